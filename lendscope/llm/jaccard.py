"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows, exact.

d(x, y) = 1 - |x and y| / |x or y| is a metric on the documents' shingle sets; a link is d <= r = 1 - threshold.

1. Sets.  Every shingle of every document asks its bucket in how many documents it occurs (see ``letters``; one byte
   comes back).  A document with fewer than ``threshold`` of its shingles elsewhere links with nothing.
2. First regions.  In shingle space almost all documents are at distance 1 from any pivot, where the triangle
   inequality says nothing.  So level 0 has one region around each shingle that is among a document's rarest
   n - ceil(threshold * n) + 1 (two linked documents must share one of those): all members are at distance < 1 of
   each other, and distances to a pivot discriminate.
3. Recursion.  A small region is joined in full.  A large one elects as pivot its most central member (the one whose
   shingles occur most elsewhere: of a group of edited copies, the original) and every member learns its exact
   distance D to it.  Members with D <= r are linked to the pivot and so to each other.  By the triangle inequality
   they can link further only to members with D <= 2r (the window): those boundary documents are replicated into the
   pivot's cell, and the rest of the region (D > r) is a region of its own.  A region whose documents are all linked
   through its pivot is done.  What pivots have not separated after ``ROUNDS`` rounds is joined in full inside its windows.
   Pairs of a region are joined only if their sizes and the positions of its shingle in their rarity orders allow the
   overlap: a linked pair always passes at the first shingle that both documents have.
4. Documents with equal sets are one point (the smallest id); components are found by contraction of the links.

At scale: texts are shuffled once, three bytes per shingle travel, sets only of documents that can link at all; a group
of n near copies costs n distances to its pivot, not n^2 pairs.  Rounds end in tables in the shared folder, and the
shuffle files of a round go before the next.

Null or empty text: an empty set, linked with nothing.  Null ``doc_id``: the row is returned with its set size and no
component, as it has no name to link by.  Rows that repeat a ``doc_id`` are one node with the links of all its texts.
Fewer words than a shingle: the whole text is one shingle.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ready, stored, swept, window_hashes
from .letters import LETTER, answers, deal, letters, part_words, parted, read_letters, sorted_rows

SHINGLE, PERCENT = 5, 75
SMALL, ROUNDS = 4, 5
BLOCK_BYTES = 1 << 20
#: Bytes of a shingle's hash in a letter, besides the bucket it names.  A bucket holds about as many shingles as a part (a
#: million or two) whatever the input, so of 2^24 values about one in ten is taken by chance: such a shingle is looked at in
#: vain (regions and distances compare 64 bits), but none that occurs elsewhere is overlooked.
HASH_BYTES = 3
STATE = "doc_id long, n long, digest binary, points binary, prefix array<long>, first long, weight double"


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; scratch memory for a block of texts at a time."""
    out, block, held = [], [], 0
    for k, t in enumerate(texts, 1):
        block.append(t.lower())  # bytes: A-Z only
        held += len(t)
        if held < BLOCK_BYTES and k < len(texts):
            continue
        words, counts = part_words(block)
        every, end = window_hashes(words, size, 3), 0
        for c in counts.tolist():
            own = every[end:end + c - size + 1] if c >= size else window_hashes(words[end:end + c], c, 3) if c else every[:0]
            out.append(np.unique(own))
            end += c
        block, held = [], 0
    return out


def _pack(low: np.ndarray) -> bytes:
    """The low ``HASH_BYTES`` bytes of each hash (of four), back to back."""
    return low.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :HASH_BYTES].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // HASH_BYTES, 4), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    return out.view("<u4").reshape(-1)


def _occurrences(_: list[int], data: list[bytes]) -> list[bytes | None]:
    """A byte per shingle: 0 if it occurs once, else 4 log2 of its number of documents."""
    sizes = [len(d) // HASH_BYTES for d in data]
    entry = _unpack(b"".join(data))
    _, group, count = np.unique(entry, return_inverse=True, return_counts=True)
    rank = np.minimum(255, 4 * np.log2(count)).astype(np.uint8)[group]
    return [pa.compress(r.tobytes(), "zstd", asbytes=True) if r.any() else None
            for r in np.split(rank, np.cumsum(sizes)[:-1])]


def states(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: set size; for those that can link, the set and its rarest shared shingles."""
    ready(docs.sparkSession)
    rows, n = parted(docs)

    def ask(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.empty(0, np.uint64), *_sets(sorted_rows(table)[1], size)])
        order, edges = deal(keys, n)
        low = keys.astype("<u4")[order]
        return letters(table["part"][0].as_py(), n, edges, lambda a, b: _pack(low[a:b]))

    def settle(table: pa.Table, mail: pa.Table) -> pa.Table:
        ids, texts = sorted_rows(table) if table.num_rows else ([], [])
        sets = _sets(texts, size)
        keys = np.concatenate([np.empty(0, np.uint64), *sets])
        order, edges = deal(keys, n)
        rank = np.zeros(len(keys), np.uint8)
        for bucket, _, data in read_letters(mail):
            a, b = int(edges[bucket]), int(edges[bucket + 1])
            rank[order[a:b]] = np.frombuffer(pa.decompress(data, b - a, "zstd", asbytes=True), np.uint8)
        out, end, seen = [], 0, set()
        for i, own in zip(ids, sets):
            r, end = rank[end:end + len(own)], end + len(own)
            if i is None or not len(own) or 100 * int((r > 0).sum()) < percent * len(own):
                out.append((i, len(own), None, None, None, None, None))
                continue
            raw = own.astype("<u8").tobytes()
            digest = hashlib.blake2b(raw, digest_size=16).digest()
            first = np.lexsort((own, r))[:len(own) - -(-percent * len(own) // 100) + 1]
            prefix = own[first[r[first] > 0]].view(np.int64)
            new = digest not in seen  # equal sets of a part: one copy of the set is enough
            seen.add(digest)
            out.append((i, len(own), digest, raw if new else None, prefix.tolist() if new else None,
                        int((r == 0).sum()), float(r.mean())))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.float64())
        cols = zip(*out) if out else [[]] * 7
        return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                        names=["doc_id", "n", "digest", "points", "prefix", "first", "weight"])

    by_part = rows.groupBy("part")
    ranks = answers(by_part.applyInArrow(ask, LETTER), _occurrences)
    return stored(by_part.cogroup(ranks.groupBy("part")).applyInArrow(settle, STATE), "jaccard-sets")


def distances(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs (a, b, na, nb) with the size of their intersection."""
    ready(pairs.sparkSession)

    def count(batches):
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                      for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int64())],
                                             names=["a", "b", "na", "nb", "common"])

    left = points.select(F.col("node").alias("a"), F.col("points").alias("pa"))
    right = points.select(F.col("node").alias("b"), F.col("points").alias("pb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "pa", "pb")
    return both.mapInArrow(count, "a long, b long, na long, nb long, common long")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by repeated hooking to the smallest neighbour."""
    edges, seen = stored(links.select("a", "b").where("a <> b").distinct(), "jaccard-links"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every edge (a, b) becomes b - m(a): larger neighbours move to the smallest known
        hooked = (both.join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y"))
                  .unionByName(least.select(F.col("a").alias("x"), F.col("m").alias("y"))).where("x <> y"))
        after = stored(hooked.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(),
                       "jaccard-components")
        # done when nothing moves: then every node has one edge, to its component's smallest node
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        edges = after
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def links(state: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect all documents with a link between them, equal sets included."""
    named = state.where(F.col("digest").isNotNull())
    node = stored(named.groupBy("digest").agg(F.min("doc_id").alias("node")), "jaccard-nodes")
    swept(state.sparkSession)  # of texts and letters; right after their last task Spark's listeners may still hold the plan
    copies = named.join(node, "digest").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    one = (named.where(F.col("points").isNotNull())
           .withColumn("k", F.row_number().over(Window.partitionBy("digest").orderBy("doc_id"))).where("k = 1"))
    points = stored(one.join(node, "digest").select("node", "n", "points", "prefix", "first", "weight"), "jaccard-points")
    swept(state.sparkSession)
    # left: shingles from g on in the rarity order, g included (those that occur once come first, outside the prefix)
    regions = points.select(F.posexplode("prefix").alias("at", "g"), "node", "n", "first", "weight").select(
        "g", "node", "n", "weight", (F.col("n") - F.col("first") - F.col("at")).alias("left"))
    shared = regions.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    regions = stored(regions.join(shared, "g").select(
        "g", "node", "n", "left", "weight", "size", F.col("node").alias("label"), F.lit(0.0).alias("d")), "jaccard-regions")
    done = stored(copies.distinct(), "jaccard-copies")
    r, turn = 1 - percent / 100, 0
    while True:
        full = regions if turn >= ROUNDS else regions.where(F.col("size") <= SMALL)
        x, y = full.alias("x"), full.alias("y")
        near = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")  # sizes of linked sets
        # where g is the first shingle that both have, they can share no more than what is left of either
        room = (100 + percent) * F.least("x.left", "y.left") >= percent * (F.col("x.n") + F.col("y.n"))
        apart = (F.col("x.label") != F.col("y.label")) & (F.abs(F.col("x.d") - F.col("y.d")) <= r + 1e-9)
        pairs = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.node") < F.col("y.node")) & near & room & apart).select(
            F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        if turn < ROUNDS:
            large = regions.where(F.col("size") > SMALL)
            pivot = large.groupBy("g").agg(
                F.max(F.struct("weight", F.xxhash64(F.lit(turn), "node"), "node", "n")).alias("p"))
            star = large.join(pivot.select("g", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn")), "g")
            star = stored(star.where("node <> pivot").drop("d"), "jaccard-star")
            pairs = pairs.unionByName(star.select(F.col("pivot").alias("a"), F.col("node").alias("b"),
                                                  F.col("pn").alias("na"), F.col("n").alias("nb")))
        measured = stored(distances(pairs.distinct(), points), "jaccard-distances")
        swept(state.sparkSession)
        linked = 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))
        done = done.unionByName(measured.where(linked).select("a", "b"))
        if turn >= ROUNDS or star.limit(1).count() == 0:
            return done
        either = F.col("na") + F.col("nb") - F.col("common")
        seen = star.drop("label").join(
            measured.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "common", either.alias("either"),
                            (1 - F.col("common") / either).alias("d")), ["pivot", "node"])
        # the pivot's cell (members, linked through it, and the window around them), and the region beyond it
        member = F.when(100 * F.col("common") >= percent * F.col("either"), F.col("pivot")).otherwise(F.col("node"))
        cell = seen.where(F.col("d") <= 2 * r + 1e-9).select(
            F.xxhash64("g", "pivot", F.lit(0)).alias("g"), "node", "n", "left", "weight", "d", member.alias("label"))
        rest = seen.where(F.col("d") > r - 1e-9).select(
            F.xxhash64("g", "pivot", F.lit(1)).alias("g"), "node", "n", "left", "weight", "d", F.col("node").alias("label"))
        regions, turn = cell.unionByName(rest), turn + 1
        if turn >= ROUNDS:  # before the last join: what is connected by now need not be compared
            known = components(done)
            regions = regions.drop("label").join(known, "node", "left").withColumn(
                "label", F.coalesce("component", "node")).drop("component")
        open_ = (regions.groupBy("g").agg(F.count("*").alias("size"), F.min("label").alias("lo"),
                                          F.max("label").alias("hi")).where("lo <> hi").select("g", "size"))
        regions = stored(regions.join(open_, "g").select(
            "g", "node", "n", "left", "weight", "size", "label", "d"), "jaccard-regions")
        if regions.limit(1).count() == 0:
            return done


def jaccard_groups(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document row."""
    state = states(docs, size, percent)
    known = components(links(state, percent))
    out = state.select("doc_id", F.col("n").alias("n_shingles")).join(
        known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


#: The same in DuckDB: all pairs with a common shingle, then what is reachable.
SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' ')) END) AS s FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s)
         WHERE a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
link AS (SELECT x, y FROM near UNION ALL SELECT y, x FROM near),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON link.x = reach.y)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(y) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id, n
"""
