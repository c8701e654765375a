"""Benchmark decontamination by a prefix-filtered set join (DataFrame functions only).

A window is ``window`` consecutive item words (a shorter item is one window).  Windows and documents are sets of
shingles (``k`` consecutive words).  A document contains a window only if it contains every shingle of it, so one
necessary shingle is enough to find it, and the rarest in the corpus is the cheapest: that is the window's prefix.

1. Every document shingle is looked up among the benchmark's shingles; what matches, with its position, is the
   document side of the join, and its row counts give the global rarity order.
2. Each window's prefix (rarest shingle, smallest hash on ties) is joined with it.  A hit puts the item beside the
   document at one offset (document position minus item position); windows that share a prefix share the offset.
3. Offsets at which no whole window lies inside the document are dropped (length and position bounds).
4. The rest is verified word by word, window by window, against the whole document.

At scale: words are cut from every text once, in one pass that keeps a row for each document (its number of words) and
the shingles found in a broadcast table (only if the benchmark has at most ``BROADCAST_ROWS`` distinct shingles, else by a
shuffled join), stored in the shared folder.  Only documents with candidates are read again; their keys are broadcast
under the same bound, else joined by a shuffle.  A document meets an item's words once, with all offsets, and work on it is
bound by its own length times the items that truly share its rarest words; nothing is collected, no pair of documents is
ever formed.  A row is known by its id and two independent 64-bit hashes of its text.

Null or empty text: no words, not contaminated.  An item without words (or null) never occurs.  Null ``doc_id``: a
document of its own.  Rows that repeat a ``doc_id`` are judged one by one.  Items that repeat an ``item_id`` are
one item with the windows of all its texts; a null ``item_id`` is the empty string.  Empty documents: no rows; empty benchmark: nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW, SHINGLE = 13, 3
BROADCAST_ROWS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z to a-z only: ``lower`` where every character is one byte, else character by character."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.regexp_extract_all(folded(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(w: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order.  They only propose candidates; words decide."""
    return F.when(F.size(w) >= size, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))),
        lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(size)]))).otherwise(
            F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(key, len, shingle, at, start): every window with the shingles it has; ``at`` is the item position."""
    size = F.least(F.lit(window), F.size("iw"))
    own = items.select(
        "key", F.size("iw").alias("n"), size.alias("size"), F.least(F.lit(k), F.size("iw")).alias("len"),
        F.posexplode(F.when(F.size("iw") >= k, shingles(F.col("iw"), k))
                     .when(F.size("iw") == 2, shingles(F.col("iw"), 2)).otherwise(shingles(F.col("iw"), 1)))
        .alias("at", "shingle"))
    first = F.greatest(F.lit(0), F.col("at") + F.col("len") - F.col("size"))
    last = F.least(F.col("at"), F.col("n") - F.col("size"))
    return own.select("key", "len", "shingle", "at", F.explode(F.sequence(first, last)).alias("start"))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


KEY = ["doc_id", "d1", "d2"]


def same_key(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["d1"] == b["d1"]) & (a["d2"] == b["d2"])


def matches(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """One row for each document (``pos`` -1, with ``n_words``) and one for each of its shingles that the windows have."""
    bench = wins.select("shingle", "len").distinct()
    sizes = sorted(r["len"] for r in bench.select("len").distinct().collect())  # at most k values
    cut = docs.select(*KEY, words(F.col("text")).alias("w"))
    # element 0 stands for the document; its own hash keeps it from being a hot key where the join is shuffled
    every = cut.select(*KEY, F.size("w").cast("long").alias("n_words"),
                       F.concat(F.array("d1"), *[shingles(F.col("w"), n) for n in sizes]).alias("every"))
    # outer, though never empty: Spark would put a filter on the array's size below the extraction and cut all words anew
    # for every shingle that the filter counts
    rows = every.select(*KEY, "n_words", F.posexplode_outer("every").alias("i", "shingle"))
    known = small(bench.select("shingle").distinct().withColumn("known", F.lit(True)))
    pos, start = F.lit(-1).cast("long"), F.lit(1).cast("long")
    for n in sizes:  # the shingles of each size follow each other
        pos = F.when(F.col("i") >= start, F.col("i") - start).otherwise(pos)
        start = start + F.greatest(F.col("n_words") - (n - 1), F.lit(0).cast("long"))
    return rows.join(known, "shingle", "left").where((F.col("i") == 0) | F.col("known")).select(
        *KEY, "n_words", pos.cast("long").alias("pos"), "shingle")


def candidates(found: DataFrame, wins: DataFrame) -> DataFrame:
    """doc key, item key, diagonals: where windows of the item can lie in the document."""
    found = found.where("pos >= 0")
    rarity = found.groupBy("shingle").count()
    # a window whose shingles do not all occur somewhere cannot occur: its rarest one has no row here
    prefix = small(wins.join(rarity, "shingle", "left").groupBy("key", "start")
                   .agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "at")).alias("p"))
                   .where("p.count > 0").select("key", "p.shingle", "p.at").distinct())
    return found.join(prefix, "shingle").groupBy(*KEY, "key").agg(F.collect_set(F.col("pos") - F.col("at")).alias("diagonals"))


def verified(rows: DataFrame, window: int) -> DataFrame:
    """Document key, ``n_hit`` and ``names`` of documents (``text``) beside their candidate items (``beside``)."""
    w, n = F.col("w"), F.size("w")

    def at_offset(c: Column, d: Column) -> Column:
        """Word by word: a 1 for each item word that equals the document's at this offset, over their overlap."""
        first = F.greatest(F.lit(0).cast("long"), -d)
        over = F.greatest(F.least(F.size(c["iw"]).cast("long"), n - d) - first, F.lit(0).cast("long"))
        # element by element: a slice would copy the whole document's array for every offset
        same = F.when(over > 0, F.transform(
            F.sequence(F.lit(0).cast("long"), F.greatest(over - 1, F.lit(0).cast("long"))),
            lambda j: F.when(F.element_at(w, (first + d + j + 1).cast("int"))
                             == F.element_at(c["iw"], (first + j + 1).cast("int")), "1").otherwise("0"))
        ).otherwise(F.array().cast("array<string>"))
        return F.struct((first + d).alias("at"), over.alias("over"), F.array_join(same, "").alias("same"))

    def starts(c: Column, x: Column) -> Column:
        """Document positions where a whole window stands, times ``window + 1``, plus the window's size."""
        size = F.least(F.lit(window), F.size(c["iw"]))
        hits = F.filter(F.sequence(F.lit(0).cast("long"), F.greatest(x["over"] - size, F.lit(0).cast("long"))),
                        lambda s: F.substring(x["same"], (s + 1).cast("int"), size) == F.repeat(F.lit("1"), size))
        code = F.transform(hits, lambda s: (x["at"] + s) * (window + 1) + size)
        return F.when(x["over"] >= size, code).otherwise(F.array().cast("array<bigint>"))

    over = F.transform("beside", lambda c: F.struct(
        c["item"].alias("item"), c["iw"].alias("iw"),
        F.transform(c["diagonals"], lambda d: at_offset(c, d)).alias("offsets")))
    found = F.transform("over", lambda c: F.struct(
        c["item"].alias("item"), F.flatten(F.transform(c["offsets"], lambda x: starts(c, x))).alias("starts")))
    hit = F.filter("found", lambda c: F.size(c["starts"]) > 0)
    # a window's place counts once, however many items stand there
    places = F.array_distinct(F.flatten(F.transform("hit", lambda c: c["starts"])))
    covered = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(
        F.floor(p / (window + 1)), F.floor(p / (window + 1)) + p % (window + 1) - 1))))
    return (rows.select(*KEY, "beside", words(F.col("text")).alias("w")).withColumn("over", over).drop("beside", "w")
            .withColumn("found", found).drop("over").withColumn("hit", hit)
            .select(*KEY, F.size(covered).cast("long").alias("n_hit"),
                    F.array_sort(F.array_distinct(F.transform("hit", lambda c: c["item"]))).alias("names")))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
    items = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                              words(F.col("text")).alias("iw"))
             .where(F.size("iw") > 0).distinct().withColumn("key", F.xxhash64("item", "iw")))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumns({"d1": F.xxhash64("doc_id", "text"), "d2": F.xxhash64(F.lit(window), F.col("text"))})
    wins = stored(item_windows(items, window, k), "decontam-windows")
    found = stored(matches(docs, wins), "decontam-matches")
    near = candidates(found, wins).join(items, "key")
    beside = stored(near.groupBy(*KEY).agg(F.collect_list(F.struct("item", "diagonals", "iw")).alias("beside")),
                    "decontam-beside")
    asked = small(beside.select(*KEY))
    again = docs.join(asked, same_key(docs, asked), "left_semi")
    rows = again.join(beside, same_key(again, beside)).select(*[again[c] for c in KEY], "text", "beside")
    # rows that repeat id and text have one verdict
    verdict = verified(rows, window).dropDuplicates(KEY)
    every = found.where("pos = -1").select(*KEY, "n_words")
    out = every.join(verdict, same_key(every, verdict), "left").select(
        every["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("names", F.array().cast("array<string>")).alias("names"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


#: The same in DuckDB: every window of every item against every window of every document.
SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM benchmark),
iw AS (SELECT DISTINCT item, len(x) AS size, array_to_string(x, ' ') AS win FROM (
         SELECT item, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [w]
           ELSE list_transform(range(1, len(w) - 11), lambda p: w[p:p + 12]) END) AS x FROM i)),
dw AS (SELECT doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS win FROM (
         SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS p
         FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
h AS (SELECT dw.doc_id, iw.item, dw.p, dw.size FROM dw JOIN iw USING (size, win)),
c AS (SELECT doc_id, count(*) AS n_hit FROM (
        SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS at FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
        SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
