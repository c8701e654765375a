"""k-means with ns-bounds, fill-in-middle frames, exact dedup by snapshots."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from lendscope.llm import frames, nskmeans, registry, snapshots
from lendscope.llm.fuse import Fuse

SF = "/root/testdata/sf0.001"
EMBEDDINGS = "vec_id long, embedding array<float>, label int, cluster int, x string"


def against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(cur.fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want and want


@pytest.mark.parametrize("name", ["op11_ns_bounds", "op12_fill_in_middle", "op13_exact_dedup"])
def test_sql(spark, name):
    against_sql(spark, name)


# ---- k-means

def plain_kmeans(rows, k, rounds, dims, scale, salt):
    """Every distance in every round, in Python integers."""
    kept = [(i, [int(np.floor(scale * float(v))) for v in e]) for i, e in rows
            if e is not None and len(e) == dims and all(v is not None and np.isfinite(v) for v in e)]
    rank = sorted(kept, key=lambda r: (hashlib.sha256(f"{salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(x) for _, x in rank[:k]]

    def near(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[near(x)[0]].append(x)
        for c, xs in members.items():
            cents[c] = [sum(col) // len(xs) for col in zip(*xs)]
    out = [(i, *near(x)) for i, x in kept]
    return out, cents


def vectors(seed, n, dims, spread=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, spread, (7, dims))
    rows = [(int(i), (centers[i % 7] + rng.normal(0, 1, dims)).astype(np.float32).tolist()) for i in range(n)]
    return rows + rows[:5] + [(None, rows[0][1]), (900, None), (901, [1.0] * (dims - 1)), (902, [1.0] * (dims + 1)),
                              (903, [None] * dims), (904, [float("nan")] * dims), (905, [float("inf")] * dims)]


@pytest.mark.parametrize("seed,k,dims,scale", [(1, 7, 4, 256), (2, 17, 8, 2), (3, 9, 2, 1), (4, 300, 3, 16)])
def test_kmeans_equals_plain_rounds(spark, seed, k, dims, scale):
    rows = vectors(seed, 150, dims)
    df = spark.createDataFrame([(i, e, 0, 1, "a") for i, e in rows], EMBEDDINGS).repartition(3)
    got = nskmeans.cluster(df, k=k, dims=dims, scale=scale).collect()
    want, cents = plain_kmeans(rows, k, 5, dims, scale, "2:")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    assert sorted([(r["vec_id"], r["cluster"], r["distance"]) for r in got], key=key) == sorted(want, key=key)
    for r in got:
        mine = [w for w in want if w[1] == r["cluster"]]
        assert r["cluster_inertia"] == sum(w[2] for w in mine) and r["inertia"] == sum(w[2] for w in want)
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()


def test_bounds_use_the_norm_of_the_total_displacement():
    a, b, c = (np.array([p], np.int64) for p in ([0, 0], [8, 0], [1, 0]))  # away and back again
    rounds = nskmeans.Rounds([a, b, c])
    assert rounds.moved[0, 0] == 1 and rounds.moved[1, 0] == 7  # not 8 + 7


def test_bounds_save_distances(spark):
    rows = vectors(5, 400, 16, spread=40)
    df = spark.createDataFrame([(i, e, 0, 1, "a") for i, e in rows], EMBEDDINGS)
    state, _ = nskmeans.kmeans(nskmeans.integer_vectors(df, 16, 16), k=16, rounds=5)
    spent = [r["evaluated"] for r in state.select("evaluated").collect()]
    assert np.mean(spent) < 0.6 * 6 * 16 and min(spent) >= 17


def test_kmeans_empty_and_too_large(spark):
    none = spark.createDataFrame([], EMBEDDINGS)
    out = nskmeans.cluster(none)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                                "centroid_sha256"]
    big = spark.createDataFrame([(1, [1e30] * 64, 0, 0, "")], EMBEDDINGS)
    with pytest.raises(Exception, match="too large"):
        nskmeans.cluster(big).collect()
    # products beyond 2^53 take the integer path
    x = np.array([[1 << 26, -(1 << 26)], [5, 7]], np.int64)
    assert nskmeans.squared(x, x[::-1]).tolist() == [[int((x[i] - y) @ (x[i] - y)) for y in x[::-1]] for i in range(2)]


# ---- fill-in-middle

def plain_fim(doc, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(units), hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, form, len(p), len(m), sha(out), sha(text)


def odd_texts(seed):
    rng = np.random.default_rng(seed)
    letters = ["a", "\n", "é", "語", "😀", " ", "<", "P", "S", "M", ">", "\r", "\x00", " "]
    texts = ["".join(rng.choice(letters, rng.integers(0, 120))) for _ in range(120)]
    return [*texts, "", "\n", "\n\n", "one", "<P", "x\n<S>", "<M", "é" * 5000, "語\n" * 3000, "long " * 40_000, None]


@pytest.mark.parametrize("frame_bytes", [1, 7, 64, 1 << 16])
def test_fim_equals_plain_strings(spark, frame_bytes):
    texts = odd_texts(frame_bytes) if frame_bytes > 8 else odd_texts(frame_bytes)[:125]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a\nb\nc", 1, "x"), (3, texts[3], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, form string").repartition(3)
    out = frames.fill_in_middle(frames.store(docs, frame_bytes))
    got = sorted((tuple(r) for r in frames.digests(out).collect()), key=repr)
    assert got == sorted((plain_fim(i, t or "") for i, t, *_ in rows), key=repr)
    texts_out = {(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in frames.output_texts(out).collect()}
    assert texts_out == {(r[0], r[5]) for r in got}
    # the output can be sought in like the input: counts agree with its text
    for r in out.where("form <> 'plain'").limit(40).collect():
        f = frames.Frames.read(r["frames"], r["sizes"], r["points"], r["units"])
        text = b"".join(f.stream())
        assert f.sizes[-1] == len(text) and f.points[-1] == len(text.decode())


def test_only_cut_frames_are_opened(monkeypatch):
    text = b"".join(b"line %05d\n" % i for i in range(2000))
    held = frames.Frames.of(text, 256)
    opened = []
    monkeypatch.setattr(frames.Frames, "raw", lambda self, f, raw=frames.Frames.raw: opened.append(f) or raw(self, f))
    _, form, *_, out = frames.arrange(held, False, 5)
    assert form != "plain" and len(set(opened)) <= 2  # two cuts
    assert len(out.frames) >= len(held.frames)


def test_fim_rates_and_empty(spark):
    docs = spark.createDataFrame([(i, "a\nb\nc\n") for i in range(400)], "doc_id long, text string")
    some = frames.fill_in_middle(frames.store(docs), rate=25, spm_rate=0).groupBy("form").count().collect()
    share = {r["form"]: r["count"] / 400 for r in some}
    assert set(share) == {"plain", "psm"} and 0.15 < share["psm"] < 0.35
    assert frames.digests(frames.fill_in_middle(frames.store(docs.limit(0)))).count() == 0


# ---- filters and snapshots

@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 100, 5000, 30_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    f = Fuse.build(np.concatenate([keys, keys[:7]]))
    assert f.holds(keys).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 100_000, dtype=np.uint64)
    assert f.holds(others).mean() < 0.006
    if n >= 5000:
        assert len(f.prints) < 1.4 * n
    assert np.array_equal(Fuse.build(keys[::-1]).prints, f.prints)


def copies(seed, n=300):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(50)], rng.integers(0, 6))) for _ in range(n)]
    for i in range(0, n, 3):
        texts[i] = "the  hot\ttext \n of many" if i % 2 else "the hot text of many"
    return [*texts, None, "", " \r\n", " ", "\x1c", "abc " * 30_000, "abc" * 30_000]


def plain_dedup(rows):
    groups = defaultdict(list)
    for doc, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), doc is not None, doc or 0, doc))
    out = []
    for doc, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        out.append((doc, min(groups[norm])[3], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("batches", [1, 2, 4])
def test_dedup_equals_plain_grouping(spark, monkeypatch, batches):
    monkeypatch.setattr(snapshots, "SHARD_KEYS", 16)
    monkeypatch.setattr(snapshots, "PROBE_KEYS", 8)
    monkeypatch.setattr(snapshots, "HOT", 20)
    rows = list(enumerate(copies(batches)))
    rows += rows[:4] + [(None, "x y"), (None, "xy"), (5000, "x  y ")]
    df = spark.createDataFrame([(i, t, "k", True) for i, t in rows], "doc_id long, text string, key string, kept boolean")
    got = snapshots.dedup(df.repartition(5), batches).collect()
    key = lambda r: repr(r)
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(
        plain_dedup(rows), key=key)
    stay = [r for r in got if r["kept"]]
    assert len(stay) == len({r["text_sha256"] for r in got}) and all(r["doc_id"] == r["keep_id"] for r in stay)


def test_batches_meet_older_snapshots_by_bytes(spark, monkeypatch):
    """Every text of the second batch is looked for; with keys that collide, only equal bytes make a member."""
    from pyspark.sql import functions as F

    real = snapshots.own_groups
    monkeypatch.setattr(snapshots, "own_groups", lambda rows: real(rows).withColumn("key", F.col("key") % 3))
    rows = list(enumerate(copies(9, 60)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in snapshots.dedup(df, 3).collect()]
    assert sorted(got) == sorted(plain_dedup(rows))


def test_snapshots_hold_only_new_texts(spark):
    from lendscope.llm.common import shared_dir

    store = snapshots.Store(spark, shared_dir(spark, "test-store"))
    first = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(4, "a  b"), (5, "d"), (6, "d ")], "doc_id long, text string")
    rows = [store.ingest(first), store.ingest(second), store.ingest(second.limit(0))]
    texts = [sorted(bytes(r["text"]) for r in store.texts(k).collect()) for k in range(3)]
    assert texts == [[b"ab", b"c"], [b"d"], []]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in snapshots.report(rows, store).collect()}
    assert got == {1: (4, 3, False), 2: (4, 3, False), 4: (4, 3, True), 3: (3, 1, True), 5: (6, 2, False), 6: (6, 2, True)}
    assert snapshots.dedup(first.limit(0)).count() == 0
