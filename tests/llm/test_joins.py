import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lendscope.llm import decontam, jaccard, registry, rules, substring
from lendscope.llm.common import FOLD, window_hashes, word_hashes

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().split()


def noisy(seed, n=60, vocabulary=400):
    """Texts with exact copies, near copies, shared passages, short, empty and repeated ones."""
    rng = np.random.default_rng(seed)
    word = [f"w{i}" for i in range(vocabulary)]
    passage = " ".join(rng.choice(word, 20))
    texts = []
    for i in range(n):
        t = rng.choice(word, rng.integers(1, 90)).tolist()
        if i % 4 == 0 and texts:
            t = texts[rng.integers(len(texts))].split()
            for _ in range(rng.integers(0, 4)):
                if t:
                    t[rng.integers(len(t))] = "edit"
        if i % 7 == 0:
            t = [*t, *passage.split()]
        texts.append(" ".join(t))
    return [*texts, "", " \n", "one two", "One  two", "same word " * 50, "same word " * 50]


def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, None, None, None)],
                                 "doc_id long, text string, part string, component int").repartition(3)


def test_word_hashes():
    a = b"  the cat\nthe\x0bcat  x"
    h = word_hashes(a)
    assert len(h) == len(a.split()) and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 3
    w = window_hashes(h, 2)
    assert w[0] == w[2] and len(set(w.tolist())) == 3 and len(window_hashes(h, 6)) == 0 and len(word_hashes(b"")) == 0


def brute_substrings(texts, size=13):
    first = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k:k + size]), i)
    out = {}
    for i, t in enumerate(texts):
        w, gone = words(t), set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone.update(range(k, k + size))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_substrings_against_brute_force(spark, seed):
    texts = noisy(seed)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.dedup_substrings(frame(spark, texts)).collect()}
    want = brute_substrings(texts)
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == (0, 0, hashlib.sha256(b"").hexdigest())
    assert sum(v[1] for v in want.values()) > 100


def test_substrings_empty(spark):
    docs = frame(spark, [])
    assert substring.dedup_substrings(docs.where("doc_id = 5")).count() == 0
    assert substring.kept_texts(docs).first()["text"] == ""


def shingles(text, k=5):
    w = words((text or "").encode().lower().decode())
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_groups(texts):
    s = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s[i]), root(i)) for i in range(len(s))}


@pytest.mark.parametrize("small", [32, 2])
def test_jaccard_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)  # 2: every region is split by pivots
    texts = noisy(3, 50)
    base = " ".join(f"b{i}" for i in range(60)).split()
    rng = np.random.default_rng(5)
    for _ in range(25):  # a group of near copies around the threshold
        t = list(base)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            t[k] = f"e{rng.integers(3)}"
        texts.append(" ".join(t))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_groups(frame(spark, texts)).collect()}
    want = brute_groups(texts)
    assert {k: v for k, v in got.items() if k is not None} == want and got[None] == (0, None)
    assert len({v[1] for v in want.values()}) < len(want) - 20


def test_jaccard_empty(spark):
    assert jaccard.jaccard_groups(frame(spark, []).where("doc_id = 5")).count() == 0


def test_decontamination_against_brute_force(spark):
    texts = [*noisy(7, 40), "a b c d", "x é É y z", "q"]
    items = {"1": texts[0], "2": "a B-c", "10": "é É", "11": None, "12": "-", "3": texts[8] + " tail", "13": "q"}
    fold = {k: (v or "").encode().translate(FOLD).split() for k, v in items.items()}
    docs = frame(spark, texts)
    bench = spark.createDataFrame([(k, v, 1) for k, v in items.items()], "item_id string, text string, doc_id int")
    got = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    for i, t in enumerate(texts):
        w, hit, found = t.encode().translate(FOLD).split(), set(), set()
        for k, v in fold.items():
            n = min(13, len(v))
            wins = {tuple(v[a:a + n]) for a in range(len(v) - n + 1)} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a:a + n]) in wins:
                    hit.update(range(a, a + n))
                    found.add(k)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found)), i
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    assert got[None].n_words == 0 and not got[None].contaminated
    assert decontam.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(docs.where("doc_id = -5"), bench).count() == 0


def test_decontamination_of_repeats_ties_and_long_texts(spark):
    item = " ".join(f"v{i}" for i in range(20))
    same = "same " * 6000
    rows = [(1, item), (1, item), (1, "other text"), (None, item), (None, None), (2, same), (3, f"x {item} " + "pad " * 30_000),
            (4, "é" * 200_000), (5, item.upper())]
    docs = spark.createDataFrame([(i, t, 7, "w", True) for i, t in rows],
                                 "doc_id long, text string, n_words int, key string, contaminated boolean").repartition(4)
    bench = spark.createDataFrame([("a", item, "z"), ("a", item, "z"), ("b", "same " * 200, "z"), (None, "pad pad", "z")],
                                  "item_id string, text string, doc string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.contaminated)
                 for r in decontam.decontaminate(docs, bench).collect())
    assert got == sorted([(True, 1, 20, 20, 1, True)] * 2 + [(True, 1, 2, 0, 0, False), (False, 0, 20, 20, 1, True),
                         (False, 0, 0, 0, 0, False), (True, 2, 6000, 6000, 1, True), (True, 3, 30_021, 30_020, 2, True),
                         (True, 4, 1, 0, 0, False), (True, 5, 20, 20, 1, True)])


def test_rules_counts_and_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "", "", 0), (-3, "a b c d e a b c d e f " * 3, "", "", 0),
                                 (-4, "x#\n\nx#\n \nx#", "", "", 0)], docs.schema)
    out = rules.judge(docs.unionByName(odd).select("doc_id", "text"), labels).toPandas()
    for r in out.itertuples():
        w = words(r.text)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        count, cover = Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                cover.update(range(i, i + 5))
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), len(b"".join(w).decode()), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)),
            len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (r.base_failed and r.kept)
    both = out.merge(labels.toPandas(), on="doc_id")
    passed = both[~both.base_failed]
    assert (passed.kept == (passed.quality == 1)).mean() > 0.95
    assert rules.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_queries_are_registered():
    names = defaultdict(list)
    for k in registry.queries():
        names[int(k[2:].split("_")[0])].append(k)
    assert sorted(names) == list(range(1, 14)) and all(len(v) == 1 for v in names.values())
