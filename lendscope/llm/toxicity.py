"""Toxicity scores: Levenshtein automata over a lexicon trie, with context windows.

A lexicon is learned from training labels: words that occur almost only in toxic texts, and stems (word beginnings
with several such endings).  The lexicon is a trie; each document word is a Levenshtein automaton run against it, so
misspelled terms are found without comparing the word with every term.  A hit is looked at in its window: inside
quotation marks or after a reporting word it counts as quotation, else as abuse.  A logistic model over the hit
counts gives the score.

At scale: lexicon and model come from a sample of at most ``SAMPLE`` training documents (smallest key hashes, one of
each group of copies); word counts are summed per task before the shuffle.  Scoring is map-only over all whole texts; each worker remembers the
verdict of words it has seen in a bounded memo.

Null or empty text: no hits, the model's base score.  Null ``doc_id``: held out (it has no remainder), scored.
Repeated rows: scored row by row.  No usable labels: an empty lexicon and the smoothed share of toxic labels as score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FOLD, ready, stored

SAMPLE = 20_000
MEMO = 1_000_000
#: Least toxic documents of a term, and their least share among all documents with it.
SUPPORT, PURITY = 5, 0.9
#: Lengths of stems; words have three letters at least.
STEMS = (4, 5, 6)
#: Words that report what somebody else said (fixed values, natural order).
REPORTING = ("said", "says", "wrote", "quoted", "called", "word", "term", "dit", "dijo", "sagte")
SPAN = 60
_OPEN, _CLOSE = ('"', "«", "“", "„"), ('"', "»", "”", "“")


class Lexicon(NamedTuple):
    words: tuple[str, ...]
    stems: tuple[str, ...]


def edits(term: str, stem: bool) -> int:
    """Edits allowed for a term: short ones must match exactly; a stem tolerates fewer, as its ending is free."""
    n = len(term)
    return int(n >= 5) if stem else 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """Levenshtein automaton of a word: states are rows of (position, edits) with at most ``k`` edits."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> dict[int, int]:
        return {i: i for i in range(min(self.k, len(self.word)) + 1)}

    def step(self, state: dict[int, int], char: str) -> dict[int, int]:
        out: dict[int, int] = {}

        def reach(i: int, e: int) -> None:
            if e <= self.k and e < out.get(i, self.k + 1):
                out[i] = e

        for i, e in state.items():
            reach(i, e + 1)  # the trie has a character more
            if i < len(self.word):
                reach(i + 1, e + (self.word[i] != char))
        for i in sorted(out):  # the word has a character more
            j, e = i + 1, out[i] + 1
            while j <= len(self.word) and e <= self.k and e < out.get(j, self.k + 1):
                out[j] = e
                j, e = j + 1, e + 1
        return out

    def distance(self, state: dict[int, int]) -> int | None:
        return state.get(len(self.word))


def shortened(word: str, k: int) -> set[str]:
    """The word and all it becomes when up to ``k`` letters are left out."""
    out = last = {word}
    for _ in range(k):
        last = {w[:i] + w[i + 1:] for w in last for i in range(len(w))}
        out = out | last
    return out


class Trie:
    def __init__(self, lexicon: Lexicon):
        self.root: dict = {}
        self.k = 0
        #: by edits allowed: the lengths that a match can have, the terms with so many letters left out
        self.near: dict[tuple[bool, int], tuple[set[int], set[str]]] = {}
        #: by length of the word (None: any): the pieces of terms that may stand at a place
        places: dict[int | None, dict[tuple[int, int], set[str]]] = {}
        for term, stem in [(t, False) for t in lexicon.words] + [(t, True) for t in lexicon.stems]:
            node, k = self.root, edits(term, stem)
            for c in term:
                node = node.setdefault(c, {})
                node["edits"] = max(k, node.get("edits", 0))  # most that any term below allows
            node["stem" if stem else "word"] = term
            self.k = max(self.k, k)
            lengths, near = self.near.setdefault((stem, k), (set(), set()))
            lengths.update(range(len(term) - k, len(term) + k + 1))
            near |= shortened(term, k)
            size = len(term) / (k + 1)  # of k + 1 pieces, k edits leave one whole
            for i in range(k + 1):
                a, b = round(i * size), round((i + 1) * size)
                for n in (None,) if stem else range(len(term) - k, len(term) + k + 1):
                    for move in range(-i, i + 1):  # one with at most i edits before and k - i behind it
                        if a + move >= 0 and (stem or abs(n - len(term) - move) <= k - i):
                            places.setdefault(n, {}).setdefault((a + move, b + move), set()).add(term[a:b])
        self.places = {n: [(a, b, frozenset(p)) for (a, b), p in at.items()] for n, at in places.items()}

    def screen(self, word: str) -> bool:
        """Can the word match? First by pieces, then by ``near_term``."""
        for n in (len(word), None):
            for a, b, pieces in self.places.get(n, ()):
                if word[a:b] in pieces:
                    return self.near_term(word)
        return False

    def near_term(self, word: str) -> bool:
        """Strings within ``k`` edits become equal when at most ``k`` letters of each are left out."""
        for (stem, k), (lengths, near) in self.near.items():
            if stem:
                if any(n <= len(word) and not near.isdisjoint(shortened(word[:n], k)) for n in lengths):
                    return True
            elif len(word) in lengths and not near.isdisjoint(shortened(word, k)):
                return True
        return False

    def find(self, word: str) -> tuple[str, int] | None:
        """(kind, edits) of the closest term; kinds: word, stem, fuzzy."""
        if not self.screen(word):
            return None
        node: dict | None = self.root
        for c in word:  # without edits there is one path
            if (node := node.get(c)) is None:
                break
            if "stem" in node:
                return "stem", 0
        if node is not None and "word" in node:
            return "word", 0
        auto, best = Automaton(word, self.k), None
        stack = [(self.root, auto.start())]
        while stack:
            node, state = stack.pop()
            if (term := node.get("word")) is not None:
                d = auto.distance(state)
                if d is not None and d <= edits(term, False) and (best is None or d < best[1]):
                    best = ("word" if d == 0 else "fuzzy", d)
            if (term := node.get("stem")) is not None:
                # a misspelled stem has an ending; without one it is a word, and words have edits of their own
                d = min((e for i, e in state.items() if e == 0 or i < len(word)), default=None)
                if d is not None and d <= edits(term, True) and (best is None or d < best[1]):
                    best = ("stem" if d == 0 else "fuzzy", d)
            for c, child in node.items():
                if len(c) == 1:
                    after = {i: e for i, e in auto.step(state, c).items() if e <= child["edits"] and (best is None or e < best[1])}
                    if after:
                        stack.append((child, after))
        return best


class Scanner:
    """Finds lexicon hits of texts."""

    def __init__(self, lexicon: Lexicon):
        self.trie = Trie(lexicon)
        self.seen: set[bytes] = set()
        self.hits: dict[bytes, str] = {}

    def features(self, text: str | None) -> list[float]:
        """[word, stem, fuzzy, quoted] hits seen at all, log of abusive hits, their share of the words."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        folded = raw.translate(FOLD)
        words = folded.split()
        kinds = set(words)
        new = kinds - self.seen
        if new:
            if len(self.seen) > MEMO:
                self.seen.clear()
                self.hits.clear()
                new = kinds
            for w in new:
                if found := self.trie.find(w.decode("utf-8", "surrogatepass")):
                    self.hits[w] = found[0]
            self.seen |= new
        bad = {w for w in kinds if w in self.hits}
        n = Counter()
        if bad:
            pattern = re.compile(b"(?<= )(?:" + b"|".join(map(re.escape, sorted(bad, key=len, reverse=True)))
                                 + b")(?= )")
            for m in pattern.finditer(b" " + folded + b" "):
                n["quoted" if quoted(raw, m.start() - 1, m.end() - 1) else self.hits[m[0]]] += 1
        abuse = n["word"] + n["stem"] + n["fuzzy"]
        return [float(n[k] > 0) for k in ("word", "stem", "fuzzy", "quoted")] + [
            float(np.log1p(abuse)), min(1.0, 20 * abuse / max(1, len(words)))]


@lru_cache(maxsize=1)
def scanner_of(lexicon: Lexicon) -> Scanner:
    """One per worker: the tasks of a lexicon share its trie and its memo."""
    return Scanner(lexicon)


def quoted(raw: bytes, start: int, end: int) -> bool:
    """Does the window around a hit show that it is a quotation?"""
    before = raw[max(0, start - SPAN):start].decode("utf-8", "ignore")
    after = raw[end:end + SPAN].decode("utf-8", "ignore")
    for left, right in zip(_OPEN, _CLOSE):
        opened = before.count(left) % 2 == 1 if left == right else before.rfind(left) > before.rfind(right)
        if opened and right in after:
            return True
    words = re.findall(r"[^\W\d_]+", before.lower())[-3:]
    return any(w in REPORTING for w in words)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows outside the held-out fold, by smallest key hash."""
    chosen = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # at most ``sample`` rows
    # copies would vote many times for whatever rare words they share: one text per smallest shingle hash
    rows = rows.withColumn("_words", F.split(F.coalesce("text", F.lit("")), r"\s+"))
    first = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - 4, F.lit(1))),
                                    lambda i: F.xxhash64(F.slice(F.col("_words"), i, 5))))
    one = rows.withColumn("_first", first).groupBy("_first", "toxic").agg(F.min("text").alias("text"))
    # read twice (lexicon, features): stored, so that both see the same texts and the join runs once
    return stored(one.select("text", "toxic"), "toxicity-training")


def learn_lexicon(train: DataFrame) -> Lexicon:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, every = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {w.decode("utf-8", "surrogatepass")
                         for w in (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()}
                grams = {w for w in words if len(w) > 2} | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
                every.update(grams)
                if y:
                    toxic.update(grams)
        if every:
            keys = list(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()),
                 pa.array([every[k] for k in keys], pa.int64())], names=["gram", "toxic", "n"])

    sums = (train.mapInArrow(count, "gram string, toxic long, n long").groupBy("gram")
            .agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
            .where((F.col("toxic") >= SUPPORT) & (F.col("toxic") >= PURITY * F.col("n"))))
    # all of them: bounded, as the sample has at most SAMPLE documents and a term needs SUPPORT toxic ones
    return choose({r["gram"]: r["toxic"] for r in sums.collect()})


def choose(grams: dict[str, int]) -> Lexicon:
    """The lexicon of the words and beginnings (``*`` at the end) that passed, with their toxic documents."""
    words, most = [w for w in grams if not w.endswith("*")], Counter()
    for w in words:
        for n in STEMS:
            most[w[:n]] = max(most[w[:n]], grams[w])
    stems: set[str] = set()
    for g in sorted((g for g in grams if g.endswith("*")), key=lambda g: (len(g), g)):
        beginning = g[:-1]
        # a stem has many endings: no single word accounts for nearly all of its texts
        if grams[g] >= max(2 * SUPPORT, 1.25 * most[beginning]) and not any(beginning[:n] in stems for n in STEMS):
            stems.add(beginning)
    # the words of a stem stay: a misspelled one is found by its own edits
    return Lexicon(tuple(sorted(words)), tuple(sorted(stems)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the intercept is the last weight."""
    x, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _apply(df: DataFrame, lexicon: Lexicon, keep: list[str], make, schema: str) -> DataFrame:
    """Columns ``keep`` and what ``make`` says of the features of the first column, the text."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(lexicon)
        for batch in batches:
            x = np.array([scanner.features(t) for t in batch.column(0).to_pylist()], float).reshape(-1, 6)
            out = make(x)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *out.values()], names=[*keep, *out])

    return df.select("text", *keep).mapInArrow(run, schema)


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; the labels of the held-out fold are never read."""
    ready(docs.sparkSession)
    train = training_rows(docs, labels, sample)
    lexicon = learn_lexicon(train)
    names = ["x0", "x1", "x2", "x3", "x4", "x5"]
    rows = _apply(train, lexicon, ["toxic"], lambda x: {c: pa.array(x[:, i]) for i, c in enumerate(names)},
                  "toxic int, " + ", ".join(f"{c} double" for c in names))
    # equal feature rows are counted, so at most ``sample`` rows reach the driver
    got = rows.groupBy("toxic", *names).count().collect()
    y = np.array([r["toxic"] for r in got for _ in range(r["count"])], float)
    x = np.array([[r[c] for c in names] for r in got for _ in range(r["count"])], float).reshape(-1, 6)
    if len(y) and 0 < y.sum() < len(y):
        weights = fit(x, y)
    else:
        share = (y.sum() + 1) / (len(y) + 2)
        weights = np.array([0.0] * 6 + [np.log(share / (1 - share))])

    def scores(x: np.ndarray) -> dict[str, pa.Array]:
        return {"score": pa.array(1 / (1 + np.exp(-(x @ weights[:-1] + weights[-1]))))}

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       held_out(F.col("doc_id")).alias("held_out"))
    out = _apply(text, lexicon, ["doc_id", "held_out"], scores, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
