import hashlib
import zlib

import numpy as np
import pytest

from lendscope.llm import chat, dac, packing, registry
from lendscope.llm.tokens import Encoder

TEXTS = ["", None, " ", "a  b", "It's the end.\nOf, the line...", " lead", "trail ", "tab\there and nbsp\u00a0x", "ÉCOLE été. Über",
         "<|endoftext|> x", "a\n\n b", "x!. y?!, (z).", "word " * 300, "\u0301a e\u0301.", "don't. can't", "\0 nul", "1,234.5. 7"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_memo_equals_whole_encoding(name):
    enc = Encoder(registry.vocabulary(name), words=50, parts=20)
    for _ in range(2):
        assert enc.encode(TEXTS) == [enc.whole(t or "") for t in TEXTS]


# letters whose lower case is longer, marks that combine, white space of all kinds, control characters, special strings
ODD = ["İ", "ß", "ẞ", "Å", "Å", "ſ", "ﬁ", "µ", "ª", "²", "é", "É", "e\u0301", "\u0301", "\u0307", "Σ", "ς", "ŉ", "語", "😀", "한", "\u200b",
       "\0", "\x1c", "\x85", "\u2028", "\u3000", "\xa0", "\t", "\r", "\n", "\n\n", " ", " ", " ", "  ", ".", ",", "'s", "'S", "'ll", "'",
       '"', "!", "$$", "0", "12", "٣", "a", "B", "word", "The", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "×", "÷", "ÿ", "Ÿ"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_odd_strings_equal_whole_encodings(name):
    rng = np.random.default_rng(11)
    enc = Encoder(registry.vocabulary(name), words=5000, parts=2000)
    size = rng.integers(1, 12, 100_000)
    pick = rng.integers(0, len(ODD), int(size.sum()))
    texts, at = [], 0
    for n in size.tolist():
        texts.append("".join(ODD[i] for i in pick[at:at + n]))
        at += n
    texts += ["İ,.", "K \0", "a" * 100_000, ". " * 5000, "x" * 300 + " y", " ".join("é" * k for k in range(250))]
    whole = [np.array(e.ids, "<u4").tobytes() for e in enc.tok.encode_batch_fast(texts, add_special_tokens=False)]
    got = enc.encode(texts)
    wrong = [t for t, g, w in zip(texts, got, whole) if g != w]
    assert not wrong, wrong[:5]
    assert sum(len(m) for m in enc.parts) <= 4000 and not any(len(w) > 200 for m in enc.words for w in m)


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, piece string")


def test_packing_whole_and_gapless(spark):
    texts = TEXTS + ["lorem ipsum dolor " * 60] * 20
    docs = frame(spark, texts, [None, *range(1, len(texts))])
    out = packing.pack(docs, registry.vocabulary("word_bpe_49k.json"), capacity=64, shard_docs=10).toPandas()
    enc = Encoder(registry.vocabulary("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        ids = np.frombuffer(enc.whole(t or ""), "<u4").tolist() + [1]
        got = out[out.doc_id.isna() if i == 0 else out.doc_id == i].sort_values("piece")
        parts = [ids[k:k + 64] for k in range(0, len(ids), 64)]
        assert got.length.tolist() == [len(p) for p in parts] and got.start.tolist() == list(range(0, len(ids), 64))
        assert got.ids_crc32.tolist() == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in parts]
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 64
    assert packing.pack(docs.limit(0), registry.vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(score):
    length = np.random.default_rng(1).integers(1, 60, 500)
    seq, off = packing.best_fit(length, 64, 5, 4000, score)
    for s in np.unique(seq):
        own = length[seq == s]
        assert own.sum() <= 64 and len(own) <= 5 and ((own ** 2).sum() <= 4000)
    if score == "norm":
        seq, _ = packing.best_fit(length, 64, 10 ** 6, 10 ** 9, score)
        room = []
        for n in sorted(length, reverse=True):  # plain best fit, decreasing
            fits = [r for r in room if r >= n]
            if fits:
                room.remove(min(fits))
            room.append(min(fits, default=64) - n)
        assert len(np.unique(seq)) <= len(room) + 2
    with pytest.raises(ValueError):
        packing.best_fit(length, 10, 5, 4000)


def test_codes_random_access():
    ids = np.random.default_rng(2).choice([0, 1, 255, 256, 65535, 65536, 2 ** 32 - 1, 300], 3000).astype(np.uint32)
    codes = dac.Codes(dac.encode(ids))
    at = np.random.default_rng(3).integers(0, 3000, 500)
    assert (codes.take(at) == ids[at]).all()
    for a, b in [(0, 3000), (5, 5), (511, 513), (1234, 2999)]:
        assert (codes.run(a, b) == ids[a:b]).all()
    assert len(dac.Codes(dac.encode(ids[:0])).run(0, 0)) == 0
    with pytest.raises(IndexError):
        codes.run(0, 3001)


def test_codes_files(spark):
    docs = frame(spark, TEXTS, [None, *range(len(TEXTS) - 1, 0, -1)]).repartition(3)
    name = registry.vocabulary("byte_bpe_50k.json")
    out = dac.round_trip(docs, name).toPandas().sort_values("doc_id", na_position="first")
    enc = Encoder(name)
    ids = [enc.whole(t or "") + b"\0" * 4 for t in [TEXTS[0], *TEXTS[:0:-1]]]
    assert out.n_tokens.tolist() == [len(x) // 4 for x in ids]
    assert out.start.tolist() == [0, *np.cumsum(out.n_tokens)[:-1]]
    assert out.ids_crc32.tolist() == [zlib.crc32(x) for x in ids]
    assert dac.round_trip(docs.limit(0), name).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "<|end|>\n\\l [INST]"), (1, 0, "user", None), (1, 1, "assistant", "tie"), (None, 0, None, "x"),
            (2, 0, "assistant", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.digest(chat.format_turns(turns)).collect()}
    texts = ["<|end|>\n\\l [INST]", "tie"]
    one = out[1]
    assert one.n_turns == 3 and one.loss_chars == sum(map(len, texts))
    assert one.turns_sha256 == hashlib.sha256(("user\n\n" + "".join(f"assistant\n{t}\n" for t in texts)).encode()).hexdigest()
    assert one.loss_sha256 == hashlib.sha256("".join(texts).encode()).hexdigest()
    assert out[None].n_turns == 1 and out[2].loss_chars == 0
    assert chat.digest(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    parts = [("text", "see <|image:0|>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None),
             ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3)]
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)],
                                  f"conv_id long, turn long, role string, parts {part}")
    out = chat.format_turns(turns).orderBy("turn").collect()
    assert out[0].refs == ["a.png", "b.wav", "c.pdf"] and out[0].media_tokens == 4 + 50 + 1536
    assert out[0].formatted == "<|turn:user|>\nsee \\l|image:0|><|image:0|><|audio:1|><|document:2|><|end|>\n"
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])


def test_each_capacity_binds():
    import numpy as np

    from lendscope.llm import packing
    length = np.full(12, 10)
    for capacity, max_docs, max_cost in ((30, 12, 10 ** 6), (1000, 3, 10 ** 6), (1000, 12, 300)):
        seq, _ = packing.best_fit(length, capacity, max_docs, max_cost)
        assert np.bincount(np.asarray(seq)).max() == 3 and len(set(seq)) == 4


def test_workers_forget_vocabularies_where_no_ids_are_cut():
    from lendscope.llm.letters import part_words
    from lendscope.llm.tokens import encoder
    path = registry.vocabulary("word_bpe_49k.json")
    assert encoder(path).encode(["one two"]) and encoder.cache_info().currsize == 1
    words, counts = part_words([b"one two"])
    assert counts.tolist() == [2] and encoder.cache_info().currsize == 0


def test_plain_texts_are_cut_at_once():
    texts = ["It's the end.\nOf, the  line...", "ÉCOLE été. Über\n\n 1,234.5 ", "a\n", " lead", "'s x 's", "word " * 300]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = Encoder(registry.vocabulary(name))
        expected = [enc.whole(t) for t in texts]
        enc.whole = None  # no text goes to the library whole, and no words are looked up
        assert enc.encode(texts) == expected and not any(enc.words)


def test_a_segment_is_decoded_once(monkeypatch):
    calls, run = [], dac.Codes.run
    monkeypatch.setattr(dac.Codes, "run", lambda self, a, b: calls.append((a, b)) or run(self, a, b))
    ids = np.arange(0, 90_000, 9, dtype=np.uint32)
    size = np.array([0, 4000, 1, 0, 5999])
    crc = dac.checksums(dac.Codes(dac.encode(ids)), size)
    ends = np.cumsum(size)
    assert crc == [zlib.crc32(ids[b - n:b].astype("<u4").tobytes()) for n, b in zip(size, ends)]
    assert calls == [(0, 10_000)]
