from pyspark.sql import functions as F

import corpus_pipeline
from lendscope.llm import decontam, jaccard, packing, registry, rules
from lendscope.llm.common import stored, table
from lendscope.llm.tokens import PARTS, SMALL, WORDS, encoder, release

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stored(stage(spark, docs, SF), f"test-{name}")
        before, after = {r.doc_id: r for r in docs.collect()}, [r for r in out.collect()]
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in rules.judge(docs, table(spark, SF, "labels")).collect()}
            assert sorted(r.doc_id for r in after) == sorted(i for i, kept in verdict.items() if kept)
        elif name == "jaccard_join":
            group = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(docs).collect()}
            assert sorted(r.doc_id for r in after) == sorted(set(group.values()))
        elif name == "decontamination":
            bad = {r.doc_id for r in decontam.decontaminate(docs, table(spark, SF, "benchmark")).collect() if r.contaminated}
            assert sorted(r.doc_id for r in after) == sorted(before.keys() - bad)
        elif name == "pii":
            assert sorted(r.doc_id for r in after) == sorted(before)
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            assert {r.doc_id for r in after} == before.keys()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        docs = out


def test_empty_table(spark):
    docs = table(spark, SF, "documents").where("doc_id < -1")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = stored(out, "test-empty")
        assert docs.count() == 0


def test_repeated_and_null_ids_are_judged_by_row(spark):
    item = next(r.text for r in table(spark, SF, "benchmark").collect() if len(r.text.split()) > 20)
    near, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = table(spark, SF, "documents")
    rows = [(1, item), (1, other), (None, item), (2, near), (2, near), (3, near + " end"), (3, other + " x y z"), (4, "alone it is")]
    made = spark.createDataFrame(rows, "doc_id long, text string").select(
        *[F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns],
        F.lit("clash").alias("_row"))

    def left(stage):
        out = stage(spark, made, SF)
        assert out.columns == made.columns and {r._row for r in out.select("_row").collect()} == {"clash"}
        return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)

    assert left(corpus_pipeline.decontamination) == sorted((r for r in rows if r[1] != item), key=repr)
    # one row of each group stays, also of rows that are the same in every column
    assert left(corpus_pipeline.near_duplicates) == sorted([(1, other), (None, item), (2, near), (4, "alone it is")], key=repr)


def test_last_stage_packs_with_small_memos_as_with_large_ones(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(packing, "pieces", lambda *a, run=packing.pieces: seen.append(a[-1]) or run(*a))
    docs = table(spark, SF, "documents")
    small, large = corpus_pipeline.pack_sequences(spark, docs, SF), packing.pack(docs, registry.vocabulary("word_bpe_49k.json"))
    assert seen == [SMALL, (WORDS, PARTS)] and all(4 * s < w for s, w in zip(SMALL, (WORDS, PARTS)))
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))


def test_workers_hold_one_set_of_memos():
    path = registry.vocabulary("word_bpe_49k.json")
    assert encoder(path, *SMALL).limits == SMALL and encoder(path).limits == (WORDS, PARTS)
    assert encoder.cache_info().currsize <= 2
    release()


def test_batches_of_texts_are_bounded_in_bytes(spark):
    from lendscope.llm.common import ready, sliced

    ready(spark)
    docs = spark.range(3000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    n = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert sum(n) == 3000 and max(n) <= 1500  # 10 KB each
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(1100))], names=["n"])
    assert [b.num_rows for b in sliced(batch)] == [500, 500, 100] and not list(sliced(batch.slice(0, 0)))
    assert [v for b in sliced(batch) for v in b.column(0).to_pylist()] == list(range(1100))


def test_blocks_of_texts_give_the_same_sets(monkeypatch):
    import numpy as np

    texts = [b"", b"one", b"a b c d e f g", b" ".join(b"w%d" % (k % 37) for k in range(400)), b"A B C D E", b"\n", b"x y z v w"]
    sizes, part_words = [], jaccard.part_words
    monkeypatch.setattr(jaccard, "part_words", lambda t: sizes.append(sum(map(len, t))) or part_words(t))
    whole = jaccard._sets(texts, 5)
    sizes.clear()
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 4)
    parts = jaccard._sets(texts, 5)
    assert len(sizes) > 2 and len(parts) == len(texts) and all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_quality_stores_no_copy_of_the_texts(spark, monkeypatch, capsys):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    columns = []
    monkeypatch.setattr(rules, "stored", lambda df, *a: columns.append(df.columns) or stored(df, *a))
    out = rules.keep(docs, labels)
    assert columns and not any({"text", "_row"} & set(c) for c in columns)
    capsys.readouterr()
    out.explain()
    assert capsys.readouterr().out.count("regexp_extract_all") == 1  # the filter does not compute the words anew
    assert 0 < out.count() < docs.count()


def test_numbered_rows_are_compressed_well(spark):
    rows, row = corpus_pipeline.numbered(spark.range(10).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))
    assert all(f.endswith(".zstd.parquet") for f in rows.inputFiles())
    assert rows.select(row).distinct().count() == 10


def test_jaccard_letters_take_three_bytes_and_overlook_no_shingle():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    low = rng.integers(0, 1 << 32, 4000, dtype=np.uint64).astype("<u4")
    low[:4] = [0, 1, (1 << 24) - 1, (1 << 32) - 1]
    assert len(jaccard._pack(low)) == 3 * len(low) and jaccard._pack(low[:0]) == b""
    assert np.array_equal(jaccard._unpack(jaccard._pack(low)), low & 0xFFFFFF)
    other = np.concatenate([low[:100], rng.integers(0, 1 << 32, 50, dtype=np.uint64).astype("<u4")])
    one, two, none = jaccard._occurrences([0, 1, 2], [jaccard._pack(a) for a in (low, other, low[:0])])
    ranks = [np.frombuffer(pa.decompress(z, len(a), "zstd", asbytes=True), np.uint8) for z, a in ((one, low), (two, other))]
    assert (ranks[0][:100] >= 4).all() and (ranks[1][:100] >= 4).all() and none is None
    assert (ranks[0][100:] > 0).mean() < 0.01


def test_jaccard_sweeps_between_rounds(spark, monkeypatch):
    seen, swept = [], jaccard.swept
    monkeypatch.setattr(jaccard, "stored", lambda df, name: seen.append(name) or stored(df, name))
    monkeypatch.setattr(jaccard, "swept", lambda s: seen.append("swept") or swept(s))
    jaccard.jaccard_groups(table(spark, SF, "documents")).count()
    after = [b for a, b in zip(seen, seen[1:]) if a in ("jaccard-nodes", "jaccard-points", "jaccard-distances")]
    assert len(after) >= 3 and set(after) == {"swept"}
