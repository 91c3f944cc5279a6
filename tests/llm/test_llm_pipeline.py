"""The pipeline, stage by stage, against brute force."""

import math
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from test_llm_documents import classes_by_hand, fixed_spans, repeats_by_hand, texts_of

import corpus_pipeline as cp
from curatrix.llm import neardup, quality
from curatrix.llm.common import table


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def test_stages_on_the_table(spark, small):
    docs = table(spark, small, "documents")
    columns, before = docs.columns, by_id(docs)

    kept = cp.stored(cp.quality_stage(spark, docs, small), "t")
    assert kept.columns == columns
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, table(spark, small, "labels")).collect()}
    assert set(by_id(kept)) == {d for d, s in scores.items() if s >= 0.3}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, small, "labels").collect()}
    lost = [d for d, q in labels.items() if q == 1 and d in before and d not in by_id(kept)]
    assert len(lost) <= 0.02 * max(1, sum(labels.values()))

    one = cp.stored(cp.near_duplicates_stage(spark, kept, small), "t")
    weights = neardup.corpus_weights(neardup._with_node(kept).select("text"))
    classes = classes_by_hand(texts_of(kept), weights)
    assert one.columns == columns and set(by_id(one)) == set(classes.values())

    cut = cp.stored(cp.repeats_stage(spark, one, small), "t")
    pairs = texts_of(one)
    sizes = dict(zip([d for d, _ in pairs], repeats_by_hand([t.encode() for _, t in pairs], 200), strict=True))
    got = by_id(cut)
    assert cut.columns == columns and set(got) == set(sizes)
    for d, r in got.items():
        size, gone, spans, _ = sizes[d]
        assert r["n_chars"] == len(r["text"])
        assert size - gone - 6 * spans <= len(r["text"].encode()) <= size - gone  # halves of characters at the cuts go too

    clean = cp.stored(cp.secrets_stage(spark, cut, small), "t")
    after = by_id(clean)
    assert clean.columns == columns and set(after) == set(got)
    for d, r in after.items():
        found = fixed_spans(got[d]["text"])
        assert (r["text"] != got[d]["text"]) or not found
        assert "[SECRET]" in r["text"] or not found
        assert r["n_chars"] == len(r["text"])

    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = cp.packing_stage(spark, clean, small).toPandas()
    want = []
    for d, r in after.items():
        ids = np.array([*tool.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted(zip(packed.doc_id, packed.piece, packed.length, packed.ids_crc32, strict=True)) == sorted(want)
    assert packed.groupby("sequence_id").length.sum().max() <= 4096
    assert packed.sequence_id.nunique() <= math.ceil(packed.length.sum() / 4096) + 1


def test_run_equals_its_stages(spark, small):
    assert cp.run(spark, small).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [name for name, _ in cp.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packing"]


def test_stages_take_odd_rows_and_empty_tables(spark, small, tricky, nothing):
    for docs in (tricky, nothing):
        for name, stage in cp.STAGES:
            docs_out = cp.stored(stage(spark, docs, small), "odd")
            if name != "packing":
                assert docs_out.columns == docs.columns, name
                docs = docs_out
        assert docs_out.count() >= docs.count()


def test_texts_reach_python_in_small_batches(spark, small):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    large = spark.range(0, 200, 1, 1).selectExpr("repeat('word ', 20000) AS text")
    docs = table(spark, small, "documents")
    few = cp.stored(docs.limit(5), "t")
    try:
        for name, stage in cp.STAGES:
            if name == "secrets":  # no Python there
                continue
            spark.conf.unset(cp.BATCH_SETTING)
            stage(spark, docs if name == "quality" else few, small)
            seen = large.mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in seen) == 200 and max(r["size"] for r in seen) < cp.BATCH + 200_000, name
        spark.conf.set(cp.BATCH_SETTING, "1m")
        cp.packing_stage(spark, few, small)
        assert spark.conf.get(cp.BATCH_SETTING) == "1m"  # the session's own setting stays
    finally:
        spark.conf.unset(cp.BATCH_SETTING)


def test_a_repeated_row_leaves_one_whole_copy(spark):
    text = " ".join(f"word{i} number{i * 7 % 31}" for i in range(120))
    rows = [(1, text), (1, text), (2, "something else altogether " * 3), (3, None), (3, None), (4, "x")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    one = cp.stored(cp.near_duplicates_stage(spark, docs, ""), "t")
    assert sorted(r["doc_id"] for r in one.collect()) == [1, 2, 3, 4]
    assert {r["doc_id"]: r["text"] for r in cp.repeats_stage(spark, one, "").collect()}[1] == text
