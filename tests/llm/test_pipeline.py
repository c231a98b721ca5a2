"""The pipeline's stages on the smallest table, against its operators applied one by one."""

import random

from priorday.llm import bpe, hilbert_ann, mixing, nbsvm, quality_rules, secret_scan, simhash
from pyspark.sql import functions as F


def test_stages_keep_columns_and_order(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.repetition_rules(docs).where("kept").collect()}
    frame = P.STAGES[0][1](spark, docs, small)
    assert frame.columns == docs.columns and {r.doc_id for r in frame.collect()} == kept
    near = simhash.near_duplicates(frame).collect()
    frame2 = P.STAGES[1][1](spark, frame, small).cache()
    assert frame2.columns == docs.columns and {r.doc_id for r in frame2.collect()} == {r.component_id for r in near}
    frame3 = P.STAGES[2][1](spark, frame2, small).cache()
    want = {r.doc_id: secret_scan.redacted_text(r.text) for r in frame2.collect()}
    assert frame3.columns == docs.columns and {r.doc_id: r.text for r in frame3.collect()} == want
    frame4 = P.STAGES[3][1](spark, frame3, small).cache()
    assert frame4.columns == docs.columns and {r.doc_id for r in frame4.collect()} == {r.row.doc_id for r in mixing.mixed(frame3).where("sampled").collect()}
    final = {r.doc_id: bytes(r.ids) for r in P.STAGES[4][1](spark, frame4, small).collect()}
    encode = bpe.encoder(bpe.default_path()).encode
    assert final == {r.doc_id: encode(r.text) for r in frame4.collect()}
    assert {r.doc_id: bytes(r.ids) for r in P.run(spark, small).collect()} == final


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row struct<a:int>, id string, mark string, fp string, component string, copies long, kept boolean, tokens long, w double, col int, topic string"


def awkward(spark):
    """Nulls in every column, empty and repeated texts, repeated doc_ids, and columns named as the stages' own."""
    rng = random.Random(21)
    good = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(rng.randint(60, 120))) for _ in range(30)]
    rest = (None, "i", "m", "f", "c", 1, True, 2, 1.0, 3, "t")
    rows = [(i, t, "en", "s", len(t), *rest) for i, t in enumerate(good)]
    rows += [(i + 100, t, "en", "s", len(t), *rest) for i, t in enumerate(good[:5])]  # copies
    rows += [(3, good[7] + " end", "en", "s", 9, *rest), (3, good[7] + " end", "en", "s", 9, *rest)]  # one doc_id twice more
    rows += [(None, good[8] + " tail", None, None, None, *rest), (200, None, None, None, None, *[None] * 11), (201, "", "en", "s", 0, *rest), (202, " \n\t", "en", "s", 3, *rest)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def test_stages_take_awkward_tables(spark, small):
    import corpus_pipeline as P

    docs = awkward(spark)
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        rows = after.collect()
        allowed = {(r.doc_id, r.source) for r in docs.collect()}
        assert rows and all((r.doc_id, r.source) in allowed for r in rows), name
        docs = spark.createDataFrame(rows, COLUMNS)
    texts = [r.text for r in docs.collect()]
    assert None not in texts and "" not in texts
    assert P.STAGES[-1][1](spark, docs, small).columns == ["doc_id", "n_tokens", "ids"]


def test_near_dedup_stage_keeps_one_of_each_group(spark, small):
    import corpus_pipeline as P

    docs = awkward(spark).where("doc_id is null or doc_id < 200").where("n_chars is null or n_chars > 20")
    kept = sorted((r.doc_id is None, r.doc_id) for r in P.STAGES[1][1](spark, docs, small).collect())
    assert [i for none, i in kept if not none] == list(range(30))


def test_stages_of_empty_tables(spark, small):
    import corpus_pipeline as P

    none = awkward(spark).where("doc_id = -1")
    for name, stage in P.STAGES:
        assert stage(spark, none, small).count() == 0, name
    texts = none.select("doc_id", "text")
    assert secret_scan.scan(texts).count() == 0
    assert nbsvm.scores(texts, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
    assert hilbert_ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0
