import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkchemo.llm import packing
from tests.llm.test_operators import brute_components, brute_lines, prose

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input: what goes is what brute force says, and the columns stay."""
    item = prose(77, 30)
    shared = "This very line stands in several documents"
    texts = [prose(k, 120) for k in range(6)] + [prose(0, 120), None, "12 34", "", prose(90, 40) + " " + item] + [f"{shared}\n{prose(30 + k, 50)}" for k in range(4)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], columns)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    folder = f"file://{tmp_path}"
    stage = dict(corpus_pipeline.STAGES)

    one = stage["language_id"](spark, docs, folder)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == set(range(15)) - {7, 8, 9}
    two = stage["line_dedup"](spark, one, folder)
    plain = {r["doc_id"]: r["text"] for r in one.collect()}
    want = brute_lines(plain)
    got = {r["doc_id"]: r for r in two.collect()}
    assert two.columns == docs.columns and all(got[i]["text"].count("\n") + 1 == n - gone or n == gone for i, (n, gone, _) in want.items())
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and shared not in got[11]["text"] and shared in got[14]["text"]
    three = stage["near_dedup"](spark, two, folder)
    groups = brute_components({i: r["text"] for i, r in got.items()}, 80)
    assert {r["doc_id"] for r in three.collect()} == {i for i, (_, c) in groups.items() if i == c}
    four = stage["decontamination"](spark, three, folder)
    assert {r["doc_id"] for r in three.collect()} - {r["doc_id"] for r in four.collect()} == {10}
    five = stage["packing"](spark, four, folder)
    whole = {r["doc_id"] for r in five.collect()}
    assert whole == {r["doc_id"] for r in four.collect()}
    assert {(r["doc_id"], r["ids_crc32"]) for r in five.collect()} == {(r["doc_id"], r["ids_crc32"]) for r in packing.pieces(four).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == whole


def test_language_stage_keeps_texts_whose_id_repeats(spark):
    """A null text goes alone, not with the other texts of its doc_id; null ids are rows like others."""
    rows = [(1, prose(1, 60), "en"), (1, None, "en"), (None, prose(2, 60), "en"), (None, "12", "en"), (2, prose(3, 60), None), (2, prose(3, 60), None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = corpus_pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == sorted([r for r in rows if r[1] and r[1] != "12"], key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_run_packs_every_document_that_is_left(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    row = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert 0 < row[0] <= 4096
