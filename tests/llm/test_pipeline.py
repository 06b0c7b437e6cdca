"""The corpus pipeline: stage by stage on planted rows, and as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_order_and_columns(spark):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "near-dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    n = out.agg(F.count_distinct("doc_id"), F.sum("length")).first()
    assert 100 < n[0] < 200 and n[1] > 50_000


def test_quality_stage_keeps_the_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = cp.quality_stage(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    told = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good, bad = told.filter("quality = 1").count(), told.filter("quality = 0").count()
    assert kept.join(told.filter("quality = 1"), "doc_id").count() > 0.98 * good
    assert kept.join(told.filter("quality = 0"), "doc_id").count() < 0.1 * bad


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(9)
    words = lambda n: " ".join(f"word{x}" for x in rng.integers(0, 5000, n))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    base = words(120)
    edited = base.split()
    edited[40] = "edited"
    rows = [(1, base), (2, base.upper()), (3, " ".join(edited)), (4, words(120)), (5, f"{words(50)} {item} {words(50)}"), (6, None), (7, ""), (None, words(30)), (4000, words(80))]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_stage_keeps_one_of_a_group(spark, planted):
    kept = {r.doc_id for r in cp.near_stage(spark, planted, SF).collect()}
    assert kept == {1, 4, 5, 6, None, 4000}
    twice = cp.near_stage(spark, planted.union(planted), SF)
    assert twice.filter("doc_id = 4").count() == 1


def test_near_stage_tells_rows_apart_without_ids(spark, planted):
    words = lambda seed: " ".join(f"word{x}" for x in np.random.default_rng(seed).integers(0, 5000, 60))
    rows = [(50, words(1)), (50, words(2)), (50, words(1)), (None, words(3)), (None, words(4)), (None, words(4)), (None, words(5)), (60, words(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], planted.schema)
    kept = cp.near_stage(spark, docs, SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in [rows[0], rows[1], rows[3], rows[4], rows[7]])


def test_decontamination_stage_drops_leaks_alone(spark, planted):
    assert {r.doc_id for r in cp.decontamination_stage(spark, planted, SF).collect()} == {1, 2, 3, 4, 6, 7, None, 4000}


def test_line_stage_follows_the_text(spark):
    line = "this line is in every document of the table"
    docs = spark.createDataFrame([(k, f"own {k}\n{line}", 0) for k in range(4)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in cp.line_stage(spark, docs, SF).collect()}
    assert [out[k].text for k in range(4)] == ["own 0", "own 1", "own 2", f"own 3\n{line}"] and out[0].n_chars == 5


def test_stages_on_an_empty_table(spark, planted):
    none = planted.filter("doc_id < 0")
    for _, stage in cp.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_stages_keep_columns_of_any_name(spark, planted):
    """Names with dots, and those that stages use themselves; very long texts; repeated rows."""
    long = planted.filter("doc_id = 4").withColumns({"doc_id": F.lit(70).cast("long"), "text": F.repeat(F.lit("one long text of some words "), 20_000)})
    docs = planted.unionByName(planted).unionByName(long)
    docs = docs.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in ("_row", "_ROW_", "a.b", "component", "id", "score", "row", "kept", "item", "n")])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows or name == "quality classifier"
        for r in rows:
            own = "none" if r["doc_id"] is None else str(r["doc_id"])
            assert (r["_row"], r["_ROW_"], r["a.b"], r["id"], r["n"]) == (f"_row-{own}", f"_ROW_-{own}", f"a.b-{own}", f"id-{own}", f"n-{own}"), name
    pieces = cp.packing_stage(spark, docs, SF)
    assert pieces.agg(F.sum("length")).first()[0] == pieces.select("doc_id", "doc_tokens", "start").filter("start = 0").agg(F.sum("doc_tokens")).first()[0]
