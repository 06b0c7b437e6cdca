"""The corpus pipeline: quality, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of docs. run() writes each stage's rows to the shared folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import decontam, line_dedup, packing, quality, simhash
from trialspark.llm.common import bounded_broadcast, join_counted, table, written

#: A document stays if its chance of good quality is at least this.
KEEP_SCORE = 0.7


def _named(columns: list[str]) -> list[Column]:
    """Columns of any names, dots included."""
    return [F.col(f"`{c}`") for c in columns]


def _without(docs: DataFrame, lost: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the keys of lost; rows without a key stay."""
    return docs.join(bounded_broadcast(lost), key, "left_anti").select(*_named(docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on this input's labelled rows, doesn't reject.

    Null and empty texts are scored like others (and so mostly go), repeated rows one by one; other columns, whatever their
    names, come back as they are.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    base = docs.select(F.struct(*_named(docs.columns)).alias("row"), F.col("text").alias("text"))
    return quality.scored(base, model).filter(F.col("score") >= KEEP_SCORE).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document without the lines that stand in three or more documents; n_chars follows the text.

    A null text comes back empty. Repeated rows of one id are one document to the count, and stay rows. Rows without an id
    keep their lines but where others hold them too. Columns of any names come back.
    """
    out = line_dedup.drop_repeated_lines(docs)
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of copies and near-copies (five words, 0.8 or more).

    Rows are told apart by a number of their own: those without an id, or of one id, are compared like any others. A row
    without an id is kept only where its group has none with one.
    """
    number = "_row"
    while number.lower() in {c.lower() for c in docs.columns}:
        number += "_"
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "near-rows")
    found = simhash.near_duplicates(rows, number).withColumnRenamed("id", number).join(rows.select(number, "doc_id"), number)
    found = written(found, "near")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", number)
    kept = found.groupBy("component").agg(F.min(order).alias("kept"), F.count("*").alias("n")).filter("n > 1")
    lost = join_counted(found, written(kept, "near-kept"), ["component"], "n").filter(F.col(number) != F.col("kept")[number]).select(number)
    return _without(rows, lost, number).select(*_named(docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found.

    Null and empty texts hold none. An id goes with all its rows; rows without an id stay. Columns of any names come back.
    """
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, written(found.select(F.col("id").alias("doc_id")).distinct(), "leaks"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids, one row for each piece of a document in them; null and empty texts are their end alone."""
    return packing.piece_digests(packing.packed_pieces(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; a table without rows gives none at each stage."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the alignments can't be expressed in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None
