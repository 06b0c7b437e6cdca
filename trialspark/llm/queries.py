"""The opN_ queries: thin digests of the operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm import alignment, decontam, line_dedup, multiset_hash, packing, pitman_yor, projections, quality, quotes, repair, secrets, shards, simhash
from trialspark.llm.common import scratch, table


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = pitman_yor.scored_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 5 != 1)
    return out.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
common AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT l.doc_id, l.i, l.line, c.k IS NOT NULL AND c.keeper <> l.doc_id AS lost FROM lines l LEFT JOIN common c ON l.k = c.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.packed_pieces(table(spark, sf_dir, "documents")))


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table arrives in 16 parts by hash, each its own version of small shards, and is compacted to target files."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, scratch(spark, "store"))
    store.append_arrivals(docs, F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    version = store.compact().version
    store.vacuum(keep=1)
    out = store.read(version)
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", F.col("_arrival").alias("arrival"), F.lit(version).alias("version"), F.col("_shard").alias("shard"), F.col("_shard_rows").alias("shard_rows"), sha.alias("text_sha256"))


def op5_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quotes.conversations(table(spark, sf_dir, "conversations"))
    return out.select(F.col("conv").alias("conv_id"), "turn", "role", "position", "parent", "root", "n_quoted", "n_linked", "from_conv", "from_turn", "body")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = secrets.span_list(F.col("secrets"), ("assign", "access", "hex"))
    costed = F.filter("secrets", lambda s: s["log10_guesses"].isNotNull())
    costs = F.transform(costed, lambda s: F.round(s["log10_guesses"], 6))
    segments = F.array_join(F.transform(costed, lambda s: F.concat_ws("=", s["start"].cast("string"), s["segments"])), ";")
    more = [n("guess"), F.array_min(costs).alias("least_log10_guesses"), F.array_max(costs).alias("most_log10_guesses"), segments.alias("segments")]
    return out.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), secrets.span_list(F.col("secrets")).alias("spans"), *more)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"), words=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(~held_out))
    out = quality.scored(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multiset_hash.edit_study(table(spark, sf_dir, "documents"))
    return out.withColumnsRenamed({"id": "doc_id", "n": "n_chars"})


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("score", 6).alias("score"), "begin", "end", "n_seeds")


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(repair.damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projections.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pitman_yor, op2_line_dedup, op3_packing, op4_compaction, op5_quotation_linking, op6_secrets, op7_simhash, op8_quality, op9_multiset_hash, op10_decontamination, op11_structure_repair, op12_embedding_dedup, op13_token_alignment)}

SQL: dict[str, str] = {"op2_line_dedup": OP2_SQL}
