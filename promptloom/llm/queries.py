"""Driver queries of the language-model operators, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.llm.bisection import split_documents
from promptloom.llm.corpus_tokens import encode_corpus
from promptloom.llm.format_duplicates import format_copies, format_groups
from promptloom.llm.multi_index import IndexSettings, nearest_entries, usable_vectors
from promptloom.llm.packing import pack_documents, packing_report
from promptloom.llm.pair_defects import pair_defects
from promptloom.llm.quota_sample import quota_report, quota_sample
from promptloom.llm.split_overlap import overlap_report, split_overlaps


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(_table(spark, sf_dir, "cache_entries"))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = IndexSettings().dim
    entries = usable_vectors(_table(spark, sf_dir, "cache_entries"), "id", "prompt_embedding", dim)
    scored = _table(spark, sf_dir, "lookup_records").where("cross_encoder_score is not null")
    lookups = usable_vectors(scored, "query_id", "query_embedding", dim)
    return nearest_entries(entries, lookups.select(F.lit("lookup").alias("side"), F.col("id").alias("query_id"), "vec"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_neighbours(spark, sf_dir).select("side", "query_id", "neighbour_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_copies(_table(spark, sf_dir, "cache_entries"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_groups(_table(spark, sf_dir, "cache_entries"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split_overlaps(_table(spark, sf_dir, "equivalence_gold"))
    return found.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(_table(spark, sf_dir, "equivalence_gold"))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_report(_table(spark, sf_dir, "equivalence_gold"), _table(spark, sf_dir, "sample_targets"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_report(spark, sf_dir).where("short").select("domain", "label", "source")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quota_sample(_table(spark, sf_dir, "equivalence_gold"), _table(spark, sf_dir, "sample_targets"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(_table(spark, sf_dir, "documents"))


def _budgets(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return _table(spark, sf_dir, "token_budgets").where(F.col("job").startswith(kind))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), _budgets(spark, sf_dir, "pack"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_packed(spark, sf_dir), _budgets(spark, sf_dir, "pack"))


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(_table(spark, sf_dir, "documents"), _budgets(spark, sf_dir, "split"))


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_neighbours, p3_found, p3_groups, p4_found, p4_report, p5_found, p5_report, p5_sample, p6_ids, p7_packed, p7_report, p8_pieces)}

_CLEAN = r"lower(regexp_replace(regexp_replace({c}, '^[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g'), '[\s\-_]+', '-', 'g'))"
ORACLE_SQL: dict[str, str] = {
    "p5_found": f"""WITH c AS (SELECT {_CLEAN.replace('{c}', 'domain')} AS d, label, source, count(*) AS k FROM equivalence_gold WHERE domain IS NOT NULL AND label IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
n AS (SELECT count(*) // 5 AS n FROM equivalence_gold)
SELECT t.domain, t.label, t.source FROM sample_targets t CROSS JOIN n LEFT JOIN c ON c.d = {_CLEAN.replace('{c}', 't.domain')} AND c.label = t.label AND c.source = t.source
WHERE coalesce(c.k, 0) < greatest(t.min_rows, ceil(round(t.target_share * n.n, 6)))""",
}
