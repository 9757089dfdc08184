"""Labelled pairs and corpora as JSON lines, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.operators.pairs import checked_pairs
from promptloom.schemas import PAIRS

BASE_PROMPTS = T.StructType([T.StructField("text", T.StringType()), T.StructField("domain", T.StringType())])
ACTION_TEMPLATES = T.StructType([T.StructField(n, T.StringType()) for n in ("domain", "object", "action_a", "action_b")])


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a given schema; blank lines are skipped, unknown keys ignored, broken lines are an error."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_pairs(spark: SparkSession, path: str, *, split: str | None = None, domain: str | None = None, strict: bool = True) -> DataFrame:
    """Labelled pairs, optionally of one split or domain. ``strict`` raises on an invalid row, else such rows are left out."""
    good, bad = checked_pairs(read_lines(spark, path, PAIRS))
    if strict:
        first = bad.select("problem").first()
        if first:
            raise ValueError(f"invalid pair in {path}: {first.problem}")
    for column, wanted in (("split", split), ("domain", domain)):
        if wanted is not None:
            good = good.where(F.col(column) == wanted)
    return good


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON lines with keys in alphabetical order; nulls are kept."""
    pairs.select(*sorted(pairs.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
