"""Schemas of the ledgers and of labelled pairs; nothing is ever inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _L, _I, _TS = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


VECTOR = T.ArrayType(T.FloatType())
CACHE_ENTRIES = _struct(
    ("id", _S), ("prompt", _S), ("prompt_embedding", VECTOR), ("response", _S), ("model", _S), ("created_at", _TS), ("last_hit_at", _TS),
    ("hit_count", _L), ("feedback_negative_count", _L), ("feedback_positive_count", _L), ("metadata_json", _S),
)
LOOKUP_RECORDS = _struct(
    ("query_id", _S), ("domain", _S), ("query_prompt", _S), ("query_embedding", VECTOR), ("cache_entry_id", _S), ("similarity_score", _D), ("classifier_score", _D), ("cross_encoder_score", _D), ("created_at", _TS),
)
FEEDBACK_EVENTS = _struct(("id", _S), ("query_id", _S), ("cache_entry_id", _S), ("label", _I), ("reason", _S), ("created_at", _TS), ("metadata_json", _S))
ACTIVE_LEARNING_PAIRS = _struct(
    ("id", _S), ("domain", _S), ("query_prompt", _S), ("cached_prompt", _S), ("similarity_score", _D), ("classifier_score", _D), ("cross_encoder_score", _D), ("label", _I), ("source", _S), ("created_at", _TS),
)
PAIRS = _struct(("prompt_a", _S), ("prompt_b", _S), ("label", _I), ("domain", _S), ("source", _S), ("split", _S))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order and type; missing ones become null, others are dropped (column migration)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])
