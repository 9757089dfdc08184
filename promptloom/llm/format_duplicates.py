"""Problem 3: records that are the same but for their formatting, collapsed with their number of copies."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from promptloom.llm.canon import digest, format_free_key
from promptloom.runtime import materialize, shuffle_width

#: A key is hot above this share of all rows, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 500


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        pairs = [digest(format_free_key(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([ids, pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["id", "k1", "k2"])


def keyed_prompts(entries: DataFrame, id_col: str = "id", text_col: str = "prompt") -> DataFrame:
    """``(id, k1, k2)``: the canonical key of every row whose text is not null."""
    base = entries.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return base.mapInArrow(_keyed, "id string, k1 long, k2 long")


def _hot_keys(keyed: DataFrame, share: float) -> tuple[DataFrame, DataFrame | None]:
    """Exact counts per key (partial counts first) and the hot keys, a table of at most 1/share rows."""
    counts = keyed.groupBy("k1", "k2").agg(F.count("*").alias("copies"))
    total = keyed.count()
    limit = max(1, int(total * share))
    if total <= limit:
        return counts, None
    hot = counts.where(F.col("copies") > limit).select("k1", "k2").collect()
    if not hot:
        return counts, None
    return counts, keyed.sparkSession.createDataFrame([(r.k1, r.k2) for r in hot], "k1 long, k2 long")


def _split(keyed: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    small = F.broadcast(hot)
    return keyed.join(small, ["k1", "k2"], "left_semi"), keyed.join(small, ["k1", "k2"], "left_anti")


def _salted_groups(rows: DataFrame) -> DataFrame:
    """Two-level aggregation: per salt, then per key."""
    salts = shuffle_width(rows.sparkSession)
    first = rows.groupBy("k1", "k2", F.pmod(F.xxhash64("id"), F.lit(salts)).alias("salt")).agg(F.min("id").alias("kept_id"), F.count("*").alias("copies"))
    return first.groupBy("k1", "k2").agg(F.min("kept_id").alias("kept_id"), F.sum("copies").alias("copies"))


def format_groups(entries: DataFrame, *, id_col: str = "id", text_col: str = "prompt", hot_share: float = HOT_SHARE) -> DataFrame:
    """One row ``(kept_id, copies)`` per canonical record: its smallest id and how many rows it stands for.

    Rows with a null text are in no group. Texts without any letter, digit or symbol form one group. Equal
    rows each count. Empty input gives no rows; other columns are ignored.
    """
    keyed = materialize(keyed_prompts(entries, id_col, text_col))
    _, hot = _hot_keys(keyed, hot_share)
    one_level = lambda rows: rows.groupBy("k1", "k2").agg(F.min("id").alias("kept_id"), F.count("*").alias("copies"))
    if hot is None:
        return one_level(keyed).select("kept_id", "copies")
    crowded, rest = _split(keyed, hot)
    return one_level(rest).unionByName(_salted_groups(crowded)).select("kept_id", "copies")


def format_copies(entries: DataFrame, *, id_col: str = "id", text_col: str = "prompt", hot_share: float = HOT_SHARE) -> DataFrame:
    """One row ``(kept_id, copy_id)`` for each row that repeats another but for formatting.

    ``kept_id`` is the smallest id of the group. Nulls, blanks and empty input as in :func:`format_groups`.
    A group that holds a large share of the rows is never gathered: its smallest id comes from the salted
    aggregation and is broadcast to its rows; all other groups are small enough for one sorted shuffle.
    """
    keyed = materialize(keyed_prompts(entries, id_col, text_col))
    _, hot = _hot_keys(keyed, hot_share)
    rest = keyed
    parts = []
    if hot is not None:
        crowded, rest = _split(keyed, hot)
        parts.append(crowded.join(F.broadcast(_salted_groups(crowded)), ["k1", "k2"]))
    parts.append(rest.withColumn("kept_id", F.min("id").over(W.Window.partitionBy("k1", "k2"))))
    out = None
    for part in parts:
        rows = part.where("kept_id <> id").select("kept_id", F.col("id").alias("copy_id"))
        out = rows if out is None else out.unionByName(rows)
    return out
