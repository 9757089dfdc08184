"""Exact top-k similarity search and the decisions taken from its best match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_type

from promptloom.functions import vectors as V

#: Queries one task holds, entries that pass by them in one task, and queries compared in one step.
QUERY_BLOCK, ENTRY_BLOCK, STEP = 8192, 65_536, 512


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and unit rows of the usable vectors of an Arrow list column."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=-1)
    at = np.flatnonzero(lengths == dim)
    if not len(at):
        return at, np.empty((0, dim))
    starts = column.offsets.to_numpy()[at]
    rows = column.values.to_numpy(zero_copy_only=False).astype(np.float64)[starts[:, None] + np.arange(dim)]
    good = np.isfinite(rows).all(axis=1) & (rows != 0).any(axis=1)
    rows = rows[good]
    return at[good], rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _best_in_cell(dim: int, k: int, query_type: pa.DataType, entry_type: pa.DataType):
    """Rows sorted by cell and kind: the queries of a cell of the grid are gathered, then its entries pass by; k stay per query."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, names, parts, best = -1, [], [], []
        matrix = np.empty((0, dim))

        def found() -> pa.RecordBatch:
            rows = [(q, e, -s) for q, near in zip(names, best) for s, e in near]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], query_type), pa.array([r[1] for r in rows], entry_type), pa.array([r[2] for r in rows], pa.float64())], ["query_id", "entry_id", "score"])

        for batch in batches:
            cell, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            change = np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1
            for low, high in zip(np.append(0, change).tolist(), np.append(change, len(cell)).tolist()):
                if low == high:
                    continue
                if int(cell[low]) != here:
                    yield found()
                    here, names, parts, best = int(cell[low]), [], [], []
                part = batch.slice(low, high - low)
                at, rows = _unit(part.column(4), dim)
                if kind[low] == 0:
                    column = part.column(2).to_pylist()
                    names += [column[i] for i in at]
                    best += [[] for _ in at]
                    parts.append(rows)
                    matrix = np.concatenate(parts)
                    continue
                if not len(at) or not names:
                    continue
                ids = part.column(3).to_pylist()
                keep = min(k, len(at))
                for begin in range(0, len(names), STEP):
                    scores = np.round(matrix[begin : begin + STEP] @ rows.T, 6)
                    floor = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1]
                    for q, (line, least) in enumerate(zip(scores, floor), begin):
                        if len(best[q]) == k:
                            least = max(least, -best[q][-1][0])
                        near = np.flatnonzero(line >= least)
                        if len(near):
                            best[q] = sorted(best[q] + [(-float(line[j]), ids[at[j]]) for j in near])[:k]
        yield found()

    return scan


def exact_topk(entries: DataFrame, queries: DataFrame, *, dim: int, k: int = 5, query_block: int = QUERY_BLOCK, entry_block: int = ENTRY_BLOCK) -> DataFrame:
    """``(query_id, entry_id, score, rank)``: the k entries most similar to each query by cosine, exactly.

    ``entries`` is ``(entry_id, vec)``, ``queries`` ``(query_id, vec)``, with ids of any type that sorts. Both sides are
    dealt by hash into blocks, and every pair of blocks is one cell of a grid: its task holds the queries of the block
    while the entries pass by, and gives k of them per query. Nothing is broadcast or comes to the driver. Scores are
    rounded to six decimals, ties go to the smaller id. Vectors of another length, null, all zero or not finite are left
    out on both sides, as are null ids. Empty sides give no rows. The work is that of all pairs: for large sets of both use an index.
    """
    wide = T.ArrayType(T.FloatType())
    stored = entries.select(F.col("entry_id"), F.col("vec").cast(wide).alias("vec")).where("entry_id is not null and vec is not null")
    asked = queries.select(F.col("query_id"), F.col("vec").cast(wide).alias("vec")).where(F.col("query_id").isNotNull() & V.usable(F.col("vec"), dim))
    query_type, entry_type = queries.schema["query_id"].dataType, entries.schema["entry_id"].dataType
    across, down = max(1, -(-asked.count() // query_block)), max(1, -(-stored.count() // entry_block))
    row = lambda key, blocks: F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = asked.select(row("query_id", across).alias("a"), "query_id", "vec").select("*", every(down).alias("d")).select((F.col("a") * down + F.col("d")).alias("cell"), F.lit(0).alias("kind"), "query_id", F.lit(None).cast(entry_type).alias("entry_id"), "vec")
    right = stored.select(row("entry_id", down).alias("d"), "entry_id", "vec").select("*", every(across).alias("a")).select((F.col("a") * down + F.col("d")).alias("cell"), F.lit(1).alias("kind"), F.lit(None).cast(query_type).alias("query_id"), "entry_id", "vec")
    grid = left.unionByName(right).repartitionById(across * down, F.col("cell")).sortWithinPartitions("cell", "kind")
    schema = T.StructType([T.StructField("query_id", query_type), T.StructField("entry_id", entry_type), T.StructField("score", T.DoubleType())])
    found = grid.mapInArrow(_best_in_cell(dim, k, to_arrow_type(query_type), to_arrow_type(entry_type)), schema)
    order = W.Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def baseline_decision(matches: DataFrame, queries: DataFrame, *, threshold: float) -> DataFrame:
    """Hit or miss of every query by its best cosine alone: ``(query_id, entry_id, score, decision, reason)``.

    A query without any candidate is a miss with reason ``no_candidates_found``.
    """
    best = matches.where("rank = 1").select("query_id", "entry_id", "score")
    joined = queries.select("query_id").join(best, "query_id", "left")
    hit = F.col("score") >= threshold
    reason = F.when(F.col("entry_id").isNull(), "no_candidates_found").when(hit, "passed_cosine_threshold").otherwise("failed_cosine_threshold")
    return joined.select("query_id", "entry_id", "score", F.when(hit, "hit").otherwise("miss").alias("decision"), reason.alias("reason"))


def domain_centroids(anchors: DataFrame, *, dim: int) -> DataFrame:
    """``(domain, centroid)``: normalised mean of each domain's vectors; a zero mean stays zero.

    One partial aggregate per axis, so no vector is ever gathered per domain.
    """
    units = anchors.where(V.usable(F.col("vec"), dim)).select("domain", V.doubles(F.col("vec")).alias("v"))
    means = units.groupBy("domain").agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(dim)])
    return means.select("domain", V.normalized(F.array(*[F.col(f"m{i}") for i in range(dim)])).alias("centroid"))


def detect_domain(vectors: DataFrame, centroids: list[tuple[str, list[float]]], *, threshold: float = 0.5, fallback: str = "general") -> DataFrame:
    """Add ``domain`` and ``domain_score``: the first most similar centroid, or ``fallback`` below the threshold.

    ``centroids`` is a parameter of a few rows in order of precedence and becomes a literal of the plan.
    """
    if not centroids:
        return vectors.withColumn("domain", F.lit(fallback)).withColumn("domain_score", F.lit(None).cast("double"))
    scored = [F.struct(F.round(V.dot(V.normalized(F.col("vec")), F.array(*[F.lit(float(x)) for x in c])), 6).alias("score"), F.lit(-i).alias("order"), F.lit(d).alias("domain")) for i, (d, c) in enumerate(centroids)]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    with_best = vectors.withColumn("_best", best)
    return with_best.withColumn("domain", F.when(F.col("_best.score") >= threshold, F.col("_best.domain")).otherwise(fallback)).withColumn("domain_score", F.col("_best.score")).drop("_best")

