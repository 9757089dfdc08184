"""The read-through cache: snapshot lookups, micro-batches, and exact replay of a short ordered sequence."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.operators.knn import exact_topk
from promptloom.runtime import materialize


@dataclass(frozen=True)
class ReplaySettings:
    """Cosine at which a stored prompt is reused, how many entries stay, and how long."""

    threshold: float = 0.9
    max_entries: int = 10_000
    ttl_seconds: float | None = None


def snapshot_lookup(entries: DataFrame, queries: DataFrame, *, dim: int, threshold: float) -> DataFrame:
    """All queries against a frozen cache at once: ``(query_id, entry_id, score, decision)``; no query sees another's insert."""
    best = exact_topk(entries, queries, dim=dim, k=1).select("query_id", "entry_id", "score")
    joined = queries.select("query_id").join(best, "query_id", "left")
    return joined.withColumn("decision", F.when(F.col("score") >= threshold, "hit").otherwise("miss"))


REPLAYED = "instance string, seq long, decision string, source_seq long, score double"


def exact_replay(calls: DataFrame, settings: ReplaySettings = ReplaySettings()) -> DataFrame:
    """Sequential semantics per cache instance: each miss inserts an entry that later calls may hit.

    ``calls`` is ``(instance, seq, at_seconds, vec)``. Instances run in parallel, one after the other inside.
    On a miss, expired entries go first, then the least recently used beyond ``max_entries``. The cache bounds the
    memory of an instance; its calls are one ordered group, so this is for sequences of one instance, not for ledgers.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        vectors: dict[int, np.ndarray] = {}
        born: dict[int, float] = {}
        used: dict[int, float] = {}
        out = []
        for seq, at, vec in zip(rows["seq"], rows["at_seconds"], rows["vec"]):
            x = np.asarray(vec, dtype=np.float64)
            length = np.linalg.norm(x)
            x = x / length if length else x
            keys = list(vectors)
            scores = np.round(np.stack([vectors[k] for k in keys]) @ x, 6) if keys else np.empty(0)
            best = int(np.argmax(scores)) if len(keys) else -1
            if best >= 0 and scores[best] >= settings.threshold:
                used[keys[best]] = at
                out.append((rows["instance"].iloc[0], seq, "hit", keys[best], float(scores[best])))
                continue
            vectors[seq], born[seq], used[seq] = x, at, at
            out.append((rows["instance"].iloc[0], seq, "miss", None, float(scores[best]) if best >= 0 else None))
            gone = [k for k in vectors if settings.ttl_seconds is not None and born[k] < at - settings.ttl_seconds]
            rest = sorted((k for k in vectors if k not in gone), key=lambda k: (used[k], born[k], k))
            gone += rest[: max(0, len(rest) - settings.max_entries)]
            for k in gone:
                del vectors[k], born[k], used[k]
        return pd.DataFrame(out, columns=["instance", "seq", "decision", "source_seq", "score"]).astype({"source_seq": "Int64"})

    return calls.groupBy("instance").applyInPandas(run, REPLAYED)


def cache_batch(entries: DataFrame, queries: DataFrame, *, dim: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One micro-batch: decisions against the frozen cache, and the entries to append for its misses.

    Misses of one batch do not see each other, except that equal prompts are inserted once, under the smallest id.
    """
    decided = materialize(snapshot_lookup(entries, queries.select("query_id", "vec"), dim=dim, threshold=threshold))
    missed = queries.join(decided.where("decision = 'miss'").select("query_id"), "query_id", "left_semi")
    fresh = missed.groupBy("prompt").agg(F.min_by(F.struct("query_id", "vec"), "query_id").alias("f")).select(F.col("f.query_id").alias("entry_id"), "prompt", F.col("f.vec").alias("vec"))
    return decided, fresh
