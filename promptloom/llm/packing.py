"""Problem 7: documents packed into containers of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.bpe import TOKENIZER_DIR
from promptloom.llm.corpus_tokens import count_corpus
from promptloom.runtime import materialize

#: Items one task packs at a time; more items make more groups.
ITEMS_PER_GROUP = 100_000
#: A container is packed again with those of other groups if more than this share of it is unused.
REPACK_GAP = 0.002

_PACKED = "job string, container_id long, doc_id {id_type}, piece int, first_token long, n_tokens long, gap long"


def sum_of_squares_bins(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item and the gap left in each container.

    Each item goes where the sum of the squared numbers of open containers per gap becomes smallest; ties go
    to the tightest container, and a new one is opened only if that is better. Items are between 1 and capacity.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    where = np.empty(len(sizes), dtype=np.int64)
    gaps: list[int] = []
    never = np.int64(1 << 60)
    for i, size in enumerate(sizes.tolist()):
        best, best_cost = -1, (2 * int(count[capacity - size]) + 1 if size < capacity else 0)
        if size < capacity:
            here, after = count[size:capacity], count[: capacity - size]
            cost = np.where(here > 0, 2 * (after - here) + 2, never)
            if here[0] > 0:
                cost[0] = 1 - 2 * here[0]
            tightest = int(cost.argmin())
            if cost[tightest] <= best_cost:
                best = tightest
        if best < 0:
            chosen, left = len(gaps), capacity - size
            gaps.append(left)
        else:
            chosen, left = open_bins[size + best].pop(), best
            count[size + best] -= 1
            gaps[chosen] = left
        if left:
            open_bins[left].append(chosen)
            count[left] += 1
        where[i] = chosen
    return where, np.array(gaps, dtype=np.int64)


def _packer(level: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        capacity = int(rows["max_tokens"].iloc[0])
        rows = rows.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        sizes = rows["n_tokens"].to_numpy(dtype=np.int64)
        real = int((sizes > 0).sum())
        where = np.zeros(len(rows), dtype=np.int64)
        where[:real], gaps = sum_of_squares_bins(sizes[:real], capacity)
        if real < len(rows):  # texts without tokens take no room: dealt out over the containers
            if not len(gaps):
                gaps = np.array([capacity], dtype=np.int64)
            where[real:] = np.arange(len(rows) - real) % len(gaps)
        base = ((level << 28) + int(rows["grp"].iloc[0])) << 32
        return pd.DataFrame({"job": rows["job"], "container_id": base + where, "doc_id": rows["doc_id"], "piece": rows["piece"], "first_token": rows["first_token"], "n_tokens": sizes, "gap": gaps[where]})

    return pack


def _cut_oversized(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Items of every job: a text above the capacity gives full pieces and a rest, any other is one item."""
    n, cap = F.col("n_tokens"), F.col("max_tokens")
    pieces = F.greatest(F.ceil(n / cap), F.lit(1)).cast("int")
    items = sized.crossJoin(F.broadcast(budgets)).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return items.withColumn("first_token", F.col("piece") * cap).select("job", "max_tokens", "doc_id", "piece", "first_token", F.least(cap, n - F.col("first_token")).alias("n_tokens"))


def pack_sizes(sized: DataFrame, budgets: DataFrame, *, items_per_group: int = ITEMS_PER_GROUP, repack_gap: float = REPACK_GAP) -> DataFrame:
    """Pack ``(doc_id, n_tokens)`` into containers for each row ``(job, max_tokens)`` of ``budgets``.

    Gives ``(job, container_id, doc_id, piece, first_token, n_tokens)``, one row per item. Groups of bounded
    size, dealt by hash, are packed on their own; the few containers of a group that stay open are opened
    again and their items packed together with those of other groups. Null or zero sizes take no room and
    stand in some container. Repeated ids are separate items. Empty input or no budgets give no rows.
    ``budgets`` is a small table of parameters.
    """
    jobs = budgets.select("job", F.col("max_tokens").cast("long").alias("max_tokens")).where("max_tokens > 0").distinct()
    sized = sized.select("doc_id", F.greatest(F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)), F.lit(0)).alias("n_tokens"))
    id_type = sized.schema["doc_id"].dataType.simpleString()
    schema = _PACKED.format(id_type=id_type)
    items = _cut_oversized(sized, jobs)
    full = items.where("n_tokens = max_tokens")
    part = items.where("n_tokens < max_tokens")
    groups = max(1, -(-sized.count() // items_per_group))
    placed = part.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    packed = materialize(placed.groupBy("job", "grp").applyInPandas(_packer(1), schema))
    whole = full.select("job", (F.lit(-1) - F.monotonically_increasing_id()).alias("container_id"), "doc_id", "piece", "first_token", "n_tokens")
    columns = ["job", "container_id", "doc_id", "piece", "first_token", "n_tokens"]
    if groups == 1:
        return packed.select(*columns).unionByName(whole)
    with_cap = packed.join(F.broadcast(jobs), "job")
    loose = F.col("gap") > F.col("max_tokens") * repack_gap
    again = with_cap.where(loose)
    groups2 = max(1, -(-again.count() // items_per_group))
    repacked = again.drop("container_id", "gap").withColumn("grp", F.pmod(F.xxhash64("piece", "doc_id"), F.lit(groups2)).cast("int")).groupBy("job", "grp").applyInPandas(_packer(2), schema)
    return with_cap.where(~loose).select(*columns).unionByName(repacked.select(*columns)).unionByName(whole)


def pack_documents(documents: DataFrame, budgets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR, items_per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """:func:`pack_sizes` of the token counts of whole texts; ``budgets`` has job, tokenizer and max_tokens."""
    out = None
    for name in sorted(r[0] for r in budgets.select("tokenizer").distinct().collect()):
        sized = materialize(count_corpus(documents, id_col=id_col, text_col=text_col, name=name, folder=folder).withColumnRenamed(id_col, "doc_id"))
        packed = pack_sizes(sized, budgets.where(F.col("tokenizer") == name), items_per_group=items_per_group)
        out = packed if out is None else out.unionByName(packed)
    if out is None:
        id_type = documents.schema[id_col].dataType.simpleString()
        return documents.sparkSession.createDataFrame([], f"job string, container_id long, doc_id {id_type}, piece int, first_token long, n_tokens long")
    return out


def packing_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(job, containers, tokens, least_containers, fill)``: how close a packing is to its lower bound."""
    per_bin = packed.groupBy("job", "container_id").agg(F.sum("n_tokens").alias("used"))
    per_job = per_bin.where("used > 0").groupBy("job").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    joined = per_job.join(F.broadcast(budgets.select("job", "max_tokens").distinct()), "job")
    return joined.select("job", "containers", "tokens", F.ceil(F.col("tokens") / F.col("max_tokens")).alias("least_containers"), F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6).alias("fill"))
