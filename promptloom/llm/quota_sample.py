"""Problem 5: a sample whose categories follow target shares, with floors and a report of what falls short.

Selection probabilities come from calibration: Newton steps on the dual of exponential tilting, for which only the
number of rows per category is needed. The pivotal method then draws rows with exactly these
probabilities: fights inside partitions first, then between the few rows left over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from promptloom.runtime import materialize, shuffle_width

#: Most rows a table of targets may have: it is a parameter and is held on the driver.
MAX_TARGETS = 100_000


def clean_domain(domain: Column) -> Column:
    """Lower case, no outer white space, and one kind of joint between words."""
    trimmed = F.regexp_replace(domain, r"(?U)^\s+|\s+$", "")
    return F.lower(F.regexp_replace(trimmed, r"(?U)[\s\-_]+", "-"))


def category_key(domain: Column, label: Column, source: Column) -> Column:
    """Category of a row, or null if one of its parts is null."""
    known = domain.isNotNull() & label.isNotNull() & source.isNotNull()
    return F.when(known, F.concat_ws("\u001f", clean_domain(domain), label.cast("string"), source))


@dataclass
class QuotaPlan:
    """Targets with what is there, what each category needs, and the calibrated number of rows to draw."""

    rows: list[dict]
    size: int
    steps: int

    def probabilities(self) -> dict[str, float]:
        """Selection probability of a row, by category; targets that name the same category share its rows."""
        drawn: dict[str, float] = {}
        for r in self.rows:
            if r["available"]:
                drawn[r["key"]] = drawn.get(r["key"], 0.0) + r["drawn"]
        there = {r["key"]: r["available"] for r in self.rows}
        return {k: min(1.0, d / there[k]) for k, d in drawn.items()}


def tilt(available: np.ndarray, targets: np.ndarray, *, tolerance: float = 1e-9, most: int = 100) -> tuple[np.ndarray, int]:
    """Weights ``exp(lambda)`` with which ``available * base * weight`` meets the targets, by Newton steps on the dual.

    The dual ``sum(available * base * exp(lambda)) - lambda . targets`` is convex, its gradient needs the tilted
    category moments and its Hessian is diagonal as categories exclude each other.
    """
    base = targets.sum() / max(1.0, available.sum())
    lam = np.zeros(len(available))
    for step in range(1, most + 1):
        moments = available * base * np.exp(lam)
        gradient = moments - targets
        if np.abs(gradient).max(initial=0.0) <= tolerance * max(1.0, targets.sum()):
            return base * np.exp(lam), step
        lam -= np.clip(gradient / np.maximum(moments, 1e-300), -2.0, 2.0)
    return base * np.exp(lam), most


def plan_counts(available: np.ndarray, shares: np.ndarray, floors: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Rows to draw per category: tilted shares of ``size`` between floor and what is there.

    Categories at a bound are fixed and the rest is calibrated again until none moves. Without enough rows
    for ``size`` everything is drawn; floors beyond ``size`` are scaled down.
    """
    low, high = np.minimum(floors, available).astype(float), available.astype(float)
    if high.sum() <= size:
        return high, 0
    if low.sum() >= size:
        return low * (size / low.sum()), 0
    fixed = np.full(len(available), np.nan)
    steps = 0
    while True:
        free = np.isnan(fixed) & (high > 0)
        left = size - np.nansum(fixed)
        weight = np.where(shares[free] > 0, shares[free], 0.0)
        if not free.any() or weight.sum() <= 0:
            break
        wanted = weight / weight.sum() * left
        positive = wanted > 0
        got = np.zeros(int(free.sum()))
        rates, n = tilt(high[free][positive], wanted[positive])
        steps += n
        got[positive] = rates * high[free][positive]
        over, under = got > high[free] + 1e-9, got < low[free] - 1e-9
        if not over.any() and not under.any():
            fixed[free] = got
            break
        excess, lack = (got - high[free])[over].sum(), (low[free] - got)[under].sum()
        where = np.flatnonzero(free)
        if excess >= lack:
            fixed[where[over]] = high[free][over]
        if lack >= excess:
            fixed[where[under]] = low[free][under]
    drawn = np.where(np.isnan(fixed), low, fixed)
    rest = size - drawn.sum()
    room = high - drawn
    if rest > 1e-6 and room.sum() > 0:  # shares of zero take what the others cannot
        drawn = drawn + room * (rest / room.sum())
    return drawn, steps


def quota_plan(rows: DataFrame, targets: DataFrame, *, fraction: float = 0.2) -> QuotaPlan:
    """Count the categories of ``rows`` where they lie and calibrate them to ``targets``."""
    goals = targets.select("domain", "label", "source", "target_share", "min_rows", category_key(F.col("domain"), F.col("label"), F.col("source")).alias("key")).limit(MAX_TARGETS + 1).collect()
    if len(goals) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    key = category_key(F.col("domain"), F.col("label"), F.col("source"))
    counts = rows.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    total = int(counts.agg(F.sum("n")).first()[0] or 0)
    wanted = rows.sparkSession.createDataFrame([(g.key,) for g in goals if g.key is not None], "key string").distinct()
    there = {r.key: r.n for r in counts.join(F.broadcast(wanted), "key").collect()}
    size = math.floor(total * fraction)
    available = np.array([there.get(g.key, 0) for g in goals], dtype=float)
    shares = np.array([g.target_share or 0.0 for g in goals], dtype=float)
    floors = np.array([g.min_rows or 0 for g in goals], dtype=float)
    drawn, steps = plan_counts(available, shares, floors, size) if goals else (np.zeros(0), 0)
    out = []
    for g, n, share, floor, d in zip(goals, available, shares, floors, drawn):
        needed = int(max(floor, math.ceil(round(share * size, 6))))
        out.append({"domain": g.domain, "label": g.label, "source": g.source, "key": g.key, "target_share": float(share), "min_rows": int(floor), "available": int(n), "needed": needed, "drawn": float(d)})
    return QuotaPlan(out, size, steps)


def quota_report(rows: DataFrame, targets: DataFrame, *, fraction: float = 0.2) -> DataFrame:
    """One row per target: what it needs, what there is, the expected draw and share, and whether it falls short.

    ``needed`` is the larger of ``min_rows`` and the target share of the sample size, rounded up; a target is
    ``short`` if fewer rows exist. Rows with a null in domain, label or source are in no category, but count
    towards the sample size. Empty rows make every positive need short; no targets give no rows.
    """
    plan = quota_plan(rows, targets, fraction=fraction)
    label_type = targets.schema["label"].dataType.simpleString()
    schema = f"domain string, label {label_type}, source string, target_share double, min_rows long, needed long, available long, drawn double, drawn_share double, missing long, short boolean"
    total = max(1.0, sum(r["drawn"] for r in plan.rows))
    data = [(r["domain"], r["label"], r["source"], r["target_share"], r["min_rows"], r["needed"], r["available"], round(r["drawn"], 6), round(r["drawn"] / total, 6), max(0, r["needed"] - r["available"]), r["available"] < r["needed"]) for r in plan.rows]
    return rows.sparkSession.createDataFrame(data, schema)


def _coin(seed: int, a: str, b: str) -> float:
    return xxhash.xxh3_64_intdigest(f"{a}\u0001{b}", seed) / 2.0**64


def _fights(level: int, seed: int, last: bool):
    """Pivotal method over rows sorted by category: two rows fight until one is drawn or out, the other goes on.

    Probabilities are counted in billionths, so no row is lost to rounding. A row left with an open probability is given
    back with it (``state`` null); at the ``last`` level the one row that may be left is settled by its coin.
    """
    one = 1_000_000_000

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out: list[tuple] = []
            for key, row_id, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held is not None and held[0] != key and not last:
                    out.append((*held, None))
                    held = None
                if p <= 0 or p >= one:
                    out.append((key, row_id, p, p >= one))
                    continue
                if held is None:
                    held = (key, row_id, p)
                    continue
                _, other, q = held
                total, coin = p + q, _coin(seed + level, str(other), str(row_id))
                if total < one:  # one goes out, the winner carries both probabilities
                    winner, loser = ((key, row_id), held[:2]) if coin * total < p else (held[:2], (key, row_id))
                    out.append((*loser, 0, False))
                else:  # one is drawn, the other goes on with what is left
                    winner, loser = ((key, row_id), held[:2]) if coin * (2 * one - total) < one - q else (held[:2], (key, row_id))
                    out.append((*winner, one, True))
                    winner, total = loser, total - one
                if total in (0, one):
                    out.append((*winner, total, total == one))
                    held = None
                else:
                    held = (*winner, total)
            yield _decided(out)
        if held is not None:
            yield _decided([(*held, _coin(seed, "last", str(held[1])) * one < held[2] if last else None)])

    def _decided(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[3] for o in out], pa.bool_())], ["key", "row_id", "p", "state"]
        )

    return play


_PLAYED = "key string, row_id string, p long, state boolean"


def quota_sample(rows: DataFrame, targets: DataFrame, *, id_col: str = "pair_id", fraction: float = 0.2, seed: int = 17) -> DataFrame:
    """``(id, domain, label, source)`` of the drawn rows, about ``floor(rows * fraction)`` of them.

    A category is drawn with its calibrated probability; the pivotal method keeps the number of rows per category
    within one of ``rows * probability`` and the whole sample within one row of its size. The draw depends on the
    ids and ``seed`` only. Rows in no target category are never drawn; rows that repeat an id are each eligible.
    Large categories fight in many partitions at once, and only the one open row of each goes on.
    """
    plan = quota_plan(rows, targets, fraction=fraction)
    id_type = rows.schema[id_col].dataType.simpleString()
    spark = rows.sparkSession
    rates = [(k, int(round(p * 1_000_000_000))) for k, p in sorted(plan.probabilities().items()) if p > 0]
    if not rates:
        return rows.select(id_col, "domain", "label", "source").where("false")
    table = F.broadcast(spark.createDataFrame(rates, "key string, p long"))
    base = rows.select(F.col(id_col).cast("string").alias("row_id"), category_key(F.col("domain"), F.col("label"), F.col("source")).alias("key"))
    entered = base.join(table, "key").select("key", "row_id", "p")
    width = shuffle_width(spark)
    order = ["key", "row_id"]
    first = materialize(entered.repartition(width, "row_id").sortWithinPartitions(*order).mapInArrow(_fights(0, seed, False), _PLAYED))
    second = materialize(first.where("state is null").select("key", "row_id", "p").repartition(width, "key").sortWithinPartitions(*order).mapInArrow(_fights(1, seed, False), _PLAYED))
    final = second.where("state is null").select("key", "row_id", "p").coalesce(1).sortWithinPartitions(*order).mapInArrow(_fights(2, seed, True), _PLAYED)
    chosen = first.where("state").select("key", "row_id").unionByName(second.where("state").select("key", "row_id")).unionByName(final.where("state").select("key", "row_id"))
    drawn = chosen.groupBy("key", "row_id").agg(F.count("*").alias("n"))
    keyed = rows.select(F.col(id_col).cast("string").alias("row_id"), category_key(F.col("domain"), F.col("label"), F.col("source")).alias("key"), F.col("domain"), F.col("label"), F.col("source"))
    numbered = keyed.join(drawn, ["key", "row_id"])
    kept = numbered.withColumn("r", F.row_number().over(W.Window.partitionBy("key", "row_id").orderBy("domain", "source"))).where("r <= n")
    return kept.select(F.col("row_id").cast(id_type).alias(id_col), "domain", "label", "source")
