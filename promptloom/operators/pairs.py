"""Labelled pairs: reading rules, generation from concepts and templates, splits and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from promptloom.operators.ledger import first_in_order
from promptloom.runtime import materialize


def checked_pairs(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid pairs and rejects: prompts must not be blank, labels are 0 or 1, a missing split is ``train``."""
    blank = lambda c: F.coalesce(F.length(F.regexp_replace(c, r"(?U)\s", "")), F.lit(0)) == 0
    bad = F.when(blank(F.col("prompt_a")), "blank prompt_a").when(blank(F.col("prompt_b")), "blank prompt_b").when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label not 0 or 1")
    marked = raw.withColumn("problem", bad)
    good = marked.where("problem is null").drop("problem").withColumn("split", F.coalesce("split", F.lit("train")))
    return good, marked.where("problem is not null")


def concept_pairs(variants: DataFrame, *, most_variants: int = 1000) -> DataFrame:
    """Positive pairs of the variants ``(concept, position, text)`` of one concept, each unordered pair once.

    A concept has a handful of variants by construction; one with more than ``most_variants`` is a ValueError, as all
    pairs of an open group are no result that anyone can use.
    """
    crowded = variants.groupBy("concept").agg(F.count("*").alias("n")).where(F.col("n") > most_variants).select("concept").first()
    if crowded:
        raise ValueError(f"concept {crowded.concept!r} has more than {most_variants} variants")
    a, b = variants.alias("a"), variants.alias("b")
    joined = a.join(b, (F.col("a.concept") == F.col("b.concept")) & (F.col("a.position") < F.col("b.position")))
    return joined.select(F.col("a.concept").alias("concept"), F.col("a.text").alias("prompt_a"), F.col("b.text").alias("prompt_b"), F.lit(1).alias("label"))


def template_pairs(renders: DataFrame, *, cap: int = 10) -> DataFrame:
    """Hard negatives: renders of side ``a`` with those of side ``b`` of a template, at most ``cap`` per template.

    Pairs are taken by the sum of their positions, so no side needs more than its first ``cap`` renders and the
    join is bounded; a template with one side gives none.
    """
    by = W.Window.partitionBy("template", "side").orderBy("position", "text")
    few = renders.where("side in ('a', 'b')").withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= cap)
    a = few.where("side = 'a'").select("template", F.col("text").alias("prompt_a"), F.col("_n").alias("_a"))
    b = few.where("side = 'b'").select("template", F.col("text").alias("prompt_b"), F.col("_n").alias("_b"))
    order = W.Window.partitionBy("template").orderBy(F.col("_a") + F.col("_b"), "_a")
    return a.join(b, "template").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cap).select("template", "prompt_a", "prompt_b", F.lit(0).alias("label"))


def unrelated_pairs(texts: DataFrame, *, ratio: float | None = None, positives: int = 0, hard: int = 0, shifts: int = 2, rows_per_bucket: int = 10_000) -> DataFrame:
    """Easy negatives ``(prompt_a, prompt_b)``: each text with the next few texts of other concepts in the order of their digests.

    Texts are dealt into buckets by the first digits of the digest, as many as the rows call for, and meet their
    successors there, so nothing is multiplied out; a run of one concept is passed over. Equal texts and unordered
    repeats are dropped. With a ``ratio`` the first ``round(positives * ratio) - hard`` pairs by digest stay.
    """
    digits = 1
    keyed = texts.select("concept", "text").distinct().withColumn("_k", F.md5(F.concat_ws("\u0001", F.col("concept").cast("string"), "text")))
    while keyed.count() > rows_per_bucket * 16**digits:
        digits += 1
    dealt = keyed.withColumn("_b", F.substring("_k", 1, digits))
    order = W.Window.partitionBy("_b").orderBy("_k", "text")
    changed = F.when(F.lag("concept").over(order).eqNullSafe(F.col("concept")), 0).otherwise(1)
    runs = dealt.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(order.rowsBetween(W.Window.unboundedPreceding, 0)))
    place = W.Window.partitionBy("_b", "_run").orderBy("_k", "text")
    firsts = runs.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= shifts).select("_b", (F.col("_run") - 1).alias("_run"), "_p", F.col("text").alias("other"))
    joined = runs.select("_b", "_run", "_k", "text").join(firsts, ["_b", "_run"]).where("text <> other")
    low, high = F.least("text", "other").alias("prompt_a"), F.greatest("text", "other").alias("prompt_b")
    found = joined.groupBy(low, high).agg(F.min("_k").alias("_k")).withColumn("label", F.lit(0))
    if ratio is not None:
        wanted = max(0, round(positives * ratio) - hard)
        found = first_in_order(materialize(found), wanted, ["_k", "prompt_a", "prompt_b"])
    return found.select("prompt_a", "prompt_b", "label")


def both_orders(pairs: DataFrame) -> DataFrame:
    """Every pair in both orders, in one pass over the rows."""
    rest = [c for c in pairs.columns if c not in ("prompt_a", "prompt_b")]
    sides = F.array(F.struct(F.col("prompt_a").alias("x"), F.col("prompt_b").alias("y")), F.struct(F.col("prompt_b").alias("x"), F.col("prompt_a").alias("y")))
    return pairs.select(*rest, F.explode(sides).alias("s")).select(F.col("s.x").alias("prompt_a"), F.col("s.y").alias("prompt_b"), *rest)


def unordered_distinct(pairs: DataFrame) -> DataFrame:
    """One row per unordered pair of prompts, with the smaller text first and the smallest label."""
    low, high = F.least("prompt_a", "prompt_b").alias("prompt_a"), F.greatest("prompt_a", "prompt_b").alias("prompt_b")
    return pairs.groupBy(low, high).agg(F.min("label").alias("label"), F.count("*").alias("rows"))


def first_of_case(texts: DataFrame, group: str, position: Column, source: str | None = None) -> DataFrame:
    """First text of each group per spelling without case; texts equal to the group's source text are left out."""
    folded = F.lower(F.trim("text"))
    rows = texts.where(F.col("text").isNotNull()).withColumn("_f", folded)
    if source is not None:
        rows = rows.where(F.col("_f") != F.coalesce(F.lower(F.trim(source)), F.lit("")))
    return rows.groupBy(group, "_f").agg(F.min_by("text", F.struct(position, F.col("text"))).alias("text"), F.min(position).alias("position")).select(group, "text", "position")


def stratified_split(rows: DataFrame, stratum: str, key: str, *, share: float, seed: int | None = None) -> DataFrame:
    """Add ``part``: ``train`` for the first round(n * share) rows of each stratum, else ``validation``.

    Halves round to even; a stratum of two or more keeps at least one row on each side, one of a single row goes
    to train. Rows are ordered by ``key``, or by its hash with ``seed``. The cut is found from counts per hash
    range, so a large stratum is never ranked in one task.
    """
    order = F.col(key) if seed is None else F.xxhash64(F.lit(seed), F.col(key))
    total = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    cut = F.greatest(F.lit(1), F.least(F.greatest(F.col("_n") - 1, F.lit(1)), F.bround(F.col("_n") * share).cast("long")))
    sliced = rows.withColumn("_o", order).withColumn("_s", F.floor(F.col("_o") / 4096) if seed is None else F.shiftright("_o", 48))
    per = sliced.groupBy(stratum, "_s").agg(F.count("*").alias("_m"))
    before = per.withColumn("_before", F.coalesce(F.sum("_m").over(W.Window.partitionBy(stratum).orderBy("_s").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = sliced.withColumn("_r", F.row_number().over(W.Window.partitionBy(stratum, "_s").orderBy("_o", key)))
    joined = ranked.join(before, [ranked[stratum].eqNullSafe(before[stratum]), ranked["_s"] == before["_s"]]).select(ranked["*"], "_before")
    sized = joined.join(total, joined[stratum].eqNullSafe(total[stratum])).select(joined["*"], "_n")
    part = F.when(F.col("_before") + F.col("_r") <= cut, "train").otherwise("validation")
    return sized.withColumn("part", part).select(*rows.columns, "part")


def training_union(feedback: DataFrame, seed: DataFrame) -> DataFrame:
    """Feedback pairs and seed pairs together; repeats stay, missing columns become null."""
    return feedback.unionByName(seed, allowMissingColumns=True)
