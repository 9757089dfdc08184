"""Ledgers of entries, lookups and feedback: counters, re-issues, exports, eviction, cascades."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from promptloom.functions.text import strip_space
from promptloom.runtime import materialize, salted_join
from promptloom.schemas import FEEDBACK_EVENTS, LOOKUP_RECORDS, conform

# Name of the source of exported feedback pairs.
FEEDBACK_SOURCE = "ledger-feedback"


def latest_by_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Upsert of an append-only ledger: the last row of each key; equal rows collapse. Partial maxima, no sort."""
    columns = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last")).select(key, "last.*")


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``current`` whose key does not change, and the changed rows."""
    return current.join(changes, key, "left_anti").unionByName(changes)


def entry_counters(entries: DataFrame, lookups: DataFrame, feedback: DataFrame) -> DataFrame:
    """``(id, hit_count, last_hit_at, negative, positive)`` derived from the ledgers, zero where nothing happened.

    Rows delivered twice count once. Lookups and feedback are reduced per entry before they are joined, so a hot
    entry costs one row.
    """
    hits = lookups.select("query_id", "cache_entry_id", "created_at").distinct().groupBy("cache_entry_id").agg(F.count("*").alias("hit_count"), F.max("created_at").alias("last_hit_at"))
    marks = feedback.select("id", "cache_entry_id", "label").distinct().groupBy("cache_entry_id").agg(F.count_if(F.col("label") == 0).alias("negative"), F.count_if(F.col("label") == 1).alias("positive"))
    joined = entries.select("id").join(hits.withColumnRenamed("cache_entry_id", "id"), "id", "left").join(marks.withColumnRenamed("cache_entry_id", "id"), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select("id", zero("hit_count"), "last_hit_at", zero("negative"), zero("positive"))


def ledger_stats(entries: DataFrame, lookups: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row of totals: entries, hits as stored and as the lookups tell, lookups and feedback events, each delivered row once."""
    one = entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum("hit_count"), F.lit(0)).alias("stored_hits"))
    hits = lookups.select("query_id", "cache_entry_id", "created_at").distinct().join(entries.select(F.col("id").alias("cache_entry_id")).distinct(), "cache_entry_id", "left_semi").agg(F.count("*").alias("total_hits"))
    two = lookups.select("query_id").distinct().agg(F.count("*").alias("lookups"))
    three = feedback.select("id", "label").distinct().agg(F.count("*").alias("feedback"), F.count_if(F.col("label") == 0).alias("bad"))
    return one.join(hits, F.lit(True)).join(two, F.lit(True)).join(three, F.lit(True))


def outcome_stats(decided: DataFrame) -> DataFrame:
    """``(lookups, hits, misses, hit_rate)`` of decided queries; the rate is 0 when there are none."""
    counted = decided.agg(F.count("*").alias("lookups"), F.count_if(F.col("decision") == "hit").alias("hits"))
    return counted.select("lookups", "hits", (F.col("lookups") - F.col("hits")).alias("misses"), F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups")).otherwise(0.0).alias("hit_rate"))


def reissued_lookups(lookups: DataFrame, *, window_seconds: float, order: str = "query_id", feedback: DataFrame | None = None) -> DataFrame:
    """``(query_id, previous_id, gap_seconds)``: lookups that repeat the same prompt of a domain within the window.

    The earlier one is the implicit bad hit; the window is inclusive. Prompts are compared without outer white
    space. Rows of one (domain, prompt) are cut into stretches of time before they are ordered, each with the last
    row of the stretch before, so a prompt that holds much of the ledger is not sorted in one task. Hits with ``feedback``
    are not flagged again: pairs whose earlier lookup has any are left out.
    """
    width = max(float(window_seconds), 1.0) * 64
    base = lookups.select("query_id", "domain", strip_space(F.col("query_prompt")).alias("prompt"), "created_at").distinct()
    at = F.unix_micros("created_at") / 1e6
    cut = base.withColumn("at", at).withColumn("stretch", F.floor(F.col("at") / width)).withColumn("own", F.lit(True))
    over = cut.where(F.col("at") + window_seconds >= (F.col("stretch") + 1) * width).withColumn("stretch", F.col("stretch") + 1).withColumn("own", F.lit(False))
    both = cut.unionByName(over)
    by = W.Window.partitionBy("domain", "prompt", "stretch").orderBy("created_at", order)
    seen = both.withColumn("previous_id", F.lag("query_id").over(by)).withColumn("gap_seconds", F.round(F.col("at") - F.lag("at").over(by), 6))
    found = seen.where(F.col("own") & (F.col("gap_seconds") <= window_seconds)).select("query_id", "previous_id", "gap_seconds")
    return found if feedback is None else found.join(feedback.select(F.col("query_id").alias("previous_id")).distinct(), "previous_id", "left_anti").select("query_id", "previous_id", "gap_seconds")


def unflagged_hits(lookups: DataFrame, feedback: DataFrame, *, as_of: datetime, window_seconds: float) -> DataFrame:
    """Newest hit without feedback of each (domain, prompt) not older than the window: ``(domain, prompt, query_id)``."""
    recent = lookups.where(F.col("created_at") >= F.lit(as_of) - F.make_dt_interval(secs=F.lit(window_seconds))).where(F.col("created_at") <= F.lit(as_of))
    open_ones = recent.join(feedback.select("query_id").distinct(), "query_id", "left_anti")
    prompt = strip_space(F.col("query_prompt")).alias("prompt")
    return open_ones.groupBy("domain", prompt).agg(F.max_by("query_id", F.struct("created_at", "query_id")).alias("query_id"))


#: Lineage of exported pairs, which becomes their metadata.
FEEDBACK_LINEAGE = ["feedback_event_id", "query_id", "cache_entry_id", "reason", "similarity_score", "classifier_score", "cross_encoder_score", "feedback_created_at"]
PAIR_LINEAGE = ["active_learning_id", "similarity_score", "classifier_score", "cross_encoder_score", "created_at"]


def with_lineage(own: Column | None, names: list[str]) -> Column:
    """JSON of the lineage columns, after the fields of ``own`` metadata, over which they have precedence."""
    lineage = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    if own is None:
        return lineage
    inner = F.regexp_extract(F.coalesce(own, F.lit("")), r"(?s)^\s*\{\s*(.*?)\s*\}\s*$", 1)
    return F.when(F.length(inner) > 0, F.concat(F.lit("{"), inner, F.lit(","), F.substr(lineage, F.lit(2)))).otherwise(lineage)


def feedback_pairs(feedback: DataFrame, lookups: DataFrame, entries: DataFrame, *, split: str = "train") -> DataFrame:
    """Labelled pairs from feedback with their lineage: prompt of the lookup, prompt of the event's entry, label, ``metadata``.

    Each feedback event counts once however often it was delivered; events without lookup or entry are left out.
    ``metadata`` is JSON of the event's own metadata and the lineage, whose fields are also columns.
    """
    feedback, lookups = conform(feedback, FEEDBACK_EVENTS), conform(lookups, LOOKUP_RECORDS)
    events = feedback.select(F.col("id").alias("feedback_event_id"), "query_id", "cache_entry_id", "label", "reason", F.col("created_at").alias("feedback_created_at"), F.col("metadata_json").alias("_own")).distinct()
    scores = ["similarity_score", "classifier_score", "cross_encoder_score"]
    calls = latest_by_key(lookups.select("query_id", "domain", "query_prompt", *scores, "created_at"), "query_id", ["created_at", "query_prompt"]).drop("created_at")
    called = events.join(calls, "query_id")
    joined = salted_join(called, entries.select(F.col("id").alias("cache_entry_id"), F.col("prompt").alias("prompt_b")), ["cache_entry_id"])
    return joined.select(F.col("query_prompt").alias("prompt_a"), "prompt_b", "label", "domain", F.lit(FEEDBACK_SOURCE).alias("source"), F.lit(split).alias("split"), with_lineage(F.col("_own"), FEEDBACK_LINEAGE).alias("metadata"), *FEEDBACK_LINEAGE)


def active_learning_pairs(pairs: DataFrame, *, split: str = "train") -> DataFrame:
    """Stored active-learning pairs in the form of labelled pairs with their lineage, each delivered row once."""
    distinct = pairs.withColumnRenamed("id", "active_learning_id").select("query_prompt", "cached_prompt", "label", "domain", "source", *PAIR_LINEAGE).distinct()
    return distinct.select(F.col("query_prompt").alias("prompt_a"), F.col("cached_prompt").alias("prompt_b"), "label", "domain", "source", F.lit(split).alias("split"), with_lineage(None, PAIR_LINEAGE).alias("metadata"), *PAIR_LINEAGE)


def accepted_feedback(reports: DataFrame, lookups: DataFrame) -> DataFrame:
    """Reports whose lookup exists and whose label is 0 or 1; the others are not recorded."""
    return reports.where("label in (0, 1)").join(lookups.select("query_id").distinct(), "query_id", "left_semi")


def expired(entries: DataFrame, *, as_of: datetime, ttl_seconds: float) -> DataFrame:
    """Ids of entries created before ``as_of`` less the time to live (strictly)."""
    return entries.where(F.col("created_at") < F.lit(as_of) - F.make_dt_interval(secs=F.lit(ttl_seconds))).select("id")


def first_in_order(rows: DataFrame, n: int, order: list[str], *, slices: int = 4096, few: int = 100_000) -> DataFrame:
    """The first ``n`` rows in order of the columns ``order``, exactly and without sorting all rows in one task.

    Whole numbers, times and the first bytes of texts are cut into equal slices between their bounds, and again inside the
    slice in which the cut falls, column by column, until few rows are left there or the columns end. What is left is taken in order by partial heaps of
    at most the rows that are still wanted. Only counts per slice come to the driver.
    """
    if n <= 0:
        return rows.limit(0)
    cut, taken = rows, []
    left = n
    for name in order:
        kind = rows.schema[name].dataType.typeName()
        at = F.unix_micros(name) if kind == "timestamp" else F.conv(F.rpad(F.substring(F.hex(F.encode(F.col(name), "UTF-8")), 1, 12), 12, "0"), 16, 10).cast("long") if kind == "string" else F.col(name).cast("long")
        while True:
            low, high, total = cut.agg(F.min(at), F.max(at), F.count("*")).first()
            if total <= few or low is None or low == high:
                break
            step = max(1, -(-(high - low + 1) // slices))
            sliced = F.floor((at - low) / step)
            running = 0
            for r in sorted(cut.groupBy(sliced.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: r.s):
                if running + r.n > left:
                    break
                running += r.n
            else:
                return _together([*taken, cut])
            taken.append(cut.where(sliced < r.s))
            cut, left = cut.where(sliced == r.s), left - running
            if left == 0:
                return _together(taken)
        if total <= few:
            break
    return _together([*taken, cut.orderBy(*order).limit(left)])


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def lru_victims(entries: DataFrame, counters: DataFrame, *, max_entries: int) -> DataFrame:
    """Ids to evict so that ``max_entries`` stay: most negative feedback first, then longest unused, then oldest."""
    used = entries.select("id", "created_at").join(counters.select("id", "negative", "last_hit_at"), "id", "left")
    ranked = materialize(used.select("id", (-F.coalesce("negative", F.lit(0))).cast("long").alias("liked"), F.coalesce("last_hit_at", "created_at").alias("used_at"), "created_at"))
    return first_in_order(ranked, ranked.count() - max_entries, ["liked", "used_at", "created_at", "id"]).select("id")


def hybrid_victims(entries: DataFrame, counters: DataFrame, *, as_of: datetime, ttl_seconds: float, max_entries: int) -> DataFrame:
    """``(id, cause)``: expired entries, and of those that stay the least recently used beyond ``max_entries``."""
    old = expired(entries, as_of=as_of, ttl_seconds=ttl_seconds)
    rest = entries.join(old, "id", "left_anti")
    return old.withColumn("cause", F.lit("ttl")).unionByName(lru_victims(rest, counters, max_entries=max_entries).withColumn("cause", F.lit("lru")))


def cascade_delete(victims: DataFrame, lookups: DataFrame, feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lookups and feedback that remain once the entries in ``victims(id)`` are deleted with all that hangs on them."""
    gone = victims.select(F.col("id").alias("cache_entry_id"))
    kept = lookups.join(gone, "cache_entry_id", "left_anti")
    lost = lookups.join(gone, "cache_entry_id", "left_semi").select("query_id").distinct()
    return kept, feedback.join(gone, "cache_entry_id", "left_anti").join(lost, "query_id", "left_anti")
