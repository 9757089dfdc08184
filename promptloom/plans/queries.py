"""Driver queries of the core operators, each over its whole tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from datetime import datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import mutate as U
from promptloom.functions import text as X
from promptloom.functions import vectors as V
from promptloom.operators import decision as D
from promptloom.operators import knn as K
from promptloom.operators import ledger as L
from promptloom.operators import metrics as M
from promptloom.operators import pairmodel as PM
from promptloom.operators import pairs as P
from promptloom.plans.oracle import ORACLE_SQL  # noqa: F401
from promptloom.runtime import shared_dir, shuffle_width, spread
from promptloom.schemas import PAIRS, conform
from promptloom.sources.pairs_io import read_pairs, write_pairs
from promptloom.streaming.reissue import reissue_stream
from promptloom.streaming.replay import ReplaySettings, exact_replay

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

DIM = 64
HIT_COSINE = 0.35
AS_OF = datetime(2026, 1, 1)
DAY = 86_400.0
LADDER = D.LadderSettings(domain_tiers={"medical": "high", "finance": "high", "legal": "high"}, domain_thresholds={"devops": {"mlp": 0.93, "cross_encoder": 0.8}}, bypass=0.995)
RATES = [("large", "0.005", "0.015"), ("small", "0.0005", "0.0015"), ("mini", "0.00015", "0.0006")]
DEFAULT_RATE = ("0.0015", "0.002")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = _vectors(spark, sf_dir)
    queries = vectors.select(F.col("vec_id").alias("query_id"), "vec")
    return K.exact_topk(vectors.select(F.col("vec_id").alias("entry_id"), "vec"), queries, dim=DIM, k=6), queries


@query
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)[0]


@query
def baseline_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, queries = _matches(spark, sf_dir)
    others = found.where("entry_id <> query_id")
    ranked = others.withColumn("rank", F.row_number().over(K.W.Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id")))
    return K.baseline_decision(ranked, queries, threshold=HIT_COSINE)


@query
def domain_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.domain_centroids(_vectors(spark, sf_dir).withColumnRenamed("label", "domain"), dim=DIM)
    return found.select("domain", F.posexplode("centroid").alias("axis", "value")).select("domain", "axis", F.round("value", 6).alias("value"))


@query
def domain_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    rows = K.domain_centroids(vectors.withColumnRenamed("label", "domain"), dim=DIM).orderBy("domain").collect()
    found = K.detect_domain(vectors, [(f"d{r.domain}", list(r.centroid)) for r in rows], threshold=0.3)
    return found.select("vec_id", "domain", "domain_score")


def _neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.select("vec_id", F.col("vec").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec").alias("b")), "vec_id")


@query
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _neighbour_pairs(spark, sf_dir).select("vec_id", V.pair_features(V.normalized(F.col("a")), V.normalized(F.col("b"))).alias("f"))
    total = F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x)
    return f.select("vec_id", F.size("f").alias("width"), F.round(total, 6).alias("square_sum"), F.round(F.col("f")[2 * DIM], 6).alias("first_difference"), F.round(F.col("f")[3 * DIM], 6).alias("first_product"))


def formula_network(dim: int, hidden: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """A small network whose weights follow a formula, so that any engine can rebuild it."""
    first = np.array([[math.sin(1.0 + i + j * 4 * dim) for j in range(hidden)] for i in range(4 * dim)])
    second = np.array([[math.cos(1.0 + j)] for j in range(hidden)])
    return [(first, np.full(hidden, 0.1)), (second, np.array([-0.05]))]


@query
def mlp_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = V.network_score("a", "b", formula_network(DIM), _neighbour_pairs(spark, sf_dir))
    return scored.select("vec_id", F.round("score", 6).alias("score"))


def _lookup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each lookup once, with the prompt of the entry it hit."""
    width = max(shuffle_width(spark), 2 * spark.sparkContext.defaultParallelism)  # the text rules need all cores, so the parts are not merged
    calls = table(spark, sf_dir, "lookup_records").drop("query_embedding").repartition(width, "query_id").distinct()
    prompts = table(spark, sf_dir, "cache_entries").select(F.col("id").alias("cache_entry_id"), F.col("prompt").alias("cached_prompt"))
    domain = F.lower(F.regexp_replace(X.strip_space(F.col("domain")), r"[ _]", "-"))
    return L.salted_join(calls, prompts, ["cache_entry_id"]).withColumn("domain", domain)


@query
def decision_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.decide(_lookup_pairs(spark, sf_dir), LADDER).select("query_id", "risk_tier", "decision", "reason", "detector")


@query
def decision_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = D.decide(_lookup_pairs(spark, sf_dir), LADDER)
    return decided.groupBy("domain", "risk_tier", "reason").agg(F.count("*").alias("lookups"))


@query
def decision_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.stage_report(D.decide(_lookup_pairs(spark, sf_dir), LADDER), ["domain"])


@query
def decision_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.outcome_stats(D.decide(_lookup_pairs(spark, sf_dir), LADDER)).withColumn("hit_rate", F.round("hit_rate", 6))


@query
def active_learning_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.active_learning(D.decide(_lookup_pairs(spark, sf_dir), LADDER)).select("query_id", "source", "label")


@query
def risk_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    domains = _lookup_pairs(spark, sf_dir).select("domain").distinct()
    tier = D.risk_tier(F.col("domain"), LADDER)
    mlp, cross = D.thresholds(F.col("domain"), tier, LADDER)
    return domains.select("domain", tier.alias("risk_tier"), mlp.alias("mlp_threshold"), cross.alias("cross_threshold"))


@query
def argmax_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "active_learning_pairs").distinct().select(F.col("query_prompt").alias("query_id"), "cached_prompt", "classifier_score")
    order = K.W.Window.partitionBy("query_id").orderBy("cached_prompt", "classifier_score")
    return D.best_candidates(pairs.withColumn("rank", F.row_number().over(order))).select("query_id", "cached_prompt", F.round("classifier_score", 6).alias("classifier_score"))


def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "equivalence_gold"), "pair_id")


@query
def opposite_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_opposite_action(_gold(spark, sf_dir), "prompt_a", "prompt_b", "opposite").select("pair_id", "opposite")


@query
def entity_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.with_entity_change(_gold(spark, sf_dir), "prompt_a", "prompt_b", "c").select("pair_id", "c.*")


def _picked(sentence: str, words: list[str], key: str) -> str:
    """A sentence with one of some words, chosen by a key of the row."""
    listed = ", ".join(f"'{w}'" for w in words)
    return f"replace('{sentence}', '%', element_at(array({listed}), CAST({key} % {len(words)} + 1 AS INT)))"


_ORDINALS, _DOSES, _TIMES = ["first", "second", "third", "4th", "21st"], ["ibuprofen", "Warfarin", "insulin", "metformin", "water", "tea"], ["current", "latest", "previous", "Next", "recent", "full"]
_RESETS = ["my password", "the admin password", "the Guest password", "the door"]
#: Pairs of prompts written from orders, for the detectors that the labelled pairs hold nothing for.
RENDERED = {
    "quarter": ("concat('Summary for Q', quarter(o_orderdate))", "concat('Summary for quarter ', o_custkey % 4 + 1)"),
    "year": ("concat('Total for ', year(o_orderdate))", "concat('Total for ', year(o_orderdate) + o_custkey % 2)"),
    **{d: (_picked(s, w, "o_orderkey"), _picked(s, w, "o_custkey")) for d, s, w in (("ordinal", "Send the % copy", _ORDINALS), ("drug", "Dose of %", _DOSES), ("temporal", "Show the % report", _TIMES), ("privilege", "Reset %", _RESETS))},
}


def _entity_query(detector: str) -> Callable[[SparkSession, str], DataFrame]:
    only = X.EntityRules(disabled=tuple(d for d in X.DETECTORS if d != detector))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _gold(spark, sf_dir).select(F.concat(F.lit("g"), "pair_id").alias("pair_id"), "prompt_a", "prompt_b")
        if detector in RENDERED:
            a, b = RENDERED[detector]
            rows = rows.unionByName(table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("pair_id"), F.expr(a).alias("prompt_a"), F.expr(b).alias("prompt_b")))
        found = X.with_entity_change(rows, "prompt_a", "prompt_b", "c", only)
        return found.where("c is not null").select("pair_id", "c.token_a", "c.token_b")

    run.__name__ = f"entity_{detector}"
    return run


for _detector in X.DETECTORS:
    query(_entity_query(_detector))


@query
def text_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "cache_entries")
    cost = X.usage_cost(F.col("prompt"), F.col("response"), F.col("model"), RATES, DEFAULT_RATE)
    return e.select("id", X.estimated_tokens(F.col("response")).alias("tokens"), cost.cast("string").alias("cost"), X.shortened(F.col("prompt")).alias("short"))


@query
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _gold(spark, sf_dir).select("pair_id", V.hash_embedding(F.col("prompt_a"), 16).alias("v"))
    return e.select("pair_id", F.posexplode("v").alias("axis", "value"))


@query
def support_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _gold(spark, sf_dir).select("pair_id", V.support_embedding(F.col("prompt_a")).alias("v"))
    return e.select("pair_id", F.posexplode("v").alias("axis", "value"))


@query
def request_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gold(spark, sf_dir).select("pair_id", X.request_key(F.col("prompt_a"), F.col("prompt_b")).alias("request_key"))


def _mutation_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _gold(spark, sf_dir).select("pair_id", U.MUTATIONS[name](F.col("prompt_a")).alias("mutated"))

    run.__name__ = f"mutate_{name}"
    return run


for _name in U.MUTATIONS:
    query(_mutation_query(_name))


@query
def ledger_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ledger_stats(*[table(spark, sf_dir, t) for t in ("cache_entries", "lookup_records", "feedback_events")])


def _counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.entry_counters(*[table(spark, sf_dir, t) for t in ("cache_entries", "lookup_records", "feedback_events")])


@query
def entry_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counters(spark, sf_dir)


@query
def counter_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "cache_entries").select("id", F.col("hit_count").alias("stored_hits"))
    return stored.join(_counters(spark, sf_dir).select("id", "hit_count"), "id").where("stored_hits <> hit_count").select("id", "stored_hits", F.col("hit_count").alias("ledger_hits"))


@query
def reissued_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.reissued_lookups(table(spark, sf_dir, "lookup_records").select("query_id", "domain", "query_prompt", "created_at"), window_seconds=DAY)


@query
def open_reissues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-issues whose earlier hit has no feedback yet."""
    lookups = table(spark, sf_dir, "lookup_records").select("query_id", "domain", "query_prompt", "created_at")
    return L.reissued_lookups(lookups, window_seconds=DAY, feedback=table(spark, sf_dir, "feedback_events"))


@query
def upsert_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup ledger as it stands when a later row of a query replaces an earlier one."""
    rows = table(spark, sf_dir, "lookup_records").select("query_id", "cache_entry_id", "query_prompt", "similarity_score", "created_at")
    return L.latest_by_key(rows, "query_id", ["created_at", "cache_entry_id"])


@query
def record_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.accepted_feedback(table(spark, sf_dir, "feedback_events").select("id", "query_id", "label").distinct(), table(spark, sf_dir, "lookup_records"))


@query
def unflagged_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookups, feedback = table(spark, sf_dir, "lookup_records"), table(spark, sf_dir, "feedback_events")
    return L.unflagged_hits(lookups.select("query_id", "domain", "query_prompt", "created_at"), feedback, as_of=AS_OF, window_seconds=30 * DAY)


@query
def latest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lookup_records").select("cache_entry_id", "query_id", "created_at", "similarity_score")
    return L.latest_by_key(rows, "cache_entry_id", ["created_at", "query_id"])


@query
def feedback_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.feedback_pairs(*[table(spark, sf_dir, t) for t in ("feedback_events", "lookup_records", "cache_entries")])
    told = lambda name: F.get_json_object("metadata", f"$.{name}")
    return found.select("prompt_a", "prompt_b", "label", "domain", "source", "split", *L.FEEDBACK_LINEAGE, told("via").alias("via"), told("feedback_event_id").alias("metadata_event"))


@query
def active_learning_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.active_learning_pairs(table(spark, sf_dir, "active_learning_pairs"))
    return found.withColumn("metadata_id", F.get_json_object("metadata", "$.active_learning_id")).drop("metadata")


@query
def evict_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.expired(table(spark, sf_dir, "cache_entries"), as_of=AS_OF, ttl_seconds=240 * DAY)


def _half(entries: DataFrame) -> int:
    return entries.count() // 2


@query
def evict_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "cache_entries").select("id", "created_at")
    return L.lru_victims(entries, _counters(spark, sf_dir), max_entries=_half(entries))


@query
def evict_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "cache_entries").select("id", "created_at")
    return L.hybrid_victims(entries, _counters(spark, sf_dir), as_of=AS_OF, ttl_seconds=240 * DAY, max_entries=_half(entries) // 2)


@query
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    victims = evict_ttl(spark, sf_dir)
    lookups, feedback = table(spark, sf_dir, "lookup_records").select("query_id", "cache_entry_id"), table(spark, sf_dir, "feedback_events").select("id", "query_id", "cache_entry_id")
    kept, left = L.cascade_delete(victims, lookups, feedback)
    return kept.groupBy("cache_entry_id").agg(F.count("*").alias("lookups")).join(left.groupBy("cache_entry_id").agg(F.count("*").alias("feedback")), "cache_entry_id", "left")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lookups: each feedback event once with the scores of its lookup."""
    events = table(spark, sf_dir, "feedback_events").select("id", "query_id", "label").distinct()
    calls = table(spark, sf_dir, "lookup_records").select("query_id", "domain", "similarity_score", "classifier_score", "cross_encoder_score").distinct()
    domain = F.lower(F.regexp_replace(X.strip_space(F.col("domain")), r"[ _]", "-"))
    return events.join(calls, "query_id").withColumn("domain", domain).withColumn("score", F.col("classifier_score"))


@query
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.binary_metrics(_scored(spark, sf_dir), ["domain"], threshold=0.95)


@query
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.binary_metrics(_scored(spark, sf_dir).withColumn("score", F.col("similarity_score")), ["domain"], threshold=0.9, empty_precision=1.0)


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.roc_auc(_scored(spark, sf_dir), ["domain"])


@query
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.calibration_error(_scored(spark, sf_dir), ["domain"])


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(_scored(spark, sf_dir), ["domain"])


@query
def precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_precision(M.threshold_sweep(_scored(spark, sf_dir), ["domain"]), ["domain"], target_recall=0.8)


@query
def grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.grid_search(_scored(spark, sf_dir), ["domain"], first=(0.8, 0.005, 40), second=(0.7, 0.01, 30), fpr_limits={"finance": 0.1, "medical": 0.05}, limit_key="domain")


@query
def blocked_false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.blocked_false_positives(_scored(spark, sf_dir), ["domain"], cosine_threshold=0.9, classifier_threshold=0.95)


def _decided_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups decided by the ladder, once for each label that feedback gives them."""
    labels = table(spark, sf_dir, "feedback_events").select("id", "query_id", "label").distinct()
    return labels.join(D.decide(_lookup_pairs(spark, sf_dir), LADDER), "query_id")


@query
def comparison_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine, classifier, both scorers and the whole ladder, per domain."""
    return M.comparison_matrix(_decided_labels(spark, sf_dir), ["domain"])


@query
def method_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety and reuse of the four ways of deciding."""
    rows = M.method_decisions(_decided_labels(spark, sf_dir).where("label in (0, 1)").select("label", "similarity_score", "classifier_score", "cross_encoder_score", "decision"))
    outcome = lambda c: F.when(c, "hit").otherwise("miss")
    return M.expectation_report(rows.withColumns({"expected": outcome(F.col("label") == 1), "decision": outcome(F.col("hit"))}), ["method"])


@query
def baseline_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.scenario_summary(_scored(spark, sf_dir), ["domain"], thresholds=[0.7, 0.8, 0.9, 0.95, 0.98])


@query
def six_point_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.threshold_sweep(_scored(spark, sf_dir), ["domain"], lowest=0.7, step=0.05, count=6)


@query
def reply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a response's lines without bullets, numbers and quotes."""
    lines = table(spark, sf_dir, "cache_entries").where("response is not null").select("id", F.explode(X.cleaned_lines(F.col("response"))).alias("line"))
    return lines.groupBy("id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


@query
def rendered_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.rendered(F.lower("p_type"), F.col("p_name")).alias("prompt"))


@query
def pairs_of_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = P.checked_pairs(table(spark, sf_dir, "equivalence_gold"))
    return good.where("domain = 'finance' and split = 'test'").select("pair_id", "prompt_a", "prompt_b", "label")


@query
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.class_weights(_gold(spark, sf_dir), ["source"])


@query
def label_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.label_summary(_gold(spark, sf_dir), ["source"])


@query
def expectation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift report: pairs of label 1 should hit, of label 0 should miss; only the text rules decide."""
    pairs = _gold(spark, sf_dir).select("source", "label", F.col("prompt_a").alias("query_prompt"), F.col("prompt_b").alias("cached_prompt"), F.lit("x").alias("domain"), F.lit(0.97).alias("classifier_score"), F.lit(None).cast("double").alias("cross_encoder_score"))
    decided = D.decide(pairs, D.LadderSettings(bypass=None)).withColumn("expected", F.when(F.col("label") == 1, "hit").when(F.col("label") == 0, "miss"))
    return M.expectation_report(decided, ["source"])


@query
def mutation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the text rules on a prompt against its own mutations, per mutation."""
    base = _gold(spark, sf_dir).select(F.col("prompt_a").alias("cached_prompt"))
    sides = F.explode(F.array(*[F.struct(F.lit(n).alias("mutation"), f(F.col("cached_prompt")).alias("query_prompt")) for n, f in U.MUTATIONS.items()]))
    pairs = base.select("cached_prompt", sides.alias("m")).select("cached_prompt", "m.*").withColumns({"domain": F.lit("x"), "classifier_score": F.lit(0.97), "cross_encoder_score": F.lit(None).cast("double")})
    return D.decide(pairs, D.LadderSettings(bypass=None)).groupBy("mutation").agg(F.count_if(F.col("decision") == "hit").alias("hits"), F.count_if(F.col("decision") == "miss").alias("misses"))


@query
def checked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = P.checked_pairs(conform(_gold(spark, sf_dir), PAIRS))
    return good.groupBy("split").agg(F.count("*").alias("rows")).withColumn("problem", F.lit(None).cast("string")).unionByName(bad.groupBy("split", "problem").agg(F.count("*").alias("rows")))


@query
def concept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("order "), "o_orderkey", F.lit(" "), "o_orderpriority")
    return P.concept_pairs(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("concept"), F.col("o_orderkey").alias("position"), text.alias("text")))


@query
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("template"), F.lit("a").alias("side"), F.col("c_custkey").alias("position"), F.col("c_name").alias("text"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("template"), F.lit("b").alias("side"), F.col("s_suppkey").alias("position"), F.col("s_name").alias("text"))
    return P.template_pairs(a.unionByName(b))


@query
def easy_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unrelated_pairs(table(spark, sf_dir, "part").select(F.col("p_brand").alias("concept"), F.col("p_name").alias("text")))


@query
def both_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.both_orders(_gold(spark, sf_dir).select("pair_id", "prompt_a", "prompt_b", "label"))


@query
def unordered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.unordered_distinct(_gold(spark, sf_dir))


@query
def paraphrase_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _gold(spark, sf_dir).select(F.col("source").alias("grp"), F.col("prompt_a").alias("text"), "pair_id", F.col("prompt_b").alias("origin"))
    return P.first_of_case(texts, "grp", F.col("pair_id"), "origin")


@query
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.stratified_split(_gold(spark, sf_dir).select("pair_id", "source"), "source", "pair_id", share=0.85)


@query
def training_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    feedback = L.feedback_pairs(*[table(spark, sf_dir, t) for t in ("feedback_events", "lookup_records", "cache_entries")])
    both = P.training_union(conform(feedback, PAIRS), conform(_gold(spark, sf_dir), PAIRS))
    return both.groupBy("source", "label").agg(F.count("*").alias("rows"))


@query
def stream_reissued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming operator over the whole lookup ledger in one run, into a table of the shared folder."""
    schema = table(spark, sf_dir, "lookup_records").schema
    stream = spark.readStream.schema(schema).parquet(_stream_folder(f"{sf_dir}/lookup_records.parquet")).select("query_id", "domain", "query_prompt", "created_at")
    out = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    found = reissue_stream(stream.where("query_id is not null"), window_seconds=DAY, lateness="1 day 10 minutes")
    running = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema("query_id string, previous_id string, gap_seconds double").parquet(f"{out}/rows")


def _stream_folder(path: str) -> str:
    """A file source takes folders or globs; a single file is named by a glob that matches it alone."""
    return path if not path.endswith(".parquet") else path[: -len("t")] + "[t]"


@query
def replay_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact replay of all vectors, one cache instance per label."""
    calls = _vectors(spark, sf_dir).select(F.col("label").cast("string").alias("instance"), F.col("vec_id").alias("seq"), F.col("vec_id").cast("double").alias("at_seconds"), "vec")
    return exact_replay(calls, ReplaySettings(threshold=0.4, max_entries=1000, ttl_seconds=None))


@query
def entry_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "cache_entries")
    wanted = entries.agg(F.min("id")).first()[0]
    return entries.where(F.col("id") == wanted).select("id", "prompt", "response", "model")


@query
def entries_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cache_entries").select("id", "created_at").orderBy("created_at", "id")


@query
def feedback_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feedback_events").select("id", "query_id", "label", "created_at").distinct().orderBy("created_at", "id")


@query
def served_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each decided lookup is answered with: the stored response on a hit, and the tokens that saves."""
    decided = D.decide(_lookup_pairs(spark, sf_dir), LADDER).select("query_id", "cache_entry_id", "decision")
    stored = table(spark, sf_dir, "cache_entries").select(F.col("id").alias("cache_entry_id"), "response")
    hit = F.col("decision") == "hit"
    joined = L.salted_join(decided, stored, ["cache_entry_id"])
    return joined.select("query_id", "decision", F.when(hit, F.col("response")).alias("answer"), F.when(hit, X.estimated_tokens(F.col("response"))).otherwise(0).cast("long").alias("tokens_saved"))


@query
def pairs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid pairs written as JSON lines to the shared folder and read back."""
    good, _ = P.checked_pairs(conform(table(spark, sf_dir, "equivalence_gold"), PAIRS))
    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    write_pairs(good, path)
    return read_pairs(spark, path)


@query
def pair_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network trained on the training split with hash embeddings and measured on the others."""
    good, _ = P.checked_pairs(conform(table(spark, sf_dir, "equivalence_gold"), PAIRS))
    pairs = PM.embedded(good.withColumn("split", F.lower(X.strip_space(F.col("split")))), lambda c: V.hash_embedding(c, 32).cast("array<float>"))
    model = PM.train(pairs.where("split = 'train'"), dim=32, settings=PM.TrainSettings(epochs=2, max_rows=20_000))
    return PM.evaluate(model, pairs.where("split <> 'train'").select("split", "label", "vec_a", "vec_b"), ["split"])
