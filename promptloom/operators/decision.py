"""The explainable ladder from pair scores to hit or miss, as one chain of conditions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptloom.functions import text as X


@dataclass(frozen=True)
class LadderSettings:
    """Thresholds of the two scorers per tier, overrides per domain and what is switched on."""

    tiers: dict[str, tuple[float, float]] = field(default_factory=lambda: {"low": (0.90, 0.85), "high": (0.99, 0.95)})
    domain_tiers: dict[str, str] = field(default_factory=dict)
    domain_thresholds: dict[str, dict[str, float]] = field(default_factory=dict)
    default_tier: str = "low"
    classifier_threshold: float | None = None
    cross_threshold: float | None = None
    bypass: float | None = 0.995
    veto_opposites: bool = True
    rules: X.EntityRules = X.EntityRules()
    check_entities_on_bypass: bool = False

    def __post_init__(self) -> None:
        if self.default_tier not in self.tiers:
            raise ValueError(f"unknown default tier {self.default_tier!r}")
        for name, tier in self.domain_tiers.items():
            if tier not in self.tiers:
                raise ValueError(f"unknown tier {tier!r} of domain {name!r}")
        for pair in self.tiers.values():
            if not all(0.0 <= t <= 1.0 for t in pair):
                raise ValueError("thresholds lie between 0 and 1")


def _lookup(values: dict, key: Column) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def risk_tier(domain: Column, settings: LadderSettings) -> Column:
    return F.coalesce(_lookup(settings.domain_tiers, domain).cast("string"), F.lit(settings.default_tier))


def thresholds(domain: Column, tier: Column, settings: LadderSettings) -> tuple[Column, Column]:
    """Classifier and cross-encoder threshold: explicit value, else the domain's, else the tier's."""

    def chain(explicit: float | None, name: str, at: int) -> Column:
        by_domain = _lookup({d: t[name] for d, t in settings.domain_thresholds.items() if name in t}, domain).cast("double")
        by_tier = _lookup({t: v[at] for t, v in settings.tiers.items()}, tier).cast("double")
        return F.coalesce(F.lit(explicit).cast("double"), by_domain, by_tier)

    return chain(settings.classifier_threshold, "mlp", 0), chain(settings.cross_threshold, "cross_encoder", 1)


def best_candidates(candidates: DataFrame) -> DataFrame:
    """Per query the candidate with the highest classifier score; ties keep the better similarity rank.

    An aggregate with partial maxima, no window and no sort.
    """
    order = F.struct(F.coalesce("classifier_score", F.lit(-1.0)).alias("s"), (-F.col("rank")).alias("r"))
    columns = [c for c in candidates.columns if c != "query_id"]
    return candidates.groupBy("query_id").agg(F.max_by(F.struct(*columns), order).alias("best")).select("query_id", "best.*")


def decide(pairs: DataFrame, settings: LadderSettings = LadderSettings()) -> DataFrame:
    """Add ``risk_tier``, ``decision``, ``reason`` and ``detector`` to scored pairs.

    Reads query_prompt, cached_prompt (null: no candidate), domain, classifier_score and cross_encoder_score (null:
    that scorer did not run), and ``candidate_known`` where there is one: an index knew a candidate that the store does not
    have any more. Without a candidate the tier is low. Order: no candidate, opposite action, classifier gate, bypass, cross-encoder gate,
    entity change. All of it are JVM expressions, without a shuffle.
    """
    tier = F.when(F.col("cached_prompt").isNull(), F.lit("low")).otherwise(risk_tier(F.col("domain"), settings))
    mlp_gate, cross_gate = thresholds(F.col("domain"), F.col("risk_tier"), settings)
    mlp, cross = F.col("classifier_score"), F.col("cross_encoder_score")
    changed = F.col("_change").isNotNull()
    veto = F.col("_veto") if settings.veto_opposites else F.lit(False)
    bypassed = mlp >= settings.bypass if settings.bypass is not None else F.lit(False)
    entity = F.concat(F.lit("entity_change_detected:"), F.col("_change.detector"))
    on_bypass = F.when(bypassed & changed, entity).when(bypassed, F.lit("mlp_bypass")) if settings.check_entities_on_bypass else F.when(bypassed, F.lit("mlp_bypass"))
    none = F.col("cached_prompt").isNull()
    known = F.col("candidate_known") if "candidate_known" in pairs.columns else F.lit(False)
    reason = F.coalesce(
        F.when(none & known, F.lit("no_candidate_entries_in_store")).when(none, F.lit("no_candidates_found")),
        F.when(veto, F.lit("opposite_action_detected")),
        F.when(mlp.isNull() | (mlp < mlp_gate), F.lit("failed_mlp_threshold")),
        on_bypass,
        F.when(cross.isNull() & changed, entity).when(cross.isNull(), F.lit("passed_mlp_threshold_no_cross_encoder")),
        F.when(cross < cross_gate, F.lit("failed_cross_encoder_threshold")),
        F.when(changed, entity),
        F.lit("passed_all_thresholds"),
    )
    ruled = X.with_entity_change(pairs.withColumn("risk_tier", tier), "query_prompt", "cached_prompt", "_change", settings.rules)
    if settings.veto_opposites:
        ruled = X.with_opposite_action(ruled, "query_prompt", "cached_prompt", "_veto")
    out = ruled.withColumn("reason", reason)
    hit = F.col("reason").isin("mlp_bypass", "passed_all_thresholds", "passed_mlp_threshold_no_cross_encoder")
    return out.withColumn("decision", F.when(hit, "hit").otherwise("miss")).withColumn("detector", F.when(F.col("reason").startswith("entity_change"), F.col("_change.detector"))).drop("_change", "_veto")


def active_learning(decided: DataFrame, source_prefix: str = "") -> DataFrame:
    """Decisions worth labelling: scorers that disagree, and entity changes; all as label 0."""
    source = F.when(F.col("reason") == "failed_cross_encoder_threshold", "mlp_ce_disagreement").when(F.col("reason").startswith("entity_change_detected"), "entity_change")
    return decided.withColumn("source", F.concat(F.lit(source_prefix), source)).where("source is not null").withColumn("label", F.lit(0))
