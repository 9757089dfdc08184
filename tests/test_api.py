import json
import os
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import promptloom
from promptloom.api import CacheSettings, ModelCallError, PromptCache, RetrySettings, StoreError, call_with_retry
from promptloom.operators import decision as D
from promptloom.sources.ledger_io import Ledgers

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def ask(spark, *prompts):
    return spark.createDataFrame(list(enumerate(prompts, 1)), "query_id long, prompt string")


def test_totals_cost_and_repeats(spark, tmp_path):
    rates = (("m", "1", "2"),)
    with PromptCache(spark, str(tmp_path / "c"), "d", settings=CacheSettings(dim=16, implicit_window_seconds=60, rates=rates)) as cache:
        first = cache.get_or_call(ask(spark, "reset the key"), lambda p: "press it long", model_name="m", metadata={"team": 1}, as_of=T0).first()
        assert (first.was_hit, first.tokens_saved, first.cost_saved, first.implicit_bad_hit) == (False, 0, 0, False) and first.entry_id and first.latency_ms > 0
        for n in (1, 2):
            hit = cache.get_or_call(ask(spark, "reset the key"), lambda p: "never", model_name="m", as_of=T0 + timedelta(seconds=n)).first()
        assert (hit.was_hit, hit.entry_id, hit.tokens_saved, hit.implicit_bad_hit) == (True, first.entry_id, 3, True) and hit.cost_saved == Decimal("0.009")
        stats = cache.stats()
        assert (stats["entries"], stats["total_hits"], stats["lookups"], stats["asked"], stats["hits"], stats["misses"], stats["bad"]) == (1, 2, 2, 3, 2, 1, 1)
        assert stats["hit_rate"] == pytest.approx(2 / 3) and stats["cost_saved"] == Decimal("0.018")
        entry = cache.entries().first()
        assert (entry.hit_count, entry.feedback_negative_count, json.loads(entry.metadata_json)) == (2, 1, {"team": 1})
        about = json.loads(cache.ledgers.read("feedback_events").first().metadata_json)
        assert about == {"auto_detected": True, "detector": "re-issue", "elapsed_seconds": 1.0, "window_seconds": 60.0}
        assert cache.report_good_hit(hit.lookup_id) and not cache.report_bad_hit("unknown")
        assert cache.ledgers.lookup(hit.lookup_id).count() == 1 and cache.ledgers.entry(first.entry_id).count() == 1
        assert cache.export_feedback(str(tmp_path / "f")) == 2
        lines = [json.loads(x) for f in sorted(os.listdir(tmp_path / "f")) if f.endswith(".json") for x in open(tmp_path / "f" / f)]
        told = [json.loads(x["metadata"]) for x in lines]
        assert [x["label"] for x in lines] == [0, 1] and told[0]["detector"] == "re-issue" and set(told[1]) >= {"feedback_event_id", "query_id", "cache_entry_id", "reason", "similarity_score", "classifier_score", "cross_encoder_score", "feedback_created_at"}
    with pytest.raises(StoreError):
        cache.lookup(ask(spark, "x"))


def test_scorers_domains_and_doubtful_pairs(spark, tmp_path):
    class Same:  # a classifier that finds all pairs nearly equal; defined here, so that it travels by value
        def predict_batch(self, pairs):
            return [0.97 for _ in pairs]

    def cross(pairs):
        return [0.2 if "window" in a else 0.9 for a, _ in pairs]

    embed = lambda text: F.when(text.contains("law"), F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.1)))
    ladder = D.LadderSettings(domain_tiers={"legal": "high"}, bypass=None)
    cache = PromptCache(spark, str(tmp_path / "c"), "d", settings=CacheSettings(dim=2, ladder=ladder), embed=embed, model=Same(), cross_encoder=cross, centroids=[("legal", [0.0, 1.0])])
    cache.get_or_call(ask(spark, "open the door"), str.upper, as_of=T0)
    rows = {r.prompt: r for r in cache.get_or_call(ask(spark, "open the doors", "open the window", "open the law"), str.upper, as_of=T0 + timedelta(seconds=5)).collect()}
    assert rows["open the doors"].reason == "passed_all_thresholds" and rows["open the doors"].cross_encoder_score == 0.9
    assert rows["open the window"].reason == "failed_cross_encoder_threshold"
    assert rows["open the law"].reason == "failed_mlp_threshold" and rows["open the law"].cross_encoder_score is None
    kept = cache.ledgers.read("active_learning_pairs").collect()
    assert [(r.query_prompt, r.cached_prompt, r.source, r.label) for r in kept] == [("open the window", "open the door", "mlp_ce_disagreement", 0)]


def test_candidates_that_are_gone(spark):
    rows = [(1, "a", None, True), (2, "a", None, False), (3, "a b", "a b", True)]
    df = spark.createDataFrame(rows, "query_id int, query_prompt string, cached_prompt string, candidate_known boolean").withColumns({"domain": F.lit("legal"), "classifier_score": F.lit(0.97), "cross_encoder_score": F.lit(None).cast("double")})
    got = {r.query_id: (r.reason, r.risk_tier) for r in D.decide(df, D.LadderSettings(domain_tiers={"legal": "high"})).collect()}
    assert got == {1: ("no_candidate_entries_in_store", "low"), 2: ("no_candidates_found", "low"), 3: ("failed_mlp_threshold", "high")}


def test_retries_of_named_errors_and_async_models():
    async def later(prompt):
        return prompt + "!"

    assert call_with_retry(later, "p", RetrySettings(), lambda s: None) == "p!"
    calls = []

    def broken(prompt):
        calls.append(prompt)
        raise KeyError("no")

    with pytest.raises(KeyError):
        call_with_retry(broken, "p", RetrySettings(attempts=3, retry_on=(OSError,)), lambda s: None)
    with pytest.raises(ModelCallError):
        call_with_retry(broken, "p", RetrySettings(attempts=2, retry_on=(LookupError,)), lambda s: None)
    assert len(calls) == 3
    for wrong in (dict(attempts=0), dict(factor=0.5), dict(retry_on=())):
        with pytest.raises(ValueError):
            RetrySettings(**wrong)
    for wrong in (dict(ttl_seconds=0), dict(implicit_window_seconds=-1)):
        with pytest.raises(ValueError):
            CacheSettings(**wrong)


def test_ledgers_are_exchanged_at_once(spark, tmp_path):
    ledgers = Ledgers(spark, str(tmp_path))
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    ledgers.append("cache_entries", rows("a", "b"))
    before = ledgers.read("cache_entries")
    ledgers.replace({"cache_entries": ledgers.read("cache_entries").where("id = 'a'"), "feedback_events": rows("f")})
    assert [r.id for r in ledgers.read("cache_entries").collect()] == ["a"] and ledgers.read("feedback_events").count() == 1
    assert before.count() == 2  # a reader that began earlier still sees what it began with
    ledgers.append("cache_entries", rows("c"))
    ledgers.replace({"cache_entries": ledgers.read("cache_entries")})
    assert sorted(r.id for r in ledgers.read("cache_entries").collect()) == ["a", "c"]


def test_names_of_the_package():
    assert all(hasattr(promptloom, name) for name in promptloom.__all__)
