import json
import os
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom import cli
from promptloom.api import CacheSettings, ModelCallError, PromptCache, RetrySettings, call_with_retry
from promptloom.functions import vectors as V
from promptloom.operators import ledger as L
from promptloom.operators import pairmodel as PM
from promptloom.schemas import CACHE_ENTRIES, PAIRS, conform
from promptloom.sources import pairs_io
from promptloom.streaming.reissue import reissue_stream
from promptloom.streaming.replay import ReplaySettings, cache_batch, exact_replay

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def ask(spark, *prompts):
    return spark.createDataFrame(list(enumerate(prompts, 1)), "query_id long, prompt string")


def test_miss_then_hit_feedback_and_exports(spark, tmp_path):
    cache = PromptCache(spark, str(tmp_path / "c"), "d", settings=CacheSettings(dim=16, implicit_window_seconds=30))
    first = {r.query_id: r for r in cache.get_or_call(ask(spark, "reset the key", "reset the key ", "open the door"), lambda p: p.upper(), as_of=T0).collect()}
    assert {r.decision for r in first.values()} == {"miss"} and first[1].response == "RESET THE KEY" == first[2].response
    assert cache.stats()["entries"] == 2
    again = cache.get_or_call(ask(spark, "reset the key"), lambda p: "never", as_of=T0 + timedelta(seconds=5)).first()
    assert (again.decision, again.response, again.reason) == ("hit", "RESET THE KEY", "passed_cosine_threshold") and again.lookup_id
    cache.get_or_call(ask(spark, "  reset the key"), lambda p: "never", as_of=T0 + timedelta(seconds=20))
    flagged = cache.ledgers.read("feedback_events").collect()
    assert [(r.query_id, r.label, r.reason) for r in flagged] == [(again.lookup_id, 0, "implicit:re-issued")]
    last = cache.ledgers.lookups().where(F.col("query_id") != again.lookup_id).first().query_id
    reports = spark.createDataFrame([(last, 1, "good"), ("unknown", 1, None), (last, 7, None)], "query_id string, label int, reason string")
    assert cache.report(reports, as_of=T0 + timedelta(seconds=60)) == 1
    assert cache.export_feedback(str(tmp_path / "f")) == 2 and cache.export_active_learning(str(tmp_path / "a")) == 1
    back = pairs_io.read_pairs(spark, str(tmp_path / "f"), split="train")
    assert sorted(r.label for r in back.collect()) == [0, 1]
    assert cli.main(["stats", str(tmp_path / "c")], spark) == 0


def test_eviction_follows_inserts(spark, tmp_path):
    cache = PromptCache(spark, str(tmp_path / "c"), "d", settings=CacheSettings(dim=16, max_entries=2))
    for i, prompt in enumerate(["one thing", "two cats", "three old houses"]):
        cache.get_or_call(ask(spark, prompt), lambda p: p, as_of=T0 + timedelta(seconds=i))
    assert sorted(r.prompt for r in cache.ledgers.read("cache_entries").collect()) == ["three old houses", "two cats"]
    old = PromptCache(spark, str(tmp_path / "t"), "d", settings=CacheSettings(dim=16, eviction="ttl", ttl_seconds=10))
    old.get_or_call(ask(spark, "one thing"), lambda p: p, as_of=T0)
    assert old.evict(as_of=T0 + timedelta(seconds=10)) == 0 and old.evict(as_of=T0 + timedelta(seconds=11)) == 1
    with pytest.raises(ValueError):
        CacheSettings(eviction="random")


def test_retry_waits_longer_each_time():
    pauses, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert call_with_retry(flaky, "p", RetrySettings(attempts=3, first_delay=1, factor=10, longest_delay=5), pauses.append) == "ok" and pauses == [1, 5]
    with pytest.raises(ModelCallError) as error:
        call_with_retry(lambda p: 1 / 0, "p", RetrySettings(attempts=2), lambda s: None)
    assert error.value.attempts == 2
    with pytest.raises(TypeError):
        call_with_retry(lambda p: 5, "p", RetrySettings(), lambda s: None)


def test_pairs_as_json_lines(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    path.write_text('{"prompt_a": "x", "prompt_b": "y", "label": 1, "extra": 3}\n\n{"prompt_a": "x", "prompt_b": "z", "label": 0, "domain": "d", "split": "test"}\n')
    pairs = pairs_io.read_pairs(spark, str(path))
    assert sorted((r.prompt_b, r.label, r.split, r.domain) for r in pairs.collect()) == [("y", 1, "train", None), ("z", 0, "test", "d")]
    assert pairs_io.read_pairs(spark, str(path), domain="d").count() == 1
    pairs_io.write_pairs(pairs, str(tmp_path / "out"))
    lines = [json.loads(line) for f in os.listdir(tmp_path / "out") if f.endswith(".json") for line in open(tmp_path / "out" / f)]
    assert all(list(x) == sorted(x) and "domain" in x for x in lines)
    path.write_text('{"prompt_a": " ", "prompt_b": "y", "label": 1}\n')
    with pytest.raises(ValueError):
        pairs_io.read_pairs(spark, str(path))
    assert pairs_io.read_pairs(spark, str(path), strict=False).count() == 0
    assert conform(spark.createDataFrame([("a",)], "id string"), CACHE_ENTRIES).columns == CACHE_ENTRIES.names


def test_training_finds_a_rule_and_is_kept(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        a = rng.normal(size=4)
        b = a + 0.05 * rng.normal(size=4) if i % 2 else rng.normal(size=4)
        rows.append(([float(x) for x in a], [float(x) for x in b], i % 2))
    df = spark.createDataFrame(rows, "vec_a array<float>, vec_b array<float>, label int")
    settings = PM.TrainSettings(epochs=30, learning_rate=0.01, hidden=(16, 8))
    model = PM.train(df, dim=4, settings=settings)
    row = PM.evaluate(model, df).first()
    assert row.accuracy > 0.9 and row.auc > 0.95 and model.card["losses"][-1] < model.card["losses"][0]
    model.save(spark, str(tmp_path))
    loaded = PM.PairModel.load(spark, str(tmp_path), threshold=0.7)
    assert loaded.threshold == 0.7 and all(np.allclose(a[0], b[0]) for a, b in zip(model.layers, loaded.layers))
    report = PM.retrain(df, df, dim=4, folder=str(tmp_path / "r"), settings=PM.RetrainSettings(train=settings))
    assert report["promoted"] and os.path.exists(tmp_path / "r" / "current" / "card.json")
    strict = PM.retrain(df, df, dim=4, folder=str(tmp_path / "s"), settings=PM.RetrainSettings(least_precision=1.0, least_recall=1.0, train=PM.TrainSettings(epochs=1)))
    assert not strict["promoted"] and not os.path.exists(tmp_path / "s" / "current")
    with pytest.raises(ValueError):
        PM.train(df.limit(0), dim=4)
    with pytest.raises(ValueError):
        PM.TrainSettings(epochs=0)


def test_command_line_trains_and_evaluates(spark, tmp_path, capsys):
    rows = [(f"reset key {i}", f"reset key {i}", 1, None, None, None) for i in range(20)] + [(f"reset key {i}", f"open door {i + 1}", 0, None, None, None) for i in range(20)]
    spark.createDataFrame(rows, PAIRS).coalesce(1).write.json(str(tmp_path / "pairs"))
    assert cli.main(["train-classifier", str(tmp_path / "pairs"), str(tmp_path / "m"), "--dim", "16", "--epochs", "2"], spark) == 0
    assert cli.main(["eval-classifier", str(tmp_path / "m"), str(tmp_path / "pairs"), "--dim", "16", "--threshold", "0.4"], spark) == 0
    out = [json.loads(line) for line in capsys.readouterr().out.strip().split("\n")]
    assert out[0]["rows"] == 40 and out[1]["examples"] == 40


def test_network_matches_plain_numpy(spark):
    layers = [(np.arange(32).reshape(8, 4) / 50.0, np.full(4, 0.1)), (np.array([[1.0], [-1.0], [0.5], [0.2]]), np.array([0.05]))]
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "a array<float>, b array<float>")
    x, y = np.array([0.6, 0.8]), np.array([0.0, 1.0])
    h = np.maximum(np.concatenate([x, y, abs(x - y), x * y]) @ layers[0][0] + 0.1, 0) @ layers[1][0] + 0.05
    assert V.network_score("a", "b", layers, df).first().score == pytest.approx(1 / (1 + np.exp(-h[0])))


def test_stream_agrees_with_batch(spark, tmp_path, rows):
    data = [(f"q{i:02}", "d", f"p{i % 3}", T0 + timedelta(seconds=i * 11 % 97)) for i in range(40)]
    df = spark.createDataFrame(data + data[:5], "query_id string, domain string, query_prompt string, created_at timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = reissue_stream(stream, window_seconds=10, lateness="1 hour").writeStream.format("memory").queryName("reissued").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("reissued")) == rows(L.reissued_lookups(df, window_seconds=10))


def test_replay_inserts_misses(spark):
    vectors = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0]]
    calls = spark.createDataFrame([("x", i, float(i), v) for i, v in enumerate(vectors)], "instance string, seq long, at_seconds double, vec array<float>")
    got = [(r.seq, r.decision, r.source_seq) for r in sorted(exact_replay(calls, ReplaySettings(threshold=0.9)).collect())]
    assert got == [(0, "miss", None), (1, "hit", 0), (2, "miss", None), (3, "hit", 0), (4, "hit", 2)]
    one = [(r.seq, r.decision) for r in sorted(exact_replay(calls, ReplaySettings(threshold=0.9, max_entries=1)).collect())]
    assert one == [(0, "miss"), (1, "hit"), (2, "miss"), (3, "miss"), (4, "miss")]


def test_micro_batch_inserts_each_missed_prompt_once(spark):
    entries = spark.createDataFrame([(1, [1.0, 0.0])], "entry_id long, vec array<float>")
    queries = spark.createDataFrame([(10, "a", [1.0, 0.0]), (11, "b", [0.0, 1.0]), (12, "b", [0.0, 1.0])], "query_id long, prompt string, vec array<float>")
    decided, fresh = cache_batch(entries, queries, dim=2, threshold=0.9)
    assert {r.query_id: r.decision for r in decided.collect()} == {10: "hit", 11: "miss", 12: "miss"}
    assert [(r.entry_id, r.prompt) for r in fresh.collect()] == [(11, "b")]
