import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.functions import vectors as V
from promptloom.operators import decision as D
from promptloom.operators import knn as K
from promptloom.operators import ledger as L
from promptloom.operators import metrics as M
from promptloom.operators import pairs as P

T0 = datetime(2025, 1, 1, tzinfo=timezone.utc)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_exact_topk_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[5] = x[4]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [float("nan")] * 8)]
    df = spark.createDataFrame(data, "id long, vec array<float>")
    queries = df.where("id % 20 = 0 or id > 800").select(F.col("id").alias("query_id"), "vec")
    got = {(r.query_id, r.rank): r.entry_id for r in K.exact_topk(df.select(F.col("id").alias("entry_id"), "vec"), queries, dim=8, k=4, query_block=5, entry_block=16).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    expected = {}
    for q in range(0, 300, 20):
        s = np.round(unit @ unit[q], 6)
        for rank, e in enumerate(sorted(range(300), key=lambda i: (-s[i], i))[:4], 1):
            expected[(q, rank)] = e
    assert got == expected


def test_topk_of_nothing(spark):
    empty = spark.createDataFrame([], "entry_id long, vec array<float>")
    some = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<float>")
    found = K.exact_topk(empty, some, dim=2)
    assert found.count() == 0
    assert K.baseline_decision(found, some, threshold=0.5).first().reason == "no_candidates_found"
    assert K.exact_topk(some.withColumnRenamed("query_id", "entry_id"), empty.withColumnRenamed("entry_id", "query_id"), dim=2).count() == 0


def test_domain_of_nearest_centroid(spark):
    anchors = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [-1.0, 0.0]), ("b", None)], "domain string, vec array<float>")
    centroids = {r.domain: r.centroid for r in K.domain_centroids(anchors, dim=2).collect()}
    assert centroids["a"] == pytest.approx([math.sqrt(0.5)] * 2) and centroids["b"] == [-1.0, 0.0]
    vectors = spark.createDataFrame([(1, [2.0, 2.0]), (2, [-1.0, 0.1]), (3, [0.0, -1.0])], "i int, vec array<float>")
    found = {r.i: r.domain for r in K.detect_domain(vectors, sorted(centroids.items()), threshold=0.5).collect()}
    assert found == {1: "a", 2: "b", 3: "general"}


LADDER = D.LadderSettings(default_tier="high")


@pytest.mark.parametrize(
    "mlp,cross,cached,reason",
    [
        (0.95, None, "reset it", "failed_mlp_threshold"), (0.996, None, "reset it", "mlp_bypass"), (0.991, 0.90, "reset it", "failed_cross_encoder_threshold"), (0.991, 0.97, "reset it", "passed_all_thresholds"),
        (0.991, None, "reset it", "passed_mlp_threshold_no_cross_encoder"), (0.991, 0.97, "reset 20mg", "passed_all_thresholds"), (0.5, 0.5, None, "no_candidates_found"), (None, 0.9, "reset it", "failed_mlp_threshold"),
    ],
)
def test_ladder(spark, mlp, cross, cached, reason):
    df = spark.createDataFrame([("reset it", cached, "x", mlp, cross)], "query_prompt string, cached_prompt string, domain string, classifier_score double, cross_encoder_score double")
    row = D.decide(df, LADDER).first()
    assert row.reason == reason and row.decision == ("hit" if "passed" in reason or "bypass" in reason else "miss")


def test_ladder_vetoes_and_domain_thresholds(spark):
    schema = "query_prompt string, cached_prompt string, domain string, classifier_score double, cross_encoder_score double"
    df = spark.createDataFrame([("approve it", "deny it", "x", 0.999, 0.99), ("report of march", "report of april", "x", 0.991, 0.99), ("same", "same", "d", 0.93, 0.82)], schema)
    settings = D.LadderSettings(default_tier="high", domain_thresholds={"d": {"mlp": 0.92, "cross_encoder": 0.81}})
    assert [r.reason for r in D.decide(df, settings).collect()] == ["opposite_action_detected", "entity_change_detected:month", "passed_all_thresholds"]
    assert D.active_learning(D.decide(df, settings)).count() == 1
    with pytest.raises(ValueError):
        D.LadderSettings(default_tier="none")


def test_best_candidate_keeps_rank_on_ties(spark):
    df = spark.createDataFrame([("q", 1, "a", 0.5), ("q", 2, "b", 0.9), ("q", 3, "c", 0.9), ("r", 1, "d", None)], "query_id string, rank int, entry string, classifier_score double")
    assert {r.query_id: r.entry for r in D.best_candidates(df).collect()} == {"q": "b", "r": "d"}


@pytest.fixture(scope="module")
def ledgers(spark):
    entries = spark.createDataFrame([("e1", "p1", at(0), 0), ("e2", "p2", at(10), 0), ("e3", "p3", at(20), 0)], "id string, prompt string, created_at timestamp, hit_count long")
    lookups = spark.createDataFrame(
        [("q1", "d", " hi ", "e1", 0.9, at(100)), ("q1", "d", " hi ", "e1", 0.9, at(100)), ("q2", "d", "hi", "e1", 0.9, at(130)), ("q3", "d", "hi", "e2", 0.9, at(161)), ("q4", "e", "hi", "e2", 0.9, at(162))],
        "query_id string, domain string, query_prompt string, cache_entry_id string, similarity_score double, created_at timestamp",
    )
    feedback = spark.createDataFrame([("f1", "q1", "e1", 0, None, at(200)), ("f1", "q1", "e1", 0, None, at(200)), ("f2", "q4", "e2", 1, "ok", at(210)), ("f3", "zz", "e9", 1, None, at(211))], "id string, query_id string, cache_entry_id string, label int, reason string, created_at timestamp")
    return entries, lookups, feedback


def test_counters_count_each_delivery_once(ledgers, rows):
    assert rows(L.entry_counters(*ledgers), "id", "hit_count", "negative", "positive") == [("e1", 2, 1, 0), ("e2", 2, 0, 1), ("e3", 0, 0, 0)]


def test_reissue_window_is_inclusive(ledgers, rows):
    assert rows(L.reissued_lookups(ledgers[1], window_seconds=30)) == [("q2", "q1", 30.0)]
    assert rows(L.reissued_lookups(ledgers[1], window_seconds=31)) == [("q2", "q1", 30.0), ("q3", "q2", 31.0)]
    assert L.reissued_lookups(ledgers[1].limit(0), window_seconds=31).count() == 0


def test_reissue_across_stretches_matches_plain_order(spark, rows):
    data = [(f"q{i:03}", "d", "p", at(i * 37 % 4000)) for i in range(200)]
    df = spark.createDataFrame(data, "query_id string, domain string, query_prompt string, created_at timestamp")
    ordered = sorted(data, key=lambda r: (r[3], r[0]))
    expected = sorted((b[0], a[0], (b[3] - a[3]).total_seconds()) for a, b in zip(ordered, ordered[1:]) if (b[3] - a[3]).total_seconds() <= 5)
    assert rows(L.reissued_lookups(df, window_seconds=5)) == expected


def test_unflagged_hits_are_the_newest_without_feedback(ledgers, rows):
    assert rows(L.unflagged_hits(ledgers[1], ledgers[2], as_of=at(162), window_seconds=60)) == [("d", "hi", "q3")]
    assert rows(L.unflagged_hits(ledgers[1], ledgers[2], as_of=at(140), window_seconds=60)) == [("d", "hi", "q2")]


def test_feedback_pairs_need_lookup_and_entry(ledgers, rows):
    entries, lookups, feedback = ledgers
    assert rows(L.feedback_pairs(feedback, lookups, entries), "feedback_event_id", "prompt_a", "prompt_b", "label") == [("f1", " hi ", "p1", 0), ("f2", "hi", "p2", 1)]
    assert L.accepted_feedback(feedback, lookups).select("id").distinct().count() == 2


def test_eviction_order_and_cascade(ledgers, rows):
    entries, lookups, feedback = ledgers
    counters = L.entry_counters(*ledgers)
    assert rows(L.lru_victims(entries, counters, max_entries=2)) == [("e1",)]
    assert rows(L.lru_victims(entries, counters, max_entries=1)) == [("e1",), ("e3",)]
    assert L.lru_victims(entries, counters, max_entries=5).count() == 0
    assert rows(L.expired(entries, as_of=at(30), ttl_seconds=20)) == [("e1",)]
    assert rows(L.hybrid_victims(entries, counters, as_of=at(30), ttl_seconds=20, max_entries=1)) == [("e1", "ttl"), ("e3", "lru")]
    kept, left = L.cascade_delete(L.expired(entries, as_of=at(30), ttl_seconds=20), lookups, feedback)
    assert rows(kept, "query_id") == [("q3",), ("q4",)] and rows(left, "id") == [("f2",), ("f3",)]


def test_first_in_order_matches_a_sort(spark):
    data = [(i, (i * 7) % 5, (i * 13) % 101) for i in range(500)]
    df = spark.createDataFrame(data, "i int, c int, f int")
    for n in (0, 1, 99, 100, 101, 499, 500, 700):
        got = sorted(r.i for r in L.first_in_order(df, n, ["c", "f", "i"], slices=4, few=9).collect())
        assert got == sorted(r[0] for r in sorted(data, key=lambda r: (r[1], r[2], r[0]))[:n])


def test_metrics_of_four_rows(spark):
    df = spark.createDataFrame([("g", 1, 0.9), ("g", 1, 0.1), ("g", 0, 0.8), ("g", 0, 0.2), ("g", None, 0.5), ("g", 1, None), ("h", 1, 0.5)], "g string, label int, score double")
    m = {r.g: r for r in M.binary_metrics(df, ["g"], threshold=0.5).collect()}["g"]
    assert (m.tp, m.fp, m.tn, m.fn, m.precision, m.recall, m.f1, m.accuracy) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    auc = {r.g: r.auc for r in M.roc_auc(df, ["g"]).collect()}
    assert auc == {"g": 0.5, "h": None}
    assert M.calibration_error(df, ["g"]).count() == 2
    assert M.binary_metrics(df.limit(0), ["g"], threshold=0.5).count() == 0


def test_sweep_and_grid_match_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [("a" if i % 3 else None, int(rng.random() < 0.5), float(np.round(rng.random(), 2)), float(np.round(rng.random(), 2))) for i in range(300)]
    df = spark.createDataFrame(data, "g string, label int, classifier_score double, cross_encoder_score double")
    sweep = M.threshold_sweep(df.withColumn("score", F.col("classifier_score")), ["g"]).collect()
    assert len(sweep) == 202
    for r in sweep:
        mine = [d for d in data if d[0] == r.g]
        assert r.tp == sum(d[1] == 1 and d[2] >= r.threshold - 1e-9 for d in mine) and r.fn == sum(d[1] == 1 and d[2] < r.threshold - 1e-9 for d in mine)
    best = {r.g: r for r in M.grid_search(df, ["g"], first=(0.1, 0.1, 8), second=(0.2, 0.2, 3), fpr_limits={"a": 0.3}, limit_key="g").collect()}
    for g in ("a", None):
        mine, found = [d for d in data if d[0] == g], []
        for i in range(8):
            for j in range(3):
                t1, t2 = 0.1 + 0.1 * i, 0.2 + 0.2 * j
                hit = [d[2] >= t1 - 1e-9 and d[3] >= t2 - 1e-9 for d in mine]
                tp, fp = sum(h and d[1] == 1 for h, d in zip(hit, mine)), sum(h and d[1] == 0 for h, d in zip(hit, mine))
                p, r = tp / (tp + fp) if tp + fp else 1.0, tp / max(1, sum(d[1] for d in mine))
                fpr = fp / max(1, sum(1 - d[1] for d in mine))
                if g is None or round(fpr, 6) < 0.3:
                    found.append((-round(2 * p * r / (p + r) if p + r else 0.0, 6), -round(p, 6), round(fpr, 6), i, j))
        chosen = min(found)
        assert (best[g].classifier_threshold, best[g].cross_threshold) == (pytest.approx(0.1 + 0.1 * chosen[3]), pytest.approx(0.2 + 0.2 * chosen[4]))


def test_pairs_and_splits(spark, rows):
    raw = spark.createDataFrame([("a", "b", 1, None), (" ", "b", 1, "test"), ("a", "b", 3, "test")], "prompt_a string, prompt_b string, label int, split string")
    good, bad = P.checked_pairs(raw)
    assert rows(good, "split") == [("train",)] and rows(bad, "problem") == [("blank prompt_a",), ("label not 0 or 1",)]
    variants = spark.createDataFrame([("c", 1, "x"), ("c", 2, "y"), ("c", 3, "z"), ("d", 1, "w")], "concept string, position int, text string")
    assert rows(P.concept_pairs(variants), "prompt_a", "prompt_b") == [("x", "y"), ("x", "z"), ("y", "z")]
    renders = spark.createDataFrame([("t", s, i, f"{s}{i}") for s in "ab" for i in range(20)] + [("u", "a", 1, "only")], "template string, side string, position int, text string")
    assert P.template_pairs(renders, cap=10).count() == 10
    texts = spark.createDataFrame([(str(i % 4), f"t{i}") for i in range(40)], "concept string, text string")
    assert all(r.prompt_a < r.prompt_b for r in P.unrelated_pairs(texts, rows_per_bucket=2).collect())
    assert rows(P.both_orders(good.select("prompt_a", "prompt_b", "label"))) == [("a", "b", 1), ("b", "a", 1)]
    split = P.stratified_split(spark.createDataFrame([("s", i) for i in range(10)] + [("t", 1), (None, 2)], "s string, k int"), "s", "k", share=0.85)
    assert rows(split.groupBy("s", "part").count()) == [("s", "train", 8), ("s", "validation", 2), ("t", "train", 1), (None, "train", 1)]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.normalized(F.col("a")), V.pair_features(F.col("a"), F.col("b"))).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8]) and got[1][0] == [0.0, 0.0]
    assert got[0][1] == [3.0, 4.0, 4.0, 3.0, 1.0, 1.0, 12.0, 12.0]
    text = spark.createDataFrame([("Refund my invoice, please.",), (None,)], "t string")
    assert [r[0] for r in text.select(V.support_embedding(F.col("t"))).collect()] == [[1.0, 1.0, 0, 0, 0, 0, 0, 2.0], [0.0] * 8]
    import hashlib

    expected = [0.0] * 8
    for word in ("refund", "my"):
        h = hashlib.sha256(word.encode()).digest()
        expected[int.from_bytes(h[:4], "big") % 8] += 1.0 if h[4] % 2 == 0 else -1.0
    assert spark.createDataFrame([("Refund my",)], "t string").select(V.hash_embedding(F.col("t"), 8)).first()[0] == expected
