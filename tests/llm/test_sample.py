import numpy as np
import pytest
from pyspark.sql import functions as F

from promptloom.llm import quota_sample as Q


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, ["Customer Support ", "customer-support", "devops", "legal"][i % 4], int(i % 2), ["s", "t"][i % 3 == 0], "clash") for i in range(600)] + [(1000, None, 1, "s", ""), (1001, "devops", None, "s", ""), (1002, "x", 1, "s", "")]
    gold = spark.createDataFrame(rows, "pair_id long, domain string, label int, source string, key string")
    targets = spark.createDataFrame([("customer-support", 0, "s", 0.5, 5), ("customer-support", 1, "t", 0.2, 5), ("devops", 0, "s", 0.1, 3), ("legal", 1, "s", 0.1, 200), ("legal", 0, "s", 0.1, 1)], "domain string, label int, source string, target_share double, min_rows long")
    return gold, targets


def test_report(data):
    report = {(r.domain, r.label): r for r in Q.quota_report(*data).collect()}
    assert report[("customer-support", 0)].needed == 60 and report[("customer-support", 0)].available == 100
    assert report[("legal", 1)].short and report[("legal", 1)].missing == 100
    assert report[("legal", 0)].available == 0 and report[("legal", 0)].short
    assert sum(r.drawn for r in report.values()) == pytest.approx(120, abs=0.01)


def test_sample_follows_the_plan(data):
    gold, targets = data
    sample = Q.quota_sample(gold, targets).collect()
    assert len({r.pair_id for r in sample}) == len(sample) and abs(len(sample) - 120) <= 1
    plan = {(r.domain, r.label, r.source): r.drawn for r in Q.quota_report(gold, targets).collect()}
    for (domain, label, source), drawn in plan.items():
        got = sum(r.domain.strip().lower().replace(" ", "-") == domain and r.label == label and r.source == source for r in sample)
        assert abs(got - drawn) < 1.01
    again = Q.quota_sample(gold.repartition(3), targets).collect()
    assert sorted(r.pair_id for r in again) == sorted(r.pair_id for r in sample)
    assert sorted(r.pair_id for r in Q.quota_sample(gold, targets, seed=5).collect()) != sorted(r.pair_id for r in sample)


def test_pivotal_method_keeps_probabilities(spark):
    rows = spark.createDataFrame([(i, "a", 0, "s") for i in range(40)], "pair_id long, domain string, label int, source string")
    targets = spark.createDataFrame([("a", 0, "s", 1.0, 0)], "domain string, label int, source string, target_share double, min_rows long")
    counts = np.zeros(40)
    for seed in range(12):
        picked = [r.pair_id for r in Q.quota_sample(rows, targets, fraction=0.25, seed=seed).collect()]
        assert len(picked) == 10
        counts[picked] += 1
    assert counts.max() < 12 and counts.sum() == 120


def test_edges(spark, data):
    gold, targets = data
    assert Q.quota_sample(gold.limit(0), targets).count() == 0
    assert Q.quota_report(gold.limit(0), targets).where("short").count() == 5
    assert Q.quota_report(gold, targets.limit(0)).count() == 0 and Q.quota_sample(gold, targets.limit(0)).count() == 0
    assert Q.quota_sample(gold.where(F.col("pair_id") < 8), targets).count() == 1


def test_newton_meets_the_targets():
    rates, steps = Q.tilt(np.array([100.0, 50.0, 10.0]), np.array([10.0, 40.0, 1.0]))
    assert np.allclose(rates * [100, 50, 10], [10, 40, 1]) and steps < 60
    drawn, _ = Q.plan_counts(np.array([100.0, 5.0, 50.0]), np.array([0.6, 0.3, 0.1]), np.array([0.0, 0.0, 20.0]), 50)
    assert drawn.sum() == pytest.approx(50) and drawn[1] == 5 and drawn[2] >= 20
