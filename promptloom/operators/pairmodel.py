"""Training and use of the small pair network: numpy on a bounded sample, scoring in Arrow batches."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptloom.functions import vectors as V
from promptloom.operators import metrics as M
from promptloom.runtime import materialize


@dataclass(frozen=True)
class TrainSettings:
    epochs: int = 5
    batch_size: int = 32
    learning_rate: float = 1e-3
    weight_decay: float = 0.01
    dropout: float = 0.1
    hidden: tuple[int, ...] = (128, 64)
    seed: int = 7
    #: Labelled rows the driver fits on at most, taken by hash; every row is scored.
    max_rows: int = 100_000

    def __post_init__(self) -> None:
        if self.epochs < 1 or self.batch_size < 1 or self.learning_rate <= 0 or not 0 <= self.dropout < 1 or self.max_rows < 1:
            raise ValueError("epochs, batch_size, max_rows >= 1, learning_rate > 0 and 0 <= dropout < 1 are needed")


@dataclass
class PairModel:
    """Layers, decision threshold and what is known of the training."""

    layers: list[tuple[np.ndarray, np.ndarray]]
    threshold: float
    dim: int
    card: dict

    def score(self, df: DataFrame, a: str, b: str, name: str = "classifier_score") -> DataFrame:
        return V.network_score(a, b, self.layers, df, name)

    def save(self, spark: SparkSession, folder: str) -> None:
        """One row per layer as Parquet, and a JSON card beside it."""
        rows = [(i, w.shape[0], w.shape[1], [float(x) for x in w.ravel()], [float(x) for x in c]) for i, (w, c) in enumerate(self.layers)]
        spark.createDataFrame(rows, "layer int, inputs int, outputs int, weights array<double>, bias array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/layers")
        write_text(spark, f"{folder}/card.json", json.dumps({"threshold": self.threshold, "dim": self.dim, **self.card}, sort_keys=True))

    @classmethod
    def load(cls, spark: SparkSession, folder: str, threshold: float | None = None) -> PairModel:
        rows = spark.read.parquet(f"{folder}/layers").orderBy("layer").collect()
        card = json.loads(read_text(spark, f"{folder}/card.json"))
        layers = [(np.array(r.weights).reshape(r.inputs, r.outputs), np.array(r.bias)) for r in rows]
        return cls(layers, card.pop("threshold") if threshold is None else threshold, card.pop("dim"), card)


def write_text(spark: SparkSession, folder: str, text: str) -> None:
    """A short text where Spark writes, so that it lies beside the tables on any file system."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)


def read_text(spark: SparkSession, folder: str) -> str:
    return spark.read.text(folder, wholetext=True).first().value.rstrip("\n")


def embedded(pairs: DataFrame, embed, a: str = "prompt_a", b: str = "prompt_b") -> DataFrame:
    """Pairs with ``vec_a`` and ``vec_b``; ``embed`` maps a text column to a vector column."""
    return pairs.withColumns({"vec_a": embed(F.col(a)), "vec_b": embed(F.col(b))})


def train(pairs: DataFrame, *, dim: int, threshold: float = 0.5, settings: TrainSettings = TrainSettings()) -> PairModel:
    """Fit on rows ``(vec_a, vec_b, label)``: weighted cross entropy, mini-batches, decoupled weight decay.

    Rows beyond ``max_rows`` are left out by hash. Without any usable labelled row a ValueError is raised.
    """
    usable = pairs.where("label in (0, 1)").where(V.usable(F.col("vec_a"), dim) & V.usable(F.col("vec_b"), dim)).select("vec_a", "vec_b", "label")
    total = usable.count()
    if not total:
        raise ValueError("there are no usable labelled pairs")
    if total > settings.max_rows:
        usable = usable.where(F.pmod(F.xxhash64("vec_a", "vec_b", F.lit(settings.seed)), F.lit(1_000_000)) < int(1_000_000 * settings.max_rows / total))
    table = usable.toPandas()
    x, y = V.unit_rows(table["vec_a"]), V.unit_rows(table["vec_b"])
    features = np.concatenate([x, y, np.abs(x - y), x * y], axis=1)
    labels = table["label"].to_numpy(dtype=np.float64)
    order = np.lexsort((*features[:, :3].T, labels))
    features, labels = features[order], labels[order]
    positive = labels.sum()
    weights = np.where(labels == 1, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive))) if 0 < positive < len(labels) else np.ones(len(labels))
    rng = np.random.default_rng(settings.seed)
    sizes = [features.shape[1], *settings.hidden, 1]
    layers = [[rng.uniform(-1, 1, (i, o)) * math.sqrt(1.0 / i), np.zeros(o)] for i, o in zip(sizes, sizes[1:])]
    moments = [[np.zeros_like(p) for p in (w, w, c, c)] for w, c in layers]
    step, losses = 0, []
    for _ in range(settings.epochs):
        shuffled = rng.permutation(len(labels))
        batch_losses = []
        for low in range(0, len(labels), settings.batch_size):
            rows = shuffled[low : low + settings.batch_size]
            step += 1
            batch_losses.append(_step(layers, moments, features[rows], labels[rows], weights[rows], settings, rng, step))
        losses.append(float(np.mean(batch_losses)))
    card = {"rows": int(len(labels)), "positives": int(positive), "losses": losses, "settings": asdict(settings)}
    return PairModel([(w, c) for w, c in layers], threshold, dim, card)


def _step(layers, moments, x, y, weight, settings: TrainSettings, rng, step: int) -> float:
    inputs, masks, h = [], [], x
    for depth, (w, c) in enumerate(layers):
        inputs.append(h)
        h = h @ w + c
        if depth + 1 < len(layers):
            mask = (h > 0) / (1 - settings.dropout) * (rng.random(h.shape) >= settings.dropout)
            h = h * mask
            masks.append(mask)
    logit = h[:, 0]
    p = 1 / (1 + np.exp(-np.clip(logit, -60, 60)))
    loss = float(np.mean(weight * (np.logaddexp(0, logit) - y * logit)))
    grad = ((p - y) * weight / len(y))[:, None]
    for depth in range(len(layers) - 1, -1, -1):
        w, c = layers[depth]
        gw, gc = inputs[depth].T @ grad, grad.sum(axis=0)
        grad = grad @ w.T
        if depth:
            grad = grad * masks[depth - 1]
        m = moments[depth]
        for slot, param, g in ((0, w, gw), (2, c, gc)):
            m[slot] = 0.9 * m[slot] + 0.1 * g
            m[slot + 1] = 0.999 * m[slot + 1] + 0.001 * g * g
            scaled = (m[slot] / (1 - 0.9**step)) / (np.sqrt(m[slot + 1] / (1 - 0.999**step)) + 1e-8)
            param -= settings.learning_rate * (scaled + settings.weight_decay * param)
    return loss


def evaluate(model: PairModel, pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Confusion counts, rates, AUC and calibration error of a model on labelled pairs with vectors."""
    keys = group or ["all"]
    rated = model.score(pairs, "vec_a", "vec_b", "score").withColumn("all", F.lit("all"))
    scored = materialize(rated.select(*keys, "label", "score"))
    base = M.binary_metrics(scored, keys, threshold=model.threshold)
    return base.join(M.roc_auc(scored, keys).select(*keys, "auc"), keys, "left").join(M.calibration_error(scored, keys).select(*keys, "ece"), keys, "left")


@dataclass(frozen=True)
class RetrainSettings:
    threshold: float = 0.5
    least_precision: float = 0.8
    least_recall: float = 0.5
    train: TrainSettings = TrainSettings()

    def __post_init__(self) -> None:
        if not all(0 <= v <= 1 for v in (self.threshold, self.least_precision, self.least_recall)):
            raise ValueError("threshold and gates lie between 0 and 1")


def retrain(train_pairs: DataFrame, held_out: DataFrame, *, dim: int, folder: str, settings: RetrainSettings = RetrainSettings()) -> dict:
    """Train, evaluate, and promote the model to ``folder/current`` if it passes both gates; the report is returned and kept."""
    spark = train_pairs.sparkSession
    model = train(train_pairs, dim=dim, threshold=settings.threshold, settings=settings.train)
    row = evaluate(model, held_out).first()
    measured = row.asDict() if row else {"precision": 0.0, "recall": 0.0}
    passed = measured["precision"] >= settings.least_precision and measured["recall"] >= settings.least_recall
    model.save(spark, f"{folder}/candidate")
    if passed:
        model.save(spark, f"{folder}/current")
    report = {"promoted": bool(passed), "metrics": {k: v for k, v in measured.items() if v is None or isinstance(v, (int, float))}, "training": model.card}
    write_text(spark, f"{folder}/report.json", json.dumps(report, sort_keys=True))
    return report
