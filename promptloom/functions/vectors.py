"""Vector expressions: unit vectors, cosine, text embeddings without a model, pair features and a small network."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Support words and the axis each stands for; all other words share the last axis.
SUPPORT_AXES = {
    "refund": 0, "refunds": 0, "billing": 1, "invoice": 1, "subscription": 2, "cancel": 2, "cancellation": 2, "shipping": 3, "delivery": 3, "account": 4, "login": 4, "escalate": 5, "escalation": 5, "angry": 6, "upset": 6,
}
SUPPORT_DIM = 8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit vector in double precision; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / length))


def usable(v: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` finite values that are not all zero."""
    finite = F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False)) & F.exists(doubles(v), lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hash_embedding(text: Column, dim: int) -> Column:
    """Signed counts of hashed lower-case words: the first four digest bytes give the axis, the fifth the sign."""
    tokens = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda t: F.length(t) > 0)
    digests = F.transform(tokens, lambda t: F.sha2(t, 256))
    axis = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim
    sign = lambda h: F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("long") % 2 == 0, 1.0).otherwise(-1.0)
    parts = F.transform(digests, lambda h: F.struct(axis(h).alias("axis"), sign(h).alias("sign")))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter(parts, lambda p: p["axis"] == i), F.lit(0.0), lambda s, p: s + p["sign"]))


def support_embedding(text: Column) -> Column:
    """Counts of support words on seven axes and of all other words on the eighth."""
    spaced = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[?.]", " ")
    tokens = F.filter(F.split(spaced, r"(?U)\s+"), lambda t: F.length(t) > 0)
    axes = F.create_map(*[x for word, axis in SUPPORT_AXES.items() for x in (F.lit(word), F.lit(axis))])
    found = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(axes, F.regexp_replace(t, r"^[,;:]+|[,;:]+$", "")), F.lit(SUPPORT_DIM - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(SUPPORT_DIM - 1)), lambda i: F.size(F.filter(found, lambda x: x == i)).cast("double"))


def pair_features(a: Column, b: Column) -> Column:
    """Both vectors, their absolute difference and their product, one after the other."""
    return F.concat(doubles(a), doubles(b), F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)), F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def sigmoid(x: Column) -> Column:
    """Logistic function; far values give 0 or 1 instead of an overflow."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def network_score(a: str, b: str, layers: list[tuple[np.ndarray, np.ndarray]], df: DataFrame, name: str = "score") -> DataFrame:
    """Add the probability of a small ReLU network over :func:`pair_features` of unit vectors, in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast([(np.asarray(w, np.float64), np.asarray(c, np.float64)) for w, c in layers])

    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.DoubleType())])
    kept = [f.name for f in schema.fields[:-1]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        for batch in batches:
            out = np.empty(0)
            if batch.num_rows:
                x, y = unit_rows(batch.column(a).to_pylist()), unit_rows(batch.column(b).to_pylist())
                h = np.concatenate([x, y, np.abs(x - y), x * y], axis=1)
                for depth, (w, c) in enumerate(weights):
                    h = h @ w + c
                    if depth + 1 < len(weights):
                        h = np.maximum(h, 0.0)
                out = 1.0 / (1.0 + np.exp(-np.clip(h[:, 0], -700, 700)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.float64())], [*kept, name])

    return df.mapInArrow(score, schema)


def unit_rows(vectors: Sequence) -> np.ndarray:
    rows = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1.0, length)
