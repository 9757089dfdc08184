"""A prompt cache over ledgers: lookups in batches, feedback, statistics, exports and eviction."""

from __future__ import annotations

import asyncio
import inspect
import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptloom.functions import text as X
from promptloom.functions import vectors as V
from promptloom.functions.text import strip_space
from promptloom.operators import decision as D
from promptloom.operators import ledger as L
from promptloom.operators.knn import detect_domain, exact_topk
from promptloom.runtime import materialize
from promptloom.sources.ledger_io import Ledgers
from promptloom.sources.pairs_io import write_pairs

log = logging.getLogger(__name__)


class PromptCacheError(Exception):
    """Base of the errors of this package."""


class MissingDependencyError(PromptCacheError):
    """Something that is only needed for a chosen option is not installed."""


class StoreError(PromptCacheError):
    """The ledgers cannot be read or written, or the cache is closed."""


class ModelCallError(PromptCacheError):
    """The outside model failed for good; ``attempts`` tells how often it was tried."""

    def __init__(self, message: str, attempts: int) -> None:
        super().__init__(message)
        self.attempts = attempts


@dataclass(frozen=True)
class RetrySettings:
    attempts: int = 1
    first_delay: float = 0.5
    factor: float = 2.0
    longest_delay: float = 30.0
    #: Errors that are worth another attempt; any other ends the call at once.
    retry_on: tuple[type[BaseException], ...] = (Exception,)

    def __post_init__(self) -> None:
        if self.attempts < 1 or self.first_delay < 0 or self.factor < 1 or self.longest_delay < self.first_delay or not self.retry_on:
            raise ValueError("attempts >= 1, factor >= 1, 0 <= first_delay <= longest_delay and some errors to retry on are needed")

    def delay(self, attempt: int) -> float:
        """Seconds to wait after the given failed attempt, counted from 1."""
        return min(self.longest_delay, self.first_delay * self.factor ** (attempt - 1))


@dataclass(frozen=True)
class CacheSettings:
    dim: int = 64
    candidates: int = 5
    cosine_threshold: float = 0.9
    max_entries: int = 10_000
    eviction: str = "lru"
    ttl_seconds: float | None = None
    implicit_window_seconds: float | None = None
    ladder: D.LadderSettings = field(default_factory=D.LadderSettings)
    retry: RetrySettings = RetrySettings()
    #: Rates per thousand tokens ``(model, input, output)`` and those of any other model.
    rates: tuple[tuple[str, str, str], ...] = ()
    default_rate: tuple[str, str] = ("0", "0")
    domain_confidence: float = 0.5

    def __post_init__(self) -> None:
        if (self.ttl_seconds is not None and self.ttl_seconds <= 0) or (self.implicit_window_seconds is not None and self.implicit_window_seconds <= 0) or not 0 <= self.domain_confidence <= 1:
            raise ValueError("times are positive and the confidence lies between 0 and 1")
        if self.dim < 1 or self.candidates < 1 or self.max_entries < 1 or not -1 <= self.cosine_threshold <= 1 or self.eviction not in ("lru", "ttl", "hybrid"):
            raise ValueError("invalid cache settings")


def call_with_retry(model: Callable, prompt: str, retry: RetrySettings, sleep: Callable[[float], None]) -> str:
    """The reply of a plain or an async model; failures of the named kinds are tried again with growing pauses, and a reply that is no text is an error."""
    for attempt in range(1, retry.attempts + 1):
        try:
            reply = model(prompt)
            if inspect.isawaitable(reply):
                reply = asyncio.run(_awaited(reply))
        except retry.retry_on as error:
            if attempt == retry.attempts:
                raise ModelCallError(str(error), attempt) from error
            sleep(retry.delay(attempt))
            continue
        if not isinstance(reply, str):
            raise TypeError("a model must return text")
        return reply
    raise ModelCallError("no attempt allowed", 0)


async def _awaited(reply):
    return await reply


def _with_column(df: DataFrame, name: str, kind: T.DataType, fill: Callable[[pd.DataFrame], object]) -> DataFrame:
    """``df`` with a column computed in batches by ``fill``."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])

    def filled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[name] = fill(batch)
            yield batch[schema.names]

    return df.mapInPandas(filled, schema)


class PromptCache:
    """Batch cache of one domain. All state lies in the ledgers, so any number of sessions can read it.

    ``embed`` makes a vector column of a text column, or has ``embed_batch(texts)``. ``model`` is a pair classifier: it
    has ``score(df, a, b, name)`` like the pair network, or ``predict_batch(pairs of vectors)``. ``cross_encoder`` gives a
    list of scores for a list of pairs of prompts; it is asked about candidates only that have passed the classifier.
    ``centroids`` are vectors of domains: with them every prompt is decided by the rules of its own domain.
    A cache can be used in a ``with`` statement, and cannot be used once closed.
    """

    def __init__(
        self, spark: SparkSession, folder: str, domain: str, *, settings: CacheSettings = CacheSettings(), embed=None, model=None,
        cross_encoder: Callable[[list[tuple[str, str]]], list[float]] | None = None, centroids: list[tuple[str, list[float]]] | None = None,
    ) -> None:
        self.spark, self.domain, self.settings, self.pair_model, self.cross_encoder, self.centroids = spark, domain, settings, model, cross_encoder, centroids
        self.ledgers = Ledgers(spark, folder)
        self.embed = embed or (lambda text: V.hash_embedding(text, settings.dim))
        self.asked = self.hits = 0
        self.cost_saved = Decimal(0)
        self.closed = False

    def __enter__(self) -> PromptCache:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """No further calls; the ledgers are whole at any time, so nothing has to be written."""
        self.closed = True

    def _open(self) -> None:
        if self.closed:
            raise StoreError("the cache is closed")

    def _now(self, as_of: datetime | None) -> Column:
        return F.lit(as_of or datetime.now(timezone.utc)).cast("timestamp")

    def _embedded(self, asked: DataFrame) -> DataFrame:
        if not hasattr(self.embed, "embed_batch"):
            return asked.withColumn("vec", self.embed(F.col("prompt")).cast("array<float>"))
        provider = self.embed
        return _with_column(asked, "vec", T.ArrayType(T.FloatType()), lambda batch: [[float(x) for x in v] for v in provider.embed_batch(batch["prompt"].tolist())])

    def _classified(self, paired: DataFrame) -> DataFrame:
        model = self.pair_model
        if hasattr(model, "score"):
            return model.score(paired, "vec", "prompt_embedding")
        return _with_column(paired, "classifier_score", T.DoubleType(), lambda batch: [float(x) for x in model.predict_batch(list(zip(batch["vec"], batch["prompt_embedding"])))])

    def _cross_scored(self, pairs: DataFrame) -> DataFrame:
        """The cross-encoder's score of the candidates that have passed the classifier and are not let through by it."""
        if self.cross_encoder is None:
            return pairs.withColumn("cross_encoder_score", F.lit(None).cast("double"))
        ladder, score = self.settings.ladder, self.cross_encoder
        gate, _ = D.thresholds(F.col("domain"), D.risk_tier(F.col("domain"), ladder), ladder)
        open_pair = F.coalesce(F.col("cached_prompt").isNotNull() & (F.col("classifier_score") >= gate), F.lit(False))
        if ladder.bypass is not None:
            open_pair = open_pair & (F.col("classifier_score") < ladder.bypass)

        def scored(batch: pd.DataFrame) -> pd.Series:
            out = pd.Series([None] * len(batch), index=batch.index, dtype="float64")
            wanted = batch["_open"].to_numpy(dtype=bool)
            if wanted.any():
                out[wanted] = [float(x) for x in score(list(zip(batch.loc[wanted, "query_prompt"], batch.loc[wanted, "cached_prompt"])))]
            return out

        return _with_column(pairs.withColumn("_open", open_pair), "cross_encoder_score", T.DoubleType(), scored).drop("_open")

    def lookup(self, queries: DataFrame) -> DataFrame:
        """Decide ``(query_id long, prompt)``: ``(query_id, prompt, entry_id, response, scores, decision, reason, vec)``.

        Candidates are the most similar entries; with a classifier the best of them by its score goes down the
        ladder, without one the cosine decides. The text rules run in the JVM, the models on candidates only.
        """
        self._open()
        s = self.settings
        asked = materialize(self._embedded(queries.select("query_id", strip_space(F.col("prompt")).alias("prompt"))))
        entries = self.ledgers.read("cache_entries")
        near = exact_topk(entries.select(F.col("id").alias("entry_id"), F.col("prompt_embedding").alias("vec")), asked, dim=s.dim, k=s.candidates)
        stored = entries.select(F.col("id").alias("entry_id"), F.col("prompt").alias("cached_prompt"), "response", "prompt_embedding")
        paired = L.salted_join(near, stored, ["entry_id"]).join(asked.select("query_id", "vec", F.col("prompt").alias("query_prompt")), "query_id").withColumnRenamed("score", "similarity_score")
        columns = ["query_id", "rank", "entry_id", "cached_prompt", "response", "similarity_score", "classifier_score"]
        shown = ["query_id", "prompt", "vec", "domain", "entry_id", "cached_prompt", "response", "similarity_score", "classifier_score", "cross_encoder_score", "risk_tier", "decision", "reason"]
        no_score = F.lit(None).cast("double")
        tagged = detect_domain(asked, self.centroids, threshold=s.domain_confidence, fallback=self.domain).drop("domain_score") if self.centroids else asked.withColumn("domain", F.lit(self.domain))
        if self.pair_model is None:
            best = paired.where("rank = 1").withColumn("classifier_score", no_score).select(*columns)
            hit = F.coalesce(F.col("similarity_score") >= s.cosine_threshold, F.lit(False))
            reason = F.when(F.col("entry_id").isNull(), "no_candidates_found").when(hit, "passed_cosine_threshold").otherwise("failed_cosine_threshold")
            plain = tagged.join(best, "query_id", "left").withColumns({"cross_encoder_score": no_score, "risk_tier": D.risk_tier(F.col("domain"), s.ladder), "reason": reason, "decision": F.when(hit, "hit").otherwise("miss")})
            return plain.select(*shown)
        best = D.best_candidates(self._classified(paired).select(*columns))
        whole = tagged.join(best, "query_id", "left").withColumn("query_prompt", F.col("prompt"))
        return D.decide(self._cross_scored(whole), s.ladder).select(*shown)

    def get_or_call(self, queries: DataFrame, model: Callable, *, model_name: str | None = None, metadata: dict | None = None, as_of: datetime | None = None) -> DataFrame:
        """Answer a batch: hits from the cache, misses by the model, whose replies become entries.

        Gives ``(query_id, prompt, response, was_hit, decision, reason, lookup_id, entry_id, scores, cost_saved,
        tokens_saved, implicit_bad_hit, latency_ms)``; the latency is that of the batch, shared by its rows. Equal missed
        prompts are asked once. Misses of one batch do not see each other's entries. Hits are written to the lookup
        ledger, repeats within the window are flagged before that, decisions worth labelling are kept, and eviction
        follows the inserts.
        """
        began = time.perf_counter()
        decided = materialize(self.lookup(queries).withColumn("lookup_id", F.concat_ws("-", F.lit(uuid.uuid4().hex), F.col("query_id"))))
        now, at = self._now(as_of), as_of or datetime.now(timezone.utc)
        hit = F.col("decision") == "hit"
        calls = decided.where(hit).select(
            F.col("lookup_id").alias("query_id"), F.lit(self.domain).alias("domain"), F.col("prompt").alias("query_prompt"), F.col("vec").alias("query_embedding"), F.col("entry_id").alias("cache_entry_id"),
            "similarity_score", "classifier_score", "cross_encoder_score", now.alias("created_at"),
        )
        flagged = self._flag_repeats(decided, at) if self.settings.implicit_window_seconds is not None else None
        self.ledgers.append("lookup_records", calls)
        doubtful = D.active_learning(decided.withColumnRenamed("prompt", "query_prompt"))
        self.ledgers.append("active_learning_pairs", doubtful.withColumns({"id": F.sha2(F.col("lookup_id"), 256), "domain": F.lit(self.domain), "created_at": now}))
        retry = self.settings.retry

        def ask(rows):
            for batch in rows:
                batch["response"] = [call_with_retry(model, p, retry, time.sleep) for p in batch["prompt"]]
                yield pd.DataFrame(batch[["id", "prompt", "vec", "response"]])

        missed = decided.where(~hit).groupBy("prompt").agg(F.first("vec").alias("vec")).withColumn("id", F.sha2(F.concat_ws("\u0001", F.lit(uuid.uuid4().hex), "prompt"), 256))
        replies = materialize(missed.select("id", "prompt", "vec").mapInPandas(ask, "id string, prompt string, vec array<float>, response string"))
        zero = F.lit(0)
        self.ledgers.append("cache_entries", replies.select(
            "id", "prompt", F.col("vec").alias("prompt_embedding"), "response", F.lit(model_name).alias("model"), now.alias("created_at"),
            zero.alias("hit_count"), zero.alias("feedback_negative_count"), zero.alias("feedback_positive_count"), F.lit(json.dumps(metadata or {}, sort_keys=True)).alias("metadata_json"),
        ))
        cost = X.usage_cost(F.col("prompt"), F.col("response"), F.lit(model_name).cast("string"), list(self.settings.rates), self.settings.default_rate)
        saved = decided.withColumns({"cost_saved": F.when(hit, cost).otherwise(F.lit(0)).cast("decimal(28,9)"), "tokens_saved": F.when(hit, X.estimated_tokens(F.col("response"))).otherwise(F.lit(0)).cast("long")})
        totals = saved.agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.sum("cost_saved").alias("cost")).first()
        self.asked, self.hits, self.cost_saved = self.asked + totals.n, self.hits + totals.hits, self.cost_saved + (totals.cost or 0)
        gone = self.evict(as_of=as_of)
        log.debug("batch: %d asked, %d hits, %d evicted", totals.n, totals.hits, gone)
        answered = saved.join(replies.select("prompt", F.col("id").alias("new_id"), F.col("response").alias("new_response")), "prompt", "left")
        if flagged is not None:
            answered = answered.join(flagged.withColumn("implicit_bad_hit", F.lit(True)), "prompt", "left")
        else:
            answered = answered.withColumn("implicit_bad_hit", F.lit(False))
        elapsed = (time.perf_counter() - began) * 1000.0 / max(1, totals.n)
        return answered.select(
            "query_id", "prompt", F.when(hit, F.col("response")).otherwise(F.col("new_response")).alias("response"), hit.alias("was_hit"), "decision", "reason", F.when(hit, F.col("lookup_id")).alias("lookup_id"),
            F.when(hit, F.col("entry_id")).otherwise(F.col("new_id")).alias("entry_id"), "similarity_score", "classifier_score", "cross_encoder_score", "cost_saved", "tokens_saved",
            F.coalesce("implicit_bad_hit", F.lit(False)).alias("implicit_bad_hit"), F.lit(elapsed).alias("latency_ms"),
        )

    def _flag_repeats(self, decided: DataFrame, as_of: datetime) -> DataFrame:
        """Newest unflagged hit of each repeated prompt gets label 0; any later call counts, hit or miss. Gives these prompts."""
        window = float(self.settings.implicit_window_seconds)
        lookups = self.ledgers.lookups()
        open_hits = L.unflagged_hits(lookups, self.ledgers.read("feedback_events"), as_of=as_of, window_seconds=window).where(F.col("domain") == self.domain)
        repeated = materialize(open_hits.join(decided.select("prompt").distinct(), "prompt", "left_semi").join(lookups.select("query_id", "created_at"), "query_id"))
        elapsed = (F.unix_micros(self._now(as_of)) - F.unix_micros("created_at")) / 1e6
        about = F.to_json(F.struct(F.lit(True).alias("auto_detected"), F.lit("re-issue").alias("detector"), elapsed.alias("elapsed_seconds"), F.lit(window).alias("window_seconds")))
        self._record(repeated.select("query_id", F.lit(0).alias("label"), F.lit("implicit:re-issued").alias("reason"), about.alias("metadata_json")), as_of)
        return repeated.select("prompt").distinct()

    def report(self, reports: DataFrame, *, as_of: datetime | None = None) -> int:
        """Record feedback ``(query_id, label, reason)`` on lookups; unknown lookups are left out. Gives how many were recorded."""
        return self._record(reports.select("query_id", "label", "reason", F.lit("{}").alias("metadata_json")), as_of or datetime.now(timezone.utc))

    def report_bad_hit(self, query_id: str, reason: str | None = None, *, as_of: datetime | None = None) -> bool:
        return self.report(self.spark.createDataFrame([(query_id, 0, reason)], "query_id string, label int, reason string"), as_of=as_of) > 0

    def report_good_hit(self, query_id: str, *, as_of: datetime | None = None) -> bool:
        return self.report(self.spark.createDataFrame([(query_id, 1, None)], "query_id string, label int, reason string"), as_of=as_of) > 0

    def _record(self, reports: DataFrame, as_of: datetime) -> int:
        self._open()
        calls = self.ledgers.lookups()
        known = L.accepted_feedback(reports, calls).join(calls.drop("created_at"), "query_id")
        events = materialize(known.withColumns({"id": F.sha2(F.concat_ws("\u0001", F.lit(uuid.uuid4().hex), "query_id", "label"), 256), "created_at": F.lit(as_of).cast("timestamp")}))
        self.ledgers.append("feedback_events", events)
        cached = self.ledgers.read("cache_entries").select(F.col("id").alias("cache_entry_id"), F.col("prompt").alias("cached_prompt"))
        self.ledgers.append("active_learning_pairs", events.where("label = 0").join(cached, "cache_entry_id").withColumn("source", F.lit("user_reported_bad_hit")))
        return events.count()

    def evict(self, *, as_of: datetime | None = None) -> int:
        """Apply the eviction policy; lookups and feedback of evicted entries go with them. Gives how many entries went."""
        self._open()
        s = self.settings
        entries, lookups, feedback = (self.ledgers.read(t) for t in ("cache_entries", "lookup_records", "feedback_events"))
        at = as_of or datetime.now(timezone.utc)
        counters = L.entry_counters(entries, lookups, feedback)
        if s.eviction == "hybrid" and s.ttl_seconds is not None:
            victims = L.hybrid_victims(entries, counters, as_of=at, ttl_seconds=s.ttl_seconds, max_entries=s.max_entries).select("id")
        elif s.eviction == "ttl":
            victims = L.expired(entries, as_of=at, ttl_seconds=s.ttl_seconds) if s.ttl_seconds is not None else entries.select("id").limit(0)
        else:
            victims = L.lru_victims(entries, counters, max_entries=s.max_entries)
        victims = materialize(victims)
        gone = victims.count()
        if gone:
            kept, left = L.cascade_delete(victims, lookups, feedback)
            self.ledgers.replace({"feedback_events": left, "lookup_records": kept, "cache_entries": entries.join(victims, "id", "left_anti")})
        return gone

    def stats(self) -> dict:
        """Totals of the ledgers, and what this object has seen: asked, hits, misses, hit rate and cost saved."""
        entries, lookups, feedback = (self.ledgers.read(t) for t in ("cache_entries", "lookup_records", "feedback_events"))
        seen = {"domain": self.domain, "asked": self.asked, "hits": self.hits, "misses": self.asked - self.hits, "hit_rate": self.hits / self.asked if self.asked else 0.0, "cost_saved": self.cost_saved}
        return L.ledger_stats(entries, lookups, feedback).first().asDict() | seen

    def entries(self) -> DataFrame:
        """All entries with their counters as the ledgers tell them."""
        entries, lookups, feedback = (self.ledgers.read(t) for t in ("cache_entries", "lookup_records", "feedback_events"))
        stored = entries.drop("hit_count", "last_hit_at", "feedback_negative_count", "feedback_positive_count")
        return stored.join(L.entry_counters(entries, lookups, feedback).withColumnsRenamed({"negative": "feedback_negative_count", "positive": "feedback_positive_count"}), "id", "left")

    def export_feedback(self, path: str, *, split: str = "train") -> int:
        pairs = L.feedback_pairs(self.ledgers.read("feedback_events"), self.ledgers.lookups(), self.ledgers.read("cache_entries"), split=split)
        return self._export(pairs, "feedback_created_at", "feedback_event_id", path)

    def export_active_learning(self, path: str, *, split: str = "train") -> int:
        return self._export(L.active_learning_pairs(self.ledgers.read("active_learning_pairs"), split=split), "created_at", "active_learning_id", path)

    @staticmethod
    def _export(pairs: DataFrame, time_col: str, id_col: str, path: str) -> int:
        """Pairs in order of time, with their lineage as metadata."""
        kept = materialize(pairs.orderBy(time_col, id_col))
        write_pairs(kept.orderBy(time_col, id_col).select("prompt_a", "prompt_b", "label", "domain", "source", "split", "metadata"), path)
        return kept.count()
