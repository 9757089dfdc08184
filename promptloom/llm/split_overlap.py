"""Problem 4: evaluation records that also occur, exactly or almost, in the training split.

Records are hashed in a canonical form: case, punctuation and white space gone, words without content
dropped and slips inside words undone. Candidates for slips are found corpus-wide: words within two letters of one in
far more different records, by a join on deletion variants without comparing all words. Such a word is a slip only if
each record that holds it, once corrected, is another record of the corpus, so it has no use of its own; or if it is
next to nothing beside the other. Rare words have no such evidence; records that differ in nothing else are compared
word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from promptloom.llm.canon import digest, words
from promptloom.runtime import materialize, salted_join

# Articles and courtesies, which do not make another record.
EMPTY_WORDS = {
    "a", "an", "the", "please", "kindly", "hello", "hi", "hey", "dear", "thanks", "thank", "cheers", "just", "pls", "der", "die", "das", "den", "dem", "ein", "eine", "einen", "einem", "einer", "bitte", "danke", "hallo", "mal",
    "le", "la", "les", "un", "une", "merci", "bonjour", "svp", "stp", "el", "los", "las", "una", "unos", "unas", "gracias", "hola",
}
# Courtesies of several words.
EMPTY_PHRASES = [("thank", "you", "very", "much"), ("thank", "you"), ("for", "me"), ("many", "thanks"), ("if", "you", "please"), ("s", "il", "vous", "plaît"), ("s", "il", "te", "plaît"), ("por", "favor"), ("vielen", "dank")]
#: Words of courtesies, which are never slips; the longest wording of a record need not hold them all.
COURTESY_WORDS = EMPTY_WORDS.union(*EMPTY_PHRASES)
#: In how many times as many different records a word must be as one that is taken for a slip of it.
SLIP_RATIO = 8
#: A word in this many times fewer records than another within two letters is a slip of it wherever it stands.
SURE_RATIO = 1000
#: Words with more letters are looked up by thirds, one of which two slips leave alone, not by what deletions leave.
LONG_WORD = 16
#: Largest number of corrections that is broadcast; more are joined by a shuffle.
BROADCAST_CORRECTIONS = 500_000
_PHRASES_BY_HEAD: dict[str, list[tuple[str, ...]]] = {}
for _p in EMPTY_PHRASES:
    _PHRASES_BY_HEAD.setdefault(_p[0], []).append(_p)


def content_words(tokens: list[str]) -> list[str]:
    """Tokens without articles and courtesies; if nothing else is there, the tokens themselves."""
    out: list[str] = []
    i = 0
    while i < len(tokens):
        phrase = next((p for p in _PHRASES_BY_HEAD.get(tokens[i], ()) if tuple(tokens[i : i + len(p)]) == p), None)
        if phrase:
            i += len(phrase)
            continue
        if tokens[i] not in EMPTY_WORDS:
            out.append(tokens[i])
        i += 1
    return out or tokens


def slip_limit(length: int) -> int:
    return 0 if length < 3 else 1 if length <= 4 else 2


def within_slips(a: str, b: str, limit: int) -> int | None:
    """Letters inserted, dropped, changed or swapped with their neighbour between two words, if at most ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return None
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before2[j - 2] + 1)
            row.append(cost)
        if min(row) > limit:
            return None
        before2, before = before, row
    return before[-1] if before[-1] <= limit else None


def _thirds(word: str) -> set[str]:
    """Keys of a long word: beginning, end and stretches around its middle; words within two letters share one."""
    out = set()
    for step in {(len(word) + d) // 6 for d in (-2, 0, 2)}:
        part = 2 * step - 2
        out |= {f"{step}<{word[:part]}", f"{step}>{word[-part:]}"}
        out |= {f"{step}={word[at : at + part]}" for at in range(part, min(len(word) - part, 2 * part + 10) + 1)}
    return out


def deletion_variants(word: str) -> set[str]:
    """The word with up to ``slip_limit`` letters left out, or the thirds of a long one; words within the limit share a variant."""
    if len(word) > LONG_WORD:
        return _thirds(word)
    out = {word}
    for k in range(1, slip_limit(len(word)) + 1):
        for drop in combinations(range(len(word)), k):
            out.add("".join(c for i, c in enumerate(word) if i not in drop))
    return out


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a = [words(t or "") for t in batch.column(1).to_pylist()]
        b = [words(t or "") for t in batch.column(2).to_pylist()]
        kind = pa.list_(pa.string())
        high, low = _digests(["\u001e".join(sorted(" ".join(content_words(s)) for s in sides)) for sides in zip(a, b)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, kind), pa.array(b, kind), high, low], ["row_id", "a", "b", "c1", "c2"])


def _digests(keys: list[str | None]) -> tuple[pa.Array, pa.Array]:
    both = [(None, None) if k is None else digest(k) for k in keys]
    return pa.array([x[0] for x in both], pa.int64()), pa.array([x[1] for x in both], pa.int64())


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = [(v, t, n) for t, n in zip(tokens, counts) for v in deletion_variants(t)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["variant", "word", "n"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        d = [within_slips(x, y, min(slip_limit(len(x)), slip_limit(len(y)))) for x, y in zip(a, b)]
        keep = [i for i, x in enumerate(d) if x is not None]
        yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in range(4)] + [pa.array([d[i] for i in keep], pa.int32())], ["word", "better", "n", "m", "d"])


def slip_corrections(tokens: DataFrame, *, ratio: int = SLIP_RATIO) -> DataFrame:
    """``(word, better)`` for each word of the column ``token`` that may be a slip of a far more frequent one.

    Closest word first, then the more frequent, then the smaller. Words with digits and those of courtesies are never
    corrected, nor are words that others are corrected to.
    """
    return _corrections(materialize(word_counts(tokens)), ratio).select("word", "better")


def word_counts(tokens: DataFrame) -> DataFrame:
    """``(token, n)`` for words of three letters or more; others are never taken for slips."""
    return tokens.where(F.col("token").rlike(r"^[\p{L}\p{M}]{3,}$")).groupBy("token").agg(F.count("*").alias("n"))


def _corrections(counts: DataFrame, ratio: int) -> DataFrame:
    top = counts.agg(F.max("n")).first()[0] or 0
    schema = "variant string, word string, n long"
    rare = counts.where((F.col("n") * ratio <= top) & ~F.col("token").isin(sorted(COURTESY_WORDS))).mapInArrow(_variants, schema)
    known = counts.where(F.col("n") >= ratio).mapInArrow(_variants, schema).select("variant", F.col("word").alias("better"), F.col("n").alias("m"))
    near = salted_join(rare, known, ["variant"]).where(F.col("m") >= F.col("n") * ratio).select("word", "better", "n", "m").distinct()
    judged = near.mapInArrow(_distances, "word string, better string, n long, m long, d int")
    best = W.Window.partitionBy("word").orderBy("d", F.desc("m"), "better")
    chosen = materialize(judged.withColumn("r", F.row_number().over(best)).where("r = 1").select("word", "better", "n", "m"))
    return chosen.join(chosen.select(F.col("better").alias("word")).distinct(), "word", "left_anti")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = [batch.column(1).to_pylist(), batch.column(2).to_pylist()]
        marks = batch.column(3).to_pylist()
        keys, frames, words_left, seen = [], [], [], []
        for a, b, marked in zip(*sides, marks):
            rare: dict[str, int] = {}
            for m in marked or ():
                if m["better"] is None:
                    rare[m["token"]] = m["n"]
                else:
                    (a if m["side"] == 0 else b)[m["pos"]] = m["better"]
            content = [content_words(s) for s in (a, b)]
            keys.append("\u001e".join(sorted(" ".join(s) for s in content)))
            framed = sorted((" ".join("\u001f" if w in rare else w for w in s), [w for w in s if w in rare]) for s in content)
            left = [w for _, found in framed for w in found]
            frames.append("\u001e".join(f for f, _ in framed) + ("\u001d" if framed[0][0] == framed[1][0] else "") if left else None)
            words_left.append(left or None)
            seen.append([rare[w] for w in left] or None)
        yield pa.RecordBatch.from_arrays([batch.column(0), *_digests(keys), *_digests(frames), pa.array(words_left, pa.list_(pa.string())), pa.array(seen, pa.list_(pa.int64())), pa.array([f is not None and f.endswith("\u001d") for f in frames])], ["row_id", "k1", "k2", "f1", "f2", "rare", "seen", "even"])


def record_keys(pairs: DataFrame, *, id_col: str, a_col: str, b_col: str, ratio: int = SLIP_RATIO) -> DataFrame:
    """``(row_id, k1, k2, ...)``: equal keys mean the same record up to formatting, slips, courtesies and sides.

    ``f1, f2`` are the key without the words of fewer than ``ratio`` records, which are in ``rare`` with their
    numbers of records in ``seen``; ``even`` says that both sides have the same frame. All null without such words.
    """
    base = pairs.select(F.col(id_col).alias("row_id"), F.col(a_col).cast("string").alias("a"), F.col(b_col).cast("string").alias("b")).where("a is not null and b is not null")
    id_type = base.schema["row_id"].dataType.simpleString()
    split = materialize(base.mapInArrow(_tokenised, f"row_id {id_type}, a array<string>, b array<string>, c1 long, c2 long"))
    # Copies count once; of their wordings the longest stands for them, as it has the most courtesies.
    records = split.groupBy("c1", "c2").agg(F.max(F.struct((F.size("a") + F.size("b")).alias("size"), "a", "b")).alias("r"))
    counts = materialize(word_counts(records.select(F.explode(F.array_distinct(F.concat("r.a", "r.b"))).alias("token"))))
    fixes = _corrections(counts, ratio).withColumnRenamed("word", "token").select("token", "better", "m")
    schema = f"row_id {id_type}, k1 long, k2 long, f1 long, f2 long, rare array<string>, seen array<long>, even boolean"
    found = materialize(_marked(split, counts.join(fixes, "token", "left").where((F.col("n") < ratio) | F.col("better").isNotNull())))
    judged = salted_join(found, _own_use(split, found.where("better is not null"), schema), ["token"], how="left")
    slip = F.col("own").isNull() | (F.col("n") * SURE_RATIO <= F.col("m"))
    settled = judged.withColumn("better", F.when(slip, F.col("better"))).where((F.col("n") < ratio) | F.col("better").isNotNull())
    marked = materialize(_per_row(split, settled))
    clear = marked.where("marked is null").select("row_id", F.col("c1").alias("k1"), F.col("c2").alias("k2"), *[F.lit(None).cast(t).alias(c) for c, t in (("f1", "long"), ("f2", "long"), ("rare", "array<string>"), ("seen", "array<long>"))], F.lit(False).alias("even"))
    return clear.unionByName(_hashed_rows(marked.where("marked is not null"), schema))


def _marked(split: DataFrame, marks: DataFrame) -> DataFrame:
    """``(row_id, side, pos, token, n, better, m)``: where the words of ``marks(token, n, better, m)`` stand in the records."""
    placed = split.select("row_id", F.lit(0).alias("side"), F.posexplode("a").alias("pos", "token")).unionByName(split.select("row_id", F.lit(1).alias("side"), F.posexplode("b").alias("pos", "token")))
    marks = materialize(marks)
    return placed.join(F.broadcast(marks), "token") if marks.count() <= BROADCAST_CORRECTIONS else salted_join(placed, marks, ["token"])


def _per_row(split: DataFrame, found: DataFrame, how: str = "left") -> DataFrame:
    """Records with the words marked in them; sides are kept only where there are any."""
    per_row = found.groupBy("row_id").agg(F.collect_list(F.struct("side", "pos", "token", "n", "better")).alias("marked"))
    side = lambda c: F.when(F.col("marked").isNotNull(), F.col(c)).alias(c)
    return split.join(per_row, "row_id", how).select("row_id", "c1", "c2", side("a"), side("b"), "marked")


def _hashed_rows(marked: DataFrame, schema: str) -> DataFrame:
    return marked.select("row_id", "a", "b", "marked").mapInArrow(_hashed, schema)


def _own_use(split: DataFrame, found: DataFrame, schema: str) -> DataFrame:
    """``(token, own)``: words in a record that, with all slips undone, is no other record without the word.

    A record without slips is what it is: its key in canonical form.
    """
    key = ["k1", "k2"]
    touched = _per_row(split, found, "inner")
    corrected = materialize(touched.select("row_id", "c1", "c2").join(_hashed_rows(touched, schema).select("row_id", *key), "row_id"))
    holders = corrected.join(found.select("row_id", "token").distinct(), "row_id").select(*key, "c1", "c2", "token").distinct().groupBy(*key, "token").agg(F.count("*").alias("holding"))
    wanted = corrected.select(*key).distinct()
    clean = split.join(corrected.select("row_id"), "row_id", "left_anti").select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "c1", "c2").join(wanted, key, "left_semi")
    records = corrected.select(*key, "c1", "c2").unionByName(clean).distinct().groupBy(*key).agg(F.count("*").alias("records"))
    return holders.join(records, key).where("holding >= records").select("token").distinct().withColumn("own", F.lit(True))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records under the deletion variants of their first rare word; with even sides also in the other order."""
    for batch in batches:
        rows, at, orders = batch.to_pylist(), [], []
        variants = []
        for i, row in enumerate(rows):
            rare, seen = row["rare"], row["seen"]
            half = len(rare) // 2
            for j in range(2 if row["even"] else 1):
                order = (rare, seen) if j == 0 else (rare[half:] + rare[:half], seen[half:] + seen[:half])
                for v in deletion_variants(order[0][0]):
                    at.append(i)
                    variants.append(v)
                    orders.append(order)
        taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(4)]
        yield pa.RecordBatch.from_arrays([*taken, pa.array(variants, pa.string()), pa.array([o[0] for o in orders], pa.list_(pa.string())), pa.array([o[1] for o in orders], pa.list_(pa.int64()))], ["k1", "k2", "f1", "f2", "variant", "rare", "seen"])


def same_words(a: list[str], n: list[int], b: list[str], m: list[int]) -> bool:
    """Each pair of rare words is equal or a slip; of two words within a slip, one is in no other record."""
    return len(a) == len(b) and all(x == y or (min(i, j) <= 1 and within_slips(x, y, min(slip_limit(len(x)), slip_limit(len(y)))) is not None) for x, i, y, j in zip(a, n, b, m))


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, n, b, m = (batch.column(i).to_pylist() for i in range(4, 8))
        keep = pa.array([i for i, x in enumerate(zip(a, n, b, m)) if same_words(*x)], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in range(4)], ["k1", "k2", "o1", "o2"])


def same_records(keys: DataFrame) -> DataFrame:
    """``(k1, k2, o1, o2)``, in both directions: records with different keys that differ in slips of rare words only."""
    parts = ["k1", "k2", "f1", "f2", "rare", "seen", "even"]
    records = keys.where("rare is not null").groupBy("k1", "k2").agg(F.min(F.struct(*parts[2:])).alias("r")).select("k1", "k2", "r.*")
    shared = records.groupBy("f1", "f2").agg(F.count("*").alias("_n")).where("_n > 1").select("f1", "f2")
    entries = records.join(shared, ["f1", "f2"]).select(*parts).mapInArrow(_entries, "k1 long, k2 long, f1 long, f2 long, variant string, rare array<string>, seen array<long>")
    entries = materialize(entries)
    other = entries.select("f1", "f2", "variant", F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("rare").alias("rare_o"), F.col("seen").alias("seen_o"))
    near = entries.join(other, ["f1", "f2", "variant"]).where("k1 <> o1 or k2 <> o2")
    return near.select("k1", "k2", "o1", "o2", "rare", "seen", "rare_o", "seen_o").mapInArrow(_same, "k1 long, k2 long, o1 long, o2 long").distinct()


def clean_split(split: Column) -> Column:
    """Lower case without outer white space; null is ``train``."""
    return F.coalesce(F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", "")), F.lit("train"))


def split_overlaps(pairs: DataFrame, *, id_col: str = "pair_id", a_col: str = "prompt_a", b_col: str = "prompt_b", split_col: str = "split", ratio: int = SLIP_RATIO) -> DataFrame:
    """Pairs of ids of one training and one evaluation record that are the same: ``(train_id, eval_id, eval_split)``.

    A record with a null prompt matches nothing. Rows of a split other than train, validation and test are on
    neither side. All matches come out, also between many copies; a record that holds a large share of the rows
    is joined in salted parts. Empty input gives no rows, and further columns are ignored.
    """
    keys = materialize(record_keys(pairs, id_col=id_col, a_col=a_col, b_col=b_col, ratio=ratio))
    splits = pairs.select(F.col(id_col).alias("row_id"), clean_split(F.col(split_col)).alias("_split"))
    tagged = materialize(keys.join(splits, "row_id"))
    train = tagged.where("_split = 'train'").select("k1", "k2", F.col("row_id").alias("train_id"))
    held = tagged.where("_split in ('validation', 'test')").select("k1", "k2", F.col("row_id").alias("eval_id"), F.col("_split").alias("eval_split"))
    linked = salted_join(held, same_records(tagged), ["k1", "k2"]).select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), "eval_id", "eval_split")
    held = held.unionByName(linked)
    return salted_join(train, held, ["k1", "k2"]).select("train_id", "eval_id", "eval_split")


def overlap_report(pairs: DataFrame, *, id_col: str = "pair_id", a_col: str = "prompt_a", b_col: str = "prompt_b", split_col: str = "split", source_col: str = "source", ratio: int = SLIP_RATIO) -> DataFrame:
    """``(split, source, rows, overlapping, matches)`` of the evaluation splits; a null source is its own group.

    Counts come from keys grouped by split and source, so copies are never multiplied out.
    """
    keys = record_keys(pairs, id_col=id_col, a_col=a_col, b_col=b_col, ratio=ratio)
    info = pairs.select(F.col(id_col).alias("row_id"), clean_split(F.col(split_col)).alias("split"), F.col(source_col).alias("source"))
    tagged = materialize(info.join(keys, "row_id", "left"))
    train = tagged.where("split = 'train' and k1 is not null").groupBy("k1", "k2").agg(F.count("*").alias("in_train"))
    held = tagged.where("split in ('validation', 'test')").groupBy("split", "source", "k1", "k2").agg(F.count("*").alias("n"))
    linked = train.join(same_records(tagged), ["k1", "k2"]).select(F.col("o1").alias("k1"), F.col("o2").alias("k2"), "in_train")
    train = train.unionByName(linked).groupBy("k1", "k2").agg(F.sum("in_train").alias("in_train"))
    joined = held.join(train, ["k1", "k2"], "left")
    return joined.groupBy("split", "source").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("in_train").isNotNull(), F.col("n")).otherwise(0)).alias("overlapping"), F.sum(F.col("n") * F.coalesce("in_train", F.lit(0))).alias("matches")
    )
