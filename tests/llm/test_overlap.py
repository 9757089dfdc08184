import random

import pytest

from promptloom.llm import split_overlap as S
from promptloom.llm.canon import words

BASE = "Tell me whether Harskailde Railways ought to prolong the temporary vendor payment without touching batch {n}."
OTHER = "How should the support lead at Harskailde Railways review the temporary vendor payment for case {n}?"


def make(spark, extra):
    """Enough ordinary records for the words to be known, and the given ones."""
    data = [(1000 + i, BASE.format(n=i + 100), OTHER.format(n=i + 100), "train", "s") for i in range(40)]
    return spark.createDataFrame(data + extra, "pair_id long, prompt_a string, prompt_b string, split string, source string")


def test_overlaps(spark, rows):
    a, b = BASE.format(n=805), OTHER.format(n=805)
    extra = [
        (1, a, b, None, "x"), (2, b.upper(), a, " Test", "x"), (3, "Please, " + a.replace("whether", "whteher").replace("the temporary", "tempoary"), b + " Thanks", "VALIDATION ", "y"),
        (4, a.replace("805", "806"), b, "test", "y"), (5, a.replace("prolong", "review"), b, "test", "y"), (6, a, None, "test", "y"), (7, a, b, "other", "y"), (8, a, b, "train", None),
    ]
    found = rows(S.split_overlaps(make(spark, extra)))
    assert found == sorted([(1, 2, "test"), (1, 3, "validation"), (8, 2, "test"), (8, 3, "validation")], key=lambda r: tuple((x is None, str(x)) for x in r))
    report = {(r.split, r.source): (r.rows, r.overlapping, r.matches) for r in S.overlap_report(make(spark, extra)).collect()}
    assert report == {("test", "x"): (1, 1, 2), ("validation", "y"): (1, 1, 2), ("test", "y"): (3, 0, 0)}


def test_empty(spark):
    df = spark.createDataFrame([], "pair_id long, prompt_a string, prompt_b string, split string, source string")
    assert S.split_overlaps(df).count() == 0 and S.overlap_report(df).count() == 0


@pytest.mark.parametrize("a,b,d", [("whether", "whteher", 1), ("pament", "payment", 1), ("abc", "abc", 0), ("renew", "review", 2), ("lower", "slower", 1), ("august", "october", None)])
def test_distance_and_shared_variants(a, b, d):
    assert S.within_slips(a, b, 2) == d
    if d is not None and len(a) > 4 and len(b) > 4:
        assert S.deletion_variants(a) & S.deletion_variants(b)


def test_words_without_content():
    assert S.content_words(words("Hello, please move the desk for me. Thank you very much!")) == ["move", "desk"]
    assert S.content_words(["the"]) == ["the"] and S.content_words([]) == []


def test_frequent_words_are_not_corrected(spark, rows):
    df = spark.createDataFrame([("glabriara",)] * 40 + [("glabriana",)] * 50 + [("glabriara1",)] + [("shuold",)] + [("should",)] * 30, "token string")
    assert rows(S.slip_corrections(df)) == [("shuold", "should")]


def _both(spark, rows, df):
    found = rows(S.split_overlaps(df), "train_id", "eval_id")
    report = S.overlap_report(df).collect()
    assert sum(r.matches for r in report) == len(found)
    return found


def test_slip_in_a_hot_record(spark, rows):
    a, b = BASE.format(n=805), OTHER.format(n=805)
    hot = [(i, ("Please, " if i % 2 else "") + a.replace("whether", "whteher"), b, "train", "x") for i in range(30)]
    assert _both(spark, rows, make(spark, [*hot, (900, a, b, "test", "x")])) == sorted(((i, 900) for i in range(30)), key=lambda r: (str(r[0]), str(r[1])))


def test_words_of_two_records_only(spark, rows):
    a, b = BASE.format(n=805), OTHER.format(n=805)
    named = lambda x, y: (a.replace("Harskailde", x), b.replace("Harskailde", y))
    extra = [(1, *named("Quombrelt", "Quombrelt"), "train", "x"), (2, *named("Quombrlet", "Quombrelt"), "test", "x"), (3, *reversed(named("Quomrelt", "Quombret")), "validation", "x"), (4, *named("Trevanik", "Trevanik"), "test", "x")]
    assert _both(spark, rows, make(spark, extra)) == [(1, 2), (1, 3)]
    same = [(1, "Vexalor keeps it", "Vexalor keeps it", "train", "x"), (2, "Vexalor keeps it", "Vexlaor keeps it", "test", "x"), (3, "Vexaolr keeps it", "Vexalor keeps it", "test", "x")]
    assert _both(spark, rows, make(spark, same)) == [(1, 2), (1, 3)]


def test_copies_do_not_make_a_word_a_slip(spark, rows):
    names = [(i, BASE.format(n=i).replace("Harskailde", name), OTHER.format(n=i), "other", "x") for name, ids in (("Glabriara", range(300, 303)), ("Glabriana", range(310, 313))) for i in ids]
    a, b = BASE.format(n=805), OTHER.format(n=805)
    hot = [(400 + i, a.replace("Harskailde", "Glabriana"), b, "train", "x") for i in range(40)]
    assert _both(spark, rows, make(spark, [*names, *hot, (900, a.replace("Harskailde", "Glabriara"), b, "test", "x")])) == []


def test_courtesies_are_not_corrected(spark, rows):
    df = spark.createDataFrame([("hello",)] + [("yellow",)] * 40 + [("shuold",)] + [("should",)] * 30, "token string")
    assert rows(S.slip_corrections(df)) == [("shuold", "should")]


def test_a_word_with_slips_of_its_own_is_none(spark, rows):
    df = spark.createDataFrame([("spirnt",)] + [("sprint",)] * 10 + [("split",)] * 100, "token string")
    assert rows(S.slip_corrections(df)) == [("spirnt", "sprint")]


@pytest.mark.parametrize("few,many,n,m", [("contract", "contact", 9, 80), ("renew", "review", 10, 100), ("ulmer", "ulmen", 5, 50)])
def test_words_with_a_use_of_their_own_are_kept_apart(spark, rows, few, many, n, m):
    text = "file the {w} of the {c} crew in room {i}"
    crews = ["night", "search", "billing", "support", "garden"]
    data = [(i, text.format(w=many, c=crews[i % 5], i=i), "x y", "train", "s") for i in range(m)]
    data += [(500 + i, text.format(w=few, c=crews[i % 5], i=i if i == 0 else 700 + i), "x y", "test", "s") for i in range(n)]
    df = spark.createDataFrame(data + [(900, text.format(w=many[:-2] + many[-1] + many[-2], c="night", i=5), "x y", "test", "s")], "pair_id long, prompt_a string, prompt_b string, split string, source string")
    assert _both(spark, rows, df) == [(5, 900)]


def test_long_words_and_unspaced_scripts(spark, rows):
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(17, 60)))
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[], ["z"], [b[at], "z"]])
        if len(b) > S.LONG_WORD:
            assert S.deletion_variants(a) & S.deletion_variants("".join(b))
    assert len(S.deletion_variants("x" * 400)) < 1000
    assert words("東京の天気 is ok") == ["東", "京", "の", "天", "気", "is", "ok"]
    df = spark.createDataFrame([(1, "東京の天気は晴れです", "x y", "train", "s"), (2, "大阪の天気は晴れです", "x y", "test", "s"), (3, "東京の天気は、晴れです。", "x y", "test", "s")], "pair_id long, prompt_a string, prompt_b string, split string, source string")
    assert _both(spark, rows, df) == [(1, 3)]
