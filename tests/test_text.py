import pytest
from pyspark.sql import functions as F

from promptloom.functions import mutate as U
from promptloom.functions import text as X

CHANGES = [
    ("Revenue in Q3 please", "Revenue in Q4 please", "quarter"),
    ("Report of 2023", "Report of 2024", "year"),
    ("the first step", "the second step", "ordinal"),
    ("dose of ibuprofen today", "dose of aspirin today", "drug"),
    ("take 200mg", "take 400mg", "numeric"),
    ("meeting in january", "meeting in march", "month"),
    ("meeting on monday", "meeting on friday", "day"),
    ("yesterday totals", "tomorrow totals", "temporal"),
    ("reset the administrator key", "reset my key", "privilege"),
    ("news of Apple", "news of Microsoft", "proper_noun"),
    ("how do i reset it", "how can i reset it", None),
    ("current totals", "latest totals", None),
    (None, "take 400mg", None),
    ("", "", None),
]


def test_first_detector_decides(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CHANGES)], "i int, a string, b string")
    got = {r.i: (r.c.detector if r.c else None) for r in X.with_entity_change(df, "a", "b", "c").collect()}
    assert got == {i: d for i, (_, _, d) in enumerate(CHANGES)}


def test_detectors_can_be_switched_off(spark):
    df = spark.createDataFrame([("take 200mg in 2023", "take 400mg in 2024")], "a string, b string")
    rules = X.EntityRules(disabled=("year", "numeric"))
    assert X.with_entity_change(df, "a", "b", "c", rules).first().c is None
    assert X.with_entity_change(df, "a", "b", "c", X.EntityRules(enabled=False)).first().c is None
    with pytest.raises(ValueError):
        X.EntityRules(disabled=("nothing",))


def test_change_is_symmetric_and_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(a, b, 1) for a, b, _ in CHANGES], "a string, b string, c int")
    one = [bool(r.c) for r in X.with_entity_change(df, "a", "b", "c").collect()]
    two = [bool(r.c) for r in X.with_entity_change(df, "b", "a", "c").collect()]
    assert one == two


@pytest.mark.parametrize(
    "a,b,opposite",
    [
        ("Approve the loan", "Deny the loan", True), ("Approve the loan", "Approve the loan", False), ("turn on light", "turn off light", True), ("it is required", "it is not required", True),
        ("pay 100 now", "pay 500 now", True), ("take 50mg", "take 70mg", False), (None, "Deny it", False), ("open the door", "close the door and open it", False),
    ],
)
def test_opposite_action(spark, a, b, opposite):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert X.with_opposite_action(df, "a", "b", "o").first().o is opposite


def test_whole_words_do_not_match_inside_others(spark):
    df = spark.createDataFrame([("it is safe, as we know", "it is safe")], "a string, b string")
    assert X.with_opposite_action(df, "a", "b", "o").first().o is True
    assert X.with_opposite_action(df, "a", "b", "o", whole_words=True).first().o is False


def test_small_text_functions(spark):
    df = spark.createDataFrame([("  hi 　",), ("",), (None,), ("x" * 100,)], "t string")
    got = df.select(X.strip_space(F.col("t")), X.estimated_tokens(F.col("t")), X.shortened(F.col("t"), 10)).collect()
    assert [r[0] for r in got] == ["hi", "", None, "x" * 100]
    assert [r[1] for r in got] == [1, 0, 0, 25]
    assert got[3][2] == "x" * 9 + "…"
    lines = spark.createDataFrame([("<think>a\nb</think>- \"one\"\n2) two\n\n",)], "t string").select(X.cleaned_lines(F.col("t"))).first()[0]
    assert lines == ["one", "two"]


def test_cost_takes_the_first_rate_that_fits(spark):
    df = spark.createDataFrame([("a" * 4000, "b" * 8000, "my-large-v2"), ("a" * 4000, "b" * 8000, None), ("", "", "large")], "p string, r string, m string")
    got = [str(r[0]) for r in df.select(X.usage_cost(F.col("p"), F.col("r"), F.col("m"), [("large", "0.005", "0.015")], ("0.001", "0.002"))).collect()]
    assert got == ["0.035000000", "0.005000000", "0E-9"]


@pytest.mark.parametrize(
    "name,text,expected",
    [
        ("synonym", "cancel my order", "terminate my purchase"), ("synonym", "nothing here", "nothing here (global delivery details)"), ("word_order", "a b c d", "a c b d"), ("word_order", "a b", "a b"),
        ("negation", "Can you help", "Can you not help"), ("negation", "Tell me", "Do not Tell me"), ("numeric", "pay 10 and 10", "pay 35 and 35"), ("numeric", "pay", "pay for 10 users instead of 1"),
        ("typo", "refund please now", "reufnd plaese now"), ("typo", "a b", "a b checkk"),
    ],
)
def test_mutations(spark, name, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(U.MUTATIONS[name](F.col("t"))).first()[0] == expected
