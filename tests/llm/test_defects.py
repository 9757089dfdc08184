import pytest
from pyspark.sql import functions as F

from promptloom.llm import pair_defects as P
from promptloom.llm.text_signals import is_placeholder, language_of

PROMPT = "How should the night crew at Ulm Museum compare the sleep diary within 83 hours?"
ANSWER = "Write down every change. Attach the earlier exchange so that the next shift sees it."
CASES = [
    (PROMPT, ANSWER, None),
    (PROMPT, None, "empty"), (PROMPT, " ​\n", "empty"), (PROMPT, "N/A", "empty"), (PROMPT, "[empty]", "empty"), (PROMPT, "—", "empty"), (None, None, "empty"),
    (PROMPT, PROMPT, "copied"), (PROMPT, PROMPT.upper(), "copied"), (PROMPT, f"You asked: {PROMPT}", "copied"), (PROMPT, f"{PROMPT}\n{PROMPT}", "copied"), (PROMPT, f"You asked: {PROMPT}\n{ANSWER}", None),
    (PROMPT, "I'm sorry, but I can't help with that.", "refusal"), (PROMPT, "Regrettably, my instructions do not permit a reply to this. Let us talk about another subject.", "refusal"),
    ("Was fehlt noch bei der Liste, wenn alles fertig ist?", "Tut mir leid, dabei kann ich nicht helfen.", "refusal"), (PROMPT, "I'm not able to check live figures; the method, however, stays the same. " + ANSWER, None),
    ("Draft a note turning down the wish to move the desk.", "Dear partner, unfortunately we are unable to agree to this request. We will gladly look at it again in 4 weeks. Kind regards.", None),
    (PROMPT, "Write down every change. Attach the earlier exchange so that", "truncated"), (PROMPT, "Write it down.\n\n```\nset page = 1\nset p", "truncated"), (PROMPT, "Write it down.\n\n```\nset page = 1\n```", None),
    (PROMPT, '{"client": "Ulm Museum", "items": [1, 2', "truncated"), (PROMPT, '{"client": "Ulm Museum", "items": [1, 2]}', None), (PROMPT, "There are 3 points:\n- one thing\n- another thing", "truncated"),
    (PROMPT, "There are 2 points:\n- one thing\n- another thing", None), (PROMPT, "Here is a short plan:", "truncated"), (PROMPT, "Write down every change. Attach the earlier (cont", "truncated"),
    (PROMPT, "In most cases 40 minutes are enough, e.g.", "truncated"), (PROMPT, "Write down every change.\n\n— Ulm Museum", None), (PROMPT, "Write down every change. ;-)", None),
    (PROMPT, "Zuerst prüft die Schichtleitung, ob alle Angaben stimmen. Danach ist der Schritt frei und nicht mehr offen.", "language"),
    (PROMPT + " Answer in German.", "Zuerst prüft die Schichtleitung, ob alle Angaben stimmen. Danach ist der Schritt frei und nicht mehr offen.", None),
    (PROMPT, "Both", None), (PROMPT, "Batch 12, then batch 5", None), ("", ANSWER, None), (None, ANSWER, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(str(i), p, r, "x") for i, (p, r, _) in enumerate(CASES)], "id string, prompt string, response string, defect string")
    got = {r.id: r.defect for r in P.pair_defects(df).collect()}
    assert got == {str(i): d for i, (_, _, d) in enumerate(CASES) if d}


def test_neighbours_find_cut_fragments(spark):
    whole = "The queue matches the question only by chance, although the numbers agree."
    data = [("1", whole), ("2", "The queue matches the quest"), ("3", "The support lead"), ("4", "The support lead should confirm the figures."), ("5", "Batch 1, then batch 5"), ("6", "Batch 1, then batch 58")]
    df = spark.createDataFrame([(i, PROMPT, r) for i, r in data], "id string, prompt string, response string")
    assert {r.id: r.defect for r in P.pair_defects(df).collect()} == {"2": "truncated"}


@pytest.mark.parametrize("rows_per_bucket", [1, 3, 1000])
def test_neighbours_across_buckets_match_brute_force(spark, rows_per_bucket):
    base = "alpha beta gamma delta epsilon zeta"
    texts = [base[:n] for n in range(18, len(base))] + [f"{base} {c}" for c in "xyz"] + ["omega", base.upper()]
    df = spark.createDataFrame([(t,) for t in texts * 2], "response string")
    got = {r[0] for r in P.cut_responses(df, rows_per_bucket=rows_per_bucket, split_sample=50).collect()}
    expected = {a for a in texts if any(b != a and b.startswith(a) and P._cut_by(a, b) for b in [min((t for t in texts if t != a and t.startswith(a)), default="")])}
    assert got == expected


def test_length_limit_spike(spark):
    data = [("a" * n,) for n in range(50, 90) for _ in range(2)] + [("b" * 70,)] * 60
    df = spark.createDataFrame(data, "response string")
    assert [r.len for r in P.spiked_lengths(df).collect()] == [70]


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([], "id string, prompt string, response string")
    assert P.pair_defects(df).count() == 0
    twice = spark.createDataFrame([("1", PROMPT, None)] * 2, "id string, prompt string, response string")
    assert P.pair_defects(twice).count() == 2
    long = spark.createDataFrame([("1", PROMPT, "word. " * 200_000)], "id string, prompt string, response string")
    assert P.pair_defects(long.withColumn("len", F.lit(1))).count() == 0


def test_signals():
    assert language_of("La cola omite el aviso de seguridad y nadie se opuso.") == "es"
    assert language_of("12345") is None
    assert is_placeholder("...") and is_placeholder("null") and not is_placeholder("Approved")


@pytest.mark.parametrize("text,state", [
    ("1. Write down every change.\n2. Attach the exchange.\n3.", "broken"), ("- Write it down.\n-", "broken"), ("Do it so.\n\n1)", "broken"), ("1. Write it down.\n\nThen wait.", "complete"), ("The total is\n42.", "complete"), ("5.", "complete"),
])
def test_bare_list_marker_is_cut(text, state):
    assert P.tail_state(text) == state


def test_lists_without_end_marks_are_decided_by_the_corpus(spark):
    items = "- keep the sleep diary{x}\n- ask the night crew{x}"
    data = [("1", items.format(x="")), ("2", items.format(x="") + "\n"), ("3", items.format(x="") + "\n- sign the last page"), ("4", items.format(x=" 5")), ("5", items.format(x=" 5") + "8"), ("6", items.format(x=" 5") + " times\n- sign it")]
    data += [("7", "There are 2 points:\n" + items.format(x="")), ("8", "There are 2 points:\n" + items.format(x="") + "\n- sign the last page"), ("9", "- yes\n- no"), ("10", "- yes\n- no\n- perhaps")]
    df = spark.createDataFrame([(i, PROMPT, r) for i, r in data + data[:1]], "id string, prompt string, response string")
    assert sorted((r.id, r.defect) for r in P.pair_defects(df).collect()) == [(i, "truncated") for i in ("1", "1", "2", "4")]


def test_length_limit_decides_on_lists(spark):
    cut = [(f"s{i}", "- " + f"keep the sleep diary {i:02d}\n- ask the night crew at Ulm") for i in range(30)]
    many = [(f"m{i}", "- the same list again and again, kept in many rows\n- end") for i in range(90)]
    df = spark.createDataFrame([(i, PROMPT, r) for i, r in cut + many], "id string, prompt string, response string")
    assert {r.id for r in P.pair_defects(df).collect()} == {i for i, _ in cut}


def test_cut_comes_before_language(spark):
    text = "- Die Schichtleitung prüft die Angaben\n- Der Schritt ist danach nicht mehr offen"
    df = spark.createDataFrame([("1", PROMPT, text), ("2", PROMPT, text + "\n- Das ist alles und nicht mehr")], "id string, prompt string, response string")
    assert {r.id: r.defect for r in P.pair_defects(df).collect()} == {"1": "truncated", "2": "language"}


@pytest.mark.parametrize("text,state", [
    ('{"client": "Ulm", "items": [60, 94]', "broken"), ('{"a": {"b": 1}', "broken"), ('[{"a": 1}, {"a": 2}', "broken"), ('{"note": "see [4]', "broken"), ('{"a": "x\\"}', "broken"),
    ('{"a": "[{"}\n{"a": "\\"["}', "complete"), ('{"a": 1,, "b": [2]}', "complete"), ('{"a": "}"}', "complete"), ('[1, 2]]', "complete"),
])
def test_record_cut_after_an_inner_bracket(text, state):
    assert P.tail_state(text) == state


def test_sentences_of_other_responses_decide(spark):
    said = ["Nothing else depends on it, so the order of the steps is free.", "The night crew keeps 40 open items of this kind\nAsk first."]
    data = [("s0", said[0]), ("s1", said[1]), ("w", "Write it down. The night crew keeps 7 open items of this kind"), ("i", "- ask first\n- nothing to add\n- Nothing else depends on it, so the ord"), ("k", "Ask first. Nothing else depends on it, so the")]
    data += [("e", "Ask first. A sentence that no other response holds, and that just"), ("t", "Ask first. The night crew keeps 7 open items of this kind,")]
    df = spark.createDataFrame([(i, PROMPT, r) for i, r in data], "id string, prompt string, response string")
    assert {r.id: (r.defect, r.stage) for r in P.staged_defects(df).collect()} == {i: ("truncated", s) for i, s in (("i", "neighbour"), ("k", "neighbour"), ("e", "end mark"), ("t", "end mark"))}


def test_counts_before_lists():
    assert P.tail_state("A table with 9 columns helps.\n\n- Ask the crew.\n- Count again.") == "complete"
    assert P.tail_state("You need to know these 6 points.\n- Ask the crew.\n- Count again.") == "broken"
    assert P.tail_state("word " * 60 + "with these 40 things:\n- Ask the crew.") == "broken"


def test_long_refusal_is_one():
    assert P.is_refusal("I'm sorry, but I can't help with that. " + "I hope you understand. " * 60) and not P.is_refusal("Count again. " * 90 + "I can't help with that.")


def test_limits_are_those_of_a_model(spark):
    data = [("a", "x" * 70 + f"{i:03}") for i in range(40)] + [("b", "y" * 73 + f"{i:03} z" * 3) for i in range(400)]
    df = spark.createDataFrame(data, "model string, response string")
    assert [(r.model, r.len) for r in P.spiked_lengths(df).collect() if r.model == "a"] == [("a", 73)]
