from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from promptloom.llm import format_duplicates as D
from promptloom.llm.canon import digest, format_free_key

SAME = [
    ("Can you move it, within 3.5 hours?", "« can  you — MOVE it within 3.5 hours »"), ('{"ask": "move it", "ref": "12"}', "REF : 12;\nAsk: move  it;"), ("ask: a; to: b; from: c", "from: c\n\nto: b\n\nask: a."),
    ("Name: Ann, City: Ulm", "City: Ulm; name: ANN"), ("Name: Ann | City: Ulm", "City: Ulm | Name: Ann"), ("Name = Ann\tCity 2 = Ulm", "city 2: Ulm, name: Ann"), ("a very long name of a field with many words: x\nb: y", "b: y / a very long name of a field with many words: x"),
    ("« Straße »", "STRASSE"), ("a​b", "ab"), ("frage: Was: jetzt?; kunde: x", '{"kunde": "x", "frage": "Was: jetzt?"}'), ("", " 　…"),
]
OTHER = [("within 3.5 hours", "within 35 hours"), ("within 3,5 hours", "within 3.5 hours"), ("from: a; to: b", "from: b; to: a"), ("name: Ann, city: Ulm", "name: Ulm, city: Ann"), ("at 10:30, at 11:40", "at 11:40, at 10:30"), ("room 12 3", "room 123"), ("move it", "move them"), ("café", "cafe"), ("a + b", "a b")]


@pytest.mark.parametrize("a,b", SAME)
def test_formatting_does_not_matter(a, b):
    assert format_free_key(a) == format_free_key(b)


@pytest.mark.parametrize("a,b", OTHER)
def test_content_does(a, b):
    assert format_free_key(a) != format_free_key(b)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["move", "it", "Now", "7", "2.5", "é"]), min_size=1, max_size=6), st.sampled_from([" ", "\n", "  ", "　", " - ", ", "]))
def test_separators_do_not_matter(words, separator):
    assert format_free_key(" ".join(words)) == format_free_key(separator.join(w.upper() for w in words) + "!")


@pytest.mark.parametrize("share", [0.1, 0.9])
def test_groups_and_copies_with_and_without_hot_keys(spark, rows, share):
    data = [(f"{i:04}", text, "x") for i, text in enumerate(["Same text!", "same  TEXT", "other", None, "same text"] * 40 + ["alone"])]
    df = spark.createDataFrame(data, "id string, prompt string, kept_id string")
    keys: dict = {}
    for i, text, _ in data:
        if text is not None:
            keys.setdefault(format_free_key(text), []).append(i)
    groups = sorted((min(v), len(v)) for v in keys.values())
    assert rows(D.format_groups(df, hot_share=share)) == groups
    assert rows(D.format_copies(df, hot_share=share)) == sorted((min(v), i) for v in keys.values() for i in v if i != min(v))


def test_nothing_in_nothing_out(spark):
    df = spark.createDataFrame([], "id string, prompt string")
    assert D.format_groups(df).count() == 0 and D.format_copies(df).count() == 0


def test_digest_is_spread():
    assert max(Counter(digest(str(i))[0] % 16 for i in range(1600)).values()) < 160
