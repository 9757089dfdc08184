import base64
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from promptloom.llm import bisection as B
from promptloom.llm import bpe
from promptloom.llm import packing as K
from promptloom.llm.corpus_tokens import count_corpus, decode_corpus, encode_corpus

pytestmark = pytest.mark.skipif(not os.path.isdir(bpe.TOKENIZER_DIR), reason="needs the public vocabularies")
TEXTS = [None, "", " ", "Hello world", "don't  stop\r\n\r\nnow", "<|endoftext|> is text", "日本語のテキスト。次の文。", "naïve café 👩‍👩‍👧 🇩🇪🇫🇷", "a" * 3000, "x​y﻿ z", "12345678 3.14", "\u0085 odd　space"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(os.path.join(bpe.TOKENIZER_DIR, "byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok


def test_same_ids_as_the_library(spark, library):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    encoded = encode_corpus(df.withColumn("ids", F.lit(1)))
    got = {r.doc_id: r.ids for r in encoded.collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == library.encode(text or "", add_special_tokens=False).ids
    assert {r.doc_id: r.text for r in decode_corpus(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in count_corpus(df).collect()} == {i: len(v) for i, v in got.items()}
    assert encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_any_text(library, text):
    text = text.encode("utf-8", "ignore").decode()
    tok = bpe.tokenizer("byte_bpe_50k")
    ids = tok.encode(text)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and tok.decode(ids) == text


def test_ranks_alone_give_the_same_automaton():
    import tiktoken

    name = "byte_bpe_multi_50k"
    path = os.path.join(bpe.TOKENIZER_DIR, f"{name}.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    tok = bpe.tokenizer(name)
    for text in filter(None, TEXTS):
        assert tok.encode(text).tolist() == library.encode_ordinary(text)
    with pytest.raises(FileNotFoundError):
        bpe.tokenizer_path("piece_bpe_32k")


def test_arcs_agree_with_merging():
    merges = [(0, 1, 2), (2, 0, 3), (0, 0, 4), (2, 2, 5)]
    labels = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3, b"aa": 4, b"abab": 5}
    auto = bpe.TokenAutomaton(labels, merges)

    def merge(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        for a, b, _ in merges:
            i = 0
            while i + 1 < len(parts):
                if parts[i] == auto.labels[a] and parts[i + 1] == auto.labels[b]:
                    parts[i : i + 2] = [parts[i] + parts[i + 1]]
                i += 1
        return [labels[p] for p in parts]

    for n in range(1, 9):
        for bits in range(2**n):
            word = bytes(97 + (bits >> i & 1) for i in range(n))
            assert auto.encode_bytes(word) == merge(word), word


def test_packing_holds_everything_once(spark):
    rng = np.random.default_rng(4)
    sizes = [int(x) for x in rng.integers(0, 90, 500)] + [0, 100, 101, 350, None]
    sized = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumn("gap", F.lit(1))
    budgets = spark.createDataFrame([("a", 100), ("b", 37)], "job string, max_tokens long")
    for group in (100_000, 60):
        packed = K.pack_sizes(sized, budgets, items_per_group=group).toPandas()
        for job, cap in (("a", 100), ("b", 37)):
            mine = packed[packed.job == job]
            assert mine.groupby("container_id").n_tokens.sum().max() <= cap
            assert mine.groupby("doc_id").n_tokens.sum().to_dict() == {i: s or 0 for i, s in enumerate(sizes)}
            pieces = mine.groupby("doc_id").size()
            assert all(pieces[i] == max(1, -(-(s or 0) // cap)) for i, s in enumerate(sizes))
            used = mine.groupby("container_id").n_tokens.sum()
            assert (used > 0).sum() <= 1.1 * sum(filter(None, sizes)) / cap
    assert K.pack_sizes(sized.limit(0), budgets).count() == 0 and K.pack_sizes(sized, budgets.limit(0)).count() == 0


def test_sum_of_squares_prefers_full_bins():
    where, gaps = K.sum_of_squares_bins(np.array([6, 4, 7, 3, 10]), 10)
    assert len(gaps) == 3 and sorted(gaps) == [0, 0, 0] and where[0] == where[1] and where[2] == where[3]


def test_pieces_cover_the_text_within_the_limit(spark):
    tok = bpe.tokenizer("byte_bpe_50k")
    long = [
        "First sentence here. Second one follows, with a clause; and more.\n\n" * 40, "nospaces" * 400, "日本語のテキスト。次の文。" * 80, "👩‍👩‍👧" * 200, "\r\n" * 500, "# Head\n\ntext text\n\n" * 90, "a b " * 600,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(long + [None, "", "short"])], "doc_id int, text string").withColumn("piece", F.lit(1))
    budgets = spark.createDataFrame([("s", "byte_bpe_50k", 100, 10), ("t", "byte_bpe_50k", 64, 0)], "job string, tokenizer string, max_tokens long, overlap_tokens long")
    got = B.split_documents(df, budgets).toPandas()
    assert set(got.doc_id) == set(range(len(long)))
    for (job, doc), rows in got.groupby(["job", "doc_id"]):
        limit, overlap = {"s": (100, 10), "t": (64, 0)}[job]
        rows = rows.sort_values("piece")
        ids = tok.encode(long[doc]).tolist()
        assert rows.piece.tolist() == list(range(len(rows))) and rows.n_tokens.max() <= limit
        assert rows.own_start.tolist() == [0, *rows.end.tolist()[:-1]] and rows.end.iloc[-1] == len(ids)
        assert b"".join(tok.decode_bytes(ids[a:b]) for a, b in zip(rows.own_start, rows.end)) == long[doc].encode()
        for r in rows.iloc[1:].itertuples():
            assert overlap <= r.own_start - r.start <= overlap + 12 and tok.decode(ids[r.start : r.end]) == r.text and "�" not in r.text
    assert B.split_documents(df.limit(0), budgets).count() == 0 and B.split_documents(df, budgets.limit(0)).count() == 0


def test_cuts_prefer_strong_boundaries():
    strength = np.zeros(100, dtype=np.int8)
    strength[[30, 55, 60]] = [4, 6, 6]
    assert B.bisect_cuts(strength, 80, 70)[0] == (0, 56)


def test_word_end_vocabulary_equals_the_library():
    tokenizers = pytest.importorskip("tokenizers")
    own, other = bpe.tokenizer("word_bpe_49k"), tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZER_DIR}/word_bpe_49k.json")
    other.encode_special_tokens = True
    for text in ["Hello  World's\n 12 naïve ΑΣ cafés 東京 \U0001f44d ok", "a", "", "x" * 70, "don't WE'LL <|endoftext|>", "1 234,5 -- ???"]:
        assert list(own.encode(text)) == other.encode(text, add_special_tokens=False).ids
    assert not own.exact and own.decode(own.encode("Hello World")) == "hello world "


def test_unknown_rules_are_refused():
    model = {"type": "BPE", "vocab": {}, "merges": []}
    for file in ({"model": {**model, "byte_fallback": True}}, {"model": model, "pre_tokenizer": {"type": "Metaspace"}}, {"model": model, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False}, "normalizer": {"type": "Prepend"}}):
        with pytest.raises(ValueError):
            bpe.text_rules(file)
    with pytest.raises(FileNotFoundError):
        bpe.tokenizer("piece_bpe_32k")


def test_indivisible_texts_and_wide_overlaps():
    tok = bpe.tokenizer("byte_bpe_50k")
    family = "\u200d".join(["\U0001f468"] * 300)  # one visible character
    pieces = B.TextSplitter(family, tok).split(16, 0)
    assert "".join(p[4] for p in pieces) == family and max(p[3] for p in pieces) <= 16
    text = "one two three four five six seven eight nine ten eleven twelve"
    pieces = B.TextSplitter(text, tok).split(8, 6)
    assert all(p[0] - p[1] == min(6, p[0]) for p in pieces) and max(p[3] for p in pieces) <= 8 and pieces[-1][2] == len(tok.encode(text))
    assert [p[4] for p in B.TextSplitter("\U0001f9ff", tok).split(1, 0)] == ["\U0001f9ff"]
    with pytest.raises(ValueError):
        B.TextSplitter(text, tok).split(8, 8)


def test_flags_are_never_divided():
    tok = bpe.tokenizer("byte_bpe_50k")
    pieces = B.TextSplitter("\U0001f1e9\U0001f1ea" * 50, tok).split(20, 0)
    assert len(pieces) > 5 and all(len(p[4]) % 2 == 0 for p in pieces)


def test_sizes_of_pieces_are_exact():
    tok = bpe.tokenizer("byte_bpe_50k")
    text = "It'llama  goes\n\n\n on  \t and on, we'll see: 12345 67 — naïve 東京です…   " * 30
    for limit, overlap in ((12, 5), (40, 0), (64, 63)):
        assert all(p[3] == tok.count(p[4]) for p in B.TextSplitter(text, tok).split(limit, overlap))
