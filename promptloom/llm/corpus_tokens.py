"""Problem 6: token ids of the whole corpus by a public byte-level tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.bpe import TOKENIZER_DIR, tokenizer
from promptloom.runtime import spread


def encode_corpus(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id, ids)``: one row per input row with the ids of its whole text, without special tokens.

    Null and empty texts have the empty list. Marker strings of special tokens are ordinary text. Repeated
    rows come out again; an empty table gives an empty result; other columns are ignored. Rows are encoded
    where they are read, without a shuffle.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name, folder)
        for batch in batches:
            lists = [tok.encode(t) for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.concatenate([np.frombuffer(x, dtype=np.int32) for x in lists if len(x)]) if offsets[-1] else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], [id_col, "ids"])

    base = spread(documents.select(F.col(id_col), F.col(text_col).cast("string")), id_col)
    return base.mapInArrow(encoded, f"{id_col} {base.schema[0].dataType.simpleString()}, ids array<int>")


def count_corpus(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id, n_tokens)``: like :func:`encode_corpus`, with the number of ids only."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name, folder)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tok.count(t) for t in batch.column(1).to_pylist()], pa.int64())], [id_col, "n_tokens"])

    base = spread(documents.select(F.col(id_col), F.col(text_col).cast("string")), id_col)
    return base.mapInArrow(counted, f"{id_col} {base.schema[0].dataType.simpleString()}, n_tokens long")


def decode_corpus(encoded: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``(id, text)`` from token ids, by emitting the label of every arc; null ids give a null text."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(name, folder)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else tok.decode(x) for x in batch.column(1).to_pylist()], pa.string())], [id_col, "text"])

    base = encoded.select(F.col(id_col), F.col(ids_col))
    return base.mapInArrow(decoded, f"{id_col} {base.schema[0].dataType.simpleString()}, text string")
