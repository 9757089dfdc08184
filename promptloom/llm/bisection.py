"""Problem 8: oversized texts cut at natural boundaries by recursive bisection, with overlaps."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptloom.llm.bpe import TOKENIZER_DIR, ByteTokenizer, tokenizer
from promptloom.runtime import spread

#: Boundaries from strong to weak; a place gets the strength of the first rule that ends there. Ends of words have strength 2.
BOUNDARIES = [
    (7, re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*(?=#{1,6} )|(?:\r\n|\n|\r)(?=#{1,6} )")),  # before a heading
    (6, re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*")),  # after an empty line
    (5, re.compile(r"(?:\r\n|\n|\r|\u2028|\u2029)+")),  # after a line
    (4, re.compile(r"[.!?…]+[\"'”’»)\]*_]*(?=\s)|[。！？]+[」』”’）]*|\}(?=, ?\{)")),  # after a sentence or record
    (3, re.compile(r"[;:,](?=\s)|[；：，、]|\s[–—-](?=\s)|[)\]}]+,?(?=\s)")),  # after a clause
]
_WORD_END = 2
_ASCII_BLANK = np.array([chr(c).isspace() for c in range(128)])
_FLAGS, _JOINER = (0x1F1E6, 0x1F1FF), 0x200D


@lru_cache(maxsize=1)
def _character_kinds() -> tuple[np.ndarray, np.ndarray]:
    """For every code point whether it continues the visible character before it, and whether it is white space."""
    codes = [chr(c) for c in range(0x110000)]
    joins = np.fromiter((unicodedata.category(c)[0] == "M" for c in codes), bool, len(codes))
    joins[_JOINER] = True
    joins[0x1160:0x1200] = True
    joins[0x1F3FB:0x1F400] = True
    return joins, np.fromiter((c.isspace() for c in codes), bool, len(codes))


def _inside_characters(codes: np.ndarray) -> np.ndarray:
    """Positions inside one visible character: before marks and joiners, after joiners, between flag letters, inside CR LF."""
    inside = (codes[:-1] == 13) & (codes[1:] == 10)
    if codes.dtype == np.uint8:
        return np.flatnonzero(inside) + 1
    inside |= _character_kinds()[0][codes[1:]] | (codes[:-1] == _JOINER)
    flag = (codes >= _FLAGS[0]) & (codes <= _FLAGS[1])
    if flag.any():
        at = np.arange(len(codes))
        since = at - np.maximum.accumulate(np.where(flag, -1, at))  # how many flag letters in a row end here
        inside |= flag[1:] & (since[1:] % 2 == 0)
    return np.flatnonzero(inside) + 1


#: Tokens by which an overlap may begin earlier so as not to divide a visible character.
MOST_EARLIER = 16
#: Part of a stretch around its midpoint in which the strongest boundary is taken, tried from narrow to wide.
WINDOWS = (0.2, 0.4, 0.49)


def boundary_strengths(text: str, raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Strength of a cut after each token (``ends``: byte offsets): 0 between characters, -1 inside a visible one, -2 inside a code point."""
    strength = np.full(len(raw) + 1, -2, dtype=np.int8)
    if len(raw) == len(text):
        at, codes = np.arange(len(text) + 1), np.frombuffer(raw, dtype=np.uint8)
    else:
        at = np.append(np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80), len(raw))
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    strength[at] = 0
    blank = _ASCII_BLANK[codes] if codes.dtype == np.uint8 else _character_kinds()[1][codes]
    strength[at[np.flatnonzero(~blank[:-1] & blank[1:]) + 1]] = _WORD_END
    for value, rule in reversed(BOUNDARIES):
        places = at[[m.end() for m in rule.finditer(text)]]
        strength[places] = np.maximum(strength[places], value)
    strength[at[_inside_characters(codes)]] = -1
    return strength[ends]


def bisect_cuts(strength: np.ndarray, limit: int, room: int) -> list[tuple[int, int]]:
    """Stretches ``[start, end)`` of tokens, each at most ``room`` long (the first and an undivided text: ``limit``).

    ``strength[i]`` is that of a cut after token i. A stretch that is too long is cut at the strongest
    boundary near its midpoint, the nearest of equals, and its halves are treated alike.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(strength))]
    while todo:
        start, end = todo.pop()
        if end - start <= (limit if start == 0 and end == len(strength) else room) or end - start < 2:
            out.append((start, end))
            continue
        middle = (start + end) / 2
        cut = -1
        for share in WINDOWS:
            reach = max(1, int((end - start) * share))
            low, high = max(start + 1, int(middle) - reach), min(end - 1, int(middle) + reach)
            around = strength[low - 1 : high]
            if len(around) and around.max() >= (_WORD_END if share < WINDOWS[-1] else 0):
                best = np.flatnonzero(around == around.max()) + low
                cut = int(best[np.abs(best - middle).argmin()])
                break
        if cut < 0:
            free = strength[start : end - 1]
            if not (free >= -1).any():
                out.append((start, end))  # a single code point longer than the limit
                continue
            inside = np.flatnonzero(free >= min(0, free.max())) + start + 1  # a visible character is divided only if nothing else is left
            cut = int(inside[np.abs(inside - middle).argmin()])
        todo.append((cut, end))
        todo.append((start, cut))
    return out


class TextSplitter:
    """A text with its encoding and boundaries, to be cut under one or more budgets."""

    def __init__(self, text: str, tok: ByteTokenizer) -> None:
        if not tok.exact:
            raise ValueError("only a tokenizer that keeps every byte of a text can tell where to cut it")
        self.text, self.tok = text, tok
        self.words = tok.pattern.findall(text)
        encoded = tok.automaton.encode_words(self.words)
        self.ids = np.frombuffer(b"".join(encoded), dtype=np.int32)
        self._word_token = np.concatenate([[0], np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)))])
        self._strength: np.ndarray | None = None

    def _prepare(self) -> None:
        if self._strength is None:
            self._ends = np.cumsum(self.tok.automaton.label_sizes[self.ids])
            self._raw = self.text.encode("utf-8")
            self._strength = boundary_strengths(self.text, self._raw, self._ends)
            self._word_byte = np.concatenate([[0], self._ends])[self._word_token]

    def _text(self, first: int, last: int) -> str:
        return self._raw[first:last].decode("utf-8", errors="replace")

    def _count(self, start: int, end: int) -> int:
        """Tokens of the stretch encoded by itself.

        Its words are those of the whole text but at its edges: a word that it begins inside is followed until its words
        end where those of the text do, and white space and a divided word at its end are encoded anew.
        """
        first, last = (int(self._ends[start - 1]) if start else 0), int(self._ends[end - 1])
        low = int(np.searchsorted(self._word_token, start))
        head = 0
        if self._word_token[low] != start:
            known = set(self._word_byte[low : low + 4].tolist())
            at = first
            for word in self.tok.pattern.findall(self._text(first, min(last, int(self._word_byte[min(low + 4, len(self.words))])))):
                at += len(word.encode("utf-8"))
                head += len(self.tok.automaton.encode_word(word))
                if at in known:
                    break
            else:
                return self.tok.count(self._text(first, last))
            low = int(np.searchsorted(self._word_byte, at))
        high = int(np.searchsorted(self._word_token, end, side="right")) - 1
        while high > low and self.words[high - 1].isspace():
            high -= 1
        if high <= low + 4:  # too short for edges of its own
            return self.tok.count(self._text(first, last))
        return head + int(self._word_token[high] - self._word_token[low]) + self.tok.count(self._text(int(self._word_byte[high]), last))

    def _piece(self, own: int, end: int, shared: int) -> tuple[int, int, int, int, str]:
        start = max(0, own - shared) if own else 0
        earlier = start
        while start < own and earlier > 0 and self._strength[earlier - 1] < 0 and start - earlier < MOST_EARLIER:
            earlier -= 1
        if earlier == 0 or self._strength[earlier - 1] >= 0:
            start = earlier
        while start > 0 and self._strength[start - 1] < -1:
            start -= 1
        return own, start, end, self._count(start, end), self._text(int(self._ends[start - 1]) if start else 0, int(self._ends[end - 1]))

    def split(self, limit: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
        """``(own_start, start, end, n_tokens, piece)`` of each piece; ``[start, own_start)`` is the overlap.

        Positions count tokens of the whole text. ``n_tokens`` is the size of the piece encoded by itself,
        which can differ from ``end - start`` at the edges; a piece that would exceed the limit is cut again. Only a
        code point that has more tokens than the limit by itself gives a piece beyond it. An overlap that is not
        smaller than the limit is a ValueError.
        """
        if limit < 1 or not 0 <= overlap < limit:
            raise ValueError(f"an overlap of {overlap} does not go with a limit of {limit}")
        if len(self.ids) <= limit:
            return [(0, 0, len(self.ids), len(self.ids), self.text)]
        self._prepare()
        out = []
        todo = [(a, b, limit - overlap) for a, b in reversed(bisect_cuts(self._strength, limit, limit - overlap))]
        while todo:
            own, end, room = todo.pop()
            piece = self._piece(own, end, overlap)
            smaller = min(room, end - own) - max(1, piece[3] - limit)
            if piece[3] <= limit:
                out.append(piece)
                continue
            halves = bisect_cuts(self._strength[own:end], max(1, smaller), max(1, smaller))
            if len(halves) == 1:
                out.append(self._piece(own, end, 0) if piece[3] > limit else piece)
            else:
                todo.extend((own + a, own + b, max(1, smaller)) for a, b in reversed(halves))
        return out


def split_documents(documents: DataFrame, budgets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Pieces of every text with more than ``max_tokens`` tokens, for each row of ``budgets``.

    Gives ``(job, doc_id, piece, own_start, start, end, n_tokens, text)``; pieces are numbered from 0, the
    parts ``[own_start, end)`` follow each other without gap and the piece text also holds the last
    ``overlap_tokens`` tokens before (a few more if a character begins earlier). Null, empty and small texts
    give no rows. Repeated rows come out again. Texts are cut where they are read, without a shuffle.
    ``budgets`` is a small table of parameters.
    """
    jobs = [(r["job"], r["tokenizer"], int(r["max_tokens"]), int(r["overlap_tokens"] or 0)) for r in budgets.select("job", "tokenizer", "max_tokens", "overlap_tokens").distinct().orderBy("job").collect()]
    for job, _, limit, overlap in jobs:
        if limit < 1 or not 0 <= overlap < limit:
            raise ValueError(f"budget {job!r}: an overlap of {overlap} does not go with a limit of {limit}")
    base = spread(documents.select(F.col(id_col), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()), id_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            keys = batch.column(0)
            held = []
            size = 0
            for row, text in enumerate(batch.column(1).to_pylist()):
                splitters: dict[str, TextSplitter] = {}
                length = len(text.encode("utf-8"))  # no token is shorter than a byte
                for job, name, limit, overlap in jobs:
                    if length <= limit:
                        continue
                    if name not in splitters:
                        splitters[name] = TextSplitter(text, tokenizer(name, folder))
                    if len(splitters[name].ids) <= limit:
                        continue
                    pieces = splitters[name].split(limit, overlap)
                    for number, (own, start, end, n, piece) in enumerate(pieces):
                        held.append(row)
                        for column, value in zip(columns, (job, number, own, start, end, n, piece)):
                            column.append(value)
                        size += len(piece)
                if size > 8_000_000:
                    yield _rows(keys, held, columns)
                    columns, held, size = [[] for _ in range(8)], [], 0
            yield _rows(keys, held, columns)

    id_type = base.schema[0].dataType.simpleString()
    return base.mapInArrow(cut, f"job string, doc_id {id_type}, piece int, own_start int, start int, end int, n_tokens int, text string")


def _rows(keys: pa.Array, held: list[int], columns: list[list]) -> pa.RecordBatch:
    job, number, own, start, end, n, piece = columns[:7]
    ints = [pa.array(c, pa.int32()) for c in (number, own, start, end, n)]
    return pa.RecordBatch.from_arrays([pa.array(job, pa.string()), keys.take(pa.array(held, pa.int64())), *ints, pa.array(piece, pa.string())], ["job", "doc_id", "piece", "own_start", "start", "end", "n_tokens", "text"])
