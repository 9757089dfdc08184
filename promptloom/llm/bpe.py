"""Byte-level byte-pair encoding as a deterministic automaton over tokens.

The merges are compiled one by one, each by a gadget. The gadget of a merge ``u + v -> uv`` adds the arc ``uv`` from
every state that has the arc ``u`` to the state that ``v`` leads to, and takes the arc ``v`` away from the state after
``u``. Every state of the result is accepting and a token sequence has a path exactly if it is an encoding. Since
the state after a token depends on the token alone, the arcs are kept in factored form (where an arc was
inherited from, which merge removed it), so the tables are linear in the vocabulary. Encoding walks a byte trie
of the arc labels and keeps, for each prefix, the one label that a path to it can end with; decoding emits labels.
"""

from __future__ import annotations

import base64
import json
import os
import unicodedata
from array import array
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import regex

#: Folder with the public vocabularies.
TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the published rule that cuts a text into words before merging.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words a worker remembers; a full memory is emptied, results do not depend on it.
WORD_MEMORY = 300_000


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class TextRules:
    """What is done to a text before merging: normalising steps, the words that are kept, and how a word's end is marked."""

    steps: tuple[Callable[[str], str], ...] = ()
    pattern: str = WORD_PATTERN
    suffix: str = ""


#: Added to the last symbol of a word in vocabularies that mark ends of words.
WORD_END = 256


def _normalising_steps(rule: dict | None) -> tuple[Callable[[str], str], ...]:
    if rule is None:
        return ()
    kind = rule["type"]
    if kind == "Sequence":
        return tuple(step for part in rule["normalizers"] for step in _normalising_steps(part))
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return (lambda text: unicodedata.normalize(kind, text),)
    if kind == "Lowercase":
        return (lambda text: "".join(map(str.lower, text)),)  # letter by letter: no rule for the end of a word
    if kind == "Replace" and "Regex" in rule["pattern"]:
        compiled = regex.compile(rule["pattern"]["Regex"])
        return (lambda text: compiled.sub(lambda _: rule["content"], text),)
    raise ValueError(f"unknown normaliser {kind!r}")


def text_rules(file: dict) -> TextRules:
    """The rules of a vocabulary file; any that this encoder does not know is a ValueError, never a wrong id."""
    model, words = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("only plain byte-pair merges are supported")
    suffix = model.get("end_of_word_suffix") or ""
    parts = words["pretokenizers"] if words.get("type") == "Sequence" else [words]
    level = parts[-1]
    if level.get("type") != "ByteLevel" or level.get("add_prefix_space"):
        raise ValueError("only byte-level vocabularies without an added space are supported")
    steps = _normalising_steps(file.get("normalizer"))
    if len(parts) == 1 and level.get("use_regex", True):
        return TextRules(steps, WORD_PATTERN, suffix)
    if len(parts) == 2 and not level.get("use_regex", True) and parts[0]["type"] == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and "Regex" in parts[0]["pattern"]:
        return TextRules(steps, parts[0]["pattern"]["Regex"], suffix)
    raise ValueError("unknown rule for cutting words")


def load_merges(path: str) -> tuple[dict[tuple[int, ...], int], list[tuple[int, int, int]], TextRules]:
    """Ids of the tokens (as symbols: bytes, the last one of a word's end marked), the merges ``(left, right, result)`` in
    order of priority, and the rules for texts."""
    if path.endswith(".tiktoken"):
        with open(path, "rb") as lines:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return {tuple(t): n for t, n in ids.items()}, _recovered_merges(ids), TextRules()
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    rules, model = text_rules(whole), whole["model"]
    letters = byte_letters()
    ids = {}
    for token, number in model["vocab"].items():
        final = bool(rules.suffix) and token.endswith(rules.suffix)
        core = token.removesuffix(rules.suffix) if final else token
        if core and all(c in letters for c in core):
            symbols = [letters[c] for c in core]
            symbols[-1] += WORD_END if final else 0
            ids[tuple(symbols)] = number
    merges = []
    for merge in model["merges"]:
        left, right = merge if isinstance(merge, list) else merge.split(" ")
        merges.append((model["vocab"][left], model["vocab"][right], model["vocab"][left + right]))
    return ids, merges, rules


def _recovered_merges(ids: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """The merge that made each token, from ranks alone: its encoding by all earlier merges has two parts."""
    merges = []
    for token, rank in sorted(ids.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [(ids.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1)]
            best, i = min(ranked)
            if best >= rank:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            merges.append((ids[parts[0]], ids[parts[1]], rank))
    return merges


class TokenAutomaton:
    """Deterministic automaton whose arcs are tokens and whose paths are exactly the encodings of words."""

    def __init__(self, ids: Mapping[Sequence[int], int], merges: list[tuple[int, int, int]], *, marks_ends: bool = False) -> None:
        ids = {tuple(token): number for token, number in ids.items()}
        size = max(ids.values()) + 1
        self.marks_ends = marks_ends
        self.symbols: list[tuple[int, ...]] = [()] * size
        for token, number in ids.items():
            self.symbols[number] = token
        #: What decoding emits; the end of a word is a space.
        self.labels = [bytes(c % WORD_END for c in t) + (b" " if t and t[-1] >= WORD_END else b"") for t in self.symbols]
        #: Number of the gadget that added a state and its arc label; 0 is the start automaton of single bytes.
        self.added = array("i", [0]) * size
        #: The token whose outgoing arcs a state inherited, and the token whose incoming arcs a label inherited.
        self.out_from = array("i", [-1]) * size
        self.in_from = array("i", [-1]) * size
        #: Gadget that removed the arc of a pair.
        self.removed: dict[int, int] = {}
        self.size = size
        for step, (left, right, result) in enumerate(merges, 1):
            self._add_gadget(step, left, right, result)
        self.trie = self._label_trie()
        self.label_sizes = np.array([len(label) for label in self.labels], dtype=np.int64)
        self.symbol_ids = array("i", [ids.get((b,), -1) for b in range(2 * WORD_END)])
        self._memory: dict[str, array] = {}
        self._arc_memory: dict[int, bool] = {}

    def _add_gadget(self, step: int, left: int, right: int, result: int) -> None:
        self.added[result] = step
        self.out_from[result] = right
        self.in_from[result] = left
        self.removed[left * self.size + right] = step

    def _label_trie(self) -> dict[int, int]:
        """``node * 512 + symbol -> node``, and the label that ends at a node."""
        self.label_at: dict[int, int] = {}
        trie: dict[int, int] = {}
        nodes = 1
        for number, token in enumerate(self.symbols):
            if not token:
                continue
            node = 0
            for symbol in token:
                step = node * 2 * WORD_END + symbol
                following = trie.get(step)
                if following is None:
                    following = trie[step] = nodes
                    nodes += 1
                node = following
            self.label_at[node] = number
        return trie

    def has_arc(self, state: int, label: int) -> bool:
        """Whether the state after token ``state`` has an arc ``label``: follow the gadgets back in time."""
        key = state * self.size + label
        known = self._arc_memory.get(key)
        if known is not None:
            return known
        now = 1 << 30
        a, b = state, label
        there = True
        while True:
            gone = self.removed.get(a * self.size + b)
            if gone is not None and gone < now:
                there = False
                break
            made_a, made_b = self.added[a], self.added[b]
            if made_a == 0 and made_b == 0:
                break
            if made_a > made_b:  # a state keeps what its gadget itself removes,
                now, a = made_a, self.out_from[a]
            else:  # a new arc does not start where its gadget removed the arc it is based on
                now, b = made_b + 1, self.in_from[b]
        if len(self._arc_memory) > 2_000_000:
            self._arc_memory.clear()
        self._arc_memory[key] = there
        return there

    def encode_bytes(self, word: bytes) -> list[int]:
        """The only path of the automaton that spells ``word``."""
        n = len(word)
        symbols = list(word)
        if self.marks_ends:
            symbols[-1] += WORD_END
        if n == 1:
            return [self.symbol_ids[symbols[0]]]
        last = [-1] * (n + 1)
        trie, label_at, has_arc = self.trie, self.label_at, self.has_arc
        for start in range(n):
            state = last[start]
            if start and state < 0:
                continue
            node = 0
            for end in range(start, n):
                node = trie.get(node * 512 + symbols[end], -1)
                if node < 0:
                    break
                label = label_at.get(node)
                if label is not None and last[end + 1] < 0 and (not start or has_arc(state, label)):
                    last[end + 1] = label
        out = []
        at = n
        while at:
            out.append(last[at])
            at -= len(self.symbols[last[at]])
        out.reverse()
        return out

    def encode_word(self, word: str) -> array:
        found = self._memory.get(word)
        if found is None:
            found = array("i", self.encode_bytes(word.encode("utf-8")))
            if len(self._memory) >= WORD_MEMORY:
                self._memory.clear()
            if len(word) <= 64:
                self._memory[word] = found
        return found


    def encode_words(self, words: list[str]) -> list[array]:
        get, encode = self._memory.get, self.encode_word
        return [found if (found := get(word)) is not None else encode(word) for word in words]


class ByteTokenizer:
    """Words of the published pattern, each encoded by the automaton. Special tokens are ordinary text."""

    def __init__(self, path: str) -> None:
        ids, merges, self.rules = load_merges(path)
        self.automaton = TokenAutomaton(ids, merges, marks_ends=bool(self.rules.suffix))
        self.pattern = regex.compile(self.rules.pattern)

    @property
    def exact(self) -> bool:
        """Whether decoding gives the text back byte by byte."""
        return not self.rules.steps and not self.rules.suffix and self.rules.pattern == WORD_PATTERN

    def words(self, text: str) -> list[str]:
        for step in self.rules.steps:
            text = step(text)
        return self.pattern.findall(text)

    def encode(self, text: str | None) -> array:
        """Ids of a text; an empty or null text has none."""
        return array("i", b"".join(self.automaton.encode_words(self.words(text)))) if text else array("i")

    def count(self, text: str | None) -> int:
        return sum(map(len, self.automaton.encode_words(self.words(text)))) if text else 0

    def decode_bytes(self, ids) -> bytes:
        labels = self.automaton.labels
        return b"".join([labels[i] for i in ids])

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def tokenizer_path(name: str, folder: str = TOKENIZER_DIR) -> str:
    """File of a byte-level tokenizer; a vocabulary of another kind is an error, never a wrong id."""
    for ending in (".json", ".tiktoken"):
        path = os.path.join(folder, name + ending)
        if os.path.exists(path):
            return path
    raise FileNotFoundError(f"no byte-level vocabulary named {name!r} in {folder}")


@lru_cache(maxsize=4)
def tokenizer(name: str, folder: str = TOKENIZER_DIR) -> ByteTokenizer:
    """One compiled tokenizer per Python worker; the vocabulary file is read where the worker runs."""
    return ByteTokenizer(tokenizer_path(name, folder))
