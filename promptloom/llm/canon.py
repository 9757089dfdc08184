"""Canonical forms of prompts: what stays when formatting is taken away."""

from __future__ import annotations

import json
import unicodedata

import regex
import xxhash

_INVISIBLE = regex.compile(r"\p{Cf}+")
_SEPARATORS = regex.compile(r"(?:(?!(?<=\d)[.,](?=\d))[\p{P}\p{Z}\p{C}`´|])+")
_JOINABLE = regex.compile(r"(?<!\d) | (?!\d)")
_FIELD = regex.compile(r"^[\W_]*([^\W\d_](?:[^\W_]|[ '’_-])*?)\s*(?:(?<!\d)[:=]|[:=](?!\d))(.*)$", regex.S)
#: What may set fields off, in the order in which it is looked for; a text whose parts are not mostly fields is tried with the next.
_FIELD_BREAKS = [regex.compile(p) for p in (r"[;\r\n\u2028\u2029]+", r"\|+", r"\t+", r"(?<=\s)/+(?=\s)|(?<=\s)[–—]+(?=\s)|[•·]+", r",(?!\d)|(?<!\d),")]
#: Letters of scripts that set no space between words; each is a word of its own.
_UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WORD_OR_NUMBER = regex.compile(rf"(?V1)\d+(?:[.,]\d+)*|[{_UNSPACED}]\p{{M}}*|[[\p{{L}}\p{{M}}]--[{_UNSPACED}]]+|\p{{S}}")

#: Share of the segments that must look like ``name: value`` for a text to count as named fields.
FIELD_SHARE = 0.7


def fold(text: str) -> str:
    """Letter case and invisible characters removed, in one Unicode form."""
    return _INVISIBLE.sub("", unicodedata.normalize("NFC", text.casefold()))


def plain_key(text: str) -> str:
    """Letters, digits and symbols only; a point or comma between digits stays, and digits stay apart."""
    return _JOINABLE.sub("", _SEPARATORS.sub(" ", fold(text)).strip())


def words(text: str) -> list[str]:
    """Words, numbers (with inner points and commas) and symbols of the folded text, in order."""
    return _WORD_OR_NUMBER.findall(fold(text))


def named_fields(text: str) -> list[tuple[str, str]] | None:
    """``(name, value)`` of a text written as fields, in JSON, in lines or set off by signs, else None.

    A name ends at a colon or an equals sign. The first of the signs that makes most parts fields is the one that
    sets them off; a part without a name goes on with the value before it.
    """
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            loaded = json.loads(body)
        except ValueError:
            loaded = None
        if isinstance(loaded, dict) and len(loaded) > 1:
            return [(str(k), v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)) for k, v in loaded.items()]
    if ":" not in body and "=" not in body:
        return None
    for sign in _FIELD_BREAKS:
        fields = _fields_between(sign.split(body))
        if fields is not None:
            return fields
    return None


def _fields_between(parts: list[str]) -> list[tuple[str, str]] | None:
    segments = [p for p in parts if p and p.strip()]
    if len(segments) < 2:
        return None
    fields: list[tuple[str, str]] = []
    named = 0
    for segment in segments:
        match = _FIELD.match(segment)
        if match:
            fields.append((match[1], match[2]))
            named += 1
        elif not fields:
            return None
        elif plain_key(segment):
            fields[-1] = (fields[-1][0], f"{fields[-1][1]} {segment}")
        else:
            named += 1  # a stray end mark is no segment of its own
    if len(fields) < 2 or named < FIELD_SHARE * len(segments):
        return None
    return fields


def format_free_key(text: str) -> str:
    """Equal for two texts exactly if they differ in formatting or the order of named fields only."""
    fields = named_fields(text)
    if fields is None:
        return plain_key(text)
    return "\u001e".join(sorted(f"{plain_key(name)}\u001f{plain_key(value)}" for name, value in fields))


def digest(key: str) -> tuple[int, int]:
    """128 bits of a key as two signed 64-bit numbers."""
    whole = xxhash.xxh3_128_intdigest(key)
    high, low = whole >> 64, whole & 0xFFFFFFFFFFFFFFFF
    return high - (1 << 64) if high >> 63 else high, low - (1 << 64) if low >> 63 else low
