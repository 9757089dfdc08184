"""Prompt mutations as expressions: synonyms, word order, negation, numbers and typing slips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and what they are replaced by.
SYNONYMS = {
    "check": "verify", "reset": "change", "cancel": "terminate", "membership": "subscription", "international": "global", "shipping": "delivery", "invoice": "receipt", "contact": "reach", "active": "current", "transfer": "move",
    "payment": "transaction", "dosage": "amount", "patient": "sick person", "user": "customer", "order": "purchase", "password": "login credentials",
}
# What is added where a mutation finds nothing to change.
SYNONYM_SUFFIX, NUMBER_SUFFIX, SLIP_SUFFIX = " (global delivery details)", " for 10 users instead of 1", " checkk"


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: F.length(w) > 0)


def with_synonyms(text: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])

    def swap(word: Column) -> Column:
        bare = F.lower(F.regexp_replace(word, r"(?U)[^\w]", ""))
        better = F.try_element_at(table, bare)
        return F.when(better.isNotNull(), F.replace(F.lower(word), bare, better)).otherwise(word)

    changed = F.array_join(F.transform(_split(text), swap), " ")
    return F.when(F.lower(changed) == F.lower(text), F.concat(changed, F.lit(SYNONYM_SUFFIX))).otherwise(changed)


def with_swapped_words(text: Column) -> Column:
    w = _split(text)
    swapped = F.concat(F.slice(w, 1, 1), F.slice(w, 3, 1), F.slice(w, 2, 1), F.slice(w, F.lit(4), F.greatest(F.size(w) - 3, F.lit(0))))
    return F.array_join(F.when(F.size(w) > 3, swapped).otherwise(w), " ")


def negated(text: Column) -> Column:
    low = F.lower(text)

    def inserted(phrase: str) -> Column:
        capital = phrase[0].upper() + phrase[1:]
        first = capital[:-1] + "I" if phrase.endswith(" i") else capital
        return F.replace(F.replace(text, F.lit(first), F.lit(first + " not")), F.lit(phrase), F.lit(phrase + " not"))

    return (
        F.when(low.contains("can you"), inserted("can you"))
        .when(low.contains("how do i"), inserted("how do i"))
        .when(low.contains("should i"), inserted("should i"))
        .when(low.contains("is "), F.regexp_replace(text, r"(?i)\bis\b", "is not"))
        .otherwise(F.concat(F.lit("Do not "), text))
    )


def with_other_numbers(text: Column) -> Column:
    """Each digit run d becomes 3d + 5, replaced once from the left in the text changed so far."""
    runs = F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))

    def step(done: Column, run: Column) -> Column:
        at = F.instr(done, run)
        new = (run.cast("decimal(30,0)") * 3 + 5).cast("decimal(31,0)").cast("string")
        return F.when(at > 0, F.concat(F.substr(done, F.lit(1), at - 1), new, F.substr(done, at + F.length(run)))).otherwise(done)

    return F.when(F.size(runs) > 0, F.aggregate(runs, text, step)).otherwise(F.concat(text, F.lit(NUMBER_SUFFIX)))


def with_slips(text: Column) -> Column:
    """Third and fourth letter swapped in the first two words of more than four letters."""
    w = _split(text)
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, word: Column) -> Column:
        hit = (F.length(word) > 4) & (state["n"] < 2)
        slipped = F.concat(F.substring(word, 1, 2), F.substring(word, 4, 1), F.substring(word, 3, 1), F.substr(word, F.lit(5)))
        return F.struct((state["n"] + F.when(hit, 1).otherwise(0)).alias("n"), F.array_append(state["out"], F.when(hit, slipped).otherwise(word)).alias("out"))

    changed = F.array_join(F.aggregate(w, start, step)["out"], " ")
    return F.when(changed == text, F.concat(text, F.lit(SLIP_SUFFIX))).otherwise(changed)


MUTATIONS = {"synonym": with_synonyms, "word_order": with_swapped_words, "negation": negated, "numeric": with_other_numbers, "typo": with_slips}
