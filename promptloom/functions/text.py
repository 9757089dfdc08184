"""Text rules as column expressions: tokens, entity changes and opposite actions of prompt pairs.

All of it stays inside the JVM; nothing here is a Python UDF. Every detector treats null prompts as empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Medication names that must not be swapped.
DRUGS = [
    "ibuprofen", "acetaminophen", "paracetamol", "aspirin", "naproxen", "amoxicillin", "penicillin", "metformin", "lisinopril", "atorvastatin", "simvastatin", "omeprazole", "prednisone", "warfarin",
    "clopidogrel", "sertraline", "fluoxetine", "alprazolam", "diazepam", "lorazepam", "insulin", "metoprolol", "amlodipine", "losartan", "gabapentin", "tramadol", "oxycodone", "morphine", "codeine",
    "hydroxychloroquine", "ivermectin", "remdesivir", "dexamethasone",
]
# Words that refer to a time relative to now.
TEMPORAL_WORDS = "today yesterday tomorrow now current currently recent recently latest last previous prior next upcoming this past historical annual monthly weekly daily".split()
# Pairs of such words that mean the same.
HARMLESS_TEMPORAL = [("current", "recent"), ("recent", "latest"), ("current", "latest"), ("last", "recent"), ("last", "latest"), ("recent", "most"), ("current", "most")]
# Roles and privilege levels, and words for the speaker's own things.
PRIVILEGES = "administrator admin root superuser sudo system service privileged elevated owner manager guest anonymous".split()
POSSESSIVES = ["my", "our", "your"]
# Capitalised words that are no names.
NOT_NAMES = [
    "the", "an", "a", "in", "on", "at", "for", "of", "to", "and", "or", "but", "is", "are", "was", "were", "be", "i", "my", "this", "that", "it", "its", "by", "as", "do", "can", "how", "what",
    "give", "me", "us", "list", "provide", "q", "mr", "dr", "ms", "tell", "show", "get", "find", "describe", "explain", "summarize", "summarise", "analyze", "analyse", "compare", "calculate",
    "generate", "write", "create", "make", "help", "please", "need", "want", "looking",
]
# Actions that exclude each other.
OPPOSITES = [
    ("approve", "deny"), ("approve", "reject"), ("allow", "block"), ("allow", "deny"), ("increase", "decrease"), ("raise", "lower"), ("buy", "sell"), ("enable", "disable"), ("grant", "revoke"), ("grant", "restrict"),
    ("release", "hold back"), ("release", "withhold"), ("whitelist", "blacklist"), ("encrypt", "decrypt"), ("open", "close"), ("start", "stop"), ("keep", "sell"), ("keep", "liquidate"), ("deposit", "withdraw"), ("backup", "delete"),
    ("backup", "destroy"), ("public", "private"), ("external", "internal"), ("personal", "business"), ("personal", "external"), ("cryptocurrency", "deposit"), ("crypto", "fiat"), ("legitimate", "fraudulent"), ("turn on", "turn off"),
    ("require", "allow"), ("require", "permit"), ("complex", "simple"), ("complex", "basic"),
]
# Words whose meaning a negation turns round, and negations.
NEGATABLE = "required safe valid active legitimate binding enforceable malignant benign".split()
NEGATIONS = ["not", "no", "never", "don't", "cannot", "can't", "refuse"]
# Names of months, days and ordinals, and patterns of dates, numbers and versions.
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec".split()
DAYS = "monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
QUARTER = r"(?i)\b(?:Q[1-4]|quarter\s+[1-4]|[1-4](?:st|nd|rd|th)\s+quarter)\b"
NUMBER = r"\b\d+(?:\.\d+)?[a-zA-Z]{0,5}"
VERSION = r"(?i)\bv?\d+(?:\.\d+){1,3}\b"
#: Order in which the detectors decide.
DETECTORS = ["quarter", "year", "ordinal", "drug", "numeric", "version", "month", "day", "temporal", "privilege", "proper_noun"]


def strip_space(text: Column) -> Column:
    """Without outer white space of any Unicode kind; the canonical form of a prompt before it is a key."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)))


def _quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(words: list[str]) -> Column:
    """Array of literals, as one expression."""
    return F.expr("array(" + ", ".join(_quoted(w) for w in words) + ")")


def token_set(text: Column) -> Column:
    """Distinct lower-case tokens of letters, digits, points and apostrophes."""
    return _found(F.lower(text), r"[a-zA-Z0-9.']+")


def name_tokens(text: Column) -> Column:
    """Distinct lower-case runs that start with a capital or are capitals only."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Z][a-z]+|[A-Z]+(?=[A-Z][a-z])|[A-Z]+"), F.lit(0)), F.lower))


@dataclass(frozen=True)
class EntityRules:
    """Which detectors run; the two strict flags switch single ones off as well."""

    enabled: bool = True
    disabled: tuple[str, ...] = field(default_factory=tuple)
    strict_time_periods: bool = True
    strict_proper_nouns: bool = True

    def __post_init__(self) -> None:
        unknown = set(self.disabled) - set(DETECTORS)
        if unknown:
            raise ValueError(f"unknown detectors: {sorted(unknown)}")

    def active(self) -> list[str]:
        off = set(self.disabled) | ({"temporal"} if not self.strict_time_periods else set()) | ({"proper_noun"} if not self.strict_proper_nouns else set())
        return [d for d in DETECTORS if d not in off] if self.enabled else []


_LEXICONS = {"drug": DRUGS, "temporal": TEMPORAL_WORDS, "privilege": PRIVILEGES}
_CALENDAR = {"month": MONTHS, "day": DAYS}


def _entity_set(detector: str, text: Column, low: Column, tokens: Column, runs: Column) -> Column:
    """What one side mentions of the kind a detector compares.

    ``low`` is the text in lower case, ``tokens`` its :func:`token_set` and ``runs`` its runs of word characters.
    """
    none = F.array().cast("array<string>")
    if detector in _LEXICONS:
        return F.array_intersect(tokens, _words(_LEXICONS[detector]))
    if detector in _CALENDAR:
        return F.array_intersect(runs, _words(_CALENDAR[detector]))
    if detector == "year":
        return F.filter(runs, lambda x: x.rlike(r"^(?:19|20)[0-9]{2}$"))
    if detector == "ordinal":
        return F.filter(runs, lambda x: x.rlike(r"^[1-9][0-9]*(?:st|nd|rd|th)$") | x.isin(ORDINALS))
    if detector == "quarter":
        return F.when(low.contains("q"), F.array_distinct(F.transform(_found(text, QUARTER), F.upper))).otherwise(none)
    if detector == "version":
        return F.when(low.contains("."), _found(low, VERSION)).otherwise(none)
    if detector == "numeric":
        return F.filter(_found(low, NUMBER), lambda x: ~x.rlike(r"^(?:19|20)[0-9]{2}$"))
    return F.filter(F.array_except(name_tokens(text), _words(NOT_NAMES)), lambda x: F.length(x) > 2)


def _verdict(detector: str, a: Column, b: Column, own_a: Column, own_b: Column, mine_a: Column, mine_b: Column) -> Column:
    """Struct of a detector where it fires. Tokens are the smallest of each side's own ones, so they do not depend on order."""
    least_a, least_b = F.array_min(own_a), F.array_min(own_b)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    differ = both & ((F.size(own_a) > 0) | (F.size(own_b) > 0))
    each = (F.size(own_a) > 0) & (F.size(own_b) > 0)

    def change(changed: Column, token_a: Column, token_b: Column) -> Column:
        return F.when(changed, F.struct(F.lit(detector).alias("detector"), token_a.alias("token_a"), token_b.alias("token_b")))

    if detector == "drug":
        return change(differ, least_a, least_b)
    if detector == "proper_noun":
        return change(each, least_a, least_b)
    if detector == "temporal":
        same = F.array_contains(_words([" ".join(sorted(p)) for p in HARMLESS_TEMPORAL]), F.concat_ws(" ", F.array_sort(F.array(least_a, least_b))))
        return change(each & ~same, least_a, least_b)
    if detector == "privilege":
        return F.coalesce(
            change(differ, least_a, least_b), change((F.size(a) > 0) & (F.size(b) == 0) & mine_b, F.array_min(a), F.lit("user")), change((F.size(b) > 0) & (F.size(a) == 0) & mine_a, F.lit("user"), F.array_min(b))
        )
    return change(differ, F.coalesce(least_a, F.array_min(a)), F.coalesce(least_b, F.array_min(b)))


def with_entity_change(df: DataFrame, a: str, b: str, name: str, rules: EntityRules = EntityRules()) -> DataFrame:
    """Add ``name``: struct of the first detector, in fixed order, that sees another entity in ``b`` than in ``a``, else null.

    Token sets, what each side mentions and what only it mentions are columns of their own before the verdict, so
    that none is computed twice.
    """
    active = rules.active()
    if not active:
        return df.withColumn(name, F.lit(None).cast("struct<detector:string,token_a:string,token_b:string>"))
    kept = df.columns
    sides = {"a": F.col(a), "b": F.col(b)}
    staged = df.withColumns({f"_l_{s}": F.lower(F.coalesce(c, F.lit(""))) for s, c in sides.items()})
    staged = staged.withColumns({**{f"_t_{s}": token_set(F.col(f"_l_{s}")) for s in sides}, **{f"_r_{s}": _found(F.col(f"_l_{s}"), r"(?U)\w+") for s in sides}})
    staged = staged.withColumns({f"_e_{d}_{s}": _entity_set(d, c, *[F.col(f"_{k}_{s}") for k in "ltr"]) for d in active for s, c in sides.items()})
    own = {f"_o_{d}_{s}": F.array_except(f"_e_{d}_{s}", f"_e_{d}_{o}") for d in active for s, o in (("a", "b"), ("b", "a"))}
    staged = staged.withColumns({**own, **{f"_m_{s}": F.arrays_overlap(f"_t_{s}", _words(POSSESSIVES)) for s in sides}})
    verdicts = [_verdict(d, *[F.col(f"_{k}_{d}_{s}") for k in "eo" for s in "ab"], F.col("_m_a"), F.col("_m_b")) for d in active]
    return staged.withColumn(name, F.coalesce(*verdicts)).select(*[c for c in kept if c != name], name)


def with_opposite_action(df: DataFrame, a: str, b: str, name: str, *, whole_words: bool = False) -> DataFrame:
    """Add ``name``: whether two prompts ask for opposite things: antonyms, one-sided negation or other whole numbers.

    Words are looked for as substrings, or as whole words with ``whole_words``. Each word is looked for once per side.
    """
    terms = sorted({w for pair in OPPOSITES for w in pair} | set(NEGATABLE))
    bit = {t: 1 << i for i, t in enumerate(terms)}
    sides = {"a": F.col(a), "b": F.col(b)}
    kept = df.columns

    def has(side: str, word: str) -> str:
        return f"rlike(_l_{side}, {_quoted(rf'(?<![a-z])' + word + rf'(?![a-z])')})" if whole_words else f"contains(_l_{side}, {_quoted(word)})"

    def mask(side: str) -> Column:
        """One bit for each term that the text holds."""
        return F.expr(" | ".join(f"(CASE WHEN {has(side, t)} THEN {n}L ELSE 0L END)" for t, n in bit.items()))

    staged = df.withColumns({f"_l_{s}": F.lower(F.coalesce(c, F.lit(""))) for s, c in sides.items()})
    negations = {f"_n_{s}": F.expr(" OR ".join(has(s, n) for n in NEGATIONS)) for s in sides}
    staged = staged.withColumns({**{f"_w_{s}": mask(s) for s in sides}, **negations, **{f"_d_{s}": _found(c, r"\b\d+\b") for s, c in sides.items()}})
    staged = staged.withColumns({"_only_a": F.expr("_w_a & ~_w_b"), "_only_b": F.expr("_w_b & ~_w_a")})
    crossed = " OR ".join(f"((_only_a & {bit[x]}L) <> 0L AND (_only_b & {bit[y]}L) <> 0L) OR ((_only_a & {bit[y]}L) <> 0L AND (_only_b & {bit[x]}L) <> 0L)" for x, y in OPPOSITES)
    antonyms = F.expr(f"_only_a <> 0L AND _only_b <> 0L AND ({crossed})")
    negation = F.expr(f"(_w_a & _w_b & {sum(bit[k] for k in NEGATABLE)}L) <> 0L AND _n_a <> _n_b")
    numbers = (F.size("_d_a") > 0) & (F.size("_d_b") > 0) & ((F.size(F.array_except("_d_a", "_d_b")) > 0) | (F.size(F.array_except("_d_b", "_d_a")) > 0))
    return staged.withColumn(name, antonyms | negation | numbers).select(*[c for c in kept if c != name], name)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, at least one, and none for an empty or null text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def usage_cost(prompt: Column, response: Column, model: Column, rates: list[tuple[str, str, str]], default: tuple[str, str]) -> Column:
    """Exact decimal cost from rates per thousand tokens; the first rate whose name contains, or is in, the model name.

    ``rates`` are ``(name, input, output)`` in order; nothing is divided, so the scale is the same for all rows.
    """

    def priced(rate_in: str, rate_out: str) -> Column:
        part = lambda text, rate: estimated_tokens(text).cast("decimal(12,0)") * F.lit(rate).cast("decimal(10,6)") * F.lit("0.001").cast("decimal(4,3)")
        return (part(prompt, rate_in) + part(response, rate_out)).cast("decimal(28,9)")

    lowered = F.lower(model)
    out = priced(*default)
    for name, rate_in, rate_out in reversed(rates):
        out = F.when((F.length(model) > 0) & (lowered.contains(name.lower()) | F.lit(name.lower()).contains(lowered)), priced(rate_in, rate_out)).otherwise(out)
    return out


def shortened(text: Column, width: int = 44) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)


def cleaned_lines(text: Column) -> Column:
    """Lines of a model's reply without its thinking, bullets, numbers and quotes; empty ones dropped."""
    plain = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    lines = F.transform(F.split(plain, r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^(?:[-*•]|\d+[.)])\s*", ""), r"^[\"'“”]+|[\"'“”]+$", ""))
    return F.filter(lines, lambda x: F.length(F.trim(x)) > 0)


def request_key(*parts: Column) -> Column:
    """Key under which an outside reply is kept: a digest of the request's fields in order of their names."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)


def rendered(action: Column, thing: Column) -> Column:
    return F.concat(F.concat_ws(" ", action, thing), F.lit("."))


def percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, 1)).otherwise(0.0)
