"""Problem 1: prompts whose stored response does not answer them, with the kind of defect.

All responses and all their sentences and list items are sorted and compared with their neighbours, so a
shortened text meets the longer one it was cut from, and an unfinished last sentence the sentence it began;
response lengths are counted to find length limits. Together they decide what is cut; end marks decide only where no
neighbour tells. Unfinished blocks and records, lists shorter than announced, placeholders, copies, refusals and
languages are settled pair by pair.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from promptloom.llm.text_signals import _FENCED, is_placeholder, language_of, languages_named, parses_as_record
from promptloom.runtime import materialize, salted_join

# Ways of saying that no answer will be given, by language.
REFUSAL_PATTERNS = {
    "en": [
        r"\bi(?:'m| am)? (?:can(?:'|no)t|can not|cannot|could not|won't|will not|must not|may not) (?:\w+ )?(?:help|comply|assist|answer|do|provide|discuss|share|be providing|give|offer|respond|reply|fulfil|support|continue)",
        r"\bi (?:must |have to |will |respectfully )?(?:decline|refuse)\b", r"\bso i decline\b", r"\bi(?:'m| am) (?:not|un) ?able to (?:help|comply|assist|answer|provide|do|respond|discuss|share|give)",
        r"\bsomething i am not able to do", r"\bi don't have the ability to", r"\bi(?:'m| am) barred from", r"\bi have to stay silent\b", r"\bnot possible for me\b",
        r"\b(?:not be|isn't|is not) appropriate for me\b", r"\b(?:falls|is|lies) outside (?:of )?what i (?:may|can|am)", r"\bi'm (?:not )?allowed to discuss", r"\bi am not allowed\b",
        r"\b(?:instructions|guidelines|rules|policy|policies)\b.{0,40}\b(?:do not permit|don't permit|rule this out|forbid|prohibit|do not allow|don't allow)", r"\bagainst my (?:guidelines|policy|instructions)",
        r"\bi(?:'d| would) rather not\b", r"\bi prefer not to\b",
    ],
    "de": [
        r"\bkann ich (?:\w+ ){0,3}nicht (?:helfen|antworten|beantworten|weiterhelfen|sagen|geben|tun)", r"\bnicht in der lage\b", r"\bdarf ich (?:\w+ ){0,3}nicht\b", r"\bmöchte ich keine antwort geben",
        r"\bäußere ich mich nicht", r"\bich (?:kann|darf|werde|möchte) (?:\w+ ){0,4}(?:nicht|keine)\b", r"\bnicht gestattet\b", r"\bmir (?:ist )?(?:es )?(?:nicht erlaubt|untersagt|nicht möglich)", r"\blehne ich ab\b",
        r"\baußerhalb dessen, was ich", r"\bgebe ich keine\b", r"\bmuss ich ablehnen\b",
    ],
    "fr": [
        r"\bje ne (?:peux|puis|suis|souhaite|veux|saurais) pas\b", r"\bm'est impossible\b", r"\bje n'y suis pas autorisé", r"\bm'est interdit", r"\bje préfère ne pas\b", r"\bsort de ce que je\b", r"\bje ne répondrai pas\b",
        r"\bje dois (?:refuser|décliner)\b", r"\bhors de ce que je\b", r"\bdépasse ce que je\b", r"\bje refuse\b",
    ],
    "es": [
        r"\bno puedo (?:ayudar|responder|contestar|hacer|dar|ofrecer|atender)", r"\bno soy capaz\b", r"\bprefiero no\b", r"\bfuera de lo que puedo\b", r"\bno me (?:está|es) (?:permitido|posible)", r"\bno se me permite\b",
        r"\bno estoy autorizad", r"\bdebo (?:rechazar|negarme)\b", r"\bme niego\b", r"\btengo prohibido\b", r"\bno voy a (?:responder|contestar)",
    ],
}
# Sentences around a refusal that carry no answer.
SOFTENER_PATTERNS = [
    r"^(?:i'm |i am |we are )?(?:so |very )?sorry\b", r"^apolog", r"^regrettably", r"^unfortunately\W*$", r"^hmm\b", r"^\W*note\W*$", r"^thank(?:s| you)\b", r"^as an ai\b", r"^let us talk about", r"^let's talk about", r"^please ask (?:a|an|someone|your)\b",
    r"\banything (?:different|else) i (?:could|can) do\b", r"\bi hope you understand\b", r"^i must be honest\b", r"\bconsult (?:a|an) \w+", r"\bthanks for (?:reaching out|your|the|asking)", r"^(?:gern|gerne) ", r"^danke\b", r"^leider\b", r"^tut mir leid\b",
    r"\betwas anderes tun\b", r"^bitte (?:frag|frage|fragen|wende|wenden)\b", r"^désolé", r"^malheureusement", r"^merci (?:de|pour) (?:votre|ta|ton|la|cette)\b", r"\bautre chose\b", r"^lo siento", r"^por desgracia", r"^gracias por\b", r"\botra cosa\b", r"^lamento",
    r"\bautre sujet\b", r"\botro tema\b", r"\banderes thema\b", r"\bqualified person\b", r"\bfachperson\b", r"\bpersona (?:cualificada|experta)\b", r"\bpersonne (?:qualifiée|compétente)\b", r"^(?:sprechen|reden) wir\b", r"^parlons\b", r"^hablemos\b", r"^pregunta a\b",
    r"\bespero que lo entienda", r"\bich hoffe\b", r"\bj'espère\b", r"\bespero que\b", r"\bverständnis\b",
]
# Words that may frame a repeated prompt without adding to it.
FRAME_WORDS = set(
    "you your asked ask asking question request prompt was is the that this here are as follows follow said wrote wanted know me i to about q a re du deine frage war ist das hast gefragt die lautet also "
    "votre ta question est voilà tu as demandé vous avez c la tu pregunta es esta has preguntado su preguntaste esa aquí está su la".split()
)
_ABBREVIATION_END = re.compile(r"(?:\b(?:nos|no|e\.g|i\.e|z|z\. ?b|p|p\. ?ej|p\. ?ex|ca|bzw|approx|vs|etc|ej|ex|mr|dr|st)\.|\b(?:is|about|of|until|than) \d+\.)$", re.I)
_MARKER_END = re.compile(r"(?:\[(?:cut|truncated|more|continued|gekürzt|…)\]?|\((?:cont|continued|cut|more|truncated|suite|sigue|forts)\w*\.?\)?|<(?:cut|truncated|eot|more)>?)$", re.I)
_TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_PICTURE_END = re.compile(r"(?:[\U0001F300-\U0001FAFF☀-➿]️?|[;:]-?[)(DP])$")
_ASIDE_END = re.compile(r"\([^()]{2,60}[.!]?\)$")
_SIGNATURE = re.compile(r"^(?:[—–-]{1,2} ?\S|(?:kind|best) regards|with best wishes|mit freundlichen|cordialement|saludos)", re.I)
_ITEM = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+(\S.*)$")
_BARE_MARKER = re.compile(r"^(?:[-*•–]|(\d{1,3})[.)])$")
_ITEM_START = re.compile(r"^\s*(?:[-*•–]|\d{1,3}[.)])\s+", re.M)
_TOKENS = re.compile(r"[^\W_]+")
_SENTENCE_SPLIT = re.compile(r"(?<=[.!?:])\s+|\n+")
_LIST_COUNT = re.compile(r"\b\d+ (?:\w+ )?(?:points?|things?|parts?|steps?|reasons?|punkte|schritte|gründe|étapes|raisons|puntos|pasos|razones)\b", re.I)
_INNER_END = re.compile(r"(?<=[.!?])[\"'”’»)\]*_]*\s+|(?<=[。！？])")
_END_MARKS = re.compile(r"[.!?。！？][\"'”’»)\]*_]*$")
_DIGITS = re.compile(r"\d+")
_TRAILING = ("…", "...", ",", ";", ":", "-", "–")
_LOOSE_WORDS = set("the a an of to in for and or with at by from is are that this than der die das und oder mit für von zu auf bei le la les des de du et ou pour dans que el los las y o del con por para que un una une ein eine".split())
_REFUSAL_RE = {lang: re.compile("|".join(f"(?:{p})" for p in patterns)) for lang, patterns in REFUSAL_PATTERNS.items()}
_SOFTENER_RE = re.compile("|".join(f"(?:{p})" for p in SOFTENER_PATTERNS))

#: Words a reply without end mark has at least if it counts as a broken sentence when no neighbour tells.
SHORT_REPLY_WORDS = 6
#: Words a short reply or list item needs before a longer neighbour proves that it was cut, at a word's end and inside a word.
NEIGHBOUR_WORDS = 4
NEIGHBOUR_WORDS_INSIDE = 3
#: White space at the end of a response, which does not make another one.
_WHITE = " \t\n\r\f\v\u00a0\u2028\u2029\u3000"


def is_copy(prompt: str, response: str) -> bool:
    """The response repeats the prompt, whole or nearly, and adds at most framing words."""
    asked = set(_TOKENS.findall(prompt.casefold()))
    said = set(_TOKENS.findall(response.casefold()))
    if not asked or not said:
        return False
    if len(said & asked) < 0.9 * len(asked):
        return False
    extra = said - asked - FRAME_WORDS
    return len(extra) <= max(0, len(asked) // 20)


def is_refusal(response: str) -> bool:
    """At least one sentence declines and no other sentence says anything of its own."""
    declined = False
    for sentence in _SENTENCE_SPLIT.split(response.replace("’", "'").casefold().replace("**", "")):
        sentence = sentence.strip(" \t-–—*_>\"'")
        if not _TOKENS.search(sentence):
            continue
        if any(r.search(sentence) for r in _REFUSAL_RE.values()):
            declined = True
        elif not _SOFTENER_RE.search(sentence):
            return False
    return declined


def _announced(line: str) -> int | None:
    """The number of items that the last sentence before a list announces: its only number, before a colon or with what it counts."""
    sentence = _INNER_END.split(line.strip())[-1] if not line.rstrip().endswith(".") else _INNER_END.split(line.strip().rstrip("."))[-1] + "."
    numbers = re.findall(r"(?<![\w.,-])\d+(?![\w.,-]|:\d)", sentence)
    if len(numbers) != 1 or not int(numbers[0]) or not (sentence.endswith(":") or (sentence.endswith(".") and _LIST_COUNT.search(sentence))):
        return None
    return int(numbers[0])


def _balanced(text: str) -> bool:
    """Every bracket and string that a record opens is closed; brackets inside strings do not count."""
    expected: list[str] = []
    quoted = escaped = False
    for c in text:
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{[":
            expected.append("}" if c == "{" else "]")
        elif c in "}]" and expected and expected[-1] == c:
            expected.pop()
    return not expected and not quoted


def _listed(text: str) -> tuple[list[str], list[int], int | None]:
    """Lines that are not blank, positions of the list items among them, and the number of items announced before."""
    lines = [line for line in text.split("\n") if line.strip()]
    items = [i for i, line in enumerate(lines) if _ITEM.match(line)]
    return lines, items, _announced(lines[items[0] - 1].strip()) if items and items[0] > 0 else None


def tail_state(response: str) -> str:
    """How a response ends: ``complete``, ``broken`` (stops before it is done), ``unended`` (a sentence without end mark,
    whole or cut), or ``open`` (a short reply or a list without end marks, whole or cut)."""
    text = response.strip()
    if is_placeholder(text):
        return "complete"
    if text.count("```") % 2:
        return "broken"
    if text[:1] in "{[" and re.match(r'[{\[]\s*(?:["{\[\d]|$)', text):
        return "complete" if parses_as_record(text) or (text[-1:] in "}]" and _balanced(text)) else "broken"
    if text.endswith("```"):
        return "complete"
    if _MARKER_END.search(text):
        return "broken"
    lines, items, announced = _listed(text)
    if announced is not None and len(items) < announced:
        return "broken"
    last = lines[-1].strip()
    bare = _BARE_MARKER.match(last) if len(lines) > 1 else None
    if bare and (items or bare[1] in (None, "1")):
        return "broken"  # the next item was begun; another number alone on its line may be the answer
    if not items and last.endswith(":"):
        return "broken"
    if not items and _announced(last) and _LIST_COUNT.search(last) and len(_INNER_END.split(last)) == 1:
        return "broken"
    if items and items[-1] == len(lines) - 1:
        ended = [bool(_TERMINAL.search(lines[i].strip())) for i in items]
        if ended[-1]:
            return "broken" if _ABBREVIATION_END.search(last) else "complete"
        return "unended" if any(ended[:-1]) or last.endswith((",", "-", "…", "...")) else "open"
    if _PICTURE_END.search(text) or (len(lines) > 1 and _SIGNATURE.match(last)):
        return "complete"
    if _ASIDE_END.search(text) and _TERMINAL.search(text[: text.rfind("(")].strip() or "."):
        return "complete"
    if text.endswith(("…", "...")):
        return "unended"
    if _TERMINAL.search(text):
        return "broken" if _ABBREVIATION_END.search(text) else "complete"
    words = text.split()
    if len(words) > SHORT_REPLY_WORDS or words[-1].endswith((",", ";", "-", "–")) or words[-1].lower() in _LOOSE_WORDS:
        return "unended"
    return "open"


def segments(text: str) -> list[tuple[str, bool]]:
    """Sentences and list items of a text without markers and end marks, digits all alike, and whether each was ended.

    One that another follows, or that has an end mark, is ended; dots that trail off end nothing. Records and blocks of
    code have no sentences.
    """
    if text[:1] in ("{", "["):
        return []
    found: list[str] = []
    for line in _FENCED.sub("\n", text).split("\n"):
        line = _ITEM_START.sub("", line).strip()
        if line:
            found.extend(part for part in _INNER_END.split(line) if part)
    out = []
    for i, part in enumerate(found):
        bare = _END_MARKS.sub("", part)
        trails = part.endswith(_TRAILING)
        if bare:
            out.append((_DIGITS.sub("0", bare.rstrip(".…") if trails else bare), not trails and (i < len(found) - 1 or bare != part)))
    return out


def _pair_verdict(prompt: str | None, response: str | None) -> tuple[str | None, str]:
    """The defect that a pair shows by itself, and the state in which its response ends."""
    if response is None or is_placeholder(response):
        return "empty", "complete"
    prompt = prompt or ""
    if is_copy(prompt, response):
        return "copied", "complete"
    if is_refusal(response):
        return "refusal", "complete"
    state = tail_state(response)
    if state == "broken":
        return "truncated", state
    spoken = language_of(response, prose_only=True)
    if spoken is not None:
        asked = language_of(prompt, least=1.5, ratio=1.2)
        if asked is not None and spoken != asked and spoken not in languages_named(prompt):
            return "language", state
    return None, state


def local_verdict(prompt: str | None, response: str | None) -> str | None:
    """The defect that a pair shows by itself, ``open`` if the corpus has to decide, None if it has none."""
    defect, state = _pair_verdict(prompt, response)
    return defect or ("open" if state in ("open", "unended") else None)


_JUDGED = "id string, defect string, state string, response string, tail string, text string, asks boolean, whole boolean"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts with what the corpus has to decide (``response`` and its last segment ``tail``), and the texts to be sorted.

    ``text`` is a response (first letter r) or a segment (s), each once a batch; ``asks`` tells that its end is in
    question, ``whole`` that it was seen ended.
    """
    for batch in batches:
        rows: list[tuple] = []
        texts: dict[str, list[bool]] = {}
        for key, prompt, response in zip(*(batch.column(i).to_pylist() for i in range(3))):
            defect, state = _pair_verdict(prompt, response)
            waits = state in ("open", "unended")
            parts: list[tuple[str, bool]] = []
            asks = False
            if defect not in ("empty", "copied", "refusal"):
                trimmed = response.rstrip(_WHITE)
                parts = segments(trimmed)
                if state == "unended" and trimmed.endswith(_TRAILING):
                    state = "trailing"
                asks = waits and bool(parts) and len(parts[-1][0].split()) >= NEIGHBOUR_WORDS_INSIDE and not (state == "open" and parts[-1][0].endswith("0"))  # a number may be whole
                for i, (part, ended) in enumerate(parts):
                    seen = texts.setdefault("s" + part, [False, False])
                    seen[0] |= asks and i == len(parts) - 1
                    seen[1] |= ended
                texts.setdefault("r" + trimmed, [False, False])[0] |= state == "open"
            if defect or waits:
                rows.append((key, defect, state, trimmed if waits else None, "s" + parts[-1][0] if asks else None, None, None, None))
        rows.extend((None, None, None, None, None, text, *flags) for text, flags in texts.items())
        kinds = [pa.string()] * 6 + [pa.bool_()] * 2
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["id", "defect", "state", "response", "tail", "text", "asks", "whole"])


def _continued(short: str, text: str) -> str | None:
    """How a text goes on where one that begins it stops: ``word`` or ``sentence`` if in the middle of it, ``cut`` for a response."""
    if short[0] == "r":
        return "cut" if _cut_by(short[1:], text[1:]) else None
    rest = text[len(short) :]
    words = len(short.split())
    if short[-1].isalnum() and rest[0].isalnum():
        return "word" if words >= NEIGHBOUR_WORDS_INSIDE else None
    return "sentence" if words >= NEIGHBOUR_WORDS and rest[0].isspace() and rest[1:2].isalnum() else None


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted texts against later ones: those in question that begin the current one are kept until one goes on in their middle."""
    begun: list[str] = []
    for batch in batches:
        out: list[tuple[str, str]] = []
        for text, asks, whole in zip(*(batch.column(i).to_pylist() for i in range(1, 4))):
            while begun and not text.startswith(begun[-1]):
                begun.pop()
            if begun:
                proofs = [(short, _continued(short, text)) for short in begun if short != text]
                out.extend(x for x in proofs if x[1])
                begun = [short for short, proof in proofs if not proof]
            if asks and whole:
                out.append((text, "whole"))
            elif asks:
                begun.append(text)
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], ["text", "proof"])


def _cut_by(short: str, long: str) -> bool:
    """``long`` goes on in the middle of what ``short`` was saying."""
    if tail_state(short) == "complete":
        return False
    rest = long[len(short) :]
    if _DIGITS.sub("0", short) == _DIGITS.sub("0", long):
        return False
    if rest[:1].isspace() and "\n" in rest[: len(rest) - len(rest.lstrip())]:
        _, items, announced = _listed(short)
        if announced is not None and len(items) >= announced:
            return False
    inside_word = short[-1:].isalpha() and rest[:1].isalpha()
    return inside_word or len(_ITEM_START.sub("", short).split()) >= NEIGHBOUR_WORDS


def sorted_proofs(texts: DataFrame, *, rows_per_bucket: int = 25_000, split_sample: int = 20_000, split_bytes: int = 64_000_000) -> DataFrame:
    """``(text, proof)`` of the texts in question: ``whole``, or how a neighbour in sorted order goes on.

    ``texts`` is ``(text, asks, whole)``. Sorted buckets are cut at quantiles of a sample of whole keys of at most about
    ``split_sample`` rows and ``split_bytes`` bytes, which only places the cuts; a text that begins the next bucket's
    first key also goes there, so every text meets all that it begins.
    """
    distinct = materialize(texts.groupBy("text").agg(F.max("asks").alias("asks"), F.max("whole").alias("whole")))
    total, size = distinct.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-total // rows_per_bucket))
    splits: list[str] = []
    if n > 1:
        share = min(1.0, split_sample / total, split_bytes / max(1, size))
        grid = 1_000_000_000
        sample = sorted(r[0] for r in distinct.where(F.pmod(F.xxhash64("text"), F.lit(grid)) < int(share * grid) + 1).select("text").collect())
        splits = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, rows = [], []
            for row, text in enumerate(batch.column(0).to_pylist()):
                b = bisect.bisect_right(splits, text)
                buckets.append(b)
                rows.append(row)
                while b < len(splits) and splits[b].startswith(text):
                    b += 1
                    buckets.append(b)
                    rows.append(row)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *(batch.column(i).take(at) for i in range(3))], ["bucket", "text", "asks", "whole"])

    ordered = distinct.mapInArrow(placed, "bucket int, text string, asks boolean, whole boolean").repartitionById(len(splits) + 1, F.col("bucket")).sortWithinPartitions("bucket", "text")
    return ordered.mapInArrow(_neighbours, "text string, proof string").groupBy("text").agg(F.min("proof").alias("proof"))


def cut_responses(responses: DataFrame, *, rows_per_bucket: int = 25_000, split_sample: int = 20_000) -> DataFrame:
    """Distinct unfinished responses that another one, later in sorted order, continues. ``responses`` has one column ``response``."""
    texts = responses.where("response is not null").select(F.concat(F.lit("r"), "response").alias("text"), F.lit(True).alias("asks"), F.lit(False).alias("whole"))
    found = sorted_proofs(texts, rows_per_bucket=rows_per_bucket, split_sample=split_sample)
    return found.select(F.expr("substring(text, 2)").alias("response"))


def spiked_lengths(responses: DataFrame, *, window: int = 8, times: float = 6.0, least: int = 20) -> DataFrame:
    """``(model, len)`` at which far more responses of a model end without an end mark than at the lengths around them.

    A limit leaves few responses that are longer, so a length that many exceed is none. ``responses`` is
    ``(response)`` or ``(model, response)``; a missing or null model is one model of its own.
    """
    model = F.coalesce(F.col("model").cast("string"), F.lit("")) if "model" in responses.columns else F.lit("")
    sized = responses.where(F.col("response").isNotNull()).select(model.alias("model"), F.length("response").alias("len"), (~F.rtrim("response").rlike(r"[.!?`}\])”\"»]$")).cast("int").alias("open"))
    counts = sized.groupBy("model", "len").agg(F.count("*").alias("all"), F.sum("open").alias("n"))
    after = W.Window.partitionBy("model").orderBy(F.desc("len")).rowsBetween(W.Window.unboundedPreceding, -1)
    ranked = counts.withColumn("longer", F.coalesce(F.sum("all").over(after), F.lit(0)))
    near = counts.where("n > 0").select("model", F.explode(F.sequence(F.col("len") - window, F.col("len") + window)).alias("at"), F.col("len").alias("src"), F.col("n").alias("m")).where("at <> src")
    around = near.groupBy("model", F.col("at").alias("len")).agg((F.sum("m") / (2.0 * window)).alias("usual"))
    joined = ranked.join(around, ["model", "len"], "left")
    return joined.where((F.col("n") >= least) & (F.col("n") > times * F.coalesce("usual", F.lit(0.0))) & (F.col("longer") <= times * F.col("n"))).select("model", "len")


def _base(entries: DataFrame, id_col: str, prompt_col: str, response_col: str) -> DataFrame:
    model = F.col("model").cast("string") if "model" in entries.columns else F.lit(None).cast("string")
    return entries.select(F.col(id_col).cast("string").alias("id"), F.col(prompt_col).cast("string").alias("prompt"), F.col(response_col).cast("string").alias("response"), model.alias("model"))


def staged_defects(entries: DataFrame, *, id_col: str = "id", prompt_col: str = "prompt", response_col: str = "response") -> DataFrame:
    """``(id, defect, stage)``: like :func:`pair_defects`, with the stage that decided.

    ``neighbour`` (a longer text in sorted order), ``length`` (a length limit), ``pair`` (the pair by itself) or
    ``end mark`` (a sentence without end mark that no neighbour tells about).
    """
    base = _base(entries, id_col, prompt_col, response_col)
    judged = materialize(base.select("id", "prompt", "response").mapInArrow(_verdicts, _JUDGED))
    verdicts = judged.where("text is null")
    settled = verdicts.where("response is null").select("id", "defect", F.lit("pair").alias("stage"))
    proofs = materialize(sorted_proofs(judged.where("text is not null").select("text", "asks", "whole")))
    of_response = proofs.where("text like 'r%'").select(F.expr("substring(text, 2)").alias("response"), F.col("proof").alias("response_proof"))
    waiting = verdicts.where("response is not null").select("id", "defect", "state", "response", F.col("tail").alias("text"))
    late = salted_join(salted_join(waiting, proofs, ["text"], how="left"), of_response, ["response"], how="left")
    lengths = base.select(F.coalesce("model", F.lit("")).alias("model"), F.rtrim(F.col("response"), F.lit(_WHITE)).alias("response"))
    spikes = [(r.model, r.len) for r in spiked_lengths(lengths.distinct()).collect()]  # copies of one text are no limit
    if spikes:
        limits = F.broadcast(base.sparkSession.createDataFrame(spikes, "model string, _len int"))
        at_limit = lengths.withColumn("_len", F.length("response")).join(limits, ["model", "_len"], "left_semi").select("response").distinct().withColumn("_limit", F.lit(True))
        late = late.join(at_limit, "response", "left")
    else:
        late = late.withColumn("_limit", F.lit(None).cast("boolean"))
    proof, open_end = F.col("proof"), F.col("state").isin("unended", "trailing")
    seen_whole = F.coalesce((F.col("proof") == "whole") & (F.col("state") == "unended"), F.lit(False))
    cut = proof.isin("word", "sentence") | F.col("response_proof").isNotNull()
    stage = F.when(cut, "neighbour").when(F.col("_limit"), "length").when(open_end & ~seen_whole, "end mark")
    decided = late.select("id", F.when(stage.isNotNull(), "truncated").otherwise(F.col("defect")).alias("defect"), F.coalesce(stage, F.lit("pair")).alias("stage"))
    return settled.unionByName(decided.where("defect is not null"))


def pair_defects(entries: DataFrame, *, id_col: str = "id", prompt_col: str = "prompt", response_col: str = "response") -> DataFrame:
    """One row ``(id, defect)`` for each entry whose response is defective.

    ``defect`` is one of ``empty``, ``copied``, ``refusal``, ``truncated``, ``language``; the first that holds,
    in this order, is given. Null or blank responses are ``empty`` whatever the prompt; a null prompt leaves
    only the rules that look at the response alone. Repeated rows come out as often as they come in. An empty
    table gives an empty result; further columns of any name are ignored, but ``model``, where there is one, tells
    whose length limits apply.
    """
    return staged_defects(entries, id_col=id_col, prompt_col=prompt_col, response_col=response_col).select("id", "defect")
