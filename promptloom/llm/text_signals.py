"""Language, sentence and placeholder signals used by the text operators."""

from __future__ import annotations

import json
import re
from collections import Counter

# Frequent words of the four languages, used to tell them apart.
COMMON_WORDS = {
    "en": (
        "the a an of to in is are was were be been for and or with this that these it its at by from should how what which who why when where whether please can could would may must "
        "you your we our us they their i me my not no do does did has have had will within into on as than then once before after about if so but because until only every each any some "
        "one more most keep there here let ask due using under without"
    ),
    "de": (
        "der die das den dem des ein eine einen einem einer eines und oder ist sind war wird werden wurde nicht kein keine mit für von vom zu zum zur auf aus an am im in bei beim nach bis "
        "über unter um wie was wer wann warum welche welcher welches wenn ob dass als auch nur noch schon so sich es er sie ihr wir uns ich du kann kannst soll muss hat haben bitte damit "
        "durch ohne aber niemand jede jeder unsere unser meist liegt"
    ),
    "fr": (
        "le la les l un une des du de d et ou est sont était a ont pas ne n que qui quoi quand comment pourquoi quel quelle combien si dans sur sous avec sans pour par chez depuis au aux "
        "ce cet cette ces se s son sa ses notre nos votre vos leur il elle on nous vous je j plus moins même mais donc ainsi toujours tout toute tous rien personne être avoir peut faut "
        "merci où"
    ),
    "es": (
        "el la los las un una unos unas de del al y o u es son está están era fue no ni que qué quién cuándo cuando cómo por porque para con sin en sobre entre hasta desde hace si sí ya más "
        "menos muy su sus se lo le les nuestro nuestra nuestros nuestras este esta estos esto ese esa pero también solo todo toda todos nada nadie ha han hay puede puedes hay después así "
        "otra otro conviene"
    ),
}
# Names of the languages in the languages themselves.
LANGUAGE_NAMES = {
    "en": "english englisch englische englischer anglais anglaise inglés inglesa ingles",
    "de": "german deutsch deutsche deutscher allemand allemande alemán alemana aleman",
    "fr": "french französisch französische französischer français française francais francés francesa frances",
    "es": "spanish spanisch spanische spanischer espagnol espagnole español española espanol",
}
# Whole replies that stand for a missing one.
PLACEHOLDERS = {
    "na", "n a", "none", "null", "nil", "nan", "tbd", "tba", "todo", "empty", "blank", "undefined", "missing", "placeholder", "pending", "no response", "no answer", "no reply", "no content",
    "no output", "not available", "response", "answer", "reply", "answer goes here", "insert answer here", "keine antwort", "leer", "sans réponse", "aucune réponse", "vide", "sin respuesta",
    "vacío", "k a", "s o",
}

_WORD_LANGS: dict[str, set[str]] = {}
for _lang, _words in COMMON_WORDS.items():
    for _word in _words.split():
        _WORD_LANGS.setdefault(_word, set()).add(_lang)
_NAME_LANG = {name: lang for lang, names in LANGUAGE_NAMES.items() for name in names.split()}
_LETTERS = re.compile(r"[^\W\d_]+")
_FENCED = re.compile(r"```.*?(?:```|\Z)", re.S)
_QUOTED = re.compile(r'"[^"\n]{0,80}"')
_MARKS = {"ñ": "es", "¿": "es", "¡": "es", "ß": "de", "ä": "de", "ö": "de", "ü": "de", "ç": "fr", "è": "fr", "ê": "fr", "à": "fr", "î": "fr", "û": "fr", "ù": "fr", "œ": "fr", "ó": "es", "í": "es", "ú": "es"}
_WORDISH = re.compile(r"[^\W_]+")


def language_scores(text: str) -> Counter:
    """Evidence per language: words known to few languages weigh more, letters with marks add a little."""
    scores: Counter = Counter()
    lowered = text.lower()
    for word in _LETTERS.findall(lowered):
        for lang in _WORD_LANGS.get(word, ()):
            scores[lang] += 1.0 / len(_WORD_LANGS[word])
    marked = Counter(_MARKS[c] for c in lowered if c in _MARKS)
    for lang, n in marked.items():
        scores[lang] += min(n, 4) * 0.5
    return scores


def language_of(text: str, *, least: float = 2.0, ratio: float = 1.5, prose_only: bool = False) -> str | None:
    """The language of a text, or None when the evidence is thin or mixed."""
    if prose_only:
        text = _QUOTED.sub(" ", _FENCED.sub(" ", text))
    ranked = language_scores(text).most_common(2)
    if not ranked or ranked[0][1] < least:
        return None
    if len(ranked) > 1 and ranked[0][1] < ratio * ranked[1][1]:
        return None
    return ranked[0][0]


def languages_named(text: str) -> set[str]:
    return {_NAME_LANG[w] for w in _LETTERS.findall(text.lower()) if w in _NAME_LANG}


def is_placeholder(text: str) -> bool:
    words = _WORDISH.findall(text.lower())
    return not words or (len(words) <= 4 and " ".join(words) in PLACEHOLDERS)


def parses_as_record(text: str) -> bool:
    try:
        json.loads(text)
    except ValueError:
        return False
    return True
