"""SQL of the core queries for an independent engine; written from the definitions, not from the Spark plans."""

from __future__ import annotations

from promptloom.functions import mutate as U
from promptloom.functions import vectors as V

ORACLE_SQL: dict[str, str] = {}

# Fixed values of the definitions, stated here once more so that the SQL does not depend on the code it checks.
DRUGS = [
    "ibuprofen", "acetaminophen", "paracetamol", "aspirin", "naproxen", "amoxicillin", "penicillin", "metformin", "lisinopril", "atorvastatin", "simvastatin", "omeprazole", "prednisone", "warfarin",
    "clopidogrel", "sertraline", "fluoxetine", "alprazolam", "diazepam", "lorazepam", "insulin", "metoprolol", "amlodipine", "losartan", "gabapentin", "tramadol", "oxycodone", "morphine", "codeine",
    "hydroxychloroquine", "ivermectin", "remdesivir", "dexamethasone",
]
TEMPORAL_WORDS = [
    "today", "yesterday", "tomorrow", "now", "current", "currently", "recent", "recently", "latest", "last", "previous", "prior", "next", "upcoming", "this", "past", "historical", "annual",
    "monthly", "weekly", "daily",
]
HARMLESS_TEMPORAL = [
    ("current", "recent"), ("recent", "latest"), ("current", "latest"), ("last", "recent"), ("last", "latest"), ("recent", "most"), ("current", "most"),
]
PRIVILEGES = [
    "administrator", "admin", "root", "superuser", "sudo", "system", "service", "privileged", "elevated", "owner", "manager", "guest", "anonymous",
]
POSSESSIVES = [
    "my", "our", "your",
]
NOT_NAMES = [
    "the", "an", "a", "in", "on", "at", "for", "of", "to", "and", "or", "but", "is", "are", "was", "were", "be", "i", "my", "this", "that", "it", "its", "by", "as", "do", "can", "how", "what",
    "give", "me", "us", "list", "provide", "q", "mr", "dr", "ms", "tell", "show", "get", "find", "describe", "explain", "summarize", "summarise", "analyze", "analyse", "compare", "calculate",
    "generate", "write", "create", "make", "help", "please", "need", "want", "looking",
]
OPPOSITES = [
    ("approve", "deny"), ("approve", "reject"), ("allow", "block"), ("allow", "deny"), ("increase", "decrease"), ("raise", "lower"), ("buy", "sell"), ("enable", "disable"), ("grant", "revoke"),
    ("grant", "restrict"), ("release", "hold back"), ("release", "withhold"), ("whitelist", "blacklist"), ("encrypt", "decrypt"), ("open", "close"), ("start", "stop"), ("keep", "sell"),
    ("keep", "liquidate"), ("deposit", "withdraw"), ("backup", "delete"), ("backup", "destroy"), ("public", "private"), ("external", "internal"), ("personal", "business"), ("personal", "external"),
    ("cryptocurrency", "deposit"), ("crypto", "fiat"), ("legitimate", "fraudulent"), ("turn on", "turn off"), ("require", "allow"), ("require", "permit"), ("complex", "simple"), ("complex", "basic"),
]
NEGATABLE = [
    "required", "safe", "valid", "active", "legitimate", "binding", "enforceable", "malignant", "benign",
]
NEGATIONS = [
    "not", "no", "never", "don't", "cannot", "can't", "refuse",
]
MONTHS = [
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "oct", "nov",
    "dec",
]
DAYS = [
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "mon", "tue", "wed", "thu", "fri", "sat", "sun",
]
ORDINALS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
]
DETECTORS = [
    "quarter", "year", "ordinal", "drug", "numeric", "version", "month", "day", "temporal", "privilege", "proper_noun",
]
QUARTER = r"(?i)\b(?:Q[1-4]|quarter\s+[1-4]|[1-4](?:st|nd|rd|th)\s+quarter)\b"
NUMBER = r"\b\d+(?:\.\d+)?[a-zA-Z]{0,5}"
VERSION = r"(?i)\bv?\d+(?:\.\d+){1,3}\b"


_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _domain(c: str) -> str:
    return f"lower(regexp_replace({_strip(c)}, '[ _]', '-', 'g'))"


def _found(c: str, pattern: str) -> str:
    return f"list_distinct(regexp_extract_all(coalesce({c}, ''), {_q(pattern)}))"


def _except(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def _intersect(a: str, words) -> str:
    return f"list_filter({a}, lambda x: list_contains({_list(words)}, x))"


def _tokens(c: str) -> str:
    return f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-zA-Z0-9.'']+'))"


def _fold(items: str, how: str) -> str:
    return f"list_distinct(list_transform({items}, lambda y: {how}(y)))"


_DATED = {
    "ordinal": r"(?i)\b(?:" + "|".join(ORDINALS) + r"|[1-9][0-9]*(?:st|nd|rd|th))\b", "version": VERSION, "month": r"(?i)\b(?:" + "|".join(MONTHS) + r")\b", "day": r"(?i)\b(?:" + "|".join(DAYS) + r")\b",
}


def _set_pair(detector: str, side: str) -> str:
    if detector == "quarter":
        return _fold(_found(side, QUARTER), "upper")
    if detector == "year":
        return _found(side, r"\b(?:19|20)\d{2}\b")
    if detector == "numeric":
        return f"list_filter({_fold(_found(side, NUMBER), 'lower')}, lambda z: NOT regexp_matches(z, '^(?:19|20)\\d{{2}}$'))"
    return _fold(_found(side, _DATED[detector]), "lower")


def _sets(detector: str, a: str, b: str) -> tuple[str, str]:
    if detector == "drug":
        return _intersect(_tokens(a), DRUGS), _intersect(_tokens(b), DRUGS)
    if detector == "temporal":
        return _intersect(_tokens(a), TEMPORAL_WORDS), _intersect(_tokens(b), TEMPORAL_WORDS)
    if detector == "privilege":
        return _intersect(_tokens(a), PRIVILEGES), _intersect(_tokens(b), PRIVILEGES)
    if detector == "proper_noun":
        names = lambda c: f"list_filter(list_distinct(list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Z][a-z]+|[A-Z]+'), lambda y: lower(y))), lambda z: length(z) > 2 AND NOT list_contains({_list(NOT_NAMES)}, z))"
        return names(a), names(b)
    return _set_pair(detector, a), _set_pair(detector, b)


def _entity(detector: str, rows: str) -> str:
    """Rows ``(key, token_a, token_b)`` for which the detector fires on ``rows(key, a, b)``."""
    sa, sb = _sets(detector, "a", "b")
    own = f"SELECT *, {_except('sa', 'sb')} AS oa, {_except('sb', 'sa')} AS ob FROM (SELECT key, a, b, {sa} AS sa, {sb} AS sb FROM {rows})"
    some = "len(sa) > 0 AND len(sb) > 0 AND (len(oa) > 0 OR len(ob) > 0)"
    if detector == "drug":
        return f"SELECT key, list_min(oa) AS token_a, list_min(ob) AS token_b FROM ({own}) WHERE {some}"
    if detector == "temporal":
        harmless = _list([" ".join(sorted(p)) for p in HARMLESS_TEMPORAL])
        pair = "least(list_min(oa), list_min(ob)) || ' ' || greatest(list_min(oa), list_min(ob))"
        return f"SELECT key, list_min(oa) AS token_a, list_min(ob) AS token_b FROM ({own}) WHERE len(oa) > 0 AND len(ob) > 0 AND NOT list_contains({harmless}, {pair})"
    if detector == "proper_noun":
        return f"SELECT key, list_min(oa) AS token_a, list_min(ob) AS token_b FROM ({own}) WHERE len(oa) > 0 AND len(ob) > 0"
    if detector == "privilege":
        mine = lambda c: f"len({_intersect(_tokens(c), POSSESSIVES)}) > 0"
        return (
            f"SELECT key, CASE WHEN {some} THEN list_min(oa) WHEN len(sa) > 0 THEN list_min(sa) ELSE 'user' END AS token_a, CASE WHEN {some} THEN list_min(ob) WHEN len(sa) > 0 THEN 'user' ELSE list_min(sb) END AS token_b "
            f"FROM ({own}) WHERE ({some}) OR (len(sa) > 0 AND len(sb) = 0 AND {mine('b')}) OR (len(sb) > 0 AND len(sa) = 0 AND {mine('a')})"
        )
    return f"SELECT key, coalesce(list_min(oa), list_min(sa)) AS token_a, coalesce(list_min(ob), list_min(sb)) AS token_b FROM ({own}) WHERE {some}"


def _first_entity(rows: str) -> str:
    """``(key, detector, token_a, token_b)`` of the first detector in order, for the keys where one fires."""
    parts = " UNION ALL ".join(f"SELECT key, {i} AS ord, {_q(d)} AS detector, token_a, token_b FROM ({_entity(d, rows)})" for i, d in enumerate(DETECTORS))
    return f"SELECT key, detector, token_a, token_b FROM ({parts}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1"


def _opposite(a: str, b: str) -> str:
    la, lb = f"lower(coalesce({a}, ''))", f"lower(coalesce({b}, ''))"
    has = lambda t, w: f"contains({t}, {_q(w)})"
    pairs = " OR ".join(f"((({has(la, x)} AND {has(lb, y)}) OR ({has(la, y)} AND {has(lb, x)})) AND NOT ({has(la, x)} AND {has(lb, x)}) AND NOT ({has(la, y)} AND {has(lb, y)}))" for x, y in OPPOSITES)
    negated = lambda t: "(" + " OR ".join(has(t, n) for n in NEGATIONS) + ")"
    shared = " OR ".join(f"({has(la, k)} AND {has(lb, k)})" for k in NEGATABLE)
    da, db = _found(a, r"\b\d+\b"), _found(b, r"\b\d+\b")
    numbers = f"(len({da}) > 0 AND len({db}) > 0 AND list_sort({da}) <> list_sort({db}))"
    return f"({pairs} OR (({shared}) AND {negated(la)} <> {negated(lb)}) OR {numbers})"


_GOLD_ROWS = "(SELECT pair_id AS key, prompt_a AS a, prompt_b AS b FROM equivalence_gold)"
_RENDERED = {
    "quarter": "'Summary for Q' || quarter(o_orderdate) AS a, 'Summary for quarter ' || (o_custkey % 4 + 1) AS b",
    "year": "'Total for ' || year(o_orderdate) AS a, 'Total for ' || (year(o_orderdate) + o_custkey % 2) AS b",
    "ordinal": "'Send the ' || (['first', 'second', 'third', '4th', '21st'])[o_orderkey % 5 + 1] || ' copy' AS a, 'Send the ' || (['first', 'second', 'third', '4th', '21st'])[o_custkey % 5 + 1] || ' copy' AS b",
    "drug": "'Dose of ' || (['ibuprofen', 'Warfarin', 'insulin', 'metformin', 'water', 'tea'])[o_orderkey % 6 + 1] AS a, 'Dose of ' || (['ibuprofen', 'Warfarin', 'insulin', 'metformin', 'water', 'tea'])[o_custkey % 6 + 1] AS b",
    "temporal": "'Show the ' || (['current', 'latest', 'previous', 'Next', 'recent', 'full'])[o_orderkey % 6 + 1] || ' report' AS a, 'Show the ' || (['current', 'latest', 'previous', 'Next', 'recent', 'full'])[o_custkey % 6 + 1] || ' report' AS b",
    "privilege": "(['Reset my password', 'Reset the admin password', 'Reset the Guest password', 'Reset the door'])[o_orderkey % 4 + 1] AS a, (['Reset my password', 'Reset the admin password', 'Reset the Guest password', 'Reset the door'])[o_custkey % 4 + 1] AS b",
}
for _d in DETECTORS:
    _gold = "SELECT 'g' || pair_id AS key, prompt_a AS a, prompt_b AS b FROM equivalence_gold"
    _rows = f"({_gold} UNION ALL SELECT 'o' || o_orderkey AS key, {_RENDERED[_d]} FROM orders)" if _d in _RENDERED else f"({_gold})"
    ORACLE_SQL[f"entity_{_d}"] = f"SELECT key AS pair_id, token_a, token_b FROM ({_entity(_d, _rows)})"
ORACLE_SQL["entity_change"] = f"SELECT g.pair_id, detector, token_a, token_b FROM equivalence_gold g LEFT JOIN ({_first_entity(_GOLD_ROWS)}) e ON e.key = g.pair_id"
ORACLE_SQL["opposite_action"] = f"SELECT pair_id, {_opposite('prompt_a', 'prompt_b')} AS opposite FROM equivalence_gold"

_UNIT = "list_transform({v}::DOUBLE[], lambda x: x / sqrt(list_dot_product({v}::DOUBLE[], {v}::DOUBLE[])))"
_SCORES = """SELECT q.vec_id AS query_id, e.vec_id AS entry_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
FROM embeddings q, embeddings e"""
ORACLE_SQL["knn_topk"] = f"SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id))::INT AS rank FROM ({_SCORES}) QUALIFY rank <= 6"
ORACLE_SQL["baseline_decision"] = f"""SELECT query_id, entry_id, score, CASE WHEN score >= 0.35 THEN 'hit' ELSE 'miss' END AS decision,
CASE WHEN score >= 0.35 THEN 'passed_cosine_threshold' ELSE 'failed_cosine_threshold' END AS reason
FROM ({_SCORES}) WHERE query_id <> entry_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) = 1"""
_MEANS = """SELECT label AS domain, i AS axis, avg(embedding[i + 1]::DOUBLE / sqrt(1.0)) AS m FROM embeddings, range(64) t(i) GROUP BY ALL"""
_CENTROIDS = f"SELECT domain, axis, m / sqrt(sum(m * m) OVER (PARTITION BY domain)) AS value FROM ({_MEANS})"
ORACLE_SQL["domain_centroids"] = f"SELECT domain, axis::INT AS axis, round(value, 6) AS value FROM ({_CENTROIDS})"
ORACLE_SQL["domain_detect"] = f"""WITH c AS (SELECT domain, list(value ORDER BY axis) AS v FROM ({_CENTROIDS}) GROUP BY domain),
s AS (SELECT vec_id, domain, round(list_dot_product({_UNIT.format(v='embedding')}, v), 6) AS score FROM embeddings, c)
SELECT vec_id, CASE WHEN score >= 0.3 THEN 'd' || domain ELSE 'general' END AS domain, score AS domain_score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, domain) = 1"""
_NEIGHBOURS = f"SELECT a.vec_id, {_UNIT.format(v='a.embedding')} AS a, {_UNIT.format(v='b.embedding')} AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"
_FEATURES = f"SELECT vec_id, list_concat(list_concat(a, b), list_concat(list_transform(range(64), lambda i: abs(a[i + 1] - b[i + 1])), list_transform(range(64), lambda i: a[i + 1] * b[i + 1]))) AS f FROM ({_NEIGHBOURS})"
ORACLE_SQL["pair_features"] = f"SELECT vec_id, len(f)::INT AS width, round(list_dot_product(f, f), 6) AS square_sum, round(f[129], 6) AS first_difference, round(f[193], 6) AS first_product FROM ({_FEATURES})"
_HIDDEN = " + ".join(f"greatest(0, 0.1 + list_dot_product(f, list_transform(range(256), lambda i: sin(1.0 + i + {j * 256})))) * cos(1.0 + {j})" for j in range(3))
ORACLE_SQL["mlp_score"] = f"SELECT vec_id, round(1 / (1 + exp(-({_HIDDEN} - 0.05))), 6) AS score FROM ({_FEATURES})"

_CALLS = f"""SELECT l.* REPLACE ({_domain('l.domain')} AS domain), c.prompt AS cached_prompt
FROM (SELECT DISTINCT query_id, domain, query_prompt, cache_entry_id, similarity_score, classifier_score, cross_encoder_score, created_at FROM lookup_records) l JOIN cache_entries c ON c.id = l.cache_entry_id"""
_TIER = "CASE WHEN domain IN ('medical', 'finance', 'legal') THEN 'high' ELSE 'low' END"
_MLP = f"CASE WHEN domain = 'devops' THEN 0.93 WHEN {_TIER} = 'high' THEN 0.99 ELSE 0.90 END"
_CROSS = f"CASE WHEN domain = 'devops' THEN 0.8 WHEN {_TIER} = 'high' THEN 0.95 ELSE 0.85 END"
_DECIDED = f"""WITH calls AS ({_CALLS}), texts AS (SELECT DISTINCT query_prompt AS a, cached_prompt AS b FROM calls WHERE cached_prompt IS NOT NULL),
keyed AS (SELECT row_number() OVER () AS key, a, b FROM texts), veto AS (SELECT key, a, b, {_opposite('a', 'b')} AS opposite FROM keyed), changed AS ({_first_entity('keyed')}),
rules AS (SELECT v.*, e.detector AS found FROM veto v LEFT JOIN changed e ON e.key = v.key),
decided AS (SELECT query_id, domain, {_TIER} AS risk_tier, CASE WHEN cached_prompt IS NULL THEN 'no_candidates_found' WHEN opposite THEN 'opposite_action_detected' WHEN classifier_score IS NULL OR classifier_score < {_MLP} THEN 'failed_mlp_threshold'
WHEN classifier_score >= 0.995 THEN 'mlp_bypass' WHEN cross_encoder_score IS NULL AND found IS NOT NULL THEN 'entity_change_detected:' || found WHEN cross_encoder_score IS NULL THEN 'passed_mlp_threshold_no_cross_encoder'
WHEN cross_encoder_score < {_CROSS} THEN 'failed_cross_encoder_threshold' WHEN found IS NOT NULL THEN 'entity_change_detected:' || found ELSE 'passed_all_thresholds' END AS reason
FROM calls LEFT JOIN rules ON a IS NOT DISTINCT FROM query_prompt AND b = cached_prompt),
final AS (SELECT *, CASE WHEN reason IN ('mlp_bypass', 'passed_all_thresholds', 'passed_mlp_threshold_no_cross_encoder') THEN 'hit' ELSE 'miss' END AS decision, CASE WHEN reason LIKE 'entity_change%' THEN split_part(reason, ':', 2) END AS detector FROM decided)
"""
ORACLE_SQL["decision_ladder"] = _DECIDED + "SELECT query_id, risk_tier, decision, reason, detector FROM final"
ORACLE_SQL["decision_outcomes"] = _DECIDED + "SELECT domain, risk_tier, reason, count(*) AS lookups FROM final GROUP BY ALL"
ORACLE_SQL["decision_stage_report"] = _DECIDED + """SELECT domain, count(*) AS lookups, count_if(decision = 'hit') AS hits, count_if(reason = 'mlp_bypass') AS bypassed,
round(CASE WHEN count_if(decision = 'hit') > 0 THEN count_if(reason = 'mlp_bypass') / count_if(decision = 'hit') ELSE 0.0 END, 6) AS bypass_rate FROM final GROUP BY domain"""
ORACLE_SQL["decision_stats"] = _DECIDED + "SELECT count(*) AS lookups, count_if(decision = 'hit') AS hits, count(*) - count_if(decision = 'hit') AS misses, round(count_if(decision = 'hit') / count(*), 6) AS hit_rate FROM final"
ORACLE_SQL["active_learning_candidates"] = _DECIDED + "SELECT query_id, CASE WHEN reason = 'failed_cross_encoder_threshold' THEN 'mlp_ce_disagreement' ELSE 'entity_change' END AS source, 0 AS label FROM final WHERE reason = 'failed_cross_encoder_threshold' OR reason LIKE 'entity_change%'"
ORACLE_SQL["risk_thresholds"] = f"SELECT DISTINCT domain, {_TIER} AS risk_tier, ({_MLP})::DOUBLE AS mlp_threshold, ({_CROSS})::DOUBLE AS cross_threshold FROM ({_CALLS})"
ORACLE_SQL["argmax_candidates"] = """SELECT query_prompt AS query_id, cached_prompt, round(classifier_score, 6) AS classifier_score FROM (SELECT DISTINCT * FROM active_learning_pairs)
QUALIFY row_number() OVER (PARTITION BY query_prompt ORDER BY coalesce(classifier_score, -1) DESC, cached_prompt, classifier_score) = 1"""

_TOKENS = "CASE WHEN coalesce({c}, '') = '' THEN 0 ELSE greatest(1, length({c}) // 4) END"
_COST = f"({_TOKENS.format(c='prompt')} * {{i}} + {_TOKENS.format(c='response')} * {{o}}) * 0.001"
_RATE = lambda i, o: _COST.format(i=f"{i}::DECIMAL(10,6)", o=f"{o}::DECIMAL(10,6)")
_MODEL = " ".join(f"WHEN model <> '' AND (contains(lower(model), {_q(n)}) OR contains({_q(n)}, lower(model))) THEN {_RATE(i, o)}" for n, i, o in [("large", "0.005", "0.015"), ("small", "0.0005", "0.0015"), ("mini", "0.00015", "0.0006")])
ORACLE_SQL["text_estimates"] = f"""SELECT id, ({_TOKENS.format(c='response')})::BIGINT AS tokens, (CASE {_MODEL} ELSE {_RATE('0.0015', '0.002')} END)::DECIMAL(28,9)::VARCHAR AS cost,
CASE WHEN length(prompt) > 44 THEN substring(prompt, 1, 43) || '…' ELSE prompt END AS short FROM cache_entries"""


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '{_SPACE}+'), lambda w: length(w) > 0)"


ORACLE_SQL["hash_embedding"] = f"""WITH t AS (SELECT pair_id, list_transform({_words('lower(prompt_a)')}, lambda w: sha256(w)) AS h FROM equivalence_gold), u AS (SELECT pair_id, unnest(h) AS h FROM t),
p AS (SELECT pair_id, ('0x' || h[1:8])::BIGINT % 16 AS axis, CASE WHEN ('0x' || h[9:10])::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM u)
SELECT g.pair_id, i::INT AS axis, coalesce(sum(p.s), 0.0) AS value FROM equivalence_gold g CROSS JOIN range(16) r(i) LEFT JOIN p ON p.pair_id = g.pair_id AND p.axis = r.i GROUP BY ALL"""
_AXES = " ".join(f"WHEN {_q(w)} THEN {a}" for w, a in V.SUPPORT_AXES.items())
ORACLE_SQL["support_embedding"] = f"""WITH t AS (SELECT pair_id, unnest({_words("regexp_replace(lower(prompt_a), '[?.]', ' ', 'g')")}) AS w FROM equivalence_gold), p AS (SELECT pair_id, CASE regexp_replace(w, '^[,;:]+|[,;:]+$', '', 'g') {_AXES} ELSE 7 END AS axis FROM t)
SELECT g.pair_id, i::INT AS axis, count(p.axis)::DOUBLE AS value FROM equivalence_gold g CROSS JOIN range(8) r(i) LEFT JOIN p ON p.pair_id = g.pair_id AND p.axis = r.i GROUP BY ALL"""
_ESCAPED = "replace(replace(replace(replace(replace({c}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
ORACLE_SQL["request_keys"] = f"""SELECT pair_id, sha256('{{"prompt_a":"' || {_ESCAPED.format(c='prompt_a')} || '","prompt_b":"' || {_ESCAPED.format(c='prompt_b')} || '"}}') AS request_key FROM equivalence_gold"""

_SYN = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in U.SYNONYMS.items())
ORACLE_SQL["mutate_synonym"] = f"""WITH t AS (SELECT pair_id, prompt_a, {_words('prompt_a')} AS w FROM equivalence_gold),
m AS (SELECT pair_id, prompt_a, array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({_list(U.SYNONYMS)}, lower(regexp_replace(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '', 'g')))
THEN replace(lower(x), lower(regexp_replace(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '', 'g')), CASE lower(regexp_replace(x, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]', '', 'g')) {_SYN} END) ELSE x END), ' ') AS s FROM t)
SELECT pair_id, CASE WHEN lower(s) = lower(prompt_a) THEN s || {_q(U.SYNONYM_SUFFIX)} ELSE s END AS mutated FROM m"""
ORACLE_SQL["mutate_word_order"] = f"""WITH t AS (SELECT pair_id, {_words('prompt_a')} AS w FROM equivalence_gold)
SELECT pair_id, array_to_string(CASE WHEN len(w) > 3 THEN list_concat([w[1], w[3], w[2]], w[4:]) ELSE w END, ' ') AS mutated FROM t"""
_INS = lambda cap, low: f"replace(replace(prompt_a, {_q(cap)}, {_q(cap + ' not')}), {_q(low)}, {_q(low + ' not')})"
ORACLE_SQL["mutate_negation"] = f"""SELECT pair_id, CASE WHEN contains(lower(prompt_a), 'can you') THEN {_INS('Can you', 'can you')} WHEN contains(lower(prompt_a), 'how do i') THEN {_INS('How do I', 'how do i')}
WHEN contains(lower(prompt_a), 'should i') THEN {_INS('Should I', 'should i')} WHEN contains(lower(prompt_a), 'is ') THEN regexp_replace(prompt_a, '(?i)\\bis\\b', 'is not', 'g') ELSE 'Do not ' || prompt_a END AS mutated FROM equivalence_gold"""
ORACLE_SQL["mutate_numeric"] = f"""WITH RECURSIVE d AS (SELECT pair_id, prompt_a, regexp_extract_all(prompt_a, '\\d+') AS runs FROM equivalence_gold),
s AS (SELECT pair_id, prompt_a AS done, runs, 1 AS i FROM d UNION ALL SELECT pair_id, CASE WHEN instr(done, runs[i]) > 0 THEN substring(done, 1, instr(done, runs[i]) - 1) || (runs[i]::HUGEINT * 3 + 5)::VARCHAR || substring(done, instr(done, runs[i]) + length(runs[i])) ELSE done END, runs, i + 1 FROM s WHERE i <= len(runs))
SELECT pair_id, CASE WHEN len(runs) = 0 THEN done || {_q(U.NUMBER_SUFFIX)} ELSE done END AS mutated FROM s WHERE i = len(runs) + 1"""
ORACLE_SQL["mutate_typo"] = f"""WITH t AS (SELECT pair_id, prompt_a, {_words('prompt_a')} AS w FROM equivalence_gold), u AS (SELECT pair_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
n AS (SELECT *, sum(CASE WHEN length(x) > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY i) AS c FROM u),
m AS (SELECT pair_id, string_agg(CASE WHEN length(x) > 4 AND c <= 2 THEN substring(x, 1, 2) || substring(x, 4, 1) || substring(x, 3, 1) || substring(x, 5) ELSE x END, ' ' ORDER BY i) AS s FROM n GROUP BY pair_id)
SELECT t.pair_id, CASE WHEN coalesce(s, '') = prompt_a THEN prompt_a || {_q(U.SLIP_SUFFIX)} ELSE coalesce(s, '') END AS mutated FROM t LEFT JOIN m USING (pair_id)"""

ORACLE_SQL["ledger_stats"] = """SELECT (SELECT count(*) FROM cache_entries) AS entries, (SELECT coalesce(sum(hit_count), 0)::BIGINT FROM cache_entries) AS stored_hits, (SELECT count(*) FROM (SELECT DISTINCT query_id, cache_entry_id, created_at FROM lookup_records) WHERE cache_entry_id IN (SELECT id FROM cache_entries)) AS total_hits, (SELECT count(DISTINCT query_id) FROM lookup_records) AS lookups,
count(*) AS feedback, count_if(label = 0) AS bad FROM (SELECT DISTINCT id, label FROM feedback_events)"""
_COUNTERS = """SELECT c.id, coalesce(h.n, 0) AS hit_count, h.t AS last_hit_at, coalesce(f.neg, 0) AS negative, coalesce(f.pos, 0) AS positive FROM cache_entries c
LEFT JOIN (SELECT cache_entry_id, count(*) AS n, max(created_at) AS t FROM (SELECT DISTINCT query_id, cache_entry_id, created_at FROM lookup_records) GROUP BY 1) h ON h.cache_entry_id = c.id
LEFT JOIN (SELECT cache_entry_id, count_if(label = 0) AS neg, count_if(label = 1) AS pos FROM (SELECT DISTINCT id, cache_entry_id, label FROM feedback_events) GROUP BY 1) f ON f.cache_entry_id = c.id"""
ORACLE_SQL["entry_counters"] = _COUNTERS
ORACLE_SQL["counter_lag"] = f"SELECT c.id, c.hit_count AS stored_hits, k.hit_count AS ledger_hits FROM cache_entries c JOIN ({_COUNTERS}) k ON k.id = c.id WHERE c.hit_count <> k.hit_count"
ORACLE_SQL["reissued_lookups"] = f"""WITH b AS (SELECT DISTINCT query_id, domain, {_strip('query_prompt')} AS prompt, created_at FROM lookup_records),
g AS (SELECT query_id, lag(query_id) OVER w AS previous_id, round((epoch_us(created_at) - lag(epoch_us(created_at)) OVER w) / 1e6, 6) AS gap_seconds FROM b WINDOW w AS (PARTITION BY domain, prompt ORDER BY created_at, query_id))
SELECT * FROM g WHERE gap_seconds <= 86400"""
ORACLE_SQL["open_reissues"] = f"SELECT * FROM ({ORACLE_SQL['reissued_lookups']}) WHERE previous_id NOT IN (SELECT query_id FROM feedback_events WHERE query_id IS NOT NULL)"
ORACLE_SQL["upsert_lookup"] = """SELECT query_id, cache_entry_id, query_prompt, similarity_score, created_at FROM (SELECT DISTINCT query_id, cache_entry_id, query_prompt, similarity_score, created_at FROM lookup_records)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, cache_entry_id DESC) = 1"""
ORACLE_SQL["record_feedback"] = "SELECT DISTINCT id, query_id, label FROM feedback_events WHERE label IN (0, 1) AND query_id IN (SELECT query_id FROM lookup_records)"
ORACLE_SQL["unflagged_hits"] = f"""SELECT domain, {_strip('query_prompt')} AS prompt, arg_max(query_id, struct_pack(a := created_at, b := query_id)) AS query_id FROM lookup_records
WHERE created_at <= TIMESTAMPTZ '2026-01-01 00:00:00+00' AND created_at >= TIMESTAMPTZ '2026-01-01 00:00:00+00' - INTERVAL 30 DAY AND query_id NOT IN (SELECT query_id FROM feedback_events WHERE query_id IS NOT NULL) GROUP BY ALL"""
ORACLE_SQL["latest_lookup"] = """SELECT cache_entry_id, query_id, created_at, similarity_score FROM (SELECT DISTINCT cache_entry_id, query_id, created_at, similarity_score FROM lookup_records)
QUALIFY row_number() OVER (PARTITION BY cache_entry_id ORDER BY created_at DESC, query_id DESC) = 1"""
_FEEDBACK = """SELECT l.query_prompt AS prompt_a, c.prompt AS prompt_b, f.label, l.domain, 'ledger-feedback' AS source, 'train' AS split, f.id AS feedback_event_id, f.query_id, f.cache_entry_id, f.reason,
l.similarity_score, l.classifier_score, l.cross_encoder_score, f.created_at AS feedback_created_at, f.metadata_json ->> '$.via' AS via, f.id AS metadata_event
FROM (SELECT DISTINCT id, query_id, cache_entry_id, label, reason, created_at, metadata_json FROM feedback_events) f
JOIN (SELECT DISTINCT query_id, domain, query_prompt, similarity_score, classifier_score, cross_encoder_score, created_at FROM lookup_records QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC, query_prompt DESC) = 1) l ON l.query_id = f.query_id
JOIN cache_entries c ON c.id = f.cache_entry_id"""
ORACLE_SQL["feedback_export"] = _FEEDBACK
ORACLE_SQL["active_learning_export"] = """SELECT DISTINCT query_prompt AS prompt_a, cached_prompt AS prompt_b, label, domain, source, 'train' AS split, id AS active_learning_id, similarity_score, classifier_score, cross_encoder_score, created_at, id AS metadata_id
FROM active_learning_pairs"""
_TTL = "SELECT id FROM cache_entries WHERE created_at < TIMESTAMPTZ '2026-01-01 00:00:00+00' - INTERVAL 240 DAY"
ORACLE_SQL["evict_ttl"] = _TTL
_LRU = "SELECT c.id FROM {rows} c JOIN (" + _COUNTERS + ") k ON k.id = c.id ORDER BY k.negative DESC, coalesce(k.last_hit_at, c.created_at), c.created_at, c.id LIMIT {n}"
ORACLE_SQL["evict_lru"] = _LRU.format(rows="cache_entries", n="(SELECT count(*) - count(*) // 2 FROM cache_entries)")
_REST = f"(SELECT * FROM cache_entries WHERE id NOT IN ({_TTL}))"
ORACLE_SQL["evict_hybrid"] = f"SELECT id, 'ttl' AS cause FROM ({_TTL}) UNION ALL SELECT id, 'lru' AS cause FROM ({_LRU.format(rows=_REST, n=f'(SELECT greatest(0, (SELECT count(*) FROM {_REST}) - count(*) // 2 // 2) FROM cache_entries)')})"
ORACLE_SQL["cascade_delete"] = f"""WITH v AS ({_TTL}), k AS (SELECT cache_entry_id, count(*) AS lookups FROM lookup_records WHERE cache_entry_id NOT IN (SELECT id FROM v) GROUP BY 1),
f AS (SELECT cache_entry_id, count(*) AS feedback FROM feedback_events WHERE cache_entry_id NOT IN (SELECT id FROM v) AND query_id NOT IN (SELECT query_id FROM lookup_records WHERE cache_entry_id IN (SELECT id FROM v)) GROUP BY 1)
SELECT k.cache_entry_id, lookups, feedback FROM k LEFT JOIN f ON f.cache_entry_id = k.cache_entry_id"""

_SCORED = f"""SELECT e.id, e.label, l.query_id, {_domain('l.domain')} AS domain, similarity_score, classifier_score, cross_encoder_score FROM (SELECT DISTINCT id, query_id, label FROM feedback_events) e
JOIN (SELECT DISTINCT query_id, domain, similarity_score, classifier_score, cross_encoder_score FROM lookup_records) l ON l.query_id = e.query_id"""


def _rated(counts: str, keys: str, empty: str = "0.0") -> str:
    precision, recall = f"CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE {empty} END", "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
    return f"""SELECT {keys}, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0.0 END, 6) AS fpr FROM (SELECT *, {precision} AS p, {recall} AS r FROM ({counts}))"""


def _confusion(score: str, threshold: str) -> str:
    hit = f"{score} >= {threshold}"
    return f"count_if({hit} AND label = 1) AS tp, count_if({hit} AND label = 0) AS fp, count_if(NOT ({hit}) AND label = 0) AS tn, count_if(NOT ({hit}) AND label = 1) AS fn"


_VALID = "label IN (0, 1) AND {s} IS NOT NULL AND NOT isnan({s})"
ORACLE_SQL["binary_metrics"] = _rated(f"SELECT domain, count(*) AS examples, 0.95::DOUBLE AS threshold, {_confusion('classifier_score', '0.95')} FROM ({_SCORED}) WHERE {_VALID.format(s='classifier_score')} GROUP BY domain", "domain, examples, threshold")
ORACLE_SQL["benchmark_metrics"] = _rated(f"SELECT domain, count(*) AS examples, 0.9::DOUBLE AS threshold, {_confusion('similarity_score', '0.9')} FROM ({_SCORED}) WHERE {_VALID.format(s='similarity_score')} GROUP BY domain", "domain, examples, threshold", "1.0")
ORACLE_SQL["roc_auc"] = f"""WITH s AS (SELECT domain, label, classifier_score AS score FROM ({_SCORED}) WHERE {_VALID.format(s='classifier_score')}),
r AS (SELECT domain, label, rank() OVER (PARTITION BY domain ORDER BY score) + (count(*) OVER (PARTITION BY domain, score) - 1) / 2.0 AS rk FROM s), t AS (SELECT domain, count_if(label = 1) AS p, count_if(label = 0) AS n, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs FROM r GROUP BY domain)
SELECT domain, p AS positives, n AS negatives, round(CASE WHEN p * n > 0 THEN (rs - p * (p + 1) / 2.0) / (p * n) END, 6) AS auc FROM t"""
ORACLE_SQL["calibration"] = f"""WITH s AS (SELECT domain, label, classifier_score AS score, CASE WHEN classifier_score BETWEEN 0 AND 1 THEN least(floor(classifier_score * 10), 9) END AS b FROM ({_SCORED}) WHERE {_VALID.format(s='classifier_score')}),
g AS (SELECT domain, b, count(*) AS n, avg(score) AS conf, avg(label) AS acc FROM s GROUP BY ALL) SELECT domain, sum(n)::BIGINT AS examples, round(sum(CASE WHEN b IS NOT NULL THEN n * abs(acc - conf) ELSE 0 END) / sum(n), 6) AS ece FROM g GROUP BY domain"""
_SWEEP = f"SELECT domain, threshold, {_confusion('round(classifier_score, 8)', 'threshold')} FROM ({_SCORED}), (SELECT round(i * 0.01, 6) AS threshold FROM range(101) t(i)) WHERE {_VALID.format(s='classifier_score')} GROUP BY domain, threshold"
ORACLE_SQL["threshold_sweep"] = _rated(_SWEEP, "domain, threshold")
ORACLE_SQL["precision_at_recall"] = f"""WITH s AS ({_rated(_SWEEP, 'domain, threshold')}) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY domain ORDER BY recall >= 0.8 - 1e-9 DESC, CASE WHEN recall >= 0.8 - 1e-9 THEN precision END DESC NULLS LAST, recall DESC, precision DESC, threshold) = 1"""
_GRID = f"""SELECT domain, a AS classifier_threshold, b AS cross_threshold, count_if(label = 1 AND h) AS tp, count_if(label = 0 AND h) AS fp, count_if(label = 0 AND NOT h) AS tn, count_if(label = 1 AND NOT h) AS fn
FROM (SELECT domain, label, a, b, round(classifier_score, 8) >= a AND round(cross_encoder_score, 8) >= b AS h FROM ({_SCORED}), (SELECT round(0.8 + i * 0.005, 6) AS a FROM range(40) t(i)), (SELECT round(0.7 + j * 0.01, 6) AS b FROM range(30) u(j)) WHERE label IN (0, 1) AND classifier_score IS NOT NULL AND cross_encoder_score IS NOT NULL) GROUP BY ALL"""
ORACLE_SQL["grid_search"] = f"""WITH s AS ({_rated(_GRID, 'domain, classifier_threshold, cross_threshold', '1.0')})
SELECT domain, classifier_threshold, cross_threshold, tp, fp, tn, fn, precision, recall, f1, fpr FROM s WHERE CASE domain WHEN 'finance' THEN fpr < 0.1 WHEN 'medical' THEN fpr < 0.05 ELSE true END
QUALIFY row_number() OVER (PARTITION BY domain ORDER BY f1 DESC, precision DESC, fpr, classifier_threshold, cross_threshold) = 1"""
ORACLE_SQL["blocked_false_positives"] = f"""SELECT domain, count_if(label = 0) AS negatives, count_if(label = 0 AND similarity_score >= 0.9) AS cosine_fp, count_if(label = 0 AND classifier_score >= 0.95) AS classifier_fp,
count_if(label = 0 AND similarity_score >= 0.9 AND NOT coalesce(classifier_score >= 0.95, false)) AS blocked FROM ({_SCORED}) WHERE label IN (0, 1) GROUP BY domain"""
ORACLE_SQL["class_weights"] = """WITH c AS (SELECT source, count(*) AS n, count_if(label = 1) AS p FROM equivalence_gold WHERE label IN (0, 1) GROUP BY source)
SELECT source, round(CASE WHEN p > 0 AND p < n THEN n / (2.0 * (n - p)) ELSE 1.0 END, 6) AS negative_weight, round(CASE WHEN p > 0 AND p < n THEN n / (2.0 * p) ELSE 1.0 END, 6) AS positive_weight FROM c"""
ORACLE_SQL["label_summary"] = "SELECT source, count(*) AS rows, count_if(label = 1) AS positives, count_if(label = 0) AS negatives FROM equivalence_gold GROUP BY source"
_RULED = f"""WITH veto AS (SELECT pair_id AS key, source, label, {_opposite('prompt_a', 'prompt_b')} AS opposite, prompt_b FROM equivalence_gold), changed AS ({_first_entity(_GOLD_ROWS)}),
d AS (SELECT v.source, v.label, CASE WHEN prompt_b IS NULL OR opposite OR c.detector IS NOT NULL THEN 'miss' ELSE 'hit' END AS decision FROM veto v LEFT JOIN changed c ON c.key = v.key WHERE label IN (0, 1)),
s AS (SELECT source, count_if(label = 0) AS must_miss, count_if(label = 1) AS must_hit, count_if(label = 0 AND decision = 'miss') AS blocked, count_if(label = 1 AND decision = 'hit') AS reused FROM d GROUP BY source)"""
_PCT = "CASE WHEN {w} > 0 THEN round(100.0 * ({p}) / {w}, 1) ELSE 0.0 END"
ORACLE_SQL["expectation_report"] = f"""{_RULED} SELECT source, must_miss, must_hit, ({_PCT.format(p='blocked', w='must_miss')})::DOUBLE AS safety_pct, ({_PCT.format(p='reused', w='must_hit')})::DOUBLE AS reuse_pct, must_miss - blocked AS dangerous_hits,
({_PCT.format(p='must_miss - blocked', w='must_miss')})::DOUBLE AS dangerous_pct, must_hit - reused AS missed_reuse, ({_PCT.format(p='must_hit - reused', w='must_hit')})::DOUBLE AS missed_pct FROM s"""
_CHECK = r"CASE WHEN regexp_replace(coalesce(prompt_a, ''), '" + _SPACE + r"', '', 'g') = '' THEN 'blank prompt_a' WHEN regexp_replace(coalesce(prompt_b, ''), '" + _SPACE + r"', '', 'g') = '' THEN 'blank prompt_b' WHEN label IS NULL OR label NOT IN (0, 1) THEN 'label not 0 or 1' END"
ORACLE_SQL["checked_pairs"] = f"SELECT CASE WHEN problem IS NULL THEN coalesce(split, 'train') ELSE split END AS split, problem, count(*) AS rows FROM (SELECT split, {_CHECK} AS problem FROM equivalence_gold) GROUP BY ALL"
ORACLE_SQL["hard_negatives"] = """WITH a AS (SELECT c_nationkey AS template, c_name AS x, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey, c_name) AS i FROM customer), b AS (SELECT s_nationkey AS template, s_name AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey, s_name) AS j FROM supplier)
SELECT a.template, x AS prompt_a, y AS prompt_b, 0 AS label FROM a JOIN b ON a.template = b.template WHERE i <= 10 AND j <= 10 QUALIFY row_number() OVER (PARTITION BY a.template ORDER BY i + j, i) <= 10"""
ORACLE_SQL["both_orders"] = "SELECT prompt_a, prompt_b, pair_id, label FROM equivalence_gold UNION ALL SELECT prompt_b AS prompt_a, prompt_a AS prompt_b, pair_id, label FROM equivalence_gold"
ORACLE_SQL["unordered_pairs"] = "SELECT least(prompt_a, prompt_b) AS prompt_a, greatest(prompt_a, prompt_b) AS prompt_b, min(label) AS label, count(*) AS rows FROM equivalence_gold GROUP BY 1, 2"
ORACLE_SQL["paraphrase_dedupe"] = """SELECT source AS grp, arg_min(prompt_a, struct_pack(p := pair_id, t := prompt_a)) AS text, min(pair_id) AS position FROM equivalence_gold
WHERE prompt_a IS NOT NULL AND lower(trim(prompt_a)) <> coalesce(lower(trim(prompt_b)), '') GROUP BY source, lower(trim(prompt_a))"""
ORACLE_SQL["stratified_split"] = """WITH r AS (SELECT pair_id, source, row_number() OVER (PARTITION BY source ORDER BY pair_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM equivalence_gold)
SELECT pair_id, source, CASE WHEN rn <= greatest(1, least(greatest(n - 1, 1), round_even(n * 0.85, 0))) THEN 'train' ELSE 'validation' END AS part FROM r"""
ORACLE_SQL["training_union"] = f"SELECT source, label, count(*) AS rows FROM (SELECT source, label FROM ({_FEEDBACK}) UNION ALL SELECT source, label FROM equivalence_gold) GROUP BY ALL"

ORACLE_SQL["entry_by_id"] = "SELECT id, prompt, response, model FROM cache_entries WHERE id = (SELECT min(id) FROM cache_entries)"
ORACLE_SQL["entries_in_order"] = "SELECT id, created_at FROM cache_entries ORDER BY created_at, id"
ORACLE_SQL["feedback_in_order"] = "SELECT DISTINCT id, query_id, label, created_at FROM feedback_events ORDER BY created_at, id"
ORACLE_SQL["served_answers"] = _DECIDED + f"""SELECT f.query_id, decision, CASE WHEN decision = 'hit' THEN response END AS answer, (CASE WHEN decision = 'hit' THEN {_TOKENS.format(c='response')} ELSE 0 END)::BIGINT AS tokens_saved
FROM final f JOIN (SELECT DISTINCT query_id, cache_entry_id FROM lookup_records) l ON l.query_id = f.query_id JOIN cache_entries c ON c.id = l.cache_entry_id"""
ORACLE_SQL["pairs_roundtrip"] = f"SELECT prompt_a, prompt_b, label, domain, source, coalesce(split, 'train') AS split FROM equivalence_gold WHERE ({_CHECK}) IS NULL"
ORACLE_SQL["stream_reissued"] = ORACLE_SQL["reissued_lookups"]
_MUTATED = " UNION ALL ".join(f"SELECT {_q(n)} AS mutation, pair_id, mutated FROM ({ORACLE_SQL[f'mutate_{n}']})" for n in U.MUTATIONS)
ORACLE_SQL["mutation_report"] = f"""WITH m AS ({_MUTATED}), keyed AS (SELECT mutation || ':' || m.pair_id AS key, mutation, mutated AS a, g.prompt_a AS b FROM m JOIN equivalence_gold g ON g.pair_id = m.pair_id),
changed AS ({_first_entity('keyed')}), d AS (SELECT mutation, k.b IS NULL OR {_opposite('k.a', 'k.b')} OR c.detector IS NOT NULL AS missed FROM keyed k LEFT JOIN changed c ON c.key = k.key)
SELECT mutation, count_if(NOT missed) AS hits, count_if(missed) AS misses FROM d GROUP BY mutation"""

ORACLE_SQL["comparison_matrix"] = _DECIDED + f""", lab AS (SELECT DISTINCT id, query_id, label FROM feedback_events WHERE label IN (0, 1)),
m AS (SELECT f.domain, l.label, f.decision, z.s, z.c, z.x FROM final f JOIN lab l ON l.query_id = f.query_id JOIN (SELECT DISTINCT query_id, similarity_score AS s, classifier_score AS c, cross_encoder_score AS x FROM lookup_records) z ON z.query_id = f.query_id),
h AS (SELECT domain, label, 'cosine' AS method, coalesce(s >= 0.9, false) AS hit FROM m UNION ALL SELECT domain, label, 'classifier', coalesce(c >= 0.85, false) FROM m UNION ALL SELECT domain, label, 'double', coalesce(c >= 0.95 AND x >= 0.9, false) FROM m UNION ALL SELECT domain, label, 'full', decision = 'hit' FROM m),
k AS (SELECT domain, method, count(*) AS examples, count_if(hit AND label = 1) AS tp, count_if(hit AND label = 0) AS fp, count_if(NOT hit AND label = 0) AS tn, count_if(NOT hit AND label = 1) AS fn FROM h GROUP BY ALL)
{_rated('SELECT * FROM k', 'domain, method, examples', '1.0')}"""
ORACLE_SQL["baseline_scenarios"] = f"""WITH r AS (SELECT domain, label, t AS threshold, coalesce(similarity_score >= t, false) AS hit FROM ({_SCORED}), (SELECT unnest([0.7, 0.8, 0.9, 0.95, 0.98])::DOUBLE AS t) WHERE label IN (0, 1))
SELECT domain, threshold, count(*) AS cases, count_if(hit) AS hits, count_if(hit AND label = 0) AS wrong_hits, count_if(NOT hit AND label = 1) AS missed_reuse, round(avg(CASE WHEN hit = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS right_share FROM r GROUP BY ALL"""
ORACLE_SQL["method_drift"] = _DECIDED + f""", lab AS (SELECT DISTINCT id, query_id, label FROM feedback_events WHERE label IN (0, 1)), m AS (SELECT l.label, f.decision, z.s, z.c, z.x FROM final f JOIN lab l ON l.query_id = f.query_id JOIN (SELECT DISTINCT query_id, similarity_score AS s, classifier_score AS c, cross_encoder_score AS x FROM lookup_records) z ON z.query_id = f.query_id),
h AS (SELECT label, 'cosine' AS method, coalesce(s >= 0.9, false) AS hit FROM m UNION ALL SELECT label, 'classifier', coalesce(c >= 0.85, false) FROM m UNION ALL SELECT label, 'double', coalesce(c >= 0.95 AND x >= 0.9, false) FROM m UNION ALL SELECT label, 'full', decision = 'hit' FROM m),
s AS (SELECT method, count_if(label = 0) AS must_miss, count_if(label = 1) AS must_hit, count_if(label = 0 AND NOT hit) AS blocked, count_if(label = 1 AND hit) AS reused FROM h GROUP BY method)
SELECT method, must_miss, must_hit, ({_PCT.format(p='blocked', w='must_miss')})::DOUBLE AS safety_pct, ({_PCT.format(p='reused', w='must_hit')})::DOUBLE AS reuse_pct, must_miss - blocked AS dangerous_hits,
({_PCT.format(p='must_miss - blocked', w='must_miss')})::DOUBLE AS dangerous_pct, must_hit - reused AS missed_reuse, ({_PCT.format(p='must_hit - reused', w='must_hit')})::DOUBLE AS missed_pct FROM s"""
_SIX = f"SELECT domain, threshold, {_confusion('round(classifier_score, 8)', 'threshold')} FROM ({_SCORED}), (SELECT round(0.7 + i * 0.05, 6) AS threshold FROM range(6) t(i)) WHERE {_VALID.format(s='classifier_score')} GROUP BY domain, threshold"
ORACLE_SQL["six_point_sweep"] = _rated(_SIX, "domain, threshold")
ORACLE_SQL["reply_lines"] = r"""WITH l AS (SELECT id, unnest(regexp_split_to_array(regexp_replace(response, '(?s)<think>.*?</think>', '', 'g'), '\r?\n')) AS x FROM cache_entries WHERE response IS NOT NULL),
c AS (SELECT id, regexp_replace(regexp_replace(trim(x), '^(?:[-*•]|\d+[.)])\s*', ''), '^["''“”]+|["''“”]+$', '', 'g') AS line FROM l) SELECT id, count(*) AS lines, sum(length(line))::BIGINT AS characters FROM c WHERE length(trim(line)) > 0 GROUP BY id"""
ORACLE_SQL["rendered_actions"] = "SELECT p_partkey, lower(p_type) || ' ' || p_name || '.' AS prompt FROM part"
ORACLE_SQL["pairs_of_domain"] = f"SELECT pair_id, prompt_a, prompt_b, label FROM equivalence_gold WHERE domain = 'finance' AND split = 'test' AND ({_CHECK}) IS NULL"
ORACLE_SQL["concept_pairs"] = """WITH v AS (SELECT o_custkey AS concept, o_orderkey AS position, 'order ' || o_orderkey || ' ' || o_orderpriority AS text FROM orders)
SELECT a.concept, a.text AS prompt_a, b.text AS prompt_b, 1 AS label FROM v a JOIN v b ON a.concept = b.concept AND a.position < b.position"""
ORACLE_SQL["easy_negatives"] = """WITH k AS (SELECT DISTINCT p_brand AS concept, p_name AS text, md5(p_brand || chr(1) || p_name) AS k FROM part), n AS (SELECT CASE WHEN count(*) <= 160000 THEN 1 WHEN count(*) <= 2560000 THEN 2 ELSE 3 END AS digits FROM k),
d AS (SELECT *, substr(k, 1, (SELECT digits FROM n)::INT) AS b FROM k), c AS (SELECT *, CASE WHEN lag(concept) OVER w IS NOT DISTINCT FROM concept THEN 0 ELSE 1 END AS c FROM d WINDOW w AS (PARTITION BY b ORDER BY k, text)),
r AS (SELECT *, sum(c) OVER (PARTITION BY b ORDER BY k, text ROWS UNBOUNDED PRECEDING) AS run FROM c), f AS (SELECT b, run - 1 AS run, text AS other FROM r QUALIFY row_number() OVER (PARTITION BY b, run ORDER BY k, text) <= 2)
SELECT DISTINCT least(text, other) AS prompt_a, greatest(text, other) AS prompt_b, 0 AS label FROM r JOIN f USING (b, run) WHERE text <> other"""
