"""The scanners in SQL for DuckDB, to check the Spark results against.

RE2 has no look-behind and its word boundary knows ASCII letters only. Accented
letters are therefore turned into underscores first, which are word characters
too, and a look-behind becomes a consumed character in front of a group.
"""

from __future__ import annotations

from ..functions.patterns import ALL_PATTERNS, INDIA_PATTERNS, US_PATTERNS, Pattern, sensitivity_weight
from ..operators.adversarial import (
    GUARDIAN_RULES,
    INJECTION_RULES,
    PAYLOAD_REGEX,
    PAYLOAD_WORDS,
)

LETTERS = "[À-ÖØ-öø-ɏ]"

# The patterns that need another form; the second item is the group to take.
_RE2 = {
    "Aadhaar Number": (r"(?:^|[^+\w])([2-9]\d{3}(?:\s\d{4}\s\d{4}|\d{8}))\b", 1),
    "Indian Bank Account": (r"(?:^|[^+\w])([0-9]{9,16})\b", 1),
    "Indian Mobile": (r"(?:^|\s)((?:\+91|0)?[6-9]\d{9})\b", 1),
    "DB String": (r"([a-zA-Z0-9]+)://([a-zA-Z0-9]+):([a-zA-Z0-9]+)@([a-zA-Z0-9\.-]+)", 0),
}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def re2(p: Pattern) -> tuple[str, int]:
    return _RE2.get(p.label, (p.regex, 0))


def hits(p: Pattern, text: str = "t2") -> str:
    regex, group = re2(p)
    return f"regexp_extract_all({text}, {lit(regex)}, {group})"


def plain(text: str) -> str:
    return f"regexp_replace({text}, '{LETTERS}', '_', 'g')"


def counts_cte(source: str, key: str, extra: str = "", name: str = "cnt") -> str:
    """CTE with one column ``c<i>`` per pattern."""
    cols = ", ".join(f"len({hits(p)}) AS c{i}" for i, p in enumerate(ALL_PATTERNS))
    more = f", {extra}" if extra else ""
    return f"{name} AS (SELECT {key}{more}, {cols} FROM (SELECT *, {plain('text')} AS t2 FROM {source}))"


def long_cte(source: str, key: str, extra: str = "", name: str = "hits", patterns=ALL_PATTERNS) -> str:
    """CTE with one row per hit."""
    more = f", {extra}" if extra else ""
    parts = [
        f"SELECT {key}{more}, {lit(p.label)} AS label, {lit(p.type)} AS type, {i} AS pno, unnest({hits(p)}) AS entity FROM plain_{name}"
        for i, p in enumerate(patterns)
    ]
    return f"plain_{name} AS (SELECT *, {plain('text')} AS t2 FROM {source}),\n{name} AS ({' UNION ALL '.join(parts)})"


def _total(weights: list[float]) -> str:
    by: dict[float, list[str]] = {}
    for i, w in enumerate(weights):
        if w:
            by.setdefault(w, []).append(f"c{i}")
    return " + ".join(f"({' + '.join(cs)}) * CAST({w} AS DOUBLE)" for w, cs in by.items())


def n_of(type_: str) -> str:
    return "(" + " + ".join(f"c{i}" for i, p in enumerate(ALL_PATTERNS) if p.type == type_) + ")"


RISK = f"least(CAST(10 AS DOUBLE), {n_of('SECRET')} * CAST(2.5 AS DOUBLE) + {n_of('CLASSIFICATION')} * CAST(0.8 AS DOUBLE))"
SENSITIVITY = f"least(CAST(10 AS DOUBLE), round({_total([sensitivity_weight(p.label, p.type) for p in ALL_PATTERNS])}, 2))"
N_ALL = "(" + " + ".join(f"c{i}" for i in range(len(ALL_PATTERNS))) + ")"
N_INDIA = "(" + " + ".join(f"c{i}" for i, p in enumerate(ALL_PATTERNS) if p.type == "INDIA_PII") + ")"
LABELS = (
    "list_sort(list_distinct(list_filter(["
    + ", ".join(f"CASE WHEN c{i} > 0 THEN {lit(p.label)} END" for i, p in enumerate(ALL_PATTERNS))
    + "], lambda x: x IS NOT NULL)))"
)


def policy_name(score: str = "s", n: str = "n", department: str = "department") -> str:
    scope = f"coalesce({department}, 'GLOBAL')"
    return (
        f"CASE WHEN {n} = 0 THEN NULL WHEN {score} > 7 THEN {scope} || ':FORCE_AIRGAP_HIGH_SENSITIVITY' "
        f"ELSE {scope} || ':PSEUDONYMIZE_BEFORE_LLM' END"
    )


# ---- redaction ------------------------------------------------------------


def _words_of(regex: str) -> str:
    return regex[regex.index("(", 4) + 1 : regex.rindex(")")].replace(r"\b", "")


def redact_india(text: str) -> str:
    """Nested replacements. For word lists every delimiter is wrapped in \\x01, so
    that neighbours do not share one and accented letters count as letters."""
    for p in INDIA_PATTERNS:
        tag = p.redaction_tag
        if p.regex.startswith("(?i)"):
            words = _words_of(p.regex).replace(" ", "\x01 \x01")
            marked = f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_])', '\x01\\1\x01', 'g')"
            done = f"regexp_replace({marked}, '(?i)(^|\x01)({words})(\x01|$)', '\\1{tag}\\3', 'g')"
            text = f"replace({done}, '\x01', '')"
        elif p.label in _RE2:
            regex = {
                "Aadhaar Number": r"(^|[^+\w])(?:[2-9]\d{3}(?:\s\d{4}\s\d{4}|\d{8}))\b",
                "Indian Bank Account": r"(^|[^+\w])[0-9]{9,16}\b",
                "Indian Mobile": r"(^|\s)(?:\+91|0)?[6-9]\d{9}\b",
            }[p.label]
            text = f"regexp_replace({text}, {lit(regex)}, '\\1{tag}', 'g')"
        else:
            text = f"regexp_replace({text}, {lit(p.regex)}, '{tag}', 'g')"
    return text


def redact_us(text: str) -> str:
    """Replacements one after the other; right where hits do not overlap."""
    for p in sorted(US_PATTERNS, key=lambda p: p.label == "Medical/HIPAA"):
        token = "[REDACTED_" + "_".join("".join(c if c.isalnum() else " " for c in p.label.upper()).split()) + "]"
        regex = re2(p)[0]
        if "SSN" in p.label:
            regex, token = r"\b\d{3}-\d{2}-(\d{4})\b", r"[REDACTED_SSN_XXX-XX-\1]"
        text = f"regexp_replace({text}, {lit(regex)}, '{token}', 'g')"
    return text


# ---- adversarial ----------------------------------------------------------

_TAIL_RE2 = {
    "injection": r"(?i)(?:[!#@$%^&*_=+\-]{8,}|(?:\b[a-z]{1,3}\b\s*){18,})$",
    "guardian": r"(?i)(?:\b[a-z]{1,3}\b[\s,.;:/\\|]*){24,}$",
}


def _any(patterns, text: str) -> str:
    tests = []
    for regex, _ in patterns:
        if regex.startswith("TAIL:"):
            regex = _TAIL_RE2[regex.split(":")[1]]
        elif regex.startswith("(?<!"):
            regex = r"[^\w\s]{10,}.{0,60}$"
        tests.append(f"regexp_matches({text}, {lit(regex)})")
    return "(" + " OR ".join(tests) + ")"


def payload_hit(text: str) -> str:
    found = f"regexp_extract_all({text}, {lit(PAYLOAD_REGEX)})"
    body = "rtrim(c, '=')"
    padded = f"rpad({body}, CAST(ceil(length({body}) / 4.0) * 4 AS INTEGER), '=')"
    decoded = f"TRY(decode(from_base64({padded})))"
    words = lit("(?i)(" + "|".join(PAYLOAD_WORDS) + ")")
    return f"(len(list_filter(list_transform({found}, lambda c: {decoded}), lambda d: d IS NOT NULL AND regexp_matches(d, {words}))) > 0)"


def injection_cte(source: str, key: str, extra: str = "", name: str = "inj") -> str:
    more = f", {extra}" if extra else ""
    cols = ", ".join(f"{_any(pats, 't2')} AS i{k}" for k, (_, _, pats) in enumerate(INJECTION_RULES))
    return f"{name} AS (SELECT {key}{more}, {cols} FROM (SELECT *, {plain('text')} AS t2 FROM {source}))"


INJECTION_SCORE = "least(CAST(10 AS DOUBLE), " + " + ".join(
    f"CASE WHEN i{k} THEN CAST({s} AS DOUBLE) ELSE 0 END" for k, (_, s, _) in enumerate(INJECTION_RULES)
) + ")"
INJECTION_LABELS = "list_filter([" + ", ".join(
    f"CASE WHEN i{k} THEN {lit(label)} END" for k, (label, _, _) in enumerate(INJECTION_RULES)
) + "], lambda x: x IS NOT NULL)"


def guardian_cte(source: str, key: str, extra: str = "", name: str = "gua") -> str:
    more = f", {extra}" if extra else ""
    cols = ", ".join(f"{_any(pats, 't2')} AS g{k}" for k, (_, _, pats) in enumerate(GUARDIAN_RULES))
    return (
        f"{name} AS (SELECT {key}{more}, {cols}, {payload_hit('text')} AS g{len(GUARDIAN_RULES)} "
        f"FROM (SELECT *, {plain('text')} AS t2 FROM {source}))"
    )


_G = [(label, w) for label, w, _ in GUARDIAN_RULES] + [("Encoded Payload Bypass", 4.0)]
GUARDIAN_SCORE = "least(CAST(10 AS DOUBLE), " + " + ".join(
    f"CASE WHEN g{k} THEN CAST({w} AS DOUBLE) ELSE 0 END" for k, (_, w) in enumerate(_G)
) + ")"
GUARDIAN_LABELS = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN g{k} THEN {lit(label)} END" for k, (label, _) in enumerate(_G)
) + "], lambda x: x IS NOT NULL))"
