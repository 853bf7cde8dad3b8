"""Prompt-injection and jailbreak detection, encoded payloads, access paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import JAVA_FLAGS, PROMPT_INJECTION, SCORE_CAP, word_classes
from ..schemas import FINDINGS
from .detect import any_literal, either, quoted, with_probes, without_probes

# Labels, scores and patterns. Each pattern comes with literals
# of which one must occur for it to match. The pattern of trailing short words
# is not here but in ``_TAILS``, because a regex for it would recurse per word.
INJECTION_RULES = (
    (
        "DAN / Role Override",
        2.5,
        (
            (
                r"(?i)\b(do anything now|dan mode|developer mode|jailbreak)\b",
                ("do anything now", "dan mode", "developer mode", "jailbreak"),
            ),
            (r"(?i)\byou are now (dan|free|unrestricted|uncensored)\b", ("you are now ",)),
        ),
    ),
    (
        "Instruction Hierarchy Attack",
        4.0,
        (
            (
                r"(?i)\b(ignore|disregard|forget|override)\b.{0,80}"
                r"\b(previous|system|developer|security|policy|instructions?)\b",
                ("ignore", "disregard", "forget", "override"),
            ),
            (r"(?i)\bnew instructions?:\b.{0,120}\b(do not|never|bypass|disable)\b", ("new instruction",)),
        ),
    ),
    (
        "Prompt Leakage Attempt",
        3.0,
        (
            (
                r"(?i)\b(reveal|print|show|repeat|dump)\b.{0,80}"
                r"\b(system prompt|hidden prompt|policy|instructions|rules)\b",
                ("system prompt", "hidden prompt", "policy", "instructions", "rules"),
            ),
            (r"(?i)\bwhat (are|were) your (system|developer) instructions\b", ("instructions",)),
        ),
    ),
    (
        "Redaction Bypass",
        4.0,
        (
            (
                r"(?i)\b(reconstruct|decode|deanonymize|de-anonymize|unmask)\b.{0,80}"
                r"\b(redacted|masked|pii|token)\b",
                ("reconstruct", "decode", "deanonymize", "de-anonymize", "unmask"),
            ),
            (r"(?i)\breturn the original\b.{0,80}\b(aadhaar|pan|ssn|patient|secret)\b", ("return the original",)),
        ),
    ),
    (
        "Adversarial Suffix",
        2.5,
        (
            ("TAIL:injection", ()),
            (
                r"(?i)\b(base64|rot13|hex encoded|unicode smuggling|token smuggling)\b",
                ("base64", "rot13", "hex encoded", "unicode smuggling", "token smuggling"),
            ),
        ),
    ),
)

GUARDIAN_RULES = (
    (
        "Roleplay Jailbreak",
        3.5,
        (
            (r"(?i)\bpretend you are\b.{0,80}\b(unfiltered|evil|developer|admin|auditor|root)\b", ("pretend you are",)),
            (r"(?i)\broleplay\b.{0,120}\b(ignore|bypass|disable|override|leak)\b", ("roleplay",)),
            (
                r"(?i)\bfor educational purposes\b.{0,120}\b(reveal|dump|bypass|exfiltrate)\b",
                ("for educational purposes",),
            ),
        ),
    ),
    (
        "Data Exfiltration Intent",
        4.0,
        (
            (
                r"(?i)\b(print|dump|reveal|exfiltrate|show)\b.{0,120}"
                r"\b(secret|policy|system prompt|hidden rules|token|key)\b",
                ("print", "dump", "reveal", "exfiltrate", "show"),
            ),
            (r"(?i)\bdecode\b.{0,120}\b(masked|redacted|aadhaar|pan|ssn|patient)\b", ("decode",)),
            (
                r"(?i)\breturn\b.{0,80}\b(original|unmasked|raw)\b.{0,80}\b(value|identifier|pii|secret)\b",
                ("return",),
            ),
        ),
    ),
    (
        "Adversarial Suffix",
        3.0,
        (
            ("TAIL:guardian", ()),
            # One attempt per run of symbols: look-behind and possessive repeat.
            (r"(?<![^\w\s])[^\w\s]{10,}+.{0,60}$", ()),
            (
                r"(?i)\b(token smuggling|unicode smuggling|adversarial suffix|gradient suffix)\b",
                ("token smuggling", "unicode smuggling", "adversarial suffix", "gradient suffix"),
            ),
        ),
    ),
)

# What may stand between the short words of a tail, the least
# number of words, and a pattern of symbols that also counts as such a tail.
_TAILS = {
    "injection": (r"\s", 18, r"(?<![!#@$%^&*_=+\-])[!#@$%^&*_=+\-]{8,}+$"),
    "guardian": (r"\s,.;:/\\|", 24, None),
}

_EIGHT_SYMBOLS = r"[!#@$%^&*_=+\-]{8}"
# What the last characters of a text must contain for a pattern to match: ten
# symbols with at most 60 characters and a line end after them.
_NEEDED_AT_END = {r"(?<![^\w\s])[^\w\s]{10,}+.{0,60}$": (71, r"[^\w\s]{10}")}

BLOCK_THRESHOLD = 7.0
EVIDENCE_CUT, INJECTION_SNIPPET_CUT = 180, 160
PAYLOAD_LABEL, PAYLOAD_SCORE = "Encoded Payload Bypass", 4.0
PAYLOAD_REGEX = r"\b[A-Za-z0-9+/]{28,}={0,2}\b"
PAYLOAD_LEAST = 28
PAYLOAD_WORDS = ("ignore", "bypass", "reveal", "secret", "system prompt", "policy", "aadhaar", "pan")
JUDGE_LABEL, JUDGE_SCORE, JUDGE_EVIDENCE = "Local Judge Jailbreak", 3.0, "root/safety override intent"
JUDGE_LITERALS = ("you are now root", "disable all safety")


def _form(pattern: str, flag: str | None) -> str:
    """SQL: a pattern with its words spelt out, or in the cheaper form where ``flag`` says that the text is plain."""
    spelt = JAVA_FLAGS + word_classes(pattern)
    return quoted(spelt) if flag is None else either(JAVA_FLAGS + pattern, spelt, flag)


def _tail_sql(text: str, kind: str, flag: str | None = None) -> str:
    """Text of a trailing run of words of one to three letters, NULL if too short.

    The run is what follows the last piece of text that cannot belong to it: a
    symbol outside the separators, or a word that is not one to three letters.
    This needs no repeated group, so a long text cannot exhaust the stack. The
    greedy dot runs to the end and comes back to the last such piece, which in
    nearly every text is a few letters away.
    """
    sep, least, symbols = _TAILS[kind]
    breaker = _form(rf"(?is)^.*(?:[^\w{sep}]|\b(?![a-z]{{1,3}}\b)\w+)", flag)
    tail = f"regexp_replace({text}, {breaker}, '')"
    trimmed = f"regexp_replace(({tail}), {quoted(JAVA_FLAGS + '^[' + sep + ']+')}, '')"
    run = f"CASE WHEN regexp_count({trimmed}, {_form(chr(92) + 'w+', flag)}) >= {least} THEN {trimmed} END"
    if symbols is None:
        return run
    sym = f"nullif(regexp_extract({text}, {quoted(JAVA_FLAGS + symbols)}, 0), '')"
    ends_so = f"right({text}, 9) RLIKE {quoted(_EIGHT_SYMBOLS)}"
    return f"coalesce(CASE WHEN {ends_so} THEN {sym} END, {run})"


def _evidence_sql(text: str, pattern: str, literals: Sequence[str]) -> str:
    """First match of a pattern, NULL if there is none."""
    if pattern.startswith("TAIL:"):
        return _tail_sql(text, pattern.split(":")[1], "__plain")
    found = f"nullif(regexp_extract({text}, {either(JAVA_FLAGS + pattern, JAVA_FLAGS + word_classes(pattern), '__plain')}, 0), '')"
    if pattern in _NEEDED_AT_END:
        last, needed = _NEEDED_AT_END[pattern]
        return f"CASE WHEN right({text}, {last}) RLIKE {quoted(JAVA_FLAGS + word_classes(needed))} THEN {found} END"
    return f"CASE WHEN {any_literal('__fold', literals)} THEN {found} END" if literals else found


def _label_evidence(text: str, patterns) -> str:
    return "coalesce(" + ", ".join(_evidence_sql(text, p, lits) for p, lits in patterns) + ")"


def scan_injection(df: DataFrame, text: str = "text", out: str = "injection_findings") -> DataFrame:
    """At most one finding per label, from its first matching pattern."""
    staged = with_probes(df, text).selectExpr(
        "*", *[f"{_label_evidence(text, pats)} AS __i{k}" for k, (_, _, pats) in enumerate(INJECTION_RULES)]
    )
    items = [
        F.when(
            F.col(f"__i{k}").isNotNull(),
            F.struct(
                F.lit(k).alias("ord"),
                F.lit(PROMPT_INJECTION).alias("type"),
                F.lit(label).alias("label"),
                F.lit("HIGH").alias("confidence"),
                F.col(f"__i{k}").alias("entity"),
                F.lit(0).alias("start"),
                F.lit(0).alias("end"),
                F.substring(F.col(f"__i{k}"), 1, INJECTION_SNIPPET_CUT).alias("snippet"),
                F.lit(score).alias("score"),
                F.lit(None).cast("string").alias("redaction_tag"),
                F.lit(None).cast("string").alias("dpdp_category"),
            ),
        )
        for k, (label, score, _) in enumerate(INJECTION_RULES)
    ]
    found = F.filter(F.array(*items), lambda f: f.isNotNull()).cast(FINDINGS)
    return without_probes(staged.withColumn(out, found), df.columns).drop(*[f"__i{k}" for k in range(len(INJECTION_RULES))])


def injection_risk(findings: Column | str = "injection_findings") -> Column:
    total = F.aggregate(findings, F.lit(0.0), lambda acc, f: acc + F.coalesce(f["score"], F.lit(0.0)))
    return F.least(F.lit(SCORE_CAP), F.round(total, 2))


def _decoded_sql(candidate: str) -> str:
    """Lenient Base64: padding is normalised, bytes that are not UTF-8 are dropped."""
    body = f"rtrim('=', {candidate})"
    padded = f"rpad({body}, cast(ceil(length({body}) / 4.0) * 4 as int), '=')"
    binary = f"CASE WHEN length({body}) % 4 <> 1 THEN try_to_binary({padded}, 'base64') END"
    return f"replace(make_valid_utf8(cast({binary} as string)), '�', '')"


def encoded_payload(text: str, candidates: int | None = None, flag: str | None = None) -> str:
    """SQL: ``base64:<decoded>`` of the first suspicious candidate, else NULL; ``candidates`` looks at the first few only.

    ``flag`` names a column that tells plain texts.
    """
    words = quoted("(?i)(" + "|".join(PAYLOAD_WORDS) + ")")
    # A candidate holds no blank, so a text of short words has none; cutting at blanks is far cheaper than the pattern.
    found = f"regexp_extract_all({text}, {_form(PAYLOAD_REGEX, flag)}, 0)"
    found = f"CASE WHEN exists(split({text}, ' ', -1), w -> octet_length(w) >= {PAYLOAD_LEAST}) THEN {found} ELSE array() END"
    if candidates is not None:
        found = f"slice({found}, 1, {int(candidates)})"
    decoded = f"transform({found}, c -> {_decoded_sql('c')})"
    return f"concat('base64:', try_element_at(filter({decoded}, d -> d IS NOT NULL AND d RLIKE {words}), 1))"


def local_judge(text: Column | str) -> Column:
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.contains(low, F.lit(JUDGE_LITERALS[0])) | F.contains(low, F.lit(JUDGE_LITERALS[1]))


def guardian_scan(
    df: DataFrame, text: str = "text", out: str = "guardian", judge: bool = False, threshold: float = BLOCK_THRESHOLD
) -> DataFrame:
    """Verdict struct: blocked, score, labels, evidence and the mode."""
    n = len(GUARDIAN_RULES)
    staged = with_probes(df, text).selectExpr(
        "*",
        *[f"{_label_evidence(text, pats)} AS __h{k}" for k, (_, _, pats) in enumerate(GUARDIAN_RULES)],
        f"{encoded_payload(text, flag='__plain')} AS __h{n}",
    )
    parts = [(f"__h{k}", label, weight) for k, (label, weight, _) in enumerate(GUARDIAN_RULES)]
    parts.append((f"__h{n}", PAYLOAD_LABEL, PAYLOAD_SCORE))
    if judge:
        staged = staged.withColumn(f"__h{n + 1}", F.when(local_judge(text), F.lit(JUDGE_EVIDENCE)))
        parts.append((f"__h{n + 1}", JUDGE_LABEL, JUDGE_SCORE))
    score = F.lit(0.0)
    for col, _, weight in parts:
        score = score + F.when(F.col(col).isNotNull(), weight).otherwise(0.0)
    score = F.least(F.lit(SCORE_CAP), F.round(score, 2))
    labels = F.filter(
        F.array(*[F.when(F.col(c).isNotNull(), F.lit(label)) for c, label, _ in parts]), lambda x: x.isNotNull()
    )
    evidence = F.filter(
        F.array(*[F.substring(F.col(c), 1, EVIDENCE_CUT) for c, _, _ in parts]), lambda x: x.isNotNull()
    )
    verdict = F.struct(
        (score >= threshold).alias("blocked"),
        score.alias("score"),
        F.array_sort(F.array_distinct(labels)).alias("labels"),
        evidence.alias("evidence"),
        F.lit("deterministic+local-judge" if judge else "deterministic-local").alias("judge_mode"),
    )
    return without_probes(staged.withColumn(out, verdict), df.columns).drop(*[c for c, _, _ in parts])


# What an access log row is checked for.
BLOCKED_FRAGMENTS = ("../", "/.env", "/wp-admin", "/phpmyadmin", "/actuator", "/server-status")
MAX_BODY_BYTES = 524288
PROTECTED_PREFIXES = ("/ask", "/api/v2/chat", "/api/v2/proxy", "/api/v2/audit", "/audit", "/export-audit")


def suspicious_paths(
    df: DataFrame, path: str = "path", size: str = "content_length", fragments: Sequence[str] = BLOCKED_FRAGMENTS,
    verified: Column | None = None,
) -> DataFrame:
    """Deny reason of an access-log row, NULL if it may pass.

    ``size`` may be a string as found in a header. With ``verified`` (client
    certificate accepted) unverified calls of protected paths are denied too.
    """
    p = F.lower(F.col(path))
    bad = F.expr(any_literal(f"lower({path})", fragments))
    length = F.col(size).try_cast("bigint")
    reason = (
        F.when(bad, "NOT_FOUND")
        .when(F.col(size).isNotNull() & (F.col(size).cast("string") != "") & length.isNull(), "INVALID_CONTENT_LENGTH")
        .when(length > MAX_BODY_BYTES, "REQUEST_TOO_LARGE")
    )
    if verified is not None:
        protected = F.lit(False)
        for prefix in PROTECTED_PREFIXES:
            protected = protected | F.startswith(F.col(path), F.lit(prefix))
        reason = reason.when(protected & ~F.coalesce(verified, F.lit(False)), "MTLS_CLIENT_CERT_REQUIRED")
    return df.withColumns({"suspicious": F.coalesce(F.expr(any_literal(f"lower({path})", fragments)), F.lit(False)), "deny_reason": reason})
