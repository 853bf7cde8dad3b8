"""The rule tables of the scanners, as data.

``regex`` is the Java form without the flags that ``JAVA_FLAGS`` adds.
``probes`` are literals of which at least one must occur in the text for the
pattern to be able to match; ``folded`` says that they are looked up in the
case-folded text. ``digits`` names a shared digit probe. Probes only skip work.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

# Unicode classes and word boundaries, and only \n as a line end.
JAVA_FLAGS = "(?Ud)"

SECRET, CLASSIFICATION, INDIA_PII, PII = "SECRET", "CLASSIFICATION", "INDIA_PII", "PII"
PROMPT_INJECTION, SEMANTIC_DLP = "PROMPT_INJECTION", "SEMANTIC_DLP"


@dataclass(frozen=True)
class Pattern:
    label: str
    regex: str
    type: str
    confidence: str = "HIGH"
    redaction_tag: str | None = None
    dpdp_category: str | None = None
    probes: tuple[str, ...] = ()
    folded: bool = False
    digits: str | None = None  # None, "any" (a digit) or "four" (four in a row)

    @property
    def java(self) -> str:
        """The Java form. Where the first character of every match is known, a
        look-ahead tests it before the costlier word boundary."""
        return JAVA_FLAGS + _first_character(self.regex) + word_classes(self.regex)

    @property
    def java_plain(self) -> str:
        """The same for texts of plain letters, in which Java's own word boundary is right and cheaper."""
        return JAVA_FLAGS + _first_character(self.regex) + self.regex

    @property
    def core(self) -> str | None:
        """What some run of a text (``RUN``) holds if a pattern of digits matches: the pattern without its boundaries."""
        if not self.digits:
            return None
        return JAVA_FLAGS + re.sub(r"\\b|\(\?<[!=][^()]*\)", "", self.regex).replace("[LUu]", "")

    @property
    def whole_words(self) -> bool:
        """The pattern is an alternation of words that stand alone."""
        return self.regex.startswith(r"(?i)\b(") and self.regex.endswith(r")\b")


# Java counts combining marks and join controls as word characters; here, as in
# the rules' own language, only letters, numbers and the underscore are.
_WORD = r"\p{L}\p{N}_"
_BOUNDARY = rf"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"


# What a text of plain letters has none of: ASCII, Latin letters and common punctuation are left out. In these,
# Java and the rules' own language agree on word characters.
NOT_PLAIN = r"[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u00a0\u00a7\u00ab\u00b0\u00bb\u2010-\u2015\u2018-\u201e\u2026\u20ac]"
ASCII_RUN = r"[\x00-\x7f]+"
# In a text of plain letters, the core of every match of a pattern of digits lies within one such run.
RUN = r"[A-Z0-9\s\u00a0-]{4,}+"


def word_classes(regex: str) -> str:
    r"""The regex with every \b, \w and \W spelt out."""
    out, inside, i = [], False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            pair = regex[i : i + 2]
            if pair == r"\w":
                out.append(_WORD if inside else f"[{_WORD}]")
            elif pair == r"\W":
                out.append(f"[^{_WORD}]")
            elif pair == r"\b" and not inside:
                out.append(_BOUNDARY)
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]":
            inside = False
        out.append(c)
        i += 1
    return "".join(out)


# Letters outside ASCII that case-insensitive matching equates with i, k and s.
_ALSO = {"i": "İı", "k": "K", "s": "ſ"}


def _first_character(regex: str) -> str:
    known = re.match(r"(?:\(\?<!\\?[+\w]\))*\\b(?:\(\?:)?(\[[^\]]*\]|\\d|[A-Z0-9])", regex)
    if known:
        return f"(?={known[1]})"
    words = re.match(r"\(\?i\)(?:\\b)?\(([\w :|\\/.-]+)\)", regex)
    if not words:
        return ""
    firsts = {w.lstrip("\\")[0].lower() for w in words[1].split("|")}
    return "(?=[" + "".join(re.escape(c) + c.upper() * c.isalpha() + _ALSO.get(c, "") for c in sorted(firsts)) + "])"


def _words(regex: str) -> tuple[str, ...]:
    """Probe literals of a pattern that is one plain alternation of words."""
    inner = regex[regex.index("(", 4) + 1 : regex.rindex(")")]
    return tuple(w.replace(r"\b", "").replace("\\", "").lower() for w in inner.split("|"))


def _alternation(label: str, regex: str, type_: str, **kw) -> Pattern:
    return Pattern(label, regex, type_, probes=_words(regex), folded=True, **kw)


# Labels, patterns and their order decide the results.
SECRET_PATTERNS = (
    Pattern("AWS Token", r"AKIA[0-9A-Z]{16}", SECRET, probes=("AKIA",)),
    Pattern(
        "Secret Key",
        r"(?i)(key|secret|token|pass|auth|api)[:=]\s*[a-zA-Z0-9/+=]{30,}",
        SECRET,
        probes=tuple(w + s for w in ("key", "secret", "token", "pass", "auth", "api") for s in ":="),
        folded=True,
    ),
    Pattern("PII (SSN)", r"\b\d{3}-\d{2}-\d{4}\b", SECRET, probes=("-",), digits="four"),
    Pattern("Credit Card", r"\b(?:\d[ -]*?){13,16}\b", SECRET, digits="any"),
    Pattern("SSH Key", r"-----BEGIN (RSA|OPENSSH|DSA|EC|PGP) PRIVATE KEY-----", SECRET, probes=("-----BEGIN ",)),
    # The look-behind keeps a long run of letters from being tried at each of its characters.
    Pattern(
        "DB String",
        r"(?<![a-zA-Z0-9])([a-zA-Z0-9]+)://([a-zA-Z0-9]+):([a-zA-Z0-9]+)@([a-zA-Z0-9\.-]+)",
        SECRET,
        probes=("://",),
    ),
    Pattern(
        "Environment File",
        r"(?i)(\.env|\.history|\.bash_history|\.ssh/id_rsa)",
        SECRET,
        probes=(".env", ".history", ".bash_history", ".ssh/id_rsa"),
        folded=True,
    ),
)

# Fixed values.
CLASSIFICATION_PATTERNS = tuple(
    _alternation(label, regex, CLASSIFICATION, confidence="MEDIUM")
    for label, regex in (
        ("System Intrusion", r"(?i)(bash -i|rm -rf /|nc -e /bin/sh|exploit|payload|reverse shell|sudo -l)"),
        ("Legal/Compliance", r"(?i)(NDA|Confidentiality|Plaintiff|Defendant|Lawsuit|Agreement)"),
        ("Medical/HIPAA", r"(?i)(Patient|Diagnosis|Medical Record|HIPAA|PHI|NPI)"),
    )
)

# Fixed values.
_INDIA = (
    Pattern("Aadhaar Number", r"(?<!\+)\b[2-9]\d{3}(\s\d{4}\s\d{4}|\d{8})\b", INDIA_PII, digits="four"),
    Pattern("PAN Card", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", INDIA_PII, digits="four"),
    Pattern("Voter ID", r"\b[A-Z]{3}[0-9]{7}\b", INDIA_PII, digits="four"),
    Pattern("Passport (India)", r"\b[A-PR-WY][1-9]\d\s?\d{4}[1-9]\b", INDIA_PII, digits="four"),
    Pattern("Driving License (India)", r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{4}[0-9]{7}\b", INDIA_PII, digits="four"),
    Pattern("GST Number", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", INDIA_PII, digits="four"),
    Pattern("UPI ID", r"\b[a-zA-Z0-9.\-_]{2,49}@[a-zA-Z]{2,}\b", INDIA_PII, probes=("@",)),
    Pattern("IFSC Code", r"\b[A-Z]{4}0[A-Z0-9]{6}\b", INDIA_PII, probes=("0",), digits="any"),
    Pattern("Indian Bank Account", r"(?<!\+)(?<!\d)\b[0-9]{9,16}\b", INDIA_PII, digits="four"),
    Pattern("MICR Code", r"\b[0-9]{9}\b", INDIA_PII, digits="four"),
    Pattern("UHID (Hospital ID)", r"\bUHID[-\s]?[A-Z0-9]{6,12}\b", INDIA_PII, probes=("UHID",)),
    Pattern("NPI (Indian Doctor)", r"\bMCI[-\s]?[0-9]{6}\b", INDIA_PII, probes=("MCI",)),
    Pattern("Ayushman Bharat ID", r"\b\d{2}-\d{4}-\d{4}-\d{4}\b", INDIA_PII, digits="four", probes=("-",)),
    Pattern("Indian Mobile", r"(?:(?<=\s)|(?<=^))(?:\+91|0)?[6-9]\d{9}\b", INDIA_PII, digits="four"),
    Pattern("Indian Landline", r"\b0\d{2,4}[-\s]?\d{6,8}\b", INDIA_PII, digits="four"),
    Pattern("Indian Pincode", r"\b[1-9][0-9]{5}\b", INDIA_PII, digits="four"),
    Pattern(
        "Email Address (India Context)",
        r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[A-Za-z]{2,}\b",
        INDIA_PII,
        probes=("@",),
    ),
    Pattern("CIN (Company ID)", r"\b[LUu]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}\b", INDIA_PII, digits="four"),
    Pattern("LLPIN", r"\bAAA[-]?\d{4}\b", INDIA_PII, probes=("AAA",)),
    Pattern("TAN Number", r"\b[A-Z]{4}\d{5}[A-Z]\b", INDIA_PII, digits="four"),
    Pattern("FSSAI License", r"\b[1-2]\d{13}\b", INDIA_PII, digits="four"),
    _alternation(
        "Caste / Tribe Reference", r"(?i)\b(scheduled caste|sc\b|scheduled tribe|st\b|OBC|backward class)\b", INDIA_PII
    ),
    _alternation("Religious Identity", r"(?i)\b(hindu|muslim|christian|sikh|jain|buddhist|parsi|jewish)\b", INDIA_PII),
    _alternation("Political Opinion", r"(?i)\b(BJP|INC|congress|AAP|DMK|AIADMK|voter preference)\b", INDIA_PII),
    _alternation(
        "Health Data (India-specific)",
        r"(?i)\b(HIV|AIDS|cancer|tuberculosis|TB|mental health|psychiatric)\b",
        INDIA_PII,
    ),
    _alternation(
        "Biometric Reference", r"(?i)\b(fingerprint|iris scan|retina|face recognition|biometric)\b", INDIA_PII
    ),
)

# Display tags; every other label shows DEFAULT_INDIA_TAG.
DEFAULT_INDIA_TAG = "[REDACTED_INDIA_PII]"
INDIA_TAGS = {
    "Aadhaar Number": "[REDACTED_AADHAAR]",
    "PAN Card": "[REDACTED_PAN]",
    "Voter ID": "[REDACTED_VOTER_ID]",
    "GST Number": "[REDACTED_GST]",
    "UPI ID": "[REDACTED_UPI]",
    "Indian Mobile": "[REDACTED_PHONE]",
    "UHID (Hospital ID)": "[REDACTED_UHID]",
    "Ayushman Bharat ID": "[REDACTED_ABHA]",
    "Caste / Tribe Reference": "[REDACTED_SENSITIVE_CATEGORY]",
    "Religious Identity": "[REDACTED_SENSITIVE_CATEGORY]",
    "Health Data (India-specific)": "[REDACTED_HEALTH]",
    "Biometric Reference": "[REDACTED_BIOMETRIC]",
}

# The labels of the SENSITIVE category; the others are PERSONAL.
SENSITIVE_LABELS = (
    "Aadhaar Number",
    "PAN Card",
    "Voter ID",
    "Passport (India)",
    "Driving License (India)",
    "Caste / Tribe Reference",
    "Religious Identity",
    "Political Opinion",
    "Health Data (India-specific)",
    "Biometric Reference",
    "UHID (Hospital ID)",
    "Ayushman Bharat ID",
)

INDIA_PATTERNS = tuple(
    replace(
        p,
        redaction_tag=INDIA_TAGS.get(p.label, DEFAULT_INDIA_TAG),
        dpdp_category="SENSITIVE" if p.label in SENSITIVE_LABELS else "PERSONAL",
    )
    for p in _INDIA
)

US_PATTERNS = SECRET_PATTERNS + CLASSIFICATION_PATTERNS
ALL_PATTERNS = US_PATTERNS + INDIA_PATTERNS

# Aliases used in pseudonym tokens.
TOKEN_ALIASES = {
    "Aadhaar Number": "Aadhaar",
    "PAN Card": "PAN",
    "IFSC Code": "IFSC",
    "Indian Mobile": "Phone",
    "Indian Bank Account": "BankAccount",
    "UHID (Hospital ID)": "UHID",
    "Passport (India)": "Passport",
    "GST Number": "GST",
}

# Weights of the two scores.
RISK_WEIGHTS = {SECRET: 2.5, PII: 1.0, CLASSIFICATION: 0.8}
SENSITIVE_TERMS = ("aadhaar", "pan", "passport", "bank", "health", "biometric")
SENSITIVITY_WEIGHTS = {SECRET: 3.0, "term": 2.0, INDIA_PII: 1.25, PII: 1.25, CLASSIFICATION: 0.75}
SCORE_CAP = 10.0


def sensitivity_weight(label: str, type_: str) -> float:
    """Weight of one finding of a known pattern."""
    if type_ == SECRET:
        return SENSITIVITY_WEIGHTS[SECRET]
    if any(term in label.lower() for term in SENSITIVE_TERMS):
        return SENSITIVITY_WEIGHTS["term"]
    return SENSITIVITY_WEIGHTS.get(type_, 0.0)


# The self-check labels a healthy scanner must find in its fixture.
REQUIRED_LABELS = (
    "Aadhaar Number",
    "PAN Card",
    "IFSC Code",
    "Indian Mobile",
    "UPI ID",
    "GST Number",
    "Credit Card",
    "PII (SSN)",
)
