"""Many rules matched in one pass over the texts, by an automaton over all their keywords.

Keywords are patterns. The longest piece that every match of a pattern holds
is its anchor; plain keywords are their own. One automaton finds all anchors
of a text at once, so the cost of a text does not grow with the number of
rules. Only patterns whose anchor is found are tried as patterns, in the JVM.
Labels and thresholds are looked up beside it, so a row needs no join.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import JAVA_FLAGS, word_classes
from .detect import folded

EVERYWHERE = "*"  # key of the global rules
META = "struct<rule_ord:int,name:string,description:string,enforcement:string,allowed_models:array<string>>"
_FOUND = f"array<struct<rule:{META},patterns:array<string>>>"
#: A letter, digit or harmless sign of ASCII stands for itself; these end a piece, and the last two make what precedes them uncertain.
_PLAIN = re.compile(r"[\x20-\x7e]")
_SPECIAL = set(".^$*+?{}[]\\|()")


def is_plain(keyword: str) -> bool:
    return bool(keyword) and all(_PLAIN.match(c) and c not in _SPECIAL for c in keyword)


def anchor(keyword: str) -> str:
    """The longest plain piece that every match of the pattern holds, in lower case; "" if none is certain."""
    if is_plain(keyword):
        return keyword.lower()
    if any(c in keyword for c in "(|") or "\\Q" in keyword or "[^" in keyword and "]" not in keyword:
        return ""
    pieces, piece, i = [], "", 0
    while i < len(keyword):
        c = keyword[i]
        if c == "\\" and i + 1 < len(keyword):
            after = keyword[i + 1]
            i += 2
            if not after.isalnum() and _PLAIN.match(after):
                piece += after
            elif after in "bB":
                pieces, piece = [*pieces, piece], ""
            elif after in "dDsSwWhHvVtnrf":
                pieces, piece = [*pieces, piece], ""
            else:
                return ""  # a code, a class with a name, a group: not worth the care
            continue
        if c == "[":
            end = keyword.find("]", i + 2)
            if end < 0 or "[" in keyword[i + 1 : end] or "\\" in keyword[i + 1 : end]:
                return ""
            pieces, piece, i = [*pieces, piece], "", end + 1
            continue
        if c in "*?{":
            pieces, piece = [*pieces, piece[:-1]], ""
            if c == "{":
                i = keyword.find("}", i)
                if i < 0:
                    return ""
        elif c in ".^$+" or not _PLAIN.match(c):
            pieces, piece = [*pieces, piece], ""
        else:
            piece += c
        i += 1
    return max([*pieces, piece], key=len).lower()


def pattern_of(keyword: str) -> str:
    return JAVA_FLAGS + "(?i)" + keyword.replace(r"\b", word_classes(r"\b"))


class Matcher:
    """Rules in the form that a worker looks up: an automaton, labels, thresholds by department."""

    def __init__(self, rules: Sequence[dict]):
        import ahocorasick

        self.rules = sorted(rules, key=lambda r: r["rule_ord"])
        self.metas = [{k: r[k] for k in ("rule_ord", "name", "description", "enforcement", "allowed_models")} for r in self.rules]
        self.dept = [(r["dept"].upper() if r["dept"] is not None else EVERYWHERE) for r in self.rules]
        self.labels: dict[str, list[int]] = {}
        self.always: list[tuple[int, str | None]] = []
        by_anchor: dict[str, list[tuple[int, str | None]]] = {}
        risks: dict[str, list[tuple[float, int]]] = {}
        for i, r in enumerate(self.rules):
            for label in r["entity_types"] or ():
                self.labels.setdefault(label, []).append(i)
            for k in r["keywords"] or ():
                if k is not None:
                    piece = anchor(k)
                    reason = (i, None if is_plain(k) or k == "" else pattern_of(k))
                    (by_anchor.setdefault(piece, []) if piece else self.always).append(reason)
            if r["risk_threshold"]:
                risks.setdefault(self.dept[i], []).append((float(r["risk_threshold"]), i))
        self.risks = {d: sorted(t) for d, t in risks.items()}
        self.automaton = None
        if by_anchor:
            self.automaton = ahocorasick.Automaton()
            for piece, reasons in by_anchor.items():
                self.automaton.add_word(piece, reasons)
            self.automaton.make_automaton()

    def found(self, text: str | None, labels: Sequence[str] | None, risk: float | None, departments: Sequence[str]) -> list[dict]:
        """Rules that match for certain (no patterns) or if one of their patterns does, in rule order."""
        hits: dict[int, set[str] | None] = {}

        def add(i: int, pattern: str | None) -> None:
            if self.dept[i] in departments:
                if pattern is None:
                    hits[i] = None
                elif (held := hits.setdefault(i, set())) is not None:
                    held.add(pattern)

        for label in labels if labels is not None else ():
            for i in self.labels.get(label, ()):
                add(i, None)
        if risk is not None and risk == risk:
            for d in departments:
                limits = self.risks.get(d, [])
                for _, i in limits[: bisect_right(limits, (risk, len(self.rules)))]:
                    add(i, None)
        if text is not None:
            seen = {id(reasons): reasons for _, reasons in self.automaton.iter(text)} if self.automaton else {}
            for reasons in (*seen.values(), self.always):
                for i, pattern in reasons:
                    add(i, pattern)
        return [{"rule": self.metas[i], "patterns": sorted(hits[i] or ())} for i in sorted(hits)]


def match_keywords(df: DataFrame, rules: Sequence[dict], text: str, labels: str, risk: str, departments: Column, out: str) -> DataFrame:
    """Add the matched rules of every row, in rule order; ``rules`` are of a checked number and go to every task once."""
    shared = df.sparkSession.sparkContext.broadcast([dict(r) for r in rules])

    @F.pandas_udf(_FOUND)
    def search(batches: pd.Series, names: pd.Series, scores: pd.Series, depts: pd.Series) -> pd.Series:
        held = search_state
        if not held:
            held.append(Matcher(shared.value))
        return pd.Series([held[0].found(*row) for row in zip(batches, names, scores, depts)], dtype=object)

    search_state: list[Matcher] = []
    found = df.withColumn("__found", search(F.expr(folded(text)), F.col(labels), F.col(risk).cast("double"), departments))
    holds = lambda x: (F.size(x["patterns"]) == 0) | F.exists(x["patterns"], lambda p: F.rlike(F.col(text), p))
    return found.withColumn(out, F.transform(F.filter("__found", holds), lambda x: x["rule"])).drop("__found")
