"""Pattern recognizers: policy regexes, built-in entities, partial masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from maskloom.functions.spans import LEFT, RIGHT, SPACE, regex_spans, unicode_edges, without_edges
from maskloom.policy import Policy

FINDING = "array<struct<entity_type:string,start:int,end:int,value:string,score:double,phase:string>>"
BASE_THRESHOLD = 0.4

EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"
PHONE = r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{2}[ .-]?[0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = (
    r"(?:[3-6][0-9]{15}|[3-6][0-9]{3}(?:-[0-9]{4}){3}|[3-6][0-9]{3}(?: [0-9]{4}){3}"
    r"|3[47][0-9]{13}|3[47][0-9]{2}-[0-9]{6}-[0-9]{5}|3[47][0-9]{2} [0-9]{6} [0-9]{5})"
)

# The shapes of partly masked numbers.
PARTIAL_PATTERNS = (
    ("US_SSN", r"[*X]{3}-[*X]{2}-[0-9]{4}"),
    ("CREDIT_CARD", r"[*X]{4}-[*X]{4}-[*X]{4}-[0-9]{4}"),
    ("PHONE_NUMBER", r"\([*X]{3}\)[%s]*[*X]{3}-[0-9]{4}"),
)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid_ssn(value: Column) -> Column:
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
    return ~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000")


def valid_card(value: Column) -> Column:
    return F.call_function("luhn_check", digits(value))


# entity, pattern, cheap test, score, check on the matched text
BUILTIN: tuple[tuple[str, str, str, float, Callable[[Column], Column] | None], ...] = (
    ("EMAIL_ADDRESS", rf"(?<![A-Za-z0-9]){EMAIL}{RIGHT}", "[A-Za-z0-9._%+-]@[A-Za-z0-9-]", 1.0, None),
    ("PHONE_NUMBER", rf"{LEFT}{PHONE}{RIGHT}", "[2-9][0-9]{2}[ .-]?[0-9]{4}", 0.75, None),
    ("US_SSN", rf"{LEFT}{SSN}{RIGHT}", "-[0-9]{2}-[0-9]{4}", 0.85, valid_ssn),
    ("CREDIT_CARD", rf"{LEFT}{CARD}{RIGHT}", "[3-6][0-9]{3}[- ]?[0-9]{4}[- ]?[0-9]{2}", 1.0, valid_card),
)


def _findings(text: Column, entity: str, pattern: str, test: str, score: float, phase: str, check=None) -> Column:
    spans = regex_spans(text, pattern, test)
    if check is not None:
        spans = F.filter(spans, lambda s: check(s["value"]))
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(entity).alias("entity_type"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            s["value"].alias("value"),
            F.lit(float(score)).alias("score"),
            F.lit(phase).alias("phase"),
        ),
    )


def custom_findings(text: Column, policy: Policy) -> Column:
    parts = [
        _findings(text, r.entity, unicode_edges(r.pattern), without_edges(r.pattern), r.score, "recognizer")
        for r in policy.recognizers
        if r.score >= BASE_THRESHOLD
    ]
    return F.concat(*parts) if parts else F.lit([]).cast(FINDING)


def builtin_findings(text: Column, entities=None) -> Column:
    parts = [
        _findings(text, entity, pattern, test, score, "recognizer", check)
        for entity, pattern, test, score, check in BUILTIN
        if entities is None or entity in entities
    ]
    return F.concat(*parts) if parts else F.lit([]).cast(FINDING)


def partial_findings(text: Column) -> Column:
    test = "[*X]-[0-9]{4}"  # all of them have it, so most texts are tested once
    found = F.concat(*[_findings(text, entity, p.replace("%s", SPACE), test, 1.0, "partial") for entity, p in PARTIAL_PATTERNS])
    return F.when(text.rlike(test), found).otherwise(F.lit([]).cast(FINDING))


def pattern_findings(text: Column, policy: Policy) -> Column:
    """All regex findings of one text as one array, for the entities the policy names."""
    return F.concat(custom_findings(text, policy), builtin_findings(text, set(policy.entity_names())))
