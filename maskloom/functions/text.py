"""Small text predicates and formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from maskloom.functions.spans import SPACE, WORD
from maskloom.policy import NOTICE, Policy

EMAIL_SHAPE = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}$"
HTML_TAG = rf"</?[a-zA-Z][a-zA-Z0-9-]*[{SPACE}/>]"


def strip(value: Column) -> Column:
    return F.regexp_replace(value, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(value: Column) -> Column:
    return value.isNull() | ~value.rlike(rf"[^{SPACE}]")


def words(value: Column) -> Column:
    return F.filter(F.split(value, rf"[{SPACE}]+"), lambda w: w != "")


def looks_like_email(value: Column) -> Column:
    return strip(value).rlike(EMAIL_SHAPE)


def looks_like_html(value: Column) -> Column:
    return value.rlike(HTML_TAG)


def name_rejected(value: Column, policy: Policy) -> Column:
    """Hard rejections that come before any lookup."""
    bare = strip(value)
    bad = blank(value) | (F.length(bare) > 80) | bare.rlike(r"[_\p{Nd}]")
    terms = sorted({term.lower() for term in policy.allow_list})
    if terms:
        bad = bad | F.exists(words(bare), lambda w: F.lower(w).isin(*terms))
    return bad


def name_structure(value: Column) -> Column:
    """Two or more capitalised words of name characters only."""
    bare = strip(value)
    parts = words(bare)
    return (
        bare.rlike(rf"^[{WORD}{SPACE}'\-.]+$")
        & (F.size(parts) >= 2)
        & F.forall(parts, lambda w: F.rtrim(w, F.lit(".")).rlike(r"^\p{Lu}"))
    )


def preview(value: Column) -> Column:
    n = F.length(value)
    return F.when(
        n > 4, F.concat(F.left(value, F.lit(2)), F.repeat(F.lit("*"), n - 4), F.right(value, F.lit(2)))
    ).otherwise(F.lit("****"))


def with_notice(text: Column, masked: Column, policy: Policy) -> Column:
    if not policy.notice:
        return text
    return F.when(masked > 0, F.concat(text, F.lit("\n\n" + NOTICE))).otherwise(text)


def content_with_notice(content: Column, kind: T.DataType, masked: Column, policy: Policy) -> Column:
    """The same for a result of any shape: behind a string, or as one more item of a list."""
    if isinstance(kind, T.StringType):
        return with_notice(content, masked, policy)
    if not policy.notice:
        return content
    item = F.lit(NOTICE)
    if isinstance(kind.elementType, T.StructType):
        given = {"type": F.lit("text"), "text": F.lit(NOTICE)}
        item = F.struct(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.elementType.fields])
    return F.when(masked > 0, F.array_append(content, item)).otherwise(content)


def json_quoted(value: Column) -> Column:
    """The value as a JSON string body (no outer quotes)."""
    wrapped = F.to_json(F.struct(value.alias("v")))
    return F.substring(wrapped, F.lit(7), F.length(wrapped) - 8)


def html_quoted(value: Column) -> Column:
    out = F.replace(value, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#39;"))
