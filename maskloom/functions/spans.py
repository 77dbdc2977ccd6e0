"""Regex matches as spans: ``array<struct<start,end,value>>`` columns, all JVM-side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Letters, digits and underscore of any script next to a token. Java's own \b and \w
# disagree with each other on non-ASCII text, so edges are written out.
WORD = r"\p{L}\p{N}_"
LEFT = rf"(?<![{WORD}])"
RIGHT = rf"(?![{WORD}])"
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

SPAN = "array<struct<start:int,end:int,value:string>>"
#: What a pattern may hold that does not bear another pattern around it: references to groups, flags for the rest, quoting, comments.
_REFERENCE = re.compile(r"\\[1-9kGQ]|\(\?[a-zA-Z]*x|#")


#: Items of a block of a walk, and how often blocks are put into blocks; characters of a part of a long text.
BLOCK, LEVELS, PART = 32, 4, 4096
#: Items of a short walk, for which blocks cost more than they save.
SHORT = 128
#: Matches of a text that are looked up one by one.
FEW = 4


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def walk(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Go through an array with a state; all that the steps give out, as one array of ``kind``.

    ``step(state, item)`` -> the next state and an array of what it gives out. What a fold has
    gathered is copied at every step, so a plain fold takes time with the square of what it
    gives out. Here blocks of ``BLOCK`` items gather on their own, then blocks of blocks, so
    that each item is copied a few times whatever the length.
    """
    none = F.lit([]).cast(kind)

    def acc_of(state: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), out.alias("out"))

    def whole(array: Column) -> Column:
        def one(acc: Column, place: Column) -> Column:
            after, given = step(acc["state"], F.get(array, place))
            return acc_of(after, F.when(F.size(given) > 0, F.concat(acc["out"], given)).otherwise(acc["out"]))

        def gather(state: Column, first: Column, level: int) -> Column:
            width = BLOCK**level
            count = F.least(F.floor((F.size(array) - 1 - first) / (width // BLOCK)).cast("int"), F.lit(BLOCK - 1)) if level <= LEVELS else F.floor((F.size(array) - 1) / (width // BLOCK)).cast("int")
            start = acc_of(state, none)
            if level == 1:
                return F.aggregate(F.sequence(first, first + count), start, one)

            def join(acc: Column, number: Column) -> Column:
                inner = gather(acc["state"], first + number * (width // BLOCK), level - 1)
                # a fold over one item names the inner result once
                return F.aggregate(F.array(inner), acc, lambda a, r: acc_of(r["state"], F.concat(a["out"], r["out"])))

            return F.aggregate(F.sequence(F.lit(0), count), start, join)

        def plain(acc: Column, item: Column) -> Column:
            after, given = step(acc["state"], item)
            return acc_of(after, F.when(F.size(given) > 0, F.concat(acc["out"], given)).otherwise(acc["out"]))

        long = gather(state, F.lit(0), LEVELS + 1)["out"]
        short = F.aggregate(array, acc_of(state, none), plain, lambda acc: acc["out"])
        return F.when(F.size(array) > SHORT, long).when(F.size(array) > 0, short).otherwise(none)

    return let(items, whole)


def parts_of(text: Column) -> Column:
    """The text in parts of ``PART`` characters, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PART}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end``, without a walk from the text's first character."""
    first, last = F.floor(start / PART).cast("int"), F.floor((end - 1) / PART).cast("int")
    head, tail = F.get(parts, first), F.get(parts, last)
    at = start - first * PART + 1
    several = F.concat(
        F.substring(head, at, F.lit(PART)),
        F.when(last - first > 1, F.array_join(F.transform(F.sequence(first + 1, last - 1), lambda i: F.get(parts, i)), "")).otherwise(F.lit("")),
        F.substring(tail, F.lit(1), end - last * PART),
    )
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(head, at, end - start)).otherwise(several)


def unicode_edges(pattern: str) -> str:
    """Rewrite ``\\b`` as an edge between a word character of any script and the rest."""
    edge = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
    return pattern.replace(r"\b", edge)


def without_edges(pattern: str) -> str:
    """A cheaper pattern that matches wherever ``pattern`` does: its edges taken away."""
    if "(?!" in pattern or "(?<!" in pattern:
        return pattern
    return pattern.replace(r"\b", "")


def _gaps(text: Column, pattern: str, found: Column) -> Column:
    """The text before each match. ``split`` would compile the pattern anew for each row; it is left to
    empty matches, and to patterns that refer to their own groups, which a group around the gap would renumber."""
    split = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    if _REFERENCE.search(pattern):
        return split
    before = F.regexp_extract_all(text, F.lit(rf"\G((?s:.*?))(?:{pattern})"), F.lit(1))
    return F.when(F.exists(found, lambda hit: hit == ""), split).otherwise(before)


def _span(start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))


def _looked_up(text: Column, found: Column) -> tuple[Column, Column]:
    """Whether each of a few matches is in the text once only, and their spans if so."""

    def once(hit: Column) -> Column:
        return F.position(hit, text, F.position(hit, text) + 1) == 0

    def span(hit: Column) -> Column:
        start = F.position(hit, text) - 1
        return _span(start, start + F.length(hit), hit)

    return (F.size(found) <= FEW) & F.forall(found, once), F.transform(found, span).cast(SPAN)


def regex_spans(text: Column, pattern: str, test: str | None = None) -> Column:
    """Every non-overlapping match with its half-open character offsets.

    ``test`` is a cheap pattern found in every text that ``pattern`` matches. It runs
    first; only rows that pass pay for the pass that gives the matches. A few matches that
    are in the text once only are looked up in it; else a second pass gives the text between
    them. Most rows of most tables have no match at all.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(pos: Column, s: Column) -> tuple[Column, Column]:
        start = pos + F.length(s["gap"])
        end = start + F.length(s["hit"])
        return end, F.array(_span(start, end, s["hit"]))

    def spans(f: Column) -> Column:
        single, direct = _looked_up(text, f)
        steps = F.arrays_zip(f, _gaps(text, pattern, f)).cast("array<struct<hit:string,gap:string>>")
        return F.when(single, direct).otherwise(walk(steps, F.lit(0), SPAN, step))

    return F.when(text.rlike(test or pattern), let(found, spans)).otherwise(F.lit([]).cast(SPAN))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (a_end > b_start)
