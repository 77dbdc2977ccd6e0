"""Greedy span choice inside one overlap cluster, and splicing replacements into text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from maskloom.functions.spans import cut, let, overlaps, parts_of


def splice(text: Column, edits: Column) -> Column:
    """Rebuild ``text`` from the gaps between ``edits`` and their replacements.

    ``edits``: ``array<struct<start,end,replacement>>``, sorted, not overlapping.
    """

    def whole(parts: Column) -> Column:
        def one(edit: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(edits, i - 1)["end"])
            return F.concat(cut(parts, before, edit["start"]), edit["replacement"])

        last = F.get(edits, F.size(edits) - 1)["end"].cast("int")
        return F.concat(F.array_join(F.transform(edits, one), ""), cut(parts, last, F.greatest(last, F.length(text))))

    walked = let(parts_of(text), whole)
    return F.when(F.size(edits) > 0, walked).otherwise(text)


def keep_greedy(ranked: Column, kind: str) -> Column:
    """Walk spans in rank order, keep each one that overlaps nothing kept before it."""
    return F.aggregate(
        ranked,
        F.lit([]).cast(kind),
        lambda kept, s: F.when(
            F.exists(kept, lambda k: overlaps(s["start"], s["end"], k["start"], k["end"])), kept
        ).otherwise(F.array_append(kept, s)),
    )
