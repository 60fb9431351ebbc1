"""Typed differences between two rows, and the condition codes that follow from them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnwork.model import Field

TOLERANCE = 1e-9
#: Positions whose difference has a code of its own.
POSITION_CODES = {"vertical": "position_to_vertical", "overhead": "position_to_overhead"}


def diff_code(field: str, change: Column) -> Column:
    """The field without its unit, and the change."""
    return F.concat(F.lit(field.removesuffix("_mm") + "_"), change)


def diff_rows(fields: Sequence[Field], target: Callable[[str], Column], base: Callable[[str], Column], position: str = "position") -> Column:
    """Array of (ord, field, change, code, before, after, note), in the order of ``fields``.

    Fields that the target lacks give no element. A field that only the target has is changed, with a note.
    """
    out = []
    for n, f in enumerate(fields):
        t, b = target(f.name), base(f.name)
        if f.numeric:
            change = F.when(b.isNull(), "changed").when(F.abs(t - b) <= TOLERANCE, "same").when(t > b, "increase").otherwise("decrease")
        else:
            change = F.when(b.isNull(), "changed").when(t.cast("string") == b.cast("string"), "same").otherwise("changed")
        code = diff_code(f.name, change)
        if f.name == position:
            for value, special in POSITION_CODES.items():
                code = F.when((change == "changed") & b.isNotNull() & (t == value), F.lit(special)).otherwise(code)
        out.append(F.when(t.isNotNull(), F.struct(F.lit(n).alias("ord"), F.lit(f.name).alias("field"), change.alias("change"), code.alias("code"), b.cast("string").alias("before"), t.cast("string").alias("after"), F.when(b.isNull(), F.lit("missing in base")).alias("note"))))
    return F.array_compact(F.array(*out))


def condition_codes(diffs: Column) -> Column:
    """Codes of differences that the graph can have rules for."""
    return F.transform(F.filter(diffs, lambda d: (d["change"] != "same") & ~d["code"].endswith("_changed")), lambda d: d["code"])


def gaps(diffs: Column) -> Column:
    """Messages for differences without rules."""
    return F.transform(F.filter(diffs, lambda d: d["code"].endswith("_changed")), lambda d: F.concat(d["field"], F.lit(": "), F.coalesce(d["before"], F.lit("none")), F.lit(" -> "), d["after"], F.lit(" has no adjustment rule")))


def signature(codes: Column) -> Column:
    return F.array_sort(F.array_distinct(codes))
