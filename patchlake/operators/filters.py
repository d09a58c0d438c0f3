"""Search filters: module, tag and source, empty or NULL meaning no filter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("module", "tag", "source")


def matches(module: Column, tag: Column, source: Column, doc: str = "") -> Column:
    """True when the document row satisfies every filter that is set."""

    def unset(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) == ""

    d = f"{doc}." if doc else ""
    return (
        (unset(module) | F.coalesce(F.array_contains(F.col(d + "modules"), module), F.lit(False)))
        & (unset(tag) | F.coalesce(F.col(d + "tag") == tag, F.lit(False)))
        & (unset(source) | F.coalesce(F.col(d + "source") == source, F.lit(False)))
    )


def literal_filter(module: str | None, tag: str | None, source: str | None) -> Column | None:
    """The same for known values; only the set ones appear, so scans can use them."""
    tests = []
    if module:
        tests.append(F.array_contains("modules", module))
    if tag:
        tests.append(F.col("tag") == tag)
    if source:
        tests.append(F.col("source") == source)
    out = None
    for test in tests:
        out = test if out is None else out & test
    return out
