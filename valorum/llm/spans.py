"""Positions of pattern matches with built-in functions only.

Spark returns what a pattern matches but not where. The places follow from the pieces between the
matches: ``split`` and ``regexp_extract_all`` walk the same leftmost non-overlapping matches, so the
running sum of piece and match lengths (code points) gives every start and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.llm.common import fresh

SPAN = "struct<start:int,end:int,value:string>"


def running(values: Column, combine, zero) -> Column:
    """Inclusive running ``combine`` of an array by doubling steps: n log n work, no appended arrays."""
    n = F.size(values)
    # One step more than the logarithm asks for, so that its rounding cannot matter.
    steps = F.when(n > 1, F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int"))).otherwise(
        F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        far = F.least(F.pow(F.lit(2.0), i).cast("int"), F.size(acc))
        moved = F.concat(F.array_repeat(F.lit(zero), far), F.slice(acc, F.lit(1), F.size(acc) - far))
        return F.zip_with(acc, moved, combine)

    return F.aggregate(steps, values, step)


def with_spans(df: DataFrame, text: str, out: str, pattern: str, wanted: Column | None = None) -> DataFrame:
    """Add array ``out`` of (start, end, value) for the pattern's matches, ends exclusive.

    ``wanted``: a cheap condition that a text with matches meets; other texts are not searched.
    """
    found, size, ends = (fresh(f"{out}_{x}", df.columns) for x in ("found", "size", "ends"))
    none = F.array().cast("array<string>")
    every = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn(found, every if wanted is None else F.when(wanted, every).otherwise(none))
    pieces = F.split(F.col(text), pattern, -1)
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.col(found),
                         lambda a, b: F.char_length(a) + F.char_length(b))
    df = df.withColumn(size, F.when(F.size(found) > 0, lengths))
    df = df.withColumn(ends, running(F.col(size), lambda a, b: a + b, 0))
    spans = F.zip_with(F.col(ends), F.col(found), lambda e, v: F.struct(
        (e - F.char_length(v)).alias("start"), e.alias("end"), v.alias("value")))
    return df.withColumn(out, F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))).drop(found, size, ends)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """Spans with their kind and its place in the list of kinds."""
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"),
                                                 s["start"].alias("start"), s["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def near(text: Column, span: Column, words: str, width: int = 40) -> Column:
    """Whether one of the words (a pattern) occurs up to ``width`` code points before or after a span."""
    lo = F.greatest(span["start"] - width, F.lit(0))
    return F.lower(F.substring(text, lo + 1, span["end"] - lo + width)).rlike(words)
