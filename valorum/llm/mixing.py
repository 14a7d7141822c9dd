"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its id. A source takes each document ``floor(target / size)``
times, and once more those whose hash is at most a threshold. To find it nothing is sorted: word
counts are summed by source and hash bucket (``2**bits`` buckets), the running sum tells the bucket in
which the remaining budget ends, and only that bucket is summed again by the next bits, until it holds a single
hash. That hash is taken if this brings the source nearer to its budget. A larger budget has a larger threshold
on the same hashes, so mixes are nested.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valorum.llm.common import WORD, fresh, stored, text_of

HASH_BITS = 60
FEW_SOURCES = 10_000  # limits of so many sources are broadcast: a name and two numbers each


def hash60(column: str, seed: str = "mix") -> str:
    """SQL of a 60-bit hash of an id (null: of the word null); DuckDB can compute it too."""
    return (f"cast(conv(substr(md5(concat('{seed}:', coalesce(cast(`{column}` as string), 'null'))), 1, 15), 16, 10)"
            " as bigint)")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0,
                   cap: float = 3.0) -> DataFrame:
    """(skey, source, source_size, target) from (skey, source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn. Targets share ``share`` of all words by
    weight, but stop at ``cap`` times the source's size; the excess goes to the others by weight. In closed
    form: with the sources ordered by cap / weight, every split into capped and open ones gives a level that
    is at most the true one, which the right split attains. One row per source; the windows see no documents.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((number - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    spent = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    t = t.withColumn("level", (total - spent) / rest)
    level = F.max("level").over(Window.partitionBy())
    return t.withColumn("target", F.least("cap", level * F.col("w"))).select(
        "skey", "source", "source_size", "target")


def _thresholds(rows: DataFrame, targets: DataFrame, bits: int) -> DataFrame:
    """(skey, epochs, threshold): the extra time goes to hashes up to the threshold."""
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    open_ = targets.withColumn("epochs", epochs.cast("long")).select(
        "skey", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("left"),
        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    shift = HASH_BITS
    while shift > 0:
        shift = max(0, shift - bits)
        cell = F.shiftright("h", shift)
        if shift + bits >= HASH_BITS:
            sums = rows.groupBy("skey", cell.alias("cell")).agg(
                F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).join(open_, "skey")
        else:
            inside = rows.withColumn("prefix", F.shiftright("h", shift + bits)).join(open_, ["skey", "prefix"])
            sums = inside.groupBy("skey", "epochs", "left", "before", cell.alias("cell")).agg(
                F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = Window.partitionBy("skey").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(run), F.lit(0)))
        # The budget ends in the cell whose running sum first exceeds it.
        ends = sums.where((F.col("start") <= F.col("left")) & (F.col("start") + F.col("n") > F.col("left")))
        open_ = stored(ends.select("skey", "epochs", "left", F.col("cell").alias("prefix"),
                                   F.col("start").alias("before"), "n", "lo", "hi"), "mix-bounds")
        if not open_.where("lo < hi").limit(1).count():
            break
        open_ = open_.drop("n", "lo", "hi")
    nearer = F.col("before") + F.col("n") - F.col("left") < F.col("left") - F.col("before")
    return open_.select("skey", "epochs", F.when(nearer, F.col("hi")).otherwise(F.col("lo") - 1).alias("threshold"))


def _source_key(source_col: str) -> Column:
    """A key without nulls: no source begins like the null one's."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit(""))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float,
          cap: float, bits: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, skey, size, h, cell), the filled (skey, cell), and by skey the targets and the limits (epochs, threshold)."""
    rows = stored(docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"),
        _source_key(source_col).alias("skey"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"),
        F.expr(hash60(id_col)).alias("h")), "mix-rows").withColumn("cell", F.shiftright("h", HASH_BITS - bits))
    # Words by source and first bucket; a source's sum and the final join both go by it, so no key is hot.
    cells = stored(rows.groupBy("skey", "source", "cell").agg(F.sum("size").alias("n")), "mix-cells")
    sizes = cells.groupBy("skey", "source").agg(F.sum("n").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, cap), "mix-targets")
    limits = _thresholds(rows.drop("cell"), targets.where("source_size > 0"), bits)
    return rows.drop("source"), cells.select("skey", "cell"), targets.drop("source"), limits


def _copies(h: Column) -> Column:
    return F.coalesce(F.col("epochs") + (h <= F.col("threshold")).cast("long"), F.lit(0).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, bits: int = 10) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies.

    Size is the number of words (null text: 0); taken = copies * size, copies at most ``cap`` rounded up. Null ids hash
    alike, and rows that repeat an id are taken or left together. A null source is a source of its own,
    the last. Sources without words have target 0 and take nothing. An empty table gives an empty result; other
    columns are ignored.
    """
    rows, cells, targets, limits = _plan(docs, id_col, text_col, source_col, weights, share, cap, bits)
    plan = cells.join(targets, "skey").join(limits, "skey", "left")
    return (rows.join(plan, ["skey", "cell"]).withColumn("copies", _copies(F.col("h")))
            .select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: float = 3.0, bits: int = 10) -> DataFrame:
    """The mix itself: every input row as often as it is taken, all columns as they are.

    Up to ``FEW_SOURCES`` sources, counted first, their limits go to the tasks that read the documents and no text is
    shuffled; with more, documents and limits meet by source and hash bucket.
    """
    _, cells, targets, limits = _plan(docs, id_col, text_col, source_col, weights, share, cap, bits)
    skey, cell, h, plan_col = (fresh(x, docs.columns) for x in ("mix_source", "mix_cell", "mix_hash", "mix_plan"))
    few = targets.count() <= FEW_SOURCES
    plan = limits if few else cells.join(limits, "skey", "left").withColumnRenamed("cell", cell)
    on = [skey] if few else [skey, cell]
    plan = plan.withColumnRenamed("skey", skey).select(*on, F.struct("epochs", "threshold").alias(plan_col))
    rows = docs.withColumn(skey, _source_key(source_col)).withColumn(h, F.expr(hash60(id_col)))
    rows = rows.withColumn(cell, F.shiftright(h, HASH_BITS - bits)).join(F.broadcast(plan) if few else plan, on, "left")
    copies = F.coalesce(F.col(plan_col)["epochs"] + (F.col(h) <= F.col(plan_col)["threshold"]).cast("long"), F.lit(0))
    times = F.array_repeat(F.lit(1), copies.cast("int"))
    once = fresh("mix_copy", docs.columns)
    return rows.withColumn(once, F.explode(times)).select(*[F.col(f"`{c}`") for c in docs.columns])
