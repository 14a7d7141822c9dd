"""Document fingerprints by winnowing, with built-in functions only.

A text is lower-cased and read as units: words (in pieces of at most ``PIECE`` code points), single code
points of scripts written without spaces and single other signs; white space is dropped. So a passage has the
same units wherever it stands, but for the rest of a word it begins within. Every k-gram of units has a
rolling polynomial hash modulo 2^31 - 1, made for all positions at once by doubling shifts. From
each window of w successive k-grams the smallest hash is chosen, the rightmost on ties; equal choices of
neighbouring windows are kept once, with their position. A text shorter than a window has one choice,
one shorter than a k-gram one hash of all it has.

Guarantee: two texts that share a run of w + k - 1 units share a chosen hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valorum.llm.common import fresh, stored, text_of

PIECE = 12
# Scripts whose words are not parted by spaces.
UNSPACED = "".join(r"\p{Is%s}" % s for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"))
UNITS = r"[\p{L}\p{M}\p{N}&&[^%s]]{1,%d}+|[^\x20\x09-\x0D]" % (UNSPACED, PIECE)
PRIME = (1 << 31) - 1
BASE = 1_000_003
PLACE = 31  # bits for the position beside a 31-bit hash


def with_winnow(df: DataFrame, text: str, out: str, k: int = 5, w: int = 8, modulus: int = PRIME) -> DataFrame:
    """Add ``out``: the chosen k-grams as an array of ``hash << 31 | (2^31 - 1 - position)``, by position.

    Each array is a column of its own, so that no step is evaluated twice.
    """
    unit, pack, low = (fresh(f"{out}_{x}", df.columns) for x in ("unit", "pack", "low"))
    df = df.withColumn(unit, F.transform(F.regexp_extract_all(F.lower(F.col(text)), F.lit(UNITS), F.lit(0)),
                                         lambda u: F.pmod(F.xxhash64(u), F.lit(modulus))))
    def joined(n: int):
        """Polynomial of two neighbours, the second n units long."""
        power = F.lit(pow(BASE, n, modulus))
        return lambda x, y: (x * power + y) % F.lit(modulus)

    grams, span = [unit], 1
    while span * 2 <= k:
        a, n = F.col(grams[-1]), F.greatest(F.size(grams[-1]) - span, F.lit(0))
        name = fresh(f"{out}_gram{span * 2}", df.columns)
        df = df.withColumn(name, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(span + 1), n), joined(span)))
        grams.append(name)
        span *= 2

    every, done = F.col(grams[-1]), span
    while done < k:
        half = max(h for h in (2**e for e in range(len(grams))) if h <= k - done)
        rest, n = grams[half.bit_length() - 1], F.greatest(F.size(unit) - (done + half - 1), F.lit(0))
        every = F.zip_with(F.slice(every, F.lit(1), n), F.slice(F.col(rest), F.lit(done + 1), n), joined(half))
        done += half

    # The smaller number has the smaller hash, and on ties the larger position.
    top = F.lit((1 << PLACE) - 1).cast("long")
    whole = F.aggregate(F.col(unit), F.lit(0).cast("long"), lambda a, u: (a * F.lit(BASE) + u) % F.lit(modulus))
    df = df.withColumn(pack, F.when(F.size(unit) >= k, F.transform(every, lambda h, i: F.shiftleft(h, PLACE) + top - i)).when(
        F.size(unit) > 0, F.array(F.shiftleft(whole, PLACE) + top)).otherwise(F.array().cast("array<long>")))
    # Window minima by doubling.
    steps, span = [pack], 1
    while span < w:
        by = min(span, w - span)
        span += by
        a, n, name = F.col(steps[-1]), F.greatest(F.size(steps[-1]) - by, F.lit(0)), fresh(f"{out}_{span}", df.columns)
        df = df.withColumn(name, F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n),
                                            lambda x, y: F.least(x, y)))
        steps.append(name)
    df = df.withColumn(low, F.when(F.size(pack) >= w, F.col(steps[-1])).when(F.size(pack) > 0, F.array(F.array_min(pack)))
                       .otherwise(F.array().cast("array<long>")))
    return df.withColumn(out, F.array_distinct(low)).drop(low, *grams, *steps)


def hashes(chosen: Column) -> Column:
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, PLACE).cast("int")))


def as_text(chosen: Column) -> Column:
    """hash@position, comma-joined."""
    top = F.lit((1 << PLACE) - 1).cast("long")
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(
        "@", F.shiftright(x, PLACE), top - x.bitwiseAND(top))), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, w: int = 8) -> DataFrame:
    """One row per input row: doc_id, chosen (array of hash and position). Null text counts as empty: no choice."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return with_winnow(base, "text", "chosen", k, w).select("doc_id", "chosen")


def successors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, next_id, next_mark, want) for every distinct id, ascending, nulls first; after the last comes the first.

    ``next_mark`` is the least text hash among rows with the next id: it says which of them is meant if an id
    repeats. ``want``: a quarter of the longest text of the id. Ids are range-partitioned, so no task sees them
    all; the ranges' first ids are few.
    """
    text = text_of(text_col)
    ids = docs.groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(
        F.min(F.xxhash64(text)).alias("mark"), F.max(F.floor(F.char_length(text) / 4)).cast("int").alias("want"))
    ranged = stored(ids.repartitionByRange(F.col("doc_id").asc_nulls_first())
                    .withColumn("part", F.spark_partition_id()), "successor-ids")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first())
    entry = F.struct(F.col("doc_id").alias("id"), F.col("mark").alias("mark"))
    ranged = ranged.withColumn("next", F.lead(entry).over(inside)).withColumn("no", F.row_number().over(inside))
    heads = ranged.where("no = 1").select("part", entry.alias("head"))
    over = Window.orderBy("part")
    after = heads.select("part", F.coalesce(F.lead("head").over(over), F.first("head").over(over)).alias("after"))
    return (ranged.join(after, "part").withColumn("next", F.coalesce("next", "after"))
            .select("doc_id", F.col("next.id").alias("next_id"), F.col("next.mark").alias("next_mark"), "want"))


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, w: int = 8) -> DataFrame:
    """Fingerprints of each text and of an edited copy, and their likeness to each other and to the next text's.

    Edited: the last floor(n_chars / 4) code points are replaced by the first as many (or all) of the next
    document by ascending id. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, one row per input row. Null texts count as empty; a null id is the smallest. If an
    id repeats, the next document is the row of that id with the least text hash. An
    empty table gives an empty result; other columns are ignored.
    """
    id_type = dict(docs.dtypes)[id_col]

    def key(column: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(""))

    # Fingerprinted once, where the documents lie, and shuffled once: both joins below read the same exchange.
    base = docs.select(key(id_col).alias("k"), text_of(text_col).alias("text"))
    base = with_winnow(base, "text", "own", k, w)
    nxt = successors(docs, id_col, text_col)
    nxt = nxt.select(key("doc_id").alias("wanted_by"), key("next_id").alias("k"), "next_mark", "want")
    # What a document lends to the one before it: the start of its text, as much as any text there can want, and its hashes.
    # (An equality of hashes would become a second join key, and so a second exchange.)
    lender = base.join(nxt, "k").where(F.xxhash64("text").bitwiseXOR(F.col("next_mark")) == 0)
    lent = (lender.select(F.col("wanted_by").alias("k"), F.expr("substring(text, 1, want)").alias("start"),
                          hashes(F.col("own")).alias("next_hashes")).dropDuplicates(["k"]))
    n = F.char_length("text").cast("long")
    cut = F.floor(n / 4).cast("int")
    df = base.join(lent, "k", "left").withColumn("n_chars", n)
    edited = F.concat(F.substr(F.col("text"), F.lit(1), (n - cut).cast("int")),
                      F.substr(F.coalesce(F.col("start"), F.lit("")), F.lit(1), cut))
    df = with_winnow(df.withColumn("edited", edited), "edited", "changed", k, w)
    df = df.withColumns({"h_own": hashes(F.col("own")), "h_changed": hashes(F.col("changed"))})
    doc_id = F.when(F.col("k") != "", F.substr(F.col("k"), F.lit(2)).cast(id_type)).alias("doc_id")
    return df.select(doc_id, "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                     as_text(F.col("own")).alias("fingerprint"), as_text(F.col("changed")).alias("edited_fingerprint"),
                     likeness(F.col("h_own"), F.col("h_changed")).alias("near_edited"),
                     likeness(F.col("h_own"), F.col("next_hashes")).alias("near_next"))
