"""Entity resolution by name: exact normalised match, then token-set similarity.

The similarity join is exact and never forms all pairs:

* identical token sets are merged on both sides first (a name shared by a third
  of all rows becomes one set);
* every set keeps only its prefix of rarest tokens (global order: frequency as
  counted by hash, then the hash), ``n - ceil(t * n) + 1`` tokens long: two sets with
  Jaccard >= t always share a prefix token (prefix-filter principle);
* candidates come from an equi-join on prefix tokens, judged in it by the least number
  of tokens they differ in (places of the shared token, parity bits of what follows), and
  are verified with the exact Jaccard, for each left set the most promising first.

Prefix tokens are the rare ones, so hot tokens only meet in sets made of hot
tokens alone, which the set merge has already collapsed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.functions.text import name_tokens, normalize_name
from valorum.operators.latest import latest_per_key, order_struct

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
SIMILARITY_THRESHOLD = 0.72
LABEL_EXACT = "exato"
LABEL_TOKEN_PREFIX = "token "
LABEL_NO_MATCH = "SEM MATCH"
# ---------------------------------------------------------------------------

_EPS = 1e-9


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def name_profile(df: DataFrame, id_col: str, name_col: str, year_col: str | None = None,
                 materialize: bool = True) -> DataFrame:
    """(_id, [_year], _norm, _toks, _sid): normalised name, sorted token set and the set's id, computed once.

    With ``materialize`` the profile is written as a work table, so the text
    pipeline runs once however many branches read it.
    """
    from valorum.session import spread

    cols = [F.col(id_col).alias("_id")]
    if year_col is not None:
        cols.append(F.col(year_col).alias("_year"))
    prof = spread(df.select(*cols, F.col(name_col).alias("_name")))
    prof = prof.select(*[c for c in prof.columns if c != "_name"], normalize_name("_name").alias("_norm"))
    prof = prof.withColumn("_toks", F.sort_array(name_tokens("_norm", normalized=True)))
    prof = prof.withColumn("_sid", set_id("_toks"))
    if materialize:
        from valorum.session import work_table
        prof = work_table(prof, "name-profile")
    return prof


def best_per_name(rprof: DataFrame) -> DataFrame:
    """A3: per normalised name, the entity with the newest year (then the smallest id)."""
    return latest_per_key(rprof.select("_norm", "_id", "_year"), "_norm", ["_year", ("_id", "asc")],
                          columns=["_id", "_year"])


def _exact(lprof: DataFrame, rprof: DataFrame) -> DataFrame:
    best = best_per_name(rprof).select("_norm", F.col("_id").alias("_match"))
    return lprof.join(best, "_norm", "left")


def exact_match(left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str,
                right_name: str, right_year: str) -> DataFrame:
    """(left_id, match_id) by equal normalised name; match_id is null without a match."""
    lprof = name_profile(left, left_id, left_name, materialize=False)
    rprof = name_profile(right, right_id, right_name, right_year, materialize=False)
    return _exact(lprof, rprof).select(F.col("_id").alias(left_id), F.col("_match").alias("match_id"))


def set_id(toks: str) -> Column:
    """Compact id of a sorted token set: two independent hashes and the size (96 bits + size).

    Used only to route rows through joins; every score is computed on the arrays.
    """
    return F.struct(F.xxhash64(toks).alias("h1"), F.hash(toks).alias("h2"), F.size(toks).alias("n"))


def _token_ids(toks: str = "_toks") -> Column:
    """A set's tokens as 64-bit hashes: candidates meet on integers, scores are computed on the arrays."""
    return F.transform(toks, lambda t: F.xxhash64(t))


# Tokens are counted by hash in at most so many counters: one row of 4 MB, whatever the number of tokens. Tokens that share a
# counter only look more frequent than they are; any order that both sides share is right, so this costs candidates, never matches.
_COUNTER_BITS = 20
# A posting's key: the token's frequency level above so many bits of its hash. Equal keys of two tokens cost candidates only, too.
_HASH_BITS = 55
# Parity words of 64 bits that a posting carries; a set has as many or more (a power of two times), about a bit for each token.
_POSTING_WORDS = 4
_MOST_WORDS = 1024
# With more postings than this the candidates are written, so that the postings' shuffle files go before any array moves.
_POSTINGS_IN_ONE_PLAN = 1_000_000


def _counters(*sets: DataFrame) -> int:
    """A power of two, about one counter for 16 tokens of the sets."""
    total = _tokens(*sets)
    return 1 << min(_COUNTER_BITS, max(0, total.bit_length() - 4))


def _tokens(*sets: DataFrame) -> int:
    return sum(s.agg(F.sum("_sid.n")).first()[0] or 0 for s in sets)


def _token_counts(counters: int, *sets: DataFrame) -> DataFrame:
    """One row: the array ``_counts`` of how many sets have a token of each counter (plus one, so none is missing)."""
    found = sets[0].sparkSession.range(counters).select(F.col("id").alias("_k"))
    for s in sets:
        found = found.unionAll(s.select(F.explode(_token_ids()).alias("tok")).select(F.pmod("tok", F.lit(counters)).alias("_k")))
    counts = found.groupBy("_k").agg(F.least(F.count(F.lit(1)), F.lit(2**31 - 1)).cast("int").alias("_n"))
    return counts.agg(F.sort_array(F.collect_list(F.struct("_k", "_n"))).getField("_n").alias("_counts"))


def parity_words(toks: str = "_toks") -> Column:
    """A set's parity signature: every token flips one bit of an array of 64-bit words.

    The signatures of two sets differ in at most as many bits as the sets differ in tokens. A power of two of words, so a longer
    signature is brought to a shorter one's length by XOR of its parts.
    """
    def word(marked, w):
        begin, end = (F.array_position(marked, (w + k).cast("long") * 128).cast("int") for k in (0, 1))
        return F.aggregate(F.slice(marked, begin + 1, end - begin - 1), F.lit(0).cast("long"), lambda x, v: x.bitwiseXOR(_bit(F.shiftright(v, 1))))

    def marked(words):
        """Sorted, each word's mark (even) stands before its tokens' bits (odd)."""
        last = (words * 64 - 1).cast("long")
        bits = F.transform(_token_ids(toks), lambda h: F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH_BITS).bitwiseAND(last), 1).bitwiseOR(F.lit(1).cast("long")))
        return F.sort_array(F.concat(bits, F.transform(F.sequence(F.lit(0), words), lambda w: w.cast("long") * 128)))

    wanted = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.size(toks), F.lit(1)) / F.lit(64.0)))).cast("int")
    words = F.least(F.greatest(wanted, F.lit(_POSTING_WORDS)), F.lit(_MOST_WORDS))
    # transform(array(x), ...)[0] computes x once.
    return F.transform(F.array(words), lambda length: F.transform(F.array(marked(length)), lambda a: F.transform(
        F.sequence(F.lit(0), length - 1), lambda w: word(a, w)))[0])[0]


def _bit(place: Column) -> Column:
    """The bit that a token flips in its word, from the low six bits of its place."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def _folded(words: Column, length) -> Column:
    """A signature brought to ``length`` words (a power of two, at most its own)."""
    parts = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.aggregate(
        F.sequence(i, F.size(words) - 1, length), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get(words, j))))
    return F.when(F.size(words) == length, words).otherwise(parts)


def _parity_distance(left: str, right: str) -> Column:
    """In how many bits two signatures differ: at most the number of tokens that only one of the sets has."""
    length = F.least(F.size(left), F.size(right))
    differ = F.zip_with(_folded(F.col(left), length), _folded(F.col(right), length), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda acc, x: acc + x)


def _prefix_tokens(sets: DataFrame, counts: DataFrame, counters: int, threshold: float) -> DataFrame:
    """(set number, size, position, token, previous token, parity words) for the prefix of rarest tokens of each distinct set.

    Positions are 0-based in the global order (level of the count, then the hash). ``_s0``.. are the parity words of the tokens
    after the position. The counts are looked up inside the row, so nothing is shuffled.
    """
    n = F.col("_sid.n")
    overlap = F.ceil(n * threshold - _EPS)
    plen = (n - overlap + 1).cast("int")
    words = F.col("_words") if "_words" in sets.columns else parity_words()
    levels = counts.select(F.transform("_counts", lambda c: F.floor(F.log2(c) * 8).cast("long")).alias("_levels"))
    ranked = F.sort_array(F.transform(_token_ids(), lambda t: F.shiftleft(
        F.element_at("_levels", (F.pmod(t, F.lit(counters)) + 1).cast("int")), _HASH_BITS)
        .bitwiseOR(F.shiftrightunsigned(t, 64 - _HASH_BITS))))
    names = [f"_s{k}" for k in range(_POSTING_WORDS)]
    # Where the token's place falls into word k, entry place - 64 * k + 64 * (words - 1) has its bit, else no bit.
    none = [0] * (64 * (_POSTING_WORDS - 1))
    bits = F.lit([*none, *(1 << i for i in range(63)), -1 << 63, *none]).cast("array<bigint>")

    def step(rows, tok):
        last, place = F.element_at(rows, -1), tok.bitwiseAND(F.lit(64 * _POSTING_WORDS - 1)).cast("int")
        after = [last[s].bitwiseXOR(F.get(bits, place + 64 * (_POSTING_WORDS - 1 - k))).alias(s) for k, s in enumerate(names)]
        return F.concat(rows, F.array(F.struct(tok.alias("tok"), last["tok"].alias("_prev"), *after)))

    # In chunks, so that adding a row to the rest copies few of them; a chunk begins with the row before it.
    none, chunk = F.lit(-1).cast("long"), 16
    zero = F.array(F.struct(none.alias("tok"), none.alias("_prev"), *[F.col("_all")[k].alias(s) for k, s in enumerate(names)]))
    chunks = F.aggregate(F.sequence(F.lit(1), plen, F.lit(chunk)), F.array(zero), lambda done, i: F.concat(done, F.array(F.aggregate(
        F.slice("_ranked", i, F.least(F.lit(chunk), plen - i + 1)), F.array(F.element_at(F.element_at(done, -1), -1)), step))))
    rows = F.flatten(F.transform(chunks, lambda c: F.slice(c, 2, chunk)))
    return (sets.withColumn("_levels", levels.scalar()).withColumn("_all", _folded(words, F.lit(_POSTING_WORDS)))
            .withColumn("_ranked", ranked)
            .select("_set", n.alias("_n"), F.posexplode(rows).alias("_pos", "_p"))
            .select("_set", "_n", "_pos", "_p.*"))


def _candidates(lset: DataFrame, rset: DataFrame, counts: DataFrame, counters: int, threshold: float) -> DataFrame:
    """(_lset, _rset, _d): pairs of sets that may reach the threshold, with the least number of tokens they differ in.

    Each pair is judged where it meets, by its first shared token: the tokens before it are not shared, and those after it
    differ at least as their parity words do. Later shared tokens may be judged too harshly; they are not needed.
    """
    def side(sets, x):
        out = _prefix_tokens(sets, counts, counters, threshold)
        return out.withColumnsRenamed({c: f"_{x}{c.lstrip('_')}" for c in out.columns if c != "tok"})

    need = F.ceil((F.col("_ln") + F.col("_rn")) * (threshold / (1.0 + threshold)) - _EPS).cast("int")
    after = F.abs((F.col("_ln") - F.col("_lpos")) - (F.col("_rn") - F.col("_rpos")))
    differ = sum((F.bit_count(F.col(f"_ls{k}").bitwiseXOR(F.col(f"_rs{k}"))) for k in range(1, _POSTING_WORDS)),
                 F.bit_count(F.col("_ls0").bitwiseXOR(F.col("_rs0"))))
    least = F.col("_lpos") + F.col("_rpos") + F.greatest(after, differ)
    # The planner sizes the prefixes by the sets' files, before they are exploded, so it must not choose to broadcast them.
    # A shared token right after another shared one need not make the pair again.
    shared = (side(lset, "l").join(side(rset, "r").hint("merge"), "tok")
              .where((F.col("_lpos") <= F.col("_ln") - need) & (F.col("_rpos") <= F.col("_rn") - need)
                     & ((F.col("_lprev") != F.col("_rprev")) | (F.col("_lprev") == -1))
                     & (least <= F.col("_ln") + F.col("_rn") - need * 2)))
    first = F.min(F.shiftleft(F.col("_lpos").cast("long"), 32).bitwiseOR(least.cast("long")))
    return (shared.groupBy("_lset", "_rset").agg(first.alias("_first"))
            .select("_lset", "_rset", F.col("_first").bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("_d")))


def _token_best(lids: DataFrame, lset: DataFrame, rset: DataFrame, threshold: float) -> DataFrame:
    """(_id, _rid, _j): best right entity per left row (_id, _sid) with Jaccard >= threshold, from each side's distinct sets.

    Candidates that the parity signatures of the whole sets still allow are verified on the full arrays, many of them in two rounds:
    first, for each left set, the one that could score best; then only those that could still beat it.
    """
    from valorum.session import drop_table, work_table

    counters = _counters(lset, rset)
    postings = (1.0 - threshold) * _tokens(lset, rset)
    large = postings > _POSTINGS_IN_ONE_PLAN

    def kept(df, label):
        return work_table(df, label) if large else df

    # Global token order: frequency over both sides' distinct sets, then the token.
    counts = work_table(_token_counts(counters, lset, rset), "token-counts")
    cand = kept(_candidates(lset, rset, counts, counters, threshold), "candidates")
    prefer = order_struct(rset, ["_year", ("_id", "asc")])
    lpart = lset.select(F.col("_set").alias("_lset"), F.col("_sid.n").alias("_ln"), F.col("_words").alias("_lwords"))
    rpart = rset.select(F.col("_set").alias("_rset"), F.col("_sid.n").alias("_rn"), F.col("_words").alias("_rwords"),
                        F.col("_id").alias("_rid"), F.col("_year").alias("_ryear"), (F.lit(None) if prefer is None else prefer).alias("_prefer"))
    size, least = F.col("_ln") + F.col("_rn"), F.greatest("_d", _parity_distance("_lwords", "_rwords"))
    pairs = kept(cand.join(lpart, "_lset").join(rpart, "_rset")
                 .withColumn("_d", least).withColumn("_most", (size - F.col("_d")) / (size + F.col("_d")))
                 .where(F.col("_most") >= threshold).select("_lset", "_rset", "_most", "_rid", "_ryear", "_prefer"), "pairs")

    def verified(pairs):
        l_arr = lset.select(F.col("_set").alias("_lset"), "_sid", F.col("_toks").alias("_ltoks"))
        r_arr = rset.select(F.col("_set").alias("_rset"), F.col("_toks").alias("_rtoks"))
        inter = F.size(F.array_intersect("_ltoks", "_rtoks"))
        return (pairs.join(l_arr, "_lset").join(r_arr, "_rset")
                .withColumn("_j", inter / (F.size("_ltoks") + F.size("_rtoks") - inter)).drop("_ltoks", "_rtoks"))

    order = ["_ryear", ("_rid", "asc")]
    if large:
        first = work_table(verified(latest_per_key(pairs, "_lset", ["_most", *order])), "first-scores")
        seen = first.select("_lset", F.col("_rset").alias("_seen"), F.col("_prefer").alias("_than"),
                            F.when(F.col("_j") >= threshold, F.col("_j")).otherwise(-1.0).alias("_score"))
        better = F.coalesce(F.col("_prefer") > F.col("_than"), F.lit(True)) if prefer is not None else F.lit(True)
        rest = (pairs.join(seen, "_lset").where((F.col("_rset") != F.col("_seen")) & (
            (F.col("_most") > F.col("_score")) | ((F.col("_most") == F.col("_score")) & better))).select(pairs.columns))
        scored = first.unionByName(verified(rest)).where(F.col("_j") >= threshold)
    else:  # few pairs: one round, so the plan holds their join once
        scored = verified(pairs).where(F.col("_j") >= threshold)
    best = kept(latest_per_key(scored, "_sid", ["_j", *order], columns=["_rid", "_j"]), "best-scores")
    if large:
        for done in (cand, pairs, first, lset, rset):
            drop_table(done)
    return lids.join(best, "_sid").select("_id", "_rid", "_j")


def _left_sets(marked: DataFrame) -> DataFrame:
    """Distinct token sets of the left rows, numbered, with their signatures; written once.

    ``marked(_sid, _toks, _open)``: a set is kept if any of its rows is open; rows that only open a set have no tokens.
    """
    from valorum.session import work_table

    sets = (marked.where(F.col("_sid.n") > 0).groupBy("_sid").agg(F.first("_toks", ignorenulls=True).alias("_toks"), F.max("_open").alias("_open"))
            .where("_open").drop("_open"))
    return work_table(sets.withColumn("_words", parity_words()).withColumn("_set", F.monotonically_increasing_id()), "left-sets")


def _right_sets(rprof: DataFrame) -> DataFrame:
    """Distinct token sets of the right rows with their best entity, numbered, with their signatures; written once."""
    from valorum.session import work_table

    rows = rprof.select("_id", "_year", "_sid", "_toks").where(F.col("_sid.n") > 0)
    sets = latest_per_key(rows, "_sid", ["_year", ("_id", "asc")], columns=["_id", "_year", "_toks"])
    return work_table(sets.withColumn("_words", parity_words()).withColumn("_set", F.monotonically_increasing_id()), "right-sets")


def token_match(left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str,
                right_name: str, right_year: str, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Best right entity per left row with Jaccard >= threshold.

    Best = highest Jaccard, then the newest year, then the smallest id. Empty token
    sets never match. Returns (left_id, match_id, jaccard) for matched rows only.
    """
    from valorum.session import drop_table, work_table

    # Only the sets are needed; the normalised names are not written. A profile goes as soon as its sets are written.
    lprof = work_table(name_profile(left, left_id, left_name, materialize=False).drop("_norm"), "name-profile")
    lset = _left_sets(lprof.select("_sid", "_toks", F.lit(True).alias("_open")))
    lids = work_table(lprof.select("_id", "_sid"), "left-rows")
    drop_table(lprof)
    rprof = work_table(name_profile(right, right_id, right_name, right_year, materialize=False).drop("_norm"), "name-profile")
    rset = _right_sets(rprof)
    drop_table(rprof)
    best = _token_best(lids, lset, rset, threshold)
    return best.select(F.col("_id").alias(left_id), F.col("_rid").alias("match_id"), F.col("_j").alias("jaccard"))


def token_label(j) -> Column:
    """'token 0.xx' with the score rounded half-even on its binary value, like Python's '%.2f'."""
    return F.concat(F.lit(LABEL_TOKEN_PREFIX), F.format_number(_c(j), 2))


def resolve_entities(left: DataFrame, left_id: str, left_name: str, right: DataFrame, right_id: str,
                     right_name: str, right_year: str, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Exact match first; token similarity only for the rows exact matching missed.

    Returns every left row as (left_id, match_id, how, jaccard); ``how`` is
    'exato', 'token 0.xx' or 'SEM MATCH'. Each side's names are normalised and
    tokenised once (work tables), and equal names meet by a 256-bit digest; the exact
    result is a work table too, as both the token branch and the final labelling read it.
    """
    from valorum.session import drop_table, work_table

    def profile(*args):
        prof = name_profile(*args, materialize=False)
        return work_table(prof.withColumn("_norm", F.unhex(F.sha2("_norm", 256))), "name-profile")

    lprof = profile(left, left_id, left_name)
    rprof = profile(right, right_id, right_name, right_year)
    ex = work_table(_exact(lprof.drop("_toks"), rprof).select("_id", "_sid", "_match"), "exact-match")
    missed = ex.where(F.col("_match").isNull())
    no_tokens = F.lit(None).cast("array<string>").alias("_toks")
    lset = _left_sets(lprof.select("_sid", "_toks", F.lit(False).alias("_open"))
                      .unionAll(missed.select("_sid", no_tokens, F.lit(True).alias("_open"))))
    drop_table(lprof)
    rset = _right_sets(rprof)
    drop_table(rprof)
    tok = _token_best(missed.select("_id", "_sid"), lset, rset, threshold)
    j = ex.select("_id", "_match").join(tok, "_id", "left")
    how = (F.when(F.col("_match").isNotNull(), F.lit(LABEL_EXACT))
           .when(F.col("_rid").isNotNull(), token_label("_j")).otherwise(F.lit(LABEL_NO_MATCH)))
    return j.select(F.col("_id").alias(left_id), F.coalesce("_match", "_rid").alias("match_id"), how.alias("how"),
                    F.when(F.col("_match").isNull(), F.col("_j")).alias("jaccard"))
