"""One query per operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valorum.llm import (ann, mixing, packing, pii, quality, runs, secret_scan, sharding, simhash, tokens, toxicity,
                         whitening, winnow)
from valorum.llm.common import WORD, read

QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def seen_label():
    """Labels that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    return toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), seen_label())


@query
def op1_inverted_multi_index(spark: SparkSession, d: str) -> DataFrame:
    return ann.search(read(spark, d, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@query
def op2_toxicity(spark: SparkSession, d: str) -> DataFrame:
    scored = toxicity.score(read(spark, d, "documents"), toxicity_model(spark, d))
    return scored.select("doc_id", F.coalesce(~seen_label(), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op3_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_counts(read(spark, d, "documents"), *tokens.tokenizer_files(), limit=512)


@query
def op4_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(pii.find_pii(read(spark, d, "documents")))


@query
def op5_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(read(spark, d, "documents"), weights=(1, 2, 3), share=1.0, cap=3.0).drop("copies")


@query
def op6_winnowing(spark: SparkSession, d: str) -> DataFrame:
    return winnow.compare_edits(read(spark, d, "documents"))


@query
def op7_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read(spark, d, "documents"), *tokens.tokenizer_files(), end_id=2, size=1024)


@query
def op8_shard_by_splitters(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(read(spark, d, "documents"), shards=16)


@query
def op9_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    ledger = secret_scan.Ledger(spark)
    return secret_scan.digest(secret_scan.scan_paths(read(spark, d, "documents"), ledger))


@query
def op10_simhash_bk_trees(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, d, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_spectrum_slicing(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(read(spark, d, "embeddings"), components=32)


@query
def op12_run_detection(spark: SparkSession, d: str) -> DataFrame:
    return runs.digest(runs.find_runs(runs.plant(read(spark, d, "documents")), least=6, times=4))


@query
def op13_byte_cnn_quality(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    scored = quality.score(docs, quality.fit(docs, read(spark, d, "labels"), seen_label()))
    return scored.select("doc_id", F.coalesce(~seen_label(), F.lit(False)).alias("held_out"), "score", "predicted")


_HASH = "('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15))::BIGINT"
_WORD = WORD.replace("'", "''")

ORACLE_SQL["op5_mix_sources"] = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS skey, {_HASH} AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT skey, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY skey),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         source_size * 3.0::DOUBLE AS cap FROM src),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT skey, source_size,
         least(cap, max(level) OVER () * w) AS target
  FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM targets),
cells AS (
  SELECT skey, h, CAST(sum(size) AS BIGINT) AS n FROM docs GROUP BY skey, h),
run AS (
  SELECT c.skey, c.h, c.n, b.target - b.epochs * b.source_size AS remaining,
         CAST(sum(c.n) OVER (PARTITION BY c.skey ORDER BY c.h) AS BIGINT) AS upto
  FROM cells c JOIN budgets b USING (skey)),
taken AS (
  SELECT skey, h, (upto <= remaining OR (upto - n <= remaining AND upto > remaining
                   AND upto - remaining < remaining - (upto - n)))::INT AS extra FROM run)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST((b.epochs + t.extra) * d.size AS BIGINT) AS taken
FROM docs d JOIN budgets b USING (skey) JOIN taken t USING (skey, h)
"""


# --- spans in SQL: the plain patterns of the contracts (DuckDB's matcher is linear and has no look-around) -------
def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _spans(kind: str, pattern: str) -> str:
    """A row (doc_id, text, kind, s, e, v) for each match."""
    return f"""
SELECT doc_id, text, '{kind}' AS kind, CAST(e - length(v) AS BIGINT) AS s, CAST(e AS BIGINT) AS e, v FROM (
  SELECT doc_id, text, unnest(found) AS v,
         unnest(list_transform(range(1, len(found) + 1), lambda i: list_sum(list_transform(found[1:i], lambda x: length(x)))
                + list_sum(list_transform(parts[1:i], lambda x: length(x))))) AS e
  FROM (SELECT doc_id, text, regexp_extract_all(text, {_q(pattern)}) AS found,
               string_split_regex(text, {_q(pattern)}) AS parts FROM docs) WHERE len(found) > 0)"""


_DOCS = "docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE
    WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT)
    ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(reverse({_DIGITS})[i] AS INT) + 1] END)) % 10 = 0"""


def _mod97(v: str) -> str:
    plain = f"replace({v}, ' ', '')"
    return f"""list_reduce(list_concat([0], list_transform(
    string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''),
    lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)),
    lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1"""


def _in(codes: str) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes.split()) + ")"


def _iban(n: int) -> str:
    """The candidate of n characters at a head, empty where its country has another length."""
    country, known = "substr(rest, 1, 2)", " ".join(pii.IBAN_LENGTHS.values())
    own = f"{country} IN {_in(pii.IBAN_LENGTHS[n])} OR " if n in pii.IBAN_LENGTHS else ""
    pattern = rf"^[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}\b"
    return f"CASE WHEN {own}{country} NOT IN {_in(known)} THEN regexp_extract(rest, {_q(pattern)}) ELSE '' END"


def _near(kind: str) -> str:
    return f"regexp_matches(lower(substr(text, greatest(s - 40, 0) + 1, e - greatest(s - 40, 0) + 40)), {_q(pii.CONTEXT[kind])})"


_CARD = r"[0-9]([\x20-]?[0-9])+"
_IBANS = f"""
SELECT doc_id, text, kind, s, CAST(s + length(v) AS BIGINT) AS e, v FROM (
  SELECT doc_id, text, kind, s, list_filter([{", ".join(_iban(n) for n in range(34, 14, -1))}],
                                            lambda x: x <> '' AND {_mod97("x")})[1] AS v
  FROM (SELECT *, substr(text, s + 1, 68) AS rest FROM ({_spans("iban", r"\b[A-Z]{2}[0-9]{2}")})))
WHERE v IS NOT NULL"""
ORACLE_SQL["op4_pii"] = f"""
WITH {_DOCS},
card_runs AS ({_spans("card", _CARD)}),
base AS (
  SELECT *, 0 AS o FROM ({_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")})
  UNION ALL SELECT *, 1 FROM ({_spans("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")})
    WHERE len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR TRY_CAST(p AS DOUBLE) > 255)) = 0
  UNION ALL SELECT *, 2 FROM card_runs WHERE length({_DIGITS}) BETWEEN 16 AND 19 AND {_LUHN}
  UNION ALL SELECT *, 3 FROM ({_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]")}) WHERE length({_DIGITS}) BETWEEN 8 AND 15),
own AS (
  SELECT *, 4 AS o FROM ({_IBANS})
  UNION ALL SELECT doc_id, text, 'short_card', s, e, v, 5 FROM card_runs
    WHERE length({_DIGITS}) BETWEEN 13 AND 15 AND {_LUHN} AND {_near("short_card")}
  UNION ALL SELECT *, 6 FROM ({_spans("national_id", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")}) WHERE {_near("national_id")}),
spans AS (
  SELECT doc_id, kind, s, e, o FROM base
  UNION ALL SELECT doc_id, kind, s, e, o FROM own
    WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = own.doc_id AND b.s < own.e AND own.s < b.e)),
texts AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_email, count(*) FILTER (WHERE o = 1) AS n_ip,
         count(*) FILTER (WHERE o = 2) AS n_card, count(*) FILTER (WHERE o = 3) AS n_phone,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (WHERE o < 4), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS every
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
       coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs d LEFT JOIN texts t USING (doc_id)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = rf"""(?:{_WORDS})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
_OWN_RULES = (("private_key", secret_scan.PRIVATE_KEY), ("forge_token", r"\bgh[opsur]_[A-Za-z0-9]{36,}"),
              ("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
              ("web_token", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"))
ORACLE_SQL["op9_secret_scan"] = f"""
WITH {_DOCS},
spans AS (
  SELECT doc_id, kind, s, e, 0 AS o FROM ({_spans("assign", _ASSIGN)})
    WHERE length(regexp_replace(v, '^[A-Za-z_]+["'']?[ ]*[:=][ ]*["'']?', '')) >= 6
  UNION ALL SELECT doc_id, kind, s, e, 1 FROM ({_spans("access", "AKIA[A-Z0-9]+")}) WHERE length(v) >= 20
  UNION ALL SELECT doc_id, kind, s, e, 2 FROM ({_spans("hex", "[0-9a-f]{24,}")})
  {"".join(f" UNION ALL SELECT doc_id, kind, s, e, {3 + i} FROM ({_spans(k, p)})" for i, (k, p) in enumerate(_OWN_RULES))}),
texts AS (
  SELECT doc_id, count(*) FILTER (WHERE o = 0) AS n_assign, count(*) FILTER (WHERE o = 1) AS n_access,
         count(*) FILTER (WHERE o = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (WHERE o < 3), '') AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o > 2, s, o) AS every
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs d LEFT JOIN texts t USING (doc_id)
"""
