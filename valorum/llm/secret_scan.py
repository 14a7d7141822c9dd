"""Secret scans with an incremental blob ledger, with built-in functions only.

Every version of a path is content-addressed by the SHA-256 of its text. The ledger (Parquet tables in a shared folder)
records which pairs of blob and rule version have been scanned, and the findings of those that had any. A
scan first asks the ledger by address alone which blobs it has not seen. Only their texts move, once per blob however
many paths hold it: up to ``FEW_BLOBS`` new addresses go to the tasks that read the texts, so of an
unchanged or little changed corpus no old text is shuffled; with more (a first scan, new rules) copies are gathered within
each task and the rest is shuffled once. What is found is appended and the findings of the current rules are
joined back to all paths.

Scans that overlap in time, or a run that is repeated after its write, may record a pair twice; the record of a pair is the
same whoever writes it, and readers take each pair once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valorum.llm.common import stored, text_of
from valorum.llm.spans import joined, tagged, with_spans
from valorum.session import shared_path

RULES = "2"
BASE = ("assign", "access", "hex")
OWN = ("private_key", "forge_token", "chat_token", "web_token")
# Fixed values of the contract; letters of the words in either case, group 2 has 6+ characters:
# (password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)
ASSIGN = (r"(?:[Pp](?i:assword|asswd)|[Ss](?i:ecret)|[Tt](?i:oken)|[Aa](?i:pi_?key))[\x22']?+\x20*+[:=]\x20*+"
          r"[\x22']?+[A-Za-z0-9+/_.=-]++")
ASSIGN_VALUE = r"^[A-Za-z_]+[\x22']?\x20*[:=]\x20*[\x22']?"
ASSIGN_LEAST = 6
# AKIA[A-Z0-9]+ of 20+ characters; [0-9a-f]+ of 24+ characters
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
# The method's own rules.
PRIVATE_KEY = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
FORGE_TOKEN = r"(?<![A-Za-z0-9_])gh[opsur]_[A-Za-z0-9]{36,}+"
CHAT_TOKEN = r"(?<![A-Za-z0-9_])xox[abprs]-[A-Za-z0-9-]{10,}+"
WEB_TOKEN = r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"

FEW_BLOBS = 200_000  # addresses of 64 characters: some 20 MB to each executor
FINDINGS = "array<struct<order:int,kind:string,start:int,end:int>>"


def blob_id(text_col: str = "text") -> Column:
    return F.sha2(text_of(text_col), 256)


def findings_of(blobs: DataFrame) -> DataFrame:
    """(blob, found) for rows (blob, text): base kinds by start then kind, then the own kinds likewise."""
    t = F.col("text")
    df = with_spans(blobs, "text", "assign", ASSIGN, t.rlike("[:=]"))
    df = with_spans(df, "text", "access", ACCESS, F.contains(t, F.lit("AKIA")))
    df = with_spans(df, "text", "hex", HEX)
    df = with_spans(df, "text", "private_key", PRIVATE_KEY, F.contains(t, F.lit("-----BEGIN")))
    df = with_spans(df, "text", "forge_token", FORGE_TOKEN, F.contains(t, F.lit("gh")))
    df = with_spans(df, "text", "chat_token", CHAT_TOKEN, F.contains(t, F.lit("xox")))
    df = with_spans(df, "text", "web_token", WEB_TOKEN, F.contains(t, F.lit("eyJ")))
    long = F.filter("assign", lambda s: F.length(F.regexp_replace(s["value"], ASSIGN_VALUE, "")) >= ASSIGN_LEAST)
    spans = {k: F.col(k) for k in (*BASE, *OWN)} | {"assign": long}

    def by_start(kinds, first: int) -> Column:
        every = F.concat(*[tagged(spans[k], k, first + i) for i, k in enumerate(kinds)])
        key = F.transform(every, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"),
                                                    s["kind"].alias("kind"), s["end"].alias("end")))
        return F.transform(F.array_sort(key), lambda s: F.struct(
            s["order"].alias("order"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    return df.select("blob", F.concat(by_start(BASE, 0), by_start(OWN, len(BASE))).alias("found"))


class Ledger:
    """Scanned (blob, rules) pairs and their findings, as an append-only Parquet table (a null list: none found)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "ledger", uuid.uuid4().hex)

    def records(self) -> DataFrame:
        """All records as they were appended, a pair perhaps more than once (empty before the first scan)."""
        schema = f"blob string, rules string, found {FINDINGS}"
        made = self.spark.createDataFrame([], schema)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return made

    def read(self) -> DataFrame:
        """One record of each pair."""
        return self.records().dropDuplicates(["blob", "rules"])

    def hits(self, rules: str = RULES) -> DataFrame:
        """(blob, found) of the blobs with findings under these rules, each once."""
        found = self.records().where((F.col("rules") == rules) & F.col("found").isNotNull())
        return found.select("blob", "found").dropDuplicates(["blob"])

    def unseen(self, versions: DataFrame, text_col: str = "text", rules: str = RULES) -> DataFrame:
        """(blob, text) once for each blob of ``versions`` that these rules have not scanned."""
        blobs = versions.select(blob_id(text_col).alias("blob"), text_of(text_col).alias("text"))
        seen = self.records().where(F.col("rules") == rules).select("blob")
        if not seen.isEmpty():
            # Addresses alone travel here; the texts are read again, once it is known which are new.
            new = stored(blobs.select("blob").distinct().join(seen, "blob", "left_anti"), "new-blobs")
            few = new.count() <= FEW_BLOBS
            blobs = blobs.join(F.broadcast(new), "blob", "left_semi") if few else blobs.dropDuplicates(["blob"]).join(new, "blob", "left_semi")
        # Copies meet by their address, first within each task, so that a blob of many paths is no hot key.
        return blobs.dropDuplicates(["blob"])

    def scan(self, versions: DataFrame, text_col: str = "text", rules: str = RULES) -> None:
        """Scan the blobs of ``versions`` that this rule version has not seen and record them."""
        found = findings_of(self.unseen(versions, text_col, rules)).select(
            "blob", F.lit(rules).alias("rules"), F.when(F.size("found") > 0, F.col("found")).alias("found"))
        found.write.parquet(f"{self.path}/scan={uuid.uuid4().hex}")


def scan_paths(versions: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text",
               rules: str = RULES) -> DataFrame:
    """One row per input row: doc_id, blob, found (all findings of its text under these rules).

    Null texts count as empty. Null and repeated ids are carried. An empty table gives an empty result and
    records nothing; other columns are ignored.
    """
    ledger.scan(versions, text_col, rules)
    hits = ledger.hits(rules)
    paths = versions.select(F.col(f"`{id_col}`").alias("doc_id"), blob_id(text_col).alias("blob"))
    return paths.join(hits, "blob", "left").select(
        "doc_id", "blob", F.coalesce("found", F.array().cast(FINDINGS)).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, all spans as text."""
    base = F.filter("found", lambda s: s["order"] < len(BASE))
    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))
