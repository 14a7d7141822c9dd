"""Landing-file readers and versioned writers.

Every reader takes an explicit schema (no inference on production paths).
Writers never overwrite a path that may be read: each write goes to a new
version directory and readers pick the newest complete one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, LongType, StringType, StructField,
                               StructType)

from valorum.functions.classify import classify_control
from valorum.functions.text import clean_registry_sector

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's.
# ---------------------------------------------------------------------------
REGISTRY_SEPARATOR = ";"
REGISTRY_ENCODING = "ISO-8859-1"
REGISTRY_CODE_WIDTH = 6
GOVERNANCE_FIELD = "market"
# ---------------------------------------------------------------------------

TICKER_LIST_SCHEMA = StructType([StructField("ticker", StringType()), StructField("empresa", StringType())])
REGISTRY_SCHEMA = StructType([StructField("CD_CVM", StringType()), StructField("SETOR_ATIV", StringType()),
                              StructField("CONTROLE_ACIONARIO", StringType())])
SNAPSHOT_SCHEMA = StructType([StructField("stocks", ArrayType(StructType([
    StructField("stock", StringType()), StructField("close", DoubleType()),
    StructField("market_cap", DoubleType())])))])
INDICATOR_FIELDS = ("dy", "p_l", "p_vp", "receitas_cagr5", "roe", "dividaliquidaebit", "lpa", "valormercado",
                    "liquidezmediadiaria")
INDICATOR_SCHEMA = StructType([StructField("list", ArrayType(StructType(
    [StructField(c, StringType()) for c in ("ticker", "sectorname", "subsectorname", "segmentname")]
    + [StructField(c, DoubleType()) for c in INDICATOR_FIELDS])))])
META_SCHEMA = StructType(
    [StructField(c, StringType()) for c in ("ticker", "nome", "setor", "subsetor", "segmento", "perfil", "tamanho",
                                            "gov", "ctrl", "modelo")]
    + [StructField("tags", ArrayType(StringType())), StructField("monitored", BooleanType())]
    + [StructField(c, DoubleType()) for c in ("g1", "ke", "gp", "lpa", "payout")])


def read_ticker_list(spark: SparkSession, path: str) -> DataFrame:
    """Quoted UTF-8 CSV with header ``ticker,empresa``."""
    return (spark.read.schema(TICKER_LIST_SCHEMA).option("header", True).option("quote", '"')
            .option("escape", '"').option("encoding", "UTF-8").csv(path))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """S2: ';'-separated Latin-1 registry extract, all columns as text."""
    return (spark.read.schema(REGISTRY_SCHEMA).option("header", True).option("sep", REGISTRY_SEPARATOR)
            .option("encoding", REGISTRY_ENCODING).csv(path))


def pad_code(col, width: int = REGISTRY_CODE_WIDTH) -> Column:
    """Left-pad a code with zeros to ``width``; longer codes stay whole (``lpad`` would cut them)."""
    c = F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def registry_rows(raw: DataFrame) -> DataFrame:
    """S2 + F5 + C2: padded code, cleaned sector, control label."""
    return raw.select(pad_code("CD_CVM").alias("cd_cvm"),
                      clean_registry_sector("SETOR_ATIV").alias("setor"),
                      classify_control("CONTROLE_ACIONARIO").alias("ctrl"))


def read_quote_snapshot(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``{stocks: [{stock, close, market_cap}]}`` documents to (stock, close, market_cap) rows."""
    doc = spark.read.schema(SNAPSHOT_SCHEMA).option("multiLine", multi_line).json(path)
    return doc.select(F.inline("stocks"))


def read_indicator_list(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``{list: [...]}`` documents to one row per indicator record."""
    doc = spark.read.schema(INDICATOR_SCHEMA).option("multiLine", multi_line).json(path)
    return doc.select(F.inline("list"))


def read_meta(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Curated metadata, a JSON array of records with a nested tag array, one a file or (not multi_line) one a line."""
    return spark.read.schema(META_SCHEMA).option("multiLine", multi_line).json(path)


def double_decode(col, field: str = GOVERNANCE_FIELD) -> Column:
    """A field of JSON text that may itself be a JSON string holding the JSON."""
    c = F.col(col) if isinstance(col, str) else col
    inner = F.when(F.ltrim(c).startswith('"'), F.get_json_object(c, "$")).otherwise(c)
    return F.get_json_object(inner, f"$.{field}")


def write_version(df: DataFrame, base: str, version: str | None = None, fmt: str = "parquet",
                  **options) -> str:
    """K1/K2: write ``df`` to a new version directory under ``base`` and return its path."""
    version = version or uuid.uuid4().hex
    path = f"{base.rstrip('/')}/v={version}"
    w = df.write.mode("overwrite").format(fmt)
    for k, v in options.items():
        w = w.option(k, v)
    w.save(path)
    return path
