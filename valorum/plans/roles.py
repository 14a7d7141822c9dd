"""Stand-in roles: the driver's test tables cast as the engine's inputs.

The test tables hold no stock data, so each demo maps a role (stocks, assumption
log, quotes, filings, names...) onto whole test tables. Every role reads a whole
table (or a Spark aggregate of one), so the demo work grows with the data. The
SQL twin of every role lives in :mod:`valorum.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valorum.operators.quotes import newest_time

# Look-back of the quote demos.
QUOTE_LOOKBACK = "5d"


_TABLES: dict[str, tuple[SparkSession, DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the DataFrame (schema and file listing) is reused within the same session."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    hit = _TABLES.get(path)
    if hit is not None and hit[0] is spark and spark.sparkContext._jsc is not None:
        return hit[1]
    df = spark.read.parquet(path)
    _TABLES[path] = (spark, df)
    return df


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stocks: one per part. EPS = retail price / 100, payout = size / 50."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    return p.select(
        F.col("p_partkey").alias("ticker"),
        F.col("p_name").alias("nome"),
        F.col("p_type").alias("setor"),
        F.col("p_brand").alias("segmento"),
        (F.col("p_retailprice") / 100.0).alias("lpa"),
        (size / 50.0).alias("payout"),
        F.when(F.col("p_size") <= 40, size / 200.0).alias("roe_i"),
        (size / 500.0).alias("g1"),
        (0.06 + size / 250.0).alias("ke"),
        ((F.col("p_partkey") % 11).cast("double") / 100.0).alias("gp"),
        (F.col("p_size") > 25).alias("monitored"),
    )


def assumption_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assumption log: one event per line item, keyed by part, timed by ship date."""
    return assumption_events_from(table(spark, sf_dir, "lineitem"))


def assumption_events_from(li: DataFrame) -> DataFrame:
    """The assumption-log mapping over line-item rows (batch or stream)."""
    return li.selectExpr(
        "l_orderkey * 8 + l_linenumber AS id",
        "l_partkey AS ticker",
        "l_shipdate AS event_time",
        "CASE WHEN l_quantity > 45 THEN l_extendedprice / l_quantity / 100.0D END AS lpa",
        "CASE WHEN l_linestatus = 'F' THEN 0.05D + l_tax * 2.0D END AS roe_i",
        "CASE WHEN l_returnflag = 'R' THEN l_discount * 5.0D END AS payout_i",
        "0.05D + l_tax AS roe_t",
        "0.3D + l_discount * 3.0D AS payout_t",
        "CAST(l_linenumber * 2 AS DOUBLE) AS fade",
        "0.10D + l_discount AS ke",
        "CASE WHEN l_quantity > 40 THEN 'g' WHEN l_quantity < 5 THEN '' WHEN l_quantity < 10 THEN NULL "
        "ELSE 'roe' END AS growth_mode",
        "l_tax * 2.0D AS g_i",
        "0.02D + l_discount / 2.0D AS g_t",
        "l_quantity / 2.0D AS fut_pe",
        "l_discount * 2.0D AS mos",
        "CASE WHEN l_returnflag = 'N' THEN 1 WHEN l_returnflag = 'A' THEN 0 END AS ke_default",
        "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS roet_default",
        "CASE WHEN l_quantity >= 25 THEN 0 ELSE 1 END AS payoutt_default",
        "CASE WHEN l_linenumber > 4 THEN 0 ELSE 1 END AS fade_default",
    )


# Order priority -> config key of the stand-in config writes.
CONFIG_KEY_OF_PRIORITY = (
    ("1-URGENT", "ke_global"),
    ("2-HIGH", "roet_global"),
    ("3-MEDIUM", "payoutt_global"),
    ("4-NOT SPECIFIED", "fade_global"),
    ("5-LOW", "ke_mode_global"),
)


def config_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Config writes: every order writes v = total / 2e6 to its priority's key (NULL if pending)."""
    o = table(spark, sf_dir, "orders")
    key = None
    for prio, k in CONFIG_KEY_OF_PRIORITY:
        key = F.when(F.col("o_orderpriority") == prio, F.lit(k)) if key is None else key.when(
            F.col("o_orderpriority") == prio, F.lit(k))
    return o.select(
        key.alias("k"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 2e6).alias("v"),
        F.col("o_orderdate").alias("written_at"),
        F.col("o_orderkey").alias("write_id"),
    )


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchlist: parts with a line of quantity 50 at a 10 % discount."""
    li = table(spark, sf_dir, "lineitem")
    return (li.where((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.1))
            .select(F.col("l_partkey").alias("ticker")))


def removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tombstones: small promo parts."""
    p = table(spark, sf_dir, "part")
    return p.where((F.col("p_type") == "PROMO") & (F.col("p_size") <= 5)).select(F.col("p_partkey").alias("ticker"))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary quotes: events as (ticker, ts, close); 'error' events carry a NULL close."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("ticker"),
        F.col("ts"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("close"),
    )


def exact_sum(col: str) -> F.Column:
    """Order-independent sum of two-decimal values: summed as decimal, returned as double."""
    return F.sum(F.col(col).cast("decimal(28,2)")).cast("double")


def second_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second quote source: average unit price per part (exact sums, so the cents never depend on
    the order rows are added in)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("ticker")).agg(
        (exact_sum("l_extendedprice") / exact_sum("l_quantity")).alias("price"))


def quote_as_of(spark: SparkSession, sf_dir: str) -> Column:
    """The as-of time of the quotes: their newest time."""
    return newest_time(table(spark, sf_dir, "events"), "ts")


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing facts: one per line item; entity = supplier, year of shipping, scope = line status,
    class / account = return flag, value = extended price, scale by quantity."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("entity"),
        F.year("l_shipdate").alias("year"),
        F.col("l_linestatus").alias("scope"),
        F.col("l_returnflag").alias("klass"),
        F.col("l_extendedprice").alias("value"),
        F.when(F.col("l_quantity") > 25, F.lit("MIL")).otherwise(F.lit("UN")).alias("scale"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


def history_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History list: events per user, newest id first."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("ticker"), F.col("event_id").alias("id"), "ts", "value")


def listed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names: documents with an even id (the other half is the registry; every document is used once)."""
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % 2 == 0).select(F.col("doc_id").alias("ticker_id"), F.col("text").alias("empresa"))


def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of companies: documents with an odd id; last filing year from the text length."""
    d = table(spark, sf_dir, "documents")
    return d.where(F.col("doc_id") % 2 == 1).select(
        F.col("doc_id").alias("cd"), F.col("text").alias("nome"),
        (F.lit(2000) + (F.col("n_chars") % 25)).cast("int").alias("ultimo_ano"))


# Stand-in text tables (fixed values of the demo mapping, not of the reference).
RAW_SECTORS = ("Petróleo. Gás e Biocombustíveis", "Financeiro e Outros", " Utilidade Pública ",
               "Consumo não Cíclico", "Saúde", "Materiais Básicos", "Bens Industriais..Máquinas",
               "Consumo Cíclico . Varejo", "Tecnologia da Informação", "Comunicações")
RAW_SUBSECTORS = ("Energia Elétrica", "Intermediários Financeiros", "Mineração. Siderurgia", "Bancos")
LISTING_SEGMENTS = ("NOVO MERCADO", "BOVESPA MAIS NÍVEL 2", "NÍVEL 2", "Nivel 1", "BOVESPA MAIS",
                    "MERCADO BASICO", "")
CONTROL_TEXTS = ("ESTATAL", "Estrangeiro", "PRIVADO NACIONAL", "Holding", "")
REGISTRY_SECTORS = ("Emp. Adm. Part. - Energia Elétrica", "Sem Setor Principal", " Bancos ",
                    "Emp. Adm. Part. - Sem Setor Principal", "Telecomunicações")


def pick(options, idx) -> F.Column:
    """Element of a fixed stand-in list chosen by a non-negative integer column."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (idx % len(options)).cast("int") + 1)


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market indicators per listed security: one per customer, with its order totals."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"), exact_sum("o_totalprice").alias("sum_total"))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    return j.select(
        F.col("c_custkey").alias("ticker"),
        pick(RAW_SECTORS, F.col("c_nationkey")).alias("sectorname"),
        pick(RAW_SUBSECTORS, F.col("c_nationkey")).alias("subsectorname"),
        F.col("c_mktsegment").alias("segmentname"),
        (F.col("c_acctbal") / 700.0).alias("dy"),
        (F.col("sum_total") / F.col("n_orders") / 6000.0 - 5.0).alias("p_l"),
        (F.col("n_orders") / 3.0).alias("p_vp"),
        ((F.col("c_custkey") % 40) - 5).cast("double").alias("roe"),
        (F.col("c_nationkey") - 5).cast("double").alias("receitas_cagr5"),
        (F.col("n_orders") / 4.0).alias("dividaliquidaebit"),
        (F.col("c_acctbal") / 1000.0).alias("lpa"),
        (F.col("c_acctbal") * 1e7).alias("valormercado"),
        F.col("sum_total").alias("liquidezmediadiaria"),
        pick(LISTING_SEGMENTS, F.col("c_custkey")).alias("listing"),
        pick(CONTROL_TEXTS, F.col("c_nationkey")).alias("controle"),
    )


def registry_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regulator registry rows: one per supplier, code padded later, raw sector and control text."""
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("CD_CVM"),
                    pick(REGISTRY_SECTORS, F.col("s_nationkey")).alias("SETOR_ATIV"),
                    pick(CONTROL_TEXTS, F.col("s_nationkey")).alias("CONTROLE_ACIONARIO"))


def part_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing facts keyed by part (company code of the universe demo)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").alias("cd"),
        F.year("l_shipdate").alias("year"),
        F.col("l_linestatus").alias("scope"),
        F.col("l_returnflag").alias("klass"),
        F.col("l_extendedprice").alias("value"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("paid"),
        F.when(F.col("l_quantity") > 25, F.lit("MIL")).otherwise(F.lit("UN")).alias("scale"),
        "l_orderkey", "l_linenumber",
    )


def company_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry control and governance payload per company code (one per part)."""
    p = table(spark, sf_dir, "part")
    seg = pick(LISTING_SEGMENTS, F.col("p_partkey"))
    obj = F.concat(F.lit('{"market": "'), seg, F.lit('"}'))
    payload = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('"'), F.replace(obj, F.lit('"'), F.lit('\\"')), F.lit('"'))
                     ).otherwise(obj)
    return p.select(F.col("p_partkey").alias("cd_cvm"), pick(CONTROL_TEXTS, F.col("p_size")).alias("controle"),
                    payload.alias("payload"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market-cap snapshot per listed security (from customers)."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("ticker"), (F.col("c_acctbal") * 2e6).alias("market_cap"))


MODEL_DEFAULT = "DDM · 2 est."


def state_stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current stocks table: all parts (from size 41 on user-created) plus user rows from suppliers."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("double")
    parts = p.select(
        F.col("p_partkey").alias("ticker"), F.col("p_name").alias("nome"),
        F.col("p_partkey").cast("string").alias("cd_cvm"), F.concat(F.lit("edited "), F.col("p_type")).alias("setor"),
        F.lit("").alias("subsetor"), F.col("p_brand").alias("segmento"), F.lit("").alias("perfil"),
        F.lit("").alias("tamanho"), F.lit("").alias("gov"), F.lit("").alias("ctrl"),
        F.when(F.col("p_size") % 3 == 0, F.lit("custom")).otherwise(F.lit(MODEL_DEFAULT)).alias("modelo"),
        F.lit("[]").alias("tags"), (F.col("p_size") > 20).cast("int").alias("monitored"),
        (F.col("p_retailprice") / 100.0).alias("lpa"), (size / 50.0).alias("payout"),
        F.lit(None).cast("double").alias("liquidez"), F.lit(0.15).alias("roe_i"), F.lit(0.06).alias("g1"),
        F.lit(0.14).alias("ke"), F.lit(0.04).alias("gp"), (F.col("p_size") > 40).cast("int").alias("user"))
    s = table(spark, sf_dir, "supplier")
    users = s.select(
        (F.lit(-1) - F.col("s_suppkey")).alias("ticker"), F.col("s_name").alias("nome"),
        F.lit(None).cast("string").alias("cd_cvm"), F.lit("user").alias("setor"), F.lit("").alias("subsetor"),
        F.lit("").alias("segmento"), F.lit("").alias("perfil"), F.lit("").alias("tamanho"), F.lit("").alias("gov"),
        F.lit("").alias("ctrl"), F.lit(MODEL_DEFAULT).alias("modelo"), F.lit("[]").alias("tags"),
        F.lit(0).alias("monitored"), (F.col("s_acctbal") / 1000.0).alias("lpa"), F.lit(None).cast("double").alias("payout"),
        F.lit(None).cast("double").alias("liquidez"), F.lit(0.15).alias("roe_i"), F.lit(0.06).alias("g1"),
        F.lit(0.14).alias("ke"), F.lit(0.04).alias("gp"), F.lit(1).alias("user"))
    return parts.unionByName(users)


# Keys of customers in the seed: none of the current stocks has them.
NEW_KEY = 1_000_000_000


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh universe seed: every part with refreshed fundamentals, and every customer as a new listing."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ticker"), F.col("p_name").alias("name"), F.col("p_type").alias("setor"),
        F.col("p_brand").alias("segmento"), F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"))
    c = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + NEW_KEY).alias("ticker"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("setor"), F.lit("").alias("segmento"),
        F.col("c_nationkey").cast("double").alias("size"), F.col("c_acctbal").alias("price"))
    u, size = p.unionByName(c), F.col("size")
    return u.select(
        "ticker", F.upper("name").alias("nome"), F.col("ticker").cast("string").alias("cd_cvm"), "setor",
        F.lit("").alias("subsetor"), "segmento", F.lit("Valor").alias("perfil"), F.lit("Small cap").alias("tamanho"),
        F.lit("").alias("gov"), F.lit("").alias("ctrl"), F.lit(MODEL_DEFAULT).alias("modelo"), F.lit("[]").alias("tags"),
        (size > 30).cast("int").alias("monitored"), (F.col("price") / 90.0).alias("lpa"),
        (size / 40.0).alias("payout"), (F.col("price") * 1000.0).alias("liquidez"),
        (size / 100.0).alias("roe_i"), F.lit(0.06).alias("g1"), F.lit(0.14).alias("ke"), F.lit(0.04).alias("gp"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portfolio positions per part: quantity net of 700 units, average unit price (-1 for returned-only parts)."""
    li = table(spark, sf_dir, "lineitem")
    agg = li.groupBy(F.col("l_partkey").alias("ticker")).agg(
        (exact_sum("l_quantity") - 700.0).alias("quantidade"),
        (exact_sum("l_extendedprice") / exact_sum("l_quantity")).alias("avg_price"),
        F.min("l_returnflag").alias("min_flag"))
    return agg.select("ticker", "quantidade",
                      F.when(F.col("min_flag") == "R", F.lit(-1.0)).otherwise(F.col("avg_price")).alias("preco_medio"))


def more_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in two batches: those of :func:`positions`, then one of every part, so most keys repeat."""
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ticker"), (F.col("p_size").cast("double") - 3.0).alias("quantidade"),
        F.col("p_retailprice").alias("preco_medio"), F.lit(2).alias("batch"))
    return positions(spark, sf_dir).withColumn("batch", F.lit(1)).unionByName(p)
