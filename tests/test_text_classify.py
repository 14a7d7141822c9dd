import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from valorum.functions import classify as cl
from valorum.functions import text as tx


def _one(spark, col_expr, values, ddl="s string"):
    df = spark.createDataFrame([(v,) for v in values], ddl)
    return [r[0] for r in df.select(col_expr).collect()]


FOLD_CASES = ["São Paulo", "Ação Ótima", "Straße", "1ª 2º", "ﬁnanças", "d’Água", "½ cota", "Œuvre", "ÀÉÎÕÜ çñ",
              "Ĳssel ǅ", "ascii only"]


def test_fold_matches_nfkd_rule(spark):
    got = _one(spark, tx.fold_accents("s"), FOLD_CASES)
    want = [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in FOLD_CASES]
    assert got == want


def test_fold_every_code_point(spark):
    chars = [chr(cp) for cp in range(1, sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000]
    blocks = ["x".join(chars[i:i + 500]) for i in range(0, len(chars), 500)]
    want = [unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode() for s in blocks]
    df = spark.createDataFrame([(s,) for s in blocks], "s string")
    got = df.select(tx.fold_accents("s"), tx.fold_accents(F.col("s"))).collect()
    assert [r[0] for r in got] == want and [r[1] for r in got] == want


def test_fold_column_and_sql_paths_agree(spark):
    a = _one(spark, tx.fold_accents(F.col("s")), FOLD_CASES)
    b = _one(spark, tx.fold_accents("s"), FOLD_CASES)
    assert a == b


def test_normalize_name(spark):
    got = _one(spark, tx.normalize_name("s"), [
        "Petróleo Brasileiro S.A. - Petrobras", "OI S.A. – EM RECUPERAÇÃO JUDICIAL", "  Ação  &  Cia.  ", "ß", None])
    assert got == ["PETROLEO BRASILEIRO S A PETROBRAS", "OI S A", "ACAO CIA", "", None]


def test_name_tokens_stop_words_and_single_letters(spark):
    got = _one(spark, F.array_sort(tx.name_tokens("s")), [
        "CIA BRASILEIRA DE DISTRIBUICAO", "S.A. DA DE DO", "A B C DOS", "Banco do Brasil S/A Banco"])
    assert got == [["BRASILEIRA", "DISTRIBUICAO"], [], [], ["BANCO", "BRASIL"]]


def test_clean_label_order_of_dot_artefacts(spark):
    got = _one(spark, tx.clean_label("s"), [
        "Petróleo. Gás e Biocombustíveis", "Financeiro e Outros", "Bens..Industriais", "a . b", " , x , ",
        "  many   spaces\n", None, ""])
    assert got == ["Petróleo, Gás e Biocombustíveis", "Financeiro", "Bens, Industriais", "a, b", "x",
                   "many spaces", "", ""]


def test_clean_registry_sector(spark):
    got = _one(spark, tx.clean_registry_sector("s"), [
        "Emp. Adm. Part. - Energia Elétrica", "Sem Setor Principal", " Bancos ",
        "Emp. Adm. Part. - Sem Setor Principal", None])
    assert got == ["Energia Elétrica", "", "Bancos", "", ""]


def test_ticker_suffix(spark):
    got = spark.createDataFrame([("petr4",)], "t string").select(
        tx.add_suffix("t").alias("a"), tx.strip_suffix(tx.add_suffix("t")).alias("b")).first()
    assert (got.a, got.b) == ("PETR4.SA", "PETR4")


@pytest.mark.parametrize("text,label", [
    ("NOVO MERCADO", "Novo Mercado"), ("Bovespa Mais Nível 2", "Bovespa Mais N2"), ("Nível 2", "Nível 2"),
    ("nivel 1", "Nível 1"), ("BOVESPA MAIS", "Bovespa Mais"), ("MERCADO BASICO", "Tradicional"), ("", ""),
    (None, ""),
])
def test_governance(spark, text, label):
    assert _one(spark, cl.classify_governance("s"), [text]) == [label]
    assert _one(spark, cl.classify_governance(F.col("s")), [text]) == [label]


def test_control(spark):
    got = _one(spark, cl.classify_control("s"), ["Estatal Holding", "ESTRANGEIRO", "Privado", "outro", None])
    assert got == ["Estatal", "Estrangeiro", "Privada nacional", "", ""]


def test_size_edges(spark):
    got = _one(spark, cl.classify_size("m"), [0.0, None, -5.0, 1.99e9, 2e9, 9.9e9, 1e10], "m double")
    assert got == ["", "", "Small cap", "Small cap", "Mid cap", "Mid cap", "Large cap"]


TAG_ROWS = [
    # dy, pl, pvp, roe, lev, eps, mcap
    (9.0, 5.0, 0.8, 20.0, None, 1.0, 6e10),    # four match -> first three
    (None, 30.0, 0.5, None, 4.0, -1.0, 6e10),  # loss, expensive, leveraged; no blue chip after a loss
    (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0),       # zeros fail every truthy test; lev 0 is "not None" and <= 2
    (None, None, None, None, None, None, None),
]


def test_tags(spark):
    df = spark.createDataFrame(TAG_ROWS, "dy double, pl double, pvp double, roe double, lev double, eps double, mc double")
    fast = [r[0] for r in df.select(cl.derive_tags("dy", "pl", "pvp", "roe", "lev", "eps", "mc")).collect()]
    slow = [r[0] for r in df.select(cl.derive_tags(*[F.col(c) for c in ("dy", "pl", "pvp", "roe", "lev", "eps", "mc")]))
            .collect()]
    assert fast == slow
    assert fast == [["Alta DY", "Barata", "Qualidade"], ["Prejuízo", "Cara", "Alavancada"], [], []]


def test_profile(spark):
    rows = [("Materiais Básicos", 10.0, 5.0, 1.0, 20.0, 20.0), ("Financeiro", 7.0, None, None, None, None),
            ("Financeiro", None, 5.0, 1.0, 13.0, 13.0), ("Financeiro", None, 5.0, 1.0, None, None),
            ("Saúde", None, None, None, None, None), ("Financeiro", None, None, None, 9.0, None),
            ("Financeiro", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, dy double, pl double, pvp double, cagr double, roe double")
    got = [r[0] for r in df.select(cl.derive_profile("s", "dy", "pl", "pvp", "cagr", "roe")).collect()]
    assert got == ["Cíclica", "Dividendos", "Crescimento", "Valor", "Defensiva", "Crescimento", "Valor"]
