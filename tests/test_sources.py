import json
import os
import tempfile

from pyspark.sql import functions as F

from valorum.sources import files as src


def _write(name: str, data: bytes) -> str:
    d = tempfile.mkdtemp(prefix="valorum-src-")
    path = os.path.join(d, name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def test_registry_latin1_semicolon_and_padding(spark):
    text = ("CD_CVM;SETOR_ATIV;CONTROLE_ACIONARIO\n"
            "9512;Emp. Adm. Part. - Energia Elétrica;ESTATAL\n"
            "1234567;Sem Setor Principal;Privado\n"
            "77; Telecomunicações ;Estrangeiro\n")
    rows = src.registry_rows(src.read_registry(spark, _write("cad.csv", text.encode("latin-1")))).collect()
    assert [tuple(r) for r in rows] == [("009512", "Energia Elétrica", "Estatal"),
                                        ("1234567", "", "Privada nacional"),
                                        ("000077", "Telecomunicações", "Estrangeiro")]


def test_ticker_list_quoted_csv(spark):
    text = 'ticker,empresa\nAALR3,"ALLIANÇA SAÚDE E PARTICIPAÇÕES S.A."\nXPTO3,"NOME, COM VÍRGULA"\n'
    rows = src.read_ticker_list(spark, _write("t.csv", text.encode("utf-8"))).collect()
    assert [tuple(r) for r in rows] == [("AALR3", "ALLIANÇA SAÚDE E PARTICIPAÇÕES S.A."),
                                        ("XPTO3", "NOME, COM VÍRGULA")]


def test_snapshot_document_multiline(spark):
    doc = {"stocks": [{"stock": "PETR4", "close": 38.5, "market_cap": 5.1e11},
                      {"stock": "OIBR3", "close": None, "market_cap": 0}]}
    path = _write("snap.json", json.dumps(doc, indent=2).encode())
    rows = src.read_quote_snapshot(spark, path, multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("PETR4", 38.5, 5.1e11), ("OIBR3", None, 0.0)]


def test_meta_array_with_tags(spark):
    recs = [{"ticker": "PETR4", "nome": "Petrobras", "tags": ["Alta DY"], "monitored": True, "g1": 0.1, "lpa": 4.24},
            {"ticker": "VALE3", "nome": "Vale", "tags": [], "monitored": False, "ke": 0.16}]
    rows = src.read_meta(spark, _write("meta.json", json.dumps(recs).encode())).select(
        "ticker", "tags", "monitored", "g1", "ke").collect()
    assert [tuple(r) for r in rows] == [("PETR4", ["Alta DY"], True, 0.1, None), ("VALE3", [], False, None, 0.16)]


def test_double_decode(spark):
    inner = json.dumps({"market": "NOVO MERCADO"})
    df = spark.createDataFrame([(inner,), (json.dumps(inner),), ("not json",), (None,), ('{"x": 1}',)], "p string")
    got = [r[0] for r in df.select(src.double_decode("p")).collect()]
    assert got == ["NOVO MERCADO", "NOVO MERCADO", None, None, None]


def test_write_version_never_overwrites(spark):
    base = tempfile.mkdtemp(prefix="valorum-ver-")
    df = spark.range(3).withColumn("x", F.col("id") * 2)
    p1 = src.write_version(df, base)
    p2 = src.write_version(df.where("id > 0"), base)
    assert p1 != p2
    assert spark.read.parquet(p1).count() == 3 and spark.read.parquet(p2).count() == 2
