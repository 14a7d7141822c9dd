import brute
from llm_cases import clashing, empty, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as cp
from test_llm_pii_secrets import masked
from test_llm_tokens_packing import JSON, check_packed
from valorum.llm import mixing, pii, toxicity
from valorum.llm.common import stored
from valorum.llm.queries import seen_label

SF = "/root/testdata/sf0.001"


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "pii", "mix_sources", "best_fit_packing"]


def test_each_stage_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in cp.STAGES:
        at[name] = docs
        docs = stored(stage(spark, docs, SF), "test-stage")
        assert name == cp.STAGES[-1][0] or docs.columns == columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    model = toxicity.fit(at["toxicity"], spark.read.parquet(f"{SF}/labels.parquet"), seen_label())
    made = model.automaton()
    clean = [r.doc_id for r in at["toxicity"].collect()
             if toxicity.to_score(toxicity.density(toxicity.fold(r.text), made), model.scale) < toxicity.CUT]
    assert ids(at["simhash_near_dedup"]) == sorted(clean)

    classes = brute.simhash_components([(r.doc_id, r.text) for r in at["simhash_near_dedup"].collect()])
    assert ids(at["pii"]) == sorted({c for _, c in classes.values()})

    spans = {r.doc_id: r.pii for r in pii.find_pii(at["pii"]).collect()}
    before = {r.doc_id: r for r in at["pii"].collect()}
    for r in at["mix_sources"].collect():
        old = before[r.doc_id]
        assert r.text == masked(old.text, spans[r.doc_id]) and r.source == old.source and r.lang == old.lang
        assert r.n_chars == (len(r.text) if spans[r.doc_id] else old.n_chars)

    copies = {r.doc_id: r.copies for r in mixing.mix(at["mix_sources"]).collect()}
    assert ids(at["best_fit_packing"]) == sorted(d for d, c in copies.items() for _ in range(c))

    tok = Tokenizer.from_file(JSON)
    rows = docs.collect()
    want = {r.doc_id: len(tok.encode(r.text or "").ids) + 1 for r in at["best_fit_packing"].collect()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {d: n * copies[d] for d, n in want.items()}


def test_run_equals_its_stages(spark):
    got = cp.run(spark, SF)
    one = [c for c in got.columns if c not in ("sequence_id", "offset")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stored(stage(spark, docs, SF), "test-run")
    assert sorted(map(tuple, got.select(one).collect())) == sorted(map(tuple, docs.select(one).collect()))


def test_stages_take_odd_documents(spark):
    docs = clashing(frame(spark))
    for name, stage in cp.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0
        columns = docs.columns
        docs = stored(stage(spark, docs, SF), "test-odd")
        assert name == cp.STAGES[-1][0] or docs.columns == columns
    assert docs.where(F.col("length") > 1024).count() == 0 and docs.count() > 0
