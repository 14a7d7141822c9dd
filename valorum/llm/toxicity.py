"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding.

Folding maps look-alike letters of other scripts, capitals by their own look, and styled letters to Latin ones, digits that
stand for letters to those letters, drops accents and lower-cases, so ``tr4sh``, ``trásh`` and a spelling with
Cyrillic or Greek letters meet the same lexicon term.

The lexicon is learned from labelled texts: a term's weight follows from the share of toxic and clean groups of texts that
hold it. Near copies of a text count once (they share a min-hash), so the words of one much copied text
are no evidence. Phrases of two words that hold a candidate term but occur mostly in clean texts become
exception phrases; a match inside one does not count. They are found before terms are judged: a term's evidence is what
it has outside them, so a toxic word that clean texts use within a harmless phrase is learned all the same.
Candidates are terms with a quarter of the required odds, phrases included.

A text's density is the summed weight of its matches, each a whole word, divided by its number of words. The score is
density / (density + scale), with the scale set so that the best cut on the training texts scores 0.7.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.llm.common import fresh, ready, stored, text_of

# Digits that stand for letters, and letters that look like Latin ones.
DIGITS = dict(zip("01345789", "oieastbg"))
CYRILLIC = dict(zip("асеорхуіјѕһԁԛԝкмтвнАВЕКМНОРСТУХІЈЅԚԜҮ", "aceopxyijshdqwkmtbhabekmhopctyxijsqwy"))
GREEK = dict(zip("αβγεηικνορτυχωΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "abyenikvoptuxwabezhikmnoptyx"))
WORD = re.compile(r"[^\W_]+")
CUT = 0.7


@lru_cache(maxsize=1)
def fold_table() -> dict[int, str | None]:
    """Look-alikes, digits, accents (dropped) and every letter that decomposes to one ASCII letter and marks."""
    table: dict[int, str | None] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        if unicodedata.category(c) == "Mn":
            table[cp] = None
        elif unicodedata.decomposition(c):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) != "Mn").lower()
            plain = {**CYRILLIC, **GREEK}.get(plain, plain)
            if len(plain) == 1 and plain.isascii() and plain.isalnum():
                table[cp] = DIGITS.get(plain, plain)
    table.update({ord(a): b for part in (DIGITS, CYRILLIC, GREEK) for a, b in part.items()})
    return table


def fold(text: str | None) -> str:
    return (text or "").translate(fold_table()).lower()


def words_of(text: str | None) -> list[str]:
    return WORD.findall(fold(text))


@dataclass
class Model:
    """Folded terms with weights, exception phrases, and the density that scores one half."""

    terms: dict[str, float]
    exceptions: frozenset[str] = field(default_factory=frozenset)
    scale: float = 0.01

    def automaton(self):
        import ahocorasick

        made = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            made.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        if len(made):
            made.make_automaton()
        return made


def density(folded: str, automaton) -> float:
    """Summed weight of matches that are whole words and outside exception phrases, per word of the text."""
    if not folded or not len(automaton):
        return 0.0
    last, hits, safe = len(folded) - 1, [], []
    for end, (n, weight) in automaton.iter(folded):
        start = end - n + 1
        if (start and folded[start - 1].isalnum()) or (end < last and folded[end + 1].isalnum()):
            continue
        (safe if weight is None else hits).append((start, end, weight))
    if not hits:
        return 0.0
    if safe:
        hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in safe)]
    return sum(w for _, _, w in hits) / max(1, sum(1 for _ in WORD.finditer(folded)))


def to_score(x, scale: float):
    return x / (x + scale)


def _evidence_rows(phrases_of: frozenset[str] | None):
    """(term, group, toxic) once per text; with ``phrases_of``: two-word phrases that hold one of those terms.

    Every text also holds the empty term, which so counts the groups.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"term": [], "grp": [], "toxic": []}
            for text, toxic in zip(b["text"], b["toxic"]):
                words = words_of(text)
                group = group_of(words)
                found = set(words) if phrases_of is None else {
                    f"{x} {y}" for x, y in zip(words, words[1:]) if x in phrases_of or y in phrases_of}
                for t in ["", *found]:
                    out["term"].append(t)
                    out["grp"].append(group)
                    out["toxic"].append(int(toxic))
            yield pd.DataFrame(out)
    return run


def _outside_rows(terms: frozenset[str], exceptions: frozenset[str]):
    """(term, group, toxic) once per text for the terms that it holds outside exception phrases."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {"term": [], "grp": [], "toxic": []}
            for text, toxic in zip(b["text"], b["toxic"]):
                words = words_of(text)
                inside = set()
                for i, (x, y) in enumerate(zip(words, words[1:])):
                    if (x in terms or y in terms) and f"{x} {y}" in exceptions:
                        inside |= {i, i + 1}
                found = {x for i, x in enumerate(words) if x in terms and i not in inside}
                group = group_of(words) if found else 0
                out["term"] += found
                out["grp"] += [group] * len(found)
                out["toxic"] += [int(toxic)] * len(found)
            yield pd.DataFrame(out)
    return run


def group_of(words: list[str]) -> int:
    """Min-hash of the word triples: near copies mostly share it."""
    digest = xxhash.xxh64_intdigest
    return min(digest(s) for s in {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}) >> 1


def _support(rows: DataFrame) -> DataFrame:
    """(term, tox0, clean0, tox1, clean1): groups that hold the term, by label and by half of the groups."""
    once = rows.groupBy("term", "grp", "toxic").agg(F.lit(1).alias("one"))
    return once.groupBy("term").agg(*[
        F.count(F.when((F.col("grp") % 2 == half) & (F.col("toxic") == label), 1)).alias(f"{name}{half}")
        for half in (0, 1) for name, label in (("tox", 1), ("clean", 0))])


def choose(rows, n_tox: int, n_clean: int, tested: int, min_groups: int, min_odds: float, false_terms: float,
           max_terms: int) -> dict[str, float]:
    """Terms with weights from (term, tox, clean): toxic evidence that chance hardly explains."""
    n_tox, n_clean = max(1, n_tox), max(1, n_clean)
    rate = n_tox / (n_tox + n_clean)
    found = []
    for term, tox, clean in rows:
        odds = ((tox + 0.5) / n_tox) / ((clean + 0.5) / n_clean)
        luck = tested * chance(tox, tox + clean, rate)
        if tox >= min_groups and odds >= min_odds and luck <= false_terms:
            # An exclusive term that chance cannot explain weighs 1; weaker evidence less.
            sure = min(1.0, max(0.05, (2.0 - math.log10(max(luck, 1e-9))) / 8.0))
            found.append((-odds, term, sure * min(1.0, math.log(odds) / math.log(100.0))))
    return {term: weight for _, term, weight in sorted(found)[:max_terms]}


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic", max_rows: int = 40_000, max_terms: int = 20_000,
        min_groups: int = 2, min_odds: float = 8.0, false_terms: float = 50.0) -> Model:
    """Learn a lexicon from labelled texts; ``usable`` (a condition on doc_id) says which labels may be seen.

    Bounded: about ``max_rows`` labelled texts, drawn by a hash of the id, and the ``max_terms`` strongest
    terms. A term needs ``min_groups`` toxic groups of near copies, must be ``min_odds`` times as frequent in
    toxic texts as in clean ones, and so unlikely a find that about ``false_terms`` of all terms tested would
    pass by chance. The cut is set on texts that did not choose the terms: each half of the groups is scored with the
    lexicon of the other half. Null labels and ids are not used; conflicting labels count as toxic.
    """
    spark = docs.sparkSession
    ready(spark)
    marks = (labels.select(F.col(f"`{label_id}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
             .where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = marks.count()
    if n > max_rows:
        marks = marks.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    train = stored(texts.join(marks, "doc_id").select("text", F.least("toxic", F.lit(1)).alias("toxic")), "tox-train")
    schema = "term string, grp long, toxic int"
    tox, clean = F.col("tox0") + F.col("tox1"), F.col("clean0") + F.col("clean1")
    support = stored(_support(train.mapInPandas(_evidence_rows(None), schema)).where(tox + clean >= min_groups),
                     "tox-support")
    totals = support.where("term = ''").first()
    if totals is None:
        return Model({})
    n_tox, n_clean = totals.tox0 + totals.tox1, totals.clean0 + totals.clean1
    odds = ((tox + 0.5) / max(1, n_tox)) / ((clean + 0.5) / max(1, n_clean))
    tested = support.count()
    # Only terms that some half can choose come to the driver: the strongest, in a bounded number.
    few = (support.where((tox >= min_groups) & (odds >= min_odds / 4) & (F.length("term") > 1))
           .orderBy(F.desc(tox * odds), "term").limit(4 * max_terms).collect())
    limits = (min_groups, min_odds, false_terms, max_terms)
    # Exception phrases of the candidates first, then the candidates by what they have outside those.
    candidates, exceptions = frozenset(r.term for r in few), frozenset()
    if few:
        phrases = (_support(train.mapInPandas(_evidence_rows(candidates), schema))
                   .where((clean >= max(3, min_groups)) & (odds < 1.0) & (F.length("term") > 0))
                   .orderBy(F.desc(clean), "term").limit(max_terms).collect())
        exceptions = frozenset(r.term for r in phrases)
    if exceptions:
        few = _support(train.mapInPandas(_outside_rows(candidates, exceptions), schema)).collect()
    terms = choose(((r.term, r.tox0 + r.tox1, r.clean0 + r.clean1) for r in few), n_tox, n_clean, tested, *limits)
    halves = (choose(((r.term, r.tox0, r.clean0) for r in few), totals.tox0, totals.clean0, tested, *limits),
              choose(((r.term, r.tox1, r.clean1) for r in few), totals.tox1, totals.clean1, tested, *limits))
    exceptions = frozenset(p for p in exceptions if any(w in terms or w in halves[0] or w in halves[1] for w in p.split(" ")))
    # max_rows pairs of numbers.
    seen = train.mapInPandas(_density_rows(tuple(Model(h, exceptions) for h in halves)), "x double, toxic int").toPandas()
    cut = best_cut(seen["x"].to_numpy(), seen["toxic"].to_numpy())
    return Model(terms, exceptions, cut * (1 - CUT) / CUT)


def chance(hits: int, n: int, rate: float) -> float:
    """Probability that exactly ``hits`` of ``n`` groups are toxic by chance."""
    if not 0 < rate < 1:
        return 0.0
    log = (math.lgamma(n + 1) - math.lgamma(hits + 1) - math.lgamma(n - hits + 1)
           + hits * math.log(rate) + (n - hits) * math.log(1 - rate))
    return math.exp(log)


def best_cut(x: np.ndarray, toxic: np.ndarray) -> float:
    """The density that parts the classes best, midway between the neighbouring ones.

    Best by F(1/2), which holds precision dearer than recall: clean texts are to be left alone.
    """
    values = np.unique(x[x > 0])
    if not len(values) or not toxic.any():
        return 0.01
    hot, cold = np.sort(x[toxic > 0]), np.sort(x[toxic <= 0])
    hits = len(hot) - np.searchsorted(hot, values)
    false = len(cold) - np.searchsorted(cold, values)
    best = 1.25 * hits / (hits + false + 0.25 * len(hot))
    at = int(len(best) - 1 - np.argmax(best[::-1]))
    return float((values[at] + (values[at - 1] if at else 0.0)) / 2)


def _density_rows(models: tuple[Model, Model]):
    """Density of each text by the lexicon of the half it is not in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = [m.automaton() for m in models]
        for b in batches:
            yield pd.DataFrame({"x": [density(fold(t), made[1 - group_of(words_of(t)) % 2]) for t in b["text"]],
                                "toxic": b["toxic"]})
    return run


def _score_rows(model: Model, text_col: str, out_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = model.automaton()
        for b in batches:
            x = np.array([density(fold(t), made) for t in b.pop(text_col)], float)
            b[out_col] = to_score(x, model.scale)
            yield b
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted (1 if score >= 0.7).

    Null and empty texts score 0. Null ids and repeated rows are carried. An empty table gives an empty
    result; other columns are ignored. The model (bounded lexicon) travels with the tasks.
    """
    ready(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return (base.mapInPandas(_score_rows(model, "text", "score"), f"doc_id {id_type}, score double")
            .withColumn("predicted", (F.col("score") >= CUT).cast("int")))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input rows, all columns as they are, without those predicted toxic (null text: kept)."""
    ready(docs.sparkSession)
    mark = fresh("toxicity", docs.columns)
    copy = fresh("folded_text", docs.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    marked = docs.withColumn(copy, text_of(text_col)).mapInPandas(
        _score_rows(model, copy, mark), f"{fields}, `{mark}` double")
    return marked.where(F.col(f"`{mark}`") < CUT).drop(mark)
