"""IBANs followed by what could belong to them."""

import pytest
from llm_cases import DOCS

from valorum.llm import pii

DE, GB, NO, MT = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84MALT011000012345MTLCAST001S"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)


def found(spark, texts):
    got = pii.find_pii(docs_of(spark, texts)).collect()
    return {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.pii if s.kind == "iban"] for r in got}


def test_ibans_end_where_their_country_says(spark):
    cases = [(f"IBAN {DE} BIC COBADEFFXXX.", [DE]), (f"{GB} BEFORE FRIDAY", [GB]), (f"{DE} 2024 invoice", [DE]),
             (f"{NO} 12 A {MT} EUR 5", [NO, MT]), (f"{DE} {GB} {NO}", [DE, GB, NO]), (f"😀 {GB} X", [GB]),
             ("AT61 IBAN DE89 3704 0044 0532 0130 00 OK", ["DE89 3704 0044 0532 0130 00"]),  # a head that is none hides nothing
             (f"{DE}0 X", []), (f"{DE}x", []), (f"x{DE} X", []), ("DE88 3704 0044 0532 0130 00 BIC", []),
             ("DE89 3704 0044 0532 0130", []), (None, []), ("", [])]
    got = found(spark, [t for t, _ in cases])
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_unlisted_countries_keep_every_length(spark):
    def checked(code, rest):
        number = "".join(str(int(c, 36)) for c in f"{rest}{code}00")
        return f"{code}{98 - int(number) % 97:02d}{rest}"
    texts = [checked("ZZ", "ABCD0123456789012"[:n]) for n in (11, 17)]
    got = found(spark, [texts[0], f"{texts[1]} BIC X", f"{texts[1]}, and"])
    assert [got[i] for i in range(3)] == [[texts[0]], [texts[1]], [texts[1]]]


@pytest.mark.parametrize("after", [" BIC COBADEFFXXX.", " BEFORE FRIDAY", " 2024 invoice"])
def test_mask_hides_ibans_before_upper_case(spark, after):
    assert [r.text for r in pii.mask(docs_of(spark, [f"to {DE}{after}"])).collect()] == [f"to [IBAN]{after}"]
