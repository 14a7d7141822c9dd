"""Personal data by patterns, checksums and context, with built-in functions only.

Patterns propose spans. Checksum validators confirm them: Luhn for card numbers, mod-97 for IBANs. Each span has a
score: what its kind is worth, more if a checksum confirms it or a context word stands nearby. The base
kinds (email, ip, card, phone) stay whatever their score; the method's own kinds (iban, shorter cards, national
identity numbers) are kept from a score of 0.5 on and where they do not overlap a base span.

Patterns are written so that a run of any length is walked once (possessive, and begun only where a run
begins or the match before ended); they match what the plain forms in their comments match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valorum.llm.common import fresh, text_of
from valorum.llm.spans import joined, near, running, tagged, with_spans

# Fixed values of the contract: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
# [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# [0-9]([\x20-]?[0-9])+
CARD = r"[0-9](?:[\x20-]?[0-9])++"
# \+[0-9][\x20().0-9-]+[0-9]
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# The method's own: two letters, two check digits, 11 to 30 letters or digits, in groups or not. The pattern takes the head
# alone, so that no candidate hides the next one; each is then cut to the length of its country.
IBAN = r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
NATIONAL = r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])"

BASE = ("email", "ip", "card", "phone")
OWN = ("iban", "short_card", "national_id")
# Worth of a kind, with its checksum, and what a context word adds; kept from KEEP on.
WORTH = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "short_card": 0.3, "national_id": 0.3}
CONTEXT_ADDS, KEEP = 0.3, 0.5
CONTEXT = {
    "email": r"mail|contact|write to", "ip": r"\bip\b|address|host|server", "card": r"card|visa|master|credit|debit",
    "phone": r"phone|tel|call|mobile|fax", "iban": r"iban|account|bank", "short_card": r"card|amex|diners|credit|debit",
    "national_id": r"ssn|social security|national id|tax id",
}


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Luhn checksum of a string of at most 19 digits; false for longer ones."""
    def worth(c: Column, i: Column) -> Column:
        d = F.when(i % 2 == 0, F.ascii(c) - 48).otherwise(2 * (F.ascii(c) - 48))
        return F.when(d > 9, d - 9).otherwise(d)

    chars = F.split(F.reverse(number), "")
    total = F.aggregate(F.transform(chars, worth), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(number).between(1, 19), total % 10 == 0).otherwise(False)


def mod97(value: Column) -> Column:
    """IBAN check: first four characters to the end, letters as 10 to 35, remainder 1."""
    plain = F.translate(value, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def ibans(text: Column, heads: Column) -> Column:
    """Spans of the IBANs that begin at the heads: of the length that the country prescribes.

    Countries without a known length: the longest of 15 to 34 that passes. A length ends where a word ends.
    """
    known = "|".join(" ".join(IBAN_LENGTHS.values()).split())

    def of_length(n: int) -> str:
        own = IBAN_LENGTHS.get(n, "").replace(" ", "|")
        code = f"(?:{own}|(?!{known})[A-Z]{{2}})" if own else f"(?!{known})[A-Z]{{2}}"
        return rf"^{code}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9_])"

    def longest(s: Column) -> Column:
        rest = F.substring(text, s["start"] + 1, F.lit(2 * 34))
        every = F.array(*[F.regexp_extract(rest, of_length(n), 0) for n in range(34, 14, -1)])
        value = F.get(F.filter(every, lambda v: (v != "") & mod97(v)), F.lit(0))
        return F.struct(s["start"].alias("start"), (s["start"] + F.char_length(value)).alias("end"), value.alias("value"))

    return F.filter(F.transform(heads, longest), lambda s: s["value"].isNotNull())


def ip_ok(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(
        "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def with_pii(docs: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (order, kind, start, end, score), base kinds first, then by start.

    Positions are code points, ends exclusive. Null and empty texts have no spans. Every row is kept with all
    its columns; helper columns take names that no input column has.
    """
    t, c, p, e, i, b, n = (fresh(f"pii_{x}", docs.columns) for x in ("t", "c", "p", "e", "i", "b", "n"))
    has_digit_run = F.col(t).rlike("[0-9]")
    df = docs.withColumn(t, text_of(text_col))
    df = with_spans(df, t, e, EMAIL, F.contains(F.col(t), F.lit("@")))
    df = with_spans(df, t, i, IP, F.col(t).rlike(r"[0-9]\.[0-9]"))
    df = with_spans(df, t, c, CARD, has_digit_run)
    df = with_spans(df, t, p, PHONE, F.col(t).rlike(r"\+[0-9]"))
    df = with_spans(df, t, b, IBAN, F.col(t).rlike("[A-Z]{2}[0-9]{2}"))
    df = with_spans(df, t, n, NATIONAL, F.col(t).rlike("[0-9]-[0-9]"))

    size = lambda s: F.length(digits(s["value"]))
    keep = {
        "email": F.col(e),
        "ip": F.filter(i, lambda s: ip_ok(s["value"])),
        "card": F.filter(c, lambda s: size(s).between(16, 19) & luhn(digits(s["value"]))),
        "phone": F.filter(p, lambda s: size(s).between(8, 15)),
        "iban": ibans(F.col(t), F.col(b)),
        "short_card": F.filter(c, lambda s: size(s).between(13, 15) & luhn(digits(s["value"]))),
        "national_id": F.col(n),
    }
    text = F.col(t)

    def scored(kind: str, order: int) -> Column:
        return F.transform(tagged(keep[kind], kind, order), lambda s: F.struct(
            s["order"].alias("order"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            F.when(near(text, s, CONTEXT[kind]), F.least(F.lit(1.0), F.lit(WORTH[kind] + CONTEXT_ADDS)))
            .otherwise(F.lit(WORTH[kind])).alias("score")))

    base, own = fresh("pii_base", docs.columns), fresh("pii_own", docs.columns)
    df = df.withColumn(base, F.concat(*[scored(k, x) for x, k in enumerate(BASE)]))
    df = df.withColumn(own, F.filter(F.concat(*[scored(k, len(BASE) + x) for x, k in enumerate(OWN)]),
                                     lambda s: s["score"] >= KEEP))
    clear = F.filter(own, lambda s: ~F.exists(base, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))
    return df.withColumn(out, F.concat(F.col(base), clear)).drop(t, c, p, e, i, b, n, base, own)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, pii (see :func:`with_pii`). Null and repeated ids are carried."""
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return with_pii(base).select("doc_id", "pii")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the base spans, all spans as text."""
    base = F.filter("pii", lambda s: s["order"] < len(BASE))
    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("pii")).alias("spans"))


def mask(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The input rows with every span replaced by ``[KIND]``; ``length_col`` gets the new length.

    Overlapping spans become one mask with the label of the first. Texts without spans, null texts among them, stay.
    """
    pii, chars, order, ends = (fresh(x, docs.columns) for x in ("pii", "pii_chars", "pii_sorted", "pii_ends"))
    df = with_pii(docs, text_col, pii)
    some = F.size(pii) > 0
    df = df.withColumn(chars, F.when(some, F.split(F.col(f"`{text_col}`"), "")))
    df = df.withColumn(order, F.when(some, F.array_sort(F.transform(pii, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))))
    df = df.withColumn(ends, running(F.transform(order, lambda s: -s["back"]), lambda a, b: F.greatest(a, b), 0))
    prior = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(ends), i - 1))
    parts = F.transform(F.col(order), lambda s, i: F.when(s["start"] >= prior(i), F.concat(
        F.array_join(F.slice(F.col(chars), prior(i) + 1, F.greatest(s["start"] - prior(i), F.lit(0))), ""),
        F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))
    last = F.element_at(F.col(ends), -1)
    tail = F.array_join(F.slice(F.col(chars), last + 1, F.size(chars) - last), "")
    masked = F.when(some, F.concat(F.array_join(parts, ""), tail)).otherwise(F.col(f"`{text_col}`"))
    df = df.withColumn(text_col, masked)
    if length_col:
        df = df.withColumn(length_col, F.when(some, F.char_length(F.col(f"`{text_col}`")).cast(
            dict(docs.dtypes)[length_col])).otherwise(F.col(f"`{length_col}`")))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])
