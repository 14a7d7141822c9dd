"""Text Column expressions: accent folding, name normalisation, tokens, label clean-up.

All of these are JVM-side expressions (no Python UDF); they stay inside
whole-stage code generation.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from valorum.functions.sqltext import expr, ident, lit

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
# Stop words dropped from name tokens.
NAME_STOP_WORDS = ("SA", "S", "A", "DO", "DA", "DE", "E", "DOS", "DAS", "CIA", "COMPANHIA")
# Phrase removed from company names before comparison (court-supervised recovery).
NAME_DROP_PHRASES = ("EM RECUPERACAO JUDICIAL",)
# Sector label clean-up: phrase replacement and the dot artefacts, in this order.
LABEL_PHRASES = (("Financeiro e Outros", "Financeiro"),)
LABEL_DOT_ARTEFACTS = (("..", ", "), (" . ", ", "), (". ", ", "))
# Registry sector: prefix stripped and the sentinel that means "no sector".
REGISTRY_SECTOR_PREFIX = r"^Emp\. Adm\. Part\. - "
REGISTRY_SECTOR_BLANK = "Sem Setor Principal"
# Exchange suffix of the quote provider.
TICKER_SUFFIX = ".SA"
# ---------------------------------------------------------------------------

_WS = r"(?U)\s"  # Unicode-aware whitespace, like Python's str patterns


_SEP = "\x01"  # between the entries of a table written as one string


@lru_cache(maxsize=None)
def fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Build the fold tables from the NFKD rule over every code point.

    Returns ``(match, replace, multi)``: ``translate(match, replace)`` maps the one-letter folds;
    ``multi`` lists the characters whose fold has several letters. All other
    characters outside ASCII have no ASCII form.
    """
    one_src, one_dst, multi = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if not unicodedata.decomposition(ch):
            continue
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            one_src.append(ch)
            one_dst.append(folded)
        elif folded:
            multi.append((ch, folded))
    return "".join(one_src), "".join(one_dst), tuple(multi)


# Any character that could have a fold of several letters: a first look that is one range check for each character.
_BEYOND_LATIN1 = "[\u00bc-\u00be\u0100-\\x{10FFFF}]"


@lru_cache(maxsize=None)
def multi_class() -> str:
    """The characters whose fold has several letters, as a character class of ranges."""
    ranges: list[list[int]] = []
    for ch, _ in fold_tables()[2]:
        if ranges and ord(ch) == ranges[-1][1] + 1:
            ranges[-1][1] = ord(ch)
        else:
            ranges.append([ord(ch), ord(ch)])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges) + "]"


def fold_sql(x: str) -> str:
    """F1 as SQL text over the SQL expression ``x``.

    Text that is all ASCII is left as it is. The characters with several letters are looked up one by one, only in rows
    that hold one, and there only from the first such character (U+00BC) on.
    """
    match, replace, multi = fold_tables()
    table = ", ".join(f"split({lit(_SEP.join(part))}, {lit(_SEP)})" for part in zip(*multi))
    expanded = (f"array_join(transform(split({x}, ''), c -> CASE WHEN c < '\u00bc' THEN c "
                f"ELSE coalesce(element_at(map_from_arrays({table}), c), c) END), '')")
    c = (f"CASE WHEN {x} RLIKE {lit(_BEYOND_LATIN1)} AND {x} RLIKE {lit(multi_class())} THEN {expanded} "
         f"ELSE {x} END")
    c = f"translate({c}, {lit(match)}, {lit(replace)})"
    c = f"regexp_replace({c}, {lit(r'[^\x00-\x7F]')}, '')"
    return f"CASE WHEN octet_length({x}) = length({x}) THEN {x} ELSE {c} END"


def normalize_sql(x: str, drop_phrases=NAME_DROP_PHRASES) -> str:
    """F2 as SQL text."""
    c = f"upper({fold_sql(x)})"
    for phrase in drop_phrases:
        c = f"replace({c}, {lit(phrase)}, ' ')"
    # One pass: every run of characters other than A-Z / 0-9 (spaces included) becomes
    # one space - the same as "non-alphanumerics to spaces" followed by "collapse spaces".
    c = f"regexp_replace({c}, '[^A-Z0-9]+', ' ')"
    return f"trim({c})"


def tokens_sql(norm: str, stop_words=NAME_STOP_WORDS) -> str:
    """F3 as SQL text over an already normalised name (only A-Z, 0-9 and single spaces).

    One-letter tokens and stop words (plus the empty string) are cut by one ``array_except``, which also keeps first
    occurrences only: no lambda, no pattern.
    """
    stop = "array(" + ", ".join(lit(w) for w in ("", *stop_words, *(c for c in _NORMAL_LETTERS if c not in stop_words))) + ")"
    return f"array_except(split({norm}, ' '), {stop})"


# The characters of a normalised name.
_NORMAL_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def fold_accents(col: Column | str) -> Column:
    """fold to ASCII (NFKD + drop what has no ASCII form). Fold before ``upper``."""
    if isinstance(col, str):
        return expr(fold_sql(ident(col)))
    c = col
    match, replace, multi = fold_tables()
    table = F.map_from_arrays(*[F.split(F.lit(_SEP.join(part)), _SEP) for part in zip(*multi)])
    expanded = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x < "\u00bc", x).otherwise(
        F.coalesce(F.element_at(table, x), x))), "")
    c = F.when(c.rlike(_BEYOND_LATIN1) & c.rlike(multi_class()), expanded).otherwise(c)
    c = F.translate(c, match, replace)
    return F.regexp_replace(c, r"[^\x00-\x7F]", "")


def fold_literal(text: str) -> str:
    """F1 on a Python string (patterns, constants): the same NFKD-to-ASCII rule."""
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def normalize_name(col: Column | str, drop_phrases=NAME_DROP_PHRASES) -> Column:
    """fold, upper, drop phrases, non-alphanumerics to spaces, collapse, trim."""
    if isinstance(col, str):
        return expr(normalize_sql(ident(col), drop_phrases))
    c = F.upper(fold_accents(col))
    for phrase in drop_phrases:
        c = F.replace(c, F.lit(phrase), F.lit(" "))
    c = F.regexp_replace(c, r"[^A-Z0-9]+", " ")
    return F.trim(c)


def name_tokens(col: Column | str, stop_words=NAME_STOP_WORDS, normalized: bool = False) -> Column:
    """distinct tokens of the normalised name without stop words and one-letter tokens."""
    if isinstance(col, str):
        base = ident(col) if normalized else normalize_sql(ident(col))
        return expr(tokens_sql(base, stop_words))
    norm = (F.col(col) if isinstance(col, str) else col) if normalized else normalize_name(col)
    stop = F.array(*[F.lit(w) for w in stop_words])
    return F.array_distinct(
        F.filter(F.split(norm, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def py_strip(col: Column) -> Column:
    """Strip leading and trailing Unicode whitespace."""
    return F.regexp_replace(col, rf"^{_WS}+|{_WS}+$", "")


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, {lit(f'^{_WS}+|{_WS}+$')}, '')"


def clean_label_sql(x: str) -> str:
    """F4 as SQL text."""
    out = _strip_sql(x)
    for old, new in LABEL_PHRASES + LABEL_DOT_ARTEFACTS:
        out = f"replace({out}, {lit(old)}, {lit(new)})"
    out = _strip_sql(f"regexp_replace({out}, {lit(f'{_WS}+')}, ' ')")
    out = _strip_sql(f"regexp_replace({out}, '^,+|,+$', '')")
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {out} END"


def clean_label(col: Column | str) -> Column:
    """sector text clean-up; order of the dot replacements matters (Q13)."""
    if isinstance(col, str):
        return expr(clean_label_sql(ident(col)))
    c = col
    out = py_strip(c)
    for old, new in LABEL_PHRASES:
        out = F.replace(out, F.lit(old), F.lit(new))
    for old, new in LABEL_DOT_ARTEFACTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    out = py_strip(F.regexp_replace(out, rf"{_WS}+", " "))
    out = py_strip(F.regexp_replace(out, r"^,+|,+$", ""))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(out)


def clean_registry_sector(col: Column | str) -> Column:
    """strip, drop the holding prefix, blank the 'no sector' sentinel."""
    c = F.col(col) if isinstance(col, str) else col
    out = F.regexp_replace(py_strip(F.coalesce(c, F.lit(""))), REGISTRY_SECTOR_PREFIX, "")
    return F.when(out == REGISTRY_SECTOR_BLANK, F.lit("")).otherwise(out)


def ticker_upper(col: Column | str) -> Column:
    """upper-case ticker key."""
    return F.upper(F.col(col) if isinstance(col, str) else col)


def add_suffix(col: Column | str, suffix: str = TICKER_SUFFIX) -> Column:
    """provider symbol = upper ticker + suffix."""
    return F.concat(ticker_upper(col), F.lit(suffix))


def strip_suffix(col: Column | str, suffix: str = TICKER_SUFFIX) -> Column:
    """provider symbol back to the ticker."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, "\\Q" + suffix + "\\E$", "")


def cut(col: Column | str, n: int = 120) -> Column:
    """cut a message to ``n`` characters."""
    return F.left(F.col(col) if isinstance(col, str) else col, F.lit(n))
