"""Classification rules as set-wise Column expressions.

Every rule table is a parameter with the reference's table as default; rules are
applied in order, first match wins, exactly like the reference's if-chains.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valorum.functions.sqltext import expr, ident, lit

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's (labels, patterns, thresholds).
# ---------------------------------------------------------------------------
# C1 listing segment (upper-cased text contains any pattern -> label), in order.
GOVERNANCE_RULES = (
    (("NOVO MERCADO",), "Novo Mercado"),
    (("MAIS N",), "Bovespa Mais N2"),
    (("NIVEL 2", "NÍVEL 2"), "Nível 2"),
    (("NIVEL 1", "NÍVEL 1"), "Nível 1"),
    (("MAIS",), "Bovespa Mais"),
)
GOVERNANCE_OTHER = "Tradicional"
# C2 shareholder control, in order.
CONTROL_RULES = (
    (("ESTATAL",), "Estatal"),
    (("ESTRANGEIRO",), "Estrangeiro"),
    (("PRIVADO",), "Privada nacional"),
)
# C3 size cut-offs on market cap in units: (minimum, label), largest first.
SIZE_CUTS = ((10e9, "Large cap"), (2e9, "Mid cap"))
SIZE_OTHER = "Small cap"
# C4 situation tags.
TAG_LOSS = "Prejuízo"
TAG_HIGH_DY = "Alta DY"
TAG_CHEAP = "Barata"
TAG_EXPENSIVE = "Cara"
TAG_QUALITY = "Qualidade"
TAG_LEVERAGED = "Alavancada"
TAG_BLUE_CHIP = "Blue chip"
TAG_THRESHOLDS = {
    "dy_high": 8.0, "pl_cheap": 8.0, "pvp_cheap": 1.0, "pl_expensive": 25.0, "pvp_expensive": 4.0,
    "roe_quality": 15.0, "leverage_quality": 2.0, "leverage_high": 3.5, "mcap_blue_chip": 5e10,
}
TAG_LIMIT = 3
# C5 investment profile.
PROFILE_CYCLICAL = "Cíclica"
PROFILE_DIVIDENDS = "Dividendos"
PROFILE_GROWTH = "Crescimento"
PROFILE_VALUE = "Valor"
PROFILE_DEFENSIVE = "Defensiva"
CYCLICAL_SECTORS = ("Materiais Básicos", "Petróleo, Gás e Biocombustíveis")
DEFENSIVE_SECTORS = ("Utilidade Pública", "Consumo não Cíclico", "Saúde")
PROFILE_THRESHOLDS = {
    "dy_dividends": 6.0, "cagr_growth": 12.0, "roe_growth": 12.0, "pl_value": 9.0,
    "pvp_value": 1.2, "cagr_growth_late": 8.0,
}
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def classify_by_contains(col, rules, default: str | None = None, blank: str = "") -> Column:
    """Upper-case the text, first rule with a contained pattern wins.

    ``default`` is the label for non-blank text no rule matched (``None``: blank).
    Blank or null text gives ``blank``.
    """
    if isinstance(col, str):
        up_s = f"upper(coalesce({ident(col)}, ''))"
        whens = " ".join(
            "WHEN " + " OR ".join(f"contains({up_s}, {lit(p)})" for p in pats) + f" THEN {lit(label)}"
            for pats, label in rules)
        other = lit(default if default is not None else blank)
        return expr(f"CASE {whens} WHEN {up_s} = '' THEN {lit(blank)} ELSE {other} END")
    up = F.upper(F.coalesce(_c(col), F.lit("")))
    expr_ = None
    for patterns, label in rules:
        cond = None
        for p in patterns:
            c = up.contains(p)
            cond = c if cond is None else (cond | c)
        expr_ = F.when(cond, F.lit(label)) if expr_ is None else expr_.when(cond, F.lit(label))
    fallback = F.when(up == "", F.lit(blank)).otherwise(F.lit(default if default is not None else blank))
    return expr_.otherwise(fallback)


def classify_governance(col) -> Column:
    """C1 with the reference's rule table."""
    return classify_by_contains(col, GOVERNANCE_RULES, GOVERNANCE_OTHER)


def classify_control(col) -> Column:
    """C2 with the reference's rule table."""
    return classify_by_contains(col, CONTROL_RULES, None)


def classify_size(mcap, cuts=SIZE_CUTS, other: str = SIZE_OTHER) -> Column:
    """Null or zero -> blank; else the first cut reached; negative counts as small (Q6)."""
    m = _c(mcap)
    out = F.when(m.isNull() | (m == 0), F.lit(""))
    for lo, label in cuts:
        out = out.when(m >= lo, F.lit(label))
    return out.otherwise(F.lit(other))


def _truthy_ge(x: Column, k: float) -> Column:
    # Python "x and x >= k" for k > 0: null and zero fail; null -> false here.
    return F.coalesce(x >= k, F.lit(False))


def _between_open(x: Column, hi: float) -> Column:
    return F.coalesce((x > 0) & (x <= hi), F.lit(False))


def derive_tags(dy, pl, pvp, roe, leverage, eps, mcap, th: dict | None = None,
                limit: int = TAG_LIMIT) -> Column:
    """C4: situation tags by rule order, at most ``limit`` (Q15)."""
    t = dict(TAG_THRESHOLDS, **(th or {}))
    if all(isinstance(c, str) for c in (dy, pl, pvp, roe, leverage, eps, mcap)):
        return expr(tags_sql(*map(ident, (dy, pl, pvp, roe, leverage, eps, mcap)), t, limit))
    dy, pl, pvp, roe, lev, eps, mcap = map(_c, (dy, pl, pvp, roe, leverage, eps, mcap))
    loss = F.coalesce(eps < 0, F.lit(False))
    cheap = _between_open(pl, t["pl_cheap"]) & _between_open(pvp, t["pvp_cheap"])
    expensive = _truthy_ge(pl, t["pl_expensive"]) | _truthy_ge(pvp, t["pvp_expensive"])
    quality = _truthy_ge(roe, t["roe_quality"]) & (lev.isNull() | F.coalesce(lev <= t["leverage_quality"], F.lit(False)))
    candidates = F.array(
        F.when(loss, F.lit(TAG_LOSS)),
        F.when(_truthy_ge(dy, t["dy_high"]), F.lit(TAG_HIGH_DY)),
        F.when(cheap, F.lit(TAG_CHEAP)).when(expensive, F.lit(TAG_EXPENSIVE)),
        F.when(quality, F.lit(TAG_QUALITY)),
        F.when(_truthy_ge(lev, t["leverage_high"]), F.lit(TAG_LEVERAGED)),
        F.when(_truthy_ge(mcap, t["mcap_blue_chip"]) & ~loss, F.lit(TAG_BLUE_CHIP)),
    )
    return F.slice(F.filter(candidates, lambda x: x.isNotNull()), 1, limit)


def derive_profile(sector, dy, pl, pvp, cagr, roe, th: dict | None = None) -> Column:
    """Investment profile by ordered rules; default 'Valor'."""
    t = dict(PROFILE_THRESHOLDS, **(th or {}))
    if all(isinstance(c, str) for c in (dy, pl, pvp, cagr, roe)) and isinstance(sector, (str, SqlText)):
        sec = sector.text if isinstance(sector, SqlText) else ident(sector)
        return expr(profile_sql(sec, *map(ident, (dy, pl, pvp, cagr, roe)), t))
    if isinstance(sector, SqlText):
        sector = expr(sector.text)
    sector, dy, pl, pvp, cagr, roe = map(_c, (sector, dy, pl, pvp, cagr, roe))
    return (
        F.when(sector.isin(*CYCLICAL_SECTORS), F.lit(PROFILE_CYCLICAL))
        .when(_truthy_ge(dy, t["dy_dividends"]), F.lit(PROFILE_DIVIDENDS))
        .when(_truthy_ge(cagr, t["cagr_growth"]) & _truthy_ge(roe, t["roe_growth"]), F.lit(PROFILE_GROWTH))
        .when(_between_open(pl, t["pl_value"]) & _between_open(pvp, t["pvp_value"]), F.lit(PROFILE_VALUE))
        .when(sector.isin(*DEFENSIVE_SECTORS), F.lit(PROFILE_DEFENSIVE))
        .when(_truthy_ge(cagr, t["cagr_growth_late"]), F.lit(PROFILE_GROWTH))
        .otherwise(F.lit(PROFILE_VALUE))
    )


class SqlText:
    """A SQL expression text passed where a column is expected (kept as text for the fast path)."""

    def __init__(self, text: str):
        self.text = text


def _ge(x: str, k: float) -> str:
    return f"coalesce({x} >= {k!r}D, false)"


def _between(x: str, hi: float) -> str:
    return f"coalesce({x} > 0 AND {x} <= {hi!r}D, false)"


def tags_sql(dy: str, pl: str, pvp: str, roe: str, lev: str, eps: str, mcap: str, t: dict,
             limit: int = TAG_LIMIT) -> str:
    """C4 as SQL text (same rules as :func:`derive_tags`)."""
    loss = f"coalesce({eps} < 0, false)"
    cheap = f"({_between(pl, t['pl_cheap'])} AND {_between(pvp, t['pvp_cheap'])})"
    expensive = f"({_ge(pl, t['pl_expensive'])} OR {_ge(pvp, t['pvp_expensive'])})"
    quality = f"({_ge(roe, t['roe_quality'])} AND ({lev} IS NULL OR coalesce({lev} <= {t['leverage_quality']!r}D, false)))"
    items = [f"CASE WHEN {loss} THEN {lit(TAG_LOSS)} END",
             f"CASE WHEN {_ge(dy, t['dy_high'])} THEN {lit(TAG_HIGH_DY)} END",
             f"CASE WHEN {cheap} THEN {lit(TAG_CHEAP)} WHEN {expensive} THEN {lit(TAG_EXPENSIVE)} END",
             f"CASE WHEN {quality} THEN {lit(TAG_QUALITY)} END",
             f"CASE WHEN {_ge(lev, t['leverage_high'])} THEN {lit(TAG_LEVERAGED)} END",
             f"CASE WHEN {_ge(mcap, t['mcap_blue_chip'])} AND NOT {loss} THEN {lit(TAG_BLUE_CHIP)} END"]
    return f"slice(filter(array({', '.join(items)}), x -> x IS NOT NULL), 1, {limit})"


def profile_sql(sector: str, dy: str, pl: str, pvp: str, cagr: str, roe: str, t: dict) -> str:
    """C5 as SQL text (same rules as :func:`derive_profile`)."""
    cyc = ", ".join(lit(x) for x in CYCLICAL_SECTORS)
    dfn = ", ".join(lit(x) for x in DEFENSIVE_SECTORS)
    return (f"CASE WHEN {sector} IN ({cyc}) THEN {lit(PROFILE_CYCLICAL)} "
            f"WHEN {_ge(dy, t['dy_dividends'])} THEN {lit(PROFILE_DIVIDENDS)} "
            f"WHEN {_ge(cagr, t['cagr_growth'])} AND {_ge(roe, t['roe_growth'])} THEN {lit(PROFILE_GROWTH)} "
            f"WHEN {_between(pl, t['pl_value'])} AND {_between(pvp, t['pvp_value'])} THEN {lit(PROFILE_VALUE)} "
            f"WHEN {sector} IN ({dfn}) THEN {lit(PROFILE_DEFENSIVE)} "
            f"WHEN {_ge(cagr, t['cagr_growth_late'])} THEN {lit(PROFILE_GROWTH)} "
            f"ELSE {lit(PROFILE_VALUE)} END")
