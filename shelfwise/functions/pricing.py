"""Price and promotion algebra: price text to typed values, effective price and per cent off.

The algebra is a list of stages, each a set of named expressions over the columns before it, so Spark compiles one
projection (no UDF) and the same definition can be printed for another SQL engine. Money is whole cents; per cents are
exact fractions, rounded half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialect import SPARK, Dialect

_NUMBER = r"[0-9]+(?:\.[0-9]{1,2})?"
_PERCENT = r"(?i)([0-9]+)\s*%\s*off"
_BUY_GET = r"(?i)buy\s+([0-9]+)\s*,?\s*get\s+([0-9]+)\s+free"
_N_FOR = rf"(?i)([0-9]+)\s+for\s+\$({_NUMBER})"
_SINGLE = rf"^\$({_NUMBER})(.*)$"
_RANGE = rf"^\$({_NUMBER})\s+to\s+\$({_NUMBER})(.*)$"
_PRICED = rf"^(\${_NUMBER}(?:\s+to\s+\${_NUMBER})?)(.*)$"


def is_percent(d: Dialect, x: str) -> str:
    return f"coalesce({d.matches(x, _PERCENT)}, false)"


def is_promo(d: Dialect, x: str) -> str:
    """Per cent off, buy and get, or some for a price: text that is no price of one."""
    n_for = r"(?i)[0-9]+\s+for\s+\$[0-9]"
    return f"({is_percent(d, x)} OR coalesce({d.matches(x, _BUY_GET)}, false) OR coalesce({d.matches(x, n_for)}, false))"


def clean_discount(d: Dialect, x: str) -> str:
    return f"CASE WHEN {is_percent(d, x)} THEN concat({d.group(x, _PERCENT)}, '% off') ELSE trim({x}) END"


def clean_regular(d: Dialect, x: str) -> str:
    level = "trim(" + d.replace("trim(" + d.replace(x, r"(?i)^\s*regular\s+", "") + ")", r"\s+", " ") + ")"
    return f"CASE WHEN lower({level}) LIKE '%prices vary%' THEN 'prices vary' ELSE nullif({level}, '') END"


def unit_suffix(x: str) -> str:
    return f"CASE WHEN lower(coalesce({x}, '')) LIKE '%/lb%' THEN '/lb' ELSE ' ea' END"


def with_suffix(d: Dialect, x: str, suffix: str = "' ea'") -> str:
    """A price text with a unit; promotions and prices that have one stay."""
    own = f"lower({x}) LIKE '%/lb%' OR lower({x}) LIKE '% ea%' OR lower({x}) LIKE '%ea'"
    return f"CASE WHEN {is_promo(d, x)} THEN {clean_discount(d, x)} WHEN lower({x}) LIKE '%prices vary%' THEN 'prices vary' WHEN {own} THEN trim({x}) ELSE concat(trim({x}), {suffix}) END"


def other_suffix(d: Dialect, x: str, suffix: str) -> str:
    return f"CASE WHEN {is_promo(d, x)} THEN {clean_discount(d, x)} WHEN lower({x}) LIKE '%prices vary%' THEN 'prices vary' WHEN {d.matches(x, _PRICED)} THEN concat({d.group(x, _PRICED)}, {suffix}) ELSE trim({x}) END"


def cents(x: str) -> str:
    return f"CAST(try_cast({x} AS DECIMAL(14, 2)) * 100 AS BIGINT)"


def is_single(x: str) -> str:
    return f"NOT (lower({x}) LIKE '%buy %' OR lower({x}) LIKE '% for $%' OR {x} LIKE '%!%%' ESCAPE '!' OR lower({x}) LIKE '%vary%' OR lower({x}) LIKE '% to %')"


def half_even(d: Dialect, a: str, b: str) -> str:
    """a / b rounded half to even; b positive."""
    q, r = d.div(f"abs({a})", b), f"(abs({a}) % ({b}))"
    up = f"CASE WHEN 2 * {r} > ({b}) OR (2 * {r} = ({b}) AND {q} % 2 = 1) THEN 1 ELSE 0 END"
    return f"(CASE WHEN ({a}) < 0 THEN -1 ELSE 1 END * ({q} + {up}))"


def money(d: Dialect, c: str) -> str:
    return f"concat('$', CAST({d.div(c, '100')} AS STRING), '.', lpad(CAST(({c}) % 100 AS STRING), 2, '0'))"


def stages(d: Dialect, regular: str, prime: str, current: str, discount: str) -> list[dict[str, str]]:
    """Named expressions over the input columns, stage by stage; the last gives ``basis_price, prime_price, discount``."""
    single = lambda x, n: f"CASE WHEN {is_single(x)} THEN {d.group(x, _SINGLE, n)} END"
    off = lambda p, r: half_even(d, f"100 * (({r}) - ({p}))", r)
    up = lambda a, b: d.div(f"({a}) + ({b}) - 1", b)  # noqa: E731  cents are rounded up
    text_of = lambda pct: f"concat(CAST({pct} AS STRING), '% off')"
    span = lambda a, b: f"CASE WHEN {a} = {b} THEN {text_of(a)} ELSE concat(CAST(least({a}, {b}) AS STRING), '% to ', CAST(greatest({a}, {b}) AS STRING), '% off') END"
    unit = lambda s: f"CASE WHEN trim(coalesce({s}, '')) = '' THEN ' ea' WHEN lower({s}) LIKE '%ea%' OR lower({s}) LIKE '%/lb%' THEN trim({s}) ELSE concat(trim({s}), ' ea') END"
    return [
        {"q_reg_in": f"nullif({regular}, '')", "q_cur": f"nullif({current}, '')", "q_disc_in": f"nullif({discount}, '')", "q_prime_in": f"nullif({prime}, '')"},
        {"q_reg": clean_regular(d, "q_reg_in"), "q_pr": "coalesce(q_prime_in, q_cur)", "q_disc": clean_discount(d, "q_disc_in")},
        {
            "q_p1": "nullif(q_disc, '0% off')",
            "q_p2": f"CASE WHEN {is_percent(d, 'q_pr')} THEN nullif({clean_discount(d, 'q_pr')}, '0% off') END",
            "q_p3": f"CASE WHEN {is_percent(d, 'q_cur')} THEN nullif({clean_discount(d, 'q_cur')}, '0% off') END",
            "q_mode": f"CASE WHEN {is_percent(d, 'q_pr')} THEN 'percent' WHEN q_reg IS NOT NULL AND q_pr IS NOT NULL THEN 'both' WHEN q_reg IS NOT NULL AND q_disc IS NOT NULL THEN 'discount' WHEN q_reg IS NOT NULL THEN 'regular' WHEN q_pr IS NOT NULL THEN 'prime' ELSE 'none' END",
        },
        {"q_v1": d.largest_percent("q_p1"), "q_v2": d.largest_percent("q_p2"), "q_v3": d.largest_percent("q_p3"), "q_px": "CASE WHEN q_mode = 'both' THEN q_pr WHEN q_mode = 'discount' THEN q_disc END"},
        {
            "q_strong": "CASE WHEN q_p1 IS NOT NULL AND (q_p2 IS NULL OR q_v1 >= q_v2) AND (q_p3 IS NULL OR q_v1 >= q_v3) THEN q_p1 WHEN q_p2 IS NOT NULL AND (q_p3 IS NULL OR q_v2 >= q_v3) THEN q_p2 ELSE q_p3 END",
            "q_dreg": with_suffix(d, "q_reg"), "q_dpx": with_suffix(d, "q_px", unit_suffix("q_reg")),
            "q_r": cents(single("q_reg", 1)), "q_rs": single("q_reg", 2), "q_lo": cents(d.group("q_reg", _RANGE, 1)), "q_hi": cents(d.group("q_reg", _RANGE, 2)), "q_gs": d.group("q_reg", _RANGE, 3),
            "q_p": cents(single("q_px", 1)), "q_pct": f"try_cast({d.group('q_px', _PERCENT)} AS BIGINT)", "q_n": f"try_cast({d.group('q_px', _N_FOR, 1)} AS BIGINT)", "q_t": cents(d.group("q_px", _N_FOR, 2)),
            "q_buy": f"try_cast({d.group('q_px', _BUY_GET, 1)} AS BIGINT)", "q_free": f"try_cast({d.group('q_px', _BUY_GET, 2)} AS BIGINT)",
        },
        {
            "q_dr": cents(single("q_dreg", 1)), "q_dp": cents(single("q_dpx", 1)),
            "q_branch": "CASE WHEN q_px IS NULL THEN NULL WHEN lower(q_reg) LIKE '%vary%' THEN 0 WHEN q_r > 0 AND q_p IS NOT NULL THEN 1 WHEN q_lo > 0 AND q_hi > 0 AND q_p IS NOT NULL THEN 2 WHEN q_lo IS NOT NULL AND q_pct IS NOT NULL THEN 3 WHEN q_r > 0 AND q_n > 0 THEN 4 WHEN q_lo > 0 AND q_hi > 0 AND q_n > 0 THEN 5 WHEN q_r IS NOT NULL AND q_buy + q_free > 0 THEN 6 WHEN q_lo IS NOT NULL AND q_buy + q_free > 0 THEN 7 WHEN q_r IS NOT NULL AND q_pct IS NOT NULL THEN 8 END",
        },
        {
            "q_b": f"CASE WHEN q_branch IS NOT NULL OR q_px IS NULL THEN q_branch WHEN q_dr > 0 AND q_dp IS NOT NULL THEN 10 WHEN {is_percent(d, 'q_px')} THEN 11 ELSE 12 END",
            "q_unit": f"CASE WHEN q_branch IN (4, 5) THEN {up('q_t', 'q_n')} WHEN q_branch = 6 THEN {up('q_r * q_buy', 'q_buy + q_free')} WHEN q_branch = 7 THEN {up('q_lo * q_buy', 'q_buy + q_free')} WHEN q_branch = 8 THEN {half_even(d, 'q_r * (100 - q_pct)', '100')} END",
            "q_unit2": f"CASE WHEN q_branch = 7 THEN {up('q_hi * q_buy', 'q_buy + q_free')} END",
            "q_sfx": f"CASE WHEN q_branch IN (5, 7) THEN {unit('q_gs')} ELSE {unit('q_rs')} END",
        },
        {
            "q_prime": f"CASE WHEN q_b IN (3, 11) THEN {clean_discount(d, 'q_px')} WHEN q_b IN (4, 5, 6, 8) THEN concat({money(d, 'q_unit')}, q_sfx) WHEN q_b = 7 THEN concat({money(d, 'q_unit')}, ' to ', {money(d, 'q_unit2')}, q_sfx) ELSE q_dpx END",
            "q_off": f"CASE WHEN q_b = 1 THEN {text_of(off('q_p', 'q_r'))} WHEN q_b = 2 THEN {span(off('q_p', 'q_lo'), off('q_p', 'q_hi'))} WHEN q_b IN (3, 11) THEN {clean_discount(d, 'q_px')} WHEN q_b = 4 THEN {text_of(off('q_unit', 'q_r'))} WHEN q_b = 5 THEN {span(off('q_unit', 'q_lo'), off('q_unit', 'q_hi'))} WHEN q_b IN (6, 7) THEN {text_of(half_even(d, '100 * q_free', 'q_buy + q_free'))} WHEN q_b = 8 THEN {text_of('q_pct')} WHEN q_b = 10 THEN {text_of(off('q_dp', 'q_dr'))} WHEN q_b = 12 THEN '0% off' END",
            "q_basis": f"CASE WHEN q_b = 4 THEN concat({money(d, 'q_r')}, q_sfx) WHEN q_b = 5 THEN concat({money(d, 'q_lo')}, ' to ', {money(d, 'q_hi')}, q_sfx) ELSE q_dreg END",
        },
        {"q_h": f"CASE WHEN q_mode IN ('both', 'discount') THEN {with_suffix(d, 'q_prime', unit_suffix('q_basis'))} END"},
        {"q_h2": other_suffix(d, "q_h", unit_suffix("q_basis"))},
        {
            "price_branch": "q_b",
            "basis_price": f"CASE WHEN q_mode IN ('both', 'discount') THEN CASE WHEN q_h2 IS NOT NULL AND {d.key('q_basis')} = {d.key('q_h2')} THEN NULL ELSE q_basis END WHEN q_mode IN ('percent', 'regular') THEN q_dreg END",
            "prime_price": f"CASE WHEN q_mode IN ('both', 'discount') THEN q_h2 WHEN q_mode = 'prime' THEN {with_suffix(d, 'q_pr', unit_suffix('coalesce(q_reg_in, q_cur)'))} END",
            "discount": "CASE WHEN q_mode = 'both' THEN nullif(q_off, '0% off') WHEN q_mode = 'discount' THEN nullif(coalesce(q_off, q_disc), '0% off') WHEN q_mode = 'percent' THEN q_strong ELSE coalesce(q_strong, q_disc) END",
        },
    ]


def resolve_prices(df: DataFrame, regular: str, prime: str, current: str, discount: str) -> DataFrame:
    """Adds ``price_branch, basis_price, prime_price, discount``; columns of those names are replaced.

    Inputs are price texts; empty is null. ``price_branch`` is the rule of the algebra that applied, null if none had two sides.
    """
    own = [c for c in df.columns if c not in ("price_branch", "basis_price", "prime_price", "discount")]
    names = {c: f"i_{i}" for i, c in enumerate((regular, prime, current, discount))}
    now = df.select("*", *(F.col(c).cast("string").alias(n) for c, n in names.items()))
    last = now
    for stage in stages(SPARK, *(names[c] for c in (regular, prime, current, discount))):
        last = last.drop(*(set(stage) & {"price_branch", "basis_price", "prime_price", "discount"})).selectExpr("*", *(f"{e} AS {n}" for n, e in stage.items()))
    # a generator of one row: filters on its columns cannot be pushed below, where they would repeat the whole algebra
    results = F.array(F.struct("price_branch", "basis_price", "prime_price", "discount"))
    return last.select(*own, F.inline(results))


def resolve_prices_sql(d: Dialect, source: str, regular: str, prime: str, current: str, discount: str, keep: str) -> str:
    """The same as a query over ``source``, with columns ``keep`` and the four results."""
    sql = source
    for i, stage in enumerate(stages(d, regular, prime, current, discount)):
        sql = f"(SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM {sql} AS s{i})"
    text = f"SELECT {keep}, price_branch, basis_price, prime_price, discount FROM {sql} AS priced"
    return text if d.spark else text.replace("AS STRING", "AS VARCHAR")


def discount_percent(x: Column | str) -> Column:
    """The largest number before a percent sign in a text, at least 0."""
    found = F.regexp_extract_all(F.col(x) if isinstance(x, str) else x, F.lit(r"([0-9]+)\s*%"), F.lit(1))
    return F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(found, lambda t: t.try_cast("int"))), F.lit(0)))


def first_price(x: Column | str) -> Column:
    """The first ``$n`` of a text as a double, null without one (sorts last)."""
    return F.nullif(F.regexp_extract(F.col(x) if isinstance(x, str) else x, r"\$([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
