"""Label and parsing Columns (C2-C6, C15-C17): owner bands, compact counts,
currency labels, hours labels, review quota, genre and tag parsing.

All pure Column expressions, so they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ludex import config

DASH = "—"
EN_DASH = "–"
ELLIPSIS = "…"


def owners_lo(raw: Column) -> Column:
    """Lower bound of an owners band ('10,000,000 .. 20,000,000' -> 10000000); ''/NULL -> NULL."""
    first = F.split_part(F.coalesce(raw, F.lit("")), F.lit(".."), F.lit(1))
    digits = F.regexp_replace(F.trim(first), r"[^0-9]", "")
    return F.nullif(digits, F.lit("")).cast("bigint")


def _js_round(x: Column) -> Column:
    """Math.round: half up toward +infinity."""
    return F.floor(x + F.lit(0.5))


def _plain_number(x: Column) -> Column:
    """Number formatted like toLocaleString('en-US') for |x| < 1000 (<= 3 decimals)."""
    s = F.format_number(x.cast("double"), 3)
    return F.regexp_replace(s, r"\.?0+$", "")


def compact(n: Column) -> Column:
    """C4: 999 -> '999', 1500 -> '2k', 35510000 -> '36m' (b/m/k; rounding on the raw magnitude)."""
    a = F.abs(n.cast("double"))
    sign = F.when(n < 0, F.lit("-")).otherwise(F.lit(""))

    def fmt(v, suffix):
        # |n| >= 1000 here, so the reference always rounds to an integer
        return F.concat(sign, _js_round(v).cast("bigint").cast("string"), F.lit(suffix))
    return (F.when(n.isNull(), F.lit(None))
             .when(a >= 1e9, fmt(a / 1e9, "b"))
             .when(a >= 1e6, fmt(a / 1e6, "m"))
             .when(a >= 1e3, fmt(a / 1e3, "k"))
             .otherwise(_plain_number(n)))


def parse_num(s: Column) -> Column:
    """Number(raw.replace(/,/g, '').trim()) with NULL for non-numbers."""
    cleaned = F.trim(F.regexp_replace(s, ",", ""))
    return F.when(cleaned == "", F.lit(0.0)).otherwise(cleaned.try_cast("double"))


def owners_label(raw: Column) -> Column:
    """C3: '10,000,000 .. 20,000,000' -> '10m–20m'; NULL/'' /'0' -> '—'; single number; else raw."""
    parts = F.split(raw, r"\s*\.\.\s*")
    lo, hi = parse_num(F.element_at(parts, 1)), parse_num(F.element_at(parts, 2))
    single = parse_num(raw)
    return (F.when(raw.isNull() | (raw == "") | (raw == "0"), F.lit(DASH))
             .when((F.size(parts) == 2) & lo.isNotNull() & hi.isNotNull(),
                   F.concat(compact(lo), F.lit(EN_DASH), compact(hi)))
             .when(single.isNotNull(), compact(single))
             .otherwise(raw))


def count_label(n: Column) -> Column:
    """formatCount: NULL -> '—', else compact."""
    return F.when(n.isNull(), F.lit(DASH)).otherwise(compact(n))


def full_count(n: Column) -> Column:
    """1234 -> '1,234' (NULL -> '—')."""
    return F.when(n.isNull(), F.lit(DASH)).otherwise(F.format_number(n.cast("double"), 0))


def usd_label(p: Column, zero_as: str = "Free") -> Column:
    """C5: '$29.99' / 'Free' (or '$0') / '—'."""
    return (F.when(p.isNull(), F.lit(DASH)).when(p == 0, F.lit(zero_as))
             .otherwise(F.concat(F.lit("$"), F.format_string("%.2f", p.cast("double")))))


def inr_label(col_name: str, zero_as: str = "₹0") -> Column:
    """C5: '₹2,49,900' style Indian digit grouping (lakh/crore); 2 decimals when not whole.

    Built as a SQL expression over a column name (look-ahead regex groups digits)."""
    c = col_name
    s = f"cast(floor(cast({c} as decimal(20,2))) as bigint)"
    whole = f"cast({s} as string)"
    grouped = (f"case when length({whole}) <= 3 then {whole} else "
               f"concat(regexp_replace(substring({whole}, 1, length({whole}) - 3), '(\\\\d)(?=(\\\\d{{2}})+$)', '$1,'), "
               f"',', substring({whole}, length({whole}) - 2, 3)) end")
    frac = f"cast({c} as decimal(20,2)) - {s}"
    text = f"concat('₹', {grouped}, case when {frac} = 0 then '' else substring(format_string('%.2f', cast({frac} as double)), 2) end)"
    return F.expr(f"case when {c} is null then '{DASH}' when {c} = 0 then '{zero_as}' else {text} end")


def store_price_label(usd: str, inr: str, is_free: str | None = None) -> Column:
    """formatStorePrice: 'Free' when free or a known price is 0, else USD and INR joined by ' · '."""
    u, i = F.col(usd), F.col(inr)
    free = (u.isNotNull() & (u == 0)) | (u.isNull() & i.isNotNull() & (i == 0))
    if is_free:
        free = F.coalesce(F.col(is_free), F.lit(False)) | free
    parts = F.array_compact(F.array(F.when(u.isNotNull(), usd_label(u, "Free")), F.when(i.isNotNull(), inr_label(inr))))
    return F.when(free, F.lit("Free")).when(F.size(parts) == 0, F.lit(DASH)).otherwise(F.array_join(parts, " · "))


def hours_label(minutes: Column) -> Column:
    """Minutes -> '12h' (>= 10 h), '1.5h' (>= 1 h), '40m'."""
    h = minutes / 60.0
    return (F.when(minutes.isNull(), F.lit(DASH))
             .when(h >= 10, F.concat(_js_round(h).cast("bigint").cast("string"), F.lit("h")))
             .when(h >= 1, F.concat(F.format_string("%.1f", _js_round(h * 10) / 10), F.lit("h")))
             .otherwise(F.concat(_js_round(minutes).cast("bigint").cast("string"), F.lit("m"))))


def short_label(s: Column, max_len: int = 18) -> Column:
    """Truncate to max_len with an ellipsis."""
    return F.when(F.length(s) <= max_len, s).otherwise(F.concat(F.substring(s, 1, max_len - 1), F.lit(ELLIPSIS)))


def short_band(s: Column, max_len: int = 16) -> Column:
    """'a .. b' -> 'a–b' without commas, then truncated."""
    return short_label(F.regexp_replace(F.regexp_replace(s, r"\s*\.\.\s*", EN_DASH), ",", ""), max_len)


def review_quota(rank: Column) -> Column:
    """(pages, per_page) to fetch for a snapshot rank (0-based)."""
    expr = None
    for hi, pages, per in config.REVIEW_QUOTA:
        val = F.struct(F.lit(pages).alias("pages"), F.lit(per).alias("per_page"))
        if hi is None:
            expr = expr.otherwise(val)
        else:
            expr = F.when(rank < hi, val) if expr is None else expr.when(rank < hi, val)
    return expr


def parse_genres(c: Column) -> Column:
    """Comma-separated genre string -> trimmed non-empty names; NULL/'' -> []."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def parse_genre_field(raw: Column) -> Column:
    """C16 on a field read as text: a JSON list (``["A", "B"]``, as the JSON
    reader hands over a list in a string column) or a plain comma string."""
    as_list = F.from_json(raw, "array<string>")
    from_list = F.filter(F.transform(as_list, lambda x: F.trim(x)), lambda x: x != "")
    return (F.when(raw.isNull(), F.array().cast("array<string>"))
             .when(F.trim(raw).startswith("["), F.coalesce(from_list, F.array().cast("array<string>")))
             .otherwise(parse_genres(raw)))


def tag_names(raw_json: Column) -> Column:
    """C17: keys of a tags object ({name: votes}); a non-object (e.g. []) gives []."""
    m = F.from_json(raw_json, "map<string,int>")
    return F.coalesce(F.map_keys(m), F.array().cast("array<string>"))
