"""Pure Column functions. All of them stay inside JVM expression evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions import vocab as V


# ---- text and numbers -------------------------------------------------------------------

def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor blank."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def as_number(c: Column) -> Column:
    """Text or number to double; unreadable text and NaN become null, infinity is kept."""
    value = F.trim(c.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def optional_amount(c: Column) -> Column:
    """Absent amounts count as zero; a supplied but unreadable amount stays null."""
    return F.when(c.isNull(), F.lit(0.0)).otherwise(as_number(c))


def is_malformed(c: Column) -> Column:
    return c.isNotNull() & as_number(c).isNull()


def finite(c: Column) -> Column:
    value = c.cast("double")
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def json_safe(c: Column) -> Column:
    """Double as a JSON-safe text: non-finite numbers keep their name instead of breaking the file."""
    value = c.cast("double")
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(value == float("inf"), F.lit("inf"))
        .when(value == float("-inf"), F.lit("-inf"))
        .otherwise(value.cast("string"))
    )


def clean_default(c: Column, default) -> Column:
    """Null, NaN and the text 'nan' become the default."""
    text = c.cast("string")
    return F.when(c.isNull() | (F.lower(text) == "nan"), F.lit(default)).otherwise(c)


def ratio(numerator: Column, denominator: Column, places: int | None = None) -> Column:
    """Null-safe division; decimals stay exact until the final rounding."""
    value = numerator / F.nullif(denominator, F.lit(0))
    return value if places is None else F.round(value, places)


# ---- time -------------------------------------------------------------------------------

def to_instant(c: Column) -> Column:
    """Mixed ISO text to an instant. Text without an offset is UTC whatever the session zone is."""
    text = F.trim(c.cast("string"))
    # The pattern is tried only where the common ending does not decide.
    has_zone = text.endswith("Z") | text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    spelled = (
        F.when(F.length(text) <= 10, F.concat(text, F.lit("T00:00:00Z")))
        .when(has_zone, text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return spelled.try_cast("timestamp")


def business_time(instant: Column, tz: str = V.BUSINESS_TZ) -> Column:
    """Instant to wall time of the business zone, without a zone."""
    return F.convert_timezone(None, F.lit(tz), instant.cast("timestamp_ntz"))


def business_date(instant: Column, tz: str = V.BUSINESS_TZ) -> Column:
    return business_time(instant, tz).cast("date")


def weekday_monday0(d: Column) -> Column:
    return F.weekday(d)


def is_sale_day(d: Column) -> Column:
    """Double-day sale: day of month equals month."""
    return F.dayofmonth(d) == F.month(d)


def is_flash_hour(ts: Column) -> Column:
    return F.hour(ts).isin(*V.FLASH_HOURS)


def last_transition(*cols: Column) -> Column:
    """Latest of several lifecycle times, nulls ignored."""
    return F.greatest(*cols)


# ---- platform, line key, cancellation ---------------------------------------------------

def normal_platform(c: Column) -> Column:
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*V.PLATFORMS), text).otherwise(F.lit("unknown"))


def platform_from_path(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"platform=([^/]+)", 1), F.lit(""))


def _integral_text(c: Column, numeric: bool) -> Column:
    # Only numbers lose a trailing .0; text identifiers are kept letter by letter.
    text = c.cast("string")
    return F.regexp_replace(text, r"^(-?\d+)\.0+$", "$1") if numeric else text


def line_key(order_line_id: Column, line_id: Column, source_line_id: Column, sku: Column,
             numeric: bool = False) -> Column:
    """Identity of an order line: upstream line id, else a kept key, else the SKU."""
    def prefixed(c: Column, prefix: str) -> Column:
        return F.when(F.trim(c.cast("string")) != "", F.concat(F.lit(prefix), _integral_text(c, numeric)))

    return F.coalesce(
        prefixed(order_line_id, "id:"), prefixed(line_id, "id:"),
        prefixed(source_line_id, ""), prefixed(sku, "sku:"),
    )


def is_cancelled(status: Column) -> Column:
    return F.coalesce(F.upper(F.trim(status)).isin(*V.CANCELLED), F.lit(False))


def message_key(*candidates: Column) -> Column:
    return first_filled(*[c.cast("string") for c in candidates])


def region_of(state: Column, labels: str = "load") -> Column:
    """Region by province; ``load`` and ``seed`` are the two labellings in use."""
    if labels == "load":
        return (
            F.when(state.isin(*V.SOUTH), "Nam").when(state.isin(*V.CENTRAL), "Trung").otherwise("Bắc")
        )
    return (
        F.when(state.isin(*V.SEED_NORTH), "Miền Bắc")
        .when(state.isin(*V.SEED_CENTRAL), "Miền Trung")
        .when(state.isin(*V.SEED_SOUTH), "Miền Nam")
        .otherwise("Khác")
    )


# ---- money ------------------------------------------------------------------------------

def buyer_total(subtotal: Column, *deductions: Column) -> Column:
    """Subtotal less discounts and vouchers, never below zero."""
    left = reduce(lambda a, b: a - F.coalesce(b, F.lit(0)), deductions, subtotal)
    return F.greatest(left, F.lit(0))


def net_revenue(buyer: Column, commission: Column, service: Column) -> Column:
    return buyer - F.coalesce(commission, F.lit(0)) - F.coalesce(service, F.lit(0))


def escrow(buyer: Column, commission: Column, service: Column, transaction: Column, shipping: Column) -> Column:
    """Seller payout: net revenue less the transaction fee plus half the shipping fee, at least zero."""
    value = net_revenue(buyer, commission, service) - F.coalesce(transaction, F.lit(0)) \
        + F.coalesce(shipping, F.lit(0)) * F.lit("0.5").cast("decimal(2,1)")
    return F.greatest(F.round(value, 0), F.lit(0))


# ---- inventory policy -------------------------------------------------------------------

def z_for_service(level: Column) -> Column:
    """Next listed service level upwards; the 95 % value beyond the table."""
    out = F.lit(0.0) + F.lit(1.645)
    for step in sorted(V.SERVICE_Z, reverse=True):
        out = F.when(level <= step, F.lit(V.SERVICE_Z[step])).otherwise(out)
    return out


def z_for_classifier(level: float) -> float:
    """Exact table entry, else the next lower entry, else 1.0."""
    if level in V.CLASSIFIER_Z:
        return V.CLASSIFIER_Z[level]
    lower = [z for step, z in V.CLASSIFIER_Z.items() if step in (0.90, 0.95, 0.99) and step <= level]
    return max(lower, default=1.0)


def z_for_stability(xyz: Column) -> Column:
    return F.when(xyz == "X", V.STABILITY_Z["stable"]).otherwise(V.STABILITY_Z["volatile"])


def _ceil(c: Column) -> Column:
    # Nine places absorb float noise that would otherwise lift an exact integer by one.
    return F.ceil(F.round(c, 9))


def safety_stock(sigma: Column, z: Column | float = 1.645, lead_time: Column | float = 3, floor: bool = True) -> Column:
    z = z if isinstance(z, Column) else F.lit(float(z))
    lead = lead_time if isinstance(lead_time, Column) else F.lit(float(lead_time))
    stock = _ceil(z * sigma * F.sqrt(lead))
    return F.greatest(F.lit(1).cast("long"), stock) if floor else stock


def reorder_point(mean: Column, stock: Column, lead_time: Column | float = 3, floor: bool = True) -> Column:
    lead = lead_time if isinstance(lead_time, Column) else F.lit(float(lead_time))
    point = _ceil(mean * lead + stock)
    return F.greatest(stock + 1, point) if floor else point


def alert_level(stock: Column, safety: Column, point: Column, blank: str | None = None) -> Column:
    level = F.when(stock <= safety, "CRITICAL").when(stock <= point, "WARNING").otherwise("NORMAL")
    return F.when(stock.isNull(), F.lit(blank)).otherwise(level)


def days_to_stockout(stock: Column, mean: Column, style: str = "sql") -> Column:
    """``sql``: null without demand. ``api``: demand is taken as at least 0.1 a day."""
    days = stock / (F.nullif(mean, F.lit(0.0)) if style == "sql" else F.greatest(mean, F.lit(0.1)))
    # The margin keeps an exact half from falling to either side by float noise.
    return F.round(days + 1e-9, 1)


def recommended_quantity(stock: Column, point: Column, mean: Column) -> Column:
    wanted = F.greatest(F.lit(0).cast("long"), point + _ceil(mean * 7) - stock)
    return F.when(stock <= point, wanted).otherwise(F.lit(0).cast("long"))


# ---- segmentation -----------------------------------------------------------------------

def volatility(std: Column, mean: Column) -> Column:
    return F.when(mean > 0, std / mean).otherwise(F.lit(999.0))


def abc_class(previous_share: Column, a: float = 0.80, b: float = 0.95) -> Column:
    return F.when(previous_share < a, "A").when(previous_share < b, "B").otherwise("C")


def xyz_class(cv: Column, x: float = 0.50, y: float = 1.00) -> Column:
    return F.when(cv <= x, "X").when(cv <= y, "Y").otherwise("Z")


def nine_box_text(cell: Column, which: int) -> Column:
    pairs: list[Column] = []
    for name, texts in V.NINE_BOX.items():
        pairs += [F.lit(name), F.lit(texts[which])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), cell), F.lit(V.NINE_BOX_DEFAULT[which]))


def vocab_code(c: Column, vocabulary: tuple[str, ...] | list[str]) -> Column:
    """Position in a fixed vocabulary, -1 for anything else."""
    pairs: list[Column] = []
    for position, word in enumerate(vocabulary):
        pairs += [F.lit(word), F.lit(position)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(-1))


# ---- heuristic demand -------------------------------------------------------------------

def weekday_factor(d: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in V.WEEKDAY_FACTOR]), weekday_monday0(d) + 1)


def sale_factor(d: Column) -> Column:
    return F.when(is_sale_day(d), V.SALE_DAY_FACTOR).otherwise(1.0)


def payday_factor(d: Column) -> Column:
    return F.when(F.dayofmonth(d).between(25, 28), V.PAYDAY_FACTOR).otherwise(1.0)


def heuristic_demand(base: Column, d: Column) -> Column:
    return F.greatest(F.lit(0.0), base * weekday_factor(d) * sale_factor(d) * payday_factor(d))


def interval_bounds(quantity: Column, sigma: Column, widen: Column | float = 1.0) -> tuple[Column, Column]:
    """Plus or minus 1.96 sigma; ``widen`` is the square root of the sale factor on heuristic days."""
    widen = widen if isinstance(widen, Column) else F.lit(float(widen))
    margin = F.lit(1.96) * sigma * widen
    # Exact halves are common here; the margin rounds them up whatever the float noise.
    return F.greatest(F.lit(0.0), F.round(quantity - margin + 1e-9, 1)), F.round(quantity + margin + 1e-9, 1)


def demand_multiplier(d: Column, trend: float = 0.1, sale_lift: float = 1.5, weekend_lift: float = 0.12) -> Column:
    """Expected demand driver of a day: season, trend, campaign shape, payday and weekend."""
    season = F.element_at(F.array(*[F.lit(m) for m in V.MARKET_MONTHS]), F.month(d))
    growth = F.exp(F.lit(trend) * (F.dayofyear(d) - 1) / F.lit(365.0))
    gap = F.dayofmonth(d) - F.month(d)
    campaign = (
        F.when(gap == 0, 1 + sale_lift)
        .when(gap.between(-2, -1), 1 + 0.22 * sale_lift)
        .when(gap.between(1, 2), max(0.55, 1 - 0.12 * sale_lift))
        .otherwise(1.0)
    )
    payday = F.when(F.dayofmonth(d).isin(15, 25, 26, 27, 28), 1.15).otherwise(1.0)
    weekend = F.when(weekday_monday0(d) >= 5, 1 + weekend_lift).otherwise(1.0)
    return season * growth * campaign * payday * weekend


# ---- datasets ---------------------------------------------------------------------------

def dataset_list(c: Column) -> Column:
    """Canonical form of a list of dataset names: distinct and sorted."""
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def dataset_json(c: Column) -> Column:
    return F.to_json(dataset_list(c))


def statistics_from_sums(n: Column, total: Column, squares: Column) -> tuple[Column, Column]:
    """Mean and sample deviation from count, sum and sum of squares; one value has deviation 0."""
    n_ = n.cast("double")
    s = total.cast("double")
    q = squares.cast("double")
    mean = s / n_
    variance = F.greatest(F.lit(0.0), (n_ * q - s * s)) / (n_ * (n_ - 1))
    return mean, F.when(n > 1, F.sqrt(variance)).otherwise(F.lit(0.0))
