"""Scalar rules of the telemetry domain as column expressions; none needs Python at run time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Calendar days and labels are in this zone; buckets are in UTC.
LOCAL_ZONE = "Asia/Kolkata"


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(ratio_or_null(a, b), F.lit(0.0))


def ratio_or_null(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def percent(a: Column, b: Column) -> Column:
    return ratio(a, b) * 100


def rounded(x: Column, digits: int = 1, exact: bool = False) -> Column:
    """Ties to even. A decimal tie that binary can't hold (2.675) may differ from rounding of the exact binary value;
    exact=True gives half-up by one multiplication, the same on every engine with IEEE doubles."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if exact else F.bround(x, digits)


def whole(x: Column) -> Column:
    """Towards zero."""
    return x.cast("bigint")


def clamped(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("double"))


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(a / b)


def named_voice(labels: Column) -> Column:
    """The voice label is there and not empty."""
    return F.coalesce(labels["voice"], F.lit("")) != ""


def labelled_not_blank(labels: Column) -> Column:
    """Some label, and no empty voice label: a labelled sample without a voice counts."""
    return (F.size(labels) > 0) & ~labels["voice"].eqNullSafe(F.lit(""))


def has_label(labels: Column, name: str, value: str | None) -> Column:
    """Exact equality; a missing label equals None."""
    return labels[name].eqNullSafe(F.lit(value))


def selector(labels: Column, **wanted: str) -> Column:
    """All labels equal; no condition selects everything. A missing label equals the empty string."""
    out = F.lit(True)
    for k, v in wanted.items():
        out = out & (F.coalesce(labels[k], F.lit("")) == v)
    return out


def show_ms(x: Column, none: str = "N/A") -> Column:
    """1500 -> 1.50s, 999 -> 999ms, else none."""
    return F.when(x >= 1000, F.concat(F.format_string("%.2f", x / 1000), F.lit("s"))).when(x > 0, F.concat(F.format_string("%.0f", F.bround(x, 0)), F.lit("ms"))).otherwise(F.lit(none))


def show_count(x: Column, none: str = "-") -> Column:
    """2500000 -> 2.50M, 1234 -> 1.2K, 12 -> 12, null -> none."""
    big = F.when(x >= 1e6, F.concat(F.format_string("%.2f", x / 1e6), F.lit("M")))
    return big.when(x >= 1e3, F.concat(F.format_string("%.1f", x / 1e3), F.lit("K"))).when(x.isNotNull(), F.format_string("%.0f", x)).otherwise(F.lit(none))


def thousands(x: Column) -> Column:
    return F.format_number(x, 0)


def hit_band(rate: Column, total: Column) -> Column:
    """Band of a hit rate in percent."""
    return F.when(total == 0, "no data").when(rate >= 70, "good").when(rate >= 30, "moderate").otherwise("low")


#: Where yellow and red begin.
THRESHOLDS = {"utilization": (70, 90), "memory": (70, 90), "temperature": (70, 85)}


def threshold_colour(x: Column, kind: str) -> Column:
    yellow, red = THRESHOLDS[kind]
    return F.when(x >= red, "red").when(x >= yellow, "yellow").otherwise("green")


def up_state(x: Column) -> Column:
    return F.when(x == 1, "UP").otherwise("DOWN")


def up_colour(x: Column) -> Column:
    return F.when(x >= 1, "green").otherwise("red")


def mib_to_bytes(x: Column) -> Column:
    return x * (1024 * 1024)


def used_percent(used: Column, free: Column | None = None, total: Column | None = None) -> Column:
    return percent(used, used + free if total is None else total)


def short_node(node: Column) -> Column:
    """Last two dotted parts of the host."""
    return F.substring_index(host_of(node), ".", -2)


def host_of(node: Column) -> Column:
    return F.substring_index(node, ":", 1)


def file_key(node: Column) -> Column:
    """Node name that can be a file name."""
    return F.translate(node, ":/", "__")


def local_time(ts_ms: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(LOCAL_ZONE), F.timestamp_millis(ts_ms).cast("timestamp_ntz"))


def local_date(ts_ms: Column) -> Column:
    return local_time(ts_ms).cast("date")


def local_label(ts_ms: Column) -> Column:
    return F.date_format(local_time(ts_ms), "dd MMM HH:mm")


def fingerprint(*values: Column) -> Column:
    return F.concat_ws("|", *(v.cast("string") for v in values))


def since_ms(mode: str, now_ms: int, custom_ms: int | None = None) -> int:
    """Lower time bound of a range preset; 0 (no bound) for live."""
    spans = {"5m": 300_000, "15m": 900_000, "1h": 3_600_000}
    if mode == "custom":
        if custom_ms is None or custom_ms < 0:
            raise ValueError("a custom range needs a time that is not negative")
        return custom_ms
    return now_ms - spans[mode] if mode in spans else 0
