"""Date and time feature columns. All are plain column arithmetic in UTC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

C = F.col
DAY_US = 86_400_000_000
#: fixed values: weekday labels, Monday first
DAY_NAMES = ("Mon", "Tues", "Weds", "Thurs", "Fri", "Sat", "Sun")


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def days_since(ref: Column, c: Column) -> Column:
    """Whole elapsed days from c to ref, rounded down (not calendar days)."""
    diff = _us(ref) - _us(c)
    return ((diff - F.pmod(diff, F.lit(DAY_US))) / F.lit(DAY_US)).cast("bigint")


def time_of_day_cyclic(c: Column) -> tuple[Column, Column]:
    angle = F.pmod(_us(c), F.lit(DAY_US)) / F.lit(1e6) * (2 * F.pi() / 86400)
    return F.sin(angle), F.cos(angle)


def day_of_week_cyclic(c: Column) -> tuple[Column, Column]:
    angle = F.weekday(c) * (2 * F.pi() / 7)
    return F.sin(angle), F.cos(angle)


def day_of_week_name(c: Column) -> Column:
    return F.when(c.isNotNull(), F.element_at(F.array(*[F.lit(d) for d in DAY_NAMES]), F.weekday(c) + 1))


def is_weekend(c: Column) -> Column:
    return F.when(c.isNotNull(), F.when(F.weekday(c) >= 5, 1).otherwise(0))


def is_holiday(c: Column) -> Column:
    """1 on a US federal holiday as observed: fixed dates move off the weekend, the others are n-th weekdays."""
    d = c.cast("date")
    y, m, day, wd = F.year(d), F.month(d), F.dayofmonth(d), F.weekday(d)

    def fixed(month, dom, since=None):
        def at(shift):
            moved = F.date_add(d, shift)
            ok = (F.month(moved) == month) & (F.dayofmonth(moved) == dom)
            return ok if since is None else ok & (F.year(moved) >= since)
        # on the day itself, the Friday before a Saturday, or the Monday after a Sunday
        return ((wd < 5) & at(0)) | ((wd == 4) & at(1)) | ((wd == 0) & at(-1))

    def nth(month, weekday, first_dom, since=None):
        ok = (m == month) & (wd == weekday) & day.between(first_dom, first_dom + 6)
        return ok if since is None else ok & (y >= since)

    rules = [fixed(1, 1), nth(1, 0, 15, 1986), nth(2, 0, 15), nth(5, 0, 25, 1971), fixed(6, 19, 2021), fixed(7, 4),
             nth(9, 0, 1), nth(10, 0, 8), fixed(11, 11), nth(11, 3, 22), fixed(12, 25)]
    hit = rules[0]
    for r in rules[1:]:
        hit = hit | r
    return F.when(d.isNotNull(), F.when(hit, 1).otherwise(0))


def date_feature_bundle(df: DataFrame, date_cols: Sequence[str], timestamp_cols: Sequence[str],
                        todrop_cols: Sequence[str], creation_col: str) -> DataFrame:
    """All date features of the listed columns that exist, in one projection; listed columns to drop are dropped."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    for c in date_cols:
        if c in have:
            sin, cos = day_of_week_cyclic(C(c))
            new |= {f"{c}_ft_days_since": days_since(C(creation_col), C(c)),
                    f"{c}_ft_dayofweek_sin": sin, f"{c}_ft_dayofweek_cos": cos,
                    f"{c}_ft_dayofweek": day_of_week_name(C(c)), f"{c}_ft_is_weekend": is_weekend(C(c)),
                    f"{c}_ft_is_holiday": is_holiday(C(c))}
    for c in timestamp_cols:
        if c in have:
            sin, cos = time_of_day_cyclic(C(c))
            new |= {f"{c}_ft_timeofday_sin": sin, f"{c}_ft_timeofday_cos": cos}
    return df.withColumns(new).drop(*todrop_cols)


def tz_adjust(ts: Column, offset_hours: Column) -> Column:
    """Timestamp moved by whole hours, as text."""
    moved = F.timestamp_micros(_us(ts) + offset_hours.cast("bigint") * 3_600_000_000)
    return F.date_format(moved, "yyyy-MM-dd HH:mm:ss")


def duration_seconds(c: Column) -> Column:
    """Text such as '1 days 02:03:04.5' to seconds; missing gives 0."""
    def part(regex):
        return F.coalesce(F.nullif(F.regexp_extract(c, regex, 1), F.lit("")).cast("double"), F.lit(0.0))

    days = part(r"(-?\d+)\s*days?")
    clock = part(r"(\d+):\d+:\d+") * 3600 + part(r"\d+:(\d+):\d+") * 60 + part(r"\d+:\d+:(\d+(?:\.\d+)?)")
    return F.when(c.isNull(), F.lit(0.0)).otherwise(days * 86400 + clock)


def account_age_days(created: Column, added: Column) -> Column:
    return F.coalesce(days_since(created, added), F.lit(0)).cast("int")
