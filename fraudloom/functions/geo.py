"""Distances and numeric score helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.relational import coerce_numeric_lenient
from ..operators.skew import join_null_safe
from .text import url_decode

C = F.col
#: fixed values that results must share: mean earth radius (km) and the alignment of the base score
EARTH_KM = 6371.0088
SCORE_SLOPE = 1.22643393399164
SCORE_OFFSET = 0.00197736842965041
#: fixed values: error-function polynomial of Abramowitz & Stegun 7.1.26
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)

#: coordinate sources as (latitude, longitude) columns
_POINTS = {
    "input_ip": ("tmx_raw_input_ip_latitude", "tmx_raw_input_ip_longitude"),
    "true_ip": ("tmx_raw_true_ip_latitude", "tmx_raw_true_ip_longitude"),
    "proxy_ip": ("tmx_raw_proxy_ip_latitude", "tmx_raw_proxy_ip_longitude"),
    "dns_ip": ("tmx_raw_dns_ip_latitude", "tmx_raw_dns_ip_longitude"),
    "address": ("ss_lat", "ss_long"),
    "phone": ("tcr_location_coordinates_latitude", "tcr_location_coordinates_longitude"),
}
#: fixed values that results must share: the twelve output columns and the two sources each one compares
_DISTANCES = {
    "tmx_ft_input_ip_true_ip_distance": ("input_ip", "true_ip"),
    "tmx_ss_ft_input_ip_address_distance": ("address", "input_ip"),
    "tmx_ss_ft_true_ip_address_distance": ("address", "true_ip"),
    "ss_tcr_ft_address_phone_distance": ("address", "phone"),
    "tcr_tmx_ft_phone_true_ip_distance": ("phone", "true_ip"),
    "ss_tmx_ft_address_dns_ip_distance": ("address", "dns_ip"),
    "tmx_ft_proxy_ip_dns_ip_distance": ("proxy_ip", "dns_ip"),
    "tmx_ft_proxy_ip_input_ip_distance": ("proxy_ip", "input_ip"),
    "tcr_tmx_ft_phone_input_ip_distance": ("phone", "input_ip"),
    "ss_tmx_ft_address_proxy_ip_distance": ("address", "proxy_ip"),
    "tcr_tmx_ft_phone_proxy_ip_distance": ("phone", "proxy_ip"),
    "tcr_tmx_ft_phone_dns_ip_distance": ("phone", "dns_ip"),
}
#: outputs whose second point once had latitude and longitude exchanged
SWAPPED = ("tcr_tmx_ft_phone_input_ip_distance", "tcr_tmx_ft_phone_dns_ip_distance")
DISTANCE_PAIRS = tuple((*_POINTS[a], *_POINTS[b], name) for name, (a, b) in _DISTANCES.items())


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, o1, a2, o2 = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return EARTH_KM * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def geo_distance_features(df: DataFrame, pairs: Sequence[tuple] = DISTANCE_PAIRS, compat_swap: bool = False) -> DataFrame:
    """All distances in one projection; a missing source column gives a null column.

    ``compat_swap`` exchanges latitude and longitude of the second point for the outputs in SWAPPED,
    for models fitted on such values.
    """
    have = set(df.columns)
    out = {}
    for lat1, lon1, lat2, lon2, name in pairs:
        if compat_swap and name in SWAPPED:
            lat2, lon2 = lon2, lat2
        if {lat1, lon1, lat2, lon2} <= have:
            out[name] = haversine_km(C(lat1), C(lon1), C(lat2), C(lon2))
        else:
            out[name] = F.lit(None).cast("double")
    return df.withColumns(out)


def clean_coordinates(df: DataFrame, cols: Sequence[str], encoded_marker: str = "tmx_raw") -> DataFrame:
    """Vendor coordinates are decoded and cast strictly, the others unquoted and cast leniently."""
    have = set(df.columns)
    return df.withColumns({
        c: url_decode(C(c)).cast("double") if encoded_marker in c else coerce_numeric_lenient(C(c))
        for c in cols if c in have})


def unscale_score(c: Column) -> Column:
    return (c - SCORE_OFFSET) / SCORE_SLOPE


def time_zone_minutes(c: Column) -> Column:
    """Minutes to hours, 4 digits, ties to even."""
    return F.bround(c / 60, 4)


def erf(x: Column) -> Column:
    z = F.abs(x)
    t = 1.0 / (1.0 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    return F.signum(x) * (1.0 - poly * F.exp(-z * z))


def erf_probability(df: DataFrame, score: str, out: str = "proba", groups: Sequence[str] = ()) -> DataFrame:
    """z-score over root 2 through erf, clipped to [0, 1], and its complement."""
    stats = df.groupBy(*groups).agg(F.avg(score).alias("_mu"), F.stddev_pop(score).alias("_sd"))
    if groups:
        both = join_null_safe(df, stats, list(groups))
        mu, sd = C("_mu"), C("_sd")
    else:
        both = df
        one = stats.agg(F.first(F.struct("_mu", "_sd"))).scalar()
        mu, sd = one["_mu"], one["_sd"]
    z = F.try_divide(C(score) - mu, sd * F.sqrt(F.lit(2.0)))
    proba = F.greatest(F.lit(0.0), F.least(F.lit(1.0), erf(F.coalesce(z, F.lit(0.0)))))
    return both.withColumn(out, proba).withColumn(f"{out}_complement", 1 - C(out)).drop("_mu", "_sd")
