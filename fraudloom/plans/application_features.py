"""Payload to feature row: the whole chain as one declarative plan, shared by batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import dates, geo, text
from ..operators import relational

C = F.col

#: coordinate columns the chain cleans
COORDINATES = tuple(sorted({c for p in geo.DISTANCE_PAIRS for c in p[:4]}))
#: default name and address comparisons: application value, vendor value, output
NAME_PAIRS = (("p_first_name", "tcr_contact_firstname", "p_tcr_ft_first_name_match"),
              ("p_last_name", "tcr_contact_lastname", "p_tcr_ft_last_name_match"),
              ("a_address_1", "tcr_contact_address1", "a_tcr_ft_address_match"))
GESTALT_PAIRS = (("p_first_name", "tcr_contact_firstname", "p_tcr_ft_difflib_first_name_match"),
                 ("p_last_name", "tcr_contact_lastname", "p_tcr_ft_difflib_last_name_match"))


def application_features(payloads: DataFrame, zip_offsets: DataFrame, high_risk: DataFrame | None = None,
                         tmx_keys: Sequence[str] = (), final_features: Sequence[str] | None = None) -> DataFrame:
    """Query-string columns, risk flag, name matches, local time, e-mail length, distances, contract projection.

    ``zip_offsets`` (a_zip, tz_offset) and ``high_risk`` (a_zip) are tables; Spark
    broadcasts them when they are small enough. Everything else is one projection,
    so the same plan runs on a stream.
    """
    if "tmx_raw" in payloads.columns and not tmx_keys:
        raise ValueError("name the keys to take from tmx_raw")
    df = text.kv_expand(payloads, "tmx_raw", tmx_keys) if "tmx_raw" in payloads.columns else payloads
    if high_risk is not None:
        df = relational.membership_flag(df, "a_zip", high_risk, "a_ft_high_risk_area")
    have = set(df.columns)
    pairs = [p for p in NAME_PAIRS if {p[0], p[1]} <= have]
    gestalt = [p for p in GESTALT_PAIRS if {p[0], p[1]} <= have]
    df = text.match_scores(df, pairs, "indel", unquote=("a_tcr_ft_address_match",))
    df = text.match_scores(df, gestalt, "gestalt")
    df = relational.lookup_default(df, zip_offsets, "a_zip", "tz_offset", 0)
    df = df.withColumn("ca_ft_created_at_tz_adj", dates.tz_adjust(C("ca_created_at"), C("tz_offset")))
    df = df.drop("ca_created_at", "tz_offset")
    if "ea_email" in df.columns:
        df = df.withColumn("ea_ft_digits", text.email_local_length(C("ea_email")))
    df = geo.geo_distance_features(geo.clean_coordinates(df, COORDINATES))
    if final_features is not None:
        df = relational.add_missing_columns(df, final_features)
    df = relational.lowercase_columns(df)
    return df if final_features is None else relational.pii_projection(df, final_features)
