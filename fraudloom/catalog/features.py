"""Queries of text, date, geo and missing-value features, encoders and scalers."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..anomaly.knn import impute_knn
from ..functions import dates, email_tokens, geo, missing, text
from ..ml import stages, train
from ..operators import encode, relational as rel
from ..plans.application_features import application_features
from ..session import settle
from .base import APPS, C, applications, md5_bucket, q6, q_stamp, query, r6, rounded, stamp, tbl
from .tables import SPARSE_SQL, ZIP_SQL, sparse_rows, zip_offsets

# ---------------------------------------------------------------- text


@query("url_decode_columns", """SELECT page_id, url_decode(replace(url, '?', '%3F%20+50% off')) AS url,
  'x' || CAST(page_id AS VARCHAR) AS other FROM pages""")
def url_decode_columns(spark, sf):
    raw = tbl(spark, sf, "pages").select(
        "page_id", F.replace(C("url"), F.lit("?"), F.lit("%3F%20+50% off")).alias("url"),
        F.concat(F.lit("x"), C("page_id").cast("string")).alias("other"))
    return text.url_decode_columns(raw, ["url", "other", "absent"])


@query("dirty_json_expand", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS j_k FROM events""")
def dirty_json_expand(spark, sf):
    dirty = tbl(spark, sf, "events").select("event_id", F.translate("props", '"', "'").alias("props"))
    return text.dirty_json_expand(dirty, "props", ["k"], prefix="j_").drop("props")


_QS = """qs AS (SELECT page_id, CASE WHEN contains(url, '?') THEN
  regexp_replace(regexp_extract(url, '[?](.*)$', 1), '#.*$', '') || '&page=' || CAST(page_id AS VARCHAR) || '=9&flag' END AS q FROM pages),
  seg AS (SELECT page_id, i, string_split(q, '&')[i] AS s FROM qs, range(1, 20) r(i) WHERE q IS NOT NULL AND i <= len(string_split(q, '&'))),
  kv AS (SELECT page_id, i, string_split(s, '=')[1] AS k, string_split(s, '=')[2] AS v FROM seg WHERE contains(s, '='))"""


@query("kv_expand", f"""WITH {_QS} SELECT page_id, (SELECT string_agg(v, ', ' ORDER BY i) FROM kv WHERE kv.page_id = qs.page_id AND k = 'page') AS tmx_raw_page,
  (SELECT string_agg(v, ', ' ORDER BY i) FROM kv WHERE kv.page_id = qs.page_id AND k = 'ref') AS tmx_raw_ref,
  CAST(NULL AS VARCHAR) AS tmx_raw_flag FROM qs""")
def kv_expand(spark, sf):
    url = C("url")
    q = F.when(url.contains("?"), F.concat(
        F.regexp_replace(F.regexp_extract(url, "[?](.*)$", 1), "#.*$", ""),
        F.lit("&page="), C("page_id").cast("string"), F.lit("=9&flag")))
    raw = tbl(spark, sf, "pages").select("page_id", q.alias("tmx_raw"))
    return text.kv_expand(raw, "tmx_raw", ["page", "ref", "flag"])


@query("fold_levels_exact", """SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'ECONOMY') THEN 'LOW'
  WHEN p_type IN ('LARGE', 'PROMO') THEN 'HIGH' ELSE p_type END AS p_type FROM part""")
def fold_levels_exact(spark, sf):
    p = tbl(spark, sf, "part").select("p_partkey", F.concat(C("p_type"), F.lit(" ")).alias("p_type"))
    folded = text.fold_levels_exact(C("p_type"), {"LOW": ["SMALL", "ECONOMY"], "HIGH": ["LARGE", "PROMO"]})
    return p.withColumn("p_type", F.trim(folded))


@query("fold_levels_regex", """SELECT doc_id, CASE WHEN regexp_matches(source, '^src1') THEN 'one'
  WHEN regexp_matches(source, '[35]$') THEN 'odd' ELSE source END AS source FROM documents""")
def fold_levels_regex(spark, sf):
    d = tbl(spark, sf, "documents").select("doc_id", "source")
    return text.fold_levels_regex(d, [("source", "^src1", "one"), ("source", "[35]$", "odd"), ("absent", "x", "y")])


@query("fold_source", """SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'google' WHEN source = 'src2' THEN 'organic'
  ELSE 'OTHER' END AS fsl_source FROM documents""")
def fold_source(spark, sf):
    raw = (F.when(C("source").startswith("src1"), F.concat(F.lit("google_"), C("source")))
           .when(C("source") == "src2", "organic").when(C("source") != "src3", C("source")))
    return tbl(spark, sf, "documents").select("doc_id", text.fold_source(raw).alias("fsl_source"))


def _names(spark, sf):
    """Each supplier next to the applicants of its region and nation: one pairing per applicant."""
    c, s = tbl(spark, sf, "customer"), tbl(spark, sf, "supplier")
    pick = s.groupBy("s_nationkey").agg(F.min("s_name").alias("tcr_contact_lastname"))
    return c.join(pick, c.c_nationkey == pick.s_nationkey, "left").select(
        "c_custkey", C("c_name").alias("p_last_name"),
        F.when(C("c_custkey") % 11 == 0, F.lit("")).otherwise(C("tcr_contact_lastname")).alias("tcr_contact_lastname"))


def _lcs_sql(source):
    """Recursive table of LCS rows: the next row is the running maximum of stay and match moves."""
    return f"""dp(a, b, i, r) AS (SELECT a, b, 0, list_transform(range(0, CAST(length(b) AS BIGINT) + 1), lambda x: CAST(0 AS BIGINT)) FROM {source}
    UNION ALL SELECT a, b, i + 1, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, CAST(length(b) AS BIGINT) + 1), lambda j: list_max(list_transform(
      range(1, j + 1), lambda t: greatest(r[t + 1], CASE WHEN substr(a, i + 1, 1) = substr(b, t, 1) THEN r[t] + 1 ELSE 0 END)))))
    FROM dp WHERE i < length(a)),
  lcs AS (SELECT a, b, 2.0e0 * r[length(b) + 1] / (length(a) + length(b)) AS ratio FROM dp WHERE i = length(a))"""


@query("match_scores_indel", f"""WITH RECURSIVE pick AS (SELECT s_nationkey, MIN(s_name) AS s FROM supplier GROUP BY 1),
  nm AS (SELECT c_custkey, c_name AS p_last_name, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE s END AS tcr_contact_lastname
    FROM customer LEFT JOIN pick ON c_nationkey = s_nationkey),
  prs AS (SELECT DISTINCT lower(p_last_name) AS a, lower(tcr_contact_lastname) AS b FROM nm WHERE length(tcr_contact_lastname) > 0),
  {_lcs_sql('prs')} SELECT c_custkey, p_last_name, tcr_contact_lastname, {q6('COALESCE(ratio, -1)')} AS score FROM nm
  LEFT JOIN lcs ON a = lower(p_last_name) AND b = lower(tcr_contact_lastname)""")
def match_scores_indel(spark, sf):
    return rounded(text.match_scores(_names(spark, sf), [("p_last_name", "tcr_contact_lastname", "score")]), "score")


@query("match_scores_gestalt")
def match_scores_gestalt(spark, sf):
    return rounded(text.match_scores(_names(spark, sf), [("p_last_name", "tcr_contact_lastname", "score")], "gestalt"), "score")


@query("candidate_match_join", f"""WITH RECURSIVE nms AS (SELECT DISTINCT p_brand, lower(p_name) AS v FROM part),
  prs AS (SELECT DISTINCT x.v AS a, y.v AS b FROM nms x JOIN nms y ON x.p_brand = y.p_brand AND x.v < y.v), {_lcs_sql('prs')}
  SELECT x.p_brand, x.v AS left_name, y.v AS right_name, {q6('ratio')} AS score FROM nms x JOIN nms y ON x.p_brand = y.p_brand
  JOIN lcs ON a = x.v AND b = y.v WHERE ratio >= 0.75""")
def candidate_match_join(spark, sf):
    p = tbl(spark, sf, "part")
    out = text.candidate_match_join(p.select("p_brand", C("p_name").alias("left_name")),
                                    p.select("p_brand", C("p_name").alias("right_name")),
                                    "p_brand", "left_name", "right_name", 0.75)
    return rounded(out.where(C("left_name") < C("right_name")), "score")


@query("email_local_length", """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE CAST(length(c_name) AS INTEGER) END AS ea_ft_digits FROM customer""")
def email_local_length(spark, sf):
    mail = F.when(C("c_custkey") % 9 != 0, F.concat("c_name", F.lit("@"), F.lower("c_mktsegment"), F.lit(".com")))
    return tbl(spark, sf, "customer").select("c_custkey", text.email_local_length(mail).alias("ea_ft_digits"))


@query("strip_quotes", """SELECT event_id, replace(replace(props, '"', ''), '''', '') AS props, event_type FROM events""")
def strip_quotes(spark, sf):
    return text.strip_quotes(tbl(spark, sf, "events").select("event_id", "props", "event_type"))


_EMAILS = """emails AS (SELECT c_name || '-u' || (c_custkey % 211) || '_' || lower(substr(c_mktsegment, 1, 2)) || '-' || lower(c_mktsegment)
    || '@n' || c_nationkey || '.com' AS email FROM customer)"""
_TOKENS = _EMAILS + """, lists AS (SELECT list_filter(regexp_split_to_array(lower(email), '[^\\w.#]+'), lambda t: t <> '') AS t FROM emails),
  near AS (SELECT t[i] AS token, t[j] AS neighbour, COUNT(*) AS n FROM lists, range(1, 20) a(i), range(1, 20) b(j)
    WHERE i <= len(t) AND j <= len(t) AND abs(i - j) = 1 GROUP BY 1, 2),
  summed AS (SELECT token, CAST(pos AS INTEGER) AS pos, CAST(SUM(CASE WHEN substr(md5(neighbour), pos, 1) < '8' THEN -n ELSE n END) AS DOUBLE) AS v
    FROM near, range(1, 17) r(pos) GROUP BY 1, 2),
  vecs AS (SELECT token, list(v ORDER BY pos) AS v FROM summed GROUP BY 1),
  units AS (SELECT token, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS vec FROM vecs
    WHERE list_sum(list_transform(v, lambda y: y * y)) > 0),
  heads AS (SELECT MIN(token) AS token, vec FROM units GROUP BY vec)"""


def _token_vectors(spark, sf):
    c = tbl(spark, sf, "customer")
    email = F.concat("c_name", F.lit("-u"), (C("c_custkey") % 211).cast("string"), F.lit("_"), F.lower(F.substring("c_mktsegment", 1, 2)), F.lit("-"),
                     F.lower("c_mktsegment"), F.lit("@n"), C("c_nationkey").cast("string"), F.lit(".com"))
    return settle(email_tokens.token_vectors(c.select(email.alias("email")), "email"), "token-vectors")


@query("email_token_similarity", f"""WITH {_TOKENS}
  SELECT a.token AS a, b.token AS b, {q6('list_dot_product(a.vec, b.vec)')} AS similarity FROM heads a JOIN heads b ON a.token < b.token
    AND list_dot_product(a.vec, b.vec) >= 0.95 UNION ALL
  SELECT heads.token, units.token, 1.0 FROM heads JOIN units ON heads.vec = units.vec AND heads.token < units.token""")
def email_token_similarity(spark, sf):
    """Similar pairs between class heads, and each further member of a class with its head."""
    classes = settle(email_tokens.token_classes(_token_vectors(spark, sf)), "token-classes")
    heads = classes.where(C("token") == C("head")).select("token", "vec")
    members = classes.where(C("token") != C("head")).select(C("head").alias("a"), C("token").alias("b"), F.lit(1.0).alias("similarity"))
    return rounded(email_tokens.similar_tokens(heads, 0.95), "similarity").unionByName(members)


@query("email_most_similar", f"""WITH {_TOKENS} SELECT token, {q6('s')} AS similarity FROM (
  SELECT u.token, list_dot_product(u.vec, q.vec) AS s FROM units u, (FROM units WHERE token = 'building') q WHERE u.token <> 'building')
  ORDER BY round(s, 9) DESC, token LIMIT 4""")
def email_most_similar(spark, sf):
    """The four tokens nearest to one token."""
    return rounded(email_tokens.most_similar(_token_vectors(spark, sf), "building", 4), "similarity")


# ---------------------------------------------------------------- dates


def _dates(spark, sf):
    e = tbl(spark, sf, "events")
    return e.select("event_id", "ts", F.when(C("event_id") % 10 != 0, C("ts")).alias("d"))


_DATES = "d AS (SELECT event_id, ts, CASE WHEN event_id % 10 <> 0 THEN ts END AS d FROM events)"
_REF = "TIMESTAMP '2024-02-01 12:00:00'"


@query("days_since", f"""WITH {_DATES} SELECT event_id, CAST(floor((epoch_us({_REF}) - epoch_us(d)) / 86400000000) AS BIGINT) AS days FROM d""")
def days_since(spark, sf):
    ref = F.lit("2024-02-01 12:00:00").cast("timestamp_ntz")
    return _dates(spark, sf).select("event_id", dates.days_since(ref, C("d")).alias("days"))


_SEC = "(epoch_us(d) % 86400000000) / 1e6"


@query("time_of_day_cyclic", f"""WITH {_DATES} SELECT event_id, {q6(f'sin(2 * pi() * {_SEC} / 86400)')} AS s, {q6(f'cos(2 * pi() * {_SEC} / 86400)')} AS c FROM d""")
def time_of_day_cyclic(spark, sf):
    s, c = dates.time_of_day_cyclic(C("d"))
    return _dates(spark, sf).select("event_id", r6(s).alias("s"), r6(c).alias("c"))


@query("day_of_week_cyclic", f"""WITH {_DATES} SELECT event_id, {q6('sin(2 * pi() * (isodow(d) - 1) / 7)')} AS s, {q6('cos(2 * pi() * (isodow(d) - 1) / 7)')} AS c FROM d""")
def day_of_week_cyclic(spark, sf):
    s, c = dates.day_of_week_cyclic(C("d"))
    return _dates(spark, sf).select("event_id", r6(s).alias("s"), r6(c).alias("c"))


@query("day_of_week_name", f"""WITH {_DATES} SELECT event_id, CASE isodow(d) WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tues' WHEN 3 THEN 'Weds'
  WHEN 4 THEN 'Thurs' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' WHEN 7 THEN 'Sun' END AS dow FROM d""")
def day_of_week_name(spark, sf):
    return _dates(spark, sf).select("event_id", dates.day_of_week_name(C("d")).alias("dow"))


@query("is_weekend", f"WITH {_DATES} SELECT event_id, CASE WHEN d IS NULL THEN NULL WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS weekend FROM d")
def is_weekend(spark, sf):
    return _dates(spark, sf).select("event_id", dates.is_weekend(C("d")).alias("weekend"))


#: the twin lists observed dates per year instead of testing each row
HOLIDAY_SQL = """yrs AS (SELECT y FROM range(1970, 2031) t(y)),
  fixed AS (SELECT make_date(y, m, d) AS h FROM yrs, (VALUES (1, 1, 0), (6, 19, 2021), (7, 4, 0), (11, 11, 0), (12, 25, 0)) v(m, d, since) WHERE y >= since),
  moved AS (SELECT CASE isodow(h) WHEN 6 THEN h - 1 WHEN 7 THEN h + 1 ELSE h END AS h FROM fixed),
  nth AS (SELECT make_date(y, m, 1) + CAST((wd - isodow(make_date(y, m, 1)) + 7) % 7 + 7 * (k - 1) AS INTEGER) AS h
    FROM yrs, (VALUES (1, 1, 3, 1986), (2, 1, 3, 0), (9, 1, 1, 0), (10, 1, 2, 0), (11, 4, 4, 0)) v(m, wd, k, since) WHERE y >= since),
  memorial AS (SELECT make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) - 1) AS INTEGER) AS h FROM yrs WHERE y >= 1971),
  holidays AS (SELECT CAST(h AS DATE) AS h FROM moved UNION SELECT CAST(h AS DATE) FROM nth UNION SELECT CAST(h AS DATE) FROM memorial)"""


@query("is_holiday", f"""WITH {HOLIDAY_SQL} SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) IN (SELECT h FROM holidays) THEN 1 ELSE 0 END AS holiday FROM orders""")
def is_holiday(spark, sf):
    return tbl(spark, sf, "orders").select("o_orderkey", dates.is_holiday(C("o_orderdate")).alias("holiday"))


@query("date_feature_bundle", f"""WITH {HOLIDAY_SQL} SELECT event_id,
  CAST(floor((epoch_us({_REF}) - epoch_us(ts)) / 86400000000) AS BIGINT) AS ts_ft_days_since,
  {q6('sin(2 * pi() * (isodow(ts) - 1) / 7)')} AS ts_ft_dayofweek_sin, {q6('cos(2 * pi() * (isodow(ts) - 1) / 7)')} AS ts_ft_dayofweek_cos,
  CASE isodow(ts) WHEN 1 THEN 'Mon' WHEN 2 THEN 'Tues' WHEN 3 THEN 'Weds' WHEN 4 THEN 'Thurs' WHEN 5 THEN 'Fri' WHEN 6 THEN 'Sat' ELSE 'Sun' END AS ts_ft_dayofweek,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS ts_ft_is_weekend,
  CASE WHEN CAST(ts AS DATE) IN (SELECT h FROM holidays) THEN 1 ELSE 0 END AS ts_ft_is_holiday,
  {q6('sin(2 * pi() * ((epoch_us(ts) % 86400000000) / 1e6) / 86400)')} AS ts_ft_timeofday_sin,
  {q6('cos(2 * pi() * ((epoch_us(ts) % 86400000000) / 1e6) / 86400)')} AS ts_ft_timeofday_cos FROM events""")
def date_feature_bundle(spark, sf):
    e = tbl(spark, sf, "events").select("event_id", "ts").withColumn("created", F.lit("2024-02-01 12:00:00").cast("timestamp_ntz"))
    out = dates.date_feature_bundle(e, ["ts", "absent"], ["ts"], ["ts", "created"], "created")
    return rounded(out, "ts_ft_dayofweek_sin", "ts_ft_dayofweek_cos", "ts_ft_timeofday_sin", "ts_ft_timeofday_cos")


@query("tz_adjust", f"""WITH {APPS}, {ZIP_SQL} SELECT ca_id, {q_stamp('ca_created_at + to_hours(CAST(COALESCE(tz_offset, 0) AS INTEGER))')} AS ca_ft_created_at_tz_adj
  FROM apps LEFT JOIN zips ON c_nationkey = a_zip""")
def tz_adjust(spark, sf):
    df = applications(spark, sf).select("ca_id", "ca_created_at", C("c_nationkey").alias("a_zip"))
    df = rel.lookup_default(df, zip_offsets(spark, sf), "a_zip", "tz_offset", 0)
    return df.select("ca_id", dates.tz_adjust(C("ca_created_at"), C("tz_offset")).alias("ca_ft_created_at_tz_adj"))


@query("duration_seconds", """SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0.0e0 ELSE
  (o_orderkey % 3) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + (o_orderkey % 59) + 0.5e0 END AS seconds FROM orders""")
def duration_seconds(spark, sf):
    k = C("o_orderkey")
    word = F.when(k % 9 != 0, F.format_string("%d days %02d:%02d:%02d.5", k % 3, k % 24, k % 60, k % 59))
    return tbl(spark, sf, "orders").select("o_orderkey", dates.duration_seconds(word).alias("seconds"))


@query("account_age_days", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(COALESCE(floor((epoch_us(o_orderdate) -
  epoch_us(CASE WHEN l_partkey % 10 <> 0 THEN l_shipdate END)) / 86400000000), 0) AS INTEGER) AS age FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def account_age_days(spark, sf):
    li, o = tbl(spark, sf, "lineitem"), tbl(spark, sf, "orders")
    added = F.when(C("l_partkey") % 10 != 0, C("l_shipdate"))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", dates.account_age_days(C("o_orderdate"), added).alias("age"))


# ---------------------------------------------------------------- geo and numbers


def _coord(key, m, n, off):
    return F.when(key % 11 != 0, (key * m % n - off).cast("double"))


def _q_coord(key, m, n, off):
    return f"CASE WHEN {key} % 11 <> 0 THEN CAST({key} * {m} % {n} - {off} AS DOUBLE) END"


_HAV = ("6371.0088e0 * 2 * atan2(sqrt(pow(sin((radians({2}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({2})) * "
        "pow(sin((radians({3}) - radians({1})) / 2), 2)), sqrt(1 - (pow(sin((radians({2}) - radians({0})) / 2), 2) + "
        "cos(radians({0})) * cos(radians({2})) * pow(sin((radians({3}) - radians({1})) / 2), 2))))")
_PTS = {"ss": ("ss_lat", "ss_long"), "tr": ("tmx_raw_true_ip_latitude", "tmx_raw_true_ip_longitude"),
        "ip": ("tmx_raw_input_ip_latitude", "tmx_raw_input_ip_longitude")}


def _geo_rows(spark, sf):
    k, s = C("ca_id"), C("customer_id")
    return applications(spark, sf).select(
        "ca_id", _coord(k, 37, 181, 90).alias("ss_lat"), _coord(k, 53, 361, 180).alias("ss_long"),
        _coord(s, 37, 181, 90).alias("tmx_raw_true_ip_latitude"), _coord(s, 53, 361, 180).alias("tmx_raw_true_ip_longitude"),
        _coord(k + s, 37, 181, 90).alias("tmx_raw_input_ip_latitude"), _coord(k + s, 53, 361, 180).alias("tmx_raw_input_ip_longitude"))


_GEO = f"""geo AS (SELECT ca_id, {_q_coord('ca_id', 37, 181, 90)} AS ss_lat, {_q_coord('ca_id', 53, 361, 180)} AS ss_long,
  {_q_coord('customer_id', 37, 181, 90)} AS tmx_raw_true_ip_latitude, {_q_coord('customer_id', 53, 361, 180)} AS tmx_raw_true_ip_longitude,
  {_q_coord('(ca_id + customer_id)', 37, 181, 90)} AS tmx_raw_input_ip_latitude,
  {_q_coord('(ca_id + customer_id)', 53, 361, 180)} AS tmx_raw_input_ip_longitude FROM apps)"""
_GEO_OUT = {"tmx_ft_input_ip_true_ip_distance": ("ip", "tr"), "tmx_ss_ft_input_ip_address_distance": ("ip", "ss"),
            "tmx_ss_ft_true_ip_address_distance": ("tr", "ss")}


@query("geo_distance_features", f"WITH {APPS}, {_GEO} SELECT ca_id, CAST(NULL AS DOUBLE) AS tcr_tmx_ft_phone_dns_ip_distance, " + ", ".join(
    f"{q6(_HAV.format(*_PTS[a], *_PTS[b]), 4)} AS {name}" for name, (a, b) in _GEO_OUT.items()) + " FROM geo")
def geo_distance_features(spark, sf):
    out = geo.geo_distance_features(_geo_rows(spark, sf))
    return out.select("ca_id", "tcr_tmx_ft_phone_dns_ip_distance", *[r6(c, 4).alias(c) for c in _GEO_OUT])


@query("clean_coordinates", """SELECT o_orderkey, o_orderkey % 90 + 0.5e0 AS tmx_raw_dns_ip_latitude,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 90 + 0.25e0 END AS ss_lat FROM orders""")
def clean_coordinates(spark, sf):
    k = (C("o_orderkey") % 90).cast("string")
    raw = tbl(spark, sf, "orders").select(
        "o_orderkey", F.concat(k, F.lit("%2E5")).alias("tmx_raw_dns_ip_latitude"),
        F.when(C("o_orderkey") % 4 == 0, "'none'").otherwise(F.concat(F.lit("'"), k, F.lit(".25'"))).alias("ss_lat"))
    return geo.clean_coordinates(raw, ["tmx_raw_dns_ip_latitude", "ss_lat", "absent"])


@query("unscale_score", f"SELECT o_orderkey, {q6('(o_totalprice - 0.00197736842965041e0) / 1.22643393399164e0', 4)} AS unscaled FROM orders")
def unscale_score(spark, sf):
    return tbl(spark, sf, "orders").select("o_orderkey", r6(geo.unscale_score(C("o_totalprice")), 4).alias("unscaled"))


@query("time_zone_minutes", "SELECT o_orderkey, round_even((o_orderkey % 1441 - 720) / 60.0e0, 4) + 0.0 AS hours FROM orders")
def time_zone_minutes(spark, sf):
    return tbl(spark, sf, "orders").select(
        "o_orderkey", (geo.time_zone_minutes((C("o_orderkey") % 1441 - 720).cast("double")) + F.lit(0.0)).alias("hours"))


_T = "(1.0e0 / (1.0e0 + 0.3275911e0 * abs(z)))"
ERF_SQL = (f"sign(z) * (1.0e0 - (((((1.061405429e0 * {_T} - 1.453152027e0) * {_T}) + 1.421413741e0) * {_T} - 0.284496736e0) * {_T} "
           f"+ 0.254829592e0) * {_T} * exp(-z * z))")


@query("erf_probability", f"""WITH z AS (SELECT event_id, (value - AVG(value) OVER ()) / (stddev_pop(value) OVER () * sqrt(2.0e0)) AS z FROM events)
  SELECT event_id, {q6(f'greatest(0.0e0, least(1.0e0, {ERF_SQL}))')} AS proba, {q6(f'1 - greatest(0.0e0, least(1.0e0, {ERF_SQL}))')} AS proba_complement FROM z""")
def erf_probability(spark, sf):
    out = geo.erf_probability(tbl(spark, sf, "events").select("event_id", "value"), "value")
    return rounded(out.drop("value"), "proba", "proba_complement")


# ---------------------------------------------------------------- missing values and flags


def _coded(spark, sf):
    k = C("o_orderkey")
    return tbl(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 5 == 0, -1.0).when(k % 5 == 1, -2.0).when(k % 5 == 2, None).otherwise(C("o_totalprice")).alias("ida"),
        F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high"), F.lit("odd")), (k % 4).cast("int") + 1).alias("a"),
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "low").alias("b"),
        (k % 1441 - 720).cast("double").alias("tmx_raw_time_zone"), C("o_orderstatus").alias("s1"),
        F.when(k % 7 != 0, F.lit("F")).alias("s2"))


_CODED = """coded AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN -1.0e0 WHEN 1 THEN -2.0e0 WHEN 2 THEN NULL ELSE o_totalprice END AS ida,
  CASE o_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' ELSE 'odd' END AS a,
  CASE o_orderkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' END AS b, CAST(o_orderkey % 1441 - 720 AS DOUBLE) AS tz,
  o_orderstatus AS s1, CASE WHEN o_orderkey % 7 <> 0 THEN 'F' END AS s2 FROM orders)"""
_STATUS = "CASE WHEN ida = -1 THEN 'Partial Match' WHEN ida = -2 THEN 'No Match' WHEN ida IS NULL THEN 'Missing' ELSE 'Other' END"
_IDA = "CASE WHEN ida IN (-1, -2) THEN NULL ELSE ida END"
_RANK = "CASE {0} WHEN 'low' THEN 1 WHEN 'mid' THEN 2 WHEN 'high' THEN 3 END"
_MERGED = f"CASE greatest({_RANK.format('a')}, {_RANK.format('b')}) WHEN 1 THEN 'low' WHEN 2 THEN 'mid' WHEN 3 THEN 'high' END"
_FLAG = "CASE WHEN s1 = s2 THEN 1 ELSE 0 END"
_RANKS = {"low": 1, "mid": 2, "high": 3}


@query("match_status", f"WITH {_CODED} SELECT o_orderkey, {_STATUS} AS status, {_IDA} AS ida FROM coded")
def match_status(spark, sf):
    return _coded(spark, sf).select("o_orderkey", missing.match_status(C("ida")).alias("status"), missing.clear_codes(C("ida")).alias("ida"))


@query("consolidate_levels", f"WITH {_CODED} SELECT o_orderkey, {_MERGED} AS merged FROM coded")
def consolidate_levels(spark, sf):
    return _coded(spark, sf).select("o_orderkey", missing.consolidate_levels(C("a"), C("b"), _RANKS).alias("merged"))


@query("match_flags", f"WITH {_CODED} SELECT o_orderkey, {_FLAG} AS same FROM coded")
def match_flags(spark, sf):
    return _coded(spark, sf).select("o_orderkey", missing.match_flag(C("s1"), C("s2")).alias("same"))


@query("feature_consolidator", f"""WITH {_CODED} SELECT o_orderkey, {_IDA} AS ida, {_STATUS} AS ida_ft_matchstatus, {_MERGED} AS merged,
  round_even(tz / 60, 4) + 0.0 AS tmx_raw_time_zone, {_FLAG} AS same FROM coded""")
def feature_consolidator(spark, sf):
    stage = stages.FeatureConsolidator(
        ida_vars=["ida", "absent"], consolidation_vars=[["merged", "a", "b"], ["gone", "x", "y"]],
        consolidation_mapping=_RANKS, match_vars=[["same", "s1", "s2"], ["never", "s1", "z"]])
    out = stage.transform(_coded(spark, sf)).drop("s1", "s2")
    return out.withColumn("tmx_raw_time_zone", C("tmx_raw_time_zone") + F.lit(0.0))


@query("missing_indicators", f"""WITH {SPARSE_SQL} SELECT o_orderkey, CAST(priority IS NULL AS DOUBLE) AS priority_ft_missing_ind,
  CAST(amount IS NULL AS DOUBLE) AS amount_ft_missing_ind FROM sparse""")
def missing_indicators(spark, sf):
    out = stages.MissingIndicators(missingind_vars=["priority", "amount", "absent"]).transform(sparse_rows(spark, sf))
    return out.select("o_orderkey", "priority_ft_missing_ind", "amount_ft_missing_ind")


@query("drop_sparse_constant", f"WITH {SPARSE_SQL} SELECT o_orderkey, priority, amount FROM sparse")
def drop_sparse_constant(spark, sf):
    df = sparse_rows(spark, sf)
    return stages.MissingHandler(missing_threshold=0.5).fit(df).transform(df)


@query("impute_dates", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN {q_stamp('o_orderdate')}
  ELSE {q_stamp("o_orderdate - INTERVAL 5 DAY")} END AS seen, CASE WHEN o_orderkey % 4 = 0 THEN {q_stamp('o_orderdate')}
  ELSE {q_stamp("o_orderdate - INTERVAL 5 DAY")} END AS seen2 FROM orders""")
def impute_dates(spark, sf):
    k = C("o_orderkey")
    early = F.when(k % 4 != 0, F.expr("o_orderdate - INTERVAL 5 DAYS"))
    df = tbl(spark, sf, "orders").select("o_orderkey", "o_orderdate", early.alias("seen"), early.alias("seen2"),
                                         F.when(k % 6 != 0, F.lit("ok")).alias("result"))
    out = missing.impute_dates(df, ["seen", "seen2", "absent"], {"seen": "result"}, "o_orderdate")
    return out.select("o_orderkey", stamp("seen").alias("seen"), stamp("seen2").alias("seen2"))


@query("impute_numeric", f"""WITH {SPARSE_SQL} SELECT o_orderkey, {q6('COALESCE(amount, (SELECT AVG(amount) FROM sparse))', 3)} AS amount,
  COALESCE(amount, 99999999) AS constant_amount FROM sparse""")
def impute_numeric(spark, sf):
    df = sparse_rows(spark, sf).select("o_orderkey", "amount", C("amount").alias("constant_amount"))
    df = missing.impute_constant(df, ["constant_amount"])
    model = stages.NumericScaler(columns=["amount"], fill="mean", method="none").fit(df)
    return rounded(model.transform(df), "amount", digits=3)


_DIMS = 64


@query("impute_knn", "WITH e AS (SELECT vec_id, CASE WHEN vec_id % 10 <> 0 THEN CAST(vec_id % 97 AS DOUBLE) END AS t, "
       + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(_DIMS)) + " FROM embeddings), z AS (SELECT vec_id, t, ["
       + ", ".join(f"(f{i} - AVG(f{i}) OVER ()) / stddev_pop(f{i}) OVER ()" for i in range(_DIMS)) + """] AS v FROM e),
  nn AS (SELECT q.vec_id, d.t, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, d.v), d.vec_id) AS r
    FROM z q JOIN z d ON q.t IS NULL AND d.t IS NOT NULL)
  SELECT z.vec_id, """ + q6("COALESCE(z.t, m)") + """ AS t FROM z LEFT JOIN (SELECT vec_id, AVG(t) AS m FROM nn WHERE r <= 5 GROUP BY 1) f ON z.vec_id = f.vec_id""")
def impute_knn_query(spark, sf):
    names = [f"f{i}" for i in range(_DIMS)]
    e = tbl(spark, sf, "embeddings").select(
        "vec_id", F.when(C("vec_id") % 10 != 0, (C("vec_id") % 97).cast("double")).alias("t"),
        *[C("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    return rounded(impute_knn(e, "vec_id", "t", names, 5).select("vec_id", "t"), "t")


@query("impute_categorical", f"WITH {SPARSE_SQL} SELECT o_orderkey, COALESCE(priority, 'Missing') AS priority FROM sparse")
def impute_categorical(spark, sf):
    return missing.impute_categorical(sparse_rows(spark, sf).select("o_orderkey", "priority"), ["priority"])


@query("standardize_present", """WITH d AS (SELECT event_id, event_type, CASE WHEN event_id % 8 <> 0 THEN value END AS value FROM events)
  SELECT event_id, event_type, """ + q6("COALESCE((value - AVG(value) OVER w) / stddev_pop(value) OVER w, -1)") + """ AS value
  FROM d WINDOW w AS (PARTITION BY event_type)""")
def standardize_present(spark, sf):
    d = tbl(spark, sf, "events").select("event_id", "event_type", F.when(C("event_id") % 8 != 0, C("value")).alias("value"))
    return rounded(missing.standardize_present(d, ["value"], "event_type"), "value").select("event_id", "event_type", "value")


# ---------------------------------------------------------------- encoders and scalers


def _cats(spark, sf):
    a = applications(spark, sf)
    return a.select("ca_id", "ca_created_at", "dep_var", F.concat_ws("_", "partner", "c_nationkey").alias("level"),
                    F.when(C("ca_id") % 10 != 0, C("product_type")).alias("product_type"), "partner")


_CATS = APPS + """, cats AS (SELECT ca_id, ca_created_at, dep_var, partner || '_' || CAST(c_nationkey AS VARCHAR) AS level,
  CASE WHEN ca_id % 10 <> 0 THEN product_type END AS product_type, partner FROM apps),
  st AS (SELECT level, COUNT(*) AS n, SUM(dep_var) AS pos, AVG(dep_var) AS m, var_pop(dep_var) AS v FROM cats GROUP BY level),
  al AS (SELECT COUNT(*) AS t, SUM(dep_var) AS p, AVG(dep_var) AS prior, var_pop(dep_var) AS va FROM cats)"""


def _encoded(method):
    def run(spark, sf):
        df = _cats(spark, sf)
        levels = encode.encoded_levels(df, ["level"], "dep_var", method)
        return encode.apply_levels(df, "level", levels, "code").select("ca_id", r6("code").alias("code"))
    return run


query("target_encode", f"""WITH {_CATS} SELECT ca_id, {q6('CASE WHEN n = 1 THEN prior ELSE prior * (1 - 1 / (1 + exp(-(n - 1)))) + m / (1 + exp(-(n - 1))) END')} AS code
  FROM cats JOIN st USING (level), al""")(_encoded("target"))
query("woe_encode", f"""WITH {_CATS} SELECT ca_id, {q6('CASE WHEN n = 1 THEN 0 ELSE ln(((pos + 1) / (p + 2)) / ((n - pos + 1) / (t - p + 2))) END')} AS code
  FROM cats JOIN st USING (level), al""")(_encoded("woe"))
query("james_stein_encode", f"""WITH {_CATS} SELECT ca_id, {q6('(1 - v / (v + va)) * m + v / (v + va) * prior')} AS code
  FROM cats JOIN st USING (level), al""")(_encoded("james_stein"))


@query("ordered_target_encode", f"""WITH {_CATS} SELECT ca_id, {q6('''(COALESCE(SUM(dep_var) OVER w, 0) + prior) / (COUNT(*) OVER w + 1)''')} AS code
  FROM cats, al WINDOW w AS (PARTITION BY level ORDER BY ca_created_at, ca_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def ordered_target_encode(spark, sf):
    out = encode.ordered_target_encode(_cats(spark, sf), "level", "dep_var", "ca_created_at", "ca_id", "code")
    return out.select("ca_id", r6("code").alias("code"))


@query("rare_label", f"""WITH {_CATS} SELECT ca_id, CASE WHEN n / t >= 0.008e0 THEN level ELSE 'Others' END AS level,
  COALESCE(product_type, 'Missing') AS product_type FROM cats JOIN st USING (level), al""")
def rare_label(spark, sf):
    df = _cats(spark, sf).select("ca_id", "level", "product_type")
    model = stages.LevelEncoder(columns=["level", "product_type"], method="rare", tol=0.008).fit(df)
    return model.transform(df)


@query("hash_encode", f"""WITH {APPS} SELECT ca_id, """ + ", ".join(
    f"CAST({md5_bucket(chr(39) + 'partner=' + chr(39) + ' || partner', 8, 0)} = {i} AS INTEGER) + "
    f"CAST({md5_bucket(chr(39) + 'product_type=' + chr(39) + ' || product_type', 8, 0)} = {i} AS INTEGER) AS hash_{i}" for i in range(8)) + " FROM apps")
def hash_encode(spark, sf):
    df = applications(spark, sf).select("ca_id", "partner", "product_type")
    return encode.hash_encode(df, ["partner", "product_type"], 8).drop("partner", "product_type")


_DUMMY = """lv AS (SELECT o_orderstatus AS "window", o_orderpriority AS level, COUNT(*) AS n,
    row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r,
    SUM(COUNT(*)) OVER (PARTITION BY o_orderstatus) AS t FROM orders GROUP BY 1, 2),
  dm AS (SELECT o_orderkey, "window", level, CAST(o_orderpriority = level AS DOUBLE) AS x, n / t AS share
    FROM orders JOIN lv ON o_orderstatus = "window" WHERE r > 1)"""


def _dummies(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderkey", C("o_orderstatus").alias("window"), "o_orderpriority")
    return encode.one_hot_drop_first(o, "o_orderkey", "window", ["o_orderpriority"])


@query("one_hot_drop_first", f"""WITH {_DUMMY} SELECT o_orderkey, "window", level, x FROM dm""")
def one_hot_drop_first(spark, sf):
    return _dummies(spark, sf).select("o_orderkey", "window", "level", "x")


@query("famd_scale", f"""WITH {_DUMMY} SELECT o_orderkey, "window", level, {q6('x / sqrt(share) - share')} AS x_scaled FROM dm""")
def famd_scale(spark, sf):
    return rounded(encode.famd_scale(_dummies(spark, sf)).select("o_orderkey", "window", "level", "x_scaled"), "x_scaled")


@query("one_hot_sparse", f"""WITH lng AS (SELECT o_orderkey, o_orderstatus AS w, 'o_custkey' AS col, CAST(o_custkey AS VARCHAR) AS level FROM orders
    UNION ALL SELECT o_orderkey, o_orderstatus, 'o_orderpriority', o_orderpriority FROM orders),
  lv AS (SELECT w, col, level, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY w, col) AS share,
    row_number() OVER (PARTITION BY w, col ORDER BY level) AS r FROM lng GROUP BY 1, 2, 3),
  kp AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY col, level) - 1 AS pos FROM lv WHERE r > 1)
  SELECT o_orderkey, w AS "window", pos, {q6('share')} AS share FROM lng JOIN kp USING (w, col, level)""")
def one_hot_sparse(spark, sf):
    """Dummies of a column with a level per customer next to one with five levels."""
    o = tbl(spark, sf, "orders").select("o_orderkey", C("o_orderstatus").alias("window"), "o_custkey", "o_orderpriority")
    own = encode.one_hot_sparse(o, "o_orderkey", "window", ["o_custkey", "o_orderpriority"])
    return rounded(own.select("o_orderkey", "window", F.inline("own")), "share")


@query("scale_standard", f"SELECT o_orderkey, {q6('(o_totalprice - AVG(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()')} AS o_totalprice FROM orders")
def scale_standard(spark, sf):
    return rounded(encode.scale_standard(tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), "o_totalprice")


@query("scale_minmax", f"""SELECT o_orderkey, {q6('(o_totalprice - MIN(o_totalprice) OVER ()) / (MAX(o_totalprice) OVER () - MIN(o_totalprice) OVER ()) * 0.98e0 + 0.01e0')} AS o_totalprice FROM orders""")
def scale_minmax(spark, sf):
    return rounded(encode.scale_minmax(tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]), "o_totalprice")


@query("scale_robust", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  {q6('(l_extendedprice - (SELECT quantile_cont(l_extendedprice, 0.5) FROM lineitem)) / (SELECT quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) FROM lineitem)')} AS l_extendedprice,
  {q6('(l_quantity - (SELECT quantile_cont(l_quantity, 0.5) FROM lineitem)) / (SELECT quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) FROM lineitem)')} AS l_quantity FROM lineitem""")
def scale_robust(spark, sf):
    li = tbl(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return rounded(encode.scale_robust(li, ["l_extendedprice", "l_quantity"]), "l_extendedprice", "l_quantity")


@query("preprocess_by_type", f"""WITH {_CATS}, num AS (SELECT ca_id, requested_loan_amount AS amount FROM apps),
  ps AS (SELECT partner, COUNT(*) AS pn, SUM(dep_var) AS pp FROM cats GROUP BY 1)
  SELECT ca_id, {q6('(amount - AVG(amount) OVER ()) / stddev_pop(amount) OVER ()')} AS f0,
  {q6('ln(((pp + 1) / (p + 2)) / ((pn - pp + 1) / (t - p + 2)))')} AS f1 FROM cats JOIN num USING (ca_id) JOIN ps USING (partner), al""")
def preprocess_by_type(spark, sf):
    df = applications(spark, sf).select("ca_id", "dep_var", C("requested_loan_amount").alias("amount"), "partner")
    model = Pipeline(stages=train.preprocess_by_type(df, "dep_var", ["ca_id"])).fit(df)
    v = vector_to_array("features")
    return model.transform(df).select("ca_id", r6(v[0]).alias("f0"), r6(v[1]).alias("f1"))


# ---------------------------------------------------------------- the whole feature plan


def payloads(spark, sf):
    """Wide payload rows: names, e-mail, query string and coordinates of every application."""
    g = _geo_rows(spark, sf)
    a = applications(spark, sf)
    k = C("ca_id")
    side = a.select(
        "ca_id", "ca_created_at", C("c_nationkey").alias("a_zip"), C("c_name").alias("p_last_name"),
        F.regexp_replace("c_name", "0+", "").alias("tcr_contact_lastname"), F.lower("partner").alias("p_first_name"),
        C("partner").alias("tcr_contact_firstname"), F.concat("c_name", F.lit("@x.com")).alias("ea_email"),
        F.concat(F.lit("os="), C("product_type"), F.lit("&lang=en&os=alt&n="), k.cast("string")).alias("tmx_raw"))
    return side.join(g.drop("tmx_raw_true_ip_latitude", "tmx_raw_true_ip_longitude"), "ca_id")


FINAL = ["ca_id", "ca_ft_created_at_tz_adj", "tmx_raw_os", "tmx_raw_n", "a_ft_high_risk_area", "ea_ft_digits",
         "p_tcr_ft_first_name_match", "p_tcr_ft_last_name_match", "tmx_ss_ft_input_ip_address_distance",
         "tmx_ft_input_ip_true_ip_distance", "never_sent"]


def feature_plan(df, spark, sf):
    risk = tbl(spark, sf, "nation").where(C("n_nationkey") % 7 == 0).select(C("n_nationkey").alias("a_zip"))
    return application_features(df, zip_offsets(spark, sf), risk, ["os", "n"], FINAL)


FEATURE_PLAN_SQL = f"""WITH RECURSIVE {APPS}, {ZIP_SQL}, {_GEO},
  prs AS (SELECT DISTINCT lower(c_name) AS a, lower(regexp_replace(c_name, '0+', '', 'g')) AS b FROM apps), {_lcs_sql('prs')}
  SELECT apps.ca_id, {q_stamp('ca_created_at + to_hours(CAST(COALESCE(tz_offset, 0) AS INTEGER))')} AS ca_ft_created_at_tz_adj,
  product_type || ', alt' AS tmx_raw_os, CAST(apps.ca_id AS VARCHAR) AS tmx_raw_n, CASE WHEN c_nationkey % 7 = 0 THEN 1 ELSE 0 END AS a_ft_high_risk_area,
  CAST(length(c_name) AS INTEGER) AS ea_ft_digits, 1.0e0 AS p_tcr_ft_first_name_match, {q6('ratio')} AS p_tcr_ft_last_name_match,
  {q6(_HAV.format(*_PTS['ss'], *_PTS['ip']), 4)} AS tmx_ss_ft_input_ip_address_distance, CAST(NULL AS DOUBLE) AS tmx_ft_input_ip_true_ip_distance,
  '' AS never_sent FROM apps JOIN geo ON apps.ca_id = geo.ca_id JOIN lcs ON a = lower(c_name) LEFT JOIN zips ON c_nationkey = a_zip"""


def rounded_features(out):
    out = rounded(out, "p_tcr_ft_first_name_match", "p_tcr_ft_last_name_match")
    return rounded(out, "tmx_ss_ft_input_ip_address_distance", digits=4)


@query("application_features", FEATURE_PLAN_SQL)
def application_features_query(spark, sf):
    return rounded_features(feature_plan(payloads(spark, sf), spark, sf))
