"""Queries of sources, sinks, schema, filter, join, aggregate, window, top-k and set operators."""

from __future__ import annotations

import hashlib

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from ..operators import curves, graph, relational as rel
from ..session import scratch_path
from ..sources import readers, writers
from .base import (APPS, AP, AUC, C, SCORED, applications, curve_sql, md5_bucket, q6, q_stamp, query, r6, rounded,
                   scored, stamp, tbl)

# ---------------------------------------------------------------- sources


@query("scan_csv", "SELECT * FROM customer")
def scan_csv(spark, sf):
    src = tbl(spark, sf, "customer")
    path = scratch_path(spark, "csv")
    writers.write_table(src, path, "csv")
    return readers.read_csv(spark, path, src.schema)


@query("split_features_label", f"WITH {APPS} SELECT ca_id, requested_loan_amount, product_type, dep_var FROM apps")
def split_features_label(spark, sf):
    df = applications(spark, sf).select("ca_id", "requested_loan_amount", "product_type", "dep_var")
    x, y = rel.split_features_label(df, "dep_var", "ca_id")
    return x.join(y, "ca_id")


@query("scan_payload_json", """SELECT o_orderkey AS ca_id, o_totalprice AS amount, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS status FROM orders""")
def scan_payload_json(spark, sf):
    o = tbl(spark, sf, "orders")
    path = scratch_path(spark, "payloads")
    o.select(C("o_orderkey").alias("ca_id"), C("o_totalprice").alias("amount"), C("o_orderpriority").alias("priority"),
             F.when(C("o_orderkey") % 3 != 0, C("o_orderstatus")).alias("status")).write.json(path)
    return readers.read_payloads(spark, path, "ca_id bigint, amount double, priority string, status string")


@query("scan_graph_csv", """SELECT CAST(s_suppkey AS VARCHAR) AS id, 'supplier' AS label, s_name AS code,
  CASE WHEN s_suppkey % 10 = 3 THEN NULL ELSE CAST(s_suppkey % 10 AS INTEGER) END AS runways,
  CAST(s_suppkey % 10 = 3 AS INTEGER) AS _bad_cells FROM supplier""")
def scan_graph_csv(spark, sf):
    s = tbl(spark, sf, "supplier")
    cells = s.select(C("s_suppkey").cast("string"), F.lit("supplier"), "s_name",
                     F.when(C("s_suppkey") % 10 == 3, "x").otherwise((C("s_suppkey") % 10).cast("string")))
    path = scratch_path(spark, "vertices")
    writers.write_table(cells.toDF("~id", "~label", "code:String", "runways:Int"), path, "csv")
    return readers.read_vertices(spark, path)


@query("name_columns", """SELECT p_partkey AS part_id, p_size AS size, p_retailprice AS price,
  'size,price' AS slots FROM part""")
def name_columns(spark, sf):
    unnamed = tbl(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice").toDF("_0", "_1", "_2")
    named = rel.name_columns(unnamed, ["part_id", "size", "price"])
    vec = VectorAssembler(inputCols=["size", "price"], outputCol="v").transform(named)
    return named.withColumn("slots", F.lit(",".join(rel.vector_slot_names(vec, "v"))))


# ---------------------------------------------------------------- sinks


@query("write_table", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def write_table(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    path = scratch_path(spark, "table")
    writers.write_table(o, path, "parquet", partition_by=["o_orderstatus"])
    return spark.read.schema(o.schema).parquet(path)


@query("write_metrics", f"""WITH {SCORED} SELECT partner, COUNT(*) AS applications, CAST(SUM(ytrue) AS BIGINT) AS fraud
  FROM scored GROUP BY partner""")
def write_metrics(spark, sf):
    m = scored(spark, sf).groupBy("partner").agg(F.count(F.lit(1)).alias("applications"), F.sum("ytrue").alias("fraud"))
    path = scratch_path(spark, "metrics")
    writers.write_metrics(m, path)
    return readers.read_csv(spark, path, "partner string, applications bigint, fraud bigint")


@query("evaluation_report", f"""WITH {SCORED}, {curve_sql('scored')} SELECT 0 AS part, NULL AS threshold, {q6(AP)} AS a, {q6(AUC)} AS b,
    CAST(COUNT(*) AS DOUBLE) AS c FROM cum
  UNION ALL SELECT CAST((row_number() OVER (ORDER BY score DESC) - 1) // 10000 AS INTEGER) + 1, {q6('score')}, {q6('fp / n')}, {q6('tp / p')},
    {q6('tp / (tp + fp)')} FROM cum""")
def evaluation_report(spark, sf):
    """The report is written, read back and unpacked: areas in part 0, then every curve point with its part."""
    counts = curves.curve_counts(scored(spark, sf))
    path = scratch_path(spark, "report")
    writers.write_report(writers.evaluation_report(counts), path)
    docs = spark.read.schema("part int, json string").json(path)
    series = "threshold array<double>, fpr array<double>, tpr array<double>, precision array<double>"
    points = docs.where("part > 0").select("part", F.from_json("json", series).alias("j")).select(
        "part", F.explode(F.arrays_zip("j.threshold", "j.fpr", "j.tpr", "j.precision")).alias("p")).select(
        "part", r6("p.threshold").alias("threshold"), r6("p.fpr").alias("a"), r6("p.tpr").alias("b"), r6("p.precision").alias("c"))
    head = docs.where("part = 0").select("part", F.from_json("json", "average_precision double, roc_auc double").alias("j")).select(
        "part", F.lit(None).cast("double").alias("threshold"), r6("j.average_precision").alias("a"), r6("j.roc_auc").alias("b"),
        counts.agg(F.count(F.lit(1)).cast("double")).scalar().alias("c"))
    return head.unionByName(points)


@query("score_response", f"""WITH {SCORED} SELECT ca_id, '{{"keyAttributes":{{"scores":{{"model_v1":{{"probability_fraud":' ||
  CAST(round(score, 3) AS VARCHAR) || '}}}},"applicationId":' || CAST(ca_id AS VARCHAR) || '}}}}' AS response FROM scored""")
def score_response(spark, sf):
    return scored(spark, sf).select("ca_id", writers.score_response(C("ca_id"), F.round("score", 3)).alias("response"))


_WINDOWS = f"""WITH {APPS}, b AS (SELECT MIN(ca_created_at) AS lo, MAX(ca_created_at) AS hi FROM apps),
  ends AS (SELECT k, lo + to_days(CAST(90 * (k - 1) AS INTEGER)) AS s, lo + to_days(CAST(90 * k AS INTEGER)) AS e
           FROM b, range(1, 1000) r(k) WHERE lo + to_days(CAST(90 * k AS INTEGER)) <= hi),
  win AS (SELECT a.*, k AS window_no, CAST(e AS DATE) AS window_end FROM apps a
          JOIN ends ON a.ca_created_at >= s AND a.ca_created_at <= e)"""


@query("materialise_windows", _WINDOWS + """ SELECT CAST(window_end AS VARCHAR) AS window_end, COUNT(*) AS n,
  CAST(SUM(ca_id) AS BIGINT) AS ids FROM win GROUP BY window_end""")
def materialise_windows(spark, sf):
    win = rel.period_windows(applications(spark, sf), "ca_created_at", 90)
    path = scratch_path(spark, "windows")
    writers.materialise_windows(win, path)
    stored = writers.materialise_windows(win, path)  # second call reads the files
    return stored.groupBy(C("window_end").cast("string").alias("window_end")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ca_id").alias("ids"))


# ---------------------------------------------------------------- schema


@query("select_existing", "SELECT o_orderkey, o_totalprice FROM orders")
def select_existing(spark, sf):
    return rel.select_existing(tbl(spark, sf, "orders"), ["o_totalprice", "not_there", "o_orderkey"])


@query("drop_existing", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_existing(spark, sf):
    return rel.drop_existing(tbl(spark, sf, "customer"), ["c_name", "c_acctbal", "not_there"])


@query("pii_projection", f"WITH {APPS} SELECT ca_id, partner, product_type, requested_loan_amount FROM apps")
def pii_projection(spark, sf):
    return rel.pii_projection(applications(spark, sf), ["ca_id", "partner", "product_type", "requested_loan_amount"])


@query("add_missing_columns", "SELECT s_suppkey, s_name, '' AS fax, '' AS phone FROM supplier")
def add_missing_columns(spark, sf):
    s = tbl(spark, sf, "supplier").select("s_suppkey", "s_name")
    return rel.add_missing_columns(s, ["s_name", "fax", "phone"])


@query("lowercase_columns", "SELECT p_partkey, p_brand, p_size FROM part")
def lowercase_columns(spark, sf):
    p = tbl(spark, sf, "part").select(C("p_partkey").alias("P_PARTKEY"), C("p_brand").alias("P_Brand"), "p_size")
    return rel.lowercase_columns(p)


@query("coerce_types", f"""SELECT CAST(o_orderkey AS VARCHAR) AS ca_id, {q_stamp('o_orderdate')} AS created,
  o_totalprice AS amount, COALESCE(CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey AS VARCHAR) END, 'nan') AS customer
  FROM orders""")
def coerce_types(spark, sf):
    raw = tbl(spark, sf, "orders").select(
        C("o_orderkey").alias("ca_id"), stamp("o_orderdate").alias("created"),
        C("o_totalprice").cast("string").alias("amount"), F.when(C("o_custkey") % 10 != 0, C("o_custkey")).alias("customer"))
    out = rel.coerce_types(raw, ["created"], ["amount"], ["ca_id", "customer", "absent"], null_as="nan")
    return out.withColumn("created", stamp("created"))


@query("coerce_numeric_lenient", """SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amount FROM orders""")
def coerce_numeric_lenient(spark, sf):
    text = F.when(C("o_orderkey") % 5 == 0, "n/a").otherwise(F.concat(F.lit("'"), C("o_totalprice").cast("string"), F.lit("'")))
    return tbl(spark, sf, "orders").select("o_orderkey", rel.coerce_numeric_lenient(text).alias("amount"))


@query("resolve_collision", """SELECT o_orderkey AS ca_id, o_custkey AS customer_id, o_orderpriority AS tag,
  o_totalprice AS amount FROM orders""")
def resolve_collision(spark, sf):
    o = tbl(spark, sf, "orders")
    left = o.select(C("o_orderkey").alias("ca_id"), C("o_custkey").alias("customer_id"), C("o_orderstatus").alias("tag"))
    right = o.select(C("o_orderkey").alias("ca_id"), C("o_custkey").alias("customer_id"),
                     C("o_orderpriority").alias("tag"), C("o_totalprice").alias("amount"))
    return rel.resolve_collision(left, right, ["ca_id", "customer_id"], "tag")


@query("fraud_label", f"""WITH {APPS} SELECT ca_id, CASE WHEN dep_var = 1 OR first_party_fraud = 1 THEN 1 ELSE 0 END AS general,
  CASE WHEN first_party_fraud = 1 THEN 1 ELSE 0 END AS first, CASE WHEN dep_var = 1 THEN 1 ELSE 0 END AS third,
  CASE WHEN any_fraud = 1 THEN 1 ELSE 0 END AS "any" FROM
  (SELECT ca_id, CASE WHEN ca_id % 13 <> 0 THEN dep_var END AS dep_var, first_party_fraud, any_fraud FROM apps)""")
def fraud_label(spark, sf):
    df = applications(spark, sf).withColumn("dep_var", F.when(C("ca_id") % 13 != 0, C("dep_var")))
    for mode in ("general", "first", "third", "any"):
        df = rel.fraud_label(df, mode, mode)
    return df.select("ca_id", "general", "first", "third", "any")


@query("map_flag", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS flag FROM orders")
def map_flag(spark, sf):
    word = F.when(C("o_orderstatus") == "F", "fraud").otherwise(C("o_orderstatus"))
    return tbl(spark, sf, "orders").select("o_orderkey", rel.map_flag(word).alias("flag"))


@query("conditional_update", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 999 WHEN c_mktsegment = 'BUILDING' THEN 667
  ELSE c_nationkey END AS c_nationkey FROM customer""")
def conditional_update(spark, sf):
    c = tbl(spark, sf, "customer")
    return rel.conditional_update(c, "c_nationkey", [
        (C("c_mktsegment") == "BUILDING", 667), (C("c_acctbal") < 0, 999)]).select("c_custkey", "c_nationkey")


# ---------------------------------------------------------------- filters


@query("filter_product", f"WITH {APPS} SELECT ca_id, product_type FROM apps WHERE product_type = 'F'")
def filter_product(spark, sf):
    return rel.filter_product(applications(spark, sf), "F").select("ca_id", "product_type")


@query("filter_scored", f"WITH {SCORED} SELECT ca_id, {q6('fm_5_score')} AS fm_5_score FROM scored WHERE fm_5_score IS NOT NULL")
def filter_scored(spark, sf):
    return rounded(rel.filter_scored(scored(spark, sf)).select("ca_id", "fm_5_score"), "fm_5_score")


@query("search_email", f"""WITH {APPS} SELECT ca_id, c_name || '@' || lower(partner) || '.com' AS email FROM apps
  WHERE c_name || '@' || lower(partner) || '.com' = 'Customer#000000001@machinery.com'""")
def search_email(spark, sf):
    df = applications(spark, sf).select(
        "ca_id", F.concat("c_name", F.lit("@"), F.lower("partner"), F.lit(".com")).alias("email"))
    return rel.search_exact(df, "email", "Customer#000000001@machinery.com")


_DEVICE_PREFIX = hashlib.md5(b"8").hexdigest()[:7]


@query("search_device_prefix", f"""SELECT event_id, md5(CAST(user_id AS VARCHAR)) AS fuzzy_device_id FROM events
  WHERE substr(md5(CAST(user_id AS VARCHAR)), 1, 7) = '{_DEVICE_PREFIX}'""")
def search_device_prefix(spark, sf):
    e = tbl(spark, sf, "events").select("event_id", F.md5(C("user_id").cast("string")).alias("fuzzy_device_id"))
    return rel.search_prefix(e, "fuzzy_device_id", _DEVICE_PREFIX)


@query("search_customer_prefix", """SELECT o_orderkey AS customer_id, o_totalprice AS amount FROM orders
  WHERE substr(CAST(o_orderkey AS VARCHAR), 1, 3) = '123'""")
def search_customer_prefix(spark, sf):
    o = tbl(spark, sf, "orders").select(C("o_orderkey").alias("customer_id"), C("o_totalprice").alias("amount"))
    return rel.search_prefix(o, "customer_id", "123")


_LINE_EDGES = """edges AS (SELECT l_suppkey AS "from", l_partkey AS "to", COUNT(*) AS velocity,
  AVG(CASE WHEN l_returnflag = 'R' THEN 1.0e0 ELSE 0 END) AS fraud FROM lineitem GROUP BY 1, 2)"""


def line_edges(spark, sf):
    li = tbl(spark, sf, "lineitem").withColumn("flag", rel.map_flag(C("l_returnflag"), "R"))
    return graph.bipartite_edges(li, "l_suppkey", "l_partkey", "flag")


@query("filter_velocity", f"""WITH {_LINE_EDGES} SELECT "from", "to", velocity, {q6('fraud')} AS fraud FROM edges WHERE velocity = 2""")
def filter_velocity(spark, sf):
    return rounded(line_edges(spark, sf).where(C("velocity") == 2), "fraud")


def _vertices(spark, sf):
    s, n = tbl(spark, sf, "supplier"), tbl(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        C("s_suppkey").alias("id"), F.lit("supplier").alias("label"), C("s_name").alias("code"),
        C("n_name").alias("city"), (C("s_suppkey") % 10).alias("runways"))


@query("traverse_has_values", "SELECT s_name AS code FROM supplier WHERE s_suppkey % 10 >= 6")
def traverse_has_values(spark, sf):
    return graph.has_values(_vertices(spark, sf), "runways", 6, "code")


@query("traverse_sample_order_fold", f"""SELECT s_name || ',' || n_name AS folded FROM supplier
  JOIN nation ON s_nationkey = n_nationkey ORDER BY {md5_bucket('s_name', 1 << 31)}, s_name LIMIT 10""")
def traverse_sample_order_fold(spark, sf):
    out = graph.sample_order_fold(_vertices(spark, sf), "supplier", 10, "code", ["code", "city"])
    return out.select(F.array_join("folded", ",").alias("folded"))


# ---------------------------------------------------------------- joins


@query("join_labels_features", f"""WITH {APPS} SELECT ca_id, customer_id, dep_var, requested_loan_amount FROM apps""")
def join_labels_features(spark, sf):
    a = applications(spark, sf)
    return rel.join_on_keys(a.select("ca_id", "customer_id", "dep_var"),
                            a.select("ca_id", "customer_id", "requested_loan_amount"))


@query("join_scores", f"""WITH {SCORED} SELECT ca_id, customer_id, partner, {q6('fm_5_score')} AS fm_5_score FROM scored
  WHERE fm_5_score IS NOT NULL""")
def join_scores(spark, sf):
    s = scored(spark, sf)
    base = rel.filter_scored(s).select("ca_id", "customer_id", "fm_5_score")
    return rounded(rel.join_on_keys(s.select("ca_id", "customer_id", "partner"), base), "fm_5_score")


@query("join_on_key_left", f"""WITH {SCORED} SELECT ca_id, product_type, {q6('fm_5_score')} AS fm_5_score FROM scored""")
def join_on_key_left(spark, sf):
    s = scored(spark, sf)
    base = rel.filter_scored(s).select("ca_id", "fm_5_score")
    return rounded(rel.join_on_keys(s.select("ca_id", "product_type"), base, ["ca_id"], "left"), "fm_5_score")


def zip_offsets(spark, sf):
    return tbl(spark, sf, "nation").where(C("n_nationkey") % 5 != 0).select(
        C("n_nationkey").alias("a_zip"), (C("n_nationkey") % 24 - 12).alias("tz_offset"))


ZIP_SQL = "zips AS (SELECT n_nationkey AS a_zip, n_nationkey % 24 - 12 AS tz_offset FROM nation WHERE n_nationkey % 5 <> 0)"


@query("lookup_timezone", f"""WITH {APPS}, {ZIP_SQL} SELECT ca_id, c_nationkey AS a_zip, COALESCE(tz_offset, 0) AS tz_offset
  FROM apps LEFT JOIN zips ON c_nationkey = a_zip""")
def lookup_timezone(spark, sf):
    df = applications(spark, sf).select("ca_id", C("c_nationkey").alias("a_zip"))
    return rel.lookup_default(df, zip_offsets(spark, sf), "a_zip", "tz_offset", 0)


@query("membership_flag", f"""WITH {APPS} SELECT ca_id, CASE WHEN c_nationkey % 7 = 0 THEN 1 ELSE 0 END AS high_risk FROM apps""")
def membership_flag(spark, sf):
    listed = tbl(spark, sf, "nation").where(C("n_nationkey") % 7 == 0).select(C("n_nationkey").alias("c_nationkey"))
    df = applications(spark, sf).select("ca_id", "c_nationkey")
    return rel.membership_flag(df, "c_nationkey", listed, "high_risk").select("ca_id", "high_risk")


def identity_rows(spark, sf):
    return tbl(spark, sf, "events").select(
        "event_id", "user_id", "props",
        F.concat_ws("|", "event_type", F.date_format("ts", "yyyy-MM-dd HH")).alias("device"))


IDENTITY_SQL = """ident AS (SELECT event_id, user_id, props, event_type || '|' || strftime(ts, '%Y-%m-%d %H') AS device FROM events)"""
ALL_PAIRS_SQL = f"""{IDENTITY_SQL}, attrs AS (
    SELECT event_id AS id, user_id AS owner, 'props' AS attr, props AS value FROM ident WHERE trim(props) <> ''
    UNION ALL SELECT event_id, user_id, 'device', device FROM ident WHERE trim(device) <> ''),
  sizes AS (SELECT attr, value, COUNT(*) AS n FROM attrs GROUP BY 1, 2 HAVING COUNT(DISTINCT owner) > 1),
  att AS (SELECT attrs.*, n FROM attrs JOIN sizes USING (attr, value)),
  pairs AS (
    SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM (
      SELECT a.id AS src, b.id AS dst, COUNT(*) AS weight FROM att a
      JOIN att b ON a.attr = b.attr AND a.value = b.value AND a.owner <> b.owner GROUP BY 1, 2))"""
#: the same with the pairs of listed rows only
EDGES_SQL = ALL_PAIRS_SQL.replace("GROUP BY 1, 2))", "WHERE a.id % 20 = 0 GROUP BY 1, 2))")


@query("shared_attribute_edges", f"WITH {EDGES_SQL} SELECT id, owner, attr || '=' || value AS via FROM att")
def shared_attribute_edges(spark, sf):
    return graph.shared_attribute_edges(identity_rows(spark, sf), "event_id", "user_id", ["props", "device"])


@query("assign_window", _WINDOWS + " SELECT ca_id, window_no FROM win WHERE product_type = 'F'")
def assign_window(spark, sf):
    a = applications(spark, sf)
    return rel.assign_window(a, "ca_created_at", 90, rel.filter_product(a, "F")).select("ca_id", "window_no")


@query("anti_join_holdout", f"""WITH {APPS} SELECT ca_id, partner FROM apps WHERE {md5_bucket('ca_id', 100)} >= 20""")
def anti_join_holdout(spark, sf):
    a = applications(spark, sf).select("ca_id", "partner")
    return rel.anti_join_holdout(a, rel.sample_fraction(a, "ca_id", 20), "ca_id")


# ---------------------------------------------------------------- aggregates


@query("partner_metrics", f"""WITH {SCORED}, {curve_sql('scored', ('partner',))} SELECT partner, MAX(p + n) AS total_applications,
  MAX(p) AS actual_fraud, {q6(AUC)} AS auc_roc, {q6(AP)} AS auc_pr FROM cum GROUP BY partner""")
def partner_metrics(spark, sf):
    return rounded(curves.group_metrics(curves.curve_counts(scored(spark, sf), groups=["partner"]), ["partner"]),
                   "auc_roc", "auc_pr")


def cv_scores(spark, sf):
    return rel.stratified_fold(scored(spark, sf), "ca_id", "dep_var", 5)


FOLD = md5_bucket("CAST(dep_var AS VARCHAR) || '|' || CAST(ca_id AS VARCHAR)", 5)
CV_SQL = f"{SCORED}, cv AS (SELECT *, CAST({FOLD} AS INTEGER) AS fold FROM scored)"


@query("partner_objective", f"""WITH {CV_SQL}, {curve_sql('cv', ('fold', 'partner'))},
  m AS (SELECT fold, partner, {AP} AS ap FROM cum GROUP BY 1, 2),
  pm AS (SELECT partner, AVG(ap) AS a FROM m WHERE partner IN ('BUILDING', 'MACHINERY') GROUP BY 1)
  SELECT {q6('AVG(a)')} AS objective FROM pm""")
def partner_objective(spark, sf):
    m = curves.average_precision(curves.curve_counts(cv_scores(spark, sf), groups=["fold", "partner"]), ["fold", "partner"])
    return rounded(curves.partner_objective(m, ["BUILDING", "MACHINERY"]), "objective")


@query("bipartite_edges", f"""WITH {_LINE_EDGES} SELECT "from", "to", velocity, {q6('fraud')} AS fraud FROM edges""")
def bipartite_edges(spark, sf):
    return rounded(line_edges(spark, sf), "fraud")


def sparse_rows(spark, sf):
    """Orders with a part-null, an all-null and a constant column."""
    return tbl(spark, sf, "orders").select(
        "o_orderkey", F.nullif(C("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("priority"),
        F.when(C("o_orderkey") % 7 != 0, C("o_totalprice")).alias("amount"),
        F.lit("x").alias("constant"), F.lit(None).cast("string").alias("empty"),
        F.when(C("o_orderkey") % 2 == 0, F.lit(1)).alias("half"))


SPARSE_SQL = """sparse AS (SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS amount, 'x' AS constant, CAST(NULL AS VARCHAR) AS empty,
  CASE WHEN o_orderkey % 2 = 0 THEN 1 END AS half FROM orders)"""
_SPARSE_COLS = ("o_orderkey", "priority", "amount", "constant", "empty", "half")


@query("null_fraction", f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", {q6(f'AVG(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END)')} AS null_fraction FROM sparse"""
    for c in _SPARSE_COLS))
def null_fraction(spark, sf):
    return rounded(rel.null_fraction(sparse_rows(spark, sf)), "null_fraction")


@query("constant_columns", f"WITH {SPARSE_SQL}, d AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) + MAX(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS k FROM sparse"""
    for c in _SPARSE_COLS) + """) SELECT "column" FROM d WHERE k = 1""")
def constant_columns(spark, sf):
    return rel.constant_columns(sparse_rows(spark, sf))


@query("label_counts", f"WITH {APPS} SELECT dep_var, COUNT(*) AS count FROM apps GROUP BY dep_var")
def label_counts(spark, sf):
    return rel.label_counts(applications(spark, sf), "dep_var")


@query("time_span_and_rate", f"""WITH {APPS} SELECT CAST(floor((epoch_us(MAX(ca_created_at)) - epoch_us(MIN(ca_created_at))) / 86400000000) AS BIGINT) AS days,
  round(AVG(any_fraud), 5) AS rate FROM apps""")
def time_span_and_rate(spark, sf):
    return rel.time_span_and_rate(applications(spark, sf), "ca_created_at", "any_fraud")


@query("confusion_at_threshold", f"""WITH {SCORED} SELECT partner,
  COUNT(*) FILTER (score > 0.5 AND ytrue = 1) AS true_positives, COUNT(*) FILTER (score > 0.5 AND ytrue = 0) AS false_positives,
  COUNT(*) FILTER (score <= 0.5 AND ytrue = 1) AS false_negatives, COUNT(*) FILTER (score <= 0.5 AND ytrue = 0) AS true_negatives
  FROM scored GROUP BY partner""")
def confusion_at_threshold(spark, sf):
    return curves.confusion_at(scored(spark, sf), 0.5, groups=["partner"])


@query("cv_summary", f"""WITH {CV_SQL}, {curve_sql('cv', ('fold',))}, m AS (SELECT fold, {AP} AS ap FROM cum GROUP BY fold)
  SELECT {q6('AVG(ap)')} AS auc_pr_cv_mean, {q6('stddev_samp(ap)')} AS auc_pr_cv_std FROM m""")
def cv_summary(spark, sf):
    m = curves.average_precision(curves.curve_counts(cv_scores(spark, sf), groups=["fold"]), ["fold"])
    return rounded(curves.cv_summary(m, "auc_pr"), "auc_pr_cv_mean", "auc_pr_cv_std")


def importance_rows(spark, sf):
    """Importances per (brand-type feature, fold): mean price by part group, five folds by key."""
    p = tbl(spark, sf, "part")
    return p.groupBy(F.concat_ws("_", "p_brand", "p_type").alias("feature"), (C("p_partkey") % 5).alias("fold")).agg(
        F.avg("p_retailprice").alias("importance"))


IMPORTANCE_SQL = """imp AS (SELECT p_brand || '_' || p_type AS feature, p_partkey % 5 AS fold,
  AVG(p_retailprice) AS importance FROM part GROUP BY 1, 2),
  mi AS (SELECT feature, round(AVG(importance), 6) AS mean_importance FROM imp GROUP BY 1)"""


def mean_importances(spark, sf):
    return rounded(rel.importance_mean(importance_rows(spark, sf)), "mean_importance")


@query("importance_mean", f"WITH {IMPORTANCE_SQL} SELECT feature, mean_importance FROM mi")
def importance_mean(spark, sf):
    return mean_importances(spark, sf)


# ---------------------------------------------------------------- windows by key


@query("duplicated_filter", f"""WITH {IDENTITY_SQL} SELECT event_id, props, device FROM (SELECT *, COUNT(*) OVER (PARTITION BY props) AS a,
  COUNT(*) OVER (PARTITION BY device) AS b FROM ident) WHERE a > 1 AND b = 1""")
def duplicated_filter(spark, sf):
    return rel.duplicated_filter(identity_rows(spark, sf), "props", "device", "event_id").select(
        "event_id", "props", "device")


@query("first_occurrence", f"""WITH {IDENTITY_SQL} SELECT event_id, device FROM (SELECT *, row_number() OVER
  (PARTITION BY device ORDER BY event_id) AS r FROM ident) WHERE r = 1""")
def first_occurrence(spark, sf):
    return rel.first_occurrence(identity_rows(spark, sf), "device", "event_id").select("event_id", "device")


@query("cumulative_curve_counts", f"""WITH {SCORED}, r AS (SELECT partner, round(score, 2) AS score, ytrue FROM scored),
  {curve_sql('r', ('partner',))} SELECT partner, score, tp, fp FROM cum""")
def cumulative_curve_counts(spark, sf):
    s = scored(spark, sf).withColumn("score", F.round("score", 2))
    return curves.curve_counts(s, groups=["partner"]).select("partner", "score", "tp", "fp")


@query("stratified_fold", f"WITH {CV_SQL} SELECT ca_id, fold FROM cv")
def stratified_fold(spark, sf):
    return cv_scores(spark, sf).select("ca_id", "fold")


@query("dense_node_id", f"""WITH {IDENTITY_SQL} SELECT DISTINCT 'customer' AS kind, CAST(user_id AS VARCHAR) AS value, 1 AS ids, 1 AS owners FROM ident
  UNION ALL SELECT DISTINCT 'device', device, 1, 1 FROM ident""")
def dense_node_id(spark, sf):
    """Every node has one id and every id one node (hash ids cannot be compared across engines)."""
    e = identity_rows(spark, sf)
    nodes = graph.node_table(e, {"customer": "user_id", "device": "device"})
    again = e.select(graph.dense_node_id("device", C("device")).alias("node_id")).distinct()
    again = again.union(e.select(graph.dense_node_id("customer", C("user_id"))).distinct())
    owners = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("owners"))
    ids = nodes.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("ids"))
    return nodes.join(again, "node_id").join(owners, "node_id").join(ids, ["kind", "value"]).select("kind", "value", "ids", "owners")


@query("period_windows", _WINDOWS + " SELECT ca_id, window_no, CAST(window_end AS VARCHAR) AS window_end FROM win")
def period_windows(spark, sf):
    win = rel.period_windows(applications(spark, sf), "ca_created_at", 90)
    return win.select("ca_id", "window_no", C("window_end").cast("string").alias("window_end"))


# ---------------------------------------------------------------- sort, top-k, samples, sets


@query("sort_created", f"WITH {APPS} SELECT ca_id, {q_stamp('ca_created_at')} AS created FROM apps ORDER BY ca_created_at, ca_id")
def sort_created(spark, sf):
    return applications(spark, sf).orderBy("ca_created_at", "ca_id").select("ca_id", stamp("ca_created_at").alias("created"))


@query("topk_importance", f"WITH {IMPORTANCE_SQL} SELECT * FROM mi ORDER BY mean_importance DESC, feature LIMIT 50")
def topk_importance(spark, sf):
    return rel.topk(mean_importances(spark, sf), "mean_importance", 50, "feature")


@query("drop_bottom_k", f"""WITH {IMPORTANCE_SQL} SELECT feature, mean_importance FROM (SELECT *, row_number() OVER
  (ORDER BY mean_importance, feature) AS r FROM mi) WHERE r > 5""")
def drop_bottom_k(spark, sf):
    return rel.drop_bottom_k(mean_importances(spark, sf), "mean_importance", 5, "feature").select("feature", "mean_importance")


@query("head_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head_n(spark, sf):
    return rel.head_n(tbl(spark, sf, "orders"), 10, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("sample_fraction", f"SELECT o_orderkey FROM orders WHERE {md5_bucket('o_orderkey', 100)} < 20")
def sample_fraction(spark, sf):
    return rel.sample_fraction(tbl(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 20)


_COPIES = " + ".join(f"({md5_bucket('o_orderkey', 1 << 32)} >= {s})::INTEGER" for s in rel.poisson_steps(0.2))


@query("sample_with_replacement", f"""SELECT o_orderkey FROM (SELECT o_orderkey, unnest(range({_COPIES})) FROM orders)""")
def sample_with_replacement(spark, sf):
    return rel.sample_with_replacement(tbl(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("argmax_trial", f"""WITH {IMPORTANCE_SQL} SELECT MAX(mean_importance) AS best_score, arg_max(feature, mean_importance) AS best_params FROM mi""")
def argmax_trial(spark, sf):
    return rel.argmax_trial(mean_importances(spark, sf), "mean_importance", "feature")


@query("union_rows", f"""WITH {APPS} SELECT ca_id, dep_var, partner FROM apps WHERE dep_var = 1
  UNION ALL SELECT ca_id, dep_var, NULL FROM apps WHERE dep_var = 0 AND {md5_bucket('ca_id', 100)} < 20""")
def union_rows(spark, sf):
    a = applications(spark, sf).select("ca_id", "dep_var", "partner")
    clean = rel.sample_fraction(a.where(C("dep_var") == 0), "ca_id", 20).drop("partner")
    return rel.union_rows(a.where(C("dep_var") == 1), clean)


@query("concat_columns", f"""SELECT o_orderkey, {q6('o_totalprice / 1000')} AS thousands, length(o_orderpriority) AS width FROM orders""")
def concat_columns(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    out = rel.concat_columns(o, {"thousands": r6(C("o_totalprice") / 1000), "width": F.length("o_orderpriority").cast("bigint")})
    return out.select("o_orderkey", "thousands", "width")
