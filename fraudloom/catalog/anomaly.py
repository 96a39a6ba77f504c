"""Queries of outlier detectors, the windowed cost study and the graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..anomaly import detectors, knn
from ..operators import graph, relational as rel
from ..plans import lift_study as lift_plan, window_cost
from ..session import settle
from .base import APPS, C, SCORED, applications, q6, query, rounded, scored, tbl
from .tables import ALL_PAIRS_SQL, EDGES_SQL, IDENTITY_SQL, _LINE_EDGES, _WINDOWS, identity_rows, line_edges


def feature_rows(spark, sf):
    """(id, window, vec) from the embeddings, one window per label."""
    return tbl(spark, sf, "embeddings").select(
        C("vec_id").alias("id"), C("label").cast("string").alias("window"), C("embedding").cast("array<double>").alias("vec"))


_ROWS = 'rws AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS "window", CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)'


@query("outlier_hbos", f"""WITH {_ROWS}, cells AS (SELECT id, "window", pos, vec[pos] AS x FROM rws, range(1, 65) r(pos)),
  e AS (SELECT *, MIN(x) OVER w AS lo, MAX(x) OVER w AS hi, COUNT(*) OVER w AS n FROM cells WINDOW w AS (PARTITION BY "window", pos)),
  b AS (SELECT *, least(9, floor((x - lo) / ((hi - lo) / 10))) AS bin FROM e),
  h AS (SELECT *, COUNT(*) OVER (PARTITION BY "window", pos, bin) AS c FROM b)
  SELECT id, "window", {q6('SUM(-ln(c / (n * ((hi - lo) / 10)) + 0.1e0))', 4)} AS raw FROM h GROUP BY id, "window" """)
def outlier_hbos(spark, sf):
    return rounded(detectors.outlier_hbos(feature_rows(spark, sf)), "raw", digits=4).select("id", "window", "raw")


def _knn_sql(k):
    return f"""{_ROWS}, nn AS (SELECT * FROM (SELECT a."window", a.id, b.id AS nbr, list_distance(a.vec, b.vec) AS dist,
    row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rnk
    FROM rws a JOIN rws b ON a."window" = b."window" AND a.id <> b.id) WHERE rnk <= {k})"""


@query("outlier_knn", f"""WITH {_knn_sql(15)} SELECT id, "window", {q6('AVG(dist)')} AS raw FROM nn GROUP BY id, "window" """)
def outlier_knn(spark, sf):
    return rounded(detectors.outlier_knn(knn.knn_table(feature_rows(spark, sf), 15), 15), "raw").select("id", "window", "raw")


@query("outlier_lof", f"""WITH {_knn_sql(15)}, kd AS (SELECT id, MAX(dist) AS kdist FROM nn GROUP BY id),
  d AS (SELECT nn.id, 1.0e0 / AVG(greatest(kdist, dist)) AS lrd FROM nn JOIN kd ON nn.nbr = kd.id GROUP BY nn.id)
  SELECT nn.id, nn."window", {q6('AVG(o.lrd) / MAX(s.lrd)')} AS raw FROM nn JOIN d o ON nn.nbr = o.id JOIN d s ON nn.id = s.id GROUP BY nn.id, nn."window" """)
def outlier_lof(spark, sf):
    return rounded(detectors.outlier_lof(knn.knn_table(feature_rows(spark, sf), 15), 15), "raw").select("id", "window", "raw")


@query("outlier_pca")
def outlier_pca(spark, sf):
    return rounded(detectors.outlier_pca(feature_rows(spark, sf), (1, 3, 5, 19)), "raw")


@query("pca_reduce")
def pca_reduce(spark, sf):
    out = detectors.pca_reduce(feature_rows(spark, sf), 20)
    return out.select("id", "window", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vec"))


@query("outlier_iforest")
def outlier_iforest(spark, sf):
    return rounded(detectors.outlier_iforest(feature_rows(spark, sf), trees=128), "raw")


_HBOS = """cells AS (SELECT id, "window", pos, vec[pos] AS x FROM rws, range(1, 65) r(pos)),
  e AS (SELECT *, MIN(x) OVER w AS lo, MAX(x) OVER w AS hi, COUNT(*) OVER w AS n FROM cells WINDOW w AS (PARTITION BY "window", pos)),
  b AS (SELECT *, least(9, floor((x - lo) / ((hi - lo) / 10))) AS bin FROM e),
  h AS (SELECT *, COUNT(*) OVER (PARTITION BY "window", pos, bin) AS c FROM b),
  hb AS (SELECT id, "window", SUM(-ln(c / (n * ((hi - lo) / 10)) + 0.1e0)) AS raw FROM h GROUP BY 1, 2)"""


@query("outlier_lscp", f"""WITH {_knn_sql(20)}, {_HBOS}, n15 AS (SELECT * FROM nn WHERE rnk <= 15),
  kd AS (SELECT id, MAX(dist) AS kdist FROM n15 GROUP BY id),
  d AS (SELECT n15.id, 1.0e0 / AVG(greatest(kdist, dist)) AS lrd FROM n15 JOIN kd ON n15.nbr = kd.id GROUP BY n15.id),
  s AS (SELECT id, "window", 'hbos' AS det, raw FROM hb UNION ALL SELECT id, "window", 'knn_15', AVG(dist) FROM n15 GROUP BY 1, 2
    UNION ALL SELECT n15.id, n15."window", 'lof_15', AVG(o.lrd) / MAX(m.lrd) FROM n15 JOIN d o ON n15.nbr = o.id JOIN d m ON n15.id = m.id GROUP BY 1, 2),
  z AS (SELECT id, "window", det, (raw - AVG(raw) OVER w) / stddev_pop(raw) OVER w AS z FROM s WINDOW w AS (PARTITION BY "window", det)),
  zt AS (SELECT *, MAX(z) OVER (PARTITION BY id) AS target FROM z),
  fit AS (SELECT nn.id, zt.det, corr(zt.z, zt.target) AS f FROM nn JOIN zt ON nn.nbr = zt.id GROUP BY 1, 2),
  best AS (SELECT id, det FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY COALESCE(f, -2) DESC, det DESC) AS r FROM fit) WHERE r = 1)
  SELECT z.id, z."window", 'lscp' AS detector, {q6('z.z')} AS raw FROM z JOIN best ON z.id = best.id AND z.det = best.det""")
def outlier_lscp(spark, sf):
    rows = feature_rows(spark, sf)
    nbrs = knn.knn_table(rows, 20)
    base = detectors.outlier_hbos(rows).unionByName(detectors.outlier_knn(nbrs, 15)).unionByName(detectors.outlier_lof(nbrs, 15))
    return rounded(detectors.outlier_lscp(base, nbrs, 20, "lscp"), "raw")


@query("window_features", _WINDOWS + f""", lng AS (SELECT ca_id, window_end, 'partner' AS col, partner AS level FROM win
    UNION ALL SELECT ca_id, window_end, 'product_type', product_type FROM win),
  lv AS (SELECT window_end, col, level, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY window_end, col) AS t,
    row_number() OVER (PARTITION BY window_end, col ORDER BY level) AS r FROM lng GROUP BY 1, 2, 3),
  kp AS (SELECT *, n / t AS p, row_number() OVER (PARTITION BY window_end ORDER BY col, level) AS pos FROM lv WHERE r > 1)
  SELECT ca_id AS id, CAST(window_end AS VARCHAR) AS "window", 0 AS pos, {q6('(requested_loan_amount - AVG(requested_loan_amount) OVER w) / stddev_pop(requested_loan_amount) OVER w')} AS x
  FROM win WINDOW w AS (PARTITION BY window_end)
  UNION ALL SELECT l.ca_id, CAST(l.window_end AS VARCHAR), CAST(pos AS INTEGER), {q6('CASE WHEN l.level = kp.level THEN 1 ELSE 0 END / sqrt(p) - p')}
  FROM lng l JOIN kp ON l.window_end = kp.window_end AND l.col = kp.col""")
def window_features(spark, sf):
    a = applications(spark, sf)
    out = window_cost.window_features(a, "ca_id", "ca_created_at", 90, ["requested_loan_amount"], ["partner", "product_type"])
    return rounded(out.select("id", "window", F.posexplode("vec").alias("pos", "x")), "x")


@query("window_anomaly_cost")
def window_anomaly_cost(spark, sf):
    """Windows, features, three detectors, augmentation and cost over all applications; ``window_study`` has all seven."""
    s = rel.filter_scored(scored(spark, sf))
    rows = window_cost.window_features(s, "ca_id", "ca_created_at", 90, ["requested_loan_amount"], ["partner", "product_type"])
    rows = settle(rows, "windows")
    found = detectors.outlier_hbos(rows).unionByName(detectors.outlier_iforest(rows, trees=128)).unionByName(
        detectors.outlier_pca(rows, (1, 3)))
    return window_cost.window_savings(found, s, "ca_id", "ytrue", "fm_5_score")


@query("detector_suite_cost")
def detector_suite_cost(spark, sf):
    """All seven detectors on the embeddings, priced against a base score of the same ids."""
    rows = feature_rows(spark, sf)
    k = C("vec_id")
    labels = tbl(spark, sf, "embeddings").select(k, (k % 5 == 0).cast("int").alias("y"), (k * 7919 % 10007 / F.lit(20014.0)).alias("base"))
    found = detectors.detector_suite(rows, trees=128, dims=64)
    return window_cost.window_savings(found, labels, "vec_id", "y", "base")


@query("window_study")
def window_study(spark, sf):
    """The whole study: 90-day windows of all applications, seven detectors, money saved per detector and window."""
    s = rel.filter_scored(scored(spark, sf))
    out = window_cost.window_study(s, s, "ca_id", "ca_created_at", ["requested_loan_amount"], ["partner", "product_type"], "ytrue", "fm_5_score")
    return rounded(out, *[c for c in out.columns if c != "detector"], digits=4)


@query("lift_study", _WINDOWS + SCORED[len(APPS):] + f""", s AS (SELECT scored.*, (fm_5_score - 0.00197736842965041e0) / 1.22643393399164e0 AS base
    FROM scored JOIN win ON scored.ca_id = win.ca_id WHERE fm_5_score IS NOT NULL)
  SELECT COUNT(*) AS labelled, {q6('COUNT(*) FILTER (base > 0.05e0 AND ytrue = 1) / COUNT(*) FILTER (base > 0.05e0)')} AS base_precision,
    {q6('COUNT(*) FILTER (base > 0.05e0 AND ytrue = 1) / COUNT(*) FILTER (ytrue = 1)')} AS base_recall, 0 AS unaccounted, true AS recall_kept FROM s""")
def lift_study(spark, sf):
    """The whole study on 90-day windows. SQL knows what the base score catches and that flags only add; the forest is tested apart."""
    s = scored(spark, sf)
    rows = settle(window_cost.window_features(s, "ca_id", "ca_created_at", 90, ["requested_loan_amount"], ["partner", "product_type"]), "lift-rows")
    share = s.agg(F.avg("ytrue")).first()[0]
    out = lift_plan.lift_study(rows, s, "ca_id", "ytrue", "fm_5_score", share)
    return rounded(out, "base_precision", "base_recall").select(
        "labelled", "base_precision", "base_recall", (C("added") - C("changed")).cast("int").alias("unaccounted"), (C("recall_gain") >= 0).alias("recall_kept"))


# ---------------------------------------------------------------- graph


def _edges(spark, sf):
    return graph.shared_attribute_edges(identity_rows(spark, sf), "event_id", "user_id", ["props", "device"])


@query("graph_from_adjacency", f"WITH {ALL_PAIRS_SQL} SELECT src, dst, weight FROM pairs")
def graph_from_adjacency(spark, sf):
    """Undirected pair weights of all rows against all rows."""
    return graph.graph_from_adjacency(graph.pair_weights(_edges(spark, sf)))


@query("edge_attributes", f"""WITH {EDGES_SQL} SELECT src, dst, a.props AS src_email, b.props AS dst_email, substr(a.device, 1, 7) AS src_device,
  substr(b.device, 1, 7) AS dst_device FROM pairs JOIN ident a ON src = a.event_id JOIN ident b ON dst = b.event_id""")
def edge_attributes(spark, sf):
    """The pairs of every row whose id is divisible by 20 with all rows."""
    rows, columns = identity_rows(spark, sf), {"email": C("props"), "device": F.substring("device", 1, 7)}
    listed = tbl(spark, sf, "events").where(C("event_id") % 20 == 0).select(C("event_id").alias("id"))
    pairs = graph.graph_from_adjacency(graph.pair_weights(_edges(spark, sf), listed, graph.vertex_rows(rows, "event_id", columns)))
    return graph.edge_attributes(pairs.drop("weight"), rows, "event_id", columns)


@query("bipartite_graph", f"""WITH {_LINE_EDGES} SELECT "from", "to", velocity, {q6('fraud')} AS fraud, true AS nodes_known FROM edges""")
def bipartite_graph(spark, sf):
    li = tbl(spark, sf, "lineitem").withColumn("flag", rel.map_flag(C("l_returnflag"), "R"))
    nodes, edges = graph.bipartite_graph(li, "l_suppkey", "l_partkey", "flag", "supplier", "part")
    # both ends must be found among the nodes again
    src = nodes.where(C("kind") == "supplier").select(C("node_id").alias("src"), C("value").alias("sv"))
    dst = nodes.where(C("kind") == "part").select(C("node_id").alias("dst"), C("value").alias("dv"))
    known = (C("sv") == C("from").cast("string")) & (C("dv") == C("to").cast("string"))
    out = edges.join(src, "src").join(dst, "dst").withColumn("nodes_known", known)
    return rounded(out.select("from", "to", "velocity", "fraud", "nodes_known"), "fraud")


@query("tripartite_graph", f"""WITH {IDENTITY_SQL} SELECT DISTINCT CAST(user_id AS VARCHAR) AS "from", props AS "to", 'email' AS kind FROM ident
  UNION SELECT DISTINCT CAST(user_id AS VARCHAR), device, 'device' FROM ident""")
def tripartite_graph(spark, sf):
    return graph.tripartite_graph(identity_rows(spark, sf), "user_id", {"email": "props", "device": "device"})


@query("align_to_nodes", f"""WITH {_LINE_EDGES} SELECT s_suppkey AS node, "to", velocity, {q6('fraud')} AS fraud FROM supplier
  LEFT JOIN (SELECT * FROM edges WHERE velocity = 2) ON s_suppkey = "from" """)
def align_to_nodes(spark, sf):
    nodes = tbl(spark, sf, "supplier").select(C("s_suppkey").alias("node"))
    return rounded(graph.align_to_nodes(nodes, line_edges(spark, sf).where(C("velocity") == 2), "node", "from"), "fraud")


@query("render_tables", f"""WITH {_LINE_EDGES} SELECT "from", "to", velocity, {q6('fraud')} AS fraud, CASE WHEN velocity > 1 THEN 100 ELSE 10 END AS node_size,
  CASE WHEN velocity > 1 THEN 1 ELSE 0 END AS highlight, CASE WHEN fraud = 1 THEN 'r' ELSE 'g' END AS edge_color,
  CASE WHEN s_acctbal < 0 THEN 'red' ELSE 'lightgray' END AS color, substr(CAST(s_suppkey AS VARCHAR), 1, 5) AS label, 100 AS size
  FROM edges JOIN supplier ON s_suppkey = "from" """)
def render_tables(spark, sf):
    edges = graph.render_edges(line_edges(spark, sf))
    nodes = graph.render_nodes(tbl(spark, sf, "supplier"), "s_suppkey", C("s_acctbal") < 0)
    return rounded(edges.join(nodes.withColumnRenamed("node", "from"), "from"), "fraud")
