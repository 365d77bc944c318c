"""Cell graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import CUBE, query, r6
from drygrid.operators import graph as gr

EDGES = """ed AS (SELECT l_suppkey AS src, l_partkey % 100 AS dst, SUM(l_quantity) AS w FROM lineitem GROUP BY 1, 2), dg AS (SELECT src AS node, SUM(w) AS d FROM ed GROUP BY 1),
nd AS (SELECT src AS node FROM ed UNION SELECT dst FROM ed)"""
SYM = f"""{EDGES}, sy AS (SELECT dst AS src, ed.src AS dst, COALESCE(w / SQRT(a.d) / SQRT(b.d), 0) AS w FROM ed LEFT JOIN dg a ON a.node = ed.src LEFT JOIN dg b ON b.node = ed.dst)"""


def edges(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 100).alias("dst")).agg(F.sum("l_quantity").alias("w"))


def out(df):
    return df.select("src", "dst", (F.round("w", 6) + 0).alias("w"))


@query("graph_symmetric", f"""WITH {SYM} SELECT src, dst, ROUND(w, 6) + 0 AS w FROM sy""")
def graph_symmetric(t):
    return out(gr.supports(edges(t), "symnadj")[0])


@query("graph_transition", f"""WITH {EDGES} SELECT ed.src, dst, ROUND(w / d, 6) + 0 AS w FROM ed JOIN dg ON node = ed.src""")
def graph_transition(t):
    return out(gr.supports(edges(t), "transition")[0])


@query("graph_transition_backward", f"""WITH {EDGES}, bd AS (SELECT dst AS node, SUM(w) AS d FROM ed GROUP BY 1) SELECT ed.dst AS src, ed.src AS dst, ROUND(w / d, 6) + 0 AS w FROM ed JOIN bd ON node = ed.dst""")
def graph_transition_backward(t):
    return out(gr.supports(edges(t), "doubletransition")[1])


@query("graph_laplacian", f"""WITH {SYM}, u AS (SELECT node AS src, node AS dst, 1.0::DOUBLE AS w FROM nd UNION ALL SELECT src, dst, -w FROM sy) SELECT src, dst, ROUND(SUM(w), 6) + 0 AS w FROM u GROUP BY 1, 2""")
def graph_laplacian(t):
    return out(gr.supports(edges(t), "normlap")[0])


@query("graph_scaled_laplacian", f"""WITH {EDGES}, tw AS (SELECT src, dst, w FROM ed UNION ALL SELECT dst, src, w FROM ed), un AS (SELECT src, dst, MAX(w) AS w FROM tw GROUP BY 1, 2), ud AS (SELECT src AS node, SUM(w) AS d FROM un GROUP BY 1),
 u AS (SELECT node AS src, node AS dst, 1.0::DOUBLE AS w FROM nd UNION ALL SELECT dst, un.src, -w / SQRT(a.d) / SQRT(b.d) FROM un JOIN ud a ON a.node = un.src JOIN ud b ON b.node = un.dst UNION ALL SELECT node, node, -1 FROM nd)
SELECT src, dst, ROUND(SUM(w), 6) + 0 AS w FROM u GROUP BY 1, 2""")
def graph_scaled_laplacian(t):
    return out(gr.supports(edges(t), "scalap")[0])


LANCZOS_STEPS = 5


def lanczos_sql() -> str:
    """The recursion unrolled: q_k has node, x (this vector) and y (matrix times x, less the last beta times the vector before)."""
    parts = [f"""WITH {EDGES}, tw AS (SELECT src, dst, w FROM ed UNION ALL SELECT dst, src, w FROM ed), un AS (SELECT src, dst, MAX(w) AS w FROM tw GROUP BY 1, 2), ud AS (SELECT src AS node, SUM(w) AS d FROM un GROUP BY 1),
 lp AS (SELECT src, dst, SUM(w) AS w FROM (SELECT node AS src, node AS dst, 1.0::DOUBLE AS w FROM nd UNION ALL SELECT un.src, dst, -w / SQRT(a.d) / SQRT(b.d) FROM un JOIN ud a ON a.node = un.src JOIN ud b ON b.node = un.dst) GROUP BY 1, 2),
 r0 AS (SELECT node, node % 1009 * 7919 % 1009 / 1009 - 0.5::DOUBLE AS x FROM nd), v0 AS (SELECT node, x / (SELECT SQRT(SUM(x * x)) FROM r0) AS x, 0.0::DOUBLE AS p, 0.0::DOUBLE AS b FROM r0)"""]
    for k in range(LANCZOS_STEPS):
        parts.append(f"""m{k} AS (SELECT dst AS node, SUM(w * x) AS y FROM lp JOIN v{k} ON v{k}.node = src GROUP BY 1), q{k} AS (SELECT v{k}.node, x, y - b * p AS y FROM v{k} JOIN m{k} ON m{k}.node = v{k}.node),
 c{k} AS (SELECT SUM(x * y) AS alpha, SQRT(SUM(y * y) - SUM(x * y) * SUM(x * y)) AS beta FROM q{k}),
 v{k + 1} AS (SELECT node, (y - x * (SELECT alpha FROM c{k})) / (SELECT beta FROM c{k}) AS x, x AS p, (SELECT beta FROM c{k}) AS b FROM q{k})""")
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {k} AS step, ROUND(alpha, 6) AS alpha, ROUND(beta, 6) AS beta FROM c{k}" for k in range(LANCZOS_STEPS))


@query("graph_lanczos", lanczos_sql())
def graph_lanczos(t):
    """The tridiagonal matrix whose largest eigenvalue stands for that of the Laplacian."""
    alpha, beta = gr.lanczos(gr.normalised_laplacian(gr.undirected(edges(t))), LANCZOS_STEPS)
    return t.spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip(alpha, beta))], "step int, alpha double, beta double").select("step", r6("alpha"), r6("beta"))


@query("graph_scaled_laplacian_by_eigenvalue")
def graph_scaled_laplacian_by_eigenvalue(t):
    return out(gr.scaled_laplacian(edges(t), lambda_max=None))


@query("graph_identity", f"""WITH {EDGES} SELECT node AS src, node AS dst, 1.0::DOUBLE AS w FROM nd""")
def graph_identity(t):
    return out(gr.supports(edges(t), "identity")[0])


@query("graph_diffusion", f"""WITH {CUBE}, {EDGES}, tr AS (SELECT ed.src, dst, w / d AS w FROM ed JOIN dg ON node = ed.src), x0 AS (SELECT cell_id AS node, AVG(value) AS v FROM cube GROUP BY 1),
 x1 AS (SELECT dst AS node, SUM(w * v) AS v FROM tr JOIN x0 ON x0.node = src GROUP BY 1), x2 AS (SELECT dst AS node, SUM(w * v) AS v FROM tr JOIN x1 ON x1.node = src GROUP BY 1)
SELECT node, 0 AS hop, ROUND(v, 6) AS value FROM x0 UNION ALL SELECT node, 1, ROUND(v, 6) FROM x1 UNION ALL SELECT node, 2, ROUND(v, 6) FROM x2""")
def graph_diffusion(t):
    features = t.cube().groupBy(F.col("cell_id").alias("node")).agg(F.avg("value").alias("value"))
    return gr.diffuse(gr.row_normalised(edges(t)), features, 2).select("node", "hop", r6("value"))


@query("distance_graph", """WITH c AS (SELECT s_suppkey AS id, -5.25 + (s_suppkey // 10) * 0.2::DOUBLE AS lat, 32.25 + (s_suppkey % 10) * 0.25::DOUBLE AS lon FROM supplier),
 a AS (SELECT id, lat, lon, UNNEST((SELECT LIST({'id': id, 'lat': lat, 'lon': lon}) FROM c)) AS b FROM c),
 p AS (SELECT id AS src, b.id AS dst, 2 * 6371.0088::DOUBLE * ASIN(LEAST(SQRT(POW(SIN(RADIANS(b.lat - lat) / 2), 2) + COS(RADIANS(lat)) * COS(RADIANS(b.lat)) * POW(SIN(RADIANS(b.lon - lon) / 2), 2)), 1)) AS d FROM a),
 w AS (SELECT src, dst, EXP(-POW(d / (SELECT STDDEV_POP(d) FROM p), 2)) AS w FROM p) SELECT src, dst, ROUND(w, 6) AS w FROM w WHERE w >= 0.05""")
def distance_graph(t):
    return gr.distance_adjacency(t.cells()).select("src", "dst", r6("w"))


@query("distance_graph_of_valid_cells", """WITH c AS (SELECT s_suppkey AS id, -5.25 + (s_suppkey // 10) * 0.2::DOUBLE AS lat, 32.25 + (s_suppkey % 10) * 0.25::DOUBLE AS lon FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING COUNT(*) FILTER (l_quantity = 50 AND l_linenumber = 7) > 0)),
 a AS (SELECT id, lat, lon, UNNEST((SELECT LIST({'id': id, 'lat': lat, 'lon': lon}) FROM c)) AS b FROM c),
 p AS (SELECT id AS src, b.id AS dst, 2 * 6371.0088::DOUBLE * ASIN(LEAST(SQRT(POW(SIN(RADIANS(b.lat - lat) / 2), 2) + COS(RADIANS(lat)) * COS(RADIANS(b.lat)) * POW(SIN(RADIANS(b.lon - lon) / 2), 2)), 1)) AS d FROM a),
 w AS (SELECT src, dst, EXP(-POW(d / (SELECT STDDEV_POP(d) FROM p), 2)) AS w FROM p) SELECT src, dst, ROUND(w, 6) AS w FROM w WHERE w >= 0.05""")
def distance_graph_of_valid_cells(t):
    from drygrid.operators.subset import keep_cells

    hits = F.count_if((F.col("l_quantity") == 50) & (F.col("l_linenumber") == 7))
    kept = t.lineitem.groupBy(F.col("l_suppkey").alias("cell_id")).agg(hits.alias("hits")).where("hits > 0").select("cell_id")
    return gr.distance_adjacency(keep_cells(t.cells(), kept)).select("src", "dst", r6("w"))


def adjacency_sql(vector: str, distance: str) -> str:
    return f"""WITH e AS (SELECT vec_id AS id, {vector} AS v FROM embeddings), p AS (SELECT a.id AS src, b.id AS dst, 1 / ({distance}) AS iv FROM e a JOIN e b ON a.id < b.id),
 s AS (SELECT src, dst, iv / (SELECT MAX(iv) FROM p) AS w FROM p), al AS (SELECT w FROM s UNION ALL SELECT 0 FROM s UNION ALL SELECT 1 FROM e), q AS (SELECT QUANTILE_CONT(w, 0.98) AS t FROM al), k AS (SELECT src, dst, w FROM s, q WHERE w >= t)
SELECT src, dst, ROUND(w, 6) AS w, 1 AS a FROM k UNION ALL SELECT dst, src, ROUND(w, 6), 1 FROM k UNION ALL SELECT id, id, 1, 1 FROM e"""


def feature_graph(t, measure, vector=None):
    rows = t.embeddings.select(F.col("vec_id").alias("node"), (F.col("embedding") if vector is None else vector).alias("vector"))
    return gr.feature_adjacency(rows, 98.0, measure).select("src", "dst", r6("w"), "a")


@query("feature_graph_euclidean", adjacency_sql("embedding::DOUBLE[]", "list_distance(a.v, b.v)"))
def feature_graph_euclidean(t):
    return feature_graph(t, "euclidean")


@query("feature_graph_correlation", adjacency_sql(
    "list_transform(embedding::DOUBLE[], lambda x: x - list_avg(embedding::DOUBLE[]))", "1 - list_cosine_similarity(a.v, b.v)"))
def feature_graph_correlation(t):
    return feature_graph(t, "correlation")


@query("feature_graph_jensen_shannon", adjacency_sql(
    "list_transform(embedding::DOUBLE[], lambda x: ABS(x) / list_sum(list_transform(embedding::DOUBLE[], lambda y: ABS(y))))",
    "SQRT(list_sum(list_transform(list_zip(a.v, b.v), lambda z: CASE WHEN z[1] > 0 THEN z[1] * LN(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * LN(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2)"))
def feature_graph_jensen_shannon(t):
    return feature_graph(t, "jensenshannon", F.transform("embedding", lambda x: F.abs(x)))


@query("feature_graph_mahalanobis")
def feature_graph_mahalanobis(t):
    return feature_graph(t, "mahalanobis")


SHORT_VECTORS = """WITH e AS (SELECT l_suppkey AS id, AVG(l_quantity) AS x, AVG(l_extendedprice) / 1000 AS y, AVG(l_discount) * 100 AS z FROM lineitem GROUP BY 1),
 c AS (SELECT 2.0::DOUBLE * COUNT(*) / (2 * COUNT(*) - 1) AS f, VAR_POP(x) * f AS xx, VAR_POP(y) * f AS yy, VAR_POP(z) * f AS zz, COVAR_POP(x, y) * f AS xy, COVAR_POP(x, z) * f AS xz, COVAR_POP(y, z) * f AS yz FROM e),
 d AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM c),
 g AS (SELECT a.id AS src, b.id AS dst, a.x - b.x AS p, a.y - b.y AS q, a.z - b.z AS r FROM e a JOIN e b ON a.id < b.id),
 p AS (SELECT src, dst, 1 / SQRT(((yy * zz - yz * yz) * p * p + (xx * zz - xz * xz) * q * q + (xx * yy - xy * xy) * r * r + 2 * ((xz * yz - xy * zz) * p * q + (xy * yz - xz * yy) * p * r + (xy * xz - xx * yz) * q * r)) / det) AS iv FROM g, d),
 s AS (SELECT src, dst, iv / (SELECT MAX(iv) FROM p) AS w FROM p), al AS (SELECT w FROM s UNION ALL SELECT 0 FROM s UNION ALL SELECT 1 FROM e), t AS (SELECT QUANTILE_CONT(w, 0.9) AS t FROM al), k AS (SELECT src, dst, w FROM s, t WHERE w >= t)
SELECT src, dst, ROUND(w, 6) AS w, 1 AS a FROM k UNION ALL SELECT dst, src, ROUND(w, 6), 1 FROM k UNION ALL SELECT id, id, 1, 1 FROM e"""


@query("supplier_graph_mahalanobis", SHORT_VECTORS)
def supplier_graph_mahalanobis(t):
    """Suppliers by three averages of their lines; short enough for a closed inverse in SQL."""
    means = t.lineitem.groupBy(F.col("l_suppkey").alias("node")).agg(
        F.array(F.avg("l_quantity"), F.avg("l_extendedprice") / 1000, F.avg("l_discount") * 100).alias("vector"))
    return gr.feature_adjacency(means, 90.0, "mahalanobis").select("src", "dst", r6("w"), "a")
