"""Registered queries: one or more for each operator, on the test tables, with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lattice as L
from ..operators import bmu, ensemble, grid, lattice_maps, quality, scaling, train
from ..sources import io
from ..sources.scratch import shared_path
from ..streaming import score

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
X, Y = 6, 5

DIM = 64
PTS = "pts AS MATERIALIZED (SELECT vec_id AS point_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS f FROM embeddings)"
START = "st AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY md5('7-' || point_id), point_id) - 1 AS INTEGER) AS node, f AS w FROM pts QUALIFY node < 30)"


def _d2(a: str, b: str, n: int = DIM) -> str:
    return "(" + " + ".join(f"({a}[{i}] - {b}[{i}]) * ({a}[{i}] - {b}[{i}])" for i in range(1, n + 1)) + ")"


def _epoch(src: str, out: str, n: int) -> str:
    h = f"CASE WHEN greatest(abs(a.node % 6 - s.c % 6), abs(a.node // 6 - s.c // 6)) <= {n} THEN exp(-(greatest(abs(a.node % 6 - s.c % 6), abs(a.node // 6 - s.c // 6)) * greatest(abs(a.node % 6 - s.c % 6), abs(a.node // 6 - s.c // 6))) / (2 * ({n} / 3.0) * ({n} / 3.0))) ELSE 0.0 END"
    return f"""{out}_m AS (SELECT point_id, f, node AS c FROM (SELECT point_id, f, node, row_number() OVER (PARTITION BY point_id ORDER BY {_d2('f', 'w')}, node) AS k FROM pts, {src}) WHERE k = 1),
{out}_s AS (SELECT c, count(*) AS n, {', '.join(f'sum(f[{i}]) AS s{i}' for i in range(1, DIM + 1))} FROM {out}_m GROUP BY 1),
{out}_h AS (SELECT a.node, sum(({h}) * n) AS den, {', '.join(f'sum(({h}) * s{i}) AS t{i}' for i in range(1, DIM + 1))} FROM {src} a, {out}_s s GROUP BY 1),
{out} AS (SELECT a.node, CASE WHEN den > 0 THEN [{', '.join(f't{i} / den' for i in range(1, DIM + 1))}] ELSE a.w END AS w FROM {src} a JOIN {out}_h h ON a.node = h.node)"""


#: The lattice of most queries: trained on all points with all components, by two epochs.
LAT = f"{PTS}, {START}, {_epoch('st', 'e1', 4)}, {_epoch('e1', 'e2', 2)}, lat AS MATERIALIZED (SELECT node, CAST(node % 6 AS INTEGER) AS x, CAST(node // 6 AS INTEGER) AS y, w FROM e2)"
BMU = f"""pd AS (SELECT point_id, label, f, node, {_d2('f', 'w')} AS d2 FROM pts, lat),
rk AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d2, node) AS k FROM pd), bm AS (SELECT point_id, label, f, node, d2, node % 6 AS x, node // 6 AS y FROM rk WHERE k = 1)"""
NB = f"""nb AS (SELECT a.x, a.y, avg(sqrt({_d2('a.w', 'b.w')})) AS raw FROM lat a JOIN lat b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.node <> b.node GROUP BY 1, 2), um AS MATERIALIZED (SELECT x, y, raw / 30 AS heat FROM nb)"""
ORD = """off(ord, dx, dy) AS (VALUES (0, -1, -1), (1, 0, -1), (2, 1, -1), (3, 1, 0), (4, 1, 1), (5, 0, 1), (6, -1, 1), (7, -1, 0))"""
DESC = f"""{ORD}, cand AS (SELECT a.x, a.y, b.x AS nx, b.y AS ny, row_number() OVER (PARTITION BY a.x, a.y ORDER BY b.heat, o.ord) AS k FROM um a, off o JOIN um b ON b.x = a.x + o.dx AND b.y = a.y + o.dy WHERE b.heat < a.heat),
de AS (SELECT u.x, u.y, coalesce(c.nx, u.x) AS nx, coalesce(c.ny, u.y) AS ny FROM um u LEFT JOIN cand c ON c.x = u.x AND c.y = u.y AND c.k = 1)"""
CENT = f"""{DESC}, walk(x, y, cx, cy, n) AS (SELECT x, y, nx, ny, 0 FROM de UNION ALL SELECT w.x, w.y, d.nx, d.ny, n + 1 FROM walk w JOIN de d ON d.x = w.cx AND d.y = w.cy WHERE n < 30),
ce AS (SELECT x, y, cx, cy FROM walk WHERE n = 30)"""
CLUS = "cl AS (SELECT x, y, CAST(dense_rank() OVER (ORDER BY cx, cy) - 1 AS INTEGER) AS cluster_id FROM ce)"
LATQ = f"WITH RECURSIVE {LAT}, {BMU}, {NB}, {CENT}, {CLUS}"

ENS = """runs AS (SELECT 'priority' AS run_id, o_orderkey AS point_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS cluster_id FROM orders
 UNION ALL SELECT 'status', o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END FROM orders
 UNION ALL SELECT 'price', o_orderkey, CAST(least(4, floor(o_totalprice / 100000)) AS INTEGER) FROM orders
 UNION ALL SELECT 'year', o_orderkey, CAST(year(o_orderdate) AS INTEGER) FROM orders)"""
SQS = """sz AS (SELECT run_id, cluster_id, count(*) AS n FROM runs GROUP BY 1, 2),
ix AS (SELECT a.run_id AS run_a, a.cluster_id AS id_a, b.run_id AS run_b, b.cluster_id AS id_b, count(*) AS n_inter FROM runs a JOIN runs b ON a.point_id = b.point_id AND a.run_id < b.run_id GROUP BY 1, 2, 3, 4),
sq AS (SELECT ix.*, a.n AS n_a, b.n AS n_b, CASE WHEN a.n + b.n = 2 * n_inter THEN 0.0 ELSE CAST(n_inter AS DOUBLE) * (a.n + b.n) / (CAST(a.n + b.n - n_inter AS DOUBLE) * (a.n + b.n - 2 * n_inter)) END AS sq
 FROM ix JOIN sz a ON a.run_id = run_a AND a.cluster_id = id_a JOIN sz b ON b.run_id = run_b AND b.cluster_id = id_b),
gs AS (SELECT z.run_id, z.cluster_id, coalesce(sum(sq), 0.0) AS gsum FROM sz z LEFT JOIN (SELECT run_a AS run_id, id_a AS cluster_id, sq FROM sq UNION ALL SELECT run_b, id_b, sq FROM sq) q ON q.run_id = z.run_id AND q.cluster_id = z.cluster_id GROUP BY 1, 2),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY gsum DESC, run_id, cluster_id) - 1 AS INTEGER) AS rank FROM gs)"""
ENSQ = f"WITH {ENS}, {SQS}"
CUBE = "cells AS (SELECT CAST(id // 64 AS INTEGER) AS i, CAST(id // 8 % 8 AS INTEGER) AS j, CAST(id % 8 AS INTEGER) AS k, ((id // 64) * 7 + (id // 8 % 8) * 13 + (id % 8) * 29) % 31 / 10.0 AS v FROM range(512) r(id))"
SERIES = """ev AS (SELECT CAST(dayofmonth(ts) - 1 AS INTEGER) AS day, sum(value) AS s FROM events GROUP BY 1),
series AS (SELECT day AS i, s - lag(s, 1, s) OVER (ORDER BY day) AS d FROM ev)"""


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("f"), "label")


_TRAINED: dict[tuple[str, str], list] = {}


def lat(spark: SparkSession, sf: str) -> DataFrame:
    """The lattice of LAT; 30 rows, trained once for each session and folder."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _TRAINED:
        _TRAINED[at] = [(r.node, r.x, r.y, list(r.w)) for r in train.train_batch(pts(spark, sf), X, Y, [4, 2]).collect()]
    return spark.createDataFrame(_TRAINED[at], "node int, x int, y int, w array<double>")


def umat(spark: SparkSession, sf: str) -> DataFrame:
    return lattice_maps.umatrix(lat(spark, sf))


def cents(spark: SparkSession, sf: str) -> DataFrame:
    return lattice_maps.centroids(umat(spark, sf))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    cols = {"priority": F.substring("o_orderpriority", 1, 1), "status": status, "price": F.least(F.lit(4), F.floor(F.col("o_totalprice") / 100000)), "year": F.year("o_orderdate")}
    return ensemble.labels_of(table(spark, sf, "orders"), "o_orderkey", cols)


def cube(spark: SparkSession) -> DataFrame:
    i, j, k = F.floor(F.col("id") / 64).cast("int"), F.floor(F.col("id") / 8).cast("int") % 8, (F.col("id") % 8).cast("int")
    return spark.range(512).select(i.alias("i"), j.alias("j"), k.alias("k"), ((i * 7 + j * 13 + k * 29) % 31 / 10.0).alias("v"))


def r6(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# -- scaling and scalar functions


@register("SELECT p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (2 * (SELECT stddev_pop(p_size) FROM part)), 6) AS p_size, round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (2 * (SELECT stddev_pop(p_retailprice) FROM part)), 6) AS p_retailprice FROM part")
def scale_two_sigma(spark, sf):
    return r6(scaling.two_sigma(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


@register("SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (2 * (SELECT stddev_pop(o_totalprice) FROM orders)) * 3, 6) AS o_totalprice FROM orders")
def scale_two_sigma_orders(spark, sf):
    return r6(scaling.two_sigma(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], 3.0), "o_totalprice")


@register("SELECT avg(p_size) AS mean_size, round(stddev_pop(p_size), 6) AS std_size, round(avg(p_retailprice), 6) AS mean_price, round(stddev_pop(p_retailprice), 6) AS std_price FROM part")
def column_moments(spark, sf):
    return table(spark, sf, "part").agg(F.avg("p_size").alias("mean_size"), F.round(F.stddev_pop("p_size"), 6).alias("std_size"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"), F.round(F.stddev_pop("p_retailprice"), 6).alias("std_price"))


@register("SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / ((SELECT max(p_size) FROM part) - (SELECT min(p_size) FROM part)), 6) AS p_size, round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / ((SELECT max(p_retailprice) FROM part) - (SELECT min(p_retailprice) FROM part)), 6) AS p_retailprice FROM part")
def scale_minmax(spark, sf):
    return r6(scaling.min_max(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


@register("SELECT p_partkey, round(p_size / (p_size + p_retailprice), 6) AS p_size, round(p_retailprice / (p_size + p_retailprice), 6) AS p_retailprice FROM part")
def normalize_rows(spark, sf):
    return r6(scaling.by_row_sum(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"]), "p_size", "p_retailprice")


@register("SELECT ratio, CAST(trunc(5 * sqrt(n * 4) / 6) AS BIGINT) AS nodes, CAST(trunc(sqrt(trunc(5 * sqrt(n * 4) / 6) / ratio)) AS BIGINT) AS xdim, CAST(trunc(trunc(5 * sqrt(n * 4) / 6) / trunc(sqrt(trunc(5 * sqrt(n * 4) / 6) / ratio))) AS BIGINT) AS ydim FROM (SELECT count(*) AS n FROM orders), (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.7 AS DOUBLE))) t(ratio)")
def lattice_size(spark, sf):
    n = table(spark, sf, "orders").count()
    return spark.createDataFrame([(r, L.node_count(n, 4), *L.lattice_size(n, 4, r)) for r in (0.5, 0.7)], "ratio double, nodes long, xdim long, ydim long")


@register("SELECT id AS node, CAST(id % 6 AS INTEGER) AS x, CAST(id // 6 AS INTEGER) AS y, CAST(id % 6 + (id // 6) * 6 AS INTEGER) AS back FROM range(30) r(id)")
def node_coordinates(spark, sf):
    n = spark.range(30).select(F.col("id").alias("node"), L.node_x(F.col("id"), X).alias("x"), L.node_y(F.col("id"), X).alias("y"))
    return n.withColumn("back", L.node_of(F.col("x"), F.col("y"), X))


@register(f"WITH {LAT} SELECT node, round(w[1], 6) AS w1, round(w[4], 6) AS w4 FROM lat WHERE node = 3 + 2 * 6")
def node_weight(spark, sf):
    return lat(spark, sf).where(F.col("node") == 3 + 2 * X).select("node", F.round(F.get("w", F.lit(0)), 6).alias("w1"), F.round(F.get("w", F.lit(3)), 6).alias("w4"))


def _hood(spark):
    return spark.range(30).select("id", (L.node_x(F.col("id"), X) - 2).alias("dx"), (L.node_y(F.col("id"), X) - 2).alias("dy"))


_HOOD = "WITH h AS (SELECT id, id % 6 - 2 AS dx, id // 6 - 2 AS dy, greatest(abs(id % 6 - 2), abs(id // 6 - 2)) AS d FROM range(30) r(id)) "


@register(_HOOD + "SELECT id, round(CASE WHEN d <= 2 THEN 0.5 * exp(-(d * d) / (2 * (2 / 3.0) * (2 / 3.0))) ELSE 0.0 END, 6) AS h FROM h")
def neighborhood_gaussian(spark, sf):
    return _hood(spark).select("id", F.round(L.neighbourhood(L.chebyshev(F.col("dx"), F.col("dy")), 0.5, 2), 6).alias("h"))


@register(_HOOD + "SELECT id, CAST(CASE WHEN d <= 2 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS h FROM h")
def neighborhood_bubble(spark, sf):
    return _hood(spark).select("id", L.neighbourhood(L.chebyshev(F.col("dx"), F.col("dy")), 0.5, 2, False).alias("h"))


@register(_HOOD + "SELECT id, CAST(CASE WHEN sqrt(dx * dx + dy * dy) < 1.5 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS h FROM h")
def neighborhood_legacy(spark, sf):
    return _hood(spark).select("id", L.neighbourhood_euclid(F.col("dx"), F.col("dy"), 0.5, 1).alias("h"))


@register("""WITH RECURSIVE st(step, ns, al) AS (SELECT 0, 21, CAST(0.3 AS DOUBLE) UNION ALL
 SELECT step + 1, CASE WHEN step > 200 AND step % 7 = 0 AND ns > 8 THEN greatest(8, 21 - (step - 200) // 7) ELSE ns END, CASE WHEN step <> 0 AND step % 16 = 0 THEN al * 0.75 ELSE al END FROM st WHERE step < 399)
 SELECT CAST(step AS BIGINT) AS step, CAST(ns AS INTEGER) AS nsize, round(al, 6) AS alpha FROM st""")
def training_schedule(spark, sf):
    p = L.SomParams(20, 10, 0.3, 400)
    return spark.range(400).select(F.col("id").alias("step"), L.nsize_at(F.col("id"), p, 400).alias("nsize"), F.round(L.alpha_at(F.col("id"), p), 6).alias("alpha"))


@register(f"WITH {PTS}, {START} SELECT node, round(w[1], 6) AS w1 FROM st")
def init_lattice_sampled(spark, sf):
    return train.sampled_lattice(pts(spark, sf), X, Y).select("node", F.round(F.get("w", F.lit(0)), 6).alias("w1"))


@register("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) // ((SELECT count(*) FROM part) // 3) AS INTEGER) AS chunk FROM part QUALIFY chunk < 3")
def training_chunks(spark, sf):
    return scaling.chunks(table(spark, sf, "part").select("p_partkey"), "p_partkey", 3)


# -- best matches


@register(f"WITH {LAT}, {BMU} SELECT point_id, node, round(d2, 6) AS d2 FROM bm")
def bmu_kernel(spark, sf):
    return r6(bmu.best_matches(pts(spark, sf), lat(spark, sf)).drop("rank"), "d2")


@register(f"WITH {LAT}, {BMU} SELECT point_id, node, round(d2, 6) AS d2 FROM bm")
def bmu_join(spark, sf):
    return r6(bmu.best_match_sql(pts(spark, sf), lat(spark, sf)), "d2")


@register(f"WITH {LAT}, {BMU} SELECT point_id, CAST(k AS INTEGER) AS rank, node, round(d2, 6) AS d2 FROM rk WHERE k <= 2")
def bmu_top2(spark, sf):
    return r6(bmu.best_matches(pts(spark, sf), lat(spark, sf), 2), "d2")


@register("""WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (2 * (SELECT stddev_pop(l_quantity) FROM lineitem)) AS q,
 (l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (2 * (SELECT stddev_pop(l_extendedprice) FROM lineitem)) AS p FROM lineitem),
 lat AS (SELECT id AS node, (id % 6) / 5.0 - 0.5 AS a, (id // 6) / 4.0 - 0.5 AS b FROM range(30) r(id)),
 rk AS (SELECT s.q, s.p, node, row_number() OVER (PARTITION BY rid ORDER BY (q - a) * (q - a) + (p - b) * (p - b), node) AS k FROM (SELECT *, row_number() OVER () AS rid FROM s) s, lat)
 SELECT CAST(node AS INTEGER) AS node, count(*) AS n FROM rk WHERE k = 1 GROUP BY 1""")
def bmu_lineitem_histogram(spark, sf):
    s = scaling.two_sigma(table(spark, sf, "lineitem").select(F.monotonically_increasing_id().alias("point_id"), "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"])
    nodes = spark.range(30).select(F.col("id").cast("int").alias("node"), F.array((F.col("id") % 6) / 5.0 - 0.5, F.floor(F.col("id") / 6) / 4.0 - 0.5).alias("w"))
    p = s.select("point_id", F.array("l_quantity", "l_extendedprice").alias("f"))
    return bmu.best_matches(p, nodes).groupBy("node").agg(F.count("*").alias("n"))


@register(f"WITH {LAT}, {BMU} SELECT round(avg(sqrt(d2)), 6) AS quantization_error, count(*) AS n_points FROM bm")
def quantization_error(spark, sf):
    return r6(bmu.quantization_error(bmu.project(pts(spark, sf), lat(spark, sf), X)), "quantization_error")


@register(f"WITH {LAT}, {BMU}, two AS (SELECT point_id, max(CASE WHEN k = 1 THEN node END) AS a, max(CASE WHEN k = 2 THEN node END) AS b FROM rk WHERE k <= 2 GROUP BY 1) SELECT round(avg(CASE WHEN sqrt((a % 6 - b % 6) * (a % 6 - b % 6) + (a // 6 - b // 6) * (a // 6 - b // 6)) < 2 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n_points FROM two")
def topographic_accuracy(spark, sf):
    return r6(bmu.topographic_accuracy(pts(spark, sf), lat(spark, sf), X), "accuracy")


@register(f"WITH {LAT}, {BMU} SELECT point_id, node, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(d2, 6) AS d2, label FROM bm")
def project_points(spark, sf):
    return r6(bmu.project(pts(spark, sf), lat(spark, sf), X, ["label"]), "d2")


@register(f"WITH {LAT}, {BMU} SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n, arg_min(label, point_id) AS first_label FROM bm GROUP BY 1, 2")
def cell_histogram(spark, sf):
    return bmu.cell_histogram(bmu.project(pts(spark, sf), lat(spark, sf), X, ["label"]))


# -- training


_OUT = ", ".join(f"round(w[{i}], 6) AS w{i}" for i in range(1, DIM + 1))


def _weights(df: DataFrame) -> DataFrame:
    return df.select("node", *[F.round(F.get("w", F.lit(i)), 6).alias(f"w{i + 1}") for i in range(DIM)])


@register(f"WITH {PTS}, {START}, {_epoch('st', 'e1', 4)} SELECT node, {_OUT} FROM e1")
def som_batch_epoch_1(spark, sf):
    return _weights(train.train_batch(pts(spark, sf), X, Y, [4]))


@register(f"WITH {PTS}, {START}, {_epoch('st', 'e1', 4)}, {_epoch('e1', 'e2', 2)} SELECT node, {_OUT} FROM e2")
def som_batch_epoch_2(spark, sf):
    return _weights(train.train_batch(pts(spark, sf), X, Y, [4, 2]))


@register()
def som_online_train(spark, sf):
    p = scaling.two_sigma(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    p = p.select(F.col("p_partkey").alias("point_id"), F.array("p_size", "p_retailprice").alias("f"))
    return train.sweep(p, {"online": L.SomParams(X, Y, 0.5, 2000)})


_D2L = "list_transform(w, lambda q: (q[1] - f[1]) * (q[1] - f[1]) + (q[2] - f[2]) * (q[2] - f[2]))"
_NEAR = "greatest(abs((i - 1) % 6 - c % 6), abs((i - 1) // 6 - c // 6))"


@register(f"""WITH RECURSIVE d AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS s, [(p_size - (SELECT avg(p_size) FROM part)) / (2 * (SELECT stddev_pop(p_size) FROM part)), (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (2 * (SELECT stddev_pop(p_retailprice) FROM part))] AS f FROM part),
st(s, w) AS (SELECT CAST(0 AS BIGINT), list_transform(range(30), lambda i: [(i % 6) / 5.0 - 0.5, (i // 6) / 4.0 - 0.5]) UNION ALL
 SELECT s + 1, list_transform(range(1, 31), lambda i: [w[i][1] - CASE WHEN {_NEAR} <= 7 THEN 0.5 * exp(-({_NEAR} * {_NEAR}) / (2 * (7 / 3.0) * (7 / 3.0))) ELSE 0 END * (w[i][1] - f[1]), w[i][2] - CASE WHEN {_NEAR} <= 7 THEN 0.5 * exp(-({_NEAR} * {_NEAR}) / (2 * (7 / 3.0) * (7 / 3.0))) ELSE 0 END * (w[i][2] - f[2])])
 FROM (SELECT st.s, st.w, d.f, list_position({_D2L}, list_min({_D2L})) - 1 AS c FROM st JOIN d ON d.s = st.s WHERE st.s < 150))
SELECT CAST(i AS INTEGER) AS node, round(w[i + 1][1], 6) AS w1, round(w[i + 1][2], 6) AS w2 FROM (SELECT w, unnest(range(30)) AS i FROM st WHERE s = 150)""")
def som_online_ordered(spark, sf):
    """150 steps over the rows in id order from a given lattice: the step by step trainer, restarted once."""
    p = scaling.two_sigma(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    p = p.select(F.col("p_partkey").alias("point_id"), F.array("p_size", "p_retailprice").alias("f"))
    start = spark.range(30).select(F.lit(0).cast("long").alias("epoch"), F.lit(0.5).alias("alpha"), F.col("id").cast("int").alias("node"), F.array((F.col("id") % 6) / 5.0 - 0.5, F.floor(F.col("id") / 6) / 4.0 - 0.5).alias("w"))
    out = train.train_lattice(p, L.SomParams(X, Y, 0.5, 150, "static"), restart=start, shuffled=False)
    return train.last_lattice(out).select("node", *[F.round(F.get("w", F.lit(i)), 6).alias(f"w{i + 1}") for i in (0, 1)])


@register()
def som_snapshots(spark, sf):
    """The lattice after every 500 of 2000 steps, written by step and read back."""
    out = train.train_lattice(pts(spark, sf), L.SomParams(X, Y, 0.3, 2000), snapshot_every=500)
    path = shared_path(spark, "snapshots")
    io.write_snapshots(out, path)
    return spark.read.parquet(path)


@register()
def som_sweep(spark, sf):
    params = {f"{a}-{t}-{x}": L.SomParams(x, 5, a, t) for a in (0.1, 0.5) for t in (500, 1000) for x in (5, 6)}
    return train.sweep(pts(spark, sf), params)


# -- lattice maps


@register(f"WITH {LAT}, {NB} SELECT x, y, round(heat, 6) AS heat FROM um")
def umatrix(spark, sf):
    return r6(umat(spark, sf), "heat")


@register(f"WITH {LAT}, {NB} SELECT x, y, round(raw, 6) AS heat FROM nb")
def umatrix_legacy(spark, sf):
    return r6(lattice_maps.umatrix(lat(spark, sf), False), "heat")


@register(f"WITH {LAT}, {NB}, pr AS (SELECT a.x, a.y, b.heat, exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 4.0) AS g FROM um a, um b) SELECT x, y, round(sum(g * heat) / sum(g), 6) AS heat FROM pr GROUP BY 1, 2")
def umatrix_smooth(spark, sf):
    return r6(lattice_maps.smooth(umat(spark, sf), 2.0), "heat")


@register(f"WITH {LAT}, {NB}, m AS (SELECT min(heat) AS lo, max(heat) AS hi FROM um) SELECT x, y, CAST(least(100, floor((heat - lo) / (hi - lo) * 100 + 1e-9) + 1) AS INTEGER) AS bin FROM um, m")
def umatrix_digitised(spark, sf):
    return lattice_maps.digitised(umat(spark, sf))


@register(f"{LATQ} SELECT x, y, nx, ny FROM de")
def centroids_explicit(spark, sf):
    return lattice_maps.descent(umat(spark, sf))


@register(f"{LATQ} SELECT x, y, cx, cy FROM ce")
def centroids(spark, sf):
    return cents(spark, sf)


@register(f"{LATQ} SELECT cx, cy, count(*) AS nodes FROM ce GROUP BY 1, 2")
def unique_centroids(spark, sf):
    return lattice_maps.unique_centroids(cents(spark, sf))


@register(f"{LATQ} SELECT x, y, cluster_id FROM cl")
def lattice_clusters(spark, sf):
    return lattice_maps.lattice_clusters(cents(spark, sf))


@register(f"{LATQ} SELECT point_id, cluster_id FROM bm JOIN cl ON bm.x = cl.x AND bm.y = cl.y")
def label_points(spark, sf):
    return bmu.label_points(bmu.project(pts(spark, sf), lat(spark, sf), X), lattice_maps.lattice_clusters(cents(spark, sf)))


_SMOOTH = f"{LAT}, {NB.replace('um AS', 'u0 AS')}, um AS MATERIALIZED (SELECT a.x, a.y, sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.64) * b.heat) / sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 0.64)) AS heat FROM u0 a, u0 b GROUP BY 1, 2)"


@register(f"WITH RECURSIVE {_SMOOTH}, {CENT}, {CLUS} SELECT x, y, cluster_id FROM cl")
def assign_clusters_smoothed(spark, sf):
    """From the trained lattice to clusters in one call, with a smoothed U-matrix."""
    return lattice_maps.assign_clusters(lat(spark, sf), 0.8)


@register()
def assign_clusters_merged(spark, sf):
    """The same with centroids merged at a relative cost below 0.2; the spline has no counterpart in SQL."""
    return lattice_maps.assign_clusters(lat(spark, sf), 0.8, 0.2)


@register()
def combine_clusters(spark, sf):
    return lattice_maps.combine_clusters(umat(spark, sf), cents(spark, sf))


@register()
def merge_centroids(spark, sf):
    return lattice_maps.merge_centroids(umat(spark, sf), cents(spark, sf), 0.3)


@register(f"{LATQ} SELECT cx, cy, array_to_string(list(CAST(CAST(round(heat * 1000000) AS BIGINT) AS VARCHAR) ORDER BY heat), ',') AS heats FROM um JOIN ce ON um.x = ce.x AND um.y = ce.y GROUP BY 1, 2")
def cluster_elements(spark, sf):
    out = lattice_maps.cluster_elements(umat(spark, sf), cents(spark, sf))
    return out.withColumn("heats", F.concat_ws(",", F.transform("heats", lambda h: F.round(h * 1000000).cast("long").cast("string"))))


@register(f"{LATQ} SELECT ce.cx, ce.cy, round(avg(abs(a.heat - b.heat)), 6) AS spread FROM um a JOIN ce ON a.x = ce.x AND a.y = ce.y JOIN um b ON b.x = ce.cx AND b.y = ce.cy GROUP BY 1, 2")
def cluster_spread(spark, sf):
    return r6(lattice_maps.cluster_spread(umat(spark, sf), cents(spark, sf)), "spread")


_BETW = f"""{LATQ}, pl AS (SELECT ce.cx, ce.cy, heat, row_number() OVER (PARTITION BY cx, cy ORDER BY um.x, um.y) AS k FROM um JOIN ce ON um.x = ce.x AND um.y = ce.y),
bt AS (SELECT a.cx, a.cy, b.cx AS ox, b.cy AS oy, coalesce(avg(CASE WHEN abs(a.heat - b.heat) > 0 THEN abs(a.heat - b.heat) END), 0.0) AS distance FROM pl a JOIN pl b ON a.k = b.k AND (a.cx < b.cx OR a.cx = b.cx AND a.cy < b.cy) WHERE a.heat <> 0 AND b.heat <> 0 GROUP BY 1, 2, 3, 4)"""


@register(f"{_BETW} SELECT cx, cy, ox, oy, round(distance, 6) AS distance FROM bt")
def cluster_between(spark, sf):
    return r6(lattice_maps.between_clusters(umat(spark, sf), cents(spark, sf)), "distance")


@register(f"{_BETW}, sp AS (SELECT ce.cx, ce.cy, avg(abs(a.heat - b.heat)) AS s FROM um a JOIN ce ON a.x = ce.x AND a.y = ce.y JOIN um b ON b.x = ce.cx AND b.y = ce.cy GROUP BY 1, 2) SELECT bt.cx, bt.cy, bt.ox, bt.oy, distance < greatest(p.s, q.s) * 1.15 AS combine FROM bt JOIN sp p ON p.cx = bt.cx AND p.cy = bt.cy JOIN sp q ON q.cx = bt.ox AND q.cy = bt.oy")
def cluster_combine_decision(spark, sf):
    u, c = umat(spark, sf), cents(spark, sf)
    return lattice_maps.combinable(lattice_maps.cluster_spread(u, c), lattice_maps.between_clusters(u, c))


# -- ensembles


@register(f"WITH {ENS} SELECT * FROM runs")
def ensemble_labels(spark, sf):
    return runs(spark, sf)


@register(f"WITH {ENS} SELECT DISTINCT run_id FROM runs")
def ensemble_runs(spark, sf):
    return io.runs(runs(spark, sf))


@register(f"WITH {ENS} SELECT run_id, count(DISTINCT cluster_id) AS n_clusters FROM runs GROUP BY 1")
def ensemble_cluster_counts(spark, sf):
    return ensemble.cluster_counts(runs(spark, sf))


@register(f"WITH {ENS} SELECT point_id, CAST(CASE WHEN cluster_id = 1 THEN 1 ELSE 0 END AS INTEGER) AS mask FROM runs WHERE run_id = 'status'")
def cluster_mask(spark, sf):
    return ensemble.masks(runs(spark, sf), "status", 1)


@register(f"{ENSQ} SELECT run_a, id_a, run_b, id_b, n_inter FROM ix")
def cluster_overlap(spark, sf):
    return ensemble.overlaps(runs(spark, sf))


@register(f"{ENSQ} SELECT run_a, id_a, run_b, id_b, n_inter, n_a, n_b, round(sq, 6) AS sq FROM sq")
def cluster_sq(spark, sf):
    r = runs(spark, sf)
    return r6(ensemble.quality(ensemble.overlaps(r), r), "sq")


@register(f"{ENSQ} SELECT run_id, cluster_id, round(gsum, 4) AS gsum FROM gs")
def gsum(spark, sf):
    return ensemble.gsum(runs(spark, sf)).withColumn("gsum", F.round("gsum", 4))


@register(f"{ENSQ} SELECT run_id, cluster_id, round(gsum, 4) AS gsum, rank FROM rk")
def gsum_ranked(spark, sf):
    return ensemble.ranked(ensemble.gsum(runs(spark, sf))).withColumn("gsum", F.round("gsum", 4))


@register(f"{ENSQ} SELECT point_id, round(sum(gsum), 4) AS signal FROM runs JOIN gs ON runs.run_id = gs.run_id AND runs.cluster_id = gs.cluster_id GROUP BY 1")
def sce_signal(spark, sf):
    r = runs(spark, sf)
    return ensemble.signal(r, ensemble.gsum(r)).withColumn("signal", F.round("signal", 4))


@register(f"{ENSQ}, sg AS (SELECT point_id, sum(gsum) AS signal FROM runs JOIN gs ON runs.run_id = gs.run_id AND runs.cluster_id = gs.cluster_id GROUP BY 1) SELECT CAST(CASE WHEN signal < 4.0 THEN 0 WHEN signal < 6.0 THEN 1 ELSE 2 END AS INTEGER) AS class, count(*) AS n FROM sg GROUP BY 1")
def sce_classes(spark, sf):
    r = runs(spark, sf)
    return ensemble.classes(ensemble.signal(r, ensemble.gsum(r)), [4.0, 6.0]).groupBy("class").agg(F.count("*").alias("n"))


def _fits(n: int, window: int, order: int, deriv: int) -> str:
    """Rows (out, inp, c): each smoothed value as a sum over its window, from least squares by normal equations."""
    half, rows = window // 2, []
    for i in range(n):
        first = min(max(i - (half if window % 2 else half - 1), 0), n - window)
        inner = half <= i < n - half
        at = (window - 1) / 2 if inner else i - first  # an even window is centred between samples
        x = [[float(t - at) ** p for p in range(order + 1)] for t in range(window)]
        gram = [[sum(r[p] * r[q] for r in x) for q in range(order + 1)] for p in range(order + 1)]
        unit = [float(p == deriv) for p in range(order + 1)]
        for p in range(order + 1):  # Gauss-Jordan with the largest pivot
            best = max(range(p, order + 1), key=lambda q: abs(gram[q][p]))
            gram[p], gram[best], unit[p], unit[best] = gram[best], gram[p], unit[best], unit[p]
            for q in range(order + 1):
                if q != p:
                    f = gram[q][p] / gram[p][p]
                    gram[q], unit[q] = [a - f * b for a, b in zip(gram[q], gram[p], strict=True)], unit[q] - f * unit[p]
        weights = [unit[p] / gram[p][p] for p in range(order + 1)]
        rows += [f"({i}, {first + t}, CAST({sum(w * v for w, v in zip(weights, x[t], strict=True))!r} AS DOUBLE))" for t in range(window)]
    return ", ".join(rows)


@register(f"""WITH r AS (SELECT CAST(row_number() OVER (ORDER BY gsum DESC) - 1 AS INTEGER) AS rank, gsum FROM (SELECT sum(c_acctbal) AS gsum FROM customer GROUP BY c_nationkey, c_mktsegment)),
a(o, i, c) AS (VALUES {_fits(125, 12, 4, 0)}), b(o, i, c) AS (VALUES {_fits(125, 12, 4, 1)}),
s AS (SELECT o AS rank, sum(c * gsum) AS smooth FROM a JOIN r ON r.rank = a.i GROUP BY 1), d AS (SELECT o AS rank, sum(c * smooth) AS slope FROM b JOIN s ON s.rank = b.i GROUP BY 1)
SELECT r.rank, round(gsum, 4) AS gsum, round(smooth, 4) AS smooth, round(CASE WHEN smooth <> 0 THEN slope / smooth END, 6) AS slope FROM r JOIN s USING (rank) JOIN d USING (rank)""")
def savgol_smooth(spark, sf):
    rows = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("gsum"))
    out = ensemble.smoothed(rows.select((F.row_number().over(Window.orderBy(F.desc("gsum"))) - 1).alias("rank"), "gsum"))
    return out.select("rank", F.round("gsum", 4).alias("gsum"), F.round("smooth", 4).alias("smooth"), F.round("slope", 6).alias("slope"))


def _series(spark, sf):
    day = table(spark, sf, "events").groupBy((F.dayofmonth("ts") - 1).cast("int").alias("i")).agg(F.sum("value").alias("s"))
    return day.select("i", (F.col("s") - F.coalesce(F.lag("s").over(Window.orderBy("i")), F.col("s"))).alias("d"))


_SEG = f"""WITH {SERIES}, w AS (SELECT i, d, lag(d) OVER (ORDER BY i) AS p, lead(d) OVER (ORDER BY i) AS n FROM series),
g AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND d > 0 THEN 1 ELSE 0 END) OVER (ORDER BY i) AS g FROM w),
c AS (SELECT i, row_number() OVER (PARTITION BY g ORDER BY i) AS k FROM g WHERE d < 0 AND d < p AND d < n AND g > 0),
m AS (SELECT i, row_number() OVER (ORDER BY i) AS k FROM c WHERE k = 1),
cut AS (SELECT i FROM m WHERE k > 1 UNION ALL SELECT max(i) + 1 FROM series),
rg AS (SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS seg, CAST(coalesce(lag(i) OVER (ORDER BY i), 0) AS INTEGER) AS lo, CAST(i AS INTEGER) AS hi FROM cut)"""


@register(f"{_SEG} SELECT seg, lo, hi FROM rg")
def sce_segments(spark, sf):
    return ensemble.segments(_series(spark, sf), 0.0)


_RNG = "(VALUES (0, 0, 4), (1, 4, 9), (2, 9, 100)) v(seg, lo, hi)"


@register(f"{ENSQ}, v AS (SELECT * FROM {_RNG}), own AS (SELECT v.seg, r.point_id, sum(rk.gsum) AS s FROM runs r JOIN rk ON r.run_id = rk.run_id AND r.cluster_id = rk.cluster_id JOIN v ON rk.rank >= lo AND rk.rank < hi GROUP BY 1, 2) SELECT CAST(v.seg AS INTEGER) AS sce_cluster, p.point_id, round(coalesce(own.s, 0.0), 4) AS signal FROM (SELECT DISTINCT point_id FROM runs) p CROSS JOIN v LEFT JOIN own ON own.seg = v.seg AND own.point_id = p.point_id")
def sce_combined(spark, sf):
    r = runs(spark, sf)
    ranges = spark.createDataFrame([(0, 0, 4), (1, 4, 9), (2, 9, 100)], "seg int, lo int, hi int")
    return ensemble.combined(r, ensemble.ranked(ensemble.gsum(r)), ranges).withColumn("signal", F.round("signal", 4))


# -- quality


@register("WITH v AS (SELECT 'p_size' AS feature, var_pop(p_size) AS v FROM part UNION ALL SELECT 'p_retailprice', var_pop(p_retailprice) FROM part) SELECT feature, round(v / (SELECT sum(v) FROM v), 6) AS significance FROM v")
def feature_significance(spark, sf):
    return r6(quality.significance(table(spark, sf, "part"), ["p_size", "p_retailprice"]), "significance")


FEATURES = [f"f{i + 1}" for i in range(DIM)]


def _cols(df: DataFrame, src: str) -> DataFrame:
    return df.select(*[F.get(src, F.lit(i)).alias(f"f{i + 1}") for i in range(DIM)])


_VM = " UNION ALL ".join(f"SELECT 'f{i}' AS feature, round(a.v / b.v, 6) AS ratio, round(a.m - b.m, 6) AS diff, round(sqrt(a.v / a.n + b.v / b.n), 6) AS se, a.n AS n_a, b.n AS n_b FROM (SELECT count(*) AS n, avg(f[{i}]) AS m, var_samp(f[{i}]) AS v FROM pts) a, (SELECT count(*) AS n, avg(w[{i}]) AS m, var_samp(w[{i}]) AS v FROM lat) b" for i in range(1, DIM + 1))


@register(f"WITH {LAT} {_VM}")
def embed_vm_ratio(spark, sf):
    return r6(quality.variance_mean(_cols(pts(spark, sf), "f"), _cols(lat(spark, sf), "w"), FEATURES), "ratio", "diff", "se")


_KS = " UNION ALL ".join(f"SELECT 'f{i}' AS feature, f[{i}] AS v, 1 AS s FROM pts UNION ALL SELECT 'f{i}', w[{i}], 0 FROM lat" for i in range(1, DIM + 1))


@register(f"WITH {LAT}, u AS ({_KS}), g AS (SELECT feature, v, sum(s) AS a, sum(1 - s) AS b FROM u GROUP BY 1, 2), c AS (SELECT feature, abs(sum(a) OVER (PARTITION BY feature ORDER BY v) / (SELECT count(*) FROM pts) - sum(b) OVER (PARTITION BY feature ORDER BY v) / (SELECT count(*) FROM lat)) AS d FROM g) SELECT feature, round(max(d), 6) AS d FROM c GROUP BY 1")
def embed_ks_stat(spark, sf):
    return r6(quality.ks_statistic(_cols(pts(spark, sf), "f"), _cols(lat(spark, sf), "w"), FEATURES), "d")


@register()
def convergence_index(spark, sf):
    p, n = pts(spark, sf), lat(spark, sf)
    cols = FEATURES
    topo = bmu.topographic_accuracy(p, n, X).first()["accuracy"]
    vm, ks = quality.embedding_accuracy(_cols(p, "f"), _cols(n, "w"), cols), quality.embedding_accuracy_ks(_cols(p, "f"), _cols(n, "w"), cols)
    low, high = quality.bootstrap_interval(bmu.best_matches(p, n), "d2")
    return spark.createDataFrame([(float(vm), float(ks), float(topo), quality.convergence(vm, topo), low, high)], "embed_vm double, embed_ks double, topo double, convergence double, d2_low double, d2_high double")


@register("SELECT CAST(CASE WHEN l_quantity < 1 THEN 0 WHEN l_quantity >= 50 THEN 11 ELSE floor((l_quantity - 1) / 49 * 10) + 1 END AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def marginal_histogram(spark, sf):
    return quality.marginal(table(spark, sf, "lineitem"), "l_quantity", 1.0, 50.0, 10)


@register(f"""{LATQ}, pc AS (SELECT bm.label, cl.cluster_id FROM bm JOIN cl ON bm.x = cl.x AND bm.y = cl.y), cn AS (SELECT cluster_id, label, count(*) AS n FROM pc GROUP BY 1, 2),
 pr AS (SELECT cluster_id, label AS pred FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, label) AS k FROM cn) WHERE k = 1),
 nm AS (SELECT cn.*, pr.pred FROM cn JOIN pr ON cn.cluster_id = pr.cluster_id), sz AS (SELECT label, sum(n) AS size, sum(CASE WHEN pred = label THEN n ELSE 0 END) AS tp FROM nm GROUP BY 1), ca AS (SELECT pred, sum(n) AS called FROM nm GROUP BY 1)
 SELECT sz.label, CAST(tp AS BIGINT) AS tp, CAST(coalesce(called, 0) - tp AS BIGINT) AS fp, CAST(size - tp AS BIGINT) AS fn, round(CASE WHEN coalesce(called, 0) > 0 THEN tp / called ELSE 0.0 END, 6) AS prec, round(tp / size, 6) AS recall FROM sz LEFT JOIN ca ON ca.pred = sz.label""")
def accuracy_precision_recall(spark, sf):
    lab = bmu.label_points(bmu.project(pts(spark, sf), lat(spark, sf), X, ["label"]), lattice_maps.lattice_clusters(cents(spark, sf)), ["label"])
    return r6(bmu.accuracy(lab), "prec", "recall")


# -- fields


def _field(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").alias("b1"), (F.col("l_discount") * 100).alias("b2"), (F.col("l_tax") * 100).alias("b3"), (F.col("l_extendedprice") / 1000).alias("jx"), F.col("l_quantity").alias("jy"), (F.col("l_tax") * 50).alias("jz"))


_FIELD = "f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity AS b1, l_discount * 100 AS b2, l_tax * 100 AS b3, l_extendedprice / 1000 AS jx, l_quantity AS jy, l_tax * 50 AS jz FROM lineitem)"
_KEY = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
_KEYS = _KEY.split(", ")


@register(f"WITH {_FIELD} SELECT {_KEY}, round(sqrt(b1 * b1 + b2 * b2 + b3 * b3), 6) AS b, round(sqrt(b1 * b1 + b2 * b2), 6) AS b_perp, round(b1 * jx + b2 * jy + b3 * jz, 6) AS bj FROM f")
def vector_features(spark, sf):
    b, j = [F.col(c) for c in ("b1", "b2", "b3")], [F.col(c) for c in ("jx", "jy", "jz")]
    return _field(spark, sf).select(*_KEYS, F.round(L.magnitude(*b), 6).alias("b"), F.round(L.magnitude(*b[:2]), 6).alias("b_perp"), F.round(L.dot(b, j), 6).alias("bj"))


@register(f"WITH {_FIELD}, m AS (SELECT *, (b1 * jx + b2 * jy + b3 * jz) / sqrt(b1 * b1 + b2 * b2 + b3 * b3) AS p, jx * jx + jy * jy + jz * jz AS j2 FROM f) SELECT {_KEY}, round(p, 6) AS j_par, round(abs(p), 6) AS j_par_abs, round(sqrt(greatest(j2 - p * p, 0)), 4) AS j_perp FROM m")
def parallel_perp(spark, sf):
    b, j = [F.col(c) for c in ("b1", "b2", "b3")], [F.col(c) for c in ("jx", "jy", "jz")]
    p = L.dot(b, j) / L.magnitude(*b)
    return _field(spark, sf).select(*_KEYS, F.round(p, 6).alias("j_par"), F.round(F.abs(p), 6).alias("j_par_abs"), F.round(F.sqrt(F.greatest(L.dot(j, j) - p * p, F.lit(0.0))), 4).alias("j_perp"))


@register(f"SELECT {_KEY}, CAST(least(greatest(l_extendedprice, 0), 18000) AS DOUBLE) AS v FROM lineitem")
def clip_field(spark, sf):
    return table(spark, sf, "lineitem").select(*_KEYS, L.clip(F.col("l_extendedprice"), 0.0, 18000.0).alias("v"))


@register(f"WITH {_FIELD} SELECT round(sqrt(avg(jz * jz)), 6) AS rms, count(*) AS n FROM f")
def rms_field(spark, sf):
    return _field(spark, sf).agg(F.round(F.sqrt(F.avg(F.col("jz") * F.col("jz"))), 6).alias("rms"), F.count("*").alias("n"))


@register(f"WITH {_FIELD} SELECT {_KEY}, round(b1 / 2.0, 6) AS b1, round(b2 / 2.0, 6) AS b2, round(jz / 0.5, 6) AS jz FROM f")
def normalise_fields(spark, sf):
    norms = {"b1": 2.0, "b2": 2.0, "jz": 0.5}
    return _field(spark, sf).select(*_KEYS, *[F.round(F.col(c) / n, 6).alias(c) for c, n in norms.items()])


def _grad(c: str) -> str:
    others = [x for x in "ijk" if x != c]
    w = f"OVER (PARTITION BY {others[0]}, {others[1]} ORDER BY {c})"
    return f"round((coalesce(lead(v) {w}, v) - coalesce(lag(v) {w}, v)) / CASE WHEN lag(v) {w} IS NULL OR lead(v) {w} IS NULL THEN 1.0 ELSE 2.0 END, 6) AS g_{c}"


@register(f"WITH {CUBE} SELECT i, j, k, {_grad('i')}, {_grad('j')}, {_grad('k')} FROM cells")
def grid_gradient(spark, sf):
    return r6(grid.gradient(cube(spark), "v").drop("v"), "g_i", "g_j", "g_k")


@register(f"WITH {CUBE} SELECT i // 2 AS i, j // 2 AS j, k // 2 AS k, CAST(v AS DOUBLE) AS v FROM cells WHERE i % 2 = 0 AND j % 2 = 0 AND k % 2 = 0")
def grid_downsample(spark, sf):
    return grid.downsample(cube(spark), 2)


@register(f"WITH {CUBE} SELECT i - 2 AS i, j - 2 AS j, k - 2 AS k, CAST(v AS DOUBLE) AS v, CAST((i * 8 + j) * 8 + k - 146 AS BIGINT) AS point_id FROM cells WHERE i BETWEEN 2 AND 4 AND j BETWEEN 2 AND 4 AND k BETWEEN 2 AND 4")
def grid_crop(spark, sf):
    return grid.flatten(grid.crop(cube(spark), 2, 3), 8, 8)


@register(f"WITH {CUBE} SELECT i // 4 AS i, j // 4 AS j, k // 4 AS k, round(avg(v) + 1e-9, 5) AS v FROM cells GROUP BY 1, 2, 3")
def grid_block_mean(spark, sf):
    return grid.block_mean(cube(spark), "v", 4).withColumn("v", F.round(F.col("v") + 1e-9, 5))


@register(f"WITH {CUBE}, o AS (SELECT a.d AS a, b.d AS b, c.d AS c FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d)) SELECT (i + a + 8) % 8 AS i, (j + b + 8) % 8 AS j, (k + c + 8) % 8 AS k, round(sum(v) / 27, 6) AS v FROM cells, o GROUP BY 1, 2, 3")
def grid_convolve(spark, sf):
    return r6(grid.convolve(cube(spark), "v", 8), "v")


@register(f"WITH {CUBE}, bl AS (SELECT i // 2 AS i, j // 2 AS j, k // 2 AS k, avg(v) AS v FROM cells GROUP BY 1, 2, 3), o AS (SELECT a.d AS a, b.d AS b, c.d AS c FROM (VALUES (-1), (0), (1)) a(d), (VALUES (-1), (0), (1)) b(d), (VALUES (-1), (0), (1)) c(d)), cv AS (SELECT (i + a + 4) % 4 AS i, (j + b + 4) % 4 AS j, (k + c + 4) % 4 AS k, sum(v) / 27 AS v FROM bl, o GROUP BY 1, 2, 3) SELECT c.i, c.j, c.k, round(cv.v, 6) AS v FROM cells c JOIN cv ON cv.i = c.i // 2 AND cv.j = c.j // 2 AND cv.k = c.k // 2")
def grid_coarse_convolution(spark, sf):
    return r6(grid.coarse_convolution(cube(spark), "v", 8, 2), "v")


@register("SELECT CAST(id // 64 AS INTEGER) AS i, CAST(id // 8 % 8 AS INTEGER) AS j, CAST(id % 8 AS INTEGER) AS k, round((id % 31) / (1.6 * 2 * 4 * 27), 6) AS rho, CAST(id % 7 AS DOUBLE) AS jx, round((id % 5) / 0.25, 6) AS bx FROM range(512) r(id)")
def grid_read_box(spark, sf):
    """A box stored as one flat array for each field, with physical norms."""
    path = shared_path(spark, "box")
    names = {"rho": 31, "jx": 7, "bx": 5}
    flat = [F.array_sort(F.collect_list(F.struct("id", (F.col("id") % m).cast("double").alias("v"))))["v"].alias(c) for c, m in names.items()]
    spark.range(512).agg(*flat).write.parquet(path)
    box = grid.read_box(spark.read.parquet(path), (8, 8, 8), list(names))
    return r6(grid.normalised(box, list(names), grid.Units(ppc=4, stride=3, charge=-1.6, cfl=0.45, b0=0.25)), *names)


@register()
def grid_directional_convolution(spark, sf):
    """Rotated 19 x 19 kernels along the gradient of the field itself."""
    g = grid.gradient(cube(spark), "v")
    return grid.directional(g.withColumns({"n_j": F.col("g_j"), "n_k": F.col("g_k")}), "v", *grid.edge_kernels(19))


# -- text forms and streams

_LINES = ["cluster-1", "1 0.5", "2 0.3", "cluster-2", "3 0.7", "4 2e-1"]


@register("SELECT * FROM (VALUES ('cluster-1', 1, 1, CAST(0.5 AS DOUBLE)), ('cluster-1', 1, 2, CAST(0.3 AS DOUBLE)), ('cluster-2', 2, 3, CAST(0.7 AS DOUBLE)), ('cluster-2', 2, 4, CAST(0.2 AS DOUBLE))) t(run_id, run_order, cluster_id, gsum)")
def gsum_text_parse(spark, sf):
    return io.parse_gsum(spark.createDataFrame(list(enumerate(_LINES)), "line_no int, line string"))


@register(f"{ENSQ}, r AS (SELECT run_id, cluster_id, CAST(round(gsum) AS BIGINT) AS g FROM gs) SELECT run_id AS line FROM (SELECT DISTINCT run_id FROM r) UNION ALL SELECT cluster_id || ' ' || g FROM r")
def gsum_text_write(spark, sf):
    return io.gsum_lines(ensemble.gsum(runs(spark, sf)).withColumn("gsum", F.round("gsum").cast("long")))


@register("SELECT n AS id, x || '-' || y || '-' || printf('%.2f', a) || '-' || t || '-' || b AS name FROM (VALUES (1, 40, 15, CAST(0.5 AS DOUBLE), 100000, 1), (2, 42, 16, CAST(0.1 AS DOUBLE), 10000, 3)) v(n, x, y, a, t, b)")
def run_name_format(spark, sf):
    d = spark.createDataFrame([(1, 40, 15, 0.5, 100000, 1), (2, 42, 16, 0.1, 10000, 3)], "id int, x int, y int, a double, t int, b int")
    return d.select("id", L.run_name(*[F.col(c) for c in "xyatb"]).alias("name"))


@register("SELECT id, (CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 4, '0') ELSE '0' || id END) || '.png' AS name FROM (VALUES (CAST(1 AS BIGINT)), (10), (100), (1000), (12345)) t(id)")
def rank_file_name(spark, sf):
    return spark.createDataFrame([(1,), (10,), (100,), (1000,), (12345,)], "id long").select("id", L.rank_file_name(F.col("id"), "png").alias("name"))


@register("SELECT 'features_1r2j1b0e_2800.h5' AS name")
def field_file_name(spark, sf):
    return spark.createDataFrame([(["rho", "jz", "j_par", "bx"], 2800)], "n array<string>, s int").select(L.field_file_name(F.col("n"), F.col("s")).alias("name"))


@register(f"WITH {LAT}, {BMU} SELECT point_id, node, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, round(d2, 6) AS d2 FROM bm")
def stream_score(spark, sf):
    """The points as a stream (all files, one trigger), scored and read back from the sink."""
    import uuid

    src = _stream(spark, sf, "embeddings")
    p = src.select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("f"))
    path = shared_path(spark, "scores")
    q = score.score_stream(p, lat(spark, sf), X).writeStream.format("parquet").option("path", path).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return r6(spark.read.schema("point_id long, node int, x int, y int, d2 double").parquet(path), "d2")


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(path if _is_dir(spark, path) else f"{sf}/{name}*.parquet")


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@register(f"WITH {PTS}, ev AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, CAST(event_id % 5 AS INTEGER) AS cluster_id FROM events) SELECT CAST(day AS VARCHAR) AS day, cluster_id, count(*) AS n FROM ev GROUP BY 1, 2")
def stream_window_counts(spark, sf):
    """The events as a stream; each trigger writes the counts of all windows so far."""
    e = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 5).cast("int").alias("cluster_id"))
    path = shared_path(spark, "counts")
    counts = score.windowed_counts(e).select(F.to_date("window.start").cast("string").alias("day"), "cluster_id", "n")
    q = counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).option("checkpointLocation", shared_path(spark, "offsets")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("day string, cluster_id int, n long").parquet(path)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Scale, train by batches, project, U-matrix, centroids, clusters, labels, histogram of labels."""
    wide = pts(spark, sf).select("point_id", "label", *[F.get("f", F.lit(i)).alias(f"f{i}") for i in range(DIM)])
    scaled = scaling.two_sigma(wide, [f"f{i}" for i in range(DIM)]).select("point_id", "label", F.array(*[f"f{i}" for i in range(DIM)]).alias("f"))
    trained = train.train_batch(scaled, X, Y, [4, 3, 2])
    labels = bmu.label_points(bmu.project(scaled, trained, X, ["label"]), lattice_maps.assign_clusters(trained), ["label"])
    return labels.groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
