"""Lattice and ensemble operators against numpy restatements, fixed facts and DuckDB."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework import cli
from latticework.functions import numerics
from latticework.functions.lattice import SomParams, lattice_size
from latticework.operators import bmu, ensemble, grid, lattice_maps, scaling, train
from latticework.plans import catalogue
from latticework.sources import io
from latticework.streaming import score

SF = "/root/testdata/sf0.01"
SAMPLE = ["bmu_kernel", "bmu_join", "umatrix", "centroids", "label_points", "cluster_sq", "gsum_ranked", "sce_segments", "som_batch_epoch_2", "training_schedule", "grid_gradient", "embed_ks_stat", "stream_score", "stream_window_counts", "som_online_ordered", "assign_clusters_smoothed", "savgol_smooth", "grid_coarse_convolution", "grid_read_box", "training_chunks", "cell_histogram", "accuracy_precision_recall"]


def rows(df):
    return sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(catalogue.SQL[name]).df())


def test_segments_example(spark):
    s = spark.createDataFrame(list(enumerate([1.0, -1.0, 2.0, -2.0, 3.0, -3.0, 4.0, -4.0, 5.0, -5.0, 6.0])), "i int, d double")
    assert [(r.lo, r.hi) for r in ensemble.segments(s, 2.0).orderBy("lo").collect()] == [(0, 7), (7, 9), (9, 11)]


def test_segments_without_minimum(spark):
    s = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "i int, d double")
    assert [(r.lo, r.hi) for r in ensemble.segments(s, 0.0).collect()] == [(0, 3)]


def test_quality_of_masks(spark):
    lab = [("a", p, c) for p, c in enumerate([1, 0, 0, 1])] + [("b", p, c) for p, c in enumerate([1, 1, 0, 0])]
    lab = spark.createDataFrame(lab, "run_id string, point_id long, cluster_id int")
    q = ensemble.quality(ensemble.overlaps(lab), lab).where("id_a = 1 and id_b = 1").first()
    assert (q.n_inter, round(q.sq, 4)) == (1, 0.6667)


def test_equal_clusters_add_nothing(spark):
    lab = spark.createDataFrame([(r, p, p % 2) for r in "ab" for p in range(6)], "run_id string, point_id long, cluster_id int")
    assert {r.gsum for r in ensemble.gsum(lab).collect()} == {0.0}


def test_gsum_text(spark):
    lines = spark.createDataFrame(list(enumerate(["cluster-1", "1 0.5", "2 0.3", "cluster-2", "3 0.7", "4 0.2"])), "line_no int, line string")
    got = ensemble.ranked(io.parse_gsum(lines)).orderBy("rank").collect()
    assert [r.gsum for r in got] == [0.7, 0.5, 0.3, 0.2]


def test_savgol_keeps_polynomials():
    x = np.arange(40.0)
    y = 1 + 2 * x - 0.3 * x**2 + 0.01 * x**3
    for window in (7, 12):
        got = numerics.savgol(y, window)
        inner = slice(window, -window)
        shift = 0.0 if window % 2 else 0.5
        want = np.polynomial.Polynomial([1, 2, -0.3, 0.01])(x + shift)
        assert np.allclose(got[inner], want[inner])


def test_spline_reproduces_grid():
    a = np.random.default_rng(1).random((7, 5))
    c = numerics.spline_coefficients(a)
    xs, ys = np.mgrid[:7, :5]
    assert np.allclose(numerics.spline_at(c, xs.ravel(), ys.ravel()), a.ravel())


def test_quantiles():
    assert abs(numerics.t_quantile(0.975, 10) - 2.228139) < 1e-5
    assert abs(numerics.f_quantile(0.95, 3, 10) - 3.708265) < 1e-5


def test_lattice_and_params():
    assert lattice_size(1_000_000, 6, 0.5) == (63, 32)
    with pytest.raises(ValueError):
        SomParams(3, 10)


def test_online_training_learns_and_restarts():
    data = np.random.default_rng(2).random((200, 3))
    p = SomParams(20, 10, 0.5, 4000, "static")
    w, epoch, _ = train.online(data, p)
    error = lambda w: np.sqrt(((data[:, None] - w) ** 2).sum(2).min(1)).mean()
    # the neighbourhood stays 8 wide, so the lattice is smooth; it is still better than one mean
    assert epoch == 4000 and error(w) < 0.7 * error(data.mean(0)[None])
    assert train.train_chunks([data[:100], data[100:]], p).shape == w.shape
    assert train.online_legacy(data, p).shape == w.shape


def test_merge_never_adds_clusters(spark):
    u = spark.createDataFrame([(x, y, float((x * 5 + y * 7) % 6) / 10) for x in range(6) for y in range(5)], "x int, y int, heat double")
    c = lattice_maps.centroids(u)
    before = lattice_maps.unique_centroids(c).count()
    after = lattice_maps.unique_centroids(lattice_maps.merge_centroids(u, c, 0.5)).count()
    assert 1 <= after <= before


def test_constant_and_null_columns(spark):
    d = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, None)], "id int, a double, b double")
    got = scaling.two_sigma(d, ["a", "b"]).orderBy("id").collect()
    assert [r.a for r in got] == [0.0, 0.0] and got[1].b is None


def test_labels_round_trip(spark, tmp_path):
    lab = spark.createDataFrame([("r1", 1, 0), ("r2", 1, 3)], "run_id string, point_id long, cluster_id int")
    io.write_labels(lab, f"{tmp_path}/labels")
    assert sorted(io.read_labels(spark, f"{tmp_path}/labels").collect()) == sorted(lab.collect())


def test_chunks_drop_the_rest(spark):
    got = scaling.chunks(spark.range(10), "id", 3).groupBy("chunk").agg(F.count("*").alias("n")).collect()
    assert sorted((r.chunk, r.n) for r in got) == [(0, 3), (1, 3), (2, 3)]


def lattice_of(spark, w, xdim):
    return spark.createDataFrame([(k, k % xdim, k // xdim, [float(v) for v in r]) for k, r in enumerate(w)], "node int, x int, y int, w array<double>")


def points_of(spark, rows, ids=None):
    return spark.createDataFrame([(int(i), [float(v) for v in r], int(k)) for k, (i, r) in enumerate(zip(ids if ids is not None else range(len(rows)), rows))], "point_id long, f array<double>, label int")


def test_best_matches_with_many_equal_nodes(spark):
    w = np.vstack([np.tile([1.0, 2.0, 3.0], (60, 1)), np.random.default_rng(1).normal(size=(40, 3))])
    x = np.vstack([np.tile([1.0, 2.0, 3.1], (5, 1)), np.random.default_rng(2).normal(size=(30, 3))])
    perm = np.random.default_rng(3).permutation(100)
    got = bmu.best_matches(points_of(spark, x), lattice_of(spark, w[perm], 10), 3).orderBy("point_id", "rank").collect()
    d2 = ((x[:, None] - w[perm]) ** 2).sum(2)
    want = np.argsort(d2, axis=1, kind="stable")[:, :3]
    assert [r.node for r in got] == want.ravel().tolist()


def test_repeated_ids_count_once_each(spark):
    p = points_of(spark, [[0.0], [10.0], [4.0]], [1, 1, 2])
    got = train.batch_epoch(p, lattice_of(spark, [[1.0]], 1), 1, 1).first()
    assert abs(got.w[0] - 14 / 3) < 1e-12
    two = lattice_of(spark, [[0.0], [10.0]], 2)
    assert bmu.topographic_accuracy(p, two, 2).first().n_points == 3
    assert sum(r.n for r in bmu.cell_histogram(bmu.project(p, two, 2, ["label"])).collect()) == 3


def test_centroids_of_a_large_lattice(spark):
    rng = np.random.default_rng(4)
    heat = rng.random((63, 32))
    u = spark.createDataFrame([(x, y, float(heat[x, y])) for x in range(63) for y in range(32)], "x int, y int, heat double")
    got = {(r.x, r.y): (r.cx, r.cy) for r in lattice_maps.centroids(u).collect()}
    for x in range(63):
        for y in range(32):
            at = (x, y)
            while True:
                near = [(at[0] + a, at[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= at[0] + a < 63 and 0 <= at[1] + b < 32]
                low = min(near, key=lambda p: heat[p])
                if heat[low] >= heat[at]:
                    break
                at = low
            assert got[x, y] == at


def test_assign_clusters_with_merging(spark):
    rng = np.random.default_rng(5)
    lat = lattice_of(spark, rng.normal(size=(80, 3)), 10)
    umat = lattice_maps.smooth(lattice_maps.umatrix(lat), 0.7)
    cents = lattice_maps.centroids(umat)
    heat = {(r.x, r.y): r.heat for r in umat.collect()}
    grid = np.asarray([[heat[x, y] for y in range(8)] for x in range(10)])
    coef = numerics.spline_coefficients(grid**2)
    to = {(r.x, r.y): (r.cx, r.cy) for r in cents.collect()}
    while True:  # the cheapest pair by a plain search over all pairs
        unique = sorted(set(to.values()))
        cost = {(a, b): numerics.spline_at(coef, np.linspace(a[0], b[0], n), np.linspace(a[1], b[1], n)).sum() for i, a in enumerate(unique) for b in unique[i + 1 :] for n in [5 * int(np.hypot(a[0] - b[0], a[1] - b[1]))]}
        best = min(cost, key=cost.get, default=None)
        if best is None or cost[best] / max(cost.values()) >= 0.2:
            break
        a, b = best
        old, new = (a, b) if list(to.values()).count(a) < list(to.values()).count(b) else (b, a)
        to = {k: new if v == old else v for k, v in to.items()}
    number = {c: i for i, c in enumerate(sorted(set(to.values())))}
    got = {(r.x, r.y): r.cluster_id for r in lattice_maps.assign_clusters(lat, 0.7, 0.2).collect()}
    assert got == {k: number[v] for k, v in to.items()} and len(number) < lattice_maps.unique_centroids(cents).count()


def test_training_restarts_where_it_stopped(spark, tmp_path):
    p = points_of(spark, np.random.default_rng(6).random((50, 3)))
    params = SomParams(5, 5, 0.4, 300, "static")
    out = train.train_lattice(p, params, snapshot_every=100)
    io.write_snapshots(out, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(r.epoch for r in back.select("epoch").distinct().collect()) == [100, 200, 300]
    more = train.train_lattice(p, params, restart=back)
    data = np.asarray([r.f for r in p.orderBy("point_id").collect()])
    w, epoch, _ = train.online(data, params, *train.online(data, params))
    assert epoch == 600 and np.allclose([r.w for r in train.last_lattice(more).orderBy("node").collect()], w)
    assert train.train_lattice(p, params, steps=10).agg(F.max("epoch")).first()[0] == 10


def test_stream_training_goes_on(spark):
    seen, params = [], SomParams(4, 4, 0.3, 50)
    step = score.train_stream(params, lambda w, epoch: seen.append(w.copy()))
    parts = [np.random.default_rng(i).random((20, 2)) for i in range(2)]
    for i, x in enumerate(parts):
        step(points_of(spark, x), i)
    assert np.allclose(seen[-1], train.train_chunks(parts, params))
    with pytest.raises(ValueError):
        score.train_stream(params, lambda w, e: None, 5)(points_of(spark, parts[0]), 0)


def test_directional_convolution_against_loops(spark):
    rng = np.random.default_rng(7)
    v, n = rng.random((2, 6, 7)), rng.normal(size=(2, 6, 7, 2))
    anti, sym = grid.edge_kernels(5)
    rows = [(i, j, k, float(v[i, j, k]), *map(float, n[i, j, k])) for i in range(2) for j in range(6) for k in range(7)]
    got = {(r.i, r.j, r.k): (r.anti, r.sym) for r in grid.directional(spark.createDataFrame(rows, "i int, j int, k int, v double, n_j double, n_k double"), "v", anti, sym).collect()}

    def at(kernel, y, x):
        y, x = min(max(y, 0.0), 4.0), min(max(x, 0.0), 4.0)
        a, b = min(int(y), 3), min(int(x), 3)
        return sum(kernel[a + p, b + q] * (y - a if p else 1 - y + a) * (x - b if q else 1 - x + b) for p in (0, 1) for q in (0, 1))

    for i, j, k in got:
        t = np.arctan2(n[i, j, k, 1], n[i, j, k, 0]) - np.pi / 2
        want = [sum(at(m, np.cos(t) * a + np.sin(t) * b + 2, np.cos(t) * b - np.sin(t) * a + 2) * v[i, (j + a) % 6, (k + b) % 7] for a in range(-2, 3) for b in range(-2, 3)) for m in (anti, sym)]
        assert np.allclose(got[i, j, k], want)


def test_sources(spark, tmp_path):
    np.save(tmp_path / "labels-a.npy", np.asarray([[0, 1], [2, 1]]))
    got = io.read_npy(spark, str(tmp_path / "*.npy"))
    assert sorted(tuple(r) for r in got.collect()) == [("labels-a", i, c) for i, c in enumerate([0, 1, 2, 1])]
    (tmp_path / "g1.txt").write_text("one\n1 0.5\n2 0.25\n")
    (tmp_path / "g2.txt").write_text("two\n7 1e-1\n")
    both = io.read_gsum(spark, str(tmp_path / "g*.txt")).select("run_id", "cluster_id", "gsum").collect()
    assert sorted(map(tuple, both)) == [("one", 1, 0.5), ("one", 2, 0.25), ("two", 7, 0.1)]
    spark.createDataFrame([(3, 1, 2.5)], "id int, a int, b double").write.parquet(str(tmp_path / "p"))
    assert io.read_points(spark, str(tmp_path / "p"), "id", ["a", "b"]).first().f == [1.0, 2.5]


def test_programs_from_files_to_files(spark, tmp_path):
    out = str(tmp_path / "out")
    for k, args in enumerate((["--batches", "3,2"], ["--train", "200"], ["--train", "300", "--smoothing", "0.6", "--merge-cost", "0.2"])):
        cli.main(["som", "--points", f"{SF}/part.parquet", "--id", "p_partkey", "--features", "p_size,p_retailprice", "--out", out, "--xdim", "8", "--ydim", "8", "--run-id", f"r{k}", *args])
    labels = io.read_labels(spark, f"{out}/labels")
    assert labels.count() == 3 * spark.read.parquet(f"{SF}/part.parquet").count()
    assert io.read_lattice(spark, f"{out}/models/r1")[1]["train"] == 200
    cli.main(["ensemble", "--labels", f"{out}/labels", "--out", out])
    clusters = labels.select("run_id", "cluster_id").distinct().count()
    assert spark.read.parquet(f"{out}/gsum").count() == io.read_gsum(spark, f"{out}/gsum_text/part-*").count() == clusters
    g = spark.createDataFrame([(f"r{k % 3}", k, float(100 - k + 20 * (k % 17 == 0))) for k in range(60)], "run_id string, cluster_id int, gsum double")
    g.write.parquet(f"{out}/many")
    cli.main(["segments", "--labels", f"{out}/labels", "--gsum", f"{out}/many", "--out", out, "--threshold", "0"])
    assert spark.read.parquet(f"{out}/combined").select("point_id").distinct().count() == labels.select("point_id").distinct().count()
