import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftmap.config import Settings
from driftmap.operators import browse, graph, indexing, pixels, similarity, spectral, zorder
from driftmap.plans import pipeline
from driftmap.sources import scratch
from driftmap.sources.scratch import materialize


def patterns(spark, values):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(values)], "global_idx long, pattern array<double>")


def dense(df, n, value="w"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r.i, r.j] = r[value]
    return out


@given(st.integers(0, 500), st.integers(1, 40))
@settings(max_examples=60, deadline=None)
def test_batch_arithmetic(total, batches):
    each, more = divmod(total, batches)
    sizes = [each + (b < more) for b in range(batches)]
    assert sum(sizes) == total and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)


def test_batches(spark):
    assert [r.n for r in indexing.batch_sizes(spark, 17, 5).orderBy("batch").collect()] == [4, 4, 3, 3, 3]
    rows = spark.range(17).select(F.col("id").alias("global_idx"), indexing.batch_of(F.col("id"), 17, 5).alias("batch"))
    assert [r["count"] for r in rows.groupBy("batch").count().orderBy("batch").collect()] == [4, 4, 3, 3, 3]
    assert [(r.start, r.end) for r in indexing.batch_ranges(spark, 17, 5).orderBy("batch").collect()] == [(0, 4), (4, 8), (8, 11), (11, 14), (14, 17)]
    assert [r.other for r in indexing.other_batches(spark, 4).where("batch = 2").orderBy("other").collect()] == [0, 1, 3]


def test_dense_index(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    assert indexing.dense_index(rows, ["x"]).where("x <> global_idx").count() == 0


def test_stats_and_masks(spark):
    rows = patterns(spark, [[1, 2, 3, 4], [3, 3, 3, 3]])
    got = pixels.with_stats(rows).orderBy("global_idx").collect()
    assert got[0].mean == 2.5 and got[0].std == pytest.approx(1.25**0.5) and got[1].std == 0
    kept = pixels.with_stats(rows, [1.0, 0.5, float("nan"), 0.0]).orderBy("global_idx").collect()
    assert kept[0].pattern == [1.0, 3.0]


@pytest.mark.parametrize("mode", similarity.MODES)
def test_neighbours_match_numpy(spark, mode):
    v = np.random.default_rng(1).normal(size=(40, 6))
    v[7] = 2.0  # no variance
    rows = pixels.with_stats(patterns(spark, v))
    c, m, s = v @ v.T / 6, v.mean(axis=1), v.std(axis=1)
    if mode in ("pearson", "covariance"):
        c = c - np.outer(m, m)
    if mode in ("pearson", "normalized"):
        c = np.where(np.outer(s, s) > 0, c / np.where(np.outer(s, s) > 0, np.outer(s, s), 1), -np.inf)
    want = [(i, j, r + 1) for i in range(40) for r, j in enumerate(np.argsort(-c[i], kind="stable")[:5]) if np.isfinite(c[i, j])]
    for found in (similarity.nearest(rows, 5, 6, mode), similarity.nearest(rows, 5, 6, mode, block_bytes=9 * 48, matrix_bytes=0), similarity.best(similarity.pair_scores(rows, 6, mode), 5)):
        assert sorted((r.i, r.j, r["rank"]) for r in found.collect()) == sorted(want)


def test_ties_go_to_the_smaller_index(spark, monkeypatch):
    monkeypatch.setattr(similarity, "SCORE_BYTES", 300)
    v = np.random.default_rng(6).integers(0, 2, size=(30, 3)).astype(float)
    c = v @ v.T / 3
    want = [(i, j, r + 1) for i in range(30) for r, j in enumerate(np.lexsort((np.arange(30), -c[i]))[:4])]
    rows = pixels.with_stats(patterns(spark, v))
    for found in (similarity.nearest(rows, 4, 3, "inner"), similarity.nearest(rows, 4, 3, "inner", block_bytes=7 * 24, matrix_bytes=0)):
        assert sorted((r.i, r.j, r["rank"]) for r in found.collect()) == sorted(want)


def test_patterns_of_65536_pixels(spark):
    """As large as 256 x 256; three patterns fill a block, so blocks meet in pairs."""
    size = 65_536
    value = lambda p: F.pmod(F.xxhash64("id", p), F.lit(1009)) / 1009.0
    rows = pixels.with_stats(spark.range(7).select(F.col("id").alias("global_idx"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), value).alias("pattern"))).cache()
    v = np.array([r.pattern for r in rows.orderBy("global_idx").collect()])
    want = np.corrcoef(v)
    got = similarity.nearest(rows, 3, size, block_bytes=3 * 8 * size, matrix_bytes=1).collect()
    assert len(got) == 21 and all(abs(r.value - want[r.i, r.j]) < 1e-9 for r in got)
    assert {(r.i, r.j) for r in got} == {(i, int(j)) for i in range(7) for j in np.argsort(-want[i])[:3]}
    rows.unpersist()


def test_fewer_patterns_than_neighbours(spark):
    rows = pixels.with_stats(patterns(spark, np.eye(3)))
    assert similarity.nearest(rows, 5, 3).count() == 9


def test_symmetrize_by_hand(spark):
    knn = spark.createDataFrame([(0, 1, 1, 0.9), (1, 0, 1, 0.7), (0, 2, 2, -0.2), (1, 2, 2, 0.4), (1, 1, 3, 1.0)], "i long, j long, rank int, value double")
    pairs = {(0, 1): 0.9, (1, 0): 0.9, (1, 2): 0.4, (2, 1): 0.4}
    got = lambda d: {(r.i, r.j): r.w for r in graph.symmetrize(knn, d).collect()}
    assert got("zero") == pairs
    assert got("keep") == pairs | {(1, 1): 1.0}
    assert got("one") == pairs | {(k, k): 0.0 for k in range(3)}
    assert graph.kernel(graph.symmetrize(knn, "one"), 0.5).where("i = j AND w = 1").count() == 3


def test_repeated_entries_are_summed(spark):
    """One direction twice is not both directions: (0, 1) is 0.5 + 0.25, (2, 3) less than the zero of (3, 2)."""
    knn = spark.createDataFrame([(0, 1, 0.5), (0, 1, 0.25), (1, 0, 0.6), (2, 3, -0.1), (2, 3, -0.2), (4, 4, 0.5), (4, 4, 0.5)], "i long, j long, value double")
    got = {(r.i, r.j): r.w for r in graph.symmetrize(knn, "keep").collect()}
    assert got == {(0, 1): 0.75, (1, 0): 0.75, (4, 4): 1.0}


def test_laplacians(spark):
    rng = np.random.default_rng(2)
    w = np.triu(rng.random((9, 9)) * (rng.random((9, 9)) < 0.6))
    w = w + w.T + np.eye(9)
    table = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "i long, j long, w double")
    d = w.sum(axis=0)
    want = {"plain": np.diag(d) - w, "random_walk": np.eye(9) - w / d[:, None], "symmetric": np.eye(9) - w / np.sqrt(np.outer(d, d))}
    for kind, matrix in want.items():
        assert np.allclose(dense(graph.laplacian(table, kind), 9, "l"), matrix)
    values, vectors = spectral.eigenpairs(graph.laplacian(table), 3, "smallest")
    exact = np.linalg.eigvalsh(want["symmetric"])
    assert np.allclose([r.value for r in values.orderBy("k").collect()], exact[:3]) and max(r.residual for r in values.where('k > 0').collect()) < 1e-6
    assert -1e-9 < exact[0] and exact[-1] < 2 + 1e-9 and vectors.count() == 27
    far = spectral.eigenpairs(graph.laplacian(table), 2, "largest", dense_rows=0, tol=1e-6)[0]
    assert np.allclose([r.value for r in far.orderBy("k").collect()], exact[::-1][:2], atol=1e-4)


def test_two_clusters_are_told_apart(spark):
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(size=16) + 0.1 * rng.normal(size=(12, 16)), rng.normal(size=16) + 0.1 * rng.normal(size=(12, 16))])
    run = Settings(neighbours_kept=8, neighbours_used=8, kernel_sign=1, diagonal="zero", which="smallest", eigenpairs=2)
    knn, _ = pipeline.neighbours(patterns(spark, v), run)
    values, vectors, _ = pipeline.eigensystem(knn, run)
    x = {r.global_idx: r.eigvec_1 for r in spectral.embedding(vectors, [1]).collect()}
    first, second = [x[k] for k in range(12)], [x[k] for k in range(12, 24)]
    assert values.orderBy("k").first().value == pytest.approx(0, abs=1e-9)
    assert max(first) < min(second) or max(second) < min(first) or abs(np.mean(first) - np.mean(second)) > 0.05


def test_tau_curve(spark):
    w = np.random.default_rng(4).random(50)
    table = spark.createDataFrame([(k, k, float(x)) for k, x in enumerate(w)], "i long, j long, w double")
    grid = np.linspace(-10, 10, 20)
    density = np.array([np.log(np.exp(-w / np.exp(e)).sum() + 1e-10) for e in grid])
    slope = np.gradient((density - density.min()) / (density.max() - density.min()))
    got = graph.tau_curve(table).orderBy("idx").collect()
    assert np.allclose([r.gradient for r in got], slope)
    best = graph.best_tau(graph.tau_curve(table)).first()
    assert best.idx == slope.argmax() and not best.at_edge
    short = graph.tau_curve(table, -10.0, float(grid[slope.argmax()]) - 1.5)  # ends before the steepest place
    assert graph.best_tau(short).first().at_edge


def test_views(spark):
    rows = spark.createDataFrame([(k, float((k * 37) % 200), float(k)) for k in range(200)], "global_idx long, x double, attribute double")
    import pandas as pd

    want = pd.DataFrame([(float((k * 37) % 200), float(k)) for k in range(200)]).sort_values(0)[1].rolling(50, center=True).mean().to_numpy()
    got = [r.rolling for r in browse.rolling_mean(rows, "x", "attribute", block=32).orderBy("x").collect()]
    assert all((g is None and np.isnan(w)) or g == pytest.approx(w) for g, w in zip(got, want))
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    probe = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (-0.1, 0.9)], "x double, y double")
    assert [r[0] for r in probe.select(browse.in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, False, False]
    drawn = [r.global_idx for r in browse.sample(rows, 20, 3).collect()]
    assert len(set(drawn)) == 20 and drawn == [r.global_idx for r in browse.sample(rows, 20, 3).collect()]
    grid = browse.pattern_grid(patterns(spark, np.ones((2, 4))), 2, 2, 4, 1).collect()
    assert len(grid) == 4 and sorted(sum(r.pattern) for r in grid) == [0, 0, 4, 4]


@pytest.mark.parametrize("which", ["largest", "smallest"])
def test_iterated_vectors_and_residuals(spark, which):
    turn = np.linalg.qr(np.random.default_rng(5).normal(size=(24, 24)))[0]
    value = np.concatenate([[0.2, 0.201, 0.21], np.linspace(0.4, 1.7, 18), [1.9, 1.908, 1.909]])
    full = turn * value @ turn.T
    matrix = spark.createDataFrame([(i, j, float(full[i, j])) for i in range(24) for j in range(24)], "i long, j long, l double")
    near, far = (spectral.eigenpairs(matrix, 3, which, dense_rows=n) for n in (4096, 0))
    assert all(r.residual < 1e-8 for r in far[0].collect())
    assert [r.value for r in far[0].orderBy("k").collect()] == pytest.approx([r.value for r in near[0].orderBy("k").collect()], abs=1e-12)
    vectors = [np.array([r.value for r in x[1].orderBy("k", "global_idx").collect()]) for x in (near, far)]
    assert np.abs(vectors[0] - vectors[1]).max() < 1e-5


def test_both_iterations_agree(spark, monkeypatch, which="smallest"):
    turn = np.linalg.qr(np.random.default_rng(6).normal(size=(30, 30)))[0]
    full = turn * np.concatenate([[0.1, 0.2, 0.3], np.linspace(0.5, 1.5, 24), [1.7, 1.8, 1.9]]) @ turn.T
    matrix = spark.createDataFrame([(3 * i, 3 * j, float(full[i, j])) for i in range(30) for j in range(30)], "i long, j long, l double")
    one, told = (lambda x: (x[0].orderBy("k").collect(), x[2]))(spectral.solve(matrix, 3, which, dense_rows=0))
    assert told.method == "block-lanczos" and told.converged == 3
    before = len(scratch._made)
    monkeypatch.setattr(spectral, "BASIS_BYTES", 0)
    other, told = (lambda x: (x[0].orderBy("k").collect(), x[2]))(spectral.solve(matrix, 3, which, dense_rows=0))
    assert told.method == "chebyshev-subspace" and [r.value for r in one] == pytest.approx([r.value for r in other], abs=1e-8)
    assert len(scratch._made) - before < 20  # the rounds' tables are freed


def test_a_large_torus(spark):
    """Five dimensions of ten places: values are sums of 2 - 2 cos(2 pi k / 10), the second ten times."""
    n, side = 100_000, 10
    rows = spark.range(n, numPartitions=8).withColumnRenamed("id", "i")
    ends = [F.expr(f"i - i div {side**d} % {side} * {side**d} + (i div {side**d} + {s}) % {side} * {side**d}") for d in range(5) for s in (1, side - 1)]
    graph_ = rows.select("i", F.explode(F.array(*ends)).alias("j"), F.lit(1.0).alias("w"))
    began = time.time()
    values, vectors, told = spectral.solve(graph.laplacian(graph_, "plain"), 10, "smallest")
    found = values.orderBy("k").collect()
    assert time.time() - began < 240 and told.method == "block-lanczos" and told.converged == 10
    gap = 2 - 2 * np.cos(2 * np.pi / side)
    assert [r.value for r in found] == pytest.approx([0.0] + [gap] * 9, abs=1e-8)
    assert all(r.residual < 1e-8 for r in found[1:]) and vectors.count() == 10 * n


def test_too_few_eigenpairs_are_an_error(spark, monkeypatch):
    matrix = spark.createDataFrame([(i, j, 1.0 / (1 + i + j)) for i in range(6) for j in range(6)], "i long, j long, l double")
    with pytest.raises(ValueError):
        spectral.solve(matrix, 7)
    with pytest.raises(RuntimeError):
        spectral.solve(matrix, 2, dense_rows=0, tol=0.0, rounds=1)


def test_samples_are_uniform_and_differ_by_seed(spark):
    rows = spark.range(2000).withColumnRenamed("id", "global_idx")
    draws = {s: sorted(r.global_idx for r in browse.sample(rows, 50, s).collect()) for s in range(40)}
    assert len({tuple(d) for d in draws.values()}) == 40 and all(len(set(d)) == 50 for d in draws.values())
    # Places in ten equal parts: 40 draws of 50 give 200 each; gaps aren't a few values that recur.
    parts = np.bincount(np.concatenate(list(draws.values())) // 200, minlength=10)
    assert ((parts - 200) ** 2 / 200).sum() < 28  # chi-square, 9 degrees of freedom, p < 0.001
    gaps = np.concatenate([np.diff(d) for d in draws.values()])
    # Gaps of a uniform draw are geometric: a quarter is at most 11, half 27, three quarters 55 (of 40).
    quarters = np.histogram(gaps, [0, 11.5, 27.5, 55.5, 4000])[0] / len(gaps)
    assert np.abs(quarters - 0.25).max() < 0.04 and len(np.unique(gaps)) > 100
    assert len(set(draws[0]) & set(draws[1])) < 12


def test_masks_of_many_pixels(spark):
    n = 65_536
    mask = [1.0 if k % 3 else 0.0 for k in range(n)]
    rows = spark.range(4).select(F.col("id").alias("global_idx"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: (k * (F.col("id") + 1) % 1000).cast("double")).alias("pattern"))
    rows.count()
    began = time.time()
    found = pixels.with_stats(rows, mask).select("global_idx", "mean", "std").orderBy("global_idx").collect()
    took = time.time() - began
    for r in found:
        own = np.array([k * (r.global_idx + 1) % 1000 for k in range(n) if k % 3], float)
        assert r.mean == pytest.approx(own.mean()) and r["std"] == pytest.approx(own.std())
    assert took < 10
    with pytest.raises(Exception, match="pixels of the mask"):
        pixels.with_stats(rows.limit(1), mask[:-1]).collect()
    assert [r.good for r in pixels.mask_table(spark, [1.0, 0.0, float("nan"), 0.5]).orderBy("pixel_idx").collect()] == [True, False, True, False]


@pytest.mark.parametrize("matrix_bytes", [10**9, 0])
def test_appended_neighbours(spark, matrix_bytes):
    v = np.random.default_rng(8).normal(size=(60, 6)).round(1)
    v[50:] = v[:10]
    rows = materialize(pixels.with_stats(patterns(spark, v)), "stats")
    old, new = rows.where("global_idx < 41"), rows.where("global_idx >= 41")
    knn = similarity.nearest(old, 5)
    got = similarity.append_neighbours(knn, old, new, 5, matrix_bytes=matrix_bytes, block_bytes=500)
    key = lambda df: sorted((r.i, r["rank"], r.j, round(r.value, 9)) for r in df.collect())
    assert key(got) == key(similarity.nearest(rows, 5))
    assert key(similarity.append_neighbours(knn, old, new.where("false"), 5)) == key(knn)


def test_bounds_skip_blocks_and_lose_nothing(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(8, 40))
    v = np.vstack([c + 0.05 * rng.normal(size=(30, 40)) for c in centres] + [np.ones((2, 40)), centres[:3]])
    rows = materialize(pixels.with_stats(patterns(spark, v)), "stats")
    key = lambda df: sorted((r.i, r["rank"], r.j, round(r.value, 9)) for r in df.collect())
    found, pairs, many = similarity.nearest_bounded(rows, 6, pivots=16, block_rows=30)
    assert key(found) == key(similarity.nearest(rows, 6))
    assert pairs.count() < 0.6 * many
    loose = materialize(pixels.with_stats(patterns(spark, rng.normal(size=(70, 5)).round(1))), "stats")
    for k, block in ((4, 8), (40, 16), (100, 16)):
        assert key(similarity.nearest_bounded(loose, k, block_rows=block)[0]) == key(similarity.nearest(loose, k))
    assert similarity.nearest_bounded(rows.where("false"), 3)[0].count() == 0


def test_zordered_selections(spark, tmp_path):
    rng = np.random.default_rng(10)
    at = np.vstack([rng.random((4000, 2)), rng.random((200, 2)) * 3 - 1, [[0.5, 0.5], [0, 0], [1, 1], [0.25, 0.75]]])
    rows = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(at)] + [(9000, None, 0.5), (9001, 0.5, None)], "global_idx long, x double, y double")
    limits, folder = zorder.Limits(0.0, 1.0, 0.0, 1.0), f"{tmp_path}/points"
    zorder.save_points(rows, folder, limits)
    ids = lambda df: sorted(r.global_idx for r in df.collect())
    polygons = [[(0.1, 0.1), (0.6, 0.2), (0.5, 0.7)], [(-0.5, 0.5), (0.5, -0.5), (1.5, 0.5), (0.5, 1.5)], [(0.2, 0.2), (0.8, 0.8), (0.2, 0.8), (0.8, 0.2)], [(0.5, 0.5), (0.5, 0.5001), (0.5001, 0.5)]]
    for polygon in polygons:
        for depth in (2, 7):
            want = rows.where(browse.in_polygon(F.col("x"), F.col("y"), polygon))
            assert ids(zorder.select_polygon(spark, folder, polygon, limits, depth)) == ids(want)
    for box in ((0.2, 0.4, 0.3, 0.9), (-2.0, 0.5, 0.5, 5.0), (0.25, 0.25, 0.75, 0.75)):
        assert ids(zorder.select_box(spark, folder, *box, limits)) == ids(rows.where(browse.in_box(F.col("x"), F.col("y"), *box)))
    small = zorder.select_polygon(spark, folder, polygons[0], limits)
    assert "Or(Or(" in small._jdf.queryExecution().executedPlan().toString()
    stored, ranges = spark.read.parquet(folder), zorder.cover(polygons[0], limits)
    read = sum(stored.where(F.col("zkey").between(a, b)).count() for a, b, _ in ranges)
    tested = sum(stored.where(F.col("zkey").between(a, b)).count() for a, b, whole in ranges if not whole)
    assert small.count() <= read < 0.2 * stored.count() and tested < 0.05 * stored.count()


def test_raster_pyramid(spark, tmp_path):
    at = np.random.default_rng(11).random((3000, 2))
    rows = spark.createDataFrame([(float(x), float(y), float(k)) for k, (x, y) in enumerate(at)], "x double, y double, v double")
    pyramid = zorder.raster_pyramid(rows, zorder.Limits(0.0, 1.0, 0.0, 0.5), 4, "v")
    inside = at[at[:, 1] < 0.5]
    for level in range(5):
        own = {(r.bx, r.by): r.n for r in pyramid.where(F.col("level") == level).collect()}
        want = np.histogram2d(inside[:, 0], inside[:, 1], bins=2**level, range=((0, 1), (0, 0.5)))[0]
        assert own == {(x, y): int(want[x, y]) for x, y in zip(*np.nonzero(want))}
    zorder.save_pyramid(pyramid, f"{tmp_path}/p")
    tiles = zorder.read_tiles(spark, f"{tmp_path}/p", 4, 0b10, 1)
    assert {(r.bx // 8, r.by // 8) for r in tiles.collect()} == {(0, 1)} and tiles.agg(F.sum("n")).first()[0] == pyramid.where("level = 1 AND bx = 0 AND by = 1").first().n


def test_lookup_by_a_million_numbers(spark, tmp_path):
    rows = spark.range(300_000).select(F.col("id").alias("global_idx"), F.lit(0).alias("file_idx"), F.expr("int(id div 100000)").alias("dataset_idx"), (F.col("id") * 3).alias("x"))
    indexing.save_indexed(rows, f"{tmp_path}/rows", 10_000)
    wanted = spark.range(1_000_000).select(F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") * 7 % 150_000).alias("global_idx"))
    found = indexing.lookup_table(spark, f"{tmp_path}/rows", wanted, 10_000)
    assert found.count() == 1_000_000 and found.where("x <> 3 * global_idx").count() == 0
    assert found.join(wanted.withColumnRenamed("global_idx", "g"), "pos").where("g <> global_idx").count() == 0
    few = indexing.lookup_table(spark, f"{tmp_path}/rows", spark.createDataFrame([(1, 290_001), (0, 7), (2, 7), (3, None), (4, 10**7)], "pos long, global_idx long"), 10_000)
    assert [(r.pos, r.global_idx) for r in few.orderBy("pos").collect()] == [(0, 7), (1, 290_001), (2, 7)]
    assert "dynamicpruning" in few._jdf.queryExecution().executedPlan().toString()
    assert [(r.out, r.pos) for r in indexing.grouped_positions(few).orderBy("out").collect()] == [(0, 0), (1, 2), (2, 1)]


@pytest.mark.parametrize("bad", [{"neighbours_kept": 0}, {"tau": 1}, {"tau": -0.5}, {"neighbours_used": 2000}, {"which": "middle"}, {"shift_by_mean": 1}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
    assert Settings(tau="auto").columns_stored == 1001 and Settings(divide_by_std=False).mode == "covariance"


def test_lanczos_reaches_an_end_of_the_spectrum_that_is_dense():
    n, offsets = 6000, (1, 5, 25)
    want = np.sort(sum(2 - 2 * np.cos(2 * np.pi * np.arange(n) * o / n) for o in offsets))[::-1][:6]
    times = lambda b: 6 * b - sum(np.roll(b, o, axis=0) + np.roll(b, -o, axis=0) for o in offsets)
    values, vectors, steps = spectral.lanczos(times, n, 6, True, 1e-9, 300, 1.2)  # restarts after 8 blocks took more
    assert np.allclose(values, want, rtol=0, atol=1e-9) and steps < 300
    assert np.abs(times(vectors) - vectors * values).max() < 1e-7


def test_lanczos_keeps_enough_at_a_restart():
    """Where the smallest values are dense, restarts from the wanted vectors alone took over 300 steps."""
    held = 1.4 * np.arange(6000) / 6000
    values, vectors, steps = spectral.lanczos(lambda b: held[:, None] * b, 6000, 6, False, 1e-9, 300, 0.2)
    assert np.allclose(values, held[:6], rtol=0, atol=1e-9) and steps < 250
    assert np.allclose(np.abs(vectors[:6]), np.eye(6), rtol=0, atol=1e-5)


def test_lanczos_goes_on_while_it_gets_on():
    """Patterns along a curve make a band of a matrix, whose smallest values lie so close that 300 steps end too early."""
    n, offsets = 4000, (1, 2)
    want = np.sort(sum(2 - 2 * np.cos(2 * np.pi * np.arange(n) * o / n) for o in offsets))[:6]
    times = lambda b: 4 * b - sum(np.roll(b, o, axis=0) + np.roll(b, -o, axis=0) for o in offsets)
    values, vectors, steps = spectral.lanczos(times, n, 6, False, 1e-9, 300, 0.8)
    assert np.allclose(values, want, rtol=0, atol=1e-12) and steps > 300
    assert np.abs(times(vectors) - vectors * values).max() < 1e-8 and np.allclose(vectors.T @ vectors, np.eye(6), rtol=0, atol=1e-10)
    # Residuals of zero can't be reached, and values that stand still end it.
    held = np.linspace(0.1, 1.5, 400)
    with pytest.raises(RuntimeError, match="no nearer"):
        spectral.lanczos(lambda b: held[:, None] * b, 400, 2, False, 0.0, 100, 0.15)


def test_few_blocks_of_a_basis_take_few_steps(spark, monkeypatch):
    """With a basis of six blocks Lanczos restarts so often that it takes over 1,000 steps there."""
    assert spectral.lanczos_room(615_360, 6)[2] and spectral.lanczos_room(900_000, 6)[2]  # no joins there
    n, offsets = 6000, (1, 5, 25)
    want = np.sort(sum(2 - 2 * np.cos(2 * np.pi * np.arange(n) * o / n) for o in offsets))
    times = lambda b: 6 * b - sum(np.roll(b, o, axis=0) + np.roll(b, -o, axis=0) for o in offsets)
    monkeypatch.setattr(spectral, "BASIS_BYTES", 8 * n * 48)
    for largest, end in ((True, want[::-1][:6]), (False, want[:6])):
        values, vectors, steps = spectral.davidson(times, n, 6, largest, 1e-9, 300, (0.0, 12.0), 1.2)
        assert np.allclose(values, end, rtol=0, atol=1e-9) and steps < 1000
        assert np.abs(times(vectors) - vectors * values).max() < 1e-7 and np.allclose(vectors.T @ vectors, np.eye(6), rtol=0, atol=1e-10)
    held = np.linspace(0.1, 1.5, 400)
    monkeypatch.setattr(spectral, "BASIS_BYTES", 8 * 400 * 16)
    with pytest.raises(RuntimeError, match="no nearer"):
        spectral.davidson(lambda b: held[:, None] * b, 400, 2, False, 0.0, 100, (0.1, 1.5), 0.15)
    # A hub makes plain discs wide.
    star = np.eye(50)
    star[0, 1:] = star[1:, 0] = -1 / 7
    low, high = spectral.closer_bounds(lambda x: np.abs(star) @ x, 50, 1.0, (-6.0, 8.0))
    assert -0.4 < low <= 0 + 1e-9 and 2 - 1e-9 <= high < 2.4
    rows = [(i, j, 1.0 + (i % 7 + 1) / 10 if i == j else -0.3) for i in range(60) for j in {i, (i + 1) % 60, (i - 1) % 60}]
    matrix = spark.createDataFrame(rows, "i long, j long, l double")
    exact = spectral.solve(matrix, 3, "smallest")[0].collect()
    monkeypatch.setattr(spectral, "BASIS_BYTES", 8 * 60 * 30)
    found, _, told = spectral.solve(matrix, 3, "smallest", dense_rows=0)
    assert told.method == "chebyshev-davidson" and [r.value for r in found.collect()] == pytest.approx([r.value for r in exact], abs=1e-8)


def test_the_best_of_a_block_are_those_of_a_sort():
    rng = np.random.default_rng(4)
    for n, k, kind in [(1, 3, "plain"), (9, 4, "whole"), (900, 11, "plain"), (900, 2, "whole"), (900, 11, "equal"), (900, 50, "copies"), (900, 5, "undefined")]:
        v = rng.integers(0, 2, (n, 8)).astype(float) if kind == "whole" else rng.standard_normal((n, 8))
        v = np.ones((n, 8)) if kind == "equal" else v[rng.integers(0, 20, n)] if kind == "copies" else v
        std = np.where(np.arange(n) % 2, np.nan if kind == "undefined" else 1.0, 0.0 if kind == "undefined" else 1.0)
        block = (np.arange(n) * 3, v, np.zeros(n), std)
        got = [tuple(r.values()) for x in similarity._best_of_block(block, block, 8, "pearson", k) for r in x.to_pylist()]
        scores = v @ v.T / 8
        with np.errstate(divide="ignore", invalid="ignore"):
            scores = np.where(np.outer(std, std) > 0, scores / np.outer(std, std), -np.inf)
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        want = [(3 * i, 3 * int(j), r + 1, scores[i, j]) for i in range(n) for r, j in enumerate(order[i]) if np.isfinite(scores[i, j])]
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want])


def test_equal_patterns_tie_in_any_block():
    """Products of blocks round equal columns unlike; the smaller index must come first all the same."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(2503, 64)).astype(np.float32).astype(float)
    same = np.sort(rng.choice(len(v), 350, replace=False))
    v[same] = v[same[0]]
    block = (np.arange(len(v)), v, v.mean(axis=1), v.std(axis=1))
    own = tuple(x[:199] for x in block)
    found = {}
    for batch in similarity._best_of_block(own, block, 64, "inner", 2500):
        for r in batch.to_pylist():
            found.setdefault(r["i"], []).append(r["j"])
    assert len(found) == 199
    for js in found.values():
        ties = [j for j in js if j in set(same.tolist())]
        assert ties == sorted(ties)


@pytest.mark.parametrize("mode", similarity.MODES)
def test_all_pairs_by_blocks(spark, mode):
    """Whole, and with nulls where a score is undefined."""
    v = np.random.default_rng(8).normal(size=(50, 6))
    v[7] = 2.0
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(50, None), (51, [1.0, None, 2.0, 0.0, 1.0, 1.0]), (52, [1.0, 2.0, 4.0]), (53, [])]
    rows = pixels.with_stats(spark.createDataFrame(rows, "global_idx long, pattern array<double>"))
    c, m, s = v @ v.T / 6, v.mean(axis=1), v.std(axis=1)
    want = c - np.outer(m, m) if mode in ("pearson", "covariance") else c
    with np.errstate(divide="ignore", invalid="ignore"):
        want = want / np.outer(s, s) if mode in ("pearson", "normalized") else want
    for got in (similarity.pair_scores(rows, 6, mode), similarity.pair_scores(rows, 6, mode, matrix_bytes=500, block_rows=9)):
        found = {(r.i, r.j): r.value for r in got.collect()}
        assert len(found) == 54 * 54
        for (i, j), value in found.items():
            if max(i, j) < 50 and np.isfinite(want[i, j]) and not (7 in (i, j) and mode in ("pearson", "normalized")):
                assert value == pytest.approx(want[i, j], abs=1e-12)
            elif i == j == 52:
                assert value is not None
            elif i == j == 53:
                assert value == (0 if mode == "inner" else None)
            else:
                assert value is None
    some = similarity.pair_scores(rows, 6, mode, F.col("global_idx") < 2)
    assert some.count() == 2 * 54 and some.select("i").distinct().count() == 2


def test_scores_are_rounded_where_they_are_made(spark):
    """A rounding of each joined row took most of the time of the queries that make all pairs."""
    halves = np.array([0.5, 1.5, 2.5, -0.5, -2.5, 0.4999999999999999, -0.2, 1e300, 4503599627370497.0, np.inf, np.nan])
    got, got_scaled = halves.copy(), np.array([0.1234565, -0.1234565, -1e-9, 1e305])
    similarity._round(got, 0)
    similarity._round(got_scaled, 6)
    assert np.array_equal(got, [1, 2, 3, -1, -3, 0, 0, 1e300, 4503599627370497.0, np.inf, np.nan], equal_nan=True)
    assert not np.signbit(got[6]) and got_scaled.tolist() == [0.123457, -0.123457, 0.0, 1e305] and not np.signbit(got_scaled[2])
    rng = np.random.default_rng(8)
    data = [(k, rng.standard_normal(4).tolist(), float(rng.random()), 0.0 if k == 3 else None if k == 5 else 1.0) for k in range(60)]
    rows = spark.createDataFrame(data, "global_idx long, pattern array<double>, mean double, std double")
    for options in ({}, {"matrix_bytes": 500, "block_rows": 9}):
        for mode in similarity.MODES:
            plain, fine = (sorted(map(tuple, df.collect())) for df in (similarity.pair_scores(rows, 4, mode, **options).withColumn("value", F.round("value", 6) + F.lit(0.0)), similarity.pair_scores(rows, 4, mode, digits=6, **options)))
            assert plain == fine and len(fine) == 3600


def test_blocks_whose_pairs_are_all_kept_are_few(spark):
    """Each pattern is sent once for each block; pairs leave in batches, so that blocks of thousands of rows fit."""
    rows = spark.range(3000).select(F.col("id").alias("global_idx"), F.array(*[F.rand(k) for k in range(4)]).alias("pattern"), F.lit(0.0).alias("mean"), F.lit(1.0).alias("std"))
    found = similarity.pair_scores(rows, 4, "inner", matrix_bytes=90_000)
    assert "sequence(0, 1," in found._jdf.queryExecution().analyzed().toString()
    assert found.agg(F.count("value"), F.count_distinct("i", "j")).first() == (9_000_000, 9_000_000)
