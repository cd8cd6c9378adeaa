import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from driftmap import scaffold
from driftmap.sources import generate, manifest, npy, scratch, store


def write_patterns(spark, path, counts, width=3):
    rows = [(d, k, [float(k)] * width) for d, n in counts.items() for k in range(n)]
    spark.createDataFrame(rows, "dataset string, local_idx long, pattern array<double>").write.parquet(path)


def test_manifest_lines():
    lines = ["# note", "", "Dataset:early", "  File:/a", "Dataset:x", "odd line", "Dataset:x", "File:/b"]
    assert manifest.parse_manifest(lines) == [("/a", ["x", "x"]), ("/b", [])]
    for bad in (["File:/a", "File:/a"], ["# only a note"]):
        with pytest.raises(ValueError):
            manifest.parse_manifest(bad)


def test_patterns_of_a_manifest(spark, tmp_path):
    a, b = f"{tmp_path}/a.parquet", f"{tmp_path}/b.parquet"
    write_patterns(spark, a, {"10": 2, "2": 3})
    write_patterns(spark, b, {"z": 4})
    text = tmp_path / "file_list.txt"
    text.write_text(f"File:{b}\nFile:{a}\n")
    source = manifest.read_patterns(spark, str(text))
    assert [(r.dataset, r.data_num) for r in source.manifest.orderBy("file_idx", "dataset_idx").collect()] == [("z", 4), ("10", 2), ("2", 3)]
    rows = source.rows.orderBy("global_idx").collect()
    assert [r.global_idx for r in rows] == list(range(9)) and [r.local_idx for r in rows] == [0, 1, 2, 3, 0, 1, 0, 1, 2]
    assert [p.rsplit("/", 1)[1] for p in manifest.list_tables(spark, str(tmp_path))] == ["a.parquet", "b.parquet"]
    write_patterns(spark, f"{tmp_path}/c.parquet", {"z": 1}, width=4)
    text.write_text(f"File:{b}\nFile:{tmp_path}/c.parquet\n")
    with pytest.raises(ValueError):
        manifest.read_patterns(spark, str(text))
    with pytest.raises(ValueError):
        manifest.read_patterns(spark, str(text), "csv")
    manifest.write_manifest(spark, ["/B", "/a"], f"{tmp_path}/out")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ["File:/a", "File:/B"]


def test_shapes_of_patterns(spark, tmp_path):
    """Patterns of two dimensions are flattened row by row; 2 x 3 isn't 3 x 2, and ragged ones are no shape."""
    text = tmp_path / "file_list.txt"

    def source(*tables):
        for k, patterns in enumerate(tables):
            spark.createDataFrame([("d", n, p) for n, p in enumerate(patterns)], "dataset string, local_idx long, pattern array<array<double>>").write.mode("overwrite").parquet(f"{tmp_path}/s{k} x.parquet")
        text.write_text("".join(f"File:{tmp_path}/s{k} x.parquet\n" for k in range(len(tables))))
        return manifest.read_patterns(spark, str(text))

    wide, high = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
    found = source([wide, wide], [wide])
    assert found.shape == (2, 3) and [r.pattern for r in found.rows.collect()] == [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] * 3
    for bad in ([[wide], [high]], [[[[1.0], [2.0, 3.0]]]]):
        with pytest.raises(ValueError):
            source(*bad)


def test_names_that_uris_encode(spark, tmp_path):
    names = ["plain", "a+b#c", "x%20y", "blank name", "é日", "100%", "semi;q=1"]
    for k, name in enumerate(names):
        write_patterns(spark, f"{tmp_path}/{name}.parquet", {"d": k + 1})
    text = tmp_path / "file_list.txt"
    text.write_text("".join(f"File:{tmp_path}/{name}.parquet\n" for name in names))
    source = manifest.read_patterns(spark, str(text))
    assert [r.data_num for r in source.manifest.orderBy("file_idx").collect()] == list(range(1, 8))
    assert sorted((r.file_idx, r.local_idx) for r in source.rows.collect()) == [(k, n) for k in range(7) for n in range(k + 1)]
    plan = source.rows._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    spark.createDataFrame([], "dataset string, local_idx long, pattern array<double>").write.parquet(f"{tmp_path}/none.parquet")
    for bad in (f"File:{tmp_path}/none.parquet\nFile:{tmp_path}/plain.parquet\n", f"File:{tmp_path}\nFile:{tmp_path}/plain.parquet\n"):
        text.write_text(bad)
        with pytest.raises((ValueError, PySparkException)):
            manifest.read_patterns(spark, str(text))


def test_npy_files_are_read_by_ranges(spark, tmp_path):
    arrays = {"a": np.arange(60, dtype=">f4").reshape(10, 2, 3), "b": np.arange(24, dtype=np.int16).reshape(4, 2, 3), "one": np.arange(5.0), "none": np.zeros((0, 2, 3))}
    for name, x in arrays.items():
        np.save(tmp_path / f"{name}.npy", x)
    paths = [f"{tmp_path}/{n}.npy" for n in ("a", "b")]
    df = npy.read_npy(spark, paths, rows_per_task=3)
    assert df.rdd.getNumPartitions() == 4 + 2
    got = {(r.dataset, r.local_idx): (r.file_idx, r.shape, r.pattern) for r in df.collect()}
    assert got == {(n, k): (f, [2, 3], arrays[n][k].ravel().astype(float).tolist()) for f, n in enumerate("ab") for k in range(len(arrays[n]))}
    part = df.where("dataset = 'a' AND local_idx >= 4 AND local_idx < 6")
    assert part.rdd.getNumPartitions() == 1 and sorted(r.local_idx for r in part.collect()) == [4, 5]
    assert df.where("local_idx > 20").count() == 0 and df.where("local_idx % 2 = 1 AND dataset IN ('b', 'c')").count() == 2
    assert [r.pattern for r in npy.read_npy(spark, [f"{tmp_path}/one.npy"]).orderBy("local_idx").collect()] == [[float(k)] for k in range(5)]
    assert npy.read_npy(spark, [f"{tmp_path}/none.npy"]).count() == 0
    text = tmp_path / "file_list.txt"
    text.write_text("".join(f"File:{p}\n" for p in paths))
    source = manifest.read_patterns(spark, str(text), "npy")
    assert source.shape == (2, 3) and [r.data_num for r in source.manifest.orderBy("file_idx").collect()] == [10, 4]
    assert [r.pattern[0] for r in source.rows.orderBy("global_idx").collect()] == [6.0 * k for k in range(10)] + [6.0 * k for k in range(4)]
    text.write_text(f"File:{paths[0]}\nFile:{tmp_path}/one.npy\n")
    with pytest.raises(ValueError):
        manifest.read_patterns(spark, str(text), "npy")
    np.save(tmp_path / "turned.npy", np.asfortranarray(arrays["b"][:, 0]))
    for bad in ("turned", "objects"):
        np.save(tmp_path / "objects.npy", np.array([{}], object), allow_pickle=True)
        with pytest.raises(Exception, match="not a row-wise array"):
            npy.read_npy(spark, [f"{tmp_path}/{bad}.npy"]).count()


def test_marks_travel_as_bitmaps(spark, tmp_path):
    spark.range(100_000).withColumnRenamed("id", "gone").repartition(3).write.parquet(f"{tmp_path}/t")
    rows, row = scratch.numbered(spark.read.parquet(f"{tmp_path}/t"), "test")
    marks = rows.where("gone % 7 > 3").select(row, (F.col("gone") % 7 - 3).cast("int").alias("times"))
    found = scratch.with_marks(rows, row, marks, "times", 3)
    assert found.where("times <> greatest(gone % 7 - 3, 0)").count() == 0 and found.count() == 100_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    kept = scratch.without(rows, row, marks.select(row), scratch.made())
    assert kept.columns == ["gone"] and kept.where("gone % 7 > 3").count() == 0 and kept.count() == sum(k % 7 <= 3 for k in range(100_000))
    assert scratch.without(rows, row, marks.select(row).where("false"), scratch.made()).count() == 100_000


def test_batches_are_read_by_ranges(spark, tmp_path):
    rows = spark.range(40).selectExpr("0 AS file_idx", "int(id % 2) AS dataset_idx", "id div 2 AS local_idx", "array(double(id)) AS pattern")
    store.save_patterns(rows, f"{tmp_path}/patterns")
    ends = spark.createDataFrame([(0, 0, 3, 7), (0, 1, 0, 2)], "file_idx int, dataset_idx int, start long, end long")
    found = store.scan_batch(spark, f"{tmp_path}/patterns", ends)
    assert sorted(r.pattern[0] for r in found.collect()) == [1.0, 3.0, 6.0, 8.0, 10.0, 12.0]
    assert "PushedFilters: [IsNotNull(file_idx)" in found._jdf.queryExecution().executedPlan().toString()


def test_row_numbers_stay(spark, tmp_path):
    spark.range(50).withColumn("row", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/t")
    for df in (spark.read.parquet(f"{tmp_path}/t"), spark.range(50).withColumn("row", F.lit(1)), spark.read.parquet(f"{tmp_path}/t").withColumn("x", F.explode(F.array(F.lit(1), F.lit(2))))):
        found, name = scratch.numbered(df, "test")
        assert name == "_row" and found.columns == [*df.columns, "_row"]
        assert found.select("_row").distinct().count() == df.count()
        assert sorted(found.collect()) == sorted(found.coalesce(1).collect())


def test_shared_folder_is_asked_for(spark, monkeypatch):
    class Cluster:
        conf = {"spark.master": "spark://host:7077"}

    with pytest.raises(ValueError):
        scratch.scratch_root(Cluster())


def test_stores(spark, tmp_path):
    knn = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 0.5)], "i long, j long, rank int, value double")
    stats = spark.createDataFrame([(0, 1.0, 2.0), (1, 1.0, 2.0)], "global_idx long, mean double, std double")
    mask = spark.createDataFrame([(0, True)], "pixel_idx int, good boolean")
    for _ in range(2):
        store.save_similarity(str(tmp_path), knn, stats, mask)
    assert store.load_similarity(spark, str(tmp_path), 1)[0].count() == 1
    assert store.load_mask(spark, str(tmp_path)) == [1.0]
    assert store.load_attributes(spark, None, stats).where("attribute = 1").count() == 2
    values = spark.createDataFrame([(0, 1.0, 0.0)], "k int, value double, residual double")
    vectors = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0)], "k int, global_idx long, value double")
    run = store.save_eigensystem(f"{tmp_path}/eigen", values, vectors, 5, 0.5, False)
    assert store.load_eigenvectors(spark, run, [1]).count() == 1
    store.save_selection(stats, f"{tmp_path}/selected")
    assert spark.read.parquet(f"{tmp_path}/selected").columns == ["global_idx"]


def test_a_version_appears_at_once_or_not_at_all(spark, tmp_path):
    folder = str(tmp_path)
    knn = spark.createDataFrame([(0, 0, 1, 1.0)], "i long, j long, rank int, value double")
    stats = spark.createDataFrame([(0, 1.0, 2.0)], "global_idx long, mean double, std double")
    mask = spark.createDataFrame([(0, True)], "pixel_idx int, good boolean")
    with pytest.raises(FileNotFoundError):
        store.load_similarity(spark, folder)
    first = store.save_similarity(folder, knn, stats, mask)
    pinned = store.load_similarity(spark, folder, version=first)[0]
    broken = stats.withColumn("mean", F.raise_error(F.lit("no more room")).cast("double"))
    with pytest.raises(Exception, match="no more room"):
        store.save_similarity(folder, knn.withColumn("value", F.lit(9.0)), broken, mask)
    assert store.versions(spark, folder) == [first] and [x.name for x in tmp_path.iterdir() if x.is_dir()] == ["version=000000000"]
    assert store.load_similarity(spark, folder)[0].first().value == 1.0
    for k in (2.0, 3.0):
        store.save_similarity(folder, knn.withColumn("value", F.lit(k)), stats, mask)
    assert pinned.first().value == 1.0 and store.load_similarity(spark, folder)[0].first().value == 3.0
    store.save_similarity(folder, knn, stats, mask)
    assert len(store.versions(spark, folder)) == store.KEPT and first not in store.versions(spark, folder)
    values = spark.createDataFrame([(0, 1.0, 0.0)], "k int, value double, residual double")
    vectors = spark.createDataFrame([(0, 0, 1.0)], "k int, global_idx long, value double")
    assert len({store.save_eigensystem(f"{folder}/e", values, vectors, 5, 0.5, False) for _ in range(3)}) == 3


def test_splines_against_closed_forms():
    """A cosine that fits the mirrored edges is a wave of the splines: its coefficients are its values by
    6 / (4 + 2 cos w), and so is the spline between its places."""
    n = 17
    k, fine = np.arange(n), np.linspace(0, n - 1, 101)
    b = lambda t: np.where(np.abs(t) < 1, 2 / 3 - t * t + np.abs(t) ** 3 / 2, np.maximum(2 - np.abs(t), 0) ** 3 / 6)
    for m in (0, 1, 3, 16):
        w = np.pi * m / (n - 1)
        wave = np.cos(w * k)
        image = wave[:, None] * np.ones(5)
        assert np.allclose(generate.spline_coefficients(image)[:, 0], 6 / (4 + 2 * np.cos(w)) * wave)
        far = np.arange(-3, n + 3)
        want = (b(fine[:, None] - far) * np.cos(w * far)).sum(axis=1) * 6 / (4 + 2 * np.cos(w))
        assert np.allclose(generate.sampled(image, fine[:, None], np.full((101, 1), 1.7))[:, 0], want)
    rng = np.random.default_rng(1)
    image = rng.random((6, 9))
    ys, xs = np.indices(image.shape, dtype=float)
    assert np.allclose(generate.sampled(image, ys, xs), image) and (generate.sampled(image, ys - 20, xs) == 0).all()
    blob = np.exp(-((np.indices((32, 32))[0] - 12.3) ** 2 + (np.indices((32, 32))[1] - 17.8) ** 2) / 18)
    moved = generate.centred(blob)
    ys, xs = np.indices(moved.shape, dtype=float)
    assert abs((moved * ys).sum() / moved.sum() - 16) < 1e-3 and abs((moved * xs).sum() / moved.sum() - 16) < 1e-3


def test_generators(spark):
    shapes = generate.squares_and_disks(spark, 122, side=16, noise=0.0)
    assert shapes.where("kind = 'square'").count() == 51
    assert {r.top for r in shapes.select("kind", F.array_max("pattern").alias("top")).distinct().collect()} == {40.0, 68.0}
    a, b = (generate.random_disks(spark, 5, side=8).orderBy("global_idx").collect() for _ in range(2))
    assert a == b and len(a[0].pattern) == 64
    flat = generate.flat_shapes(spark, rounds=3, side=8)
    sizes = {r.dataset: r["count"] for r in flat.groupBy("dataset").count().collect()}
    assert set(sizes) == set("012345") and all(5 <= n < 100 for n in sizes.values()) and flat.where("size(pattern) <> 64").count() == 0
    turned = generate.rotations(spark, 10, side=16).orderBy("global_idx").collect()
    assert [r.category for r in turned] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4] and turned[-1].angle == 355.0
    first, last = np.array(turned[0].pattern), np.array(turned[-1].pattern)
    assert np.corrcoef(first, last)[0, 1] > 0.95  # the loop closes


def test_new_projects(tmp_path):
    assert [scaffold.new_project(str(tmp_path)).name for _ in range(2)] == ["proj_000", "proj_001"]
    assert (tmp_path / "proj_001" / "src" / "settings.py").exists()
