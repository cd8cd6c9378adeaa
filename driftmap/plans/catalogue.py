"""Named queries over the test tables, with their DuckDB counterparts.

Patterns are the rows of ``embeddings``: 64 values as 8 x 8 pixels, ``label`` as the dataset and the
order of ``vec_id`` in it as the local index.  Views of coordinates take two embedding components,
so that no eigenvector, whose sign is arbitrary, enters a comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmap.config import Settings
from driftmap.operators import browse, graph, indexing, pixels, similarity, spectral, zorder
from driftmap.plans import pipeline
from driftmap.sources import manifest, npy, store
from driftmap.sources.scratch import materialize, scratch_path

PIXELS, K, TAU = 64, 10, 0.5
MASK = [0.0 if p % 4 == 3 else 1.0 for p in range(PIXELS)]
POLYGON = [(-0.1, -0.1), (0.15, -0.05), (0.1, 0.12), (-0.05, 0.1)]
IDS = [7, 3, 250, 3, 499, 120, 0]
BATCHES = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- inputs


def placed_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """global_idx, file_idx, dataset_idx, vec_id, pattern, in the order of datasets and vec_id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    own = rows.select(F.lit(0).alias("file_idx"), F.col("label").alias("dataset_idx"), "vec_id", F.col("embedding").cast("array<double>").alias("pattern"))
    return indexing.dense_index(own, ["dataset_idx", "vec_id"])


def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """global_idx, file_idx, dataset_idx, local_idx, vec_id, pattern"""
    # A dataset may hold any share of the rows: numbers in a dataset are numbers of all rows less its first.
    placed = placed_patterns(spark, sf_dir).withColumnRenamed("global_idx", "place")
    first = placed.groupBy("dataset_idx").agg(F.min("place").alias("first"))
    numbered = placed.join(F.broadcast(first), "dataset_idx").withColumn("local_idx", F.col("place") - F.col("first"))  # a row for each dataset
    return indexing.global_index_map(numbered.select("file_idx", "dataset_idx", "local_idx", "vec_id", "pattern"))


def stats(spark: SparkSession, sf_dir: str, mask: list[float] | None = None) -> DataFrame:
    return pixels.with_stats(placed_patterns(spark, sf_dir), mask)


def knn(spark: SparkSession, sf_dir: str, settings: Settings = Settings(neighbours_kept=K, neighbours_used=K), read_once: bool = False) -> DataFrame:
    return pipeline.neighbours(placed_patterns(spark, sf_dir), settings, read_once=read_once)[0]


def weighted(spark: SparkSession, sf_dir: str, diagonal: str = "one", sign: int = -1) -> DataFrame:
    return graph.kernel(graph.symmetrize(knn(spark, sf_dir), diagonal), TAU, sign)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """global_idx, x, y, attribute, category: two components of each embedding, and its label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("global_idx"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("embedding")[2].cast("double").alias("attribute"), F.col("label").alias("category"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Doubles to six places; adding zero drops the sign of zero."""
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n in names})


# ---- SQL building blocks

P = """p AS (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS global_idx, 0 AS file_idx, label AS dataset_idx,
  row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS local_idx, vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""
R = "round({}, 6) + 0.0"


def with_stats_sql(masked: bool = False) -> str:
    source = "list_filter(v, lambda x, i: (i - 1) % 4 <> 3)" if masked else "v"
    return f"""{P},
q AS (SELECT global_idx, vec_id, dataset_idx, {source} AS g FROM p),
m AS (SELECT *, list_sum(g) / len(g) AS mean FROM q),
s AS (SELECT *, sqrt(list_sum(list_transform(g, lambda x: (x - mean) * (x - mean))) / len(g)) AS std FROM m)"""


def value_sql(mode: str, pixels_: int = PIXELS) -> str:
    c = f"list_inner_product(a.g, b.g) / {pixels_}"
    if mode in ("pearson", "covariance"):
        c = f"({c} - a.mean * b.mean)"
    return f"{c} / nullif(a.std * b.std, 0)" if mode in ("pearson", "normalized") else c


def knn_sql(mode: str = "pearson", k: int = K + 1, masked: bool = False) -> str:
    return f"""{with_stats_sql(masked)},
c AS (SELECT a.global_idx AS i, b.global_idx AS j, {value_sql(mode)} AS value FROM s a CROSS JOIN s b),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY value DESC, j) AS rank FROM c WHERE value IS NOT NULL),
k AS (SELECT i, j, rank, value FROM r WHERE rank <= {k})"""


def graph_sql(diagonal: str = "one", used: int = K) -> str:
    """g: the symmetrised graph (i, j, w)."""
    tail = {"keep": "SELECT * FROM y", "zero": "SELECT * FROM y WHERE i <> j", "one": "SELECT * FROM y WHERE i <> j UNION ALL SELECT DISTINCT i, i, 0.0 FROM (SELECT i FROM t UNION SELECT j FROM t)"}[diagonal]
    return f"""{knn_sql()},
t AS (SELECT i, j, value FROM k WHERE rank <= {used}),
y AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, greatest(coalesce(a.value, 0), coalesce(b.value, 0)) AS w
      FROM t a FULL JOIN t b ON a.i = b.j AND a.j = b.i WHERE greatest(coalesce(a.value, 0), coalesce(b.value, 0)) <> 0),
g AS ({tail})"""


def kernel_sql(diagonal: str = "one", sign: int = -1) -> str:
    return f"{graph_sql(diagonal, K + 1)},\nw AS (SELECT i, j, exp({sign} * w / {TAU}) AS w FROM g),\nd AS (SELECT j AS i, sum(w) AS deg FROM w GROUP BY j)"


def laplacian_sql(kind: str, base: str | None = None) -> str:
    scaled = {"plain": "w.w", "random_walk": "w.w / di.deg", "symmetric": "w.w / sqrt(di.deg) / sqrt(dj.deg)"}[kind]
    one = "deg" if kind == "plain" else "1.0"
    return f"""{base or kernel_sql()},
e AS (SELECT w.i, w.j, -({scaled}) AS l FROM w JOIN d di ON di.i = w.i JOIN d dj ON dj.i = w.j UNION ALL SELECT i, i, {one} FROM d),
l AS (SELECT i, j, sum(l) AS l FROM e GROUP BY i, j HAVING sum(l) <> 0)"""


XY = "xy AS (SELECT vec_id AS global_idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS attribute, label AS category FROM embeddings)"

# ---- numbering and batches


@query(f"WITH {P} SELECT global_idx, file_idx, dataset_idx, local_idx, vec_id FROM p")
def global_index_map(spark, sf_dir):
    return patterns(spark, sf_dir).drop("pattern")


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS row_idx, l_orderkey, l_linenumber FROM lineitem")
def dense_row_numbers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    return indexing.dense_index(rows, ["l_orderkey", "l_linenumber"], "row_idx")


@query(f"WITH {P} SELECT file_idx, dataset_idx, count(*) AS n FROM p GROUP BY ROLLUP (file_idx, dataset_idx)")
def dataset_counts_rollup(spark, sf_dir):
    return indexing.source_counts(patterns(spark, sf_dir))


def _total(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


TILES = f"WITH {P}, b AS (SELECT *, (ntile({BATCHES}) OVER (ORDER BY global_idx) - 1)::INT AS batch FROM p)"


@query(f"{TILES} SELECT batch, count(*) AS n FROM b GROUP BY batch")
def batch_sizes(spark, sf_dir):
    return indexing.batch_sizes(spark, _total(spark, sf_dir), BATCHES)


@query(f'{TILES} SELECT batch, min(global_idx) AS start, max(global_idx) + 1 AS "end" FROM b GROUP BY batch')
def batch_ranges(spark, sf_dir):
    return indexing.batch_ranges(spark, _total(spark, sf_dir), BATCHES)


@query(f'{TILES} SELECT batch, file_idx, dataset_idx, min(local_idx) AS start, max(local_idx) + 1 AS "end" FROM b GROUP BY ALL')
def batch_ends(spark, sf_dir):
    return indexing.batch_ends(patterns(spark, sf_dir), _total(spark, sf_dir), BATCHES)


@query(f"SELECT a.range::INT AS batch, b.range::INT AS other FROM range({BATCHES}) a, range({BATCHES}) b WHERE a.range <> b.range")
def batch_pairs_offdiag(spark, sf_dir):
    return indexing.other_batches(spark, BATCHES)


# ---- pixels


@query(f"SELECT range::INT AS pixel_idx, range % 4 <> 3 AS good FROM range({PIXELS})")
def mask_pixels(spark, sf_dir):
    return pixels.mask_table(spark, MASK)


@query(f"WITH {with_stats_sql()} SELECT global_idx, {R.format('mean')} AS mean, {R.format('std')} AS std FROM s")
def pattern_stats(spark, sf_dir):
    return rounded(stats(spark, sf_dir).select("global_idx", "mean", "std"), "mean", "std")


@query(f"WITH {with_stats_sql(True)} SELECT global_idx, {R.format('mean')} AS mean, {R.format('std')} AS std FROM s")
def masked_stats(spark, sf_dir):
    return rounded(stats(spark, sf_dir, MASK).select("global_idx", "mean", "std"), "mean", "std")


@query("SELECT vec_id, (unnest(range(64)))::INT AS pixel_idx, round(unnest(embedding::DOUBLE[]), 6) + 0.0 AS value FROM embeddings")
def flatten_pattern(spark, sf_dir):
    """Patterns stored as 8 x 8 arrays in arrays, flattened."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    square = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("embedding", r * 8 + 1, F.lit(8)))
    nested = rows.select("vec_id", square.alias("pattern"))
    whole = nested.select("vec_id", pixels.flat(F.col("pattern"), pixels.rank_of(nested.schema["pattern"].dataType)).alias("pattern"))
    return rounded(whole.select("vec_id", F.posexplode("pattern").alias("pixel_idx", "value")), "value")


@query(f"WITH {with_stats_sql(True)} SELECT global_idx, {R.format('mean')} AS mean, {R.format('std')} AS std FROM s")
def mask_round_trip(spark, sf_dir):
    """Statistics under a mask that was stored and read back."""
    folder, rows = scratch_path(spark, "similarity"), patterns(spark, sf_dir)
    store.save_similarity(folder, spark.createDataFrame([], "i long, j long, rank int, value double"), stats(spark, sf_dir), pixels.mask_table(spark, MASK))
    found = pixels.with_stats(rows, store.load_mask(spark, folder))
    return rounded(found.select("global_idx", "mean", "std"), "mean", "std")


@query(f"{TILES} SELECT global_idx, dataset_idx, local_idx, {R.format('list_sum(v)')} AS total FROM b WHERE batch = 2")
def batch_scan(spark, sf_dir):
    """One batch of stored patterns, read by its ranges of each dataset."""
    folder, total = scratch_path(spark, "patterns"), _total(spark, sf_dir)
    store.save_patterns(patterns(spark, sf_dir), folder)
    ends = indexing.batch_ends(patterns(spark, sf_dir), total, BATCHES).where("batch = 2")
    found = store.scan_batch(spark, folder, ends)
    value = F.aggregate("pattern", F.lit(0.0), lambda a, x: a + x)
    return rounded(found.select("global_idx", "dataset_idx", "local_idx", value.alias("total")), "total")


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT row_number() OVER () - 1 AS g FROM embeddings),
x AS (SELECT t AS batch0, min(g) AS start0, max(g) + 1 AS end0 FROM (SELECT g, (ntile({BATCHES}) OVER (ORDER BY g) - 1)::INT AS t FROM e) GROUP BY t),
y AS (SELECT t AS batch1, min(g) AS start1, max(g) + 1 AS end1 FROM (SELECT g, (ntile(3) OVER (ORDER BY g) - 1)::INT AS t FROM e) GROUP BY t)
SELECT * FROM x CROSS JOIN y""")
def batch_grid_2d(spark, sf_dir):
    return indexing.batch_grid(spark, _total(spark, sf_dir), BATCHES, 3)


@query(f"WITH {P} SELECT vec_id, {R.format('list_sum(v)')} AS total FROM p WHERE dataset_idx <> 1")
def npy_patterns(spark, sf_dir):
    """Patterns written as ``.npy`` files, listed by a manifest and read back by ranges."""
    folder = scratch_path(spark, "arrays")
    rows = placed_patterns(spark, sf_dir).where("dataset_idx <> 1").select(F.concat(F.array(F.col("vec_id").cast("double")), "pattern").alias("pattern"))
    files = [r.path for r in npy.write_npy(rows, folder).orderBy("path").collect()]  # a row a file
    manifest.write_manifest(spark, files, f"{folder}-list")
    found = manifest.read_patterns(spark, f"{folder}-list", "npy").rows
    total = F.aggregate(F.slice("pattern", 2, PIXELS), F.lit(0.0), lambda a, x: a + x)
    return rounded(found.select(F.get("pattern", F.lit(0)).cast("long").alias("vec_id"), total.alias("total")), "total")


@query(f"WITH {P} SELECT dataset_idx + 1 AS file_idx, local_idx, {R.format('list_sum(v)')} AS total FROM p WHERE dataset_idx < 2")
def manifest_patterns(spark, sf_dir):
    """Two datasets stored as two files, one with a name that URIs encode, read through a manifest."""
    folder, rows = scratch_path(spark, "listed"), patterns(spark, sf_dir)
    names = [f"{folder}/plain.parquet", f"{folder}/a+b #1 %20 é.parquet"]
    for k, name in enumerate(names):
        rows.where(f"dataset_idx = {k}").select(F.lit("d").alias("dataset"), "local_idx", "pattern").write.parquet(name)
    spark.createDataFrame([(f"File:{n}",) for n in names], "value string").coalesce(1).write.text(f"{folder}-list")
    found = manifest.read_patterns(spark, f"{folder}-list").rows
    total = F.aggregate("pattern", F.lit(0.0), lambda a, x: a + x)
    return rounded(found.select((F.col("file_idx") + 1).alias("file_idx"), "local_idx", total.alias("total")), "total")


# ---- similarity


def _similarity(mode: str, masked: bool = False, size: int = PIXELS):
    def run(spark, sf_dir):
        rows = materialize(stats(spark, sf_dir, MASK if masked else None), "stats")
        return similarity.pair_scores(rows, size, mode, digits=6)

    return run, f"WITH {with_stats_sql(masked)} SELECT a.global_idx AS i, b.global_idx AS j, {R.format(value_sql(mode, size))} AS value FROM s a CROSS JOIN s b"


for _mode in similarity.MODES:
    QUERIES[f"sim_{_mode}"], ORACLES[f"sim_{_mode}"] = _similarity(_mode)
QUERIES["sim_pearson_masked_by_all_pixels"], ORACLES["sim_pearson_masked_by_all_pixels"] = _similarity("pearson", True)
QUERIES["sim_pearson_masked_by_good_pixels"], ORACLES["sim_pearson_masked_by_good_pixels"] = _similarity("pearson", True, 48)

KNN_OUT = f"SELECT i, j, rank, {R.format('value')} AS value FROM k"


@query(f"WITH {knn_sql()} {KNN_OUT}")
def knn_topk(spark, sf_dir):
    return rounded(knn(spark, sf_dir, read_once=True), "value")


@query(f"WITH {knn_sql(k=K)} {KNN_OUT}")
def knn_topk_keepdiag(spark, sf_dir):
    return rounded(knn(spark, sf_dir, Settings(neighbours_kept=K, neighbours_used=K, keep_diagonal=True), True), "value")


@query(f"WITH {knn_sql('covariance')} {KNN_OUT}")
def knn_covariance(spark, sf_dir):
    return rounded(knn(spark, sf_dir, Settings(neighbours_kept=K, neighbours_used=K, divide_by_std=False), True), "value")


@query(f"WITH {knn_sql()} {KNN_OUT}")
def knn_array_functions(spark, sf_dir):
    """Every pattern against all, of which a task keeps the best only."""
    rows = materialize(stats(spark, sf_dir), "stats")
    return rounded(similarity.between(rows, rows, K + 1, PIXELS), "value")


@query(f"WITH {knn_sql()} {KNN_OUT}")
def knn_block_pairs(spark, sf_dir):
    """The way for patterns too large to broadcast: blocks meet in pairs."""
    rows = materialize(stats(spark, sf_dir), "stats")
    # Each pattern is sent once for each block, so there are few blocks, until they have BLOCK_ROWS.
    return rounded(similarity.nearest(rows, K + 1, PIXELS, block_bytes=max(200, rows.count() // 16) * 8 * PIXELS, matrix_bytes=0), "value")


@query(f"WITH {knn_sql()} {KNN_OUT}")
def knn_bounded(spark, sf_dir):
    """Blocks that angles to pivots keep apart never meet."""
    rows = materialize(stats(spark, sf_dir), "stats")
    return rounded(similarity.nearest_bounded(rows, K + 1, block_rows=max(64, rows.count() // 32))[0], "value")


@query(f"WITH {knn_sql()} {KNN_OUT}")
def knn_appended(spark, sf_dir):
    """Every third pattern comes later: the others' neighbours are kept and merged with what it brings."""
    rows = materialize(stats(spark, sf_dir), "stats")
    old, new = rows.where("global_idx % 3 <> 1"), rows.where("global_idx % 3 = 1")
    before = materialize(similarity.nearest(old, K + 1, PIXELS), "knn")
    return rounded(similarity.append_neighbours(before, old, new, K + 1, PIXELS), "value")


@query(f"WITH {knn_sql()} {KNN_OUT}")
def knn_blocked_merge(spark, sf_dir):
    """The neighbours in each of three blocks of columns, merged."""
    rows = materialize(stats(spark, sf_dir), "stats")
    parts = [similarity.between(rows, rows.where(F.col("global_idx") % 3 == b), K + 1, PIXELS) for b in range(3)]
    return rounded(similarity.merge_best(parts, K + 1), "value")


@query(f"WITH {knn_sql(k=4)} {KNN_OUT}")
def knn_prune_k(spark, sf_dir):
    return rounded(graph.prune(knn(spark, sf_dir, read_once=True), 4), "value")


# ---- graph

GRAPH_OUT = f"SELECT i, j, {R.format('w')} AS w FROM"


@query(f"WITH {graph_sql('keep', K + 1)} {GRAPH_OUT} g")
def symmetrized_graph(spark, sf_dir):
    return rounded(graph.symmetrize(knn(spark, sf_dir), "keep"), "w")


@query(f"WITH {graph_sql('zero')} {GRAPH_OUT} g")
def symmetrized_no_diag(spark, sf_dir):
    return rounded(graph.symmetrize(graph.prune(knn(spark, sf_dir), K), "zero"), "w")


@query(f"WITH {graph_sql('one', K + 1)} {GRAPH_OUT} g")
def symmetrized_zero_diag_stored(spark, sf_dir):
    return rounded(graph.symmetrize(knn(spark, sf_dir), "one"), "w")


@query(f"WITH {knn_sql()} SELECT i, j, {R.format('value')} AS w FROM k")
def asymmetric_graph(spark, sf_dir):
    return rounded(knn(spark, sf_dir).select("i", "j", F.col("value").alias("w")), "w")


@query(f"WITH {kernel_sql()} {GRAPH_OUT} w")
def kernel_neg(spark, sf_dir):
    return rounded(weighted(spark, sf_dir), "w")


@query(f"WITH {kernel_sql(sign=1)} {GRAPH_OUT} w")
def kernel_pos(spark, sf_dir):
    return rounded(weighted(spark, sf_dir, sign=1), "w")


_FIRST = f"""{knn_sql()},
t AS (SELECT i, j, exp(value / {TAU}) AS value FROM k),
w AS (SELECT coalesce(a.i, b.j) AS i, coalesce(a.j, b.i) AS j, greatest(coalesce(a.value, 0), coalesce(b.value, 0)) AS w FROM t a FULL JOIN t b ON a.i = b.j AND a.j = b.i WHERE coalesce(a.i, b.j) <> coalesce(a.j, b.i)),
d AS (SELECT j AS i, sum(w) AS deg FROM w GROUP BY j)"""


@query(f"WITH {laplacian_sql('symmetric', _FIRST)} SELECT i, j, {R.format('l')} AS l FROM l")
def kernel_first_laplacian(spark, sf_dir):
    return rounded(graph.kernel_first_laplacian(knn(spark, sf_dir), TAU), "l")


@query(f"WITH {kernel_sql()} SELECT i, {R.format('deg')} AS deg FROM d")
def degree(spark, sf_dir):
    return rounded(graph.degree(weighted(spark, sf_dir)), "deg")


@query(f"WITH {kernel_sql()} SELECT i, {R.format('1 / deg')} AS inv FROM d")
def inv_degree(spark, sf_dir):
    return rounded(graph.inverse_degree(weighted(spark, sf_dir)), "inv")


@query(f"WITH {kernel_sql()} SELECT i, {R.format('1 / sqrt(deg)')} AS inv_sqrt FROM d")
def inv_sqrt_degree(spark, sf_dir):
    return rounded(graph.inverse_sqrt_degree(weighted(spark, sf_dir)), "inv_sqrt")


def _laplacian(kind: str):
    return (lambda spark, sf_dir: rounded(graph.laplacian(weighted(spark, sf_dir), kind), "l")), f"WITH {laplacian_sql(kind)} SELECT i, j, {R.format('l')} AS l FROM l"


QUERIES["laplacian"], ORACLES["laplacian"] = _laplacian("plain")
QUERIES["laplacian_rw"], ORACLES["laplacian_rw"] = _laplacian("random_walk")
QUERIES["laplacian_sym"], ORACLES["laplacian_sym"] = _laplacian("symmetric")

_STEPS = 60
_CURVE = f"""{graph_sql('zero', K + 1)},
grid AS (SELECT range AS idx, -10.0::DOUBLE + range * (20.0::DOUBLE / {_STEPS - 1}) AS log_eps FROM range({_STEPS})),
dens AS (SELECT idx, log_eps, exp(log_eps) AS eps, ln(sum(exp(-w / exp(log_eps))) + 1e-10) AS density FROM g CROSS JOIN grid GROUP BY idx, log_eps),
nrm AS (SELECT *, (density - min(density) OVER ()) / (max(density) OVER () - min(density) OVER ()) AS normalized FROM dens),
curve AS (SELECT *, CASE WHEN lag(normalized) OVER o IS NULL THEN lead(normalized) OVER o - normalized WHEN lead(normalized) OVER o IS NULL THEN normalized - lag(normalized) OVER o
  ELSE (lead(normalized) OVER o - lag(normalized) OVER o) / 2 END AS gradient FROM nrm WINDOW o AS (ORDER BY idx))"""


def curve(spark, sf_dir):
    return graph.tau_curve(graph.symmetrize(knn(spark, sf_dir), "zero"), steps=_STEPS)


@query(f"WITH {_CURVE} SELECT idx::INT AS idx, {R.format('log_eps')} AS log_eps, {R.format('density')} AS density, {R.format('normalized')} AS normalized FROM curve")
def tau_density_curve(spark, sf_dir):
    return rounded(curve(spark, sf_dir).select("idx", "log_eps", "density", "normalized"), "log_eps", "density", "normalized")


@query(f"WITH {_CURVE} SELECT idx::INT AS idx, {R.format('gradient')} AS gradient FROM curve")
def tau_gradient(spark, sf_dir):
    return rounded(curve(spark, sf_dir).select("idx", "gradient"), "gradient")


@query(f"WITH {_CURVE} SELECT idx::INT AS idx, {R.format('eps')} AS eps, idx = {_STEPS - 1} AS at_edge FROM curve ORDER BY gradient DESC, idx LIMIT 1")
def tau_optimal(spark, sf_dir):
    return rounded(graph.best_tau(curve(spark, sf_dir)), "eps")


# ---- spectrum

_START = "v0 AS (SELECT i, (i % 7 + 1)::DOUBLE AS x FROM (SELECT DISTINCT i FROM l))"


@query(f"WITH {laplacian_sql('symmetric')}, {_START} SELECT l.i, {R.format('sum(l.l * v0.x)')} AS x FROM l JOIN v0 ON l.j = v0.i GROUP BY l.i")
def spmv(spark, sf_dir):
    matrix = graph.laplacian(weighted(spark, sf_dir))
    vector = matrix.select("i").distinct().select("i", (F.col("i") % 7 + 1).cast("double").alias("x"))
    return rounded(graph.multiply(matrix, vector), "x")


@query(f"""WITH {laplacian_sql('symmetric')}, {_START},
a1 AS (SELECT l.i, sum(l.l * v.x) AS x FROM l JOIN v0 v ON l.j = v.i GROUP BY l.i), v1 AS (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM a1),
a2 AS (SELECT l.i, sum(l.l * v.x) AS x FROM l JOIN v1 v ON l.j = v.i GROUP BY l.i), v2 AS (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM a2),
a3 AS (SELECT l.i, sum(l.l * v.x) AS x FROM l JOIN v2 v ON l.j = v.i GROUP BY l.i), v3 AS (SELECT i, x / sqrt(sum(x * x) OVER ()) AS x FROM a3)
SELECT i, {R.format('x')} AS x FROM v3""")
def power_iteration_fixed_steps(spark, sf_dir):
    matrix = graph.laplacian(weighted(spark, sf_dir))
    vector = matrix.select("i").distinct().select("i", (F.col("i") % 7 + 1).cast("double").alias("x"))
    for _ in range(3):
        vector = graph.multiply(matrix, vector)
        norm = vector.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        vector = vector.join(F.broadcast(norm)).select("i", (F.col("x") / F.col("norm")).alias("x"))  # one row
    return rounded(vector, "x")


@query(f"WITH {laplacian_sql('symmetric')} SELECT {R.format('sum(l)')} AS trace FROM l WHERE i = j")
def laplacian_trace(spark, sf_dir):
    return rounded(graph.laplacian(weighted(spark, sf_dir)).where("i = j").agg(F.sum("l").alias("trace")), "trace")


def eigen(spark, sf_dir, which="largest", pairs=6):
    return spectral.eigenpairs(graph.laplacian(weighted(spark, sf_dir)), pairs, which)


def spectrum_sql(pairs: int, which: str, squarings: int = 8, steps: int = 100) -> str:
    """CTEs v0, v1 ... (v: a unit vector, value) of the first eigenpairs, for WITH RECURSIVE: ``steps`` steps
    of power iteration with the matrix less a shift, squared ``squarings`` times before, each vector
    made orthogonal to those before it in every step."""
    shift = 0.4 if which == "largest" else 1.2  # the wanted end is the farther one
    out = f"""{laplacian_sql('symmetric')},
ids AS MATERIALIZED (SELECT i, row_number() OVER (ORDER BY i) AS r FROM (SELECT DISTINCT i FROM l)),
q0 AS MATERIALIZED (SELECT a.r AS i, list(coalesce(l.l, 0) - CASE WHEN a.r = b.r THEN {shift} ELSE 0 END ORDER BY b.r) AS row
  FROM ids a CROSS JOIN ids b LEFT JOIN l ON l.i = a.i AND l.j = b.i GROUP BY a.r)"""

    def vector(k: int, power: str) -> str:
        less = "".join(f" - list_inner_product(y, v{m}.v) * v{m}.v[j]" for m in range(k))
        others = "".join(f" CROSS JOIN v{m}" for m in range(k))
        return f""",
r{k}(n, v) AS (SELECT 0, list((r * 7919 % 1009 / 1009.0 - 0.5)::DOUBLE ORDER BY r) FROM ids UNION ALL
  SELECT n + 1, list_transform(z, lambda x: x / sqrt(list_inner_product(z, z))) FROM (
    SELECT n, list_transform(y, lambda x, j: x{less}) AS z FROM (SELECT n, list(list_inner_product(row, v) ORDER BY i) AS y FROM r{k} CROSS JOIN {power} WHERE n < {steps} GROUP BY n){others})),
v{k} AS MATERIALIZED (SELECT v, sum(v[i] * list_inner_product(row, v)) + {shift} AS value FROM q0 CROSS JOIN (SELECT v FROM r{k} WHERE n = {steps}) GROUP BY v)"""

    last, begin = "q0", 0
    if which == "smallest":  # far from the others, so that squares would hide them
        out += vector(0, "q0") + """,
p0 AS MATERIALIZED (SELECT i, list_transform(row, lambda x, j: x - (value - 1.2) * v[i] * v[j]) AS row FROM q0 CROSS JOIN v0)"""
        last, begin = "p0", 1
    for s in range(1, squarings + 1):
        out += f""",
q{s} AS MATERIALIZED (SELECT x.i, list(list_inner_product(x.row, y.row) / n ORDER BY y.i) AS row FROM {last} x CROSS JOIN {last} y
  CROSS JOIN (SELECT sum(list_inner_product(row, row)) AS n FROM {last}) GROUP BY x.i)"""
        last = f"q{s}"
    return out + "".join(vector(k, last) for k in range(begin, pairs))


def _values(which: str, pairs: int = 6) -> str:
    return f"WITH RECURSIVE {spectrum_sql(pairs, which)} " + " UNION ALL ".join(f"SELECT {k} AS k, {R.format('value')} AS value FROM v{k}" for k in range(pairs))


def _signed(k: int) -> str:
    """(i, x): vector k with its entry of the greatest size positive."""
    return f"SELECT ids.i, v[r] * sign(list_aggregate(v, 'max') + list_aggregate(v, 'min')) AS x FROM ids CROSS JOIN v{k}"


@query(_values("largest"))
def eigenvalues_largest(spark, sf_dir):
    return rounded(eigen(spark, sf_dir)[0].select("k", "value"), "value")


@query(_values("smallest"))
def eigenvalues_smallest(spark, sf_dir):
    return rounded(eigen(spark, sf_dir, "smallest")[0].select("k", "value"), "value")


def _residual(k: int) -> str:
    """The norm of matrix times vector k less value times vector, over that of value times vector."""
    return f"""(SELECT sqrt(sum((x - value * v[r]) * (x - value * v[r]))) / abs(any_value(value)) FROM v{k} CROSS JOIN
  (SELECT a.r, sum(l.l * v[b.r]) AS x FROM l JOIN ids a ON a.i = l.i JOIN ids b ON b.i = l.j CROSS JOIN v{k} GROUP BY a.r))"""


@query(f"WITH RECURSIVE {spectrum_sql(6, 'largest')} " + " UNION ALL ".join(f"SELECT {k} AS k, {R.format('value')} AS value, {R.format(_residual(k))} AS residual FROM v{k}" for k in range(6)))
def eigen_residuals(spark, sf_dir):
    return rounded(eigen(spark, sf_dir)[0].select("k", "value", "residual"), "value", "residual")


@query(f"WITH RECURSIVE {spectrum_sql(6, 'largest')} SELECT 6 AS requested, ({' + '.join(f'({_residual(k)} < 1e-6)::INT' for k in range(6))}) AS converged, true AS in_time")
def eigen_diagnostics(spark, sf_dir):
    told = spectral.solve(graph.laplacian(weighted(spark, sf_dir)), 6)[2]
    return spark.range(1).select(F.lit(told.requested).alias("requested"), F.lit(told.converged).alias("converged"), F.lit(told.rounds <= told.most_rounds).alias("in_time"))


@query(f"WITH RECURSIVE {spectrum_sql(3, 'smallest')} SELECT a.i AS global_idx, {R.format('a.x')} AS eigvec_1, {R.format('b.x')} AS eigvec_2 FROM ({_signed(1)}) a JOIN ({_signed(2)}) b USING (i)")
def embedding_wide(spark, sf_dir):
    return rounded(spectral.embedding(eigen(spark, sf_dir, "smallest")[1], [1, 2]), "eigvec_1", "eigvec_2")


_OFFSETS = (1, 5, 25, 125, 625)


@query(f"""WITH n AS (SELECT count(*) AS n FROM customer),
s AS (SELECT {' + '.join(f'2 - 2 * cos(2 * pi() * range * {o} / n)' for o in _OFFSETS)} AS value FROM n, range((SELECT n FROM n)))
SELECT (row_number() OVER (ORDER BY value DESC) - 1)::INT AS k, {R.format('value')} AS value FROM s ORDER BY value DESC LIMIT 6""")
def circulant_spectrum(spark, sf_dir):
    """The customers in a ring, each tied to those some steps ahead: a Laplacian with a known spectrum,
    solved by the iteration for large tables."""
    rows = indexing.dense_index(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), ["c_custkey"], "i").select("i")
    n = rows.count()
    ends = [((F.col("i") + o) % n).alias(f"j{o}") for o in _OFFSETS]
    edges = rows.select("i", F.explode(F.array(*ends)).alias("j")).where("i <> j")
    both = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"))).select("i", "j", F.lit(1.0).alias("w"))
    weights = both.groupBy("i", "j").agg(F.sum("w").alias("w"))
    return rounded(spectral.eigenpairs(graph.laplacian(weights, "plain"), 6, "largest", dense_rows=0)[0].select("k", "value"), "value")


# ---- views

_DRAW = "sha256('9:' || global_idx)"


@query(f"WITH {P} SELECT global_idx, dataset_idx, local_idx FROM p ORDER BY {_DRAW}, global_idx LIMIT 50")
def sample_patterns(spark, sf_dir):
    return browse.sample(patterns(spark, sf_dir), 50, 9).select("global_idx", "dataset_idx", "local_idx").orderBy("global_idx")


_WANTED = ", ".join(f"({k}, {g})" for k, g in enumerate(IDS))


@query(f"WITH {P}, w(pos, g) AS (VALUES {_WANTED}) SELECT pos, global_idx, dataset_idx, local_idx FROM p JOIN w ON g = global_idx")
def lookup_by_ids(spark, sf_dir):
    return indexing.lookup(patterns(spark, sf_dir), IDS).select("pos", "global_idx", "dataset_idx", "local_idx").orderBy("pos")


@query(f"WITH {P}, w(pos, g) AS (VALUES {_WANTED}) SELECT (row_number() OVER (ORDER BY file_idx, dataset_idx, pos) - 1)::INT AS out, pos, global_idx FROM p JOIN w ON g = global_idx")
def lookup_grouped_order(spark, sf_dir):
    return indexing.grouped_positions(indexing.lookup(patterns(spark, sf_dir), IDS)).select("out", "pos", "global_idx")


@query(f"WITH {P}, w AS (SELECT o_orderkey AS pos, o_custkey % 600 AS g FROM orders) SELECT pos, global_idx, vec_id FROM p JOIN w ON g = global_idx")
def lookup_by_table(spark, sf_dir):
    """One pattern for each order, by a table of requests with repeats and numbers that don't exist."""
    folder = scratch_path(spark, "indexed")
    indexing.save_indexed(patterns(spark, sf_dir), folder, 100)
    wanted = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 600).alias("global_idx"))
    return indexing.lookup_table(spark, folder, wanted, 100).select("pos", "global_idx", "vec_id")


def _edges() -> str:
    terms = []
    for (x0, y0), (x1, y1) in zip(POLYGON, POLYGON[1:] + POLYGON[:1]):
        terms.append(f"CASE WHEN y >= {min(y0, y1)} AND y < {max(y0, y1)} AND x < {x0} + (y - {y0}) * ({(x1 - x0) / (y1 - y0)!r})::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(terms)


@query(f"WITH {XY} SELECT global_idx, {R.format('x')} AS x, {R.format('y')} AS y FROM xy WHERE ({_edges()}) % 2 = 1")
def polygon_select(spark, sf_dir):
    rows = points(spark, sf_dir)
    return rounded(rows.where(browse.in_polygon(F.col("x"), F.col("y"), POLYGON)).select("global_idx", "x", "y"), "x", "y")


_ALL = zorder.Limits(-0.5, 0.5, -0.5, 0.5)


@query(f"WITH {XY} SELECT global_idx, {R.format('x')} AS x, {R.format('y')} AS y FROM xy WHERE ({_edges()}) % 2 = 1")
def polygon_select_zorder(spark, sf_dir):
    folder = scratch_path(spark, "zordered")
    zorder.save_points(points(spark, sf_dir), folder, _ALL)
    return rounded(zorder.select_polygon(spark, folder, POLYGON, _ALL).select("global_idx", "x", "y"), "x", "y")


@query(f"WITH {XY} SELECT global_idx FROM xy WHERE x BETWEEN -0.05 AND 0.1 AND y BETWEEN -0.1 AND 0.07")
def box_select_zorder(spark, sf_dir):
    folder = scratch_path(spark, "zordered")
    zorder.save_points(points(spark, sf_dir), folder, _ALL)
    return zorder.select_box(spark, folder, -0.05, 0.1, -0.1, 0.07, _ALL).select("global_idx")


_LEVELS = 6
_PYRAMID = " UNION ALL ".join(f'SELECT {k} AS level, floor((x - -0.5::DOUBLE) / (1.0::DOUBLE / {1 << k}))::INT AS bx, floor((y - -0.5::DOUBLE) / (1.0::DOUBLE / {1 << k}))::INT AS "by", attribute FROM xy WHERE x >= -0.5 AND x < 0.5 AND y >= -0.5 AND y < 0.5' for k in range(_LEVELS + 1))


@query(f'WITH {XY} SELECT level, bx, "by", count(*) AS n, {R.format("sum(attribute)")} AS total FROM ({_PYRAMID}) GROUP BY ALL')
def raster_pyramid(spark, sf_dir):
    return rounded(zorder.raster_pyramid(points(spark, sf_dir), _ALL, _LEVELS, "attribute").drop("tile"), "total")


@query(f"""WITH {XY}, f AS (SELECT floor((x - -0.5::DOUBLE) / (1.0::DOUBLE / 32))::INT AS bx, floor((y - -0.5::DOUBLE) / (1.0::DOUBLE / 32))::INT AS "by" FROM xy WHERE x >= -0.5 AND x < 0.5 AND y >= -0.5 AND y < 0.5)
SELECT bx, "by", count(*) AS n FROM f WHERE bx >= 16 AND bx < 24 AND "by" >= 8 AND "by" < 16 GROUP BY ALL""")
def raster_zoom(spark, sf_dir):
    """The fifth level of a stored pyramid, of the part (2, 1) of the second."""
    folder = scratch_path(spark, "pyramid")
    zorder.save_pyramid(zorder.raster_pyramid(points(spark, sf_dir), _ALL, _LEVELS), folder)
    return zorder.read_tiles(spark, folder, 5, 0b0110, 2).select("bx", "by", "n")


@query(f"WITH {XY} SELECT global_idx FROM xy WHERE x BETWEEN -0.05 AND 0.1 AND y BETWEEN -0.1 AND 0.07")
def box_select(spark, sf_dir):
    return points(spark, sf_dir).where(browse.in_box(F.col("x"), F.col("y"), -0.05, 0.1, -0.1, 0.07)).select("global_idx")


@query(f"""WITH {XY}, m AS (SELECT *, min(x) OVER () AS x0, max(x) OVER () AS x1, min(y) OVER () AS y0, max(y) OVER () AS y1 FROM xy),
r AS (SELECT least(floor((x - x0) / ((x1 - x0) / 16)), 15)::INT AS bx, least(floor((y - y0) / ((y1 - y0) / 16)), 15)::INT AS "by", count(*) AS n FROM m GROUP BY ALL)
SELECT 'raster' AS part, bx, "by", n, NULL::BIGINT AS global_idx, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM r UNION ALL
SELECT 'sample', NULL, NULL, NULL, global_idx, {R.format('x')}, {R.format('y')} FROM (SELECT * FROM xy ORDER BY {_DRAW}, global_idx LIMIT 40)""")
def background_sample(spark, sf_dir):
    """The raster of all coordinates and the positions of a sample of them."""
    vectors = points(spark, sf_dir).select(F.posexplode(F.array("x", "y")).alias("k", "value"), "global_idx")
    _, counted, drawn = browse.background_and_sample(vectors, 0, 1, 16, 40, 9)
    return counted.withColumn("part", F.lit("raster")).unionByName(rounded(drawn, "x", "y").withColumn("part", F.lit("sample")), allowMissingColumns=True)


def _rolling(by: str):
    sql = f"""WITH {XY} SELECT global_idx, CASE WHEN count(*) OVER o = 50 THEN {R.format('avg(attribute) OVER o')} END AS rolling FROM xy
WINDOW o AS (ORDER BY {by}, global_idx ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)"""
    return (lambda spark, sf_dir: rounded(browse.rolling_mean(points(spark, sf_dir), by, "attribute", block=128).select("global_idx", "rolling"), "rolling")), sql


QUERIES["rolling_mean_x"], ORACLES["rolling_mean_x"] = _rolling("x")
QUERIES["rolling_mean_y"], ORACLES["rolling_mean_y"] = _rolling("y")

_BOX = (16, -0.4, 0.4, -0.4, 0.4)
_BIN = "floor(({0} - -0.4::DOUBLE) / ((0.4::DOUBLE - -0.4::DOUBLE) / 16))::INT"
_IN = f"WITH {XY} SELECT {_BIN.format('x')} AS bx, {_BIN.format('y')} AS by, count(*) AS n{{}} FROM xy WHERE x >= -0.4 AND x < 0.4 AND y >= -0.4 AND y < 0.4 GROUP BY ALL"


@query(_IN.format(""))
def raster_count(spark, sf_dir):
    return browse.raster(points(spark, sf_dir), "x", "y", *_BOX)


@query(_IN.format(f", {R.format('avg(attribute)')} AS mean_attribute"))
def raster_mean(spark, sf_dir):
    return rounded(browse.raster(points(spark, sf_dir), "x", "y", *_BOX, "attribute"), "mean_attribute")


@query(f"""WITH {with_stats_sql()}, {XY} SELECT xy.global_idx, {R.format('x')} AS x, {R.format('y')} AS y, {R.format('mean')} AS mean, {R.format('std')} AS std, {R.format('std')} AS variance,
{R.format('attribute')} AS attribute, category FROM xy JOIN s ON s.vec_id = xy.global_idx""")
def browser_frame(spark, sf_dir):
    rows = points(spark, sf_dir)
    own = stats(spark, sf_dir).select(F.col("vec_id").alias("global_idx"), "mean", "std")
    frame = browse.browser_frame(rows.select("global_idx", "x", "y"), own, rows.select("global_idx", "attribute", "category"))
    return rounded(frame, "x", "y", "mean", "std", "variance", "attribute")


@query(f"WITH {XY}, v AS (SELECT 0 AS k, x AS value FROM xy UNION ALL SELECT 1, y FROM xy UNION ALL SELECT 2, attribute FROM xy) SELECT k, {R.format('min(value)')} AS low, {R.format('max(value)')} AS high FROM v GROUP BY k")
def axis_limits(spark, sf_dir):
    vectors = points(spark, sf_dir).select(F.posexplode(F.array("x", "y", "attribute")).alias("k", "value"))
    return rounded(browse.axis_limits(vectors), "low", "high")


@query(f"WITH {XY} SELECT global_idx, {R.format('(attribute - min(attribute) OVER ()) / (max(attribute) OVER () - min(attribute) OVER ())')} AS color FROM xy")
def color_scale(spark, sf_dir):
    return rounded(browse.color_scale(points(spark, sf_dir), "attribute").select("global_idx", "color"), "color")


@query(f"""WITH {P}, f AS (SELECT * FROM p ORDER BY {_DRAW}, global_idx LIMIT 12), o AS (SELECT *, row_number() OVER (ORDER BY global_idx) - 1 AS at FROM f)
SELECT (r.range // 4)::INT AS row, (r.range % 4)::INT AS col, global_idx, {R.format('coalesce(list_sum(v), 0)')} AS total FROM range(12) r LEFT JOIN o ON o.at = r.range""")
def grid_pad(spark, sf_dir):
    grid = browse.pattern_grid(patterns(spark, sf_dir), 3, 4, PIXELS, 9)
    total = F.aggregate("pattern", F.lit(0.0), lambda a, x: a + x)
    return rounded(grid.select("row", "col", "global_idx", total.alias("total")), "total")


@query(f"WITH {XY} SELECT global_idx, (ntile(5) OVER (ORDER BY x, global_idx) - 1)::INT AS category FROM xy")
def angle_category(spark, sf_dir):
    return browse.equal_blocks(points(spark, sf_dir).drop("category"), "x", 5, _total(spark, sf_dir)).select("global_idx", "category")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, eigvec_0, eigvec_1: from patterns to coordinates."""
    rows = patterns(spark, sf_dir)
    settings = Settings(neighbours_kept=K, neighbours_used=K, eigenpairs=4)
    found, _ = pipeline.neighbours(rows, settings)
    _, vectors, _ = pipeline.eigensystem(found, settings)
    coordinates = spectral.embedding(vectors, [0, 1])
    return rows.select("global_idx", "vec_id", F.col("dataset_idx").alias("label")).join(coordinates, "global_idx").drop("global_idx")
