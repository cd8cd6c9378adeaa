import math
import os
import random

import duckdb
import pytest

from driftmap.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = ["eigenvalues_smallest", "embedding_wide", "flatten_pattern", "mask_round_trip", "batch_scan", "batch_grid_2d", "background_sample", "grid_pad", "global_index_map", "batch_ends", "masked_stats", "sim_pearson_masked_by_all_pixels", "knn_topk", "symmetrized_zero_diag_stored", "laplacian_sym", "tau_optimal", "polygon_select", "rolling_mean_x", "raster_mean", "angle_category"]


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 9) + 0.0) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_duckdb(spark, name):
    c = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, SF)
    want = c.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda found, names: sorted((tuple(plain(r[names.index(k)]) for k in columns) for r in found), key=repr)
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_flagship(spark):
    if os.path.isdir(SF):
        assert catalogue.flagship(spark, SF).columns == ["vec_id", "label", "eigvec_0", "eigvec_1"]


def test_blocks_of_neighbours_are_few_and_pairs_are_not_made_one_by_one(spark, tmp_path, monkeypatch):
    """Patterns are sent once for each block, so blocks must not grow in number with the patterns."""
    rng = random.Random(2)
    rows = [(k, [rng.random() for _ in range(64)], k % 3) for k in range(4000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(catalogue.similarity, "pair_scores", None)
    merged = sorted(map(tuple, catalogue.QUERIES["knn_blocked_merge"](spark, str(tmp_path)).collect()))
    asked, nearest = [], catalogue.similarity.nearest
    monkeypatch.setattr(catalogue.similarity, "nearest", lambda *a, **k: asked.append(k["block_bytes"]) or nearest(*a, **k))
    pairs = sorted(map(tuple, catalogue.QUERIES["knn_block_pairs"](spark, str(tmp_path)).collect()))
    assert -(-4000 * 64 * 8 // asked[0]) <= 16
    assert merged == pairs and len(pairs) == 11 * 4000


@pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
def test_pairs_are_not_rounded_one_by_one(spark):
    for name in ("sim_inner", "sim_normalized", "sim_pearson", "sim_pearson_masked_by_all_pixels"):
        assert "round(" not in catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
