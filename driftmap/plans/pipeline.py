"""The whole way from patterns to coordinates."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame

from driftmap.config import Settings
from driftmap.operators import graph, pixels, similarity, spectral
from driftmap.sources.scratch import materialize


def neighbours(rows: DataFrame, settings: Settings, mask: list[float] | None = None, read_once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(knn, stats) of ``rows`` (global_idx, pattern); ``read_once`` says that nothing needs to be written."""
    stats = pixels.with_stats(rows.select("global_idx", "pattern"), mask)
    stats = stats if read_once else materialize(stats, "stats")
    size = len(mask) if mask and settings.inner_norm == "total" else None
    knn = similarity.nearest(stats, settings.columns_stored, size, settings.mode, least_blocks=settings.column_batches)
    return knn if read_once else materialize(knn, "knn"), stats.select("global_idx", "mean", "std")


def weights(knn: DataFrame, settings: Settings) -> tuple[DataFrame, float]:
    """(the kernel's weights, tau)"""
    symmetric = materialize(graph.symmetrize(graph.prune(knn, settings.neighbours_used), "keep" if settings.keep_diagonal else settings.diagonal), "graph")
    tau = settings.tau
    if tau == "auto":
        found = graph.best_tau(graph.tau_curve(symmetric, steps=200)).first()
        tau = found.eps
        if found.at_edge:
            warnings.warn(f"the curve of scales is steepest at its end, {tau}", stacklevel=2)
    return graph.kernel(symmetric, tau, settings.kernel_sign), tau


def eigensystem(knn: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, float]:
    """(eigenvalues, eigenvectors, tau)"""
    weighted, tau = weights(knn, settings)
    values, vectors = spectral.eigenpairs(graph.laplacian(weighted, settings.laplacian), settings.eigenpairs, settings.which)
    return values, vectors, tau
