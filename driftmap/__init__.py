"""Manifold learning, similarity graphs and corpus preparation as Spark jobs."""
