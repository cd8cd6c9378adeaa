"""Readers, manifests and stores."""
