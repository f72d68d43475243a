"""Readers: manifests, line lists, result files, archives, and the adapters from the given tables."""
