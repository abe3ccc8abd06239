"""Readers: vault trees, word-processor files, plans, registries, test tables."""
