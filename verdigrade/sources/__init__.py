"""Readers of tables, dataset packs and artifacts."""
