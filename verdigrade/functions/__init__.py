"""Column builders: text, keys, statistics, metrics."""
