"""Composite queries: the registered query catalogue, its SQL oracles and module reports."""
