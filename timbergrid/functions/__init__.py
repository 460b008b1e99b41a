"""Column expressions and driver-side helpers."""
