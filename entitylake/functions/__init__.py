"""Column-level building blocks (no DataFrames, no actions)."""
