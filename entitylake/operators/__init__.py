"""DataFrame-level operators, grouped by the stage of the data flow they serve."""
