"""Column-level helpers: windows, folds, rounding and formatting."""
