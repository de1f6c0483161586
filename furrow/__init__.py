"""An analytics engine for multi-objective benchmark studies, on Spark DataFrames."""
