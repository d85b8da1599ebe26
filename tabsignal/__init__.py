"""Pattern discovery on tabular panel data, as lazy Spark plans."""
