"""Evidence analytics on Spark: which published values are really backed by captures."""
