"""Market-bar analytics on Spark: bars, features, structure, analyzers."""
