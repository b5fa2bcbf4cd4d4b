"""Daily price-bar screening on Spark: ingest, indicators, pair metrics, reports."""
