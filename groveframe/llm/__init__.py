"""Training-data operators: fingerprints, dedup, scoring, mixing and output formats, as Spark jobs."""
