"""Notes, lines, spans and routing thresholds as Spark DataFrames."""
