"""spanloom: corpus annotation, concept linking and relation operators on Spark DataFrames."""
