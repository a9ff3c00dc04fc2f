"""Collections over Parquet: reading, writing and the catalogue."""
