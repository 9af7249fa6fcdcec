"""Input tables: driver parquet, the binding to the order model, file readers and writers."""
