"""Column builders. Each takes and gives Columns, so Catalyst plans them, on batch and streaming DataFrames alike."""
