"""tidemark: point-in-time analytics over event and price tables, as plain Spark plans."""
