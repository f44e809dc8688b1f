"""Document ingest, hybrid retrieval and report analytics as Spark plans."""
