"""Document quality and production analytics expressed as Spark plans."""
