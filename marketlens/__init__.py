"""News-impact analytics expressed as Spark DataFrame, ML and streaming plans."""
