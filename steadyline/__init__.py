"""Process-quality analytics expressed as Spark DataFrame plans."""
