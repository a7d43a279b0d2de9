"""holdfast: preservation-inventory analytics expressed as Spark DataFrame plans."""
