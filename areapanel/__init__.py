"""Area-by-year panel analytics written as Spark DataFrame operators."""
