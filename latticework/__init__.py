"""latticework: entity-by-year panel analytics expressed as Spark DataFrame plans."""
