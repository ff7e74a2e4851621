"""kinfold: record linkage and blocking analytics expressed as Spark logical plans."""
