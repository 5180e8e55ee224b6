"""Change data capture on PySpark: decode, flatten, fold and evolve row changes."""
