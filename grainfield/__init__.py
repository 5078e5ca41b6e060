"""grainfield: sparse-matrix cell analytics expressed as PySpark DataFrame plans."""
