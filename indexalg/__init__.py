"""indexalg: algebra over indexed symbols, evaluated as Spark DataFrames."""
