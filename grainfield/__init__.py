"""grainfield: Spark-first analytics over coded sample grids and tables."""
