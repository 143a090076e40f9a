"""loomwork: a DataFrame-first analytics library for PySpark."""
