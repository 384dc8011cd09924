"""Panel-data operators for Spark: every function takes and returns DataFrames or Columns."""
