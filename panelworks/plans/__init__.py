"""Table-level compositions of the operators."""
