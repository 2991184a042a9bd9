"""Column builders: expressions that take and return columns."""
