"""lintel: a typed expression, validation and versioned-data engine on PySpark."""
