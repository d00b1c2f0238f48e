"""docstrata: analytics over large collections of versioned documents, on PySpark."""
