"""Analytics over temporal knowledge graphs on PySpark."""
