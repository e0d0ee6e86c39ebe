"""bytewren: analytics over byte, bit and token streams on PySpark."""
