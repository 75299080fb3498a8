"""Field-survey analytics on PySpark."""
