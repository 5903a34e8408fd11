"""Evidence-gated record resolution and evaluation analytics on PySpark."""
