"""Training-data operators. Nothing outside this package imports it, except the guarded
registration in ``__spark_entry__.py``."""
