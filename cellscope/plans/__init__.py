"""Registered queries: each is a Spark plan over the given tables plus, where the
semantics are expressible in SQL, an equivalent DuckDB oracle."""
