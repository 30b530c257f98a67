"""Column-expression helpers. All return ``pyspark.sql.Column`` built from
built-in functions so they stay inside whole-stage codegen."""
