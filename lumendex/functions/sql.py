"""The engine's functions under names that ``spark.sql`` knows, as SQL functions that Catalyst inlines.
The natural logarithm is built in: ``ln``."""

from __future__ import annotations

from pyspark.sql import SparkSession

_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), CAST(0 AS DOUBLE), (s, x) -> s + x)"
FUNCTIONS = {
    "vector_dot": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", _DOT.format(a="a", b="b")),
    "vector_magnitude": ("a ARRAY<FLOAT>", "DOUBLE", f"sqrt({_DOT.format(a='a', b='a')})"),
    "chunk_uuid": ("digest STRING", "STRING", "regexp_replace(substr(digest, 1, 32), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5')"),
}


def register(spark: SparkSession) -> None:
    """Registers FUNCTIONS for a session; again does no harm."""
    for name, (parameters, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}")
