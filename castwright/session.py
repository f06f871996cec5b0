"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

_METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_DEFAULT_LIMIT = "65535"
_HOTSPOT_LIMIT = "8000"


def tune(spark: SparkSession) -> None:
    """Keep generated methods small enough for the JVM to compile them to machine code.

    HotSpot interprets methods above 8000 bytes of bytecode, which makes a fused
    stage of many value rules some ten times slower.  With this documented limit
    Spark runs such a stage as separate projections with small methods.  A limit
    set by the user is left alone.
    """
    if spark.conf.get(_METHOD_LIMIT, _DEFAULT_LIMIT) == _DEFAULT_LIMIT:
        spark.conf.set(_METHOD_LIMIT, _HOTSPOT_LIMIT)
