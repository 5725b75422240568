"""Session settings that the order plans profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: HotSpot does not compile methods of more bytes; a projection of some forty columns would be interpreted row by row.
#: Beyond this size Spark splits a projection into several methods instead.
HUGE_METHOD = 8000


def tune(spark: SparkSession) -> SparkSession:
    """Set what is still at its default; a smaller limit is left as it is."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name, "65535")) > HUGE_METHOD:
        spark.conf.set(name, str(HUGE_METHOD))
    return spark
