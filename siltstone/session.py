"""Sessions with the settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rank filters up to this many rows a group are pushed below the exchange; mining keeps 2,048.
    "spark.sql.optimizer.windowGroupLimitThreshold": "4096",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Bytes of an Arrow batch to or from Python; a batch lies several times in the memory of the JVM and of the worker.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches hold BATCH_BYTES at most, or one longer row. A smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, "64m")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def session(name: str = "siltstone", **settings) -> SparkSession:
    """The running session, or a new one; `settings` go over the defaults."""
    builder = SparkSession.builder.appName(name)
    for k, v in {**SETTINGS, **settings}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
