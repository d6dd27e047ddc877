"""Session defaults and table readers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit both a laptop and a large cluster; sizes of shuffles are left to AQE.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

#: Settings that bound memory, whatever the input: a file's rows take ten times its bytes, or far more, once they are read, so that Spark's
#: estimate, by which it sends tables to the driver and all executors at once, must not be the bytes; and what a task gets
#: after a shuffle is a quarter of the default 64 MB, as compressed ids take some twenty times that in hash tables.
ROWS_BY_FILE, TASK_BYTES = "10.0", 16 << 20


def tune(spark: SparkSession) -> SparkSession:
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def bounded(spark: SparkSession) -> SparkSession:
    """Set what bounds memory, where the session isn't stricter."""
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor")) < float(ROWS_BY_FILE):
        spark.conf.set("spark.sql.sources.fileCompressionFactor", ROWS_BY_FILE)
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))
    if size > TASK_BYTES:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
