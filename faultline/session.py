"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; anything passed in ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(name).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a scale-factor directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
