"""Session, table access, lineage cuts and size-checked collection, shared by all operators."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


class SizeBoundExceeded(ValueError):
    """A side that was to be sent to every executor is larger than its stated bound."""


def local_session(cores: int | str = 8, app: str = "bidloom", memory: str = "12g") -> SparkSession:
    """A session on this machine, for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores if isinstance(cores, int) else 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it comes in fewer partitions than there are cores (a small table in one file), before work
    that costs far more than moving its rows; tables of many partitions stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back to a temporary one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "bidloom-checkpoints")
    context.setCheckpointDir(named)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage there; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_rows(df: DataFrame, most: int, what: str) -> list[Row]:
    """The rows of df on the driver, or SizeBoundExceeded if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise SizeBoundExceeded(f"{what} has more than {most} rows")
    return rows


def is_empty(df: DataFrame) -> bool:
    return not df.select(F.lit(1)).take(1)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per application, so that Python tasks can import it. It goes
    through the shared checkpoint folder."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    ensure_checkpoint_dir(spark)
    here = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for root, _, files in os.walk(here):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.join("bidloom", os.path.relpath(full, here)))
    path = f"{context.getCheckpointDir()}/bidloom-src.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target, True)
    stream.write(bytearray(packed.getvalue()))
    stream.close()
    context.addPyFile(path)
    _shipped.add(context.applicationId)
