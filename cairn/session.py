"""Session helpers: a local session for tests, and tables in the shared folder that cut lineage.

The shared folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is
absent (tests, a laptop) a folder of our own is made, once per process. Intermediate tables are written
there as Parquet, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def local_session(cores: int = 8, partitions: int | None = None) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairn")
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master that leaves it unset, one of our own. A cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="cairn-")
    return _OWN[app]


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path objects for ``path``."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cairn/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and every reader sees one result."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that no later step reads."""
    for df in frames:
        path = getattr(df, "_cairn_path", None)
        if path:
            fs, p = filesystem(df.sparkSession, path)
            fs.delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_index(df: DataFrame, order: list[Column | str], name: str, group: list[str] | None = None) -> DataFrame:
    """Add ``row_index``, the 0-based place of each row in ``order`` (within ``group`` if given), without ever
    sending one group to one task.

    The rows are range-partitioned and sorted (group columns first), written once so that places are stable, and
    numbered per partition; what precedes a partition is added from one count per (partition, group), a table
    that holds at most one row for each pair of a partition and a group beginning in or crossing it. Rows that
    tie on ``order`` are numbered in an arbitrary but fixed order, so ``order`` should end in a key.
    """
    spark, group = df.sparkSession, group or []
    keys = [F.col(g) for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    placed = placed.withColumn("_pid", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, name)
    starts = placed.groupBy("_pid", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_pid") if group else Window.orderBy("_pid")  # at most one row per partition
    starts = starts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    renamed = starts.select(F.col("_pid").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_first", "_before")
    on = F.col("_pid") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = placed.join(renamed, on, "inner")
    return joined.withColumn("row_index", F.col("_at") - F.col("_first") + F.col("_before")).select(*df.columns, "row_index")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package, data = Path(__file__).resolve().parent, io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f.relative_to(package.parent))
        archive = f"{new_path(spark, 'code')}/cairn-code.zip"
        fs, path = filesystem(spark, archive)
        out = fs.create(path, True)
        out.write(bytearray(data.getvalue()))
        out.close()
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
    return spark
