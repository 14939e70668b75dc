"""Session helpers and the place where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: set[str] = set()


def get_spark(app: str = "lumbung", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use. On a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a temporary one in local mode only."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = tempfile.mkdtemp(prefix="lumbung-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def work_dir(spark: SparkSession) -> str:
    """This application's own part of the shared folder. In local mode it goes when Python ends; on a cluster, call
    :func:`release` when the results are written."""
    path = f"{shared_dir(spark)}/lumbung/{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        if spark.sparkContext.master.startswith("local"):
            atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path


def release(spark: SparkSession) -> None:
    """Deletes what this application wrote to the shared folder; results that weren't written yet can't be read then."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes ``df`` as a table to the shared folder and reads it back, so that later steps neither recompute it nor
    depend on the executor that made it. Compressed columnar files take less room than checkpoint() would."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
