"""Session defaults and the few settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: str = "8", name: str = "palimpsest", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
    builder = builder.config("spark.sql.shuffle.partitions", str(conf.pop("shuffle_partitions", 8)))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share.

    Only where it is unset and the master is local (tests, bench) is a folder made, and it goes
    when the session's JVM ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    if spark.sparkContext.applicationId not in _LOCAL:
        _LOCAL.clear()
        _LOCAL[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="run-shared-")
        _drop_on_exit(spark, _LOCAL[spark.sparkContext.applicationId])
    return _LOCAL[spark.sparkContext.applicationId]


def _drop_on_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def scratch_folder(spark: SparkSession) -> str:
    """A new folder among the shared ones; it goes when the session's JVM ends."""
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    _drop_on_exit(spark, folder)
    return folder


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: cuts lineage, outlives
    executors, and tells Spark the table's size. The table goes when the session's JVM ends."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}/{name}"
    df.write.parquet(folder, compression=codec)
    _drop_on_exit(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def packed(df: DataFrame) -> DataFrame:
    """The same for rows that need much space, packed as tightly as they can be."""
    return written(df, "rows", "zstd")


class Parts(Mapping):
    """Named tables, each worked out when it is first asked for: a job that reads one writes nothing for the others."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]) -> None:
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
