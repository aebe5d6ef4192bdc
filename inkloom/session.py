"""Sessions and the shared working folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, app: str = "inkloom") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names. Where it is unset, a session on
    one machine, as in tests, gets a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not _one_machine(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, None) or f"file://{tempfile.mkdtemp(prefix='inkloom-')}"
        _own[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


#: Temporary folders of sessions on one machine, by application.
_own: dict[str, str | None] = {}


def _one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors. ``keep`` deletes what only
    steps in between needed; the rest goes when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: list[str] = []
        atexit.register(self._clear)

    def path(self, name: str = "t") -> str:
        self.saved.append(f"{self.root}/{name}{len(self.saved) + 1}")
        return self.saved[-1]

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Writes the rows and returns them as read from there."""
        to = self.path(name)
        df.write.parquet(to)
        out = self.spark.read.schema(df.schema).parquet(to)
        out._inkloom_path = to
        return out

    def drop(self, *saved: DataFrame) -> None:
        """Deletes saved tables that nothing reads any more."""
        self._delete([df._inkloom_path for df in saved])

    def keep(self, *saved: DataFrame) -> None:
        """Deletes all saved tables but these."""
        kept = {df._inkloom_path for df in saved}
        self._delete([p for p in self.saved if p not in kept])

    def _delete(self, paths: list[str]) -> None:
        for p in paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                self._delete([self.root])
        except Exception:  # the session ended before the program
            pass
