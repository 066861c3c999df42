"""Session settings and the shared scratch folder."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = 8, name: str = "gazette") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; only a local session may
    leave that unset and gets a temporary folder, remembered in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.gazette.scratch", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-gazette-")
        spark.conf.set("spark.gazette.scratch", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored_once(df, label: str):
    """The rows as Parquet in the shared folder: made once however many plans read them, and each reads its columns only."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class StoredFrames:
    """Frames stored for one piece of work, which drops them when it is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df, label: str):
        """As :func:`stored_once`."""
        self.paths.append(scratch_path(self.spark, label))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        """Delete their files; frames made from them can't be read any more."""
        while self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def rows_frame(spark: SparkSession, rows: list[tuple], ddl: str):
    """A few literal rows as a DataFrame that stays in the plan.

    Rows handed to ``createDataFrame`` become a Python-fed scan; these are one
    folded literal, so reading them starts no Python worker.
    """
    names = [part.split()[0] for part in re.split(r",\s*(?![^<]*>)", ddl)]
    literal = F.lit(json.dumps([dict(zip(names, row)) for row in rows], ensure_ascii=False))
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(literal, f"array<struct<{struct_ddl(ddl)}>>")))


def struct_ddl(ddl: str) -> str:
    """``a int, b string`` as the fields of a struct type."""
    return re.sub(r"(^|,\s*)(\w+)\s+(?=\w)", r"\1\2:", ddl)


def reliable_checkpoint(df):
    """Cut the lineage with a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
