"""Tables in the cluster's shared folder: lineage ends where one is written, whatever executor is lost later."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); a temporary one in local mode where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tallyweave-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def cut(df: DataFrame, what: str) -> DataFrame:
    """The rows, written to the shared folder and reread."""
    return Scratch(df.sparkSession).cut(df, what)


class Scratch:
    """The tables that one run of an operator writes. Each goes once nothing lazy reads it any more; what is left when the
    run ends goes with end(), which keeps its result alone."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def cut(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table), (None, None))
            if path:
                target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)

    def end(self, result: DataFrame, what: str) -> DataFrame:
        """The result as a table of its own; all others of this run are removed."""
        kept = Scratch(self.spark).cut(result, what)
        self.drop(*[table for table, _ in self.paths.values()])
        return kept
