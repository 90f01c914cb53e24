"""Lineage cuts and files on the session's own file system."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Makes checkpoint() usable: the cluster's spark.checkpoint.dir, or, where it is unset and everything runs in one process, a folder of this machine. Elsewhere an unset folder is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            shared = tempfile.mkdtemp(prefix="lamina-checkpoint-")
        context.setCheckpointDir(shared)
    return spark


def cut(frame: DataFrame) -> DataFrame:
    """The frame with its lineage cut, its rows in the shared checkpoint folder: for what several branches read."""
    ready(frame.sparkSession)
    return frame.checkpoint()


class Storage:
    """Small files and folders by Hadoop paths, so that a run folder may lie in any store that Spark reaches."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.conf), place

    def exists(self, path: str) -> bool:
        files, place = self._at(path)
        return files.exists(place)

    def occupied(self, path: str) -> bool:
        files, place = self._at(path)
        return files.exists(place) and len(files.listStatus(place)) > 0

    def resolved(self, path: str) -> str:
        files, place = self._at(path)
        return str(files.makeQualified(place).toString()).rstrip("/")

    def make(self, path: str) -> None:
        files, place = self._at(path)
        files.mkdirs(place)

    def remove(self, path: str) -> None:
        files, place = self._at(path)
        files.delete(place, True)

    def read(self, path: str) -> str:
        files, place = self._at(path)
        stream = files.open(place)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """All of the text or none: written beside the file, then renamed."""
        files, place = self._at(path)
        beside = self.jvm.org.apache.hadoop.fs.Path(f"{path}.partial")
        stream = files.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if files.exists(place):
            files.delete(place, False)
        if not files.rename(beside, place):
            raise OSError(f"{path} was not written")
