"""Small files on whatever file system Spark is set up for (local, HDFS, object stores), through its own classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def text(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def put(self, path: str, text: str) -> None:
        """Replaces the file in one step: it is written beside its place, then renamed over it."""
        part = f"{path}.part"
        stream = self._fs(part).create(self._path(part), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        where = self._fs(path).getUri()
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where, self.conf).rename(self._path(part), self._path(path), options)

    def remove(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)

    def folders(self, path: str) -> list[str]:
        if not self.exists(path):
            return []
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)) if s.isDirectory())

    def listed(self, path: str, ending: str) -> list[str]:
        """Names of the files in a folder that end so, in order."""
        return sorted(n for n in (s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)) if s.isFile()) if n.endswith(ending))

    def set_time(self, path: str, ms: int) -> None:
        self._fs(path).setTimes(self._path(path), ms, -1)
