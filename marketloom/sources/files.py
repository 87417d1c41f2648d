"""Folders as tables need them, on whatever file system the session's paths name."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._settings = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, text: str):
        path = self._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self._settings), path

    def exists(self, text: str) -> bool:
        files, path = self._at(text)
        return files.exists(path)

    def names(self, text: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        files, path = self._at(text)
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def size(self, text: str) -> int:
        """Bytes in a folder."""
        files, path = self._at(text)
        return files.getContentSummary(path).getLength()

    def mark(self, text: str) -> None:
        """An empty file."""
        files, path = self._at(text)
        files.create(path, True).close()

    def make(self, text: str) -> None:
        files, path = self._at(text)
        files.mkdirs(path)

    def delete(self, text: str) -> None:
        """A file or a whole folder; nothing if it is not there."""
        files, path = self._at(text)
        files.delete(path, True)

    def move(self, source: str, target: str) -> None:
        files, path = self._at(source)
        if not files.rename(path, self._at(target)[1]):
            raise OSError(f"could not move {source} to {target}")
