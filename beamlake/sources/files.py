"""File operations through Hadoop's file system API, so on any store that Spark reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class FileStore:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)]

    def stat(self, path: str) -> dict[str, int | bool]:
        fs, p = self._at(path)
        s = fs.getFileStatus(p)
        return {"size": s.getLen(), "modified": s.getModificationTime(), "is_dir": s.isDirectory()}

    def mkdirs(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.mkdirs(p)

    def delete(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def rename(self, old: str, new: str) -> bool:
        fs, p = self._at(old)
        return fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new))

    def write_text(self, path: str, text: str) -> None:
        self.write_bytes(path, text.encode())

    def write_bytes(self, path: str, data: bytes) -> None:
        """Create a small file in one step: it appears only when it is complete."""
        fs, p = self._at(path)
        tmp = self.jvm.org.apache.hadoop.fs.Path(f"{path}.part")
        out = fs.create(tmp, True)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(tmp, p):
            raise OSError(f"cannot publish {path}")

    def read_bytes(self, path: str, start: int = 0, length: int | None = None) -> bytes:
        """Part of a small file, from a place on."""
        fs, p = self._at(path)
        size = fs.getFileStatus(p).getLen()
        n = max(0, min(size - start, size if length is None else length))
        stream = fs.open(p)
        try:
            stream.seek(start)
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
        finally:
            stream.close()

    def append_text(self, path: str, text: str) -> None:
        """Rewrite a small file with more at its end; stores without appending can do this too."""
        old = self.read_bytes(path).decode() if self.exists(path) else ""
        self.replace_text(path, old + text)

    def truncate(self, path: str, size: int) -> None:
        self.replace_text(path, self.read_bytes(path, 0, size).decode())

    def replace_text(self, path: str, text: str) -> None:
        if self.exists(path):
            self.delete(path)
        self.write_text(path, text)

    def read_lines(self, path: str) -> DataFrame:
        return self.spark.read.text(path)


def write_lines(df: DataFrame, pattern: str, columns: list[Column], path: str) -> None:
    """Formatted lines of text, one per row."""
    df.select(F.format_string(pattern, *columns).alias("value")).write.mode("overwrite").text(path)
