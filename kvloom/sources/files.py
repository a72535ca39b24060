"""Small files on whatever file system holds a store, through Spark's own file system classes."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Reads, atomic writes and listings below a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str) -> list[str]:
        """Names directly below a folder; none if it is not there."""
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write_once(self, name: str, text: str, flush: str = "hsync") -> bool:
        """Write a new file whole, or not at all; false if it is there already.

        Some file systems let a rename replace a file, so the name is claimed first: of two writers
        one gets it. ``flush`` is how far the bytes go before the file is there: hsync (the disk), hflush
        (other readers) or none.
        """
        target = self.path(name)
        if self.fs.exists(target) or not self.claim(f"{name}.claim"):
            return False
        part = self.path(f"{name}.{self.jvm.java.util.UUID.randomUUID()}.part")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            if flush != "none":
                getattr(stream, flush)()
        finally:
            stream.close()
        done = not self.fs.exists(target) and self.fs.rename(part, target)
        if not done:
            self.fs.delete(part, True)
        return done

    def age(self, name: str) -> float:
        """Seconds since a file was last written; 0 if it is not there."""
        try:
            return max(0.0, self.jvm.java.lang.System.currentTimeMillis() / 1000 - self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000)
        except Exception:  # gone meanwhile
            if self.exists(name):
                raise
            return 0.0

    def claim(self, name: str) -> bool:
        """Create an empty file if it is not there: the first caller wins."""
        try:
            return self.fs.createNewFile(self.path(name))
        except Exception:  # an existing file is an error on some file systems
            if self.exists(name):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def make(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def bytes(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength() if self.exists(name) else 0
