"""Small files through Hadoop's file systems, so that the store's own files can stand wherever its runs can."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; fails if there is one."""
        stream = self._fs.create(self.at(name), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def swap(self, name: str, text: str) -> None:
        """Put a file's new content in place in one step: a temporary file, then a rename over the old one."""
        temp = f"{name}.dbtmp"
        self._fs.delete(self.at(temp), False)
        self.create(temp, text)
        if not self._fs.rename(self.at(temp), self.at(name)):
            # file systems whose rename doesn't replace: the reader falls back to the newest manifest in between
            self._fs.delete(self.at(name), False)
            if not self._fs.rename(self.at(temp), self.at(name)):
                raise OSError(f"cannot replace {name}")

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self.at(name), True)

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self.at(folder)))

    def age_ms(self, name: str, now: int) -> int:
        return now - self._fs.getFileStatus(self.at(name)).getModificationTime()

    def bytes_under(self, name: str) -> int:
        return self._fs.getContentSummary(self.at(name)).getLength()


#: The names of a store's files in the classic layout.
KINDS = {r"^\d+\.wal$": "wal", r"^\d+\.sst$": "sst", r"^\d+\.dbtmp$": "temp", r"^MANIFEST-\d+$": "manifest", r"^CURRENT$": "current", r"^LOCK$": "lock", r"^LOG$": "log"}


def kind_of(name: str) -> tuple[str, int] | None:
    """(kind, number) of a file name, number 0 where there is none; None for other names."""
    for pattern, kind in KINDS.items():
        if re.match(pattern, name):
            digits = re.search(r"\d+", name)
            return kind, int(digits[0]) if digits else 0
    return None


def parse_names(names: DataFrame, column: str = "name") -> DataFrame:
    """names with kind and number, as column expressions over a listing."""
    base, kind = F.regexp_extract(column, r"[^/]*$", 0), F.lit(None).cast("string")
    for pattern, k in KINDS.items():
        kind = F.when(base.rlike(pattern), k).otherwise(kind)
    number = F.when(kind.isNotNull(), F.coalesce(F.regexp_extract(base, r"\d+", 0).try_cast("long"), F.lit(0)))
    return names.withColumn("kind", kind).withColumn("number", number)
