"""Sinks: JSON lines, a table swapped in one step, versioned snapshots."""

from __future__ import annotations

import json
import uuid

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_events(df: DataFrame, path: str) -> None:
    """Add events to a log that is only ever appended to."""
    df.write.mode("append").parquet(path)


def newest_events(spark: SparkSession, path: str, at: str, n: int) -> DataFrame:
    """The newest n events of such a log."""
    return spark.read.parquet(path).orderBy(F.col(at).desc_nulls_last()).limit(n)


def packed(df: DataFrame, content: str, least: int = 4096, saving: float = 0.9, level: int = 9) -> DataFrame:
    """Add ``body`` and ``codec``: content compressed (zstd) where it is at least ``least`` bytes and shrinks to ``saving`` of its size, else as it is.

    ``content`` is text or binary; null stays null.
    """

    @F.pandas_udf("struct<body:binary,codec:string>")
    def pack(values: pd.Series) -> pd.DataFrame:
        engine = zstandard.ZstdCompressor(level=level)
        out = []
        for v in values:
            raw = None if v is None else bytes(v)
            small = engine.compress(raw) if raw is not None and len(raw) >= least else None
            out.append((None, None) if raw is None else (small, "zstd") if small is not None and len(small) <= saving * len(raw) else (raw, "plain"))
        return pd.DataFrame(out, columns=["body", "codec"])

    made = df.withColumn("_p", pack(F.col(content).cast("binary")))
    return made.select(*[c for c in df.columns if c not in ("body", "codec")], F.col("_p.body").alias("body"), F.col("_p.codec").alias("codec"))


def unpacked(df: DataFrame) -> DataFrame:
    """Add ``content``, the bytes that ``packed`` was given."""

    @F.pandas_udf("binary")
    def unpack(body: pd.Series, codec: pd.Series) -> pd.Series:
        engine = zstandard.ZstdDecompressor()
        return pd.Series([None if b is None else engine.decompress(bytes(b)) if c == "zstd" else bytes(b) for b, c in zip(body, codec)], dtype=object)

    return df.withColumn("content", unpack("body", "codec"))


class SwappedTable:
    """A table that readers see whole: a new version is written beside the old one and a pointer is renamed over."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._p = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._p(f"{self.path}/pointer")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v"))

    def write(self, df: DataFrame) -> int:
        """Publish df as the next version; the rename fails where another writer was first."""
        version = (self.versions() or [0])[-1] + 1
        data = f"{self.path}/data-{version}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(data)
        temporary = self._p(f"{self.path}/pointer/.{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, False)
        stream.write(bytearray(json.dumps({"data": data}).encode()))
        stream.close()
        target = self._p(f"{self.path}/pointer/v{version}")
        if self._fs.exists(target) or not self._fs.rename(temporary, target):
            raise RuntimeError(f"another writer published version {version} first")
        return version

    def restore(self, version: int) -> int:
        """Make an older version the newest one again."""
        return self.write(self.read(version))

    def clean(self, keep: int = 2) -> list[int]:
        """Remove all but the newest ``keep`` versions and data that no version names; gives the versions removed."""
        old = self.versions()[:-keep] if keep else self.versions()
        live = {self._data(v).rsplit("/", 1)[-1] for v in self.versions() if v not in old}
        for version in old:
            self._fs.delete(self._p(f"{self.path}/pointer/v{version}"), False)
        for status in self._fs.listStatus(self._p(self.path)):
            name = status.getPath().getName()
            if name.startswith("data-") and name not in live:
                self._fs.delete(status.getPath(), True)
        return old

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one (a snapshot)."""
        return self.spark.read.parquet(self._data(version or self.versions()[-1]))

    def _data(self, version: int) -> str:
        stream = self._fs.open(self._p(f"{self.path}/pointer/v{version}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["data"]
        finally:
            stream.close()
