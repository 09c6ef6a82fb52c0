"""Versioned Parquet tables: a write makes a new version, the last complete one is current."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from silverbarn.operators.upsert import upsert
from silverbarn.session import cut_lineage

#: Parts of a table by hash of its key; an upsert writes those its rows fall into.
PARTS = 64


class Catalog:
    """Tables under a root folder that all executors share.

    A version is a folder that counts once its ``_SUCCESS`` mark is there, which
    is written last; so a failed write leaves the old version current and
    nothing is read and overwritten in one plan. Of two writers that take the
    same version the second fails. A version made by ``upsert`` holds only the
    parts it changed; the others are read from the versions before.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _list(self, at: str) -> list[str]:
        fs, path = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(path(at))) if fs.exists(path(at)) else []

    def versions(self, name: str) -> list[int]:
        """Versions completely written, oldest first."""
        return sorted(int(v[1:]) for v in self._list(f"{self.root}/{name}") if "_SUCCESS" in self._list(f"{self.root}/{name}/{v}"))

    def names(self) -> list[str]:
        return self._list(self.root)

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def _parts(self, name: str, version: int | None = None) -> dict[str, str]:
        """Folder of every part of a version; the part '' is a table written as a whole."""
        have = [v for v in self.versions(name) if version is None or v <= version]
        if not have or version is not None and version not in have:
            raise KeyError(name)
        where: dict[str, str] = {}
        for v in have:
            folder = f"{self.root}/{name}/v{v}"
            parts = [p for p in self._list(folder) if p.startswith("_part_of_key=")]
            if parts:
                where.update({p: f"{folder}/{p}" for p in parts})
                where.pop("", None)
            else:
                where = {"": folder}
        return where

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*self._parts(name, version).values())

    def _next(self, name: str) -> str:
        taken = [int(v[1:]) for v in self._list(f"{self.root}/{name}")]
        return f"{self.root}/{name}/v{max(taken, default=0) + 1}"

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> int:
        """A new version that replaces the table."""
        target = self._next(name)
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(target)
        return int(target.rpartition("/v")[2])

    def upsert(self, name: str, rows: DataFrame, key: Sequence[str], parts: int = PARTS) -> int:
        """A new version with the rows of each key replaced by the incoming one, of which ``rows`` has at most one a key.

        Only the parts that the rows fall into are read and written. Returns
        the number of incoming rows.
        """
        part = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in key]), F.lit(parts)).cast("int")
        rows = cut_lineage(rows)
        touched = sorted(r["p"] for r in rows.select(part.alias("p")).distinct().collect())  # at most ``parts`` rows
        if not touched:
            return 0
        where = self._parts(name) if self.exists(name) else {}
        whole = "" in where
        old = [f for p, f in where.items() if whole or int(p.partition("=")[2]) in touched]
        new = upsert(self.spark.read.parquet(*old), rows, key) if old else rows
        if not where or whole:
            touched = list(range(parts))
        (new.withColumn("_part_of_key", part).repartition(len(touched), "_part_of_key").write.mode("errorifexists").partitionBy("_part_of_key").parquet(self._next(name)))
        return rows.count()

    def register(self) -> None:
        """A temporary view per table, for SQL over the current versions."""
        for name in self.names():
            self.read(name).createOrReplaceTempView(name)

    def describe(self) -> str:
        return "\n".join(f"{name}: {self.read(name).schema.simpleString()}" for name in self.names())


class DataSource:
    """A source that can describe itself and bring its tables up to date."""

    name, brief = "", ""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog

    def describe_brief(self) -> str:
        return self.brief

    def describe_detailed(self) -> str:
        return self.catalog.describe()

    def ensure_up_to_date(self, path: str) -> dict[str, int]:
        raise NotImplementedError


class Sources:
    """Registry of sources by name; an unknown name is a KeyError."""

    def __init__(self, *sources: DataSource):
        self.by_name = {s.name: s for s in sources}

    def add(self, source: DataSource) -> None:
        self.by_name[source.name] = source

    def get(self, name: str) -> DataSource:
        return self.by_name[name]

    def chosen(self, names: Sequence[str] = ()) -> list[DataSource]:
        """The named sources, all if none is named; names of which none is known are an error."""
        wanted = [n.strip().lower() for n in names if n.strip()]
        found = [s for n, s in sorted(self.by_name.items()) if not wanted or n in wanted]
        if not found:
            raise ValueError(f"no source among {', '.join(wanted)}; there are {', '.join(sorted(self.by_name))}")
        return found

    def describe(self) -> str:
        return "\n".join(f"{n}: {s.describe_brief()}" for n, s in sorted(self.by_name.items()))
