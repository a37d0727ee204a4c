"""Tables kept for a while in the cluster's shared checkpoint folder.

A kept table cuts its lineage as a reliable checkpoint does, and outlives any executor; but it is stored by
columns, compressed, is read again only where its columns are needed, and goes as soon as it isn't.

A placed table is dealt out by key into buckets besides: joins and groupings by that key read it where it lies, without
an exchange, however often a loop comes back to it.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from orrery.plans.fixpoint import checkpoint_folder


def release(spark: SparkSession) -> None:
    """Collect the garbage of the driver's Python and JVM, and give the pages that both freed back to the system.

    After many small plans the C allocator holds hundreds of MB that nothing uses.  Where it can't be told to return
    them (another C library, an older JVM) only the garbage goes.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    gc.collect()
    jvm.System.gc()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass
    try:
        # By the public interface: the server's own class is closed to reflection.
        named, cls = jvm.java.lang.Class.forName, jvm.java.lang.Class
        kinds, given = array(cls, 4), array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        pass


@contextmanager
def dealt_into(spark: SparkSession, parts: int) -> Iterator[None]:
    """What is planned inside is exchanged into so many parts; the session's own number comes back."""
    key = "spark.sql.shuffle.partitions"
    old = spark.conf.get(key)
    spark.conf.set(key, str(parts))
    try:
        yield
    finally:
        spark.conf.set(key, old)


class Scratch:
    """One operator's tables: keep() writes one, drop() removes some, the rest go when the driver's JVM ends.

    With a home of its own, the tables stay there for a later driver (``manifest``).
    """

    def __init__(self, spark: SparkSession, home: str | None = None) -> None:
        self._spark = spark
        self._lasting = home is not None
        self._home = home or f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
        self._made = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}
        self._tables: dict[int, str] = {}

    def _path(self, name: str):
        path = self._spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def folder(self) -> str:
        """A new name for a file or a folder, which goes when the driver's JVM ends."""
        if self._lasting:
            return f"{self._home}/{uuid.uuid4().hex}"
        if not self._made:
            path, fs = self._path(self._home)
            fs.mkdirs(path)
            fs.deleteOnExit(path)
        self._made += 1
        return f"{self._home}/{self._made}"

    def keep(self, df: DataFrame) -> DataFrame:
        """df, computed and written; what it was made of is no longer needed."""
        name = self.folder()
        df.write.option("compression", "zstd").parquet(name)
        out = self._spark.read.schema(df.schema).parquet(name)
        self._paths[id(out)] = (out, name)
        return out

    def counted(self, df: DataFrame, *what: Column) -> tuple[DataFrame, dict]:
        """As keep(), with the named aggregates of all rows: side outputs of the job that writes."""
        seen = Observation()
        return self.keep(df.observe(seen, *what)), seen.get

    def place(self, df: DataFrame, parts: int, *by: str, what: tuple[Column, ...] = (), side: tuple[str, ...] = ()) -> tuple[DataFrame, dict]:
        """(df, written in so many buckets by its columns ``by``; the aggregates ``what``, side outputs of that job).

        Columns ``side`` are for the aggregates only and aren't written.  A df that is already dealt out so isn't moved;
        others should be repartitioned by these columns first, or a task may write to every bucket.
        """
        seen, name, path = Observation(), f"placed_{uuid.uuid4().hex}", self.folder()
        if what:
            df = df.observe(seen, *what)
        with dealt_into(self._spark, parts):  # exchanges meet placed tables, which stay where they are
            df.drop(*side).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, *by).saveAsTable(name)
        out = self._spark.table(name)
        self._paths[id(out)], self._tables[id(out)] = (out, path), name
        return out, seen.get if what else {}

    def described(self, table: DataFrame, parts: int, *by: str) -> dict:
        """What another driver needs to find a placed table."""
        return {"path": self._paths[id(table)][1], "columns": table._jdf.schema().toDDL(), "parts": parts, "by": list(by)}

    def found(self, what: dict) -> DataFrame:
        """A placed table that another driver described."""
        name = f"placed_{uuid.uuid4().hex}"
        self._spark.sql(f"CREATE TABLE {name} ({what['columns']}) USING parquet CLUSTERED BY ({', '.join(what['by'])}) INTO {what['parts']} BUCKETS LOCATION '{what['path']}'")
        out = self._spark.table(name)
        self._paths[id(out)], self._tables[id(out)] = (out, what["path"]), name
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove kept tables that no result reads any more."""
        for t in tables:
            held, name = self._paths[id(t)]
            if held is not None:
                if id(t) in self._tables:
                    self._spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(id(t))}")
                path, fs = self._path(name)
                fs.delete(path, True)
                self._paths[id(t)] = (None, name)

    def settle(self) -> None:
        """Let Spark's cleaner remove the shuffles of plans that are no longer referenced, and free the driver's memory."""
        release(self._spark)


#: Rows of a part of a placed table, at least and at most about, and pieces of heavy keys that a part gets.
LEAST_ROWS, PART_ROWS, PIECES = 50_000, 2_000_000, 16
#: Parts that keep a cluster busy; more only where they would be too large, as each part sends a sum for each vertex it reaches.
ENOUGH_PARTS = 64


def parts_for(spark: SparkSession, rows: int) -> int:
    """As many parts as exchanges are dealt into, as those fit then, up to ENOUGH_PARTS; fewer or more where a part would be too small or large.

    ``place`` exchanges into the same number, so that tables of other parts than the session's stay where they are too.
    """
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(dealt, ENOUGH_PARTS, -(-rows // LEAST_ROWS)), -(-rows // PART_ROWS))


def piece_rows(rows: int, parts: int) -> int:
    """Rows of a key that stay together: a heavier one is cut, so that no part is much larger than another."""
    return max(1, rows // (parts * PIECES))
