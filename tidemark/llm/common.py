"""What the operators of this subpackage share: scratch tables, ids, batches."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that part words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Bytes of an Arrow batch on its way to Python; each core holds a few copies of it, outside the heap and in its worker.
BATCH_BYTES = 4 << 20
#: No more keys than this are broadcast as hot ones.
PARTS = 1024


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Without one, a cluster is an error; where all is one process, a temporary one is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, where, True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches hold BATCH_BYTES at most, or one row: by rows alone, 10,000 long texts or sets are one batch."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors, and go when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        where, files = self._files(self.root)
        files.deleteOnExit(where)
        small_batches(spark)

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def save(self, df: DataFrame, tag: str) -> DataFrame:
        """Write df and read it back."""
        path = f"{self.root}/{tag}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                where, files = self._files(path)
                files.delete(where, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str | list[str], count: str, level: float | None = None) -> DataFrame:
    """rows joined to table (one row a key; count says how many of rows have it), with no task bound to a hot key.

    Keys of more rows than level, by default a PARTS-th of all, are broadcast: there
    are fewer than PARTS of them. The others are joined as Spark sees fit.
    """
    keys = [key] if isinstance(key, str) else key
    if level is None:
        level = max((table.agg(F.sum(count)).first()[0] or 0) / PARTS, 64)
    hot = table.filter(F.col(count) > level)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.filter(F.col(count) <= level), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold).drop(count)


def kept(name: str, make):
    """What make() gives, made once in a Python worker and used by all its later tasks, which are given these functions anew."""
    import sys
    import types

    held = sys.modules.setdefault("_tidemark_kept", types.ModuleType("_tidemark_kept"))
    if not hasattr(held, name):
        setattr(held, name, make())
    return getattr(held, name)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; none for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def crc_of(doc_id: Column) -> Column:
    """crc32 of the id as text."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def lang_split(doc_id: Column, modulus: int, rest: int) -> Column:
    """True where crc32(id as text) leaves this remainder; false for a null id."""
    return F.coalesce(crc_of(doc_id) % modulus == rest, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
