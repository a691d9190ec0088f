"""Shared pieces: shared-folder checkpoints, spooled tables and a few column expressions."""

from __future__ import annotations

import atexit
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, shared_dir

__all__ = ["WORD", "crc_of_id", "cut", "n_words", "release", "shared_dir", "spool", "table", "uniform", "unused"]

#: Words of the corpus are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Where stored tables lie.
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def spool(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, as compressed Parquet: for wide rows, and where the stored rows must stay as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return at_path(spark.read.schema(df.schema).parquet(path), path)


def at_path(df: DataFrame, path: str) -> DataFrame:
    """``df``, known to be stored at ``path``, which is removed at exit."""
    atexit.register(_remove, df.sparkSession, path)
    _PATHS[df] = path
    return df


def release(*stored: DataFrame) -> None:
    """Remove the files of stored tables that nothing still to run reads."""
    for df in stored:
        _remove(df.sparkSession, _PATHS.pop(df))


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_of_id(col: str | Column) -> Column:
    """CRC-32 of an id written as text, on which folds are dealt."""
    return F.crc32(F.col(col).cast("string").cast("binary") if isinstance(col, str) else col.cast("string").cast("binary"))


def n_words(col: str) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(seed: str, *cols: Column) -> Column:
    """A reproducible number in (0, 1) from the given columns: 48 bits of their MD5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
