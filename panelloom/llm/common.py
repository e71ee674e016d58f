"""What the operators of this subpackage share: tables, held-out split, cut lineage."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Fold of crc32(doc_id) mod 4 that no model learns from.
HELD_OUT_FOLD = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(doc_id: Column | str) -> Column:
    """True for rows that are never learned from; a null id counts as held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT_FOLD, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return named or held.get()
    if named is None and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    named = named or tempfile.mkdtemp(prefix="panelloom-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


class Stash:
    """Tables written to the shared folder, so that lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}", 0
        atexit.register(_remove, spark, self.root)

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stash_path = path
        return out

    def remove(self, name: str) -> None:
        _remove(self.spark, f"{self.root}/{name}")

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_stash_path", None):
            _remove(self.spark, path)


def arrow_limits(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that long texts don't add up."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


#: A table of ids is broadcast up to so many rows.
SMALL_ROWS = 1_000_000


def small(ids: DataFrame) -> DataFrame:
    """ids, a table of a few longs a row, marked for broadcast if it is counted to be small; else it shuffles."""
    return small_as(ids)(ids)


def small_as(ids: DataFrame, most: int = SMALL_ROWS) -> Callable[[DataFrame], DataFrame]:
    """What marks tables of a few longs a row, no more rows than ids, for broadcast if ids is counted to be small."""
    return F.broadcast if ids.limit(most + 1).count() <= most else (lambda df: df)


#: Rows of a few longs that a task takes at least.
TASK_ROWS = 50_000


def by_rows(df: DataFrame, rows: int) -> DataFrame:
    """df, of so many rows, read by no more tasks than they are worth, whatever the number of its files.

    A table that one task reads is grouped and joined to others of its kind without a shuffle.
    """
    return df.coalesce(rows // TASK_ROWS + 1)


#: A key that holds more than this part of all rows is joined by broadcast; so there are fewer of them.
SHARES = 10_000


def large_shares(counts: DataFrame, key: str, held: str) -> DataFrame:
    """Keys that hold more than a SHARES-th of all rows, of a written table with a row a key: fewer than SHARES."""
    return counts.filter(F.col(held) > (counts.agg(F.sum(held)).first()[0] or 0) / SHARES).select(key)


def join_by_share(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of rows with lookup, which has a row a key. Keys in hot, a few times SHARES at most, are broadcast;
    the others have no large group and shuffle. Both tables should be written ones: they are read twice."""
    heavy = lookup.join(F.broadcast(hot), key, "left_semi")
    light = lookup.join(F.broadcast(hot), key, "left_anti")
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti")
    return rows.join(F.broadcast(heavy), key).unionByName(rest.join(light, key))


def ship(spark: SparkSession) -> None:
    """Give Python workers this package where their path lacks it, once a context."""
    context = spark.sparkContext
    if getattr(context, "_panelloom_shipped", False):
        return
    context._panelloom_shipped = True
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="panelloom-code-")
    with zipfile.ZipFile(f"{folder}/panelloom.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    context.addPyFile(f"{folder}/panelloom.zip")
    atexit.register(shutil.rmtree, folder, True)
