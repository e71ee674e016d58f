"""A table that is refreshed by key: buckets of rows, rewritten where news falls, and a log of commits.

A commit names the folder that holds each bucket. An upsert reads the buckets that its news
falls into, writes them anew in a folder of its own, and then commits by renaming one small
file, so a run that dies before leaves nothing that a reader sees, and the next one starts
from the same rows. Folders that no commit names are removed by vacuum. News that comes with
a batch number is taken once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets that keys are dealt to.
BUCKETS = 64


class Upserts:
    """Rows by `keys`, in buckets of the first of them; of rows with equal keys the last by `order` counts, and news over what is held."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...] = ("symbol", "date"), order: str | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _fs(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def version(self) -> int:
        """Number of the last commit; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names("_log") if n.endswith(".json") and not n.startswith(".")), default=0)

    def commit(self, version: int) -> dict:
        """Folders by bucket, and the batches taken so far."""
        if not version:
            return {"buckets": {}, "batch": None}
        return json.loads(self.spark.read.text(f"{self.path}/_log/{version:08d}.json", wholetext=True).first()[0])

    def read(self, version: int | None = None) -> DataFrame:
        held = self.commit(self.version() if version is None else version)["buckets"]
        if not held:
            raise ValueError(f"{self.path} has no rows yet")
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in held.values()])

    def before(self, batch: int) -> int:
        """The last version without a batch or any after it; 0 if there is none."""
        version = self.version()
        while version and (taken := self.commit(version)["batch"]) is not None and taken >= batch:
            version -= 1
        return version

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.keys[0]), F.lit(self.buckets)).cast("int")

    def read_near(self, some: DataFrame, version: int) -> DataFrame | None:
        """The rows of a version in the buckets that `some` fall into; None if it has no such bucket."""
        held = self.commit(version)["buckets"]
        there = [str(r[0]) for r in some.select(self.bucket().alias("b")).distinct().collect()]  # buckets at most
        folders = [f"{self.path}/{held[b]}" for b in there if b in held]
        return self.spark.read.parquet(*folders) if folders else None

    def read_like(self, some: DataFrame, version: int) -> DataFrame | None:
        """The rows of a version whose first key is among those of `some`, from the buckets that these fall into; None if it has no such bucket."""
        rows, k = self.read_near(some, version), self.keys[0]
        of = some.select(F.col(k).alias("_k")).distinct()
        return None if rows is None else rows.join(of, rows[k].eqNullSafe(of["_k"]), "left_semi")

    def upsert(self, news: DataFrame, batch: int | None = None) -> int:
        """The version that holds the news; batches up to the last one taken are left alone."""
        version = self.version()
        now = self.commit(version)
        if batch is not None and now["batch"] is not None and batch <= now["batch"]:
            return version
        folder = f"data/{version + 1:08d}-{uuid.uuid4().hex}"
        order = [F.desc_nulls_last(self.order)] if self.order else [F.desc(c) for c in news.columns if c not in self.keys]
        # Dealt by bucket once, a bucket is one task's file; where nothing is held yet, the news are the rows.
        news = news.withColumn("_bucket", self.bucket()).repartition("_bucket")
        last = news.withColumn("_n", F.row_number().over(W.partitionBy("_bucket", *self.keys).orderBy(*order))).filter("_n = 1").drop("_n")
        place = f"{self.path}/{folder}/{'news' if now['buckets'] else 'rows'}"
        last.write.partitionBy("_bucket").parquet(place)
        fresh = self.spark.read.parquet(place)
        touched = [str(r[0]) for r in fresh.select("_bucket").distinct().collect()]  # buckets at most
        held = [f"{self.path}/{now['buckets'][b]}" for b in touched if b in now["buckets"]]
        if now["buckets"]:
            rows = fresh
            if held:
                old = self.spark.read.parquet(*held).withColumn("_bucket", self.bucket())
                same = [old[k].eqNullSafe(fresh[k]) for k in self.keys]
                rows = old.join(fresh.select(*self.keys), same, "left_anti").unionByName(fresh, allowMissingColumns=True)
            rows.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}/rows")
        self._publish(version + 1, {"buckets": now["buckets"] | {b: f"{folder}/rows/_bucket={b}" for b in touched}, "batch": now["batch"] if batch is None else batch})
        return version + 1

    def _publish(self, version: int, what: dict) -> None:
        fs, draft = self._fs(f"_log/.{uuid.uuid4().hex}")
        _, final = self._fs(f"_log/{version:08d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise RuntimeError(f"{self.path} was changed by another run; run again")

    def vacuum(self) -> None:
        """Removes what the last commit doesn't need, older versions included."""
        version = self.version()
        needed = {f.split("/")[1] for f in self.commit(version)["buckets"].values()}
        for name in self._names("data"):
            fs, path = self._fs(f"data/{name}" if name not in needed else f"data/{name}/news")
            fs.delete(path, True)
        for name in self._names("_log"):
            if name != f"{version:08d}.json":
                fs, path = self._fs(f"_log/{name}")
                fs.delete(path, False)
