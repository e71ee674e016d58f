"""Line dedup with levelled sorted runs of line hashes.

A line counts by its key: stripped of ASCII white space, A-Z lower-cased. Keys of at least
min_chars code points are hashed (128 bits of SHA-256), and what is known of them is kept in
runs: tables (line, docs, largest), bucketed and sorted by line, one row a line. A batch of
documents is counted by line, merge-anti-joined with the runs, which takes out lines that
some run already knows to be frequent and from a larger doc_id, and what is left becomes a
new run of the lowest level. A level that holds `fanout` runs is compacted: they are merged
into one run of the level above, so that there are few runs, and each line is rewritten
once a level. Runs share their buckets, so neither the anti-joins nor the merges move them.

After the last batch, a line that min_docs documents hold is frequent, and all documents but
the one with its largest doc_id lose it. Whether a batch may be left out of the runs depends
on ids alone, so batches may come in any order; dedup takes them from the largest ids down,
whereby most repeats of frequent lines never enter a run. Lines of frequent keys are found by
a join in which keys that hold a large share of all lines, few by that, are broadcast.

Defined cases: a null text is empty, and is one empty line; rows that repeat a doc_id are one
document, each keeping its own text; rows with a null doc_id are one document too, whose id
is smaller than any; a document that loses all lines has an empty text; an empty table gives
an empty result; other columns pass, whatever their names, and n_lines and n_dropped replace
columns of those names. A document lies in one batch, and its lines fit in a row.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stash, join_by_share, large_shares, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches that dedup makes of a table, and runs of a level before they are compacted.
BATCHES, FANOUT = 4, 2
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACE))
    # lower() is fast; it does the same wherever it changes no character beyond ASCII.
    others = F.regexp_replace(bare, r"[\x00-\x7F]+", "")
    same = (F.octet_length(bare) == F.length(bare)) | (F.lower(others) == others)
    return F.when(same, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _names(doc_id: str, text: str) -> list[Column]:
    """_id and _text, which name a document's text."""
    return [F.coalesce(doc_id, F.lit(NO_ID)).alias("_id"), F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)).alias("_text")]


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text) -> (_id, _text, pos, line): the place and hash of each line whose key is long enough."""
    rows = docs.select(*_names("doc_id", "text"), "text").select("_id", "_text", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    rows = rows.filter(F.length("raw") >= min_chars).select("_id", "_text", "pos", line_key(F.col("raw")).alias("key"))
    return rows.filter(F.length("key") >= min_chars).select("_id", "_text", "pos", F.unhex(F.substring(F.sha2("key", 256), 1, 32)).alias("line"))


class LineRuns:
    """What is known of lines: levels of runs, each a table of (line, docs, largest) with a row a line."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.stash, self.levels, self.shares = Stash(spark, "lines"), [], []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """A batch's lines (_id, line), of documents that no other batch has."""
        batch = self._write(lines.groupBy("line", "_id").agg(F.lit(1).alias("_")).groupBy("line").agg(F.count("*").alias("docs"), F.max("_id").alias("largest")))
        self.shares.append(self.stash.put(large_shares(self.spark.table(batch), "line", "docs")))
        new = self.spark.table(batch)
        for name in self.runs():
            run = self.spark.table(name)
            settled = (new["line"] == run["line"]) & (run["docs"] >= self.min_docs) & (run["largest"] >= new["largest"])
            new = new.join(run.hint("merge"), settled, "left_anti")
        if self.levels:
            self._keep(self._write(new), 0)
            self._forget([batch])
        else:
            self._keep(batch, 0)

    def _write(self, rows: DataFrame) -> str:
        """A run; rows come dealt by line already, so that a bucket is one file."""
        name = f"lines_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, "line").sortBy("line").option("path", f"{self.stash.root}/{name}").option("compression", "zstd").saveAsTable(name)
        return name

    def _keep(self, run: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._keep(self._write(self._merged(old)), level + 1)
            self._forget(old)

    def _merged(self, names: list[str]) -> DataFrame:
        def merge(a: DataFrame, b: DataFrame) -> DataFrame:
            b = b.select("line", F.col("docs").alias("_docs"), F.col("largest").alias("_largest"))
            both = a.hint("merge").join(b, "line", "full")
            return both.select("line", (F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))).alias("docs"), F.greatest("largest", "_largest").alias("largest"))

        return reduce(merge, map(self.spark.table, names))

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            self.stash.remove(name)

    def frequent(self) -> DataFrame:
        """(line, largest) of lines that min_docs documents hold."""
        return self._merged(self.runs()).filter(F.col("docs") >= self.min_docs).select("line", "largest")

    def hot(self) -> DataFrame:
        """Lines with a large share of a batch's; whatever has such a share of all lines has it in some batch."""
        return reduce(DataFrame.unionByName, self.shares).distinct()

    def close(self) -> None:
        """Drops the runs."""
        self._forget(self.runs())
        self.levels = []


def _batches(docs: DataFrame, lines: DataFrame, batches: int) -> list[DataFrame]:
    """The lines by ranges of ids of about equal numbers of documents, the largest ids first."""
    cuts = docs.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []
    bounds = [None, *sorted(set(cuts), reverse=True), None]
    below = lambda b: F.lit(True) if b is None else F.col("_id") <= b
    above = lambda b: F.lit(True) if b is None else F.col("_id") > b
    return [lines.filter(below(hi) & above(lo)) for hi, lo in zip(bounds, bounds[1:], strict=False)]


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs without the lines that min_docs documents share, but in the document with the largest id; plus n_lines, as it was, and n_dropped."""
    spark = docs.sparkSession
    stash, runs = Stash(spark, "linedup"), LineRuns(spark, min_docs)
    lines = stash.put(lines_of(docs.select("doc_id", "text"), min_chars))
    for batch in _batches(docs, lines, batches):
        runs.add(batch.select("line", "_id"))
    often = stash.put(runs.frequent())
    runs.close()
    gone = join_by_share(lines, often, "line", runs.hot()).filter(F.col("_id") < F.col("largest"))
    gone = gone.groupBy("_id", "_text").agg(F.collect_set("pos").alias("_gone"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")).select("_row", *_names("_row.doc_id", "_row.text")).join(gone, ["_id", "_text"], "left")
    whole = F.split(F.coalesce("_row.text", F.lit("")), "\n")
    # Bound once, so that texts are split once a row; array_except looks places up by hash.
    left = F.transform(F.array(whole), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone")), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.get(left, F.lit(0)))
    counts = {"n_lines": F.size(whole).cast("long"), "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in own], *[v.alias(k) for k, v in counts.items()])


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), f AS (
  SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), j AS (
  SELECT rid, k.doc_id, line, pos, largest IS NOT NULL AND k.doc_id <> largest AS dropped FROM k LEFT JOIN f ON k.key = f.key
)
SELECT any_value(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM j GROUP BY rid
"""
