"""Quality rules: per-document counts and cross-document line frequency.

A document fails the base rules if it has too few words or too many of its words lie in
repeated 3-word windows. Beyond that, its lines are normalised (lower case, one space for
white space, 0 for digits) and hashed; a frequent line of a host (the source column)
is removed, except in the document of the host with the smallest doc_id that has it, so no
line vanishes from a host altogether. A line is frequent if more than max_docs distinct
documents of the host (doc_ids) have it, or in smaller hosts more than min_docs and more than
the share min_share of the host's documents. A document that keeps less than min_left of its
words is depleted and rejected; of a host's many copies of one text the first stays.

Repeated windows are found inside the row: each window's hash and its position share one
long, whose sorted order puts equal windows side by side; the words themselves are then
compared, so a collision can't count as a repetition. It can hide one, where windows with
equal high bits lie between two equal ones.

Lines are split and hashed once; their table, a few longs a line, is written and serves both
the counts and the places to remove.

Defined cases: a null text has no words and fails; a null source is a host; rows that repeat
a doc_id with one text are one document and get the same verdict; rows with a null id count
as one document of their host; an empty table gives an empty result; judge replaces columns
named like its results and passes others; clean returns docs' columns as they are, but for
text and, where lines were removed and docs has it, n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Stash, small, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 100
#: In hosts of fewer than MAX_DOCS / MIN_SHARE documents a line is frequent from this count and share of them.
MIN_DOCS, MIN_SHARE = 3, 0.05
MIN_LEFT = 0.5
SYMBOLS, SPACE = "#*$%&|<>", " \t\n\x0b\f\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated_words() -> Column:
    """Words of _words that lie in a 3-word window which the text holds twice or more."""
    return F.expr(
        """aggregate(
          transform(sort_array(transform(
            filter(sequence(0, size(_wins) - 1), i -> (i > 0 and (_wins[i] & _high) = (_wins[i - 1] & _high) and _same(i, i - 1))
                                                   or (i < size(_wins) - 1 and (_wins[i] & _high) = (_wins[i + 1] & _high) and _same(i, i + 1))),
            i -> cast(_wins[i] & ~_high as int))), p -> p),
          named_struct('end', 0, 'n', 0L),
          (acc, p) -> named_struct('end', p + 3, 'n', acc.n + p + 3 - greatest(p, acc.end)),
          acc -> acc.n)""".replace("_same(i, i - 1)", _same("i", "i - 1")).replace("_same(i, i + 1)", _same("i", "i + 1"))
    )


def _same(i: str, j: str) -> str:
    at = lambda k, d: f"_words[cast(_wins[{k}] & ~_high as int) + {d}]"
    return " and ".join(f"{at(i, d)} = {at(j, d)}" for d in range(3))


def _without(chars: str) -> Column:
    return F.length(F.translate(F.coalesce("text", F.lit("")), chars, ""))


def with_counts(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs plus the five base counts, under their names after a prefix."""
    cols = [c for c in docs.columns if c not in [prefix + b for b in BASE]]
    out = docs.select(*cols, F.coalesce(F.expr(f"regexp_extract_all(text, r'{WORD}', 0)"), F.array().cast("array<string>")).alias("_words"))
    out = out.withColumn("_n", F.size("_words"))
    # Low bits for the position, the rest for the hash.
    out = out.withColumn("_high", F.expr("-1L << greatest(1, length(bin(_n)))"))
    out = out.withColumn(
        "_wins",
        F.expr(
            "if(_n < 4, cast(array() as array<bigint>), sort_array(transform(sequence(0, _n - 3),"
            " i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & _high) | i)))"
        ),
    )
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines)
    # A generator, so that filters on the counts aren't pushed below it and don't compute them again.
    counts = {
        "n_words": F.col("_n"), "word_chars": _without(SPACE), "n_symbols": F.length(F.coalesce("text", F.lit(""))) - _without(SYMBOLS), "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.size("_wins") == 0, F.lit(0).cast("long")).otherwise(_repeated_words()),
    }
    return out.select(*cols, F.inline(F.array(F.struct(*[v.cast("long").alias(prefix + k) for k, v in counts.items()]))))


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < MIN_WORDS) | (100 * F.col(f"{prefix}n_repeat_words") > MAX_REPEAT_PERCENT * n)


def normal_line(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "), "[0-9]+", "0"))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text_key")


def frequent_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines to remove: (doc_id, _text_key, source, _pos, _line, _line_words), one row a place."""
    stash = Stash(docs.sparkSession, "quality")
    lines = stash.put(
        docs.select("doc_id", "source", _text_key(), F.posexplode(F.split("text", "\n")).alias("_pos", "_raw"))
        .filter(F.col("_raw").rlike(r"[^\x20\x09-\x0D]"))
        .withColumn("_norm", normal_line(F.col("_raw")))
        .select("doc_id", "source", "_text_key", "_pos", F.xxhash64("_norm").alias("_line"), F.size(F.split("_norm", " ")).cast("long").alias("_line_words"))
    )
    often = (
        lines.groupBy("source", "_line").agg(F.countDistinct(F.struct("doc_id")).alias("_docs"), F.min("doc_id").alias("_first"))
        .filter(F.col("_docs") > min(max_docs, MIN_DOCS))  # no limit is below; few lines go on
    )
    sizes = small(stash.put(lines.groupBy(F.col("source").alias("_of")).agg(F.countDistinct(F.struct("doc_id")).alias("_size"))))
    limit = F.least(F.lit(float(max_docs)), F.greatest(F.lit(float(MIN_DOCS)), MIN_SHARE * F.col("_size")))
    often = often.join(sizes, often["source"].eqNullSafe(sizes["_of"])).filter(F.col("_docs") > limit)
    often = small(stash.put(often.select(F.col("source").alias("_host"), F.col("_line").alias("_often"), "_first")))
    hit = lines.join(often, (lines["_line"] == often["_often"]) & lines["source"].eqNullSafe(often["_host"]), "inner")
    return hit.filter(~F.col("doc_id").eqNullSafe(F.col("_first"))).select(*lines.columns).dropDuplicates(["doc_id", "source", "_text_key", "_pos"])


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """docs without text, plus counts, removed_words, base_failed and kept."""
    removed = (
        frequent_lines(docs, max_docs).groupBy("doc_id", "source", "_text_key").agg(F.sum("_line_words").alias("removed_words"))
        .select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("_text_key").alias("_key"), "removed_words")
    )
    rows = with_counts(docs.withColumn("_text_key", _text_key())).drop("text")
    on = (rows["_text_key"] == removed["_key"]) & rows["doc_id"].eqNullSafe(removed["_id"]) & rows["source"].eqNullSafe(removed["_src"])
    out = rows.drop("removed_words").join(removed, on, "left").drop("_id", "_src", "_key", "_text_key")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long"))).withColumn("base_failed", base_failed())
    left = F.col("n_words") - F.col("removed_words") >= F.lit(min_left) * F.col("n_words")
    return out.withColumn("kept", ~F.col("base_failed") & left)


def clean(docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that pass, without their frequent lines; the columns of docs."""
    places = (
        frequent_lines(docs, max_docs).groupBy("doc_id", "source", "_text_key")
        .agg(F.collect_set("_pos").alias("_gone"), F.sum("_line_words").alias("_removed"))
        .select(F.col("doc_id").alias("_id"), F.col("source").alias("_src"), F.col("_text_key").alias("_key"), "_gone", "_removed")
    )
    rows = docs.withColumn("_text_key", _text_key())
    on = (rows["_text_key"] == places["_key"]) & rows["doc_id"].eqNullSafe(places["_id"]) & rows["source"].eqNullSafe(places["_src"])
    out = with_counts(rows.join(places, on, "left"), "_q_").filter(~base_failed("_q_"))
    out = out.filter(F.col("_q_n_words") - F.coalesce("_removed", F.lit(0)) >= F.lit(min_left) * F.col("_q_n_words"))
    kept_lines = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_gone", i))
    out = out.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return made.select("doc_id", *BASE, "base_failed", "kept", "removed_words")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), nrep AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(range(3)) AS k) GROUP BY rid
), b AS (
  SELECT w.rid, doc_id, source, text, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(nrep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN nrep ON w.rid = nrep.rid
), line AS (
  SELECT rid, doc_id, source, text, trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS l
  FROM (SELECT rid, doc_id, source, text, unnest(ls) AS l FROM w)
), host AS (
  SELECT source, count(DISTINCT {'id': doc_id}) AS docs FROM line GROUP BY source
), often AS (
  SELECT g.source, l, first_id FROM (SELECT source, l, min(doc_id) AS first_id, count(DISTINCT {'id': doc_id}) AS n FROM line GROUP BY source, l) g
  JOIN host ON g.source IS NOT DISTINCT FROM host.source WHERE n > least(100.0, greatest(3.0, 0.05::DOUBLE * docs))
), gone AS (
  SELECT rid, CAST(sum(len(string_split(line.l, ' '))) AS BIGINT) AS n
  FROM line JOIN often ON line.l = often.l AND line.source IS NOT DISTINCT FROM often.source
  WHERE line.doc_id IS DISTINCT FROM often.first_id GROUP BY rid
), f AS (
  SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(gone.n, 0) AS removed_words FROM b LEFT JOIN gone ON b.rid = gone.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words FROM f
"""
