"""Similarity join on sets of word shingles, by parity sketches.

A text's set is its distinct 5-word shingles (the whole sequence as one below five words).
Two texts link at Jaccard >= 0.75; what is asked for is each text's connected component.

Sketch. Every shingle flips one bit of a very long bit string, at the place its 64-bit hash
names, so the Hamming distance of two sketches is their symmetric difference (equal hashes
cancel, which only lowers it). A set keeps its string in two forms. Chunks: the string is
cut into CHUNKS places a shingle; a chunk that isn't empty is the XOR of its shingles'
second hashes. Dense: the string folded to 2 to 4 bits a shingle, whose Hamming distance
is a lower bound too; the width follows the size band, and the wider of two is folded once
more, so that long texts are told apart as well as short ones.

Pigeonhole. Sets a <= b in size that reach 0.75 differ in at most a / 3 shingles, so of any
a / 3 + 1 chunks that are not empty in A one is equal in B; with both sides' chunks in one
order, the first equal one is preceded by differing ones alone on either side. Keys are
hashes of band and chunk, in their own order, which is random: as at most 0.355 of a set's
chunks differ, the first FIRST = 40 of them all differ with a probability below 1e-18, which
is that of colliding 64-bit hashes, so longer sets give no more than these. Chunk counts
follow a size band (powers of two); a set that can have a partner in the band below also
gives that band's chunks.

Join. Equal sets share a node, their signature. Every key has a hub, the member whose keys
have the most members in all, and every other member is compared with it: near copies of
one text meet at it. Members of a key that aren't linked by then meet in blocks of bounded
size. There dense sketches drop every pair that its sizes rule out, and what passes goes
two ways: each set's nearest partner is compared, and then all pairs that pass and still
aren't known to be linked are verified in their block, which gives the links of a spanning
forest. A key with more than HOT members outside its largest component, more than a block
takes, holds texts that share a common passage; its members are keyed anew, by chunks whose
shingles are seldom among such texts first, and meet under these keys. Of n seldom chunks of
a set at most a / 3 differ, so so many of them suffice that (a / 3 / n) to their number is
below 1e-18, and a / 3 + 1 chunks always do. So each pair that shares a key is compared or
lies in one component, and no step gives more rows than it has members. Comparing is exact,
on all shingles' hashes.

Hashes have 64 bits; results are exact unless two different shingles of compared texts, two
texts or two sets of the corpus have equal hashes.

Defined cases: null, empty and blank texts have an empty set and are linked with nothing
(component_id is their own id); rows that repeat a doc_id are nodes of their own texts and
share the id in the result; a row with a null id links as any other: its component has the
smallest id that is not null, or null if there is none; an empty table gives an empty
result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext
from .common import Stash, arrow_limits, by_rows, small, small_as, table
from .components import components

SHINGLE = 5
#: Jaccard threshold as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Chunks a shingle at least, keys of a set under the random order, members outside its largest component that make a key hot.
CHUNKS, FIRST, HOT = 8, 40, 4096
#: Bounds of a block: rows, and shingles of all its sets. Of what a task looks at at once: bytes, pairs, pairs remembered.
BLOCK, BLOCK_SHINGLES, BUNDLE_BYTES, PAIRS, SEEN = 4096, 2_000_000, 16 << 20, 1 << 18, 250_000
#: Log2 of the cells that count shingles of texts with a common passage, the count from which they are frequent, and the log of how seldom keys may miss.
CELL_BITS, FREQUENT, MISS = 20, 64, np.log(1e-18)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text index and hash of the distinct shingles of all texts, sorted by both."""
    doc, h = bytetext.all_words(data, offsets, lower=True)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    docs, hashes = [], []
    if len(h) >= SHINGLE:
        m = len(h) - SHINGLE + 1
        s = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            s += h[k : k + m] * _ODD[k]
        whole = doc[:m] == doc[SHINGLE - 1 :]
        docs.append(doc[:m][whole])
        hashes.append(bytetext.mix(s[whole]))
    for size in range(1, SHINGLE):
        short = np.flatnonzero(count == size)
        if len(short):
            s = np.full(len(short), size, np.uint64)
            for k in range(size):
                s += h[first[short] + k] * _ODD[k]
            docs.append(short)
            hashes.append(bytetext.mix(s))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def signatures(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit signature of every set; the signature of an empty one is 0."""
    size = np.bincount(doc, minlength=n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bytetext.mix(h + np.uint64(1)), dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(size)])
    sig = bytetext.mix(sums[at[1:]] - sums[at[:-1]] + size.astype(np.uint64))
    return size, np.where(size > 0, sig, 0).astype(np.uint64).view(np.int64)


def bands(size: np.ndarray) -> np.ndarray:
    """Log2 of sizes, rounded down."""
    return np.frexp(np.maximum(size, 1).astype(np.float64))[1].astype(np.int64) - 1


def dense_sketches(doc: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longs of all sets' folded sketches, 2**(band + 2) bits each and 64 at least, and each set's number of longs."""
    bits = np.maximum(64, 4 << bands(size))
    first = np.cumsum(bits) - bits
    parity = np.bincount(first[doc] + (h & (bits[doc] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.int64), bits // 64


def chunk_keys(doc: np.ndarray, h: np.ndarray, size: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text index, key) rows, under each text's own band and under the band below where it may have partners.

    In the keys' own order no more than FIRST a band; with frequent, a mask by the first
    bits of hashes, seldom chunks first and as many as may not miss.
    """
    own = bands(size)
    lower = (-(-NUMERATOR * size // DENOMINATOR) < (1 << own)) & (own > 0)
    value = bytetext.mix(h ^ np.uint64(0x5851F42D4C957F2D))
    all_needed, differ = size // 3 + 1, np.maximum(size / 3, 1e-9)
    docs, keys = [], []
    for band, takes in ((own, size > 0), (own - 1, lower & (size > 0))):
        rows = np.flatnonzero(takes[doc])
        if not len(rows):
            continue
        d, b = doc[rows], band[doc[rows]]
        bits = np.maximum(16, b + 1 + (CHUNKS - 1).bit_length())
        chunk = h[rows] >> (64 - bits).astype(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (chunk[1:] != chunk[:-1])]))
        xor = np.bitwise_xor.reduceat(value[rows], start)
        d, chunk, b = d[start], chunk[start], b[start]
        key = bytetext.mix(xor + chunk * _ODD[0] + b.astype(np.uint64) * _ODD[1])
        if frequent is None:
            order, most = np.lexsort((key, d)), np.minimum(all_needed, FIRST)
        else:
            common = np.logical_and.reduceat(frequent[(h[rows] >> np.uint64(64 - CELL_BITS)).astype(np.int64)], start)
            order = np.lexsort((key, common, d))
            seldom = np.bincount(d[~common], minlength=len(size))
            odds = np.log(differ / np.maximum(seldom, 1))
            most = np.where(odds < 0, np.minimum(all_needed, np.ceil(MISS / np.minimum(odds, -1e-9)).clip(0, 2**31)), all_needed).astype(np.int64)
        d, key = d[order], key[order]
        head = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        rank = np.arange(len(d)) - np.repeat(head, np.diff(np.append(head, len(d))))
        keep = rank < most[d]
        docs.append(d[keep])
        keys.append(key[keep])
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(keys).view(np.int64)


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.ListArray:
    """values as n lists, rows naming the list of each."""
    order = np.argsort(rows, kind="stable")
    return _listed(np.bincount(rows, minlength=n), values[order])


def _listed(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _text_id() -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"]


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, text_hash, n_shingles, sig, sketch, keys)."""

    def run(parts):
        for whole in parts:
            for part in bytetext.batches(whole, "text", 2 * bytetext.SLAB):
                doc, h = shingle_sets(*bytetext.flat(part.column("text")))
                n = part.num_rows
                size, sig = signatures(doc, h, n)
                longs, each = dense_sketches(doc, h, size)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(size), pa.array(sig), _listed(each, longs), _lists(*chunk_keys(doc, h, size), n)],
                    ["doc_id", "text_hash", "n_shingles", "sig", "sketch", "keys"],
                )

    return docs.select(*_text_id()).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, sig long, sketch array<long>, keys array<long>")


def hashed(docs: DataFrame, sets: DataFrame, sigs: DataFrame) -> DataFrame:
    """(sig) -> (sig, hashes): sorted hashes of the sets' shingles, from one text of each."""
    wanted = small(sets.join(small(sigs), "sig", "left_semi").select("sig", F.col("text.doc_id").alias("of_doc"), F.col("text.text_hash").alias("of_text")))
    texts = docs.select(*_text_id())
    texts = texts.join(wanted, (F.col("text_hash") == F.col("of_text")) & F.col("doc_id").eqNullSafe(F.col("of_doc"))).select("sig", "text")

    def run(parts):
        for whole in parts:
            for part in bytetext.batches(whole, "text", 2 * bytetext.SLAB):
                doc, h = shingle_sets(*bytetext.flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("sig"), _listed(np.bincount(doc, minlength=part.num_rows), h.view(np.int64))], ["sig", "hashes"])

    return texts.mapInArrow(run, "sig long, hashes array<long>").dropDuplicates(["sig"])


def _folded(x: str, y: str) -> str:
    """x, XORed onto its first half if it is longer than y."""
    half = f"cast(size({x}) / 2 as int)"
    return f"if(size({x}) > size({y}), zip_with(slice({x}, 1, {half}), slice({x}, {half} + 1, {half}), (p, q) -> p ^ q), {x})"


def sized(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose sizes and dense sketches allow the threshold: J >= t needs a difference of (a + b) (1 - t) / (1 + t) at most."""
    side = lambda c: sets.select(F.col("sig").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.filter(DENOMINATOR * F.least("size_a", "size_b") >= NUMERATOR * F.greatest("size_a", "size_b"))
    apart = F.expr(f"aggregate(zip_with({_folded('sketch_a', 'sketch_b')}, {_folded('sketch_b', 'sketch_a')}, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)")
    return rows.filter((DENOMINATOR + NUMERATOR) * apart <= (DENOMINATOR - NUMERATOR) * (F.col("size_a") + F.col("size_b"))).select("a", "b")


def linked(size_a, size_b, common):
    return DENOMINATOR * common >= NUMERATOR * (size_a + size_b - common)


class _Join:
    """What is known of a corpus' sets while their links are found."""

    def __init__(self, docs: DataFrame):
        self.docs, self.stash = docs, Stash(docs.sparkSession, "jaccard")
        self.every = self.stash.put(signed(docs))
        own = self.every.filter("n_shingles > 0").groupBy("sig").agg(
            F.min(F.struct("doc_id", "text_hash")).alias("text"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"),
            F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"), F.first("keys").alias("keys"),
        )
        self.sets = self.stash.put(own)
        self.per_set = small_as(self.sets)
        self.edges: DataFrame | None = None
        self.links = 0

    def compare(self, pairs: DataFrame, hashes: DataFrame) -> None:
        """Adds the pairs that link to the edges."""
        side = lambda c: hashes.select(F.col("sig").alias(c), F.col("hashes").alias(f"of_{c}"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        rows = pairs.join(side("a"), "a").join(side("b"), "b").filter(linked(F.size("of_a"), F.size("of_b"), common))
        self.add(rows.select("a", "b"))

    def add(self, new: DataFrame) -> None:
        new = self.stash.put(new)
        self.links += new.count()
        self.edges = new if self.edges is None else self.edges.unionAll(new)

    def hashes_of(self, sigs: DataFrame) -> DataFrame:
        return self.stash.put(hashed(self.docs, self.sets, sigs))

    def labelled(self, rows: DataFrame) -> DataFrame:
        """rows plus component, the same for sets that are known to be linked within two steps: enough to spare comparisons.

        Written, as is what leads to it: the driver keeps a query's plan and a thread for each exchange that it has open.
        """
        if self.edges is None:
            return rows.withColumn("component", F.col("sig"))
        n = 2 * self.links
        both = by_rows(self.edges.unionAll(self.edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), n)
        near = self.stash.put(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        far = self.stash.put(both.join(by_rows(near, n).withColumnRenamed("a", "c"), F.col("b") == F.col("c")).groupBy("a").agg(F.least("a", F.min("m")).alias("component")))
        labels = small(far.withColumnRenamed("a", "sig"))
        made = self.stash.put(rows.join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig")))
        for done in (near, far):
            self.stash.drop(done)
        return made

    def settle(self, rows: DataFrame, hot: int | None) -> DataFrame | None:
        """Finds the links within keys of rows (key, sig). The members of hot keys are left to the caller, as (sig)."""
        stash = self.stash
        many = stash.put(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
        shared = stash.put(rows.join(small(many), "key"))
        per_key = small_as(many)
        scores = self.per_set(shared.groupBy("sig").agg(F.sum("n").alias("score")))
        hubs = shared.join(scores, "sig").groupBy("key").agg(F.max(F.struct("score", "sig")).alias("hub")).select("key", F.col("hub.sig").alias("hub"))
        pairs = shared.join(per_key(hubs), "key").filter("hub <> sig").select(F.least("hub", "sig").alias("a"), F.greatest("hub", "sig").alias("b")).distinct()
        pairs = stash.put(sized(pairs, self.sets))
        hashes = self.hashes_of(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct())
        self.compare(pairs, hashes)
        known = self.labelled(shared.filter("n > 2").select("key", "sig", "n"))
        left = known.join(per_key(_largest(known)), "key")
        left = stash.put(left.withColumn("hot", F.lit(False) if hot is None else F.col("n") - F.col("most") > hot))
        for done in (many, shared, pairs, hashes, known):
            stash.drop(done)
        near = stash.put(_meeting(left.filter("not hot").join(self.sets.select("sig", "size", "sketch"), "sig"), _nearest, "key long, sig long, partner long", per_key))
        if not near.isEmpty():
            self.verify(near, per_key)
        again = None if hot is None else stash.put(left.filter("hot").select("sig").distinct())
        stash.drop(left)
        stash.drop(near)
        return again

    def verify(self, near: DataFrame, per_key: Callable[[DataFrame], DataFrame]) -> None:
        """near: (key, sig, partner) of all sets that have a partner which sketches allow, with the nearest."""
        hashes = self.hashes_of(near.select("sig").distinct())
        self.compare(near.select(F.least("sig", "partner").alias("a"), F.greatest("sig", "partner").alias("b")).distinct(), hashes)
        known = self.labelled(near.select("key", "sig").distinct())
        asked = self.stash.put(known.join(per_key(_largest(known)), "key"))
        self.stash.drop(known)
        rows = asked.join(self.sets.select("sig", "size", "sketch"), "sig").join(hashes, "sig")
        self.add(_meeting(rows, _verified, "a long, b long", per_key).distinct())
        for done in (asked, hashes):
            self.stash.drop(done)

    def seldom_keys(self, sigs: DataFrame) -> DataFrame:
        """(sig) -> (key, sig): keys of seldom chunks first."""
        own = self.hashes_of(sigs)
        cells = own.select(F.explode("hashes").alias("h")).groupBy(F.shiftrightunsigned("h", 64 - CELL_BITS).alias("cell")).agg(F.count("*").alias("n"))
        cells = cells.filter(F.col("n") >= FREQUENT).select("cell").toArrow()  # 2**CELL_BITS rows at most
        frequent = np.zeros(1 << CELL_BITS, bool)
        frequent[cells.column("cell").to_numpy()] = True
        held = own.sparkSession.sparkContext.broadcast(frequent)

        def run(parts):
            for part in parts:
                sig, at = part.column("sig").to_numpy(), part.column("hashes").offsets.to_numpy()
                h = part.column("hashes").flatten().to_numpy().view(np.uint64)
                d, key = chunk_keys(np.repeat(np.arange(len(sig)), np.diff(at)), h, np.diff(at), held.value)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sig[d])], ["key", "sig"])

        return own.mapInArrow(run, "key long, sig long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, component_id), one row a row of docs."""
    arrow_limits(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    known = _Join(docs)
    hot = known.settle(known.sets.select(F.explode("keys").alias("key"), "sig"), HOT)
    if not hot.isEmpty():
        known.settle(known.stash.put(known.seldom_keys(hot)), None)
    labels = small(components(by_rows(known.edges, known.links), known.stash).withColumnRenamed("node", "sig"))
    sets = known.sets.select("sig", "rep", "copies").join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    named = sets.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("rows")).filter("rows > 1")
    ids = known.stash.put(sets.select("sig", "component").join(named, "component").select("sig", "component_id"))
    return known.every.select("doc_id", "n_shingles", "sig").join(small(ids), "sig", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _largest(rows: DataFrame) -> DataFrame:
    """(key, most, main) of keys with members of several components: the largest one and its members."""
    per = rows.groupBy("key", "component").agg(F.count("*").alias("own")).groupBy("key").agg(F.max(F.struct("own", "component")).alias("largest"), F.count("*").alias("parts"))
    return per.filter("parts > 1").select("key", F.col("largest.own").alias("most"), F.col("largest.component").alias("main"))


def _meeting(rows: DataFrame, of, schema: str, per_key: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `of` finds in blocks of the members of each key: rows outside the key's main component against all.

    rows: key, sig, component, main, size, sketch and what else `of` reads. per_key marks a table of keys for its join.
    """
    asks = F.col("component") != F.col("main")
    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK, s / BLOCK_SHINGLES))
    per = rows.groupBy("key").agg(
        blocks(F.count("*"), F.sum("size")).alias("holders"), blocks(F.count_if(asks), F.coalesce(F.sum(F.when(asks, F.col("size"))), F.lit(0))).alias("askers")
    )
    rows = rows.withColumn("asks", asks).join(per_key(per), "key")
    own = lambda n: F.pmod(F.xxhash64("sig"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda i, j, holds: F.struct(i.alias("i"), j.alias("j"), F.lit(holds).alias("holds"))
    # A row holds its cells and asks in others at once: two passes would join rows with their sets twice.
    held = F.transform(every("askers"), lambda j: cell(own("holders"), j, True))
    asked = F.transform(every("holders"), lambda i: cell(i, own("askers"), False))
    rest = [c for c in rows.columns if c not in ("holders", "askers", "main", "most", "hot", "n", "key")]
    placed = rows.select("key", F.explode(F.when(F.col("asks"), F.concat(held, asked)).otherwise(held)).alias("cell"), *rest).select("key", "cell.*", *rest)
    made = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "holds")

    def run(parts):
        for bundle, group in _bundles(parts):
            yield from of(bundle, group)

    return made.mapInArrow(run, schema)


def _bundles(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of equal (key, i, j) from sorted batches, many at once, with each row's group number."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def numbered(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        for c in ("key", "i", "j"):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in parts:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < BLOCK and size < BUNDLE_BYTES:
            continue
        t = pa.Table.from_batches(held)
        group = numbered(t)
        last = int(np.searchsorted(group, group[-1]))
        if last:
            yield t.slice(0, last).combine_chunks(), group[:last]
            held = t.slice(last).to_batches()
            rows, size = t.num_rows - last, sum(b.nbytes for b in held)
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbered(t)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _passing(bundle: pa.Table, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(asker, holder, distance) of rows of one group that sizes and sketches let through and whose components differ."""
    sig, component, size = (bundle.column(c).to_numpy() for c in ("sig", "component", "size"))
    holds, asks = (_one(bundle.column(c)).to_numpy(zero_copy_only=False).astype(bool) for c in ("holds", "asks"))
    sketch = _one(bundle.column("sketch"))
    at, longs = sketch.offsets.to_numpy(), sketch.values.to_numpy().view(np.uint64)
    width = np.diff(at)
    askers = np.flatnonzero(~holds)
    if not len(askers):
        return
    n = int(group[-1]) + 1
    end, many = np.searchsorted(group, np.arange(n), "right"), np.bincount(group[holds], minlength=n)
    first = end - many  # of the holders, which come after the askers
    cost = np.cumsum(many[group[askers]])
    lo = 0
    while lo < len(askers):
        hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + PAIRS, "right")))
        q, lo = askers[lo:hi], hi
        each = many[group[q]]
        a = np.repeat(q, each)
        b = np.repeat(first[group[q]] - np.cumsum(each) + each, each) + np.arange(len(a))
        fits = (component[a] != component[b]) & (DENOMINATOR * np.minimum(size[a], size[b]) >= NUMERATOR * np.maximum(size[a], size[b]))
        fits &= ~asks[b] | (sig[a] < sig[b])
        a, b = a[fits], b[fits]
        kinds = np.minimum(width[a], width[b]) * 4 + (width[a] > width[b]) + 2 * (width[b] > width[a])
        for kind in np.unique(kinds).tolist():
            k, fold = np.flatnonzero(kinds == kind), kind >> 2
            for s in range(0, len(k), step := max(1, PAIRS // fold)):
                x, y = a[k[s : s + step]], b[k[s : s + step]]
                of = lambda r: longs[at[r][:, None] + np.arange(fold)] ^ longs[at[r][:, None] + fold + np.arange(fold)] if width[r[0]] > fold else longs[at[r][:, None] + np.arange(fold)]  # noqa: E731, B023
                apart = np.bitwise_count(of(x) ^ of(y)).sum(axis=1, dtype=np.int64)
                near = (DENOMINATOR + NUMERATOR) * apart <= (DENOMINATOR - NUMERATOR) * (size[x] + size[y])
                if near.any():
                    yield x[near], y[near], apart[near]


def _nearest(bundle: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each row's nearest partner that sizes and sketches allow."""
    sig = bundle.column("sig").to_numpy()
    best = np.full(bundle.num_rows, np.iinfo(np.int64).max)
    partner = np.zeros(bundle.num_rows, np.int64)
    for a, b, apart in _passing(bundle, group):
        for own, other in ((a, b), (b, a)):
            order = np.lexsort((apart, own))
            rows, first = np.unique(own[order], return_index=True)
            to, d = other[order][first], apart[order][first]
            closer = d < best[rows]
            best[rows[closer]], partner[rows[closer]] = d[closer], sig[to[closer]]
    rows = np.flatnonzero(best < np.iinfo(np.int64).max)
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(bundle.column("key").to_numpy()[rows]), pa.array(sig[rows]), pa.array(partner[rows])], ["key", "sig", "partner"])


def _verified(bundle: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of the bundle's sets over the components that are known."""
    sig, component = (bundle.column(c).to_numpy() for c in ("sig", "component"))
    lists = _one(bundle.column("hashes"))
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    root: dict[int, int] = {}
    failed: set[tuple[int, int]] = set()

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    found = []
    for a, b, apart in _passing(bundle, group):
        for k in np.argsort(apart, kind="stable").tolist():
            x, y = int(a[k]), int(b[k])
            p, q = find(int(component[x])), find(int(component[y]))
            pair = (min(int(sig[x]), int(sig[y])), max(int(sig[x]), int(sig[y])))
            if p == q or pair in failed:
                continue
            of_x, of_y = flat[at[x] : at[x + 1]], flat[at[y] : at[y + 1]]
            common = int((of_x[np.minimum(np.searchsorted(of_x, of_y), len(of_x) - 1)] == of_y).sum())
            if linked(len(of_x), len(of_y), common):
                root[p] = q
                found.append(pair)
            elif len(failed) < SEEN:
                failed.add(pair)
    if found:
        one, two = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["a", "b"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, repeated rows once; the columns of docs."""
    made = near_duplicates(docs.select("doc_id", "text"))
    ids = made.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept"))
    counts = made.agg(F.count("*").alias("rows"), F.count_distinct(F.coalesce("doc_id", F.lit(-1))).alias("ids")).first()
    kept = docs.join(small(ids.distinct()), F.col("doc_id").cast("long").eqNullSafe(F.col("_kept")), "left_semi")
    return kept if counts["rows"] == counts["ids"] else kept.dropDuplicates(["doc_id", "text"])


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT x.doc_id AS xa, y.doc_id AS yb, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n a ON a.doc_id = xa JOIN n b ON b.doc_id = yb WHERE 100 * c >= 75 * (a.n + b.n - c)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), c AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN c ON w.doc_id = c.a
"""
