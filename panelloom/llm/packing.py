"""Packing documents into training sequences along a space-filling curve.

Each document's words are hashed into a vector, which a fixed random projection takes to a
few dimensions; its place on the Hilbert curve through them is the key by which documents
are put into ranges and sorted, so that sequences hold related documents. Ranges hold about
equal bytes, not rows, since long documents lie together on the curve, and are dealt to
tasks by hash. Each task's ranges are one stream of tokens, cut at every 2048; what remains
at its end goes to sequences whose lengths are powers of two, so nothing is padded.
Documents with equal keys follow a hash of their ids, so copies needn't share a range.
Keys are worked out once and written with their texts.

Tokens come from the named tokenizer. Texts are cut where white space follows a character
that is certainly not white space, which never changes a byte-level BPE's pieces, and each
distinct part is encoded once while it is in a bounded cache.

Defined cases: null and empty texts are their end token alone; rows that repeat a document,
or have a null id, are packed each on its own; an empty table gives no pieces; other columns
are not carried. Memory follows the longest document.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytetext
from .common import Stash, arrow_limits, table

LENGTH, END = 2048, 1
TOKENIZER = "byte_bpe_50k.json"
CACHE = 600_000
#: New parts that are encoded as one text.
JOINED = 64
BUCKETS, DIMS, BITS, SEED = 256, 4, 10, 5
#: Bytes of a range, and of what counts as one when ranges are bounded; ranges at most (they get longer beyond); bits of a key's hash of ids.
RANGE_BYTES, UNIT_BYTES, MOST_RANGES, TIE_BITS = 1 << 20, 1 << 10, 20_000, 20
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of integer points (n, dims), after Skilling (2004)."""
    x = x.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


@lru_cache(1)
def _projection() -> np.ndarray:
    return np.random.default_rng(SEED).normal(0, 1, (BUCKETS, DIMS))


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert keys of texts."""
    n = len(offsets) - 1
    vectors = np.zeros(n * BUCKETS)
    for doc, h, _ in bytetext.words(data, offsets, lower=True):
        lo = int(doc[0]) * BUCKETS if len(doc) else 0
        cell = doc * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64) - lo
        sums = np.bincount(cell) if len(cell) else np.zeros(0)
        vectors[lo : lo + len(sums)] += sums
    vectors = np.log1p(vectors.reshape(n, BUCKETS))
    vectors /= np.maximum(np.sqrt((vectors**2).sum(axis=1, keepdims=True)), 1e-12)
    at = 1 / (1 + np.exp(-1.7 * vectors @ _projection()))
    return hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


class Encoder:
    """Token ids of many texts, by distinct parts.

    A part is looked up by a 64-bit hash and compared with the bytes of the part that had it
    first; parts that share a hash with another are looked up by their bytes. New parts are
    encoded many to a text where texts may be cut between them, and told apart by the bytes
    that each id stands for.
    """

    SPACE = np.zeros(256, bool)
    SPACE[[0x20, *range(0x09, 0x0E)]] = True
    SOLID = np.zeros(256, bool)  # ASCII that is no white space in any definition
    SOLID[0x21:0x7F] = True

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = t = Tokenizer.from_file(path)
        self.encode = getattr(t, "encode_batch_fast", t.encode_batch)
        cut = t.pre_tokenizer
        self.joins = isinstance(cut, pre_tokenizers.ByteLevel) and cut.use_regex and not cut.add_prefix_space and t.normalizer is None and isinstance(t.model, models.BPE)
        vocab = t.get_vocab(with_added_tokens=False)
        added = {k: len(x.content.encode()) for k, x in t.get_added_tokens_decoder().items()}
        self.width = np.zeros(max(chain(vocab.values(), added), default=0) + 1, np.int64)  # bytes of each id; a byte is one character of a token's name
        for name, k in vocab.items():
            self.width[k] = len(name)
        for k, size in added.items():
            self.width[k] = size
        self.clear()

    def shrink(self) -> None:
        """Forget parts that came up once, and more of them if too many are left."""
        n = len(self.at)
        keep = np.flatnonzero(self.hits[:n] > max(1, np.sort(self.hits[:n])[-CACHE // 2] if n > CACHE // 2 else 1))
        names = list(self.at)
        known = [names[k] for k in keep.tolist()]
        start, size, ids, first, length, text = self.start[keep], self.size[keep], self.ids, self.first[keep], self.length[keep], self.text
        self.clear()
        for k, h in enumerate(known):
            self.at[h] = k
        n = len(known)
        gathered = lambda x, start, size, to: (x[np.repeat(start - to, size) + np.arange(int(size.sum()))])
        room = lambda x: np.concatenate([x, np.zeros(max(1024, n), np.int64)])
        self.start, self.size, self.hits, self.first, self.length = map(room, (np.cumsum(size) - size, size, np.ones(n, np.int64), np.cumsum(length) - length, length))
        self.ids = np.concatenate([gathered(ids, start, size, self.start[:n]), np.zeros(1 << 16, np.int32)])
        self.text = np.concatenate([gathered(text, first, length, self.first[:n]), np.zeros(1 << 16, np.uint8)])
        self.used, self.written = int(size.sum()), int(length.sum())

    def clear(self) -> None:
        self.at: dict = {}
        self.start, self.size, self.hits, self.first, self.length = (np.zeros(1024, np.int64) for _ in range(5))
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0
        self.text, self.written = np.zeros(1 << 16, np.uint8), 0

    def _encoded(self, parts: list[bytes], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of parts that aren't empty, and how many are each one's."""
        body, end = b"".join(parts), np.cumsum(length)
        if self.joins:
            try:
                body.decode()
            except UnicodeDecodeError:  # what replaces bytes has others
                pass
            else:
                apart = ~self._cuts(np.frombuffer(body, np.uint8))[end[:-1] - 1]
                apart[JOINED - 1 :: JOINED] = True
                stop = np.append(end[:-1][apart], len(body)).tolist()
                texts = [body[i:j].decode() for i, j in zip([0, *stop], stop, strict=False)]
                ids = np.fromiter(chain.from_iterable(e.ids for e in self.encode(texts, add_special_tokens=False)), np.int32)
                upto = np.cumsum(self.width[ids])
                last = np.searchsorted(upto, end)
                if len(ids) and upto[-1] == len(body) and np.array_equal(upto[last], end):
                    return ids, np.diff(last, prepend=-1)
        encoded = [e.ids for e in self.encode([x.decode("utf-8", "replace") for x in parts], add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, len(parts))
        return np.fromiter(chain.from_iterable(encoded), np.int32, int(size.sum())), size

    def _cuts(self, data: np.ndarray) -> np.ndarray:
        """Whether a text may be cut after each byte but the last: white space follows a character that is certainly none."""
        lead, before = (data >= 0xC3) & (data < 0xE0), self.SOLID[data]
        before[1:] |= lead[:-1] & (data[1:] >= 0x80)
        return self.SPACE[data[1:]] & before[:-1]

    def _learn(self, names: list, parts: list[bytes]) -> None:
        """Ids of parts under names, none of which is known; in arrays, as most of a table's distinct parts come up once."""
        roomy = lambda x, n: np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)]) if n > len(x) else x
        for lo in range(0, len(parts), 10_000):
            some, k = parts[lo : lo + 10_000], len(self.at)
            n = k + len(some)
            length = np.fromiter(map(len, some), np.int64, len(some))
            fresh, size = self._encoded(some, length)
            used, written = self.used + int(size.sum()), self.written + int(length.sum())
            self.start, self.size, self.hits, self.first, self.length = (roomy(x, n) for x in (self.start, self.size, self.hits, self.first, self.length))
            self.ids, self.text = roomy(self.ids, used), roomy(self.text, written + 8)  # eights() of it need room
            self.ids[self.used : used] = fresh
            self.text[self.written : written] = np.frombuffer(b"".join(some), np.uint8)
            self.start[k:n], self.size[k:n] = self.used + np.cumsum(size) - size, size
            self.first[k:n], self.length[k:n] = self.written + np.cumsum(length) - length, length
            self.at.update(zip(names[lo : lo + 10_000], range(k, n), strict=True))
            self.used, self.written = used, written

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, each text followed by END, and each text's number of ids with it."""
        n, lo, hi = len(offsets) - 1, int(offsets[0]), int(offsets[-1])
        part, starts = data[lo:hi], offsets - lo
        cut = np.zeros(len(part) + 1, bool)
        if len(part):
            cut[1:-1] = self._cuts(part)
        cut[starts[:-1][np.diff(starts) > 0]] = True
        begin = np.flatnonzero(cut[: len(part)])
        end = np.append(begin[1:], len(part))
        length = end - begin
        hashes = bytetext.spans(part, begin, length)
        known, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.at) + len(known) > CACHE:
            self.shrink()
        slot = np.fromiter(map(self.at.get, known.tolist(), repeat(-1)), np.int64, len(known))
        body = part.tobytes()
        text = lambda k: body[begin[k] : end[k]]
        if len(new := np.flatnonzero(slot < 0)):
            one = first[new]
            self._learn(known[new].tolist(), [body[i:j] for i, j in zip(begin[one].tolist(), end[one].tolist(), strict=True)])
            slot[new] = np.arange(len(self.at) - len(new), len(self.at))
        self.hits[slot] += 1
        slot = slot[inverse]
        # Parts that share a hash with another are named by their bytes.
        same = self.length[slot] == length
        held = np.ndarray((len(self.text) - 7,), "<u8", self.text, strides=(1,))
        same[same] = bytetext.same_spans(bytetext.eights(part), begin[same], held, self.first[slot[same]], length[same])
        for k in np.flatnonzero(~same).tolist():
            name = text(k)
            if name not in self.at:
                self._learn([name], [name])
            slot[k] = self.at[name]
        size = self.size[slot]
        total = int(size.sum())
        source = np.repeat(self.start[slot] - np.cumsum(size) + size, size) + np.arange(total)
        doc = np.searchsorted(starts, begin, "right") - 1
        tokens = np.bincount(doc, weights=size, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        out = np.full(total + n, END, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(n), tokens)] = self.ids[source]
        return out, tokens + 1


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One for all tasks that a Python worker runs, so that its cache stays warm."""
    return Encoder(path)


def _cut(doc_ids: np.ndarray, ids: np.ndarray, tokens: np.ndarray, open_tokens: int) -> Iterator[tuple]:
    """Pieces of a stretch of the stream: (doc, start in it, ids, its tokens, whether the sequence is full after it)."""
    edge = np.concatenate([[0], np.cumsum(tokens)])
    full = np.arange(LENGTH - open_tokens, len(ids) + 1, LENGTH)
    bounds = np.unique(np.concatenate([edge, full]))
    doc = np.searchsorted(edge, bounds[:-1], "right") - 1
    ends = np.isin(bounds[1:], full)
    for d, a, b, e in zip(doc.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), ends.tolist(), strict=True):
        yield doc_ids[d], a - int(edge[d]), ids[a:b], int(tokens[d]), e


def _pieces(parts: Iterator[pa.RecordBatch], path: str) -> Iterator[list[tuple]]:
    """Lists of rows of PIECE for one partition's documents in their order."""
    encode, sequence = encoder(path), TaskContext.get().partitionId() << 40
    waiting, held = [], 0
    for whole in parts:
        for part in bytetext.batches(whole, "text", 2 * bytetext.SLAB):
            rows = []
            ids, tokens = encode(*bytetext.flat(part.column("text")))
            for doc, start, piece, n, full in _cut(part.column("doc_id").to_pylist(), ids, tokens, held):
                waiting.append((doc, start, piece, n))
                held += len(piece)
                if full:
                    at = 0
                    for doc, start, piece, n in waiting:
                        rows.append((doc, start, len(piece), piece.tobytes(), n, sequence, at))
                        at += len(piece)
                    sequence, waiting, held = sequence + 1, [], 0
            waiting = [(doc, start, piece.copy(), n) for doc, start, piece, n in waiting]
            yield rows
    rows, room, at = [], 0, 0
    for doc, start, piece, n in waiting:
        while len(piece):
            if not room:
                room, at = 1 << (held.bit_length() - 1), 0  # the largest power of two that the rest fills
                size = room
            take = piece[:room]
            rows.append((doc, start, len(take), take.tobytes(), n, sequence, at))
            start, piece, room, at, held = start + len(take), piece[room:], room - len(take), at + len(take), held - len(take)
            sequence += at == size
    yield rows


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)

    def keyed(parts):
        for whole in parts:
            for part in bytetext.batches(whole, "text"):
                key = curve_keys(*bytetext.flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(key)], [*part.schema.names, "_key"])

    def packed(parts):
        names = [x.split()[0] for x in PIECE.split(", ")]
        types = [pa.binary() if x.endswith("binary") else pa.int64() for x in PIECE.split(", ")]
        for rows in _pieces(parts, path):
            for lo in range(0, len(rows), 2000):
                columns = zip(*rows[lo : lo + 2000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    arrow_limits(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = Stash(docs.sparkSession, "packing").put(docs.mapInArrow(keyed, "doc_id long, text string, _key long"))
    tie = F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))
    docs = docs.withColumns({"_place": F.shiftleft("_key", TIE_BITS) + tie, "_bytes": F.coalesce(F.octet_length("text"), F.lit(0))})
    docs = _in_ranges(docs).sortWithinPartitions("_range", "_place", "doc_id", F.xxhash64("text"))
    return docs.select("doc_id", "text").mapInArrow(packed, PIECE)


def _in_ranges(docs: DataFrame) -> DataFrame:
    """docs plus _range, by _place, dealt to partitions by it; ranges hold about as many bytes each."""
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, (docs.agg(F.sum("_bytes")).first()[0] or 0) // RANGE_BYTES + 1)
    bounds = np.zeros(0, np.int64)
    if ranges > 1:
        units = docs.select("_place", F.explode(F.sequence(F.lit(0), F.floor(F.col("_bytes") / UNIT_BYTES).cast("int"))))
        at = F.percentile_approx("_place", [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))
        bounds = np.unique(np.array(units.agg(at).first()[0], np.int64))  # MOST_RANGES at most
    # A table over the first bits of places leaves few bounds to look at.
    shift = max(0, DIMS * BITS + TIE_BITS - 16)
    cells = np.arange(1 << 16, dtype=np.int64)
    first = np.searchsorted(bounds, cells << shift)
    inside = pa.ListArray.from_arrays(pa.array(np.append(first, len(bounds)).astype(np.int32)), pa.array(bounds))
    cells = spark.createDataFrame(pa.table({"_cell": cells, "_first": first, "_bounds": inside}))
    docs = docs.withColumn("_cell", F.shiftright("_place", shift)).join(F.broadcast(cells), "_cell")  # 2**16 rows
    return docs.withColumn("_range", F.col("_first") + F.expr("size(filter(_bounds, b -> b < _place))")).repartition("_range")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pack(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
