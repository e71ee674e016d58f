"""Words and their hashes from the bytes of Arrow text columns, without a Python loop over words.

A word's hash starts from its length and takes in eight bytes at a time, each followed by a
mix that isn't linear; so words of up to eight bytes differ wherever they do, and longer ones
with structure (repetitions, complements, shifts) collide no more than others, which a
polynomial in the bytes modulo 2**64 can't say. All words of a stretch take their first
eight bytes together, then those that have more their next ones. Arrays cover at most SLAB
bytes; longer texts are cut where they have a separator, and words beyond LONG bytes are
hashed by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLAB, LONG = 1 << 20, 1024
#: White space of WORD: 0x20 and 0x09-0x0D.
WORD_BYTES = np.ones(256, bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: ASCII letters and all bytes of multi-byte characters.
LETTER_BYTES = np.zeros(256, bool)
LETTER_BYTES[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if at is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, offsets


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of the low end of a number, by how many.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
KEY, ODD = np.uint64(0x6A09E667F3BCC908), np.uint64(0x9E3779B97F4A7C15)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; what lies beyond the end is 0."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each stretch of the data; equal stretches have equal ones."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    at = eights(data)
    h = mix(size.astype(np.uint64) * ODD + KEY + np.uint64(salt))
    h = mix(h ^ (at[begin] & MASK[np.minimum(size, 8)]))
    more, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        h[more] = mix(h[more] ^ (at[begin[more] + k] & MASK[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > LONG).tolist():
        body = data[begin[i] : begin[i] + size[i]].tobytes()
        h[i] = mix(np.frombuffer(hashlib.blake2b(body, digest_size=8).digest(), np.uint64))[0] + np.uint64(salt)
    return h


def same_spans(a: np.ndarray, a_begin: np.ndarray, b: np.ndarray, b_begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of two data, of one size each, have the same bytes. a and b are eights()."""
    out = np.ones(len(size), bool)
    left, k = np.flatnonzero(size > 0), 0
    while len(left):
        differ = ((a[a_begin[left] + k] ^ b[b_begin[left] + k]) & MASK[np.minimum(size[left] - k, 8)]) != 0
        out[left[differ]] = False
        k += 8
        left = left[~differ]
        left = left[size[left] > k]
    return out


def _slabs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first byte, last byte, first text, last text): whole texts, or parts of one that is longer than a slab."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLAB, "right")) - 1)
        lo, hi = int(offsets[i]), int(offsets[j])
        while hi - lo > SLAB:
            cut = np.flatnonzero(~inside[data[lo : lo + SLAB]])
            if len(cut):
                end = lo + int(cut[-1]) + 1
            else:  # one word fills the slab: take all of it
                end = lo + SLAB
                while end < hi and not len(cut := np.flatnonzero(~inside[data[end : min(hi, end + SLAB)]])):
                    end = min(hi, end + SLAB)
                end += int(cut[0]) if len(cut) else 0
            yield lo, end, i, j
            lo = end
        yield lo, hi, i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTES, lower: bool = False, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """By slab: the text's index and the hash of each word, and for each k of prefixes the hash of its first k bytes.

    A prefix's hash is 0 where the word has no more than k bytes.
    """
    for lo, hi, i, j in _slabs(data, offsets, inside):
        part = data[lo:hi]
        if lower:
            part = LOWER[part]
        n = len(part)
        if not n:
            continue
        if n > SLAB:
            part = part[inside[part]]  # one word
            begin, size, doc = np.zeros(1, np.int64), np.array([len(part)]), np.array([i])
            yield doc, spans(part, begin, size), [spans(part, begin, np.full(1, k), k) for k in prefixes]
            continue
        is_word = np.zeros(n + 2, bool)
        is_word[1:-1] = inside[part]
        first = np.zeros(n + 1, bool)
        starts = offsets[i : j + 1] - lo
        first[starts[(starts >= 0) & (starts <= n)]] = True
        begin = np.flatnonzero(is_word[1:-1] & (~is_word[:-2] | first[:-1]))
        end = np.flatnonzero(is_word[1:-1] & (~is_word[2:] | first[1:])) + 1
        size, heads = end - begin, []
        for k in prefixes:
            heads.append(np.zeros(len(begin), np.uint64))
            longer = np.flatnonzero(size > k)
            heads[-1][longer] = spans(part, begin[longer], np.full(len(longer), k), k)
        yield np.searchsorted(starts, begin, "right") - 1 + i, spans(part, begin, size), heads


def all_words(data: np.ndarray, offsets: np.ndarray, **how) -> tuple[np.ndarray, np.ndarray]:
    """As words(), in one piece: text index and hash of every word."""
    parts = [(d, h) for d, h, _ in words(data, offsets, **how)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def batches(batch: pa.RecordBatch, column: str, most: int = 8 * SLAB) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about `most` bytes at most."""
    _, offsets = flat(batch.column(batch.schema.get_field_index(column)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j
