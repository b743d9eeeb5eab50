"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A fingerprint adds each digest to one cell of each of three sub-tables: a count, an XOR of digests, an XOR of checksums.
Two fingerprints are subtracted cell by cell; what they share cancels, and cells left with one digest are peeled until
the differing digests are all known. Where peeling gets stuck both sides are sketched again at twice the size. The
number of differing digests and the sizes of both sets give the likeness.

Paragraphs end at line breaks, and within a long line after words whose hash is a multiple of ``_CUT``, so that an edit
changes only the pieces it touches, also in a text of one line.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import BLANK, flat_bytes, hash_runs, mix, runs_of, text_slices

_CUT = 8
_SUBTABLES = 3
_CHECK = np.uint64(0xA0761D6478BD642F)


def digests(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digest and row of every paragraph; the n-th repeat of a paragraph in a text has a digest of its own."""
    data, offsets = flat_bytes(column)
    start, end, _ = runs_of(~BLANK[data], offsets)
    cut = np.zeros(len(data) + 1, bool)
    cut[end[hash_runs(data, start, end) % np.uint64(_CUT) == 0]] = True
    cut[np.flatnonzero(data == 0x0A) + 1] = True
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    lo, hi = edges[:-1], edges[1:]
    row = np.searchsorted(offsets, lo, side="right") - 1
    h = hash_runs(data, lo, hi)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    repeat = np.arange(len(h)) - np.repeat(at, np.diff(at, append=len(h)))
    return mix(h + repeat.astype(np.uint64) * _CHECK), row


def _cells(key: np.ndarray, width: int) -> np.ndarray:
    """The cell of each key in each sub-table, n x 3."""
    salts = np.arange(1, _SUBTABLES + 1, dtype=np.uint64) * _CHECK
    return (mix(key[:, None] + salts) % np.uint64(width)).astype(np.int64) + np.arange(_SUBTABLES) * width


class Sketch:
    """One table per row: ``count``, ``key`` and ``check`` are rows x cells."""

    def __init__(self, key: np.ndarray, row: np.ndarray, rows: int, width: int):
        self.width = width
        shape = (rows, _SUBTABLES * width)
        self.count, self.key, self.check = np.zeros(shape, np.int32), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        self.add(key, row, np.ones(len(key), np.int32))

    def add(self, key: np.ndarray, row: np.ndarray, sign: np.ndarray) -> None:
        at = (_cells(key, self.width) + row[:, None] * self.count.shape[1]).reshape(-1)
        np.add.at(self.count.reshape(-1), at, np.repeat(sign, _SUBTABLES))
        np.bitwise_xor.at(self.key.reshape(-1), at, np.repeat(key, _SUBTABLES))
        np.bitwise_xor.at(self.check.reshape(-1), at, np.repeat(mix(key ^ _CHECK), _SUBTABLES))

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch.__new__(Sketch)
        out.width = self.width
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(digest, row, sign) of the differences found, and which rows came out empty. Uses the sketch up."""
        found = []
        while True:
            pure = (np.abs(self.count) == 1) & (mix(self.key ^ _CHECK) == self.check)
            row, cell = np.nonzero(pure)
            if not len(row):
                break
            key, sign = self.key[row, cell], self.count[row, cell]
            _, first = np.unique(np.stack([row.astype(np.uint64), key], axis=1), axis=0, return_index=True)
            row, key, sign = row[first], key[first], sign[first]
            found.append((key, row, sign))
            self.add(key, row, -sign)
        key, row, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
        return key, row, sign, ~(self.count.any(axis=1) | self.key.any(axis=1) | self.check.any(axis=1))


def _subset(key: np.ndarray, row: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the given rows, renumbered by their place in ``rows``."""
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    at = place[row] >= 0
    return key[at], place[row[at]]


def likeness(a: tuple, b: tuple, rows: int, width: int) -> np.ndarray:
    """Jaccard likeness of the digest sets of each row of ``a`` and ``b`` (digest, row); two empty ones are alike.

    Starts at sub-tables of ``width`` cells and doubles it for the rows that don't peel.
    """
    n_a, n_b = np.bincount(a[1], minlength=rows), np.bincount(b[1], minlength=rows)
    differ, left = np.zeros(rows, np.int64), np.arange(rows)
    while len(left):
        parts = [_subset(*x, left, rows) for x in (a, b)]
        gap = Sketch(*parts[0], len(left), width).minus(Sketch(*parts[1], len(left), width))
        _, row, _, done = gap.peel()
        differ[left] = np.bincount(row, minlength=len(left))
        left, width = left[~done], 2 * width
    both = (n_a + n_b - differ) / 2
    return np.where(n_a + n_b == 0, 1.0, both / np.maximum(1, n_a + n_b - both))


def serialized(sketch: Sketch, sizes: np.ndarray) -> list[str]:
    return [base64.b64encode(int(n).to_bytes(4, "big") + c.astype(">i4").tobytes() + k.astype(">u8").tobytes()
                             + (h >> np.uint64(32)).astype(">u4").tobytes()).decode()
            for n, c, k, h in zip(sizes, sketch.count, sketch.key, sketch.check)]


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _compare(width: int):
    def run(table: pa.Table) -> pa.Table:
        lent = np.asarray(table.column("lent"))
        ids = table.column("doc_id").to_pylist()
        texts = [zstandard.decompress(p).decode() for p in table.column("packed").to_pylist()]
        low = -(1 << 63) - 1
        order = sorted(range(len(ids)), key=lambda i: (lent[i], -(low if ids[i] is None else ids[i]), texts[i]))
        n = int((~lent).sum())
        texts = [texts[i] for i in order[:n + 1]]
        out = []
        for lo in range(0, n, 500):
            own, after = texts[lo:min(n, lo + 500)], texts[lo + 1:min(n, lo + 500) + 1]
            edited = [t[:len(t) - len(t) // 2] + u[:len(t) // 2] for t, u in zip(own, after)]
            rows = len(own)
            a, b, c = (digests(pa.array(x, pa.string())) for x in (own, edited, after))
            sizes = [np.bincount(x[1], minlength=rows) for x in (a, b)]
            out.append(pa.Table.from_arrays([
                pa.array([ids[i] for i in order[lo:lo + rows]], pa.int64()), pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(serialized(Sketch(*a, rows, width), sizes[0]), pa.string()),
                pa.array(serialized(Sketch(*b, rows, width), sizes[1]), pa.string()),
                pa.array(likeness(a, b, rows, width)), pa.array(likeness(a, c, rows, width))],
                names=[c.split()[0] for c in _OUT.split(", ")]))
        return pa.concat_tables(out) if out else pa.table({c.split()[0]: pa.array([], {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[c.split()[1]]) for c in _OUT.split(", ")})

    return run


def compare_versions(docs: DataFrame, width: int = 5, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per input row.

    The next document is the one with the next smaller doc_id (after the last, the first), among equal ids the next text
    by code points; rows without an id come last. The edited text is the text with its second half replaced by as much
    of the next one's beginning. Null texts are empty; a table of one row is its own next. Documents are dealt to
    ``buckets`` ranges of ids (default 4 per shuffle partition), and each range borrows the first row of the next, so a
    text moves once, compressed.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.stat.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))

    def bucket_of(doc_id: np.ndarray, missing: np.ndarray) -> np.ndarray:
        return np.where(missing, -1, np.searchsorted(cuts, doc_id, side="right"))

    def numbers(column) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(column.fill_null(0)), np.asarray(column.is_null())

    def heads(batches):
        for batch in batches:
            doc_id, missing = numbers(batch.column("doc_id"))
            bucket = bucket_of(doc_id, missing)
            found = [(int(k), int(doc_id[bucket == k].max())) for k in np.unique(bucket)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["bucket", "head"])

    top = sorted(ids.mapInArrow(heads, "bucket long, head long").groupBy("bucket").agg(F.max("head")).collect(), reverse=True)
    lend = {(k, head): top[i - 1][0] for i, (k, head) in enumerate(top)}  # to the range before, the first to the last

    def deal(batches):
        for batch in text_slices(batches):
            doc_id, missing = numbers(batch.column("doc_id"))
            bucket = bucket_of(doc_id, missing)
            packer = zstandard.ZstdCompressor(level=3)
            data, offsets = flat_bytes(batch.column("text"))
            view = memoryview(data)
            packed = [packer.compress(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            extra = [(i, lend[k, d]) for i, (k, d) in enumerate(zip(bucket.tolist(), doc_id.tolist())) if (k, d) in lend]
            pick = [*range(batch.num_rows), *(i for i, _ in extra)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*bucket.tolist(), *(k for _, k in extra)], pa.int64()), batch.column("doc_id").take(pa.array(pick)),
                 pa.array([False] * batch.num_rows + [True] * len(extra)), pa.array([packed[i] for i in pick], pa.binary())],
                names=["bucket", "doc_id", "lent", "packed"])

    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        deal, "bucket long, doc_id long, lent boolean, packed binary")
    return dealt.groupBy("bucket").applyInArrow(_compare(width), _OUT)
