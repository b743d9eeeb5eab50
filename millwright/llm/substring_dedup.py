"""Duplicate passages by relative Lempel-Ziv parsing against indexed reference blocks.

A block is a few megabytes of documents. Its index holds the hash of every 13-word window, filed under the window's
anchor: the least hash of the word 5-grams inside it, so that equal windows, wherever they are, meet in the same bucket
and neighbouring windows mostly travel together. Documents are parsed greedily: a factor goes on as long as the next
window is found in the reference at the next position. Where a factor ends, the windows that straddle its boundary are
looked up on their own, so none is missed between two factors. Factors of at least ``window`` words are duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import BLANK, flat_bytes, hash_runs, mix, rolling, runs_of, text_slices

_FACTORS = "doc_id long, start long, n_windows long, ref_doc_id long, ref_start long"
_FACTOR_TYPE = pa.schema([(c.split()[0], pa.int64()) for c in _FACTORS.split(", ")])
_ANCHOR_WORDS = 5


def _merge(doc, pos, ref_doc, ref_pos) -> list[np.ndarray]:
    """Runs in which position and reference advance together, as columns of the factor table."""
    if not len(doc):
        return [np.zeros(0, np.int64)] * 5
    order = np.lexsort((pos, doc))
    doc, pos, ref_doc, ref_pos = doc[order], pos[order], ref_doc[order], ref_pos[order]
    new = np.ones(len(doc), bool)
    new[1:] = ((doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (ref_doc[1:] != ref_doc[:-1])
               | (ref_pos[1:] != ref_pos[:-1] + 1))
    at = np.flatnonzero(new)
    return [doc[at], pos[at], np.diff(at, append=len(doc)), ref_doc[at], ref_pos[at]]


def _firsts(key: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """Sort by key, document and position; and for each sorted row the place of its key's first row."""
    order = np.lexsort((pos, doc, key))
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    return order, np.repeat(at, np.diff(at, append=len(key)))


def _pack(arrays: list[np.ndarray]) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(a, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
                                       for a in arrays), 1)


def _unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    return [np.ascontiguousarray(part.reshape(8, -1).T).view(np.int64).reshape(-1) for part in raw.reshape(columns, -1)]


def _index(window: int, buckets: int):
    anchor_words = min(_ANCHOR_WORDS, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, batch in enumerate(text_slices(batches)):
            ids = np.asarray(batch.column("doc_id"))
            data, offsets = flat_bytes(batch.column("text"))
            start, end, row = runs_of(~BLANK[data], offsets)
            n = len(start) - window + 1
            if n <= 0:
                continue
            word = hash_runs(data, start, end)
            gram = rolling(word, anchor_words)
            anchor = gram[:n].copy()
            for j in range(1, window - anchor_words + 1):
                np.minimum(anchor, gram[j:j + n], out=anchor)
            at = np.flatnonzero(row[:n] == row[window - 1:])
            key, doc = rolling(word, window)[at], ids[row[at]]
            pos = at - np.searchsorted(row, np.arange(len(ids)))[row[at]]
            order, first = _firsts(key, doc, pos)
            held = doc[order] != doc[order][first]  # a smaller document of this very block has it: settled here
            dup, ref = order[held], order[first[held]]
            rows = [(turn % buckets, 1, b"", _pack(_merge(doc[dup], pos[dup], doc[ref], pos[ref])))] if len(dup) else []
            send = np.sort(order[~held])
            bucket = (mix(anchor[at[send]]) % np.uint64(buckets)).astype(np.int64)
            send = send[np.argsort(bucket, kind="stable")]
            bucket = np.sort(bucket)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=buckets))
            for lo, hi in zip(edges[:-1], edges[1:]):
                mine = send[lo:hi]
                d, p = doc[mine], pos[mine]
                new = np.ones(len(mine), bool)
                new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)
                new = np.flatnonzero(new)
                rows.append((int(bucket[lo]), 0, key[mine].tobytes(),
                             _pack([d[new], p[new], np.diff(new, append=len(mine))])))
            for lo in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[lo:lo + 1000])],
                                                 names=["bucket", "settled", "keys", "places"])

    return run


def _look_up(table: pa.Table) -> pa.Table:
    keys, docs, places, out = [], [], [], []
    for settled, key, packed in zip(*(table.column(c).to_pylist() for c in ("settled", "keys", "places"))):
        if settled:
            out.append(_unpack(packed, 5))
            continue
        doc, pos, n = _unpack(packed, 3)
        keys.append(np.frombuffer(key, np.uint64))
        docs.append(np.repeat(doc, n))
        places.append(np.repeat(pos - np.cumsum(n) + n, n) + np.arange(int(n.sum())))
    if keys:
        key, doc, pos = (np.concatenate(x) for x in (keys, docs, places))
        order, first = _firsts(key, doc, pos)
        doc, pos = doc[order], pos[order]
        dup = doc != doc[first]
        out.append(_merge(doc[dup], pos[dup], doc[first[dup]], pos[first[dup]]))
    columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] or [np.zeros(0, np.int64)] * 5
    return pa.Table.from_arrays([pa.array(c) for c in columns], schema=_FACTOR_TYPE)


def factors(docs: DataFrame, window: int = 13, buckets: int | None = None) -> DataFrame:
    """Parts of greedy factors: (doc_id, start, n_windows, ref_doc_id, ref_start), positions in words.

    Words [start, start + n_windows + window - 1) of a document equal those at ``ref_start`` of a document with a
    smaller doc_id. Together the parts hold every window that has such a reference. Windows seen before within a block
    are settled there, so a passage in very many documents sends one entry per block. Rows without a doc_id have no
    order and give nothing; null and short texts have no windows; rows that share a doc_id never refer to each other.
    ``buckets`` (default 16 per shuffle partition) only spreads the work.
    """
    buckets = buckets or 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(_index(window, buckets), "bucket long, settled long, keys binary, places binary"))
    return blocks.groupBy("bucket").applyInArrow(_look_up, _FACTORS)


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        packer = zstandard.ZstdCompressor(level=3)
        data, offsets = flat_bytes(batch.column("text"))
        view = memoryview(data)
        packed = [packer.compress(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())],
                                         names=["doc_id", "packed"])


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, removed, digest, kept_text = [], [], [], []
            for packed, parts in zip(batch.column("packed"), batch.column("parts").to_pylist()):
                words = zstandard.decompress(packed.as_py()).split()
                if parts:
                    gone = np.zeros(len(words) + 1, np.int64)
                    for p in parts:
                        gone[p["start"]] += 1
                        gone[min(len(words), p["start"] + p["n_windows"] + window - 1)] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    kept = words
                text = b" ".join(kept)
                total.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(text).hexdigest())
                kept_text.append(text.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_duplicate_passages(docs: DataFrame, window: int = 13, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text), one row per input row.

    A word goes when a window over it also starts in a document with a smaller doc_id. Texts travel compressed. Rows
    without a doc_id and texts without words keep what they have; doc_id is a key, so rows that repeat it are taken for
    copies of one document. Other columns are ignored.
    """
    parts = (factors(docs, window, buckets).groupBy("doc_id")
             .agg(F.collect_list(F.struct("start", "n_windows")).alias("parts")))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _compress, "doc_id long, packed binary")
    return packed.join(parts, "doc_id", "left").select("doc_id", "packed", "parts").mapInArrow(
        _cut(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
