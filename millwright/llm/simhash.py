"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

Fingerprints within ``radius`` bits are linked. By the triangle inequality their distances to any reference fingerprint
(pivot) differ by no more than ``radius``, so a table of distances to many pivots discards most pairs by their largest
coordinate difference; the exact distance decides on the rest. Distances to pivots of random 64-bit fingerprints lie
within a few bits of 32 for nearly all of them, so they cannot say which pairs to look at in the first place: pairs are
looked at when they share a cell, that is, agree in two of ``radius + 2`` bit blocks. Bits that differ spoil at most
``radius`` blocks, so no pair within the radius is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import BLANK, flat_bytes, runs_of, text_slices
from millwright.llm.graph import components
from millwright.session import staged

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Reference fingerprints of the pivot table.
PIVOTS = np.random.RandomState(64).randint(0, 1 << 32, (32, 2), np.uint64) @ np.array([1, 1 << 32], np.uint64)


def _shingle_hashes(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat_bytes(batch.column("text"))
    data = LOWER[data]
    start, end, row = runs_of(~BLANK[data], offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(batch.num_rows + 1, np.int64)
    size = end - start
    begin = np.cumsum(size + 1) - size - 1
    joined = np.full(int(begin[-1] + size[-1]), 0x20, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    joined[np.repeat(begin, size) + inside] = data[np.repeat(start, size) + inside]
    count = np.bincount(row, minlength=batch.num_rows)
    first = np.cumsum(count) - count
    full = np.flatnonzero(row[:-width + 1 or None] == row[width - 1:]) if len(row) >= width else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < width))
    owner = np.concatenate([row[full], short])
    lo = np.concatenate([begin[full], begin[first[short]]])
    hi = np.concatenate([begin[full + width - 1] + size[full + width - 1],
                         begin[first[short] + count[short] - 1] + size[first[short] + count[short] - 1]])
    order = np.argsort(owner, kind="stable")
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], 42) for a, b in zip(lo[order].tolist(), hi[order].tolist())), np.uint64,
                         len(order))
    return hashes, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=batch.num_rows))])


def _fingerprint(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, max_bytes=1 << 20):
            hashes, edge = _shingle_hashes(batch, width)
            out = np.zeros((batch.num_rows, 64), np.uint8)
            for i in np.flatnonzero(np.diff(edge)):
                part = hashes[edge[i]:edge[i + 1]]
                ones = np.zeros(64, np.int64)
                for lo in range(0, len(part), 1 << 16):
                    ones += np.unpackbits(part[lo:lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1,
                                          bitorder="little").sum(axis=0, dtype=np.int32)
                out[i] = 2 * ones > len(part)
            prints = np.packbits(out, axis=1, bitorder="little").view(np.int64).reshape(-1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, print): 64-bit SimHash of the word ``width``-shingles of each whole text, repeats included.

    A-Z are lower-cased; a shorter text is one shingle, one without words (or null) has fingerprint 0. One row per input
    row; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _fingerprint(width), "doc_id long, print long")


def _masks(radius: int) -> list[int]:
    """Bit masks of the cells: all choices of blocks that two fingerprints within the radius may agree in."""
    blocks = radius + 2
    edge = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(edge[:-1], edge[1:])]
    return [a | b for a, b in combinations(block, 2)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give the ends of each link a common, smallest label."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label[:] = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def _link(cell: np.ndarray, prints: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the members of each cell; rows come sorted by cell. Pairs already connected are skipped."""
    table = np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    label = np.arange(len(cell))
    at, lag = np.arange(len(cell)), 0
    while len(at):
        lag += 1
        at = at[at + lag < len(cell)]
        at = at[cell[at] == cell[at + lag]]
        a = at[label[at] != label[at + lag]]
        for lo in range(0, table.shape[1], 8):
            a = a[np.abs(table[a, lo:lo + 8] - table[a + lag, lo:lo + 8]).max(axis=1, initial=0) <= radius]
        a = a[np.bitwise_count(prints[a] ^ prints[a + lag]) <= radius]
        _join_up(label, a, a + lag)
    linked = np.flatnonzero(label != np.arange(len(cell)))
    return node[linked], node[label[linked]]


def _pair_up(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in _closed(batches):
            if batch is None:
                rows, cut = held, len(held)
            else:
                rows = np.concatenate([held, np.stack([np.asarray(batch.column(c)) for c in ("cell", "print", "node")],
                                                      axis=1)])
                cut = int(np.searchsorted(rows[:, 0], rows[-1, 0])) if len(rows) else 0
            if cut:
                a, b = _link(rows[:cut, 0], np.ascontiguousarray(rows[:cut, 1]).view(np.uint64), rows[:cut, 2], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            held = rows[cut:]

    return run


def _closed(batches):
    """The batches, then None."""
    yield from batches
    yield None


def _balls(radius: int, masks: list[int]):
    """For each member of a crowded cell, the points near it: all that differ in at most radius - 1 free bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = []
        for mask in masks:
            bits = [1 << i for i in range(64) if not mask >> i & 1]
            flips.append((np.array([sum(c) for r in range(radius) for c in combinations(bits, r)], np.uint64),
                          np.array([r <= 1 for r in range(radius) for _ in combinations(bits, r)])))
        for batch in batches:
            for cell, which, bits, node in zip(*(batch.column(c).to_pylist() for c in ("cell", "which", "print", "node"))):
                points, near = flips[which]
                points = (points ^ np.uint64(bits % (1 << 64))).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), cell)), pa.array(points), pa.array(np.full(len(points), node)),
                     pa.array(near)], names=["cell", "point", "node", "near"])

    return run


def links(reps: DataFrame, radius: int = 3, crowd: int = 20_000) -> DataFrame:
    """(a, b): links that connect whatever nodes of (print, node) have prints within ``radius`` bits of each other.

    Fingerprints must be distinct. Cells are paired inside one task while they are small; a pair of two is not looked at
    again once they are connected. A cell with more than ``crowd`` fingerprints is not paired: two members within the
    radius share a point at most radius - 1 bits from the one and 1 bit from the other, and meet there, which is linear
    in the cell. Both ways are exact.
    """
    masks = _masks(radius)
    cells = reps.select("print", "node", F.posexplode(F.array(*[F.col("print").bitwiseAND(_signed(m)) for m in masks]))
                        .alias("which", "bits"))
    cells = cells.select(F.xxhash64("which", "bits").alias("cell"), "which", "print", "node")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("members")).where("members > 1")
    cells = staged(cells.join(sizes, "cell"), "cells")
    small = (cells.where(F.col("members") <= crowd).select("cell", "print", "node").repartition("cell")
             .sortWithinPartitions("cell", "print").mapInArrow(_pair_up(radius), "a long, b long"))
    points = (cells.where(F.col("members") > crowd).select("cell", "which", "print", "node")
              .mapInArrow(_balls(radius, masks), "cell long, point long, node long, near boolean"))
    hubs = points.groupBy("cell", "point").agg(F.min(F.when(F.col("near"), F.col("node"))).alias("b"))
    crowded = points.join(hubs.where("b IS NOT NULL"), ["cell", "point"]).select(F.col("node").alias("a"), "b")
    return small.unionByName(crowded.where("a != b").distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row; component_id is the smallest doc_id reachable.

    Equal fingerprints are reduced to one node before any pairing. Texts without words share fingerprint 0 and link like
    any other. Rows without a doc_id have a fingerprint but no component and link nothing; doc_id is a key, so rows that
    repeat it count as one document. An empty table gives no rows.
    """
    prints = staged(fingerprints(docs, width), "prints")
    reps = staged(prints.where("doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("node")), "reps")
    found = components(links(reps, radius))
    reps = reps.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return prints.join(reps, "print", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
