"""Quality by importance resampling: two hashed n-gram models and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import BLANK, flat_bytes, hash_runs, mix, runs_of, text_slices
from millwright.session import staged

BUCKETS = 1 << 16
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash bucket and row of every token (word or run of symbols) and of every pair of neighbouring tokens."""
    data, offsets = flat_bytes(column)
    data = _LOWER[data]
    kinds = [runs_of(m, offsets) for m in (_WORD[data], ~_WORD[data] & ~BLANK[data])]
    start, end, row = (np.concatenate(x) for x in zip(*kinds))
    order = np.argsort(start, kind="stable")
    h, row = hash_runs(data, start[order], end[order]), row[order]
    pair = np.flatnonzero(row[:-1] == row[1:]) if len(row) else row
    both = mix(h[pair] * np.uint64(3) + h[np.minimum(pair + 1, max(0, len(h) - 1))])
    bucket = np.concatenate([h, both]) % np.uint64(BUCKETS)
    return bucket.astype(np.int64), np.concatenate([row, row[pair]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in text_slices(batches):
        total += np.bincount(_grams(batch.column("text"))[0], minlength=BUCKETS)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["bucket", "n"])


def gram_counts(docs: DataFrame) -> np.ndarray:
    """n-grams per bucket over all ``docs``; as many numbers as buckets, whatever the size of the corpus."""
    out = np.zeros(BUCKETS)
    for bucket, n in (docs.select("text").mapInArrow(_count, "bucket long, n long").groupBy("bucket")
                      .agg(F.sum("n")).collect()):
        out[bucket] = n
    return out


_FILTER_BITS = 1 << 23  # of the filter of labelled ids: at most 131,072 rows of 64 bits are broadcast


def _only(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose doc_id is among ``ids``: a Bloom filter of fixed size first, so that few other texts are shuffled,
    then the exact join, which is the same at every size."""
    def places(c: str) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(seed), c), F.lit(_FILTER_BITS)) for seed in (1, 2)]

    def bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))

    words = staged(ids.select(F.explode(F.array(*places("doc_id"))).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(bit(F.col("place"))).alias("bits")), "filter")
    likely = texts
    for i, place in enumerate(places("doc_id")):
        own = words.select(F.col("word").alias(f"word{i}"), F.col("bits").alias(f"bits{i}"))
        likely = likely.join(F.broadcast(own), F.shiftright(place, 6) == F.col(f"word{i}")).where(F.col(f"bits{i}").bitwiseAND(bit(place)) != 0)
    return likely.select(*texts.columns).join(ids.hint("merge"), "doc_id", "left_semi")


def log_ratio(docs: DataFrame, labels: DataFrame, max_docs: int | None = None) -> np.ndarray:
    """Per bucket log p(target) - log p(raw), each with one count added to every bucket.

    Raw text is all of ``docs``; the target is all documents labelled quality 1, or ``max_docs`` of them by a hash of the id.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"))
              .distinct())
    if max_docs is not None:
        chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    target, raw = (gram_counts(d) + 1 for d in (_only(texts, staged(chosen, "chosen")), texts))
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _weigh(ratio: np.ndarray, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            bucket, row = _grams(batch.column("text"))
            n = np.bincount(row, minlength=batch.num_rows)
            weight = length * np.bincount(row, ratio[bucket], batch.num_rows) / np.maximum(1, n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(n)],
                                             names=["doc_id", "log_weight", "n_grams"])

    return run


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from a hash of the id: the same in every run."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(-1)), F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def _narrowed(rows: DataFrame, column: str, left: int, descending: bool, bins: int, small: int) -> tuple[DataFrame, int, int]:
    """Rows among which the ``left``-th by ``column`` is: at most ``small``, or all of one value. Also how many, and its number there."""
    n, lo, hi = rows.agg(F.count("*"), F.min(column), F.max(column)).first()
    while n > small and hi > lo:
        # Bounds are compared exactly; bins only have to be monotonous.
        slot = F.least(F.lit(bins - 1), F.floor((F.col(column).cast("double") - float(lo)) / ((float(hi) - float(lo)) / bins)))
        counts = sorted((tuple(r) for r in rows.groupBy(slot).agg(F.count("*"), F.min(column), F.max(column)).collect()), reverse=descending)
        for _, n, lo, hi in counts:
            if left <= n:
                break
            left -= n
        rows = rows.where(F.col(column).between(lo, hi))
    return rows, n, left


def top_k(rows: DataFrame, k: int, bins: int = 1024, small: int = 20_000) -> tuple[float, int] | None:
    """(key, doc_id) of the k-th row of (key, doc_id) by falling key, then rising doc_id; None: all rows.

    Histograms of the keys, and among rows of one key of the ids, narrow the interval around it until at most ``small`` rows are
    left or all are the same; nothing is sorted as a whole, and any number of rows may share a key or an id.
    """
    if k >= rows.count():
        return None
    inside, n, left = _narrowed(rows, "key", k, True, bins, small)
    if n > small:  # of one key
        inside, n, left = _narrowed(inside, "doc_id", left, False, bins, small)
    if n > small:  # of one key and id
        return tuple(inside.select("key", "doc_id").first())
    for key, doc_id in inside.select("key", "doc_id").orderBy(F.desc("key"), "doc_id").collect():
        left -= 1
        if not left:
            return key, doc_id


def resample(docs: DataFrame, ratio: np.ndarray, fraction: float = 0.5, length: int = 100, seed: int = 11) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, selected), one row per input row.

    ``log_weight`` is the mean log ratio of the text's n-grams times ``length``, so that long texts don't win by length;
    a text without tokens (or null) has 0. The ``fraction`` of rows with the largest weight plus Gumbel noise is
    selected, which samples without replacement in proportion to the weights. Rows that repeat the last selected doc_id
    are selected with it; rows without a doc_id share one noise value.
    """
    weighed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _weigh(ratio, length), "doc_id long, log_weight double, n_grams long")
    keyed = staged(weighed.withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "weighed")
    bare = keyed.select(F.col("gumbel_key").alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("doc_id"))
    k = int(fraction * keyed.count())
    last = top_k(bare, k) if k else (float("inf"), 0)
    key, doc = F.col("gumbel_key"), F.coalesce("doc_id", F.lit(-1))
    chosen = F.lit(True) if last is None else (key > last[0]) | ((key == last[0]) & (doc <= last[1]))
    return keyed.select("doc_id", "n_grams", "log_weight", "gumbel_key", chosen.alias("selected"))
