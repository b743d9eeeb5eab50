"""Toxic spans with a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled, so token labels are derived first: in a toxic training document a word is toxic when one of
its features (the word, its first 4, 5 and 6 bytes) is significantly more frequent in toxic than in clean documents. The
field has two tags, those features as emissions, and free transitions; it is trained on these token labels by gradient
steps that each run as one Spark job. Marginals come from exact forward-backward passes over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import flat_bytes, hash_runs, runs_of, text_slices
from millwright.session import staged

#: Bytes of words: everything but ASCII that is neither letter nor digit.
WORD_BYTE = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PREFIXES = (0, 4, 5, 6)
_SPACE = 1 << 22


@dataclass(frozen=True)
class Model:
    """``features`` are hashed feature numbers, ``weights`` theirs; ``chain`` is (bias, 0>1, 1>0, 1>1) potentials."""

    features: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    scale: np.ndarray


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from. Rows without an id count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _tokens(column: pa.Array):
    """Start, end (bytes), row and the hashed features (n x 4) of every word."""
    data, offsets = flat_bytes(column)
    data = _LOWER[data]
    start, end, row = runs_of(WORD_BYTE[data], offsets)
    parts = [hash_runs(data, start, np.minimum(end, start + n) if n else end) + np.uint64(n) for n in _PREFIXES]
    features = (np.stack(parts, axis=1) % np.uint64(_SPACE)).astype(np.int32) if len(start) else np.zeros((0, 4), np.int32)
    return start, end, row, features, offsets


def marginals(emission: np.ndarray, row: np.ndarray, rows: int, chain: np.ndarray):
    """P(tag 1) of every token by forward-backward, and the expected number of each transition.

    Tokens come row by row. All rows advance together, the longest first, so step t works on a contiguous block.
    """
    n = len(emission)
    count = np.bincount(row, minlength=rows)
    first = np.cumsum(count) - count
    rank = np.argsort(np.argsort(-count, kind="stable"), kind="stable")
    step = np.arange(n) - first[row]
    active = np.bincount(step)
    base = np.cumsum(active) - active
    place = base[step] + rank[row]
    e = np.empty(n)
    e[place] = np.exp(np.clip(emission, -30, 30))
    m00, (m01, m10, m11) = 1.0, np.exp(chain[1:])
    ahead, back = np.empty(n), np.ones(n)
    steps = list(zip(base.tolist(), active.tolist()))
    for t, (b, k) in enumerate(steps):
        if t:
            r = ahead[steps[t - 1][0]:steps[t - 1][0] + k]
            ahead[b:b + k] = e[b:b + k] * (m01 + m11 * r) / (m00 + m10 * r)
        else:
            ahead[b:b + k] = e[b:b + k]
    for t in range(len(steps) - 2, -1, -1):
        b, k = steps[t + 1]
        x = e[b:b + k] * back[b:b + k]
        back[steps[t][0]:steps[t][0] + k] = (m10 + m11 * x) / (m00 + m01 * x)
    odds = ahead * back
    p = (odds / (1 + odds))[place]
    left = np.flatnonzero(row[:-1] == row[1:]) if n else np.zeros(0, np.int64)
    a, x = ahead[place[left]], (e * back)[place[left + 1]]
    total = m00 + m01 * x + m10 * a + m11 * a * x
    pairs = np.array([(m01 * x / total).sum(), (m10 * a / total).sum(), (m11 * a * x / total).sum()])
    return p, pairs


def _emission(features: np.ndarray, model: Model) -> np.ndarray:
    table = np.zeros(_SPACE, np.float32)
    table[model.features] = model.weights
    return model.chain[0] + table[features].sum(axis=1, dtype=np.float64)


def _summary(p: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row: log-odds of its most likely toxic word, and log of the expected number of toxic words."""
    top = np.full(rows, 1e-5)
    np.maximum.at(top, row, p)
    top = np.minimum(top, 1 - 1e-5)
    return np.stack([np.log(top / (1 - top)), np.log(np.bincount(row, p, minlength=rows) + 1e-2)], axis=1)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches):
        toxic = np.asarray(batch.column("toxic"))
        _, _, row, features, _ = _tokens(batch.column("text"))
        pair = np.unique(row[:, None] * _SPACE + features.astype(np.int64))
        found, where = np.unique(pair % _SPACE, return_inverse=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(np.bincount(where, toxic[pair // _SPACE], len(found)).astype(np.int64)),
             pa.array(np.bincount(where, minlength=len(found)))], names=["feature", "toxic", "total"])


def _prepare(known: np.ndarray):
    """Per training document the words that have known features, and its token labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = np.full(_SPACE, -1, np.int32)
        index[known] = np.arange(len(known))
        for batch in text_slices(batches):
            _, _, row, features, _ = _tokens(batch.column("text"))
            count = np.bincount(row, minlength=batch.num_rows)
            step = np.arange(len(row)) - (np.cumsum(count) - count)[row]
            code = index[features]
            at, which = np.nonzero(code >= 0)
            cut = np.searchsorted(row[at], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(count),
                 pa.array([step[at[a:b]] for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.int64())),
                 pa.array([code[at[a:b], which[a:b]] for a, b in zip(cut[:-1], cut[1:])], pa.list_(pa.int32()))],
                names=["toxic", "words", "step", "code"])

    return run


def _unfold(batch: pa.RecordBatch):
    toxic, count = np.asarray(batch.column("toxic")), np.asarray(batch.column("words"))
    steps, codes = batch.column("step"), batch.column("code")
    sizes = np.diff(np.asarray(steps.offsets))
    owner = np.repeat(np.arange(len(count)), sizes)
    token = (np.cumsum(count) - count)[owner] + np.asarray(steps.flatten())
    gold = np.zeros(int(count.sum()))
    gold[token[toxic[owner] == 1]] = 1
    return toxic, np.repeat(np.arange(len(count)), count), token, np.asarray(codes.flatten()), gold


def _gradient(weights: np.ndarray, chain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 4)
        for batch in batches:
            _, row, token, code, gold = _unfold(batch)
            emission = np.full(len(row), chain[0])
            np.add.at(emission, token, weights[code])
            p, pairs = marginals(emission, row, batch.num_rows, chain)
            np.add.at(total, code, gold[token] - p[token])
            same = row[:-1] == row[1:]
            seen = [((gold[:-1] == i) & (gold[1:] == j) & same).sum() for i, j in ((0, 1), (1, 0), (1, 1))]
            total[-4:] += [(gold - p).sum(), *(np.array(seen) - pairs)]
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["gradient"])

    return run


def _summaries(weights: np.ndarray, chain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, row, token, code, _ = _unfold(batch)
            emission = np.full(len(row), chain[0])
            np.add.at(emission, token, weights[code])
            x = _summary(marginals(emission, row, batch.num_rows, chain)[0], row, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(toxic), pa.array(x[:, 0]), pa.array(x[:, 1])],
                                             names=["toxic", "top", "mass"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps, intercept first."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, max_docs: int = 6_000, max_features: int = 20_000, least_z: float = 5.0,
          rounds: int = 25) -> Model:
    """Fit the field on at most ``max_docs`` labelled documents outside the held-out fold, chosen by a hash of the id.

    ``max_features`` bounds the model. A document labelled twice counts as toxic if one label says so; null labels and
    ids are ignored. Without usable labels every document gets the same score, 0.5 or below.
    """
    chosen = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg(F.max(F.col("toxic").cast("long")).alias("toxic")).where(~held_out(F.col("doc_id")))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sample = staged(texts.join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "sample")
    n, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    expected = F.col("total") * F.lit(n_toxic / max(1, n))
    z = (F.col("toxic") - expected) / F.sqrt(expected + 1)
    counts = sample.mapInArrow(_evidence, "feature long, toxic long, total long").groupBy("feature").agg(
        F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))
    # Most of a word's occurrences must be in toxic documents, or common words would qualify by number.
    best = counts.where((z >= least_z) & (F.col("toxic") * 2 > F.col("total"))).orderBy(z.desc(), "feature")
    known = np.array([r[0] for r in best.limit(max_features).select("feature").collect()], np.int64)
    ready = staged(sample.mapInArrow(_prepare(known), "toxic long, words long, step array<long>, code array<int>")
                   .coalesce(8), "ready")
    w = np.zeros(len(known) + 4)
    w[-4:] = [-4.0, -1.0, 0.0, 0.0]
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        rows = ready.mapInArrow(_gradient(w[:-4], w[-4:]), "gradient array<double>").collect()
        g = np.sum([r[0] for r in rows], axis=0) / max(1, n) - 1e-4 * w if rows else np.zeros_like(w)
        first, second = 0.8 * first + 0.2 * g, 0.95 * second + 0.05 * g * g
        w = w + 0.5 * (first / (1 - 0.8 ** t)) / (np.sqrt(second / (1 - 0.95 ** t)) + 1e-8)
    fit = ready.mapInArrow(_summaries(w[:-4], w[-4:]), "toxic long, top double, mass double").collect()
    x = np.array([r[1:] for r in fit], float).reshape(-1, 2)
    return Model(known, w[:-4], w[-4:], _logistic(x, np.array([r[0] for r in fit], float)))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            start, end, row, features, offsets = _tokens(batch.column("text"))
            p, _ = marginals(_emission(features, model), row, batch.num_rows, model.chain)
            x = _summary(p, row, batch.num_rows)
            score = 1 / (1 + np.exp(-np.clip(model.scale[0] + x @ model.scale[1:], -30, 30)))
            hot = np.flatnonzero(p >= 0.5)
            cut = np.searchsorted(row[hot], np.arange(batch.num_rows + 1))
            spans = [[] for _ in range(batch.num_rows)]
            for i in np.flatnonzero(np.diff(cut)).tolist():
                raw = (batch.column("text")[i].as_py() or "").encode()
                for k in hot[cut[i]:cut[i + 1]].tolist():  # from bytes to code points
                    lo, hi = int(start[k] - offsets[i]), int(end[k] - offsets[i])
                    at = len(raw[:lo].decode())
                    spans[i].append({"start": at, "end": at + len(raw[lo:hi].decode())})
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "score", "spans"])

    return run


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans: array of (start, end)), one row per input row; toxic words in code points, end exclusive.

    Scores use the text alone. Null and empty texts get the score of a text without toxic words.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scorer(model), "doc_id long, score double, spans array<struct<start bigint, end bigint>>")
