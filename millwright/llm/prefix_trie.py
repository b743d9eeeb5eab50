"""Trie of conversation prefixes from composable fingerprints.

A sequence of turns has the fingerprint (length n, sum of e_j * Q^j mod p) in four lanes of 31 bits, e_j from a 128-bit key of
the j-th turn's role and text. Fingerprints form a monoid: (n, G) then (m, H) is (n + m, G + Q^n * H), and a front part can be
divided out again. So the prefixes of a conversation whose head is another one's and whose rest is its own follow from prefix
fingerprints of the stored turns; no rebuilt conversation is ever written down, its rows refer to stored turns by key.

Fingerprints are not trusted. All members of a group of equal fingerprints must refer to one turn key at the last place, and
keys must stand for one role and text each, which whole contents are compared for. Then the fingerprints one place shorter are
equal too, and by induction so are the prefixes. If a check fails, everything is done anew with other bases.

Totals over subtrees need no walk. The smallest member owns a node, and a conversation owns its path from some depth on; every
total is then a sum over the members of a node, of how far each one's path runs on before it owns it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.session import staged

LANES = 4
PRIME = (1 << 31) - 1
STEP = 5  # a conversation's head is taken from the one at the next lower multiple of this
HEADS = 9  # heads have fewer turns than this
_MASK = (1 << 31) - 1
_BLOCK_BITS = 12  # of conv_ids whose list one row holds
_KEY = ["depth", "g1", "g2"]


def bases(modulus: int, seed: int) -> list[int]:
    draw = np.random.RandomState(1000 + seed)
    return [int(q) for q in draw.randint(min(2, modulus - 1), modulus, LANES)]


def _powers(base: int, n: int, modulus: int) -> np.ndarray:
    """base^1 to base^n."""
    out = np.array([base % modulus], np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * out[-1] % modulus])
    return out[:n]


def _scan(modulus: int, qs: list[int]):
    """Prefix fingerprints and lengths of conversations, as far as a partition holds them; at its end, a row that sums up its last one."""
    names = ["part", "conv_id", "pos", "g1", "g2", "cum", "k1", "k2", "bytes", "first_conv"]

    def pack(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (lanes[0] << 31) | lanes[1], (lanes[2] << 31) | lanes[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first_conv, conv, n, cum = TaskContext.get().partitionId(), None, None, 0, 0
        lanes, power = np.zeros(LANES, np.int64), np.ones(LANES, np.int64)  # of the conversation that is open: G, Q^n
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            ids, k1, k2, size = (np.asarray(batch.column(c)) for c in ("conv_id", "k1", "k2", "bytes"))
            first_conv = int(ids[0]) if first_conv is None else first_conv
            start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            length = np.diff(np.append(start, rows))
            index = np.arange(rows) - np.repeat(start, length)
            carried = int(length[0]) if ids[0] == conv else 0  # rows that go on with the open conversation
            pos = index + 1
            pos[:carried] += n
            total = np.cumsum(size)
            total -= np.repeat(total[start] - size[start], length)
            total[:carried] += cum
            e = np.stack([k1 & _MASK, (k1 >> 31) & _MASK, k2 & _MASK, (k2 >> 31) & _MASK]) % modulus
            got = np.empty((LANES, rows), np.int64)
            for lane, q in enumerate(qs):
                pw = _powers(q, int(length.max()), modulus)
                sums = np.cumsum(e[lane] * pw[index] % modulus)
                sums = (sums - np.repeat(np.concatenate([[0], sums[start[1:] - 1]]), length)) % modulus
                if carried:
                    sums[:carried] = (lanes[lane] + power[lane] * sums[:carried]) % modulus
                got[lane] = sums
                reach = int(pw[length[-1] - 1])
                power[lane] = power[lane] * reach % modulus if carried == rows else reach
            conv, n, cum, lanes = int(ids[-1]), int(pos[-1]), int(total[-1]), got[:, -1].copy()
            g1, g2 = pack(got)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(rows, part, np.int32)), pa.array(ids), pa.array(pos), pa.array(g1), pa.array(g2), pa.array(total),
                 pa.array(k1), pa.array(k2), pa.array(size), pa.nulls(rows, pa.int64())], names=names)
        if first_conv is not None:
            g1, g2 = pack(lanes[:, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), *[pa.array([int(v)], pa.int64()) for v in (conv, n, g1[0], g2[0], cum, 0, 0, 0, first_conv)]],
                names=names)

    return run


def _lane(g1: str, g2: str, lane: int) -> Column:
    g = F.col(g1 if lane < 2 else g2)
    return F.shiftright(g, 31) if lane % 2 == 0 else g.bitwiseAND(F.lit(_MASK))


def _packed(lanes: list[Column]) -> list[Column]:
    return [F.shiftleft(lanes[i], 31).bitwiseOR(lanes[i + 1]).alias(f"g{i // 2 + 1}") for i in (0, 2)]


def stored_turns(turns: DataFrame, modulus: int, qs: list[int]) -> DataFrame:
    """(conv_id, pos, g1, g2, cum, k1, k2, bytes) of ``turns`` (conv_id, turn, k1, k2, bytes): the place of each turn, from 1, and the
    fingerprint and bytes up to it.

    Turns are sorted by range, so a long conversation is spread over tasks. What partitions hand on to the next ones, a row each, is
    composed on the driver and joined.
    """
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("k1"), F.asc("k2")]
    spread = turns.withColumn("row", F.monotonically_increasing_id())  # tells equal rows apart, so that ranges can
    rows = (spread.repartitionByRange(*order, F.asc("row")).sortWithinPartitions(*order, F.asc("row"))
            .select("conv_id", "k1", "k2", "bytes").mapInArrow(_scan(modulus, qs), (
                "part int, conv_id long, pos long, g1 long, g2 long, cum long, k1 long, k2 long, bytes long, first_conv long")))
    rows = staged(rows, "turns")
    spark, carry, carries = turns.sparkSession, None, []
    for r in rows.where("first_conv IS NOT NULL").orderBy("part").collect():  # one row per partition
        lanes = [r.g1 >> 31, r.g1 & _MASK, r.g2 >> 31, r.g2 & _MASK]
        goes_on = carry is not None and carry[0] == r.first_conv
        if goes_on:
            _, n, cum, g = carry
            power = [pow(q, n, modulus) for q in qs]
            carries.append((r.part, r.first_conv, n, cum, *g, *power))
            if r.conv_id == r.first_conv:
                carry = (r.conv_id, n + r.pos, cum + r.cum, [(a + w * b) % modulus for a, b, w in zip(g, lanes, power)])
                continue
        carry = (r.conv_id, r.pos, r.cum, lanes)
    rows = rows.where("first_conv IS NULL").drop("first_conv")
    if not carries:
        return rows.drop("part")
    names = [f"c{i}" for i in range(LANES)] + [f"w{i}" for i in range(LANES)]
    add = spark.createDataFrame(carries, "part int, conv_id long, n0 long, cum0 long, " + ", ".join(f"{c} long" for c in names))
    rows = rows.join(F.broadcast(add), ["part", "conv_id"], "left")  # no more rows than partitions
    lanes = [(F.coalesce(F.col(f"c{i}"), F.lit(0)) + F.coalesce(F.col(f"w{i}"), F.lit(1)) * _lane("g1", "g2", i)) % modulus for i in range(LANES)]
    return rows.select("conv_id", (F.col("pos") + F.coalesce("n0", F.lit(0))).alias("pos"), *_packed(lanes),
                       (F.col("cum") + F.coalesce("cum0", F.lit(0))).alias("cum"), "k1", "k2", "bytes")


def rebuilt_prefixes(turns: DataFrame, modulus: int, qs: list[int]) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation, (conv_id, depth, g1, g2, k1, k2, bytes, cum, size), and conversations
    (conv_id, size, total), from the result of ``stored_turns``."""
    entry = F.struct("pos", "g1", "g2", "k1", "k2", "bytes", "cum")
    convs = staged(turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.max("cum").alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("pos") < HEADS, entry))).alias("head")), "convs")
    donors = (convs.where(F.col("conv_id") % STEP == 0)
              .select(F.col("conv_id").alias("donor"), F.col("head").alias("theirs")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    info = convs.withColumn("h", h).withColumn("donor", F.col("conv_id") - F.col("conv_id") % STEP).join(donors, "donor", "left")
    info = info.withColumn("theirs", F.when(F.col("theirs").isNull(), F.array().cast(info.schema["theirs"].dataType))
                           .otherwise(F.slice("theirs", 1, F.col("h"))))
    info = info.withColumn("hb", F.size("theirs"))
    cut = F.when((F.col("h") > 0) & (F.col("n") >= F.col("h")), F.element_at("head", F.greatest("h", F.lit(1))))  # own turns that go
    lent = F.when(F.col("hb") > 0, F.element_at("theirs", F.greatest("hb", F.lit(1))))
    zero = F.lit(0).cast("long")
    field = lambda of, name: F.coalesce(of.getField(name), zero)
    lent_cum, cut_cum = field(lent, "cum"), field(cut, "cum")
    info = info.select(
        "conv_id", "h", "hb", "theirs", (F.col("hb") + F.greatest(F.col("n") - F.col("h"), zero)).alias("size"),
        (lent_cum + F.when(F.col("n") > F.col("h"), F.col("own") - cut_cum).otherwise(0)).alias("total"),
        (lent_cum - cut_cum).alias("cum0"), *[field(lent, g).alias(f"l{g}") for g in ("g1", "g2")],
        *[field(cut, g).alias(f"c{g}") for g in ("g1", "g2")])
    info = staged(info, "info")
    root = F.struct(*[zero.alias(c) for c in ("pos", "g1", "g2", "k1", "k2", "bytes", "cum")])
    heads = info.select("conv_id", "size", F.explode(F.concat(F.array(root), "theirs")).alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.g1", "t.g2", "t.k1", "t.k2", "t.bytes", "t.cum", "size")
    rest = turns.where(F.col("pos") > h).join(info.drop("theirs", "total"), "conv_id")
    back = [F.element_at(F.array(*[F.lit(pow(q, -i, modulus)) for i in range(HEADS)]), F.col("h") - F.col("hb") + 1) for q in qs]
    lanes = [(_lane("lg1", "lg2", i) + (_lane("g1", "g2", i) - _lane("cg1", "cg2", i) + modulus) % modulus * back[i]) % modulus
             for i in range(LANES)]
    rest = rest.select("conv_id", (F.col("hb") + F.col("pos") - F.col("h")).alias("depth"), *_packed(lanes), "k1", "k2", "bytes",
                       (F.col("cum") + F.col("cum0")).alias("cum"), "size")
    return staged(heads.unionByName(rest), "prefixes"), info.select("conv_id", "size", "total")


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ids, each node's in order, to one hash per node."""
    key, state, done = None, None, []

    def flush() -> pa.RecordBatch:
        keys = [pa.array(c, pa.int64()) for c in zip(*[k for k, _ in done])]
        return pa.RecordBatch.from_arrays([*keys, pa.array([d for _, d in done], pa.string())], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if node != key:
                if state:
                    done.append((key, state.hexdigest()))
                key, state = node, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if len(done) >= 4096:
            yield flush()
            done = []
    if state:
        done.append((key, state.hexdigest()))
    if done:
        yield flush()


def _verified(contents: DataFrame, nodes: DataFrame) -> bool:
    """Whether each key stands for one role and text, and each group of equal fingerprints refers to one key."""
    kinds = contents.groupBy("k1", "k2", "role", "text").agg(F.count("*").alias("n"))  # equal contents combine before the shuffle
    return (nodes.where("k1 != k1_max OR k2 != k2_max").isEmpty()
            and kinds.groupBy("k1", "k2").agg(F.count("*").alias("kinds")).where("kinds > 1").isEmpty())


def prefix_trie(conversations: DataFrame, moduli: Sequence[int] = (PRIME,) * 4) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one row per node.

    ``conversations`` has conv_id, turn, role, text; other columns are ignored, whatever their names. Turns go by ``turn``, nulls first,
    those of one number by a hash of role and text. Null roles and texts are empty. Rows without a conv_id belong to no conversation
    and are left out. Conversation c is rebuilt from the first h turns of conversation c - c % 5 (all if it has fewer, none if there
    is none) and its own turns after its first h, with h = crc32(c) % 9; repeated rows are turns of their own. Without any
    conversation there is no root and no row.

    A node of which a third of all conversations are members is summed before its rows are shuffled. The list of the conversations that
    end at a node is hashed as a stream, blocks of at most 4096 ids at a time. ``moduli`` are those of the fingerprints, the next one
    for each attempt; ValueError if none passes the checks.
    """
    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                  F.coalesce("text", F.lit("")).alias("text")).where("conv_id IS NOT NULL")
    for seed, modulus in enumerate(moduli):
        qs = bases(modulus, seed)
        contents = source.withColumns({"k1": F.xxhash64("role", "text"), "k2": F.xxhash64(F.lit(seed), "text", "role"),
                                       "bytes": F.octet_length("text").cast("long")})
        turns = stored_turns(contents.drop("role", "text"), modulus, qs)
        rows, convs = rebuilt_prefixes(turns, modulus, qs)
        nodes = staged(rows.groupBy(*_KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("longest"), F.min("bytes").alias("bytes"),
            F.min("cum").alias("cum"), F.min("k1").alias("k1"), F.max("k1").alias("k1_max"), F.min("k2").alias("k2"),
            F.max("k2").alias("k2_max")), "nodes")
        if _verified(contents, nodes):
            return _totals(rows, convs, nodes.drop("k1", "k1_max", "k2", "k2_max"))
    raise ValueError("no modulus gave distinct fingerprints to distinct prefixes")


def _totals(rows: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    owned = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("owns"), F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).alias("alone"),
        F.min_by(F.col("cum") - F.col("bytes"), "depth").alias("before"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    beyond = F.col("size") + 1
    paths = convs.join(owned, "conv_id", "left").select(
        "conv_id", F.coalesce("owns", beyond).alias("owns"), F.coalesce("alone", beyond).alias("alone"),
        F.coalesce("before", "total").alias("before"), F.coalesce("leaf", F.lit(False)).alias("leaf"))
    shared = rows.join(paths, "conv_id").where("depth < alone").select("conv_id", *_KEY, "bytes", "cum", "size", "owns", "before", "leaf")
    shared = staged(shared, "shared")
    several = nodes.where("n_convs > 1")
    sums = shared.groupBy(*_KEY).agg(
        F.sum(((F.col("owns") <= F.col("depth") + 1) & (F.col("depth") < F.col("size"))).cast("long")).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"),
        F.sum(F.when(F.col("owns") > F.col("depth"), F.col("before") - F.col("cum") + F.col("bytes")).otherwise(0)).alias("saved_tokens"))
    blocks = (shared.where("depth = size").groupBy(*_KEY, F.shiftright("conv_id", _BLOCK_BITS).alias("block"))
              .agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")))
    ends = (blocks.repartition(*_KEY).sortWithinPartitions(*_KEY, "block")
            .mapInArrow(_ends, "depth long, g1 long, g2 long, ends_sha256 string"))
    of_shared = (several.join(sums, _KEY).join(ends, _KEY, "left")
                 .select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
    one = F.lit(1).cast("long")
    of_one = nodes.where("n_convs = 1").select(
        "conv_id", "depth", "n_convs", (F.col("longest") > F.col("depth")).cast("long").alias("n_children"), one.alias("n_leaves"),
        (one - one).alias("saved_tokens"),
        F.when(F.col("longest") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"))
    entries = (shared.where("depth = owns - 1 AND depth < size").select(F.col("conv_id").alias("child"), *_KEY)
               .join(several.select(F.col("conv_id").alias("parent"), *_KEY), _KEY)
               .select(F.col("child").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent"))
    return of_shared.unionByName(of_one).join(entries, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
