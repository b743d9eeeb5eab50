"""Secret scan with a trigram index: Boolean trigram queries come from the regexes themselves.

Documents are indexed where they are read, in shards of about a megabyte: for each trigram of the shard's texts a list
of the documents that hold it. A rule's query is an AND of ORs of ANDs over trigrams its matches must contain; posting
lists are intersected and united, and only the remaining documents are searched with the regex. A rule without mandatory
trigrams searches every document. Shards share nothing, so nothing is shuffled and a lost shard is simply read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import flat_bytes, text_slices


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``least`` characters of ``group`` are needed; shorter matches are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The base rules, in their order.
BASE = (
    Rule("assign", "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
         + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]+", 0, 16),
)
#: Further kinds of secrets.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]{30,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~%!$&*+-]+@"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}"),
)
_MOST_STRINGS = 64


def _fold(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _strings(node) -> set[str] | None:
    """All strings a regex node can match, folded, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {_fold(chr(arg))}
    if op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in arg):
        found = {_fold(chr(x)) for o, a in arg for x in ([a] if o is C.LITERAL else range(a[0], a[1] + 1))}
        return found if len(found) <= 4 else None
    if op is C.SUBPATTERN and not arg[1] and not arg[2]:
        return _sequence_strings(arg[3])
    if op is C.BRANCH:
        parts = [_sequence_strings(p) for p in arg[1]]
        return set().union(*parts) if None not in parts else None
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 8:
        inner = _sequence_strings(arg[2])
        if inner is not None and sum(len(inner) ** n for n in range(arg[0], arg[1] + 1)) <= _MOST_STRINGS:
            return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, repeat=n)}
    return None


def _sequence_strings(nodes) -> set[str] | None:
    total = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(total) * len(part) > _MOST_STRINGS:
            return None
        total = {a + b for a in total for b in part}
    return total


def _clauses(nodes) -> list[frozenset[frozenset[str]]]:
    """AND of clauses; a clause is an OR of strings, each an AND of its trigrams."""
    out, run = [], {""}

    def close(strings: set[str]) -> None:
        grams = [frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings]
        if all(grams):  # an option that asks for more than another one adds nothing
            out.append(frozenset(g for g in grams if not any(less < g for less in grams)))

    for node in nodes:
        part = _strings(node)
        if part is not None and len(run) * len(part) <= _MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        close(run)
        run = {""} if part is None else part
        op, arg = node
        if op is C.SUBPATTERN and part is None:
            out += _clauses(arg[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and part is None and arg[0] >= 1:
            out += _clauses(arg[2])
    close(run)
    return out


def trigram_query(pattern: str) -> list[list[list[int]]]:
    """Folded trigrams that every match of ``pattern`` must contain: AND of ORs of ANDs. Empty: none are mandatory.

    Trigrams are of UTF-8 bytes with A-Z lower-cased, as numbers below 2**24.
    """
    if re.compile(pattern).flags & re.IGNORECASE:
        raise ValueError("spell out both cases; folding by flag also matches letters outside ASCII")
    code = lambda s: [int.from_bytes(b[i:i + 3], "big") for b in [s.encode()] for i in range(len(b) - 2)]
    return [sorted(sorted({c for gram in option for c in code(gram)}) for option in clause)
            for clause in dict.fromkeys(_clauses(_parser.parse(pattern)))]


class Shard:
    """Trigram to ascending document numbers, for the trigrams of a vocabulary."""

    def __init__(self, column: pa.Array, vocabulary: np.ndarray):
        data, offsets = flat_bytes(column)
        low = data.astype(np.int64)
        low[(data >= 65) & (data <= 90)] += 32
        gram = (low[:-2] << 16 | low[1:-1] << 8 | low[2:]) if len(low) > 2 else np.zeros(0, np.int64)
        wanted = np.zeros(1 << 24, bool)
        wanted[vocabulary] = True
        at = np.flatnonzero(wanted[gram])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 2 < offsets[row + 1]
        posting = np.unique(gram[at[inside]] * len(column) + row[inside])
        term = posting // max(1, len(column))
        self.rows = len(column)
        self.docs = posting % max(1, len(column))
        self.span = {int(t): (lo, hi) for t, lo, hi in zip(
            vocabulary, np.searchsorted(term, vocabulary), np.searchsorted(term, vocabulary, side="right"))}

    def postings(self, term: int) -> np.ndarray:
        lo, hi = self.span[term]
        return self.docs[lo:hi]

    def find(self, query: list[list[list[int]]]) -> np.ndarray:
        """Documents that satisfy a query, from its shortest posting lists on; all of them for an empty query."""
        left = None
        for clause in query:
            hits = np.zeros(0, np.int64)
            for option in clause:
                lists = sorted((self.postings(t) for t in option), key=len)
                both = lists[0]
                for more in lists[1:]:
                    if not len(both):
                        break
                    both = np.intersect1d(both, more, assume_unique=True)
                hits = np.union1d(hits, both)
            left = hits if left is None else np.intersect1d(left, hits, assume_unique=True)
        return np.arange(self.rows) if left is None else left


def _scanner(rules: tuple[Rule, ...]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        regexes = [re.compile(r.pattern) for r in rules]
        queries = [trigram_query(r.pattern) for r in rules]
        vocabulary = np.unique(np.array([t for q in queries for c in q for o in c for t in o], np.int64))
        for batch in text_slices(batches, max_bytes=1 << 20):
            texts = batch.column("text").to_pylist()
            found = [[] for _ in texts]
            shard = Shard(batch.column("text"), vocabulary)
            for nr, (rule, regex, query) in enumerate(zip(rules, regexes, queries)):
                for row in shard.find(query).tolist():
                    for m in regex.finditer(texts[row] or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            found[row].append((m.start(), nr, m.end()))
            spans = [[{"kind": rules[nr].kind, "start": lo, "end": hi} for lo, nr, hi in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)],
                                             names=["doc_id", "spans"])

    return scan


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(doc_id, spans: array of (kind, start, end)), one row per input row; code points, end exclusive.

    Matches of a rule are the leftmost, non-overlapping ones; spans are ordered by start, then by the order of the
    rules. Null and empty texts have no spans. Other columns are ignored, repeated rows stay repeated.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scanner(rules), "doc_id long, spans array<struct<kind string, start bigint, end bigint>>")


def digest_spans(found: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts and digests of ``find_secrets``: (doc_id, n_<base kind>..., base_sha256, spans)."""
    kinds = [r.kind for r in base]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in kinds],
                        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(kinds))), 256).alias("base_sha256"),
                        text(F.col("spans")).alias("spans"))
