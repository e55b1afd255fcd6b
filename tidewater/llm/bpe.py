"""Byte-level BPE encoding and decoding by merge replay over a corpus of distinct pieces.

All distinct pieces of a batch stand in one symbol array. An inverted index leads from each
pair (by the rank of its merge) to the positions where it occurs. Merges are taken from a heap in
rank order; each is applied at all its positions at once and only the pairs that touch a merged
symbol are looked up again. A merge that could create a pair of lower rank than its own is applied
to the first position of each piece only and then queued again, so the result equals merging each
piece alone, lowest rank first and leftmost first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import pieces

#: Chunks of text that the pattern never looks across: a word with the one blank before it, or blanks.
_CHUNK = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Characters that Python's ``\s`` and the Unicode property White_Space class differently.
_ODD = re.compile("[\x1c-\x1f]")
#: A worker forgets its pieces beyond this many; a speed setting that never changes a result.
KEPT = 900_000


class Ranks:
    """A vocabulary of byte strings by rank, as arrays."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            self.token[r] = token
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        keys, ranks = [], []
        for token, r in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.pair, self.merged = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        early = np.zeros(len(self.token), bool)  # a pair with this token may merge into a lower rank
        for side in (self.pair >> 32, self.pair & 0xFFFFFFFF):
            early[side[self.merged < side]] = True
        self.early = early
        self.known: dict[str, bytes] = {}

    def merge_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.pair, key)
        at[at == len(self.pair)] = 0
        return np.where(self.pair[at] == key, self.merged[at], -1)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        word = np.repeat(np.arange(len(words)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(size)[size > 0]
        after[ends - 1] = -1
        before[(ends - size[size > 0])] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, -1, np.int64)  # of the pair that starts here
        has = np.flatnonzero(after >= 0)
        rank[has] = self.merge_rank(sym[has], sym[has + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(at: np.ndarray) -> None:
            r = rank[at]
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            starts = [0, *cut.tolist(), len(r)]
            for k, key in enumerate(r[starts[:-1]].tolist()):
                if key not in index:
                    index[key] = []
                    heapq.heappush(heap, key)
                index[key].append(at[starts[k] : starts[k + 1]])

        add(has)
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            if self.early[r]:
                first = np.r_[True, word[at[1:]] != word[at[:-1]]]
                if not first.all():
                    index[r] = [at[~first]]
                    heapq.heappush(heap, r)
                at = at[first]
            elif len(at) > 1:  # of overlapping positions, every second from the left
                follows = np.r_[False, before[at[1:]] == at[:-1]]
                if follows.any():
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
            gone = after[at]
            nxt = after[gone]
            alive[gone] = False
            sym[at] = r
            after[at] = nxt
            before[nxt[nxt >= 0]] = at[nxt >= 0]
            rank[at] = -1
            touched = np.concatenate([at[nxt >= 0], before[at][before[at] >= 0]])
            if len(touched) > 1:
                touched = np.unique(touched)
            if len(touched):
                rank[touched] = self.merge_rank(sym[touched], sym[after[touched]])
                add(touched)
        ids = sym[alive].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word[alive], minlength=len(words))) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text) if _ODD.search(text) else _CHUNK.findall(text)

    def learn(self, chunks: set[str]) -> None:
        """Adds the ids of chunks not yet known."""
        new = [c for c in chunks if c not in self.known]
        parts = [[p.encode() for p in self.pattern.findall(c)] for c in new]
        found: dict[bytes, bytes] = {}
        for p in {p for some in parts for p in some}:
            r = self.rank.get(p)
            found[p] = b"" if r is None else r.to_bytes(4, "little")
        todo = [p for p, ids in found.items() if not ids]
        found.update(zip(todo, self.replay(todo), strict=True))
        self.known.update((c, b"".join([found[p] for p in some])) for c, some in zip(new, parts, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT:
            self.known.clear()
        number: dict[str, int] = _Numbers()
        docs = []
        for text in texts:
            some = self.split(text)
            docs.append(np.fromiter(map(number.__getitem__, some), np.int32, len(some)))
        self.learn(set(number))
        ids = [self.known[c] for c in number]
        return [b"".join([ids[k] for k in doc.tolist()]) for doc in docs]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = len(self)
        return self[key]


@lru_cache(2)
def ranks(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of docs but text, and ``token_ids`` (binary, unsigned 32-bit little-endian) for it.

    A null text has no ids. A column named token_ids is replaced.
    """
    keep = [c for c in docs.columns if c not in ("text", "token_ids")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("text", F.lit("")).alias("token_ids"))
    schema = source.schema
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields[:-1]] + ["token_ids binary"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for b in pieces(batches):
            ids = pa.array(table.encode(b.column(b.num_columns - 1).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=b.schema.names)

    return source.mapInArrow(run, ", ".join(out))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 of its ids and the bytes they decode to.

    A null or empty text has no tokens and the digests of nothing. Rows with equal or null doc_id
    each get a row. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks(path, pattern)
        for b in pieces(batches):
            ids = table.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(table.decode(x)).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
