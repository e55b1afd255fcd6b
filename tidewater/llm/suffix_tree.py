"""Language-model scoring by a probabilistic suffix tree.

States are contexts of up to DEPTH words, the last word last. A string of words is a candidate if it occurs
CONTEXT_LEAST times at least, so states grow with the corpus. A candidate stays if the distribution of its
next symbol diverges from that of its suffix: its count times the Kullback-Leibler divergence is at least
DIVERGENCE. A state keeps the next symbols that follow it PAIR_LEAST times at least; what is left of its
mass, and a Witten-Bell share, goes to the next shorter state, and at the root to the smoothed unigram
distribution. A token is scored in the longest state that is a suffix of the words before it.

``score`` grows and asks the tree in parts of the words (see ``suffix_parts``) and keeps no table of it. ``grow``
writes the same tree down by depth, and ``fit`` gives its head, strings of at least HEAD_SHARE of the training
tokens, at most 1 / HEAD_SHARE strings of a length. Bits of a fixed number keep strings out that are in no
table; they lose none. Words are known by 64-bit hashes, strings of the tables too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm import suffix_parts
from tidewater.llm.kernels import BASE_A, binary, hash_words, pieces, signed
from tidewater.llm.scratch import Scratch, freed

DEPTH = 3
#: Occurrences that a state and a next symbol need, whatever the corpus.
CONTEXT_LEAST, PAIR_LEAST = 4, 2
DIVERGENCE = 30.0
#: Strings of this share of the training tokens are the head.
HEAD_SHARE = 1e-6
#: Bits of the filter that strings pass before they are shuffled; its size is fixed.
FILTER_BITS, CHUNK_BITS = 26, 19
#: Bytes of text whose tokens a task holds at once.
BATCH = 3_000_000
#: The end of a text, told from every word by its use alone.
END = np.uint64(0x9D3779B185EBCA87)


@dataclass
class Model:
    """The head of the tree, of bounded size; symbols are numbers of frequent words, in the order of their hashes."""

    hashes: np.ndarray
    counts: np.ndarray
    total: int  # training tokens
    distinct: int
    keys: list[np.ndarray] = field(default_factory=list)  # by depth: of (state of the suffix, older symbol), sorted
    states: list[np.ndarray] = field(default_factory=list)  # the state of each key
    pairs: list[np.ndarray] = field(default_factory=list)  # by depth: of (state, next symbol), sorted
    share: list[np.ndarray] = field(default_factory=list)  # probability that each pair adds
    rest: list[np.ndarray] = field(default_factory=list)  # by state: the share of the next shorter state
    beyond: np.ndarray | None = None  # the filter of the strings beyond the head

    @property
    def width(self) -> int:
        return len(self.hashes) + 1


def batch_tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z in lower case, with an end after each text; and each text's length in tokens."""
    parts, size = [], []
    for t in texts:
        h = hash_words((t or b"").lower().split())
        parts.append(np.r_[h, END])
        size.append(len(parts[-1]))
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.array(size, np.int64)


def lookup(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(x), -1, np.int64)
    at = np.searchsorted(keys, x)
    at[at == len(keys)] = 0
    return np.where(keys[at] == x, at, -1)


def walk(model: Model, symbols: np.ndarray, end: int, depth: int) -> list[np.ndarray]:
    """For each depth, the state of that length before each token, or -1; no state reaches over an end."""
    n, found = len(symbols), []
    state = np.zeros(n, np.int64)  # the root
    older = symbols
    for d in range(depth):
        older = np.r_[np.int64(-1), older[:-1]]
        older = np.where(older == end, -1, older)
        ok = np.flatnonzero((state >= 0) & (older >= 0))
        at = lookup(model.keys[d], state[ok] * model.width + older[ok])
        state = np.full(n, -1, np.int64)
        state[ok] = np.where(at >= 0, model.states[d][at], -1)
        found.append(state)
        older = np.where(state >= 0, older, -1)
    return found


def _train(docs: DataFrame) -> DataFrame:
    return docs.where(~F.col("held_out")).select("text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n) of all training tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, BATCH):
            h, n = np.unique(batch_tokens(binary(b.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n)], names=["h", "n"])

    return _train(docs).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def strings(h: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2 to ``most``: places where such a string ends, its hash, and those without its last and first word.

    No word but the last is an end.
    """
    key, ok, inner = h, np.ones(len(h), bool), h != END
    for _ in range(most - 1):
        ok = np.r_[False, ok[:-1] & inner[:-1]][: len(h)]
        front = np.r_[np.uint64(0), key[:-1]][: len(h)]
        longer = front * np.uint64(BASE_A) + h
        at = np.flatnonzero(ok)
        yield at, longer[at], front[at], key[at]
        key = longer


def _passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    bit = key >> np.uint64(64 - FILTER_BITS)
    return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _filter(keys: DataFrame) -> np.ndarray:
    """One bit for each value of the first FILTER_BITS bits of the keys, gathered chunk by chunk: 8 MB whatever the corpus."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            bit = np.unique(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
            chunk = bit >> CHUNK_BITS
            for c in np.unique(chunk).tolist():
                at = bit[chunk == c] & (1 << CHUNK_BITS) - 1
                np.bitwise_or.at(held.setdefault(c, np.zeros(1 << CHUNK_BITS - 3, np.uint8)), at >> 3, (1 << (at & 7)).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros((1 << FILTER_BITS - CHUNK_BITS, 1 << CHUNK_BITS - 3), np.uint8)
    with freed(keys.sparkSession):
        keys = keys.toDF("key").repartition(F.shiftrightunsigned("key", 64 - FILTER_BITS + CHUNK_BITS))
        for r in keys.mapInArrow(pack, "chunk long, bits binary").collect():
            out[r.chunk] |= np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def _pair_counts(docs: DataFrame, sent: Broadcast, depth: int) -> DataFrame:
    """(suffix, context, n) of the strings of depth + 1 words that occur PAIR_LEAST times at least; the two tell a string.

    ``sent`` has the filters of contexts and of suffixes, of depth words; strings that do not pass are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, BATCH):
            h, _ = batch_tokens(binary(b.column(0)))
            for _, key, context, suffix in strings(h, depth + 1):
                pass  # the last is of the length asked for
            ok = np.flatnonzero(_passes(sent.value[0], context))
            ok = ok[_passes(sent.value[1], suffix[ok])]
            key, first, n = np.unique(key[ok], return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(suffix[ok[first]])), pa.array(signed(context[ok[first]])), pa.array(n)], names=["suffix", "context", "n"])

    rows = _train(docs).mapInArrow(run, "suffix long, context long, n long")
    return rows.groupBy("suffix", "context").agg(F.sum("n").alias("n")).where(F.col("n") >= PAIR_LEAST)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the hash of each whole string in the place of what its context has after its first word (the first column)."""
    for b in batches:
        short, context, suffix = (b.column(i).to_numpy().view(np.uint64) for i in range(3))
        key = context * np.uint64(BASE_A) + (suffix - short * np.uint64(BASE_A))
        yield pa.RecordBatch.from_arrays([pa.array(signed(key)), *b.columns[1:]], names=["key", *b.schema.names[1:]])


def _totals(counts: DataFrame) -> tuple[int, int]:
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return int(total), int(distinct)


def _head_least(total: int) -> int:
    return max(2, int(np.ceil(HEAD_SHARE * total)))


def grow(docs: DataFrame, counts: DataFrame, scratch: Scratch) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """The whole tree by depth, as written tables, from the training rows of docs (text, held_out).

    Of candidates' next symbols: those of the head (key, context, suffix, n and share, null where the context does not
    stay) and, where it stays, the others (key and adds, to the logarithm beyond what the context leaves to its suffix).
    Of states: key, n, rest. A string without its first word occurs as often at least, and so does its context, so what
    the suffix says of a next symbol is a row of the depth before, which goes when nothing reads it.
    """
    total, distinct = _totals(counts)
    if not total:
        return []
    frequent = F.col("n") >= _head_least(total)
    above = counts.where(F.col("n") >= PAIR_LEAST).select(F.col("h").alias("key"), F.lit(0).cast("long").alias("suffix"), "n", F.log((F.col("n") + 1) / F.lit(float(total + distinct + 1))).alias("log_p"))
    found = []
    for depth in range(1, DEPTH + 1):
        visits = above.where(F.col("n") >= CONTEXT_LEAST).select(F.col("key").alias("context"), F.col("suffix").alias("short"), F.col("n").alias("visits"))
        expected = above.select(F.col("key").alias("suffix"), F.col("log_p").alias("log_e"))
        sent = docs.sparkSession.sparkContext.broadcast((_filter(visits.select("context")), _filter(expected.select("suffix"))))
        # each step is written, so its shuffle files go before the next one's come
        pairs = scratch.write(_pair_counts(docs, sent, depth), f"counted{depth}")
        sent.destroy()
        pairs = scratch.write(pairs.join(expected, "suffix"), f"expected{depth}")
        scratch.drop(f"counted{depth}")
        pairs = pairs.join(visits, "context").select("short", "context", "suffix", "n", "visits", "log_e").mapInArrow(_keyed, "key long, context long, suffix long, n long, visits long, log_e double")
        pairs = scratch.write(pairs, f"pairs{depth}")
        scratch.drop(f"expected{depth}")
        if depth > 1:
            scratch.drop(f"next{depth - 1}")
        of = pairs.groupBy("context").agg(
            F.max("visits").alias("n"),
            F.sum("n").alias("kept"),
            F.count("*").alias("followers"),
            F.sum(F.exp("log_e")).alias("e"),
            F.sum(F.col("n") * (F.log(F.col("n") / F.col("visits")) - F.col("log_e"))).alias("gain"),
        )
        left = F.col("n") - F.col("kept")
        gain = F.col("gain") + F.when(left > 0, left * F.log(left / F.col("n") / F.least(F.greatest(1 - F.col("e"), F.lit(1e-12)), F.lit(1.0)))).otherwise(0.0)
        bottom = F.col("n") + F.col("followers")
        states = of.where(gain >= DIVERGENCE).select(F.col("context").alias("key"), "n", ((left + F.col("followers")) / bottom).alias("rest"), bottom.alias("bottom"))
        states = scratch.write(states, f"states{depth}")
        rows = pairs.join(states.select(F.col("key").alias("context"), "rest", "bottom"), "context", "left").withColumn("share", F.col("n") / F.col("bottom"))
        log_p = F.when(F.col("share").isNull(), F.col("log_e")).otherwise(F.log(F.col("share") + F.col("rest") * F.exp("log_e")))
        adds = F.when(~frequent, log_p - F.col("log_e") - F.log("rest"))
        only = lambda name: F.when(frequent, F.col(name)).alias(name)
        rows = scratch.write(rows.select("key", only("context"), "suffix", "n", only("share"), log_p.alias("log_p"), adds.alias("adds")), f"next{depth}")
        scratch.drop(f"pairs{depth}")
        known = scratch.write(rows.where(frequent).select("key", "context", "suffix", "n", "share"), f"head{depth}")
        rest = scratch.write(rows.where(F.col("adds").isNotNull()).select("key", "adds"), f"adds{depth}")
        above = rows.select("key", "suffix", "n", "log_p")
        found.append((known, rest, states))
    scratch.drop(f"next{DEPTH}")
    return found


def head(counts: DataFrame, tree: list[tuple[DataFrame, DataFrame, DataFrame]]) -> Model:
    """What is sent to tasks of a tree."""
    total, distinct = _totals(counts)
    least = _head_least(total)
    rows = counts.where((F.col("n") >= least) | (F.col("h") == int(signed(np.array([END]))[0]))).toArrow()
    h, n = rows.column("h").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(h)
    model = Model(h[order], n[order], total, distinct)
    column = lambda t, name: t.column(name).to_numpy().view(np.uint64)
    # strings of a depth's length that can be states, with the state of their suffix and their first word
    key = model.hashes[(model.counts >= max(least, CONTEXT_LEAST)) & (model.hashes != END)]
    suffix, first = np.zeros(len(key), np.int64), key
    for depth, (pairs, _, states) in enumerate(tree, 1):
        code = suffix * model.width + lookup(model.hashes, first)
        order = np.argsort(code)
        model.keys.append(code[order])
        by_key = np.argsort(key)
        number = np.empty(len(key), np.int64)  # states are numbered by their codes
        number[order] = np.arange(len(key))
        model.states.append(np.arange(len(key)))
        place = lambda x: (lambda at: np.where(at >= 0, number[by_key[at]], -1))(lookup(key[by_key], x)) if len(key) else np.full(len(x), -1, np.int64)  # noqa: B023, E731
        t = states.where(F.col("n") >= least).select("key", "rest").toArrow()
        rest = np.ones(len(key))
        rest[place(column(t, "key"))] = t.column("rest").to_numpy()
        model.rest.append(rest)
        t = pairs.toArrow()
        whole, context, short = (column(t, c) for c in ("key", "context", "suffix"))
        last = whole - context * np.uint64(BASE_A)
        share = t.column("share").to_numpy()
        at = place(context) * model.width + lookup(model.hashes, last)
        use = np.flatnonzero(~np.isnan(share))
        use = use[np.argsort(at[use])]
        model.pairs.append(at[use])
        model.share.append(share[use])
        inner = (last != END) & (t.column("n").to_numpy() >= CONTEXT_LEAST)
        key, suffix = whole[inner], place(short[inner])
        first = (whole - short)[inner] * np.uint64(pow(BASE_A, -depth, 1 << 64))
    return model


def fit(docs: DataFrame, counts: DataFrame) -> Model:
    """The head of the tree of docs (text, held_out), from their word counts."""
    scratch = Scratch(docs.sparkSession, "suffix_tree", free=True)
    return head(counts, grow(docs, counts, scratch))


def _local(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """By text: tokens, those the head knows, base and model log10 probability by the head; and the strings to ask for, with their texts."""
    h, size = batch_tokens(texts)
    symbols = lookup(model.hashes, h)
    end = int(lookup(model.hashes, np.array([END]))[0]) if len(model.hashes) else -2
    ends = np.cumsum(size) - 1
    frequent = symbols >= 0
    bottom = model.total + model.distinct + 1
    p0 = np.where(frequent, model.counts[symbols] + 1 if len(model.counts) else 1, 1) / bottom
    base = np.log10(p0)
    p = p0.copy()
    for d, state in enumerate(walk(model, symbols, end, len(model.keys))):
        at = np.flatnonzero(state >= 0)
        s = state[at]
        hit = lookup(model.pairs[d], s * model.width + symbols[at])
        hit[symbols[at] < 0] = -1
        share = np.zeros(len(at))
        share[hit >= 0] = model.share[d][hit[hit >= 0]]
        p[at] = share + model.rest[d][s] * p[at]
    starts = ends - size + 1
    by = lambda x: np.add.reduceat(x, starts) if len(x) else np.empty(0)
    asked, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    if model.beyond is not None:
        rare = np.flatnonzero(~frequent)
        for at, key in [(rare, h[rare]), *((at, key) for at, key, _, _ in strings(h, len(model.keys) + 1))]:
            ok = np.flatnonzero(_passes(model.beyond, key))
            asked.append(key[ok])
            places.append(at[ok])
    doc = np.searchsorted(ends, np.concatenate(places))
    return size, by(frequent.astype(np.int64)), by(base), by(np.log10(p)), np.concatenate(asked), doc


def score(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Scores of docs (doc_id, text, held_out); rows with held_out false are learned from.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row. A
    null or blank text is its end alone. Without training rows every token has probability 1 under
    both. Rows of equal doc_id are scored each; a null held_out counts as false. Extra columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "suffix_tree", free=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce("held_out", F.lit(False)).alias("held_out"))
    return suffix_parts.scores(docs, scratch, END, DEPTH, (CONTEXT_LEAST, PAIR_LEAST), DIVERGENCE)
