"""Benchmark decontamination by spaced-seed hashing.

A mask names the token positions of a short span that count; the others may differ. Hashes of every
span of every benchmark item meet the hashes of every span of the documents; each hit gives a diagonal
on which item and document are compared token by token, and substitutions are tolerated up to a share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import hash_words, mix, pieces, signed
from tidewater.llm.scratch import Scratch, unused_name

#: Positions that count are 1. Whichever tokens differ within SHARE of a stretch or a shorter item, one mask finds its own equal.
MASKS = ("111000111", "110101011", "101101101", "111111", "1111011", "1101111", "11101101")
#: Items of fewer tokens can't be told from chance and match nothing.
LEAST_TOKENS = 9
#: A stretch of so many tokens (or the whole item) must agree in at least this share.
STRETCH, SHARE = 20, 0.8
#: Bits of the filter that documents' hashes pass before they are shuffled; its size is fixed.
FILTER_BITS, CHUNK_BITS = 24, 15
_STRIP = ".,;:!?\"'()[]{}<>*#%$&|-_"


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the lower-case words without punctuation at their ends."""
    return hash_words([w.strip(_STRIP).encode() for w in (text or "").lower().split()])


def seeds(h: np.ndarray) -> list[np.ndarray]:
    """For each mask, the hash of each span."""
    out = []
    for k, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        total = np.full(max(n, 0), k + 1, np.uint64)
        for i, c in enumerate(mask):
            if c == "1" and n > 0:
                total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        out.append(mix(total))
    return out


def _rows(ids: list[int], texts: list[str | None], keep: np.ndarray | None) -> pa.RecordBatch:
    """(id, position, seed) of all spans, or of those whose bit is set in the filter."""
    doc, place, seed = [], [], []
    for i, text in zip(ids, texts, strict=True):
        h = tokens(text)
        if keep is None and len(h) < LEAST_TOKENS:
            continue
        for s in seeds(h):
            at = np.arange(len(s))
            if keep is not None:
                bit = s >> np.uint64(64 - FILTER_BITS)
                at = np.flatnonzero(keep[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            if len(at):
                doc.append(np.full(len(at), i))
                place.append(at)
                seed.append(s[at])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return pa.RecordBatch.from_arrays([pa.array(join(doc, np.int64)), pa.array(join(place, np.int64).astype(np.int64)), pa.array(signed(join(seed, np.uint64)))], names=["id", "position", "seed"])


def _spans(table: DataFrame, keep: np.ndarray | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8_000_000):
            yield _rows(b.column(0).to_pylist(), b.column(1).to_pylist(), keep)

    return table.mapInArrow(run, "id long, position long, seed long")


def _filter(items: DataFrame) -> np.ndarray:
    """One bit for each value of the seeds' first FILTER_BITS bits, gathered chunk by chunk: 2 MB whatever the benchmark's size."""
    rest = FILTER_BITS - CHUNK_BITS
    bit = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bits = items.select(F.shiftright(bit, CHUNK_BITS).alias("chunk"), F.shiftright(bit, 3).alias("byte"), F.expr(f"shiftleft(1, CAST(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 7 AS INT))").alias("value"))
    rows = bits.groupBy("chunk", "byte").agg(F.bit_or("value").alias("value"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            chunk, byte, value = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for c in np.unique(chunk).tolist():
                mine = chunk == c
                held.setdefault(c, np.zeros(1 << CHUNK_BITS - 3, np.uint8))[byte[mine] & (1 << CHUNK_BITS - 3) - 1] = value[mine]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["chunk", "bits"])

    out = np.zeros((1 << rest, 1 << CHUNK_BITS - 3), np.uint8)
    for r in rows.repartition("chunk").mapInArrow(pack, "chunk long, bits binary").collect():
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start in doc, compared, equal) of the best stretch on a diagonal, or None if it agrees too little.

    Tokens of the item beyond the document's edges differ; they do not count as compared.
    """
    a, b = max(0, diagonal), min(len(doc), diagonal + len(item))
    if b <= a:
        return None
    stretch = min(STRETCH, len(item))
    equal = np.zeros(len(item), bool)
    equal[a - diagonal : b - diagonal] = doc[a:b] == item[a - diagonal : b - diagonal]
    total = np.r_[0, np.cumsum(equal)]
    windows = total[stretch:] - total[:-stretch]
    if windows.max() < SHARE * stretch:
        return None
    good = np.flatnonzero(windows >= SHARE * stretch)
    first, last = max(int(good[0]), a - diagonal), min(int(good[-1]) + stretch, b - diagonal)
    return first + diagonal, last - first, int(total[last] - total[first])


def leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Pairs (doc_id, item_id) with start, n_compared, n_equal: the document holds a passage of the item.

    At least SHARE of the tokens of a stretch of STRETCH tokens, or of a shorter item, agree in place; tokens that
    a document's edge cuts off differ. A pair has one row, of its longest overlap, then the earliest. Null texts and ids and items of fewer
    than LEAST_TOKENS tokens match nothing; rows of equal id are tried each. Empty tables give no rows;
    extra columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "leaks")
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text")).where("id IS NOT NULL AND text IS NOT NULL")
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text")).where("id IS NOT NULL AND text IS NOT NULL")
    item_spans = scratch.write(_spans(items, None), "items")
    keep = docs.sparkSession.sparkContext.broadcast(_filter(item_spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8_000_000):
            yield _rows(b.column(0).to_pylist(), b.column(1).to_pylist(), keep.value)

    hits = source.mapInArrow(run, "id long, position long, seed long").select(F.col("id").alias("doc"), F.col("position").alias("at"), "seed")
    diagonals = hits.join(item_spans, "seed").select("doc", F.col("id").alias("item"), (F.col("at") - F.col("position")).alias("diagonal")).distinct()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([tokens(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["item", "item_tokens"])

    diagonals = scratch.write(diagonals.join(items.mapInArrow(hashed, "item long, item_tokens binary"), "item").select("doc", "item", "diagonal", "item_tokens"), "diagonals")
    held = source.join(diagonals.select(F.col("doc").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("doc"), "text")
    # each document's text comes once, before its diagonals
    rows = held.select("doc", F.lit(0).alias("kind"), "text", F.lit(None).cast("long").alias("item"), F.lit(None).cast("long").alias("diagonal"), F.lit(None).cast("binary").alias("item_tokens"))
    rows = rows.union(diagonals.select("doc", F.lit(1), F.lit(None).cast("string"), "item", "diagonal", "item_tokens"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, texts = None, []
        for b in pieces(batches, 8_000_000):
            out = []
            for doc, kind, text, item, diagonal, item_tokens in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if doc != at:
                    at, texts = doc, []
                if kind == 0:
                    texts.append(tokens(text))
                    continue
                for h in texts:
                    if found := overlap(h, np.frombuffer(item_tokens, np.uint64), diagonal):
                        out.append((doc, item, *found))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "start", "n_compared", "n_equal"])

    found = rows.repartition("doc").sortWithinPartitions("doc", "kind").mapInArrow(verify, "doc_id long, item_id long, start long, n_compared long, n_equal long")
    best = F.max(F.struct(F.col("n_compared"), F.col("n_equal"), (-F.col("start")).alias("back"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.n_compared", "best.n_equal")


def without_leaks(docs: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The rows whose text holds no passage of the benchmark, all columns as they are; rows without a doc_id stay."""
    name = unused_name(docs, "gone")
    gone = leaks(docs, benchmark, scratch).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
