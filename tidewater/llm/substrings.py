"""Substring deduplication by level-wise doubling.

A window of ``window`` words is looked for at a quarter of its length first, then at half, then
whole. At a short length a window stands for itself by its minimizer, the least hash among the short
runs that it holds: equal windows have equal minimizers, so a window whose minimizer occurs in one
document alone can't occur in another, and only windows whose minimizer is repeated go on to twice
the length. No repeated window is lost; at the full length every surviving window is compared by a
128-bit hash of all its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tidewater.llm.kernels import BASE_A, BASE_B, binary, flat_rows, hash_words, is_in, pieces, signed, sliding_min, window_hashes
from tidewater.llm.scratch import Scratch, unused_name


def levels(window: int) -> list[int]:
    """Lengths from about a quarter of the window, each twice the one before."""
    found = [window]
    while len(found) < 3 and found[0] > 4:
        found.insert(0, -(-found[0] // 2))
    return found


def _minimizers(h: np.ndarray, length: int, window: int) -> np.ndarray:
    """For each window, the least hash of the runs of ``length`` words in it."""
    return sliding_min(window_hashes(h, length), window - length + 1)


def _survivors(h: np.ndarray, kept: list[np.ndarray], lengths: list[int], window: int) -> np.ndarray:
    """Which windows have a repeated minimizer at each of the lengths done."""
    alive = np.ones(len(h) - window + 1, bool)
    for length, found in zip(lengths, kept, strict=False):
        alive &= is_in(_minimizers(h, length, window), found)
    return alive


def _found(raw: bytes | None) -> np.ndarray:
    return np.sort(np.frombuffer(raw or b"", ">i8").astype(np.int64).view(np.uint64))


def _hex(*columns: str) -> F.Column:
    return F.concat(*[F.lpad(F.hex(c), 16, "0") for c in columns])


def _packed(column: F.Column) -> F.Column:
    """A list of hexadecimal values as one binary value; nulls are left out."""
    return F.unhex(F.concat_ws("", F.collect_list(column)))


def _shared(rows: DataFrame) -> DataFrame:
    """Hashes that stand in more than one document, with the least doc_id; they are gathered before the shuffle."""
    return rows.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")


def _whole(words: list[bytes]) -> bytes:
    """The name of a whole sequence of words; its last bit is set, which tells it from a short run's."""
    name = bytearray(xxh3_128_digest(b" ".join(words)))
    name[15] |= 1
    return bytes(name)


def _is_copy(words: list[bytes], copies: bytes | None) -> bool:
    return bool(copies) and any(copies[i : i + 16] == _whole(words) for i in range(0, len(copies), 16))


def _emit(docs: DataFrame, window: int, lengths: list[int], make: Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, h, g) of the surviving windows of each document.

    docs has doc_id, text and, after the first level, copies and the hashes kept at each level so far.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8_000_000):
            ids, texts = b.column(0).to_pylist(), binary(b.column(1))
            copies, *lists = [b.column(i).to_pylist() for i in range(2, b.num_columns)] or [[None] * b.num_rows]
            out_ids, parts = [], []
            for k, text in enumerate(texts):
                words = text.split()
                if len(words) < window or _is_copy(words, copies[k]):
                    continue
                h = hash_words(words)
                alive = _survivors(h, [_found(x[k]) for x in lists], lengths, window)
                if alive.any():
                    out_ids.append(ids[k])
                    parts.append(make(words, h, alive))
            if parts:
                doc_id, values = flat_rows(out_ids, parts)
                yield pa.RecordBatch.from_arrays([doc_id, pa.array(signed(values[:, 0])), pa.array(signed(values[:, 1]))], names=["doc_id", "h", "g"])

    return docs.mapInArrow(run, "doc_id long, h long, g long")


def _short(h: np.ndarray, alive: np.ndarray, length: int, window: int) -> np.ndarray:
    """The minimizers of the windows that are alive, once each, as pairs with 0."""
    least = np.unique(_minimizers(h, length, window)[alive])
    return np.stack([least, np.zeros_like(least)], axis=1)


def _first(words: list[bytes], h: np.ndarray, alive: np.ndarray, length: int, window: int) -> np.ndarray:
    """The minimizers, and the name of the whole text to tell copies."""
    return np.concatenate([_short(h, alive, length, window), np.frombuffer(_whole(words), ">u8").astype(np.uint64).reshape(1, 2)])


def _full(h: np.ndarray, alive: np.ndarray, window: int) -> np.ndarray:
    """Both halves of the 128-bit hash of the windows that are alive, each pair once."""
    both = np.stack([window_hashes(h, window, BASE_A)[alive], window_hashes(h, window, BASE_B)[alive]], axis=1)
    return np.unique(both, axis=0)


def repeated_windows(docs: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(doc_id, copies, found): names of whole texts, and hashes of windows, that also start in a document of smaller doc_id.

    A copy of a whole text needs no windows of its own: all of them start in the first such text too.
    """
    lengths = levels(window)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = scratch.write(_emit(source, window, [], lambda words, h, alive: _first(words, h, alive, lengths[0], window)), "level0")
    mine = (
        rows.join(_shared(rows), ["h", "g"])
        .groupBy("doc_id")
        .agg(
            _packed(F.when((F.col("g") != 0) & (F.col("least") < F.col("doc_id")), _hex("h", "g"))).alias("copies"),
            _packed(F.when(F.col("g") == 0, _hex("h"))).alias("kept0"),
        )
    )
    left, done = scratch.write(source.join(mine, "doc_id"), "candidates"), ["kept0"]
    scratch.drop("level0")
    copies = left.where("length(copies) > 0").select("doc_id", "copies", F.lit(None).cast("binary").alias("found"))
    for step, length in enumerate(lengths[1:-1], 1):
        rows = scratch.write(_emit(left, window, lengths[:step], lambda words, h, alive, n=length: _short(h, alive, n, window)), f"level{step}")
        mine = rows.join(_shared(rows), ["h", "g"], "left_semi").groupBy("doc_id").agg(_packed(_hex("h")).alias(f"kept{step}"))
        left = left.join(mine, "doc_id")
        done.append(f"kept{step}")
    rows = scratch.write(_emit(left.select("doc_id", "text", "copies", *done), window, lengths[:-1], lambda words, h, alive: _full(h, alive, window)), "windows")
    found = rows.join(_shared(rows), ["h", "g"]).where("least < doc_id").groupBy("doc_id").agg(_packed(_hex("h", "g")).alias("found"))
    copies = scratch.write(copies, "copies")
    for k in range(1, len(lengths) - 1):
        scratch.drop(f"level{k}")
    scratch.drop("candidates")
    return copies.unionByName(found.withColumn("copies", F.lit(None).cast("binary"))).groupBy("doc_id").agg(F.max("copies").alias("copies"), F.max("found").alias("found"))


def _covered(words: list[bytes], copies: bytes | None, found: bytes | None, window: int) -> np.ndarray:
    """Which words stand in a window that is found."""
    if _is_copy(words, copies):
        return np.ones(len(words), bool)
    if not found or len(words) < window:
        return np.zeros(len(words), bool)
    pairs = np.frombuffer(found, ">i8").astype(np.int64).view(np.uint64).reshape(-1, 2)
    h = hash_words(words)
    a, b = window_hashes(h, window, BASE_A), window_hashes(h, window, BASE_B)
    maybe = np.flatnonzero(is_in(a, np.sort(pairs[:, 0])))
    known = {(x, y) for x, y in pairs.tolist()}
    hits = [p for p, x, y in zip(maybe.tolist(), a[maybe].tolist(), b[maybe].tolist(), strict=True) if (x, y) in known]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, np.array(hits, np.int64), 1)
    np.add.at(step, np.array(hits, np.int64) + window, -1)
    return np.cumsum(step[:-1]) > 0


def kept_words(docs: DataFrame, window: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_text and kept_sha256, without the words of repeated windows.

    A window is ``window`` consecutive words of one document; a word goes if it stands in a window
    whose words also start in a document of smaller doc_id. Windows are judged on the input. A null
    text has no words and a null kept_text. Rows with a null doc_id keep all words and take none from
    others; rows of equal doc_id count as one document, so they take none from each other. A document
    that loses nothing keeps its text as it is; else the kept words are joined by one blank.
    kept_sha256 is of the kept words joined by one blank in either case. Every row of the input has
    one in the result; extra columns are ignored.
    """
    found = repeated_windows(docs, window, scratch or Scratch(docs.sparkSession, "substrings"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8_000_000):
            out: list[list] = [[], [], [], []]
            for text, copies, some in zip(binary(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                covered = _covered(words, copies, some, window)
                kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
                gone = int(covered.sum())
                for column, value in zip(out, (len(words), gone, kept if gone else text, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()).cast(pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return source.join(found, "doc_id", "left").select("doc_id", "text", "copies", "found").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = 50, scratch: Scratch | None = None) -> DataFrame:
    """The same rows and columns, with each text without the words that kept_words() removes."""
    of, copies, some = (unused_name(docs, c) for c in ("found_of", "found_copies", "found_windows"))
    found = repeated_windows(docs, window, scratch or Scratch(docs.sparkSession, "substrings")).toDF(of, copies, some)
    rows = docs.join(found, docs["doc_id"].cast("long") == F.col(of), "left").select(*[docs[c] for c in docs.columns], copies, some)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8_000_000):
            texts = binary(b.column(at))
            for k, (copies, some) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)):
                if (copies or some) and texts[k] is not None:
                    words = texts[k].split()
                    covered = _covered(words, copies, some, window)
                    if not covered.any():
                        continue
                    texts[k] = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])
            columns = list(b.columns[:-2])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names[:-2])

    return rows.mapInArrow(run, docs.schema)
