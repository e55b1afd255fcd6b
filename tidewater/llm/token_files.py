"""Token ids in files, and back: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in descending frequency over the whole corpus, so frequent ids take one
byte. Lengths stand apart from the values: a control byte holds those of four values, two bits each.
Decoding looks each control byte up in a table of four lengths and gathers all values of a shard with
array operations.

A shard holds documents in ascending order: a header of eight little-endian 64-bit numbers (magic,
partition, tokens of the partition before this shard, documents, tokens, bytes of control, bytes of
data, 0), then document ids and token counts (64 bits each), one byte per document that says whether its
id is null, control bytes and data bytes. Shards are named by partition and number, so their order by
name is that of the documents. The table of ids by rank is a file of its own.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.kernels import binary, pieces
from tidewater.llm.scratch import Scratch

MAGIC = 0x314E454B4F54
#: Tokens of a shard, about.
SHARD = 8_000_000
#: Tokens counted at once, about.
COUNTED = 500_000
#: A worker forgets its words beyond so many of them or of their characters, hands its tokenizer words of about so many
#: characters at a time, and cuts texts of more bytes than these; settings of speed that never change a result.
KEPT_WORDS, KEPT_CHARACTERS, GROUP, LONG = 1_200_000, 24_000_000, 10_000, 8_000_000
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.int64)
#: Letters that stay single letters in normal form and in lower case (so not U+0130), then ASCII marks.
_LETTERS = r"\A(?P<core>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17E}]+)(?P<marks>[!-/:-@\[-`{-~]*)\z"
_BLANK = re.compile(rb"[ \t-\r]")


# -- coding -------------------------------------------------------------------------------------------


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    more = codes[: len(v)]  # bytes of each value after the first
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        more += v > most
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.tobytes(), v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again, by looking control bytes up in the table of lengths."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = raw[start].astype("<u4") if count else np.empty(0, "<u4")
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= raw[start[more] + k].astype("<u4") << np.uint32(8 * k)
    return out


# -- words to ids -------------------------------------------------------------------------------------


def _stretches(text: bytes) -> Iterator[bytes]:
    """A text cut at blanks into parts of about ``LONG`` bytes."""
    at = 0
    while found := _BLANK.search(text, at + LONG):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Words(dict):
    """Ids of words by a tokenizer that never looks across blanks; a worker encodes each distinct word once.

    This holds for a tokenizer that splits at white space and drops it. A word of Latin letters is kept
    in lower case, and marks at its end stand alone, if the tokenizer folds case and splits words from
    marks (``folds``). Words of letters are encoded many at a time: each ends at its only id that the
    tokenizer keeps for ends of words. All others, and groups whose ends don't match, go one by one.
    """

    def __init__(self, path: str, folds: bool = True):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.folds = folds
        self.characters = 0
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # which ids end a word
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def _groups(self, words: Iterable[str]) -> Iterator[list[str]]:
        """Words in groups of few characters, as the tokenizer's answer takes many times their memory."""
        some, held = [], 0
        for word in words:
            some.append(word)
            held += len(word)
            if held >= GROUP:
                self.characters += held
                yield some
                some, held = [], 0
        if some:
            self.characters += held
            yield some

    def _alone(self, words: Iterable[str]) -> None:
        for some in self._groups(words):
            for word, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self[word] = pack_ids(e.ids)

    def _together(self, words: Iterable[str]) -> None:
        for some in self._groups(words):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
            if len(ends) != len(some):
                self._alone(some)
                continue
            raw, ends = ids.tobytes(), ends.tolist()
            self.update(zip(some, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def _ids(self, words: pa.Array, learn: Callable[[Iterable[str]], None]) -> np.ndarray:
        """Ids of each word, as an array of bytes objects."""
        distinct = words.dictionary_encode()
        if not len(distinct.dictionary):
            return np.empty(0, object)
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct.dictionary)], distinct.dictionary), pa.scalar(" ", words.type))[0].as_py().split(" ")
        learn(w for w in names if w not in self)
        return np.fromiter(map(self.__getitem__, names), object, len(names))[distinct.indices.to_numpy()]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of every text, as little-endian unsigned 32-bit integers."""
        if any(len(t) > LONG for t in texts):
            return [b"".join(ids for part in _stretches(t) for ids in self._encode([part])) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self) > KEPT_WORDS or self.characters > KEPT_CHARACTERS:
            self.clear()
            self.characters = 0
        runs = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        distinct = runs.values.dictionary_encode()
        words = distinct.dictionary
        if self.folds:
            parts = pc.extract_regex(words, _LETTERS)
            letters = parts.is_valid()
            ids, at = np.empty(len(words), object), letters.to_numpy(zero_copy_only=False)
            parts = parts.filter(letters)
            ids[at] = self._ids(pc.utf8_lower(pc.struct_field(parts, "core")), self._together) + self._ids(pc.struct_field(parts, "marks"), self._alone)
            ids[~at] = self._ids(words.filter(pc.invert(letters)), self._alone)
        else:
            ids = self._ids(words, self._alone)
        found, ends = ids[distinct.indices.to_numpy()].tolist(), runs.offsets.to_pylist()
        return [b"".join(found[a:z]) for a, z in pairwise(ends)]


def pack_ids(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" and array("I").itemsize == 4 else np.array(ids, "<u4").tobytes()


@lru_cache(2)
def words(path: str, folds: bool) -> Words:
    return Words(path, folds)


def encode(docs: DataFrame, path: str, end: int, folds: bool = True) -> DataFrame:
    """(doc_id, n_tokens, packed): ids of each text and the end id, compressed little-endian 32-bit integers.

    A null text counts as empty and has the end id only.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squeeze = words(path, folds), zstandard.ZstdCompressor(level=3).compress
        for b in pieces(batches, 8_000_000):
            ids = [x + last for x in table.encode(binary(b.column(1)))]
            # the halves of the ids apart: the upper ones are mostly zero
            halves = [np.frombuffer(x, "<u2").reshape(-1, 2).T.tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([squeeze(x) for x in halves], pa.binary())], names=["doc_id", "n_tokens", "packed"])

    return source.mapInArrow(run, "doc_id long, n_tokens long, packed binary")


def _ids(packed: bytes) -> np.ndarray:
    halves = np.frombuffer(zstandard.decompress(packed), "<u2").reshape(2, -1)
    return halves[0].astype("<u4") | halves[1].astype("<u4") << np.uint32(16)


def frequencies(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        parts: list[np.ndarray] = []

        def add() -> None:
            nonlocal total, parts
            n = np.bincount(np.concatenate(parts), minlength=len(total))
            n[: len(total)] += total
            total, parts = n, []

        held = 0
        for b in batches:
            for packed in b.column(0).to_pylist():
                parts.append(_ids(packed))
                held += len(parts[-1])
                if held >= COUNTED:
                    add()
                    held = 0
        if parts:
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return encoded.select("packed").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


# -- files --------------------------------------------------------------------------------------------


def _put(root: str, name: str, content: bytes) -> None:
    """Writes a file whole, whatever other attempts of the task have left."""
    fs, base = pyarrow.fs.FileSystem.from_uri(root)
    fs.create_dir(base, recursive=True)
    context = TaskContext.get()
    own = f"{base}/.{name}.{context.taskAttemptId() if context else 0}"
    with fs.open_output_stream(own) as f:
        f.write(content)
    fs.move(own, f"{base}/{name}")


def _shard(partition: int, before: int, ids: list[int | None], counts: list[int], ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    head = np.array([MAGIC, partition, before, len(ids), len(ranks), len(control), len(data), 0], "<i8")
    return b"".join([head.tobytes(), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(counts, "<i8").tobytes(), bytes(i is None for i in ids), control, data])


def write(encoded: DataFrame, root: str, vocabulary: int, shard: int = SHARD) -> dict[int, int]:
    """Writes shards and the table of ids by rank under a shared folder; returns each partition's tokens.

    Documents stand in ascending doc_id, those without one last, equal ones by a hash of their ids. The
    counts by id (one per entry of the vocabulary) and by partition are all that the driver sees.
    """
    counts = np.zeros(vocabulary, np.int64)
    for r in frequencies(encoded).collect():
        counts[r.id] = r.n
    by_rank = np.argsort(-counts, kind="stable").astype("<u4")
    rank = np.empty(vocabulary, "<u4")
    rank[by_rank] = np.arange(vocabulary, dtype="<u4")
    _put(f"{root}/ranks", "ids.bin", by_rank.tobytes())
    sent = encoded.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, number, before, held = TaskContext.get().partitionId(), 0, 0, 0
        ids: list = []
        parts: list[np.ndarray] = []

        def flush() -> None:
            nonlocal number, before, held, ids, parts
            _put(f"{root}/shards", f"part-{partition:07d}-{number:07d}.tok", _shard(partition, before, ids, [len(p) for p in parts], sent.value[np.concatenate(parts)]))
            number, before, held, ids, parts = number + 1, before + held, 0, [], []

        for b in batches:
            for doc, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(doc)
                parts.append(_ids(packed))
                held += len(parts[-1])
                if held >= shard:
                    flush()
        if ids:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([partition], pa.int64()), pa.array([before], pa.int64())], names=["partition", "tokens"])

    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("packed")]
    rows = encoded.select("doc_id", "packed").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "partition long, tokens long").collect()
    return {r.partition: r.tokens for r in rows}


def read(spark: SparkSession, root: str, totals: dict[int, int], use: Callable[[np.ndarray], object], kind: pa.DataType) -> DataFrame:
    """(doc_id, start, n_tokens, value) of every document in the shards; value is what ``use`` makes of its ids."""
    starts, total = {}, 0
    for p in sorted(totals):
        starts[p], total = total, total + totals[p]
    names = ["doc_id", "start", "n_tokens", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_rank = None
        for b in batches:
            for content in b.column(0).to_pylist():
                if by_rank is None:
                    fs, base = pyarrow.fs.FileSystem.from_uri(f"{root}/ranks")
                    with fs.open_input_stream(f"{base}/ids.bin") as f:
                        by_rank = np.frombuffer(f.read(), "<u4")
                magic, partition, before, docs, tokens, control, data, _ = np.frombuffer(content, "<i8", 8).tolist()
                if magic != MAGIC:
                    raise ValueError("not a token shard")
                ids, counts = np.frombuffer(content, "<i8", docs, 64), np.frombuffer(content, "<i8", docs, 64 + 8 * docs)
                null = np.frombuffer(content, np.uint8, docs, 64 + 16 * docs).astype(bool)
                at = 64 + 17 * docs
                found = by_rank[unpack(content[at : at + control], content[at + control : at + control + data], tokens)]
                ends = np.cumsum(counts)
                values = [use(found[a:z]) for a, z in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=null), pa.array(ends - counts + starts[partition] + before), pa.array(counts), pa.array(values, kind)], names=names)

    shards = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").schema("path string, modificationTime timestamp, length long, content binary").load(f"{root}/shards")
    made = {pa.int64(): "long", pa.binary(): "binary"}[kind]
    return shards.select("content").mapInArrow(run, f"doc_id long, start long, n_tokens long, value {made}")


def token_files(docs: DataFrame, path: str, end: int, vocabulary: int, scratch: Scratch | None = None) -> DataFrame:
    """Writes the corpus and reads it back: (doc_id, start, n_tokens, ids_crc32) per document.

    An empty table writes no shards and gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "tokens")
    encoded = scratch.write(encode(docs, path, end), "encoded")
    totals = write(encoded, scratch.path("files"), vocabulary)
    scratch.drop("encoded")
    if not sum(totals.values()):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, scratch.path("files"), totals, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64()).withColumnRenamed("value", "ids_crc32")
