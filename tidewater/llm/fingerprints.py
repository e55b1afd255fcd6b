"""Document fingerprints by consistent weighted sampling.

Each word of a text weighs as often as it occurs. For every sample k a term draws r and c from
Gamma(2, 1) and beta from U(0, 1), all from a hash of term and k; with t = floor(ln w / r + beta)
and ln y = r (t - beta) the term's key is ln a = ln c - ln y - r, and the term of least key is the
sample, named by (term, t). Two texts agree in a sample with the probability of their generalised
Jaccard similarity, sum of min weights over sum of max weights.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import hash_words, pieces

SAMPLES = 128
_STEP = 16  # samples computed at once
_ROWS, _TERMS = 8_000, 4_000  # gathered and computed at once, to stay in a core's cache
_SEED = 0xD1B54A32D192ED03


def _uniforms(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Three float32 in (0, 1) from each 64-bit key."""
    x = key * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(29)
    scale, half, low = np.float32(2.0**-21), np.float32(2.0**-22), np.uint64(0x1FFFFF)
    out = []
    for shift in (43, 22, 1):
        u = ((x >> np.uint64(shift)) & low).astype(np.uint32).astype(np.float32)
        u *= scale
        u += half
        out.append(u)
    return out[0], out[1], out[2]


def _keys(term: np.ndarray, log_w: np.ndarray, first: int, last: int) -> np.ndarray:
    """For each term and sample: the key's order in the high half, the sample's name in the low half."""
    seed = (np.arange(first, last, dtype=np.uint64) * np.uint64(3) + np.uint64(1)) * np.uint64(_SEED)
    key = term[:, None] ^ seed[None, :]
    u1, u2, beta = _uniforms(key)
    u3, u4, _ = _uniforms(key + np.uint64(_SEED >> 7))
    u1 *= u2
    r = np.log(u1, out=u1)
    np.negative(r, out=r)
    t = np.floor(log_w[:, None] / r + beta)
    u3 *= u4
    log_a = np.log(-np.log(u3, out=u3))
    log_a -= r * (t - beta + np.float32(1))
    bits = log_a.view(np.uint32)
    order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
    order <<= np.uint64(32)
    key += t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    key *= np.uint64(0xFF51AFD7ED558CCD)
    key >>= np.uint64(32)
    order |= key
    return order


def signatures(texts: list[bytes], samples: int = SAMPLES) -> np.ndarray:
    """A row of ``samples`` 16-bit names for each text; texts without words get a row of zeros."""
    out = np.zeros((len(texts), samples), np.uint16)
    parts = [np.unique(hash_words(text.split()), return_counts=True) for text in texts]
    size = np.array([len(p[0]) for p in parts], np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return out
    term, count = np.concatenate([parts[i][0] for i in full]), np.concatenate([parts[i][1] for i in full])
    del parts
    pair = term ^ (count.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    _, one, place = np.unique(pair, return_index=True, return_inverse=True)
    term, log_w = term[one], np.log(count[one].astype(np.float32))
    starts = np.r_[0, np.cumsum(size[full])]
    cuts = [0]
    while cuts[-1] < len(full):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(starts, starts[cuts[-1]] + _ROWS, "right")) - 1))
    for k in range(0, samples, _STEP):
        last = min(k + _STEP, samples)
        keys = np.empty((len(term), last - k), np.uint64)
        for a in range(0, len(term), _TERMS):
            keys[a : a + _TERMS] = _keys(term[a : a + _TERMS], log_w[a : a + _TERMS], k, last)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            least = np.minimum.reduceat(keys[place[starts[a] : starts[b]]], starts[a:b] - starts[a], axis=0)
            out[full[a:b], k:last] = (least & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    """Share of equal samples; a text without words is like another without words only."""
    return float(a_empty and b_empty) if a_empty or b_empty else float(np.mean(a == b))


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """The rows in ranges of descending doc_id; each range also gets the first row of the next as a guard.

    The first rows' ids, one per range, are all that the driver sees.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("x")).where("x IS NOT NULL")
    cuts = sorted(set(ids.approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)))
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]  # two buckets at least
    dealer = Bucketizer(splits=splits, inputCol="x", outputCol="bucket", handleInvalid="keep")
    rows = dealer.transform(docs.withColumn("x", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("nan")))))
    # ranges count from the largest ids on; rows without an id stand last
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(splits))).otherwise(F.lit(len(splits) - 2) - F.col("bucket")).cast("int"))
    heads = {r.part: r.head for r in rows.groupBy("part").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    before = {p: order[k - 1] for k, p in enumerate(order)}
    guards = F.create_map(*[F.lit(x) for p in order or [0] for x in (p, before.get(p, p))])
    first = F.coalesce(F.col("doc_id").isin([heads[p] for p in order if heads[p] is not None]), F.lit(True))
    return rows.withColumn(
        "to",
        F.explode(F.when(first, F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guard")), F.struct(guards[F.col("part")].alias("part"), F.lit(True).alias("guard")))).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guard"))))),
    ).select("to.part", "to.guard", "doc_id", "text")


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and their likeness, and that to the next document.

    The edited text has the last floor(n_chars / 3) code points replaced by the first as many of the
    next document by descending doc_id; the first follows the last. A null text counts as empty. Rows
    without a doc_id stand last; rows with equal doc_id follow one another by a hash of their texts. A
    single document is its own next one. An empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = (
        _dealt(source, parts)
        .repartition("part")
        .sortWithinPartitions("part", "guard", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row of a batch, until its next one comes
        for batch in pieces(batches, 8_000_000):
            got = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            rows = ([held] if held else []) + got
            done = _rows(rows, samples)
            held = rows[-1]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), _KINDS.values(), strict=True)], names=list(_KINDS))

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_KINDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _rows(rows: list[tuple], samples: int) -> list[tuple]:
    """Results of all rows but the last and the guards; rows are (part, guard, doc_id, text)."""
    own = [i for i, r in enumerate(rows[:-1]) if not r[1]]
    if not own:
        return []
    texts, edited = [], []
    for i in own:
        text, following = rows[i][3], rows[i + 1][3]
        cut = len(text) // 3
        edited.append((text[: len(text) - cut] + following[:cut]).encode())
    texts = [r[3].encode() for r in rows]
    used = sorted({*own, *(i + 1 for i in own)})
    at = {i: k for k, i in enumerate(used)}
    names = signatures([texts[i] for i in used] + edited, samples)
    empty = [not texts[i].split() for i in used] + [not e.split() for e in edited]
    text_of = lambda k: "" if empty[k] else names[k].astype(">u2").tobytes().hex()
    out = []
    for k, i in enumerate(own):
        a, b, e = at[i], at[i + 1], len(used) + k
        out.append((rows[i][2], len(rows[i][3]), hashlib.sha256(edited[k]).hexdigest(), text_of(a), text_of(e), likeness(names[a], names[e], empty[a], empty[e]), likeness(names[a], names[b], empty[a], empty[b])))
    return out
