"""Similarity join of documents on word n-grams, by partition of the universe and exact verification.

1. Each document becomes a set of hashed n-grams; equal sets make one class.
2. The sets' keys (partitions.py) are dealt out; in a bucket every set is paired with the least one, its
   hub. A batch sends a key on once, with the list of its sets.
3. A pair is tested by signatures first. A signature holds the parity of the number of elements in each of its
   bits, so two sets differ in as many elements at least as their signatures in bits: what the test refuses
   is not linked, and nothing is lost. What passes is verified on whole sets. With it goes, for each set of a
   crowded bucket, the pair with the nearest lesser set of its block of the group, so a group of near copies
   that are unlike the hub makes a few components after as many pairs as it has members.
4. Two other sets of a bucket may be linked with each other. That matters only if they are not yet in one component.
   In each group the sets outside its largest component are lone; they are tested against all members of other components
   by signatures, and what passes is verified. A group with more than BLOCK lone sets is dealt out by elements first, those
   that the hub lacks before others: linked sets share one in the prefixes of their orders, so sets that only share a
   passage with the hub part.
5. All links make components by star contraction.

Signatures are a small share of the sets, and whole sets travel only for pairs that signatures let through, so
the keys are the largest exchange. Joins whose sides grow with the input are all sorted and merged, whatever
their size, so plans and costs are alike at every size and adaptive execution can split the partitions of a hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tidewater.llm.components import components
from tidewater.llm.kernels import binary, hash_words, pieces, signed, window_hashes
from tidewater.llm.partitions import set_keys
from tidewater.llm.scratch import Scratch, unused_name

#: Lone sets of a group that a task compares at once, and sets of a hub in one block.
BLOCK = 1024
#: Bits of a signature: about the size of the set, within these.
LEAST_BITS, MOST_BITS = 64, 1 << 17


def shingles(text: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of words, A-Z in lower case; of all words if there are fewer."""
    words = (text or b"").lower().split()
    return np.unique(window_hashes(hash_words(words), min(n, len(words)))) if words else np.empty(0, np.uint64)


def signature(s: np.ndarray) -> bytes:
    """For each of about len(s) bits, whether an odd number of elements falls on it."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (len(s) - 1).bit_length() if len(s) else 0))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differences(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many elements sets differ at least, from the rows of two arrays of 64-bit words; the wider is folded."""
    while a.shape[1] > b.shape[1]:
        a = a[:, : a.shape[1] // 2] ^ a[:, a.shape[1] // 2 :]
    while b.shape[1] > a.shape[1]:
        b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def _words_of(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint64).reshape(len(signatures), -1)


def _index(docs: DataFrame, n: int) -> DataFrame:
    """Per row of (node, doc_id, text): node, doc_id, n_shingles, a 128-bit name of its set (f, g) and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8_000_000):
            sets = [shingles(text, n) for text in binary(b.column(2))]
            names = np.frombuffer(b"".join([xxh3_128_digest(s.tobytes()) for s in sets]), "<i8").reshape(-1, 2)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            columns = [b.column(0), b.column(1), pa.array(size), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array(list(map(signature, sets)), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "doc_id", "n_shingles", "f", "g", "signature"])

    return docs.mapInArrow(run, "node long, doc_id long, n_shingles long, f long, g long, signature binary")


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _keys(docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """(key, hub, docs): each key of a batch once, with the least of its sets and the list of the others.

    Of equal sets the first in a task has keys; equal sets of several tasks meet under all their keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in pieces(batches, 8_000_000):
            ids, keys = [], []
            for doc, text in zip(b.column(0).to_pylist(), binary(b.column(1)), strict=True):
                s = shingles(text, n)
                name = xxh3_128_digest(s.tobytes())
                if len(s) and name not in seen:
                    seen.add(name)
                    ids.append(doc)
                    keys.append(set_keys(s, p, q))
            if sum(map(len, keys)):
                key, doc = signed(np.concatenate(keys)), np.repeat(np.array(ids, np.int64), [len(k) for k in keys])
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                start = _starts(key)
                others = np.ones(len(key), bool)
                others[start] = False
                ends = np.r_[0, np.cumsum(np.add.reduceat(others.astype(np.int64), start))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(doc[start]), pa.ListArray.from_arrays(pa.array(ends), pa.array(doc[others]))], names=["key", "hub", "docs"])

    return docs.mapInArrow(run, "key long, hub long, docs array<long>")


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, doc, crowded) of each key's least set and all its others; rows come by key and hub, one batch in memory.

    A pair is crowded if its bucket holds a third set, or may hold one in another batch.
    """
    last: tuple[int, int] | None = None  # key and hub of a bucket that may go on
    for b in batches:
        key, least, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), b.column(2)
        if not len(key):
            continue
        start = _starts(key)
        hub = least[start].copy()
        goes_on = last is not None and key[0] == last[0]
        if goes_on:
            hub[0] = last[1]
        last = (int(key[-1]), int(hub[-1]))
        bucket = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(key)]))
        inner = np.repeat(bucket, np.diff(lists.offsets.to_numpy()))
        bucket, doc = np.r_[bucket, inner], np.r_[least, lists.flatten().to_numpy(zero_copy_only=False)]
        other = doc != hub[bucket]
        bucket, doc = bucket[other], doc[other]
        if not len(doc):
            continue
        crowded = np.bincount(bucket, minlength=len(start)) > 1
        crowded[-1] = True
        crowded[0] |= goes_on
        pairs = np.unique(np.stack([hub[bucket], doc, crowded[bucket]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.array(pairs[:, 2].astype(bool))], names=["hub", "doc", "crowded"])


def _hub_pairs(docs: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """Distinct (hub, doc) pairs over all keys, and whether any of their buckets is crowded."""
    rows = _keys(docs.select("node", "text"), n, p, q).repartition("key").sortWithinPartitions("key", "hub")
    found = rows.mapInArrow(_across, "hub long, doc long, crowded boolean")
    return found.groupBy("hub", "doc").agg(F.max("crowded").alias("crowded"))


def _most(x: np.ndarray | int, y: np.ndarray | int, p: int, q: int) -> np.ndarray | int:
    """Differences that two linked sets of these sizes can have."""
    return (x + y) * (q - p) // (q + p)


def _tested(pairs: DataFrame, index: DataFrame, p: int, q: int) -> DataFrame:
    """(hub, doc, crowded) with the size and signature of doc, and whether hub and doc may be linked."""
    of = index.select("node", "n_shingles", "signature")
    rows = pairs.join(of.toDF("hub", "hub_size", "hub_signature").hint("merge"), "hub").join(of.toDF("doc", "size", "signature").hint("merge"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False)
            a, s = b.column(5).to_pylist(), b.column(6).to_pylist()
            apart = np.empty(b.num_rows, np.int64)
            widths = np.array([(len(i), len(j)) for i, j in zip(a, s, strict=True)], np.int64).reshape(-1, 2)
            for pair in np.unique(widths, axis=0):
                at = np.flatnonzero((widths == pair).all(axis=1))
                apart[at] = differences(_words_of([a[i] for i in at]), _words_of([s[i] for i in at]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(4), b.column(6), pa.array(apart <= _most(x, y, p, q))], names=["hub", "doc", "crowded", "size", "signature", "may"])

    return rows.select("hub", "doc", "crowded", "hub_size", "size", "hub_signature", "signature").mapInArrow(run, "hub long, doc long, crowded boolean, size long, signature binary, may boolean")


def _sets(source: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    """(node, elements) of all sets of some (hub, doc) pairs; a row without words has no set."""
    needed = pairs.select(F.col("hub").alias("node")).union(pairs.select("doc")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 8_000_000):
            sets = [shingles(t, n).tobytes() for t in binary(b.column(1))]
            rows = pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "elements"])
            yield rows.filter(pa.array(list(map(bool, sets))))

    return source.select("node", "text").join(needed.hint("merge"), "node", "left_semi").mapInArrow(run, "node long, elements binary")


def _beside_hub(pairs: DataFrame, sets: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """What a kernel gives for (g, hub, doc, hub's set, doc's set) of each pair; the hub's own set goes to each block of its pairs."""
    rows = pairs.select("g", "hub", "doc", F.pmod(F.xxhash64("doc"), F.lit(1 << 30)).alias("r"))
    number = rows.groupBy("g", "hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    members = rows.join(number.hint("merge"), ["g", "hub"]).select("g", "hub", "doc", (F.col("r") % F.col("blocks")).alias("block"))
    own = number.select("g", "hub", F.col("hub").alias("doc"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    rows = members.union(own).join(sets.hint("merge"), F.col("doc") == F.col("node")).select("g", "hub", "block", (F.col("doc") != F.col("hub")).alias("member"), "doc", "elements")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, np.empty(0, np.uint64)
        for b in batches:
            out: list[tuple] = []
            for g, hub, block, member, doc, raw in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if not member:
                    at, own = (g, hub, block), s
                    continue
                if at != (g, hub, block):
                    raise ValueError("a hub without its set")
                out += kernel(g, hub, doc, own, s)
            if out:
                names = [x.split()[0] for x in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return rows.repartition("g", "hub", "block").sortWithinPartitions("g", "hub", "block", "member").mapInArrow(run, schema)


def _verified(pairs: DataFrame, source: DataFrame, n: int, p: int, q: int, scratch: Scratch, name: str) -> DataFrame:
    """The linked ones among distinct (hub, doc) pairs."""

    def kernel(g: int, hub: int, doc: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        return [(hub, doc)] if len(np.setxor1d(a, b, assume_unique=True)) <= _most(len(a), len(b), p, q) else []

    sets = scratch.write(_sets(source, pairs, n), "sets")
    found = scratch.write(_beside_hub(pairs.withColumn("g", F.lit(0).cast("long")), sets, kernel, "hub long, doc long"), name)
    scratch.drop("sets")
    return found


def _lone_pairs(members: DataFrame, groups: DataFrame, p: int, q: int) -> DataFrame:
    """(hub, doc) of lone sets and members of other components of their group that signatures let through.

    Lone sets and members are cut into blocks; a task holds BLOCK lone sets and walks a block of members. No pair is
    written unless its signatures allow a link.
    """
    rows = members.join(groups.hint("merge"), ["g", "hub"]).withColumn("lone", F.col("component") != F.col("largest")).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("lone_blocks", F.ceil(F.col("n_lone") / BLOCK))
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    home = lambda n: F.pmod(F.xxhash64("doc"), F.col(n))
    place = lambda a, b, kind: F.struct(a.alias("a"), b.alias("b"), kind.alias("kind"))
    # a lone set's own block needs it once, as lone set and as member
    as_member = F.transform(numbers("lone_blocks"), lambda a: place(a, home("blocks"), F.when(F.col("lone") & (a == home("lone_blocks")), 1).otherwise(2)))
    as_lone = F.transform(F.filter(numbers("blocks"), lambda b: b != home("blocks")), lambda b: place(home("lone_blocks"), b, F.lit(0)))
    rows = rows.withColumn("at", F.explode(F.when(F.col("lone"), F.concat(as_lone, as_member)).otherwise(as_member)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}  # lone sets by the width of their signatures
        mine: list[tuple] = []  # those that are members of the block too, not yet tested
        u: list[int] = []
        v: list[int] = []

        def test(doc: int, size: int, component: int, lone: bool, s: np.ndarray) -> None:
            for width, (docs, sizes, others, words) in held.items():
                if not isinstance(words, np.ndarray):
                    docs, sizes, others, words = held[width] = np.array(docs), np.array(sizes), np.array(others), np.stack(words)
                may = (differences(words, s[None, :]) <= _most(sizes, size, p, q)) & (others != component)
                if lone:  # of two lone sets the greater is tested
                    may &= docs < doc
                u.extend(np.minimum(docs[may], doc).tolist())
                v.extend(np.maximum(docs[may], doc).tolist())

        def test_mine() -> None:
            for row in mine:
                test(*row)
            mine.clear()

        def found() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["hub", "doc"])
            u.clear()
            v.clear()
            return out

        at = None
        for batch in batches:
            for g, hub, a, b, kind, doc, size, component, lone, raw in zip(*(batch.column(i).to_pylist() for i in range(10)), strict=True):
                if at != (g, hub, a, b):
                    test_mine()
                    at = (g, hub, a, b)
                    held.clear()
                s = np.frombuffer(raw, np.uint64)
                if kind == 2:  # after all lone sets
                    test_mine()
                    test(doc, size, component, lone, s)
                    continue
                for x, y in zip(held.setdefault(len(s), ([], [], [], [])), (doc, size, component, s), strict=True):
                    x.append(y)
                if kind == 1:
                    mine.append((doc, size, component, True, s))
            if u:
                yield found()
        test_mine()
        yield found()

    rows = rows.select("g", "hub", "at.a", "at.b", "at.kind", "doc", "size", "component", "lone", "signature").repartition("g", "hub", "a", "b").sortWithinPartitions("g", "hub", "a", "b", "kind")
    return rows.mapInArrow(run, "hub long, doc long").distinct()


def _grouped(members: DataFrame) -> DataFrame:
    """(g, hub, n, n_lone, largest) of groups of several components: the largest, and how many are outside it."""
    parts = members.groupBy("g", "hub", "component").agg(F.count("*").alias("n"))
    groups = parts.groupBy("g", "hub").agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("top"))
    return groups.select("g", "hub", "n", (F.col("n") - F.col("top.n")).alias("n_lone"), F.col("top.component").alias("largest")).where("n_lone > 0")


def _nearest(members: DataFrame, p: int, q: int) -> DataFrame:
    """(hub, doc): for each set of a group, the lesser set of its block that is nearest by signatures, if they allow a link.

    A set falls into other blocks in other groups, so blocks of near copies are joined by other groups' pairs.
    """
    groups = members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    rows = members.join(groups.hint("merge"), "hub").select("hub", F.pmod(F.xxhash64("doc", "hub"), "blocks").alias("block"), "doc", "size", "signature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}  # sets by the width of their signatures: how many, documents, sizes and signatures
        for b in batches:
            u, v = [], []
            for hub, block, doc, size, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if at != (hub, block):
                    at, held = (hub, block), {}
                s = np.frombuffer(raw, np.uint64)
                best = None
                for n, docs, sizes, words in held.values():
                    most = _most(sizes[:n], size, p, q)
                    apart = differences(words[:n], s[None, :])
                    ratio = np.where(apart <= most, apart / np.maximum(most, 1), 2.0)
                    i = int(ratio.argmin())
                    if ratio[i] <= 1 and (best is None or ratio[i] < best[0]):
                        best = (ratio[i], int(docs[i]))
                if best is not None:
                    u.append(best[1])
                    v.append(doc)
                n, docs, sizes, words = held.get(len(s)) or (0, np.empty(4, np.int64), np.empty(4, np.int64), np.empty((4, len(s)), np.uint64))
                if n == len(docs):
                    docs, sizes, words = np.resize(docs, 2 * n), np.resize(sizes, 2 * n), np.resize(words, (2 * n, len(s)))
                docs[n], sizes[n], words[n] = doc, size, s
                held[len(s)] = (n + 1, docs, sizes, words)
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["hub", "doc"])

    return rows.repartition("hub", "block").sortWithinPartitions("hub", "block", "doc").mapInArrow(run, "hub long, doc long")


def _parts(members: DataFrame, groups: DataFrame, source: DataFrame, n: int, p: int, q: int, scratch: Scratch) -> DataFrame:
    """The members of large groups dealt out by elements, each part a group of its own.

    Elements are ordered by whether the hub has them, then by value. Two linked sets have at least p / q of
    either in common, so the first elements of both, as many as a set may lack and one more, meet.
    """

    def kernel(g: int, hub: int, doc: int, a: np.ndarray, b: np.ndarray) -> list[tuple]:
        known = np.isin(b, a, assume_unique=True)
        first = np.r_[b[~known], b[known]][: len(b) - -(-len(b) * p // q) + 1]
        return [(g, hub, doc, e) for e in signed(first).tolist()]

    chosen = members.join(groups.select("g", "hub").hint("merge"), ["g", "hub"], "left_semi")
    sets = scratch.write(_sets(source, chosen, n), "part_sets")
    dealt = _beside_hub(chosen, sets, kernel, "g long, hub long, doc long, element long")
    rows = dealt.join(chosen.select("g", "hub", "doc", "size", "component", "signature").hint("merge"), ["g", "hub", "doc"])
    return scratch.write(rows.select(F.xxhash64("g", "hub", "element").alias("g"), "hub", "doc", "size", "component", "signature"), "parts")


def _all_links(source: DataFrame, index: DataFrame, n: int, p: int, q: int, scratch: Scratch) -> DataFrame:
    """(u, v): links between different sets, enough of them to reach all that links reach."""
    pairs = scratch.write(_hub_pairs(source, n, p, q), "pairs")
    tested = scratch.write(_tested(pairs, index, p, q), "tested")
    scratch.drop("pairs")
    crowded = tested.where("crowded")
    candidates = scratch.write(tested.where("may").select("hub", "doc").union(_nearest(crowded, p, q)).distinct(), "candidates")
    links = _verified(candidates, source, n, p, q, scratch, "linked")
    scratch.drop("candidates")
    known = components(links.select(F.col("hub").alias("u"), F.col("doc").alias("v")), scratch)
    known = known.withColumnRenamed("node", "doc").hint("merge")
    members = crowded.join(known, "doc", "left").select(F.col("hub").alias("g"), "hub", "doc", "size", F.coalesce("component", "doc").alias("component"), "signature")
    members = scratch.write(members, "members")
    scratch.drop("tested")
    groups = scratch.write(_grouped(members), "groups")
    some, many = groups.where(F.col("n_lone") <= BLOCK), groups.where(F.col("n_lone") > BLOCK)
    beside = _lone_pairs(members, some, p, q)
    if not many.isEmpty():
        parts = _parts(members, many, source, n, p, q, scratch)
        beside = beside.union(_lone_pairs(parts, _grouped(parts), p, q)).distinct()
    beside = scratch.write(beside, "beside")
    scratch.drop("members")
    if not beside.isEmpty():
        links = links.union(_verified(beside, source, n, p, q, scratch, "linked_beside"))
    return links.select(F.col("hub").alias("u"), F.col("doc").alias("v"))


def similar_documents(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the least doc_id that links reach.

    Two documents are linked when q times the size of the intersection of their n-gram sets is at
    least p times that of the union. Words are runs between ASCII blanks, A-Z in lower case. A text of
    fewer than n words has one n-gram, all its words; a null, empty or blank text has none and is linked
    with nothing. Rows with a null doc_id are linked with nothing and have a null component_id. Rows of equal
    doc_id are one document for links, which has every link of any of its texts, whatever their order. Every row of
    the input has one in the result; extra columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession, "jaccard")
    source = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    index = scratch.write(_index(source, n), "index")
    sets = index.where("n_shingles > 0 AND doc_id IS NOT NULL")
    repeated = sets.groupBy("doc_id").agg(F.min("f").alias("a"), F.max("f").alias("b"), F.min("g").alias("c"), F.max("g").alias("d")).where("a <> b OR c <> d")
    links = []
    if not repeated.isEmpty():  # a doc_id with several texts: every row is a node, numbered in a table that stays
        source = scratch.write(source.withColumn("node", F.monotonically_increasing_id()), "texts")
        index = scratch.write(_index(source, n), "numbered")
        sets = index.where("n_shingles > 0 AND doc_id IS NOT NULL")
        named = index.where("doc_id IS NOT NULL")
        least = named.groupBy("doc_id").agg(F.min("node").alias("least"))
        links = [named.join(least.hint("merge"), "doc_id").where("node > least").select(F.col("node").alias("u"), F.col("least").alias("v"))]
    found = _all_links(source.where("doc_id IS NOT NULL AND text IS NOT NULL"), sets.select("node", "n_shingles", "signature").dropDuplicates(["node"]), n, p, q, scratch)
    classes = sets.groupBy("f", "g").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    # copies: every node that is not the least of its class is linked with it
    copies = sets.join(classes.where("least < most").hint("merge"), ["f", "g"]).where("node > least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    for more in [copies, *links]:
        found = found.union(more)
    found = components(found, scratch)
    rows = index.select("node", "doc_id", "n_shingles").join(found.withColumnRenamed("node", "of").hint("merge"), F.col("node") == F.col("of"), "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    if not links:
        return rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    rows = scratch.write(rows, "rows")
    least = rows.where("doc_id IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least.hint("merge"), "component", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, scratch: Scratch | None = None) -> DataFrame:
    """The rows of each component's least document, all columns as they are; rows without a doc_id stay."""
    found = similar_documents(docs, n, p, q, scratch)
    name = unused_name(docs, "gone")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == F.col(name), "left_anti")
