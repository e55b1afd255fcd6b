"""The suffix tree, grown and asked in parts of the corpus' words.

A token is judged by the words before it, so all that the tree says of it hangs on its window: the token and
at most DEPTH words before. Windows are dealt by their last context word; a part then holds every string whose
context ends in its words, counts them, grows those branches and scores its windows, and only a sum for each text
and part goes back. Windows of a very frequent word are dealt by the word before as well; the counts of the words
that follow it are summed first and sent to each of its parts.

Blocks of numbers travel packed: a task writes one for each other task, so no row stands for a token or a string.
Texts are split once, into chunks of numbered words. Each chunk gets for its words their numbers and occurrences in
the whole corpus; numbers stand for 64-bit hashes, the most frequent words of a part first, which packs well.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import binary, hash_words, mix, pieces
from tidewater.llm.scratch import Scratch

#: Tokens (and texts) of a chunk, bytes of text split at once, and words of a part of the dictionary, about.
CHUNK, TEXTS, BATCH, WORDS = 2_000_000, 200_000, 3_000_000, 2_000_000
#: Windows of a part, about; a word with more than a quarter of them is dealt to several parts.
WINDOWS = 1_000_000
#: Turns in which the parts are dealt, one after another, so that the windows of one turn alone are on disk.
TURNS = 2
#: Kinds of blocks: windows, windows of frequent words, what follows those, and what is known of texts without contexts.
PLAIN, FREQUENT, FOLLOWERS, ALONE = range(4)
_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length of whole numbers from 0, by the bytes of equal weight."""
    n, planes, widths = len(columns[0]), [], []
    for c in columns:
        width = (int(c.max()).bit_length() + 7) // 8 if n else 0
        rows = np.ascontiguousarray(c.astype("<u4" if width <= 4 else "<u8", copy=False)).view(np.uint8).reshape(n, 4 if width <= 4 else 8)
        planes += [rows[:, k].tobytes() for k in range(width)]
        widths.append(width)
    return np.array([n, len(widths), *widths], "<i8").tobytes() + (_ZSTD.compress(b"".join(planes), asbytes=True) if planes else b"")


def unpack(block: bytes) -> list[np.ndarray]:
    n, columns = np.frombuffer(block, "<i8", 2).tolist()
    widths = np.frombuffer(block, "<i8", columns, 16).tolist()
    raw = np.frombuffer(_ZSTD.decompress(memoryview(block)[16 + 8 * columns :], n * sum(widths)), np.uint8) if n * sum(widths) else np.empty(0, np.uint8)
    found, at = [], 0
    for width in widths:
        rows = np.zeros((n, 4 if width <= 4 else 8), np.uint8)
        for k in range(width):
            rows[:, k] = raw[at : at + n]
            at += n
        found.append(rows.view("<u4" if width <= 4 else "<u8").reshape(n))
    return found


def _joined(blocks: list[list[np.ndarray]]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*blocks, strict=True)]


def _dealt(to: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each part, in their order."""
    order = np.argsort(to.astype(np.uint16) if parts < 1 << 16 else to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, order[cuts[k] : cuts[k + 1]]


def _rows(schema: dict[str, pa.DataType], *rows: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.values(), strict=True)], names=list(schema))


_CODED = {"chunk": pa.int64(), "n_tokens": pa.int64(), "n_words": pa.int64(), "tokens": pa.binary(), "docs": pa.binary(), "words": pa.binary(), "doc_id": pa.list_(pa.int64())}
_BLOCK = {"part": pa.int32(), "kind": pa.int32(), "chunk": pa.int64(), "data": pa.binary()}
_BLOCK_DDL = "part int, kind int, chunk long, data binary"


def coded(docs: DataFrame, end: np.uint64) -> DataFrame:
    """Chunks of docs (doc_id, text, held_out): their tokens as numbers, each text's length and side, their words' hashes and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        index: defaultdict = defaultdict()
        index.default_factory = index.__len__
        tokens, sizes, held, ids = [], [], [], []

        def chunk() -> pa.RecordBatch:
            token, size, out = np.concatenate(tokens), np.array(sizes, np.int64), np.array(held, bool)
            words = list(index)
            h = hash_words([w or b"" for w in words])
            h[words.index(None)] = end
            n = np.bincount(token[np.repeat(~out, size)], minlength=len(words))
            by_hash = np.argsort(h)
            place = np.empty(len(words), np.int64)
            place[by_hash] = np.arange(len(words))
            by_use = np.argsort(-np.bincount(token, minlength=len(words)))
            rank = np.empty(len(words), np.uint32)
            rank[by_use] = np.arange(len(words))
            h = h[by_hash]
            steps = np.r_[h[:1], np.diff(h)]
            dealt = pack(rank[token])
            data = np.int64(len(dealt)).tobytes() + dealt + pack(place[by_use])
            return _rows(_CODED, (number, len(token), len(words), data, pack(size, out), pack(steps, n[by_hash]), ids))

        for b in pieces(batches, BATCH):
            words = []
            for t in binary(b.column(1)):
                own = (t or b"").lower().split()
                words += own
                words.append(None)
                sizes.append(len(own) + 1)
            tokens.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            ids += b.column(0).to_pylist()
            held += b.column(2).to_pylist()
            if sum(map(len, tokens)) >= CHUNK or len(sizes) >= TEXTS:
                yield chunk()
                number += 1
                index.clear()
                tokens, sizes, held, ids = [], [], [], []
        if sizes:
            yield chunk()

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, "chunk long, n_tokens long, n_words long, tokens binary, docs binary, words binary, doc_id array<long>")


def dictionary(chunks: DataFrame, parts: int, hot: int) -> DataFrame:
    """For each chunk and part its words' numbers (from 1) and training occurrences, by hash; and rows of chunk -1 with a part's sums.

    The data of those are training tokens, distinct words of them, and words of more than ``hot`` occurrences.
    """
    step = (1 << 64) // parts + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                steps, n = unpack(words)
                h = np.cumsum(steps.astype(np.uint64))
                cuts = np.r_[np.searchsorted(h, np.array([k * step for k in range(parts)], np.uint64)), len(h)]
                for k in range(parts):
                    s = slice(cuts[k], cuts[k + 1])
                    own = h[s] - np.uint64(k * step)
                    yield _rows(_BLOCK, (k, PLAIN, chunk, pack(np.r_[own[:1], np.diff(own)], n[s])))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunks, blocks = 0, [], []
        for b in batches:
            for k, _, chunk, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                steps, n = unpack(data)
                part = k
                chunks.append(chunk)
                blocks.append([np.cumsum(steps.astype(np.uint64)), n.astype(np.int64)])
        if not blocks:
            return
        h, n = _joined(blocks)
        _, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, weights=n).astype(np.int64)
        own = np.empty(len(total), np.int64)
        own[np.argsort(-total, kind="stable")] = np.arange(len(total))
        own = own * parts + part + 1
        yield _rows(_BLOCK, (part, PLAIN, -1, pack(np.array([total.sum(), (total > 0).sum(), (total > hot).sum()]))))
        start = 0
        for chunk, (h, _) in zip(chunks, blocks, strict=True):
            s = at[start : start + len(h)]
            start += len(h)
            yield _rows(_BLOCK, (part, PLAIN, chunk, pack(own[s], total[s])))

    return chunks.select("chunk", "words").mapInArrow(deal, _BLOCK_DDL).repartitionById(parts, F.col("part")).mapInArrow(number, _BLOCK_DDL)


def _numbered(chunks: DataFrame, words: DataFrame, tasks: int) -> DataFrame:
    """Chunks with the blocks of their words in one task; the texts' block first in the list of kinds."""
    none = F.lit(-1).cast("int")
    rows = chunks.select(none.alias("part"), F.lit(PLAIN).alias("kind"), "chunk", F.col("tokens").alias("data"))
    rows = rows.unionAll(chunks.select(none.alias("part"), F.lit(ALONE).alias("kind"), "chunk", F.col("docs").alias("data")))
    return rows.unionAll(words.where("chunk >= 0").select("part", "kind", "chunk", "data")).repartition(tasks, "chunk")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each chunk of a task: its number, its tokens' numbers and training occurrences, and its texts' sizes and sides."""
    found: dict[int, dict] = {}
    for b in batches:
        for part, kind, chunk, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found.setdefault(chunk, {})[part, kind] = data
    for chunk in sorted(found):
        blocks = found.pop(chunk)
        tokens, (size, held) = blocks.pop((-1, PLAIN)), unpack(blocks.pop((-1, ALONE)))
        cut = 8 + int(np.frombuffer(tokens, "<i8", 1)[0])
        (token,), (place,) = unpack(tokens[8:cut]), unpack(tokens[cut:])
        number, n = _joined([[c.astype(np.int64) for c in unpack(blocks[k])] for k in sorted(blocks)])
        yield chunk, number[place][token], n[place][token], size.astype(np.int64), held.astype(bool)


def _windows(number: np.ndarray, n: np.ndarray, size: np.ndarray, depth: int, context_least: int, pair_least: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Columns of context words (last first) and token, 0 where nothing can be known of a string with it; the token's occurrences, and places.

    Places are those of the tokens that have a context.
    """
    first = np.cumsum(size) - size
    position = np.arange(len(number)) - np.repeat(first, size)
    is_word = np.where(n >= context_least, number, 0)
    columns, ok = [], np.ones(len(number), bool)
    for d in range(1, depth + 1):
        back = np.r_[np.zeros(min(d, len(number)), np.int64), is_word[:-d]][: len(number)]
        ok = ok & (position >= d) & (back > 0)
        columns.append(np.where(ok, back, 0))
    at = np.flatnonzero(columns[0] > 0)
    token = np.where(n >= pair_least, number, 0)
    return [*(c[at] for c in columns), token[at]], np.where(n >= pair_least, n, 0)[at], at


def _share_of(word: np.ndarray, parts: int) -> np.ndarray:
    return (mix(word.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _copies(n: np.ndarray, hot: int, parts: int) -> np.ndarray:
    """Parts that the windows of a word of n occurrences go to."""
    return np.where(n > hot, np.minimum(-(-n // hot), parts), 1)


def followers(chunks: DataFrame, words: DataFrame, parts: int, tasks: int, hot: int, least: tuple[int, int], sums: int) -> DataFrame:
    """What follows the words of more than ``hot`` occurrences, summed, for each part that their windows go to."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, number, n, size, held in _chunks(batches):
            (a, x), nx, at = _windows(number, n, size, 1, *least)
            ok = (n[at - 1] > hot) & ~np.repeat(held, size)[at]
            if not ok.any():
                continue
            words, ai = np.unique(a[ok], return_inverse=True)
            tokens, xi = np.unique(x[ok], return_inverse=True)
            many, occurs = np.zeros(len(words), np.int64), np.zeros(len(tokens), np.int64)
            many[ai], occurs[xi] = n[at - 1][ok], nx[ok]
            key, times = np.unique(ai * len(tokens) + xi, return_counts=True)
            ai, xi = key // len(tokens), key % len(tokens)
            a, x = words[ai], tokens[xi]
            for k, s in _dealt(_share_of(a * 31 + x, sums), sums):
                yield _rows(_BLOCK, (k, FOLLOWERS, chunk, pack(a[s], x[s], many[ai[s]], occurs[xi[s]], times[s])))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [unpack(data) for b in batches for data in b.column(3).to_pylist()]
        if not blocks:
            return
        a, x, n, nx, times = (c.astype(np.int64) for c in _joined(blocks))
        tokens, xi = np.unique(x, return_inverse=True)
        words, ai = np.unique(a, return_inverse=True)
        key, at = np.unique(ai * len(tokens) + xi, return_inverse=True)
        times = np.bincount(at, weights=times).astype(np.int64)
        one = np.empty(len(key), np.int64)
        one[at] = np.arange(len(at))
        a, x, n, nx = (c[one] for c in (a, x, n, nx))
        x, nx = (np.where(times >= least[1], c, 0) for c in (x, nx))  # the others count for their context alone
        copies = _copies(n, hot, parts)
        place = np.repeat(np.arange(len(a)), copies)
        turn = np.arange(len(place)) - np.repeat(np.cumsum(copies) - copies, copies)
        for k, s in _dealt((_share_of(a, parts)[place] + turn) % parts, parts):
            s = place[s]
            yield _rows(_BLOCK, (k, FOLLOWERS, -1, pack(a[s], x[s], nx[s], times[s])))

    return _numbered(chunks, words, tasks).mapInArrow(count, _BLOCK_DDL).repartitionById(sums, F.col("part")).mapInArrow(add, _BLOCK_DDL)


def dealt(chunks: DataFrame, words: DataFrame, parts: int, turn: int, tasks: int, hot: int, depth: int, least: tuple[int, int], bottom: int) -> DataFrame:
    """The windows of all chunks for each part of a turn; in the first, for each chunk what its texts are without contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, number, n, size, held in _chunks(batches):
            if not turn:
                starts = np.cumsum(size) - size
                base = np.add.reduceat(np.log10((n + 1) / bottom), starts)
                known = np.add.reduceat((n > 0).astype(np.int64), starts)
                yield _rows(_BLOCK, (chunk % parts // TURNS * TURNS, ALONE, chunk, pack(known, base.view(np.uint64))))
            columns, nx, at = _windows(number, n, size, depth, *least)
            text = np.repeat(np.arange(len(size)), size)[at]
            same = np.r_[False, text[1:] == text[:-1]][: len(at)]
            for c in columns:
                same[1:] &= c[1:] == c[:-1]
            new = np.flatnonzero(~same)  # a word repeated on and on is one row
            runs = np.diff(np.r_[new, len(at)])
            columns, nx, text, many = [c[new] for c in columns], nx[new], text[new], n[at - 1][new]
            times = 2 * runs + ~held[text]
            copies = _copies(many, hot, parts)
            to = (_share_of(columns[0], parts) + np.where(copies > 1, _share_of(columns[1 % len(columns)] + 7, 1 << 40) % copies, 0)) % parts
            often, now = many > hot, to % TURNS == turn
            for kind, of in ((PLAIN, np.flatnonzero(now & ~often)), (FREQUENT, np.flatnonzero(now & often))):
                for k, s in _dealt(to[of], parts):
                    s = of[s]
                    yield _rows(_BLOCK, (k, kind, chunk, pack(*(c[s] for c in columns), nx[s], np.diff(text[s], prepend=0), times[s])))

    return _numbered(chunks, words, tasks).mapInArrow(run, _BLOCK_DDL)


def _dense(x: np.ndarray) -> tuple[int, np.ndarray]:
    values, at = np.unique(x, return_inverse=True)
    return len(values), at


def grown(context: list[np.ndarray], token: np.ndarray, p: np.ndarray, first: np.ndarray, times: np.ndarray, least: tuple[int, int], divergence: float) -> np.ndarray:
    """Each token's probability in the tree of all windows, from that without contexts (p).

    Windows weigh ``first`` in counts of one word's context and ``times`` in those of longer ones; a context word or
    token of 0 takes no part.
    """
    p = p.copy()
    tokens, x = _dense(token)
    _, ctx = _dense(context[0])
    at, weight = np.arange(len(p)), first
    for depth in range(len(context)):
        if depth:
            ok = context[depth][at] != 0
            at, ctx = at[ok], ctx[ok]
            older, o = _dense(context[depth][at])
            _, ctx = _dense(ctx * older + o)
            weight = times[at]
        n = np.bincount(ctx, weights=weight)
        live = n[ctx] >= least[0]
        at, ctx, weight = at[live], ctx[live], weight[live]
        if not len(at):
            break
        say = np.flatnonzero(token[at] != 0)
        pairs, of = np.unique(ctx[say] * tokens + x[at[say]], return_inverse=True)
        count = np.bincount(of, weights=weight[say], minlength=len(pairs))
        one = np.empty(len(pairs), np.int64)
        one[of] = say
        kept = count >= least[1]
        owner, c, e = ctx[one][kept], count[kept], p[at[one]][kept]
        total = lambda v: np.bincount(owner, weights=v, minlength=len(n)).astype(np.float64)  # noqa: B023, E731
        follow, left = total(None), n - total(c)
        gain = total(c * (np.log(c / n[owner]) - np.log(e)))
        some = np.flatnonzero((left > 0) & (follow > 0))
        gain[some] += left[some] * np.log(left[some] / n[some] / np.clip(1 - total(e)[some], 1e-12, 1.0))
        state = (follow > 0) & (gain >= divergence)
        whole = np.maximum(n + follow, 1)
        rest = np.where(state, (left + follow) / whole, 1.0)
        share = np.zeros(len(pairs))
        share[kept] = np.where(state[owner], c / whole[owner], 0.0)
        p[at] *= rest[ctx]
        p[at[say]] += share[of]
    return p


def judged(blocks: DataFrame, parts: int, depth: int, least: tuple[int, int], divergence: float, bottom: int) -> DataFrame:
    """For each part of a turn and chunk the texts that have windows there (as steps) and what contexts add to their log10 probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []
        chunks: list[int] = []
        for b in batches:
            for part, kind, chunk, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == ALONE:
                    yield _rows(_BLOCK, (part, kind, chunk, data))
                    continue
                if kind == FOLLOWERS:
                    a, x, nx, times = unpack(data)
                    none = np.zeros(len(a), np.uint32)
                    found.append([a, *[none] * (depth - 1), x, nx, none, times, none, np.full(len(a), -1, np.int32), none])
                else:
                    *columns, nx, step, times = unpack(data)
                    train = times // 2 * (times & 1)
                    place = np.full(len(nx), len(chunks), np.int32)
                    chunks.append(chunk)
                    found.append([*columns, nx, np.cumsum(step).astype(np.uint32), train if kind == PLAIN else np.zeros_like(train), train, place, times // 2])
        if not chunks:
            return
        *context, token, nx, text, first, times, place, runs = _joined(found)
        found.clear()
        p = (nx + 1.0) / bottom
        adds = grown(context, token, p, first, times, least, divergence)
        adds = (np.log10(adds) - np.log10(p)) * runs
        ends = np.flatnonzero(np.r_[(place[1:] != place[:-1]) | (text[1:] != text[:-1]), True])
        starts = np.r_[0, ends[:-1] + 1]
        adds, place, text = np.add.reduceat(adds, starts), place[starts], text[starts].astype(np.int64)
        cuts = np.searchsorted(place[np.argsort(place, kind="stable")], np.arange(len(chunks) + 1))
        order = np.argsort(place, kind="stable")
        for k, chunk in enumerate(chunks):
            s = order[cuts[k] : cuts[k + 1]]
            s = s[adds[s] != 0]
            if len(s):
                yield _rows(_BLOCK, (0, PLAIN, chunk, pack(np.diff(text[s], prepend=0), adds[s].view(np.uint64))))

    return blocks.repartitionById(parts // TURNS, F.expr(f"part div {TURNS}").cast("int")).mapInArrow(run, _BLOCK_DDL)


def put_together(chunks: DataFrame, blocks: DataFrame, tasks: int, train_tokens: int) -> DataFrame:
    """The rows of all texts, from their chunks and what the parts say."""
    schema = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for b in batches:
            for chunk, ids, kind, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found.setdefault(chunk, []).append((kind, ids, data))
        for chunk in sorted(found):
            adds, size = [], np.empty(0, np.int64)
            for kind, ids, data in found.pop(chunk):
                if ids is not None:
                    doc_id, (size, held) = ids, unpack(data)
                elif kind == ALONE:
                    known, base = unpack(data)
                else:
                    adds.append(unpack(data))
            score = base.astype(np.uint64).view(np.float64).copy()
            base = score.copy()
            for step, more in adds:
                score[np.cumsum(step.astype(np.int64))] += more.astype(np.uint64).view(np.float64)
            columns = [doc_id, held.astype(bool), size.astype(np.int64), known.astype(np.int64), np.full(len(size), train_tokens), base, score]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))

    none = F.lit(None)
    rows = chunks.select("chunk", "doc_id", F.lit(PLAIN).alias("kind"), F.col("docs").alias("data"))
    rows = rows.unionAll(blocks.select("chunk", none.cast("array<long>").alias("doc_id"), "kind", "data"))
    return rows.repartition(tasks, "chunk").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def scores(docs: DataFrame, scratch: Scratch, end: np.uint64, depth: int, least: tuple[int, int], divergence: float) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text, held_out)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    chunks = scratch.write(coded(docs, end), "coded")
    tokens, n_words, n_chunks = chunks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0)), F.count("*")).first()
    parts, tasks, hot = -(-max(cores, -(-tokens // WINDOWS)) // TURNS) * TURNS, max(cores, n_chunks), max(WINDOWS // 4, 1)
    of_words = max(cores, -(-n_words // WORDS))
    words = scratch.write(dictionary(chunks, of_words, hot), "words")
    train = distinct = often = 0
    for r in words.where("chunk < 0").select("data").toLocalIterator():
        train, distinct, often = (x + int(y) for x, y in zip((train, distinct, often), unpack(r.data)[0], strict=True))
    bottom = train + distinct + 1
    often = scratch.write(followers(chunks, words, parts, tasks, hot, least, of_words), "followers") if often else None
    found = None
    for turn in range(TURNS):
        blocks = dealt(chunks, words, parts, turn, tasks, hot, depth, least, bottom)
        if often is not None:
            blocks = blocks.unionAll(often.where(F.col("part") % TURNS == turn))
        blocks = scratch.write(judged(blocks, parts, depth, least, divergence, bottom), f"judged{turn}")
        found = blocks if found is None else found.unionAll(blocks)
    for name in ("words", "followers"):
        scratch.drop(name)
    return put_together(chunks, found, tasks, train)
