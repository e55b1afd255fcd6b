"""Toxicity by a weighted finite-state pattern grammar.

A lexicon reads words as symbols with weights: insults and threats, targets, negations and verbs of reported
speech. Five transducers read a clause one after another: the first marks what stands in reported speech, the
next what is negated, the third what is aimed at a target before or after it, the last two accept insults and
threats by their marks and weigh them. They are composed into one machine, which has one accepting path through
any clause. A document's score comes from what these paths accept, not from words alone: one logistic curve
over the weights by mark, and over the number, density and presence of insults that are neither negated nor reported.

Lexicon and curve are fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.kernels import hash_words, pieces
from tidewater.llm.scratch import Scratch

#: Labelled rows that the lexicon and the curve are fitted on, at most: those of least hash of doc_id.
SAMPLE = 8000
#: An entry stands in at least so many toxic texts of different kinds in the sample, or this share of them, and is this much
#: likelier in them; fewer texts would let words in that are toxic by chance.
LEAST_TEXTS, LEAST_SHARE, LEAST_LOG_ODDS = 4, 0.01, 2.5
#: Beginnings of words that may become entries, in characters.
BEGINNINGS = range(4, 9)
THRESHOLD = 0.7

# Closed word classes of the four languages of the corpus.
TARGETS = frozenset("you your yours yourself u ur he she they him her them his their du dich dir dein deine ihr euch euer er sie ihn ihm tu te toi ton ta vous votre vos il elle ils elles lui leur tú ti tu usted ustedes vosotros él ella ellos ellas".split())
NEGATIONS = frozenset("not no never nor isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ne n'est pas jamais nunca jamás tampoco ni".split())
REPORTS = frozenset("said says say told tells wrote writes called calls quoted reported claims claimed sagte sagt schrieb nannte behauptet dit disait écrit écrivait appelle déclaré dijo dice escribió llamó afirma".split())
THREATS = frozenset("kill hurt destroy beat punch shoot stab töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir".split())

_END = 8  # the word ends a clause
_STRIP = ".,;:!?\"'()[]{}<>*#%$&|-_«»“”¡¿…"
_ENDS = frozenset(".,;:!?…")


@dataclass(frozen=True)
class Transducer:
    """Arcs lead from (state, symbol) to (next state, symbol written, factor); a symbol that no arc reads is copied."""

    arcs: dict[tuple[int, str], tuple[tuple[int, str, float], ...]]
    finals: frozenset[int]

    @cached_property
    def reads(self) -> frozenset[str]:
        return frozenset(symbol for _, symbol in self.arcs)

    def step(self, state: int, symbol: str) -> tuple[tuple[int, str, float], ...]:
        return self.arcs.get((state, symbol), ()) if symbol in self.reads else ((state, symbol, 0.0),)


def compose(first: Transducer, second: Transducer, alphabet: Sequence[str]) -> Transducer:
    """The machine that hands what the first writes to the second; factors add up."""
    number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
    while todo:
        a, b = todo.pop()
        for symbol in alphabet:
            out = []
            for a2, between, x in first.step(a, symbol):
                for b2, written, y in second.step(b, between):
                    if (a2, b2) not in number:
                        number[a2, b2] = len(number)
                        todo.append((a2, b2))
                    out.append((number[a2, b2], written, x + y))
            arcs[number[a, b], symbol] = tuple(out)
    return Transducer(arcs, frozenset(n for (a, b), n in number.items() if a in first.finals and b in second.finals))


ALPHABET = ("insult", "threat", "target", "negation", "report")
MARKS = ("plain", "aimed", "negated", "reported")
_HITS = ("insult", "threat")


def _after(sign: str, mark: str) -> Transducer:
    """Marks every insult and threat that follows a sign in the clause."""
    arcs = {(state, sign): ((1, sign, 0.0),) for state in (0, 1)}
    for hit in _HITS:
        arcs |= {(0, hit): ((0, hit, 0.0),), (1, hit): ((1, f"{hit} {mark}", 0.0),)}
    return Transducer(arcs, frozenset((0, 1)))


def _aimed() -> Transducer:
    """Marks insults and threats as aimed if a target stands in the clause, before or after them, else as plain.

    States: no target yet, a target seen, a target promised, none may follow. The promise must be kept.
    """
    none, seen, promised, barred = range(4)
    arcs = {(state, "target"): ((seen, "target", 0.0),) for state in (none, seen, promised)}
    for hit in _HITS:
        aimed, plain = f"{hit} aimed", f"{hit} plain"
        arcs[none, hit] = ((promised, aimed, 0.0), (barred, plain, 0.0))
        arcs |= {(seen, hit): ((seen, aimed, 0.0),), (promised, hit): ((promised, aimed, 0.0),), (barred, hit): ((barred, plain, 0.0),)}
    return Transducer(arcs, frozenset((none, seen, barred)))


def _accepts(hit: str, factors: dict[str, float]) -> Transducer:
    """Weighs the marks of insults or of threats."""
    return Transducer({(0, f"{hit} {mark}"): ((0, f"{hit} {mark}", factor),) for mark, factor in factors.items()}, frozenset((0,)))


REPORTED, NEGATED, AIMED = _after("report", "reported"), _after("negation", "negated"), _aimed()
INSULTS = _accepts("insult", dict.fromkeys(MARKS, 1.0))
THREATS_ACCEPTED = _accepts("threat", {"plain": 0.0, "aimed": 1.0, "negated": 1.0, "reported": 1.0})  # a threat needs a target
CHAIN = (REPORTED, NEGATED, AIMED, INSULTS, THREATS_ACCEPTED)


def compose_all(chain: Sequence[Transducer]) -> Transducer:
    machine = chain[0]
    for following in chain[1:]:
        machine = compose(machine, following, ALPHABET)
    return machine


MACHINE = compose_all(CHAIN)


def accepted(machine: Transducer, symbols: Sequence[str]) -> list[tuple[str, float]]:
    """What the accepting path writes for each symbol, and its factor."""
    paths: dict[int, tuple | None] = {0: None}
    for symbol in symbols:
        ahead = {}
        for state, path in paths.items():
            for following, written, factor in machine.step(state, symbol):
                ahead[following] = (path, written, factor)
        paths = ahead
    path = next(p for state, p in paths.items() if state in machine.finals)
    out = []
    while path is not None:
        path, written, factor = path
        out.append((written, factor))
    return out[::-1]


SLOTS = {f"{hit} {mark}": k for k, (hit, mark) in enumerate((h, m) for h in _HITS for m in MARKS)}
OPEN = ("insult plain", "insult aimed")
FEATURES = len(SLOTS) + 3


class Grammar:
    """The lexicon as a transducer from words to symbols and weights, before the composed machine."""

    def __init__(self, entries: dict[str, float]):
        self.words = {e[1:-1]: w for e, w in entries.items() if e[-1] == "$"}
        self.begins = {e[1:]: w for e, w in entries.items() if e[-1] != "$"}
        self.lengths = sorted({len(b) for b in self.begins}, reverse=True)
        self.symbols: dict[str, int] = {}
        self.weights: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Of the entry for the whole word, else of its longest known beginning; 0 without one."""
        if word in self.words:
            return self.words[word]
        for n in self.lengths:
            if (w := self.begins.get(word[:n])) is not None and len(word) >= n:
                return w
        return 0.0

    def symbol(self, raw: str) -> int:
        """1 and on for the symbols of ALPHABET, 0 for other words, and whether the word ends a clause."""
        word = raw.strip(_STRIP)
        w = self.weight(word)
        kind = 2 if word in THREATS else 1 if w else 3 if word in TARGETS else 4 if word in NEGATIONS else 5 if word in REPORTS else 0
        if w:
            self.weights[raw] = w
        return kind | (_END if raw[-1] in _ENDS else 0)

    def features(self, text: str) -> list[float]:
        """Sums of accepted weights by kind and mark; distinct open insults, their density and whether there are any."""
        out = np.zeros(FEATURES)
        words = text.lower().split()
        if not words:
            return out.tolist()
        known = self.symbols
        if len(known) > 500_000:
            known.clear()
        new = set(words).difference(known)
        known.update((w, self.symbol(w)) for w in new)
        codes = np.fromiter(map(known.__getitem__, words), np.int8, len(words))
        kinds = codes & 7
        hits = np.flatnonzero((kinds == 1) | (kinds == 2))
        if not len(hits):
            return out.tolist()
        ends = np.flatnonzero(codes & _END)
        total, distinct = 0.0, set()
        for c in np.unique(np.searchsorted(ends, hits)).tolist():
            a = int(ends[c - 1]) + 1 if c else 0
            b = int(ends[c]) + 1 if c < len(ends) else len(words)
            at = (a + np.flatnonzero(kinds[a:b])).tolist()
            for i, (written, factor) in zip(at, accepted(MACHINE, [ALPHABET[kinds[i] - 1] for i in at]), strict=True):
                if factor:
                    weight = factor * self.weights.get(words[i], 1.0)
                    out[SLOTS[written]] += weight
                    if written in OPEN:
                        total += weight
                        distinct.add(words[i].strip(_STRIP))
        out[: len(SLOTS)] = np.log1p(out[: len(SLOTS)])
        out[-3:] = np.log1p(len(distinct)), np.log1p(100 * total / len(words)), float(total > 0)
        return out.tolist()


def _beginnings(text: str) -> set[str]:
    """What may become an entry: ^word$ and ^beginning."""
    words = {w.strip(_STRIP) for w in set(text.lower().split())}
    words = {w for w in words if w.isalpha() and len(w) >= 3}
    return {f"^{w}$" for w in words} | {f"^{w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def _kind(text: str) -> int:
    """Near copies mostly share it: the least hash among a text's words."""
    words = text.encode().split()
    return int(hash_words(words).min()) if words else 0


def choose_entries(rows: Iterator[tuple[str, int]]) -> dict[str, float]:
    """Entries and weights from (text, label), toxic texts first; one text at a time is in memory.

    Entries are taken by how many kinds of toxic texts they add to those found so far, each kind counting
    up to three times; of equal ones the longer beginning comes first.
    """
    groups: dict[str, set[int]] = defaultdict(set)
    other: Counter[str] = Counter()
    toxic_kinds: set[int] = set()
    clean = 0
    pruned, least = False, LEAST_TEXTS
    for text, label in rows:
        if label:
            k, found = _kind(text), _beginnings(text)
            toxic_kinds.add(k)
            for f in found:
                groups[f].add(k)
            continue
        if not pruned:
            least = max(LEAST_TEXTS, int(np.ceil(LEAST_SHARE * len(toxic_kinds))))
            groups = {f: g for f, g in groups.items() if len(g) >= least}
            pruned = True
        clean += 1
        words = {w.strip(_STRIP) for w in set(text.lower().split())}
        other.update({f for w in words for f in (f"^{w}$", *(f"^{w[:n]}" for n in BEGINNINGS if len(w) >= n)) if f in groups})
    n = len(toxic_kinds)
    odds = {f: float(np.log((len(g) + 0.5) / (n + 1)) - np.log((other[f] + 0.5) / (clean + 1))) for f, g in groups.items() if len(g) >= least}
    odds = {f: w for f, w in odds.items() if w >= LEAST_LOG_ODDS}
    kept: dict[str, float] = {}
    counted: Counter[int] = Counter()
    while odds:
        gain = {f: sum(counted[k] < 3 for k in groups[f]) * min(odds[f], 4.0) for f in odds}
        best = max(gain, key=lambda f: (gain[f], len(f), f))
        if sum(counted[k] < 3 for k in groups[best]) < least:
            break
        kept[best] = odds.pop(best)
        counted.update(groups[best])
        stem = best.strip("^$")
        odds = {f: w for f, w in odds.items() if not (best[-1] != "$" and f.startswith(best)) and not (f[-1] != "$" and stem.startswith(f[1:]))}
    return kept


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic) of at most ``most`` labelled documents; one that is labelled twice counts as toxic if one label says so.

    Of several texts of one doc_id the least counts, so the order and the partitions of rows change nothing.
    """
    named = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # ``most`` pairs of numbers: small enough to send
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    return rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "toxic", F.xxhash64("doc_id").alias("at"))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, scratch: Scratch | None = None) -> tuple[dict[str, float], list[float]]:
    """Entries and the curve's coefficients, from at most ``most`` labelled rows, which are written once and read twice.

    Without toxic or without other rows there is nothing to tell apart: no entries, and a curve that
    gives every text the share of toxic rows, smoothed.
    """
    sample = (scratch or Scratch(docs.sparkSession, "toxicity")).write(_sample(docs, labels, most), "sample")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((t, y) for b in pieces(batches, 8_000_000) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        found = choose_entries(rows)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.float64())], names=["entry", "weight"])

    # the bounded sample is read in one task, toxic texts first
    entries = {r.entry: r.weight for r in sample.coalesce(1).sortWithinPartitions(F.col("toxic").desc(), "at").select("text", "toxic").mapInArrow(learn, "entry string, weight double").collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(entries)
        for b in pieces(batches, 8_000_000):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([grammar.features(t) for t in b.column(1).to_pylist()], pa.list_(pa.float64())), b.column(2)], names=["at", "x", "toxic"])

    rows = sorted(sample.select("at", "text", "toxic").mapInArrow(measure, "at long, x array<double>, toxic int").collect())
    x = np.array([r.x for r in rows]).reshape(len(rows), FEATURES)
    return entries, curve(x, np.array([r.toxic for r in rows], float)).tolist()


def curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and coefficients of a logistic curve with a quadratic penalty, by Newton's method."""
    x = np.c_[np.ones(len(x)), x]
    beta = np.zeros(x.shape[1])
    beta[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if len(y) else -2.0
    if not 0 < y.sum() < len(y):
        return beta
    penalty = np.diag([1e-6] + [0.3] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score_texts(texts: list[str | None], grammar: Grammar, beta: np.ndarray) -> np.ndarray:
    x = np.array([grammar.features(t or "") for t in texts]).reshape(len(texts), FEATURES)
    return 1 / (1 + np.exp(-np.clip(beta[0] + x @ beta[1:], -30, 30)))


def scores(docs: DataFrame, entries: dict[str, float], beta: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs and ``toxicity`` (0 to 1), ``toxic`` (toxicity >= threshold).

    Every row is scored by its own text, so rows of equal text have equal scores, whatever their doc_id. A null or
    blank text gets the score of a text without any match. The two columns replace columns of their names in any case.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("toxicity", "toxic")])
    at = docs.columns.index("text")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["toxicity double", "toxic boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, b0 = Grammar(entries), np.array(beta)
        for b in pieces(batches, 8_000_000):
            p = score_texts(b.column(at).to_pylist(), grammar, b0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(p >= threshold)], names=[*b.schema.names, "toxicity", "toxic"])

    return docs.mapInArrow(run, schema)


def held_out() -> F.Column:
    """Rows kept from learning: crc32 of doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
