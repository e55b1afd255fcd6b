"""Operators against brute force on small tables with nulls, empty, very long and repeated texts."""

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import bpe, chat, components, decontamination, fingerprints, jaccard, kernels, partitions, substrings, suffix_parts, suffix_tree, token_files, toxicity, url_filters
from tidewater.llm.queries import PATTERN, RANKS, WORD_BPE
from tidewater.llm.scratch import Scratch

DOCS = "doc_id long, text string, lang string, h long, seed string, found string, n_chars long"


def _words(rnd, n, most=40):
    return " ".join(f"w{rnd.randrange(most)}" for _ in range(n))


def _texts(seed=1, n=60):
    """Random texts, copies, near copies, shared passages, and the odd ones."""
    rnd = random.Random(seed)
    passage = _words(rnd, 70, 500)
    out = [None, "", "  \n\t ", "one", "One  two", "é x   y", "x " * 3000, passage, passage]
    for _ in range(n):
        t = _words(rnd, rnd.randrange(1, 200), 600)
        kind = rnd.randrange(5)
        if kind == 0 and len(out) > 9:
            words = (rnd.choice(out) or "a b").split() or ["z"]
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(len(words))] = f"q{rnd.randrange(99)}"
            t = " ".join(words)
        elif kind == 1:
            t += " " + passage[rnd.randrange(100) :] + " tail " + t
        elif kind == 2:
            t = rnd.choice(out)
        out.append(t)
    return out


def _docs(spark, texts, ids=None):
    rows = [(i, t, "en", 7, "s", "f", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def texts():
    return _texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return _docs(spark, texts).cache()


def _empty(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 ------------------------------------------------------------------------------------------------


def _kept(rows, w):
    first = {}
    for i, t in rows:
        words = (t or "").encode().split()
        if i is not None:
            for p in range(len(words) - w + 1):
                k = tuple(words[p : p + w])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for p in range(len(words) - w + 1):
            if i is not None and first[tuple(words[p : p + w])] < i:
                gone[p : p + w] = [True] * w
        kept = b" ".join(x for x, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("w", [1, 2, 5, 50])
def test_substrings(spark, docs, texts, w):
    got = substrings.kept_words(docs, w).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == _kept(list(enumerate(texts)), w)
    back = {r.doc_id: r for r in substrings.without_repeats(docs, w).collect()}
    assert len(back) == len(texts) and back[0].text is None and back[3].h == 7
    for r in got:
        assert back[r.doc_id].text == r.kept_text


def test_substrings_null_and_equal_ids(spark):
    p = _words(random.Random(5), 60, 900)
    rows = [(None, p), (3, p), (3, p + " more"), (1, "x " + p), (2, None), (None, p)]
    got = substrings.kept_words(_docs(spark, [t for _, t in rows], [i for i, _ in rows]), 50).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=str) == _kept(rows, 50)
    assert substrings.kept_words(_empty(spark)).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------


def test_packing_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype("<u4")
        control, data = token_files.pack(v)
        assert len(control) == -(-n // 4)
        assert token_files.unpack(control, data, n).tolist() == v.tolist()


def test_token_files(spark, docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD_BPE)
    got = {r.doc_id: r for r in token_files.token_files(docs, WORD_BPE, 1, 49_408).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.token_files(_empty(spark), WORD_BPE, 1, 49_408).count() == 0
    odd = token_files.token_files(_docs(spark, ["a", "b", "a", None], [2, None, 2, 1]), WORD_BPE, 1, 49_408).orderBy("start").collect()
    assert [r.doc_id for r in odd] == [1, 2, 2, None]


def test_small_shards_keep_the_order(spark, docs, texts):
    scratch = Scratch(spark, "shards")
    encoded = scratch.write(token_files.encode(docs, WORD_BPE, 1), "encoded")
    totals = token_files.write(encoded, scratch.path("files"), 49_408, shard=50)
    rows = token_files.read(spark, scratch.path("files"), totals, lambda ids: ids.astype("<u4").tobytes(), __import__("pyarrow").binary()).orderBy("start").collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(WORD_BPE), random.Random(3)
    w = token_files.Words(WORD_BPE)
    some = ["".join(rnd.choice("abZ  \n\t'.,sé中\x1c\x85 0!!<|end́ ΣİÉ") for _ in range(rnd.randrange(40))) for _ in range(2000)] + ["<|endoftext|>", "a<|ENDOFTEXT|>.", "<|startoftext|>,x"]
    for text, ids in zip(some, w.encode([x.encode() for x in some])):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


class _Counting:
    """A tokenizer that counts the calls made to it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def __getattr__(self, name):
        found = getattr(self.tokenizer, name)
        if not callable(found):
            return found
        self.calls += 1
        return found


def test_new_words_take_few_calls_of_the_tokenizer():
    rnd = random.Random(5)
    some = list({"".join(rnd.choice("aeiouäéñlrstnÅŒ") for _ in range(9)) + rnd.choice(["", ".", "!?", "***"]) for _ in range(5000)})
    w = token_files.Words(WORD_BPE)
    w.tokenizer = _Counting(w.tokenizer)
    ids = w.encode([" ".join(some[:2500]).encode(), " ".join(some[2500:]).encode()])
    assert w.tokenizer.calls <= 20
    t = w.tokenizer.tokenizer
    for text, found in zip((some[:2500], some[2500:]), ids):
        assert np.frombuffer(found, "<u4").tolist() == t.encode(" ".join(text), add_special_tokens=False).ids


@pytest.mark.parametrize("how", ["usual", "no ends of words", "no folds", "small groups, little kept"])
def test_words_of_letters_equal_whole_texts(how, monkeypatch):
    from tokenizers import Tokenizer

    t, rnd = Tokenizer.from_file(WORD_BPE), random.Random(4)
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    some = [f"{c} {c}. a{c}b! {c}'s {c}'{c} .{c} {c}\u0301 {c}1 _{c}_" for c in letters]
    some += [" ".join("".join(rnd.choices(letters, k=rnd.randrange(4))) + "".join(rnd.choices(marks, k=rnd.randrange(3))) for _ in range(30)) for _ in range(300)]
    some += ["", " ", "a\u0328 क़. Å! ﬁ. İ. i̇. \xa0 \u3000 x\u3000y", "A<|endoftext|> <|startoftext|>!"]
    if how.startswith("small"):
        monkeypatch.setattr(token_files, "GROUP", 7)
        monkeypatch.setattr(token_files, "KEPT_WORDS", 5)
        monkeypatch.setattr(token_files, "LONG", 20)
    w = token_files.Words(WORD_BPE, folds=how != "no folds")
    if how.startswith("no ends"):
        w.last[:] = False
    found = [x for k in range(0, len(some), 100) for x in w.encode([x.encode() for x in some[k : k + 100]])]
    for text, ids in zip(some, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    assert w.encode([]) == [] and w.encode([b"", b" "]) == [b"", b""]


# -- 3 ------------------------------------------------------------------------------------------------


def _labelled(spark, n=400):
    rnd = random.Random(9)
    bad = ["vilk" + "".join(rnd.choice("aeiou") for _ in range(k)) for k in (1, 2, 3)] + ["snarg"]
    texts, labels = [], []
    for _ in range(n):
        words = [f"w{rnd.randrange(300)}".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(rnd.randrange(20, 80))]
        y = int(rnd.random() < 0.2)
        for _ in range(rnd.randrange(2, 5) if y else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(bad) + rnd.choice(["", ",", "."]))
        texts.append(" ".join(words))
        labels.append(y)
    return texts, labels


def test_toxicity_is_learned(spark):
    texts, y = _labelled(spark)
    docs = _docs(spark, [*texts, None, "", "you vilkaeioaei!", "w" * 200_000])
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)] + [(None, 1, 0), (5, None, 0), (9999, 1, 0)], "doc_id long, toxic int, quality int")
    entries, beta = toxicity.fit(docs, labels.where("doc_id % 2 = 0 OR doc_id IS NULL"))
    got = {r.doc_id: r for r in toxicity.scores(docs.withColumn("toxic", F.lit("clash")), entries, beta).collect()}
    odd = [i for i in range(len(y)) if i % 2]
    assert sum(got[i].toxic == bool(y[i]) for i in odd) / len(odd) > 0.97
    assert got[len(y)].toxicity == got[len(y) + 1].toxicity < 0.7 and got[len(y) + 2].toxicity > got[len(y)].toxicity
    assert all(0 <= r.toxicity <= 1 for r in got.values()) and len(got) == len(y) + 4


def test_toxicity_without_labels(spark):
    docs = _docs(spark, ["a b", None])
    entries, beta = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not entries and [r.toxic for r in toxicity.scores(docs, entries, beta).collect()] == [False, False]
    assert toxicity.scores(_empty(spark), entries, beta).count() == 0


def test_grammar_marks_clauses():
    g = toxicity.Grammar({"^snarg$": 3.0, "^vilk": 2.0})
    mark = {}
    for text, name in (("such a snarg", "plain"), ("you vilkaa", "aimed"), ("he said snarg", "reported"), ("you are not a snarg", "negated"), ("no. snarg", "plain"), ("snargs", None), ("they kill you", None)):
        f = np.array(g.features(text))
        mark[text] = (toxicity.MARKS[int(f[:4].argmax())] if f[:4].any() else None) == name
    assert all(mark.values()), mark
    assert np.array(g.features("they kill you"))[4:8].any() and not np.array(g.features("to kill time"))[4:8].any()
    f = np.array(g.features("you are not a snarg. he said vilkaa"))
    assert f[2:4].all() and not f[-3:].any()  # negated and reported insults are no open ones


def test_composition_equals_the_chain_of_transducers():
    def chain(symbols):
        """Every path through every machine, one machine after another; what the accepting ones write."""
        rows = [[(s, 0.0) for s in symbols]]
        for machine in toxicity.CHAIN:
            out = []
            for row in rows:
                paths = [(0, [])]
                for symbol, factor in row:
                    paths = [(n, [*done, (written, factor + f)]) for state, done in paths for n, written, f in machine.step(state, symbol)]
                out += [done for state, done in paths if state in machine.finals]
            rows = out
        return rows

    rnd = random.Random(5)
    for n in range(9):
        for _ in range(60):
            symbols = [rnd.choice(toxicity.ALPHABET) for _ in range(n)]
            want = chain(symbols)
            assert len(want) == 1 and toxicity.accepted(toxicity.MACHINE, symbols) == want[0], symbols
    many = ["insult", "target"] * 20_000
    assert len(toxicity.accepted(toxicity.MACHINE, many)) == len(many)


def test_toxicity_does_not_depend_on_partitions(spark):
    texts, y = _labelled(spark, 200)
    ids = [*range(len(texts)), *range(60)]
    docs = _docs(spark, [*texts, *[t + " other" for t in texts[1:61]]], ids)
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    got = [toxicity.fit(docs.repartition(n, F.rand(n)), labels) for n in (1, 3, 7)]
    assert got[0] == got[1] == got[2] and got[0][0]


# -- 4 ------------------------------------------------------------------------------------------------


def _components(texts, n, p, ids=None):
    ids = ids or list(range(len(texts)))
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in itertools.combinations(range(len(ids)), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= p * len(x | y):
            i, j = find(ids[a]), find(ids[b])
            up[max(i, j)] = min(i, j)
    return sorted((i, len(s), find(i)) for i, s in zip(ids, sets))


@pytest.mark.parametrize("n, p", [(3, 90), (5, 80), (1, 50), (2, 70)])
def test_jaccard(spark, docs, texts, n, p):
    got = jaccard.similar_documents(docs, n, p, 100).collect()
    want = _components(texts, n, p)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = sorted(r.doc_id for r in jaccard.one_of_each(docs, n, p, 100).collect())
    assert kept == [i for i, _, c in want if i == c]


def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rnd.randrange(9)):
            w[rnd.randrange(len(w))] = f"n{rnd.randrange(50)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    for p in (80, 90):
        got = jaccard.similar_documents(_docs(spark, texts), 3, p, 100).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(texts, 3, p)


def test_jaccard_odd_rows(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (2, "A b c d"), (7, ""), (8, ""), (9, None), (4, "a b c d")]
    got = jaccard.similar_documents(_docs(spark, [t for _, t in rows], [i for i, _ in rows]), 3, 90, 100).collect()
    assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == sorted([(None, None), (4, 2), (2, 2), (7, 7), (8, 8), (9, 9), (4, 2)], key=str)
    assert jaccard.similar_documents(_empty(spark)).count() == 0


@pytest.mark.parametrize("block", [1, 4, 1024])
def test_jaccard_of_lone_sets_that_share_passages(spark, monkeypatch, block):
    rnd = random.Random(8)
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(3)]
    texts = []
    for k in range(70):
        own = [f"o{k % 50}y{i}" for i in range(rnd.randrange(5, 60))] if k < 50 else texts[rnd.randrange(50)].split()
        if k < 50:
            for x in rnd.sample(passages, rnd.randrange(1, 4)):
                own = x + own
        elif rnd.random() < 0.8:
            own[rnd.randrange(len(own))] = f"z{k}"
        texts.append(" ".join(own))
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.similar_documents(_docs(spark, texts), 2, 70, 100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _components(texts, 2, 70)


def test_signatures_refuse_no_linked_pair():
    rng = np.random.default_rng(3)
    for _ in range(500):
        a = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 900))).astype(np.uint64))
        b = np.unique(np.r_[a[rng.random(len(a)) < rng.random()], rng.integers(0, 2**63, int(rng.integers(1, 300))).astype(np.uint64)])
        x, y = (np.frombuffer(jaccard.signature(s), np.uint64)[None, :] for s in (a, b))
        assert jaccard.differences(x, y)[0] <= len(np.setxor1d(a, b))
        assert jaccard.differences(x, x)[0] == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_jaccard_with_a_repeated_doc_id(spark, partitions):
    a, b, c = ([f"{x}{i}" for i in range(40)] for x in "abc")
    near = lambda t, k: " ".join([*t[:k], "other", *t[k + 1 :]])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, 0)), (3, near(b, 39)), (5, " ".join(c)), (4, near(c, 0)), (4, None), (1, ""), (None, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = sorted([(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(docs, 3, 90, 100).collect()], key=str)
    assert got == sorted([(1, 38, 1), (1, 38, 1), (2, 38, 1), (3, 38, 1), (5, 38, 4), (4, 38, 4), (4, 0, 4), (1, 0, 1), (None, 38, None)], key=str)


def test_clashing_names_of_filters(spark, docs, texts):
    odd = docs
    for name in ("gone", "GONE_", "__gone", "__copies", "copies", "node", "of", "start"):
        odd = odd.withColumn(name, F.lit("x"))
    bench = spark.createDataFrame([(1, texts[9])], "item_id long, text string")
    for df in (jaccard.one_of_each(odd, 3, 90, 100), substrings.without_repeats(odd, 50), decontamination.without_leaks(odd, bench)):
        assert df.columns == odd.columns and df.count() > 0 and df.where("gone <> 'x' OR __copies <> 'x'").count() == 0


@pytest.mark.parametrize("p", [30, 50, 80, 90])
def test_linked_sets_share_a_key(p):
    rng = np.random.default_rng(p)
    for _ in range(300):
        base = rng.integers(0, 2**63, int(rng.integers(1, 150))).astype(np.uint64)
        a, b = np.unique(base), np.unique(np.r_[base[int(rng.integers(0, 4)) :], rng.integers(0, 2**63, int(rng.integers(0, 20))).astype(np.uint64)])
        if len(b) and partitions.linked(a, b, p, 100) and a.tobytes() != b.tobytes():
            assert np.intersect1d(partitions.set_keys(a, p, 100), partitions.set_keys(b, p, 100)).size


def test_components(spark):
    rnd = random.Random(2)
    links = [(k, k + 1) for k in range(100, 140)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(25)] + [(5, 5)]
    up = {x: x for e in links for x in e}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(links, "u long, v long"), Scratch(spark, "t")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for a, b in links for x in (a, b) if a != b or find(x) != x}
    assert components.components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t")).count() == 0


# -- 5 ------------------------------------------------------------------------------------------------


def test_leaks(spark):
    rnd = random.Random(6)
    items = [_words(rnd, n, 5000) for n in (30, 14, 50, 9, 8, 3)] + [None, ""]
    bench = spark.createDataFrame([(100 + i, t, "x") for i, t in enumerate(items)] + [(None, items[0], "x")], "item_id long, text string, doc_id string")
    swap = lambda t, k: " ".join(f"zz{i}" if i % k == 1 else w for i, w in enumerate(t.split()))
    texts = ["pre " + items[0] + ", post", items[0].upper(), swap(items[0], 7), swap(items[0], 2), _words(rnd, 500, 5000), None, "", items[1] + " " + items[2], items[3], items[4], items[5], " ".join(items[2].split()[:25]), " ".join(items[2].split()[:12])]
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(_docs(spark, texts), bench).collect()}

    def brute(text, item):
        a, b = decontamination.tokens(text), decontamination.tokens(item)
        return len(b) >= 9 and any(decontamination.overlap(a, b, d) for d in range(-len(b), len(a)))

    want = {(i, 100 + k) for i, t in enumerate(texts) for k, x in enumerate(items) if brute(t, x)}
    assert got == want and {(0, 100), (1, 100), (2, 100), (7, 101), (7, 102), (8, 103), (11, 102)} == want
    clean = {r.doc_id for r in decontamination.without_leaks(_docs(spark, texts), bench).collect()}
    assert clean == set(range(len(texts))) - {i for i, _ in want}
    assert decontamination.leaks(_empty(spark), bench).count() == 0
    assert decontamination.without_leaks(_docs(spark, texts), bench.limit(0)).count() == len(texts)


def test_every_substitution_within_the_share_is_seeded():
    word = np.arange(1, 21, dtype=np.uint64)
    for n in range(decontamination.LEAST_TOKENS, 21):
        item = word[:n]
        own = decontamination.seeds(item)
        most = n - math.ceil(decontamination.SHARE * n - 1e-9)
        changed = np.array(list(itertools.combinations(range(n), most)))
        found = np.zeros(len(changed), bool)
        differs = np.zeros((len(changed), n), bool)
        np.put_along_axis(differs, changed, True, axis=1)
        for mask, spans in zip(decontamination.MASKS, own):
            counts = np.array([c == "1" for c in mask])
            for at in range(len(spans)):
                found |= ~differs[:, at : at + len(mask)][:, counts].any(axis=1)
        assert found.all(), (n, changed[~found][:3])


def test_leaks_at_ends_and_edges(spark):
    rnd = random.Random(3)
    items = [_words(rnd, n, 5000).split() for n in (9, 10, 16, 20)]
    bench = spark.createDataFrame([(100 + i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    put = lambda t, *at: [f"zz{i}" if i in at else w for i, w in enumerate(t)]
    texts = [["pre", *put(items[0], 0), "post"], ["pre", *put(items[0], 8)], put(items[1], 2, 5), ["pre", *put(items[2], 0, 5, 10)]]
    texts += [items[2][1:] + ["and", "more"], ["so", *items[2][:13]], items[2][:12], items[0][1:], items[3][4:], items[3][5:]]
    got = {(r.doc_id, r.item_id): (r.start, r.n_compared, r.n_equal) for r in decontamination.leaks(_docs(spark, [" ".join(t) for t in texts]), bench).collect()}
    assert set(got) == {(0, 100), (1, 100), (2, 101), (3, 102), (4, 102), (5, 102), (7, 100), (8, 103)}
    assert got[4, 102] == (0, 15, 15) and got[5, 102] == (1, 13, 13) and got[8, 103] == (0, 16, 16) and got[3, 102] == (1, 16, 13)


def test_near_copies_unlike_their_hub_make_few_pairs(spark):
    """A group of near copies: at most one pair for each set comes first, and components that are known make no more."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(200)]
    rows, component = [], 10
    for doc in range(10, 90):
        s = np.unique(np.array([*base, *(rnd.getrandbits(63) for _ in range(4))], np.uint64))
        rows.append((1, 1, doc, len(s), component, bytearray(jaccard.signature(s))))
    members = spark.createDataFrame(rows, "g long, hub long, doc long, size long, component long, signature binary")
    near = jaccard._nearest(members, 80, 100).collect()
    assert sorted(r.doc for r in near) == list(range(11, 90)) and all(r.hub < r.doc for r in near)
    assert jaccard._grouped(members).isEmpty()
    apart = members.withColumn("component", F.when(F.col("doc") == 50, 50).otherwise(F.col("component")))
    groups = jaccard._grouped(apart)
    assert [(r.n, r.n_lone, r.largest) for r in groups.collect()] == [(80, 1, 10)]
    assert sorted((r.hub, r.doc) for r in jaccard._lone_pairs(apart, groups, 80, 100).collect()) == sorted((min(50, d), max(50, d)) for d in range(10, 90) if d != 50)


# -- 6 ------------------------------------------------------------------------------------------------


def test_suffix_tree(spark, monkeypatch):
    rnd = random.Random(8)
    chain = {w: rnd.sample(range(30), 3) for w in range(30)}
    texts = []
    for _ in range(200):
        w, out = rnd.randrange(30), []
        for _ in range(60):
            out.append(f"T{w}")
            w = rnd.choice(chain[w]) if rnd.random() < 0.9 else rnd.randrange(30)
        texts.append(" ".join(out))
    texts += [None, "", "never seen", "x " * 2000]
    docs = _docs(spark, texts).withColumn("held_out", F.col("doc_id") % 7 == 2)
    got = {r.doc_id: r for r in suffix_tree.score(docs).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in enumerate(texts)}
    c = collections.Counter(x for i, w in tokens.items() if i % 7 != 2 for x in w)
    total, distinct = sum(c.values()), len(c)
    base = own = 0.0
    for i, w in tokens.items():
        want = sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(w), sum(c[x] > 0 for x in w), total, i % 7 == 2)
        assert abs(got[i].base_score - want) < 1e-6 * max(1, -want)
        if i % 7 == 2 and i < 200:
            base, own = base + want, own + got[i].score
    assert own > 0.8 * base  # both negative: the contexts tell much of the next word


def test_suffix_tree_probabilities_sum_to_one(spark):
    rnd = random.Random(1)
    texts = [_words(rnd, 80, 12) for _ in range(60)]
    docs = _docs(spark, texts).withColumn("held_out", F.lit(False)).select("doc_id", "text", "held_out")
    model = suffix_tree.fit(docs, suffix_tree.word_counts(docs))
    for lead in ([], ["w1"], ["w1", "w2"], ["w3", "w1", "w2"]):
        total = 0.0
        for w in [f"w{k}" for k in range(12)] + ["unseen", None]:
            text = " ".join([*lead, *([w] if w else [])]).encode()
            _, _, _, p, _, _ = suffix_tree._local(model, [text])
            h, _ = suffix_tree.batch_tokens([text])
            symbols = suffix_tree.lookup(model.hashes, h)
            at = len(lead)
            q = (model.counts[symbols[at]] + 1 if symbols[at] >= 0 else 1) / (model.total + model.distinct + 1)
            for d, state in enumerate(suffix_tree.walk(model, symbols, int(suffix_tree.lookup(model.hashes, np.array([suffix_tree.END]))[0]), len(model.keys))):
                s = int(state[at])
                if s >= 0:
                    hit = int(suffix_tree.lookup(model.pairs[d], np.array([s * model.width + symbols[at]]))[0]) if symbols[at] >= 0 else -1
                    q = (model.share[d][hit] if hit >= 0 else 0) + model.rest[d][s] * q
            total += q
        assert abs(total - 1) < 1e-9


def _tree_by_hand(texts, held):
    """Scores of the texts in the whole tree, with nothing sent and nothing joined."""
    tokens = [[*(t or "").lower().split(), None] for t in texts]
    n = collections.Counter(tuple(w[i : i + k]) for w, out in zip(tokens, held) if not out for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    words = {s: c for s, c in n.items() if len(s) == 1}
    bottom = sum(words.values()) + len(words) + 1
    after = collections.defaultdict(dict)
    for s, c in n.items():
        if len(s) > 1 and c >= suffix_tree.PAIR_LEAST and n[s[:-1]] >= suffix_tree.CONTEXT_LEAST:
            after[s[:-1]][s[-1]] = c
    states = {}

    def p(context, w):
        if not context:
            return (n[(w,)] + 1) / bottom
        share, rest = states.get(context, ({}, 1.0))
        return share.get(w, 0.0) + rest * p(context[1:], w)

    for s in sorted(after, key=len):
        e = {w: p(s[1:], w) for w in after[s]}
        left = n[s] - sum(after[s].values())
        gain = sum(c * math.log(c / n[s] / e[w]) for w, c in after[s].items())
        gain += left * math.log(left / n[s] / min(1, max(1e-12, 1 - sum(e.values())))) if left else 0
        if gain >= suffix_tree.DIVERGENCE:
            whole = n[s] + len(after[s])
            states[s] = ({w: c / whole for w, c in after[s].items()}, (left + len(after[s])) / whole)
    score = [sum(math.log10(p(tuple(w[max(0, i - 3) : i]), x)) for i, x in enumerate(w)) for w in tokens]
    return score, states


@pytest.mark.parametrize("head", [None, 2e-5])
def test_suffix_tree_grows_with_the_corpus(spark, monkeypatch, head):
    """Contexts that make up less than any share of the tokens are states, and all strings count, sent or joined."""
    if head:
        monkeypatch.setattr(suffix_tree, "HEAD_SHARE", head)
    rnd = random.Random(5)
    lines = [_words(rnd, 8, 12) for _ in range(25)]
    texts = [" ".join(rnd.choice(lines) if rnd.random() < 0.7 else _words(rnd, 5) for _ in range(12)) for _ in range(69)]
    texts += ["x " * 2_000_000, None, "never seen w1 w2", *lines[:8]]
    held = [i % 7 == 2 or i > 71 for i in range(len(texts))]
    docs = _docs(spark, texts).withColumn("held_out", (F.col("doc_id") % 7 == 2) | (F.col("doc_id") > 71))
    want, states = _tree_by_hand(texts, held)
    assert {len(s) for s in states} == {1, 2, 3}
    rows = {r.doc_id: r for r in suffix_tree.score(docs).collect()}
    for i, r in rows.items():
        assert abs(r.score - want[i]) < 1e-6 * max(1, -want[i])
    assert sum(rows[i].score for i in range(72, 80)) > 0.6 * sum(rows[i].base_score for i in range(72, 80))


def test_suffix_tree_in_parts(spark, monkeypatch):
    """Many chunks and parts, and words so frequent that several parts have them, give the tree of the whole corpus."""
    monkeypatch.setattr(suffix_parts, "WINDOWS", 600)
    monkeypatch.setattr(suffix_parts, "CHUNK", 500)
    rnd = random.Random(9)
    lines = [_words(rnd, 8, 12) for _ in range(25)]
    texts = [" ".join(f"The {rnd.choice(lines)} the of" if rnd.random() < 0.7 else _words(rnd, 5) for _ in range(12)) for _ in range(69)]
    texts += ["x " * 5000, None, "", "never seen w1 the of", *lines[:8]]
    held = [i % 7 == 2 or i > 72 for i in range(len(texts))]
    docs = _docs(spark, texts).withColumn("held_out", (F.col("doc_id") % 7 == 2) | (F.col("doc_id") > 72))
    want, states = _tree_by_hand(texts, held)
    assert {len(s) for s in states} == {1, 2, 3} and ("the",) in states
    got = {r.doc_id: r.score for r in suffix_tree.score(docs).collect()}
    assert len(got) == len(texts)
    for i, score in got.items():
        assert abs(score - want[i]) < 1e-6 * max(1, -want[i])


def test_suffix_tree_shuffles_no_row_a_string(spark):
    """Strings travel in packed blocks: rows of all shuffles are far fewer than tokens, their bytes a few a token."""
    rnd = random.Random(10)
    docs = _docs(spark, [_words(rnd, 500, 3000) for _ in range(400)]).withColumn("held_out", F.col("doc_id") % 7 == 2)
    stages = lambda: {(s.stageId(), s.attemptId()): s for s in (lambda x: [x.apply(i) for i in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None))}
    before = stages()
    tokens = suffix_tree.score(docs).groupBy().sum("n_tokens").first()[0]
    new = [s for k, s in stages().items() if k not in before]
    assert tokens == 400 * 501
    assert 0 < sum(s.shuffleWriteRecords() for s in new) < tokens / 10
    assert sum(s.shuffleWriteBytes() for s in new) < 25 * tokens


def test_suffix_tree_odd_tables(spark):
    docs = _docs(spark, ["a b", None, "a"], [1, None, 1]).withColumn("held_out", F.lit(True))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in suffix_tree.score(docs).collect()) == [("1", 2, 0, 0, 0.0), ("1", 3, 0, 0, 0.0), ("None", 1, 0, 0, 0.0)]
    assert suffix_tree.score(_empty(spark).withColumn("held_out", F.lit(False))).count() == 0


# -- 7 ------------------------------------------------------------------------------------------------


def test_url_filters(spark, monkeypatch):
    events = spark.createDataFrame(
        [("block", "Bad.com", "2024-01-10", "add"), ("block", "bad.com", "2024-02-01", "remove"), ("block", "bad.com", "2024-03-01", "add"), ("allow", "bad.com/ok", "2024-01-01", "add"), ("block", "same.org", "2024-01-01", "add"), ("block", "same.org", "2024-01-01", "remove"), (None, "x.com", "2024-01-01", "add")],
        "list string, key string, at string, action string",
    ).withColumn("at", F.to_date("at"))
    rows = [(1, "http://www.BAD.com/x", "2024-01-09"), (2, "http://www.bad.com/x", "2024-01-10"), (3, "https://u:p@bad.com:80/ok/y?q#f", "2024-01-15"), (4, "http://bad.com/okay", "2024-01-15"), (5, "http://bad.com", "2024-02-01"), (6, "http://notbad.com", "2024-03-02"), (7, "http://bad.com./", "2024-03-02"), (8, None, "2024-03-02"), (9, "no url", "2024-03-02"), (10, "http://bad.com", None), (11, "http://same.org", "2024-01-01"), (2, "http://www.bad.com/x", "2024-01-10")]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_at string").withColumn("fetched_at", F.to_date("fetched_at")).withColumn("host", F.lit("clash")).withColumn("key", F.lit("k"))
    for sent in (100_000, 0):
        monkeypatch.setattr(url_filters, "SENT", sent)
        out = url_filters.verdicts(captures, events)
        got = sorted((r.page_id, r.blocked, r.n_active) for r in out.collect())
        assert got == [(1, False, 0), (2, True, 1), (2, True, 1), (3, False, 2), (4, True, 1), (5, False, 0), (6, False, 0), (7, True, 1), (8, False, 0), (9, False, 0), (10, False, 0), (11, False, 0)]
        assert "Python" not in out._jdf.queryExecution().toString() and {r.host for r in out.where("page_id = 7").collect()} == {"bad.com"}
    assert url_filters.verdicts(captures.limit(0), events).count() == 0 and url_filters.verdicts(captures, events.limit(0)).where("blocked").count() == 0


# -- 8 ------------------------------------------------------------------------------------------------


def test_byte_bpe(spark, docs, texts):
    import tiktoken

    table = bpe.Ranks(RANKS, PATTERN)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table.rank, special_tokens={})
    rnd = random.Random(1)
    some = ["".join(rnd.choice("ab  \n\t'sdtreé中\x1c\x85    0123!!==\U0001f600́᠎​﻿") for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["a" * 5000, " " * 5001, "=-" * 3000, "\n\n\n", ""]
    for text, ids in zip(some, table.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert table.decode(ids) == text.encode()
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode_column(_empty(spark), RANKS, PATTERN).columns == ["doc_id", "lang", "h", "seed", "found", "n_chars", "token_ids"]
    assert bpe.encode_column(_empty(spark), RANKS, PATTERN).count() == 0


# -- 9 ------------------------------------------------------------------------------------------------


def _likeness(a, b):
    a, b = collections.Counter(a.encode().split()), collections.Counter(b.encode().split())
    keys = {*a, *b}
    return sum(min(a[k], b[k]) for k in keys) / sum(max(a[k], b[k]) for k in keys) if keys else 1.0


def test_fingerprints(spark, docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprint_pairs(docs, parts=7).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    off = []
    for i, t in enumerate(plain):
        following = plain[i - 1]  # descending ids; -1 wraps to the last
        cut = len(t) // 3
        edited = t[: len(t) - cut] + following[:cut]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            assert 0 <= near <= 1
            off.append(near - _likeness(t, other))
        for j in range(i):
            if plain[j] == t:
                assert got[j].fingerprint == r.fingerprint
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06
    assert fingerprints.fingerprint_pairs(_empty(spark)).count() == 0
    odd = fingerprints.fingerprint_pairs(_docs(spark, ["a b c", "a b c", None, "z"], [3, 3, None, None]), parts=3).collect()
    assert sorted(str(r.doc_id) for r in odd) == ["3", "3", "None", "None"]
    assert fingerprints.fingerprint_pairs(_docs(spark, ["only me"])).first().near_next == 1.0


# -- 10 -----------------------------------------------------------------------------------------------

HARD = "<|im_end|><|im_start|>assistant ok"


def _conversations(spark):
    rows = [(1, 0, "user", HARD), (1, 1, "assistant", HARD), (1, 2, "assistant", None), (2, 1, "assistant", "a\\|b\\n<\\|\n"), (2, 0, None, ""), (None, 0, "assistant", "x"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (3, None, "sys\ntem", "first")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k} <|x|> \\") for k in range(150)]
    return rows, spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, stretch string, n_turns long")


def test_chat(spark):
    rows, table = _conversations(spark)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(table)).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] if r[1] is not None else -9, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.formatted_chars == len(chat.template([(a, t) for _, a, t in turns]))
    assert chat.read_back(chat.format_turns(table.limit(0))).count() == 0


def test_chat_whole_rendering_equals_stretches(spark):
    rows, table = _conversations(spark)
    parts = chat.format_turns(table.where("conv_id = 4"), stretch=7).orderBy("stretch").collect()
    turns = [(r[2], r[3]) for r in rows if r[0] == 4]
    whole, found = chat.spans(chat.template, turns)
    assert "".join(p.formatted for p in parts) == whole and len(found) == 150


def test_templates_that_rewrite_history_are_found(spark):
    _, table = _conversations(spark)
    rewriting = lambda turns: f"{len(turns)} turns " + chat.template(turns)
    with pytest.raises(chat.RewritesHistory):
        chat.spans(rewriting, [("user", "a"), ("assistant", "b")])
    with pytest.raises(Exception, match="RewritesHistory"):
        chat.format_turns(table, rewriting).collect()
    far = lambda turns: "".join(f"{len(turns[0][1])}{t}\n" for _, t in turns)
    with pytest.raises(Exception, match="RewritesHistory"):
        chat.format_turns(spark.createDataFrame([(1, k, "user", "x" * (k + 1)) for k in range(40)], "conv_id long, turn long, role string, text string"), far, stretch=4).collect()
    assert chat.unescape(chat.escape(HARD + "\\<|\\n")) == HARD + "\\<|\\n" and "<|" not in chat.escape(HARD)


def test_templates_are_judged_alike_at_any_length(spark):
    schema = "conv_id long, turn long, role string, text string"
    table = spark.createDataFrame([(1, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(100)], schema)
    last = lambda turns: "".join(f"{r}:{t}\n" for r, t in turns[-40:])
    with pytest.raises(Exception, match="RewritesHistory"):
        chat.format_turns(table, last).collect()
    numbered = lambda turns: "".join(f"{k}:{t}\n" for k, (_, t) in enumerate(turns))
    (r,) = chat.format_turns(table, numbered).collect()
    assert r.n_turns == 100 and r.formatted == numbered([("", f"t{k}") for k in range(100)])
    assert [r.formatted[s.a : s.b] for s in r.loss_spans] == [f"t{k}" for k in range(1, 100, 2)]


# -- kernels ------------------------------------------------------------------------------------------


def test_window_kernels():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 9, 200).astype(np.uint64)
    for n in (1, 2, 3, 13, 50, 200, 201):
        got = kernels.window_hashes(h, n)
        names = [tuple(h[i : i + n]) for i in range(len(h) - n + 1)]
        assert len(got) == max(0, len(h) - n + 1)
        assert len(set(got.tolist())) == len(set(names))
    for w in (1, 2, 7, 64):
        assert kernels.sliding_min(h, w).tolist() == [int(h[i : i + w].min()) for i in range(len(h) - w + 1)]
