"""Prefix trie, Merkle manifest and toxicity against brute force on small fixtures."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import merkle_manifest as mm, prefix_trie as pt, toxicity as tx

TURNS = "conv_id long, turn long, role string, text string, depth long, p long"


def conversations():
    rnd = random.Random(5)
    say = lambda: rnd.choice(["a", "b", "c", "été", "", "long text"])
    convs = {i: [(rnd.choice(["user", "assistant"]), say()) for _ in range(rnd.randint(1, 6))] for i in range(120)}
    shared = [("user", "t%d" % i) for i in range(11)]
    convs.update({200: shared, 201: shared, 202: shared[:6] + [("user", "own")], 203: shared[:8], 204: shared[:8] + shared[:9],
                  205: shared[:5], 206: shared[:4], 211: shared + shared, 305: shared[:3], 309: [("user", "only")], 1003: [("x", "y")],
                  500: [("user", str(i)) for i in range(40)], 501: [("user", str(i)) for i in range(8)] + [("user", "aside")] * 20})
    rows = [(c, i, r, t, 7, 7) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rows += [(400, None, "user", "first", 0, 0), (400, 0, None, "b", 0, 0), (400, 1, "user", None, 0, 0), (None, 0, "user", "lost", 0, 0)]
    rows += [(401, 0, "user", "again", 0, 0)] * 3
    return rows


def rebuild(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return Counter((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in m if len(convs[c]) == len(k)).encode()).hexdigest()) for k, m in members.items())


def nodes(df):
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(pt, "SEGMENT", 4)
    rows = conversations()
    turns = pt.turn_rows(spark.createDataFrame(rows, TURNS).repartition(5))
    want = trie(rebuild(rows))
    # small bounds: long conversations meet their rows by broadcast, digests come in pieces
    monkeypatch.setattr(pt, "PIECE_IDS", 2)
    monkeypatch.setattr(pt, "LONG", 3)
    monkeypatch.setattr(pt, "bounded_broadcast", lambda *a: None)
    assert nodes(pt.prefix_trie(*pt.rebuilt_turns(turns))) == want


def test_trie_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], TURNS)
    assert pt.prefix_trie(*pt.rebuilt_turns(pt.turn_rows(none))).count() == 0
    rows = [(c, i, "user", "same %d" % i, 0, 0) for c in range(500, 900) for i in range(9)]
    got = nodes(pt.prefix_trie(*pt.rebuilt_turns(pt.turn_rows(spark.createDataFrame(rows, TURNS)))))
    assert got == trie(rebuild(rows)) and len(got) == 10


DOCS = "doc_id long, source string, lang string, n_chars long, text string, id long, grp string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def documents():
    sizes = {"en": 700, None: 257, "de": 1, "": 256, "fr": 3, "été": 2}
    rows, k = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append((k, None if k % 11 == 0 else "s%d" % (k % 3), lang, None if k % 5 == 0 else k % 50, None if k % 13 == 0 else "tëxt %d" % k, 1, "g"))
            k += 1
    return rows + [rows[4]] * 3 + [(rows[4][0], "x", *rows[4][2:]), (None, "s", "en", 3, "no id", 1, "g")]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]])


def manifest(rows):
    def tree(row):
        levels = [row]
        while len(row) > 1:
            row = [h(*row[i:i + 2]) for i in range(0, len(row), 2)]
            levels.append(row)
        return levels

    def path(levels, i):
        return [(level[i >> d ^ 1] if i >> d ^ 1 < len(level) else None, (i >> d) & 1) for d, level in enumerate(levels[:-1])]

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = tree([leaf(r) for r in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = Counter()
    for j, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            steps = path(trees[g], i) + path(top, j)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            x = leaf((*r[:3], r[3] + 1, r[4])) if bad and r[3] is not None else leaf(r)
            for s, right in steps:
                x = h(x) if s is None else h(s, x) if right else h(x, s)
            out[(r[0], leaf(r), trees[g][-1][0], top[-1][0], h(*[s for s, _ in steps if s]), x)] += 1
    return out


def proofs(spark, rows):
    df = spark.createDataFrame(rows, DOCS).repartition(4)
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, mm.record_digest(FIELDS, {"n_chars": F.col("n_chars") + 1}))
    out = mm.proofs(mm.write_manifest(df, columns=FIELDS, claim=claim))
    return Counter((r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in out.collect())


def test_manifest(spark):
    rows = documents()
    assert proofs(spark, rows) == manifest(rows)
    assert proofs(spark, rows[:1]) == manifest(rows[:1]) and proofs(spark, []) == Counter()


def test_three_tiers(spark, monkeypatch):
    monkeypatch.setattr(mm, "BLOCK_LEVELS", 2)
    monkeypatch.setattr(mm, "_BLOCK", 4)
    rows = documents()[:90]
    assert proofs(spark, rows) == manifest(rows)


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 9])
def test_van_emde_boas_order(levels):
    at = {(d, i): int(mm.addresses(levels, d, [i])[0]) for d in range(levels) for i in range(1 << d)}
    assert sorted(at.values()) == list(range(2 ** levels - 1)) and at[0, 0] == 0
    if levels > 1:   # bottom trees are contiguous and follow the top tree
        top = levels // 2
        for i in range(1 << top):
            tree = [at[d, j] for d in range(top, levels) for j in range(i << (d - top), (i + 1) << (d - top))]
            assert max(tree) - min(tree) == len(tree) - 1
        assert max(at[d, i] for d in range(top) for i in range(1 << d)) == 2 ** top - 2


def test_gradients():
    model = tx.new_model(3, np.float64)
    words = ["idiot", "the", "a", "longerword"]
    windows = np.array([[1, 2, 4], [2, 3, 0], [3, 0, 0], [1, 4, 0]]).T
    label, weight = np.array([1.0, 0, 0, 1]), np.array([1.0, 2, 1, 0.5])
    _, grads = tx.loss_and_gradients(model, windows, words, label, weight)
    assert set(grads) == set(model)
    rng = np.random.default_rng(0)
    for name, value in model.items():
        touched = np.argwhere(grads[name] != 0)
        for at in rng.permutation(touched)[:6]:
            at, step, old = tuple(at), 1e-6, value[tuple(at)]
            value[at] = old + step
            up = tx.loss_and_gradients(model, windows, words, label, weight)[0]
            value[at] = old - step
            down = tx.loss_and_gradients(model, windows, words, label, weight)[0]
            value[at] = old
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-6, (name, at)


def test_windows_cover_every_word():
    counts = np.array([0, 1, 64, 65, 112, 113, 0, 500])
    doc, start, end = tx.cut_windows(counts)
    first = np.cumsum(counts) - counts
    for d, n in enumerate(counts):
        mine = [(s - first[d], e - first[d]) for k, s, e in zip(doc, start, end) if k == d]
        assert {i for s, e in mine for i in range(s, e)} == set(range(n)) and all(e - s <= 64 for s, e in mine)
        assert all(b[0] < a[1] for a, b in zip(mine, mine[1:])) and len(set(mine)) == len(mine)


def test_word_pieces():
    long = "".join(chr(97 + i % 26) for i in range(1000))
    pieces = tx.words_of("One " + long + " two")
    assert pieces[0] == "one" and pieces[-1] == "two" and max(map(len, pieces)) <= 24
    rebuilt = pieces[1]
    for p in pieces[2:-1]:
        rebuilt += p[8:]
    assert rebuilt == long


LABELS = "doc_id long, toxic int, quality int, text string"


def test_toxicity(spark):
    rnd = random.Random(2)
    bad, plain = ["idiot", "moron", "scum", "loser"], ["w%s" % "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts, toxic = [], []
    for i in range(600):
        words = [rnd.choice(plain) for _ in range(rnd.choice([5, 40, 200]))]
        toxic.append(i % 4 == 0)
        if toxic[-1]:
            for _ in range(2):
                words[rnd.randrange(len(words))] = rnd.choice(bad)
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    odd = [(1000, ""), (1001, None), (1002, "¡ !"), (None, texts[0]), (1003, "x" * 4000), (1004, " ".join(plain * 30) + " you idiot moron scum"), rows[1]]
    docs = spark.createDataFrame([(*r, "en", 0.5) for r in rows + odd], "doc_id long, text string, score_lang string, score double").repartition(3)
    labels = spark.createDataFrame([(i, int(toxic[i]), 0, "t") for i in range(400)] + [(None, 1, 0, "t"), (7, None, 0, "t")], LABELS)
    model = tx.fit_toxicity(docs, labels)
    got = tx.score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 for r in got)
    score = {r.id: r.score for r in got}
    assert sum((score[i] >= 0.7) == toxic[i] for i in range(400, 600)) >= 195
    assert score[1000] == score[1001] == score[1002] == model.share and score[1004] >= 0.7 and score[1003] < 0.7
    # batches do not matter: the same text scores alike wherever it stands
    assert np.allclose(tx.Scorer(model).score(texts[:50])[0], [score[i] for i in range(50)], atol=1e-5)
    again = tx.fit_toxicity(docs.repartition(5), labels)
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    nothing = tx.fit_toxicity(docs.limit(0), labels.limit(0))
    assert nothing.weights is None and {r.score for r in tx.score_documents(docs, nothing).collect()} == {0.0}
    assert tx.score_documents(docs.limit(0), model).count() == 0
