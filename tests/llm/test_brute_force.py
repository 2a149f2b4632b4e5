"""Operators that SQL cannot express, and the pipeline, against plain Python written apart from them."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from kbspark.llm import decontaminate, preference, queries, sentencepiece_viterbi as sp, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- op1 -------------------------------------------------------------------------------------
def judged(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, rule in queries.URL_RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


def test_urls_against_plain_rules(spark):
    rnd = random.Random(9)
    part = lambda xs: rnd.choice(xs)
    urls = [part(["http://", "https://", "HTTP://", "", "x:"]) + part(["www.", "a.b.", "", "WWW."]) + part(["example.com", "Example.COM", "b.net", "net", "com", "site.org", ""])
            + part(["/en/", "/en", "/fr/x", "/es/", "", "?q=/en/", "#/es/"]) + part(["", "a/b", "?u=http://c.net/es/", "é"]) for _ in range(400)]
    urls += [None, "", "://", "http://example.com/en/" + "y" * 200_000, "http://" + "a." * 30_000 + "net/fr/"]
    pages = spark.createDataFrame([(i, u, "n") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.id: r for r in url_filter.filter_urls(pages, queries.URL_RULES, queries.labelled_urls(pages)).collect()}
    for i, u in enumerate(urls):
        host, path, best = judged(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[1]), u
        assert got[i].verdict == best[0] if best else got[i].verdict in ("allow", "block")


# ---- op3 -------------------------------------------------------------------------------------
def test_preferences_against_plain_python(spark):
    rnd = random.Random(4)
    convs = {}
    for c in range(150):
        turns = [("user", rnd.choice(["q1", "q2", None, "q%d" % c]))]
        for _ in range(rnd.randint(0, 5)):
            turns.append((rnd.choice(["assistant", "assistant", "user", None]), rnd.choice(["yes", "no", "", None, "a longer answer"])))
        convs[c] = turns
    rows = [(c, i, r, t, "x", 0) for c, turns in convs.items() for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "q1", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string, chosen int")
    size = lambda turns: sum(len(t or "") for r, t in turns if r == "assistant")
    groups = defaultdict(list)
    for c, turns in convs.items():
        groups[turns[0]].append(c)
    pairs = {}
    for members in groups.values():
        best = min(members, key=lambda c: (-size(convs[c]), c))
        pairs.update({f"shared-{c}": (best, c, convs[best], convs[c]) for c in members if c != best})
    for c, turns in convs.items():
        at = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        if len(at) > 1:
            pairs[f"stale-{c}"] = (c, c, turns[:at[-1] + 1], turns[:at[-1]] + [turns[at[-2]]])

    def side(turns):
        text, spans = "", []
        for r, t in turns:
            head = f"<|{r or ''}|>\n"
            if r == "assistant":
                spans.append((len(text) + len(head), len(text) + len(head) + len(t or "") + len("<|end|>\n")))
            text += head + (t or "") + "<|end|>\n"
        return text, spans

    want = {}
    for key, (a, b, x, y) in pairs.items():
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        (xt, xs), (yt, ys) = side(x[n:]), side(y[n:])
        want[key] = (a, b, n, side(x[:n])[0], xt, xs, yt, ys, bool(xs and ys))
    got = {r.pair_id: (r.chosen_id, r.rejected_id, r.n_prompt_turns, r.prompt, r.chosen_text, [tuple(s) for s in r.chosen_mask], r.rejected_text,
                       [tuple(s) for s in r.rejected_mask], r.usable) for r in preference.format_pairs(preference.preference_pairs(df)).collect()}
    assert got == want and len(want) > 100
    assert preference.format_pairs(preference.preference_pairs(df.limit(0))).count() == 0


# ---- op4 -------------------------------------------------------------------------------------
def plain_tiles(doc, item, least):
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and free_d[p + n] and free_i[q + n] and doc[p + n] == item[q + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return sorted(tiles)
        p, q, n = best
        free_d[p:p + n] = free_i[q:q + n] = [False] * n
        tiles.append(best)


def test_tiles_against_plain_search():
    rnd = random.Random(6)
    for _ in range(60):
        item = rnd.sample(range(10 ** 6), rnd.randint(4, 50))
        cuts = sorted(rnd.sample(range(len(item)), min(len(item), rnd.randint(1, 5))))
        passages = [item[a:b] for a, b in zip([0, *cuts], [*cuts, len(item)])]
        rnd.shuffle(passages)
        doc = []
        for x in passages:
            doc += x + [10 ** 7 + rnd.randrange(10 ** 6) for _ in range(rnd.randint(0, 6))]
        a, b = (np.array(x, np.uint64) for x in (doc, item))
        assert decontaminate.greedy_tiles(a, b, 4) == plain_tiles(doc, item, 4)


def test_long_and_tied_texts(spark):
    item = " ".join(f"q{i}" for i in range(40))
    rows = [(1, "z " * 50_000 + item), (2, item + " " + item), (3, "la " * 3000), (4, "x" * 100_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(7, item, 0), (8, "la " * 60, 0), (7, item, 0)], "item_id long, text string, doc_id long")
    got = Counter((r.id, r.item_id, r.coverage) for r in decontaminate.contaminated(df, bench).collect())
    assert got == Counter({(1, 7, 1.0): 2, (2, 7, 1.0): 2, (3, 8, 1.0): 1})


# ---- op10 ------------------------------------------------------------------------------------
def plain_viterbi(text, model):
    """Best score and ids over the whole text at once."""
    if not text:
        return 0.0, []
    marked = "▁" + text.replace("▁", "\udfff").replace(" ", "▁")
    best = [(0.0, [])] + [None] * len(marked)
    for j in range(1, len(marked) + 1):
        char = "▁" if marked[j - 1] == "\udfff" else marked[j - 1]
        top = (best[j - 1][0] + model.unknown, best[j - 1][1] + [model.byte[b] for b in char.encode()])
        found = None
        for i in range(max(0, j - model.longest), j):
            hit = model.piece.get(marked[i:j])
            if hit and (found is None or best[i][0] + hit[1] > found[0]):
                found = (best[i][0] + hit[1], best[i][1] + [hit[0]])
        best[j] = found if found and found[0] >= top[0] else top
    return best[-1]


def test_pieces_against_a_search_of_whole_texts():
    model = sp.Model(public_tokenizers.path(queries.PIECES))
    rnd = random.Random(8)
    alphabet = ["the", "ing", " ", "  ", "straße", "▁", "😀", "\n", "x", "Que", "é", "12", ".", "\t"]
    texts = ["", " ", "▁", "a", "the cats sat on the mat"] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    flat, at, score = sp.encode_texts(pa.array(texts), model)
    for i, t in enumerate(texts):
        want, ids = plain_viterbi(t, model)
        got = flat[at[i]:at[i + 1]].tolist()
        # a character apart: sums are added up in another order, so ties may fall differently
        assert abs(score[i] - want) < 1e-3 and sp.decode_ids(np.array(got, np.uint32), np.array([0, len(got)]), model)[0].decode() == t
        assert abs(sum(model.piece[p][1] for p in pieces(got, model)) + model.unknown * unknowns(t, got, model) - want) < 1e-3
        assert got == ids or abs(score[i] - want) < 1e-4


def pieces(ids, model):
    names = {i: p for p, (i, _) in model.piece.items()}
    return [names[i] for i in ids if not model.is_byte[i]]


def unknowns(text, ids, model):
    raw = bytes(model.raw[i][0] for i in ids if model.is_byte[i])
    return len(raw.decode())


# ---- pipeline --------------------------------------------------------------------------------
def good(t):
    w = WORD.findall(t or "")
    runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    n, chars, symbols = len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>")
    letters = sum(bool(regex.search(r"\p{L}", x)) for x in w)
    upper = sum(bool(regex.search(r"\p{Lu}", x)) and not regex.search(r"\p{Ll}", x) for x in w)
    return not (n < 20 or 100 * len(covered) > 30 * n or 10 * symbols > n or chars < 2 * n or chars > 15 * n or 2 * (len(lines) - len(set(lines))) > len(lines)
                or 10 * letters < 7 * n or 2 * upper > n or (5 * len(set(w)) < n and len(set(w)) < 1000))


def test_pipeline_against_plain_python(spark, tmp_path):
    rnd = random.Random(12)
    make = lambda n: " ".join("w%s" % rnd.randrange(10 ** 5) for _ in range(n))
    passage, item = make(45), make(30)
    base = make(120)
    near = base.split(" ")
    near[60] = "changed"
    texts = [base, " ".join(near), base.upper(), make(80) + "\n" + passage, passage + " " + make(70), make(90), "too short", None, "", "# " * 40,
             make(40) + " " + item + " " + make(40), make(20) + " " + " ".join(item.split(" ")[15:]) + " x " + " ".join(item.split(" ")[:15]), "la " * 60,
             make(60) + " été straße 😀", make(50) + " " + passage]
    ids = list(range(10, 10 + len(texts)))
    rnd.shuffle(ids)
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "short")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {i: t for i, t in zip(ids, texts) if good(t)}
    grams = {i: Counter(tuple(t.lower().split()[k:k + 5]) for k in range(len(t.split()) - 4)) for i, t in kept.items()}
    root = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and (grams[a] & grams[b]).total() >= 0.8 * (grams[a] | grams[b]).total():
                x, y = sorted((root[a], root[b]))
                root = {k: x if v == y else v for k, v in root.items()}
    kept = {i: t for i, t in kept.items() if root[i] == i}
    words = {i: WORD.findall(t) for i, t in kept.items()}
    seen = Counter(tuple(w[k:k + 35]) for w in words.values() for k in range(len(w) - 34))
    left = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(35)}
        left[i] = [x for k, x in enumerate(w) if k not in gone]
    token = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())
    clean = {i for i, w in left.items() if sum(n for *_, n in plain_tiles(token(" ".join(w)), token(item), 4)) < 0.5 * 30}
    model = sp.Model(public_tokenizers.path(queries.PIECES))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == clean and len(clean) >= 5 and len(left) > len(clean)
    for i, r in got.items():
        ids = np.frombuffer(r.ids, "<u4")
        text = sp.decode_ids(ids, np.array([0, len(ids)]), model)[0].decode()
        assert WORD.findall(text) == left[i] and r.round_trip and r.n_pieces == len(ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.count("*")).first()[0] == 0
