"""Training-data operators against brute force on small fixtures, with the odd rows that their
docstrings define: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from kbspark.llm import (decontaminate, lm_scoring, near_dedup, preference, quality_rules, queries, sentencepiece_viterbi as sp,
                         substring_dedup, token_rans, url_filter, warc)

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, n_words long, id long, batch string"


def texts():
    rnd = random.Random(7)
    vocab = ["w%d" % i for i in range(400)] + ["été", "straße", "Ünï", "😀"]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base, passage = make(200), make(60)
    near = base.split(" ")
    near[100] = "changed"
    return [base, base, " ".join(near), make(150), make(30) + "\n" + passage + "\t" + make(40), passage + " " + make(20), make(6) * 3,
            "", None, " \n ", "one two", "one two", "x" * 5000, make(3000), "a  b\u00a0c ▁d", passage + passage[::-1], ("la " * 90).strip()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 5, -1, "b") for i, t in enumerate(texts())]
    rows += [rows[3], (None, "no id here at all", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return re.findall(WORD, t or "")


def test_substrings(docs, none):
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    seen = Counter(tuple(w[i:i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = []
    for k, w in rows:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    for options in ({}, {"group_size": 2, "batch_bytes": 4000}):
        got = substring_dedup.repeated_words(docs, **options).collect()
        assert Counter((r.id, r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == Counter(want)
        assert all(words(r.text) == words(r.kept) for r in got)
    out = substring_dedup.substring_dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and out.where("doc_id = 8").first().text is None
    assert substring_dedup.substring_dedup(none).count() == 0


def test_near_duplicates(docs, none):
    got = {r.id: (r.class_id, r.copy_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got[0] == got[1] == (0, 0) and got[2] == (0, 2) and got[11] == (10, 10) and got[None] == (None, None)
    assert all(got[i][0] == i for i in (3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14))
    kept = near_dedup.near_dedup(docs)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [i for i in range(17) if i not in (1, 2, 11)]
    assert kept.columns == docs.columns and near_dedup.near_dedup(none).count() == 0
    other = docs.drop("id").withColumnRenamed("doc_id", "id")   # the key under the operator's own name
    assert near_dedup.near_dedup(other, id_col="id").count() == kept.count()


def test_dart_minhash_estimates_weighted_similarity():
    a, b = {i: 1.0 + i % 3 for i in range(60)}, {i: 1.0 + i % 2 for i in range(15, 75)}
    true = sum(min(a.get(i, 0), b.get(i, 0)) for i in range(75)) / sum(max(a.get(i, 0), b.get(i, 0)) for i in range(75))
    doc = np.repeat([0, 1], [len(a), len(b)])
    h = near_dedup.mix(np.array([*a, *b], np.uint64) + np.uint64(99))
    s = near_dedup.dart_minhash(doc, h, np.array([*a.values(), *b.values()]), 3, 2000)
    assert abs((s[0] == s[1]).mean() - true) < 0.05 and (s[:2] != 0).all() and (s[2] == 0).all()


def test_large_buckets_are_dealt_into_parts(spark):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rnd.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.class_id for r in near_dedup.near_duplicates(df, bucket=10).collect()} == {0}


def test_classes_equal_those_of_all_pairs(spark):
    """Families of drifting texts (each a few words from the one before): classes by brute force."""
    rnd = random.Random(3)
    rows, new = [], iter(range(10**6))
    for _ in range(6):
        line = [f"w{rnd.randrange(10**6)}" for _ in range(240)]
        for i in range(25):
            rows.append((len(rows), " ".join(line)))
            line = list(line)
            for _ in range(3 if i % 8 else 6):
                line[rnd.randrange(240)] = f"new{next(new)}"
    grams = [Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (t.split(" ") for _, t in rows)]
    least = list(range(len(rows)))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (grams[i] & grams[j]).total() >= 0.8 * (grams[i] | grams[j]).total():
                a, b = sorted((root(i), root(j)))
                least[b] = a
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    want = {i: root(i) for i in range(len(rows))}
    assert len(set(want.values())) > 6 and got == want


def test_pairs_at_the_threshold_are_found_in_their_first_band():
    """10,000 planted pairs just over 0.8 among texts of families: all that share a band are compared."""
    rnd = np.random.default_rng(5)
    n, size = 10_000, 60
    doc, gram = [], []
    for i in range(n):   # similarity 53 / 66 = 0.803
        own = rnd.integers(0, 2 ** 62, 73).astype(np.uint64)
        doc += [2 * i] * size + [2 * i + 1] * (size - 1)
        gram += [*own[:size], *own[:53], *own[size:size + 6]]
    sig = near_dedup.dart_minhash(np.array(doc), near_dedup.mix(np.array(gram, np.uint64)), np.ones(len(doc)), 2 * n, 100).reshape(2 * n, 20, 5)
    h = np.broadcast_to(near_dedup.mix(np.arange(1, 21, dtype=np.uint64)), (2 * n, 20))
    for r in range(5):
        h = near_dedup.combine(h, sig[:, :, r])
    sketch, keys = sig.reshape(2 * n, 100).astype(np.uint8), h.astype(np.uint32)
    a, b = slice(0, None, 2), slice(1, None, 2)
    shared = h[a] == h[b]
    least = (0.8 - near_dedup.SIGMAS * (0.16 / 100) ** 0.5) * 100
    found = shared.any(axis=1) & ((keys[a] == keys[b]).argmax(axis=1) == shared.argmax(axis=1)) & ((sketch[a] == sketch[b]).sum(axis=1) >= least)
    assert found.sum() >= n * 0.999 and (found | ~shared.any(axis=1)).sum() >= n - 1


def _templated(texts, planted):
    """Rows (id, text): ``texts`` of one template, each with words of its own at the end, 0.766 alike; and
    near copies of the first ``planted`` (0.808), which have the first 6 of those 30 words in common."""
    template = [f"t{i}" for i in range(200)]
    tails = [[f"own{i}x{j}" for j in range(30)] for i in range(texts)]
    tails += [tails[i][:6] + [f"copy{i}x{j}" for j in range(24)] for i in range(planted)]
    return [(i, " ".join(template + tail)) for i, tail in enumerate(tails)]


@pytest.mark.parametrize("options", [{}, {"bucket": 100, "block": 60}])
def test_near_copies_within_a_templated_family(spark, options):
    df = spark.createDataFrame(_templated(500, 50), "doc_id long, text string").repartition(4)
    got = {r.id: r.class_id for r in near_dedup.near_duplicates(df, **options).collect()}
    assert got == {i: i if i < 500 else i - 500 for i in range(550)}


def test_shared_grams_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(near_dedup, "GRAMS_AT_ONCE", 7)
    rnd = random.Random(8)
    sets = [np.array(sorted(rnd.sample(range(90), rnd.randrange(50))), np.uint64) for _ in range(30)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets[10:]] for a in sets[:12]]
    assert near_dedup.shared_grams(sets[:12], sets[10:]).tolist() == want


def test_tiling(spark, docs, none):
    rnd = random.Random(5)
    items = [(i, " ".join(f"q{rnd.randrange(10**6)}" for _ in range(40))) for i in range(5)] + [(None, None), (7, ""), (8, "too short")]
    a, b = items[1][1].split(" ")[:20], items[1][1].split(" ")[20:]
    rows = [(1, "see " + items[0][1].upper() + "!"), (2, " ".join(b) + " and " + ", ".join(a)), (3, " ".join(items[2][1].split(" ")[:10])), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 300):
        got = {(r.id, r.item_id): r for r in decontaminate.contaminated(df, bench, block_bytes=block).collect()}
        assert set(got) == {(1, 0), (2, 1)} and got[2, 1].coverage == 1.0 and sorted(t.length for t in got[2, 1].tiles) == [20, 20]
    assert {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()} == {3, 4, 5}
    assert decontaminate.decontaminate(docs, bench).count() == docs.count() and decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == 5


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality_rules.cascade(docs).collect()}
    for k, r in got.items():
        t = next(x.text for x in docs.collect() if x.doc_id == k) or ""
        w = words(t)
        runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)), k
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
    kept = quality_rules.keep_good(docs)
    assert sorted(kept.columns) == sorted(docs.columns) and {0, 3} <= {r.doc_id for r in kept.collect()}
    assert quality_rules.keep_good(none).count() == 0


def test_backoff_scores(docs, none):
    assert lm_scoring.score(none).count() == 0
    got = {r.id: r for r in lm_scoring.score(docs, order=3, batch_bytes=5000).collect()}
    assert got[8].n_words == 0 and got[8].mean_log is None and got[12].n_unseen == 1
    assert got[0].mean_log > got[13].mean_log   # a text with copies is no surprise


def test_pieces_round_trip(spark, docs, none):
    path = public_tokenizers.path(queries.PIECES)
    out = sp.encode(docs, path)
    assert all(r.round_trip for r in out.collect()) and sp.encode(none, path).count() == 0
    back = {r.id: r.text for r in sp.decode(out, path).collect()}
    assert all(back[i] == t for i, t in enumerate(texts()))
    model = sp.Model(path)
    for t in ["the cats sat", "  x\ny ▁ z", "straße 😀"]:   # whole text in one search, nothing shared
        whole, score = sp.viterbi_words([sp._marked(t.encode(), True)], model)
        flat, at, s = sp.encode_texts(pa.array([t]), model)
        assert flat.tolist() == whole[0] and s[0] == score[0]


def test_token_files(spark, docs, none, tmp_path):
    path, tok = f"{tmp_path}/t", public_tokenizers.path(queries.TOKENIZER)
    token_rans.write_tokens(none, f"{tmp_path}/none", tok, 2)
    assert token_rans.read_tokens(spark, f"{tmp_path}/none").count() == 0
    special = ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  y\n", "<|endoftext", "a <|endoftext|>" * 300]
    docs = docs.unionByName(spark.createDataFrame([(100 + i, t, "en", 1, 1, "b") for i, t in enumerate(special)], DOCS))
    token_rans.write_tokens(docs, path, tok, 2)
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tok)
    start = 0
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    got = sorted(token_rans.read_tokens(spark, path).collect(), key=lambda r: r.start)
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (g.id, g.start, g.n_tokens, g.ids, g.ids_crc32) == (r.doc_id, start, len(ids) // 4, ids, zlib.crc32(ids))
        start += g.n_tokens


def test_rans_checkpoints_and_checksums():
    rnd = np.random.default_rng(0)
    ids = np.minimum(rnd.zipf(1.3, 400_000), 50_000)
    seen, n = np.unique(ids, return_counts=True)
    table = token_rans.Table(seen, token_rans.scaled_frequencies(n))
    lanes = token_rans.lanes_of(len(ids))
    w, states, before = token_rans.rans_encode(ids, table, lanes)
    stretch = lanes * token_rans.CHECKPOINT_STEPS
    row = {"n_ids": len(ids), "lanes": lanes, "words": w.tobytes(), "crc32": zlib.crc32(w.tobytes()), "checkpoints": np.concatenate(states).tobytes(),
           "checkpoint_words": np.array(before, "<u8").tobytes(),
           "checkpoint_crcs": np.array([zlib.crc32(ids[a:a + stretch].astype("<u4").tobytes()) for a in range(0, len(ids), stretch)], "<u4").tobytes()}
    assert (token_rans.decode_block(row, table) == ids).all() and len(states) > 2
    assert (token_rans.decode_block(row, table, 200_001, 300_000) == ids[200_001:300_000]).all()
    with pytest.raises(ValueError):
        token_rans.decode_block({**row, "words": w[:-1].tobytes() + b"\0\0\0\1"}, table)


def test_urls(spark):
    urls = ["http://a.example.com/en/x", "https://www.example.com/en/", "x://b.net/es/?q", "http://a.com", "http://A.ORG/p#f", None, "none", "http://b.net/fr/1",
            "ftp://c.com/?a", "http://example.com/en"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id long, url string")
    got = {r.id: r for r in url_filter.filter_urls(pages, queries.URL_RULES, queries.labelled_urls(pages)).collect()}
    assert [got[i].rule for i in range(10)] == ["example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, "net/fr/", "com/", "com/"]
    assert (got[4].host, got[4].path, got[5].host, got[5].path) == ("a.org", "/p", "", "") and {got[i].verdict for i in (0, 2, 7)} == {"block"}
    train = [(f"h{i}.good.org", "/news", 0) for i in range(50)] + [(f"h{i}.casino.org", "/win", 1) for i in range(50)]
    w = url_filter.train(train)
    score = lambda h, p: w[url_filter.features(h, p)].sum() / len(url_filter.features(h, p)) ** 0.5 + w[-1]
    held = [(f"k{i}.good.org", "/news/x", False) for i in range(20)] + [(f"k{i}.casino.org", "/win/x", True) for i in range(20)]
    assert sum((score(h, p) > 0) == y for h, p, y in held) >= 38
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES, pages.selectExpr("url", "1 AS block").limit(0)).count() == 0


def test_preferences(spark):
    t = lambda *xs: [(r, x) for r, x in xs]
    rows = [("a", t(("user", "q"), ("assistant", "yes")), t(("user", "q"), ("assistant", None))), ("b", None, t(("user", "q"))),
            ("c", t(("user", "q"), ("assistant", "s")), t(("user", "q"), ("assistant", "s")))]
    df = spark.createDataFrame(rows, f"pair_id string, chosen {preference.TURN}, rejected {preference.TURN}")
    got = {r.pair_id: r for r in preference.format_pairs(df).collect()}
    a = got["a"]
    assert a.n_prompt_turns == 1 and a.prompt == "<|user|>\nq<|end|>\n" and a.usable and not got["b"].usable and not got["c"].usable
    assert [a.chosen_text[s.first:s.end] for s in a.chosen_mask] == ["yes<|end|>\n"]
    conv = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "long answer"), (2, 0, "user", "q"), (2, 1, "assistant", "no"),
                                  (3, 0, "user", "z"), (3, 1, "assistant", "m"), (3, 2, "user", None), (3, 3, "assistant", "n")],
                                 "conv_id long, turn long, role string, text string")
    pairs = {r.pair_id: r for r in preference.preference_pairs(conv).collect()}
    assert set(pairs) == {"shared-2", "stale-3"} and pairs["shared-2"].chosen_id == 1
    assert [x.text for x in pairs["stale-3"].rejected] == ["m" if i == 3 else x.text for i, x in enumerate(pairs["stale-3"].chosen)]


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "WARC/1.0\r\n\r\nété " * 100
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "x\r\ny", None),
            (6, "x\r\ny", None), (None, "http://n", "no id")]
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{tmp_path}/w", queries.WARC_DATE, records_per_file=4)
    got = warc.captures_with_origin(warc.assemble(warc.read_warc(spark, f"{tmp_path}/w"))).collect()
    by = {r.metadata[0].page_id: r for r in got}
    assert len(got) == 7 and all(len(r.requests) == 1 for r in got)
    assert [by[i].response.type for i in (1, 2, 3, 4, 5, 6, None)] == ["revisit", "revisit", *["response"] * 5]
    assert by[1].origin.page_id == 3 == by[2].origin.page_id and by[3].response.payload == big and by[3].response.digest_ok
    assert by[1].response.payload_digest == hashlib.sha1(big.encode()).hexdigest() and by[6].response.payload_bytes == 0
