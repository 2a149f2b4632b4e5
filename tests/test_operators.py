"""Hand-written edge tables for each operator family (the cases listed in FIXTURES §C)."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from kbspark.functions import text as tx
from kbspark.functions.html import html_to_text
from kbspark.functions.vectors import cosine_distance, l2_distance
from kbspark.operators import access, chunking, facts, groupconcat as gc, index as idx, metrics, mixing as mx
from kbspark.operators import qa_data as qa
from kbspark.operators.groupconcat import ConcatRule

AS_OF = "2024-01-15 00:00:00"


# ----------------------------------------------------------------------------------- access
def _access_tables(spark):
    docs = spark.createDataFrame([
        # id, company, owner, level, approved
        (1, 1, 10, "PUBLIC", False),     # unapproved public owned by caller 10
        (2, 2, None, "PUBLIC", True),    # approved public, other company
        (3, 1, None, "PUBLIC", None),    # NULL approval
        (4, 1, None, "INTERNAL", None),  # internal, same company
        (5, 2, None, "INTERNAL", None),  # internal, other company, grant held by 10
        (6, 1, None, "RESTRICTED", True),
        (7, 1, 11, "RESTRICTED", False),
        (8, 1, None, "PUBLIC", True),    # approved public, same company
        (9, 3, None, "PUBLIC", False),   # unapproved public, grant held by 10
    ], "document_id long, company_id long, owner_id long, access_level string, is_approved boolean")
    callers = spark.createDataFrame([
        (10, 1, "INTERNAL"), (11, 1, None), (None, None, None),
    ], "user_id long, company_id long, user_type string")
    ts = dt.datetime(2024, 1, 15)
    grants = spark.createDataFrame([
        (10, 5, False, None),
        (10, 9, False, ts),                          # expires exactly at as_of: live
        (11, 6, None, None),                         # NULL is_revoked: not live
        (11, 6, False, dt.datetime(2024, 1, 14)),    # expired
        (11, 4, True, None),                         # revoked
    ], "user_id long, document_id long, is_revoked boolean, expires_at timestamp")
    return docs, callers, grants


def _pairs(df):
    return {(r.user_id, r.document_id) for r in df.collect()}


def test_list_policy_edges(spark):
    docs, callers, grants = _access_tables(spark)
    got = _pairs(access.list_policy(docs, callers, grants, AS_OF))
    assert got == {(10, 1), (10, 4), (10, 5), (10, 8), (10, 9), (11, 7), (11, 8)}


def test_point_policy_edges(spark):
    docs, callers, grants = _access_tables(spark)
    got = _pairs(access.point_policy(docs, callers, grants, AS_OF))
    # PUBLIC decided by approval/company only; anonymous sees approved PUBLIC of any company;
    # INTERNAL decided before grants; RESTRICTED by owner or live grant.
    assert got == {(10, 4), (10, 8), (11, 7), (11, 8), (None, 2), (None, 8)}


def test_point_flag_matches_point_policy(spark):
    docs, callers, grants = _access_tables(spark)
    pairs = docs.crossJoin(callers.withColumnRenamed("company_id", "user_company_id"))
    flagged = access.point_access_flag(pairs, grants, AS_OF).where("has_access")
    assert _pairs(flagged) == _pairs(access.point_policy(docs, callers, grants, AS_OF))


def test_policy_diff(spark):
    docs, callers, grants = _access_tables(spark)
    diff = access.policy_diff(access.list_policy(docs, callers, grants, AS_OF),
                              access.point_policy(docs, callers, grants, AS_OF))
    got = {(r.user_id, r.document_id, r.visible_in) for r in diff.collect()}
    assert (10, 1, "list_only") in got and (10, 5, "list_only") in got and (None, 2, "point_only") in got


def test_requested_docs(spark):
    acc = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 5)], "query_id long, document_id long")
    req = spark.createDataFrame([(1, [2]), (2, None), (3, [])], "query_id long, doc_ids array<long>")
    got = {(r.query_id, r.document_id) for r in access.restrict_to_requested(acc, req).collect()}
    assert got == {(1, 2), (2, 1)}


# ----------------------------------------------------------------------------------- chunking
@pytest.mark.parametrize("n,expected", [(0, 0), (1, 1), (5, 2), (6, 2), (7, 3)])
def test_sentence_windows(spark, n, expected):
    text = " ".join(f"Sentence {i}." for i in range(n))
    df = spark.createDataFrame([(1, text)], "document_id long, text string")
    rows = chunking.sentence_chunks(df).orderBy("chunk_idx").collect()
    assert len(rows) == expected
    if n == 7:
        assert rows[2].chunk_text == "Sentence 6."  # last chunk lies inside its predecessor
        assert rows[1].chunk_text.endswith("Sentence 6.")


def test_sentence_windows_reject_bad_overlap():
    with pytest.raises(ValueError):
        tx.sentence_windows(F.array(), size=2, overlap=2)


@pytest.mark.parametrize("n,expected", [(0, 0), (254, 1), (255, 2), (476, 2), (477, 3)])
def test_token_windows(spark, n, expected):
    text = " ".join(f"t{i}" for i in range(n))
    df = spark.createDataFrame([(1, 0, text)], "document_id long, chunk_idx long, chunk_text string")
    rows = chunking.token_subchunks(df).orderBy("subchunk_idx").collect()
    assert len(rows) == expected
    for a, b in zip(rows, rows[1:]):  # consecutive windows overlap by exactly 32 tokens
        assert a.subchunk_text.split()[-32:] == b.subchunk_text.split()[:32]


def test_token_windows_keep_original_spacing(spark):
    df = spark.createDataFrame([(1, 0, "  a\nb  c\t\td  ")], "document_id long, chunk_idx long, chunk_text string")
    assert chunking.token_subchunks(df).first().subchunk_text == "a\nb  c\t\td"


def test_html_to_text(spark):
    html = ("<html><head><title>T&amp;C</title><style>p{}</style><script>var x='</p>';</script></head>"
            "<body><nav><a>menu</a></nav><!-- ad --><p>Hello&nbsp;<b>world</b> &lt;3</p></body></html>")
    got = spark.createDataFrame([(html,)], "h string").select(html_to_text(F.col("h")).alias("t")).first().t
    assert got == "T&C Hello world <3"


# ----------------------------------------------------------------------------------- vectors
def test_distances(spark):
    df = spark.createDataFrame([
        ([0.0, 0.0], [1.0, 0.0]), ([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0, 0.0], [1.0, 0.0]),
    ], "a array<float>, b array<float>")
    r = df.select(cosine_distance("a", "b").alias("c"), l2_distance("a", "b").alias("l")).collect()
    assert r[0].c == 1.0 and r[1].c == 0.0 and r[2].c == 2.0
    assert r[3].c is None and r[3].l is None
    assert math.isclose(r[2].l, 2.0)


# ----------------------------------------------------------------------------------- retrieval
def test_retrieval_edges(spark):
    from kbspark.operators import retrieve as rt
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vector array<float>")
    chunks = spark.createDataFrame([(c, 100, c, f"c{c}") for c in (1, 2, 3, 4, 5, 6)],
                                   "chunk_id long, document_id long, chunk_idx long, chunk_text string")
    v = [  # (embedding_id, chunk_id, subchunk_idx, vector, status)
        (1, 1, 0, [1.0, 0.0], "COMPLETED"),
        (2, 2, 0, [1.0, 0.1], "COMPLETED"), (3, 2, 1, [0.0, 1.0], "COMPLETED"),
        (4, 3, 0, [1.0, 0.2], "COMPLETED"), (5, 3, 1, [1.0, 0.3], "COMPLETED"), (6, 3, 2, [1.0, 0.4], "COMPLETED"),
        (7, 4, 0, [1.0, 0.0], "COMPLETED"), (8, 4, 1, [0.0, 1.0], "COMPLETED"), (9, 4, 2, [0.0, -1.0], "COMPLETED"),
        (10, 4, 3, [1.0, 0.0], "COMPLETED"),
        (11, 5, 0, [1.0, 0.0], "FAILED"),
        (12, 6, 0, [-1.0, 0.0], "COMPLETED"),
    ]
    emb = spark.createDataFrame(v, "embedding_id long, chunk_id long, subchunk_idx long, vector array<float>, status string")
    r = {x.chunk_id: x for x in rt.retrieve(q, chunks, emb, top_k=4, score_threshold=0.3).collect()}
    assert 5 not in r                       # no COMPLETED vector
    assert 6 not in r                       # opposite vector: outside the top 4
    assert r[1].match_count == 1 and math.isclose(r[1].score, 0.6 + 0.3 + 0.1 / 3, abs_tol=1e-6)
    assert r[4].match_count == 3 and r[4].best_distance == 0.0
    # tie on best distance 0.0 between chunks 1 and 4: chunk id breaks it
    assert r[1].chunk_rank == 1 and r[4].chunk_rank == 2


def test_scoped_search_against_the_policy_rows(spark, monkeypatch):
    """Nearest readable chunks = those of (question, document) rows made by the list policy, in one
    block or many, with named documents and without."""
    import random

    import numpy as np
    from kbspark.operators import scoped
    rnd = random.Random(1)
    docs, callers, grants = _access_tables(spark)
    chunk_rows = [(f"c{i:03d}", rnd.randint(1, 10)) for i in range(80)]      # document 10 does not exist
    chunks = spark.createDataFrame(chunk_rows, "chunk_id string, document_id long")
    vec = [(c, [float(x) for x in np.random.default_rng(i).normal(size=4)]) for i, (c, _) in enumerate(chunk_rows) for _ in range(2)]
    vec += [("c000", None), (None, [1.0] * 4), ("c001", [1.0, 2.0]), ("c002", [0.0] * 4)] + vec[:9]
    emb = spark.createDataFrame(vec, "chunk_id string, vector array<double>").repartition(3)
    asks = [(q, u, [float(x) for x in np.random.default_rng(100 + q).normal(size=4)]) for q, u in enumerate([10, 11, 10, None, 77, 11])]
    questions = spark.createDataFrame([(q, v) for q, _, v in asks] + [(9, None)], "query_id long, query_vector array<double>")
    who = spark.createDataFrame([(q, u) for q, u, _ in asks], "query_id long, user_id long").join(callers.where("user_id IS NOT NULL"), "user_id", "left")
    requests = spark.createDataFrame([(0, None), (1, [7]), (2, [4, 8, 10]), (4, None), (5, [])], "query_id long, doc_ids array<long>")
    allowed = _pairs(access.list_policy(docs, callers, grants, AS_OF))
    named = {0: None, 1: [7], 2: [4, 8, 10], 3: [], 4: None, 5: []}
    place = dict(chunk_rows)

    def want(k, with_requests):
        out = set()
        for q, u, x in asks:
            best = {}
            for c, v in vec:
                if c is None or v is None or len(v) != 4 or (u, place[c]) not in allowed:
                    continue
                if with_requests and named[q] is not None and place[c] not in named[q]:
                    continue
                n = np.linalg.norm(v)
                d = round(1 - (np.dot(x, v) / np.linalg.norm(x) / n if n else 0), 9)
                best[c] = min(best.get(c, 9), d)
            out |= {(q, c) for _, c in sorted((d, c) for c, d in best.items())[:k]}
        return out

    for size in (4096, 2):
        monkeypatch.setattr(scoped, "BLOCK_QUESTIONS", size)
        for r in (None, requests):
            s = scoped.Scope(docs, who, grants, AS_OF, r)
            got = scoped.nearest_chunks(questions, chunks, emb, s, 5).collect()
            assert {(x.query_id, x.chunk_id) for x in got} == want(5, r is not None) and len(got) == len(want(5, r is not None))
    assert scoped.nearest_chunks(questions.limit(0), chunks, emb, s, 5).count() == 0
    assert scoped.nearest_chunks(questions, chunks, emb.limit(0), s, 5).count() == 0


# ----------------------------------------------------------------------------------- replies and fold
def _parse(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r.p for r in df.select(facts.parse_reply(F.col("t")).alias("p")).collect()]


def test_reply_parse_edges(spark):
    ok = '{"answer": "a", "new_facts": [{"fact": "f", "certainty": "HIGH"}], "updated_facts": [{"id": null, "fact": "g", "certainty": "low", "reasoning": "r"}]}'
    texts = ["no braces", "Sure! " + ok + " bye", '{"answer": "x", "new_facts": [{"fact": "f"}]}',
             '{"answer": "x", "new_facts": [{"fact": "f", "certainty": "certain"}]}',
             '{"answer": "{nested}", "reasoning": "r"}', None]
    p = _parse(spark, texts)
    assert not p[0].valid and p[0].answer == "" and p[0].new_facts == []
    assert p[1].valid and p[1].answer == "a" and p[1].new_facts[0].certainty == "high"
    assert p[1].new_facts[0].reasoning == "" and p[1].updated_facts[0].id is None
    assert not p[2].valid and not p[3].valid
    assert p[4].valid and p[4].answer == "{nested}" and p[4].can_answer is False
    assert not p[5].valid
    for t, r in zip(texts, p):
        py = facts.parse_reply_py(t)
        assert py["answer"] == r.answer and len(py["new_facts"]) == len(r.new_facts)


def _reply(new=(), upd=(), answer="ans"):
    import json
    return json.dumps({"answer": answer, "new_facts": [{"fact": f, "certainty": c} for f, c in new],
                       "updated_facts": [{"id": i, "fact": f, "certainty": c} for i, f, c in upd]})


def _fold_both(spark, histories):
    rows = [(q, r, t) for q, docs in histories.items() for r, t in enumerate(docs, 1)]
    df = spark.createDataFrame(rows, "query_id long, doc_rank long, reply_text string")
    rel = facts.fold_facts(df.withColumn("reply", facts.parse_reply(F.col("reply_text"))))
    seq = facts.fold_facts_sequential(
        df.withColumn("question", F.lit("q")).withColumn("dialog_history", F.lit("")).withColumn("context_json", F.lit("[]")),
        lambda request, row: row["reply_text"])
    a = {(r.query_id, r.fact_id, r.fact, r.certainty) for r in rel.collect()}
    b = {(r.query_id, r.fact_id, r.fact, r.certainty) for r in seq.collect() if r.fact_id is not None}
    return a, b


def test_fold_edges(spark):
    histories = {
        1: [_reply(upd=[("1", "early", "high")]), _reply(new=[("a", "low")])],            # update before creation
        2: [_reply(new=[("a", "low")], upd=[("1", "same doc", "high")])],                 # update in creating doc
        3: [_reply(new=[("a", "low")]), _reply(upd=[("1", "", "contradicts")]),
            _reply(upd=[("1", "revive", "high")])],                                        # delete then update
        4: [_reply(new=[("a", "low")]), _reply(upd=[("1", "", "contradicts")], new=[("b", "high")])],  # id not reused
        5: [_reply(new=[("x", "contradicts"), ("y", "contradicts")])],                     # all contradicts
        6: [_reply(new=[("a", "low")]), "garbage"],                                        # blank last answer
    }
    a, b = _fold_both(spark, histories)
    assert a == b
    assert (1, "1", "a", "low") in a
    assert (2, "1", "same doc", "high") in a
    assert not any(q == 3 for q, *_ in a)
    assert (4, "2", "b", "high") in a
    assert not any(q == 5 for q, *_ in a)


def test_fold_random_histories_match_sequential(spark):
    rnd = random.Random(7)
    certs = ["high", "medium", "low", "contradicts"]
    histories = {}
    for q in range(60):
        docs = []
        for _ in range(rnd.randint(1, 5)):
            new = [(f"f{rnd.randint(0, 99)}", rnd.choice(certs)) for _ in range(rnd.randint(0, 3))]
            upd = [(str(rnd.randint(0, 6)), rnd.choice(["", "u"]), rnd.choice(certs)) for _ in range(rnd.randint(0, 3))]
            docs.append(_reply(new, upd) if rnd.random() > 0.1 else "broken")
        histories[q] = docs
    a, b = _fold_both(spark, histories)
    assert a == b


# ----------------------------------------------------------------------------------- group & concat
def test_group_concat_edges(spark):
    df = spark.createDataFrame([
        (1, "a", 1, "x", " "), (2, "a", 2, None, "p"), (3, "a", 3, "z", "q"), (4, None, 4, "w", "r"),
    ], "ord long, k string, n long, v string, w string")
    sep = gc.group_concat(df, " k ,", [ConcatRule("v", "%tab%", "joined"), ConcatRule("n", "", "")], "ord").collect()
    assert len(sep) == 1 and sep[0].joined == "x    z" and sep[0].n == "1\n2\n3"
    tpl = gc.group_concat(df, "k", [ConcatRule("v", "%id%:%value%[{w}];", "t"), ConcatRule("n", "{w}|", "only_col")],
                          "ord").first()
    assert tpl.t == "1:x[N/A];2:z[q];"
    assert tpl.only_col == "N/A|p|q|"
    assert gc.group_concat(df, "k", [], "ord").count() == 1
    rec = gc.as_records(gc.group_concat(df, "k", [ConcatRule("v", ",", "")], "ord"), "k").first()
    assert rec.text == "a" and rec.data.v == "x,z"


# ----------------------------------------------------------------------------------- mixing
def test_mixing_invariants(spark):
    rows = [(i, "big") for i in range(10000)] + [(10000, "tiny")] + [(10001 + i, "mid") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, dataset string")
    w = mx.dataset_weights(mx.dataset_sizes(df), "dataset")
    ws = {r.dataset: r.weight for r in w.collect()}
    assert math.isclose(sum(ws.values()), 1.0) and ws["tiny"] > ws["mid"] > ws["big"]
    g = mx.global_index(df, "dataset", "id")
    assert sorted(r.global_index for r in g.collect()) == list(range(len(rows)))
    s = mx.weighted_sample(df, w, "dataset", "id")
    assert s.count() == len(rows)
    explicit = spark.createDataFrame([("big", 100.0)], "dataset string, weight double")
    ws2 = {r.dataset: r.weight for r in mx.dataset_weights(mx.dataset_sizes(df), "dataset", explicit=explicit).collect()}
    assert ws2["big"] > 0.9


def test_consecutive_index_one_dataset(spark):
    df = spark.range(0, 1000).withColumn("dataset", F.lit("only"))
    g = mx.global_index(df, "dataset", "id").collect()
    assert {r.global_index for r in g} == set(range(1000))


# ----------------------------------------------------------------------------------- QA
def test_qa_padding_and_masks(spark):
    df = spark.createDataFrame([("a b c",), ("",)], "t string")
    r = df.select(qa.encode(qa.token_ids(F.col("t")), 5).alias("e")).collect()
    assert len(r[0].e) == 5 and r[0].e[3] == qa.EOS_ID and r[0].e[4] == qa.PAD_ID
    assert r[1].e == [qa.EOS_ID, 0, 0, 0, 0]
    long = spark.createDataFrame([(" ".join(["w"] * 10),)], "t string")
    e = long.select(qa.encode(qa.token_ids(F.col("t")), 4).alias("e")).first().e
    assert len(e) == 4 and e[-1] == qa.EOS_ID
    m = spark.createDataFrame([([5, 1, 0, 0],)], "x array<int>").select(
        qa.mask_labels(F.col("x")).alias("m"), qa.unmask_labels(qa.mask_labels(F.col("x"))).alias("u")).first()
    assert m.m == [5, 1, -100, -100] and m.u == [5, 1, 0, 0]


def test_qa_loaders(spark, tmp_path):
    import json
    squad = {"data": [{"title": "t", "paragraphs": [{"context": "ctx", "qas": [
        {"id": "1", "question": "q?", "answers": [{"text": "first", "answer_start": 0}, {"text": "second", "answer_start": 3}]}]}]}]}
    p = tmp_path / "squad.json"
    p.write_text(json.dumps(squad, indent=2))
    r = qa.load_squad(spark, str(p)).first()
    assert (r.context, r.question, r.answer_text) == ("ctx", "q?", "first")
    j = tmp_path / "yn.jsonl"
    j.write_text("\n".join(json.dumps({"passage": "p", "question": f"q{i}", "label": i % 2 == 0, "idx": i}) for i in range(3)))
    assert [x.answer_text for x in qa.load_yesno(spark, str(j), "yes", "no").orderBy("question").collect()] == ["yes", "no", "yes"]


# ----------------------------------------------------------------------------------- GLEU
def test_gleu(spark):
    pairs = spark.createDataFrame([
        ("same", "a b c d e", "a b c d e"), ("disjoint", "a b", "c d"), ("clip", "the the the", "the cat"),
        ("short", "a", "a b"), ("empty", "", ""),
    ], "pair_id string, hypothesis string, reference string")
    g = {r.pair_id: r.gleu for r in metrics.gleu_pairs(pairs).collect()}
    assert g["same"] == 1.0 and g["disjoint"] == 0.0 and g["empty"] == 0.0
    assert math.isclose(g["clip"], 1 / 6, abs_tol=1e-6)   # 1 clipped unigram match / max(5, 3) n-grams
    assert math.isclose(g["short"], 1 / 3, abs_tol=1e-6)


# ----------------------------------------------------------------------------------- index
def test_index_decision_table():
    assert idx.decide(True, False, True, "").action == "append"
    assert idx.decide(True, False, True, "find").action == "read"
    assert idx.decide(True, False, False, "").action == "read"
    assert idx.decide(False, False, True, "").action == "create"
    assert idx.decide(True, True, True, "find").action == "create"
    with pytest.raises(ValueError):
        idx.decide(False, False, False, "")
    with pytest.raises(ValueError):
        idx.decide(True, True, False, "")
    with pytest.raises(ValueError):
        idx.decide(False, False, True, "", has_directory=False)


def test_sequential_fold_isolates_failing_question(spark):
    rows = [(1, 1, _reply(new=[("a", "low")])), (2, 1, _reply(new=[("b", "high")]))]
    df = (spark.createDataFrame(rows, "query_id long, doc_rank long, reply_text string")
          .withColumn("question", F.lit("q")).withColumn("dialog_history", F.lit("")).withColumn("context_json", F.lit("[]")))

    def flaky(request, row):
        if row["query_id"] == 2:
            raise RuntimeError("model unavailable")
        return row["reply_text"]

    out = {r.query_id: r for r in facts.fold_facts_sequential(df, flaky).collect()}
    assert out[1].fact == "a" and out[1].final_result == "ans"
    assert out[2].fact_id is None and out[2].final_result == facts.ERROR_ANSWER


# ----------------------------------------------------------------------------------- joins
def test_salted_join_equals_plain_join(spark):
    from kbspark.operators.joins import hot_key_join, require_bounded
    big = spark.range(0, 3000).select(F.col("id").alias("doc"), (F.col("id") % 3 == 0).cast("int").alias("k"))
    small = spark.createDataFrame([(0, "a"), (1, "b"), (1, "c")], "k int, v string")
    plain = {tuple(r) for r in big.join(small, "k").collect()}
    salted = {tuple(r) for r in hot_key_join(big, small, ["k"], max_broadcast_rows=0, salt_by=["doc"]).collect()}
    assert plain == salted and len(plain) == 2000 + 2 * 1000
    semi = hot_key_join(big, small.where("k = 0"), ["k"], how="left_semi", max_broadcast_rows=0, salt_by=["doc"])
    assert semi.count() == 2000
    with pytest.raises(ValueError):
        require_bounded(big, 10, "big")


def test_access_policies_salted_path(spark, monkeypatch):
    from kbspark.operators import joins
    docs, callers, grants = _access_tables(spark)
    expected_list = _pairs(access.list_policy(docs, callers, grants, AS_OF))
    expected_point = _pairs(access.point_policy(docs, callers, grants, AS_OF))
    monkeypatch.setattr(access, "_fits", lambda c: False)
    assert _pairs(access.list_policy(docs, callers, grants, AS_OF)) == expected_list
    assert _pairs(access.point_policy(docs, callers, grants, AS_OF)) == expected_point


# ----------------------------------------------------------------------------------- schema
def test_conform_renames_defaults_and_bad_values(spark):
    from kbspark import schema as S
    old = spark.createDataFrame([(1, "7", "x", True)],
                                "chunk_id long, document_id string, chunk_text string, is_important boolean")
    r = S.conform(old, S.CHUNKS, renames={"is_hot": "is_important"}, defaults={"overlap": 0}).first()
    assert r.document_id == 7 and r.is_hot is True and r.overlap == 0 and r.chunk_scope is None
    assert r.chunk_text == "x" and r.chunk_idx is None
    bad = spark.createDataFrame([(1, "seven")], "chunk_id long, document_id string")
    assert S.conform(bad, S.CHUNKS).first().document_id is None


def test_answer_rows_of_failed_questions(spark):
    ask = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    replies = spark.createDataFrame([(1, 1, ("a",)), (1, 2, ("b",)), (2, 1, ("c",))], "query_id long, doc_rank int, reply struct<answer:string>")
    folded = spark.createDataFrame([(1, "2", "f2", "high", "r2"), (1, "10", "f10", "low", "r10"), (2, "1", "g", "high", "s")],
                                   "query_id long, fact_id string, fact string, certainty string, reasoning string")
    used = spark.createDataFrame([(1, "7", "70"), (2, "8", "80")], "query_id long, used_documents string, used_chunks string")
    errors = spark.createDataFrame([(2, "boom"), (2, "later")], "query_id long, error string")
    got = {r.query_id: r for r in facts.answer_summary(ask, replies, folded, used, errors, "echo").collect()}
    assert got[1].final_result == "b" and [f.id for f in got[1].facts] == ["2", "10"] and got[1].reasoning == "r2\nr10" and got[1].confidence == 0.4
    assert (got[2].final_result, got[2].facts, got[2].confidence, got[2].reasoning, got[2].used_documents) == (facts.FAILED_RESULT, [], 0.0, "boom", "")
    assert got[3].final_result == "" and got[3].facts == [] and got[3].warnings == [] and got[3].truncated is False and got[3].llm_provider == "echo"
    assert got[1].processing_time_ms is None
