"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame whose columns
match the DuckDB oracle in ``kbspark.plans.oracle`` by name.

A query builds one ``KB`` over the input folder; every derived table is built once per query
and shared, so a table used twice in one plan is one subtree (Spark reuses its exchange) and
each size check runs once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kbspark.functions.html import html_to_text
from kbspark.functions.vectors import unit
from kbspark.operators import access, chunking, context as ctx, dialog, facts, generate as gen, groupconcat as gc
from kbspark.operators import embed as emb, importance as imp, index as idx, integrity as integ, ivf, metrics
from kbspark.operators import mixing as mx, nearest as near, qa_data as qa, retrieve as rt
from kbspark.plans import ingest, report
from kbspark import schema as S
from kbspark.operators.joins import bounded_broadcast
from kbspark.operators.scoped import Scope
from kbspark.session import materialize, scratch_path
from kbspark.sources import fixtures as fx
from kbspark.sources.stored import stored
from kbspark.sources.tables import read_table, table_glob

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

TOP_K = 20
SUBCHUNK_TOP_K = 3
FIXTURE_THRESHOLD = 0.15
PROMPT_TEMPLATE = ("Context:\n{context}\n\nHistory:\n{history}\n\nDate: {date}\n\n"
                   "Question: {question}\nAnswer with JSON only.")


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


class KB:
    """Lazily built, shared tables of one query over one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    # entity tables
    @cached_property
    def documents(self):
        return fx.kb_documents(self.spark, self.sf_dir)

    @cached_property
    def grants(self):
        return fx.kb_grants(self.spark, self.sf_dir)

    @cached_property
    def questions(self):
        return fx.kb_questions(self.spark, self.sf_dir)

    @cached_property
    def callers(self):
        return self.questions.select("query_id", "user_id").join(fx.kb_users(self.spark, self.sf_dir), "user_id", "left")

    @cached_property
    def chunks(self):
        return fx.kb_chunks(self.spark, self.sf_dir)

    @cached_property
    def embeddings(self):
        return fx.kb_embeddings(self.spark, self.sf_dir)

    @cached_property
    def conversations(self):
        return self.table("conversations").select("conv_id", "turn", "role", "text")

    # access
    @cached_property
    def list_access(self):
        return access.list_policy(self.documents, self.callers, self.grants, fx.AS_OF)

    @cached_property
    def point_access(self):
        return access.point_policy(self.documents, self.callers, self.grants, fx.AS_OF)

    @cached_property
    def question_access(self):
        q = self.questions.select("query_id", "user_id")
        return q.join(self.list_access, "user_id").select("query_id", "document_id")   # each pair once

    # retrieval and answering
    @cached_property
    def scope(self):
        return Scope(self.documents, self.callers, self.grants, fx.AS_OF)

    def retrieve(self, threshold):
        return rt.retrieve(self.questions, self.chunks, self.embeddings, self.scope, TOP_K, SUBCHUNK_TOP_K, threshold)

    @cached_property
    def retrieved(self):
        return materialize(self.retrieve(FIXTURE_THRESHOLD))

    @cached_property
    def contexts(self):
        return ctx.context_by_document(self.retrieved)

    @cached_property
    def replies(self):
        c = self.contexts
        return materialize(
            c.withColumn("reply_text", fx.reply_text(F.col("query_id"), F.col("document_id"), F.col("doc_rank")))
            .withColumn("reply", facts.parse_reply(F.col("reply_text"))))

    @cached_property
    def folded(self):
        return facts.fold_facts(self.replies)

    @cached_property
    def used(self):
        return ctx.used_ids(self.contexts)

    @cached_property
    def answers(self):
        return facts.answer_summary(self.questions, self.replies, self.folded, self.used)

    @cached_property
    def user_history(self):
        """Memory per asking user: the conversation with conv_id = user_id."""
        return dialog.dialog_history(self.conversations).select(F.col("conv_id").alias("user_id"), "history")

    def with_question_history(self, df: DataFrame) -> DataFrame:
        q = self.questions.select("query_id", "user_id", "question")
        line = F.concat(F.lit("user: "), F.col("question"))
        hist = F.when(F.col("history").isNull(), line).otherwise(F.concat(F.col("history"), F.lit("\n"), line))
        return df.join(q, "query_id").join(self.user_history, "user_id", "left").withColumn("dialog_history", hist)

    # ingestion text
    @cached_property
    def doc_chunks(self):
        docs = self.table("documents").select(F.col("doc_id").alias("document_id"), "text")
        return chunking.sentence_chunks(docs)


# ---------------------------------------------------------------------------------- access
@query("access_list_policy")
def q_access_list_policy(spark, sf_dir):
    return KB(spark, sf_dir).list_access


@query("access_point_policy")
def q_access_point_policy(spark, sf_dir):
    return KB(spark, sf_dir).point_access


@query("access_policy_diff")
def q_access_policy_diff(spark, sf_dir):
    kb = KB(spark, sf_dir)
    return access.policy_diff(kb.list_access, kb.point_access)


@query("requested_docs_filter")
def q_requested_docs_filter(spark, sf_dir):
    kb = KB(spark, sf_dir)
    qid, n = F.col("query_id") * fx.STRIDE, fx.document_bound(spark, sf_dir)
    requests = kb.questions.select(
        "query_id",
        F.when(F.col("query_id") % 4 == 0, F.lit(None).cast("array<bigint>"))
         .otherwise(F.array(qid % n, (qid * 3) % n, (qid * 7) % n)).alias("doc_ids"))
    return access.restrict_to_requested(kb.question_access, requests)


# ---------------------------------------------------------------------------------- vectors
@query("vector_distance")
def q_vector_distance(spark, sf_dir):
    """Cosine and L2 distance of each question to every candidate vector it may see: COMPLETED
    vectors of chunks in documents the asker can read (the candidate set of the search).
    A vector reaches its document's list of questions through equi-joins on chunk and document ids."""
    kb = KB(spark, sf_dir)
    e = kb.embeddings.where(F.col("status") == "COMPLETED")
    return near.listed_distances(e, kb.chunks, kb.question_access, kb.questions, "embedding_id")


@query("retrieve_topk")
def q_retrieve_topk(spark, sf_dir):
    kb = KB(spark, sf_dir)
    top = rt.attach_chunk_details(rt.top_stats(kb.questions, kb.chunks, kb.embeddings, kb.scope, TOP_K, SUBCHUNK_TOP_K), kb.chunks)
    return top.select("query_id", "chunk_id", "document_id", "chunk_idx", "chunk_text", "best_distance",
                      "avg_distance", "match_count", F.col("chunk_rank").cast("bigint").alias("chunk_rank"))


@query("retrieve_scored")
def q_retrieve_scored(spark, sf_dir):
    r = KB(spark, sf_dir).retrieve(0.25)
    return r.select("query_id", "chunk_id", "document_id", "chunk_idx", "best_distance", "avg_distance",
                    "match_count", F.col("chunk_rank").cast("bigint").alias("chunk_rank"), "score")


@query("retrieve_with_access")
def q_retrieve_with_access(spark, sf_dir):
    r = KB(spark, sf_dir).retrieved
    return r.select("query_id", "chunk_id", "document_id", "chunk_idx", "chunk_text", "best_distance",
                    "avg_distance", "match_count", F.col("chunk_rank").cast("bigint").alias("chunk_rank"), "score")


# ---------------------------------------------------------------------------------- ingestion text
@query("sentence_chunks")
def q_sentence_chunks(spark, sf_dir):
    c = KB(spark, sf_dir).doc_chunks
    return c.select("document_id", "chunk_idx", F.col("n_sentences").cast("bigint").alias("n_sentences"),
                    "chunk_text", "overlap")


@query("token_subchunks")
def q_token_subchunks(spark, sf_dir):
    s = chunking.token_subchunks(KB(spark, sf_dir).doc_chunks)
    return s.select("document_id", "chunk_idx", "subchunk_idx",
                    F.col("token_start").cast("bigint").alias("token_start"),
                    F.col("n_tokens").cast("bigint").alias("n_tokens"), "subchunk_text")


@query("chunk_metadata")
def q_chunk_metadata(spark, sf_dir):
    return chunking.chunk_metadata(KB(spark, sf_dir).doc_chunks)


@query("page_text")
def q_page_text(spark, sf_dir):
    p = KB(spark, sf_dir).table("pages").select("page_id", "url", "html")
    t = html_to_text(F.col("html"))
    return p.select("page_id", "url", t.alias("text"), F.length(t).cast("bigint").alias("n_chars"))


# ---------------------------------------------------------------------------------- answering
@query("context_by_document")
def q_context_by_document(spark, sf_dir):
    c = KB(spark, sf_dir).contexts
    return c.select("query_id", "document_id", "doc_rank", "n_chunks",
                    F.array_join(F.transform("chunks", lambda x: x["chunk_id"].cast("string")), ",").alias("chunk_ids"),
                    ctx.context_json(F.col("chunks")).alias("context_json"))


@query("used_ids")
def q_used_ids(spark, sf_dir):
    return KB(spark, sf_dir).used


@query("reply_parse")
def q_reply_parse(spark, sf_dir):
    r = KB(spark, sf_dir).replies
    return r.select("query_id", "document_id", "doc_rank", F.col("reply.valid").alias("valid"),
                    F.col("reply.answer").alias("answer"), F.col("reply.reasoning").alias("reasoning"),
                    F.col("reply.can_answer").alias("can_answer"),
                    F.size("reply.new_facts").cast("bigint").alias("n_new_facts"),
                    F.size("reply.updated_facts").cast("bigint").alias("n_updated_facts"))


@query("fact_fold")
def q_fact_fold(spark, sf_dir):
    return KB(spark, sf_dir).folded


@query("answer_summary")
def q_answer_summary(spark, sf_dir):
    """Answer rows of all questions; every tenth question's model fails, the times are fixture values."""
    kb = KB(spark, sf_dir)
    q = F.col("query_id")
    failed = kb.questions.where(q % 10 == 9).select(q, F.concat(F.lit("model unavailable for question "), q.cast("string")).alias("error"))
    a = facts.answer_summary(kb.questions, kb.replies, kb.folded, kb.used, failed, "table",
                             kb.questions.select(q, (100 + q * 7).alias("processing_time_ms")))
    return a.select("query_id", "final_result", F.to_json("facts").alias("facts"), "n_facts", "confidence", "reasoning", "used_documents",
                    "used_chunks", "llm_provider", "processing_time_ms", F.to_json("warnings").alias("warnings"), "truncated")


@query("fact_fold_model_loop")
def q_fact_fold_model_loop(spark, sf_dir):
    kb = KB(spark, sf_dir)
    rows = kb.with_question_history(kb.contexts).select(
        "query_id", "doc_rank", "question", "dialog_history",
        ctx.context_json(F.col("chunks")).alias("context_json"),
        fx.reply_text(F.col("query_id"), F.col("document_id"), F.col("doc_rank")).alias("reply_text"))
    return facts.fold_facts_sequential(rows, gen.table_reply)


@query("request_json")
def q_request_json(spark, sf_dir):
    kb = KB(spark, sf_dir)
    r = kb.replies
    before = (facts.facts_before(r).groupBy("query_id", "doc_rank")
              .agg(F.array_sort(F.collect_list(F.struct(F.col("fact_id").cast("bigint").alias("k"), "fact_id", "fact",
                                                        "certainty", "reasoning"))).alias("pf")))
    w = Window.partitionBy("query_id").orderBy("doc_rank")
    base = (r.join(before, ["query_id", "doc_rank"], "left")
            .withColumn("previous_answer", F.coalesce(F.lag("reply.answer").over(w), F.lit(""))))
    base = kb.with_question_history(base)
    pf = F.transform(F.coalesce(F.col("pf"), F.array().cast(before.schema["pf"].dataType)),
                     lambda x: F.struct(x["fact_id"].alias("id"), x["fact"].alias("fact"),
                                        x["certainty"].alias("certainty"), x["reasoning"].alias("reasoning")))
    return base.select("query_id", "document_id", "doc_rank",
                       ctx.request_json(F.col("question"), F.col("chunks"), pf, F.col("previous_answer"),
                                        F.col("dialog_history")).alias("request"))


@query("prompt_render")
def q_prompt_render(spark, sf_dir):
    kb = KB(spark, sf_dir)
    c = kb.with_question_history(kb.contexts)
    text = F.array_join(F.transform("chunks", lambda x: x["chunk_text"]), "\n\n")
    return c.select("query_id", "document_id",
                    ctx.render_prompt(PROMPT_TEMPLATE, context=text, history=F.col("dialog_history"),
                                      date=F.lit(fx.AS_OF[:10]), question=F.col("question")).alias("prompt"))


# ---------------------------------------------------------------------------------- dialog
@query("dialog_history")
def q_dialog_history(spark, sf_dir):
    return dialog.dialog_history(KB(spark, sf_dir).conversations).select(
        "conv_id", F.col("n_turns").cast("bigint").alias("n_turns"), "history")


@query("dialog_compact")
def q_dialog_compact(spark, sf_dir):
    return dialog.compact_history(KB(spark, sf_dir).conversations)


@query("dialog_stream")
def q_dialog_stream(spark, sf_dir):
    """Conversation turns streamed through keyed state."""
    from kbspark.streaming.dialog_stream import latest_histories, run_dialog_stream
    out = scratch_path(spark, "dialog-stream-" + uuid.uuid4().hex)
    run_dialog_stream(spark, table_glob(sf_dir, "conversations"), out)
    return latest_histories(spark, out).select("conv_id", "n_turns", "history")


@query("dialog_append")
def q_dialog_append(spark, sf_dir):
    kb = KB(spark, sf_dir)
    ans = kb.answers.select("query_id", F.col("final_result").alias("answer"))
    ex = (kb.questions.select("query_id", F.col("user_id").alias("conv_id"), "question")
          .join(ans, "query_id").withColumn("exchange_id", F.col("query_id")))
    return dialog.append_turns(kb.conversations, ex).select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")


# ---------------------------------------------------------------------------------- group & concat
SEPARATOR_RULES = [gc.ConcatRule("o_orderkey", ", ", "order_keys"), gc.ConcatRule("o_orderpriority", "%tab%", "priorities"),
                   gc.ConcatRule("o_totalprice", "", "")]
TEMPLATE_RULES = [gc.ConcatRule("text", "%id%. [{role}] %value%%newLine%", "transcript"),
                  gc.ConcatRule("role", "{turn}:", "turn_tags")]


def _separator_concat(kb: KB) -> DataFrame:
    o = kb.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return gc.group_concat(o, "o_custkey, o_orderstatus", SEPARATOR_RULES, "o_orderkey")


@query("group_concat_separator")
def q_group_concat_separator(spark, sf_dir):
    return _separator_concat(KB(spark, sf_dir))


@query("group_concat_template")
def q_group_concat_template(spark, sf_dir):
    return gc.group_concat(KB(spark, sf_dir).conversations, "conv_id", TEMPLATE_RULES, "turn")


@query("grouped_records")
def q_grouped_records(spark, sf_dir):
    r = gc.as_records(_separator_concat(KB(spark, sf_dir)), "o_custkey, o_orderstatus")
    return r.select("text", F.to_json("data").alias("data"))


# ---------------------------------------------------------------------------------- mixing
def mix_input(kb: KB) -> DataFrame:
    """documents as a multi-dataset training pool: dataset = language, split by a hash of the id."""
    u = mx.hash_uniform(F.col("doc_id"), F.lit(":split"))
    return kb.table("documents").select(
        "doc_id", F.col("lang").alias("dataset"),
        F.when(u < 0.8, "train").when(u < 0.9, "validation").otherwise("test").alias("split"))


@query("mixing_weights")
def q_mixing_weights(spark, sf_dir):
    m = mix_input(KB(spark, sf_dir))
    w = mx.dataset_weights(mx.dataset_sizes(m, "dataset", "split"), "dataset", "split")
    return w.select("split", "dataset", "n_rows", F.round("weight", 9).alias("weight"))


@query("mixing_index")
def q_mixing_index(spark, sf_dir):
    m = mix_input(KB(spark, sf_dir)).select("doc_id", "dataset")
    return mx.global_index(m, "dataset", "doc_id").select("doc_id", "dataset", "local_index", "global_index")


@query("mixing_sample")
def q_mixing_sample(spark, sf_dir):
    m = mix_input(KB(spark, sf_dir)).select("doc_id", "dataset")
    w = mx.dataset_weights(mx.dataset_sizes(m, "dataset"), "dataset")
    return mx.weighted_sample(m, w, "dataset", "doc_id").select("draw", "dataset", "local_index", "doc_id")


@query("mixing_index_by_split")
def q_mixing_index_by_split(spark, sf_dir):
    m = mix_input(KB(spark, sf_dir))
    return mx.global_index(m, "dataset", "doc_id", "split").select("split", "doc_id", "dataset", "local_index", "global_index")


@query("mixing_sample_by_split")
def q_mixing_sample_by_split(spark, sf_dir):
    m = mix_input(KB(spark, sf_dir))
    w = mx.dataset_weights(mx.dataset_sizes(m, "dataset", "split"), "dataset", "split")
    return mx.weighted_sample(m, w, "dataset", "doc_id", split_col="split").select("split", "draw", "dataset", "local_index", "doc_id")


@query("sample_rows")
def q_sample_rows(spark, sf_dir):
    m = mix_input(KB(spark, sf_dir)).select("doc_id", "dataset")
    return mx.hash_sample(m, 3, "doc_id", by="dataset").select(
        "dataset", F.col("sample_rank").cast("bigint").alias("sample_rank"), "doc_id")


# ---------------------------------------------------------------------------------- QA data
def qa_examples(kb: KB) -> DataFrame:
    return qa.conversation_examples(kb.conversations)


@query("qa_format")
def q_qa_format(spark, sf_dir):
    e = qa_examples(KB(spark, sf_dir))
    return e.select("conv_id", "turn", qa.format_input(F.col("context"), F.col("question")).alias("input_text"),
                    F.col("answer_text").alias("target_text"))


@query("qa_pad_mask")
def q_qa_pad_mask(spark, sf_dir):
    e = qa_examples(KB(spark, sf_dir))
    src = qa.encode(qa.token_ids(qa.format_input(F.col("context"), F.col("question"))), qa.SOURCE_MAX_TOKENS)
    tgt = qa.encode(qa.token_ids(F.col("answer_text")), qa.TARGET_MAX_TOKENS)
    t = e.select("conv_id", "turn", src.alias("input_ids"), tgt.alias("target_ids"))
    as_text = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return t.select("conv_id", "turn", as_text("input_ids").alias("input_ids"),
                    F.aggregate(qa.attention_mask(F.col("input_ids")), F.lit(0), lambda a, x: a + x).cast("bigint")
                    .alias("n_attended"),
                    F.array_join(qa.mask_labels(F.col("target_ids")).cast("array<string>"), " ").alias("labels"),
                    F.array_join(qa.attention_mask(F.col("target_ids")).cast("array<string>"), "").alias("labels_attention_mask"),
                    F.array_join(qa.unmask_labels(qa.mask_labels(F.col("target_ids"))).cast("array<string>"), " ")
                    .alias("labels_unmasked"))


@query("qa_length_filter")
def q_qa_length_filter(spark, sf_dir):
    e = qa_examples(KB(spark, sf_dir))
    return qa.length_filter(e, 256, 64, ["conv_id", "turn"]).select("conv_id", "turn", "context", "question",
                                                                    "answer_text")


@query("qa_length_max")
def q_qa_length_max(spark, sf_dir):
    e = qa_examples(KB(spark, sf_dir))
    n = lambda c: F.size(qa.token_ids(F.col(c)))
    return e.agg(F.count(F.lit(1)).alias("n_examples"), F.max(n("context")).cast("bigint").alias("max_context_tokens"),
                 F.max(n("question")).cast("bigint").alias("max_question_tokens"),
                 F.max(n("answer_text")).cast("bigint").alias("max_answer_tokens"))


@query("qa_nested_load")
def q_qa_nested_load(spark, sf_dir):
    """Conversation examples written as SQuAD-shaped JSON by Spark, read back by the loader."""
    e = qa_examples(KB(spark, sf_dir))
    nested = (e.groupBy("conv_id").agg(F.collect_list(F.struct(
        "context", F.array(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), "question",
                                    F.array(F.struct(F.col("answer_text").alias("text"),
                                                     F.lit(0).cast("bigint").alias("answer_start"))).alias("answers")))
        .alias("qas"))).alias("paragraphs"))
        .select(F.array(F.struct(F.col("conv_id").cast("string").alias("title"), "paragraphs")).alias("data")))
    path = scratch_path(spark, "squad-" + uuid.uuid4().hex)
    nested.write.mode("overwrite").json(path)
    return qa.load_squad(spark, path, multi_line=False).select(F.col("question_id"), "context", "question", "answer_text")


@query("qa_jsonl_load")
def q_qa_jsonl_load(spark, sf_dir):
    """Yes/no examples (label = quality) written as JSON lines by Spark, read back by the loader."""
    kb = KB(spark, sf_dir)
    rows = (kb.table("documents").select("doc_id", F.col("text").alias("passage"))
            .join(kb.table("labels").select("doc_id", (F.col("quality") == 1).alias("label")), "doc_id")
            .select("passage", F.concat(F.lit("Is document "), F.col("doc_id").cast("string"), F.lit(" good?"))
                    .alias("question"), "label", F.col("doc_id").alias("idx")))
    path = scratch_path(spark, "yesno-" + uuid.uuid4().hex)
    rows.write.mode("overwrite").json(path)
    return qa.load_yesno(spark, path, "yes", "no").select("question", "answer_text")


# ---------------------------------------------------------------------------------- GLEU
def gleu_input(kb: KB) -> DataFrame:
    c = mx.with_neighbours(kb.conversations, "conv_id", "turn", ["text"]).withColumnRenamed("next_text", "reference")
    return c.where(F.col("reference").isNotNull()).select(
        F.concat_ws("-", "conv_id", "turn").alias("pair_id"), F.col("text").alias("hypothesis"), "reference")


@query("gleu_pair")
def q_gleu_pair(spark, sf_dir):
    return metrics.gleu_pairs(gleu_input(KB(spark, sf_dir))).select("pair_id", "matches", "total", "gleu")


@query("gleu_corpus")
def q_gleu_corpus(spark, sf_dir):
    return metrics.gleu_corpus(gleu_input(KB(spark, sf_dir)))


# ---------------------------------------------------------------------------------- vector index
@query("vector_l2_topk")
def q_vector_l2_topk(spark, sf_dir):
    kb = KB(spark, sf_dir)
    r = idx.l2_topk(kb.table("embeddings"), kb.questions, k=4)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "l2_distance")


@query("index_conditional_update")
def q_index_conditional_update(spark, sf_dir):
    """Create the index from even labels, append all vectors (duplicates skipped), then read."""
    e = KB(spark, sf_dir).table("embeddings").select("vec_id", "embedding", "label")
    d = scratch_path(spark, "index-" + uuid.uuid4().hex)
    idx.update_index(spark, d, "vectors", e.where(F.col("label") % 2 == 0))
    idx.update_index(spark, d, "vectors", e, search_query="")
    out = idx.update_index(spark, d, "vectors", None, search_query="find me")
    return out.select("vec_id", "label", F.size("embedding").cast("bigint").alias("dim"))


def stored_ivf(kb: KB) -> ivf.IvfIndex:
    """The stored index over the embeddings table, tuned on the questions at ``TOP_K``."""
    e = kb.table("embeddings").select("vec_id", "embedding")
    base = stored(kb.spark, "ivf", [e, kb.table("benchmark")], lambda path: ivf.tune(ivf.build_ivf(e, path), kb.questions, TOP_K))
    return ivf.open_ivf(kb.spark, base)


@query("vector_ivf_topk")
def q_vector_ivf_topk(spark, sf_dir):
    """Approximate nearest vectors through the stored index, as many cells probed as its tuning found."""
    kb = KB(spark, sf_dir)
    r = ivf.search_ivf(stored_ivf(kb), kb.questions, TOP_K)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "distance")


@query("vector_ivf_all_cells")
def q_vector_ivf_all_cells(spark, sf_dir):
    """The stored index with every cell probed: the exact answer."""
    kb = KB(spark, sf_dir)
    index = stored_ivf(kb)
    r = ivf.search_ivf(index, kb.questions, TOP_K, index.n_cells)
    return r.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))


# ---------------------------------------------------------------------------------- audits
@query("audit_unique")
def q_audit_unique(spark, sf_dir):
    kb = KB(spark, sf_dir)
    users = fx.kb_users(spark, sf_dir)
    parts = [integ.unique_violations(users, "users", ["user_id"]),
             integ.unique_violations(users, "users", ["provider", "external_id"]),
             integ.unique_violations(kb.documents, "documents", ["document_id"]),
             integ.unique_violations(kb.chunks, "document_chunks", ["chunk_id"]),
             integ.unique_violations(kb.chunks, "document_chunks", ["document_id", "chunk_idx"]),
             integ.unique_violations(kb.doc_chunks, "sentence_chunks", ["document_id", "chunk_idx"]),
             integ.unique_violations(kb.embeddings, "chunk_embeddings", ["embedding_id"]),
             integ.unique_violations(kb.table("documents"), "documents_text", ["text"])]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("audit_orphans")
def q_audit_orphans(spark, sf_dir):
    kb = KB(spark, sf_dir)
    users, companies = fx.kb_users(spark, sf_dir), fx.kb_companies(spark, sf_dir)
    parts = [integ.orphans(users, companies, "users", "company_id", "company_id", "companies"),
             integ.orphans(kb.documents, companies, "documents", "company_id", "company_id", "companies"),
             integ.orphans(kb.documents, users, "documents", "owner_id", "user_id", "users"),
             integ.orphans(kb.chunks, kb.documents, "document_chunks", "document_id", "document_id", "documents"),
             integ.orphans(kb.embeddings, kb.chunks, "chunk_embeddings", "chunk_id", "chunk_id", "document_chunks"),
             integ.orphans(kb.grants, kb.documents, "access_grants", "document_id", "document_id", "documents"),
             integ.orphans(kb.grants, users, "access_grants", "user_id", "user_id", "users")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("audit_domain")
def q_audit_domain(spark, sf_dir):
    kb = KB(spark, sf_dir)
    users = fx.kb_users(spark, sf_dir)
    d = integ.domain_violations(kb.documents, "documents", {
        "access_level in domain": integ.in_domain("access_level", S.ACCESS_LEVELS),
        "source_type in domain": integ.in_domain("source_type", S.SOURCE_TYPES),
        "title length <= 512": integ.max_length("title", S.TITLE_MAX),
        "title not null": integ.not_null("title"),
        "public is approved": (F.col("access_level") != "PUBLIC") | F.coalesce(F.col("is_approved"), F.lit(False)),
    })
    u = integ.domain_violations(users, "users", {
        "provider in domain": integ.in_domain("provider", S.AUTH_PROVIDERS),
        "user_type in domain": integ.in_domain("user_type", S.USER_TYPES),
        "role in domain": integ.in_domain("role", S.USER_ROLES),
        "external_id length <= 255": integ.max_length("external_id", S.EXTERNAL_ID_MAX),
    })
    e = integ.domain_violations(kb.embeddings, "chunk_embeddings", {
        "status in domain": integ.in_domain("status", S.EMBEDDING_STATUSES),
        "vector dim = 64": F.size("vector") == 64,
        "vector not null": integ.not_null("vector"),
    })
    return d.unionByName(u).unionByName(e)


@query("cascade_delete")
def q_cascade_delete(spark, sf_dir):
    kb = KB(spark, sf_dir)
    companies, users = fx.kb_companies(spark, sf_dir), fx.kb_users(spark, sf_dir)
    gone = companies.where(F.col("company_id") == 0).select("company_id")
    left = integ.cascade_delete(gone, companies, users, kb.documents, kb.chunks, kb.embeddings, kb.grants)
    before = {"companies": companies, "users": users, "documents": kb.documents, "chunks": kb.chunks,
              "embeddings": kb.embeddings, "grants": kb.grants}
    rows = None
    for name, df in left.items():
        nulls = F.col("owner_id").isNull().cast("bigint") if name == "documents" else F.lit(0).cast("bigint")
        both = (before[name].select(F.lit(1).alias("_b"), F.lit(0).alias("_a"), F.lit(0).cast("bigint").alias("_n"))
                .unionByName(df.select(F.lit(0).alias("_b"), F.lit(1).alias("_a"), nulls.alias("_n"))))
        r = both.agg(F.sum("_b").cast("bigint").alias("n_before"), F.sum("_a").cast("bigint").alias("n_remaining"),
                     F.sum("_n").cast("bigint").alias("n_null_owner")).select(
            F.lit(name).alias("table_name"), "n_before", "n_remaining", "n_null_owner")
        rows = r if rows is None else rows.unionByName(r)
    return rows


@query("conform_schema")
def q_conform_schema(spark, sf_dir):
    """An old-revision vector table (no status/attempts/scope columns, ``is_important`` instead of
    ``is_hot`` on chunks) conformed to the current schema with back-filled defaults."""
    old = KB(spark, sf_dir).embeddings.select("embedding_id", "chunk_id", "subchunk_idx", "vector")
    c = S.conform(old, S.with_dimension(S.EMBEDDINGS, 64), defaults={"embedding_scope": "chunk", "embedding_model": "unknown", "overlap": 0,
                                               "status": "PENDING", "attempts": 0})
    return c.select("embedding_id", "chunk_id", "subchunk_idx", "embedding_scope", "embedding_model", "overlap",
                    "status", "attempts", "error_message", F.size("vector").cast("bigint").alias("dim"))


@query("conform_chunks")
def q_conform_chunks(spark, sf_dir):
    """Chunks written before the rename of ``is_important`` to ``is_hot`` and before
    ``chunk_scope``/``overlap`` existed, conformed to the current chunk schema."""
    old = (KB(spark, sf_dir).doc_chunks
           .select("document_id", "chunk_idx", "chunk_text", (F.col("chunk_idx") % 2 == 0).alias("is_important"))
           .withColumn("chunk_id", F.col("document_id") * fx.CHUNKS_PER_DOCUMENT + F.col("chunk_idx")))
    c = S.conform(old, S.CHUNKS, renames={"is_hot": "is_important"}, defaults={"chunk_scope": "sentence", "overlap": 0})
    return c.select("chunk_id", "document_id", "is_hot", "chunk_idx", "chunk_scope", "overlap",
                    F.length("chunk_text").cast("bigint").alias("text_length"))


# ---------------------------------------------------------------------------------- ingestion
@query("ingest_status")
def q_ingest_status(spark, sf_dir):
    req = ingest.requests_from_documents(KB(spark, sf_dir).table("documents"))
    v = ingest.validate(req)
    return v.select(F.col("request_id").alias("doc_id"), "title", "status", "error",
                    F.col("document_uid").isNotNull().alias("has_document_id"))


@query("embedding_status")
def q_embedding_status(spark, sf_dir):
    e = KB(spark, sf_dir).embeddings
    return e.groupBy("status").agg(F.count(F.lit(1)).alias("n_vectors"), F.max("attempts").cast("bigint").alias(
        "max_attempts"), F.countDistinct("chunk_id").alias("n_chunks"))


@query("ingest_batch")
def q_ingest_batch(spark, sf_dir):
    req = ingest.requests_from_documents(KB(spark, sf_dir).table("documents"))
    out = scratch_path(spark, "ingest-" + uuid.uuid4().hex)
    ingest.ingest_batch(req, out, batch_id=0, as_of=fx.AS_OF)
    return ingest.ingest_summary(spark, out)


@query("ingest_stream")
def q_ingest_stream(spark, sf_dir):
    from kbspark.streaming.ingest_stream import run_ingest_stream
    out = scratch_path(spark, "ingest-stream-" + uuid.uuid4().hex)
    run_ingest_stream(spark, table_glob(sf_dir, "documents"), out, as_of=fx.AS_OF)
    return ingest.ingest_summary(spark, out)


@query("ingest_embeddings")
def q_ingest_embeddings(spark, sf_dir):
    """Vectors of the default embedder for every token window: dimension and norm per window."""
    kb = KB(spark, sf_dir)
    sub = chunking.token_subchunks(kb.doc_chunks)
    c = sub.select("document_id", "chunk_idx", "subchunk_idx", emb.hashed_counts(F.col("subchunk_text")).alias("c"))
    t = c.withColumn("v", emb.normalize(F.col("c")))
    return t.select("document_id", "chunk_idx", "subchunk_idx", F.size("v").cast("bigint").alias("dim"),
                    F.round(F.sqrt(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)), 3)
                    .alias("norm"),
                    F.element_at("c", 1).cast("bigint").alias("bucket0_count"),
                    F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x).cast("bigint").alias("sum_sq_counts"))


# ---------------------------------------------------------------------------------- importance
@query("importance_exact")
def q_importance_exact(spark, sf_dir):
    d = KB(spark, sf_dir).table("documents").select(F.col("doc_id").alias("document_id"), "text")
    return imp.exact_importance(d).select("document_id", "importance")


@query("importance_lsh")
def q_importance_lsh(spark, sf_dir):
    d = KB(spark, sf_dir).table("documents").select(F.col("doc_id").alias("document_id"), "text")
    return imp.near_importance(d)


@query("importance_similar")
def q_importance_similar(spark, sf_dir):
    d = KB(spark, sf_dir).table("documents").select(F.col("doc_id").alias("document_id"), "text")
    return imp.similar_importance(d)


T_THR, T_RECENT, T_LATEST = "2024-01-10 00:00:00", "2024-01-20 00:00:00", "2024-01-28 00:00:00"


@query("training_selection")
def q_training_selection(spark, sf_dir):
    kb = KB(spark, sf_dir)
    d = kb.table("documents").select(F.col("doc_id").alias("document_id"), "text")
    i = imp.exact_importance(d)
    return imp.select_training(kb.documents, i, T_THR, T_RECENT, 0.5)


@query("training_selection_similar")
def q_training_selection_similar(spark, sf_dir):
    """The training selection with importance by similar documents."""
    kb = KB(spark, sf_dir)
    d = kb.table("documents").select(F.col("doc_id").alias("document_id"), "text")
    return imp.select_training(kb.documents, imp.similar_importance(d), T_THR, T_RECENT, 0.5)


@query("selected_fragments")
def q_selected_fragments(spark, sf_dir):
    """S(D): the two chunks closest to the document centroid, for old important documents."""
    kb = KB(spark, sf_dir)
    d = kb.table("documents").select(F.col("doc_id").alias("document_id"), "text")
    sel = imp.select_training(kb.documents, imp.exact_importance(d), T_THR, T_RECENT, 0.5)
    sel = sel.where(F.array_contains(F.split("reasons", ","), "selected")).select("document_id")
    # the texts are picked before they are cut and embedded: chunks of other documents are never made
    sel = materialize(sel.distinct())
    few = bounded_broadcast(sel)
    chunks = chunking.sentence_chunks(d.join(sel if few is None else few, "document_id", "left_semi"))
    vecs = chunks.select("document_id", "chunk_idx", unit(emb.hashed_counts(F.col("chunk_text"))).alias("vector"))
    f = imp.key_fragments(vecs, 2)
    return f.select("document_id", "chunk_idx", F.col("fragment_rank").cast("bigint").alias("fragment_rank"),
                    F.round("centroid_distance", 6).alias("centroid_distance"))


@query("rag_only_new")
def q_rag_only_new(spark, sf_dir):
    return imp.route_new(KB(spark, sf_dir).documents, T_LATEST, 100)


@query("recent_window")
def q_recent_window(spark, sf_dir):
    return imp.recent_window(KB(spark, sf_dir).documents, 3).select("document_id", "created_at")


# ---------------------------------------------------------------------------------- report
def _monthly(kb: KB) -> DataFrame:
    return report.monthly_by_region(kb.table("orders"), kb.table("customer"), kb.table("nation"), kb.table("region"))


@query("order_dynamics")
def q_order_dynamics(spark, sf_dir):
    return _monthly(KB(spark, sf_dir))


@query("problem_regions")
def q_problem_regions(spark, sf_dir):
    return report.problem_regions(_monthly(KB(spark, sf_dir)))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
