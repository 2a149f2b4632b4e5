"""Knowledge-base entity tables derived from the driver tables.

The derivations are plain arithmetic on ids so that any SQL engine builds identical rows; the
same rules are written as SQL in ``kbspark.plans.oracle``. ``as_of`` for grant expiry is
``AS_OF``; session time zone UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from kbspark.operators.chunking import sentence_chunks
from kbspark.sources.stored import stored
from kbspark.sources.tables import read_table

AS_OF = "2024-01-15 00:00:00"
CHUNKS_PER_DOCUMENT = 1_000_000   # chunk ids leave room for so many chunks of a document
STRIDE = 7919   # a prime: consecutive numbers land on documents all over the table


def _pick(key: Column, values: list[str]) -> Column:
    """values[key] for a small integer key, as a CASE expression (stays in codegen)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(key == i, F.lit(v)) if expr is None else expr.when(key == i, F.lit(v))
    return expr


def document_bound(spark: SparkSession, sf_dir: str) -> Column:
    """One past the largest document id, as a scalar subquery (1 for an empty table)."""
    return read_table(spark, sf_dir, "documents").agg(F.coalesce(F.max("doc_id") + 1, F.lit(1))).scalar()


def kb_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.col("user_id")
    return (read_table(spark, sf_dir, "events").select("user_id").distinct()
            .select(
                uid,
                F.when(uid % 5 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("u"), uid.cast("string"))).alias("external_id"),
                _pick(uid % 3, ["INTERNAL", "VK", "GOOGLE"]).alias("provider"),
                (uid % 7).alias("company_id"),
                _pick(uid % 4, ["UNKNOWN", "INTERNAL", "EXTERNAL", "SYSTEM"]).alias("user_type"),
                F.lit("BASE").alias("role"),
            ))


def kb_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (kb_users(spark, sf_dir).select("company_id").distinct()
            .select("company_id", F.concat(F.lit("company "), F.col("company_id").cast("string")).alias("name")))


def kb_documents(spark: SparkSession, sf_dir: str, with_text: bool = False) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = F.col("doc_id")
    cols = [
        d.alias("document_id"),
        (d % 7).alias("company_id"),
        F.when(d % 11 == 0, F.lit(None).cast("bigint")).otherwise(d % 50).alias("owner_id"),
        _pick(d % 5, ["TEXT_INPUT", "FILE", "URI", "WEB_SCRAPING", "CONFLUENCE"]).alias("source_type"),
        F.concat(F.lit("doc "), d.cast("string")).alias("title"),
        _pick(d % 3, ["PUBLIC", "INTERNAL", "RESTRICTED"]).alias("access_level"),
        F.lit(False).alias("is_hot"),
        (F.col("quality") == 1).alias("is_approved"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=(d % 720).cast("int")))
        .alias("created_at"),
    ]
    if with_text:
        cols.append(F.col("text"))
    # labels is one row per doc_id; a left join keeps unlabelled documents with NULL approval.
    return docs.join(labels, "doc_id", "left").select(*cols)


def kb_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("event_type")
    return read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("grant_id"),
        (F.col("event_id") % document_bound(spark, sf_dir)).alias("document_id"),
        "user_id",
        F.lit("READER").alias("access_role"),
        F.when(et == "error", F.lit(True)).when(et == "signup", F.lit(None).cast("boolean"))
         .otherwise(F.lit(False)).alias("is_revoked"),
        F.when(et == "view", F.lit(None).cast("timestamp")).otherwise(F.col("ts").cast("timestamp"))
         .alias("expires_at"),
    )


def kb_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence chunk of every document, stored once: ``chunk_id = document_id * 10^6 + chunk_idx``."""
    docs = read_table(spark, sf_dir, "documents")

    def build(path: str) -> None:
        c = sentence_chunks(docs.select(F.col("doc_id").alias("document_id"), "text"))
        idx = F.col("chunk_idx").cast("bigint")
        c.select((F.col("document_id") * CHUNKS_PER_DOCUMENT + idx).alias("chunk_id"), "document_id", idx.alias("chunk_idx"), "chunk_text").write.parquet(path)

    return spark.read.parquet(stored(spark, "kb-chunks", [docs], build))


def kb_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to three vectors for every chunk, stored once: the given vectors in turn, all over the chunks."""
    docs, given = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "embeddings")

    def build(path: str) -> None:
        n = given.agg(F.coalesce(F.max("vec_id") + 1, F.lit(1))).first()[0]
        d, i, j = F.col("document_id"), F.col("chunk_idx"), F.col("subchunk_idx")
        rows = kb_chunks(spark, sf_dir).select("chunk_id", d, i, F.explode(F.sequence(F.lit(0).cast("bigint"), (d + i) % 3)).alias("subchunk_idx"))
        state = (d + i + j) % 10
        rows = rows.select(
            (F.col("chunk_id") * 3 + j).alias("embedding_id"), "chunk_id", "subchunk_idx", ((d * 31 + i * 17 + j * 7) % n).alias("vec_id"),
            F.when(state == 9, "FAILED").when(state == 8, "PENDING").otherwise("COMPLETED").alias("status"),
            F.when(state == 9, 3).otherwise(1).alias("attempts"))
        vectors = given.select("vec_id", F.col("embedding").alias("vector"))
        rows.join(vectors, "vec_id").select("embedding_id", "chunk_id", "subchunk_idx", "vector", "status", "attempts").write.parquet(path)

    return spark.read.parquet(stored(spark, "kb-embeddings", [docs, given], build))


def kb_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item is a question; its vector is the embedding with ``vec_id = item_id`` modulo
    the number of vectors and the asking user is ``user_id = item_id``."""
    given = read_table(spark, sf_dir, "embeddings")
    n = given.agg(F.coalesce(F.max("vec_id") + 1, F.lit(1))).scalar()
    b = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    b = b.withColumn("vec_id", F.col("query_id") % n)
    e = given.select("vec_id", F.col("embedding").alias("query_vector"))
    return b.join(e, "vec_id").select("query_id", F.col("query_id").alias("user_id"), "question", "query_vector")


def kb_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asking users with their attributes (NULL attributes when unknown to the store)."""
    q = kb_questions(spark, sf_dir).select("query_id", "user_id")
    return q.join(kb_users(spark, sf_dir), "user_id", "left")


# ---------------------------------------------------------------------------------------------
# Certainty cycle of the fixture replies.
# ---------------------------------------------------------------------------------------------
REPLY_CERTAINTIES = ["high", "MEDIUM", "low", "contradicts"]
# ---------------------------------------------------------------------------------------------


def reply_text(query_id: Column, document_id: Column, doc_rank: Column) -> Column:
    """Deterministic model reply for one (question, document) of the retrieved context.

    ``n = query_id * 1000 + document_id``: n % 7 = 0 → no JSON; n % 5 = 0 → JSON wrapped in
    prose; n % 11 = 0 → a fact without certainty; n % 13 = 0 → an unknown certainty. The
    certainty cycles through ``REPLY_CERTAINTIES``; the update points at fact 1 + doc_rank % 3
    and has an empty fact text when n % 3 = 0.
    """
    n = query_id * 1000 + document_id
    s = lambda c: c.cast("string")
    certs = F.array(*[F.lit(c) for c in REPLY_CERTAINTIES])

    def cert(j):
        return F.element_at(certs, (F.pmod(n + j, F.lit(4)) + 1).cast("int"))

    tag = F.concat(s(query_id), F.lit("-"), s(document_id))
    first_cert = F.when(n % 13 == 0, F.lit("certain")).otherwise(cert(0))
    second = F.when(n % 11 == 0, F.concat(F.lit('{"fact": "fact '), tag, F.lit('-b"}'))).otherwise(
        F.concat(F.lit('{"fact": "fact '), tag, F.lit('-b", "certainty": "'), cert(1), F.lit('"}')))
    upd_fact = F.when(n % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("revised "), tag))
    body = F.concat(
        F.lit('{"answer": "answer '), tag, F.lit('", "reasoning": "doc '), s(document_id),
        F.lit('", "can_answer": true, "new_facts": [{"fact": "fact '), tag, F.lit('-a", "certainty": "'),
        first_cert, F.lit('", "reasoning": "seen in '), s(document_id), F.lit('"}, '), second,
        F.lit('], "updated_facts": [{"id": "'), s(F.lit(1) + doc_rank % 3), F.lit('", "fact": "'), upd_fact,
        F.lit('", "certainty": "'), cert(2), F.lit('", "reasoning": ""}]}'))
    return (F.when(n % 7 == 0, F.concat(F.lit("Sorry, no structured answer {"), s(n)))
            .when(n % 5 == 0, F.concat(F.lit("Here is the result: "), body, F.lit(" Hope it helps.")))
            .otherwise(body))
