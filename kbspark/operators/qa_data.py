"""Question-answering training data preparation (O-04, O-05, O-11, O-24..O-26, O-41, O-96).

Examples are rows (context, question, answer_text). Loaders turn nested SQuAD-shaped JSON or
JSON-lines yes/no data into that shape with explode chains; formatting, tokenising, length
limits, padding and label masking are column expressions on arrays, so a whole training
export is one narrow Spark pass plus one de-duplicating aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kbspark.functions.text import BLANK, strip_blanks

# ---------------------------------------------------------------------------------------------
# Input markers of the QA model, special token ids, label mask value, default
# length limits of the source (context + question) and target (answer) sides.
# ---------------------------------------------------------------------------------------------
CONTEXT_MARKER = "[КОНТЕКСТ]"
QUESTION_MARKER = "[ВОПРОС]"
PAD_ID = 0
EOS_ID = 1
LABEL_MASK = -100
SOURCE_MAX_TOKENS = 396
TARGET_MAX_TOKENS = 32
# ---------------------------------------------------------------------------------------------

VOCAB = 32000
FIRST_ID = 2

SQUAD_SCHEMA = T.StructType([T.StructField("data", T.ArrayType(T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("paragraphs", T.ArrayType(T.StructType([
        T.StructField("context", T.StringType()),
        T.StructField("qas", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("question", T.StringType()),
            T.StructField("answers", T.ArrayType(T.StructType([
                T.StructField("text", T.StringType()), T.StructField("answer_start", T.LongType())]))),
        ]))),
    ]))),
])))])

YESNO_SCHEMA = T.StructType([T.StructField("passage", T.StringType()), T.StructField("question", T.StringType()),
                             T.StructField("label", T.BooleanType()), T.StructField("idx", T.LongType())])


def squad_rows(nested: DataFrame) -> DataFrame:
    """Nested SQuAD document(s) → (title, context, question_id, question, answer_text = first answer)."""
    art = nested.select(F.explode("data").alias("a"))
    par = art.select(F.col("a.title").alias("title"), F.explode("a.paragraphs").alias("p"))
    qa = par.select("title", F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return qa.select("title", "context", F.col("q.id").alias("question_id"), F.col("q.question").alias("question"),
                     F.element_at(F.col("q.answers"), 1)["text"].alias("answer_text"))


def load_squad(spark: SparkSession, path: str, extraction: Callable[[DataFrame], DataFrame] = squad_rows,
               multi_line: bool = True) -> DataFrame:
    """SQuAD-shaped JSON → examples; ``extraction`` is the caller's row extractor. Files are one
    JSON document each (``multi_line``) or JSON lines with one document per line."""
    return spark.read.schema(SQUAD_SCHEMA).option("multiLine", multi_line).json(path).transform(extraction)


def yesno_rows(df: DataFrame, yes: str = "да", no: str = "нет") -> DataFrame:
    return df.select(F.col("passage").alias("context"), "question",
                     F.when(F.col("label"), F.lit(yes)).otherwise(F.lit(no)).alias("answer_text"))


def load_yesno(spark: SparkSession, path: str, yes: str = "да", no: str = "нет") -> DataFrame:
    """JSON-lines yes/no QA (passage, question, label) → examples with caller-chosen labels."""
    return yesno_rows(spark.read.schema(YESNO_SCHEMA).json(path), yes, no)


def conversation_examples(conversations: DataFrame) -> DataFrame:
    """Examples from dialog turns: question = a user turn, answer = the next turn when it is an
    assistant turn, context = the previous turn ('' when none)."""
    from kbspark.operators.mixing import with_neighbours
    t = with_neighbours(conversations.select("conv_id", "turn", "role", "text"), "conv_id", "turn", ["role", "text"])
    return t.where((F.col("role") == "user") & (F.col("next_role") == "assistant")).select(
        "conv_id", "turn", F.coalesce(F.col("prev_text"), F.lit("")).alias("context"),
        F.col("text").alias("question"), F.col("next_text").alias("answer_text"))


def format_input(context: Column, question: Column, context_marker: str = CONTEXT_MARKER,
                 question_marker: str = QUESTION_MARKER) -> Column:
    """marker + context + marker + question (O-11)."""
    return F.concat(F.lit(context_marker), F.coalesce(context, F.lit("")), F.lit(question_marker),
                    F.coalesce(question, F.lit("")))


def token_ids(text: Column) -> Column:
    """Default tokenizer slot: blank-separated tokens mapped to ids by a hash (2 … VOCAB+1)."""
    toks = F.filter(F.split(strip_blanks(F.coalesce(text, F.lit(""))), f"{BLANK}+"), lambda t: t != "")
    return F.transform(toks, lambda t: (F.pmod(F.conv(F.substring(F.md5(t), 1, 6), 16, 10).cast("bigint"),
                                                F.lit(VOCAB)) + F.lit(FIRST_ID)).cast("int"))


def encode(ids: Column, max_len: int) -> Column:
    """Truncate to ``max_len`` with the end token kept, then pad to ``max_len`` (O-24)."""
    body = F.concat(F.slice(ids, 1, max_len - 1), F.array(F.lit(EOS_ID)))
    return F.concat(body, F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size(body)))


def attention_mask(encoded: Column) -> Column:
    return F.transform(encoded, lambda x: F.when(x == PAD_ID, F.lit(0)).otherwise(F.lit(1)))


def mask_labels(encoded: Column) -> Column:
    """Pad id → −100 so the loss ignores padding (O-25)."""
    return F.transform(encoded, lambda x: F.when(x == PAD_ID, F.lit(LABEL_MASK)).otherwise(x))


def unmask_labels(labels: Column) -> Column:
    return F.transform(labels, lambda x: F.when(x == LABEL_MASK, F.lit(PAD_ID)).otherwise(x))


def length_filter(examples: DataFrame, max_context_tokens: int, max_text_tokens: int,
                  order_cols: list[str], drop_duplicates: bool = True) -> DataFrame:
    """Keep examples within both token limits; optionally one example per (context, question),
    the first in ``order_cols`` order. The de-duplication is an aggregate (min over a struct),
    so copies are combined map-side before the shuffle and a heavily copied pair costs no more
    than a single row per map task (O-26)."""
    e = examples.where((F.size(token_ids(F.col("context"))) <= max_context_tokens)
                       & (F.size(token_ids(F.col("question"))) <= max_text_tokens))
    if not drop_duplicates:
        return e
    # texts are grouped by their hashes; the texts themselves travel once per group and map task
    first = F.min(F.struct(*[F.col(c) for c in order_cols], *[F.col(c).alias("_" + c) for c in e.columns]))
    g = e.groupBy(*[F.sha2(c, 256).alias("_h" + c) for c in ("context", "question")]).agg(first.alias("_f"))
    other = [c for c in e.columns if c not in ("context", "question")]
    return g.select(*[F.col("_f._" + c).alias(c) for c in ["context", "question", *other]])
