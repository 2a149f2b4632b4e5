"""Entity schemas, value domains and schema conformance (O-73, O-88, O-91)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# ---------------------------------------------------------------------------------------------
# Enum members as stored (upper-case member names), lengths and dimensions that
# must equal the knowledge-store schema for results to match.
# ---------------------------------------------------------------------------------------------
AUTH_PROVIDERS = ["INTERNAL", "VK", "YANDEX", "GOOGLE"]
USER_TYPES = ["UNKNOWN", "INTERNAL", "EXTERNAL", "SYSTEM"]
USER_ROLES = ["BASE", "MANAGER", "MODERATOR", "ADMIN", "API"]
DOC_ACCESS_ROLES = ["UNKNOWN", "READER", "CONTRIBUTOR", "EDITOR"]
SOURCE_TYPES = ["TEXT_INPUT", "FILE", "URI", "WEB_SCRAPING", "CONFLUENCE"]
DOCUMENT_STATUSES = ["DRAFT", "PUBLISHED", "ARCHIVED", "DELETED"]
ACCESS_LEVELS = ["RESTRICTED", "INTERNAL", "PUBLIC"]
EMBEDDING_STATUSES = ["PENDING", "PROCESSING", "COMPLETED", "FAILED"]
FACT_CERTAINTIES = ["high", "medium", "low", "contradicts"]

TITLE_MAX = 512
NAME_MAX = 255
EXTERNAL_ID_MAX = 255
MODEL_NAME_MAX = 255
SCOPE_MAX = 64
VECTOR_DIM = 384
# ---------------------------------------------------------------------------------------------

VECTOR = T.ArrayType(T.FloatType(), False)

COMPANIES = T.StructType([
    T.StructField("company_id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
])

USERS = T.StructType([
    T.StructField("user_id", T.LongType(), False),
    T.StructField("external_id", T.StringType(), True),
    T.StructField("provider", T.StringType(), False),
    T.StructField("company_id", T.LongType(), True),
    T.StructField("user_type", T.StringType(), True),
    T.StructField("role", T.StringType(), False),
])

DOCUMENTS = T.StructType([
    T.StructField("document_id", T.LongType(), False),
    T.StructField("company_id", T.LongType(), False),
    T.StructField("owner_id", T.LongType(), True),
    T.StructField("source_type", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("access_level", T.StringType(), False),
    T.StructField("is_hot", T.BooleanType(), True),
    T.StructField("is_approved", T.BooleanType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.LongType(), False),
    T.StructField("document_id", T.LongType(), False),
    T.StructField("is_hot", T.BooleanType(), True),
    T.StructField("chunk_text", T.StringType(), False),
    T.StructField("chunk_idx", T.LongType(), False),
    T.StructField("chunk_scope", T.StringType(), True),
    T.StructField("overlap", T.IntegerType(), False),
])

EMBEDDINGS = T.StructType([
    T.StructField("embedding_id", T.LongType(), False),
    T.StructField("chunk_id", T.LongType(), False),
    T.StructField("vector", VECTOR, False, {"dim": VECTOR_DIM}),
    T.StructField("embedding_scope", T.StringType(), False),
    T.StructField("subchunk_idx", T.LongType(), False),
    T.StructField("embedding_model", T.StringType(), False),
    T.StructField("overlap", T.IntegerType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("attempts", T.IntegerType(), False),
    T.StructField("error_message", T.StringType(), True),
])

GRANTS = T.StructType([
    T.StructField("grant_id", T.LongType(), False),
    T.StructField("document_id", T.LongType(), False),
    T.StructField("user_id", T.LongType(), False),
    T.StructField("access_role", T.StringType(), False),
    T.StructField("is_revoked", T.BooleanType(), True),
    T.StructField("expires_at", T.TimestampType(), True),
])

FACT = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("fact", T.StringType(), True),
    T.StructField("certainty", T.StringType(), True),
    T.StructField("reasoning", T.StringType(), True),
])

REPLY = T.StructType([
    T.StructField("answer", T.StringType(), True),
    T.StructField("reasoning", T.StringType(), True),
    T.StructField("new_facts", T.ArrayType(FACT), True),
    T.StructField("updated_facts", T.ArrayType(FACT), True),
    T.StructField("can_answer", T.BooleanType(), True),
])


def with_dimension(schema: T.StructType, dim: int) -> T.StructType:
    """``schema`` for vectors of another length."""
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, "dim": dim} if "dim" in f.metadata else f.metadata)
                         for f in schema.fields])


def _fitted(source: str, field: T.StructField, same_type: bool) -> Column:
    """The column as the target type, NULL (inside an array: a NULL element) where it does not fit; a
    vector of another length than the schema's is NULL whole."""
    c = F.col(source) if same_type else F.col(source).try_cast(_nullable(field.dataType))
    return F.when(F.size(source) == field.metadata["dim"], c) if "dim" in field.metadata else c


def _nullable(kind: T.DataType) -> T.DataType:
    return T.ArrayType(_nullable(kind.elementType), True) if isinstance(kind, T.ArrayType) else kind


def conform(df: DataFrame, schema: T.StructType, renames: dict | None = None,
            defaults: dict | None = None) -> DataFrame:
    """Bring a table written under an older revision to ``schema`` (O-91).

    Renamed columns are taken from their old name, missing columns are back-filled with the
    given default (or NULL), extra columns are dropped and every column, nested ones too, is cast
    with ``try_cast`` semantics so one bad value becomes NULL instead of failing the job; so does a
    vector whose length is not the schema's. ``conform_rejects`` lists the rows and columns where
    that happened. A pure projection: no shuffle, and the Parquet scan reads only the columns used.
    """
    renames, defaults = renames or {}, defaults or {}
    cols = []
    for field in schema.fields:
        source = renames.get(field.name, field.name)
        if source in df.columns:
            same = df.schema[source].dataType.simpleString() == field.dataType.simpleString()
            c = _fitted(source, field, same)
            if field.name in defaults:
                c = F.when(F.col(source).isNull(), F.lit(defaults[field.name]).try_cast(field.dataType)).otherwise(c)
        else:
            c = F.lit(defaults.get(field.name)).try_cast(field.dataType)
        cols.append(c.alias(field.name))
    return df.select(*cols)


def conform_rejects(df: DataFrame, schema: T.StructType, renames: dict | None = None,
                    defaults: dict | None = None) -> DataFrame:
    """The rows of ``df``, as they are, that ``conform`` cannot carry over whole, with ``bad_columns``:
    the target columns whose value (or an element of it) does not fit their type, whose vector has
    another length than the schema's, or which allow no NULL and get one."""
    renames, defaults = renames or {}, defaults or {}
    bad = []
    for field in schema.fields:
        source = renames.get(field.name, field.name)
        if source not in df.columns:
            if not field.nullable and field.name not in defaults:
                bad.append(F.lit(field.name))
            continue
        kind, c = df.schema[source].dataType, F.col(source)
        fitted = _fitted(source, field, kind.simpleString() == field.dataType.simpleString())
        lost = c.isNotNull() & fitted.isNull()
        if isinstance(field.dataType, T.ArrayType) and isinstance(kind, T.ArrayType):
            known = lambda a: F.size(F.filter(a, lambda x: x.isNotNull()))
            short = F.lit(False) if field.dataType.containsNull else F.exists(c, lambda x: x.isNull())
            lost = lost | F.coalesce((known(c) != known(fitted)) | short, F.lit(False))
        if not field.nullable and field.name not in defaults:
            lost = lost | c.isNull()
        bad.append(F.when(lost, F.lit(field.name)))
    none = F.array().cast("array<string>")
    return (df.withColumn("bad_columns", F.array_compact(F.array(*bad)) if bad else none)
            .where(F.size("bad_columns") > 0))
