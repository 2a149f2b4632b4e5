"""Declared constraints re-aimed as table audits (O-85..O-91).

Every audit is one pass per table: uniqueness by an aggregate on the key (texts by their hash),
references by an anti join of the distinct values, domains by ``count_if`` of the violated condition per rule (all rules of a table
in the same aggregate, unpivoted with ``stack``). Results are small report tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from kbspark.operators.joins import bounded_broadcast, hot_key_join


def narrow_key(df: DataFrame, c: str) -> Column:
    """The column as a grouping key: a text by its SHA-256, so that no body of a document is shuffled."""
    return F.sha2(F.col(c), 256) if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType)) else F.col(c)


def unique_violations(df: DataFrame, table: str, keys: list[str]) -> DataFrame:
    """(table_name, rule, n_violations): keys with NULL parts never collide (SQL unique)."""
    nn = F.lit(True)
    for k in keys:
        nn = nn & F.col(k).isNotNull()
    dup = (df.where(nn).groupBy(*[narrow_key(df, k).alias(f"_k{i}") for i, k in enumerate(keys)])
           .agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1))
    return dup.agg(F.count(F.lit(1)).alias("n_violations")).select(
        F.lit(table).alias("table_name"), F.lit("unique(" + ", ".join(keys) + ")").alias("rule"), "n_violations")


def orphans(child: DataFrame, parent: DataFrame, table: str, fk: str, pk: str, parent_name: str) -> DataFrame:
    """(table_name, rule, n_violations): child rows whose non-NULL ``fk`` has no parent. References are
    counted per value first (combined before the shuffle), so a parent that a third of all rows names
    is one row of the anti join."""
    named = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("_n"))
    o = named.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")
    return o.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_violations")).select(
        F.lit(table).alias("table_name"), F.lit(f"{fk} -> {parent_name}.{pk}").alias("rule"), "n_violations")


def domain_violations(df: DataFrame, table: str, rules: dict[str, Column]) -> DataFrame:
    """(table_name, rule, n_violations) for rules given as 'name' → condition that must hold."""
    aggs = [F.count_if(~F.coalesce(cond, F.lit(False))).alias(f"_r{i}") for i, cond in enumerate(rules.values())]
    counts = df.agg(*aggs)
    names = list(rules)
    stack = "stack({n}, {args}) as (rule, n_violations)".format(
        n=len(names), args=", ".join(f"'{name}', _r{i}" for i, name in enumerate(names)))
    return counts.selectExpr(stack).select(F.lit(table).alias("table_name"), "rule", "n_violations")


def in_domain(c: str, values: list[str]) -> Column:
    return F.col(c).isin(*values)


def max_length(c: str, n: int) -> Column:
    return F.col(c).isNull() | (F.length(F.col(c)) <= n)


def not_null(c: str) -> Column:
    return F.col(c).isNotNull()


def cascade_delete(deleted_companies: DataFrame, companies: DataFrame, users: DataFrame, documents: DataFrame,
                   chunks: DataFrame, embeddings: DataFrame, grants: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting companies: CASCADE down company → users/documents → chunks →
    embeddings and grants; documents owned by a deleted user keep living with ``owner_id``
    NULL (SET NULL). Each level is an anti join against the deleted keys of its parent."""
    dc = deleted_companies.select("company_id").distinct()
    # company ids are few and hot: the deleted set is broadcast after a size check, else salted
    fits = bounded_broadcast(dc) is not None

    def by_company(df: DataFrame, how: str, key: str) -> DataFrame:
        return hot_key_join(df, dc, ["company_id"], how=how, salt_by=[key], small_fits=fits)

    users_left = by_company(users, "left_anti", "user_id")
    users_gone = by_company(users, "left_semi", "user_id").select(F.col("user_id").alias("owner_id"))
    docs_left = by_company(documents, "left_anti", "document_id")
    # an owner may hold a large share of all documents
    docs_left = (hot_key_join(docs_left, users_gone.withColumn("_gone", F.lit(True)), ["owner_id"], how="left", salt_by=["document_id"])
                 .withColumn("owner_id", F.when(F.col("_gone"), F.lit(None).cast("bigint")).otherwise(F.col("owner_id")))
                 .drop("_gone"))
    keep_docs = docs_left.select("document_id")
    chunks_left = chunks.join(keep_docs, "document_id", "left_semi")
    emb_left = embeddings.join(chunks_left.select("chunk_id"), "chunk_id", "left_semi")
    grants_left = (grants.join(keep_docs, "document_id", "left_semi")
                   .join(users_left.select("user_id"), "user_id", "left_semi"))
    return {"companies": companies.join(dc, "company_id", "left_anti"), "users": users_left,
            "documents": docs_left, "chunks": chunks_left, "embeddings": emb_left, "grants": grants_left}
