"""Row-level access policies over documents (O-17..O-20, O-23, O-31, O-62).

Two policies exist and disagree in corner cases; both are built and named:

* ``list_policy`` — the OR of four branches used to filter documents before retrieval:
  PUBLIC ∧ approved ∧ same company; owner; INTERNAL ∧ caller INTERNAL ∧ same company;
  a live grant.
* ``point_policy`` — the ordered per-document decision: PUBLIC documents are decided by
  approval and company alone (anonymous callers see every approved PUBLIC document);
  otherwise owner; otherwise INTERNAL by caller type and company; otherwise a live grant.

Both are computed for a whole table of callers at once as a union of equi-joins, never as a
callers × documents product. The company joins have very few distinct keys, so they go
through ``hot_key_join`` (size-checked broadcast of callers, else salting). Retrieval does not use
these rows: it tests the list policy per candidate (``scoped.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kbspark.operators.joins import bounded_broadcast, hot_key_join


def live_grants(grants: DataFrame, as_of: str) -> DataFrame:
    """Grants that are neither revoked nor expired at ``as_of`` (O-19).

    ``is_revoked`` NULL is *not* live (``= false`` is not satisfied by NULL); an expiry exactly
    at ``as_of`` is still live. Both comparisons push down to the Parquet scan.
    """
    ts = F.lit(as_of).cast("timestamp")
    return (grants.where((F.col("is_revoked") == F.lit(False))
                         & (F.col("expires_at").isNull() | (F.col("expires_at") >= ts)))
            .select("user_id", "document_id"))


_DOC = ["document_id", "company_id", "owner_id", "access_level", "is_approved"]


def _known(callers: DataFrame) -> DataFrame:
    return callers.where(F.col("user_id").isNotNull()).select("user_id", F.col("company_id").alias("_company"), "user_type").distinct()


def _same_company(docs: DataFrame, callers: DataFrame, fits: bool) -> DataFrame:
    """Documents beside the callers of their company (few distinct keys: broadcast if small, else salted)."""
    c = callers.withColumnRenamed("_company", "company_id").where(F.col("company_id").isNotNull())
    return hot_key_join(docs, c, ["company_id"], salt_by=["document_id"], small_fits=fits)


def _owned(docs: DataFrame, callers: DataFrame, fits: bool) -> DataFrame:
    """Documents beside the caller that owns them; one owner may hold a large share of all documents."""
    c = callers.withColumn("owner_id", F.col("user_id"))
    return hot_key_join(docs.where(F.col("owner_id").isNotNull()), c, ["owner_id"], salt_by=["document_id"], small_fits=fits)


def _granted(docs: DataFrame, grants: DataFrame, callers: DataFrame, as_of: str, fits: bool) -> DataFrame:
    """Documents beside the callers that hold a live grant, each pair once."""
    g = hot_key_join(live_grants(grants, as_of).distinct(), callers, ["user_id"], salt_by=["document_id"], small_fits=fits)
    return g.join(docs, "document_id")


def _fits(callers: DataFrame) -> bool:
    """One size check of the caller table for all joins of a policy."""
    return bounded_broadcast(callers) is not None


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def list_policy(documents: DataFrame, callers: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    """(user_id, document_id) for every document each caller may read under the list form. The branches
    exclude each other row by row, so no pair arises twice and none has to be removed by a shuffle."""
    docs, known = documents.select(*_DOC), _known(callers)
    fits = _fits(known)
    approved = _yes((F.col("access_level") == "PUBLIC") & F.col("is_approved"))
    company = _yes(F.col("company_id") == F.col("_company"))
    inside = _yes((F.col("access_level") == "INTERNAL") & (F.col("user_type") == "INTERNAL")) & company
    own = _yes(F.col("owner_id") == F.col("user_id"))
    # one pass over documents for both company branches
    by_company = _same_company(docs.where(F.col("access_level").isin("PUBLIC", "INTERNAL")), known, fits).where(
        approved | _yes((F.col("access_level") == "INTERNAL") & (F.col("user_type") == "INTERNAL")))
    owned = _owned(docs, known, fits).where(~((approved & company) | inside))
    granted = _granted(docs, grants, known, as_of, fits).where(~((approved & company) | inside | own))
    return _pairs(by_company, owned, granted)


def point_policy(documents: DataFrame, callers: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    """(user_id, document_id) visible under the ordered point form; anonymous callers
    (``user_id`` NULL) appear with ``user_id`` NULL. Branches exclude each other as in ``list_policy``."""
    docs, known = documents.select(*_DOC), _known(callers)
    fits = _fits(known)
    anonymous = F.broadcast(callers.where(F.col("user_id").isNull()).limit(1).select(F.lit(1).alias("_any")))
    approved = _yes((F.col("access_level") == "PUBLIC") & F.col("is_approved"))
    by_company = _same_company(docs.where(F.col("access_level").isin("PUBLIC", "INTERNAL")), known, fits).where(
        approved | _yes((F.col("access_level") == "INTERNAL") & (F.col("user_type") == "INTERNAL")))
    # existence only: every approved PUBLIC document once, if any caller is anonymous
    unnamed = docs.where(approved).withColumn("_any", F.lit(1)).join(anonymous, "_any", "left_semi").select(
        F.lit(None).cast(known.schema["user_id"].dataType).alias("user_id"), "document_id")
    inside = _yes((F.col("access_level") == "INTERNAL") & (F.col("user_type") == "INTERNAL") & (F.col("company_id") == F.col("_company")))
    own = _yes(F.col("owner_id") == F.col("user_id"))
    owned = _owned(docs.where(F.col("access_level") != "PUBLIC"), known, fits).where(~inside)
    granted = _granted(docs.where(F.col("access_level") == "RESTRICTED"), grants, known, as_of, fits).where(~own)
    return _pairs(by_company, unnamed, owned, granted)


def _pairs(*branches: DataFrame) -> DataFrame:
    out = branches[0].select("user_id", "document_id")
    for b in branches[1:]:
        out = out.unionByName(b.select("user_id", "document_id"))
    return out


def point_access_flag(pairs: DataFrame, grants: DataFrame, as_of: str) -> DataFrame:
    """Point-form decision as a boolean column ``has_access`` for given (caller, document)
    rows: ``pairs`` carries document columns and caller columns ``user_id``,
    ``user_company_id``, ``user_type``. The live-grant flag comes from one left join."""
    g = live_grants(grants, as_of).distinct().withColumn("_grant", F.lit(True))
    p = pairs.join(g, ["user_id", "document_id"], "left")
    anon = F.col("user_id").isNull()
    decision: Column = (
        F.when(F.col("access_level") == "PUBLIC",
               F.coalesce(F.col("is_approved"), F.lit(False))
               & (anon | F.coalesce(F.col("user_company_id") == F.col("company_id"), F.lit(False))))
        .when(anon, F.lit(False))
        .when(F.coalesce(F.col("owner_id") == F.col("user_id"), F.lit(False)), F.lit(True))
        .when(F.col("access_level") == "INTERNAL",
              F.coalesce((F.col("user_type") == "INTERNAL") & (F.col("user_company_id") == F.col("company_id")),
                         F.lit(False)))
        .otherwise(F.coalesce(F.col("_grant"), F.lit(False)))
    )
    return p.withColumn("has_access", decision).drop("_grant")


def policy_diff(list_rows: DataFrame, point_rows: DataFrame) -> DataFrame:
    """Where the two policies disagree: rows visible under only one of them."""
    a = list_rows.select("user_id", "document_id")
    b = point_rows.select("user_id", "document_id")
    return (a.exceptAll(b).withColumn("visible_in", F.lit("list_only"))
            .unionByName(b.exceptAll(a).withColumn("visible_in", F.lit("point_only"))))


def restrict_to_requested(accessible: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply a question's optional ``doc_ids`` restriction (O-20, O-23).

    ``accessible`` is (query_id, document_id, ...); ``requests`` is (query_id, doc_ids array or
    NULL). NULL means no restriction; an empty array means nothing is returned for that
    question. Implemented as a semi join against the exploded ids, so no list is collected.
    """
    unrestricted = requests.where(F.col("doc_ids").isNull()).select("query_id")
    wanted = (requests.where(F.col("doc_ids").isNotNull())
              .select("query_id", F.explode("doc_ids").alias("document_id")).distinct())
    return (accessible.join(unrestricted, "query_id", "left_semi")
            .unionByName(accessible.join(wanted, ["query_id", "document_id"], "left_semi")))
