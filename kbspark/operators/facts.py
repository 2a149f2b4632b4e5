"""Structured reply parsing and the ordered fact fold (O-15, O-45, O-46, O-54, O-69, O-81).

Reply parse (all or nothing): take the text from the first ``{`` to the last ``}``, decode it
with an explicit schema, lower-case every certainty and require it in the domain, require
``fact`` and ``certainty`` on every fact; anything else gives the blank reply
(answer "", no facts, can_answer false): single quotes, text behind the object, a null or a
non-list where a list belongs. Missing ``reasoning`` → "", missing ``id`` → NULL; an id may be a
number and is compared as text.

Fact fold, per question over its documents in rank order:
1. the answer becomes the document's reply answer, even when blank;
2. each new fact in array order is skipped when ``contradicts``, else gets id ++counter;
3. each update is skipped when its id is blank or not currently present; ``contradicts``
   deletes the fact; otherwise each field is replaced by the update's value when non-empty.

``fold_facts`` is the relational equivalent (windows + anti join, one plan for all
questions); ``fold_facts_sequential`` runs the literal loop per question inside
``applyInPandas`` for when a model produces the replies on the fly.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from kbspark.operators.context import REQUEST_TASK
from kbspark.schema import FACT_CERTAINTIES, REPLY

# Fixed value: the answer text of a question whose processing failed (confidence 0).
ERROR_ANSWER = "Error processing request"


# ----------------------------------------------------------------------------------- parsing
def _fact_ok(f: Column) -> Column:
    return (f["fact"].isNotNull() & f["certainty"].isNotNull()
            & F.lower(f["certainty"]).isin(*FACT_CERTAINTIES))


def _clean_fact(f: Column) -> Column:
    return F.struct(f["id"].alias("id"), f["fact"].alias("fact"), F.lower(f["certainty"]).alias("certainty"),
                    F.coalesce(f["reasoning"], F.lit("")).alias("reasoning"))


def _list_ok(strict: Column, field: str, decoded: Column) -> Column:
    """The field is absent, or a list of which every element was decoded."""
    there = F.try_variant_get(strict, f"$[0].{field}", "variant").isNotNull()
    items = F.try_variant_get(strict, f"$[0].{field}", "array<variant>")
    return ~there | F.coalesce(F.size(items) == F.size(decoded), F.lit(False))


def parse_reply(text: Column) -> Column:
    """Reply text → struct<answer, reasoning, new_facts, updated_facts, can_answer, valid>."""
    start = F.locate("{", text)
    end = F.length(text) - F.locate("}", F.reverse(text)) + 1
    has = (start > 0) & (F.locate("}", F.reverse(text)) > 0) & (end >= start)
    body = F.when(has, text.substr(start, end - start + 1))
    # the variant parser takes no single quotes; inside a list nothing may stand behind the object
    strict = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    alone = F.coalesce(F.size(F.try_variant_get(strict, "$", "array<variant>")) == 1, F.lit(False))
    decoded = F.from_json(body, REPLY, {"allowSingleQuotes": "false"})
    new = F.coalesce(decoded["new_facts"], F.array().cast(REPLY["new_facts"].dataType))
    upd = F.coalesce(decoded["updated_facts"], F.array().cast(REPLY["updated_facts"].dataType))
    valid = (alone & _list_ok(strict, "new_facts", new) & _list_ok(strict, "updated_facts", upd)
             & F.forall(new, _fact_ok) & F.forall(upd, _fact_ok))
    empty = F.array().cast(REPLY["new_facts"].dataType)
    return F.struct(
        F.when(valid, F.coalesce(decoded["answer"], F.lit(""))).otherwise(F.lit("")).alias("answer"),
        F.when(valid, F.coalesce(decoded["reasoning"], F.lit(""))).otherwise(F.lit("")).alias("reasoning"),
        F.when(valid, F.transform(new, _clean_fact)).otherwise(empty).alias("new_facts"),
        F.when(valid, F.transform(upd, _clean_fact)).otherwise(empty).alias("updated_facts"),
        F.when(valid, F.coalesce(decoded["can_answer"], F.lit(False))).otherwise(F.lit(False)).alias("can_answer"),
        F.coalesce(valid, F.lit(False)).alias("valid"),
    )


# ----------------------------------------------------------------------------- relational fold
def _fact_log(replies: DataFrame):
    """(created facts with ids, valid updates) from parsed replies (query_id, doc_rank, reply)."""
    new = (replies.select("query_id", "doc_rank", F.posexplode("reply.new_facts").alias("pos", "f"))
           .where(F.col("f.certainty") != "contradicts"))
    w = Window.partitionBy("query_id").orderBy("doc_rank", "pos")
    created = new.select("query_id", F.row_number().over(w).cast("string").alias("fact_id"),
                         F.col("doc_rank").alias("created_rank"), F.col("f.fact").alias("fact"),
                         F.col("f.certainty").alias("certainty"), F.col("f.reasoning").alias("reasoning"))
    upd = (replies.select("query_id", "doc_rank", F.posexplode("reply.updated_facts").alias("upos", "u"))
           .where(F.col("u.id").isNotNull() & (F.trim(F.col("u.id")) != ""))
           .select("query_id", F.col("doc_rank").alias("u_rank"), "upos", F.col("u.id").alias("fact_id"),
                   F.col("u.fact").alias("u_fact"), F.col("u.certainty").alias("u_certainty"),
                   F.col("u.reasoning").alias("u_reasoning")))
    # An update counts when its fact exists by then (created in the same or an earlier document).
    valid_upd = (upd.join(created.select("query_id", "fact_id", "created_rank"), ["query_id", "fact_id"])
                 .where(F.col("created_rank") <= F.col("u_rank")).drop("created_rank"))
    return created, valid_upd


def _last_nonempty(c: str) -> Column:
    return F.max_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("u_rank", "upos")))


def _apply_edits(facts: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    latest = edits.groupBy(*keys).agg(_last_nonempty("u_fact").alias("u_fact"),
                                      _last_nonempty("u_certainty").alias("u_certainty"),
                                      _last_nonempty("u_reasoning").alias("u_reasoning"))
    return (facts.join(latest, keys, "left")
            .withColumn("fact", F.coalesce(F.col("u_fact"), F.col("fact")))
            .withColumn("certainty", F.coalesce(F.col("u_certainty"), F.col("certainty")))
            .withColumn("reasoning", F.coalesce(F.col("u_reasoning"), F.col("reasoning")))
            .drop("u_fact", "u_certainty", "u_reasoning"))


def fold_facts(replies: DataFrame) -> DataFrame:
    """Surviving facts per question: (query_id, fact_id, created_rank, fact, certainty, reasoning).

    ``replies``: (query_id, doc_rank, reply) with ``reply`` from ``parse_reply``. Facts with a
    valid ``contradicts`` update are removed by an anti join (a later update cannot revive
    them, ids are never reused); each field is the last non-empty valid update, else the
    original value.
    """
    created, valid_upd = _fact_log(replies)
    deleted = valid_upd.where(F.col("u_certainty") == "contradicts").select("query_id", "fact_id").distinct()
    edits = valid_upd.where(F.col("u_certainty") != "contradicts")
    alive = created.join(deleted, ["query_id", "fact_id"], "left_anti")
    return _apply_edits(alive, edits, ["query_id", "fact_id"]).select(
        "query_id", "fact_id", "created_rank", "fact", "certainty", "reasoning")


def facts_before(replies: DataFrame) -> DataFrame:
    """The fact state each document's request sees (O-54): (query_id, doc_rank, fact_id, fact,
    certainty, reasoning) for facts created in an earlier document and not deleted before it,
    with the edits of earlier documents applied. Joins stay inside one question, whose
    documents are bounded by the retrieval top-k."""
    created, valid_upd = _fact_log(replies)
    deleted_at = (valid_upd.where(F.col("u_certainty") == "contradicts")
                  .groupBy("query_id", "fact_id").agg(F.min("u_rank").alias("deleted_rank")))
    docs = replies.select("query_id", "doc_rank")
    alive = (docs.join(created, "query_id").where(F.col("created_rank") < F.col("doc_rank"))
             .join(deleted_at, ["query_id", "fact_id"], "left")
             .where(F.col("deleted_rank").isNull() | (F.col("deleted_rank") >= F.col("doc_rank")))
             .drop("deleted_rank"))
    edits = (valid_upd.where(F.col("u_certainty") != "contradicts")
             .join(docs, "query_id").where(F.col("u_rank") < F.col("doc_rank")))
    return _apply_edits(alive, edits, ["query_id", "doc_rank", "fact_id"]).select(
        "query_id", "doc_rank", "fact_id", "fact", "certainty", "reasoning")


# ---------------------------------------------------------------------------------------------
# Fixed value: the result text of a question whose processing failed.
# ---------------------------------------------------------------------------------------------
FAILED_RESULT = "Error processing request"
# ---------------------------------------------------------------------------------------------


def answer_summary(questions: DataFrame, replies: DataFrame, facts: DataFrame, used: DataFrame, errors: DataFrame | None = None,
                   provider: str = "", elapsed: DataFrame | None = None) -> DataFrame:
    """One answer row per question (O-15, O-45, O-46, O-47): last answer, its facts in fact-id order and
    their number, confidence = min(1, 0.2·facts), reasoning lines in that order, used ids, the
    provider's name, ``processing_time_ms``, ``warnings`` and ``truncated``.

    ``errors`` (query_id, error): questions whose processing failed; their row has the fixed result
    text, no facts and ids, confidence 0 and the error as reasoning. ``elapsed`` (query_id,
    processing_time_ms): times measured by the caller; NULL without it.
    """
    last = (replies.groupBy("query_id")
            .agg(F.max_by(F.col("reply.answer"), F.col("doc_rank")).alias("final_result")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("fact_id").cast("bigint").alias("k"), F.col("fact_id").alias("id"), "fact", "certainty", "reasoning")))
    known = facts.groupBy("query_id").agg(F.transform(ordered, lambda x: x.dropFields("k")).alias("facts"))
    no_facts, no_lines = F.array().cast(known.schema["facts"].dataType), F.array().cast("array<string>")
    rows = (questions.select("query_id").join(last, "query_id", "left").join(known, "query_id", "left").join(used, "query_id", "left"))
    if errors is not None:
        rows = rows.join(errors.groupBy("query_id").agg(F.min("error").alias("_error")), "query_id", "left")
    else:
        rows = rows.withColumn("_error", F.lit(None).cast("string"))
    if elapsed is not None:
        rows = rows.join(elapsed.select("query_id", "processing_time_ms"), "query_id", "left")
    else:
        rows = rows.withColumn("processing_time_ms", F.lit(None).cast("bigint"))
    fine = F.col("_error").isNull()
    rows = rows.withColumn("facts", F.when(fine, F.coalesce("facts", no_facts)).otherwise(no_facts))
    text = lambda c: F.when(fine, F.coalesce(F.col(c), F.lit(""))).otherwise(F.lit("")).alias(c)
    return rows.select(
        "query_id", F.when(fine, F.coalesce("final_result", F.lit(""))).otherwise(F.lit(FAILED_RESULT)).alias("final_result"),
        "facts", F.size("facts").cast("bigint").alias("n_facts"),
        F.round(F.least(F.lit(1.0), F.size("facts") * F.lit(0.2)), 6).alias("confidence"),
        F.coalesce(F.col("_error"), F.array_join(F.transform("facts", lambda x: x["reasoning"]), "\n")).alias("reasoning"),
        text("used_documents"), text("used_chunks"), F.lit(provider).alias("llm_provider"),
        F.col("processing_time_ms").cast("bigint").alias("processing_time_ms"), no_lines.alias("warnings"), F.lit(False).alias("truncated"))


# ----------------------------------------------------------------------------- sequential fold
def json_as(value, kind: T.DataType):
    """A decoded JSON value as the Spark type ``kind`` of the reply schema, as ``from_json`` reads
    it; ValueError where a container is not one."""
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            raise ValueError(f"not an object: {value!r}")
        return {f.name: json_as(value[f.name], f.dataType) if f.name in value else None for f in kind}
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            raise ValueError(f"not a list: {value!r}")
        return [json_as(v, kind.elementType) for v in value]
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))


# What a decoded field becomes; a check that fails makes the whole reply blank.
_FACT_FIELDS: dict[str, Callable] = {
    "id": lambda v: v,
    "fact": lambda v: _required(v),
    "certainty": lambda v: _one_of(_required(v).lower(), FACT_CERTAINTIES),
    "reasoning": lambda v: v or "",
}
_REPLY_FIELDS: dict[str, Callable] = {
    "answer": lambda v: v or "",
    "reasoning": lambda v: v or "",
    "new_facts": lambda v: [_each(_FACT_FIELDS, f) for f in v or []],
    "updated_facts": lambda v: [_each(_FACT_FIELDS, f) for f in v or []],
    "can_answer": lambda v: bool(v),
}


def _required(value):
    if value is None:
        raise ValueError("missing")
    return value


def _one_of(value, domain):
    if value not in domain:
        raise ValueError(value)
    return value


def _each(fields: dict[str, Callable], record: dict) -> dict:
    return {name: make(record[name]) for name, make in fields.items()}


def parse_reply_py(text: str | None) -> dict:
    """``parse_reply`` for one Python string, driven by the same schema."""
    found = re.search(r"\{.*\}", text or "", re.DOTALL)
    try:
        return _each(_REPLY_FIELDS, json_as(json.loads(found.group()), REPLY))
    except (AttributeError, ValueError):   # no braces, no JSON, or a check that failed
        return _each(_REPLY_FIELDS, dict.fromkeys(_REPLY_FIELDS))


class Event(NamedTuple):
    """One step of a question's history: ``answer``, ``create``, ``edit`` or ``delete``."""

    kind: str
    fact_id: str | None = None
    values: dict | None = None


@dataclass(frozen=True)
class FactState:
    """Facts of one question so far; ids count up and are never used again."""

    answer: str = ""
    created: int = 0
    facts: Mapping[str, dict] = field(default_factory=dict)

    def after(self, event: Event) -> FactState:
        values = {k: v for k, v in (event.values or {}).items() if k in FACT_VALUES}
        if event.kind == "answer":
            return replace(self, answer=event.values["answer"])
        if event.kind == "create":
            return replace(self, created=self.created + 1, facts={**self.facts, str(self.created + 1): values})
        if event.fact_id not in self.facts:
            return self
        rest = {k: v for k, v in self.facts.items() if event.kind != "delete" or k != event.fact_id}
        if event.kind == "edit":
            rest[event.fact_id] = {**rest[event.fact_id], **{k: v for k, v in values.items() if v}}
        return replace(self, facts=rest)


FACT_VALUES = ("fact", "certainty", "reasoning")


def reply_events(reply: dict) -> list[Event]:
    """What one parsed reply does to the state, in order."""
    gone = "contradicts"
    return [
        Event("answer", values=reply),
        *[Event("create", values=f) for f in reply["new_facts"] if f["certainty"] != gone],
        *[Event("delete" if u["certainty"] == gone else "edit", u["id"], u) for u in reply["updated_facts"] if (u["id"] or "").strip()],
    ]


def request_of(row: Mapping, state: FactState) -> str:
    """The request that a generator sees for one document."""
    return json.dumps({
        "task": REQUEST_TASK, "question": row.get("question"), "document_context": json.loads(row.get("context_json") or "[]"),
        "previous_facts": [{"id": k, **v} for k, v in state.facts.items()], "previous_answer": state.answer,
        "dialog_history": row.get("dialog_history") or ""}, ensure_ascii=False)


def fold_facts_sequential(rows: DataFrame, generate) -> DataFrame:
    """The fold with a generator in the loop (O-81 + O-84): each document's request holds the state
    that the replies before it left.

    ``rows``: (query_id, doc_rank, question, context_json, dialog_history, and whatever the
    generator reads). ``generate(request_json: str, row: dict) -> str`` runs once per document in
    rank order. One row per surviving fact: (query_id, fact_id, fact, certainty, reasoning,
    final_result), or one with null fact columns. Questions run in parallel; a question's
    documents (at most the top-k) are one small group. A question whose processing raises gives
    one row with ``final_result`` = ``ERROR_ANSWER``; the others are unaffected.
    """
    import pandas as pd

    names = ["query_id", "fact_id", *FACT_VALUES, "final_result"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        query_id = int(pdf["query_id"].iloc[0])
        state = FactState()
        try:
            for row in pdf.sort_values("doc_rank").to_dict("records"):
                state = reduce(FactState.after, reply_events(parse_reply_py(generate(request_of(row, state), row))), state)
        except Exception:  # noqa: BLE001 - a failing question gives its error answer only
            state = FactState(answer=ERROR_ANSWER)
        table = [(query_id, k, *[v[c] for c in FACT_VALUES], state.answer) for k, v in state.facts.items()]
        return pd.DataFrame(table or [(query_id, None, None, None, None, state.answer)], columns=names)

    return rows.groupBy("query_id").applyInPandas(
        run, "query_id long, fact_id string, fact string, certainty string, reasoning string, final_result string")
