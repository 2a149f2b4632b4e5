"""Quality rules as a short-circuit cascade, on DataFrame functions only.

Each rule is an expression that says whether a document is rejected. On a bounded sample
(``SAMPLE_ROWS`` documents, written once) every rule is run alone: the share it rejects is its
selectivity, its running time over that of reading the sample its cost. The rules then run in the order of rejection
per cost inside one CASE expression, which stops at the first rule that rejects, so costly rules
see few documents. The order changes cost only: a document is kept if no rule rejects it.

Words are ``[^\\x20\\x09-\\x0D]+``. A null text has no words. Repeated rows, null ids and extra
columns are kept; columns with the names of the figures are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 1000
SAMPLE_SHARE = 0.02

FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def lines_of(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word runs that occur twice or more among ``words``.

    Hashes of the runs are compared; only where two agree are their places sorted, and the words
    they cover counted in one pass over the places."""
    def covered(hashes: Column) -> Column:
        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            def twice(j: Column) -> Column:
                own = F.get(s, j)["h"]
                return F.when((own == F.get(s, j - 1)["h"]) | (own == F.get(s, j + 1)["h"]), F.get(s, j)["i"])
            return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), twice), lambda i: i.isNotNull()))

        first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last"))
        return F.aggregate(let(by_hash, places), first, lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])

    def runs(hashes: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(hashes) - window), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(window)]))
        return let(each, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), runs))


def figures(text: Column, words: Column) -> dict[str, Column]:
    """The base figures of a text and its words, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = lines_of(text)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def base_failed(d: dict[str, Column]) -> Column:
    return (d["n_words"] < 20) | (100 * d["n_repeat_words"] > 30 * d["n_words"])


@dataclass(frozen=True)
class Rule:
    """``reject`` gets the figures, ``text`` and ``words`` as columns and gives a boolean."""

    name: str
    reject: Callable[[dict[str, Column]], Column]


def _share(words: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(words, test))


#: The rules of the production query.
RULES = [
    Rule("symbols", lambda d: 10 * d["n_symbols"] > d["n_words"]),
    Rule("word_length", lambda d: (d["word_chars"] < 2 * d["n_words"]) | (d["word_chars"] > 15 * d["n_words"])),
    Rule("duplicate_lines", lambda d: 2 * d["n_dup_lines"] > F.size(lines_of(d["text"]))),
    Rule("few_letters", lambda d: 10 * _share(d["words"], lambda w: w.rlike(r"\p{L}")) < 7 * d["n_words"]),
    Rule("capitals", lambda d: 2 * _share(d["words"], lambda w: w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")) > d["n_words"]),
    Rule("vocabulary", lambda d: let(F.size(F.array_distinct(d["words"])), lambda n: (5 * n < d["n_words"]) & (n < 1000))),
]


def _judge(docs: DataFrame, text_col: str, verdict: Callable[[dict[str, Column]], Column]) -> DataFrame:
    """``docs`` with the figures and ``verdict`` of (figures, text, words); one expression per row."""
    text = F.col(text_col)

    def body(words: Column) -> Column:
        f = figures(text, words)
        return let(F.struct(*[c.alias(k) for k, c in f.items()]), lambda s: F.struct(
            *[s[k].alias(k) for k in f], base_failed({k: s[k] for k in f}).alias("base_failed"),
            verdict({**{k: s[k] for k in f}, "text": F.coalesce(text, F.lit("")), "words": words}).alias("failed_rule")))
    q = let(words_of(text), body)
    keep = [c for c in docs.columns if c not in {*FIGURES, "base_failed", "failed_rule"}]
    return docs.select(*[F.col(f"`{c}`") for c in keep], q.alias("_q")).select(*[F.col(f"`{c}`") for c in keep], "_q.*")


def order_rules(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejected share, seconds) in the order of rejection per cost; equal ones stay in the
    given order. An empty table leaves the rules as given."""
    sample = materialize(docs.select(F.col(text_col).alias("text")).sample(SAMPLE_SHARE, seed=1).limit(sample_rows))
    n = sample.count()
    if not n:
        sample = materialize(docs.select(F.col(text_col).alias("text")).limit(sample_rows))
        n = sample.count()
    rows = sample.select("text", words_of(F.col("text")).alias("words"))

    def run(make: Callable[[dict[str, Column]], Column]) -> tuple[float, int]:
        names = {"text": F.col("text"), "words": F.col("words")}
        names |= {k: F.col("f")[k] for k in FIGURES[:3]} | {"n_dup_lines": F.col("f.n_dup_lines")}
        f = figures(F.col("text"), F.col("words"))
        wide = rows.select("text", "words", F.struct(*[f[k].alias(k) for k in FIGURES[:4]]).alias("f"))
        plan = wide.agg(F.sum(F.when(make(names), 1).otherwise(0)), F.sum("f.n_words"), F.sum("f.word_chars"), F.sum("f.n_symbols"), F.sum("f.n_dup_lines"))
        began = time.perf_counter()
        got = plan.first()[0] or 0
        return time.perf_counter() - began, got

    floor = min(run(lambda d: F.lit(False))[0] for _ in range(2))
    out = []
    for rule in rules:
        seconds, rejected = run(rule.reject)
        out.append((rule, rejected / max(1, n), max(seconds - floor, 1e-3)))
    return sorted(out, key=lambda x: -x[1] / x[2])


def cascade(docs: DataFrame, text_col: str = "text", rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base figures, base_failed and failed_rule: ``base``, the first rule of the
    cascade that rejects, or null for a document to keep."""
    ordered = [r for r, _, _ in order_rules(docs, text_col, rules, sample_rows)]

    def verdict(d: dict[str, Column]) -> Column:
        out = F.when(base_failed(d), F.lit("base"))
        for rule in ordered:
            out = out.when(rule.reject(d), F.lit(rule.name))
        return out
    return _judge(docs, text_col, verdict)


def keep_good(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in {*FIGURES, "base_failed", "failed_rule"}}
    out = cascade(docs.withColumnsRenamed(clash), text_col, **options).where("failed_rule IS NULL")
    return out.drop(*FIGURES, "base_failed", "failed_rule").withColumnsRenamed({v: k for k, v in clash.items()}).select(*docs.columns)
