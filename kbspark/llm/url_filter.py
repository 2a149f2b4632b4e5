"""URL filter: domain and path rules first, then a logistic regression on hashed character n-grams.

A rule names a host and the start of a path; it fits the host, all its subdomains, and paths that
begin with the rule's. The longest rule (in characters; of equal ones the one that sorts first)
decides. Where no rule fits, a linear model over character n-grams of host and path decides.

The model is trained from a small table of labelled URLs (at most ``MAX_LABELLED`` rows, those
with the least hash of their URL, so the choice does not depend on partitioning); full-batch
gradient descent over sorted rows gives the same weights every time. Rules and weights have a fixed
size, so both travel with the function, and judging is one pass without a shuffle.

A null URL and one without ``://`` have an empty host and path; no rule fits them and the model
judges the empty string. Repeated rows and null ids pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

GRAMS = (3, 4, 5)
BUCKETS = 1 << 15
MAX_LABELLED = 4096
ROUNDS = 200
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


@dataclass
class Rules:
    """Rules by host: (path start, rule, verdict), the longest first."""

    by_host: dict[str, list[tuple[str, str, str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rules: list[tuple[str, str]]) -> Rules:
        """From (verdict, rule) pairs such as ("block", "example.com/en/")."""
        out = cls()
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            out.by_host.setdefault(host.lower(), []).append((slash + path, rule, verdict))
        return out

    def judge(self, host: str, path: str) -> tuple[str | None, str | None]:
        best = None
        while host:
            for start, rule, verdict in self.by_host.get(host, ()):
                if path.startswith(start) and (best is None or (-len(rule), rule) < (-len(best[0]), best[0])):
                    best = (rule, verdict)
            _, dot, host = host.partition(".")
            if not dot:
                break
        return best or (None, None)


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the distinct character n-grams of host and path, each with its edges marked."""
    out = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            out.update(zlib.crc32(f"{kind}{text[i:i + n]}".encode()) % BUCKETS for i in range(max(1, len(text) - n + 1)))
    return np.array(sorted(out), np.int64)


def train(rows: list[tuple[str, str, int]], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last one is the bias) from (host, path, 1 to block or 0) rows. With one class
    only, or no rows, the bias alone says so."""
    weights = np.zeros(BUCKETS + 1)
    if not rows:
        return weights
    rows = sorted(rows)
    label = np.array([y for _, _, y in rows], float)
    if label.min() == label.max():
        weights[-1] = 1.0 if label[0] else -1.0
        return weights
    seen = [features(h, p) for h, p, _ in rows]
    owner, bucket = np.repeat(np.arange(len(seen)), [len(x) for x in seen]), np.concatenate(seen)
    value = 1.0 / np.sqrt(np.array([len(x) for x in seen]))[owner]
    weight_of = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())   # classes count alike
    step = np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        margin = np.bincount(owner, weights[bucket] * value, len(rows)) + weights[-1]
        error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label) * weight_of
        slope = np.append(np.bincount(bucket, error[owner] * value, BUCKETS) + decay * weights[:-1], error.sum())
        step += slope ** 2
        weights -= rate * slope / np.sqrt(step)
    return weights


def sample_labelled(labelled: DataFrame, max_rows: int = MAX_LABELLED) -> list[tuple[str, str, int]]:
    """At most ``max_rows`` distinct (host, path, label) rows of a table (url, block 0/1)."""
    rows = labelled.where("url IS NOT NULL AND block IS NOT NULL").groupBy("url").agg(F.max("block").cast("int").alias("y"))
    got = rows.orderBy(F.xxhash64("url"), "url").limit(max_rows).select(host_of(F.col("url")), path_of(F.col("url")), "y").collect()
    return [tuple(r) for r in got]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame, id_col: str = "page_id", url_col: str = "url",
                threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(id, host, path, rule or null, verdict, score: the model's probability to block)."""
    known = Rules.of(rules)
    weights = train(sample_labelled(labelled, max_labelled)).astype(np.float32)

    @F.pandas_udf("rule string, verdict string, score double")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        out = []
        for h, p in zip(host, path, strict=True):
            x = features(h, p)
            margin = float(weights[x].sum(dtype=float)) / len(x) ** 0.5 + float(weights[-1])
            score = 1 / (1 + np.exp(-min(30.0, max(-30.0, margin))))
            rule, verdict = known.judge(h, p)
            out.append((rule, verdict or ("block" if score > threshold else "allow"), round(float(score), 9)))
        return pd.DataFrame(out, columns=["rule", "verdict", "score"])

    url = F.col(url_col)
    cut = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return cut.select("id", "host", "path", judge("host", "path").alias("j")).select("id", "host", "path", "j.rule", "j.verdict", "j.score")
