"""Embedder slot (O-83).

``embed(text_col, model)`` returns a Column of ``array<float>``. The default model is a
deterministic hashed bag of words (no model files are available offline): lower-cased
blank-separated tokens are hashed into ``dim`` buckets (md5), the counts are L2-normalised.
Counting runs in an Arrow-batched pandas UDF — the same rule written with SQL higher-order
functions (``hashed_counts_sql``) is evaluated element by element and measured 2.5× slower —
and the normalisation is a Spark expression. A user model is plugged in as a function of a pandas Series of
texts returning a sequence of vectors; it runs as an iterator pandas UDF so the model is
loaded once per Python worker and fed Arrow batches.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from kbspark.functions.exprs import let
from kbspark.functions.text import BLANK, strip_blanks

DEFAULT_MODEL_NAME = "hashed-bow"
DEFAULT_DIM = 64


def bucket_of(token: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hashed_counts_sql(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Token counts per hash bucket written with SQL higher-order functions only (reference
    implementation; interpreted per element, so the pandas version below is the default)."""
    toks = F.filter(F.split(F.lower(strip_blanks(F.coalesce(text, F.lit("")))), f"{BLANK}+"), lambda t: t != "")
    buckets = F.transform(toks, lambda t: bucket_of(t, dim))
    return F.aggregate(buckets, F.array_repeat(F.lit(0.0), F.lit(dim)),
                       lambda acc, b: F.transform(acc, lambda x, i: F.when(i == b, x + 1.0).otherwise(x)))


_BLANKS = re.compile("[ \t\r\n\f]+")


class _Buckets(dict):
    """Bucket of every token met in a batch: a token is hashed once."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        self[token] = b = int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % self.dim
        return b


TEXTS_AT_ONCE = 1000


@functools.lru_cache(maxsize=None)
def _counts_udf(dim: int):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def counts(texts: pd.Series) -> pd.Series:
        buckets, out = _Buckets(dim), []
        for at in range(0, len(texts), TEXTS_AT_ONCE):   # one count over all tokens of many texts
            tokens = [_BLANKS.split((t or "").strip(" \t\r\n\f").lower()) for t in texts.iloc[at:at + TEXTS_AT_ONCE]]
            tokens = [[] if x == [""] else x for x in tokens]
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ids = np.fromiter(map(buckets.__getitem__, itertools.chain.from_iterable(tokens)), np.int64, int(size.sum()))
            table = np.bincount(np.repeat(np.arange(len(tokens)) * dim, size) + ids, minlength=len(tokens) * dim)
            out.extend(table.reshape(len(tokens), dim).astype(np.float64))
        return pd.Series(out, dtype=object)

    return counts


def hashed_counts(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """Token counts per hash bucket (before normalisation), ``array<double>`` of length ``dim``:
    lower-cased blank-separated tokens, bucket = first 32 bits of md5(token) mod dim. Runs as an
    Arrow-batched pandas UDF (one vectorised pass per batch, token hashes cached per batch)."""
    return _counts_udf(dim)(text)


def normalize(counts: Column) -> Column:
    """L2-normalised ``array<float>``; an all-zero vector stays zero."""
    return let(counts, lambda c: let(F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)),
                                     lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))
                                                           .cast("float"))))


def hashed_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    return normalize(hashed_counts(text, dim))


def model_embedding(model_factory: Callable[[], Callable], dim: int) -> Callable[[Column], Column]:
    """Wrap a user model: ``model_factory()`` returns ``encode(list[str]) -> list[list[float]]``."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model_factory()
        for s in batches:
            vecs = encode(s.fillna("").tolist())
            yield pd.Series([[float(x) for x in v] for v in vecs])

    return _embed


MADE = T.StructType([T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("attempts", T.IntegerType()),
                     T.StructField("error_message", T.StringType())])


def isolated_embedding(model_factory: Callable[[], Callable], dim: int, max_attempts: int = 3) -> Callable[[Column], Column]:
    """As ``model_embedding``, but one text cannot fail the job: the column is a struct of vector,
    attempts (failed tries) and error_message. A batch that fails is embedded text by text, each tried up to
    ``max_attempts`` times; a vector that is not ``dim`` long counts as a failure. A text that
    keeps failing has no vector and the last error."""

    def checked(vec) -> list[float]:
        out = [float(x) for x in vec]
        if len(out) != dim:
            raise ValueError(f"vector of {len(out)} numbers, not {dim}")
        return out

    def alone(encode, text: str) -> tuple:
        error = ""
        for tries in range(max_attempts):
            try:
                return checked(encode([text])[0]), tries, None
            except Exception as e:  # noqa: BLE001 - the model's, kept with the row
                error = f"{type(e).__name__}: {e}"
        return None, max_attempts, error

    @F.pandas_udf(MADE)
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = model_factory()
        for s in batches:
            texts = s.fillna("").tolist()
            try:
                rows = [(checked(v), 0, None) for v in encode(texts)]
                if len(rows) != len(texts):
                    raise ValueError("as many vectors as texts expected")
            except Exception:  # noqa: BLE001 - found out text by text
                rows = [alone(encode, t) for t in texts]
            yield pd.DataFrame(rows, columns=MADE.names)

    return _embed


def embed(text: Column, model: str | Callable[[Column], Column] = DEFAULT_MODEL_NAME, dim: int = DEFAULT_DIM) -> Column:
    if model == DEFAULT_MODEL_NAME:
        return hashed_embedding(text, dim)
    if callable(model):
        return model(text)
    raise ValueError(f"unknown embedding model {model!r}")
