"""GLEU (sentence-level BLEU variant) per pair and over a corpus (O-44).

For a hypothesis/reference pair with blank-separated tokens: all 1..4-grams of both sides
are counted; matches = Σ min(count_hyp, count_ref) over n-grams; total = max(number of hyp
n-grams, number of ref n-grams); GLEU = matches / total (0 when total is 0). Corpus GLEU =
Σ matches / Σ totals.

Spark shape: a pair's n-grams are counted where the pair lies, in an Arrow-batched pandas UDF; no
n-gram is shuffled. Only the corpus sums are aggregated.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

MAX_N = 4
_BLANKS = re.compile("[ \t\r\n\f]+")


def _counted(text: str | None) -> tuple[Counter, int]:
    """The 1..MAX_N-grams of a text with their numbers, and how many there are."""
    t = [x for x in _BLANKS.split(text or "") if x]
    grams = Counter(g for n in range(1, MAX_N + 1) for g in zip(*(t[i:] for i in range(n))))
    return grams, sum(grams.values())


@F.pandas_udf(T.StructType([T.StructField("matches", T.LongType()), T.StructField("total", T.LongType())]))
def _parts(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
    out = []
    for h, r in zip(hypothesis, reference):
        (h, n), (r, m) = _counted(h), _counted(r)
        out.append((sum(min(c, r[g]) for g, c in h.items() if g in r), max(n, m)))
    return pd.DataFrame(out, columns=["matches", "total"])


def gleu_parts(pairs: DataFrame, hyp_col: str = "hypothesis", ref_col: str = "reference",
               id_col: str = "pair_id") -> DataFrame:
    """(pair_id, matches, total) per row of ``pairs``: clipped n-gram matches and the greater number
    of n-grams. A pair is counted where it lies, so nothing is shuffled; null texts have no n-grams."""
    return pairs.select(id_col, _parts(F.col(hyp_col), F.col(ref_col)).alias("_p")).select(id_col, "_p.matches", "_p.total")


def gleu_pairs(pairs: DataFrame, hyp_col: str = "hypothesis", ref_col: str = "reference",
               id_col: str = "pair_id") -> DataFrame:
    p = gleu_parts(pairs, hyp_col, ref_col, id_col)
    return p.withColumn("gleu", F.round(F.when(F.col("total") > 0, F.col("matches") / F.col("total"))
                                        .otherwise(F.lit(0.0)), 6))


def gleu_corpus(pairs: DataFrame, hyp_col: str = "hypothesis", ref_col: str = "reference",
                id_col: str = "pair_id") -> DataFrame:
    p = gleu_parts(pairs, hyp_col, ref_col, id_col)
    return p.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("matches").alias("matches"), F.sum("total").alias("total")) \
        .withColumn("gleu", F.round(F.when(F.col("total") > 0, F.col("matches") / F.col("total"))
                                    .otherwise(F.lit(0.0)), 6))
