"""Raw web page → plain text, as a chain of ``regexp_replace`` calls (O-07, WEB_SCRAPING).

Drops script/style/noscript/nav blocks and comments, turns every remaining tag into a blank,
decodes the common named entities and collapses blank runs. JVM-side, no parser library.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from kbspark.functions.text import BLANK, strip_blanks

# ---------------------------------------------------------------------------------------------
# Blocks removed with their content, and the entity table (``&amp;`` is decoded
# last so that an escaped entity is not decoded twice).
# ---------------------------------------------------------------------------------------------
DROP_BLOCKS = ["script", "style", "noscript", "nav"]
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&amp;", "&"),
]
# ---------------------------------------------------------------------------------------------


def html_to_text(c) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    out = F.regexp_replace(out, "(?s)<!--.*?-->", " ")
    for tag in DROP_BLOCKS:
        out = F.regexp_replace(out, f"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    out = F.regexp_replace(out, f"{BLANK}+", " ")
    return strip_blanks(out)
