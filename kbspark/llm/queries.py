"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import decontaminate, lm_scoring, merkle_manifest, near_dedup, preference, prefix_trie, quality_rules, sentencepiece_viterbi, substring_dedup, token_rans, toxicity, url_filter, warc

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
TOKENIZER, END_ID = "byte_bpe_50k.json", 2
PIECES = "piece_bpe_32k.model"
WARC_DATE = "2024-01-01T00:00:00Z"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def labelled_urls(pages: DataFrame, rules: list[tuple[str, str]] = URL_RULES) -> DataFrame:
    """(url, block): the urls that the rules decide, as training data for the others."""
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    best: Column | None = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = F.concat(F.lit("."), host).endswith(f".{name}") & path.startswith(slash + start)
        best = F.when(fits, int(verdict == "block")) if best is None else best.when(fits, int(verdict == "block"))
    return pages.select("url", best.alias("block")).where("block IS NOT NULL")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page url: rules, then logistic regression on hashed character n-grams."""
    pages = _table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, URL_RULES, labelled_urls(pages)).withColumnRenamed("id", "page_id")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document (DartMinHash)."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of all conversations, rendered with masks."""
    out = preference.format_pairs(preference.preference_pairs(_table(spark, sf_dir, "conversations")))
    mask = lambda c: F.concat_ws(" ", F.transform(c, lambda s: F.concat_ws("-", s["first"], s["end"]))).alias(c)
    return out.select("pair_id", "chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen_text", mask("chosen_mask"),
                      "rejected_text", mask("rejected_mask"), "usable")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair whose tiles cover enough of the item."""
    out = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), "item_id", F.round("coverage", 6).alias("coverage"), "n_item_tokens",
                      F.size("tiles").alias("n_tiles"), F.array_max(F.transform("tiles", lambda t: t["length"])).alias("longest_tile"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of the quality cascade on every document."""
    out = quality_rules.cascade(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality_rules.FIGURES, "base_failed", F.col("failed_rule").isNull().alias("kept"))


def op6_warc_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, read back and assembled into captures."""
    path = _scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path, WARC_DATE)
    records = warc.read_warc(spark, path, with_payload=False)
    captures = warc.captures_with_origin(_write_once(warc.assemble(records)))
    kind = F.col("response.type")
    return captures.select(
        F.col("metadata")[0]["page_id"].alias("page_id"),
        F.when(kind == "revisit", F.col("origin.payload_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), kind.alias("record_type"),
        F.when(kind == "revisit", F.col("origin.page_id")).alias("refers_to"))


def _write_once(df: DataFrame) -> DataFrame:
    """``df`` through a table in the shared folder: read twice, made once."""
    path = _scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, decoded from the rANS token files."""
    path = _scratch(spark, "tokens")
    token_rans.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), END_ID)
    return token_rans.read_tokens(spark, path, with_ids=False).select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out stupid-backoff score of every document."""
    out = lm_scoring.score(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_backoff", "n_unseen",
                      F.round("sum_log", 3).alias("sum_log"), F.round("mean_log", 6).alias("mean_log"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document because a 35-word window around them repeats."""
    out = substring_dedup.repeated_words(_table(spark, sf_dir, "documents"), texts=False)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viterbi pieces of every document, and whether decoding gives its text back."""
    out = sentencepiece_viterbi.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), with_ids=False)
    return out.select(F.col("id").alias("doc_id"), "n_pieces", "n_byte_pieces", "ids_crc32", "score", "round_trip")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie over all rebuilt conversations."""
    rows, lengths = prefix_trie.rebuilt_turns(prefix_trie.turn_rows(_table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(rows, lengths)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof; every seventh (by crc32) is checked with a tampered leaf."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = merkle_manifest.record_digest(fields, {"n_chars": F.col("n_chars") + 1})
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, tampered)
    manifest = merkle_manifest.write_manifest(_table(spark, sf_dir, "documents"), columns=fields, claim=claim)
    out = merkle_manifest.proofs(manifest)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of rows that are held out are not looked at."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = toxicity.fit_toxicity(docs, labels.where(fold != 1))
    out = toxicity.score_documents(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_url_filter, op2_minhash_near_dedup, op3_chat_preferences, op4_decontamination, op5_quality_rules,
        op6_warc_assembly, op7_token_files, op8_lm_scoring, op9_substring_dedup, op10_sentencepiece, op11_prefix_trie, op12_merkle_manifest, op13_toxicity)}


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, t, w, len(w)::BIGINT AS n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
r AS (SELECT doc_id, i, w[i:i+7] AS run FROM (SELECT doc_id, w, unnest(range(1, n_words - 6)) AS i FROM s)),
twice AS (SELECT doc_id, run FROM r GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r JOIN twice USING (doc_id, run)) GROUP BY doc_id),
f AS (SELECT doc_id, t, w, lines, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM s LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 2 * n_dup_lines > len(lines)
  OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) < 7 * n_words
  OR 2 * len(list_filter(w, lambda x: regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}'))) > n_words
  OR (5 * len(list_distinct(w)) < n_words AND len(list_distinct(w)) < 1000)) AS kept
FROM b"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
SELECT page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last > page_id THEN last END AS refers_to
FROM p LEFT JOIN g USING (h)"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
r AS (SELECT doc_id, i, md5(array_to_string(w[i:i+34], ' ')) AS run FROM (SELECT doc_id, w, unnest(range(1, len(w)::BIGINT - 33)) AS i FROM d)),
twice AS (SELECT run FROM r GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r JOIN twice USING (run)),
each AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w)::BIGINT + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

OP8 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS x, CASE WHEN i > 1 THEN w[i-1] END AS before FROM (SELECT doc_id, w, unnest(range(1, len(w)::BIGINT + 1)) AS i FROM d)),
size AS (SELECT doc_id, len(w)::BIGINT AS n FROM d), total AS (SELECT sum(n) AS n FROM size),
u AS (SELECT doc_id, x, count(*) AS c FROM t GROUP BY ALL), cu AS (SELECT x, sum(c) AS c FROM u GROUP BY x),
b AS (SELECT doc_id, before, x, count(*) AS c FROM t WHERE before IS NOT NULL GROUP BY ALL), cb AS (SELECT before, x, sum(c) AS c FROM b GROUP BY ALL),
o AS (SELECT t.doc_id, t.before IS NOT NULL AS inner_word, total.n - size.n AS other,
    coalesce(cb.c - b.c, 0) AS pair, coalesce(pu.c - pv.c, 0) AS context, cu.c - u.c AS one
  FROM t JOIN size USING (doc_id) CROSS JOIN total JOIN u USING (doc_id, x) JOIN cu USING (x)
  LEFT JOIN b ON b.doc_id = t.doc_id AND b.before = t.before AND b.x = t.x LEFT JOIN cb ON cb.before = t.before AND cb.x = t.x
  LEFT JOIN u pv ON pv.doc_id = t.doc_id AND pv.x = t.before LEFT JOIN cu pu ON pu.x = t.before),
s AS (SELECT doc_id, inner_word AND pair = 0 AS backoff, one = 0 AND pair = 0 AS unseen,
  CASE WHEN pair > 0 THEN ln(pair) - ln(context)
       WHEN one > 0 THEN ln(one) - ln(other) + CASE WHEN inner_word THEN ln(0.4) ELSE 0 END
       ELSE ln(0.4) - ln(other + 1) + CASE WHEN inner_word THEN ln(0.4) ELSE 0 END END AS l FROM o)
SELECT size.doc_id, size.n AS n_words, coalesce(sum(backoff::INT), 0)::BIGINT AS n_backoff, coalesce(sum(unseen::INT), 0)::BIGINT AS n_unseen,
  round(coalesce(sum(l), 0), 3) AS sum_log, round(sum(l) / size.n, 6) AS mean_log
FROM size LEFT JOIN s USING (doc_id) GROUP BY size.doc_id, size.n"""


#: crc32 of the digits of an integer: bytes, then eight shifts each.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END))"""
_CRC = f"xor({_CRC}, 4294967295::UBIGINT)"

OP11 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format('conv_id')} % 9 AS h FROM t),
r AS (SELECT c.conv_id, 0 AS part, i, role, text FROM c JOIN t ON t.conv_id = c.base AND i < h
  UNION ALL SELECT c.conv_id, 1, i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND i >= h),
o AS (SELECT conv_id, octet_length(encode(text)) AS bytes, length(role) || ':' || role || text AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth FROM r),
k AS (SELECT conv_id, depth, bytes, md5(string_agg(md5(turn), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key FROM o
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
e AS (SELECT *, coalesce(lag(key) OVER w, '') AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ended FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
node AS (SELECT key, depth, above, min(conv_id) AS conv_id, count(*) AS n_convs, min(bytes) AS bytes,
    sha256(coalesce(string_agg(CASE WHEN ended THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM e GROUP BY key, depth, above),
kids AS (SELECT above AS key, count(*) AS n FROM node GROUP BY above),
full_node AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids USING (key)),
below AS (SELECT a.key, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved
  FROM e AS a JOIN e AS x ON x.conv_id = a.conv_id AND x.depth >= a.depth JOIN full_node b ON b.key = x.key AND b.conv_id = x.conv_id GROUP BY a.key)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below USING (key) LEFT JOIN node p ON p.key = f.above"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n}", "text")) + ")"

OP12 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {_LEAF.format(n='n_chars')} AS leaf,
    CASE WHEN {_CRC.format('doc_id')} % 7 = 0 THEN {_LEAF.format(n='(n_chars + 1)')} END AS claim FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM d),
tree AS (SELECT g, 0 AS l, p::BIGINT AS p, n::BIGINT AS n, leaf AS h FROM p
  UNION ALL SELECT g, l + 1, p // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM tree WHERE n > 1 GROUP BY g, l, p // 2),
s AS (SELECT g, h, l, row_number() OVER (ORDER BY encode(g)) - 1 AS p, count(*) OVER () AS n FROM tree WHERE n = 1),
wood AS (SELECT 0 AS l, p::BIGINT AS p, n::BIGINT AS n, h FROM s
  UNION ALL SELECT l + 1, p // 2, (min(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY p)) FROM wood WHERE n > 1 GROUP BY l, p // 2),
root AS (SELECT h AS root, l AS top FROM wood WHERE n = 1),
up AS (SELECT p.g, p.p AS leaf_at, t.l, t.h, t.p & 1 AS odd FROM p JOIN tree t ON t.g = p.g AND t.p = xor(p.p >> t.l, 1)
  UNION ALL SELECT p.g, p.p, s.l + w.l, w.h, w.p & 1 FROM p JOIN s USING (g) JOIN wood w ON w.p = xor(s.p >> w.l, 1)),
proof AS (SELECT g, leaf_at, sha256(string_agg(h, '' ORDER BY l)) AS proof_sha256 FROM up GROUP BY ALL),
fold AS (SELECT g, p AS leaf_at, 0 AS l, coalesce(claim, leaf) AS h FROM p
  UNION ALL SELECT f.g, f.leaf_at, f.l + 1, sha256(CASE WHEN up.h IS NULL THEN f.h WHEN up.odd = 1 THEN f.h || up.h ELSE up.h || f.h END)
  FROM fold f JOIN s ON s.g = f.g CROSS JOIN root LEFT JOIN up ON up.g = f.g AND up.leaf_at = f.leaf_at AND up.l = f.l WHERE f.l < s.l + root.top)
SELECT p.doc_id, p.leaf, s.h AS subroot, root.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root.root AS verified
FROM p JOIN s USING (g) CROSS JOIN root LEFT JOIN proof ON proof.g = p.g AND proof.leaf_at = p.p
JOIN fold ON fold.g = p.g AND fold.leaf_at = p.p AND fold.l = s.l + root.top"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5, "op6_warc_assembly": OP6, "op8_lm_scoring": OP8, "op9_substring_dedup": OP9, "op11_prefix_trie": OP11, "op12_merkle_manifest": OP12}
