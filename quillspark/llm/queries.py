"""Registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import piecewise
from quillspark.llm.ann import search
from quillspark.llm.bpe import round_trip
from quillspark.llm.common import table
from quillspark.llm.extract import extract
from quillspark.llm.packing import pack
from quillspark.llm.pii import pii_report, run_key
from quillspark.llm.quality import MAX_COVERED, MAX_DUP_LINE_CHARS, MAX_DUP_LINES, MAX_PUNCTUATION, MAX_REPEAT_PERCENT, MAX_SYMBOLS, MIN_LETTER_WORDS, MIN_WORDS, repetition
from quillspark.llm.rollup import maintained_totals
from quillspark.llm.simhash import simhash_groups
from quillspark.llm.suffix import removal_report
from quillspark.llm.trie import prefix_trie
from quillspark.llm.warc import archive_round_trip
from quillspark.llm.whitening import fit, whiten


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; a function, so that the package is needed only where one is used."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op2_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op3_shifted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_suffix_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(table(spark, sf_dir, "documents"))


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"), run_key(spark))


def op6_boosted_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents"))


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_delta_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained_totals(table(spark, sf_dir, "documents"), {"word_bpe_49k": vocabulary("word_bpe_49k.json"), "byte_bpe_50k": vocabulary("byte_bpe_50k.json")})


def op10_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op11_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whiten(vectors, fit(vectors))


def op12_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piecewise.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op13_prefix_doubling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_hilbert_packing, op2_warc_boundary_chain, op3_shifted_curves, op4_suffix_grouping, op5_feistel_pseudonyms, op6_boosted_dom, op7_repetition_rules, op8_simhash_bktree, op9_delta_rollups, op10_segment_tree_bpe, op11_lanczos_whitening, op12_piece_bpe, op13_prefix_doubling_trie)}


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
d AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT payload_digest, payload_bytes, max(page_id) AS response FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN d.page_id <> r.response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN d.page_id <> r.response THEN r.response END AS refers_to,
       replace(replace(coalesce(d.url, ''), chr(13), '%0D'), chr(10), '%0A') AS uri, d.payload_digest AS stated_digest
FROM d LEFT JOIN r USING (payload_digest, payload_bytes)
"""

_COVERED = "SELECT DISTINCT doc_id, {n} AS n, i + k AS i FROM (SELECT doc_id, i, gram, count(*) OVER (PARTITION BY doc_id, gram) AS again FROM (SELECT doc_id, i, {gram} AS gram FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE gram IS NOT NULL), (SELECT unnest(range({n})) AS k) WHERE again > 1"


def _gram(n: int) -> str:
    return " || ' ' || ".join(["word", *[f"lead(word, {k}) OVER o" for k in range(1, n)]])


REPETITION_SQL = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
c AS ("""
    + " UNION ALL ".join(_COVERED.format(n=n, gram=_gram(n)) for n in (3, *MAX_COVERED))
    + r"""),
cc AS (SELECT doc_id, count(*) FILTER (n = 3) AS n_repeat_words, """
    + ", ".join(f"sum(length(word)) FILTER (n = {n}) AS chars_{n}" for n in MAX_COVERED)
    + r""" FROM c JOIN w USING (doc_id, i) GROUP BY doc_id),
l AS (SELECT doc_id, line, j, row_number() OVER (PARTITION BY doc_id, line ORDER BY j) > 1 AS later, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ll AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (later) AS n_dup_lines, sum(chars) FILTER (later) AS dup_chars FROM l GROUP BY doc_id),
ww AS (SELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (regexp_matches(word, '[A-Za-z\x{80}-\x{10FFFF}]')) AS lettered FROM w GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
    """
    + ", ".join(f"coalesce(chars_{n}, 0) / greatest(coalesce(word_chars, 0), 1) AS covered_{n}" for n in MAX_COVERED)
    + r""", coalesce(dup_chars, 0) / greatest(coalesce(word_chars, 0), 1) AS dup_line_chars, n_symbols / greatest(coalesce(n_words, 0), 1) AS symbol_ratio,
    length(regexp_replace(text, '[^!-/:-@\[-`{-~]', '', 'g')) / greatest(coalesce(word_chars, 0), 1) AS punctuation_ratio, coalesce(lettered, 0) / greatest(coalesce(n_words, 0), 1) AS letter_words
    FROM d LEFT JOIN ww USING (doc_id) LEFT JOIN ll USING (doc_id) LEFT JOIN cc USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    """
    + f"NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words OR n_dup_lines > {MAX_DUP_LINES} * n_lines OR dup_line_chars > {MAX_DUP_LINE_CHARS} OR symbol_ratio > {MAX_SYMBOLS} OR punctuation_ratio > {MAX_PUNCTUATION} OR letter_words < {MIN_LETTER_WORDS} OR "
    + " OR ".join(f"covered_{n} > {most}" for n, most in MAX_COVERED.items())
    + ") AS kept, "
    + ", ".join(f"covered_{n}" for n in MAX_COVERED)
    + ", dup_line_chars, symbol_ratio, punctuation_ratio, letter_words FROM s"
)

REMOVAL_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS e, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100),
f AS (SELECT doc_id, i, md5(array_slice(e, i + 1, i + 100)) AS f FROM p JOIN d USING (doc_id)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY f ORDER BY doc_id, i) > 1 AS again FROM f),
a AS (SELECT doc_id, i AS lo, i + 100 AS hi FROM r WHERE again),
m AS (SELECT *, max(hi) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a),
g AS (SELECT doc_id, lo, hi, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM m),
runs AS (SELECT doc_id, run, min(lo) AS lo, max(hi) AS hi FROM g GROUP BY ALL),
k AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM runs UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(array_slice(e, a + 1, coalesce(b, n))), '' ORDER BY a) AS h FROM k JOIN d USING (doc_id) WHERE coalesce(b, n) > a GROUP BY doc_id),
sums AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN d.e ELSE unhex(coalesce(kept.h, '')) END) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""

#: CRC-32 bit by bit, lowest first; prefixes as lists of turns; a node's subtree by comparing prefixes.
TRIE_SQL = r"""
WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(turn ORDER BY pos) AS turns, CAST(conv_id AS VARCHAR) AS dec FROM t GROUP BY conv_id),
b AS (SELECT conv_id, turns, list_transform(range(8 * length(dec)), lambda i: (ascii(dec[(i // 8 + 1)::INT]) >> (i % 8)::INT) & 1) AS bits FROM c),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(bits, lambda x: x::BIGINT)), lambda a, x: CASE WHEN xor(a, x) & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 4 AS h FROM b),
r AS (SELECT h.conv_id, coalesce(o.turns[1:h.h::INT], []) || h.turns[(h.h + 1)::INT:] AS turns FROM h LEFT JOIN c AS o ON o.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, len(turns) AS size, d AS depth, turns[1:d::INT] AS prefix FROM r, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
n AS (SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) = depth AS leaf, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends,
    CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(prefix[-1].t, '[^\x20\x09-\x0D]+')) END AS words FROM p GROUP BY depth, prefix),
k AS (SELECT depth - 1 AS depth, prefix[:-2] AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
s AS (SELECT p.depth, p.prefix, sum(u.leaf::INT) AS n_leaves, sum((u.n_convs - 1) * u.words) AS saved FROM (SELECT DISTINCT v.depth, v.prefix, u.conv_id, u.depth AS below FROM p AS v JOIN n AS u ON u.conv_id = v.conv_id AND u.depth >= v.depth) AS p JOIN n AS u ON u.conv_id = p.conv_id AND u.depth = p.below GROUP BY p.depth, p.prefix)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.depth = n.depth AND s.prefix = n.prefix LEFT JOIN k ON k.depth = n.depth AND k.prefix = n.prefix LEFT JOIN n AS m ON m.depth = n.depth - 1 AND m.prefix = n.prefix[:-2] AND n.depth > 0
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_boundary_chain": WARC_SQL, "op4_suffix_grouping": REMOVAL_SQL, "op7_repetition_rules": REPETITION_SQL, "op13_prefix_doubling_trie": TRIE_SQL}
