"""The registered queries of this subpackage and their SQL, which runs on the same tables in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import (
    decontaminate, licenses, line_index, packing, pii, prefix_trie, quality_model, quality_rules, quotations, secrets, simhash,
    toxicity, whitening,
)
from termloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


QUOTATIONS = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)*)', 1), '[^>]', '', 'g')) AS level,
    trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*((?:>[ \t]*)*)', '')), '[\x20\x09-\x0D]+', ' ', 'g')) AS said
  FROM (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM conversations)
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), origin AS (
  SELECT conv_id, said, min(turn) AS said_at FROM lines WHERE level = 0 AND said <> '' GROUP BY conv_id, said
), quotes AS (
  SELECT DISTINCT l.conv_id, l.turn, level, l.said, CASE WHEN said_at < l.turn THEN said_at END AS original
  FROM lines l LEFT JOIN origin o ON l.conv_id = o.conv_id AND l.said = o.said WHERE level > 0 AND l.said <> ''
), counts AS (
  SELECT conv_id, turn, count(*) AS n_quotes, count(original) AS n_linked, max(level) AS max_level
  FROM quotes GROUP BY conv_id, turn
), votes AS (
  SELECT conv_id, turn, original, count(*) AS n FROM quotes WHERE level = 1 AND original IS NOT NULL
  GROUP BY conv_id, turn, original
), replies AS (
  SELECT conv_id, turn, original AS parent FROM votes
  QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, original DESC) = 1
), chains AS (
  SELECT conv_id, turn, parent AS root, 1::BIGINT AS depth FROM replies
  UNION ALL
  SELECT c.conv_id, c.turn, r.parent, c.depth + 1 FROM chains c JOIN replies r ON c.conv_id = r.conv_id AND c.root = r.turn
), roots AS (
  SELECT conv_id, turn, min(root) AS root, max(depth) AS depth FROM chains GROUP BY conv_id, turn
)
SELECT c.conv_id, coalesce(r.root, c.turn) AS thread, c.turn, c.role,
  coalesce(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)),
    lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10)), '') AS own_text,
  p.parent AS reply_to, coalesce(r.depth, 0)::BIGINT AS depth, coalesce(n_quotes, 0)::BIGINT AS n_quotes,
  coalesce(n_linked, 0)::BIGINT AS n_linked, coalesce(max_level, 0)::BIGINT AS max_level
FROM conversations c LEFT JOIN counts k ON c.conv_id = k.conv_id AND c.turn = k.turn
LEFT JOIN roots r ON c.conv_id = r.conv_id AND c.turn = r.turn
LEFT JOIN replies p ON c.conv_id = p.conv_id AND c.turn = p.turn
"""


@query("op1_quotation_links", QUOTATIONS)
def op1_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.linked(table(spark, sf_dir, "conversations"))


def held_out(parts: int, part: int) -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % parts == part


def judged(scores: DataFrame, parts: int, part: int, *more: str) -> DataFrame:
    return scores.select(
        "doc_id", F.coalesce(held_out(parts, part), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), *more,
    )


@query("op2_subword_quality")
def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), "quality", ~held_out(5, 0))
    return judged(quality_model.scored(docs, model), 5, 0)


LINE_FREQUENCY = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs
), placed AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words
), windows AS (
  SELECT r, pos, struct_pack(
    a := word, b := lead(word, 1) OVER o, c := lead(word, 2) OVER o, d := lead(word, 3) OVER o, e := lead(word, 4) OVER o
  ) AS g, lead(pos, 4) OVER o AS last FROM placed WINDOW o AS (PARTITION BY r ORDER BY pos)
), again AS (
  SELECT r, pos FROM (SELECT r, pos, count(*) OVER (PARTITION BY r, g) AS n FROM windows WHERE last IS NOT NULL) WHERE n > 1
), repeats AS (
  SELECT r, count(DISTINCT pos + k) AS n_repeat_words FROM again, range(5) AS t(k) GROUP BY r
), lines AS (
  SELECT r, source, text, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
    len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n_line
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r
), hosts AS (
  SELECT source, count(DISTINCT text) AS n_host FROM docs GROUP BY source
), frequent AS (
  SELECT l.source, l.norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.norm, h.n_host HAVING count(DISTINCT l.text) >= 10 AND count(DISTINCT l.text) > 0.1 * h.n_host
), widespread AS (
  SELECT norm FROM lines GROUP BY norm, n_line > 50
  HAVING count(DISTINCT text) >= CASE WHEN n_line > 50 THEN 10 ELSE 200 END
), removed AS (
  SELECT l.r, sum(n_line) AS n_removed FROM lines l
  LEFT JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.norm = f.norm
  LEFT JOIN widespread w ON l.norm = w.norm WHERE f.norm IS NOT NULL OR w.norm IS NOT NULL GROUP BY l.r
), measured AS (
  SELECT w.r, doc_id, len(w)::BIGINT AS n_words,
    coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(n_removed, 0)::BIGINT AS n_removed_words
  FROM words w LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN removed USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > 0
    AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.1 * n_words)) AS kept
FROM measured
"""


@query("op3_line_frequency", LINE_FREQUENCY)
def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words",
        "base_failed", "kept",
    )


@query("op5_decoding_worklist")
def op5_decoding_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.found(table(spark, sf_dir, "documents"))


@query("op6_segment_toxicity")
def op6_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", ~held_out(4, 2))
    return judged(scores, 4, 2, "n_passages")


@query("op7_diagonal_licenses")
def op7_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


CONTAINMENT = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, w[s:s + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, n, s, w[s:s + n - 1] AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)
), found AS (
  SELECT r, s, p.n, item_id FROM places p JOIN windows v ON p.win = v.win
), hit AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS pos FROM found) GROUP BY r
), named AS (
  SELECT r, count(DISTINCT item_id) AS n_items,
    sha256(coalesce(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR), '')) AS items_sha256
  FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""


@query("op8_benchmark_containment", CONTAINMENT)
def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op9_covering_simhash")
def op9_covering_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op4_shape_field")
def op4_shape_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op10_exact_complement")
def op10_exact_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


REPEATED_LINES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
  SELECT r, doc_id, pos, lines[pos] AS line,
    translate(regexp_replace(lines[pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM docs)
), often AS (
  SELECT k, max(doc_id) AS owner FROM placed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3
), judged AS (
  SELECT r, p.doc_id, pos, line, o.k IS NOT NULL AND p.doc_id IS DISTINCT FROM owner AS gone
  FROM placed p LEFT JOIN often o ON p.k = o.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id
"""


@query("op11_line_dedup", REPEATED_LINES)
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_index.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id", F.col("line_count").alias("n_lines"), F.col("dropped_lines").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


PREFIXES = r"""
WITH told AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]),
      lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM told)
), parts AS (
  SELECT c.conv_id, pos, role, text FROM convs c JOIN told t ON t.conv_id = c.base AND pos <= h
  UNION ALL
  SELECT c.conv_id, pos, role, text FROM convs c JOIN told t ON t.conv_id = c.conv_id AND pos > h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, role, text FROM parts
), places AS (
  SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, list(struct_pack(r := role, t := text))
    OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, [] FROM convs
), named AS (
  SELECT conv_id, depth, words, min(conv_id) OVER (PARTITION BY path) AS node, max(depth) OVER (PARTITION BY conv_id) AS whole FROM places
), nodes AS (
  SELECT node, depth, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = whole), '')) AS ends_sha256
  FROM named GROUP BY node, depth
), parents AS (
  SELECT n.node, n.depth, p.node AS parent FROM nodes n LEFT JOIN named p ON p.conv_id = n.node AND p.depth = n.depth - 1
), kids AS (
  SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY ALL
), under AS (
  SELECT a.node, a.depth, count(*) FILTER (k.node IS NULL) AS n_leaves, sum(n.own) AS saved_tokens
  FROM nodes n JOIN named a ON a.conv_id = n.node AND a.depth <= n.depth
  LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth GROUP BY a.node, a.depth
)
SELECT n.node AS conv_id, n.depth, parent AS parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
  saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM nodes n JOIN parents p USING (node, depth) JOIN under u USING (node, depth) LEFT JOIN kids k USING (node, depth)
"""


@query("op13_prefix_trie", PREFIXES)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce(F.lower(F.hex("ends")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
