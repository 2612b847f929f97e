"""The registered queries of this package and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vetgrid.llm.bytebpe import op9_byte_bpe
from vetgrid.llm.chat import op12_chat_formatting
from vetgrid.llm.forest import op8_nearest_neighbours
from vetgrid.llm.jaccard import op1_jaccard_join
from vetgrid.llm.licenses import op3_license_scan
from vetgrid.llm.packing import op10_packing
from vetgrid.llm.ranking import op13_ranked_search
from vetgrid.llm.secrets import op7_secret_scan
from vetgrid.llm.sharding import op2_sharding
from vetgrid.llm.spelling import op11_spelling_variants
from vetgrid.llm.substrings import op5_substring_dedup
from vetgrid.llm.topk import op6_exact_top_k
from vetgrid.llm.toxicity import op4_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_jaccard_join, op2_sharding, op3_license_scan, op4_toxicity, op5_substring_dedup, op6_exact_top_k,
        op7_secret_scan, op8_nearest_neighbours, op9_byte_bpe, op10_packing, op11_spelling_variants,
        op12_chat_formatting, op13_ranked_search)
}

# CRC-32, tokenizers, trained models and iterative merging are beyond DuckDB's SQL or far too slow
# in it on whole tables; those queries are tested against brute force. The others are plain.
ORACLE: dict[str, str] = {
    "op5_substring_dedup": """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
wins AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) AS h
  FROM w, unnest(range(1, len(words) - 18)) AS t(i)),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM wins)
  WHERE n > 1),
gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM later, unnest(range(0, 20)) AS t(k)),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
each AS (
  SELECT w.doc_id, words, len(coalesce(ps, [])) AS n_removed,
         list_transform(list_filter(list_zip(words, range(1, len(words) + 1)),
                                    lambda z: NOT list_contains(coalesce(ps, []), z[2])), lambda z: z[1]) AS kept
  FROM w LEFT JOIN lists USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM each""",
    "op6_exact_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op12_chat_formatting": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
written AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS learned,
         regexp_replace(text, '([<\[]\\*)(/?s>|/?INST\]|/?SYS\]|ASSISTANT\]|/?ROLE\]|BODY\]|IMG\]|AUDIO\]|DOC\])',
                        '\1\\\2', 'g') AS escaped
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(length(learned)) AS BIGINT) AS loss_chars,
       sha256(string_agg(learned, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(length(escaped) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 16
                                  ELSE 19 + length(role) END) AS BIGINT) AS formatted_chars
FROM written GROUP BY conv_id""",
    "op13_ranked_search": r"""
WITH words AS (
  SELECT row_number() OVER () AS doc, doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-@\[-`{-\x7F]+')) AS term
  FROM documents),
counts AS (SELECT doc, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
df AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-@\[-`{-\x7F]+')) AS term
  FROM benchmark),
weighed AS (
  SELECT item_id, term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM items JOIN df USING (term), total),
scores AS (
  SELECT item_id, doc_id, doc,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM weighed JOIN counts USING (term) JOIN sizes USING (doc), total GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50""",
}
