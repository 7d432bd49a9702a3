"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (byte_bpe, chat_format, collocations, decontaminate, hard_negatives, hilbert_shards, language_id,
                           quality, signature_join, simhash_dups, suffix_dedup, vector_search, wavelet_tokens)
from shelfwise.llm.common import read_table

#: Conversation added to the given ones: control strings inside ordinary text.
EXTRA_TURNS = """
SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'),
                     (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)
"""


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vector_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    shards = wavelet_tokens.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, bits=16)
    return wavelet_tokens.read_tokens(shards)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns of 400 bytes, what is left (its bytes, its text at whole characters), and ``passage_text``:
    the text without the repeated passages that the pipeline cuts, many of them shorter."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, with_text=True, passages=suffix_dedup.PASSAGE)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256",
                        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), F.col("kept_text").alias("text"),
                        "passage_text")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.contamination(docs, benchmark))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dups.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = hilbert_shards.hilbert_shards(docs, 40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def op9_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = given.unionByName(spark.sql(EXTRA_TURNS))
    segments = chat_format.format_turns(turns)
    return chat_format.read_back(segments, chat_format.prefix_targets(segments))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(vectors.withColumn("label", moved))


def op13_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_cross_polytope": op2_cross_polytope,
    "op3_wavelet_tokens": op3_wavelet_tokens,
    "op4_quality": op4_quality,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_simhash": op7_simhash,
    "op8_hilbert_shards": op8_hilbert_shards,
    "op9_prefix_targets": op9_prefix_targets,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_signature_join": op13_signature_join,
    "pipeline": pipeline,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, " r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op6_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) s ON len(w) >= s.n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.k = dw.k),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
""",
    "op9_prefix_targets": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, 16 + length(role) + length(text)
    + length(regexp_replace(role || '~' || text, '[^\\]', '', 'g'))
    - len(regexp_extract_all(text || '~' || role, '<s>'))
    - 2 * len(regexp_extract_all(text || '~' || role, '</s>'))
    - 4 * len(regexp_extract_all(text || '~' || role, '\[INST\]'))
    - 5 * len(regexp_extract_all(text || '~' || role, '\[/INST\]')) + 4 AS chars
  FROM t
), p AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last
  FROM e
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR is_last) AS n_examples,
  CAST(sum(upto) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS example_chars
FROM p GROUP BY conv_id
""",
    "op11_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
  SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM w JOIN range(1, 6) s(size) ON len(w) >= size)),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND a >= 100),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = c.lang AND q.size > c.size
  AND 100 * q.a >= 100 * c.a AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head,
  array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, x.a AS l, y.a AS r, CAST(n AS BIGINT) AS n,
  CAST((1000 * cuts.a::HUGEINT * n::HUGEINT) // (x.a::HUGEINT * y.a::HUGEINT) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
  JOIN t ON t.lang = cuts.lang),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM m QUALIFY rank <= 2000
""",
    "op12_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
  AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3
""",
    "op13_signature_join": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN c x ON x.doc_id = a JOIN c y ON y.doc_id = b WHERE 100 * b.n >= 80 * (x.n + y.n - b.n)),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, root FROM reach JOIN e ON e.a = node),
m AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN m ON node = doc_id LEFT JOIN c USING (doc_id)
""",
}
