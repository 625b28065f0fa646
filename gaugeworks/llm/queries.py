"""The queries of this subpackage on the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import (
    bpe,
    html_text,
    jaccard,
    language,
    neural_lm,
    packing,
    positions,
    quality,
    spotsigs,
    token_files,
    vector_codes,
    whitening,
)

QUERIES = {}
ORACLES: dict[str, str] = {}

END_OF_TEXT = 50256


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_template_text")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by the deduced template of its host."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


@_query("op2_spot_signatures")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot-signature fingerprints of every text and its edited text, and how alike they are."""
    return spotsigs.compare_with_edits(_table(spark, sf_dir, "documents"))


@_query("op3_byte_bpe_round_trip")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the public rank table, and the bytes they decode to, as digests."""
    docs = _table(spark, sf_dir, "documents")
    return bpe.round_trip(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@_query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files by a scan for end-of-document ids.

    Columns: doc_id, file, start (ids of the file before the document), n_tokens (without the end id).
    """
    docs = _table(spark, sf_dir, "documents")
    return token_files.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), END_OF_TEXT)


@_query("op5_neural_lm_scores")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text by unigram counts and by the log-bilinear model."""
    return neural_lm.train_and_score(_table(spark, sf_dir, "documents"))


@_query("op6_cross_parsing_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text; every fourth document, by checksum, is kept from learning."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = language.held_out()
    model = language.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language.predict(F.col("text"), model).alias("of"))
    return found.select("doc_id", "held_out", "of.lang_pred", "of.score")


@_query("op7_grouping_genetic_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of at most 2048 ids as found."""
    docs = _table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@_query("op8_elias_fano_token_files")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to files with Elias-Fano boundaries and read back from them."""
    docs = _table(spark, sf_dir, "documents")
    return token_files.encode_and_read(docs, public_tokenizers.path("byte_bpe_50k.json"))


@_query("op9_learned_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of the learned rules for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, _table(spark, sf_dir, "labels"))
    judged = quality.judge(docs, rules, "doc_id")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# the sets are lists of distinct shingles, copies share one list
_JACCARD_SQL = r"""
WITH RECURSIVE
words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s
  FROM words),
copies AS (SELECT list_sort(s) AS s, min(doc_id) AS node FROM sets WHERE len(s) > 0 GROUP BY ALL),
shingles AS (SELECT node, len(s) AS n, unnest(s) AS g FROM copies),
links AS (
  SELECT a.node AS a, b.node AS b
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.node <> b.node
   AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n
  HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reached(node, to_node) AS (
  SELECT node, node FROM copies
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON r.to_node = l.a),
component AS (SELECT node, min(to_node) AS component_id FROM reached GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles,
       CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE c.component_id END AS component_id
FROM sets s LEFT JOIN copies k ON list_sort(s.s) = k.s LEFT JOIN component c ON k.node = c.node
"""


@_query("op10_shingle_jaccard_join", _JACCARD_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingles are alike to 0.9, by the size-aware join."""
    return jaccard.similar_components(_table(spark, sf_dir, "documents"))


@_query("op12_qdwh_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 first principal components, whitened."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


_CODES_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
         len(embedding) // 16 AS d
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * d + 1, (p + 1) * d) AS s, d FROM kept, (SELECT unnest(range(16)) AS p)),
start AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept),
{rounds}
near AS (
  SELECT a.vec_id, a.p, min((list_sum(list_transform(range(1, a.d + 1), lambda i: (a.s[i] - c.s[i]) * (a.s[i] - c.s[i]))), c.e)) AS m
  FROM parts a JOIN book2 c ON a.p = c.p GROUP BY ALL),
coded AS (
  SELECT vec_id, string_agg(format('{{:02x}}', m[2]), '' ORDER BY p) AS code, CAST(sum(m[1]) AS BIGINT) AS error
  FROM near GROUP BY vec_id),
digest AS (
  SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2)
SELECT k.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept k USING (vec_id), digest
"""

_ROUND_SQL = """
near{i} AS (
  SELECT a.vec_id, a.p, min((list_sum(list_transform(range(1, a.d + 1), lambda i: (a.s[i] - c.s[i]) * (a.s[i] - c.s[i]))), c.e)) AS m
  FROM parts a JOIN book{i} c ON a.p = c.p GROUP BY ALL),
sums{i} AS (
  SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
  FROM (SELECT a.p, n.m[2] AS e, unnest(a.s) AS x, generate_subscripts(a.s, 1) AS i
        FROM parts a JOIN near{i} n ON a.vec_id = n.vec_id AND a.p = n.p) GROUP BY ALL),
moved{i} AS (SELECT p, e, list(x ORDER BY i) AS s FROM sums{i} GROUP BY ALL),
book{j} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.s, b.s) AS s FROM book{i} b LEFT JOIN moved{i} m ON b.p = m.p AND b.e = m.e),
"""

_CODES_SQL = _CODES_SQL.format(
    rounds="book0 AS MATERIALIZED (SELECT p, e, s FROM parts JOIN start USING (vec_id) WHERE e < 64),"
    + "".join(_ROUND_SQL.format(i=i, j=i + 1) for i in range(2))
)


@_query("op13_memoised_grid_codes", _CODES_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings by 16 codebooks of 64 entries, found through memoised grid cells."""
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


_WORDS_SQL = r"""regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

# exact windows by their text; near ones from the rarest word of a window
_POSITIONS_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL} AS w FROM benchmark),
runs AS (
  SELECT DISTINCT item_id, list_slice(w, s + 1, s + 10) AS g
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM b WHERE len(w) > 0)),
win AS MATERIALIZED (SELECT g, row_number() OVER () AS win FROM (SELECT DISTINCT g FROM runs)),
owner AS (SELECT win, item_id FROM runs JOIN win USING (g)),
token AS MATERIALIZED (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM d),
exact AS (
  SELECT doc_id, pos, size, win
  FROM (SELECT doc_id, pos, size, list_slice(w, pos + 1, pos + size) AS g
        FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS pos
              FROM d, (SELECT DISTINCT len(g) AS size FROM win) WHERE len(w) >= size)) JOIN win USING (g)),
hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS place FROM exact) GROUP BY doc_id),
item AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM exact JOIN owner USING (win)) GROUP BY doc_id),
often AS (SELECT t, count(*) AS n FROM token GROUP BY t),
term AS (SELECT win, len(g) AS size, unnest(g) AS t, generate_subscripts(g, 1) - 1 AS off FROM win),
rarest AS (
  SELECT win, size, arg_min(t, (n, off)) AS t, arg_min(off, (n, off)) AS off
  FROM term LEFT JOIN often USING (t) GROUP BY ALL HAVING count(n) = size),
proposed AS (SELECT doc_id, win, size, pos - off AS start FROM token JOIN rarest USING (t)),
stands AS (
  SELECT DISTINCT p.doc_id, p.win, p.size, p.start, x.off
  FROM proposed p JOIN term x ON p.win = x.win
  JOIN token k ON k.doc_id = p.doc_id AND k.t = x.t AND abs(k.pos - p.start - x.off) <= 2),
near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near_items
  FROM (SELECT doc_id, win, start FROM stands GROUP BY doc_id, win, start, size HAVING count(*) = size)
  JOIN owner USING (win) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
       coalesce(n_near_items, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN near USING (doc_id)
"""


@_query("op11_positional_index_decontamination", _POSITIONS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in all documents, by a positional inverted index."""
    return positions.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
