"""The numbered corpus queries: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical, negatives, quality, toxicity
from .byte_bpe import encode_decode
from .decontaminate import find_overlaps
from .exact_dedup import exact_dedup
from .line_dedup import drop_lines
from .near_dedup import near_duplicates
from .ngram_join import jaccard_join
from .pii import pseudonymise
from .shared import new_folder, pin
from .token_counts import longest_within, prefix_tables
from .token_files import id_checksums, read_tokens, write_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def vocabulary(name: str) -> str:
    """Where the public tokenizer file ``name`` is; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from labels of the ids that are not held out."""
    docs, out = documents(spark, sf_dir), quality.held_out(2, 4)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~out), "toxic")
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted", "near_ids", "near_similarities")


@query
def op2_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their personal data pseudonymised."""
    return pseudonymise(documents(spark, sf_dir)).select("doc_id", "text", "n_private", "private_kinds")


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id of each stays."""
    return exact_dedup(documents(spark, sf_dir))


ORACLE_SQL["op4_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents less the lines that a smaller doc_id has."""
    kept = drop_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL["op5_line_dedup"] = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10 GROUP BY key
), marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.first_doc < k.doc_id, false) AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key AND length(k.key) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op6_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles have a similarity of 0.8 or more."""
    return near_duplicates(documents(spark, sf_dir), width=4)


ORACLE_SQL["op6_chosen_path_dedup"] = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingled AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s
  FROM words
), sets AS MATERIALIZED (
  SELECT min(doc_id) AS id, list_sort(s) AS s, len(s) AS n FROM shingled GROUP BY list_sort(s), len(s)
), rows AS MATERIALIZED (
  SELECT id, n, unnest(s) AS x FROM sets WHERE n > 0
), ranked AS (
  SELECT id, n, x, row_number() OVER (PARTITION BY id ORDER BY f, x) AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY x) AS f FROM rows)
), prefixes AS MATERIALIZED (
  SELECT id, n, x FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1
), pairs AS MATERIALIZED (
  SELECT DISTINCT a.id AS a, b.id AS b FROM prefixes a JOIN prefixes b ON a.x = b.x AND a.id < b.id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
), links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT p.a, p.b, any_value(x.n) AS na, any_value(y.n) AS nb, len(list_intersect(any_value(x.s), any_value(y.s))) AS k
    FROM pairs p JOIN sets x ON x.id = p.a JOIN sets y ON y.id = p.b GROUP BY p.a, p.b
  ) WHERE 100 * k >= 80 * (na + nb - k)
), reach AS (
  SELECT id AS a, id AS b FROM sets
  UNION
  SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.b
), tops AS (
  SELECT a AS id, min(b) AS component FROM reach GROUP BY a
)
SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles,
       CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE t.component END AS component_id,
       CASE WHEN len(d.s) = 0 THEN true ELSE t.component = d.doc_id END AS kept
FROM shingled d JOIN sets x ON x.s = list_sort(d.s) JOIN tops t ON t.id = x.id
"""


@query
def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact token counts of whole texts, and where a budget of 2048 tokens cuts them, from stored prefix tables."""
    tables = pin(prefix_tables(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")), "prefix-tables")
    return longest_within(tables, 2048).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "cut_chars")


@query
def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to ORC and read back: where each document starts, and a checksum of its ids."""
    path = new_folder(spark, "token-ids")
    write_tokens(documents(spark, sf_dir), path, vocabulary("byte_bpe_50k.json"), end_id=0)
    return id_checksums(read_tokens(spark, path))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids and the bytes that they decode to, as digests."""
    from public_tokenizers import PATTERN

    return encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), PATTERN, keep="digests")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from labels of the ids that are not held out."""
    docs, out = documents(spark, sf_dir), quality.held_out(0, 5)
    weights = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~out), "quality")
    return quality.score(docs, weights).select("doc_id", out.alias("held_out"), "score", "predicted")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a part of a benchmark item, with the item and the overlap."""
    return find_overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op11_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles have a similarity of 0.8 or more."""
    return jaccard_join(documents(spark, sf_dir), width=5, percent=80)


_OP6 = ORACLE_SQL["op6_chosen_path_dedup"]
ORACLE_SQL["op11_count_vector_join"] = (
    _OP6[: _OP6.rindex("SELECT d.doc_id")].replace("len(w) < 4", "len(w) < 5").replace("len(w) - 2", "len(w) - 3").replace("i:i+3", "i:i+4")
    + """SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE t.component END AS component_id
FROM shingled d JOIN sets x ON x.s = list_sort(d.s) JOIN tops t ON t.id = x.id
"""
)


@query
def op12_treap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=20)


ORACLE_SQL["op12_treap_search"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), sums AS (
  SELECT count(*) FILTER (len(terms) > 0) AS all_docs, sum(len(terms))::BIGINT AS all_terms FROM d
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), postings AS (
  SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d)
  WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term, n
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * all_docs + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), sums
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), sums GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


@query
def op13_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding; every seventh label is off by one."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", label), F.col("id") % 100 == 0)


ORACLE_SQL["op13_vantage_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id, row_number() OVER nearest::INTEGER AS rank, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW nearest AS (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other)
QUALIFY row_number() OVER nearest <= 10
"""
