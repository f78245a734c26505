"""Queries of the corpus operators over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwright.llm import bpe_codec, decontamination, embedding_dedup, licences, line_dedup, mixing, ngram_join, periodic_runs, phrases, pii, prefix_counts, quality, toxicity
from barwright.llm.common import shared_secret, table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents has no paths: a document lies in a directory of its source, language and block of 64 ids."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 64).cast("string"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    return licences.scan(docs.select("doc_id", "text", path.alias("path")))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.budgets(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), budget=512)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of spark.barwright.pii.key; without it, a random one that is kept in the shared folder."""
    key = spark.conf.get("spark.barwright.pii.key", None) or shared_secret(spark, "pii")
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, grammar).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(table(spark, sf_dir, "documents"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, top=2000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_quality": op3_quality,
        "op4_licences": op4_licences,
        "op5_line_dedup": op5_line_dedup,
        "op6_embedding_dedup": op6_embedding_dedup,
        "op7_token_counts": op7_token_counts,
        "op8_pii": op8_pii,
        "op9_toxicity": op9_toxicity,
        "op10_bpe_codec": op10_bpe_codec,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_source_mix": op12_source_mix,
        "op13_phrases": op13_phrases,
    }


#: Components by all paths: for tables of a few thousand rows.
REACHED = """reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
    least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"""
JACCARD = f"""WITH RECURSIVE words AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    nodes AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
    held AS (SELECT id, len(s) AS n, unnest(s) AS t FROM nodes),
    links AS (SELECT x.id AS a, y.id AS b FROM held x JOIN held y ON x.t = y.t AND x.id <> y.id GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    {REACHED}
    SELECT id AS doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM nodes JOIN least USING (id)"""
COSINE = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT * FROM nodes WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.label = y.label AND x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
    {REACHED}, linked AS (SELECT a AS id, count(*) AS n_links FROM links GROUP BY a)
    SELECT id AS vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, id = component_id AS kept FROM nodes JOIN least USING (id) LEFT JOIN linked USING (id)"""

PHRASES = """WITH words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    total AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
    grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM words, range(1, 6) AS t(k) WHERE len(w) >= k),
    f AS (SELECT lang, k, g, count(*) AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
    kept AS (SELECT * FROM f x WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM f y WHERE y.lang = x.lang AND y.k > x.k AND y.c >= x.c AND contains(' ' || y.g || ' ', ' ' || x.g || ' '))),
    cuts AS (SELECT lang, g, c, cut, array_to_string(string_split(g, ' ')[:cut], ' ') AS head, array_to_string(string_split(g, ' ')[cut + 1:], ' ') AS rest FROM kept, range(1, 5) AS t(cut) WHERE cut < k),
    scores AS (SELECT lang, cuts.g AS g, cuts.c AS a, h.c AS l, r.c AS r, n, cut, (1000::HUGEINT * cuts.c * n) // (h.c::HUGEINT * r.c) AS score FROM cuts JOIN f h USING (lang) JOIN f r USING (lang) JOIN total USING (lang) WHERE h.g = head AND r.g = rest),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM best)
    SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL of the exact joins and counts; it compares all pairs, so it is for small tables."""
    return {"op2_ngram_jaccard": JACCARD, "op6_embedding_dedup": COSINE, "op13_phrases": PHRASES}
