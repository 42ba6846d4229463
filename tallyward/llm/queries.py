"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyward.llm.bpe import token_digests
from tallyward.llm.common import table
from tallyward.llm.decontaminate import find_leaks
from tallyward.llm.divergence import audit_sources
from tallyward.llm.hostgraph import judge_pages
from tallyward.llm.licenses import scan_licenses
from tallyward.llm.maincontent import extract_pages
from tallyward.llm.maxscore import top_embeddings
from tallyward.llm.oddsketch import near_duplicates
from tallyward.llm.phrases import collocations
from tallyward.llm.privacy import find_personal_data
from tallyward.llm.quality import judge_quality
from tallyward.llm.suffixes import repeated_passages
from tallyward.llm.toxicity import score_documents


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_embeddings(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).drop("rejected_by")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


CALLS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_bpe": op3_bpe,
    "op4_html_text": op4_html_text,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_pii": op7_pii,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_licenses": op9_licenses,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_phrases": op11_phrases,
    "op12_quality": op12_quality,
    "op13_divergence": op13_divergence,
}

SQL: dict[str, str] = {
    "op2_topk": """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * 256) AS DOUBLE)) AS vec
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
           FROM (SELECT DISTINCT vec_id, vec FROM x) q JOIN x c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
""",
    "op11_phrases": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
     g AS (SELECT lang, array_to_string(words[i:i + k - 1], ' ') AS phrase, k AS size
           FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
                 FROM (SELECT lang, words, unnest([1, 2, 3, 4, 5]) AS k FROM w) WHERE len(words) >= k)),
     f AS (SELECT lang, phrase, size, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
     t AS (SELECT lang, count(*) AS n FROM g WHERE size = 1 GROUP BY lang),
     inner_parts AS (SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + k - 1], ' ') AS phrase
                     FROM (SELECT lang, f, phrase, k, unnest(range(1, size - k + 2)) AS i
                           FROM (SELECT *, unnest(range(2, size)) AS k FROM f))),
     longer AS (SELECT lang, phrase, max(f) AS f FROM inner_parts GROUP BY ALL),
     cuts AS (SELECT c.lang, c.phrase, c.f AS a, k,
                     array_to_string(string_split(c.phrase, ' ')[1:k], ' ') AS head,
                     array_to_string(string_split(c.phrase, ' ')[k + 1:], ' ') AS rest
              FROM (SELECT f.*, unnest(range(1, f.size)) AS k FROM f WHERE f.size > 1) c
              LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase
              WHERE o.f IS NULL OR 100 * o.f < 100 * c.f),
     s AS (SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, n,
                  CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
           FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = rest
           JOIN t ON t.lang = cuts.lang),
     b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000
""",
    "op12_quality": r"""
WITH d AS (SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS text FROM documents),
     t AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
     g AS (SELECT place, words[i:i + 2] AS three, i
           FROM (SELECT place, words, unnest(range(1, len(words) - 1)) AS i FROM t WHERE len(words) >= 3)),
     twice AS (SELECT place, i FROM g QUALIFY count(*) OVER (PARTITION BY place, three) > 1),
     inside AS (SELECT place, count(DISTINCT k) AS n FROM (SELECT place, unnest([i, i + 1, i + 2]) AS k FROM twice) GROUP BY place),
     m AS (SELECT t.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                  CAST(coalesce(inside.n, 0) AS BIGINT) AS n_repeat_words
           FROM t LEFT JOIN inside USING (place)),
     b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                  10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 12 * n_words
                  OR 10 * n_dup_lines > 3 * len(lines)
                  OR len(regexp_extract_all(text, '[A-Z]')) > len(regexp_extract_all(text, '[a-z]'))
                  OR 2 * len(regexp_extract_all(text, '!')) > n_words
                  OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) > 3 * len(lines)
                  OR 10 * len(list_filter(lines, lambda x: regexp_matches(x, '\A[\x20\x09-\x0D]*[-*•]'))) > 9 * len(lines)
                  OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) < 8 * n_words AS rejected
           FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM b
""",
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS place, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
     w AS (SELECT place, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT place) >= 3),
     v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
     c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
     groups AS (SELECT DISTINCT lang, source FROM d),
     sizes AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM groups g
               LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
     p AS (SELECT s.lang, s.source, k.term, k.total, coalesce(c.n, 0) AS n,
                  CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (s.n + v.v) AS HUGEINT) AS p,
                  CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.total + 1)) // (v.n + v.v) AS HUGEINT) AS q
           FROM sizes s JOIN v USING (lang) JOIN kept k USING (lang)
           LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS BIGINT) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     every_pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
                    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
                    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value
               FROM p WHERE n > 0 AND p > q),
     ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
                FROM (SELECT * FROM every_pair UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
""",
}
