"""Registered queries of the corpus operators, with DuckDB text where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe_codec import bpe_round_trip
from .collocations import collocations
from .common import table
from .maxscore import top_inner_products
from .packing import pack_documents
from .pii import fit_field, personal_data
from .prefix_trie import conversation_trie
from .quality import fit_quality, quality_rules
from .secrets import fit_findings, secret_scan
from .simhash import simhash_components
from .tokens import token_counts
from .toxicity import fit_lexicon, toxicity
from .url_rules import rule_frame, url_verdicts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


#: Rules of the URL query: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


@register
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate secret of every document with the forest's verdict."""
    return secret_scan(table(spark, sf_dir, "documents"), fit_findings())


@register
def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents (3-word shingles, 2 bits)."""
    return simhash_components(table(spark, sf_dir, "documents"), shingle=3, max_bits=2, seed=42)


@register
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document (byte-level BPE, 1024-token limit)."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


@register
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans and those the field adds."""
    return personal_data(table(spark, sf_dir, "documents"), fit_field())


@register
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into 1024-token sequences."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), size=1024, end_id=2)


@register
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the multilingual ranks and decoded again."""
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and quality verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return rules.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


@register
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth vector, searched among all."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, recall=0.945)


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by a lexicon learnt from the labels."""
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fit_lexicon(docs, table(spark, sf_dir, "labels")), threshold=0.7)


@register
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the longest fitting rule."""
    return url_verdicts(table(spark, sf_dir, "pages"), rule_frame(spark, URL_RULES), default="allow")


@register
def op11_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty best rows by integer inner product of every twentieth vector, exact, among all."""
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@register
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of the rebuilt conversations with its members, leaves and shared words."""
    return conversation_trie(table(spark, sf_dir, "conversations"), group=20, heads=4)


@register
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best collocations of 2 to 5 words found at least 100 times."""
    return collocations(table(spark, sf_dir, "documents"), threshold=100, longest=5, top=2_000)


ORACLE["op10_url_rules"] = """
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0
                       THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM (
  SELECT p.*, r.rhost || r.rpath AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
) WHERE k = 1
"""

ORACLE["op11_maxscore_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.e), len(v.e)) + 1), lambda i: q.e[i] * v.e[i])) AS BIGINT) AS score
  FROM q JOIN v ON q.vec_id <> v.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, coalesce(score, 0) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

ORACLE["op13_phrase_collocations"] = """
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, s.k AS k, unnest(list_transform(range(1, len(w) - s.k + 2), lambda i: array_to_string(w[i:i + s.k - 1], ' '))) AS phrase
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) s WHERE len(w) >= s.k
), f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k AS words, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (
  SELECT c.*, j.j, array_to_string(w[1:j.j], ' ') AS lp, array_to_string(w[j.j + 1:], ' ') AS rp
  FROM c, (SELECT unnest([1, 2, 3, 4]) AS j) j WHERE j.j < c.words
), scored AS (
  SELECT cut.lang, cut.phrase, cut.a, cut.j, x.a AS l, y.a AS r, n.n,
         (1000 * CAST(cut.a AS HUGEINT) * CAST(n.n AS HUGEINT)) // (CAST(x.a AS HUGEINT) * CAST(y.a AS HUGEINT)) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.lp JOIN f y ON y.lang = cut.lang AND y.phrase = cut.rp
  JOIN n ON n.lang = cut.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM c, (SELECT unnest([2, 3, 4]) AS m) m, (SELECT unnest([1, 2, 3, 4]) AS s) s
  WHERE m < words AND s + m - 1 <= words GROUP BY 1, 2
), kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR i.longer < b.a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""

ORACLE["op12_conversation_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) ORDER BY i) AS tab
  FROM range(256) r(i)
), sizes AS (SELECT c, count(*) AS had FROM t GROUP BY c),
h AS (
  SELECT s.c, s.had, s.c - s.c % 20 AS base,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(s.c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda a, x: xor(a // 256, crc.tab[(xor(a, x) % 256) + 1])), 4294967295) % 4 AS h
  FROM sizes s, crc
), cv AS (SELECT h.*, least(h.h, coalesce(b.had, 0)) AS lead FROM h LEFT JOIN sizes b ON b.c = h.base),
r AS (
  SELECT cv.c, t.pos, t.role, t.text FROM cv JOIN t ON t.c = cv.base AND t.pos <= cv.h
  UNION ALL
  SELECT cv.c, t.pos - cv.h + cv.lead, t.role, t.text FROM cv JOIN t ON t.c = cv.c AND t.pos > cv.h
), l AS (
  SELECT cv.c, coalesce(x.s, []) AS s FROM cv LEFT JOIN (SELECT c, list({'role': role, 'text': text} ORDER BY pos) AS s FROM r GROUP BY c) x ON x.c = cv.c
), m AS (SELECT c, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM l),
node AS (
  SELECT d, s[1:d] AS pre, min(c) AS conv, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends
  FROM m GROUP BY d, s[1:d]
), w AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(pre[d].text, '[^\x20\x09-\x0D]+')) END AS own FROM node),
kid AS (SELECT p.d, p.pre, p.conv, k.conv AS kconv, k.d AS kd, k.pre AS kpre FROM w p JOIN w k ON k.d = p.d + 1 AND k.pre[1:p.d] = p.pre),
kids AS (SELECT d, pre, count(*) AS n FROM kid GROUP BY d, pre),
whole AS (
  SELECT a.d, a.pre, sum(b.own) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM w a JOIN w b ON b.d >= a.d AND b.pre[1:a.d] = a.pre LEFT JOIN kids k ON k.d = b.d AND k.pre = b.pre GROUP BY a.d, a.pre
)
SELECT w.conv AS conv_id, CAST(w.d AS BIGINT) AS depth, kid.conv AS parent_conv_id, w.n_convs, coalesce(kids.n, 0) AS n_children, whole.leaves AS n_leaves,
       CAST(whole.saved AS BIGINT) AS saved_tokens, w.ends AS ends_sha256
FROM w JOIN whole ON whole.d = w.d AND whole.pre = w.pre LEFT JOIN kid ON kid.kd = w.d AND kid.kpre = w.pre LEFT JOIN kids ON kids.d = w.d AND kids.pre = w.pre
"""
