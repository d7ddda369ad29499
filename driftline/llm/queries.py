"""Registered queries of the training-text operators and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.chat_format import digest_windows, format_chats
from driftline.llm.collocations import collocations
from driftline.llm.common import table
from driftline.llm.exact_dedup import exact_dedup
from driftline.llm.fill_in_middle import fill_in_middle, restored
from driftline.llm.html_text import extract_main_text
from driftline.llm.language_id import held_out, identify, learn_from_training_fold
from driftline.llm.metric_join import near_vectors
from driftline.llm.mixing import mix_sources
from driftline.llm.near_dedup import near_dedup
from driftline.llm.pieces import encode_texts, load_model
from driftline.llm.substring_dedup import remove_repeats
from driftline.llm.token_counts import load_vocabulary, longest_prefix, prefix_counts
from driftline.llm.url_filter import Rule, filter_urls

#: The public vocabulary that the queries encode with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Tokens above which a text is over the limit.
TOKEN_LIMIT = 512


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), load_model(PIECES))


def op3_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn_from_training_fold(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest_windows(format_chats(turns))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


#: Rules of the URL query.
URL_RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).alias("doc"), "text")
    counts = prefix_counts(sized, load_vocabulary(BYTE_BPE), id_col="doc")
    n = F.element_at("counts", -1).cast("long")
    fits = F.when(n > TOKEN_LIMIT, longest_prefix(F.col("counts"), TOKEN_LIMIT)).otherwise(F.size("counts") - 1)
    return counts.select("doc.*", n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"), fits.cast("long").alias("fitting_chars"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_sentence_pieces": op2_sentence_pieces,
        "op3_remove_repeats": op3_remove_repeats,
        "op4_language_id": op4_language_id,
        "op5_near_dedup": op5_near_dedup,
        "op6_near_vectors": op6_near_vectors,
        "op7_chat_windows": op7_chat_windows,
        "op8_mix_sources": op8_mix_sources,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_url_filter": op10_url_filter,
        "op11_token_counts": op11_token_counts,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_collocations": op13_collocations,
    }


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM s
), f AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(weight) OVER () AS BIGINT) AS all_weights,
    CAST(coalesce(sum(3 * source_size) OVER p, 0) AS BIGINT) AS caps_before, CAST(coalesce(sum(weight) OVER p, 0) AS BIGINT) AS weights_before
  FROM w WINDOW p AS (ORDER BY (3 * source_size) / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, (total - caps_before) / (all_weights - weights_before) AS level FROM f
), l AS (
  SELECT level AS final FROM g WHERE level * weight <= 3 * source_size ORDER BY weights_before LIMIT 1
), t AS (
  SELECT source, source_size, round(CASE WHEN final IS NULL THEN CAST(3 * source_size AS DOUBLE)
    ELSE least(final * weight, CAST(3 * source_size AS DOUBLE)) END, 6) AS target FROM g LEFT JOIN l ON true
), p AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d
), b AS (
  SELECT greatest(1, least(256, CAST(floor(coalesce(sum(target), 0)) AS BIGINT) // 65536)) AS block FROM t
), h AS (
  SELECT source, source_size, block, CAST(ceil(source_size / block) AS BIGINT) AS blocks, target * CAST(ceil(source_size / block) AS BIGINT) / source_size AS share
  FROM t, b WHERE source_size > 0
), i AS (
  SELECT *, coalesce(sum(share) OVER o, 0.0) AS low, coalesce(sum(share) OVER o, 0.0) + share AS high
  FROM h WINDOW o AS (ORDER BY source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), a AS (
  SELECT max(high) AS al FROM i
), z AS (
  SELECT CAST((CAST(slot AS HUGEINT) * 11400714819323198485) % 18446744073709551616 // 2048 AS DOUBLE) / 9007199254740992 * al AS point
  FROM (SELECT al, unnest(range(0, CAST(ceil(round(coalesce(al, 0), 3)) AS BIGINT))) AS slot FROM a)
), c AS (
  SELECT i.source, any_value(block) AS block, any_value(blocks) AS blocks, least(count(*), 3 * any_value(blocks)) AS slots FROM z JOIN i ON point >= low AND point < high GROUP BY i.source
)
SELECT p.doc_id, p.size, t.source_size, t.target, CAST(CASE WHEN p.size = 0 OR slots IS NULL THEN 0
  ELSE (slots // blocks) * p.size + greatest(0, least(p.start + p.size, (slots % blocks) * block) - p.start) END AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source
"""

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content, length(coalesce(text, '')) AS points FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY content ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY content) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(content) AS text_sha256 FROM g
"""


#: Every string of 400 bytes is counted.
OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), n AS (
  SELECT r, doc_id, b, octet_length(b) AS n FROM d
), w AS (
  SELECT r, i, md5(hex(b[i:i + 399])) AS h FROM (SELECT r, b, unnest(range(1, n - 398)) AS i FROM n WHERE n >= 400)
), t AS (
  SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1
), s AS (
  SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM t
), p AS (
  SELECT r, span, min(i) AS a, max(i) + 400 AS z FROM s GROUP BY 1, 2
), k AS (
  SELECT r, list({'a': a, 'z': z} ORDER BY a) AS spans, sum(z - a) AS removed, count(*) AS spans_n FROM p GROUP BY 1
), kept AS (
  SELECT n.r, doc_id, n, coalesce(removed, 0) AS removed, coalesce(spans_n, 0) AS spans_n, hex(b) AS x, spans FROM n LEFT JOIN k USING (r)
)
SELECT doc_id, n AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(spans_n AS BIGINT) AS n_spans,
  sha256(CASE WHEN spans IS NULL THEN unhex(x) ELSE unhex(x[1:2 * (spans[1].a - 1)] || array_to_string(list_transform(range(1, len(spans) + 1), lambda i: x[2 * spans[i].z - 1:CASE WHEN i < len(spans) THEN 2 * (spans[i + 1].a - 1) ELSE 2 * n END]), '')) END) AS kept_sha256
FROM kept
"""


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] END AS shingle
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n_shingles + y.n_shingles - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS reach FROM documents UNION SELECT e.b, r.reach FROM r JOIN e ON r.doc_id = e.a
), c AS (
  SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

OP6_SQL = """
WITH RECURSIVE g AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
), r AS (
  SELECT vec_id, vec_id AS reach FROM embeddings UNION SELECT e.b, r.reach FROM r JOIN e ON r.vec_id = e.a
), c AS (
  SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id
), k AS (
  SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a
)
SELECT d.vec_id, coalesce(n, 0) AS n_links, component_id, d.vec_id = component_id AS kept
FROM embeddings d JOIN c ON d.vec_id = c.vec_id LEFT JOIN k ON d.vec_id = k.vec_id
"""


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), g AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS g FROM d
), f AS (
  SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), l AS (
  SELECT doc_id, t, n, form, CAST(coalesce(list_sum(list_transform(u[1:a], lambda x: length(x))), 0) AS BIGINT) AS p, CAST(coalesce(list_sum(list_transform(u[a + 1:b], lambda x: length(x))), 0) AS BIGINT) AS m FROM f
), x AS (
  SELECT *, t[1:p] AS prefix, t[p + 1:p + m] AS middle, t[p + m + 1:] AS suffix FROM l
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM x
"""

OP13_SQL = r"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), w AS (
  SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM t
), p AS (
  SELECT piece, lang, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM w
), g AS (
  SELECT lang, w, w || ' ' || lead(w, 1) OVER o AS w2, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS w3,
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o AS w4,
    w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS w5
  FROM p WINDOW o AS (PARTITION BY piece ORDER BY i)
), f AS (
  SELECT lang, 1 AS size, w AS phrase, count(*) AS f FROM g GROUP BY 1, 3 UNION ALL SELECT lang, 2, w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT lang, 3, w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT lang, 4, w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY 1, 3
  UNION ALL SELECT lang, 5, w5, count(*) FROM g WHERE w5 IS NOT NULL GROUP BY 1, 3
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT lang, phrase, size, f AS a FROM f WHERE size > 1 AND f >= 100
), k AS (
  SELECT c.*, z.k AS k, array_to_string(string_split(phrase, ' ')[1:z.k], ' ') AS head, array_to_string(string_split(phrase, ' ')[z.k + 1:], ' ') AS tail FROM c, range(1, 5) AS z(k) WHERE z.k < size
), s AS (
  SELECT k.lang, k.phrase, k.size, a, k, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM k JOIN f x ON k.lang = x.lang AND k.head = x.phrase JOIN f y ON k.lang = y.lang AND k.tail = y.phrase JOIN n ON k.lang = n.lang
), b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), o AS (
  SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.size > b.size AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_remove_repeats": OP3_SQL, "op5_near_dedup": OP5_SQL, "op6_near_vectors": OP6_SQL, "op8_mix_sources": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op12_fill_in_middle": OP12_SQL, "op13_collocations": OP13_SQL}
