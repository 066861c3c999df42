"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import bpe, html_text, langid, licences, merkle, minhash, mixing, quality, suffix, topk, warc, whitening, wordvec
from gazette.llm.common import shared_path


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary() -> tuple[str, str]:
    """Ranks and split pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Licence notices in every document, by a classifier fitted here."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return licences.scanned(documents, licences.train(documents))


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded: number and digest of its ids, digest of the decoded bytes."""
    return bpe.digests(table(spark, folder, "documents"), *vocabulary())


def op3_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents that share four fifths of their two-word shingles."""
    return minhash.near_duplicates(table(spark, folder, "documents"), size=2)


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Every fiftieth vector against all others: the five highest integer inner products."""
    vectors = table(spark, folder, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every page, by a model trained on labelled documents and the pages' other evidence."""
    found = langid.identified(table(spark, folder, "pages"), langid.train(table(spark, folder, "documents")))
    return found.withColumn("probability", F.round("probability", 4))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page written to an archive and read back."""
    return warc.round_trip(table(spark, folder, "pages"), shared_path(spark, "warc"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, base rules and the cascade's verdict for every document."""
    return quality.judged(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents mixed to the target weights: the words that the mix takes of each."""
    return mixing.taken(table(spark, folder, "documents"))


def op9_suffix_array(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the 50-byte strings of smaller documents."""
    cut = suffix.removal(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_text.main_text(table(spark, folder, "pages"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding projected on the whitened components of all distinct ones."""
    return whitening.whitened(table(spark, folder, "embeddings"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of all documents: leaf, roots, proof, and the root that a tampered row leads to."""
    return merkle.manifest(table(spark, folder, "documents"))


def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """A quality score for every document, learnt from the labels that aren't held out."""
    documents = table(spark, folder, "documents")
    return wordvec.scored(documents, *wordvec.trained(documents, table(spark, folder, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run in globals().items() if name.startswith("op") and callable(run)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
        "op6_warc": """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(bits, 1 + 5 * i, 5) AS INTEGER), 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
  CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < largest THEN largest END AS refers_to
FROM (SELECT *, CAST(unhex(sha1(coalesce(html, ''))) AS BLOB)::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
""",
        "op10_html_text": r"""
WITH b AS (
  SELECT page_id, url, unnest(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>')) AS part,
    generate_subscripts(regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>'), 1) AS pos FROM pages
), c AS (
  SELECT page_id, url, pos, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(part, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS line FROM b
)
SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line <> ''), '') AS text,
  CAST(length(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line <> ''), '')) AS BIGINT) AS n_chars
FROM c GROUP BY page_id, url
""",
        "op7_quality": r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 9),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS gram FROM p),
h AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, CAST(sum(least(8, coalesce(following - i, 8))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM h) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
c AS (
  SELECT w.doc_id, w.text, words, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(regexp_extract_all(w.text, '\p{L}')) AS letters, length(w.text) AS chars
  FROM w LEFT JOIN r USING (doc_id) JOIN l USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 10 * len(regexp_extract_all(text, '!!')) > n_words OR 2 * len(regexp_extract_all(text, '\p{Lu}')) > letters OR 2 * letters < chars
    OR chars > 20 * n_words OR 5 * chars < 12 * n_words OR 5 * len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) > n_words) AS kept
FROM b
""",
        "op9_suffix_array": """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(length(h) // 2)) AS i FROM t),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g, substr(h, 2 * i + 1, 2) AS b FROM p),
f AS (SELECT g, min(doc_id) AS earliest FROM w WHERE length(g) = 100 GROUP BY g),
m AS (SELECT w.doc_id, i, b, max(CASE WHEN earliest < w.doc_id THEN i END) OVER (PARTITION BY w.doc_id ORDER BY i) AS latest FROM w LEFT JOIN f USING (g)),
k AS (SELECT doc_id, i, b, coalesce(latest >= i - 49, false) AS gone FROM m),
s AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY i) AS opens FROM k),
a AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS rest FROM s GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256
FROM documents LEFT JOIN a USING (doc_id)
""",
        "op12_merkle": """
WITH RECURSIVE c AS (
  SELECT *, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END) AS crc FROM documents
), h AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, coalesce(xor(crc, 4294967295) % 5 = 0, false) AS struck FROM c
), t AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN struck THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM h
), l AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM t),
up AS (
  SELECT source, 0 AS level, pos, leaf AS digest, n FROM l
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM up WHERE n > 1 GROUP BY source, level, pos // 16
), s AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM s
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY level, pos // 16
), low AS (
  SELECT id, source, 0 AS level, pos, coalesce(changed, leaf) AS digest, n, '' AS proof FROM l
  UNION ALL
  SELECT id, source, level + 1, pos // 16, sha256(string_agg(CASE WHEN other = pos THEN digest ELSE digests END, '' ORDER BY other)), (any_value(n) + 15) // 16,
    any_value(proof) || coalesce(string_agg(digests, '' ORDER BY other) FILTER (other <> pos), '')
  FROM (SELECT low.*, up.pos AS other, up.digest AS digests FROM low JOIN up ON up.source IS NOT DISTINCT FROM low.source AND up.level = low.level AND up.pos // 16 = low.pos // 16 WHERE low.n > 1)
  GROUP BY id, source, level, pos
), high AS (
  SELECT id, 0 AS level, s.pos, digest, s.n, proof FROM low JOIN s ON s.source IS NOT DISTINCT FROM low.source WHERE low.n = 1
  UNION ALL
  SELECT id, level + 1, pos // 16, sha256(string_agg(CASE WHEN other = pos THEN digest ELSE digests END, '' ORDER BY other)), (any_value(n) + 15) // 16,
    any_value(proof) || coalesce(string_agg(digests, '' ORDER BY other) FILTER (other <> pos), '')
  FROM (SELECT high.*, top.pos AS other, top.digest AS digests FROM high JOIN top ON top.level = high.level AND top.pos // 16 = high.pos // 16 WHERE high.n > 1)
  GROUP BY id, level, pos
)
SELECT doc_id, leaf, subroot, (SELECT digest FROM top WHERE n = 1) AS root, sha256(proof) AS proof_sha256, high.digest AS folded_root, high.digest = (SELECT digest FROM top WHERE n = 1) AS verified
FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN high USING (id) WHERE high.n = 1
""",
        "op3_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN [words[1]] ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END)) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT s.doc_id, s.shingle, n.n FROM s JOIN n USING (doc_id)),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT doc_id, min(reached) AS least FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.least, d.doc_id) AS component_id, d.doc_id = coalesce(c.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
""",
    }
