"""The registered queries as DuckDB SQL over the same tables.

Each query is a set of named parts (common table expressions) and a body. The
parts say independently, in relational form, what the Spark plans compute.
"""

from __future__ import annotations

import re

from ..functions import lexicon as L
from ..operators.pages import BLOCK_NAMES, NEWS_LINK_PARTS, STRUCTURE_TAGS
from ..operators.tagging import category_rules
from ..sources import corpus as C
from ..sources import profiles as P
from . import queries as Q

NOW = "TIMESTAMP '2024-01-04 00:00:00'"
EDGE = "TIMESTAMP '2024-01-02 00:00:00'"
HAN_RX = r"[\x{4E00}-\x{9FFF}]"


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    cell = lambda v: q(v) if v is None or isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows) + ")"


def words(items) -> str:
    return "(" + ", ".join(q(w) for w in items) + ")"


def fmt(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S')"


def fold(col: str) -> str:
    return f"replace(strip_accents(lower({col})), 'ß', 'ss')"


def any_of(col: str, parts) -> str:
    return "(" + " OR ".join(f"contains({col}, {q(p)})" for p in parts) + ")"


def pick(options, index: str) -> str:
    """The option of a 0-based index; null beyond the list."""
    return f"list_extract([{', '.join(options)}], CAST({index} AS BIGINT) + 1)"


def back(key: str) -> str:
    return f"({NOW} - to_minutes(CAST(({key} * 37) % 4320 AS INTEGER)))"


def stem(w: str) -> str:
    return (
        f"CASE WHEN {w} LIKE '%ing' AND length({w}) > 5 THEN left({w}, length({w}) - 3) "
        f"WHEN {w} LIKE '%ed' AND length({w}) > 4 THEN left({w}, length({w}) - 2) "
        f"WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' AND length({w}) > 3 THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


def entities(col: str) -> str:
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        col = f"replace({col}, '{name}', {q(char)})"
    return col


def trim_ws(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def code_of(key: str) -> str:
    return f"chr(CAST(65 + ({key}) // 5 AS INTEGER)) || chr(CAST(65 + ({key}) % 5 AS INTEGER))"


PARTS: dict[str, str] = {}


def part(name: str, sql: str) -> None:
    PARTS[name] = sql


# --- the corpus -----------------------------------------------------------------

part(
    "raw",
    f"""SELECT doc_id AS news_id, split_part(text, chr(10), 1) AS title, text AS content,
    'https://' || source || '.example/' || doc_id AS source_url, CAST(doc_id % 21 + 1 AS BIGINT) AS source_id,
    {back('doc_id')} AS created_at, {back('doc_id')} - to_hours(CAST((doc_id % 7) * 12 AS INTEGER)) AS published_at,
    CASE doc_id % 6 WHEN 1 THEN 'technology' WHEN 2 THEN 'business' WHEN 3 THEN 'science' WHEN 4 THEN 'general'
      WHEN 5 THEN 'international' END AS hint_category FROM documents""",
)
part(
    "news",
    f"""SELECT *, CASE WHEN regexp_matches(title || content, '{HAN_RX}') THEN 'zh' ELSE 'en' END AS language,
    substr(content, 1, 500) AS summary, false AS has_video FROM raw""",
)
part(
    "han_docs",
    f"SELECT doc_id, translate(lower(text), '{C.LATIN}', '{C.HAN}') AS text, source FROM documents",
)
part(
    "han_news",
    f"""SELECT doc_id AS news_id, split_part(text, chr(10), 1) AS title, text AS content,
    {back('doc_id')} AS created_at,
    CASE WHEN regexp_matches(text, '{HAN_RX}') THEN 'zh' ELSE 'en' END AS language FROM han_docs""",
)
part("recent", f"SELECT * FROM news WHERE created_at > {EDGE}")
part("kw", f"SELECT * FROM {values(C.PROSE_KEYWORDS)} t(code, k)")
for field in ("title", "content"):
    part(
        f"{field}_best",
        f"""SELECT news_id, code FROM (SELECT news_id, code, row_number() OVER (PARTITION BY news_id ORDER BY n DESC, code) rn
        FROM (SELECT news_id, code, sum((length({field}) - length(replace({field}, k, ''))) // length(k)) n
        FROM news, kw WHERE contains({field}, k) GROUP BY news_id, code)) WHERE rn = 1""",
    )
part(
    "primary_of",
    """SELECT news_id, coalesce(t.code, c.code) AS primary_country FROM news LEFT JOIN title_best t USING (news_id)
    LEFT JOIN content_best c USING (news_id)""",
)
part("rules", f"SELECT code, {fold('k')} k FROM {values(category_rules() + C.PROSE_RULES)} t(code, k)")
part(
    "matched",
    f"""SELECT DISTINCT news_id, code FROM (SELECT news_id, {fold("title || ' ' || content")} body FROM news), rules
    WHERE contains(body, k)""",
)
part(
    "forced",
    """SELECT news_id, CASE hint_category WHEN 'technology' THEN 'tech' WHEN 'business' THEN 'economy' WHEN 'science' THEN 'tech'
    ELSE 'else' END code FROM news WHERE source_id = 1 AND hint_category IS NOT NULL
    UNION ALL SELECT news_id, 'tech' FROM news WHERE source_id = 18""",
)
part("coded", "SELECT news_id, code FROM matched UNION SELECT news_id, code FROM forced")
part(
    "all_codes",
    """SELECT news_id, code FROM coded UNION ALL SELECT news_id, coalesce(hint_category, 'else') FROM news
    WHERE news_id NOT IN (SELECT news_id FROM coded)""",
)
part(
    "categories",
    "SELECT * FROM "
    + values([(i, n, c, col) for i, (n, c, col) in enumerate(L.CATEGORIES, 1)])
    + " t(category_id, category_name, category_code, color_code)",
)
part("news_categories", "SELECT news_id, CAST(category_id AS BIGINT) category_id FROM all_codes JOIN categories ON code = category_code")
part(
    "news_countries",
    f"""SELECT news_id, primary_country AS country_code, true AS is_primary FROM primary_of WHERE primary_country IS NOT NULL
    UNION ALL SELECT news_id, {code_of('news_id % 25')}, false FROM primary_of
    WHERE primary_country IS NULL OR primary_country <> {code_of('news_id % 25')}""",
)
part(
    "countries",
    f"""SELECT {code_of('n_nationkey')} country_code,
    CASE WHEN contains(n_name, ' ') THEN upper(n_name[1]) || lower(split_part(n_name, ' ', 1)[2:]) || ' ' ||
      upper(split_part(n_name, ' ', 2)[1]) || lower(split_part(n_name, ' ', 2)[2:]) ELSE upper(n_name[1]) || lower(n_name[2:]) END country_name,
    n_name country_name_en, CASE WHEN n_nationkey % 6 <> 5 THEN CAST(n_nationkey * 5 - 60 AS DOUBLE) END latitude,
    CASE WHEN n_nationkey % 6 <> 5 THEN CAST(n_nationkey * 12 - 150 AS DOUBLE) END longitude, r_name continent
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
part(
    "sources",
    """SELECT CAST(s_suppkey AS BIGINT) source_id, s_name source_name,
    CASE s_suppkey % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'api' WHEN 2 THEN 'crawler' ELSE 'print' END source_type,
    CAST(s_suppkey % 11 AS BIGINT) reliability_score FROM supplier""",
)
part(
    "xml",
    """SELECT news_id, '<news id="' || news_id || '" lang="' || language || '"><title><![CDATA[' || title || ']]></title><summary><![CDATA['
    || substr(summary, 1, 200) || '...]]></summary><metadata>' || coalesce('<country>' || primary_country || '</country>', '')
    || '</metadata></news>' AS xml_content FROM news JOIN primary_of USING (news_id)""",
)

# --- the index -------------------------------------------------------------------

part(
    "stems",
    f"""SELECT DISTINCT news_id, f, {stem('w')} t FROM (
    SELECT news_id, 'title' f, unnest(string_split_regex(lower(title), '[^a-z0-9]+')) w FROM news
    UNION ALL SELECT news_id, 'content', unnest(string_split_regex(lower(content), '[^a-z0-9]+')) FROM news)
    WHERE length(w) > 2 AND w NOT IN {words(L.EN_STOPWORDS)}""",
)
part(
    "postings",
    """SELECT t AS term, news_id, CASE f WHEN 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END tf_weight, '/news/' || f xpath_path, f field_type,
    language, row_number() OVER (PARTITION BY news_id, f ORDER BY t) - 1 AS position, created_at FROM stems JOIN news USING (news_id)
    UNION ALL SELECT primary_country, news_id, 1.5::DOUBLE, '/news/metadata/country', 'metadata', language, 0, created_at
    FROM primary_of JOIN news USING (news_id) WHERE primary_country IS NOT NULL""",
)
part("sizes", "SELECT news_id, count(*) term_count FROM postings GROUP BY news_id")
part(
    "logs",
    "SELECT news_id, coalesce(term_count, 0) term_count FROM news LEFT JOIN sizes USING (news_id)",
)

# --- pages -------------------------------------------------------------------------

TOKEN_RX = r"<!--[\s\S]*?-->|<(?:script|style)\b[\s\S]*?</(?:script|style)>|<[^>]+>|[^<]+"
part(
    "tok",
    f"""SELECT page_id, pos, tok, lower(regexp_extract(tok, '^<(/?[a-zA-Z][a-zA-Z0-9]*)', 1)) tag FROM (
    SELECT page_id, unnest(toks) tok, generate_subscripts(toks, 1) pos FROM (
    SELECT page_id, regexp_extract_all(html, '{TOKEN_RX}') toks FROM pages))""",
)
part(
    "depth",
    f"""SELECT *, sum(CASE tag WHEN 'article' THEN 1 WHEN '/article' THEN -1 ELSE 0 END) OVER w in_article,
    sum(CASE WHEN regexp_full_match(tag, '/?(?:{BLOCK_NAMES})') THEN 1 ELSE 0 END) OVER w block
    FROM tok WINDOW w AS (PARTITION BY page_id ORDER BY pos)""",
)
part(
    "openers",
    f"""SELECT page_id, block, min(tag) opener, min(in_article) inside FROM depth
    WHERE regexp_full_match(tag, '/?(?:{BLOCK_NAMES})') GROUP BY page_id, block""",
)
part(
    "blocks",
    f"""SELECT page_id, block, min(opener) opener, min(inside) inside,
    {trim_ws(entities("string_agg(" + trim_ws('tok') + ", '' ORDER BY pos)"))} body
    FROM depth JOIN openers USING (page_id, block) WHERE tok NOT LIKE '<%' GROUP BY page_id, block""",
)
part("paragraphs", "SELECT page_id, block, body FROM blocks WHERE opener = 'p' AND body <> ''")
part(
    "generic_blocks",
    """SELECT page_id, min(block) block, body FROM blocks WHERE inside >= 1 AND opener IN ('p', 'div', 'h2', 'h3', 'h4', 'h5', 'li')
    AND length(body) > 3 AND right(body, 1) NOT IN (':', '：', '；', ';') GROUP BY page_id, body""",
)
part(
    "content_of",
    """SELECT page_id, CASE WHEN length(coalesce(g, '')) >= 200 THEN g ELSE coalesce(p, g, '') END content FROM pages
    LEFT JOIN (SELECT page_id, string_agg(body, chr(10) || chr(10) ORDER BY block) g FROM generic_blocks GROUP BY page_id) USING (page_id)
    LEFT JOIN (SELECT page_id, string_agg(body, chr(10) || chr(10) ORDER BY block) p FROM paragraphs WHERE length(body) > 5
      GROUP BY page_id) USING (page_id)""",
)
part(
    "full_of",
    """SELECT page_id, coalesce(a, p, '') full_content FROM pages
    LEFT JOIN (SELECT page_id, string_agg(p.body, chr(10) || chr(10) ORDER BY p.block) a FROM paragraphs p JOIN blocks b USING (page_id, block)
      WHERE b.inside >= 1 GROUP BY page_id) USING (page_id)
    LEFT JOIN (SELECT page_id, string_agg(body, chr(10) || chr(10) ORDER BY block) p FROM paragraphs GROUP BY page_id) USING (page_id)""",
)
part("origins", "SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]*') origin FROM pages")
part(
    "media_nums",
    "SELECT page_id, CAST(page_id AS VARCHAR) n, url, regexp_extract(url, '^[a-z]+://[^/?#]*') origin, "
    "CASE WHEN url LIKE '%/' THEN url ELSE regexp_replace(url, '/[^/]*$', '') || '/' END folder FROM pages",
)

# --- search ----------------------------------------------------------------------------


def ranked(terms: list[str], least: float, path: str | None = None, index: str = "postings", news: str = "recent", lang: str = "en") -> str:
    where = f" AND xpath_path = {q(path)}" if path else ""
    return (
        f"SELECT news_id, {news}.created_at, sum(tf_weight) score, count(DISTINCT term) match_count FROM {index} JOIN {news} USING (news_id) "
        f"WHERE term IN {words(terms)} AND {index}.language = {q(lang)}{where} GROUP BY news_id, {news}.created_at HAVING count(DISTINCT term) >= {least}"
    )


def by_country(code: str) -> str:
    return (
        "SELECT news_id, created_at, 1.5::DOUBLE score, 1 match_count FROM recent JOIN news_countries USING (news_id) "
        f"WHERE is_primary AND country_code = {q(code)}"
    )


def latest() -> str:
    return "SELECT news_id, created_at, 1.0::DOUBLE score, 1 match_count FROM recent"


def titled(phrases: list[str], score: float, news: str = "recent") -> str:
    hits = " AND ".join(f"contains({fold('title')}, {fold(q(p))})" for p in phrases)
    return f"SELECT news_id, created_at, {score}::DOUBLE score, 1 match_count FROM {news} WHERE {hits}"


def page(query_id: int, hits: str, start: int, size: int, titles: str = "news") -> str:
    return (
        f"SELECT CAST({query_id} AS BIGINT) query_id, position, p.news_id, t.title, p.score, CAST(match_count AS BIGINT) match_count, "
        f"{fmt('p.created_at')} created_at, count(*) OVER () page_count, total FROM (SELECT *, count(*) OVER () total, "
        f"row_number() OVER (ORDER BY score DESC, created_at DESC, news_id DESC) AS position FROM ({hits})) p JOIN {titles} t USING (news_id) "
        f"WHERE position > {start - 1} AND position <= {start - 1 + size}"
    )


def union(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)


#: Hits of each request, first row and most rows of its page.
SEARCHES = {
    0: (latest(), 3, 7),
    1: (ranked(["tion", "ble", "ther", "thon"], 2), 1, 20),
    2: (ranked(["tion", "not", "ble"], 1.5, "/news/content"), 1, 50),
    3: (ranked(["ther", "and", "que", "ble", "elle", "thst"], 3), 2, 5),
    4: (by_country("AB"), 1, 5),
    5: (by_country("ZZ"), 1, 20),
    6: (titled(["THE"], 2.0), 2, 30),
    7: (titled(["thand", "wh"], 1.5), 1, 10),
    9: (titled(["DÉ"], 2.0), 1, 4),
    10: (ranked(["http", "tion"], 1), 1, 20),
    11: (ranked(["nosuchterm"], 1), 1, 20),
    13: (titled(["the"], 2.0), 100000, 20),
}
part("found", union(*(page(i, *s) for i, s in SEARCHES.items())))
part("totals", union(*(f"SELECT CAST({i} AS BIGINT) query_id, count(*) total FROM ({hits})" for i, (hits, _, _) in SEARCHES.items())))
part(
    "answered",
    """SELECT asked.query_id, query, coalesce(any_value(totals.total), 0) total, count(position) page_count, min(position) first_position
    FROM asked LEFT JOIN totals USING (query_id) LEFT JOIN found USING (query_id) GROUP BY asked.query_id, query""",
)
part(
    "responses",
    """SELECT query_id, '<searchRetrieveResponse><version>1.1</version><numberOfRecords>' || total || '</numberOfRecords><records>' || coalesce(records, '')
    || '</records><echoedSearchRetrieveRequest><query>' || replace(replace(query, '&', '&amp;'), '<', '&lt;') || '</query></echoedSearchRetrieveRequest></searchRetrieveResponse>' response
    FROM answered LEFT JOIN (SELECT query_id, string_agg('<record><recordSchema>news</recordSchema><recordPacking>xml</recordPacking><recordPosition>' || position
      || '</recordPosition><datestamp>' || created_at || '</datestamp><recordData>' || xml_content || '</recordData></record>', '' ORDER BY position) records
      FROM found JOIN xml USING (news_id) GROUP BY query_id) USING (query_id)""",
)
part("asked", f"SELECT CAST(query_id AS BIGINT) query_id, query FROM {values([(i, r.query) for i, r in enumerate(Q.REQUESTS)])} t(query_id, query)")

# --- gate ---------------------------------------------------------------------------------

part(
    "arrivals",
    "SELECT news_id, title, content, source_url, source_id, created_at, published_at FROM raw UNION ALL "
    "SELECT news_id + 10000000, title, content, upper(source_url), source_id, created_at, published_at FROM raw",
)
part(
    "checked",
    "SELECT *, lower(source_url) k, length(content) < 60 short, trim(title) = '' untitled, "
    "published_at < created_at - INTERVAL 48 HOUR late FROM arrivals",
)
part(
    "firsts",
    "SELECT k, min(news_id) first FROM checked WHERE NOT short AND NOT untitled AND NOT late GROUP BY k",
)
part(
    "gated",
    f"""SELECT news_id, source_id, CASE WHEN short THEN 'short' WHEN untitled THEN 'untitled' WHEN first < news_id THEN 'duplicate'
    WHEN late THEN 'late' ELSE 'ok' END status_kind, CASE WHEN short THEN 'Rejected: Content too short (' || length(content) || ' chars)'
    WHEN untitled THEN 'Rejected: Title empty' WHEN first < news_id THEN 'Rejected: Duplicate URL (id:' || first || ')'
    WHEN late THEN 'Rejected: Exceeds 48h limit (published: ' || {fmt('published_at')} || ')' ELSE 'Success' END status
    FROM checked LEFT JOIN firsts USING (k)""",
)

# --- topics --------------------------------------------------------------------------------


def phrase_parts(prefix: str, news: str) -> None:
    part(
        f"{prefix}_titles",
        f"SELECT news_id, title, language, created_at FROM {news} WHERE created_at > {EDGE}",
    )
    part(
        f"{prefix}_words",
        f"""SELECT news_id, lt, w, row_number() OVER (PARTITION BY news_id ORDER BY i) i FROM (SELECT news_id, lower(title) lt,
        unnest(ws) w, generate_subscripts(ws, 1) i FROM (SELECT news_id, title,
        list_transform(list_filter(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_]+'), lambda x: true), lambda x: x) ws
        FROM {prefix}_titles WHERE language = 'en')) WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN {words(L.EN_STOPWORDS)}""",
    )
    part(
        f"{prefix}_en",
        f"""SELECT DISTINCT news_id, p, n FROM (SELECT news_id, lt, w || ' ' || lead(w) OVER x p, 2 n FROM {prefix}_words
          WINDOW x AS (PARTITION BY news_id ORDER BY i)
        UNION ALL SELECT news_id, lt, w || ' ' || lead(w, 1) OVER x || ' ' || lead(w, 2) OVER x, 3 FROM {prefix}_words
          WINDOW x AS (PARTITION BY news_id ORDER BY i)) WHERE p IS NOT NULL AND contains(lt, p)""",
    )
    part(
        f"{prefix}_zh",
        f"""SELECT DISTINCT news_id, substr(c, CAST(i AS BIGINT), n) p, n FROM (SELECT news_id, c, n, unnest(generate_series(1, length(c) - n + 1)) i
        FROM (SELECT news_id, regexp_replace(title, '[^\\x{{4E00}}-\\x{{9FFF}}]', '', 'g') c FROM {prefix}_titles WHERE language = 'zh'),
        (VALUES (6), (5), (4)) t(n) WHERE length(c) >= n) """,
    )
    part(
        f"{prefix}_scored",
        f"""SELECT language, p phrase, count(*) doc_freq, CAST(max(n) AS BIGINT) length, round(count(*) * (1.0 + 0.2 * max(n)), 6)::DOUBLE score FROM (
        SELECT 'en' language, * FROM {prefix}_en UNION ALL SELECT 'zh', * FROM {prefix}_zh)
        WHERE length(p) >= 4 AND NOT regexp_full_match(p, '[0-9]+') AND NOT regexp_matches(p, {q("|".join(L.MEANINGLESS_PATTERNS))})
        AND p NOT IN {words(L.FRAGMENT_PHRASES)} AND NOT (regexp_full_match(p, '[a-zA-Z]+') AND length(p) > 10)
        AND p NOT IN (SELECT lower(country_code) FROM countries UNION SELECT lower(country_name_en) FROM countries
          UNION SELECT country_name FROM countries) GROUP BY language, p""",
    )
    overlap = (
        "contains(r.phrase, t.phrase) OR contains(t.phrase, r.phrase) OR len(list_filter(generate_series(1, least(length(r.phrase), length(t.phrase)) "
        "- least(length(r.phrase), length(t.phrase)) * 2 // 5), lambda i: contains(CASE WHEN length(t.phrase) <= length(r.phrase) THEN r.phrase ELSE t.phrase END, "
        "substr(CASE WHEN length(t.phrase) <= length(r.phrase) THEN t.phrase ELSE r.phrase END, CAST(i AS BIGINT), least(length(r.phrase), length(t.phrase)) * 2 // 5 + 1)))) > 0"
    )
    part(
        f"{prefix}_rank",
        f"""SELECT *, row_number() OVER (PARTITION BY language ORDER BY score DESC, length(phrase) DESC, phrase) rn FROM {prefix}_scored""",
    )
    # step k holds the phrases still possible after k choices; the best of them is choice k + 1
    previous = f"{prefix}_rank"
    for step in range(10):
        part(f"{prefix}_top{step}", f"SELECT * FROM {previous} QUALIFY row_number() OVER (PARTITION BY language ORDER BY rn) = 1")
        part(
            f"{prefix}_left{step}",
            f"SELECT r.* FROM {previous} r JOIN {prefix}_top{step} t USING (language) WHERE NOT ({overlap})",
        )
        previous = f"{prefix}_left{step}"
    part(
        f"{prefix}_mix",
        f"""SELECT row_number() OVER (ORDER BY block, k) AS position, phrase AS name, doc_freq AS count FROM (SELECT *,
        CASE language WHEN 'zh' THEN 0 ELSE 1 END block FROM ("""
        + " UNION ALL ".join(f"SELECT {k} k, * FROM {prefix}_top{k}" for k in range(10))
        + ") WHERE language = 'en' OR k < 6)",
    )


part(
    "both_news",
    "SELECT news_id, title, language, created_at FROM news UNION ALL SELECT news_id + 10000000, title, language, created_at FROM han_news",
)
phrase_parts("tp", "news")
phrase_parts("tz", "han_news")
phrase_parts("tb", "both_news")

# --- assembling ----------------------------------------------------------------------------


def build(body: str) -> str:
    """The body behind every part it needs, in order of need; it may bring parts of its own."""
    order: list[str] = []

    def need(sql: str, path: tuple[str, ...]) -> None:
        bare = re.sub(r"'[^']*'", "''", sql)
        for name in re.findall(r"(?:FROM|JOIN|,)\s+\(?([a-z_][a-z_0-9]*)", bare):
            if name in PARTS and name not in order and name not in path:
                need(PARTS[name], (*path, name))
                order.append(name)

    need(body, ())
    shared = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name]})" for name in order)
    if not shared:
        return body
    own = body[len("WITH ") :] if body.startswith("WITH ") else ""
    return f"WITH {shared},\n{own}" if own else f"WITH {shared}\n{body}"


def _parsed(source: str) -> str:
    """Query parsing over a (query_id, query) part."""
    ascii_rx, han = "[^a-zA-Z0-9\\x{4E00}-\\x{9FFF}]+", HAN_RX
    return f"""SELECT query_id, query, CASE WHEN trim(query) = '*' THEN 'latest' WHEN xpath = '/news/metadata/country' THEN 'country'
    WHEN xpath = '/news/title' THEN 'title' ELSE 'ranked' END kind, language, xpath, clean,
    array_to_string(CASE WHEN language = 'zh' THEN coalesce((SELECT list(t ORDER BY f) FROM (SELECT t, min(i) f FROM (SELECT
        substr(clean, CAST(i AS BIGINT), 2) t, i FROM (SELECT unnest(generate_series(1, length(clean) - 1)) i))
        WHERE regexp_matches(t, '^{han}') GROUP BY t)), [])
      WHEN xpath = '/news/metadata/country' THEN [trim(clean)]
      ELSE list_transform(list_filter(regexp_extract_all(clean, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 2), lambda w: lower(w)) END, '|') terms,
    array_to_string(list_filter(string_split_regex(clean, '{ascii_rx}'), lambda w: length(w) >= 2), '|') keywords
    FROM (SELECT *, CASE WHEN regexp_matches(clean, '{han}') THEN 'zh' ELSE 'en' END language FROM (
      SELECT *, CASE WHEN xpath IS NULL THEN query ELSE trim(substr(query, strpos(query, ':') + 1)) END clean FROM (
      SELECT query_id, query, CASE WHEN contains(query, '://') OR NOT contains(query, ':') THEN NULL
        ELSE CASE lower(split_part(query, ':', 1)) WHEN 'title' THEN '/news/title' WHEN 'content' THEN '/news/content'
        WHEN 'country' THEN '/news/metadata/country' END END xpath FROM ({source}))))"""


FORMS = """CASE news_id % 6 WHEN 0 THEN w WHEN 1 THEN 'Title:' || w WHEN 2 THEN 'content: ' || w WHEN 3 THEN 'country: ' || w
    WHEN 4 THEN 'http://' || w ELSE '*' END"""
PARSE_SOURCE = (
    f"SELECT news_id query_id, {FORMS} query FROM (SELECT news_id, array_to_string(string_split(title, ' ')[1:4], ' ') w FROM raw)"
)


VIDEO_TYPE = (
    "CASE WHEN contains(lower({u}), '.m3u8') THEN 'hls' WHEN contains(lower({u}), 'youtube') OR contains(lower({u}), 'youtu.be') THEN 'youtube' "
    "WHEN contains(lower({u}), 'bilibili') THEN 'bilibili' WHEN contains(lower({u}), 'player') OR contains(lower({u}), 'embed') THEN 'embed' "
    "ELSE 'mp4' END"
)
EMBED = (
    "CASE WHEN kind = 'youtube' AND regexp_matches({u}, 'youtube.com/embed/|youtube.com/watch[?]v=|youtu.be/') THEN "
    "'https://www.youtube.com/embed/' || regexp_extract({u}, '(?:youtube.com/embed/|youtube.com/watch[?]v=|youtu.be/)([a-zA-Z0-9_-]+)', 1) "
    "WHEN kind = 'bilibili' AND regexp_matches({u}, '(?i)bv[a-z0-9]') THEN 'https://player.bilibili.com/player.html?bvid=BV' || "
    "regexp_extract({u}, '(?i)bv([a-z0-9]+)', 1) ELSE {u} END"
)
part(
    "players",
    "SELECT doc_id, "
    + pick([q(p.split("{}")[0]) + " || doc_id || " + q(p.split("{}")[1]) for p in Q.PLAYERS], f"doc_id % {len(Q.PLAYERS)}")
    + " url FROM documents",
)
part(
    "media",
    """SELECT news_id, place, media_type, media_url, is_cover FROM (
    SELECT news_id, i - 1 place, 'image' media_type, 'https://img.example/' || news_id || '-' || i media_url, i = 1 is_cover
      FROM (SELECT news_id, unnest(generate_series(1, news_id % 3)) i FROM raw)
    UNION ALL SELECT news_id, 0, 'image', 'https://one.example/' || news_id, true FROM raw WHERE news_id % 3 = 0 AND news_id % 4 = 0
    UNION ALL SELECT news_id, CASE WHEN news_id % 3 > 0 THEN news_id % 3 WHEN news_id % 4 = 0 THEN 1 ELSE 0 END, 'video',
      'https://vid.example' || CASE news_id % 5 WHEN 0 THEN '/a.m3u8?youtube' WHEN 1 THEN '//youtu.be/x' WHEN 2 THEN '/bilibili/BV1'
      WHEN 3 THEN '/embed/1' ELSE '/x.mp4' END, false FROM raw WHERE news_id % 2 = 0)""",
)
part(
    "country_counts",
    """SELECT country_code, count(DISTINCT news_id) news_count FROM recent JOIN news_countries USING (news_id)
    WHERE is_primary GROUP BY country_code""",
)
part("located", "SELECT country_code, country_name, latitude, longitude FROM countries WHERE latitude IS NOT NULL")


def heat(value: str) -> str:
    ratio = f"least({value} / 50.0::DOUBLE, 1.0::DOUBLE)"

    def rgb(a, b, r):
        return "'rgb(' || " + " || ', ' || ".join(f"CAST(floor({x}::DOUBLE + ({y - x})::DOUBLE * ({r}) + 0.5::DOUBLE) AS INTEGER)" for x, y in zip(a, b)) + " || ')'"

    s = L.HEAT_STOPS
    return (
        f"CASE WHEN {ratio} < 0.33::DOUBLE THEN {rgb(s[0], s[1], f'{ratio} / 0.33::DOUBLE')} "
        f"WHEN {ratio} < 0.66::DOUBLE THEN {rgb(s[1], s[2], f'({ratio} - 0.33::DOUBLE) / 0.33::DOUBLE')} "
        f"ELSE {rgb(s[2], s[3], f'({ratio} - 0.66::DOUBLE) / 0.34::DOUBLE')} END"
    )


def xyz(radius: float) -> str:
    phi, theta = "radians(90.0::DOUBLE - latitude)", "radians(longitude + 180.0::DOUBLE)"
    r = f"{radius}::DOUBLE"
    return (
        f"round(-({r} * sin({phi}) * cos({theta})), 6) + 0.0::DOUBLE x, round({r} * cos({phi}), 6) + 0.0::DOUBLE y, "
        f"round({r} * sin({phi}) * sin({theta}), 6) + 0.0::DOUBLE z"
    )


def _meaningless(col: str) -> str:
    return f"({col} IN {words(L.FRAGMENT_PHRASES)} OR regexp_matches({col}, {q("|".join(L.MEANINGLESS_PATTERNS))}))"


STATS = f"""SELECT source_id, count(*) total_news, count(*) FILTER (WHERE CAST(created_at AS DATE) = last_day) today_news,
    {fmt('max(created_at)')} last_publish_time FROM (SELECT *, max(CAST(created_at AS DATE)) OVER (PARTITION BY source_id) last_day FROM news)
    GROUP BY source_id"""


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}

    # sources and sinks
    o["recent_news_scan"] = f"SELECT news_id, title, {fmt('created_at')} created_at FROM recent"
    body = (
        "CASE WHEN doc_id % 3 <> 0 THEN 'A & B' || text ELSE 'Sum ' || text END"
    )
    o["rss_items"] = f"""SELECT coalesce(title, '无标题') title, content, source_url, source source_name, published_at,
        CASE WHEN doc_id % 5 = 0 THEN '/m/' || doc_id WHEN doc_id % 5 = 1 THEN '/e/' || doc_id WHEN doc_id % 3 <> 0 THEN '/i/' || doc_id || '.jpg' END image_url,
        CAST(CASE WHEN doc_id % 3 <> 0 THEN 2 ELSE 0 END AS BIGINT) n_images, 'general' category_hint, 'rss' fetch_method FROM (
        SELECT doc_id, source, 'https://' || source || '.example/' || doc_id source_url, CASE WHEN doc_id % 10 <> 3 THEN split_part(text, chr(10), 1) END title,
        {body} content, CASE WHEN doc_id % 4 = 3 THEN {fmt(NOW)} ELSE {fmt(back('doc_id'))} END published_at FROM documents)"""
    feeds = values([(i, *f) for i, f in enumerate(L.FEEDS)])
    o["feed_config"] = f"""SELECT feed, feed_language, category_hint, country_hint, count(*) articles FROM documents
        JOIN {feeds} t(i, feed, feed_language, category_hint, country_hint) ON doc_id % 11 = i GROUP BY ALL"""
    o["api_items"] = f"""SELECT coalesce(title, '无标题') title, full_content content, source_url, coalesce(name, 'NewsAPI') source_name,
        published_at, 'general' category_hint FROM (SELECT a.*, CASE WHEN needs THEN CASE WHEN length(f.full_content) > 200 THEN f.full_content END ELSE body END full_content
        FROM (SELECT *, url IS NOT NULL AND (length(body) < 500 OR (contains(body, '...') AND contains(body, '[') AND contains(lower(body), 'char'))) needs,
          coalesce(url, '') source_url FROM (SELECT doc_id % 250 page_id, nullif(CASE WHEN doc_id % 7 <> 0 THEN split_part(text, chr(10), 1) END, '') title,
          CASE WHEN doc_id % 13 <> 0 THEN 'https://page.example/' || doc_id % 250 END url,
          coalesce(nullif(CASE WHEN doc_id % 3 <> 0 THEN text END, ''), nullif(substr(text, 1, 700), ''), '') body,
          CASE WHEN doc_id % 2 = 0 THEN {fmt(back('doc_id'))} ELSE {fmt(NOW)} END published_at, CASE WHEN doc_id % 2 = 1 THEN source END AS name
          FROM documents WHERE (doc_id // 5) % 10 <> 9)) a LEFT JOIN full_of f USING (page_id)) WHERE full_content <> ''"""
    o["full_page_content"] = "SELECT page_id, full_content FROM full_of"
    o["all_sources_union"] = """SELECT 'html' fetch_method, count(*) articles, count(title) titled, CAST(sum(length(content)) AS BIGINT) chars FROM raw
        UNION ALL SELECT 'page', count(*), 0, CAST(sum(length(full_content)) AS BIGINT) FROM full_of"""
    o["write_news_tables"] = """SELECT 'news' table_name, count(*) table_rows, count(DISTINCT CAST(created_at AS DATE)) AS days FROM news
        UNION ALL SELECT 'news_countries', count(*), count(DISTINCT CAST(created_at AS DATE)) FROM primary_of JOIN news USING (news_id) WHERE primary_country IS NOT NULL
        UNION ALL SELECT 'news_categories', count(*), count(DISTINCT CAST(created_at AS DATE)) FROM news_categories JOIN news USING (news_id)
        UNION ALL SELECT 'media', count(*), count(DISTINCT CAST(created_at AS DATE)) FROM news
        UNION ALL SELECT 'inverted_index', count(*), count(DISTINCT CAST(created_at AS DATE)) FROM postings
        UNION ALL SELECT 'api_request_logs', count(*), count(DISTINCT CAST(created_at AS DATE)) FROM news
        UNION ALL SELECT 'index_build_logs', count(*), count(DISTINCT CAST(created_at AS DATE)) FROM news"""
    o["media_rows"] = "SELECT news_id, place, media_type, media_url, is_cover FROM media"
    o["article_xml"] = "SELECT news_id, xml_content FROM xml"
    o["sru_response"] = "SELECT query_id, response FROM responses"
    o["sru_parse"] = f"""SELECT query_id, news_id id, trim(title) title, trim(substr(substr(content, 1, 500), 1, 200) || '...') summary,
        coalesce(primary_country, '') country, created_at AS time FROM (SELECT query_id, news_id, created_at FROM found) JOIN (SELECT news_id, title, content FROM raw) USING (news_id)
        JOIN primary_of USING (news_id)"""
    o["export_csv"] = f"SELECT regexp_replace(title, '[\\r\\n]', ' ', 'g') title, '' author, {fmt('published_at')} date, 's' || source_id source FROM raw"
    o["export_json"] = "SELECT news_id, title, content, source_url FROM raw"
    o["dimension_seed"] = """SELECT 'countries' table_name, count(*) AS rows FROM countries UNION ALL SELECT 'country_keywords', count(*) FROM kw WHERE code IN
        (SELECT country_code FROM countries) UNION ALL SELECT 'categories', 7 UNION ALL SELECT 'sources', 21"""

    # extraction
    clean = "regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script>|<style\\b.*?</style>', '', 'g'), '<[^>]*>', '', 'g')"
    o["strip_html"] = f"SELECT page_id, {trim_ws(entities(clean))} AS text FROM pages"
    o["article_links"] = f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS position, link, link_title FROM (
        SELECT page_id, link, min(pos) pos, arg_min(title, pos) link_title FROM (SELECT page_id, pos, CASE WHEN href LIKE '//%' THEN 'https:' || href
          WHEN href LIKE '/%' THEN origin || href ELSE href END link, {entities('title')} title FROM (SELECT page_id, origin, pos,
          regexp_extract(a, 'href="([^"]*)"', 1) href, {trim_ws("regexp_replace(a, '<[^>]*>', '', 'g')")} title FROM (SELECT page_id, unnest(links) a, generate_subscripts(links, 1) pos
          FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script\\b.*?</script>', '', 'g'), '(?is)<a\\s[^>]*>.*?</a>') links FROM pages)) JOIN origins USING (page_id)))
        WHERE link <> '' AND length(title) >= 1 GROUP BY page_id, link)"""
    o["normalize_url"] = """SELECT page_id, link, CASE WHEN trim(link) LIKE '//%' THEN 'https:' || trim(link) WHEN trim(link) LIKE '/%' THEN origin || trim(link) ELSE trim(link) END href,
        CASE WHEN link LIKE '//%' THEN 'https:' || link WHEN link LIKE '/%' THEN origin || link WHEN link LIKE 'http%' THEN link ELSE folder || link END media
        FROM (SELECT page_id, origin, folder, unnest(['//h.example/' || page_id, '/p/' || page_id, 'x/' || page_id, 'http://a/b', ' /trim ', '']) link FROM media_nums)"""
    o["main_content"] = "SELECT page_id, 'generic' site, content FROM content_of"
    o["block_filters"] = """SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE length(line) > 3 AND right(line, 1) NOT IN (':', '：', '；', ';')) marks,
        count(*) FILTER (WHERE length(line) > 3 AND NOT (line LIKE '%纠错' OR line LIKE '%编辑：' OR line LIKE '%责任编辑')) editor,
        count(*) FILTER (WHERE length(line) > 20 AND NOT (contains(lower(line), 'advertisement') OR contains(lower(line), 'ad feedback') OR contains(lower(line), 'cnn sans'))) ads
        FROM (SELECT doc_id, unnest(ls) || ['', ':', ' 纠错', ' Ad Feedback', '；'][CAST((generate_subscripts(ls, 1) - 1) % 5 AS BIGINT) + 1] AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) ls FROM documents)) GROUP BY doc_id"""
    o["publish_time"] = f"""SELECT page_id, CASE page_id % 5 WHEN 4 THEN {fmt(NOW)} WHEN 1 THEN {fmt('t')} ELSE strftime(t, '%Y-%m-%d %H:%M:00') END published_at
        FROM (SELECT page_id, {back('page_id')} t FROM pages)"""
    o["url_date"] = f"SELECT page_id, CASE WHEN page_id % 5 < 3 THEN strftime({back('page_id')}, '%Y-%m-%d') END AS day FROM pages"
    o["page_images"] = """SELECT page_id, unnest([0, 1, 2])::BIGINT AS position, unnest([origin || '/img/' || n || '.jpg', 'https://cdn.example.com/' || n || '.png',
        folder || 'master1050-' || n || '.jpg']) url, unnest(['Alt ' || n, 'T' || n, '']) alt, unnest(['Cap' || n, 'T' || n, '']) caption FROM media_nums"""
    o["image_srcset_pick"] = "SELECT page_id, '/q/' || page_id || '.jpg' picked FROM pages"
    o["image_url_rewrite"] = "SELECT page_id, replace(url || '/thumbLarge.jpg', 'thumbLarge', 'master1050') image FROM pages"
    o["page_videos"] = """SELECT page_id, unnest([0, 1, 2, 3])::BIGINT AS position, unnest([origin || '/v/' || n || '.mp4', origin || '/v/' || n || '.webm',
        'https://www.youtube.com/embed/' || n, 'https://cdn.example.com/' || n || '.m3u8']) url, unnest(['direct', 'source', 'iframe', 'script']) "type",
        unnest(['unknown', 'unknown', 'youtube', 'unknown']) platform FROM media_nums"""
    o["video_platform"] = """SELECT doc_id, url, CASE WHEN contains(url, 'youtube.com') OR contains(url, 'youtu.be') THEN 'youtube' WHEN contains(url, 'vimeo.com') THEN 'vimeo'
        WHEN contains(url, 'bilibili.com') THEN 'bilibili' WHEN contains(url, 'aljazeera.com') THEN 'aljazeera' WHEN contains(url, 'nytimes.com') THEN 'nytimes'
        WHEN contains(url, 'player') THEN 'player' ELSE 'unknown' END platform FROM players"""
    o["video_type"] = f"SELECT doc_id, url, {VIDEO_TYPE.format(u='url')} \"type\" FROM players"
    o["url_media_ids"] = f"SELECT doc_id, {EMBED.format(u='url')} embed, CAST(doc_id AS VARCHAR) number FROM (SELECT *, {VIDEO_TYPE.format(u='url')} kind FROM players)"
    hosts = ["'https://www.googletagmanager.com/x'", "'https://a.example/Pixel'", "'https://ok.example/v'", "'//bat.bing.com/'"]
    o["tracker_iframe_filter"] = f"SELECT doc_id, url FROM (SELECT doc_id, {pick(hosts, 'doc_id % 4')} || '?d=' || source url FROM documents) WHERE NOT {any_of('lower(url)', L.TRACKER_PARTS)}"
    o["paywall_filter"] = f"""SELECT page_id, url FROM (SELECT page_id, url, lower({clean.replace('html,', 'noted,')}) body FROM (SELECT page_id, url, html || CASE WHEN page_id % 4 = 0 THEN
        {pick(["'Sign In to read'", "'please SUBSCRIBE'", "'<i>login</i>'", "'free'"], '(page_id // 4) % 4')} ELSE '' END noted FROM pages)) WHERE NOT {any_of('body', L.PAYWALL_SIGNS)}"""
    site_rows = [
        (i, p["site"] if p["site"] != "full_page" else "generic", "article" in p["containers"], "|".join(["", *p["blocks"], ""]), p["least"],
         p["rule"], p.get("gate"), p["article_gate"], p.get("distinct", False), p.get("fallback", False))
        if p["site"] != "full_page" else
        (i, *[("generic", True, "|".join(["", *P.PROFILES[0]["blocks"], ""]), 3, "marks", 200, 0, True, True)][0])
        for i, p in enumerate(P.PROFILES)
    ]
    site_sql = f"""WITH rule AS (SELECT * FROM {values(site_rows)} t(i, site, has_article, tags, least, rule, gate, article_gate, uniq, fallback)),
        placed AS (SELECT page_id, r.* FROM pages JOIN rule r ON page_id % {len(P.PROFILES)} = i),
        kept AS (SELECT page_id, block, body, uniq FROM placed JOIN blocks USING (page_id) WHERE has_article AND inside >= 1 AND contains(tags, '|' || opener || '|')
          AND body <> '' AND length(body) > least AND NOT (rule = 'marks' AND right(body, 1) IN (':', '：', '；', ';'))
          AND NOT (rule = 'editor' AND (body LIKE '%纠错' OR body LIKE '%编辑：' OR body LIKE '%责任编辑'))
          AND NOT (rule = 'ads' AND {any_of('lower(body)', L.AD_TEXTS)})),
        single AS (SELECT page_id, min(block) block, body FROM kept GROUP BY page_id, body, CASE WHEN uniq THEN 0 ELSE block END),
        texts AS (SELECT page_id, string_agg(body, chr(10) || chr(10) ORDER BY block) g FROM single GROUP BY page_id),
        paras AS (SELECT page_id, string_agg(body, chr(10) || chr(10) ORDER BY block) p FROM paragraphs WHERE length(body) > 5 GROUP BY page_id),
        final AS (SELECT page_id, site, article_gate, CASE WHEN length(coalesce(g, '')) > gate OR (length(g) = gate) THEN g WHEN fallback THEN coalesce(p, g, '')
          ELSE coalesce(g, '') END content FROM placed LEFT JOIN texts USING (page_id) LEFT JOIN paras USING (page_id))
        SELECT {{shown}} FROM final JOIN pages USING (page_id) {{more}} WHERE length(content) > article_gate
          AND NOT (site = 'washingtonpost' AND {any_of('lower(' + clean + ')', L.PAYWALL_SIGNS)})"""
    o["site_profiles"] = site_sql.replace("{shown}", "page_id, site, length(content) chars, md5(content) digest").replace("{more}", "")
    # what the article of a page gives by the rules of its site: the name of the source, hints, pictures, players
    told = [(p["site"], p.get("source"), p.get("category"), p.get("country"), "article" in p["containers"]) for p in P.PROFILES if p["site"] != "full_page"]
    hosted = [("nytimes", "nytimes"), ("cctv", "cctv"), ("guancha", "guancha"), ("washingtonpost", "washingtonpost")]
    o["page_articles"] = site_sql.replace("{more}", f"JOIN {values(told)} h(site, source, category, country, inside) USING (site) LEFT JOIN {values(hosted)} u(site, named) USING (site)").replace(
        "{shown}",
        """page_id, 'html_' || site fetch_method, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) title, md5(content) digest, coalesce(source, named, 'unknown') source_name,
        category category_hint, country country_hint, 'https://media.cnn.com/api/v1/images/stellar/prod/' || page_id || '.jpg' image_url, CAST(CASE WHEN site = 'cnn' THEN 1 ELSE 2 END AS BIGINT) n_images,
        concat_ws(' ', CASE WHEN site <> 'xinhua' THEN 'https://v.example/' || page_id END, CASE WHEN site NOT IN ('xinhua', 'nytimes_cn') THEN 'https://hotjar.example/' || page_id END) videos""",
    )
    feed_rows = [(i, *f) for i, f in enumerate(L.FEEDS)]
    o["feed_files"] = f"""SELECT 'Item ' || news_id title, source_url, coalesce(feed, 'unlisted') source_name, {fmt('created_at')} published_at, CASE WHEN feed IS NULL THEN 'general' ELSE hint END category_hint,
        place country_hint, length(regexp_replace(content, '\\s', '', 'g')) chars FROM raw LEFT JOIN {values(feed_rows)} f(i, feed, lang, hint, place) ON news_id % {len(L.FEEDS) + 1} = i"""
    o["api_files"] = """SELECT CASE WHEN (news_id // 5) % 2 = 0 THEN 'business' ELSE 'science' END category_hint, 'us' country_hint, 'NewsAPI' source_name, count(*) articles, count(DISTINCT source_url) addresses
        FROM raw WHERE (news_id // 5) % 10 <> 9 GROUP BY 1"""
    o["dimension_files"] = "SELECT country_code, country_name_en, country_name keyword, continent, latitude IS NOT NULL placed FROM countries"
    o["title_from_slug"] = "SELECT page_id, 'the long ' || page_id title FROM pages"
    o["source_from_url"] = f"SELECT page_id, {pick([q(x) for x in ('nytimes', 'cctv', 'guancha', 'washingtonpost', 'unknown')], 'page_id % 5')} AS source FROM pages"
    o["author_names"] = """SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'Hu ' || upper(source[1]) || source[2:] || CASE WHEN doc_id % 2 = 0 THEN ' and Liang Rui' ELSE '' END END authors FROM documents"""
    # array_join puts ' and ' between the names, which is how the text has them
    o["author_anchors"] = "SELECT page_id, 'Ann ' || page_id authors FROM pages"
    tag_counts = ", ".join(f"len(regexp_extract_all(html, '(?i)<{t}[\\s>]')) n_{t}" for t in STRUCTURE_TAGS)
    o["page_structure_profile"] = f"""SELECT page_id, length(html) size, {trim_ws(entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))} title, {tag_counts},
        len(hrefs) links, len(list_distinct(list_filter(hrefs, lambda h: {any_of('h', NEWS_LINK_PARTS)}))) news_links
        FROM (SELECT page_id, html, regexp_extract_all(html, '(?is)<a\\s[^>]*href="([^"]*)"', 1) hrefs FROM pages)"""

    # text functions
    o["detect_language"] = f"""SELECT CASE WHEN regexp_matches(text, '{HAN_RX}') THEN 'zh' ELSE 'en' END AS language, count(*) articles
        FROM (SELECT text FROM documents UNION ALL SELECT text FROM han_docs) GROUP BY 1"""
    zh_pairs = lambda col: (
        f"(SELECT news_id, f, c, unnest(generate_series(1, length(c) - 1)) i FROM (SELECT news_id, f, regexp_replace(x, '[^\\x{{4E00}}-\\x{{9FFF}}a-zA-Z0-9]', '', 'g') c FROM ({col})))"
    )
    stop2 = [w for w in L.ZH_STOPWORDS if len(w) == 2]
    pairs_sql = f"SELECT DISTINCT news_id, f, substr(c, CAST(i AS BIGINT), 2) t FROM {zh_pairs('SELECT news_id, 0 f, content x FROM han_news')} WHERE substr(c, CAST(i AS BIGINT), 2) NOT IN {words(stop2)}"
    o["tokenize_zh"] = f"SELECT news_id, coalesce(string_agg(t, ' ' ORDER BY t), '') terms FROM han_news LEFT JOIN ({pairs_sql}) USING (news_id) GROUP BY news_id"
    en_terms = f"SELECT DISTINCT doc_id, {stem('w')} t FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) w FROM documents) WHERE length(w) > 2 AND w NOT IN {words(L.EN_STOPWORDS)}"
    o["tokenize_en"] = f"SELECT doc_id, coalesce(string_agg(t, ' ' ORDER BY t), '') terms FROM documents LEFT JOIN ({en_terms}) USING (doc_id) GROUP BY doc_id"
    o["json_terms"] = f"SELECT doc_id, coalesce(string_agg(t, '|' ORDER BY t), '') terms FROM documents LEFT JOIN ({en_terms}) USING (doc_id) GROUP BY doc_id"
    o["length_caps"] = "SELECT doc_id, least(length(text), 300) title, least(length(text) * 3, 20000) content, least(length(source || text), 800) source_url FROM documents"
    o["process_article"] = f"""SELECT n.news_id, trim_title title, length(body) chars, 'en' AS language, CAST(sid AS BIGINT) source_id, count(t) term_count,
        coalesce(string_agg(t, ' ' ORDER BY t) FILTER (WHERE f = 'title'), '') title_terms, any_value(hint_category) hint_category FROM (
        SELECT news_id, {trim_ws('title')} trim_title, {trim_ws('content')} body, hint_category, CASE news_id % 4 WHEN 0 THEN 14 WHEN 1 THEN 21 WHEN 2 THEN 1 ELSE 20 END sid
        FROM news WHERE news_id % 50 <> 7) n JOIN stems USING (news_id) WHERE trim_title <> '' AND body <> '' GROUP BY n.news_id, trim_title, body, sid"""
    o["identify_country"] = "SELECT news_id, primary_country FROM primary_of"
    o["identify_country_large"] = o["identify_country"]
    names = [*L.SOURCE_IDS.items(), ("unknown", 1)]
    o["source_id_lookup"] = f"SELECT doc_id, source_name, source_id::BIGINT source_id FROM documents JOIN {values([(i, n, v) for i, (n, v) in enumerate(names)])} t(i, source_name, source_id) ON doc_id % {len(names)} = i"
    o["category_rules"] = """SELECT news_id, coalesce(string_agg(code, ',' ORDER BY code), 'else') categories FROM news LEFT JOIN matched USING (news_id) GROUP BY news_id"""
    o["category_forced"] = "SELECT news_id, coalesce(string_agg(code, ','), '') forced FROM news LEFT JOIN forced USING (news_id) GROUP BY news_id"
    o["category_fallback"] = """SELECT news_id, CAST(category_id AS BIGINT) category_id FROM (SELECT news_id, code FROM forced UNION SELECT news_id, coalesce(hint_category, 'else') FROM news
        WHERE news_id NOT IN (SELECT news_id FROM forced)) JOIN categories ON code = category_code"""
    o["summary_default"] = "SELECT news_id, CASE WHEN news_id % 3 = 1 AND trim(title) <> '' THEN title ELSE substr(content, 1, 500) END summary FROM raw"
    o["parse_query"] = _parsed(PARSE_SOURCE)
    han_source = f"SELECT query_id, translate(lower(query), '{C.LATIN}', '{C.HAN}') query FROM ({PARSE_SOURCE})"
    o["parse_query_zh"] = _parsed(han_source)
    runs = "SELECT unnest(regexp_extract_all(title, '[\\x{4E00}-\\x{9FFF}]+')) phrase FROM han_news"
    digits = "一二三四五六七八九十母净利润同比增长归上下左右前后内"
    o["is_meaningless_phrase"] = f"""SELECT phrase, count(*) uses, {_meaningless('phrase')} meaningless FROM (SELECT phrase FROM ({runs})
        UNION ALL SELECT '第' || substr(translate(phrase, '{C.HAN}', '{digits}'), 1, 3) FROM ({runs})) GROUP BY phrase"""
    o["escape_like"] = f"""SELECT count(*) FILTER (WHERE body LIKE '%5\\%%' ESCAPE '\\') five_percent, count(*) FILTER (WHERE body LIKE '%a\\_b%' ESCAPE '\\') underscore,
        count(*) FILTER (WHERE body LIKE '%\\%%' ESCAPE '\\') percent FROM (SELECT {fold("text || CASE WHEN doc_id % 2 = 0 THEN ' a_b' ELSE ' axb' END")} body FROM documents)"""
    score = "CASE WHEN reliability_score = 0 THEN 5 ELSE reliability_score END"
    colour = f"""CASE source_type WHEN 'rss' THEN '#3498db' WHEN 'api' THEN '#2ecc71' WHEN 'crawler' THEN '#e74c3c' ELSE CASE WHEN {score} >= 9 THEN '#27ae60'
        WHEN {score} >= 7 THEN '#2ecc71' WHEN {score} >= 5 THEN '#f39c12' ELSE '#e74c3c' END END"""
    o["source_badge"] = f"SELECT source_id, substr(source_name, 1, 2) logo, {colour} color FROM sources"
    o["sources_list"] = f"SELECT source_id, source_name AS name, substr(source_name, 1, 2) logo, {colour} color, source_type AS type FROM sources"
    o["snippet"] = """SELECT doc_id, CASE WHEN x IS NULL THEN '' WHEN length(x) > 200 THEN substr(x, 1, 200) || '...' ELSE x END summary
        FROM (SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN substr(text, 1, 500) END x FROM documents)"""
    o["heat_color"] = f"SELECT value, n, {heat('value')} color FROM (SELECT n_chars % 80 AS value, count(*) n FROM documents GROUP BY 1)"
    o["latlon_to_xyz"] = f"SELECT country_code, {xyz(5.0)} FROM located"
    o["country_lookup"] = f"""SELECT news_id, lower(c) country_code, country_name, latitude, longitude, c IN {words(L.TOP_COUNTRIES)} is_top
        FROM (SELECT news_id, {code_of('news_id % 30')} c FROM news) LEFT JOIN countries ON c = country_code"""
    o["fmt_time"] = f"SELECT event_id, {fmt('ts')} AS time FROM events"

    # ingest
    o["gate_articles"] = "SELECT news_id, status, status_kind FROM gated"
    o["gate_counts"] = "SELECT status_kind, count(*) articles FROM gated GROUP BY status_kind"
    o["dedupe_url"] = """SELECT news_id, source_url FROM arrivals WHERE lower(source_url) NOT IN (SELECT lower(source_url) FROM raw WHERE news_id % 10 = 0)
        QUALIFY row_number() OVER (PARTITION BY lower(source_url) ORDER BY news_id) = 1"""
    o["assign_ids"] = "SELECT news_id doc_id, 500 + row_number() OVER (ORDER BY created_at, news_id) news_id FROM raw"
    o["primary_country_row"] = "SELECT news_id, primary_country country_code, true is_primary, 1::BIGINT mention_count FROM primary_of WHERE primary_country IS NOT NULL"
    o["category_rows"] = "SELECT news_id, category_id, 1.0::DOUBLE confidence FROM news_categories"
    o["source_stats"] = STATS
    o["source_stats_incremental"] = STATS
    o["request_log"] = f"SELECT source_id, 'procedure_insert' request_type, source_url request_url, 1::BIGINT fetched_count, {fmt('created_at')} created_at FROM news"
    o["request_outcomes"] = """SELECT user_id % 21 + 1 source_id, CAST(CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS BIGINT) http_status, count(*) requests FROM events GROUP BY ALL"""
    ok = "count(*) FILTER (WHERE status_kind = 'ok')"
    o["job_totals"] = f"SELECT source_id, count(*) fetched, {ok} saved, count(*) FILTER (WHERE status_kind <> 'ok') failed, {ok} indexed FROM gated GROUP BY ROLLUP (source_id)"
    stay = f"news_id IN (SELECT news_id FROM news WHERE created_at >= {EDGE})"
    o["retention_48h"] = f"""SELECT 'news' table_name, count(*) kept_rows FROM news WHERE created_at >= {EDGE}
        UNION ALL SELECT 'api_request_logs', count(*) FROM events WHERE ts >= {NOW} - INTERVAL 7 DAY
        UNION ALL SELECT 'news_countries', count(*) FROM news_countries WHERE {stay} UNION ALL SELECT 'news_categories', count(*) FROM news_categories WHERE {stay}
        UNION ALL SELECT 'media', count(*) FROM media WHERE {stay} UNION ALL SELECT 'inverted_index', count(*) FROM postings WHERE {stay}
        UNION ALL SELECT 'index_build_logs', count(*) FROM logs WHERE {stay}"""
    o["retention_deleted"] = f"SELECT count(*) FILTER (WHERE created_at < {EDGE}) deleted_news_count, count(*) FILTER (WHERE created_at >= {EDGE}) kept_news_count FROM news"
    missing = f"created_at > {NOW} - INTERVAL 6 HOUR AND news_id % 9 = 0"
    o["unindexed_news"] = f"SELECT news_id, title, language FROM news WHERE {missing}"
    o["rebuild_missing_index"] = f"""SELECT t AS term, news_id, CASE f WHEN 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END tf_weight, '/news/' || f xpath_path,
        row_number() OVER (PARTITION BY news_id, f ORDER BY t) - 1 AS position FROM (SELECT DISTINCT news_id, f, {stem('w')} t FROM (
        SELECT news_id, 'title' f, unnest(string_split_regex(lower(title), '[^a-z0-9]+')) w FROM news WHERE {missing}
        UNION ALL SELECT news_id, 'content', unnest(string_split_regex(lower(content), '[^a-z0-9]+')) FROM news WHERE {missing})
        WHERE length(w) > 2 AND w NOT IN {words(L.EN_STOPWORDS)})
        UNION ALL SELECT primary_country, news_id, 1.5::DOUBLE, '/news/metadata/country', 0 FROM primary_of WHERE primary_country IS NOT NULL
          AND news_id IN (SELECT news_id FROM news WHERE {missing})"""

    # index
    o["build_index"] = f"SELECT term, news_id, tf_weight, xpath_path, field_type, language, CAST(position AS BIGINT) AS position, {fmt('created_at')} created_at FROM postings"
    zh_all = f"""SELECT DISTINCT news_id, f, substr(c, CAST(i AS BIGINT), 2) t FROM {zh_pairs("SELECT news_id, 'title' f, title x FROM han_news WHERE language = 'zh' UNION ALL SELECT news_id, 'content', content FROM han_news WHERE language = 'zh'")}
        WHERE substr(c, CAST(i AS BIGINT), 2) NOT IN {words(stop2)}"""
    part(
        "han_postings",
        f"""SELECT news_id, f, t AS term, '/news/' || f xpath_path, 'zh' AS language, CASE f WHEN 'title' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END tf_weight,
        row_number() OVER (PARTITION BY news_id, f ORDER BY t) - 1 AS position FROM ({zh_all})""",
    )
    o["build_index_zh"] = """SELECT term, xpath_path, language, count(*) articles, sum(tf_weight) weight, max(position) last_position FROM han_postings GROUP BY ALL
        UNION ALL SELECT 'CN', '/news/metadata/country', language, count(*), 1.5::DOUBLE * count(*), 0 FROM han_news GROUP BY language"""
    o["index_build_log"] = f"SELECT news_id, term_count, {q(L.BUILD_METHOD)} build_method FROM logs"
    o["postings_lookup"] = "SELECT term, news_id, tf_weight, xpath_path FROM postings WHERE term = 'tion'"
    o["index_coverage"] = """SELECT count(*) total_news, count(*) FILTER (WHERE news_id % 9 <> 0) indexed_news, count(*) FILTER (WHERE news_id % 9 = 0) missing_xml,
        round(count(*) FILTER (WHERE news_id % 9 <> 0) * 100.0::DOUBLE / count(*), 2) coverage_percent FROM recent"""
    o["index_language_stats"] = f"""SELECT language, count(*) term_count, count(DISTINCT term) unique_terms, count(DISTINCT news_id) covered_news,
        round(sum(tf_weight) / count(*), 6) avg_weight FROM postings WHERE created_at > {EDGE} GROUP BY language"""
    o["top_terms"] = f"""SELECT term, language, count(*) doc_freq, sum(tf_weight) total_weight FROM postings WHERE created_at > {NOW} - INTERVAL 6 HOUR
        GROUP BY term, language ORDER BY doc_freq DESC, term, language LIMIT 20"""

    # search and serving
    o["latest_news"] = page(0, latest(), 11, 20)
    o["search_country"] = union(page(0, by_country("AB"), 1, 20), page(1, by_country("BB"), 3, 10))
    o["search_title_phrase"] = page(0, titled(["dé l"], 2.0), 1, 20)
    o["search_title_keywords"] = union(page(0, titled(["thand", "wh"], 1.5), 1, 20), page(1, titled(["ment", "eux", "la"], 1.5), 1, 20))
    o["search_ranked"] = page(0, ranked(["tion", "ther", "thon", "thre", "elle", "thhe"], 3), 1, 20)
    o["search_ranked_stemmed"] = page(0, ranked(["tion", "ther", "eau"], 1.5), 1, 20)
    o["search_fielded"] = page(0, ranked(["tion", "ther", "erin"], 1.5, "/news/content"), 1, 20)
    o["search"] = "SELECT * FROM found"
    o["page_and_total"] = "SELECT query_id, page_count, total, first_position FROM answered"
    part("han_recent", f"SELECT * FROM han_news WHERE created_at > {EDGE}")
    han_rank = lambda terms, least, path=None: ranked(terms, least, path, "han_postings", "han_recent", "zh")
    o["search_zh"] = union(
        page(0, han_rank(["日闻", "闻展", "展新", "新发", "发展"], 2.5), 1, 20, "han_news"),
        page(1, han_rank(["展中", "中文"], 1, "/news/content"), 1, 20, "han_news"),
        page(2, titled(["闻展"], 2.0, "han_recent"), 1, 10, "han_news"),
    )
    o["country_stats"] = "SELECT country_code, news_count FROM country_counts"
    o["rolling_country_counts"] = o["country_stats"]
    o["region_ranking"] = """SELECT country_code, news_count, country_name FROM (SELECT * FROM country_counts ORDER BY news_count DESC, country_code LIMIT 10)
        JOIN located USING (country_code)"""
    o["country_heatmap"] = f"""SELECT country_code, news_count, {heat('news_count')} color, round(0.15::DOUBLE + news_count / 100.0::DOUBLE, 4) size, {xyz(5.05)}
        FROM country_counts JOIN located USING (country_code)"""
    o["topic_phrases"] = "SELECT language, phrase, doc_freq, length, score FROM tp_scored"
    o["topic_phrases_zh"] = "SELECT language, phrase, doc_freq, length, score FROM tz_scored"
    o["hot_topics"] = "SELECT position, name, count FROM tp_mix WHERE position <= 10"
    o["hot_topics_zh"] = "SELECT position, name, count FROM tb_mix WHERE position <= 10"
    stop_word = f"(regexp_full_match(w, '[0-9]+') OR length(w) = 1 OR w IN {words(L.ZH_CHUNK_STOPWORDS)} OR {_meaningless('w')})"
    join = lambda a, b: f"{a} || CASE WHEN regexp_matches({a}, '[a-zA-Z]$') AND regexp_matches({b}, '^[a-zA-Z]') THEN ' ' ELSE '' END || {b}"
    o["topic_phrases_segmented"] = f"""WITH cut AS (SELECT news_id, title, created_at, w, i, sum(CASE WHEN {stop_word} THEN 1 ELSE 0 END) OVER (PARTITION BY news_id ORDER BY i) chunk, {stop_word} stopped
          FROM (SELECT news_id, title, created_at, trim(unnest(ws)) w, generate_subscripts(ws, 1) i FROM (SELECT *, string_split(title, ' ') ws FROM tz_titles)) WHERE w <> ''),
        kept AS (SELECT *, lead(w, 1) OVER x w2, lead(w, 2) OVER x w3, bool_and(regexp_full_match(w, '[a-zA-Z]+')) OVER (PARTITION BY news_id, chunk) latin FROM cut WHERE NOT stopped
          WINDOW x AS (PARTITION BY news_id, chunk ORDER BY i)),
        grams AS (SELECT news_id, title, created_at, {join('w', 'w2')} p, 2 n FROM kept WHERE NOT latin
          UNION ALL SELECT news_id, title, created_at, {join('(' + join('w', 'w2') + ')', 'w3')}, 3 FROM kept WHERE NOT latin),
        used AS (SELECT news_id, created_at, p, max(n) n FROM grams WHERE p IS NOT NULL AND length(p) >= 4
          AND contains(regexp_replace(title, '\\s+', '', 'g'), regexp_replace(p, '\\s+', '', 'g')) GROUP BY ALL)
        SELECT 'zh' AS language, p phrase, count(*) doc_freq, arg_max(n, (created_at, news_id))::BIGINT length FROM used GROUP BY p"""
    o["categories_list"] = """SELECT category_id::BIGINT category_id, category_name, category_code, color_code, count(n.news_id) articles FROM categories c LEFT JOIN news_categories n USING (category_id)
        GROUP BY ALL"""
    o["news_by_category"] = f"""SELECT news_id id, title, CASE WHEN length(summary) > 200 THEN substr(summary, 1, 200) || '...' ELSE summary END summary, {fmt('created_at')} AS time,
        coalesce(primary_country, '') country FROM (SELECT * FROM recent WHERE news_id IN (SELECT news_id FROM news_categories JOIN categories USING (category_id) WHERE category_code = 'military')
        ORDER BY created_at DESC, news_id DESC LIMIT 20) JOIN primary_of USING (news_id)"""
    o["news_detail"] = f"""SELECT n.news_id id, n.title, n.summary, CASE WHEN n.content <> '' THEN n.content ELSE n.summary END AS content, {fmt('published_at')} published_at, source_url,
        coalesce(source_name, '未知来源') source_name, primary_country country_code, country_name,
        coalesce((SELECT string_agg(media_url || '#' || is_cover, ' ' ORDER BY is_cover DESC, place) FROM media m WHERE m.news_id = n.news_id AND media_type = 'image'), '') images,
        coalesce((SELECT string_agg(kind || '=' || {EMBED.format(u='media_url')}, ' ' ORDER BY place) FROM (SELECT *, {VIDEO_TYPE.format(u='media_url')} kind FROM media) m
          WHERE m.news_id = n.news_id AND media_type = 'video'), '') videos,
        (SELECT media_url FROM media m WHERE m.news_id = n.news_id AND is_cover) AS cover
        FROM news n LEFT JOIN sources USING (source_id) LEFT JOIN primary_of p ON p.news_id = n.news_id LEFT JOIN countries ON primary_country = country_code"""
    o["v_news_detail"] = f"""SELECT n.news_id, title, summary, source_url, {fmt('created_at')} created_at, {fmt('published_at')} published_at, language, has_video, source_name, reliability_score,
        related_countries, primary_country_code, category_names FROM recent n LEFT JOIN sources USING (source_id)
        LEFT JOIN (SELECT news_id, string_agg(country_name, ', ' ORDER BY is_primary DESC, country_code) related_countries, min(country_code) FILTER (WHERE is_primary) primary_country_code
          FROM news_countries JOIN countries USING (country_code) GROUP BY news_id) c ON c.news_id = n.news_id
        LEFT JOIN (SELECT news_id, string_agg(category_name, '/' ORDER BY category_id) category_names FROM news_categories JOIN categories USING (category_id) GROUP BY news_id) k ON k.news_id = n.news_id"""
    o["category_counts"] = "SELECT category_name, count(*) news_count FROM news_categories JOIN categories USING (category_id) GROUP BY category_name"
    o["retention_report"] = f"""SELECT count(*) FILTER (WHERE created_at < {EDGE}) old_news_count, count(*) FILTER (WHERE created_at >= {EDGE}) recent_news_count,
        {fmt(f'min(created_at) FILTER (WHERE created_at >= {EDGE})')} earliest_news, {fmt(f'max(created_at) FILTER (WHERE created_at >= {EDGE})')} latest_news FROM news"""
    o["recent_6h"] = f"SELECT news_id, title, {fmt('created_at')} created_at FROM news WHERE created_at >= {NOW} - INTERVAL 6 HOUR"
    o["country_news"] = f"SELECT news_id, title, content, source_url, {fmt('created_at')} created_at FROM news JOIN primary_of USING (news_id) WHERE created_at >= {EDGE} AND primary_country = 'CB'"
    o["latest_with_country"] = """SELECT title, country_code, is_primary, country_name FROM (SELECT news_id, title, created_at FROM news) JOIN news_countries USING (news_id) JOIN countries USING (country_code)
        ORDER BY created_at DESC, news_id DESC, country_code LIMIT 10"""
    tables = {"documents": 5, "pages": 3, "events": 6, "nation": 3, "region": 2, "supplier": 4, "labels": 3, "conversations": 4}
    o["table_report"] = " UNION ALL ".join(f"SELECT '{t}' table_name, {n}::BIGINT table_columns, count(*) table_rows FROM {t}" for t, n in tables.items())

    # streams
    fine = "SELECT * FROM raw WHERE length(trim(content)) >= 60 AND NOT published_at < created_at - INTERVAL 48 HOUR AND trim(title) <> '' AND news_id IN (SELECT news_id FROM stems)"
    part("stored", fine)
    o["stream_ingest"] = """SELECT 'news' table_name, count(*) table_rows FROM stored UNION ALL SELECT 'news_countries', count(*) FROM stored JOIN primary_of USING (news_id) WHERE primary_country IS NOT NULL
        UNION ALL SELECT 'news_categories', count(*) FROM stored s JOIN (SELECT news_id, code FROM matched UNION ALL SELECT news_id, coalesce(hint_category, 'else') FROM raw
          WHERE news_id NOT IN (SELECT news_id FROM matched)) m USING (news_id) JOIN categories ON code = category_code
        UNION ALL SELECT 'media', count(*) FROM stored UNION ALL SELECT 'inverted_index', count(*) FROM stored JOIN postings USING (news_id)
        UNION ALL SELECT 'api_request_logs', count(*) FROM stored UNION ALL SELECT 'index_build_logs', count(*) FROM stored
        UNION ALL SELECT 'rejected', count(*) FROM raw WHERE news_id NOT IN (SELECT news_id FROM stored) AND trim(title) <> '' AND news_id IN (SELECT news_id FROM stems)"""
    tried = "SELECT * FROM raw WHERE trim(title) <> '' AND news_id IN (SELECT news_id FROM stems)"
    part("tried", tried)
    o["stream_job"] = f"""SELECT CAST(14 AS BIGINT) source_id, count(*) fetched, (SELECT count(*) FROM stored) saved, (SELECT count(*) FROM stored) total_news,
        (SELECT count(*) FROM stored WHERE created_at >= (SELECT max(created_at) FROM tried) - INTERVAL 48 HOUR) kept_news FROM tried"""
    o["stream_dedupe"] = "SELECT lower(source_url) url_key, news_id FROM raw"
    o["late_reject"] = """SELECT news_id, CASE WHEN published_at < created_at - INTERVAL 48 HOUR THEN 'Rejected: Exceeds 48h limit' ELSE 'ok' END status FROM raw"""
    o["stream_source_stats"] = STATS
    o["stream_retention"] = f"SELECT news_id, {fmt('created_at')} created_at FROM news WHERE created_at >= {EDGE}"
    return {name: build(sql) for name, sql in o.items()}
