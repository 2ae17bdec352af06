"""Queries of the core operators over the tables of a directory, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import color, names, text
from pagemill.operators import lz, pages, technology
from pagemill.operators.packed_values import split_packed
from pagemill.operators.records import flatten_records
from pagemill.sources.tables import per_delivery, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: JSON objects of a block by the database's own tree, which reads loosely: blocks with trailing commas, comments or NaN are taken out.
_OBJECTS = r"""WITH b AS (SELECT DISTINCT page_id, CAST(i AS INT) AS block, json_ld[i + 1] AS j FROM sentences, UNNEST(range(len(json_ld))) AS t(i)),
 v AS (SELECT * FROM b WHERE json_valid(j) AND NOT regexp_matches(regexp_replace(j, '"(?:[^"\\]|\\.)*"', '""', 'g'), ',\s*[\]}]|[Nn]a[Nn]|[Ii]nf|/\*|//')),
 o AS (SELECT DISTINCT page_id, block, regexp_replace(n.fullkey, '\."([^"]*)"', '.\1', 'g') AS path FROM v, json_tree(v.j) AS n WHERE n.type = 'OBJECT')
 SELECT o.page_id, o.block, o.path, coalesce(max_by(q.path, length(q.path)), '') AS parent_path
 FROM o LEFT JOIN o AS q ON o.page_id = q.page_id AND o.block = q.block AND (starts_with(o.path, q.path || '.') OR starts_with(o.path, q.path || '['))
 GROUP BY ALL"""


def _records(spark, d):
    return flatten_records(spread(table(spark, d, "sentences", "page_id", "json_ld")), "page_id", "json_ld")


@query(_OBJECTS)
def p3_found(spark, d):
    return _records(spark, d).where("object").select("page_id", "block", "path", "parent_path").distinct()


_ROWS = _OBJECTS[: _OBJECTS.index(" o AS (")] + r""" n AS (SELECT v.page_id, v.block, t.* FROM v, json_tree(v.j) AS t),
 m AS (SELECT *, type IN ('OBJECT', 'ARRAY') AS box FROM n),
 holds AS (SELECT DISTINCT a.page_id, a.block, a.id FROM m AS a JOIN m AS b ON a.page_id = b.page_id AND a.block = b.block AND b.type = 'OBJECT' AND (a.id = b.id OR starts_with(b.fullkey, a.fullkey || '.') OR starts_with(b.fullkey, a.fullkey || '['))),
 k AS (SELECT m.*, u.type AS above FROM m LEFT JOIN m AS u ON m.page_id = u.page_id AND m.block = u.block AND m.parent = u.id),
 r AS (SELECT *, CAST(row_number() OVER (PARTITION BY page_id, block ORDER BY id) - 1 AS INT) AS node FROM k WHERE type = 'OBJECT' OR (NOT box AND coalesce(above, '') != 'OBJECT')),
 up AS (SELECT r.page_id, r.block, r.id, max(o.id) AS pid FROM r JOIN r AS o ON r.page_id = o.page_id AND r.block = o.block AND o.type = 'OBJECT' AND (starts_with(r.fullkey, o.fullkey || '.') OR starts_with(r.fullkey, o.fullkey || '[')) GROUP BY ALL),
 flat AS (SELECT k.page_id, k.block, k.parent AS id, '{' || string_agg(to_json(k.key) || ':' || k.value, ',' ORDER BY k.id) || '}' AS payload FROM k ANTI JOIN holds ON k.page_id = holds.page_id AND k.block = holds.block AND k.id = holds.id WHERE k.above = 'OBJECT' GROUP BY ALL),
 named AS (SELECT page_id, block, parent AS id, max(CASE WHEN type = 'ARRAY' THEN value->>0 WHEN type = 'VARCHAR' THEN value->>'$' END) AS kind FROM k WHERE key = '@type' AND above = 'OBJECT' GROUP BY ALL),
 full_ AS (SELECT r.*, up.pid, o.fullkey AS pkey, o.node AS pnode, coalesce(nullif(d.kind, ''), CASE WHEN up.pid IS NULL THEN 'root' ELSE regexp_extract(r.fullkey, '\."?([^."\[]*)"?(?:\[[0-9]+\])*$', 1) END) AS own, coalesce(nullif(pd.kind, ''), CASE WHEN o.id IS NULL OR NOT contains(o.fullkey, '.') THEN 'root' ELSE regexp_extract(o.fullkey, '\."?([^."\[]*)"?(?:\[[0-9]+\])*$', 1) END) AS ptag
  FROM r LEFT JOIN up ON r.page_id = up.page_id AND r.block = up.block AND r.id = up.id LEFT JOIN r AS o ON o.page_id = up.page_id AND o.block = up.block AND o.id = up.pid
  LEFT JOIN named AS d ON d.page_id = r.page_id AND d.block = r.block AND d.id = r.id LEFT JOIN named AS pd ON pd.page_id = r.page_id AND pd.block = r.block AND pd.id = up.pid)
 SELECT DISTINCT f.page_id, f.block, f.node, coalesce(f.pnode, -1) AS parent, CASE WHEN type = 'OBJECT' THEN own WHEN pid IS NULL THEN 'root' ELSE ptag || '.' || own END AS tag,
 regexp_replace(f.fullkey, '\."([^"]*)"', '.\1', 'g') AS path, coalesce(regexp_replace(f.pkey, '\."([^"]*)"', '.\1', 'g'), '') AS parent_path, coalesce(TRY_CAST(regexp_extract(f.fullkey, '\[([0-9]+)\]$', 1) AS INT), -1) AS place, type = 'OBJECT' AS object, CASE WHEN type = 'OBJECT' THEN coalesce(flat.payload, '{}') ELSE '{"value":' || f.value || '}' END AS payload
 FROM full_ AS f LEFT JOIN flat ON flat.page_id = f.page_id AND flat.block = f.block AND flat.id = f.id"""


@query(_ROWS)
def p3_tables(spark, d):
    """Every object and array member with its table tag, keys (-1 for none) and members without objects."""
    return _records(spark, d).na.fill(-1, ["parent", "place"])


#: Every unquoted delimiter taken to split, which the lattice must find out by itself on these tables.
_D = r"[,;|·•‣\t\n\r\v\f\x{85}\x{2028}\x{2029}，、；،؛]"
_AFTER = rf"\s*(?:{_D}|$|\s/\s)"
_QUOTES = r"""(?:"(?:[^"]|"")*"|'(?:[^']|''|'[^'\s,;|·•‣，、；،؛])*'|“[^”]*”|«[^»]*»|„[^“”]*[“”]|‘[^’]*’)"""
_TOKENS = rf"\s*{_QUOTES}{_AFTER}|(?:[^,;|·•‣\t\n\r\v\f\x{{85}}\x{{2028}}\x{{2029}}，、；،؛/ ]|\S/\S| +[^,;|·•‣\t\n\r\v\f\x{{85}}\x{{2028}}\x{{2029}}，、；،؛/ ]|/)+|{_D}|\s+/\s+|\s+".replace("'", "''")


def _packed_sql() -> str:
    open_ = rf"^\s*{_QUOTES}{_AFTER}$".replace("'", "''")
    bare = rf"^(?:{_D}|\s+/\s+|\s+)*$"
    inner = rf"regexp_replace(regexp_replace(t, '(?:{_D}|\s+/\s*)+$', ''), '^\s+|\s+$', '', 'g')"
    core = f"CASE WHEN regexp_matches(t, '{open_}') THEN trim(replace(substr({inner}, 2, length({inner}) - 2), repeat(left({inner}, 1), 2), left({inner}, 1))) ELSE regexp_replace(t, '^\\s+|\\s+$', '', 'g') END"
    field = "regexp_replace(keywords, '^[\\s,;|]*\\[([^\\[]*)\\][\\s,;|]*$', '\\1')"
    return f"""WITH f AS (SELECT DISTINCT page_id, {field} AS k FROM sentences WHERE keywords IS NOT NULL), t AS (SELECT page_id, k, regexp_extract_all(k, '{_TOKENS}') AS a FROM f),
 u AS (SELECT page_id, k, i, a[i] AS t FROM t, UNNEST(range(1, len(a) + 1)) AS x(i)), v AS (SELECT page_id, k, i, {core} AS keyword FROM u WHERE NOT regexp_matches(t, '{bare}'))
 SELECT DISTINCT page_id, CAST(row_number() OVER (PARTITION BY page_id, k ORDER BY i) - 1 AS INT) AS pos, keyword FROM v WHERE keyword != ''"""


@query(_packed_sql())
def p7_found(spark, d):
    return split_packed(spread(table(spark, d, "sentences", "page_id", "keywords")), "page_id", "keywords").withColumnRenamed("value", "keyword")


# --- text -----------------------------------------------------------------------------------------------------------------

WS = r"[\t\n\x0B\x0C\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRIM = f"'^{WS}+|{WS}+$'"
_A = r"[A-Za-z0-9!#$%&''*+\-/=?^_`{|}~\x{80}-\x{10FFFF}]"
_B = r"[A-Za-z0-9\x{80}-\x{10FFFF}](?:[A-Za-z0-9\x{80}-\x{10FFFF}-]*[A-Za-z0-9\x{80}-\x{10FFFF}])?"
DOCS = "(SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _documents(spark, d, result):
    """(doc_id, result) of every different delivery of a document."""
    return per_delivery(table(spark, d, "documents", "doc_id", "text").where("text is not null"), "doc_id", "text", result)


@query(f"SELECT doc_id, CAST(i AS INT) AS pos, regexp_replace(e[i + 1], '^''+|''+$', '', 'g') AS email FROM (SELECT doc_id, regexp_extract_all(text, '{_A}+(?:\\.{_A}+)*@{_B}(?:\\.{_B})+') AS e FROM {DOCS}), UNNEST(range(len(e))) AS t(i)")
def emails(spark, d):
    return _documents(spark, d, text.emails(F.col("text"))).select("doc_id", F.posexplode("result").alias("pos", "email"))


@query(f"SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE 1 + len(regexp_extract_all(text, '[ \\t\\n\\f\\r][!-~]')) END AS INT) AS n_words FROM {DOCS}")
def word_count(spark, d):
    return _documents(spark, d, text.count_words(F.col("text"))).withColumnRenamed("result", "n_words")


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ | $', '', 'g'), '[.,]$', '') AS sentence FROM {DOCS}")
def normalize_sentence(spark, d):
    return _documents(spark, d, text.normalize(F.col("text"))).withColumnRenamed("result", "sentence")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, part FROM (SELECT doc_id, i, regexp_replace(p[i], {TRIM}, '', 'g') AS part FROM (SELECT doc_id, regexp_split_to_array(text, '\\||\\p{{Zs}}-|-\\p{{Zs}}') AS p FROM {DOCS}), UNNEST(range(1, len(p) + 1)) AS t(i)) WHERE part != ''")
def split_sentence(spark, d):
    return _documents(spark, d, text.split_sentence(F.col("text"))).select("doc_id", F.posexplode("result").alias("pos", "part"))


@query(f"SELECT doc_id, CAST(i AS INT) AS pos, l[i + 1] AS line FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(13), chr(10)), '\\n|[^\\n]+') AS l FROM {DOCS}), UNNEST(range(len(l))) AS t(i)")
def separate_lines(spark, d):
    return _documents(spark, d, text.separate_lines(F.array("text"))).select("doc_id", F.posexplode("result").alias("pos", "line"))


_DOT_WORD = r"(?i:[0-9]+(?:e[0-9]+)?|inf|infinity|nan|net|travis|git|gitignore|com|gov|org|[a-z][a-z])"


@query(f"SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '([\\p{{Pi}}\\p{{Ps}}¡¿]) ', '\\1', 'g'), ' ([\\p{{Pf}}\\p{{Pe}},;:!?…])', '\\1', 'g'), ' (\\.{_DOT_WORD}(?:[^\\p{{L}}\\p{{N}}]|$))', chr(1) || '\\1', 'g'), ' \\.', '.', 'g'), chr(1), ' ') AS joined FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS s FROM {DOCS})")
def join_sentences(spark, d):
    codes = text.country_codes(spark)
    return _documents(spark, d, text.join_sentences(F.split("text", "\n"), codes)).withColumnRenamed("result", "joined")


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) - 1 AS INT) AS pos, s AS paragraph FROM (SELECT doc_id, i, p[i] AS s, CASE WHEN p[i] = '' THEN 0 ELSE 1 + len(regexp_extract_all(p[i], '[ \\t\\n\\f\\r][!-~]')) END AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {DOCS}), UNNEST(range(1, len(p) + 1)) AS t(i)) WHERE n > 2")
def order_paragraphs(spark, d):
    return _documents(spark, d, text.order_paragraphs(F.split("text", "\n"))).select("doc_id", F.posexplode("result").alias("pos", "paragraph"))


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INT) AS pos, s AS kept FROM (SELECT doc_id, i, regexp_replace(regexp_replace(regexp_replace(p[i], '(?:http|www)', '', 'gi'), '{WS}+', ' ', 'g'), '^ | $', '', 'g') AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM {DOCS}), UNNEST(range(1, len(p) + 1)) AS t(i)) WHERE s != '' AND NOT contains(lower(s), 'cookie') AND NOT contains(s, '©')")
def stop_words(spark, d):
    return _documents(spark, d, text.without_stops(F.split("text", "\n"), "http|www")).select("doc_id", F.posexplode("result").alias("pos", "kept"))


@query("SELECT doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)")
def lz_roundtrip(spark, d):
    # the packed text is shuffled, not the text
    return per_delivery(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", lz.lz_compress(F.col("text"))).select("doc_id", lz.lz_decompress(F.col("result")).alias("text"))


@query()
def lz_compressed(spark, d):
    return _documents(spark, d, lz.lz_compress(F.col("text"))).withColumnRenamed("result", "packed")


@query("SELECT * FROM (VALUES ('', 'Q'), ('a', 'IZA'), ('aaaa', 'IY5A')) AS v(word, packed)")
def lz_known(spark, d):
    """Codes of short strings that are known by heart."""
    words = spark.createDataFrame([("",), ("a",), ("aaaa",)], "word string")
    return words.select("word", lz.lz_compress(F.col("word")).alias("packed"))


# --- pages ----------------------------------------------------------------------------------------------------------------

PAGES = "(SELECT DISTINCT page_id, html FROM pages WHERE html IS NOT NULL)"
_UNESCAPE = "replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"


def _plain(expression: str, trim: bool = False) -> str:
    """SQL for an expression with its character references resolved."""
    done = _UNESCAPE.format(expression)
    return f"regexp_replace({done}, {TRIM}, '', 'g')" if trim else done


def _group(of: str, pattern: str) -> str:
    return f"regexp_extract({of}, '{pattern}', 1)"


def _pages(spark, d, result):
    """(page_id, result) of every different delivery of a page."""
    return per_delivery(table(spark, d, "pages", "page_id", "html").where("html is not null"), "page_id", "html", result)


@query(f"SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM {PAGES}")
def page_lang(spark, d):
    return _pages(spark, d, pages.extract(F.col("html"), "lang")).withColumnRenamed("result", "lang")


@query(f"SELECT page_id, CAST(i AS INT) AS pos, {_UNESCAPE.format('a[i + 1]')} AS href FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS a FROM {PAGES}), UNNEST(range(len(a))) AS t(i)")
def hrefs(spark, d):
    return _pages(spark, d, pages.extract(F.col("html"), "href_attributes")).select("page_id", F.posexplode("result").alias("pos", "href"))


_ANCHORS = f"(SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS a FROM {PAGES})"


@query(f"SELECT page_id, CAST(i AS INT) AS pos, {_plain(_group('a[i + 1]', '^<a href=\"([^\"]*)\"'))} AS href, {_plain(_group('a[i + 1]', '>([^<]*)</a>$'), True)} AS text FROM {_ANCHORS}, UNNEST(range(len(a))) AS t(i)")
def links(spark, d):
    flat = _pages(spark, d, pages.extract(F.col("html"), "links")).select("page_id", F.posexplode("result").alias("pos", "l"))
    return flat.select("page_id", "pos", "l.href", "l.text")


@query(f"SELECT page_id, 'title' AS name, {_plain(_group('html', '<title>([^<]*)</title>'), True)} AS title FROM {PAGES}")
def titles(spark, d):
    return _pages(spark, d, F.map_entries(pages.extract(F.col("html"), "meta_titles"))).select("page_id", F.inline("result").alias("name", "title"))


@query(f"SELECT DISTINCT page_id, {_UNESCAPE.format('m')} AS description FROM (SELECT page_id, UNNEST(regexp_extract_all(html, '<meta (?:name|property)=\"(?:og:)?description\" content=\"([^\"]+)\"', 1)) AS m FROM {PAGES})")
def descriptions(spark, d):
    return _pages(spark, d, pages.extract(F.col("html"), "descriptions")).select("page_id", F.explode("result").alias("description"))


@query(f"SELECT page_id, {_plain(_group('html', '<meta name=\"keywords\" content=\"([^\"]+)\"'))} AS keywords FROM {PAGES}")
def page_keywords(spark, d):
    return _pages(spark, d, pages.extract(F.col("html"), "keywords")).withColumnRenamed("result", "keywords")


_MARKUP_LIKE = "contains(t, '<') AND contains(t, '>') AND (contains(t, '</') OR contains(t, '/>'))"


@query(f"SELECT page_id, CAST(i AS INT) AS pos, CASE WHEN {_MARKUP_LIKE} THEN '' ELSE t END AS block FROM (SELECT page_id, i, regexp_replace(a[i + 1], {TRIM}, '', 'g') AS t FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script type=\"application/ld.json\">(.*?)</script>', 1) AS a FROM {PAGES}), UNNEST(range(len(a))) AS t(i))")
def page_json_ld(spark, d):
    return _pages(spark, d, pages.extract(F.col("html"), "json_ld")).select("page_id", F.posexplode("result").alias("pos", "block"))


@query(f"SELECT page_id, CAST(h AS INT) AS level, CAST(i AS INT) AS pos, regexp_replace(regexp_replace(regexp_replace({_UNESCAPE.format('a[i + 1]')}, '{WS}+', ' ', 'g'), '^ | $', '', 'g'), '[.,]$', '') AS heading FROM (SELECT page_id, h, regexp_extract_all(html, '<h' || h || '>([^<]*)</h' || h || '>', 1) AS a FROM {PAGES}, range(1, 7) AS r(h)), UNNEST(range(len(a))) AS t(i)")
def headings(spark, d):
    s = _pages(spark, d, F.map_entries(pages.sentences(F.col("html"), text.country_codes(spark), add_text_nodes=False)["h"]))
    flat = s.select("page_id", F.inline("result").alias("level", "texts")).select("page_id", F.substring("level", 2, 1).cast("int").alias("level"), F.posexplode("texts").alias("pos", "heading"))
    return flat


def _tidy(expression: str) -> str:
    """SQL for a text collapsed, without one closing stop or comma."""
    return f"regexp_replace(regexp_replace(regexp_replace({expression}, '{WS}+', ' ', 'g'), '^ | $', '', 'g'), '[.,]$', '')"


@query(f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n DESC, i) - 1 AS INT) AS pos, s AS paragraph FROM (SELECT page_id, i, s, 1 + len(regexp_extract_all(s, '[ \t\n\f\r][!-~]')) AS n FROM (SELECT page_id, i, {_tidy(_plain('a[i + 1]'))} AS s FROM (SELECT page_id, regexp_extract_all(html, '<p>([^<]*)</p>', 1) AS a FROM {PAGES}), UNNEST(range(len(a))) AS t(i))) WHERE n > 2 AND NOT contains(lower(s), 'cookie') AND NOT contains(s, '©')")
def sentences(spark, d):
    return _pages(spark, d, pages.sentences(F.col("html"), text.country_codes(spark))["p"]).select("page_id", F.posexplode("result").alias("pos", "paragraph"))


@query()
def text_groups(spark, d):
    s = _pages(spark, d, pages.sentences(F.col("html"), text.country_codes(spark))["text_nodes"])
    return s.select("page_id", F.posexplode("result").alias("grp", "g")).select("page_id", "grp", F.posexplode("g").alias("pos", "text"))


_BODY = "regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>|<header>.*?</header>|<footer>.*?</footer>|<nav>.*?</nav>', '', 'g'), '(?s)<h[1-6]>.*?</h[1-6]>|<p>.*?</p>', '', 'g'), '(?s)<div class=\"header\">.*?<div id=\"content\">|<div class=\"footer\">.*$', '', 'g')"


@query(f"SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos, s AS text FROM (SELECT page_id, i, {_plain('a[i]', True)} AS s FROM (SELECT page_id, regexp_extract_all({_BODY}, '>([^<]+)', 1) AS a FROM {PAGES}), UNNEST(range(1, len(a) + 1)) AS t(i)) WHERE s != ''")
def other_texts(spark, d):
    others = pages.sentences(F.col("html"), text.country_codes(spark), remove_header=True, remove_footer=True)["other"]
    return _pages(spark, d, others).select("page_id", F.posexplode("result").alias("pos", "text"))


@query(f"SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS value FROM {PAGES}")
def tag_attribute(spark, d):
    return _pages(spark, d, pages.tag_attribute(F.col("html"), "head > meta", "charset")).withColumnRenamed("result", "value")


@query(f"SELECT page_id, regexp_extract(html, '<h1>[^<]*</h1>') AS value FROM {PAGES}")
def tag_html(spark, d):
    return _pages(spark, d, pages.tag_html(F.col("html"), "body h1")).withColumnRenamed("result", "value")


_CLEAN = "regexp_replace(regexp_replace(replace(html, '&#x27;', chr(39)), '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', '', 'g'), '^<!DOCTYPE html>\\s*<html([^>]*)>\\s*<head>', '<!DOCTYPE html><html\\1><head>')"


@query(f"SELECT page_id, array_to_string(list_transform(regexp_extract_all({_CLEAN}, '<[^>]*>|[^<]+'), lambda x: CASE WHEN starts_with(x, '<') THEN x ELSE replace(x, '&quot;', chr(34)) END), '') AS html FROM {PAGES}")
def html_contents(spark, d):
    return _pages(spark, d, pages.extract(F.col("html"), "html_contents")).withColumnRenamed("result", "html")


@query("SELECT * FROM (VALUES (-1::BIGINT, 'da', 0::INT, '/da'), (-1::BIGINT, 'da', 1::INT, '/d2'), (-1::BIGINT, 'en', 0::INT, '/en')) AS v(page_id, hreflang, pos, href) UNION ALL SELECT page_id, 'none', 0, html FROM pages WHERE contains(html, 'hreflang')")
def alternates(spark, d):
    """The pages' own alternates, none in plain data, and those of one given page."""
    own = "<link rel=alternate hreflang=da href=/da><link rel=alternate hreflang=en href=/en><link rel=alternate hreflang=da href=/d2>"
    both = table(spark, d, "pages", "page_id", "html").where("html is not null").union(spark.createDataFrame([(-1, own)], "page_id bigint, html string"))
    found = per_delivery(both, "page_id", "html", F.map_entries(pages.extract(F.col("html"), "alternate_links")))
    return found.select("page_id", F.inline("result").alias("hreflang", "hrefs")).select("page_id", "hreflang", F.posexplode("hrefs").alias("pos", "href"))


# --- technology -----------------------------------------------------------------------------------------------------------

#: Rules that hit the data: (technology, key, pattern).
_TEXT_RULES = [("Listed", "html", "<ul>"), ("Divided", "html", "class=\"b3\""), ("Rights", "html", "&amp; co\\."), ("Offers", "html", "href=\"/[a-m][a-z]*\""), ("Never", "html", "never-there")]
_IMPLIES = [("Listed", "Markup"), ("Markup", "Web"), ("Web", "Markup"), ("Rights", "Legal")]
RULES = {"apps": {t: {"html": p} | ({"implies": [b for a, b in _IMPLIES if a == t]} if any(a == t for a, _ in _IMPLIES) else {}) for t, _, p in _TEXT_RULES} | {a: {"implies": b} for a, b in _IMPLIES if a in ("Markup", "Web")}}
_RULES_SQL = "(VALUES " + ", ".join("('{}', '{}')".format(t, p.replace("'", "''")) for t, _, p in _TEXT_RULES) + ") AS r(tech, pat)"
_EDGES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _IMPLIES) + ") AS e(a, b)"
_HITS_SQL = f"SELECT DISTINCT page_id, tech FROM {PAGES}, {_RULES_SQL} WHERE regexp_matches(html, pat, 'i')"


def _rules():
    import json

    return technology.Rules(json.dumps(RULES))


@query(_HITS_SQL)
def tech_text(spark, d):
    return _pages(spark, d, technology.detect_text(spark, _rules(), "html", technology.html_parts(F.col("html")))).select("page_id", F.explode("result").alias("tech"))


@query(f"WITH RECURSIVE hit AS ({_HITS_SQL}), c(page_id, tech) AS (SELECT page_id, tech FROM hit UNION SELECT page_id, b FROM c JOIN {_EDGES_SQL} ON tech = a) SELECT page_id, tech FROM c")
def tech_full(spark, d):
    none, maps = F.array().cast("array<string>"), F.array().cast("array<map<string,string>>")
    found = technology.detect(spark, _rules(), technology.html_parts(F.col("html")), none, maps, maps, maps)
    return _pages(spark, d, found).select("page_id", F.explode("result").alias("tech"))


#: Rules of every kind for the pages: scripts, selectors, variables, headers, cookies, meta data.
_KINDS = {"apps": {
    "Boxed": {"dom": "div.b4"}, "Mapped": {"dom": {"div#content": {"exists": ""}}}, "Graph": {"script": "\"@graph\"\\s*:", "implies": "Listing"}, "Listing": {"script": ["ItemList", "never"]},
    "Rated": {"js": {"ratingValue": "\"?: ?"}, "implies": ["Shop"]}, "Shop": {}, "Nordic": {"meta": {"LANGUAGE": "^(?:da|sv|no)"}}, "Served": {"headers": {"server": "^https://www\\."}}, "Tracked": {"cookies": {"Sid": ""}}, "Bounded": {"html": "\\bdiv"}}}
_SCRIPTS = "regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1)"
_FOUND_SQL = f"""SELECT page_id, 'Boxed' AS tech FROM k WHERE regexp_matches(html, '(?i)<[^>]*?div.*?b4') UNION SELECT page_id, 'Mapped' FROM k WHERE regexp_matches(html, '(?i)<[^>]*?div.*?content') UNION SELECT page_id, unnest(['Graph', 'Listing']) FROM k WHERE len(list_filter({_SCRIPTS}, lambda x: regexp_matches(x, '(?i)"@graph"\\s*:'))) > 0
 UNION SELECT page_id, 'Listing' FROM k WHERE len(list_filter({_SCRIPTS}, lambda x: regexp_matches(x, '(?i)ItemList|never'))) > 0 UNION SELECT page_id, unnest(['Rated', 'Shop']) FROM k WHERE len(list_filter({_SCRIPTS}, lambda x: regexp_matches(x, 'ratingValue"?: ?'))) > 0
 UNION SELECT page_id, 'Nordic' FROM k WHERE regexp_matches(regexp_extract(html, '<html lang="([^"]*)"', 1), '(?i)^(?:da|sv|no)') UNION SELECT page_id, 'Served' FROM k WHERE regexp_matches(url, '(?i)^https://www\\.') UNION SELECT page_id, 'Tracked' FROM k WHERE url IS NOT NULL"""


@query(f"WITH k AS (SELECT DISTINCT page_id, url, html FROM pages WHERE html IS NOT NULL) {_FOUND_SQL}")
def tech_kinds(spark, d):
    """Rules of all kinds: scripts and variables over a page's scripts, selectors over its markup, header, cookie and meta rules over maps."""
    import json

    scripts = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    one = lambda name, value: F.array(F.create_map(F.lit(name), value))
    found = technology.detect(spark, technology.Rules(json.dumps(_KINDS)), F.array("html"), scripts, one("Server", F.col("url")), one("sid", F.col("url")), one("language", F.regexp_extract("html", r'<html lang="([^"]*)"', 1)))
    rows = table(spark, d, "pages", "page_id", "url", "html").where("html is not null").withColumn("both", F.concat_ws("\n", "url", "html"))
    return per_delivery(rows, "page_id", "both", found).select("page_id", F.explode("result").alias("tech")).distinct()


@query(f"WITH RECURSIVE c(name, tech) AS (SELECT DISTINCT r_name, r_name FROM (SELECT 'Listed' AS r_name UNION ALL SELECT 'Rights' UNION ALL SELECT 'Other') UNION SELECT name, b FROM c JOIN {_EDGES_SQL} ON tech = a) SELECT name, tech FROM c")
def implies_closure(spark, d):
    names_ = spark.createDataFrame([("Listed",), ("Rights",), ("Other",)], "name string")
    return names_.select("name", F.explode(technology.resolve(_rules(), F.array("name"))).alias("tech"))


@query("SELECT DISTINCT event_id, 'Clicks' AS tech FROM events WHERE event_type ILIKE '%c%' UNION SELECT event_id, 'Any' FROM events WHERE event_type IS NOT NULL")
def tech_dict(spark, d):
    rules = technology.Rules('{"Clicks": {"headers": {"Type": "c"}}, "Any": {"headers": {"TYPE": ".*"}}, "No": {"headers": {"other": ""}}}')
    rows = spread(table(spark, d, "events", "event_id", "event_type"))
    return rows.select("event_id", F.explode(F.array_distinct(technology.detect_dict(spark, rules, "headers", F.create_map(F.lit("type"), "event_type")))).alias("tech")).distinct()


@query("SELECT kind, patterns::INT AS patterns FROM (VALUES ('html', 5), ('script', 0), ('dom', 0), ('js', 0), ('cookies', 0), ('headers', 0), ('meta', 0), ('implies', 4)) AS v(kind, patterns)")
def tech_counts(spark, d):
    return spark.createDataFrame(sorted(_rules().counts().items()), "kind string, patterns int")


# --- colours and names ------------------------------------------------------------------------------------------------------

_RGB = "p_partkey % 256 AS r, p_partkey // 7 % 256 AS g, p_partkey // 3 % 256 AS b"


def _parts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part", "p_partkey").select("p_partkey", (k % 256).alias("r"), (F.floor(k / 7) % 256).alias("g"), (F.floor(k / 3) % 256).alias("b"))


@query(f"SELECT p_partkey, printf('#%02x%02x%02x', r, g, b) AS hex FROM (SELECT p_partkey, {_RGB} FROM part)")
def rgb_hex(spark, d):
    return _parts(spark, d).select("p_partkey", color.rgb_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))


@query(f"""SELECT p_partkey, floor(100 * (CASE WHEN hi = lo THEN 0 WHEN hi = r THEN ((g - b) / (hi - lo) + CASE WHEN g < b THEN 6 ELSE 0 END) * 60 WHEN hi = g THEN ((b - r) / (hi - lo) + 2) * 60 ELSE ((r - g) / (hi - lo) + 4) * 60 END) + 0.501) / 100 AS hue,
 floor(100 * (CASE WHEN hi = lo THEN 0 ELSE (hi - lo) / (1 - abs(hi + lo - 1)) * 100 END) + 0.501) / 100 AS saturation, floor((hi + lo) / 2 * 10000 + 0.501) / 100 AS lightness
 FROM (SELECT p_partkey, r, g, b, greatest(r, g, b) AS hi, least(r, g, b) AS lo FROM (SELECT p_partkey, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b FROM (SELECT p_partkey, (p_partkey % 256)::DOUBLE AS r, (p_partkey // 7 % 256)::DOUBLE AS g, (p_partkey // 3 % 256)::DOUBLE AS b FROM part)))""")
def rgb_hsl(spark, d):
    h = _parts(spark, d).select("p_partkey", color.rgb_hsl(F.col("r"), F.col("g"), F.col("b")).alias("h"))
    at = lambda i: F.floor(F.get("h", F.lit(i)).cast("double") * 100 + 0.501) / 100
    return h.select("p_partkey", at(0).alias("hue"), at(1).alias("saturation"), at(2).alias("lightness"))


@query("SELECT p_partkey, rank::INT AS rank, CASE WHEN (rank = 0) = (r < 128) THEN r ELSE 255 - r END::INT AS r, CASE WHEN (rank = 0) = (r < 128) THEN g ELSE 255 - g END::INT AS g, CASE WHEN (rank = 0) = (r < 128) THEN b ELSE 255 - b END::INT AS b FROM (SELECT p_partkey, " + _RGB + " FROM part), (VALUES (0), (1)) AS t(rank)")
def palettes(spark, d):
    """Palettes of small images made of a part's colours: half one colour, half its complement."""
    k = _parts(spark, d)
    one = lambda c: F.unhex(F.lpad(F.hex(F.col(c)), 2, "0"))
    other = lambda c: F.unhex(F.lpad(F.hex(255 - F.col(c)), 2, "0"))
    image = F.concat(F.lit("P6 2 1 255\n").cast("binary"), one("r"), one("g"), one("b"), other("r"), other("g"), other("b"))
    return k.select("p_partkey", F.posexplode(color.palette(image)).alias("rank", "c")).select("p_partkey", "rank", *[F.get("c", F.lit(i)).cast("int").alias(x) for i, x in enumerate("rgb")])


@query()
def human_name(spark, d):
    rows = per_delivery(table(spark, d, "parsed_names", "name_id", "raw_name"), "name_id", "raw_name", names.parse_name(F.col("raw_name")))
    return rows.select("name_id", "result.*")


_WORD_SQL = "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{2,}"


@query(f"SELECT DISTINCT name_id, split_part(raw_name, ' ', 1) AS given_name, split_part(raw_name, ' ', 2) AS surname FROM parsed_names WHERE regexp_full_match(raw_name, '{_WORD_SQL} {_WORD_SQL}') AND NOT list_contains(['" + "','".join(sorted({*names.PREFIXES, *names.SUFFIXES, *map(str.lower, names.DEGREES), *names.PARTICLES})) + "'], lower(split_part(raw_name, ' ', 1))) AND NOT list_contains(['" + "','".join(sorted({*names.SUFFIXES, *map(str.lower, names.DEGREES), "aps", "gmbh", "ltd", "inc", "llc", "ag", "co"})) + "'], lower(split_part(raw_name, ' ', 2)))")
def plain_names(spark, d):
    """The parts of names of two plain words."""
    whole = F.col("raw_name").rlike(f"^{_WORD_SQL} {_WORD_SQL}$")
    rows = per_delivery(table(spark, d, "parsed_names", "name_id", "raw_name").where(whole), "name_id", "raw_name", names.parse_name(F.col("raw_name")))
    return rows.where("result.given_name is not null").select("name_id", "result.given_name", "result.surname").distinct()
