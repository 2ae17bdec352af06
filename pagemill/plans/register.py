"""Every row operator as a SQL function of one session."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill.functions import color, names, text
from pagemill.operators import htmltree, lz, pages, technology


def _arrow(spark: SparkSession, name: str, f, kind: str, arguments: int = 1) -> None:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    arrow = to_arrow_type(DataType.fromDDL(kind))

    def run(*columns):
        return pa.array([None if any(x is None for x in row) else f(*row) for row in zip(*(c.to_pylist() for c in columns))], arrow)

    if arguments == 1:

        def one(a: pa.Array) -> pa.Array:
            return run(a)
    elif arguments == 2:

        def one(a: pa.Array, b: pa.Array) -> pa.Array:
            return run(a, b)
    else:

        def one(a: pa.Array, b: pa.Array, c: pa.Array) -> pa.Array:
            return run(a, b, c)

    one.__annotations__ = {k: pa.Array for k in one.__annotations__}
    spark.udf.register(name, F.arrow_udf(one, kind))


def _selected(html: str, selector: str, then):
    try:
        chain = htmltree.compile_selector(selector)
    except ValueError:
        chain = None
    return then(pages.Page(html), chain)


#: SQL forms of the native expressions, given as plain Spark SQL over the arguments.
NATIVE = {
    "page_emails": ("s STRING", "ARRAY<STRING>", "transform(regexp_extract_all(s, '({0})', 1), x -> regexp_replace(x, \"^'+|'+$\", ''))"),
    "text_normalize": ("s STRING", "STRING", r"regexp_replace(regexp_replace(regexp_replace(s, '\\p{{IsWhite_Space}}+', ' '), '^ | $', ''), '[.,]\\z', '')"),
    "text_word_count": ("s STRING", "INT", r"if(length(s) = 0, 0, 1 + regexp_count(s, '[ \\t\\n\\f\\r](?=[!-~])'))"),
    "text_split": ("s STRING", "ARRAY<STRING>", r"filter(transform(split(s, '\\||\\p{{Zs}}-|-\\p{{Zs}}'), x -> regexp_replace(x, '^\\p{{IsWhite_Space}}+|\\p{{IsWhite_Space}}+$', '')), x -> x != '')"),
    "rgb_hsl": (
        "r DOUBLE, g DOUBLE, b DOUBLE",
        "ARRAY<DOUBLE>",
        "(SELECT array(CASE WHEN hi = lo THEN 0D WHEN hi = x THEN pmod((y - z) / (hi - lo), 6D) * 60 WHEN hi = y THEN ((z - x) / (hi - lo) + 2) * 60 ELSE ((x - y) / (hi - lo) + 4) * 60 END, CASE WHEN hi = lo THEN 0D ELSE (hi - lo) / (1 - abs(hi + lo - 1)) * 100 END, (hi + lo) / 2 * 100) FROM (SELECT x, y, z, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM (SELECT r / 255 AS x, g / 255 AS y, b / 255 AS z)))",
    ),
    "rgb_hex": ("r DOUBLE, g DOUBLE, b DOUBLE", "STRING", "concat('#', lpad(lower(hex(cast(floor(least(greatest(r, 0), 255) + 0.5) AS BIGINT))), 2, '0'), lpad(lower(hex(cast(floor(least(greatest(g, 0), 255) + 0.5) AS BIGINT))), 2, '0'), lpad(lower(hex(cast(floor(least(greatest(b, 0), 255) + 0.5) AS BIGINT))), 2, '0'))"),
}


def register(spark: SparkSession) -> list[str]:
    """Register all functions; their names. Extractors are page_<name>(html)."""
    made = []
    for name, (f, kind) in pages.EXTRACTORS.items():
        _arrow(spark, f"page_{name}", lambda x, f=f: f(pages.Page(x)), kind)
        made.append(f"page_{name}")
    codes, ready = text.country_codes(spark), []

    def grouper() -> text.Grouper:
        if not ready:
            ready.append(text.Grouper(codes))
        return ready[0]

    _arrow(spark, "page_sentences", lambda x: pages.sentences_of(x, grouper(), None, False, False, True, None), pages.SENTENCES)
    _arrow(spark, "page_sentences_with", lambda x, options: _sentences(x, grouper(), options), pages.SENTENCES, 2)
    _arrow(spark, "text_group", lambda nodes: grouper().group(nodes) or [], "array<array<string>>")
    _arrow(spark, "text_join", lambda lines: grouper().join(lines), "string")
    _arrow(spark, "text_order", lambda texts: sorted((t for t in texts if text.word_count(t) > 2), key=lambda t: -text.word_count(t)), "array<string>")
    _arrow(spark, "text_split_words", lambda s, stops: text.split_py(s, set(stops)), "array<string>", 2)
    _arrow(spark, "text_without_stops", _without_stops, "array<string>", 2)
    _arrow(spark, "page_tag_attribute", lambda h, s, a: _selected(h, s, lambda p, c: pages.attribute_of(p, c, a.lower()) if c else ""), "string", 3)
    _arrow(spark, "page_tag_html", lambda h, s: _selected(h, s, pages.tag_of), "string", 2)
    _arrow(spark, "lz_compress", lz.compress, "string")
    _arrow(spark, "lz_decompress", lz.decompress, "string")
    _arrow(spark, "try_lz_decompress", _or_null(lz.decompress, lz.CodecError), "string")
    _arrow(spark, "parse_name", names.parse, names.SCHEMA)
    _arrow(spark, "image_palette", color.dominant, "array<array<float>>")
    _arrow(spark, "try_image_palette", _or_null(color.dominant, color.ImageLoadError), "array<array<float>>")
    made += [
        "page_sentences", "page_sentences_with", "text_group", "text_join", "text_order", "text_split_words", "text_without_stops", "page_tag_attribute", "page_tag_html", "lz_compress", "lz_decompress", "try_lz_decompress", "parse_name", "image_palette", "try_image_palette"]
    for name, (arguments, kind, body) in NATIVE.items():
        pattern = text.EMAIL.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body.format(pattern)}")
        made.append(name)
    return made


def _sentences(html: str, grouper: text.Grouper, options: str) -> dict:
    """The full result with options as a JSON object: stop_word, remove_header, remove_footer, add_text_nodes, min_split."""
    given = {"stop_word": "", "remove_header": False, "remove_footer": False, "add_text_nodes": True, "min_split": None} | json.loads(options)
    stop = re.compile(given["stop_word"], re.I) if given["stop_word"] else None
    return pages.sentences_of(html, grouper, stop, given["remove_header"], given["remove_footer"], given["add_text_nodes"], given["min_split"])


def _without_stops(texts: list[str], stop: str) -> list[str]:
    done = [text.squeeze(re.sub(stop, "", t, flags=re.I) if stop else t) for t in texts if t is not None]
    return [t for t in done if "cookie" not in t.lower() and "©" not in t and text.word_count(t) > 0]


def register_rules(spark: SparkSession, name: str, rules: technology.Rules) -> list[str]:
    """SQL functions of a rule base: <name>_text(key, parts), <name>_dict(key, entries) and <name>_resolve(names)."""
    ready: list[technology.Matcher] = []

    def matcher() -> technology.Matcher:
        if not ready:
            ready.append(technology.Matcher(rules))
        return ready[0]

    _arrow(spark, f"{name}_text", lambda key, parts: sorted(matcher().texts(key, parts)), "array<string>", 2)
    _arrow(spark, f"{name}_dict", lambda key, entries: sorted(matcher().fields(key, entries)), "array<string>", 2)
    _arrow(spark, f"{name}_resolve", rules.resolve, "array<string>")
    return [f"{name}_text", f"{name}_dict", f"{name}_resolve"]


def _or_null(f, error):
    def g(x):
        try:
            return f(x)
        except error:
            return None

    return g
