"""Queries of the training-text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.boilerplate import boilerplate, main_text
from pagemill.llm.garbled import garbled
from pagemill.llm.languages import language_units, page_labels
from pagemill.llm.leaks import leak_report, leaks
from pagemill.llm.mixture import mix, shares
from pagemill.llm.names import entities, pairs
from pagemill.llm.personal import personal_spans
from pagemill.llm.sentences import sentence_units
from pagemill.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _names(spark, d):
    return table(spark, d, "parsed_names", "given_name", "middle_name", "surname")


@query
def p1_found(spark, d):
    pages = spread(table(spark, d, "sentences", "page_id", "p", "text_nodes"))
    return personal_spans(pages, _names(spark, d)).drop("end_pos")


@query
def p1_redacted(spark, d):
    pages = spread(table(spark, d, "sentences", "page_id", "p", "text_nodes"))
    return personal_spans(pages, _names(spark, d), redacted=True)


@query
def p2_found(spark, d):
    return boilerplate(spread(table(spark, d, "sentences", "page_id", "host", "h", "p", "text_nodes")))


@query
def p2_main(spark, d):
    pages = spread(table(spark, d, "sentences", "page_id", "host", "h", "p", "text_nodes"))
    return main_text(pages, boilerplate(pages))


@query
def p4_found(spark, d):
    return sentence_units(spread(table(spark, d, "sentences", "page_id", "p", "text_nodes")))


@query
def p6_found(spark, d):
    units = language_units(spread(table(spark, d, "sentences", "page_id", "lang", "p", "descriptions")))
    return units.where("lang != 'und' and (declared is null or lang != declared)").select("page_id", "field", "pos", "lang").distinct()


@query
def p6_labels(spark, d):
    return page_labels(language_units(spread(table(spark, d, "sentences", "page_id", "lang", "p", "descriptions"))))


def _leaks(spark, d):
    return leaks(spread(table(spark, d, "documents", "doc_id", "text")), table(spark, d, "benchmark"))


@query
def p8_found(spark, d):
    return _leaks(spark, d).select("doc_id", "item_id")


@query
def p8_passages(spark, d):
    """Where the passages stand, in the item and in the document."""
    return _leaks(spark, d)


@query
def p8_report(spark, d):
    return leak_report(_leaks(spark, d))


@query
def p10_found(spark, d):
    return garbled(spread(table(spark, d, "documents", "doc_id", "text", "lang"))).select("doc_id").distinct()


@query
def p10_restored(spark, d):
    return garbled(spread(table(spark, d, "documents", "doc_id", "text", "lang")))


def _entities(spark, d):
    columns = ("name_id", "raw_name", "given_name", "middle_name", "middle_initials", "surname", "generational_suffix", "employer", "town")
    return entities(spread(table(spark, d, "parsed_names", *columns)))


@query
def p5_found(spark, d):
    return pairs(_entities(spark, d))


@query
def p5_entities(spark, d):
    return _entities(spark, d)


#: Where the tokenizer's vocabulary file is, unless the session's setting pagemill.tokenizer says otherwise.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def _mix(spark, d):
    return mix(spread(table(spark, d, "documents", "doc_id", "text", "source")), table(spark, d, "mix_targets"), tokenizer=spark.conf.get("pagemill.tokenizer", TOKENIZER))


@query
def p9_shares(spark, d):
    return shares(_mix(spark, d), table(spark, d, "mix_targets"))


@query
def p9_sample(spark, d):
    return _mix(spark, d)
