"""What a page says: sentences, headings, links, addresses, metadata, cleaned markup.

Every operator is a function of one HTML text. `extract` runs any of them over a column with one parse a row; `sentences` gives the
full result. Null HTML gives null.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import htmltree as H
from pagemill.packing import once

#: What is removed before text is taken.
REMOVED = (
    "script", "style", "noscript", "#coiOverlay", ".CookiesOK", "#closeCookieBanner", ".CookieBanner-button", "#nts-set-cookie", ".cc_btn_accept_all", ".cookies", ".noticeCookiesContent .CustomDismissCtrl",
    ".cookie-consent .cookie-btn", "#accept-cookies", "#cookie_button_agree", "#cookies-agreement #agree-button", "#cookielayer .action-btn", ".cookie.nag .close", "#__tealiumGDPRecModal #consent_prompt_submit", ".gdpr__button",
    ".eu-cookie-compliance-agree-button", ".cookie-notification .js-cookie-notification-hide", ".js-accept-cookie-policy", "#moove_gdpr_cookie_info_bar", ".pea_cook_wrapper", ".testimonial", ".testimonial-text", ".pwr-testimonial__quote",
)
HEADER = ("header", "nav", ".header", ".header-hero")
FOOTER = ("footer", ".footer", ".footer-hero")


def _by_key(selectors: tuple[str, ...]) -> dict[tuple[str, str], list]:
    """Selectors by what their last part asks for first, a class, an id or a tag."""
    out: dict[tuple[str, str], list] = {}
    for s in selectors:
        chain = H.compile_selector(s)
        out.setdefault(tuple(chain[0][-1][1][0]), []).append(chain)
    return out


_REMOVED, _HEADER, _FOOTER = _by_key(REMOVED), _by_key(HEADER), _by_key(FOOTER)

SENTENCES = "struct<descriptions:array<string>,h:map<string,array<string>>,json_ld:array<string>,keywords:string,other:array<string>,p:array<string>,text_nodes:array<array<string>>>"


class Page:
    """A parsed page; removed subtrees are marked, not cut."""

    def __init__(self, html: str):
        self.nodes = H.parse(html)
        self.gone = bytearray(len(self.nodes))

    def find(self, *tags: str) -> list[H.Node]:
        return [n for n in self.nodes if n.kind == "el" and n.tag in tags and not self.gone[n.index]]

    def select(self, selector) -> list[H.Node]:
        return [n for n in H.select(self.nodes, selector) if not self.gone[n.index]]

    def remove(self, node: H.Node) -> None:
        for i in range(node.index, node.end + 1):
            self.gone[i] = 1

    def remove_all(self, selectors: dict[tuple[str, str], list]) -> None:
        """Remove whatever one of the selectors matches; each element is tried only on those its tag, id and classes may fit."""
        for node in self.nodes:
            if node.kind != "el" or self.gone[node.index]:
                continue
            keys = [("tag", node.tag)]
            if node.attrs:
                keys += [("id", node.attrs["id"])] if "id" in node.attrs else []
                keys += [("cls", c) for c in node.attrs.get("class", "").split()]
            if any(H.matches(node, chain) for k in keys for chain in selectors.get(k, ())):
                self.remove(node)

    def raw(self, node: H.Node, gone: bytearray | None = None) -> list[str]:
        gone = self.gone if gone is None else gone
        return [n.text for n in self.nodes[node.index : node.end + 1] if n.kind == "text" and not gone[n.index]]

    def texts(self, node: H.Node, gone: bytearray | None = None) -> list[str]:
        return [t for t in map(T.strip, self.raw(node, gone)) if t and not T.looks_like_markup(t)]

    def take(self, tag: str) -> list[str]:
        """The tidied texts of all such elements, which are then removed; one inside another is read twice."""
        before, out = bytes(self.gone), []
        for node in self.find(tag):
            if t := T.tidy(" ".join(self.texts(node, before))):
                out.append(t)
            self.remove(node)
        return out


def sentences_of(html: str, grouper: T.Grouper, stop: re.Pattern | None, remove_header: bool, remove_footer: bool, add_text_nodes: bool, min_split: int | None) -> dict:
    page = Page(html)
    json_ld = json_ld_of(page)
    for wanted, selectors in ((True, _REMOVED), (remove_header, _HEADER), (remove_footer, _FOOTER)):
        if wanted:
            page.remove_all(selectors)
    groups = grouper.group(page.raw(page.nodes[0]), min_split) if add_text_nodes else None

    def kept(texts: list[str]) -> list[str]:
        done = [T.squeeze(stop.sub("", t) if stop else t) for t in texts]
        return [t for t in done if "cookie" not in t.lower() and "©" not in t and T.word_count(t) > 0]

    h = {f"h{k}": kept(page.take(f"h{k}")) for k in range(1, 7)}
    p = sorted(page.take("p"), key=lambda t: -T.word_count(t))
    return {"descriptions": descriptions_of(page), "h": list(h.items()), "json_ld": json_ld, "keywords": keywords_of(page), "other": page.texts(page.nodes[0]), "p": kept([t for t in p if T.word_count(t) > 2]), "text_nodes": groups or []}  # other is read after h and p are gone


def json_ld_of(page: Page) -> list[str]:
    return [" ".join(page.texts(n)) for n in page.find("script") if n.attrs.get("type") == "application/ld+json"]


def descriptions_of(page: Page) -> list[str]:
    found = {n.attrs["content"] for n in page.find("meta") if n.attrs.get("content") and {n.attrs.get("name"), n.attrs.get("property")} & {"description", "og:description"}}
    return sorted(found, key=lambda s: s.encode("utf-8", "surrogatepass"))


def keywords_of(page: Page) -> str:
    return next((n.attrs["content"] for n in page.find("meta") if n.attrs.get("name") == "keywords" and n.attrs.get("content")), "")


def links_of(page: Page) -> list[tuple[str, str]]:
    return [(n.attrs.get("href", ""), " ".join(page.texts(n))) for n in page.find("a")]


def titles_of(page: Page) -> dict[str, str]:
    out = {n.attrs["name"]: n.attrs["content"] for n in page.find("meta") if n.attrs.get("name") in ("twitter:title", "og:title") and n.attrs.get("content")}
    for n in page.find("title"):
        out["title"] = " ".join(page.texts(n))
    return out


def alternates_of(page: Page) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for n in page.find("link"):
        if n.attrs.get("rel") == "alternate" and n.attrs.get("hreflang"):
            out.setdefault(n.attrs["hreflang"], []).append(n.attrs.get("href", ""))
    return out


def lang_of(page: Page) -> str:
    return next((n.attrs.get("lang", "") for n in page.find("html")), "")


def contents_of(page: Page) -> str:
    return H.serialise(page.nodes[0], {n.index for n in page.find("script", "style", "noscript")})


def attribute_of(page: Page, selector, attribute: str) -> str:
    return next((n.attrs.get(attribute, "") for n in page.select(selector)), "")


def tag_of(page: Page, selector) -> str:
    return next((H.serialise(n) for n in page.select(selector)), "") if selector else ""


def nodes_of(page: Page) -> list[dict]:
    return [{"id": n.index, "end": n.end, "parent": n.parent.index if n.parent else -1, "kind": n.kind, "tag": n.tag, "attrs": list(n.attrs.items()), "text": n.text} for n in page.nodes]


#: Extractors without parameters: name, function, type.
EXTRACTORS = {
    "href_attributes": (lambda p: [h for h, _ in links_of(p)], "array<string>"),
    "links": (lambda p: [{"href": h, "text": t} for h, t in links_of(p)], "array<struct<href:string,text:string>>"),
    "meta_titles": (lambda p: list(titles_of(p).items()), "map<string,string>"),
    "alternate_links": (lambda p: list(alternates_of(p).items()), "map<string,array<string>>"),
    "html_contents": (contents_of, "string"),
    "lang": (lang_of, "string"),
    "json_ld": (json_ld_of, "array<string>"),
    "descriptions": (descriptions_of, "array<string>"),
    "keywords": (keywords_of, "string"),
    "nodes": (nodes_of, "array<struct<id:int,end:int,parent:int,kind:string,tag:string,attrs:map<string,string>,text:string>>"),
}


def _column(batch_type: str, f):
    """An Arrow function over an HTML column; null stays null."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    kind = to_arrow_type(DataType.fromDDL(batch_type))

    def run(html: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in html.to_pylist()], kind)

    run.__annotations__ = {"html": pa.Array, "return": pa.Array}
    return once(run, batch_type)


def extract_struct(html: Column, *names: str) -> Column:
    """A struct of the named extractors with one parse a row."""
    wrong = [n for n in names if n not in EXTRACTORS]
    if wrong or not names:
        raise ValueError(f"no such extractor: {wrong or names}")

    def f(x: str) -> dict:
        page = Page(x)
        return {n: EXTRACTORS[n][0](page) for n in names}

    return _column("struct<" + ",".join(f"`{n}`:{EXTRACTORS[n][1]}" for n in names) + ">", f)(html)


def extract(html: Column, name: str) -> Column:
    """One extractor of EXTRACTORS."""
    if name not in EXTRACTORS:
        raise ValueError(f"no such extractor: {name}")
    return _column(EXTRACTORS[name][1], lambda x: EXTRACTORS[name][0](Page(x)))(html)


def tag_attribute(html: Column, selector: str, attribute: str) -> Column:
    """The attribute of the first element that a CSS selector matches, '' if none or absent; ValueError at once for a selector that can't be read."""
    chain = H.compile_selector(selector)
    return _column("string", lambda x: attribute_of(Page(x), chain, attribute.lower()))(html)


def tag_html(html: Column, selector: str) -> Column:
    """The markup of the first element that a CSS selector matches; '' if none, or if the selector can't be read."""
    try:
        chain = H.compile_selector(selector)
    except ValueError:
        chain = None
    return _column("string", lambda x: tag_of(Page(x), chain))(html)


def sentences(html: Column, codes: list[str], stop_word: str = "", remove_header: bool = False, remove_footer: bool = False, add_text_nodes: bool = True, min_split: int | None = None) -> Column:
    """The full result as a struct (SENTENCES). codes: two-letter codes that may follow a dot. ValueError at once for a bad stop pattern."""
    try:
        stop = re.compile(stop_word, re.I) if stop_word else None
    except re.error as e:
        raise ValueError(f"no such pattern: {stop_word}") from e
    grouper: list = []

    def f(x: str) -> dict:
        if not grouper:
            grouper.append(T.Grouper(codes))
        return sentences_of(x, grouper[0], stop, remove_header, remove_footer, add_text_nodes, min_split)

    return _column(SENTENCES, f)(html)


def with_sentences(df: DataFrame, html: str = "html", **options) -> DataFrame:
    """df with the fields of the full result as columns; extra columns stay, those of the same names are replaced."""
    done = df.withColumn("_s", sentences(F.col(html), T.country_codes(df.sparkSession), **options))
    fields = ("descriptions", "h", "json_ld", "keywords", "other", "p", "text_nodes")
    return done.withColumns({f: F.col("_s").getField(f) for f in fields}).drop("_s")
