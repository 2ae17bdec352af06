import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.operators import htmltree as H
from pagemill.operators import pages as P

CODES = ["fi", "no", "uk"]
G = T.Grouper(CODES)
MUSEUM = """<!DOCTYPE html><html lang=en><head><title>Tide clock</title>
<meta name="description" content="Clocks that follow the tide"><meta property="og:description" content="A small museum"><meta name="description" content="A small museum"><meta name="description" content="">
</head><body>
<h1>Tide   clocks &copy;rew &euro;7<br>open all winter</h1><h2>How they work,</h2>
<div><p>The moon pulls ~drop~ twice a day.</p><p>Two bells</p><p>A third bell rings at low water,</p></div>
<ul><li>Brass</li><li>Oak <b>and</b> ash</li></ul>
<div>Pier 4<br>Northmole<br><a href="mailto:desk@tide.example">desk@tide.example</a></div>
<p>We sell no cookie here</p><div class="testimonial">Lovely place</div><script>var x = "<p>no</p>";</script>
</body></html>"""


def test_sentences(spark):
    df = spark.createDataFrame([(1, MUSEUM), (2, MUSEUM), (3, "<html><head></head></html>"), (4, None), (5, "")], "id int, html string")
    rows = {r.id: r for r in P.with_sentences(df, stop_word="~drop~").collect()}
    for k in (1, 2):
        r = rows[k]
        assert r.h["h1"] == [] and r.h["h2"] == ["How they work"] and r.h["h6"] == []  # the rights sign takes the headline out
        assert r.p == ["The moon pulls twice a day", "A third bell rings at low water"]  # longest first as they stood, two words are too few, notices go
        assert r.other == ["Tide clock", "Brass", "Oak", "and", "ash", "Pier 4", "Northmole", "desk@tide.example"]
        assert r.descriptions == ["A small museum", "Clocks that follow the tide"]
        assert r.text_nodes[0] == ["Tide clock"] and r.text_nodes[1][:3] == ["Tide clocks ©rew €7", "open all winter", "How they work, The moon pulls ~drop~ twice a day."]
        assert ["Pier 4", "Northmole", "desk@tide.example"] == [t for g in r.text_nodes for t in g if t[:4] in ("Pier", "Nort", "desk")] and not any("Lovely" in t or "var x" in t for g in r.text_nodes for t in g)
    assert rows[3].text_nodes == rows[5].text_nodes == [] and rows[3].keywords == "" and rows[4].p is None
    with pytest.raises(ValueError):
        P.sentences(F.lit(""), CODES, stop_word="(")


def test_lines_and_split():
    assert T.lines_of(["tide", "", "ebb\r\nflow\n", "\n", "  "]) == ["tide", "ebb", "\n", "\n", "flow", "\n", "\n", "  "]
    assert T.lines_of([]) == [] and T.lines_of(["\r\r"]) == ["\n", "\n"]
    n = "\n"
    blocks = lambda *gaps: [x for k, gap in enumerate(gaps) for x in (f"line {k}", *[n] * gap)] + ["end"]
    for gaps, want in (((1, 1, 1), 1), ((2, 2), 2), ((2, 3, 2), 3), ((5, 1, 1), 2), ((4,), 4), ((), 1)):
        assert T.usual_split(blocks(*gaps)) == want, gaps
    assert T.usual_split([]) == T.usual_split([n, n]) == 1
    assert T.split_py("Tide tables | Northmole - harbour |") == ["Tide tables", "Northmole", "harbour"] and T.split_py("ebb-flow") == ["ebb-flow"]
    assert T.split_py("Clocks by Ada with bells", {"by", "with"}) == ["Clocks", "Ada", "bells"] and T.split_py("BY  with", {"by", "with"}) == [] and T.split_py("", {"by"}) == []


JOINS = [
    (["Hours", ":", "nine to five", ",", "closed on Mondays", "."], "Hours: nine to five, closed on Mondays."),
    (["Entry", "(", "children free", ")", "!"], "Entry (children free)!"),
    (["¿", "Abierto hoy", "?", " «", "sí", "»"], "¿Abierto hoy? «sí»"),
    (["See", ".org", "and", ".fi", "pages", ".", "More", ".pages"], "See .org and .fi pages. More.pages"),
    (["  \t", "low", "\n", " tide "], "low tide"),
    ([], ""),
]


def test_join_native_and_python_agree(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(JOINS)], "i int, a array<string>")
    got = {r.i: r.j for r in df.select("i", T.join_sentences(F.col("a"), CODES).alias("j")).collect()}
    for i, (lines, want) in enumerate(JOINS):
        assert G.join(lines) == got[i] == want


def test_regroup_and_group():
    n = "\n"
    # a line that ends open (with a comma or blank) or begins with a blank runs on
    assert G.regroup(["Ada Northwick, ", "keeper of clocks ", "desk@tide.example"]) == ["Ada Northwick, keeper of clocks desk@tide.example"]
    assert G.regroup(["tide.example", " (english)", "tide.fi", " (suomi)"]) == ["tide.example (english)", "tide.fi (suomi)"]
    assert G.regroup(["one", "two"]) == ["one", "two"] and G.regroup(["one "]) == ["one"] and G.regroup([]) == []
    assert G.group(["bell", " ", n, n, "rope", n, n, n, n, "moon, ", n, "sun "]) == [["bell", "rope"], ["moon, sun"]]
    # a huge limit leaves one group, 0 splits at each line end, nothing gives nothing
    assert G.group(["bell", n, n, n, "rope", n, "moon"], 99999) == [["bell", "rope", "moon"]] and G.group(["bell"]) == [["bell"]] and G.group([]) is None
    assert G.group(["bell | rope", n, "moon"], 0) == [["bell | rope"], ["moon"]]
    # a long page: sections of three lines, four line ends between them, one inside
    page = [x for k in range(20) for x in (f"\nTitle {k}", n, f"text {k}", n, f"foot {k}", n, n, n, n)]
    assert G.group(page) == [[f"Title {k}", f"text {k}", f"foot {k}"] for k in range(20)] and G.group(page, 99999) == [[x for k in range(20) for x in (f"Title {k}", f"text {k}", f"foot {k}")]]


def test_native_text(spark):
    texts = ["2110 Åndalby", " ", "", "a b  c", "x\ty\n.z", "..", " a , b. ", "one - two|three-four - ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", T.count_words(F.col("t")).alias("n"), T.normalize(F.col("t")).alias("z"), T.split_sentence(F.col("t")).alias("s")).collect()
    for r in rows:
        if r.t is not None:
            assert (r.n, r.z, r.s) == (T.word_count(r.t), T.tidy(r.t), T.split_py(r.t)), r
    html = "<a href=\"mailto:q@z.fi\" title=(\"q@z.fi\")>q@z.fi</a> x a..b@c.com. a@b.com#c@d.org a@b-.com"
    assert spark.range(1).select(T.emails(F.lit(html)).alias("e")).first().e == ["q@z.fi", "q@z.fi", "q@z.fi", "b@c.com", "a@b.com", "#c@d.org"]
    out = spark.createDataFrame([(["a b c", "a", "a b c d", "x y cookie z", "© a b c", "p stop q r"],)], "a array<string>")
    assert out.select(T.without_stops(T.order_paragraphs(F.col("a")), "STOP").alias("o")).first().o == ["a b c d", "p q r", "a b c"]


def test_tree():
    body = lambda s: H.serialise(H.parse(s)[0]).removeprefix("<html><head></head><body>").removesuffix("</body></html>")
    assert body("<p>a<b>x<p>y</b>z") == "<p>a<b>x</b></p><p><b>y</b>z</p>"
    assert body("<b>1<p>2</b>3</p>") == "<b>1</b><p><b>2</b>3</p>"
    assert body("<table><tr><td>1<td>2</table>t") == "<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table>t"
    assert body("<table>foo<tr><td>c</table>") == "foo<table><tbody><tr><td>c</td></tr></tbody></table>"
    assert body("<a href=1>x<a href=2>y") == '<a href="1">x</a><a href="2">y</a>'
    assert body("a&nbsp;b &amp; <5 &notit; <br/>") == "a&nbsp;b &amp; &lt;5 ¬it; <br>"
    assert body("<select><option>a<option>b</select><dl><dt>a<dd>b</dl>") == "<select><option>a</option><option>b</option></select><dl><dt>a</dt><dd>b</dd></dl>"
    assert H.serialise(H.parse("<!DOCTYPE HTML><!-- c --><TITLE>t</TITLE><script>a<b</script>")[0]) == "<!DOCTYPE html><!-- c --><html><head><title>t</title><script>a<b</script></head><body></body></html>"
    deep = H.parse("<div>" * 5000)
    assert len(deep) == 5004 and len(H.serialise(deep[0])) > 50000


def test_selectors():
    nodes = H.parse("<div class='a b' id=c><span>1</span><p title=q data-x='u v'>2<em>3</em></p></div>")
    tags = lambda q: [n.tag for n in H.select(nodes, H.compile_selector(q))]
    assert tags("div.a.b > span") == ["span"] and tags("#c em") == ["em"] and tags("p[title=q], span") == ["span", "p"] and tags("span + p, span ~ em") == ["p"]
    assert tags("[data-x~=v]") == tags("[title^='q']") == tags("p:not(.z)") == tags("span ~ p") == tags("*[data-x*='u ']") == ["p"] and tags("p:first-child") == []
    for bad in ("", "div >", "p[", "..a", "p:hover", "a,,b"):
        with pytest.raises(ValueError):
            H.compile_selector(bad)


def test_extractors(spark):
    html = """<html lang='da-DK '><head><title>A</title><meta name=og:title content=O><meta property=og:title content=X><meta name=twitter:title content=''><meta name=keywords content=''><meta name=keywords content='a, b'>
    <link rel=alternate hreflang=da href=/da><link rel=alternate hreflang=da><link rel='alternate x' hreflang=en href=/en><script type='application/ld+json'> {"a": 1} </script><script type="application/ld+json">{"a": "<b>x</b>"}</script></head>
    <body><noscript><a href=/no>no</a></noscript><a>none</a><a href=/x> t <b>u</b></a><style>s</style><nav class=m><i>n</i></nav><svg><title>S</title></svg></body></html>"""
    df = spark.createDataFrame([(html,), (None,)], "html string")
    e = df.select(P.extract_struct(F.col("html"), *P.EXTRACTORS).alias("e"), P.tag_attribute(F.col("html"), "a", "HREF").alias("a"), P.tag_html(F.col("html"), "nav.m").alias("t"), P.tag_html(F.col("html"), "p[").alias("bad")).collect()
    r = e[0].e
    assert r.lang == "da-DK " and r.href_attributes == ["", "/x"] and [tuple(x) for x in r.links] == [("", "none"), ("/x", "t u")]
    assert r.meta_titles == {"og:title": "O", "title": "S"} and r.alternate_links == {"da": ["/da", ""]} and r.keywords == "a, b" and r.json_ld == ['{"a": 1}', ""]
    assert "<script" not in r.html_contents and "<style" not in r.html_contents and "<noscript" not in r.html_contents and "<svg>" in r.html_contents
    assert (e[0].a, e[0].t, e[0].bad) == ("", '<nav class="m"><i>n</i></nav>', "") and e[1].e is None and e[1].a is None
    nodes = {n.id: n for n in r.nodes}
    assert all(nodes[n.parent].id < n.id <= nodes[n.parent].end for n in r.nodes if n.parent >= 0)
    with pytest.raises(ValueError):
        P.tag_attribute(F.col("html"), "p[", "x")
    cleaned = P.with_sentences(spark.createDataFrame([("<header>top</header><div class=cookies>c</div><p>one two three</p><div class='footer x'>end</div>",)], "html string"), remove_header=True, remove_footer=True).first()
    assert cleaned.other == [] and cleaned.p == ["one two three"]
