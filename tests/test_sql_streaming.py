import datetime

from pyspark.sql import functions as F

from pagemill.operators import technology
from pagemill.operators.pages import with_sentences
from pagemill.plans import queries
from pagemill.plans.register import register, register_rules
from pagemill.sources.tables import cut, read_images, read_pages, release, spread
from pagemill.streaming import rows as S

HTML = "<html lang=da><h1>Top | two</h1><p>one two three.</p><a href=/x>mail a@b.com</a></html>"


def test_sql_functions(spark):
    made = register(spark)
    spark.createDataFrame([(HTML,), (None,)], "html string").createOrReplaceTempView("w")
    r = spark.sql("SELECT page_lang(html) l, page_links(html) k, page_sentences(html).p p, page_tag_attribute(html, 'a', 'href') a, page_tag_html(html, 'h1') h, page_emails(html) e, lz_decompress(lz_compress(html)) z FROM w").collect()
    assert (r[0].l, r[0].p, r[0].a, r[0].h, r[0].e, r[0].z) == ("da", ["one two three"], "/x", "<h1>Top | two</h1>", ["a@b.com"], HTML) and r[1].l is None and r[1].e is None
    r = spark.sql("SELECT text_normalize(' a  b. ') n, text_word_count('a b c') c, text_split('x | y - z') s, rgb_hex(255, 0, 16) x, parse_name('Anna Berg').surname f, try_lz_decompress('!') t, try_image_palette(cast('x' as binary)) i, text_group(array('a', '\\n', 'b')) g").first()
    assert (r.n, r.c, r.s, r.x, r.f, r.t, r.i, r.g) == ("a b", 3, ["x", "y", "z"], "#ff0010", "Berg", None, None, [["a"], ["b"]])
    r = spark.sql("""SELECT rgb_hsl(255, 0, 0) a, rgb_hsl(18, 52, 86) b, rgb_hsl(9, 9, 9) c, text_join(array('Open', ':', 'daily', '.')) j, text_order(array('a b c', 'x', 'a b c d')) o, text_split_words('Clocks by Ada', array('by')) s,
        text_without_stops(array('a stop b', 'cookies'), 'stop') w, page_sentences_with('<header>top</header><p>one two three</p>', '{"remove_header": true}') p""").first()
    assert r.a == [0.0, 100.0, 50.0] and abs(r.b[0] - 210) < 1e-6 and r.c[:2] == [0.0, 0.0] and (r.j, r.o, r.s, r.w) == ("Open: daily.", ["a b c d", "a b c"], ["Clocks", "Ada"], ["a b"])
    assert r.p.other == [] and r.p.p == ["one two three"]
    rules = technology.Rules('{"Lamp": {"html": "lamp", "headers": {"X-Lit": "on"}, "implies": "Wick"}}')
    assert register_rules(spark, "lit", rules) == ["lit_text", "lit_dict", "lit_resolve"]
    r = spark.sql("SELECT lit_text('html', array('a LAMP')) t, lit_dict('headers', map('x-lit', 'on')) d, lit_resolve(array('Lamp')) r").first()
    assert (r.t, r.d, r.r) == (["Lamp"], ["Lamp"], ["Lamp", "Wick"])
    assert {"page_nodes", "page_html_contents", "image_palette"} <= set(made)


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 12)
    rows = [(1, "https://a.example/x", HTML, t), (1, "https://a.example/x", HTML, t), (2, "https://b.example/", None, t + datetime.timedelta(hours=2))]
    spark.createDataFrame(rows, "page_id bigint, url string, html string, at timestamp").write.parquet(str(tmp_path / "in"))
    source = S.page_stream(spark, str(tmp_path / "in"), "page_id bigint, url string, html string, at timestamp")
    S.to_tables(S.sentence_stream(S.once_per_page(source, time="at")), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("page_id").collect()
    assert [r.page_id for r in got] == [1, 2] and got[0].p == ["one two three"] and got[1].p is None
    S.to_tables(S.host_counts(source, "url", "at", late="10 minutes"), str(tmp_path / "hosts"), str(tmp_path / "c2")).awaitTermination()
    assert {(r.host, r.pages) for r in spark.read.parquet(str(tmp_path / "hosts")).collect()} >= {("a.example", 2)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text(HTML)
    assert read_pages(spark, str(tmp_path / "a.html"), "files").first().html == HTML
    assert bytes(read_images(spark, str(tmp_path / "a.html")).first().data).decode() == HTML
    df = spread(spark.range(3).coalesce(1))
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and cut(df).count() == 3 and release(spark) >= 1 and release(spark) == 0


def test_one_parse_a_row_and_pruned_scans(spark, tmp_path):
    spark.createDataFrame([(1, HTML, "extra")], "page_id bigint, html string, other string").write.parquet(str(tmp_path / "p"))
    plan = with_sentences(spark.read.parquet(str(tmp_path / "p")).select("page_id", "html"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "other" not in plan.split("ReadSchema")[1]


def test_every_query_is_registered():
    assert set(queries.SQL) <= set(queries.QUERIES) and {"p3_found", "p7_found", "sentences", "tech_full"} <= set(queries.QUERIES)
