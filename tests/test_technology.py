import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import technology as D

SAMPLE = json.dumps({"apps": {
    "Lantern": {"html": "lantern-root", "js": {"Lantern.build": "(\\d+)\\;version:\\1"}, "implies": "Wick"},
    "Wick": {"script": "wick[-.]([\\d.]+)?\\.js\\;version:\\1", "headers": {"X-Lit-By": "wick"}},
    "Harbour": {"html": ["harbour/assets", "data-harbour"], "meta": {"Generator": "^Harbour ([\\d.]+)\\;version:\\1"}, "cookies": {"harbour_id": ""}},
    "Loop": {"implies": ["Lantern", "Loop", "\\;x"], "dom": ["link[href*='loop.css'], #loop", ".loopy", "[data-loop='1']"], "headers": {"Server": "loop(?=x)"}, "cookies": {"l": [".*", "x"]}},
    "Broken": {"html": ["br(", "^start", "\\bword"], "dom": {"div": {"attributes": {"class": "a.b"}}, "p > x": {}, ".zz, img": {"text": "t"}, "x*": {}}, "js": {"ab": "", "analytics": "", "": "x", "Any": "[^]z"}},
    "Slow": {"headers": {"trap": "(?:a|aa)+$"}},
    "No": "object"}})
RULES = D.Rules(SAMPLE, chunk_size=1)


def test_patterns():
    assert D.without_version("lit\\;version:\\1") == "lit" and D.without_version("lit\\;confidence:0") is None and D.without_version(".*\\;version:\\1") is None
    assert D.list_pattern("lit(?!dim)") is None and D.list_pattern("^dim") == "dim" and D.list_pattern("a[^]b") == r"a[\s\S]b" and D.list_pattern("^^x") == "^x" and D.list_pattern(r"(a)\1") is None
    assert D.js_pattern("a.b", "^c") == r"a\.bc" and D.js_pattern("ab", "") is None and D.js_pattern("analytics", "") is None and D.js_pattern("", "xxxxx") is None
    assert D.value_pattern("x(?=y)") is None and D.value_pattern("a\\;confidence:05") is None and D.value_pattern("^Lit") == "^Lit"
    assert D.longest_literal(r"wick[-.]([\d.]+)?\.js") == "wick"
    assert D.dom_patterns("link[href*='a.css'], #loop") == [r"<link\s+(?:[^>]*?\s+)?href=([\"'])(.*?)a\.css(.*?)", "<(?:[^>]*?)loop"]
    assert D.dom_patterns("div.x") == ["<(?:[^>]*?)div(.*?)x"] and D.dom_patterns("div#it's") == ["<(?:[^>]*?)div(.*?)it\\'s"] and D.dom_patterns("[a^='v']") == ["<(?:[^>]*?)a(.*?)'v'"]
    assert D.dom_patterns("a[title]") == ["<(?:[^>]*?)a(.*?)title"] and D.dom_patterns("section") == [] and D.dom_patterns(5) == []


def test_counts_and_skipped():
    c = RULES.counts()
    assert c["implies"] == 2 and c["html"] == 4 and c["headers"] == 3 and c["cookies"] == 2 and c["js"] == 2 and RULES.skipped == ["Broken: br(", "Broken: \\bword"]
    assert D.Rules(SAMPLE, strict=False).skipped == ["Broken: br("]
    assert RULES.resolve(["Loop", "unknown"]) == ["Lantern", "Loop", "Wick", "unknown"]
    for bad in (b"[1]", b"{", b'{"apps": []}'):
        with pytest.raises(ValueError):
            D.Rules(bad)


def test_detection(spark):
    df = spark.createDataFrame([(1, ["<div data-harbour=1>"]), (2, ["<main id=lantern-root>"]), (3, ["<p>the sea</p>"]), (4, []), (5, None), (6, ["lantern-", "root", None])], "i int, p array<string>")
    got = {r.i: r.t for r in df.select("i", D.detect_text(spark, RULES, "html", F.col("p")).alias("t")).collect()}
    assert got == {1: ["Harbour"], 2: ["Lantern"], 3: [], 4: [], 5: None, 6: []}
    one = lambda key, parts: df.limit(1).select(D.detect_text(spark, RULES, key, F.array(*map(F.lit, parts))).alias("t")).first().t
    assert one("script", ["<script src='/WICK-3.6.0.js'>"]) == ["Wick"] and one("dom", ["<link rel=x href='/loop.css'>"]) == ["Loop"]
    assert one("js", ["lantern.build1"]) == [] and one("js", ["Lantern.build1"]) == ["Lantern"] and one("js", ["Any\nz"]) == ["Broken"]
    maps = spark.createDataFrame([({"GENERATOR": "Harbour 5.1", "x": None},)], "m map<string,string>")
    assert maps.select(D.detect_dict(spark, RULES, "meta", F.col("m")).alias("t")).first().t == ["Harbour"]
    assert maps.select(D.detect_dict(spark, RULES, "headers", F.create_map(F.lit("server"), F.lit("any"))).alias("t")).first().t == ["Loop"]
    empty, none = F.array().cast("array<string>"), F.array().cast("array<map<string,string>>")
    full = lambda implied: df.where("i = 2").select(D.detect(spark, RULES, F.col("p"), empty, none, F.lit(None).cast("array<map<string,string>>"), none, implied).alias("t")).first().t
    assert full(True) == ["Lantern", "Wick"] and full(False) == ["Lantern"]
    assert df.limit(1).select(D.resolve(RULES, F.array(F.lit("Loop"), F.lit("q"))).alias("t")).first().t == ["Lantern", "Loop", "Wick", "q"]
    for f, key in ((D.detect_text, "meta"), (D.detect_dict, "html")):
        with pytest.raises(ValueError):
            f(spark, RULES, key, F.col("p"))


def test_hostile_values_end(monkeypatch):
    class Stuck:
        def search(self, text, timeout=None):
            raise TimeoutError

    m = D.Matcher(RULES)
    m.dicts["headers"]["trap"] = [("Slow", Stuck()), ("Fine", None)]
    assert m.fields("headers", {"Trap": "aaaa"}) == ["Fine"]
    m.text["html"] = [(n, x, Stuck()) for n, x, _ in m.text["html"]]
    assert m.texts("html", ["data-harbour"]) == set()


def test_automaton_and_loop_agree(monkeypatch):
    parts = ["<div data-HARBOUR>", "lantern-root", "İstanbul lantern-root", "nothing", "start"]
    fast = D.Matcher(RULES)
    monkeypatch.setattr(D, "_automaton", lambda literals: None)
    slow = D.Matcher(RULES)
    for part in parts:
        assert fast.texts("html", [part]) == slow.texts("html", [part])


def test_thousand_rules(spark):
    rules = D.Rules(json.dumps({f"T{i}": {"html": f"lib{i}[.-]js"} for i in range(1000)}))
    df = spark.createDataFrame([(["x lib7.js y", "lib999-js"],)], "p array<string>")
    assert df.select(D.detect_text(spark, rules, "html", F.col("p")).alias("t")).first().t == ["T7", "T999"]
