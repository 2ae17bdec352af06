import random

from pagemill.llm.leaks import build_index, leak_report, leaks, longest, windows

r = random.Random(2)
WORDS = [f"w{i}" for i in range(400)]
ITEMS = [(i, " ".join(r.choice(WORDS) for _ in range(40))) for i in range(12)]


def corpus():
    rows = [(k, " ".join(r.choice(WORDS) for _ in range(200))) for k in range(60)]
    t = ITEMS[3][1].split()
    noise = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    rows += [(100, f"{noise(30)}\n> " + "\n> ".join(" ".join(t[i : i + 7]).upper() for i in range(0, 40, 7))), (101, noise(20) + " " + " ".join(t[18:]) + " end"),
             (102, "[b]" + " ".join(t[:20]) + "[/b] did anyone try it yet? " + " ".join(t[20:])), (103, " ".join(t[:9]) + " " + noise(50)),
             (104, " ".join("x" + w if i % 8 == 0 else f"<i>{w}</i>" for i, w in enumerate(t))), (105, None), (106, ""), (None, ITEMS[3][1]), (101, "duplicate"), (107, (noise(3000) + " ") * 5 + " ".join(t))]
    return rows


def test_leaks_against_planted_cases(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string").withColumn("item_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(9))
    items = spark.createDataFrame([*ITEMS, ITEMS[0], (50, None), (51, "")], "item_id bigint, text string")
    got = leaks(docs.drop("item_id"), items).cache()
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(k, 3) for k in (100, 101, 102, 104, 107)} and got.count() == 5
    assert leak_report(got).first().documents == 5
    places = {x.doc_id: x for x in got.collect()}
    assert (places[100].item_from, places[100].item_to, places[100].start, places[100].end, places[100].exact) == (0, 39, 30, 69, True)
    assert not places[102].exact and not places[104].exact and places[107].start in range(15000, 15003)
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_anchors_lose_nothing_that_the_whole_search_finds(spark):
    # halves of items with up to a fifth of the words misspelt and others put between, against the longest passage over whole documents
    rnd, rows = random.Random(8), []
    for k in range(150):
        t = rnd.choice(ITEMS)[1].split()
        a = rnd.randint(0, 18)
        part = [("x" + w if rnd.random() < 0.2 else w) for w in t[a : a + rnd.randint(20, 40)]]
        at = rnd.randint(0, len(part))
        rows.append((k, " ".join([*(rnd.choice(WORDS) for _ in range(40)), *part[:at], *(rnd.choice(WORDS) for _ in range(rnd.randint(0, 6))), *part[at:]])))
    want = set()
    for k, text in rows:
        words = text.split()
        for i, t in ITEMS:
            places = {w: [n for n, x in enumerate(words) if x == w] for w in set(t.split())}
            share, density, *_ = longest(t.split(), places, (0, len(words)))
            want |= {(k, i)} if share >= 0.48 and density >= 0.75 else set()
    found = leaks(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert len(want) > 60 and len(want - got) <= 0.01 * len(want) and got <= want


def test_many_terms_shuffle_alike(spark, monkeypatch):
    from pagemill.llm import leaks as module

    docs, items = spark.createDataFrame(corpus(), "doc_id bigint, text string"), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    few = {tuple(x) for x in leaks(docs, items).collect()}
    monkeypatch.setattr(module, "MOST_TERMS", 3)
    assert {tuple(x) for x in leaks(docs, items).collect()} == few


def test_index_is_positional(spark):
    df = spark.createDataFrame([(1, "A b a, [b]C[/b] 你好"), (2, None)], "doc_id bigint, text string")
    assert {(x.term, x.doc_id, tuple(x.places)) for x in build_index(df, "doc_id", "text").collect()} == {("a", 1, (0, 2)), ("b", 1, (1,)), ("c", 1, (3,)), ("你", 1, (4,)), ("好", 1, (5,))}


def test_longest_and_windows():
    item = list("abcdefgh")
    assert longest(item, {"a": [3], "b": [4], "c": [5], "h": [90]}, (0, 100)) == (3 / 8, 1.0, 0, 2, 3, 5)
    assert longest(item, {}, (0, 9)) == (0.0, 0.0, -1, -1, -1, -1)
    assert windows([(10, 0), (13, 3), (500, 4)], 8, 20) == [(2, 21)] and windows([(10, 0)], 8, 20) == []
