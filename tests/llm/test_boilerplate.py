import itertools
import random

from pagemill.llm.boilerplate import boilerplate, describe, main_text, min_cut


def test_min_cut_against_brute_force():
    r = random.Random(5)
    for _ in range(150):
        n = r.randint(1, 7)
        costs = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, r.uniform(0, 1.5)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        energy = lambda side: sum(-c if x else c for c, x in zip(costs, side)) / 2 + sum(w for a, b, w in edges if side[a] != side[b])
        best = min(energy(side) for side in itertools.product([True, False], repeat=n))
        # a capacity c is paid if the node is on the other side: costs of ±c/2 around a constant
        assert abs(energy(min_cut(costs, edges)) - best) < 1e-6


def test_describe_ignores_spacing_and_a_closing_stop():
    assert describe("A  b c.")[0] == describe("A b c")[0] != describe("A b d")[0]
    assert describe("© 2019 Foo – rights")[1] == describe("© 2023 Foo – rights")[1]


def site(i, host="a.example"):
    title = f"Story number {chr(65 + i % 26)}{i} about doors"
    body = [f"The driver paints door {chr(97 + i % 26)}{j} of house {i} in the rain, says owner {i * 7 + j}." for j in range(4)]
    nodes = [[title], ["Home", "News", "Log in"], [title, f"By Anna B{i}"], [*body, "Read also: another story"], ["Most read", f"Teaser {i} one", f"Teaser {i} two"], ["Contact", "Foo Ltd.", "mail@foo.example", "© 20%d Foo Ltd." % (10 + i)]]
    return (i, host, {"h1": [title], "h3": ["Most read", "Contact"]}, body, nodes)


def test_frame(spark):
    rows = [site(i) for i in range(14)] + [site(3), (90, "a.example", None, None, None), (91, None, {}, [None, ""], [[None], None, []])]
    df = spark.createDataFrame(rows, "page_id bigint, host string, h map<string,array<string>>, p array<string>, text_nodes array<array<string>>")
    found = boilerplate(df).cache()
    got = {tuple(r) for r in found.where("page_id = 3").collect()}
    want = {(3, "text_nodes", g, k) for g, n in ((1, 3), (4, 3), (5, 4)) for k in range(n)} | {(3, "text_nodes", 3, 4), (3, "h3", 0, 0), (3, "h3", 1, 0)}
    assert got == want and found.where("page_id = 3").count() == len(want)
    assert [r.text for r in main_text(df, found).where("page_id = 3").orderBy("pos", "item").collect()][:2] == [site(3)[4][0][0], site(3)[4][0][0]]
    assert boilerplate(df.limit(0)).count() == 0
