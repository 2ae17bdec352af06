import random

from pagemill.llm import maxent
from pagemill.llm.sentences import candidates, examples, sentence_units, spans, split

STARTS = ["The driver", "Our neighbour", "A careful buyer", "The old bakery"]
VERBS = ["paints", "repairs", "checks", "sells"]
ENDS = ["the blue door", "two long ladders in the rain", "a wool blanket after a break", "the rain barrel for approx. 12 kg", "some paint, glue etc"]


def corpus(n=1500):
    r = random.Random(3)
    one = lambda: f"{r.choice(STARTS)} {r.choice(VERBS)} {r.choice(ENDS)}" + r.choice([".", ".", "!", "?", f" with Dr. {r.choice(['Holm', 'Berg', 'Dahl'])} at the weekend."])
    return [" ".join(one() + ("." if k == 9 else "") for k in range(r.randint(1, 5))) for _ in range(n)]


def model():
    rows, labels, known = examples(corpus())
    return maxent.fit(rows, labels) | known


def test_boundaries():
    m = model()
    parts = lambda t: [t[a:b].strip() for a, b in zip([0, *split(t, m)], split(t, m))]
    assert parts("The driver paints glue etc. Our neighbour checks the door with Dr. Berg at approx. 3 kg. A careful buyer sells it") == ["The driver paints glue etc.", "Our neighbour checks the door with Dr. Berg at approx. 3 kg.", "A careful buyer sells it"]
    assert parts('"The driver paints! Our neighbour sells!" says a guest. (The old bakery checks the door.) The driver sells paint.') == ['"The driver paints! Our neighbour sells!" says a guest.', "(The old bakery checks the door.)", "The driver sells paint."]
    assert split("", m) == split("  ", m) == []
    assert split("Menu ", m) == [4]
    assert len(split("The driver paints the blue door. " * 20_000, m)) == 20_000


def test_quotations():
    assert spans("l'atelier \"a (b\" c) d") == [(10, 16)]
    assert [("x. 「a。b。」と言う。c"[:e]) for e, _ in candidates("x. 「a。b。」と言う。c")] == ["x.", "x. 「a。b。」", "x. 「a。b。」と言う。"]


def test_frame(spark):
    rows = [(1, ["The driver paints. Our neighbour sells the door", None, ""], [["Menu"], None, []], "x"), (1, ["The driver paints. Our neighbour sells the door", None, ""], [["Menu"], None, []], "x"), (2, None, None, "y")]
    df = spark.createDataFrame(rows, "page_id bigint, p array<string>, text_nodes array<array<string>>, end_pos string")
    got = sorted(map(tuple, sentence_units(df, model()).collect()))
    assert got == [(1, "p", 0, 0, 18), (1, "p", 0, 0, 47), (1, "text_nodes", 0, 0, 4)]
    assert sentence_units(df.limit(0)).count() == 0


def test_openers_of_all_pages_count(spark):
    # no page of the model's sample opens with Velkro; one page does here, none with Zanzi
    text = "The driver paints the blue door.%s sells it at the weekend."
    rows = [(1, [text % "Velkro"], None), (1, [text % "Velkro"], None), (2, [text % "Zanzi"], [["Menu"]]), (3, ["Velkro sells the old ladders at the bakery."], None), (None, [text % "Velkro"], None), (None, [text % "Velkro", "Menu"], None)]
    df = spark.createDataFrame(rows, "page_id bigint, p array<string>, text_nodes array<array<string>>")
    got = sorted(((r.page_id or 0, r.field, r.end_pos) for r in sentence_units(df, model()).collect()))
    both = [(32,), (len(text % "Velkro"),)]
    assert got == sorted([(1, "p", e) for e, in both] + [(2, "p", len(text % "Zanzi")), (2, "text_nodes", 4), (3, "p", 43)] + [(0, "p", e) for e, in both * 2] + [(0, "p", 4)])
