import itertools
import random
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm.names import allowed, components, distance, edits, employer_key, entities, fold, given_fits, index_keys, pairs, probe_keys, segment_join


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9), st.integers(0, 3))
def test_banded_distance(a, b, k):
    assert distance(a, b, k) == min(osa(a, b), k + 1)


def test_segments_find_every_pair_within_the_edits():
    r = random.Random(4)
    for _ in range(400):
        a = "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(3, 12)))
        b = list(a)
        for _ in range(edits(len(a))):
            x = r.randrange(len(b))
            r.choice([lambda: b.pop(x), lambda: b.insert(x, "q"), lambda: b.__setitem__(x, "z")])()
        b = "".join(b)
        short, long_ = sorted((a, b), key=len)
        if edits(len(short)) >= osa(a, b):
            assert set(index_keys(short)) & set(probe_keys(long_))


def test_segments_find_exchanges_over_their_borders():
    meet = lambda a, b: bool(set(index_keys(min(a, b, key=len))) & set(probe_keys(max(a, b, key=len))))
    assert meet("holm", "hlom") and meet("hlom", "holm") and meet("holms", "hloms") and meet("abc", "bac") and meet("holme", "hlomeb")
    words = ["".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)]
    r = random.Random(5)
    words += ["".join(r.choice("abcd") for _ in range(n)) for n in (3, 4, 5, 6, 7, 8, 9) for _ in range(30)]
    for _ in range(3000):  # edits of all kinds, exchanges not among the letters of another
        b = list(r.choice(words[-210:]))
        words.append("".join(b))
        for _ in range(2):
            x = r.randrange(len(b))
            r.choice([lambda: len(b) > 1 and b.pop(x), lambda: b.insert(x, r.choice("abcd")), lambda: b.__setitem__(x, r.choice("abcd")), lambda: b.__setitem__(slice(x, x + 2), b[x : x + 2][::-1])])()
        words.append("".join(b))
    tries = list(itertools.combinations(sorted(set(words[:254])), 2)) + list(zip(words[464::2], words[465::2]))
    for a, b in tries:
        k = allowed(max(len(a), len(b)))
        if a != b and distance(a, b, k) <= k:
            for x, y in ((a, b), (b, a)) if len(a) == len(b) else (sorted((a, b), key=len),):
                assert set(index_keys(x)) & set(probe_keys(y)), (x, y)


def test_folding():
    assert fold("Zacharyas") == fold("ZACHARIAS") and fold("Käthe") == fold("Kathe") and fold("H0lmvad") == fold("holmvad") and fold(None) == ""
    assert employer_key("Komikite A/S") == employer_key("KOMIKITE") == employer_key("Komikite AS") and employer_key("Foo & Co.") == "foo"
    assert given_fits("ela", "gabriela", False, False) and not given_fits("robert", "anders", False, True) and not given_fits("mete", "grete", False, False)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(20, 21)], "a bigint, b bigint")
    nodes = spark.createDataFrame([(i,) for i in [*range(10), 20, 21, 30]], "node bigint")
    assert {(r.node, r.comp) for r in components(edges, nodes).collect()} == {(i, 0) for i in range(10)} | {(20, 20), (21, 20), (30, 30)}


SCHEMA = "name_id bigint, raw_name string, given_name string, middle_name string, middle_initials string, surname string, generational_suffix string, employer string, town string, links string"


def test_entities(spark):
    one = lambda i, raw, g, s, e, t, m=None, x=None: (i, raw, g, m, None, s, x, e, t, None)
    rows = [
        one(1, "Gabriella Nordlund", "Gabriella", "Nordlund", "Komikite A/S", "Derotaton"), one(2, "Ella Nordlund", "Ella", "Nordlund", None, "DEROTATON"), one(3, "Nordlund, Gabriela", "Gabriela", "Nordlnud", "Komikkite AS", None),
        one(4, "G. Nordlund", None, "Nordlund", "Komikite", "Derotaton"), one(5, "Gabriella Nordlund", "Gabriella", "Nordlund", "Sadubake GmbH", "Elsewhere"), one(6, "Robert Nordlund", "Robert", "Nordlund", "Komikite A/S", "Derotaton"),
        one(7, "12 34", None, None, "Komikite A/S", "Derotaton"), one(8, "Nordlund Gabriella", "Nordlund", "Gabriella", "Komikite A/S", "Derotaton"), one(9, "Anna Berg", "Anna", "Berg", None, None), one(10, "Anna Berg", "Anna", "Berg", None, None),
        one(11, "Robert Nordlund Jr.", "Robert", "Nordlund", "Komikite A/S", "Derotaton", x="Jr."), one(None, "Anna Berg", "Anna", "Berg", "Komikite A/S", None), one(1, "Gabriella Nordlund", "Gabriella", "Nordlund", "Komikite A/S", "Derotaton"),
    ] + [one(100 + i, "Gabriella Kvist", "Gabriella", "Kvist", f"F{i}okite", f"Town{i}") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = entities(df).cache()
    got = {(r.name_id_a, r.name_id_b) for r in pairs(found).collect()}
    same = set(itertools.combinations((1, 2, 3, 4, 8), 2))
    assert same <= got and not any(x in (5, 7, 9, 10) for p in got for x in p)
    assert {r.name_id for r in found.collect()} == {1, 2, 3, 4, 5, 6, 8, 9, 10, 11, *range(100, 106)}
    assert entities(df.limit(0)).count() == 0


def test_employers_without_a_town_are_sought_among_all(spark):
    one = lambda i, g, s, e, t: (i, f"{g or 'G.'} {s}", g, None, None, s, None, e, t, None)
    rows = [
        # a nickname and another initial, a surname misspelt in its first letters: no row of the employer begins alike
        one(1, "Elizabeth", "Bergmann", "Komikite A/S", "Derotaton"), one(2, "Liz", "Bergmann", "Komikkite", None),
        one(3, "Theodora", "Holmvad", "Sadubake", "Elsewhere"), one(4, "Theodora", "Hlomvad", "Sadubkae", None),
        # equally near to two employers: the one beside the likest name
        one(5, "Anders", "Kvistgaard", "Ronefati", "Aby"), one(6, "Susanne", "Lindholm", "Ronefato", "Bby"), one(7, "Susanne", "Lnidholm", "Ronefat", None), one(8, "Anders", "Kvistgard", "Ronefat", None),
        # short names allow one edit
        one(9, "Maria", "Dalsgaard", "Fibo", "Cby"), one(10, "Maria", "Dalsgaard", "Figa", None),
    ]
    got = {(r.name_id_a, r.name_id_b) for r in pairs(entities(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {(1, 2), (3, 4), (5, 8), (6, 7)}


def test_letters_folded_into_two_are_found(spark):
    one = lambda i, s: (i, f"Kristian {s}", "Kristian", None, None, s, None, "Ferekime", "Nomariham", None)
    got = {(r.name_id_a, r.name_id_b) for r in pairs(entities(spark.createDataFrame([one(1, "Ubbæk"), one(2, "Ubbkæ"), one(3, "Ubbnk"), one(4, "Holm")], SCHEMA))).collect()}
    assert {(1, 2), (1, 3)} <= got and not any(4 in x for x in got)


def test_the_same_rows_link_alike_in_a_larger_table(spark):
    one = lambda i, g, s, e, t: (i, f"{g} {s}", g, None, None, s, None, e, t, None)
    rows = [one(1, "Gabriella", "Nordlund", "Komikite", "Derotaton"), one(2, "Gabriela", "Nordlund", "Komikite", "Derotaton"), one(3, "Gabriella", "Nordlnud", "Komikite", "Derotaton"), one(4, "Anders", "Holm", "Komikite", "Derotaton"), one(5, "Anders", "Holt", "Komikite", "Derotaton")]
    usual = [("Gabriella", "Nordlund"), ("Anders", "Holm"), ("Anders", "Holt"), ("Maria", "Dalsgaard"), ("Robert", "Kvist")]
    many = lambda n: [one(100 + k, *usual[k % 5], f"Firm{k}", f"Town{k}") for k in range(n)]
    got = [{(r.name_id_a, r.name_id_b) for r in pairs(entities(spark.createDataFrame(rows + many(n), SCHEMA))).collect()} for n in (60, 3000)]
    assert got[0] == got[1] == {(1, 2), (1, 3), (2, 3)}


def test_nothing_is_broadcast_through_the_driver(spark):
    # small tables, which Spark would broadcast; a row becomes some thirty keys that it doesn't count
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = spark.createDataFrame([("x", "holmvad"), ("x", "hlomvad"), ("y", "holmvad")], "place string, s string")
    found = segment_join(words, "place", "s")
    assert {tuple(r) for r in found.collect()} == {("x", "hlomvad", "holmvad")}
    rows = [(i, f"Robert {s}", "Robert", None, None, s, None, "Komikite", "Derotaton", None) for i, s in enumerate(("Nordlund", "Nordlnud", "Kvist"))]
    linked = pairs(entities(spark.createDataFrame(rows, SCHEMA)))
    assert {tuple(r) for r in linked.collect()} == {(0, 1)}
    assert not any("Broadcast" in plan(x) for x in (found, linked)) and "SortMergeJoin" in plan(found)
