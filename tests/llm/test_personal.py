from pagemill.llm.personal import KINDS, Gazetteer, find, fit, fit_personal, gazetteer, personal_spans, redact, reliabilities, spans
from collections import Counter

GAZ = Gazetteer({"anna", "lars", "josé", "mette", "hans-peter"}, {"holmvad", "fladmark"}, {"maler", "den", "paints"})
TEXTS = [
    "Call +45 00 12 34 56 and ask for Anna Holmvad. Please send it to Lars Fladmark, 12 Mill Row, Lobato, QX1 2ZZ, before Friday.",
    "Du kan ringe til Holmvad, Mette på (01632) 960495 eller skrive til mette.h [at] foo.example.",
    "I den gamle mappe står CPR 690716-5924 ud for josé fladmark. Ordre 4500-1917-22 blev sendt med faktura 198812034.",
    "Version 10.81.4.1 was released on 12-05-2023. The manual has ISBN 000-0-774321-0 on its back. CVR 00770000 står her.",
    "By Hans-Peter Holmvad", "0124 Regareby", "Sønderhøj Allé 52 B", "with Mrs. Svinbæk and St. Orbin parish", "Af L. Fladmark",
    "Æblet hedder Rød Filippa, og rosen hedder Frøken Rav.", "Telefon: 00 22 48 35", "E-mail: A.B@FOO.EXAMPLE", "Write @workshop in the chat.",
]
MODEL = fit([" " * i + t for t in TEXTS for i in range(4)], GAZ)


def pieces(text):
    return [(KINDS[k], text[a:b]) for a, b, k in find(text, MODEL, GAZ)]


def test_kinds_and_starts():
    assert pieces(TEXTS[0]) == [("phone", "+45 00 12 34 56"), ("name", "Anna Holmvad"), ("name", "Lars Fladmark"), ("address", "12 Mill Row, Lobato, QX1 2ZZ")]
    assert pieces(TEXTS[1]) == [("name", "Holmvad, Mette"), ("phone", "(01632) 960495"), ("email", "mette.h [at] foo.example")]
    assert pieces(TEXTS[2]) == [("id_number", "690716-5924"), ("name", "josé fladmark")]
    assert pieces(TEXTS[3]) == pieces(TEXTS[12]) == pieces("") == []
    assert pieces(TEXTS[4]) == [("name", "Hans-Peter Holmvad")] and pieces(TEXTS[8]) == [("name", "L. Fladmark")]
    assert pieces(TEXTS[5]) == [("address", "0124 Regareby")] and pieces(TEXTS[6]) == [("address", "Sønderhøj Allé 52 B")]
    assert pieces(TEXTS[7]) == [("name", "Svinbæk")]


def test_plant_context_votes_against():
    assert [v[3] for k, a, b, v, f in spans(TEXTS[9], GAZ) if TEXTS[9][a:b] == "Rav"] == [-1]


def test_redaction_keeps_the_rest():
    assert redact(TEXTS[1], find(TEXTS[1], MODEL, GAZ)) == "Du kan ringe til [NAME] på [PHONE] eller skrive til [EMAIL]."


def test_reliabilities_learn_a_bad_labeler():
    patterns = Counter({(1, (1, 1, 1)): 400, (1, (-1, -1, 1)): 400, (1, (0, 0, 1)): 20, (1, (1, 0, -1)): 30})
    p = reliabilities(patterns)
    assert p[(1, (1, 0, -1))] > p[(1, (0, 0, 1))]


def test_long_text_and_frame(spark):
    assert len(find(TEXTS[0] * 2000, MODEL, GAZ)) >= 7999
    rows = [(1, [TEXTS[0], None, ""], [[TEXTS[5]], None], "x")] * 2 + [(2, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, p array<string>, text_nodes array<array<string>>, kind string")
    got = sorted(tuple(r) for r in personal_spans(df, models=(MODEL, GAZ)).drop("end_pos").collect())
    assert got == [(1, "p", 0, 0, 5, "phone"), (1, "p", 0, 0, 33, "name"), (1, "p", 0, 0, 65, "name"), (1, "p", 0, 0, 80, "address"), (1, "text_nodes", 0, 0, 0, "address")]
    assert personal_spans(df, models=(MODEL, GAZ), redacted=True).count() == 2
    assert personal_spans(df.limit(0)).count() == 0


def test_spellings_of_all_pages_count(spark):
    # by-lines and common words stand outside the one page that the classifier is fitted on
    rows = [(i, ["By Velkro Holmvad", "The driver paints"], [["By Paints Ravn"], None]) for i in range(4)] + [(i, ["Paints", "it paints"], None) for i in range(10, 18)]
    rows += [(20, ["a gardener"], None)] * 9 + [(30 + i, ["Gardener", None, ""], None) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, p array<string>, text_nodes array<array<string>>")
    gaz = fit_personal(df, None, pages=1)[1]
    assert gaz.given == {"velkro"} and gaz.common == {"it", "paints"}  # paints is mostly written small; page 20 counts once
    assert gazetteer(None, df, pages=15).common == {"it", "paints"} and gazetteer(None, df, pages=5).common == set()  # 15 pages: a rate, not a number
    assert gazetteer(None, df.limit(0)).common == set()
