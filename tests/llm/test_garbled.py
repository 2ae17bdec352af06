from collections import Counter

import pytest

from pagemill.llm.garbled import Model, fit_encodings, garbled, restore, restore_segment
from pagemill.llm.pages import Memo

CLEAN = {
    "da": ["Chaufføren måler den blå dør ved åen. Vores værksted sælger træhylder.", "Naboen rengør loftslampen før den første nattefrost."] * 3,
    "ru": ["Мой сосед продаёт деревянные полки. Садовник красит синюю дверь.", "Портовая контора хранит «зимние» шины."] * 3,
    "en": ["The café owner’s résumé of it was naïve. It’s around 40 €, maybe £35 … “official” — 3½ turns at 20 °C."] * 3,
}
MODEL = Model(CLEAN, Counter("øåæéïёСМойсеПрдавянклищюьуцхзнбгы«»’“”€£…—½°") + Counter("øåæéïёСМойсеПрдавянклищюьуцхзнбгы«»’“”€£…—½°"), 12)
MODEL.segment = Memo(lambda t: restore_segment(t, MODEL))


@pytest.mark.parametrize("text", ["Chaufføren sælger den blå dør ved åen.", "Садовник продаёт синюю дверь.", "It’s “official”, maybe £35 …"])
@pytest.mark.parametrize("wrong", ["cp1252", "cp437", "mac_roman", "cp1251"])
def test_utf8_read_as_something_else(text, wrong):
    bad = text.encode().decode(wrong, "ignore")
    if bad.encode(wrong) != text.encode():
        pytest.skip("not invertible")
    assert restore(bad, MODEL)[0] == text and restore(text, MODEL) == (text, (), False)


def test_crossed_partial_double_and_lost():
    assert restore("Садовник красит синюю дверь.".encode("cp1251").decode("cp1252"), MODEL)[0] == "Садовник красит синюю дверь."
    twice = "naïve café".encode().decode("latin_1").encode().decode("latin_1")
    assert restore(twice, MODEL)[0] == "naïve café"
    mixed = "> " + "Садовник".encode().decode("cp1252", "ignore") + "\nNaboen rengør loftslampen."
    assert restore("> dÃ¸r\nNaboen rengør loftslampen.", MODEL)[0] == "> dør\nNaboen rengør loftslampen." and mixed
    assert restore("b�rn", MODEL) == ("b�rn", (), True)


def test_letters_read_as_common_marks():
    german = Model(CLEAN | {"de": ["Im März ist das Café schön und das Gärtchen größer als der schöne Hof. Der Käufer möchte im März ins Café."] * 3}, Counter("øåæéïäöüß" * 2), 12)
    german.segment = Memo(lambda t: restore_segment(t, german))
    for text in ("Im März ist das Café schön und", "Der Käufer möchte im März ins Café."):
        for right in ("cp437", "cp850"):
            bad = text.encode(right).decode("cp1252")
            assert restore(bad, german)[0] == text, bad
        assert restore(text, german) == (text, (), False)


def test_no_cases():
    for text in ("", "plain &eacute; text", "NÃO É ISSO", "«Портовая контора»", "„Садовник“ …", "S. Ångström på Österåen", "3½ at 20 °C"):
        assert restore(text, MODEL) == (text, (), False), text
    assert restore("The café owner’s résumé. " * 20_000, MODEL)[1] == ()


def test_no_text_becomes_characters_that_do_not_exist():
    ukrainian = Model({"uk": ["Наша майстерня продає дерев'яні полиці. Сусід фарбує сині двері."] * 6}, Counter("НашамйстерняподєвіолицСуіфбдх" * 2), 12)
    text = "Нову лампу купили для всієї вулиці."  # four of its letters are the bytes of an unassigned character
    assert restore_segment(text, ukrainian) == (text, ())


def test_frame(spark):
    rows = [(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, v in CLEAN.items() for t in v * 4)]
    rows += [(90, "Chauffører sælger dÃ¸r.", "da"), (90, "Chauffører sælger dÃ¸r.", "da"), (91, None, None), (92, "", "da"), (None, "naÃ¯ve", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = garbled(df)
    assert {(r.doc_id, r.restored) for r in got.collect()} == {(90, "Chauffører sælger dør."), (None, "naïve")} and got.count() == 2
    assert garbled(df.limit(0)).count() == 0
