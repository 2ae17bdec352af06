"""Personal data in free text: labelers vote on candidate spans, their reliabilities are learnt, a classifier decides.

Patterns propose spans of five kinds. For each span, regex, gazetteer and context labelers vote +1, 0 or -1.
Expectation-maximisation over the vote patterns of a bounded sample estimates how reliable each labeler is and how likely each
span is personal data; a maximum-entropy classifier over votes, shape and neighbouring words is trained on these probabilities
and applied to every span of every text. Given names and surnames come from a table of parsed names, by count; how words are
written and who is named in by-lines is counted over all pages.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import maxent
from pagemill.llm.pages import Memo, elements, field_name, sample_pages
from pagemill.packing import map_units, unpack
from pagemill.sources.tables import cut, discard

KINDS = ("email", "phone", "id_number", "address", "name")

# Words that stand before or in personal data, by kind.
TITLES = set("mr mrs ms miss dr prof hr fr fru frau herr fräulein frøken fröken mme mlle madame monsieur sr sra srta dra don doña señor señora sig dott dhr mevr meneer mevrouw sir lady lord dr.in д-р г-н г-жа пан пані د".split())
PARTICLES = set("von van der den de la del di da dos du le af av zu zum ten ter".split())
FIRMS = re.compile(r"\s*(?:A/S|ApS|GmbH|AG|AB|BV|Ltd|Inc|LLC|Co\b|& Co|S\.?A\b|S\.?L\b|SRL|Oy|KG|reception)")
PLANTS = set("hedder heißt heter rosen rose sorte oder jam plum apfel æblet äpplet variety variedad variété rosa".split())
CALL = re.compile(r"(?i)(?:tel|tél|tlf|fon|phone|mobil|telefon\w*|teléfono|telefone|телефон|ring\w*|rufen|call|llame|llamar|appelez|joindre|bel\w*|ligar|ligue|chiam\w*|reach|erreichen|звон\w*|телефонуйте|номер\w*|拨打|电话|電話|โทร\w*|هاتف|اتصل)(?![A-Za-z])[^\d@]{0,60}$")
NUMBERED = re.compile(r"(?i)(?:isbn|issn|ean|varenr|art(?:ikel)?\.?-?nr|ordre\w*|order|bestellung|pedido|commande|bestelling|ordine|encomenda|beställning\w*|заказ\w*|замовлення|faktura\w*|invoice|factura|facture|rechnung|factuur|fattura|fatura|счет\w*|рахун\w*|cvr|vat|moms|hrb|org|version|versie|версия|no\.|nr\.|№)\W{0,3}(?:nr\.?\W*|no\.?\W*)?$")
IDENTITY = re.compile(r"(?i)(?:cpr(?:-nr)?|ssn|dni|nie|nif|pas(?:s|sport|port|aporte|eport)?|personnummer|personnr|social security|identity|id-?(?:nr|no|kort|card)?|bsn|rg|cpf|инн|паспорт\w*|codice fiscale|steuer-?id|ausweis)\W{0,3}(?:nr|no|number|nummer|num|número)?\W{0,3}$")
MAIL = re.compile(r"(?i)(?:mail\w*|skriv\w*|write|schreiben|escrib\w+|écri\w+|scriv\w+|escrev\w+|schrijf|пиш\w+|naar|to|an|at|à|a|质问|写信到|质|ご質問は|问题请写信到)\W{0,3}$")
ASK = set("by af av von por par di door til till to an a al à naar ask for after efter nach por per para om auf ud junto con bij bei för pour de reach kan ringe ringa erreichen llamar joindre chiamare ligar kunt blev was er är est es fragen demandez pregunte spørg звоните телефонуйте для стал автор lists with med mit avec con com met и і 联系 当選者は 聯繫".split())

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_AT = r"(?:\s?@\s?|\s?[(\[{]\s?(?:at|AT|ät|snabela|arroba|chez)\s?[)\]}]\s?|\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s))"
_DOT = r"(?:\.|\s?[(\[{]\s?(?:dot|DOT|punkt|punto|point|ponto)\s?[)\]}]\s?|\s(?:dot|DOT)\s)"
_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+'-]*{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"(?<![A-Za-z0-9.+(/-])(?:\+\s?|\()?\d(?:[ ()./-]{0,2}\d){6,14}(?![\d-])")
_SHAPES = re.compile(r"(?:(?:\+|00)\d{1,3}[ ./-]?(?:\(\d{1,4}\)[ ./-]?)?\d(?:[ ./-]?\d){5,11}|\(0\d{2,5}\) ?\d{3,4}[ -]?\d{2,4}|\d{2}([ .])\d{2}\1\d{2}\1\d{2}(?:\1\d{2})?|\d{3}[-.]\d{4}|\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}|0\d{1,4}[/ -]\d{5,9})")
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}[-./]\d{1,2}[-./]\d{4}")
_ID = re.compile(r"(?<![A-Za-z0-9.+/-])(?:\d{6}[- ]\d{4}|\d{10,11}|\d{3}-\d{2}-\d{4}|\d{8}-?[A-Z]|[A-Z]{1,2}-?\d{6,8}|\d{9})(?![\w-]*\d|[A-Za-z])")
_ID_SHAPE = re.compile(r"\d{6}-\d{4}|\d{3}-\d{2}-\d{4}|\d{8}-?[A-Z]|[A-Z]{2}\d{7}|\d{10}")
_CAP = rf"[A-ZÀ-ÖØ-Þ][{_L}’']*\.?"
_POST = rf"(?:\d{{4,5}}(?: [A-Z]{{2}})? [A-ZÀ-ÖØ-Þ][{_L}-]+|[A-ZÀ-ÖØ-Þ][{_L}-]+,? [A-Z]{{1,2}}\d[A-Z\d]? \d[A-Z]{{2}})"
#: What street names end with, begin with, or hold as a word of their own.
_TYPE_END = r"(?:vej|gade|stræde|sti|stien|allé|torv|plads|have|gatan|gata|vägen|väg|stigen|gränd|torget|straße|strasse|gasse|weg|platz|allee|ufer|damm|straat|laan|kade|plein|gracht|steeg|dijk)"
_TYPE_WORD = r"(?:Allé|Alle|Street|Row|Lane|Close|Road|Avenue|Court|Drive|Way|Square|Terrace|Place|Gardens|Hill|Vej|Gade|Stræde|Sti|Torv|Plads|Väg|Gata|Stig|Kade|Straat|Laan|Weg|Plein|Straße|Platz|Allee|Gasse|Ufer)"
_TYPE_FIRST = r"(?:Calle|Avenida|Plaza|Paseo|Camino|Rua|Travessa|Largo|Praça|Via|Viale|Piazza|Corso|Vicolo|Rue|Place|Boulevard|Chemin|Impasse|вул\.|ул\.)"
_EARLY = r"(?:Gl\.|Gamle|Ny|Nørre|Sønder|Søndre|Øster|Vester|Store|Lille|Alte|Alter|Neue|Neuer|Große|Kleine|Obere|Untere|Am|Oude|Nieuwe|Grote|Norra|Södra|Östra|Västra|Gamla|Nya|Stora|Lilla|Old|New|North|South|East|West|Upper|Lower)"
_STREET = rf"(?:(?:{_EARLY} )?[A-ZÀ-ÖØ-Þ][{_L}-]*{_TYPE_END}|(?:{_EARLY} )?[A-ZÀ-ÖØ-Þ][{_L}-]+ {_TYPE_WORD}|{_EARLY} {_TYPE_WORD}|{_TYPE_FIRST}(?: (?:de|del|della|do|da|dos|das|des|du|la|las|los|el|l')){{0,2}} ?[A-ZÀ-ÖØ-ÞА-Я][{_L}а-яіїє-]+)"
_UNIT = r"(?: [A-Z]\b)?(?:, ?\d{1,2}\. ?(?:th|tv|mf|sal|OG|Stock)\.?| ?(?:,? (?:Unit|Flat|Apt\.?|Suite|Wohnung|Lgh|lgh|Piso|piso) ?\w{1,3}\b))?"
_STREET_FIRST = re.compile(rf"(?<![{_L}’])(?P<street>{_STREET}) (?P<number>\d{{1,3}}){_UNIT}(?![\d.]*\d)(?:,? (?P<post>{_POST}))?")
_NUMBER_FIRST = re.compile(rf"(?<![{_L}\d.,/-])(?P<number>\d{{1,3}})(?:,? (?P<street>(?:rue|impasse|avenue|boulevard|place|chemin|allée|quai)(?: (?:de|du|des|la|l'))*(?: ?[A-ZÀ-ÖØ-Þ][{_L}-]+)+?)| (?P<street2>(?:{_EARLY} )?[A-ZÀ-ÖØ-Þ][{_L}-]+ {_TYPE_WORD}))(?![{_L}]){_UNIT}(?:,? (?P<post>{_POST}))?")
_OTHER = re.compile(rf"(?<=, )(?P<street>(?:{_CAP} ){{0,2}}{_CAP}) (?P<number>\d{{1,3}}){_UNIT}, (?P<post>\d{{4,5}} {_CAP})")
_TOWN = re.compile(_POST)
#: Letters of scripts that part words by spaces; a token keeps to one script.
_SCRIPTS = (_L, "Ѐ-ӿ", "Ͱ-Ͽἀ-῿", "؀-ۿ", "\u0590-\u05ff", "ऀ-ॿ")
_TOKEN = re.compile("|".join(rf"[{x}][{x}’']*(?:-[{x}][{x}’']*)*\.?" for x in _SCRIPTS))
_LINE = re.compile(r"(?i)^(?:by|af|av|von|por|par|di|da|door|автор|от|від|文|作者|โดย|بقلم|text|foto|photo)\b\W{0,2}")


#: Titles in other scripts.
_OTHER_TITLE = re.compile(r"(?:^|\s)(?:د|أ|السيد|السيدة|الدكتور|д-р|г-н|г-жа|проф|пан|пані)\.?\s$")


class Gazetteer:
    """Given names, surnames and common small words, as sets of small letters."""

    def __init__(self, given: set[str], surnames: set[str], common: set[str]):
        self.given, self.surnames, self.common = given, surnames, common


def _cap(t: str) -> bool:
    return t[0].isupper()


def _initial(t: str) -> bool:
    return len(t) == 2 and t[1] == "." and t[0].isupper()


def name_spans(text: str, gaz: Gazetteer) -> list[tuple[int, int, str]]:
    """(start, end, how) of candidate names; how: given, initial, comma, title, line."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    out: list[tuple[int, int, str]] = []
    i, n, done = 0, len(tokens), -1
    gap = lambda a: text[tokens[a][1] : tokens[a + 1][0]]
    bare = lambda t: t.rstrip(".").lower()
    title_at = lambda k: k >= 0 and bare(tokens[k][2]) in TITLES and text[tokens[k][1] : tokens[k + 1][0]].isspace()
    line = _LINE.match(text)

    def surname(k: int, small: bool) -> int:
        """The index after a surname that begins at k, particles included, else -1."""
        while k < n and tokens[k][2] in PARTICLES or k < n and small is False and tokens[k][2].lower() in PARTICLES and tokens[k][2].isupper():
            if k + 1 >= n or not gap(k).isspace():
                return -1
            k += 1
        if k >= n:
            return -1
        t = tokens[k][2].rstrip(".")
        if len(t) < 2 or (not _cap(t) and not (small and (t in gaz.surnames or (len(t) > 4 and t not in gaz.common)))):
            return -1
        return k + 1

    while i < n:
        start, end, t = tokens[i]
        if start < done:
            i += 1
            continue
        low = bare(t)
        if i + 1 < n and text[end : tokens[i + 1][0]].strip() == "," and _cap(t) and len(t) > 2 and not t.endswith(".") and low not in gaz.given or i + 1 < n and gap(i).strip() == "," and low in gaz.surnames:
            nxt = tokens[i + 1]
            k = i
            while k > 0 and tokens[k - 1][2] in PARTICLES and gap(k - 1).isspace():
                k -= 1
            if (bare(nxt[2]) in gaz.given or _initial(nxt[2]) and low in gaz.surnames) and (not out or tokens[k][0] >= out[-1][1]) and not (i and re.fullmatch(r"\s+", gap(i - 1)) and bare(tokens[i - 1][2]) in gaz.given):
                k2 = i + 1
                while k2 + 1 < n and gap(k2).isspace() and (_initial(tokens[k2 + 1][2]) or bare(tokens[k2 + 1][2]) in gaz.given):
                    k2 += 1
                out.append((tokens[k][0], tokens[k2][1], "comma"))
                done = tokens[k2][1]
                i = k2 + 1
                continue
        if low in gaz.given and not t.endswith(".") or _initial(t):
            k, small = i + 1, not _cap(t)
            if _initial(t) and low == "m" and i and text[max(0, start - 6) : start].lower().endswith(("avec ", " et ")):
                small = None
            while small is not None and k < n and gap(k - 1).isspace() and (_initial(tokens[k][2]) or bare(tokens[k][2]) in gaz.given and not tokens[k][2].endswith(".")) and k + 1 < n and gap(k).isspace() and surname(k + 1, small) > 0:
                k += 1
            if small is None:
                pass
            elif k < n and gap(k - 1).isspace() and (stop := surname(k, small)) > 0:
                out.append((start, tokens[stop - 1][1], "initial" if _initial(t) else "given"))
                done, i = tokens[stop - 1][1], stop
                continue
        foreign = _OTHER_TITLE.search(text[max(0, start - 9) : start])
        if foreign and (stop := surname(i, False)) > 0:
            out.append((start, tokens[stop - 1][1], "title"))
            done, i = tokens[stop - 1][1], stop
            continue
        if (title_at(i - 1) or i and bare(tokens[i - 1][2]) == "m" and tokens[i - 1][2] == "M." and gap(i - 1).isspace() and re.search(r"(?:avec|et) M\.\s$", text[max(0, start - 9) : start])) and gap(i - 1).isspace() and (stop := surname(i, False)) > 0:
            out.append((start, tokens[stop - 1][1], "title"))
            done, i = tokens[stop - 1][1], stop
            continue
        if line and start == line.end() and _cap(t) and i + 1 < n and gap(i).isspace() and (stop := surname(i + 1, False)) > 0 and text[tokens[stop - 1][1] :].strip() == "":
            out.append((start, tokens[stop - 1][1], "line"))
            done, i = tokens[stop - 1][1], stop
            continue
        i += 1
    return [(a, b - (text[b - 1] == "." and text[b - 2 : b - 1].islower()), how) for a, b, how in out]


def _word_before(text: str, at: int) -> str:
    found = re.search(r"([^\s.,:;()]+)[\s.:,(]*$", text[max(0, at - 30) : at])
    return found[1].lower() if found else ""


def _word_after(text: str, at: int) -> str:
    found = re.match(r"[\s,.;:)]*([^\s.,;:)]+)", text[at : at + 30])
    return found[1].lower() if found else ""


def _for(sign) -> int:
    """The vote of a labeler that can only speak for a span."""
    return 1 if sign else 0


def _against(sign) -> int:
    """The vote of a labeler that can only speak against a span."""
    return -1 if sign else 0


def _either(sign) -> int:
    """The vote of a labeler that always speaks."""
    return 1 if sign else -1


def spans(text: str, gaz: Gazetteer) -> list[tuple[int, int, int, tuple[int, ...], list[str]]]:
    """Candidate spans of a text as (kind, start, end, votes, features); the kind by its place in KINDS."""
    out = []

    def add(kind: int, start: int, end: int, *votes: int) -> None:
        before, after = _word_before(text, start), _word_after(text, end)
        k = KINDS[kind][:2]
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "9", text[start:end])))[:16]
        features = [f"{k}v{i}{v}" for i, v in enumerate(votes)] + [f"{k}p{sum(votes)}", k + "<" + before, k + ">" + after, k + "s" + shape, k]
        out.append((kind, start, end, votes, features))

    if "@" in text or " at " in text.lower() or "at)" in text.lower() or "at]" in text.lower():
        for m in _EMAIL.finditer(text):
            start = m.start()
            own = m[0]
            plain = bool(re.fullmatch(r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9.-]+", own))
            add(
                0, start, m.end(),
                _for(plain or "dot" in own.lower() or re.search(r"\s@\s", own)),
                _for(plain or re.search(r"[(\[{]", own)),
                _for(MAIL.search(text[:start][-30:])),
                _either(re.search(r"\.[A-Za-z]{2,8}$|dot\W+[A-Za-z]{2,8}$", own)),  # a domain's end
            )
    mails = [(a, b) for _, a, b, _, _ in out]
    free = lambda m: not any(a < m.end() and m.start() < b for a, b in mails)
    if any(map(str.isdigit, text)):
        for m in filter(free, _ID.finditer(text)):
            left = text[max(0, m.start() - 30) : m.start()]
            label = bool(IDENTITY.search(left))
            add(
                2, m.start(), m.end(),
                _either(label),
                _against(NUMBERED.search(left) and not label),
                _either(_ID_SHAPE.fullmatch(m[0])),
                _against(_DATE.fullmatch(m[0])),
                _against(CALL.search(left) and not label),
                _for(re.match(r"[^\d.]{1,14}[A-ZÀ-ÖØ-Þ]", text[m.end() : m.end() + 20])),  # a name follows
            )
        for m in filter(free, _PHONE.finditer(text)):
            left = text[max(0, m.start() - 70) : m.start()]
            near = left[-30:]
            label = bool(IDENTITY.search(near))
            marked = m[0].startswith(("+", "00", "("))
            add(
                1, m.start(), m.end(),
                _either(_SHAPES.fullmatch(m[0])),
                _for(CALL.search(left)),
                _against(NUMBERED.search(near)),
                _against(label),
                _against(_DATE.search(m[0])),
                _against(not marked and re.match(r" [A-ZÀ-ÖØ-Þ]", text[m.end() : m.end() + 2]) and re.search(r"\d{4,5}$", m[0])),  # a postcode before its town
                _for(marked),
            )
        found = [*_STREET_FIRST.finditer(text), *_NUMBER_FIRST.finditer(text)]
        found += [m for m in _OTHER.finditer(text) if not any(a.start() < m.end() and m.start() < a.end() for a in found)]
        taken: list[tuple[int, int]] = []
        for m in sorted(found, key=lambda m: (not m["post"], m.start(), -m.end())):  # the whole address before a part of it
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            left = text[max(0, m.start() - 12) : m.start()]
            if re.search(r"(?i)(?:\bno|\bnr|núm|№|número|numéro)\.?\s$", left):
                continue
            taken.append((m.start(), m.end()))
            alone = not text[: m.start()].strip() and not text[m.end() :].strip(" .,")
            add(
                3, m.start(), m.end(),
                _for(m.re is not _OTHER and (m["post"] or alone or " " in (m["street"] or "a b"))),
                1 if m["post"] else 0 if alone else -1,
                _for(alone),
                _for(re.search(r",\s$", left)),
            )
        core = text.strip(" .,")
        if m := _TOWN.fullmatch(core):
            at = text.find(core)
            add(3, at, at + len(core), 0, 1, 1, 0)
    for start, end, how in name_spans(text, gaz):
        before, after = _word_before(text, start), text[end : end + 14]
        parts = [t.lower() for t in _TOKEN.findall(text[start:end])]
        known = sum(p in gaz.given for p in parts)
        alone = not text[end:].strip(" .") and (not text[:start].strip() or bool(_LINE.match(text)))
        left = {w.lower() for w in re.findall(rf"[{_L}]+", text[max(0, start - 24) : start])}
        add(
            4, start, end,
            1 if known else 0 if how in ("title", "initial") else -1,
            _for(any(p in gaz.surnames for p in parts if p not in gaz.given)),
            _for(before.rstrip(".") in ASK or before.rstrip(".") in TITLES),
            _against(left & PLANTS),
            _against(FIRMS.match(after)),
            _against(re.match(r" \d{1,3}[A-Za-z]?(?!\d|[ .-]\d)", after)),  # a house number
            _for(alone),
            _for(how == "title"),
        )
    return out


def reliabilities(patterns: Counter, rounds: int = 30) -> dict[tuple, float]:
    """Expectation-maximisation over (kind, votes) counts: the probability that a pattern is personal data.

    Votes are independent given the truth; every labeler starts as right more often than wrong (a Dirichlet prior keeps that
    reading of the two classes). Patterns of two or more votes that all agree are anchors: their class is given.
    """
    out: dict[tuple, float] = {}
    for kind in {k for k, _ in patterns}:
        rows = [(v, c) for (k, v), c in patterns.items() if k == kind]
        post = {v: 1 / (1 + math.exp(-1.5 * sum(v))) for v, _ in rows}
        sure = {v: 0.98 if sum(v) > 0 else 0.02 for v in post if abs(sum(v)) >= 2 and len({x for x in v if x}) == 1}
        post |= sure
        for _ in range(rounds):
            prior = (sum(c * post[v] for v, c in rows) + 2) / (sum(c for _, c in rows) + 4)
            width = len(rows[0][0])
            tables = []
            for i in range(width):
                yes, no = {-1: 0.2, 0: 3.0, 1: 3.0}, {-1: 3.0, 0: 3.0, 1: 0.2}
                for v, c in rows:
                    yes[v[i]] += c * post[v]
                    no[v[i]] += c * (1 - post[v])
                tables.append(({k: x / sum(yes.values()) for k, x in yes.items()}, {k: x / sum(no.values()) for k, x in no.items()}))
            for v, _ in rows:
                odds = math.log(prior / (1 - prior)) + sum(math.log(t[0][x] / t[1][x]) for t, x in zip(tables, v))
                post[v] = sure.get(v, 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        out |= {(kind, v): p for v, p in post.items()}
    return out


def fit(texts: list[str], gaz: Gazetteer) -> dict[str, float]:
    """The span classifier, trained on the probabilities that the votes give."""
    found = [s for t in dict.fromkeys(texts) for s in spans(t, gaz)]
    truth = reliabilities(Counter((k, v) for k, _, _, v, _ in found))
    return maxent.fit([f for *_, f in found], [truth[(k, v)] for k, _, _, v, _ in found], epochs=5)


_RUN = re.compile(rf"[{_L}]+")
_SMALL = re.compile(r"[a-zß-öø-ɏ]+")
_BY = re.compile(rf"(?:By|Af|Av|Von|Por|Par) ([A-ZÀ-ÖØ-Þ][{_L}-]+) [A-ZÀ-ÖØ-Þ][{_L}'’-]+$")


def spellings(df: DataFrame) -> DataFrame:
    """(word, small, caps, line): how often the words of all pages are written small, with a capital, and as the given name of a by-line.

    Whole texts are read; repeated deliveries count once. The row of the empty word has the number of pages.
    """

    def make():
        def rows(p, nodes):
            texts = [t for *_, t in elements(p, nodes)]
            small, caps = Counter(), Counter()
            for w, n in Counter(_RUN.findall("\n".join(texts))).items():
                if _SMALL.fullmatch(w):
                    small[w] += n
                elif len(w) > 1 and (w[0] <= "Z" or "À" <= w[0] <= "Þ"):
                    caps[w.lower()] += n
            line = Counter(m[1].lower() for t in texts if (m := _BY.match(t)))
            return [("", 1, 0, 0), *((w, small[w], caps[w], line[w]) for w in {*small, *caps, *line})]

        return rows

    fields = {"word": "string", "small": "int", "caps": "int", "line": "int"}
    words = unpack(map_units(df.select("page_id", "p", "text_nodes"), "page_id", fields, make), "page_id")
    return words.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("small", "caps", "line")])


def gazetteer(names: DataFrame | None, df: DataFrame, given: int = 20_000, surnames: int = 200_000, least: int = 3, pages: int = 1500) -> Gazetteer:
    """The most frequent given names and surnames of a table (at most so many, at least `least` times each); common words of the pages.

    Only these lists reach the driver; the counts run over both whole tables. A word is common that is written small five times in
    `pages` pages, so the list is bounded by what a page holds, and the same in a larger table.
    """
    sets = []
    for column, most in ((F.array("given_name", "middle_name"), given), (F.array("surname"), surnames)):
        if names is None:
            sets.append(set())
            continue
        counts = names.select(F.explode(column).alias("x")).where("x is not null").groupBy(F.lower("x").alias("x")).count()
        rows = counts.where((F.col("count") >= least) & (F.length("x") >= 2)).orderBy(F.desc("count"), "x").limit(most).collect()
        sets.append({p for r in rows if r.x.strip() and not r.x.endswith(".") for p in r.x.split() if p not in PARTICLES and len(p) > 1})
    counted = cut(spellings(df), "spellings")
    times = max(1.0, sum(r.small for r in counted.where("word = ''").collect()) / pages)
    words = counted.where((F.col("word") != "") & ((F.col("small") >= 5 * times) | (F.col("line") >= least))).collect()
    discard(counted)
    sets[0] |= {r.word for r in words if r.line >= least} - PARTICLES
    sets[0] -= {r.word for r in words if r.small >= 10 * times and r.small >= r.caps}  # a word that is mostly written small is none
    return Gazetteer(sets[0], sets[1], {r.word for r in words if r.small >= 5 * times and r.word not in sets[1]})


def fit_personal(df: DataFrame, names: DataFrame | None, pages: int = 1500) -> tuple[dict, Gazetteer]:
    """(classifier, gazetteer): the classifier from a bounded sample of pages (parameter pages), the gazetteer from all pages and names."""
    gaz = gazetteer(names, df)
    return fit([t for r in sample_pages(df, pages, "p", "text_nodes") for *_, t in elements(r.p, r.text_nodes)], gaz), gaz


def find(text: str, model: dict, gaz: Gazetteer) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the personal data of a text in order; of overlapping pieces the one that is surer."""
    sure = sorted(((maxent.score(model, f), k, a, b) for k, a, b, _, f in spans(text, gaz)), key=lambda s: -s[0])
    kept: list[tuple[int, int, int]] = []
    for score, k, a, b in sure:
        if score > 0 and not any(a < y and x < b for x, y, _ in kept):
            kept.append((a, b, k))
    return sorted(kept)


def redact(text: str, found: list[tuple[int, int, int]]) -> str:
    """The text with typed placeholders."""
    out, at = [], 0
    for a, b, k in found:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def personal_spans(df: DataFrame, names: DataFrame | None = None, models: tuple[dict, Gazetteer] | None = None, redacted: bool = False) -> DataFrame:
    """(page_id, field, pos, item, start_pos, end_pos, kind) of personal data in p and text_nodes.

    redacted: instead (page_id, field, pos, item, text) of the elements that hold any, with placeholders. Null or empty elements
    give nothing; whole texts are read; other columns aren't; repeated deliveries count once.
    """
    models = models or fit_personal(df, names)
    shared = df.sparkSession.sparkContext.broadcast(models)  # bounded by the sample and the gazetteer's limits

    def make():
        model, gaz = shared.value
        found = Memo(lambda text: find(text, model, gaz))
        if redacted:
            return lambda p, nodes: [(f, i, k, redact(t, s)) for f, i, k, t in elements(p, nodes) if (s := found[t])]
        return lambda p, nodes: [(f, i, k, *s) for f, i, k, t in elements(p, nodes) for s in found[t]]

    fields = {"field": "smallint", "pos": "int", "item": "int"} | ({"text": "string"} if redacted else {"start_pos": "int", "end_pos": "int", "kind": "smallint"})
    out = unpack(map_units(df.select("page_id", "p", "text_nodes"), "page_id", fields, make), "page_id").withColumn("field", field_name())
    return out if redacted else out.withColumn("kind", F.get(F.array(*map(F.lit, KINDS)), F.col("kind").cast("int")))
