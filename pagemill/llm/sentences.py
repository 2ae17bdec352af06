"""Sentence units: candidate boundaries, each classified by a maximum-entropy model trained on reliable boundaries.

Candidates stand after closing punctuation (with its marks and brackets) and, in Thai, at spaces; those inside a quotation
or bracket aren't candidates. Reliable for training: an element's end together with another element's start (boundary), a
full stop before a small letter and places inside a sentence (none). Each example is also given with only its left and only
its right features, so that the model learns abbreviations and sentence openers separately. A token's own history is a feature
too: whether it ends (opens) elements of the sample at all, or stands only before (after) candidates. Where only a known opener can
begin a unit, the openers of all pages count: elements that ask for one are held back and joined to them by token.
"""

from __future__ import annotations

import functools
import os
import random
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import maxent
from pagemill.llm.pages import Memo, elements, field_name, sample_pages
from pagemill.packing import map_units, once, unpack
from pagemill.sources.tables import cut

STOPS = ".!?…。！？؟۔।｡"
WIDE = "。！？｡"
OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "‚": "‘’", "«": "»", "»": "«", "「": "」", "『": "』", "（": "）", "《": "》", "‘": "’", "”": "”", "‹": "›", "›": "‹", "【": "】"}
CLOSERS = "\"'”“’‘»«›‹)]}」』）》】"
_STOP = re.compile(rf"[{re.escape(STOPS)}]+[{re.escape(CLOSERS)}]*(?:\s[»”]+(?=\s|$))?")
_THAI = "฀-๿"
_THAI_GAP = re.compile(rf"(?<=[{_THAI}\w.”“\"»)]) +(?=[{_THAI}“\"«(])")
_THAI_ANY = re.compile(f"[{_THAI}]")
_CONTACT = re.compile(r"(?i)(?:^|\s)(?:tel|telefon|telefoon|telefono|teléfono|telefone|tél|tlf|phone|fon|e-?mail|mail|mobil)\b\s*\.?\s*:")
_MARK = re.compile(rf"[{re.escape(STOPS)}\"'“”„‚‘’«»‹›「」『』()\[\]{{}}（）《》【】]")


def spans(text: str) -> list[tuple[int, int]]:
    """Outermost quotations and brackets as (start, end); unpaired marks open nothing."""
    out, i, n = [], 0, len(text)
    marks = [m.start() for m in _MARK.finditer(text) if text[m.start()] not in STOPS]
    k = 0
    while k < len(marks):
        i = marks[k]
        c = text[i]
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < n else " "
        opens = c in OPEN or c in "\"'"
        if c in "\"'’‘»«”“‹›" and before.isalnum() and not _cjk(before):
            opens = False  # an apostrophe or a closing mark
        if c in "»›" and (before.isspace() and after.isspace() or i + 1 == n):
            opens = False
        if c in "’'" and not (after.isalnum() or after in "¿¡"):
            opens = False
        end = -1
        if opens:
            closing = OPEN.get(c, c)
            depth = 1
            for j in marks[k + 1 :]:
                d = text[j]
                if d in closing:
                    if d in "'’" and j + 1 < n and text[j + 1].isalnum():
                        continue
                    depth -= 1
                    if not depth:
                        end = j + 1
                        break
                elif d == c and d not in "\"'" and closing != d:
                    depth += 1
        if end > 0:
            out.append((i, end))
            while k < len(marks) and marks[k] < end:
                k += 1
        else:
            k += 1
    return out


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "＀" <= c <= "￯" or "　" <= c <= "〿"


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _run_on(text: str, start: int, end: int) -> bool:
    """Whether a unit may end at a stop without a space after it: a small letter or sign before, a capital after, in no address."""
    before, after, more = text[start - 1 : start], text[end], text[end + 1 : end + 2]
    if before.islower() or before in ("²", "³", ")", "%") or before.isdigit():
        if not (after.isupper() and (more.islower() or more.isspace() or more in ("'", "’") or text[end : end + 3].isupper() and text[end : end + 3].isalpha())):
            return False
    elif not (before.isalpha() and after.isalpha() and _kind(before) == _kind(after) == "x"):
        return False
    token = re.search(r"\S*$", text[:start])[0] + re.match(r"\S*", text[start:])[0]
    return "@" not in token and "/" not in token


def candidates(text: str) -> list[tuple[int, int]]:
    """Candidate boundaries as (end of the unit before, start of the unit after)."""
    n = len(text.rstrip())
    closed = spans(text) if _MARK.search(text) else []
    out, at = [], 0
    gaps = [(m.start(), m.end()) for m in _THAI_GAP.finditer(text, 0, n) if _thai(text[m.start() - 1]) or _thai(text[m.end()]) or text[m.end()] in "“\"«("] if _THAI_ANY.search(text) else []
    found = [(m.start(), m.end()) for m in _STOP.finditer(text, 0, n)]
    for start, end in found:
        while at < len(closed) and closed[at][1] <= start:
            at += 1
        if at < len(closed) and closed[at][0] <= start < closed[at][1]:
            if end < closed[at][1]:
                continue
            end = closed[at][1]
        k = end
        while k < n and text[k].isspace():
            k += 1
        if k == end < n and text[start] in ".!?؟" and _run_on(text, start, end):
            out.append((end, k))  # the space is missing
            continue
        if k >= n or (k == end and not (_cjk(text[end]) or text[end - 1] in WIDE or text[start] in WIDE or _cjk(text[end - 1]))):
            continue
        out.append((end, k))
    for start, end in gaps:
        if not any(a < start < b for a, b in closed) and all(e != start for e, _ in out):
            out.append((start, end))
    return sorted(set(out))


def _kind(c: str) -> str:
    if c.isdigit():
        return "d"
    if c.isalpha():
        if _thai(c):
            return "th"
        if _cjk(c):
            return "cjk"
        return "A" if c.isupper() else "a" if c.islower() else "x"
    return "th" if _thai(c) else c if ord(c) < 0x2000 else unicodedata.category(c)


_LEFT = re.compile(r"(\S+?)(\s*)$")
_WORD = re.compile(r"[^\W\d_]+(?:[.'’-][^\W\d_]+)*|\d+")


def _holder(word: str) -> str:
    """What a single capital stands after: a number or a unit of a house, or a word such as a given name."""
    return "u" if word.lower() in ("unit", "flat", "apt", "suite", "block", "type", "model", "plan") else _kind(word[0])


def _left_key(text: str, end: int) -> str:
    token = (text[max(0, end - 60) : end].split() or [""])[-1]
    core = token.rstrip(CLOSERS)
    word = core.rstrip(STOPS)
    if not word.isascii() and any(_cjk(c) or _thai(c) for c in word[-3:]):
        return word[-3:] + core[len(word) :][-1:]
    if len(word) == 1 and word.isupper():  # a house's letter or an initial
        word += _holder((text[max(0, end - 60) : end - len(token)].split() or ["-"])[-1])
    return re.sub(r"\d", "9", word) + core[len(core.rstrip(STOPS)) :][-1:] + ("q" if len(core) < len(token) else "")


def _right_key(text: str, start: int) -> str:
    core = text[start : start + 40].lstrip(_OPENING)
    if core and (_thai(core[0]) or _cjk(core[0])):
        return core[: 5 if _thai(core[0]) else 2]
    return re.sub(r"\d", "9", (core.split() or [""])[0].rstrip(",.;:!?…»”\"'"))


_OPENING = "\"'“”„‚‘’«»‹›「『(（[  ¿¡"


def histories(texts: list[str]) -> tuple[Counter, Counter, Counter, Counter, set]:
    """How often tokens end elements, stand before candidates, open elements, stand after candidates or inside a sentence; the latter apart."""
    ends, before, opens, after, inside = Counter(), Counter(), Counter(), Counter(), set()
    for text in texts:
        ends[_left_key(t := text if text[-1] in STOPS + CLOSERS or _thai(text[-1]) else text + ".", len(t))] += 1
        opens[_right_key(text, 0)] += 1
        for end, start in candidates(text):
            before[_left_key(text, end)] += 1
            after[_right_key(text, start)] += 1
        for m in re.finditer(r"(?<=[^\s.!?…。！？؟]) (?=[^\W\d_a-zà-öø-ÿа-я])", text):
            if not (_thai(text[m.start() - 1]) and _thai(text[m.end()])):
                after[key := _right_key(text, m.end())] += 1
                inside.add(key)
    return ends, before, opens, after, inside


def _history(good: int, bad: int) -> str:
    return "e" if good else "n" if bad >= 2 else "u"


def _wordlike(word: str) -> str:
    """'w' for what looks like a whole word: four letters or more, no stop inside, a vowel among the last two."""
    return "w" if len(word) >= 4 and word.isalpha() and re.search(r"[aeiouyæøåäöüéèêíóúáàâãõаеёиоуыэюяіїє]", word[-2:].lower()) else "-"


def left_features(text: str, end: int, floor: int = 0, history: str = "u") -> list[str]:
    """Of the token before a boundary: itself, its shape and length, the stop and the marks after it, its history."""
    body = text[max(floor, end - 60) : end]
    token = body.split()[-1] if body.split() else ""
    return list(_token_features(token, (body[: len(body) - len(token)].split() or [""])[-1], history))


@functools.lru_cache(20_000)  # tokens repeat
def _token_features(token: str, before: str, history: str) -> list[str]:
    core = token.rstrip(CLOSERS)
    stop = core[len(core.rstrip(STOPS)) :]
    word = core.rstrip(STOPS)
    closed = "q" if len(core) < len(token) else ""
    if not word.isascii() and any(_cjk(c) or _thai(c) for c in word[-3:]):
        return ["L" + word[-2:] + stop, "L3" + word[-4:], "Ls" + stop[-1:] + closed, "Lt" + _kind(word[-1:] or " "), "Lx" + history]
    shape = re.sub(r"[A-ZÀ-ÖØ-ÞА-Я]", "A", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word))
    shape = re.sub(r"(.)\1{3,}", r"\1\1\1\1", re.sub(r"\d", "9", shape))[:10]
    pair = ["Lp" + _kind(before[:1] or "-") + ("1" if len(word) == 1 and word.isupper() else "")]
    pair += ["Lv" + _wordlike(word) + history]
    if len(word) == 1 and word.isupper():
        word += _holder(before or "-")  # a house's letter or an initial
    return pair + ["L" + word + stop + closed, "Ls" + stop[-1:] + closed, "Lx" + history, f"Ll{min(len(word), 5)}" + stop[-1:], "Lh" + shape + stop[-1:], "Ld" * any(c.isdigit() for c in word) + "L."]


def right_features(text: str, start: int, history: str = "u") -> list[str]:
    """Of the text after a boundary: its first token, case, digits, script, opening mark and history."""
    body = text[start : start + 40]
    core = body.lstrip("\"'“”„‚‘’«»‹›「『(（[  ¿¡")
    opened = "o" if len(core) < len(body) else ""
    if not core:
        return ["R", "Ro" + opened]
    k = _kind(core[0])
    if k in ("th", "cjk"):
        return ["R" + core[:n] for n in ((1, 2, 4) if k == "cjk" else (3, 5, 8))] + ["Rk" + k + opened, "Rx" + history + k]
    words = core.split()
    first = words[0].rstrip(",.;:!?…»”\"'")
    out = ["R" + first, "Rk" + k + opened, "Rx" + history + k]
    if k == "A":
        out.append("RA" + ("A" if first.isupper() and len(first) > 1 else "a") + ("d" if any(c.isdigit() for c in first) else ""))
    if len(words) > 1:
        out.append("R2" + _kind(words[1][0]) + k)
    return out


def surroundings(text: str, floor: int, end: int, start: int) -> list[str]:
    """What the unit before a boundary and the text after it say of their kind: a line of rights, labels of contact."""
    out = ["Ur"] if text[floor : floor + 9].lstrip()[:1] == "©" else []
    if ":" not in text:  # no label of contact is without
        return out
    before, after = bool(_CONTACT.search(text, floor, end)), bool(_CONTACT.search(text, start, start + 120))
    return out + ["Uc" + "b" * before + "a" * after] * (before or after)


def one_unit(text: str) -> bool:
    """Whether a text is surely a line of rights or contact: it begins with the sign, or its last word is an address behind its label."""
    return text.lstrip()[:1] == "©" or bool(_CONTACT.search(text) and re.search(r"\d{3}", text) and "@" in text and not re.search(r"[!?]", text) and _LABELLED.search(text))


def _both(left: list[str], right: list[str], around: list[str]) -> list[str]:
    return [*left, *right, *around, "B" + next(x for x in left if x[:2] == "Ls") + right[min(1, len(right) - 1)], "X" + "".join(x for x in (*left, *right) if x[:2] in ("Lx", "Rx"))]


def _prose(text: str) -> bool:
    return len(text) >= 25 and not _CONTACT.search(text) and "©" not in text


def opener(text: str) -> str:
    """The token that an element of running text opens with, of others ''."""
    return _right_key(t, 0) if _prose(t := text.strip()) else ""


def examples(texts: list[str], seed: int = 11) -> tuple[list[list[str]], list[float], dict[str, float]]:
    """Reliable boundaries and non-boundaries of the given elements as features and labels; the histories of their tokens."""
    rng = random.Random(seed)
    rows, labels = [], []
    prose = [t for t in dict.fromkeys(x.strip() for x in texts) if len(t) <= 4000 and _prose(t)]
    ends, before, opens, after, inside = histories(prose)

    def left(text, end, own=0):  # an example doesn't count for its own history
        key = _left_key(text, end)
        return left_features(text, end, 0, _history(ends[key] - own, before[key] - (1 - own)))

    def right(text, start, own=0):
        key = _right_key(text, start)
        return right_features(text, start, _history(opens[key] - own, after[key] - (1 - own)))

    def add(left, right, label, around=()):
        for r in (_both(left, right, around), left, right) if left and right and not around else (_both(left, right, around),) if around else (left or right,):
            rows.append(r)
            labels.append(label)

    # candidates of lines that are one unit are none, but such a line may be a whole text's beginning: its kind is a feature, no more
    for text in dict.fromkeys(x.strip() for x in texts):
        if one_unit(text):
            for end, start in candidates(text):
                add(left(text, end), right(text, start), 0.0, surroundings(text, 0, end, start) or ["U"])
    for i, text in enumerate(prose):
        other = prose[rng.randrange(len(prose))]
        same = lambda a, b: (_thai(a[0]), _cjk(a[0])) == (_thai(b[0]), _cjk(b[0]))
        stopped = text.rstrip(CLOSERS)[-1:] in STOPS
        if stopped or _thai(text[-1]):
            add(left(text, len(text), 1), right(other, 0, 1) if same(text, other) else [], 1.0)
        elif text[-1].isalnum() and not _thai(text[-1]):
            add(left(text + ".", len(text) + 1, 1), right(other, 0, 1) if same(text, other) else [], 1.0)
        for end, start in candidates(text):
            c, mark = text[start], text[:end].rstrip(CLOSERS)[-1:]
            if c.islower() or (mark == "." and c.isdigit() and len(text[:end].split()[-1]) <= 7):
                add(left(text, end), right(text, start), 0.0)
            elif mark in "!?" and c.isupper() and text[end - 1] in STOPS:
                add([], right(text, start), 1.0)
            elif mark == "." and c.isupper() and text[end - 1] == ".":  # both tokens' histories agree
                a, b = _history(ends[k := _left_key(text, end)], before[k]), _history(opens[k := _right_key(text, start)], after[k])
                word = _wordlike(text[:end].split()[-1].rstrip(CLOSERS + STOPS))
                if (a, b) == ("e", "e") or (a == "n" and b != "e" and word == "-") or (word == "w" and k not in inside and len(k) > 1):
                    add(left(text, end), right(text, start), float(a == "e" or word == "w"))
            elif mark in WIDE and text[end - 1] in WIDE:
                add(left(text, end), right(text, start), 1.0)
        gaps = [m for m in re.finditer(r"(?<=[^\s.!?…。！？؟]) (?=\S)", text)]
        for m in rng.sample(gaps, min(3, len(gaps))):
            if not (_thai(text[m.start() - 1]) and _thai(text[m.end()])):
                add([], right(text, m.end()), 0.0)
        for m in rng.sample(upper := [m for m in gaps if text[m.end()].isupper() or text[m.start() - 1] in CLOSERS], min(4, len(upper))):
            add([], right(text, m.end()), 0.0)
        inner = [k for k in range(1, len(text) - 1) if _thai(text[k]) and _thai(text[k - 1]) or _cjk(text[k]) and text[k].isalpha() and text[k - 1].isalpha()] if any(map(_thai, text)) or any(map(_cjk, text)) else []
        for k in rng.sample(inner, min(4, len(inner))):
            add([], right(text, k), 0.0)
        for m in re.finditer(r"[」』]と", text):
            add([], right(text, m.start() + 1), 0.0)
    known = {"#L" + k: 1.0 if ends[k] else -1.0 for k in {*ends, *before} if ends[k] or before[k] >= 2}
    return rows, labels, known | {"#R" + k: 1.0 if opens[k] else -1.0 for k in {*opens, *after} if opens[k] or after[k] >= 2}


def split(text: str, model: dict[str, float], opened: set[str] | tuple = (), asked: set[str] | None = None) -> list[int]:
    """Ends of the sentence units of an element. Blank text has none.

    opened: tokens known to open elements, besides those of the model; asked takes up those that it would help to know of.
    """
    n = len(text.rstrip())
    if not n:
        return []
    marks = candidates(text)
    if not marks:
        return [n]
    out, floor = [], 0
    for end, start in marks:
        left = left_features(text, end, floor, _STATE[model.get("#L" + _left_key(text, end), 0.0)])
        key = _right_key(text, start)
        right = right_features(text, start, _STATE[model.get("#R" + key, 0.0)])
        sure = any(x[:3] == "Rxe" for x in right)
        glued = end == start and not _cjk(text[end]) and not _cjk(text[end - 1])
        mixed = _thai(text[start]) and text[end - 1].isalnum() and not _thai(text[end - 1])
        trails = text[:end].endswith(("...", "…", *"\"'”“’»«」』")) and _kind(text[start]) in ("x", "th", "cjk")
        if not sure and (glued or mixed or trails):
            if asked is not None and key:
                asked.add(key)
            if key not in opened:
                continue  # only a known opener stands there
            right = right_features(text, start, "e")
        if maxent.score(model, _both(left, right, surroundings(text, floor, end, start))) > 0:
            out.append(end)
            floor = start
    return [*out, n]


#: The field code of rows that tell an opener.
_OPENER = -1
_STATE = {1.0: "e", -1.0: "n", 0.0: "u"}
_LABELLED = re.compile(r"(?i)(?:e-?mail|mail|correo|courriel|почта)\s*\.?\s*:\s*\S+$")


def fit_boundaries(df: DataFrame, pages: int = 1500) -> dict[str, float]:
    """The boundary model, from the elements of a bounded sample of pages (parameter pages)."""
    texts = [t for r in sample_pages(df, pages, "p", "text_nodes") for _, _, _, t in elements(r.p, r.text_nodes)]
    rows, labels, known = examples(texts)
    return maxent.fit(rows, labels) | known


def sentence_units(df: DataFrame, model: dict[str, float] | None = None) -> DataFrame:
    """(page_id, field, pos, item, end_pos): the ends of all sentence units of p and text_nodes.

    Null or blank elements have none; text without a boundary is one unit. Whole texts are read; repeated deliveries count once.
    """
    model = fit_boundaries(df) if model is None else model
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def judge(text):
        return split(text, shared.value, (), asked := set()), sorted(asked), opener(text)

    def make():
        units, seen = Memo(judge), set()

        def run(p, nodes):
            out, uid = [], int.from_bytes(os.urandom(8)) >> 1
            for f, i, k, text in elements(p, nodes):
                ends, asked, first = units[text]
                if first and first not in seen:
                    if len(seen) > 200_000:
                        seen.clear()  # some tokens are told once more
                    seen.add(first)
                    out.append((_OPENER, 0, 0, 0, None, None, first))
                out += [(f, i, k, 0, uid, text, key) for key in asked] or [(f, i, k, e, None, None, None) for e in ends]
            return out

        return run

    kinds = {"field": "smallint", "pos": "int", "item": "int", "end_pos": "int", "uid": "bigint", "text": "string", "key": "string"}
    rows = cut(map_units(df.select("page_id", "p", "text_nodes"), "page_id", kinds, make), "units")
    opened = rows.select(F.inline("units")).where(F.col("field") == _OPENER).select("key").distinct().withColumn("known", F.lit(True))
    unit = lambda x: F.struct(x["field"].alias("field"), x["pos"].alias("pos"), x["item"].alias("item"), x["end_pos"].alias("end_pos"))
    settled = F.transform(F.filter("units", lambda x: (x["field"] != _OPENER) & x["uid"].isNull()), unit)
    held = rows.where(F.exists("units", lambda x: x["uid"].isNotNull()))
    asked = held.select("page_id", F.inline("units")).where("uid is not null").join(opened, "key", "left")
    asked = asked.groupBy("page_id", "uid", "field", "pos", "item", "text").agg(F.collect_set(F.when(F.col("known"), F.col("key"))).alias("keys"))

    def ends(texts, keys):
        return pa.array([split(x, shared.value, set(ks)) for x, ks in zip(texts.to_pylist(), keys.to_pylist())], pa.list_(pa.int32()))

    late = asked.select("page_id", "uid", "field", "pos", "item", F.explode(once(ends, "array<int>")("text", "keys")).alias("end_pos"))
    early = held.select("page_id", F.array_max(F.transform("units", lambda x: x["uid"])).alias("uid"), F.explode(settled).alias("x")).select("page_id", "uid", "x.*")
    pages = early.unionByName(late).groupBy("page_id", "uid").agg(F.sort_array(F.collect_set(F.struct("field", "pos", "item", "end_pos"))).alias("units"))
    rows = rows.where(~F.exists("units", lambda x: x["uid"].isNotNull())).select("page_id", settled.alias("units")).unionByName(pages.select("page_id", "units"))
    return unpack(rows, "page_id").withColumn("field", field_name())
