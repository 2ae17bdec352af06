"""Personal names to their parts by rule: titles, given and middle names, initials, particles, surname, suffixes.

'Surname, Given Middle' and 'Given Middle Surname' are read. A text without a surname and a given name or initial, with numbers or with a
firm's ending is no name and gives null.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.packing import once

PARTS = ("given_name", "generational_suffix", "honorific_prefix", "honorific_suffix", "middle_initials", "middle_name", "surname")
SCHEMA = "struct<" + ",".join(f"{p}:string" for p in PARTS) + ">"
# Words beside names.
PREFIXES = {x: x.capitalize() + "." * (x in "mr mrs ms dr prof hr sr jr st rev hon fr".split()) for x in "mr mrs ms miss mx dr prof hr fru frau herr mme mlle sir dame lady lord rev hon sr sra don dona fr".split()}
SUFFIXES = {"jr": "Jr.", "junior": "Jr.", "sr": "Sr.", "senior": "Sr.", "ii": "II", "iii": "III", "iv": "IV", "v": "V"}
DEGREES = {x.lower(): x for x in "PhD MD DDS Esq MBA BA MA MSc BSc JD CPA RN".split()}
PARTICLES = set("von van der den de la del della di da dos das du le af av zu zum zur ten ter al el bin ibn st y e".split())
_FIRM = re.compile(r"(?i)(?:\ba/s|\baps|\bgmbh|\bltd|\binc|\bllc|\bag|\bco)\b\.?$|&")
_WORD = re.compile(r"[^\W\d_][\w'’.-]*$")


def _case(word: str) -> str:
    """Words all in capitals or small letters in mixed case; particles small."""
    if word.lower() in PARTICLES:
        return word.lower()
    if len(word) > 1 and (word.isupper() or word.islower()):
        word = re.sub(r"(^|[-'’])(\w)", lambda m: m[1] + m[2].upper(), word.lower())
        return re.sub(r"^Mc(\w)", lambda m: "Mc" + m[1].upper(), word)
    return word


def parse(name: str) -> dict[str, str] | None:
    text = " ".join(unicodedata.normalize("NFC", re.sub(r"\([^)]*\)|[\"“”]", " ", name)).split())
    misread = lambda w: sum(map(str.isdigit, w)) * 3 <= sum(map(str.isalpha, w))  # noqa: E731 - a digit read for a letter
    if not text or not all(map(misread, text.split())) or "@" in text or "/" in text or _FIRM.search(text):
        return None
    out: dict[str, str] = {}
    blocks = [b.split() for b in text.split(",") if b.strip()]
    key = lambda w: w.rstrip(".").lower()

    def ends(words: list[str]) -> list[str]:
        while len(words) > 1 and (key(words[-1]) in SUFFIXES or key(words[-1]).replace(".", "") in DEGREES):
            k = key(words[-1])
            out["generational_suffix" if k in SUFFIXES else "honorific_suffix"] = SUFFIXES.get(k) or DEGREES[k.replace(".", "")]
            words = words[:-1]
        return words

    while len(blocks) > 1 and all(key(w) in SUFFIXES or key(w).replace(".", "") in DEGREES for w in blocks[-1]):
        ends(["", *blocks.pop()])
    if not blocks or len(blocks) > 2:
        return None
    words = [w for b in reversed(blocks) for w in ends(b)] if len(blocks) == 2 else ends(blocks[0])
    last = len(ends(blocks[0])) if len(blocks) == 2 else 0
    turned = words
    while len(turned) > 1 and key(turned[0]) in PREFIXES and not (len(key(turned[0])) == 1):
        out.setdefault("honorific_prefix", PREFIXES[key(turned[0])])
        turned = turned[1:]
    if last and len(turned) > last and key(turned[-last]) in PREFIXES and last > 1:  # 'Ms. Surname, Given'
        out.setdefault("honorific_prefix", PREFIXES[key(turned[-last])])
        turned, last = turned[:-last] + turned[len(turned) - last + 1 :], last - 1
    if len(turned) < 2 or not all(_WORD.match(w) for w in turned):
        return None
    cut = len(turned) - (last or 1)
    while not last and cut > 1 and key(turned[cut - 1]) in PARTICLES and not re.fullmatch(r"[A-Z]\.", turned[cut - 1]):
        cut -= 1
    first, family = turned[:cut], turned[cut:]
    if not first or len(key(family[-1])) < 2:
        return None
    out["surname"] = " ".join(map(_case, family))
    full = lambda w: len(key(w)) > 1
    if full(first[0]):
        out["given_name"] = _case(first[0])
    if middle := first[1:]:
        out["middle_initials"] = "".join(p[0].upper() for w in middle for p in w.split("-") if p)
        if all(map(full, middle)):
            out["middle_name"] = " ".join(map(_case, middle))
    return out


def parse_name(c: Column) -> Column:
    """The parts as a struct; null for what is no name."""

    def run(names: pa.Array) -> pa.Array:
        return pa.array([None if x is None else parse(x) for x in names.to_pylist()], pa.struct([(p, pa.string()) for p in PARTS]))

    run.__annotations__ = {"names": pa.Array, "return": pa.Array}
    return once(run, SCHEMA)(c)
