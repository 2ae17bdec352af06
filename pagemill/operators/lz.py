"""LZ-String text compression in the alphabet that may stand in a URL.

The coder works on UTF-16 code units. Codes 0 and 1 announce a new unit of 8 or 16 bits, 2 ends the text; phrases follow. Code
width grows as the table fills. Bits of a code go out lowest first, six to a character.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.packing import once

#: Fixed value: the 65 characters in order.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+-$"
_VALUE = {c: i for i, c in enumerate(ALPHABET)}
BYTE, WIDE, END = 0, 1, 2


class CodecError(TypeError):
    """Text that isn't a whole compressed text."""


def _units(text: str) -> list[int]:
    raw = text.encode("utf-16-le", "surrogatepass")
    return [raw[i] | raw[i + 1] << 8 for i in range(0, len(raw), 2)]


def compress(text: str) -> str:
    bits: list[str] = []
    single: dict[int, int] = {}  # code of a unit
    longer: dict[int, int] = {}  # code of a phrase, by code of its beginning and last unit
    new: dict[int, int] = {}  # units met but not yet written, by code
    width, room, size, phrase = 2, 2, 3, -1

    def used() -> None:
        nonlocal width, room
        room -= 1
        if not room:
            room, width = 1 << width, width + 1

    def send(code: int) -> None:
        unit = new.pop(code, -1)
        if unit < 0:
            bits.append(f"{code:0{width}b}"[::-1])
        else:
            bits.append(f"{BYTE if unit < 256 else WIDE:0{width}b}"[::-1])
            bits.append(f"{unit:08b}"[::-1] if unit < 256 else f"{unit:016b}"[::-1])
            used()
        used()

    for unit in _units(text):
        if unit not in single:
            single[unit] = size
            new[size] = unit
            size += 1
        if phrase < 0:
            phrase = single[unit]
            continue
        known = longer.get(phrase << 16 | unit)
        if known is not None:
            phrase = known
        else:
            send(phrase)
            longer[phrase << 16 | unit] = size
            size += 1
            phrase = single[unit]
    if phrase >= 0:
        send(phrase)
    bits.append(f"{END:0{width}b}"[::-1])
    flow = "".join(bits) + "0"
    flow += "0" * (-len(flow) % 6)
    return "".join(ALPHABET[int(flow[i : i + 6], 2)] for i in range(0, len(flow), 6))


def decompress(text: str) -> str:
    """CodecError for what compress can't have made: empty, cut short, foreign characters, unknown codes, half characters."""
    try:
        flow = "".join(format(_VALUE[c], "06b") for c in text.replace(" ", "+"))
    except (KeyError, ValueError):
        raise CodecError("a character that isn't in the alphabet") from None
    at = 0

    def read(n: int) -> int:
        nonlocal at
        if at + n > len(flow):
            raise CodecError("the text ends too early")
        at += n
        return int(flow[at - n : at][::-1], 2)

    phrases: list[str] = ["", "", ""]  # of units, one character each
    out: list[str] = []
    last = ""
    width, room = 2, 2
    first = True
    while True:
        code = read(width)
        if code == END:
            break
        if code in (BYTE, WIDE):
            phrases.append(chr(read(8 if code == BYTE else 16)))
            code = len(phrases) - 1
            if not first:
                room -= 1
                if not room:
                    room, width = 1 << width, width + 1
        if first:
            if code < 3:
                raise CodecError("an unknown code")
            last, first, width, room = phrases[code], False, 3, 4
            out.append(last)
            continue
        if code < len(phrases):
            entry = phrases[code]
        elif code == len(phrases):
            entry = last + last[0]
        else:
            raise CodecError("an unknown code")
        out.append(entry)
        phrases.append(last + entry[0])
        last = entry
        room -= 1
        if not room:
            room, width = 1 << width, width + 1
    try:
        return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le")
    except UnicodeDecodeError as e:
        raise CodecError(str(e)) from None


def _text_function(f, lenient: bool):
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts.to_pylist():
            try:
                out.append(None if x is None else f(x))
            except CodecError:
                if not lenient:
                    raise
                out.append(None)
        return pa.array(out, pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return once(run, "string")


def lz_compress(c: Column) -> Column:
    return _text_function(compress, False)(c)


def lz_decompress(c: Column) -> Column:
    """Fails the query on text that can't be read."""
    return _text_function(decompress, False)(c)


def try_lz_decompress(c: Column) -> Column:
    """Null for text that can't be read."""
    return _text_function(decompress, True)(c)
