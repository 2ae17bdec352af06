"""Text decoded with a wrong character encoding: the chain of re-decodings of least description length wins.

A step takes characters back to the bytes of the encoding they were read with and reads these as another encoding. A segment's
description length is its zstandard size with the best of per-language trained dictionaries, plus an escape for every character that
the corpus hardly has, plus a cost for every step of the chain. All chains of up to three steps are searched, the best few texts of
every length going on even if they are longer than the original; a text that no chain shortens stays as it is. Lost characters
(U+FFFD) mark a text as garbled but can't be restored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.pages import Memo

#: Encodings whose characters may stand for the bytes of UTF-8 text.
READ_AS = ("cp1252", "latin_1", "cp437", "cp850", "cp866", "cp1251", "cp1250", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "cp1253", "cp1254", "cp1256", "cp1257", "cp874", "mac_cyrillic", "cp852")
#: (read as, really): pairs of encodings of one byte a character.
CROSSED = (
    ("cp1252", "cp1251"), ("cp1252", "koi8_r"), ("cp1252", "koi8_u"), ("cp1252", "cp866"), ("cp1252", "iso8859_5"), ("cp1252", "mac_cyrillic"), ("cp1251", "koi8_r"), ("cp1251", "koi8_u"), ("koi8_r", "cp1251"),
    ("cp1251", "cp866"), ("cp866", "cp1251"), ("koi8_r", "cp866"), ("cp866", "koi8_r"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"), ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("koi8_r", "cp1252"), ("cp866", "cp1252"), ("cp1250", "cp1252"), ("iso8859_5", "cp1252"),
    ("cp1252", "cp1256"), ("cp1252", "iso8859_6"), ("cp1252", "cp874"), ("cp1253", "cp1252"), ("cp1252", "cp1253"), ("cp1256", "cp1252"),
)
#: (read as, really): encodings of several bytes a character.
WIDE = (("cp1252", "gbk"), ("cp1252", "big5"), ("cp1252", "cp932"), ("cp1252", "euc_jp"), ("cp1252", "euc_kr"), ("gbk", "utf_8"), ("big5", "utf_8"), ("cp932", "utf_8"), ("euc_kr", "utf_8"), ("latin_1", "gbk"), ("latin_1", "cp932"))
#: Bytes for a step that finds valid UTF-8 in Cyrillic readings, for any other step (times its number in the chain), for a character that the corpus hardly has; longest
#: chain. Valid UTF-8 among Latin letters and signs hardly comes by chance: such a step is credited instead of charged.
VALID, STEP, ESCAPE, CHAIN, CREDIT = 1.0, 3.0, 4.0, 3, -3.0
#: Texts of each number of steps that are taken further, and how much longer than the original's their description may be.
BEAM, SLACK = 3, 0.25
CREDITED = ("cp1252>utf_8", "latin_1>utf_8", "cp437>utf_8", "mac_roman>utf_8")
#: First bytes of frequent UTF-8 sequences as these encodings show them, with what may follow.
_TRACE = re.compile(r"[ÃÂÐÑ][\x80-\xbfŒœŠšŸŽžƒˆ˜‐-›€™]|â[\x80€]|[├┬Γ╨╤][^\x00-\x7f]|[√¬‚][^\x00-\x7f]")
_TRACE_CUT = re.compile(r"[Â-ß](?![\x80-¿Œ-ž–-™])|[à-ï][\x80-¿Œ-ž–-™](?![\x80-¿Œ-ž–-™])")
_SEGMENT = re.compile(r"[^\n]*?(?:[.!?。！？…][\"'”“»«’)\]]*(?=\s)|\n|$)")
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=None)
def table(encoding: str) -> dict[int, str]:
    """Characters by byte from 0x80; bytes that the encoding leaves open stand for themselves."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            out[b] = chr(b)
    return out


@lru_cache(maxsize=None)
def _utf8_runs(encoding: str) -> tuple[re.Pattern, re.Pattern, dict[str, int]]:
    """Runs that are UTF-8 read as the encoding, the same with runs whose last byte is missing, and the bytes of characters."""
    chars = table(encoding)
    group = lambda lo, hi: "[" + "".join(re.escape(chars[b]) for b in range(lo, hi + 1)) + "]"
    more = "[" + "".join(re.escape(chars[b]) for b in range(0x80, 0xC0)) + "]"
    pattern = f"{group(0xC2, 0xDF)}{more}|{group(0xE0, 0xEF)}{more}{{2}}|{group(0xF0, 0xF4)}{more}{{3}}"
    short = f"{group(0xC2, 0xDF)}(?!{more})|{group(0xE0, 0xEF)}{more}(?!{more})"
    return re.compile(pattern), re.compile(f"{pattern}|{short}"), {c: b for b, c in chars.items()}


#: Bytes that cp1252 leaves open, and that of its hard space: a reader may have dropped or flattened them.
DROPPED = (0x81, 0x8D, 0x8F, 0x90, 0x9D, 0xA0)


def from_utf8(text: str, encoding: str, dropped: int | None = None) -> str:
    """The text with every run that is UTF-8 read as the encoding put right. dropped: the byte that is put where a run's last one is missing."""
    whole, short, byte = _utf8_runs(encoding)

    def put(m: re.Match) -> str:
        try:
            raw = bytes(byte[c] for c in m[0])
            missing = dropped is not None and len(raw) < (2 if raw[0] < 0xE0 else 3 if raw[0] < 0xF0 else 4)
            made = (raw + bytes([dropped]) if missing else raw).decode("utf-8")
            return m[0] if unicodedata.category(made) in ("Cn", "Co") else made  # no character stands there
        except (UnicodeDecodeError, KeyError):
            return m[0]

    return (whole if dropped is None else short).sub(put, text)


@lru_cache(maxsize=None)
def _crossing(wrong: str, right: str) -> dict[int, str]:
    return {ord(c): table(right)[b] for b, c in table(wrong).items()}


def _wide(text: str, wrong: str, right: str) -> str:
    back = {c: b for b, c in table(wrong).items()} if wrong in ("cp1252", "latin_1") else None

    def put(m: re.Match) -> str:
        try:
            raw = bytes(back[c] for c in m[0]) if back else m[0].encode(wrong)
            return raw.decode(right)
        except (UnicodeError, KeyError):
            return m[0]

    return _NON_ASCII.sub(put, text)


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of at most a size, trained on all samples; of too few to train on, these themselves."""
    try:
        return zstandard.train_dictionary(min(size, max(1000, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(samples)


class Model:
    """Dictionaries by language and how common characters are, from clean documents."""

    def __init__(self, samples: dict[str, list[str]], counts: Counter, documents: int, dictionary: int = 48_000):
        self.raw = {lang: trained([t.encode("utf-8", "replace") for t in texts], dictionary) for lang, texts in samples.items()}
        least = max(2.0, documents / 2000)
        self.common = {c for c, n in counts.items() if n >= least} | set("‘’‚“”„‹›«»–—…")
        self._make()

    def _make(self) -> None:
        self.packers = []
        for raw in self.raw.values():
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=3)
            self.packers.append(zstandard.ZstdCompressor(level=3, dict_data=d, write_content_size=False, write_dict_id=False))
        if not self.packers:
            self.packers.append(zstandard.ZstdCompressor(level=3, write_content_size=False))
        self.length = Memo(self._length, 4_000_000)

    def __getstate__(self):
        return self.raw, self.common

    def __setstate__(self, state):
        self.raw, self.common = state
        self._make()

    def escapes(self, text: str) -> int:
        return sum(1 for c in text if c > "\x7f" and c not in self.common)

    def _length(self, text: str) -> float:
        raw = text.encode("utf-8", "replace")
        return min(len(p.compress(raw)) for p in self.packers) + ESCAPE * self.escapes(text)


def steps(text: str, model: Model) -> dict[str, str]:
    """Every different re-decoding of a segment in one step, with the step's name."""
    out: dict[str, str] = {}
    for encoding in READ_AS:
        new = from_utf8(text, encoding)
        if new != text:
            out.setdefault(new, f"{encoding}>utf_8")
    if _TRACE_CUT.search(text):
        for byte in DROPPED:
            if (new := from_utf8(text, "cp1252", byte)) != text:
                out.setdefault(new, "cp1252>utf_8")
    letters = [c for c in text if c.isalpha()]
    high, escapes = sum(c > "\x7f" for c in letters), model.escapes(text)
    whole = high >= 3 and high * 2 > len(letters)  # a text of another script
    odd = len(_ODD.findall(text))
    if whole or escapes or odd:
        made = [(text.translate(_crossing(*pair)), pair) for pair in CROSSED] + [(_wide(text, *pair), pair) for pair in WIDE]
        for new, (wrong, right) in made:
            if new == text or len(_MIXED.findall(new)) > len(_MIXED.findall(text)) or not (odd or whole and _script_letters(text, new) or escapes and model.escapes(new) < escapes):
                continue
            out.setdefault(new, f"{wrong}>{right}")
    return out


def _script_letters(old: str, new: str) -> bool:
    """Whether the re-decoding gives three letters or more beyond ASCII, and mostly letters."""
    if len(old) != len(new):
        return sum(c > "\x7f" and c.isalpha() for c in new) >= 3
    changed = [b for a, b in zip(old, new) if a != b]
    found = sum(b.isalpha() for b in changed)
    return found >= 3 and found * 10 >= len(changed) * 6


#: Letters of one script beside those of another: Latin, Greek, Cyrillic, Arabic, Thai, East Asian.
_MIXED = re.compile(r"[A-Za-zÀ-ɏ](?=[Ͱ-๿])|[Ͱ-๿](?=[A-Za-zÀ-ɏ])|[Ͱ-Ͽ؀-ۿ](?=[Ѐ-ӿ])|[Ѐ-ӿ](?=[Ͱ-Ͽ؀-ۿ])|[Ͱ-ۿ](?=[\u0e00-\u0e7f\u3040-\u9fff])|[\u0e00-\u0e7f\u3040-\u9fff](?=[Ͱ-ۿ])")
#: A mark between letters, or one that only opens behind a letter.
_ODD = re.compile(r"[^\W\d_][^\w\s\x00-\x7f’‘'`´·​-‍­‐-—][^\W\d_]|[^\W\d_][‚„ˆ](?=[\s.,;:!?]|$)")


def restore_segment(text: str, model: Model) -> tuple[str, tuple[str, ...]]:
    """The segment by its cheapest chain, and the chain (empty if it stays). The best BEAM texts of every number of steps go on."""
    first = steps(text, model)
    if not first:
        return text, ()
    limit = model.length[text]
    worst = limit * (1 + SLACK) + STEP
    best = (limit, 0, text, ())
    known, going = {text: 0.0}, [(0.0, text, ())]
    for depth in range(1, CHAIN + 1):
        reached: dict[str, tuple[float, tuple[str, ...]]] = {}
        for spent, old, chain in going:
            for new, name in (first if depth == 1 else steps(old, model)).items():
                cost = spent + (CREDIT if name in CREDITED and _TRACE.search(old) else VALID if name.endswith("utf_8") else STEP * depth)
                if cost + ESCAPE * model.escapes(new) > worst:
                    continue  # its rare characters alone cost more: no need to compress it
                if cost < min(known.get(new, math.inf), reached[new][0] if new in reached else math.inf):
                    reached[new] = cost, (*chain, name)
        ranked = sorted((model.length[new] + cost, depth, new, chain) for new, (cost, chain) in reached.items())
        if not ranked:
            break
        best = min(best, ranked[0])
        going = [(total - model.length[new], new, chain) for total, _, new, chain in ranked[:BEAM] if total <= worst]
        known |= {new: cost for cost, new, _ in going}
    return best[2], best[3]


def restore(text: str, model: Model) -> tuple[str, tuple[str, ...], bool]:
    """(restored text, steps used, whether characters are lost)."""
    if text.isascii():
        return text, (), False
    out, used, at = [], [], 0
    for m in _SEGMENT.finditer(text):
        part = m[0]
        if not part:
            continue
        at = m.end()
        if not part.isascii():
            part, chain = model.segment[part]
            used += chain
        out.append(part)
    return "".join([*out, text[at:]]), tuple(dict.fromkeys(used)), "�" in text


#: Traces of UTF-8 read as something else, control signs, lost characters; the same in Python and Java.
_SUSPECT = r"\ufffd|[\x80-\x9f]|[ÃÂ][\x80-¿‚-™]|â€|[ÐÑ][\x80-ÿ‚-™]|[├╨╤√ΓĂ][^\x00-\x7f]|[РС][\x80-¿Ђ-џ‚-™](?:[РС].)"


def fit_encodings(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", documents: int = 6000, each: int = 400) -> Model:
    """Dictionaries from a bounded sample (parameter documents, the first by hash of their id; at most `each` a language and 4,000
    characters a document) without traces of UTF-8 read as something else and without lost characters; how common characters are, from
    all whole texts of that kind."""
    clean = df.where(F.col(text).isNotNull() & ~F.col(text).rlike(_SUSPECT))
    chars = F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"[^\x00-\x7f]"), F.lit(0))))
    # one row a character that is in use, and how many documents hold it
    counts = Counter({r.c: r["count"] for r in clean.select(chars.alias("c")).groupBy("c").count().collect()})
    n = clean.count()
    ids = df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(documents)
    rows = df.select(key, F.substring(text, 1, 4000).alias("t"), F.lower(F.substring_index(F.trim(lang), "-", 1)).alias("l")).join(F.broadcast(ids), key, "left_semi").where("t != ''").dropDuplicates([key]).orderBy(key).collect()
    samples = defaultdict(list)
    for r in rows:
        if not re.search(_SUSPECT, r.t) and len(samples[r.l or ""]) < each:
            samples[r.l or ""].append(r.t)
    return Model({k: v for k, v in samples.items() if k and len(v) >= 5}, counts, n)


def garbled(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, restored, steps, lost) of the garbled documents; restored: the text as far as it can be restored; lost: characters are gone.

    Null, empty and ASCII texts are never garbled; a document without a key is judged like any other; whole texts are read;
    repeated deliveries count once. lang is only used for fitting.
    """
    model = model or fit_encodings(df, key, text, lang)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        import pyarrow as pa

        own = shared.value
        own.segment = Memo(lambda t: restore_segment(t, own), 8_000_000)
        for batch in batches:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in batch.columns)):
                new, used, lost = restore(t, own)
                if used or lost:
                    rows.append((i, new, ",".join(used), lost))
            if rows:
                ids, new, used, lost = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(new), pa.array(used), pa.array(lost)], [key, "restored", "steps", "lost"])

    plain = df.select(F.col(key).cast("bigint").alias(key), F.col(text)).where(F.col(text).rlike(r"[^\x00-\x7f]"))
    return plain.mapInArrow(run, f"{key} bigint, restored string, steps string, lost boolean").distinct()
