"""Several values packed in one field: quoted spans are atomic, every other delimiter is judged by a lattice over the field.

Every delimiter outside quotation marks (commas, semicolons, bars, bullets, tabs, line ends, slashes beside a space, dashes between
spaces) may split or belong to a value. A field's lattice has an edge for every piece, for every run of pieces that the column shows
as a whole somewhere (quoted, or as a stretch of its own), and a chain through all other runs. The model gives a value its relative
frequency, an unseen one a letter-by-letter probability, and each kind of delimiter the rate at which it splits.
Expectation-maximisation re-estimates frequencies and rates from the whole column; a Viterbi pass takes the likeliest split.

Equal fields are solved once, weighted by their number. Frequencies never leave the cluster: edges are joined to the aggregated
column by the value's hash. No run of pieces is too long: edges have the sizes that whole values have.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagemill.sources.tables import cut, discard

#: What may part two values.
DELIMITER = r"[,;|·•‣\t\n\r\v\f\x85  ，、；،؛]|(?<=\s)/|/(?=\s)|(?<=\s)[-–—](?=\s)"
_END = rf"(?=\s*(?:$|{DELIMITER}))"
_QUOTED = re.compile(
    r"\s*(?:"
    rf'"(?:[^"]|"")*"{_END}'
    rf"|'(?:[^']|''|'(?!\s*(?:$|{DELIMITER})))*'{_END}"
    rf"|(?:“[^”]*”|«[^»]*»|„[^“”]*[“”]|‘[^’]*’){_END}"
    r")"
)
_DELIMITER = re.compile(DELIMITER)
_MORE = re.compile(rf"(?:\s|{DELIMITER})*")
_EDGE = " \t\n\r\v\f\x85\xa0  　​﻿"
#: Log probability of a letter of an unseen value.
LETTER = -math.log(40.0)
#: Prior of a delimiter's splitting: so many splits, so many joints.
PRIOR = (9.0, 1.0)



def unquote(value: str) -> str:
    """A value without the quotation marks round it; doubled marks inside made single."""
    v = value.strip(_EDGE)
    if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'":
        return v[1:-1].replace(v[0] * 2, v[0]).strip(_EDGE)
    if len(v) >= 2 and v[0] + v[-1] in ("“”", "«»", "„“", "„”", "‘’"):
        return v[1:-1].strip(_EDGE)
    return v


def _joint(text: str, at: int, n: int) -> tuple[int, int, str]:
    """(start, end, kind) of the next joint at or after a place; a joint is a run of delimiters and white space."""
    m = _DELIMITER.search(text, at)
    if not m:
        return n, n, ""
    a, b = m.start(), _MORE.match(text, m.end()).end()
    left, right = text[a - 1 : a] if a else " ", text[m.end() : m.end() + 1] or " "
    kind = m[0] + "<" * left.isspace() + ">" * right.isspace() + "9" * (left.isdigit() and right.isdigit())
    return a, b, kind


def pieces(text: str | None) -> list[tuple[int, str, str, str, bool]]:
    """(group, piece, joint after it, its kind, quoted) of a field in order. Pieces of one group may belong together; a quoted one has a
    group of its own. Empty pieces are left out; list brackets round the field are taken off."""
    text = (text or "").strip()
    core = text.strip(_EDGE + ",;|")
    if core[:1] == "[" and core[-1:] == "]" and core.count("[") == 1:
        text = core[1:-1]
    out, at, n, group, fresh = [], 0, len(text), 0, True
    while at < n:
        if m := _QUOTED.match(text, at):
            group += not fresh
            end = m.end()
            stop, after, _ = _joint(text, end, n)
            out.append((group, text[at:end].strip(_EDGE), "", "", True))
            group, fresh, at = group + 1, True, after
            continue
        stop, after, kind = _joint(text, at, n)
        if piece := text[at:stop].strip(_EDGE):
            out.append((group, piece, text[at + len(text[at:stop].rstrip(_EDGE)) : after], kind, False))
            fresh = False
        at = after
    return out


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def _grouped(rows: list[dict]) -> Iterator[list[dict]]:
    """The pieces of a field by group."""
    own: list[dict] = []
    for r in rows:
        if own and r["g"] != own[0]["g"]:
            yield own
            own = []
        own.append(r)
    if own:
        yield own


def stretch(group: list[dict], a: int, k: int) -> str:
    """The text of k pieces of a group from a on, their joints between them."""
    return "".join(r["text"] + r["joint"] for r in group[a : a + k - 1]) + group[a + k - 1]["text"]


def lattice(n: int, sizes: list[int], joints: list[tuple[int, float]], edges: list[tuple[int, int, float]], unseen: float) -> tuple[list[float], list[float], list[tuple[int, int]]]:
    """(posterior of each edge, probability that each joint splits, likeliest path as (first piece, pieces)) of a group of n pieces.

    sizes: letters of each piece. joints: letters and splitting rate of the n - 1 joints. edges: (first piece, pieces, frequency), single
    pieces included. unseen: the share of unseen values. A run without an edge, and the unseen share of one with an edge, goes through
    a chain that enters a value, adds joint and piece after piece, and leaves it: that takes time in proportion to n, not to its square.
    """
    no = -1e300

    def add(x: float, y: float) -> float:
        top, low = (x, y) if x > y else (y, x)
        return top if low < top - 40 else top + math.log1p(math.exp(low - top))

    yes = [math.log(r) for _, r in joints]
    stay = [math.log1p(-r) + size * LETTER for size, r in joints]
    kept = [math.log1p(-r) for _, r in joints]
    inside = [0.0]
    for x in kept:
        inside.append(inside[-1] + x)
    new, letters = math.log(unseen), [LETTER * s for s in sizes]
    weight = [(math.log(f) if f > 0 else no) + inside[a + k - 1] - inside[a] for a, k, f in edges]
    by_end, by_start = defaultdict(list), defaultdict(list)
    for i, (a, k, _) in enumerate(edges):
        by_end[a + k].append(i)
        by_start[a].append(i)
    # fore[i]: all ways to have values of the first i pieces, the split after them included; chain[i]: an open unseen value ends with piece i - 1
    fore, chain, best, open_ = [0.0] + [no] * n, [no] * (n + 1), [0.0] + [no] * n, [no] * (n + 1)
    back, since = [(0, 0)] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        out = yes[i - 1] if i < n else 0.0
        enter, more = fore[i - 1] + new, chain[i - 1] + (stay[i - 2] if i > 1 else 0.0)
        chain[i] = add(enter, more) + letters[i - 1]
        enter, more = best[i - 1] + new, open_[i - 1] + (stay[i - 2] if i > 1 else 0.0)
        open_[i], since[i] = (enter, i - 1) if enter >= more else (more, since[i - 1])
        open_[i] += letters[i - 1]
        total, top, way = chain[i], open_[i], (since[i], i - since[i])
        for e in by_end[i]:
            a, k, _ = edges[e]
            total = add(total, fore[a] + weight[e])
            if best[a] + weight[e] > top:
                top, way = best[a] + weight[e], (a, k)
        fore[i], best[i], back[i] = total + out, top + out, way
    # rear[i]: all ways to go on after the split before piece i
    rear, chained = [no] * n + [0.0], [no] * (n + 1)
    for i in range(n - 1, -1, -1):
        out = (yes[i] if i < n - 1 else 0.0) + rear[i + 1]
        chained[i] = letters[i] + add(out, stay[i] + chained[i + 1] if i < n - 1 else no)
        total = new + chained[i]
        for e in by_start[i]:
            a, k, _ = edges[e]
            total = add(total, weight[e] + (yes[a + k - 1] if a + k < n else 0.0) + rear[a + k])
        rear[i] = total
    whole = fore[n]
    post = []
    for (a, k, _), w in zip(edges, weight):
        own = new + sum(letters[a : a + k]) + sum(stay[a : a + k - 1])
        post.append(math.exp(min(0.0, fore[a] + add(w, own) + (yes[a + k - 1] if a + k < n else 0.0) + rear[a + k] - whole)))
    split = [math.exp(min(0.0, fore[i] + rear[i] - whole)) for i in range(1, n)]
    path, at = [], n
    while at:
        path.append(back[at])
        at = back[at][0]
    return post, split, path[::-1]


def split_packed(df: DataFrame, key: str, column: str, rounds: int = 3) -> DataFrame:
    """One row (key, pos, value) per value packed in a string column.

    pos counts non-empty values from 0. Null or empty fields give nothing; a field without delimiters is one value; an
    unpaired quotation mark is an ordinary character. Other columns aren't read; repeated deliveries count once. rounds: passes of
    expectation-maximisation, the last one with the Viterbi path.
    """
    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(column).alias("field"), F.unhex(F.md5(column)).alias("id")).where("field is not null and trim(field) != ''")
    fields = cut(_fields(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("field").alias("field"))), "fields")
    each = fields.select("id", "n", F.inline("pieces"))
    # values whose extent is certain: quoted ones and pieces that stand alone
    alone = fields.select("n", F.inline("sure")).groupBy("h").agg(F.sum("n").alias("c"))
    whole = fields.select(F.inline("whole")).distinct()
    sizes = sorted(r.k for r in whole.select("k").where("k > 1").distinct().collect())  # how many pieces a whole value can have: few numbers
    spans = _spans(fields, sizes)
    known = spans.join(whole.where("k > 1").select("h").distinct(), "h", "left_semi") if sizes else spans.where("false")
    single = each.where("not quoted").select("id", "n", "g", "h", "kind", F.char_length("text").alias("size"), F.char_length("joint").alias("gap"), "place", "among").where("among > 1")
    edges = single.select("id", "n", "g", F.col("place").alias("a"), F.lit(1).alias("k"), "h", "size", "gap", "kind")
    edges = edges.unionByName(known.select("id", "n", "g", "a", "k", "h", F.lit(0).alias("size"), F.lit(0).alias("gap"), F.lit("").alias("kind"))).withColumn("p", F.lit(0.0))
    counts, rates = cut(alone.withColumn("c", F.col("c").cast("double")), "alone"), {}
    first, solved = counts, None
    for round_ in range(rounds):
        of = counts.agg(F.sum("c").alias("all"), F.sum(F.when(F.col("c") < 1.5, F.col("c"))).alias("once")).first()
        total, once = float(of["all"] or 0.0), float(of["once"] or 0.0)
        before, solved = solved, cut(_solve(edges.join(counts, "h", "left"), rates, total, (once + 1) / (total + 2)), "solved")
        discard(*([before] if before else []), *([counts] if counts is not first else []))
        edges = solved.select("id", "n", F.inline("posts"))
        if round_ == rounds - 1:
            break
        learnt = solved.select(F.inline("posts")).select("h", "p").groupBy("h").agg(F.sum("p").alias("c")).where("c > 1e-6")
        counts = cut(first.unionByName(learnt).groupBy("h").agg(F.sum("c").alias("c")), "counts")
        # one row a kind of delimiter
        seen = solved.select(F.inline("joints")).groupBy("kind").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()
        rates = {r.kind: (r.p + PRIOR[0]) / (r.n + sum(PRIOR)) for r in seen}
    values = _values(fields.select("id", "pieces").join(solved.select("id", "path"), "id", "left"))
    return rows.select(key, "id").distinct().join(values, "id").select(key, F.posexplode("values").alias("pos", "value")).distinct()


_SCHEMA = "id binary, n bigint, pieces array<struct<g:int,place:int,among:int,text:string,joint:string,kind:string,quoted:boolean,h:bigint>>, sure array<struct<h:bigint>>, whole array<struct<k:int,h:bigint>>"


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in arrow], arrow)], schema=arrow)


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """f(*columns) -> a row (or None) over the rows of df."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                columns = [c.to_pylist() for c in batch.slice(at, 1024).columns]
                yield _batch([out for row in zip(*columns) if (out := f(*row)) is not None], arrow)

    return df.mapInArrow(run, schema)


def _fields(df: DataFrame) -> DataFrame:
    """The pieces of every different field, its certain values, and the values that it shows whole, with their number of pieces."""

    def one(id_, n, field):
        rows = [{"g": g, "text": t, "joint": j, "kind": k, "quoted": q, "h": _hash(unquote(t) if q else t)} for g, t, j, k, q in pieces(field)]
        sure, whole = [], []
        for own in _grouped(rows):
            for i, r in enumerate(own):
                r["place"], r["among"] = i, len(own)
            if len(own) > 1:
                whole.append({"k": len(own), "h": _hash(stretch(own, 0, len(own)))})
            else:
                sure.append({"h": own[0]["h"]})
                if own[0]["quoted"] and (inner := len(pieces(unquote(own[0]["text"])))) > 1:
                    whole.append({"k": inner, "h": own[0]["h"]})
        return id_, n, rows, sure, whole

    return _map(df, one, _SCHEMA)


def _spans(fields: DataFrame, sizes: list[int]) -> DataFrame:
    """(id, n, g, a, k, h): every run of pieces that has the size of a whole value."""

    def one(id_, n, rows):
        out = []
        for own in _grouped(rows):
            if len(own) > 1 and not own[0]["quoted"]:
                text = stretch(own, 0, len(own))
                starts, at = [], 0
                for r in own:
                    starts.append(at)
                    at += len(r["text"]) + len(r["joint"])
                for k in sizes:
                    if k > len(own):
                        break
                    for a in range(len(own) - k + 1):
                        out.append({"g": own[0]["g"], "a": a, "k": k, "h": _hash(text[starts[a] : starts[a + k - 1] + len(own[a + k - 1]["text"])])})
        return (id_, n, out) if out else None

    schema = "id binary, n bigint, spans array<struct<g:int,a:int,k:int,h:bigint>>"
    return _map(fields.select("id", "n", "pieces"), one, schema).select("id", "n", F.inline("spans"))


def _solve(edges: DataFrame, rates: dict[str, float], total: float, unseen: float) -> DataFrame:
    """(id, n, posts, joints, path): a field's edges with their expected values and its splits, times its number, and its likeliest path.

    That several pieces are one value only other fields can tell: a run's frequency leaves out what this field gave to it.
    """
    packed = edges.groupBy("id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("g", "a", "k", "h", "size", "gap", "kind", "p", F.coalesce("c", F.lit(0.0)).alias("c")))).alias("edges"))
    usual = PRIOR[0] / sum(PRIOR)

    def one(id_, n, rows):
        posts, joints, path = [], [], []
        for own in _grouped(rows):
            single = [r for r in own if r["k"] == 1]
            between = [(r["gap"], rates.get(r["kind"], usual)) for r in single[:-1]]
            seen = (1 - unseen) / total if total else 0.0
            post, split, way = lattice(len(single), [r["size"] for r in single], between, [(r["a"], r["k"], max(0.0, r["c"] - (r["p"] if r["k"] > 1 else 0.0)) * seen) for r in own], unseen)
            posts += [r | {"p": n * p} for r, p in zip(own, post)]
            joints += [{"kind": r["kind"], "n": float(n), "p": n * p} for r, p in zip(single, split)]
            path += [{"g": own[0]["g"], "a": a, "k": k} for a, k in way]
        return id_, n, posts, joints, path

    return _map(packed, one, "id binary, n bigint, posts array<struct<g:int,a:int,k:int,h:bigint,size:int,gap:int,kind:string,p:double>>, joints array<struct<kind:string,n:double,p:double>>, path array<struct<g:int,a:int,k:int>>")


def _values(df: DataFrame) -> DataFrame:
    """(id, values): the values of every field in order, by its path; a field without a lattice has one a piece."""

    def one(id_, rows, path):
        ways = defaultdict(list)
        for s in path or ():
            ways[s["g"]].append((s["a"], s["k"]))
        out = []
        for own in _grouped(rows):
            if own[0]["quoted"]:
                out.append(unquote(own[0]["text"]))
            else:
                out += [unquote(stretch(own, a, k)) for a, k in ways.get(own[0]["g"]) or [(0, 1)]]
        return id_, [v for v in out if v]

    return _map(df, one, "id binary, values array<string>")
