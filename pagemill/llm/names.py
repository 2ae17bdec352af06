"""Variant spellings of names: a pigeonhole segment join finds candidates, banded edit distance and name rules verify them.

A string within k edits of another shares one of the other's k+1 segments, as it is or with an exchange over its border, shifted by
k at most. Segments of surnames, keyed by
place, are looked up in an inverted index; the pairs found are verified: surname by edit distance, given name by spelling,
nickname or initial, and middle name, suffix and employer must not contradict. Employers and places are settled first, with the
same join. Sure links form components; spellings that leave something open (an initial, no employer) join a component if just
one fits.

All joins are hinted to merge: Spark judges a table by its file's size, which knows nothing of the segments that a row becomes, and
would broadcast hundreds of MB through the driver.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.tables import cut, discard

#: Nicknames by given name.
NICKNAMES = {
    "alexander": "alex sasha sander sandy xander", "anders": "andy", "benjamin": "ben benny", "birgitte": "birthe gitte", "christopher": "chris topher kit", "dorothea": "dora dorte thea dot dolly",
    "edward": "ed ted eddie ned teddy", "elizabeth": "liz beth lisbeth lizzie betty eliza", "frederik": "fred freddy rik", "gabriella": "gaby ella", "hans-peter": "hp", "ingeborg": "inge borg",
    "jens": "jes", "johannes": "hannes jo johan", "jose": "pepe", "josephine": "jo josie fina fine", "katharina": "kate kat kit trine kathy katja", "kathe": "kat", "kristian": "krille kris chris", "lars": "lasse",
    "leonora": "leo nora", "margrethe": "maggie grethe meg rita", "michael": "mike mick micky", "nikolaj": "nik niko nick klaus", "oluf": "ole", "patricia": "pat trish patsy", "rebekka": "bekka becky",
    "richard": "rick dick rich ricky", "robert": "rob bob bobby robbie", "samuel": "sam sammy", "soren": "sos", "susanne": "sus sanne susi", "theodora": "thea dora teddy", "thomas": "tom tommy", "ulrikke": "rikke ulle ulla",
    "vilhelmine": "mine villa mina", "william": "bill billy will willy", "zacharias": "zach zack", "etienne": "tienne", "margaret": "maggie meg peggy", "james": "jim jimmy", "john": "jack johnny", "henry": "harry hank", "charles": "charlie chuck",
}
_LEGAL = re.compile(r"(?:[\s,]+(?:a\s?/?\s?s|aps|gmbh|ltd|limited|inc|llc|ag|ab|as|bv|(?:&|and|und|og)?\s*co)\b\.?)+\s*\.?$")
_MARKS = str.maketrans({"ø": "o", "æ": "ae", "å": "a", "ß": "ss", "ð": "d", "þ": "th", "ł": "l", "0": "o", "1": "l", "5": "s", "’": "'", "œ": "oe"})


@lru_cache(maxsize=200_000)
def fold(name: str | None) -> str:
    """A name's sound-alike form: small letters without marks, common misreadings and equal sounds made one, doubled letters single.

    Sounds are made one letter by letter as far as can be (kv and qu become ku): so an exchange of neighbours stays one.
    """
    if not name:
        return ""
    t = unicodedata.normalize("NFKD", " ".join(name.lower().split()).translate(_MARKS))
    t = "".join(c for c in t if not unicodedata.combining(c) and (c.isalnum() or c in " -"))
    for a, b in (("aa", "a"), ("ph", "f"), ("th", "t"), ("ck", "k"), ("q", "k"), ("w", "u"), ("v", "u"), ("z", "s"), ("y", "i"), ("x", "ks")):
        t = t.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", t).strip(" -")


def employer_key(name: str | None) -> str:
    """An employer without legal form, case, stops and spaces."""
    t = " ".join((name or "").lower().split())
    return re.sub(r"[\W_]+", "", _LEGAL.sub("", t)) or re.sub(r"[\W_]+", "", t)


def distance(a: str, b: str, most: int) -> int:
    """Edits between two strings (exchanged neighbours count one), at most most + 1. Only a band of 2·most + 1 is filled."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    far = most + 1
    before, row = None, [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        lo, hi = max(1, i - most), min(m, i + most)
        new = [far] * (m + 1)
        if i <= most:
            new[0] = i
        for j in range(lo, hi + 1):
            x = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                x = min(x, before[j - 2] + 1)
            new[j] = min(x, far)
        if min(new[lo - 1 : hi + 1]) > most:
            return far
        before, row = row, new
    return row[m]


#: A given name is taken for a misspelt one if it is so many times rarer than a usual one, or than the other of two.
RARE = 25


def edits(length: int) -> int:
    """Edits allowed for a string of a length."""
    return 0 if length < 3 else 1 if length < 6 else 2


def allowed(length: int) -> int:
    """Edits within which two strings are compared, by the longer's length: two from five letters on, since a folded letter may be two (æ, x)."""
    return 0 if length < 3 else 1 if length < 5 else 2


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """k + 1 segments of a length as (start, length), nearly equal."""
    base, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = base + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def index_keys(text: str) -> list[tuple[int, int, int, str]]:
    """(length, edits, segment, characters) under which a string is found by strings of its length or longer, for each number of edits that
    these allow. An exchange over a border is counted to the segment after it; so every segment is also given with its last character exchanged
    for the first of the next."""
    n, out = len(text), set()
    for k in {allowed(m) for m in range(n, n + 3) if m - n <= allowed(m)}:
        for i, (a, size) in enumerate(segments(n, k)):
            out.add((n, k, i, text[a : a + size]))
            if size and i < k:
                out.add((n, k, i, text[a : a + size - 1] + text[a + size]))
    return sorted(out)


def probe_keys(text: str) -> list[tuple[int, int, int, str]]:
    """The keys of all strings of the same or smaller length that may be within the allowed edits; segments may have shifted.

    With k edits and k + 1 segments, some untouched segment i has just i edits before it and k - i at most after it (the first one up to which
    the edits aren't more than the segments before it). That bounds its shift from both ends.
    """
    n, out = len(text), set()
    k = allowed(n)
    for length in range(max(1, n - k), n + 1):
        for i, (a, size) in enumerate(segments(length, k)):
            for start in range(max(0, a + max(-i, n - length - k + i)), min(n - size, a + min(i, n - length + k - i)) + 1):
                out.add((length, k, i, text[start : start + size]))
    return sorted(out)


def segment_join(strings: DataFrame, block: str, text: str, wanted: str | None = None) -> DataFrame:
    """(block, a, b): different strings of a block that share a segment, each pair once; strings(block, text) are distinct.

    Candidates only: every pair within the allowed edits is among them. The keys are hashed and joined by shuffle, never broadcast; no group is collected.
    wanted: a boolean column; then only pairs of a wanted string a with one that isn't, b.
    """

    @F.pandas_udf("array<string>")
    def index(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [f"{n}.{k}.{i}.{s}" for n, k, i, s in index_keys(t)])

    @F.pandas_udf("array<string>")
    def probe(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [f"{n}.{k}.{i}.{s}" for n, k, i, s in probe_keys(t)])

    rows = strings.select(F.col(block).alias("block"), F.col(text).alias("t"), (F.col(wanted) if wanted else F.lit(False)).alias("w"))
    # nondeterministic: else the optimiser runs the functions once more in filters that it infers from explode
    # wanted strings meet only others: w goes into the key, turned on one side
    w, turned = ("w", F.expr("not w")) if wanted else (F.lit(False), F.lit(False))
    left = rows.select("block", "w", F.col("t").alias("a"), index.asNondeterministic()("t").alias("ks")).select("block", "w", "a", F.explode("ks").alias("k")).select("block", "w", "a", F.xxhash64("block", "k", w).alias("key"))
    right = rows.select("block", "w", F.col("t").alias("b"), probe.asNondeterministic()("t").alias("ks")).select("block", "w", "b", F.explode("ks").alias("k"))
    right = right.select(F.col("block").alias("block2"), F.col("w").alias("w2"), "b", F.xxhash64("block", "k", turned).alias("key"))
    # two edits, exchanges among them, are four of Levenshtein's at most: that leaves few pairs to shuffle and to verify
    found = left.join(right.hint("merge"), "key").where("a != b and block = block2 and levenshtein(a, b, 4) >= 0" + (" and w != w2" if wanted else ""))
    if wanted:
        return found.select("block", F.when(F.col("w"), F.col("a")).otherwise(F.col("b")).alias("a"), F.when(F.col("w"), F.col("b")).otherwise(F.col("a")).alias("b")).distinct()
    return found.select("block", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _nick(a: str, b: str) -> bool:
    return a in _NICK.get(b, ()) or b in _NICK.get(a, ())


_BASES: dict[str, set[str]] = {}
for _k, _v in NICKNAMES.items():
    for _x in _v.split():
        _BASES.setdefault(fold(_x), set()).add(fold(_k))
_NICK = {fold(k): {fold(x) for x in v.split()} for k, v in NICKNAMES.items()}


def given_fits(a: str, b: str, learnt: bool, rare: bool) -> bool:
    """Whether two full given names may be one: spelling (if one of them is rare), nickname, or a shortened form."""
    if a == b or a.replace("-", "") == b.replace("-", "") or _nick(a, b) or learnt:
        return True
    if rare and distance(a, b, edits(min(len(a), len(b)))) <= edits(min(len(a), len(b))):
        return True
    small, big = sorted((a, b), key=len)
    if rare and len(small) >= 3 and any(distance(small, n, 1) <= 1 for n in _NICK.get(big, ())):
        return True
    if rare and any(distance(y, base, edits(len(base))) <= edits(len(base)) for x, y in ((a, b), (b, a)) for base in _BASES.get(x, ())):
        return True  # a nickname of a misspelt name
    return rare and len(small) >= 3 and (big.startswith(small) or (len(small) >= 4 and big.endswith(small)))


def initials(given: str, initial: str) -> set[str]:
    """The letters that may stand for a given name: its own first and those of the names that it is short for."""
    return {initial or given[:1]} | {b[0] for b in _BASES.get(given, ())}


def _parts_of(given: pd.Series, middle: pd.Series, initials: pd.Series, surname: pd.Series, raw: pd.Series, employer: pd.Series, town: pd.Series) -> pd.DataFrame:
    out = []
    for g, m, mi, s, r, e, t in zip(given, middle, initials, surname, raw, employer, town):
        first = fold(g)
        if not first and isinstance(r, str):
            found = re.search(r"(?:^|[\s,])([^\W\d_])\.", r)
            initial = fold(found[1]) if found else ""
        else:
            initial = first[:1]
        mid = fold(m)
        out.append((first, initial, mid, mid[:1] or fold(mi)[:1], fold(s), employer_key(e), " ".join(t.lower().split()) if isinstance(t, str) else ""))
    return pd.DataFrame(out, columns=["g", "i", "m", "mi", "s", "emp", "town"])


def _turn(rows: DataFrame) -> DataFrame:
    """Given name and surname put right where each is far more often the other."""
    use = rows.select(F.explode(F.array(F.struct(F.col("g").alias("t"), F.lit(1).alias("g"), F.lit(0).alias("s")), F.struct(F.col("s").alias("t"), F.lit(0).alias("g"), F.lit(1).alias("s")))).alias("x")).select("x.*").where("t != ''")
    counts = use.groupBy("t").agg(F.sum("g").alias("ng"), F.sum("s").alias("ns"))
    both = rows.join(counts.select(F.col("t").alias("g"), F.col("ng").alias("gg"), F.col("ns").alias("gs")).hint("merge"), "g", "left").join(counts.select(F.col("t").alias("s"), F.col("ng").alias("sg"), F.col("ns").alias("ss")).hint("merge"), "s", "left")
    swap = F.coalesce((F.col("sg") > 3 * F.col("ss")) & (F.col("gg") < 3 * F.col("gs") + 2) & (F.col("g") != ""), F.lit(False))
    turned = both.withColumn("g2", F.when(swap, F.col("s")).otherwise(F.col("g"))).withColumn("s2", F.when(swap, F.col("g")).otherwise(F.col("s")))
    turned = turned.withColumn("i2", F.when(swap, F.substring("g2", 1, 1)).otherwise(F.col("i")))
    return turned.drop("g", "s", "i", "gg", "gs", "sg", "ss").withColumnRenamed("g2", "g").withColumnRenamed("s2", "s").withColumnRenamed("i2", "i")


def _parts(*columns: str):
    return F.pandas_udf(_parts_of, "struct<g:string,i:string,m:string,mi:string,s:string,emp:string,town:string>")(*columns)


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    # 3 where more than the allowed edits are needed
    return pd.Series([d if (d := distance(x, y, k)) <= k else 3 for x, y in zip(a, b) for k in [allowed(max(len(x), len(y)))]], dtype="int32")


def _distance_udf(a: str, b: str):
    return F.pandas_udf(_distances, "int")(a, b)


def _places(rows: DataFrame) -> DataFrame:
    """rows with place (the town, or that of the employer) and firm (its commonest spelling there)."""
    firms = cut(rows.where("emp != '' and town != ''").groupBy("emp", "town").agg(F.count(F.lit(1)).alias("n")), "firms")
    best = firms.groupBy("emp").agg(F.max_by("town", F.struct("n", "town")).alias("near"))
    # employers without a town of their own: the nearest spelling of all that have one, of equally near ones that beside the likest name
    lost = rows.where("town = '' and emp != ''").select("emp").distinct().join(best.hint("merge"), "emp", "left_anti")
    pool = lost.withColumn("lost", F.lit(True)).unionByName(best.select("emp", F.lit(False).alias("lost"))).withColumn("all", F.lit(""))
    close = cut(segment_join(pool, "all", "emp", "lost").withColumn("d", _distance_udf("a", "b")).where("d <= 2").select("a", "b", "d"), "known")
    nearest = close.join(close.groupBy("a").agg(F.min("d").alias("d")).hint("merge"), ["a", "d"]).select("a", "b")
    first = nearest.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("n"))
    tied = nearest.join(first.where("n > 1").select("a").hint("merge"), "a", "left_semi")
    named = rows.where("emp != ''").select("emp", "s", "g").distinct()
    mine, theirs = named.withColumnsRenamed({"emp": "a", "s": "s1", "g": "g1"}), named.withColumnsRenamed({"emp": "b", "s": "s2", "g": "g2"})
    scored = mine.join(tied.hint("merge"), "a").join(theirs.hint("merge"), "b").withColumn("far", F.struct(F.levenshtein("s1", "s2").alias("s"), F.levenshtein("g1", "g2").alias("g")))
    likest = scored.groupBy(F.col("a").alias("emp"), F.col("s1").alias("s"), F.col("g1").alias("g")).agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    near = best.withColumnRenamed("emp", "b")
    found = first.where("n = 1").select(F.col("a").alias("emp"), "b").join(near.hint("merge"), "b").select("emp", "near")
    by_name = likest.join(near.hint("merge"), "b").select("emp", "s", "g", F.col("near").alias("near2"))
    placed = rows.join(best.unionByName(found).hint("merge"), "emp", "left").join(by_name.hint("merge"), ["emp", "s", "g"], "left")
    placed = placed.withColumn("place", F.when(F.col("town") != "", F.col("town")).otherwise(F.coalesce("near", "near2", F.concat(F.lit("@"), F.col("emp"))))).drop("near", "near2")
    placed = cut(placed, "placed")
    spelt = cut(placed.where("emp != ''").groupBy("place", "emp").agg(F.count(F.lit(1)).alias("n")), "spelt")
    close = cut(segment_join(spelt, "place", "emp").withColumn("d", _distance_udf("a", "b")).where("d <= 2"), "close")
    close = close.select("block", "a", "b").union(close.select("block", F.col("b").alias("a"), F.col("a").alias("b")))
    counted = close.join(spelt.select(F.col("place").alias("block"), F.col("emp").alias("b"), F.col("n").alias("nb")).hint("merge"), ["block", "b"])
    counted = counted.join(spelt.select(F.col("place").alias("block"), F.col("emp").alias("a"), F.col("n").alias("na")).hint("merge"), ["block", "a"]).where("nb > na or (nb = na and b < a)")
    canon = counted.groupBy("block", "a").agg(F.max_by("b", F.struct("nb", "b")).alias("firm")).select(F.col("block").alias("place"), F.col("a").alias("emp"), "firm")
    return placed.join(canon.hint("merge"), ["place", "emp"], "left").withColumn("firm", F.coalesce("firm", "emp"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, comp): connected components of edges(a, b) by spreading the least label; every round is written to the shared folder."""
    labels = table = cut(nodes.select("node", F.col("node").alias("comp")), "labels")
    links = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    while True:
        spread_ = links.join(labels.withColumnRenamed("node", "b").hint("merge"), "b").groupBy("a").agg(F.min("comp").alias("near")).withColumnRenamed("a", "node")
        new = labels.join(spread_.hint("merge"), "node", "left").select("node", F.least("comp", F.coalesce("near", "comp")).alias("comp"), (F.coalesce("near", "comp") < F.col("comp")).alias("moved"))
        jumped = cut(new.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("beyond")).hint("merge"), "comp", "left").select("node", F.least("comp", F.coalesce("beyond", "comp")).alias("comp"), "moved"), "labels")
        discard(table)
        labels, table = jumped.select("node", "comp"), jumped
        if not jumped.where("moved").limit(1).count():
            discard(links)
            return labels


def entities(names: DataFrame) -> DataFrame:
    """(name_id, entity, links): the person of every row that names one, and how many other rows it is linked to.

    names: name_id, raw_name, given_name, middle_name, middle_initials, surname, generational_suffix, employer, town. Rows without
    any part, without a surname, or without a name_id name no person here and are left out; rows without employer and town
    stand at no place and link to no other; repeated rows count once; other columns aren't read.
    """
    parts = _parts("given_name", "middle_name", "middle_initials", "surname", "raw_name", "employer", "town")
    suffix = F.coalesce(F.lower(F.regexp_replace("generational_suffix", r"\W", "")), F.lit(""))
    named = names.where("name_id is not null and surname is not null")
    rows = named.select(F.col("name_id").cast("bigint").alias("name_id"), parts.alias("p"), suffix.alias("suffix"))
    rows = rows.select("name_id", "p.*", "suffix").where("s != ''").distinct()
    rows = _places(cut(_turn(cut(rows, "names")), "turned"))
    rows = rows.withColumn("place", F.when((F.col("town") == "") & (F.col("emp") == ""), F.concat(F.lit("#"), F.col("name_id"))).otherwise(F.col("place")))
    rows = cut(rows.withColumn("node", F.xxhash64("place", "firm", "g", "i", "m", "mi", "s", "suffix")), "rows")
    cols = ["node", "place", "firm", "g", "i", "m", "mi", "s", "suffix"]
    often = lambda c: rows.where(f"{c} != ''").groupBy(c).agg(F.count(F.lit(1)).alias("n" + c))
    surnames, givens = cut(often("s"), "surnames"), cut(often("g"), "givens")
    # how often the name of a usual row occurs: half of the rows have a commoner one. Names typed right have such counts, whatever the table's size
    usual = lambda counts, c: float(counts.agg(F.percentile(c, F.lit(0.5), F.col(c))).first()[0] or 0.0)
    usual_s, usual_g = usual(surnames, "ns"), usual(givens, "ng")
    forms = cut(rows.select(cols).distinct().join(surnames.hint("merge"), "s", "left").join(givens.hint("merge"), "g", "left").na.fill({"ns": 0, "ng": 0}), "forms")
    spelt = forms.select("place", "s").distinct()
    near = segment_join(spelt, "place", "s").withColumn("d", _distance_udf("a", "b")).where("d <= 2").drop("d")
    same = spelt.select(F.col("place").alias("block"), F.col("s").alias("a"), F.col("s").alias("b"))
    pairs = near.union(same)
    left = forms.select(*[F.col(c).alias(c + "1") for c in [*cols, "ns", "ng"]])
    right = forms.select(*[F.col(c).alias(c + "2") for c in [*cols, "ns", "ng"]])
    on = pairs.join(left.hint("merge"), (F.col("block") == F.col("place1")) & (F.col("a") == F.col("s1"))).join(right.hint("merge"), (F.col("block") == F.col("place2")) & (F.col("b") == F.col("s2")))
    quiet = lambda c: f"({c}1 = '' or {c}2 = '' or {c}1 = {c}2)"
    # two spellings that are both common are two names: one of them must be a quarter as frequent as a usual name or as the other, or single
    unlike = f"(s1 = s2 or least(ns1, ns2) = 1 or least(ns1, ns2) * 4 <= {usual_s} or least(ns1, ns2) * 4 <= greatest(ns1, ns2))"
    open_ = on.where("node1 != node2 and (a != b or node1 < node2)").where(" and ".join([quiet("firm"), quiet("suffix"), quiet("mi"), unlike, "(g1 = '' or g2 = '' or substring(g1,1,1) = substring(g2,1,1) or length(g1) >= 2)"]))
    full = cut(open_, "candidates")
    met = full.where("g1 != '' and g2 != '' and g1 != g2 and s1 = s2").select(F.least("g1", "g2").alias("x"), F.greatest("g1", "g2").alias("y"), F.xxhash64("block", "s1").alias("at")).distinct()
    seen = forms.where("g != ''").select("g", "place", "s").distinct().groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    learnt = met.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    learnt = learnt.join(seen.select(F.col("g").alias("x"), F.col("c").alias("cx")).hint("merge"), "x").join(seen.select(F.col("g").alias("y"), F.col("c").alias("cy")).hint("merge"), "y")
    learnt = learnt.where("n >= 0.25 * least(cx, cy)").select("x", "y", F.lit(True).alias("learnt"))

    @F.pandas_udf("boolean")
    def fits(s1: pd.Series, s2: pd.Series, g1: pd.Series, g2: pd.Series, i1: pd.Series, i2: pd.Series, n1: pd.Series, n2: pd.Series, m1: pd.Series, m2: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for e, f, a, b, x, y, p, q, u, v, k in zip(s1, s2, g1, g2, i1, i2, n1, n2, m1, m2, known):
            if u and v and len(u) > 1 and len(v) > 1 and distance(u, v, 2) > 2 and not _nick(u, v):
                out.append(False)
            elif a and b and a != b and distance(e, f, 1) > 1:
                out.append(False)  # two edits in the surname and another given name are too much
            elif a and b:
                out.append(given_fits(a, b, bool(k), min(p, q) == 1 or min(p, q) * RARE <= max(usual_g, p, q)))
            else:
                out.append(not x or not y or bool(initials(a, x) & initials(b, y)))
        return pd.Series(out)

    judged = full.join(learnt.hint("merge"), (F.least("g1", "g2") == F.col("x")) & (F.greatest("g1", "g2") == F.col("y")), "left").withColumn("learnt", F.coalesce("learnt", F.lit(False)))
    links = cut(judged.where(fits("s1", "s2", "g1", "g2", "i1", "i2", "ng1", "ng2", "m1", "m2", "learnt")).select("node1", "node2", "g1", "g2", "i1", "i2", "s1", "s2", "firm1", "firm2", "mi1", "mi2", "suffix1", "suffix2"), "fits")
    sure = "(g{0} != '' and firm{0} != '')"
    strong = links.where(f"{sure.format(1)} and {sure.format(2)}").select(F.col("node1").alias("a"), F.col("node2").alias("b"))
    comps = components(strong, forms.select("node"))
    # what leaves something open joins by the likest spelling that fits anybody
    comps = _attach(comps, links.where("g1 != '' and g2 != ''"), forms.where("g != '' and firm = ''").select("node"), ("s1 = s2 and g1 = g2", "s1 = s2 or g1 = g2", "true"))
    comps = _attach(comps, links, forms.where("g = ''").select("node"), ("s1 = s2 and i1 = i2", "i1 = i2", "true"))
    out = rows.select("name_id", "node").distinct().join(comps.hint("merge"), "node").select("name_id", F.col("comp").alias("entity")).distinct()
    size = out.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return out.join(size.hint("merge"), "entity").select("name_id", "entity", "links")


def _attach(comps: DataFrame, links: DataFrame, loose: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """The components after loose nodes joined the one component that they fit, stage by stage of ever weaker links. Where several fit, a
    node stays alone; loose nodes that fit no other component link among themselves."""
    both = links.withColumnsRenamed({"node1": "a", "node2": "b"}).unionByName(links.withColumnsRenamed({"node2": "a", "node1": "b"}))
    mine = cut(both.join(loose.withColumnRenamed("node", "a").hint("merge"), "a", "left_semi"), "mine")
    fixed = cut(comps.join(loose.hint("merge"), "node", "left_anti"), "fixed")
    outer = mine.join(fixed.withColumnRenamed("node", "b").hint("merge"), "b")
    best = None
    for rank, stage in enumerate(stages):
        fit = outer.where(stage).groupBy("a").agg(F.min("comp").alias("one"), F.max("comp").alias("other")).withColumn("rank", F.lit(rank))
        best = fit if best is None else best.unionByName(fit)
    fit = cut(best.groupBy("a").agg(F.min_by(F.struct("one", "other"), "rank").alias("v")).select(F.col("a").alias("node"), "v.*"), "fit")
    chosen = fit.where("one = other").select("node", F.col("one").alias("joined"))
    free = loose.join(fit.select("node").hint("merge"), "node", "left_anti")
    among = mine.join(free.withColumnRenamed("node", "a").hint("merge"), "a", "left_semi").join(free.withColumnRenamed("node", "b").hint("merge"), "b", "left_semi")
    alone = components(among, free).select("node", F.col("comp").alias("joined2"))
    return cut(comps.join(chosen.hint("merge"), "node", "left").join(alone.hint("merge"), "node", "left").select("node", F.coalesce("joined", "joined2", "comp").alias("comp")), "attached")


def pairs(found: DataFrame) -> DataFrame:
    """(name_id_a, name_id_b): all pairs of rows of one person, the smaller id first."""
    a, b = found.select("entity", F.col("name_id").alias("name_id_a")), found.select("entity", F.col("name_id").alias("name_id_b"))
    return a.join(b.hint("merge"), "entity").where("name_id_a < name_id_b").select("name_id_a", "name_id_b")
