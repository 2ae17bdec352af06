"""Boilerplate of web pages by a minimum cut over the elements of each page.

Every element of text_nodes is a node. A classifier gives its cost of being content or boilerplate (terminal capacities);
neighbours in a group, members of one group (through a hub node) and neighbouring groups are tied by smoothness edges. The cut
of least cost labels all elements at once; elements of p and h take the label of the text they came from.

The classifier sees how an element recurs: on how many different stories of its host, and how it does on other hosts. These
counts cover all pages and are joined by (host, text hash); no text is shuffled. It is fitted on a bounded sample of pages
whose reliable elements label themselves (texts of many stories and what a recurring heading leads; the headline's block and
long texts of one story).
"""

from __future__ import annotations

import math
import re
from collections import defaultdict, deque

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import maxent
from pagemill.llm.pages import Memo, field_name
from pagemill.packing import map_units, packed, unpack
from pagemill.sources.tables import cut

#: Words that open links to other pages, adverts, and site notices.
_ALSO = re.compile(r"(?i)^(?:læs også|se også|läs (?:också|även)|read (?:also|more|next)|see also|lesen sie auch|siehe auch|(?:à )?lire aussi|à lire|lea también|lee también|leggi anche|lees ook|leia também|читайте также|читайте також|اقرأ أيضا|関連記事|相关阅读|อ่านเพิ่มเติม)\b\s*[:：]")
_ADVERT = re.compile(r"(?i)^(?:annonce|advertisement|advert|sponsored|sponsoreret|anzeige|werbung|annons|publicité|publicidad|publicidade|pubblicità|advertentie|reklame|реклама|إعلان|広告|广告|โฆษณา)\W*$")
_SITE = ("cookie", "©", "all rights", "rettigheder", "newsletter", "nyhedsbrev", "nyhetsbrev", "unsubscribe", "afmelde")
_DIGIT = re.compile(r"\d")
_CONTACT = re.compile(r"@|\d{2}[ .]?\d{2}[ .]\d{2}|^(?:tel|phone|mail|e-mail|tlf)\w*\W", re.I)
UNITS = {"field": "smallint", "pos": "int", "item": "int", "e": "bigint", "n": "bigint", "flags": "int"}


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def describe(text: str) -> tuple[int, int, int]:
    """(text hash, hash with digits masked, flags and length): white space collapsed, one closing stop or comma cut off."""
    core = " ".join(text.split())
    core = core[:-1] if core[-1:] in (".", ",") else core
    e = _hash(core)
    contact = bool(_CONTACT.search(core))
    long_ = not contact and core.count(" ") >= 2 and bool(_DIGIT.search(core))
    low = core.lower()
    flags = bool(_ALSO.match(core)) | bool(_ADVERT.match(core)) << 1 | any(w in low for w in _SITE) << 2 | contact << 3
    flags |= (text.rstrip()[-1:] in ".!?。！？؟…") << 4 | (core[-1:] in ":：") << 5 | ("©" in core) << 6 | min(15, int(math.log2(len(core) + 1))) << 8
    return e, _hash(re.sub(r"\d+", "9", core)) if long_ else e, flags


def page_units(df: DataFrame) -> DataFrame:
    """(page_id, key, host, title, units) of every page with elements, each different delivery once; title: hash of the first line."""

    def make():
        seen = Memo(describe)

        def rows(host, h, p, nodes):
            out = [(1, i, k, *seen[t]) for i, g in enumerate(nodes or ()) for k, t in enumerate(g or ()) if t and t.strip()]
            out += [(0, i, 0, *seen[t]) for i, t in enumerate(p or ()) if t and t.strip()]
            levels = dict(h or ())
            out += [(2 + level, i, 0, *seen[t]) for level in range(1, 7) for i, t in enumerate(levels.get(f"h{level}") or ()) if t and t.strip()]
            return [(-1, 0, 0, _hash(host or ""), 0, 0), *out] if out else []

        return rows

    made = map_units(df.select("page_id", "host", "h", "p", "text_nodes"), "page_id", UNITS, make)
    once = made.groupBy("page_id", F.xxhash64("units").alias("salt")).agg(F.max("units").alias("units"))
    body = F.slice("units", 2, F.size("units") - 1)
    key = F.xxhash64("page_id", "salt")
    return once.select("page_id", key.alias("key"), F.get("units", F.lit(0)).getField("e").alias("host"), F.get("units", F.lit(1)).getField("e").alias("title"), body.alias("units"))


def recurrence(pages: DataFrame, least_stories: int = 5) -> DataFrame:
    """(host, hash, share, g, hosts): the share of the host's different stories with the text; its mean share on hosts with at
    least so many stories and their number. Texts of one story that no other host repeats are left out."""
    units = pages.select("host", "title", F.explode("units").alias("u")).where("u.field = 1")
    each = units.select("host", "title", F.explode(F.array_distinct(F.array("u.e", "u.n"))).alias("hash")).distinct()
    counts = each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("c"))
    stories = pages.select("host", "title").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("stories"))
    shares = counts.join(stories, "host").select("host", "hash", "c", "stories", (F.col("c") / F.col("stories")).alias("share"))
    wide = shares.where(f"stories >= {least_stories}").groupBy("hash").agg(F.avg("share").alias("g"), F.count(F.lit(1)).alias("hosts")).where("hosts >= 2")
    return shares.join(wide, "hash", "left").where("c >= 2 or g >= 0.1").select("host", "hash", F.when(F.col("c") >= 2, F.col("share")).otherwise(0.0).alias("share"), F.coalesce("g", F.lit(0.0)).alias("g"), F.coalesce("hosts", F.lit(0)).alias("hosts"))


def _bin(x: float) -> str:
    return "0" if x <= 0 else "a" if x < 0.1 else "b" if x < 0.2 else "c" if x < 0.35 else "d" if x < 0.6 else "e"


def expand(key: tuple) -> list[str]:
    """The classifier's features of an element, from its discrete properties."""
    s, w, n, where, led, first, mean, size, entries, twice, f = key
    return [
        "s" + s, "g" + w, f"n{n}", "w" + where, f"l{led:d}" + ("f" if first else "r"), "m" + mean, f"L{f >> 8}", f"p{f >> 4 & 1}", "sg" + s + w, "ws" + where + s, "wm" + where + mean, f"z{size}{where}", f"tw{twice:d}{where}",
        *(["entries"] if entries else []), *(["also"] if f & 1 else []), *(["advert"] if f & 2 else []), *(["site"] if f & 4 else []), *(["contact" + where] if f & 8 else []), *(["rights"] if f & 64 else []), *(["colon" + w] if f & 32 else []),
    ]


class Page:
    """The elements of one page, as (field, pos, item, e, n, flags), and how their texts recur, as (hash, share, g, hosts)."""

    def __init__(self, units: list[tuple], stats: list[tuple]):
        self.units = [u for u in units if u[0] == 1]
        self.other = [u for u in units if u[0] != 1]
        best = {s[0]: s[1:] for s in stats}
        nothing = (0.0, 0.0, 0)
        self.stat = [best.get(u[3], nothing) if u[3] == u[4] else max(best.get(u[3], nothing), best.get(u[4], nothing)) for u in self.units]
        self.groups: dict[int, list[int]] = defaultdict(list)
        times: dict[int, int] = defaultdict(int)
        for i, u in enumerate(self.units):
            self.groups[u[1]].append(i)
            times[u[3]] += 1
        heads = {u[3] for u in self.other if u[0] == 3} or ({self.units[0][3]} if self.units else set())
        self.order = order = list(self.groups)
        own = [g for g in order[1:] if any(self.units[i][3] in heads for i in self.groups[g])]
        self.title = order[0] if order else -1
        self.head = own[0] if own else -1
        self.at_head = order.index(self.head) if self.head in self.groups else -1
        self.twice = [times[u[3]] > 1 for u in self.units]
        at = self.at_head if self.at_head >= 0 else len(order)
        #: groups directly under the headline that list contacts, and the next one if it opens with a line found elsewhere on the page (the firm)
        self.entries = {g for g in order[at + 1 : at + 2] if sum(self.units[i][5] >> 3 & 1 for i in self.groups[g]) >= 2}
        if self.entries:
            self.entries |= {g for g in order[at + 2 : at + 3] if self.twice[self.groups[g][0]] and len(self.groups[g]) <= 4 and g != order[-1]}

    def leads(self, g: int) -> bool:
        """Whether a group opens with a heading that recurs on other stories."""
        i = self.groups[g][0]
        return len(self.groups[g]) > 1 and g not in (self.title, self.head) and not self.twice[i] and not self.units[i][5] & 64 and (self.stat[i][0] >= 0.2 or self.stat[i][1] >= 0.15)

    def keys(self) -> list[tuple]:
        """The discrete properties of every element, in order."""
        out: list[tuple] = []
        closed, last = False, len(self.order) - 1
        for k, g in enumerate(self.order):
            members = self.groups[g]
            size, led, entries = len(members), self.leads(g), g in self.entries
            mean = sum(self.stat[i][0] for i in members) / size
            where = "t" if g == self.title else "h" if g == self.head else "?" if self.at_head < 0 else "b" if k < self.at_head else "e" if k == last else "x" if closed else "m"
            closed = closed or (self.at_head >= 0 and k > self.at_head and (led or mean >= 0.5) and not entries)
            bin_, first, small = _bin(mean), True, min(size, 4)
            for i in members:
                s, w, n = self.stat[i]
                out.append((_bin(s), _bin(w), min(n, 3), where, led, first, bin_, small, entries, self.twice[i], self.units[i][5]))
                first = False
        return out

    def reliable(self) -> list[float | None]:
        """1 for sure boilerplate, 0 for sure content, None for the rest."""
        out: list[float | None] = []
        for k, g in enumerate(self.order):
            first = self.groups[g][0]
            led, after = self.leads(g), 0 <= self.at_head < k < len(self.order) - 1
            own = after and self.stat[first][0] < 0.1 and self.stat[first][1] < 0.1
            for i in self.groups[g]:
                s, w, _ = self.stat[i]
                f = self.units[i][5]
                if f & 67:
                    out.append(1.0)
                elif g in (self.title, self.head) or g in self.entries or (own and s < 0.35):
                    out.append(0.0)
                elif s >= 0.4 or led:
                    out.append(1.0)
                elif self.at_head >= 0 and k == self.at_head + 1 and s < 0.1 and w < 0.1 or (after and s < 0.1 and f >> 8 >= 6):
                    out.append(0.0)
                else:
                    out.append(None)
        return out


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source side of a minimum cut.

    costs: capacity from the source (positive) or to the sink (negative). Nodes whose own cost exceeds all their edges are settled
    first (they cannot change sides); the rest goes through maximum flow along shortest augmenting paths.
    """
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    cost, side = list(costs), [None] * n
    todo = list(range(n))
    while todo:
        i = todo.pop()
        if side[i] is None and abs(cost[i]) >= sum(near[i].values()):
            side[i] = cost[i] > 0
            for j, c in near[i].items():
                cost[j] += c if side[i] else -c
                del near[j][i]
                if side[j] is None:
                    todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if side[i] is None]
    if left:
        s, t = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in left} | {s: {}, t: {}}
        for i in left:
            if cost[i] > 0:
                room[s][i], room[i][s] = cost[i], 0.0
            else:
                room[i][t], room[t][i] = -cost[i], 0.0
        while True:
            back = {s: s}
            queue = deque([s])
            while queue and t not in back:
                u = queue.popleft()
                for v, c in room[u].items():
                    if c > 1e-9 and v not in back:
                        back[v] = u
                        queue.append(v)
            if t not in back:
                break
            path, v = [], t
            while v != s:
                path.append((back[v], v))
                v = back[v]
            flow = min(room[u][v] for u, v in path)
            for u, v in path:
                room[u][v] -= flow
                room[v][u] += flow
        for i in left:
            side[i] = i in back
    return side


#: Smoothness: neighbours in a group, member and hub, neighbouring groups' hubs.
NEXT, HUB, BESIDE = 0.4, 0.3, 0.1


def costs_of(model: dict[str, float]) -> Memo:
    """Costs by an element's discrete properties: how much more it costs to keep it than to drop it."""
    return Memo(lambda key: max(-12.0, min(12.0, maxent.score(model, expand(key)))), 30_000_000)


def label(page: Page, costs: Memo) -> list[bool]:
    """True for the boilerplate among the page's elements of text_nodes."""
    cost, edges, hubs = [costs[k] for k in page.keys()], [], {}
    for g in page.order:
        members = page.groups[g]
        hubs[g] = len(cost)
        cost.append(0.0)
        edges += [(a, b, NEXT) for a, b in zip(members, members[1:])] + [(i, hubs[g], HUB) for i in members]
    edges += [(hubs[a], hubs[b], BESIDE) for a, b in zip(page.order, page.order[1:])]
    return min_cut(cost, edges)[: len(page.units)]


def boilerplate_rows(page: Page, costs: Memo) -> list[tuple]:
    """(field, pos, item) of the boilerplate of all fields. An element of p or h takes the label of its text in text_nodes, in order where it
    occurs as often there, else content if any is; without such a text it is content."""
    labels = label(page, costs)
    rows = [u[:3] for u, bad in zip(page.units, labels) if bad]
    places: dict[int, list[bool]] = defaultdict(list)
    for u, bad in zip(page.units, labels):
        if u[1] != page.title or len(page.order) == 1:
            places[u[3]].append(bad)
    seen: dict[tuple, list[tuple]] = defaultdict(list)
    for u in page.other:
        seen[(u[0] == 0, u[3])].append(u)
    for (_, e), own in seen.items():
        found = places.get(e, [])
        bad = found if len(found) == len(own) else [bool(found) and all(found)] * len(own)
        rows += [u[:3] for u, b in zip(own, bad) if b]
    return rows


def _lists(column: pa.ListArray) -> list[list[tuple]]:
    """A list<struct> column as lists of tuples, by column: no dictionary per struct."""
    at, values = column.offsets.to_pylist(), column.values
    flat = list(zip(*(values.field(i).to_pylist() for i in range(values.type.num_fields))))
    return [flat[a:b] for a, b in zip(at, at[1:])]


def boilerplate(df: DataFrame, pages: int = 1500) -> DataFrame:
    """(page_id, field, pos, item) of the boilerplate elements of text_nodes, p and h1…h6 of pages(page_id, host, h, p, text_nodes).

    Null or blank elements and pages without any give nothing; a null host counts as one host; a page without page_id is judged
    alone. Identical deliveries count once, different ones under one page_id are judged each. pages: the bounded sample for fitting.
    """
    found = cut(page_units(df), "units")
    known = recurrence(found)
    each = found.select("key", "host", F.explode("units").alias("u")).where("u.field = 1").select("key", "host", F.explode(F.array_distinct(F.array("u.e", "u.n"))).alias("hash"))
    stats = each.distinct().join(known, ["host", "hash"]).groupBy("key").agg(F.collect_list(F.struct("hash", "share", "g", "hosts")).alias("stats"))
    both = cut(found.join(stats, "key", "left").select("page_id", "units", F.coalesce("stats", F.array()).alias("stats")), "recurring")
    ids = both.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(pages)
    sample = [Page([tuple(u) for u in r.units], [tuple(s) for s in r.stats]) for r in both.join(F.broadcast(ids), "page_id", "left_semi").collect()]
    rows = [(expand(k), y) for page in sample for k, y in zip(page.keys(), page.reliable()) if y is not None]
    shared = df.sparkSession.sparkContext.broadcast(maxent.fit([f for f, _ in rows], [y for _, y in rows], epochs=3))

    def run(batches):
        costs = costs_of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = pa.RecordBatch.from_arrays([c.take(pa.array(range(at, min(at + 512, batch.num_rows)))) for c in batch.columns], batch.schema.names)
                ids, units, stats = part.column(0).to_pylist(), _lists(part.column(1)), _lists(part.column(2))
                done = [boilerplate_rows(Page(u, s), costs) for u, s in zip(units, stats)]
                yield packed(ids, done, {"field": "smallint", "pos": "int", "item": "int"}, "page_id")

    out = both.mapInArrow(run, "page_id bigint, units array<struct<field:smallint,pos:int,item:int>>")
    return unpack(out, "page_id").withColumn("field", field_name())


def main_text(df: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, pos, item, text): the elements of text_nodes that aren't boilerplate, one row each, repeated deliveries once.

    The text moves once: deliveries are joined to their page's labels and made distinct in one partitioning. Pages without an id keep all
    and are spread by their text.
    """
    gone = found.where("field = 'text_nodes' and page_id is not null").groupBy(F.col("page_id").alias("k")).agg(F.collect_set(F.struct("pos", "item")).alias("gone"))
    texts = df.select("page_id", "text_nodes", F.coalesce("page_id", F.xxhash64("text_nodes")).alias("k")).repartition("k")
    each = texts.join(gone, "k", "left").select("k", "page_id", "gone", F.posexplode("text_nodes").alias("pos", "g"))
    each = each.select("k", "page_id", "gone", "pos", F.posexplode("g").alias("item", "text")).where("text is not null and trim(text) != ''")
    kept = each.where(~F.coalesce(F.array_contains("gone", F.struct("pos", "item")), F.lit(False)))
    return kept.select("k", "page_id", "pos", "item", "text").distinct().drop("k")
