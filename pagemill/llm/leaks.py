"""Evaluation texts in a corpus: a distributed positional inverted index, searched from the rarest terms of each item.

The index holds the places of every term of the items in every document. Each item is cut into segments of a few words; the rarest
terms of each segment are its anchors, so a longer item has more. Their postings are intersected by offset (place in the document
less place in the item): documents where anchors agree within an interruption's length are candidates, and the postings of all the
item's terms then give the longest phrase in order, with its places. A document leaks an item if that phrase is long and dense enough.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.sources.tables import cut

_MARKUP = r"\[/?\w{1,12}(?:=[^\]\n]{0,80})?\]|</?\w{1,12}(?:\s[^>\n]{0,200})?>"
_TOKEN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]]+"
#: Most terms or anchors of all items that are broadcast; beyond, the join shuffles.
MOST_TERMS = 500_000


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, term): the words in small letters, markup taken out; scripts without spaces by character. All JVM-side."""
    plain = F.regexp_replace(F.col(text), _MARKUP, "")
    return df.select(key, F.posexplode(F.regexp_extract_all(F.lower(plain), F.lit(_TOKEN), F.lit(0))).alias("pos", "term"))


def build_index(documents: DataFrame, key: str, text: str, terms: DataFrame | None = None) -> DataFrame:
    """Postings (term, key, places): all places of a term in a document; of the given terms only, if given."""
    words = tokens(documents.where(F.col(key).isNotNull()), key, text)
    if terms is not None:
        words = words.join(F.broadcast(terms) if terms.count() <= MOST_TERMS else terms, "term", "left_semi")
    return words.groupBy("term", key).agg(F.array_sort(F.collect_set("pos")).alias("places"))


def anchors(items: DataFrame, frequency: DataFrame, words: int = 10, each: int = 2) -> DataFrame:
    """(item_id, term, at): the rarest terms that occur at all, `each` per segment of about so many words; an item has four segments at least."""
    size = items.groupBy("item_id").agg((F.max("pos") + 1).alias("size"))
    segments = F.greatest(F.lit(4), F.ceil(F.col("size") / words))
    placed = items.join(size, "item_id").withColumn("segment", F.floor(F.col("pos") * segments / F.col("size")))
    rank = F.row_number().over(Window.partitionBy("item_id", "segment").orderBy("df", "term", "pos"))
    return placed.join(frequency, "term").withColumn("rank", rank).where(f"rank <= {each}").select("item_id", "term", F.col("pos").alias("at"))


def windows(hits: list[tuple[int, int]], size: int, slack: int) -> list[tuple[int, int]]:
    """Stretches of a document where two anchors or more agree in offset within slack, as (first place, last place), item-wide margins added."""
    hits = sorted(set(hits))
    out: list[tuple[int, int]] = []
    for i, (p, a) in enumerate(hits):
        for q, b in hits[i + 1 :]:
            if q - p > size + slack:
                break
            if b > a and abs((q - b) - (p - a)) <= slack:
                lo, hi = p - size, q + size
                if out and lo <= out[-1][1]:
                    out[-1] = (out[-1][0], max(hi, out[-1][1]))
                else:
                    out.append((lo, hi))
                break
    return out


def longest(item: list[str], places: dict[str, list[int]], span: tuple[int, int]) -> tuple[float, float, int, int, int, int]:
    """(share, density, first and last word in the item, first and last place in the document) of the best passage: the longest run of item words in the same order in a stretch of a document, cut to the part
    where matched words most outweigh the item's words left out and the other words between them (an interruption counts as four at most). share: that part's length in the item over the
    item's; density: the part's matched words over its length."""
    tails: list[int] = []
    ends: list[int] = []  # by length of run: the last node
    nodes: list[tuple[int, int, int]] = []  # (item place, place, node before)
    for i, term in enumerate(item):
        found = places.get(term)
        if not found:
            continue
        lo, hi = bisect_left(found, span[0]), bisect_left(found, span[1] + 1)
        for p in reversed(found[lo:hi]):
            k = bisect_left(tails, p)
            nodes.append((i, p, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(p)
                ends.append(len(nodes) - 1)
            else:
                tails[k], ends[k] = p, len(nodes) - 1
    run, at = [], (ends[-1] if ends else -1)
    while at >= 0:
        i, p, at = nodes[at]
        run.append((i, p))
    run.reverse()
    best, score, first = (0, 0, 0), 0.0, 0
    for k, (i, p) in enumerate(run):
        lost = 0.0
        if k:
            skipped, apart = i - run[k - 1][0] - 1, p - run[k - 1][1] - 1
            lost = skipped + min(4, max(0, apart - skipped))
        if score - lost <= 0:
            score, first = 0.0, k
        else:
            score -= lost
        score += 1
        if score > best[0]:
            best = (score, first, k)
    if not run:
        return 0.0, 0.0, -1, -1, -1, -1
    (i, p), (k, q) = run[best[1]], run[best[2]]
    length = k - i + 1
    return length / len(item), (best[2] - best[1] + 1) / length, i, k, p, q


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = 0.48, density: float = 0.75, slack: int = 60) -> DataFrame:
    """(key, item_id, share, density, item_from, item_to, start, end, exact): the documents that hold a passage of an item.

    share, density: least length of the passage over the item's, and least part of its words found as they are (the rest may be
    misspelt). item_from, item_to, start, end: the passage's first and last word in the item and in the document, counted in words
    without markup; exact: every word of it stands there, nothing between. slack: the longest interruption in words. Null and empty
    texts hold nothing; items without words have no leaks; documents without a key are left out; repeated deliveries count once.
    Neither items nor documents reach the driver.
    """
    items = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), F.col(item_text).alias("item_text"))
    parts = cut(tokens(items, "item_id", "item_text").distinct(), "items")
    postings = cut(build_index(documents.select(key, text), key, text, parts.select("term").distinct()), "postings")
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    words = cut(parts.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "term"))).alias("all")).select("item_id", F.col("all.term").alias("words"), F.size("all").alias("size")), "words")
    chosen = cut(anchors(parts, frequency), "anchors")
    few = chosen.count() <= MOST_TERMS
    hits = postings.join(F.broadcast(chosen) if few else chosen, "term").select(key, "item_id", "at", F.explode("places").alias("place"))
    grouped = hits.groupBy(key, "item_id").agg(F.collect_list(F.struct("place", "at")).alias("hits")).where(F.size(F.array_distinct("hits.at")) >= 2).join(words.select("item_id", "size"), "item_id")

    @F.pandas_udf("array<struct<lo:int,hi:int>>")
    def stretch(size: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([[{"lo": a, "hi": b} for a, b in windows([(h["place"], h["at"]) for h in f], int(n), slack)] for n, f in zip(size, found)])

    candidates = cut(grouped.select(key, "item_id", stretch.asNondeterministic()("size", "hits").alias("spans")).where("size(spans) > 0"), "candidates")
    wanted = candidates.select(key).distinct()
    held = postings.join(wanted, key, "left_semi").groupBy(key).agg(F.collect_list(F.struct("term", "places")).alias("terms"))

    @F.pandas_udf("struct<share:double,density:double,item_from:int,item_to:int,start:int,end:int>")
    def cover(item: pd.Series, spans: pd.Series, terms: pd.Series) -> pd.DataFrame:
        out = []
        for own, s, t in zip(item, spans, terms):
            places, own = {x["term"]: list(x["places"]) for x in t}, list(own)
            out.append(max((longest(own, places, (x["lo"], x["hi"])) for x in s), key=lambda r: r[0] * (r[1] >= density)))
        return pd.DataFrame(out, columns=["share", "density", "item_from", "item_to", "start", "end"])

    done = candidates.join(words, "item_id").join(held, key).select(key, "item_id", cover.asNondeterministic()("words", "spans", "terms").alias("c")).select(key, "item_id", "c.*")
    exact = (F.col("density") == 1.0) & (F.col("end") - F.col("start") == F.col("item_to") - F.col("item_from"))
    return done.where((F.col("share") >= share) & (F.col("density") >= density)).withColumn("exact", exact)


def leak_report(found: DataFrame) -> DataFrame:
    """(item_id, documents, best): by item, how many documents leak it and the largest share of it in one."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("best"))
