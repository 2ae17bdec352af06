"""Elements of stored page results, and bounded samples of pages for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Memo(dict):
    """Results by text within one task: page elements repeat. Emptied when it holds too many characters."""

    def __init__(self, f, most_chars: int = 20_000_000):
        super().__init__()
        self.f, self.most, self.chars = f, most_chars, 0

    def __missing__(self, text):
        if self.chars > self.most:
            self.clear()
            self.chars = 0
        self.chars += len(text) + 100
        self[text] = out = self.f(text)
        return out


def sample_pages(df: DataFrame, pages: int, *columns: str, chars: int = 5000, most: int = 400) -> list:
    """The given columns of `pages` pages, the first by hash of their id: the bounded sample that models are fitted on.

    Of every list the first `most` entries (groups, for lists of lists) of at most `chars` characters; so the driver's share is bounded
    whatever a page holds. Ids are chosen on the id column alone; at most `pages` ids are broadcast.
    """
    short = lambda c: F.slice(F.filter(c, lambda x: F.length(x) <= chars), 1, most)
    kinds = dict(df.dtypes)
    bounded = {"array<string>": lambda c: short(F.col(c)), "array<array<string>>": lambda c: F.transform(F.slice(F.col(c), 1, most), short), "string": lambda c: F.substring(c, 1, chars)}
    ids = df.select("page_id").where("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(pages)
    chosen = df.select("page_id", *[bounded[kinds[c]](c).alias(c) for c in columns]).join(F.broadcast(ids), "page_id", "left_semi")
    return chosen.dropDuplicates(["page_id"]).orderBy("page_id").collect()


def elements(p: list | None, text_nodes: list | None):
    """(field code, pos, item, text) of p (0) and text_nodes (1); nulls are left out."""
    for i, text in enumerate(p or ()):
        if text:
            yield 0, i, 0, text
    for i, group in enumerate(text_nodes or ()):
        for k, text in enumerate(group or ()):
            if text:
                yield 1, i, k, text


FIELDS = ("p", "text_nodes", "descriptions", "h1", "h2", "h3", "h4", "h5", "h6")


def field_name(column: str = "field"):
    """The name of a field code as a Column."""
    return F.get(F.array(*[F.lit(x) for x in FIELDS]), F.col(column).cast("int"))
