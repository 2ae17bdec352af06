"""Text functions: native Column expressions, and the same in Python where a whole page is worked on at once.

White space is Unicode White_Space throughout. Null gives null; empty strings stay empty strings.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
_WS = r"\p{IsWhite_Space}"
#: Fixed values, Java syntax: atom characters and labels of addresses; what a sentence is split at.
_ATOM = r"[A-Za-z0-9!#$%&'*+\-/=?^_`{|}~\x{80}-\x{10FFFF}]"
_LABEL = r"[A-Za-z0-9\x{80}-\x{10FFFF}](?:[A-Za-z0-9\x{80}-\x{10FFFF}-]*[A-Za-z0-9\x{80}-\x{10FFFF}])?"
EMAIL = rf"(?:\G|(?<!{_ATOM})){_ATOM}+(?:\.{_ATOM}+)*@{_LABEL}(?:\.{_LABEL})+"
SPLIT = r"\||\p{Zs}-|-\p{Zs}"
_DOT_WORDS = ("net", "travis", "git", "gitignore", "com", "gov", "org")


# --- native ---------------------------------------------------------------------------------------------------------------


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{_WS}+|{_WS}+$", "")


def collapse(c: Column) -> Column:
    """Words joined by one space."""
    return trim(F.regexp_replace(c, rf"{_WS}+", " "))


def normalize(c: Column) -> Column:
    """Collapsed, without one closing stop or comma."""
    return F.regexp_replace(collapse(c), r"[.,]\z", "")


def count_words(c: Column) -> Column:
    """0 for an empty string, else one more than the ASCII letters, digits and signs that follow ASCII white space."""
    return F.when(F.length(c) == 0, 0).otherwise(F.lit(1) + F.regexp_count(c, F.lit(r"[ \t\n\f\r](?=[!-~])"))).cast("int")


def split_sentence(c: Column) -> Column:
    """The parts between bars and spaced hyphens, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(c, SPLIT, -1), trim), lambda x: x != "")


def separate_lines(lines: Column) -> Column:
    """Every line end as an element of its own between the texts; \\r counts as a line end; empty strings vanish."""
    return F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(F.replace(x, F.lit("\r"), F.lit("\n")), F.lit(r"(\n|[^\n]+)"), F.lit(1))))


def join_pattern(codes: list[str]) -> str:
    """What join_sentences deletes: the space after opening and before closing marks, but not before a dot word such as .net or .dk."""
    words = "|".join([r"[0-9]+(?:e[0-9]+)?", "inf", "infinity", "nan", *_DOT_WORDS, *[re.escape(x.lower()) for x in codes]])
    return rf"(?<=[\p{{Pi}}\p{{Ps}}¡¿]) | (?=[\p{{Pf}}\p{{Pe}},;:!?…])| (?=\.)(?!\.(?i:{words})(?![\p{{L}}\p{{N}}]))"


def join_sentences(lines: Column, codes: list[str]) -> Column:
    return F.regexp_replace(collapse(F.array_join(lines, " ")), join_pattern(codes), "")


def clean_texts(texts: Column) -> Column:
    """Trimmed texts that are neither empty nor look like markup."""
    return F.filter(F.transform(texts, trim), lambda x: (x != "") & ~(x.contains("<") & x.contains(">") & (x.contains("</") | x.contains("/>"))))


def without_stops(texts: Column, stop: str) -> Column:
    """Texts with all matches of a stop pattern removed (case ignored), collapsed; notices and empty ones left out."""
    done = F.transform(texts, lambda x: collapse(F.regexp_replace(x, f"(?iu)(?:{stop})", "") if stop else x))
    return F.filter(done, lambda x: ~F.lower(x).contains("cookie") & ~x.contains("©") & (count_words(x) > 0))


def order_paragraphs(texts: Column) -> Column:
    """Texts of more than two words, the longest (in words) first, ties in order."""
    ranked = F.transform(texts, lambda x, i: F.struct((-count_words(x)).alias("n"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(F.filter(ranked, lambda r: r["n"] < -2)), lambda r: r["x"])


def emails(c: Column) -> Column:
    """Addresses in raw text in order, copies kept, without quotation marks round them."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1)), lambda x: F.regexp_replace(x, r"^'+|'+$", ""))


# --- in Python ------------------------------------------------------------------------------------------------------------


def strip(s: str) -> str:
    return s.strip(_SPACES)


_RUN = re.compile(f"[{_SPACES}]+")


def squeeze(s: str) -> str:
    return strip(_RUN.sub(" ", s))


def tidy(s: str) -> str:
    s = squeeze(s)
    return s[:-1] if s.endswith((".", ",")) else s


def word_count(s: str) -> int:
    return 1 + len(re.findall(r"[ \t\n\f\r](?=[!-~])", s)) if s else 0


def looks_like_markup(s: str) -> bool:
    return "<" in s and ">" in s and ("</" in s or "/>" in s)


_SPLIT = regex.compile(SPLIT)


def split_py(s: str, stop_words: set[str] | None = None) -> list[str]:
    """As split_sentence; with stop words also cut at these (case ignored), which go."""
    parts = [strip(x) for x in _SPLIT.split(s)]
    if stop_words:
        cut: list[str] = []
        for part in parts:
            own: list[str] = []
            for word in part.split():
                if word.lower() in stop_words:
                    cut.append(" ".join(own))
                    own = []
                else:
                    own.append(word)
            cut.append(" ".join(own))
        parts = cut
    return [x for x in parts if x]


class Grouper:
    """Text nodes of a page to groups of sentences. codes: two-letter codes that may follow a dot."""

    def __init__(self, codes: list[str]):
        self.join_re = regex.compile(join_pattern(codes))
        self.ties_left = regex.compile(r"[\p{Pi}\p{Ps}¡¿,:]$")
        self.ties_right = regex.compile(r"[\p{Pf}\p{Pe}.,;:!?…]")

    def join(self, lines: list[str]) -> str:
        return self.join_re.sub("", squeeze(" ".join(lines)))

    def tied(self, left: str, right: str) -> bool:
        return left[-1:] in _SPACES or right[:1] in _SPACES or bool(self.ties_left.search(left)) or bool(self.ties_right.match(right))

    def regroup(self, lines: list[str]) -> list[str]:
        """Lines that belong together joined, each result split into sentences."""
        if len(lines) == 1:
            return split_py(lines[0])
        runs: list[list[str]] = []
        for line in lines:
            if runs and self.tied(runs[-1][-1], line):
                runs[-1].append(line)
            else:
                runs.append([line])
        return [s for run in runs for s in split_py(self.join(run))]

    def group(self, nodes: list[str], min_split: int | None = None) -> list[list[str]] | None:
        """Groups of sentences, parted where at least min_split line ends stand in a row; None for no nodes, each line alone for 0."""
        if not nodes:
            return None
        least = usual_split(nodes) if min_split is None else min_split
        out: list[list[str]] = []
        own: list[str] = []
        ends = 0

        def flush() -> None:
            nonlocal own, ends
            if own:
                out.append(own if least == 0 else self.regroup(own))
                own, ends = [], 0

        for line in lines_of(nodes):
            if line == "\n":
                ends += 1
            elif strip(line) and not strip(line).startswith("<"):
                own.append(line)
                ends = 0
            if ends >= least:
                flush()
        flush()
        return [g for g in out if g]


def lines_of(nodes: list[str]) -> list[str]:
    return [x for n in nodes for x in re.findall(r"\n|[^\n]+", n.replace("\r", "\n"))]


def usual_split(nodes: list[str]) -> int:
    """How many line ends part two groups: the upper median of the runs between texts, one more if some run is longer."""
    runs, run, seen = [], 0, False
    for node in nodes:
        if node == "\n":
            run += 1
        elif strip(node):
            if seen and run:
                runs.append(run)
            run, seen = 0, True
    if not runs:
        return 1
    middle = sorted(runs)[len(runs) // 2]
    return middle + 1 if max(runs) > middle else middle


def country_codes(spark) -> list[str]:
    """The two-letter country codes that the JVM knows."""
    return [str(x).lower() for x in spark._jvm.java.util.Locale.getISOCountries()]
