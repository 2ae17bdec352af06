"""Mixing sources to target weights: the cube method draws the documents.

Every document of a source gets the same number of copies in expectation: the whole part is taken, the rest is an inclusion
probability. The flight phase moves the vector of probabilities at random along the null space of the constraints (number of
documents and of tokens stay what they are) until each is 0 or 1, but for two units at most. Each move settles the largest unit
left against all smaller ones, which give way a little each; so the units left over are the smallest. It runs in blocks of
bounded size; the units left over by all blocks form the blocks of the next round, until one block a source is left. Its landing
problem has two small units or fewer and is solved by the draw that misses the totals least.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.sources.tables import cut

def token_counts(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """df with tokens, the size of the text in tokens of a public tokenizer (0 for null and empty texts); whole texts.

    tokenizer: path of its vocabulary file, which every executor can read.
    """

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_encoder(tokenizer)(texts))

    return df.withColumn("tokens", F.when(F.col(text).isNull() | (F.col(text) == ""), F.lit(0)).otherwise(count(text)).cast("bigint"))


_ENCODERS: dict = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True

        def sizes(texts) -> list[int]:
            out = []
            for at in range(0, len(texts), 64):
                out += [len(e.ids) for e in t.encode_batch([x or "" for x in texts[at : at + 64]], add_special_tokens=False)]
            return out

        _ENCODERS[path] = sizes
    return _ENCODERS[path]


def _direction(q: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """How all smaller units give way, by p(1-p)(a + b·size), when the first one goes up by 1, so that both totals stay; None if they can't."""
    w, s = q[1:] * (1 - q[1:]), size[1:]
    n, t, tt = w.sum(), w @ s, w @ (s * s)
    det = n * tt - t * t
    if np.ptp(size) == 0:
        return np.concatenate([[1.0], -w / n])
    if det <= 1e-9 * n * tt:
        return None
    a, b = (tt - t * size[0]) / det, (n * size[0] - t) / det
    return np.concatenate([[1.0], -w * (a + b * s)])


def flight(p: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """Inclusion probabilities p after the flight phase: 0 or 1 but for two units at most, the smallest ones, with Σp·x as before.

    Every move settles the largest open unit, up or down with the odds that leave all probabilities as they were in expectation, along the
    direction that keeps both totals. Where the smaller units can't give way that far within 0 and 1, the number of documents
    is given up for this move, and the smaller ones make room in proportion; a unit that there is no room for is left out, one that
    couldn't be replaced is taken.
    """
    p, eps = np.clip(p.astype(float), 0.0, 1.0), 1e-9
    rng = np.random.default_rng(seed)
    order = np.argsort(-x, kind="stable")
    open_ = order[(p[order] > eps) & (p[order] < 1 - eps)]
    q, size = p[open_], x[open_].astype(float)
    while len(q) > 2:
        own, u = q[0], _direction(q, size)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))) if u is not None else 0.0
            down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf))) if u is not None else 0.0
        taken = rng.random() < own
        if up >= 1 - own - eps and down >= own - eps:
            q = q + ((1 - own) if taken else -own) * u
        else:
            held, free = q[1:] @ size[1:], (1 - q[1:]) @ size[1:]
            fits, spared = (1 - own) * size[0] <= held, own * size[0] <= free
            taken = taken if fits == spared else fits
            if taken:
                q[1:] *= 1 - min(1.0, (1 - own) * size[0] / held) if held > 0 else 1.0
            else:
                q[1:] = 1 - (1 - q[1:]) * (1 - min(1.0, own * size[0] / free) if free > 0 else 1.0)
        q = np.clip(q, 0.0, 1.0)
        q[0] = float(taken)
        near = (q <= eps) | (q >= 1 - eps)
        p[open_[near]] = np.round(q[near])
        open_, q, size = open_[~near], q[~near], size[~near]
    p[open_] = q
    p[p <= eps], p[p >= 1 - eps] = 0.0, 1.0
    return p


def landing(p: np.ndarray, x: np.ndarray, seed: int) -> np.ndarray:
    """The last fractional units settled: of all ways to settle them the one that misses the token total least, ties at random."""
    p, left = p.copy(), np.flatnonzero((p > 0) & (p < 1))
    if len(left):
        want, rng = float(p[left] @ x[left]), np.random.default_rng(seed)
        ways = [np.array([(k >> j) & 1 for j in range(len(left))], float) for k in range(1 << len(left))]
        p[left] = min(ways, key=lambda w: (abs(float(w @ x[left]) - want), rng.random()))
    return p


def plan(totals: dict[str, int], targets: list[tuple[str, float, int]], total: int | None) -> tuple[float, dict[str, float]]:
    """(total tokens, copies per document by source). Without a total: the largest at which no source exceeds its repeats. A source without
    tokens gives nothing, the others keep their proportions. A larger total than feasible is lowered to the feasible one."""
    live = [(s, w, m) for s, w, m in targets if totals.get(s, 0) > 0 and w > 0 and m > 0]
    if not live:
        return 0.0, {}
    share = sum(w for _, w, _ in live)
    feasible = min(m * totals[s] / (w / share) for s, w, m in live)
    size = feasible if total is None else min(float(total), feasible)
    return size, {s: min(float(m), size * (w / share) / totals[s]) for s, w, m in live}


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, *, tokenizer: str, seed: int = 1, block: int = 5000) -> DataFrame:
    """(key, source, tokens, copies) of the drawn documents.

    targets: source, target_share, max_repeats (few rows; they reach the driver). Documents without a key or a source, or of a source
    without a target, aren't drawn; repeated deliveries of a key count once. No document has more copies than its source's
    max_repeats. Sizes balance up to the last two units of a source, its smallest. block: documents of a flight in one task, about.
    tokenizer: path of a public tokenizer's vocabulary file.
    """
    wanted = [(r.source, float(r.target_share), int(r.max_repeats)) for r in targets.where("source is not null and target_share is not null and max_repeats is not null").select("source", "target_share", "max_repeats").distinct().orderBy("source").collect()]
    names = [s for s, _, _ in wanted]
    docs = documents.select(F.col(key).cast("bigint").alias(key), F.col(source).alias("source"), F.col(text).alias("_text")).where(F.col(key).isNotNull() & F.col("source").isin(names))
    sized = cut(token_counts(docs, tokenizer, "_text").groupBy(key).agg(F.min_by(F.struct("source", "tokens"), F.struct("source", "tokens")).alias("v")).select(key, "v.*"), "sized")
    sums = {r.source: (r.t, r.n) for r in sized.groupBy("source").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    _, copies = plan({s: t for s, (t, _) in sums.items()}, wanted, total)
    if not copies:
        return sized.where("false").withColumn("copies", F.lit(0))
    rates = F.create_map(*[x for s, r in copies.items() for x in (F.lit(s), F.lit(r))])
    base = sized.withColumn("rate", rates[F.col("source")]).where("rate is not null").withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("int")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    cores = documents.sparkSession.sparkContext.defaultParallelism
    todo, done, many, round_ = base, None, max(n for _, n in sums.values()), 0
    schema = f"{key} bigint, source string, tokens bigint, whole int, p double"

    while True:
        blocks, last = max(1, math.ceil(many / block)), many <= block
        flown = todo.withColumn("block", F.pmod(F.xxhash64(F.lit(seed * 100 + round_), F.col(key)), F.lit(blocks)))
        # a number of its own: small rows would be coalesced into one task
        flown = flown.repartition(max(cores, blocks), "source", "block").groupBy("source", "block").applyInPandas(_flier(key, seed, round_, last), schema)
        flown = cut(flown, "flown")
        settled = flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        todo, round_ = flown.where("p > 0 and p < 1"), round_ + 1
        many = todo.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if not many:
            break
    drawn = done.withColumn("copies", (F.col("whole") + F.col("p")).cast("int")).where("copies > 0")
    return drawn.select(key, "source", "tokens", "copies")


def _flier(key: str, seed: int, round_: int, last: bool):
    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, kind="stable").reset_index(drop=True)
        own = (seed * 1_000_003 + round_ * 7919 + len(pdf) * 31 + int(pdf[key].iloc[0])) % (1 << 32)
        x = pdf["tokens"].to_numpy(float)
        p = flight(pdf["p"].to_numpy(float), x, own)
        pdf["p"] = landing(p, x, own) if last else p
        return pdf[[key, "source", "tokens", "whole", "p"]]

    return fly


def shares(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, copies, tokens, actual_share, most_copies, wanted_tokens): what each source really gives,
    and what it would give at its share of the sources that give anything; those of the targets that give nothing included."""
    own = sample.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    joined = targets.select("source", "target_share", "max_repeats").distinct().join(own, "source", "left")
    total = joined.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).alias("live")).withColumn("one", F.lit(1))
    joined = joined.join(F.broadcast(total), F.lit(1) == F.col("one"), "left")  # total is one row
    zero = {c: 0 for c in ("documents", "copies", "tokens", "most_copies")}
    done = joined.na.fill(zero).withColumn("actual_share", F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)))
    wanted = F.when(F.col("tokens") > 0, F.col("all") * F.col("target_share") / F.col("live")).otherwise(0.0)
    return done.withColumn("wanted_tokens", wanted).select("source", "target_share", "max_repeats", "documents", "copies", "tokens", "actual_share", "most_copies", "wanted_tokens")
