import numpy as np
import pytest

from pagemill.llm.mixture import flight, landing, mix, plan, shares, token_counts
from pagemill.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(TOKENIZER), reason="no tokenizer files")


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 2000):
        p, x = np.full(n, 0.37), r.integers(0, 300, n).astype(float)
        q = flight(p, x, 5)
        assert ((q > 0) & (q < 1)).sum() <= 2 and set(landing(q, x, 5)) <= {0.0, 1.0}
        if n >= 50:
            assert abs((q * x).sum() - (p * x).sum()) < 3 and abs(q.sum() - p.sum()) < 3
    assert ((q := flight(np.full(9, 0.5), np.ones(9), 2)) > 0).any() and ((q > 0) & (q < 1)).sum() <= 2


def test_no_large_document_is_left_over():
    for seed in range(40):
        r = np.random.default_rng(seed)
        x = np.concatenate([r.lognormal(4, 1, 400), [7828.0, 5000.0, 3000.0]]).astype(int).astype(float)
        p = np.full(len(x), r.uniform(0.05, 0.95))
        q = flight(p, x, seed)
        assert ((q > 0) & (q < 1)).sum() <= 2 and abs((landing(q, x, seed) - p) @ x) <= np.median(x)


def test_flight_is_fair():
    x = np.array([1.0, 5, 2, 8, 3, 3, 9, 4] * 8)
    mean = np.mean([flight(np.full(64, 0.4), x, s) for s in range(2000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.06


def test_plan():
    size, copies = plan({"a": 100, "b": 100, "c": 0}, [("a", 0.5, 1), ("b", 0.25, 4), ("c", 0.25, 9)], None)
    assert size == 150 and copies == {"a": 1.0, "b": 0.5}
    assert plan({}, [("a", 1.0, 1)], None) == (0.0, {})
    assert plan({"a": 100}, [("a", 1.0, 3)], 10_000)[0] == 300


def test_mix(spark):
    rows = [(i, "word " * (5 + i % 40), "big" if i % 3 else "small") for i in range(3000)] + [(5, "word " * 10, "big"), (9001, None, "small"), (9002, "x", None), (None, "x", "big"), (9003, "x", "other")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    sample = mix(docs, targets, tokenizer=TOKENIZER, block=200).cache()
    report = {r.source: r for r in shares(sample, targets).collect()}
    assert abs(report["big"].actual_share - 5 / 9) < 0.002 and abs(report["small"].actual_share - 4 / 9) < 0.002 and report["none"].tokens == 0
    assert report["small"].most_copies <= 3 and report["big"].most_copies == 1 and sample.count() == sample.select("doc_id").distinct().count()
    assert mix(docs.limit(0), targets, tokenizer=TOKENIZER).count() == 0 and mix(docs, targets.limit(0), tokenizer=TOKENIZER).count() == 0
    assert [r.tokens for r in token_counts(docs.where("doc_id in (9001)"), TOKENIZER).collect()] == [0]
