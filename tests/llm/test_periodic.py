"""Runs of words against brute force, and the linear bound on comparisons."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from firegrid.llm import periodic
from tests.llm.test_filters import DOCS, documents


def brute_runs(w, exponent, least):
    """Every maximal stretch of every period; a stretch counts for its smallest period only."""
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - s >= max(least, exponent * q) and (s, i - s) not in found:
                found[s, i - s] = q
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_array(t):
    n, out = len(t), []
    for i in range(n):
        j = next((j for j in range(i + 1, n) if t[j:] < t[i:]), n)
        m = 0
        while j + m < n and t[i + m] == t[j + m]:
            m += 1
        out.append((j, m if j < n else 0))
    return out


LETTERS = st.lists(st.integers(0, 1), max_size=60) | st.lists(st.integers(0, 3), max_size=60)
PIECES = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 7)), max_size=6).map(lambda x: [c for w, k in x for c in w * k])


@settings(max_examples=400, deadline=None)
@given(LETTERS | PIECES)
def test_lyndon_array_and_runs(t):
    assert [*zip(*periodic.lyndon_array(t), strict=True)] == brute_array(t)
    for exponent, least in ((2, 2), (4, 6), (3, 1)):
        assert periodic.find_runs(t, exponent, least) == brute_runs(t, exponent, least)


class Counted(list):
    reads = 0

    def __getitem__(self, k):
        Counted.reads += 1
        return super().__getitem__(k)


def fibonacci(n):
    a, b = [1], [1, 0]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("kind", ["one letter", "squares", "fibonacci", "random", "thue-morse", "nested", "rising", "falling"])
def test_comparisons_are_linear(kind):
    rng, n = random.Random(3), 40_000
    nested = []
    for _ in range(14):
        nested = nested + nested + [rng.randrange(3)]
    t = {
        "one letter": [0] * n, "squares": [0, 1, 1, 0, 2] * (n // 5), "fibonacci": fibonacci(n), "random": [rng.randrange(2) for _ in range(n)],
        "thue-morse": [bin(k).count("1") % 2 for k in range(n)], "nested": nested, "rising": [*range(n)], "falling": [*range(n, 0, -1)],
    }[kind]
    for order in (t, [max(t) - x for x in t]):
        Counted.reads = 0
        periodic.lyndon_array(Counted(order))
        assert Counted.reads <= 8 * len(order)


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, 4, 6)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    head = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *head, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_report_against_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \n", "a", "a " * 5, "a " * 6, "\x1ca b " * 5, "x y x y x y x y z", "é Ω " * 9, "a b\x85c " * 4, "one\ttwo\x0bthree\r\n" * 12, "a  " * 300 + "b"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            base = [f"w{rng.randrange(5)}" for _ in range(rng.randrange(1, 9))]
            parts += base * rng.choice([1, 1, 2, 3, 4, 5, 9]) + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(6))]
        texts.append(" ".join(parts))
    docs = documents(spark, texts).withColumn("runs", F.lit("clash")).withColumn("h", F.lit(1))
    got = {r.doc_id: tuple(r)[1:] for r in periodic.run_report(periodic.with_planted_periods(docs)).collect()}
    assert got == {k: expected(k, x) for k, x in enumerate(texts)}
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k in got) > 5 and sum(x[0] > 0 for x in got.values()) > 40


def test_null_ids_repeats_long_texts_and_no_rows(spark):
    long = " ".join(f"w{k}" for k in range(100_000)) + " a b" * 50_000
    docs = spark.createDataFrame([(None, "a " * 10, None, None, None), (7, "b c " * 8, "en", "a", 0), (7, "b c " * 8, "en", "a", 0), (8, long, "en", "a", 0)], DOCS)
    got = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli) for r in periodic.run_report(docs).collect()), key=str)
    assert got == sorted([(None, 1, 0, 10, 1, 10000), (7, 1, 0, 16, 2, 8000), (7, 1, 0, 16, 2, 8000), (8, 1, 100_000, 100_000, 2, 50_000_000)], key=str)
    assert periodic.run_report(periodic.with_planted_periods(docs.limit(0))).count() == 0
