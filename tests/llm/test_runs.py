import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from latewing.llm import queries as Q
from latewing.llm import runs as R
from latewing.llm.common import table


def plain_runs(words, least_repeats=4, least_length=6):
    """Every period at every place; a stretch counts with its smallest period."""
    found = []
    for q in range(1, len(words) // least_repeats + 1):
        start = 0
        while start + q < len(words):
            stop = start + q
            while stop < len(words) and words[stop] == words[stop - q]:
                stop += 1
            if stop - start >= max(least_length, least_repeats * q):
                own = words[start:stop]
                if not any(all(own[i] == own[i - p] for i in range(p, len(own))) for p in range(1, q)):
                    found.append((start, stop - start, q))
            start = max(start + 1, stop - q + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(2, 2), (2, 4), (3, 3), (4, 6)]))
def test_automaton_finds_all_runs(words, least):
    assert R.find_runs(words, *least) == plain_runs(words, *least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), max_size=5), st.sampled_from([(2, 2), (3, 7), (4, 6), (5, 4)]))
def test_stretches_lose_no_run(texts, least):
    coded = [[b"%d" % w for w in t] for t in texts]
    assert R.runs_of(coded, *least) == [plain_runs(t, *least) for t in texts]


def test_planted_runs():
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        words = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            unit = words[:1] + [rng.choice("abc") for _ in range(rng.randint(0, 9))]
            words += unit[:1] * rng.choice((0, 0, 9))
            words += unit * rng.randint(3, 7) + unit[: rng.randint(0, len(unit))] + [rng.choice("xyz")]
        texts.append([w.encode() for w in words])
    found = R.runs_of(texts)
    assert found == [plain_runs(t) for t in texts] and sum(map(len, found)) > 60


def changed(doc_id, words):
    """The words of the query's contract."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def plain_row(doc_id, text):
    words = changed(doc_id, (text or "").encode().split())
    runs = plain_runs(words)
    best = (None,) * 4
    for s, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_equals_brute_force(spark, small):
    docs = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect() if len(r["text"] or "") < 8_000}
    found = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in Q.op12_runs(spark, small).collect() if r["doc_id"] in docs}
    assert found == {i: plain_row(i, t) for i, t in docs.items()}
    assert sum(r[1] > 0 for r in found.values()) > 5


def test_rows_of_any_kind(spark, edge):
    extra = spark.createDataFrame([(str(i), "x y " * i) for i in range(40)], "runs string, text string")
    found = {r["text"]: r for r in R.detect(extra).collect()}
    assert R.detect(extra).columns == ["text", "runs", "collapsed"] and len(found) == 40
    assert found["x y " * 3]["runs"] == [] and [tuple(r) for r in found["x y " * 30]["runs"]] == [(0, 60, 2)]
    assert found["x y " * 30]["collapsed"] == "x y" and found[""]["collapsed"] == ""
    rows = R.detect(edge).collect()
    assert len(rows) == edge.count() and {c for c in edge.columns} < set(rows[0].asDict())
    long = [r for r in rows if r["doc_id"] in (4, 5)]
    assert [[tuple(x) for x in r["runs"]] for r in long] == [[(0, 160_000, 4)]] * 2 and long[0]["collapsed"] == "Ab cd ef gh"
    assert all(r["collapsed"] == "" and r["runs"] == [] for r in rows if r["text"] is None)
    digests = [tuple(r[n] for n in NAMES) for r in Q.run_digests(edge).collect()]
    want = [plain_row(r["doc_id"], r["text"]) for r in edge.collect() if len(r["text"] or "") < 100]
    assert sorted(map(repr, want)) == sorted(repr(d) for d in digests if d[0] not in (4, 5))
    assert R.detect(edge.limit(0)).count() == 0 == Q.run_digests(edge.limit(0)).count()
    with pytest.raises(ValueError, match="two repeats"):
        R.detect(edge, least_repeats=1)
