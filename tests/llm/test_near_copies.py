import random
from itertools import combinations

import pytest

import corpus_pipeline
from latewing.llm import near_copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1)))}


def plain_kept(docs):
    """Smallest ids of the groups that pairs of 0.8 or more connect, by comparing all pairs."""
    sets = {i: plain_set(t) for i, t in docs.items()}
    root = {i: i for i in docs}
    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return set(root.values())


@pytest.fixture(scope="module")
def copies():
    """Thirty texts with ten edited copies each, from one to nine words changed in 250, and strangers."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    docs = []
    for _ in range(30):
        own = [word() for _ in range(250)]
        docs.append(" ".join(own))
        for n in range(10):
            edited = list(own)
            for at in rng.sample(range(250), n):
                edited[at] = word()
            docs.append(" ".join(edited))
    return dict(enumerate(docs + [" ".join(word() for _ in range(40)) for _ in range(50)]))


def test_pipeline_drops_edited_copies(spark, copies):
    docs = spark.createDataFrame(list(copies.items()), "doc_id bigint, text string")
    for name, stage in corpus_pipeline.STAGES:
        if name.endswith("near-dedup"):
            docs = stage(spark, docs, "").cache()
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == plain_kept({i: copies[i] for i in kept}) and kept <= plain_kept(copies)
    assert set(range(0, 330, 11)) <= kept and set(range(330, 380)) <= kept


@pytest.mark.parametrize("part", [512, 3])
def test_near_copies_match_brute_force(spark, copies, monkeypatch, part):
    monkeypatch.setattr(near_copies, "PART", part)
    docs = spark.createDataFrame(list(copies.items()), "doc_id bigint, text string")
    kept = {r["doc_id"] for r in near_copies.one_of_each(docs).collect()}
    assert kept == plain_kept(copies) and len(kept) <= 30 * 5 + 50  # up to five changed words are near copies


def test_near_copies_edges(spark, edge):
    kept = near_copies.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 4, 6, 8]
    assert near_copies.one_of_each(edge.limit(0)).count() == 0
