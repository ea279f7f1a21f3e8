import os
import re
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import oracle
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from latewing.llm import (
    language, line_dedup, packing, pieces, quality_model, quality_rules, simhash, top_k, toxicity, url_filter,
)
from latewing.llm import queries as Q
from latewing.llm.common import table
from latewing.llm.components import by_root, components

ROOT = Path(__file__).resolve().parents[2]
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id bigint, quality int, toxic int"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


@pytest.fixture(scope="module")
def texts(spark, medium):
    return {r["doc_id"]: r for r in table(spark, medium, "documents").collect()}


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, small, name):
    assert oracle.differences(Q.QUERIES[name](spark, small), oracle.connect(small), Q.SQL[name]) == []


# 1: top-k


def test_top_k_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], 1), (20, [], 1), (1, [1.0, 0.0], 2), (2, [1.0], 3), (3, None, 4), (4, [None], 5),
            (5, [nan], 6), (None, [1.0], 7), (0, [1.0, 0.0], 8), (7, [-0.01, 5.0], 9)]
    found = top_k.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, rank int")).collect()
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert by[0] == [(1, 1, 4096), (2, 2, 4096), (3, 20, 0), (4, 7, -64)]
    assert by[20] == [(1, 0, 0), (2, 1, 0), (3, 2, 0), (4, 7, 0)]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert top_k.search(empty).count() == 0


def test_top_k_prunes_exactly(spark, monkeypatch):
    for name, value in (("ANNULUS", 16), ("QUERIES", 4), ("EXPANDED", 3), ("PIVOTS", 6)):
        monkeypatch.setattr(top_k, name, value)
    rng = np.random.default_rng(1)
    points = np.repeat(rng.normal(size=(8, 5)) * 2, 40, axis=0) + rng.normal(size=(320, 5)) / 4
    points[::9] = points[0]
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")
    whole = np.floor(64 * points).astype(int)
    want = set()
    for q in range(0, 320, 20):
        score = whole @ whole[q]
        best = sorted((-score[i], i) for i in range(320) if i != q)[:20]
        want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(best)}
    assert {tuple(r) for r in top_k.search(df).collect()} == want


# 2: language


def test_language_held_out(spark, medium, texts):
    found = language.predict(table(spark, medium, "documents")).collect()
    assert len(found) == len(texts)
    judged = [r for r in found if r["held_out"] and texts[r["doc_id"]]["lang"]]
    right = sum(r["lang_pred"] == texts[r["doc_id"]]["lang"] for r in judged)
    assert all(0 <= r["score"] <= 1 for r in found) and right / len(judged) > 0.98


def test_language_edges(spark, edge):
    found = {r["doc_id"]: r for r in language.predict(edge).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1, 2, 3))
    assert found[4]["lang_pred"] == "en" and language.predict(edge).count() == edge.count()
    nothing = language.predict(edge.where("lang IS NULL")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
    assert language.predict(edge.limit(0)).count() == 0


# 3: SimHash


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), seed=42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, limit=4):
    """Smallest id reachable over links, by brute force."""
    ids, parent = sorted(codes), {i: i for i in codes}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    marks = np.array([codes[i] for i in ids], np.uint64)
    for n, i in enumerate(ids):
        for at in np.flatnonzero(np.bitwise_count(marks[n + 1 :] ^ marks[n]) <= limit):
            a, b = root(i), root(ids[n + 1 + at])
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_groups(spark, small, texts):
    docs = {r["doc_id"]: r["text"] for r in table(spark, small, "documents").collect()}
    found = {r["doc_id"]: r for r in Q.op3_simhash(spark, small).collect()}
    codes = {i: plain_fingerprint(t) for i, t in docs.items()}
    assert {i: f"{c:016x}" for i, c in codes.items()} == {i: r["fingerprint"] for i, r in found.items()}
    assert plain_groups(codes) == {i: r["component_id"] for i, r in found.items()}


def crowd(count):
    """Many codes around one centre, chains and strangers."""
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, count, np.uint64)
    for i in range(count // 2):
        bits = rng.choice(64, rng.integers(0, 5), replace=False)
        codes[i] = codes[0] ^ np.uint64(sum(1 << int(b) for b in bits))
    for i in range(count // 2, count * 3 // 4):
        codes[i] = codes[i - 1] ^ np.uint64(15 << int(rng.integers(0, 60)))
    return np.unique(codes)


def test_gray_index_finds_all_pairs():
    codes = crowd(1200)
    found = set()
    for asked, near in simhash.GrayIndex(codes).near(codes, 4):
        found |= set(zip(asked.tolist(), near.tolist()))
    want = {(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= 4)}
    assert found == want


@pytest.mark.parametrize("part", [8192, 100])
def test_links_keep_components(spark, monkeypatch, part):
    monkeypatch.setattr(simhash, "PART", part)
    codes = crowd(600)
    marks = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fingerprint bigint")
    groups = {r["fingerprint"]: r["root"] for r in simhash.near_groups(marks).collect()}
    want = plain_groups({i: int(c) for i, c in enumerate(codes)})
    ours = defaultdict(set)
    for i, c in enumerate(codes.view(np.int64)):
        ours[groups[int(c)]].add(i)
    theirs = defaultdict(set)
    for i, root in want.items():
        theirs[root].add(i)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "u bigint, v bigint")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_components_of_a_star(spark):
    star = spark.range(1, 3000).selectExpr("id AS u", "CAST(id % 2 AS bigint) AS v")
    chain = spark.createDataFrame([(0, 1), (4000, 4001), (4001, 4002)], "u bigint, v bigint")
    found = Counter(r["root"] for r in components(star.union(chain)).collect())
    assert found == {0: 3000, 4000: 3}


def test_members_of_one_root_are_spread(spark):
    members = spark.range(1000).selectExpr("id AS node", "CAST(id > 900 AS bigint) AS root")
    table = spark.createDataFrame([(0, "a"), (2, "c")], "root bigint, name string")
    assert by_root(members, table, "node").groupBy("name").count().collect() == [("a", 901)]
    left = by_root(members, table, "node", "left").groupBy("name").count().collect()
    assert {tuple(r) for r in left} == {("a", 901), (None, 99)}
    plan = by_root(members.hint("shuffle_merge"), table, "node")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(root#\d+L, __part#\d+", plan)


def test_simhash_edges(spark, edge):
    found = simhash.near_duplicates(edge).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == edge.count()
    assert {by[i]["component_id"] for i in (1, 2, 3)} == {1} and by[1]["fingerprint"] == "0" * 16
    assert by[4]["component_id"] == by[5]["component_id"] == 4
    kept = simhash.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 4, 6, 8]
    assert simhash.near_duplicates(edge.limit(0)).count() == 0 == simhash.one_of_each(edge.limit(0)).count()


# 4: quality rules


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered.update(range(i, i + 8))
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_quality_rules_count_as_much_with_less(spark):
    """Blanks are known by the words, symbols are looked for in what no class took, and few texts are hashed to the end."""
    texts = [
        "", " \t\n", "One two, three\r\nfour #5 <six> \u0130\u03a3\u03a3 \u03a3. \x1c \x85 \u00a0 \u0663 \u02b0",
        "a b c d e f g h i " * 3, "a b c d x a b c d y", "p q r s t u v w p q r s t u v w", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    words, text = quality_rules.words_of(F.col("text")), F.col("text")
    found = rows.select("text", quality_rules.class_counts(text).alias("all"), *(
        quality_rules.bound(words, use).alias(name) for name, use in {
            "known": lambda w: quality_rules.class_counts(text, quality_rules.word_chars(w)),
            "short": lambda w: quality_rules.short_words(w),
            "repeated": lambda w: quality_rules.repeated_words(w),
        }.items()
    )).collect()
    for r in found:
        own = [w for w in re.split(r"[\x20\x09-\x0d]+", r["text"] or "") if w]
        windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
        held = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        assert r["known"] == r["all"] and sum(r["all"]) == len(r["text"] or "")
        assert r["short"] == [w.lower() for w in own if len(w.lower()) <= quality_rules.COMMON_LENGTH]
        assert r["repeated"] == len(held)
    measured = quality_rules.measure(rows.withColumn("lang", F.lit("en")))
    plan = measured._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 6  # one for letters and blanks, four for the other classes, one for symbols


def test_quality_rules(spark, medium, texts, edge):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    found = {r["doc_id"]: r for r in Q.op4_quality_rules(spark, medium).collect()}
    assert {i: tuple(r[n] for n in names) for i, r in found.items()} == {i: plain_counts(r["text"]) for i, r in texts.items()}
    labels = table(spark, medium, "labels").where("quality = 1").collect()
    clean = [found[r["doc_id"]] for r in labels if not found[r["doc_id"]]["base_failed"]]
    assert sum(r["kept"] for r in clean) / len(clean) > 0.99
    edges = quality_rules.judge(edge).collect()
    plain = sorted((plain_counts(r["text"]) for r in edge.collect()))
    assert sorted(tuple(r[n] for n in names) for r in edges) == plain
    assert quality_rules.keep(edge).columns == edge.columns
    assert quality_rules.judge(edge.limit(0)).count() == 0


def plain_distance(own, reference):
    """Jensen-Shannon distance, base 2."""
    p, q = (np.array(c, float) / max(sum(c), 1) for c in (own, reference))
    halves = [np.sum(a[a > 0] * np.log2(2 * a[a > 0] / (a + b)[a > 0])) for a, b in ((p, q), (q, p))]
    return max(sum(halves) / 2, 0.0) ** 0.5


def plain_classes(text):
    found = [0] * 7
    for c in text:
        kind = unicodedata.category(c)
        tests = (kind == "Ll", c in " \t\n\x0b\f\r", kind == "Lu", c in ".,;:'\"()?-", kind == "Nd", kind[0] == "L", True)
        found[tests.index(True)] += 1
    return found


def test_quality_verdict_equals_plain_counts(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang", "text").collect()
    split = {r["doc_id"]: re.findall(r"[^\x20\x09-\x0d]+", r["text"] or "") for r in rows}
    short = {i: [w for w in (w.lower() for w in words) if len(w) <= quality_rules.COMMON_LENGTH] for i, words in split.items()}
    classes, words = defaultdict(lambda: np.zeros(7, int)), defaultdict(Counter)
    for r in rows:
        classes[r["lang"]] += plain_classes(r["text"] or "")
        words[r["lang"]].update(short[r["doc_id"]])
    found = {r["doc_id"]: r for r in Q.op4_quality_rules(spark, small).collect()}
    rejected = 0
    for r in rows:
        own, text = found[r["doc_id"]], r["text"] or ""
        common = sorted(sorted(words[r["lang"]], key=lambda w: (-words[r["lang"]][w], w.encode()))[: quality_rules.COMMON_WORDS])

        def histogram(counts):
            hits = [counts[w] for w in common]
            return [*hits, sum(counts.values()) - sum(hits)]

        far = []
        if len(text) >= quality_rules.MIN_CLASS_CHARS:
            far.append(plain_distance(plain_classes(text), classes[r["lang"]]) > quality_rules.MAX_CLASS_DISTANCE)
        n = len(split[r["doc_id"]])
        if n >= quality_rules.MIN_COMPARED_WORDS and common:
            distance = plain_distance(histogram(Counter(short[r["doc_id"]])), histogram(words[r["lang"]]))
            far.append(distance > (0.33 if n >= 100 else 0.36 * (100 / n) ** 0.5))
        assert own["kept"] == (not own["base_failed"] and not any(far)), r["doc_id"]
        rejected += any(far) and not own["base_failed"]
    assert rejected > 0


def test_divergence_rejects_bad_documents(spark, medium):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{medium}/labels.parquet").collect()}
    judged = [r for r in Q.op4_quality_rules(spark, medium).collect() if not r["base_failed"]]
    long = [r for r in judged if labels.get(r["doc_id"]) == 0 and r["n_words"] >= quality_rules.STEADY_WORDS]
    assert long and not any(r["kept"] for r in long)
    good = [r for r in judged if labels.get(r["doc_id"]) == 1]
    assert all(r["kept"] for r in good)


def test_common_words_are_limited_in_each_task(spark, edge):
    plan = quality_rules.references(edge)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_distance_is_jensen_shannon(spark):
    row = spark.sql("SELECT array(3L, 1L, 0L) AS a, array(0L, 2L, 2L) AS b, array(0L, 0L, 0L) AS z")
    d = row.select(quality_rules._distance(row.a, row.b).alias("d"), quality_rules._distance(row.a, row.a).alias("s")).first()
    p, q = np.array([0.75, 0.25, 0]), np.array([0, 0.5, 0.5])
    half = lambda x: sum(v * np.log2(2 * v / w) for v, w in zip(x, p + q) if v) / 2
    assert d["d"] == pytest.approx(np.sqrt(half(p) + half(q))) and d["s"] == 0


# 5: packing


def test_packing(spark, medium, texts):
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = sorted(texts)
    coded = coder.encode_batch([texts[i]["text"] or "" for i in ids], add_special_tokens=False)
    want = {i: [*c.ids, 0] for i, c in zip(ids, coded)}
    check_packing(Q.op5_packing(spark, medium).collect(), want)


def check_packing(rows, want):
    places, own = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        own[r["doc_id"]].append(r)
    for i, ids in want.items():
        start = 0
        for n, r in enumerate(sorted(own[i], key=lambda r: r["piece"])):
            part = np.array(ids[start : start + r["length"]], "<u4")
            assert (r["piece"], r["start"], r["ids_crc32"]) == (n, start, zlib.crc32(part.tobytes()))
            assert n == 0 or r["length"] == 2048
            start += r["length"]
        assert start == len(ids) and (len(ids) > 2048 or len(own[i]) == 1)
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    total = sum(map(len, want.values()))
    assert len(places) <= 1.03 * -(-total // 2048) + 2


def test_word_encoder_equals_tokenizer():
    coder = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json"))
    words = packing.WordEncoder(path)
    for text in ("", " ", "a  b", " a", "a ", "a\n b\tc", "don 't it's", "x\u00a0 y", "<|endoftext|> a", "a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>x <|endo", "é🙂 ▁ 12 3", "\x1c a\x1c b", "a" * 300):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == coder.encode(text, add_special_tokens=False).ids, text


def test_packing_edges(spark, edge):
    rows = packing.pack(packing.cut_pieces(edge)).collect()
    assert len({r["doc_id"] for r in rows}) == 8 and sum(r["doc_id"] == 6 for r in rows) == 2
    assert all(len(r["ids"]) == r["length"] for r in rows)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack(packing.cut_pieces(edge.limit(0))).count() == 0


def test_runs_of_one_length():
    counts = np.zeros(2049, int)
    counts[[1, 700, 1024, 2048]] = 5000, 10, 7, 3
    runs = packing.plan_runs(counts)
    used = defaultdict(int)
    for length, own in runs.items():
        bounds = [*own[:, 0].tolist(), counts[length]]
        for (first, sequence, offset), end in zip(own.tolist(), bounds[1:]):
            for n in range(end - first):
                assert offset + length <= 2048
                used[sequence + n] += length
    assert sum(used.values()) == 5000 + 7000 + 7168 + 6144 and max(used.values()) <= 2048


# 6 and 8: models of labels


def held_out_quality(rows, labels, field):
    judged = [(labels[r["doc_id"]][field], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for y, s in judged if y], [s for y, s in judged if not y]
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_label_models(spark, medium):
    labels = {r["doc_id"]: r for r in table(spark, medium, "labels").collect()}
    quality = Q.op8_quality_model(spark, medium).collect()
    assert held_out_quality(quality, labels, "quality") > 0.98
    assert all(r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (fold(r["doc_id"]) == 0) for r in quality)


def test_toxicity_held_out(spark, large):
    """On the largest table: the smaller ones hold out six toxic texts, two of them without a word that others have."""
    labels = {r["doc_id"]: r for r in table(spark, large, "labels").collect()}
    toxic = Q.op6_toxicity(spark, large).collect()
    assert held_out_quality(toxic, labels, "toxic") > 0.93
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in toxic)
    judged = [(labels[r["doc_id"]]["toxic"], r["predicted"]) for r in toxic if r["held_out"] and r["doc_id"] in labels]
    found, false = (sum(y == kind and p == 1 for y, p in judged) for kind in (1, 0))
    assert found >= 85 and false <= 5 and sum(y == 1 for y, _ in judged) == 97


@pytest.mark.parametrize("model", [quality_model, toxicity])
def test_label_model_edges(spark, edge, model):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 1), (6, 0, 1), (8, None, 7), (None, 1, 1)], LABELS)
    for known in (labels, labels.limit(0), labels.where("doc_id = 4")):
        rows = model.predict(edge, known).collect()
        assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert model.predict(edge.limit(0), labels).count() == 0
    if model is quality_model:
        assert model.keep(edge, labels).columns == edge.columns


def plain_kneser_ney(texts, left_out=None):
    """Both models as dictionaries of chances, from (fold, class, text), and what a word has by backoff alone in each."""
    held = [Counter(), Counter()]
    for fold_number, kind, text in texts:
        if fold_number != left_out:
            held[kind].update({w.strip(toxicity._ENDS) for w in text.lower().split()} - {""})
    models, rest, words = [], [], set(held[0]) | set(held[1])
    for own in held:
        cut = toxicity.discounts(*(sum(v == n for v in own.values()) for n in (2, 3, 4)))
        total, taken = sum(own.values()), sum(cut[min(v, 3)] for v in own.values())
        shared = {w: ((w in held[0]) + (w in held[1])) / (len(held[0]) + len(held[1])) for w in words}
        models.append({w: max(own[w] - cut[min(own[w], 3)], 0) / total + taken / total * shared[w] for w in words})
        rest.append(taken / total)
    often = {w for w in words if max(held[0][w], held[1][w]) > 1}
    ratio = {w: models[1][w] / models[0][w] / (rest[1] / rest[0]) for w in words}
    assert all(w in often or v == pytest.approx(1) for w, v in ratio.items())
    return models, ratio


TAUGHT = [
    (1, 1, "You IDIOT, you utter idiot"), (2, 1, "idiot! the end"), (3, 1, "what an idiot it is"), (4, 1, "a moron of the end"),
    (1, 0, "the end of the day"), (2, 0, "what a day it is"), (3, 0, "the day, the (end)"), (4, 0, "... it is it is"), (4, 0, "a day"),
]


def test_kneser_ney_equals_dictionaries(spark):
    taught = spark.createDataFrame(TAUGHT, "fold int, toxic int, text string")
    counted = toxicity.count_words(taught.repartition(3))
    model = {r["word"]: r for r in toxicity.ratios(counted).collect()}
    for column, left_out in enumerate((None, 1, 2, 3, 4)):
        (ordinary, toxic), ratio = plain_kneser_ney(TAUGHT, left_out)
        assert sum(ordinary.values()) == pytest.approx(1) == pytest.approx(sum(toxic.values()))
        for word in ordinary:
            row = model.get(toxicity._hashes([word])[0])
            found = row[f"r{column}"] if row else 0
            assert found == pytest.approx(np.log(ratio[word]), abs=1e-6), (word, left_out)
    assert 5 < len(model) < len(plain_kneser_ney(TAUGHT)[1])


@pytest.mark.parametrize("block", [1_000_000, 4])
def test_evidence_is_the_mean_likelihood_ratio(spark, monkeypatch, block):
    """Also by several blocks of the model; a text's own fold is left out of what calibrates."""
    monkeypatch.setattr(toxicity, "BLOCK", block)
    taught = spark.createDataFrame(TAUGHT, "fold int, toxic int, text string")
    texts = {i: t for i, t in enumerate(["You idiot, it is!", "the day", "unheard of", "", "...", None, "idiot " * 500])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in toxicity.rate(docs, toxicity.ratios(toxicity.count_words(taught)).cache()).collect()}
    for i, text in texts.items():
        words = [w.strip(toxicity._ENDS) for w in (text or "").lower().split()]
        words = [w for w in words if w]
        for name, left_out in (("evidence", None), ("crossed", fold(i) or None)):
            _, ratio = plain_kneser_ney(TAUGHT, left_out)
            want = np.log(np.mean([ratio.get(w, 1) for w in words])) if words else None
            assert rows[i][name] == (pytest.approx(want, abs=1e-5) if words else None), (text, name)


def test_planted_expressions_are_found(spark):
    """Frequent in toxic texts and nowhere else, in texts as long as the others."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        own = rng.choice(words, 60).tolist()
        if i % 6 == 0:
            own[int(rng.integers(60))] = ("zorg", "vile")[i % 12 == 0]
        rows.append((i, " ".join(own)))
        labels.append((i, 1, int(i % 6 == 0)))
    found = toxicity.predict(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, LABELS))
    judged = [(r["doc_id"] % 6 == 0, r["predicted"]) for r in found.collect() if r["held_out"]]
    assert sum(t for t, _ in judged) > 10 and all(t == bool(p) for t, p in judged)


def test_workers_need_no_package(tmp_path):
    """Workers whose path lacks the package: functions and models travel by value."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from latewing.llm import toxicity
from pyspark.sql import SparkSession
sys.path.pop(0)
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
docs = spark.createDataFrame([(i, 'an idiot' if i % 2 else 'a day') for i in range(40)], 'doc_id bigint, text string')
labels = spark.createDataFrame([(i, i % 2) for i in range(40)], 'doc_id bigint, toxic int')
print('rows', toxicity.predict(docs, labels).count())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert "rows 40" in done.stdout, done.stderr[-2000:]


# 7: URLs


def test_url_edges(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.ORG", "http://a.Org/x?y#z", "https://x.example.org/es/1",
            "https://example.org/es", "http://example.org/en/199", "http://notexample.org/en/1", "http://b.com/fr/?q",
            "http://b.com/de/", "http://com/de", "ftp://u@b.com:80/de/", "a://b://c.com/de/", "http://org" + "/x" * 50_000]
    rows = url_filter.judge(spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)], "page_id int, url string, verdict string"), Q.URL_RULES)
    found = {r["page_id"]: (r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in rows.collect()}
    assert [found[i] for i in range(4)] == [("", "", None, "allow")] * 4
    assert found[4] == ("a.org", "", None, "allow") and found[5] == ("a.org", "/x", "org/", "allow")
    assert found[6][2:] == ("example.org/es/", "block") and found[7][2:] == ("org/", "allow")
    assert found[8][2:] == ("example.org/en/1", "block") and found[9][2:] == ("org/", "allow")
    assert found[10][2:] == ("com/fr/", "allow") and found[11][2:] == ("com/de/", "block")
    assert found[12][2] is None and found[13][0] == "u@b.com:80" and found[13][2] is None
    assert found[14][0] == "b:" and found[15][2] == "org/"


# 9: lines


def test_line_dedup_edges(spark, edge):
    rows = [(i, f"own {i}\nAll rights reserved\n\nend {i}", f"s{i % 12}") for i in range(30)] + [(99, "All rights reserved", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r["doc_id"]: r for r in line_dedup.drop_boilerplate(docs, removed="n").collect()}
    assert found[0]["n"] == 0 and "rights" in found[0]["text"]
    assert found[7]["text"] == "own 7\n\nend 7" and found[7]["n"] == 1 and found[99]["text"] == ""
    few = line_dedup.drop_boilerplate(docs, min_sites=40).collect()
    assert sorted(r["text"] for r in few) == sorted(r[1] for r in rows)
    kept = line_dedup.drop_boilerplate(edge)
    assert kept.columns == edge.columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, edge.collect()))
    assert line_dedup.drop_boilerplate(edge.limit(0)).count() == 0


# 10: pieces


def test_pieces_round_trip(spark, small, edge):
    assert all(r["restored"] for r in Q.op10_pieces(spark, small).collect())
    rows = pieces.decode(pieces.encode(edge)).collect()
    assert len(rows) == edge.count() and all(r["decoded"] == r["text"] for r in rows)
    assert pieces.encode(edge.limit(0)).count() == 0


def test_pieces_are_best():
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1  # a sum of scores instead of merges, as in this operator
    library, coder = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()), pieces.PieceCoder(path)
    for text in ("Hello world", "the anndea thing", "Ciónez para 12", "über  alles", "internationalization", "x"):
        ids = coder.encode(text).tolist()
        total = lambda found: sum(model.pieces[i].score for i in found)
        assert library.decode(ids) == text and total(ids) >= total(library.encode(text)), text
    score = {p.piece.replace("▁", " "): (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
    for segment in (" thingster", "é\nab", " rerestouti", "🙂x"):
        best = [0.0]
        for end in range(1, len(segment) + 1):
            options = [best[a] + score[segment[a:end]][1] for a in range(end) if segment[a:end] in score]
            if segment[end - 1] not in score:
                options.append(best[end - 1] + coder.unknown)
            best.append(max(options))
        ids = coder.best(segment)
        known = sum(model.pieces[i].score for i in ids if model.pieces[i].type == 1)
        unknown = sum(c not in score for c in segment)
        assert known + unknown * coder.unknown == pytest.approx(best[-1])
