"""Operators on documents: odd inputs and brute force."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import decontam, hashing, jaccard, langid, mixing, quality, sharding, tokenfiles
from spanloom.llm.queries import vocabulary

WORD = "[^\\x20\\x09-\\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, shard string, slot int, taken int, mini string, __n int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, None, 0.5, "size", "shard", 1, 2, "mini", 3) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "Ähre", "ñandú", "the", "of"]
    long = " ".join(rng.choice(words) for _ in range(400_000))  # over the bytes that are hashed at once
    rows = [
        (0, None, None, None),
        (1, "", "en", "a"),
        (2, " \t\n ", "en", None),
        (3, "!!! ???", None, "a"),
        (4, long, "de", "b"),
        (5, "x" * 2_500_000, "de", "b"),  # one word longer than that
        (6, "one two three four five six", "en", "a"),
        (6, "one two three four five six", "en", "a"),
        (7, "one two three four five six", "en", "c"),
        (None, "one two three four five six", "en", "c"),
        (8, "one two", "en", "c"),
        (9, "ONE two", "en", "c"),
        (10, "\u00a0\u2003", "en", "c"),
    ]
    return rows, frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# hashing


def test_words_do_not_depend_on_their_place():
    texts = ["a bb  a\tccc", "", None, "bb", "é a"]
    got = {}
    for row, h, bounds in hashing.words(pa.array(texts)):
        for i in range(len(bounds) - 1):
            got[row + i] = h[bounds[i] : bounds[i + 1]].tolist()
    assert [len(got[i]) for i in range(5)] == [4, 0, 0, 1, 2]
    assert got[0][0] == got[0][2] == got[4][1] and got[0][1] == got[3][0]
    assert len({*got[0], *got[4]}) == 4


def test_long_texts_hash_like_their_words(odd):
    text = odd[0][4][1]
    whole = next(hashing.words(pa.array([text])))[1]
    each = {w: next(hashing.words(pa.array([w])))[1][0] for w in set(text.split())}
    assert whole.tolist() == [each[w] for w in text.split()]


# sharding


def test_sharding_law(spark, odd, none):
    rows, docs = odd
    got = sharding.shard_documents(docs).collect()
    assert len(got) == len(rows) and sharding.shard_documents(none).count() == 0
    assert sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in got if r.doc_id is not None) == sorted((False, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows if i is not None)
    assert all(r.grown_shard in (r.shard, 40) and 0 <= r.shard < 40 for r in got)
    more = sharding.shard_documents(spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text")).collect()
    slots = defaultdict(list)
    for r in more:
        slots[r.shard].append(r.slot)
    assert len(slots) == 40 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    moved = sum(r.grown_shard != r.shard for r in more)
    assert 350 < moved < 640 and max(map(len, slots.values())) < 620


def test_weights_share_the_keys(spark):
    w = [1.0, 3.0, 0.0]
    got = spark.range(20_000).select(sharding.rendezvous(sharding.F.col("id"), w).alias("s")).groupBy("s").count().collect()
    n = {r.s: r["count"] for r in got}
    assert set(n) == {0, 1} and abs(n[1] / 20_000 - 0.75) < 0.02
    with pytest.raises(ValueError):
        sharding.rendezvous(sharding.F.col("id"), [])


# mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    while free:
        left = total - sum(target.values())
        over = {s for s in free if left * w[s] / sum(w[x] for x in free) > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / sum(w[x] for x in free) for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


def test_mixing_against_plain(spark):
    rng = random.Random(2)
    sizes_of = {"s0": 3000, "s1": 40, "s2": 300, "s3": 2, "s4": 500, None: 25}
    rows, i = [], 0
    for s, n in sizes_of.items():
        for _ in range(n):
            rows.append((i, " ".join(["w"] * rng.randint(0, 60)), "en", s))
            i += 1
    docs = frame(spark, rows)
    keys = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) AS k").collect()}
    got = mixing.mix(docs).collect()
    size = defaultdict(int)
    for i, t, _, s in rows:
        size[s] += len(t.split())
    want = plain_targets(size)
    want_taken = plain_taken([(i, keys[i], s, len(t.split())) for i, t, _, s in rows], size, want)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == want_taken[r.doc_id] <= 3 * r["size"]
        assert abs(r.copies * r["size"] - r.taken) <= r["size"] / 2
    for s in size:
        assert sum(r.taken for r in got if r.source == s) == round(want[s])
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(docs.repartition(3)).collect())
    assert sorted((r.doc_id, r.taken, r.copies) for r in got) == sorted((r.doc_id, r.taken, r.copies) for r in mixing.taken(docs).collect())
    assert got[0].asDict().keys() == {*docs.columns, "source_size", "target", "copies"}
    copies = mixing.mixed_rows(docs)
    assert copies.schema == docs.schema and copies.count() == sum(r.copies for r in got)


def plain_taken(rows, sizes, target):
    """Words that each document gives: sources read in the order of their keys, again and again, up to the budget."""
    out = {}
    for source in sizes:
        left = round(target[source])
        own = sorted((k, i, n) for i, k, s, n in rows if s == source)
        out |= {i: 0 for _, i, _ in own}
        while left > 0:
            for _, i, n in own:
                out[i] += min(n, left)
                left -= min(n, left)
    return out


def test_equal_rows_are_mixed_one_by_one(spark):
    rows = [(1, "five words are in it", "en", "a")] * 2000 + [(k, "x " * 100, "en", "b") for k in range(100)] + [(None, "w w w", "en", None)] * 500
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    target = {r.source: r.target for r in got}
    for s in target:
        assert sum(r.taken for r in got if r.source == s) == round(target[s])
        assert abs(sum(r.copies * r["size"] for r in got if r.source == s) - target[s]) <= max(r["size"] for r in got if r.source == s)
    assert len({r.taken for r in got if r.source == "a"}) > 1  # some of the equal rows, not all or none


def test_mixing_of_odd_rows(odd, none):
    rows, docs = odd
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    assert all(r["size"] == 0 and r.taken == 0 for r in got if r.doc_id in (0, 1, 2))
    assert mixing.mix(none).count() == mixing.mixed_rows(none).count() == 0


# quality


def test_quality_learns_and_scores_everything(spark, odd, none):
    rng = random.Random(3)
    rows, marks = [], []
    for i in range(400):
        good = i % 4 > 0
        rows.append((i, " ".join((rng.choice("abcdef") * 3) + ("" if good else "###") for _ in range(30)), "en", "s"))
        marks.append((i, int(good), 9))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, score int")
    w = quality.fit(docs, labels)
    got = quality.score(docs, w).collect()
    assert all(r.predicted == int(r.doc_id % 4 > 0) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd[1], w, keep=["doc_id"]).count() == len(odd[0])
    blank = {r.doc_id: r.score for r in quality.score(odd[1], w, keep=["doc_id"]).collect() if r.doc_id in (0, 1, 2)}
    assert len(set(blank.values())) == 1
    assert quality.score(none, w).count() == 0
    assert (quality.fit(none, labels) == 0).all() and np.array_equal(quality.fit(docs, labels), w)
    one = quality.fit(docs, labels.filter("quality = 1"))
    assert (one[:-1] == 0).all() and one[-1] > 0


def test_sample_goes_to_the_driver_in_portions(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"good words {k} " * 50 + "###" * (k % 2)) for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int")
    kind, sizes, seen = type(docs), [], []
    plain = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: sizes.append(got := plain(df)) or got)
    monkeypatch.setattr(kind, "toPandas", None)
    monkeypatch.setattr(quality, "ftrl", lambda data, how: seen.extend(data) or np.zeros(3))
    quality.fit(docs, labels)
    assert len(seen) == 400 == sum(t.num_rows for t in sizes) and max(t.num_rows for t in sizes) < 80


def test_sample_is_bounded_in_rows_and_features(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"good words {k}") for k in range(3000)] + [(2, "bad ### words")] * 50 + [(k, "some more ###") for k in range(3, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "ftrl", lambda data, how: seen.append(data) or np.zeros(3))
    quality.fit(docs, labels, sample=40)
    quality.fit(docs, labels, sample=40, most=100)
    quality.fit(docs, labels, sample=400)
    for data, rows, most in zip(seen, (40, 40, 400), (10**9, 100, 10**9), strict=True):
        for label in (0, 1):
            own = [len(i) for i, _, x in data if x == label]
            assert 0 < len(own) <= rows and sum(own) <= most
    assert len([0 for *_, x in seen[2] if x == 0]) == 107  # equal rows count each


def plain_ftrl(rows, how):
    """Follow the regularised leader, one weight at a time."""
    from collections import defaultdict
    from math import exp, sqrt

    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        if abs(z[i]) <= how.l1:
            return 0.0
        return -(z[i] - (how.l1 if z[i] > 0 else -how.l1)) / ((how.beta + sqrt(n[i])) / how.alpha + how.l2)

    ones = sum(x for *_, x in rows)
    odds = (max(ones, 1) / max(len(rows) - ones, 1)) ** 0.25
    for _ in range(how.epochs):
        for ids, vals, label in rows:
            w = {i: weight(i) for i in ids}
            p = 1 / (1 + exp(-sum(w[i] * v for i, v in zip(ids, vals, strict=True))))
            for i, v in zip(ids, vals, strict=True):
                g = (p - label) * v * (1.0 if label else odds)
                z[i] += g - (sqrt(n[i] + g * g) - sqrt(n[i])) / how.alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_training_against_plain():
    rng = np.random.default_rng(4)
    how = quality.Settings(bits=6)
    rows = []
    for _ in range(80):
        ids = np.append(np.sort(rng.choice(64, 9, replace=False)), 64)
        rows.append((ids, np.append(rng.random(9), 1.0), float(ids[0] < 5)))
    got, want = quality.ftrl(rows, how), plain_ftrl([(i.tolist(), v.tolist(), x) for i, v, x in rows], how)
    assert np.allclose(got, [want.get(i, 0.0) for i in range(65)]) and (got != 0).sum() > 10


def test_scores_against_plain(spark):
    """Hashed n-grams of a text, listed word by word."""
    import re

    how = quality.Settings(bits=18)
    text = "The cat, THE cat sat!! 42 cats"
    tokens = re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+|[^A-Za-z0-9\s\x80-\U0010ffff]+", text)
    low, shape = [t.lower() for t in tokens], [re.sub("[a-z0-9]", "a", re.sub("[A-Z]", "A", t)) for t in tokens]
    grams = [("w", x) for x in low] + [("s", x) for x in shape] + [("w", *x) for x in itertools.pairwise(low)] + [("s", *x) for x in itertools.pairwise(shape)] + [("=", a == b) for a, b in itertools.pairwise(low)]
    count = defaultdict(int)
    for g in grams:
        count[g] += 1
    ids, values = next(quality.features(pa.array([text]), how))
    assert len(ids) == len(count) + 1 and ids[-1] == 1 << 18 and values[-1] == 1.0
    norm = sum(count.values()) ** 0.5
    assert np.allclose(sorted(values[:-1]), sorted(c**0.5 / norm for c in count.values()))
    w = np.random.default_rng(5).normal(size=(1 << 18) + 1)
    docs = spark.createDataFrame([(1, text, 7.0, 9), (2, None, 7.0, 9)], "doc_id long, text string, score double, predicted int")
    got = {r.doc_id: r for r in quality.score(docs, w).collect()}
    assert abs(got[1].score - 1 / (1 + np.exp(-(w.astype(np.float32)[ids] * values).sum()))) < 1e-6
    assert all(r.predicted == int(r.score >= 0.7) for r in got.values()) and abs(got[2].score - 1 / (1 + np.exp(-w[-1]))) < 1e-6


# near-duplicates


def plain_groups(rows, width=5):
    import re

    sets = {}
    for i, t in rows:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
        w = re.findall(rb"[^\x20\x09-\x0D]+", b)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def planted(rng, groups=12):
    """Copies, chains of small changes, short texts, and one passage in many texts."""
    words = [f"w{k}" for k in range(3000)]
    passage = rng.choices(words, k=60)
    texts = []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 12, 30, 80, 200]))
        for _ in range(rng.choice([1, 2, 6, 25])):
            texts.append(" ".join(base))
            if rng.random() < 0.7:  # a chain: each is near the last, not the first
                k = rng.randrange(len(base))
                base = base[:k] + [rng.choice(words)] + base[k + rng.choice([0, 1]) :]
    for _ in range(30):
        own = rng.choices(words, k=rng.choice([5, 15, 40]))
        texts.append(" ".join(own + passage if rng.random() < 0.5 else passage + own))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_plain(spark, seed):
    rows = planted(random.Random(seed), 20)
    want = plain_groups(rows)
    got = jaccard.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len(set(c for _, c in want.values())) < len(rows) - 20


def test_near_duplicates_in_two_rounds(spark, monkeypatch):
    """Small parts of groups: pairs across parts, and links that only the second round finds."""
    monkeypatch.setattr(jaccard, "CHUNK", 4)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(500)]
    base = rng.choices(words, k=120)
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(i // 10):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    got = jaccard.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_groups(rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_large_clusters_are_compared_by_heads(spark, monkeypatch, seed):
    """Common passages tie many texts into one cluster, larger than a part: no link is lost."""
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(2000)]
    passages = [rng.choices(words, k=80) for _ in range(4)]
    rows = []
    for i in range(90):
        own = rng.choices(words, k=rng.choice([15, 30]))
        t = own + rng.choice(passages) + (rng.choice(passages) if rng.random() < 0.5 else [])
        if rows and rng.random() < 0.4:
            t = rng.choice(rows)[1].split()
            for _ in range(rng.choice([1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    got = jaccard.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in rows])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_groups(rows)


def test_near_duplicates_of_odd_rows(odd, none):
    rows, docs = odd
    got = jaccard.near_duplicates(docs).collect()
    assert len(got) == len(rows) and jaccard.near_duplicates(none).count() == 0
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got}
    assert [by[i] for i in (0, 1, 2, 3, 5, 6, 7, 8, 9, 10, None)] == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 5), (2, 6), (2, 6), (1, 8), (1, 8), (1, 10), (2, None)]
    first = jaccard.first_of_groups(docs)
    assert first.columns == docs.columns
    assert sorted((r.doc_id for r in first.collect()), key=str) == sorted([0, 1, 2, 3, 4, 5, 6, 8, 10], key=str)
    every = {(r.doc_id, r.text): tuple(r) for r in docs.collect()}
    assert all(tuple(r) == every[r.doc_id, r.text] for r in first.collect())  # all columns keep their values
    assert jaccard.first_of_groups(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 300), st.integers(0, 60), st.integers(0, 60), st.integers(0, 2**32))
def test_similar_sets_share_a_key(n, drop, add, seed):
    rng = np.random.default_rng(seed)
    pool = np.unique(rng.integers(0, 2**63, n + add + 5, dtype=np.int64).astype(np.uint64))
    a = np.sort(pool[:n])
    b = np.sort(np.concatenate([rng.permutation(a)[: max(len(a) - drop, 0)], pool[n : n + add]]))
    common = len(np.intersect1d(a, b))
    how = jaccard.bands(80, 100)
    if len(b) and 100 * common >= 80 * (len(a) + len(b) - common):
        assert np.intersect1d(jaccard.block_keys(a, how), jaccard.block_keys(b, how)).size
        s, t = (np.frombuffer(jaccard.parity_sketch(x), np.uint8) for x in (a, b))
        assert jaccard._near(how, len(a), s, len(b), t)


def test_components_of_many_parts(spark):
    from spanloom.llm.components import components

    rng = random.Random(5)
    links = [(k, k + 1) for k in range(0, 300) if k % 50] + [(1000 + k, 1000) for k in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "u long, v long")
    want = {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in links)}
    for local in (500_000, 20):
        assert {r.node: r.component for r in components(df, local).collect()} == want
    assert components(df.limit(0)).count() == 0


# decontamination


def plain_tile(text, item, least):
    """Greedy tiling by trying every pair of places."""
    ft, fi, marked = [True] * len(text), [True] * len(item), 0
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(text)):
                k = 0
                while i + k < len(text) and j + k < len(item) and ft[i + k] and fi[j + k] and text[i + k] == item[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return marked
        ft[i : i + k] = [False] * k
        fi[j : j + k] = [False] * k
        marked += k


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.lists(st.integers(0, 5), min_size=1, max_size=20), st.integers(2, 4))
def test_tiles_against_plain(text, item, least):
    got = decontam.tile(np.array(text, np.uint64), np.array(item, np.uint64), least)
    want = plain_tile(text, item, least)
    assert got == want


def test_texts_of_one_id_are_kept_apart(spark):
    rows = [(1, "a b c d e f g", "en", "s"), (2, "a b c d e f g", "en", "s"), (2, "h i j k l m n", "en", "s"), (3, "o p q", "en", "s"), (3, "r s t", "en", "s"), (3, "r s t", "en", "s"), (None, "r s t", "en", "s")]
    rows += [(None, "u v w", "en", "s"), (None, "u v w", "en", "s"), (None, "x y z", "en", "s"), (None, None, "en", "s"), (None, None, "en", "s"), (5, " ", "en", "s"), (5, " ", "en", "s"), (6, "A", "en", "s"), (6, "B", "en", "s")]
    docs = frame(spark, rows)
    got = jaccard.first_of_groups(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    want = [(1, "a b c d e f g"), (2, "h i j k l m n"), (3, "o p q"), (3, "r s t"), (None, "u v w"), (None, "x y z"), (None, None), (None, None), (5, " "), (5, " "), (6, "A"), (6, "B")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all((r["size"], r.shard, r.slot, r.taken, r.mini, r["__n"]) == ("size", "shard", 1, 2, "mini", 3) for r in got.collect())
    clash = docs.selectExpr("doc_id", "text", "77 AS __n", "doc_id AS __id", "text AS __key", "1.5 AS __h", "map('a', 1) AS __row", "8 AS component_id")
    got = jaccard.first_of_groups(clash)
    assert got.schema == clash.schema and {(r["__n"], r["__h"] == 1.5, r["component_id"]) for r in got.collect()} == {(77, True, 8)}
    assert all((r["__id"], r["__key"]) == (r.doc_id, r.text) for r in got.collect())


def test_near_texts_below_the_threshold_make_no_rows(spark):
    """Long texts that share most blocks with each other but link with none: nothing is emitted for their pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 40, 3000)
    texts = []
    for _ in range(60):
        t = base.copy()
        t[rng.choice(3000, 60, replace=False)] = rng.integers(0, 1 << 40, 60)
        texts.append(" ".join(map(str, t)))
    sets = [x for _, x in hashing.shingle_sets(pa.array(texts), 5)]
    how = jaccard.bands(80, 100)
    assert list(jaccard.tile_links(how, sets, np.arange(60), np.full(60, 2))) == []
    got = jaccard.near_duplicates(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()
    assert all(r.component_id == r.doc_id for r in got)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 25), st.integers(1, 40), st.integers(0, 2**32), st.booleans())
def test_tiles_link_as_all_pairs_do(count, size, seed, two_sides):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, size * 2, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(pool[rng.random(len(pool)) < rng.choice([0.5, 0.9, 0.95])]) for _ in range(count)]
    comp, side = rng.integers(0, count, count), (rng.integers(0, 2, count) if two_sides else np.full(count, 2))
    label, other = comp.copy(), comp.copy()
    for i in range(count):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if (side[i] == 2 or side[i] != side[j]) and len(sets[i]) and len(sets[j]) and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                label[label == label[i]] = label[j]
    got = list(jaccard.tile_links(jaccard.bands(80, 100), sets, comp, side))
    for i, j in got:
        assert other[i] != other[j]
        other[other == other[i]] = other[j]
    assert len({*zip(label.tolist(), other.tolist(), strict=True)}) == len({*label.tolist()}) == len({*other.tolist()})


def test_reordered_passages_leak(spark, odd, none):
    rng = random.Random(4)
    words = [f"term{k}" for k in range(2000)]
    items = [rng.choices(words, k=40) for _ in range(5)]
    noise = lambda n: rng.choices(words, k=n)
    rows = [
        (1, " ".join(noise(50) + items[0] + noise(50)), "en", "s"),
        (2, " ".join(noise(20) + items[1][20:] + noise(30) + items[1][:20]), "en", "s"),  # parts in another order
        (3, ", ".join(w.upper() for w in items[2]), "en", "s"),  # other case and punctuation
        (4, " ".join(noise(50) + items[3][:10] + noise(50)), "en", "s"),  # a quarter
        (5, " ".join(noise(300)), "en", "s"),
    ]
    bench = spark.createDataFrame([(k, " ".join(t), "x") for k, t in enumerate(items)] + [(7, None, "x"), (8, "", "x"), (9, "too few", "x"), (None, "a b c d e f", "x"), (0, " ".join(items[0]), "x")], "item_id long, text string, coverage string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.leaks(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 1), (3, 2)} and min(got.values()) == 1.0
    clean = decontam.decontaminate(docs, bench)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [4, 5]
    assert decontam.leaks(odd[1], bench).count() == 0 and decontam.decontaminate(odd[1], bench).count() == len(odd[0])
    assert decontam.leaks(none, bench).count() == 0 == decontam.decontaminate(none, bench).count()
    assert decontam.leaks(docs, bench.limit(0)).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).count() == 5


def test_short_and_unnamed_items_leak(spark):
    rows = [(1, "x y Too, few z", "en", "s"), (2, "few too", "en", "s"), (3, "in a b c d e f g", "en", "s"), (4, "vor 你好世界 nach", "en", "s"), (5, "clean text", "en", "s"), (6, None, "en", "s"), (7, "too", "en", "s")]
    bench = spark.createDataFrame([(1, "too few"), (2, "你好世界"), (None, "a b c d e f"), (3, "?!"), (4, None), (None, None)], "item_id long, text string")
    docs = frame(spark, rows)
    assert {(r.doc_id, r.item_id, r.matched, r.coverage) for r in decontam.leaks(docs, bench).collect()} == {(1, 1, 2, 1.0), (4, 2, 1, 1.0)}
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [2, 5, 6, 7]


def test_large_benchmarks_are_joined_by_seeds(spark, odd, monkeypatch):
    """The same results by a shuffle of seeds: short items, items without id, repeated rows and null texts included."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 12, 40])))) for k in range(30)] + [(None, "a b c d e f"), (3, None), (40, ""), (41, "v1 v2 v3 v4 v5 v6")]
    bench = spark.createDataFrame(items + items[:3], "item_id long, text string")
    rows = []
    for k in range(80):
        parts = [rng.choice(items)[1] or "" for _ in range(2)]
        cut = parts[0].split()
        rng.shuffle(parts)
        rows.append((k, " ".join(rng.choices(words, k=20) + parts[0].split() + rng.choices(words, k=5) + cut[: len(cut) // 2]), "en", "s"))
    rows += [rows[0], rows[0], (None, rows[1][1], "en", "s"), (100, None, "en", "s"), (101, "x a b c d e f y", "en", "s")]
    docs = frame(spark, rows)
    one = sorted((tuple(r) for r in decontam.leaks(docs, bench).collect()), key=str)
    kept = sorted((tuple(r) for r in decontam.decontaminate(docs, bench).collect()), key=str)
    monkeypatch.setattr(decontam, "PART_BYTES", 100)
    assert sorted((tuple(r) for r in decontam.leaks(docs, bench).collect()), key=str) == one and len(one) > 50
    clean = decontam.decontaminate(docs, bench)
    assert clean.schema == docs.schema and sorted((tuple(r) for r in clean.collect()), key=str) == kept and 0 < len(kept) < len(rows)
    assert decontam.leaks(odd[1], bench).count() == 0 and decontam.decontaminate(odd[1], bench).count() == len(odd[0])
    assert decontam.leaks(docs.limit(0), bench).count() == 0


def test_large_benchmarks_are_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 100)
    items = [" ".join(f"i{k}t{j}" for j in range(12)) for k in range(6)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = frame(spark, [(k, t, "en", "s") for k, t in enumerate(items)] + [(99, "nothing of that kind here at all", "en", "s")])
    assert sorted((r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()) == [(k, k) for k in range(6)]
    assert [r.doc_id for r in decontam.decontaminate(docs, bench).collect()] == [99]


# language identification


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    prob = rng.random((pieces.count, 2))
    word = b" the man"
    known = {}
    for s, e, rows, ids in langid._steps(pieces, *langid.padded([word])):
        known[s, e] = ids[0]

    def total(s):
        if s == len(word):
            return np.ones(2)
        return sum((prob[k] * total(e) for (a, e), k in known.items() if a == s), np.zeros(2))

    alpha = langid.forward(pieces, prob, *langid.padded([word]))
    assert np.allclose(alpha[0, len(word)], total(0)) and len(known) > len(word) + 3


def test_long_words_sum_all_segmentations(monkeypatch):
    pieces = langid.Pieces(vocabulary("piece_bpe_32k.model"))
    rng = np.random.default_rng(2)
    prob = rng.random((pieces.count, 3)) * 0.6
    words = [b"configurationsandinternationalization" * k for k in (1, 2, 5)] + ["straßeñandú名字".encode() * 9, b"q" * 200, bytes(rng.integers(97, 123, 300).astype(np.uint8))]
    assert pieces.longest > 12
    got = langid.scores(pieces, prob, words)
    for w, s in zip(words, got, strict=True):
        b, n = langid.padded([b" " + w])
        assert np.allclose(s, np.log(langid.forward(pieces, prob, b, n)[0, n[0]]))
    monkeypatch.setattr(langid, "WHOLE", 5)  # short words by runs too
    short = [b"configurations", b"the", b"mannen", b"x"]
    runs = langid.scores(pieces, prob, short)
    monkeypatch.setattr(langid, "WHOLE", 40)
    assert np.allclose(runs, langid.scores(pieces, prob, short))


def test_fit_and_prediction_against_plain(spark):
    """Two rounds of EM and the scores of texts, by listing every segmentation."""
    pieces = langid.Pieces(vocabulary("piece_bpe_32k.model"))
    listed = {}

    def cuts(w):
        b, n = langid.padded([w])
        edges = {(s, e): int(i[0]) for s, e, _, i in langid._steps(pieces, b, n)}

        def all_(s):
            return [[]] if s == len(w) else [[edges[s, e], *t] for e in range(s + 1, len(w) + 1) if (s, e) in edges for t in all_(e)]

        return all_(0)

    words, counts = [b"the", b"then", b"than", b"ante"], np.array([3, 1, 2, 5])
    prob = np.full(pieces.count, 1 / pieces.count)
    for _ in range(2):
        want = np.full(pieces.count, 0.05)
        for w, c in zip(words, counts, strict=True):
            every = [(x, np.prod(prob[x])) for x in listed.setdefault(w, cuts(b" " + w))]
            total = sum(p for _, p in every)
            for x, p in every:
                np.add.at(want, x, c * p / total)
        prob = want / want.sum()
    assert np.allclose(langid.fit_one(pieces, [b" " + w for w in words], counts, rounds=2), prob)
    two = np.stack([prob, np.full(pieces.count, 1 / pieces.count)], axis=1)
    docs = spark.createDataFrame([(1, "The then, ante!", "aa", 0.1), (2, "zzz", "bb", 0.2)], "doc_id long, text string, lang_pred string, score double")
    got = langid.predict(docs, ["aa", "bb"], two, vocabulary("piece_bpe_32k.model")).orderBy("doc_id").collect()
    for r, ws in zip(got, ([b"the", b"then", b"ante"], [b"zzz"]), strict=True):
        log = np.array([sum(np.log(sum(np.prod(two[x, k]) for x in cuts(b" " + w))) for w in ws) for k in (0, 1)])
        assert r.lang_pred == ["aa", "bb"][int(log.argmax())] and abs(r.score - 1 / np.exp(log - log.max()).sum()) < 1e-9


def test_scripts_without_spaces_are_learned(spark):
    """Texts of one word each, longer than what is summed at once, and a text that is repeated over the sample."""
    rng = random.Random(4)
    kanji = [chr(c) for c in range(0x4E00, 0x4F80)]
    kana = [chr(c) for c in range(0x3042, 0x3092)]
    say = {"zh": lambda: "".join(rng.choice(kanji) for _ in range(30)), "ja": lambda: "".join(rng.choice(kana if rng.random() < 0.6 else kanji) for _ in range(30))}
    rows = [(i, say[g](), g) for i in range(400) for g in ("zh", "ja")]
    path = vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, prob = langid.fit(docs.filter("doc_id < 200"), path)
    got = langid.predict(docs.filter("doc_id >= 200"), langs, prob, path).collect()
    assert langs == ["ja", "zh"] and all(r.lang_pred == r.lang for r in got)
    assert max(len(p) for p in langid.cut_long("中".encode() * 100_000)) <= langid.WHOLE
    assert b"".join(langid.cut_long("中a".encode() * 1000)) == b" " + "中a".encode() * 1000
    rows = [(0, "un texte bien rare", "fr")] * 2100 + [(k, f"some words {k}", "en") for k in range(1, 50)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), path)[0] == ["en", "fr"]


def test_repeated_labels_change_nothing(spark):
    rows = [(k, ("good words here " if k % 2 else "bad ### things ") * 5 + str(k)) for k in range(200)]
    labels = [(k, k % 2) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    again = spark.createDataFrame(labels + [(7, 1)] * 4100 + [(8, 0)] * 4100, "doc_id long, quality int")
    assert np.array_equal(quality.fit(docs, again), want)
    assert [r.predicted for r in quality.score(docs, want).orderBy("doc_id").collect()] == [k % 2 for k in range(200)]


def test_languages_are_bounded(spark):
    path = vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame([(k, "some words here", f"l{k % 7}") for k in range(40)], "doc_id long, text string, lang string")
    langs, prob = langid.fit(docs, path, most_words=10, languages=5)
    assert langs == ["l0", "l1", "l2", "l3", "l4"] and prob.shape[1] == 5


def test_languages(spark, odd, none):
    rng = random.Random(6)
    lex = {"aa": ["ka", "lo", "mi", "nu"], "bb": ["stra", "pfe", "schu", "kno"]}
    rows = [(i, " ".join("".join(rng.choices(lex[g], k=3)) for _ in range(20)), g, "s") for i in range(60) for g in (["aa", "bb"][i % 2],)]
    path = vocabulary("piece_bpe_32k.model")
    docs = frame(spark, rows)
    langs, prob = langid.fit(docs.filter("doc_id < 40"), path)
    assert langs == ["aa", "bb"] and np.allclose(prob.sum(0), 1)
    got = langid.predict(docs, langs, prob, path).collect()
    assert all(r.lang_pred == r.lang and 0.9 < r.score <= 1 for r in got)
    by = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd[1], langs, prob, path).collect()}
    assert all(by[i] == ("und", 0.0) for i in (0, 1, 2, 3, 10)) and by[4][0] in langs and by[5][0] in langs
    assert langid.predict(none, langs, prob, path).count() == 0
    langs, prob = langid.fit(none, path)
    assert langs == [] and {r.lang_pred for r in langid.predict(docs, langs, prob, path).collect()} == {"und"}


# token files


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 3000), st.sampled_from([1, 3, 300, 65536]), st.integers(0, 2**32), st.booleans())
def test_coder_round_trip(size, bound, seed, skewed):
    rng = np.random.default_rng(seed)
    ids = (rng.integers(0, bound, size) if not skewed else np.minimum(rng.zipf(1.3, size), bound) - 1).astype(np.uint16)
    assert (tokenfiles.decode(tokenfiles.encode(ids)) == ids).all()


def test_coder_round_trip_of_whole_blocks():
    rng = np.random.default_rng(1)
    ids = (np.minimum(rng.zipf(1.2, 400_000), 40_000) - 1).astype(np.uint16)
    ids[200_000:300_000] = ids[:100_000]
    assert (tokenfiles.decode(tokenfiles.encode(ids)) == ids).all()


def test_mixture_is_a_distribution():
    """Intervals of all ids lie side by side, fill the mixture's total at most, and are found again from any place in them."""
    model, rng = tokenfiles.Model(50), np.random.default_rng(2)
    x = rng.integers(0, 50, 64).astype(np.uint32)
    for t in range(40):
        y = np.where(rng.random(64) < 0.7, (x * 7 + 1) % 50, rng.integers(0, 50, 64)).astype(np.uint32)
        model.predict(x, x)
        ends = np.zeros(64, np.int64)
        for i in range(50):
            start, size = model.interval(np.full(64, i, np.uint32))
            assert (start == ends).all() and (size > 0).all()
            for place in (start, start + size - np.uint32(1), start + size // np.uint32(2)):
                assert (model.find(place) == i).all()
            ends = (start + size).astype(np.int64)
        assert (ends <= 1 << tokenfiles.ALL).all() and (ends > 0.95 * (1 << tokenfiles.ALL)).all()
        model.interval(y)
        model.learn(y, t)
        x = y


def test_coder_compresses_what_repeats():
    ids = np.tile(np.arange(50, dtype=np.uint16) * 700, 400)
    assert len(tokenfiles.encode(ids)) < ids.size // 2


def test_coder_beats_order_zero():
    """Text of one order-1 chain codes well below the entropy of its ids."""
    rng = np.random.default_rng(3)
    next_ = rng.integers(0, 500, (500, 3))
    ids = np.zeros(200_000, np.int64)
    for k in range(1, len(ids)):
        ids[k] = next_[ids[k - 1], 0 if rng.random() < 0.7 else rng.integers(3)]
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert len(tokenfiles.encode(ids.astype(np.uint16))) * 8 / len(ids) < 0.5 * entropy


def test_token_files(spark, odd, none, tmp_path):
    import struct

    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [*odd[0], (11, "It's <|endoftext|> ΑΣ ΟΔΟΣ  e\u0301 1234 ...", "en", "a"), (12, "\x85a\x1cb\u2028c", "en", "a"), (4, "another text of one id", "en", "a")]
    files = tokenfiles.write(frame(spark, rows), path, tmp_path.as_uri())
    got = sorted(tokenfiles.read(files).collect(), key=lambda r: r.start)
    # texts of one id are in the order of their hashes
    order = dict(spark.createDataFrame([(r[1] or "",) for r in rows], "t string").selectExpr("t", "xxhash64(t) AS h").distinct().collect()).get
    want, start = [], 0
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, order(r[1] or ""))):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert tokenfiles.read(tokenfiles.write(none, path, tmp_path.as_uri())).count() == 0


def test_words_as_the_tokenizer_takes_them():
    """Words by pieces and in lines give the ids of whole texts, signs, cases, apostrophes and the mark included."""
    words = tokenfiles.Words(vocabulary("word_bpe_49k.json"))
    assert words.mark is not None
    rng, parts = random.Random(8), ["it", "'s", "IT'S", "don't", "WORD", "...", "$$$", "a1b2", "42", "é", "e\u0301", "\u0301", "§", "¶", "¤", "~", "#", "<|endoftext|>", "<|", "|>", "ß", "ΑΣ", "İ", "ﬁ", "名", "''", "'", "_", "-", "`", "’s", "\x85", "\u2028", "\ufeff", "\x00", "\U0001f600"]
    texts = [" ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    long = " ".join(texts) * 40  # in several parts
    texts = [None, *texts[:1500], "", long, "", *texts[1500:], long, "x"]
    got = list(words.encode(pa.array(texts[:2000]))) + list(words.encode(pa.array(texts[2000:])))
    for t, ids in zip(texts, got, strict=True):
        t = t or ""
        assert ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_words_that_are_forgotten_are_encoded_again(monkeypatch):
    monkeypatch.setattr(tokenfiles, "MEMORY", 50)
    monkeypatch.setattr(tokenfiles, "SLOTS", 7)
    words = tokenfiles.Words(vocabulary("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(30)) for _ in range(60)]
    got = [list(words.encode(pa.array([t])))[0] for t in texts]
    assert all(ids.tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids for t, ids in zip(texts, got, strict=True))


def test_damaged_token_files_are_found(tmp_path):
    w = tokenfiles.Writer(tmp_path.as_uri())
    w.add(1, np.arange(500, dtype=np.uint16))
    w.close()
    place = tmp_path / w.uri.rsplit("/", 1)[1]
    raw = bytearray(place.read_bytes())
    raw[20] ^= 255
    place.write_bytes(bytes(raw))
    with pytest.raises(ValueError):
        list(tokenfiles.read_file(w.uri))


def test_tiles_of_repetitive_texts():
    """Few different tokens, against the plain loop; very long runs of one token take their share of time only."""
    rng = random.Random(1)

    def plain(doc, item, least):
        covered, free_d, free_i = 0, [True] * len(doc), [True] * len(item)
        while True:
            best = (0, 0, 0)
            for j in range(len(item)):
                for i in range(len(doc)):
                    k = 0
                    while i + k < len(doc) and j + k < len(item) and free_d[i + k] and free_i[j + k] and doc[i + k] == item[j + k]:
                        k += 1
                    best = max(best, (k, -j, -i))
            k, j, i = best[0], -best[1], -best[2]
            if k < least:
                return covered
            free_d[i : i + k] = [False] * k
            free_i[j : j + k] = [False] * k
            covered += k

    h = lambda x: hashing.mix(np.array(x, np.uint64) + np.uint64(77))
    for _ in range(150):
        v = rng.choice([1, 2, 3, 6])
        a, b = ([rng.randrange(v) for _ in range(rng.randrange(1, n))] for n in (40, 25))
        assert decontam.tile(h(a), h(b), 3) == plain(a, b, 3)
    one = np.full(1_000_000, 5, np.uint64)
    assert decontam.tile(one, one[:1000], 5) == 1000 and decontam.tile(np.tile(h(range(7)), 100_000), np.tile(h(range(7)), 100), 5) == 700
