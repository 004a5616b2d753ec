"""Removal of repeated strings against a dictionary of all of them."""

import hashlib
import random

import numpy as np
import pytest

from spanloom.llm import suffixes
from spanloom.llm.shared import table


def plain_removal(rows, width=100):
    """(doc_id, n_bytes, n_removed, n_spans, bytes left) of rows in order: null last, then by hash of the text."""
    seen, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            s = b[k : k + width]
            if s in seen:
                gone[k : k + width] = True
            seen[s] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), left))
    return sorted(out, key=str)


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, d int, kept string").repartition(3)
    got = suffixes.without_repeats(df, **how).collect()
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "bé", "gamma", "delta-long-word", "of", "the", "東京"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    shared = [say(40) for _ in range(4)]
    out = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "x" * 5000, "ab" * 400, shared[0][:120], say(10) * 30]
    for k in range(60):
        parts = [say(rng.randrange(30))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(60, 300)], say(rng.randrange(20))]
        out.append("".join(parts))
    out += [out[15], out[20], out[20], out[20] + "!", "?" + out[20], out[20][:50] + "#" + out[20][51:]]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_batches(spark, texts, batches):
    rows = list(enumerate(texts))
    assert run(spark, rows, batches=batches) == plain_removal(rows)


def test_small_bounds(spark, texts, monkeypatch):
    rows = list(enumerate(texts))
    want = plain_removal(rows)
    for name, value in (("RUN", 1000), ("SORTED", 500), ("FEW", 3), ("IDS", 5), ("GATHERED", 50)):
        monkeypatch.setattr(suffixes, name, value)
    assert run(spark, rows, batches=3) == want


def test_hot_seeds(spark, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 1)
    rows = list(enumerate(texts))
    assert run(spark, rows, batches=3) == plain_removal(rows)


def test_odd_ids(spark, texts):
    rows = [(None, texts[9]), (None, texts[9]), (None, texts[12] + "."), *[(k // 2, t) for k, t in enumerate(texts)], (5, texts[11]), (5, texts[11]), (6, "short"), (6, "short")]
    assert run(spark, rows) == plain_removal(rows)


def test_levels_merge(spark, texts):
    family = suffixes.Family(spark, 3)
    sizes = []
    for k in range(6):
        df = spark.createDataFrame([(10 * k + i, texts[10 * k + i] or "") for i in range(10)], "d long, text string")
        all_ = spark.createDataFrame([(i, texts[i] or "") for i in range(10 * k + 10)], "d long, text string")
        family.add(df, all_)
        sizes.append([n for n, *_ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1]]  # merged when the next batch comes
    family.close()


def test_empty_and_long(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(5_000_000))
    part = long[3_000_000:4_500_000]
    rows = [(1, long), (2, "begin " + part + " end"), (3, "y" * 3_000_000), (4, None)]
    got = {r.doc_id: r for r in suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the seams may lie up to some equal bytes further out
    assert got[1].n_removed == 0 and 1_500_000 <= got[2].n_removed <= 1_500_010 and got[2].n_spans == 1
    assert (got[3].n_removed, got[3].n_spans, len(got[3].kept)) == (2_999_999, 1, 1) and got[4].n_bytes == 0


def test_whole_table(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = __spark_entry__.queries()["op11_suffix_dedup"](spark, sf).collect()
    want = [(i, n, m, k, hashlib.sha256(b).hexdigest()) for i, n, m, k, b in plain_removal(rows)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(r.n_removed for r in got)
