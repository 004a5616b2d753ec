"""The audit of filters against a plain loop over documents and orders."""

import itertools
import re
from collections import defaultdict

import numpy as np
import pytest

from spanloom.llm import filters


def plain_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if x == 1 else set()
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        least = first.get(t)
        copy = least is not None and (i is None or i > least)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        parts[s or ""].append(({f for f in fails if fails[f]}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part, rows in parts.items():
        shapley = defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                failing = [r for r in rows if f in r[0]]
                out[part, "".join(order), k + 1] = [len(left), len(gone), len(failing) - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[f] += len(gone)
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(shapley[f])
    return out


@pytest.mark.parametrize("small", [filters.SMALL, 3])
def test_audit(spark, monkeypatch, small):
    monkeypatch.setattr(filters, "SMALL", small)
    rng = np.random.default_rng(3)
    words = ["the", "Big", "$5", "naïve", "ÀÉ", "x|y", "plain", "more", "words", "ever"]
    texts = [None, "", " ", "A", *[" ".join(rng.choice(words[rng.integers(3) :], rng.integers(1, 500))) for _ in range(30)], " ".join(map(str, range(300)))]
    docs = [(k, texts[k % len(texts)], ["a", None, "b"][k % 3]) for k in range(90)]
    docs += [(None, "A", "a"), (None, "only here", "b"), (7, texts[7], "b"), (7, "other text of 7", "b"), (200, "only here too", "new")] + [(300 + k, "hot", "a") for k in range(60)]
    labels = [(k, k % 2, k % 5 == 0 and 1 or 0) for k in range(0, 90, 2)] + [(3, 0, None), (3, 1, 0), (None, 1, 1), (4, None, 1)]
    df = spark.createDataFrame([(i, t, s, 3, "x") for i, t, s in docs], "doc_id long, text string, source string, mask int, part string")
    got = filters.audit(df.repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = plain_audit(docs, labels)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want and len(got) == len(want)


def test_long_text_and_empty_table(spark):
    text = " ".join(f"w{k}" for k in range(400_000))
    df = spark.createDataFrame([(1, text, "a"), (2, text, "a"), (3, "x" * 2_500_000, "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in filters.audit(df, labels).collect()}
    assert (got["EABCD", 1].removed, got["ABCDE", 1].removed, got["ABCDE", 5].kept) == (1, 1, 1)
    assert filters.audit(df.filter("doc_id < 0"), labels).collect() == []
