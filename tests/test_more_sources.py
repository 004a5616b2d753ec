"""Extraction that goes on where it stopped, word vectors, and batches filled up."""

import time
from pathlib import Path

import numpy as np
import pytest

from spanloom.operators import extract, windows
from spanloom.sources import vectors


def counting(folder, fail=(), die=()):
    """A client that leaves a mark for each call."""

    def client(text):
        (Path(folder) / f"{text}-{time.time_ns()}").touch()
        if text in die:
            raise KeyboardInterrupt  # no error of a call: the task ends
        if text in fail:
            raise ValueError(f"bad {text}")
        return f"reply to {text}"

    return client


def calls(folder):
    return sorted(p.name.split("-")[0] for p in Path(folder).iterdir())


def test_a_stopped_job_goes_on(spark, tmp_path):
    marks, log = tmp_path / "marks", str(tmp_path / "log")
    marks.mkdir()
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "id long, prompt string").coalesce(1)  # other tasks would be killed
    with pytest.raises(Exception):
        extract.resume(rows, counting(marks, die={"t17"}), log, commit=4)
    first = calls(marks)
    assert "t17" in first and len(first) < 80
    before = set(first) - {"t17"}
    got = extract.resume(rows, counting(marks, fail={"t3", "t21"}), log, commit=4, retries=0).collect()
    every = calls(marks)
    assert all(every.count(t) == 1 for t in before)  # none is called twice
    assert sorted(r.id for r in got) == list(range(40))
    errors = {r.id: r.error for r in got if r.error}
    assert set(errors) <= {3, 21} and all(r.reply == f"reply to t{r.id}" for r in got if not r.error)
    n = len(every)
    assert extract.resume(rows, counting(marks), log).count() == 40 and len(calls(marks)) == n  # nothing is left
    mended = extract.resume(rows, counting(marks), log, again=True).collect()
    assert not any(r.error for r in mended) and len(calls(marks)) == n + len(errors)


def test_one_rate_over_all_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(k, str(k)) for k in range(12)], "id long, prompt string").repartition(4)
    began = time.time()
    got = extract.resume(rows, lambda x: x, str(tmp_path / "log"), rate=6.0)
    assert got.count() == 12 and time.time() - began >= 1.0  # three calls in a task, two thirds of a second apart


def test_vectors(spark, tmp_path):
    (tmp_path / "v.vec").write_text("3 2\nalpha 1 2\nbeta 0.5 -1\ngamma 3 4 \nalpha 9 9\n", encoding="utf-8")
    words = spark.createDataFrame([("alpha", 2), ("gamma", 3), ("ação", 4), ("zz", 5), ("q", 6)], "word string, word_id long")
    known = vectors.read(spark, str(tmp_path / "v.vec"), words)
    got = {r.word: r.vector for r in known.collect()}
    assert set(got) == {"alpha", "gamma"} and got["gamma"] == [3, 4] and got["alpha"] in ([1, 2], [9, 9])
    table = {b: [float(b % 7), float(b % 5) - 2] for b in range(0, 50, 2)}
    frame = spark.createDataFrame(list(table.items()), "bucket long, vector array<float>")
    made = {r.word_id: r.vector for r in vectors.matrix(words, known, frame, 2, buckets=50).collect()}
    assert made[3] == [3, 4] and len(made) == 5
    for word, k in (("ação", 4), ("zz", 5), ("q", 6)):
        hits = [table[b] for p in vectors.pieces(word) for b in [vectors.bucket(p, 50)] if b in table]
        want = np.mean(hits, axis=0) if hits else [0, 0]
        assert np.allclose(made[k], want, atol=1e-6)
    assert vectors.pieces("ab") == ["<ab", "<ab>", "ab>"] and vectors.bucket("a", 1 << 32) == 0xE40C292C


def test_collate_against_plain(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(130):
        n = int(rng.integers(0, 9))
        rows.append((k, list(range(n)), [f"l{i}" for i in range(n)] if k % 11 else None, [[i] for i in range(n % 3)]))
    df = spark.createDataFrame(rows, "id long, ids array<int>, labels array<string>, deep array<array<int>>").coalesce(2)
    got = windows.collate(df, {"ids": 0, "labels": None, "deep": []}, 8).collect()
    assert sorted(r.id for r in got) == list(range(130))
    by = {}
    for r in got:
        by.setdefault(r.batch, []).append(r)
    own = {k: (a, b, c) for k, a, b, c in rows}
    assert sorted(map(len, by.values()))[-10:] == [8] * 10 and len(by) <= 130 // 8 + 2
    for part in by.values():
        longest = max(max(len(x) for x in own[r.id] if x is not None) for r in part)
        for r in part:
            a, b, c = own[r.id]
            fill = lambda x, f: None if x is None else x + [f] * (longest - len(x))
            assert (r.longest, r.ids, r.labels, r.deep) == (longest, fill(a, 0), fill(b, None), fill(c, []))
    assert windows.collate(df.filter("id < 0"), {"ids": 0}, 8).count() == 0
