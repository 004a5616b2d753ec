"""Work that grows no faster than the input: what plans and batches hold for it."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import align, bio, long, windows
from spanloom.plans import catalog, synth
from spanloom.sources import arrays

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gold_labels_are_taken_as_lists(spark):
    segs = [0, 1, 5, 77, (1 << 20) * 3 + 2, (1 << 51) + 11]
    df = spark.createDataFrame([(s, n) for s in segs for n in (1, 7, 32)], "seg long, n int")
    gold, pred = synth._labels(F.col("seg"), F.col("n"))
    assert "lambda" not in plan(df.select(gold))

    def plain(seg, p):
        b, o, m = p // 8, p % 8, 2147483647
        t, r = (seg % m * 4 + b) * 48271 % m // 7 % 12, (seg % m * 32 + p) * 69621 % m // 11 % 29
        g = "O" if t >= 8 or o >= 1 + (seg + b) % 4 else ("B-" if o == 0 else "I-") + synth.TYPES[t]
        changed = {0: "O", 1: f"I-{synth.TYPES[(t + 1) % 8]}", 2: "BAD"} | ({3: f"B-{synth.TYPES[(seg + b) % 8]}"} if o >= 5 else {})
        return g, changed.get(r, g)

    for r in df.select("seg", "n", gold.alias("g"), pred.alias("p")).collect():
        assert list(zip(r.g, r.p, strict=True)) == [plain(r.seg, p) for p in range(r.n)]


def test_outside_labels_are_one_run(spark):
    df = spark.createDataFrame([(["O", "O", "I-A", "I-A", "O", "O", "B-A", "I-A", None, "O"],)], "x array<string>")
    assert df.select(T.let(F.col("x"), bio._runs)).first()[0] == [0, 2, 4, 6, 8, 9]


def test_subwords_of_a_token_are_not_searched_for(spark):
    assert "size(filter(" not in plan(catalog.queries()["subword_alignment"](spark, SMALL))


def test_labels_of_both_sides_are_read_once(spark):
    assert plan(catalog.queries()["class_weights_vocabulary"](spark, SMALL)).count("Scan parquet") == 2


def test_repair_of_rows_sorts_once(spark):
    df = spark.createDataFrame([(1, 0, "B-A")], "id long, p int, x string")
    assert plan(bio.repair_rows(df, "id", "p", "x")).count("Sort [") == 1


@pytest.mark.parametrize("most", [1, 10, 1000])
def test_slices_of_a_batch(most):
    rows = [[1] * 7, None, [], [1] * 25, [1], [1] * 4]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int64()))], names=["x"])
    got = [s.column(0).to_pylist() for s in windows.slices(batch, 0, most)]
    assert sum(got, []) == rows
    assert all(sum(len(x or []) for x in s) <= most or len([x for x in s if x]) == 1 for s in got)


def test_predictions_are_not_multiplied_by_their_reach(spark):
    tokens = [(t, p, s) for t in ("a", "b", None) for p, s in enumerate([0, 3, 4094, 4095, 4096, 4099, 9000, None])]
    words = [(t, k, s) for t in ("a", None) for k, s in [(0, 5), (1, 1), (2, 4097), (3, 4093), (4, 4097), (5, 8998), (6, 9002), (7, -1)]]
    left = spark.createDataFrame(tokens, "id string, pos int, start int").repartition(3)
    right = spark.createDataFrame([(t, k, f"L{k}", s, s + 1) for t, k, s in words], "id string, k int, label string, start int, end int").repartition(3)
    got = {(r.id, r.pos): r.label for r in align.nearest_rows(left, right).collect()}

    def plain(t, s):
        near = [(abs(x - s), k) for u, k, x in words if s is not None and t is not None and u == t and x != -1 and abs(x - s) <= 2]
        return f"L{min(near)[1]}" if near else "O"

    assert got == {(t, p): plain(t, s) for t, p, s in tokens} and len(got) == len(tokens)
    assert "sequence(" not in plan(align.nearest_rows(left, right))


def test_spans_write_runs_and_no_tokens(spark, monkeypatch):
    texts = {1: ["I-A", "I-A", "O", "B-A", "I-A", "I-A", "I-A", "B-A"], 2: ["O", "B-A", "I-A", "I-A", "I-A", "I-B", "BAD", "I-A"], None: ["B-A", "I-A"], 3: ["O"] * 9}
    rows = [(k, p * 3, x, f"t{p}") for k, t in texts.items() for p, x in enumerate(t)]  # places have gaps
    df = spark.createDataFrame(rows, "id long, pos long, label string, token string").repartition(3)
    written, plain = [], long._written
    monkeypatch.setattr(long, "_written", lambda d, tag: written.append(plain(d, tag)) or written[-1])
    got = {(r.id, r.type, r.start, r.end, r.text) for r in long.spans(df, "id", "pos", "label", "lenient", "token", block=6).collect()}
    want = {(1, "A", 0, 4, "t0 t1"), (1, "A", 9, 19, "t3 t4 t5 t6"), (1, "A", 21, 22, "t7"), (2, "A", 3, 13, "t1 t2 t3 t4"), (2, "B", 15, 16, "t5"), (2, "A", 21, 22, "t7"), (None, "A", 0, 4, "t0 t1")}
    assert got == want
    assert len(written) == 1 and {"start", "end", "first", "last"} <= set(written[0].columns)


def test_arrays_are_written_without_a_shuffle_and_records_joined_in_place(spark, tmp_path, monkeypatch):
    written, plain = [], arrays._written
    monkeypatch.setattr(arrays, "_written", lambda d, tag: written.append(plain(d, tag)) or written[-1])
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", None)
    df = spark.createDataFrame([(k, f'"}}{{[\\{k}', [{"a": k}] * (k % 3)) for k in range(300)], "k long, v string, s array<map<string,int>>").repartition(3)
    arrays.write_array(df, str(tmp_path / "x"))
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(x) for x in sizes]
    try:
        spark.conf.set(sizes[0], "1000")
        spark.conf.set(sizes[1], "1")
        rows = arrays.records(spark, str(tmp_path / "x"))
        got = [(r.file, r.record, r.value) for r in rows.collect()]
    finally:
        for x, y in zip(sizes, before, strict=True):
            spark.conf.set(x, y)
    assert sorted(json.loads(v)["k"] for *_, v in got) == list(range(300))
    assert {(f, k) for f, k, _ in got} == {(f, k) for f in {f for f, *_ in got} for k in range(sum(f == x for x, *_ in got))}
    assert len(written) == 2 and all("value" not in d.columns for d in written)
