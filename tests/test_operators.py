"""Rules of single operators on small fixtures with hand-made results."""

import itertools
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import align, bio, crf, events, extract, features, metrics, scoring, stats, windows
from spanloom.sources import files
from spanloom.streaming import segments as stream

# labels


def plain_repair(tags):
    out = []
    for t in tags:
        if "-" not in t:
            out.append("O")
        elif t[:2] in ("B-", "O-") or (t[:2] == "I-" and out and out[-1] in (t, "B-" + t[2:])):
            out.append(t)
        else:
            out.append("O")
    return out


def plain_spans(tags, lenient):
    out, i = [], 0
    while i < len(tags):
        t = tags[i]
        before = tags[i - 1] if i else "O"
        if t.startswith("B-") or (lenient and t.startswith("I-") and before not in (t, "B-" + t[2:])):
            j = i + 1
            while j < len(tags) and tags[j] == "I-" + t[2:]:
                j += 1
            out.append((t[2:], i, j))
            i = j
        else:
            i += 1
    return out


@pytest.mark.parametrize(
    "tags,want",
    [("B-X I-X O", "B-X I-X O"), ("O I-X I-X", "O O O"), ("B-X I-Y I-X", "B-X O O"), ("BAD B-X", "O B-X"), ("E-X I-X", "O O"), ("B-X B-X I-X", "B-X B-X I-X"), ("O-x I-x", "O-x O")],
)
def test_repair_fixtures(tags, want):
    assert plain_repair(tags.split()) == want.split()


def test_labels_exhaustively(spark):
    alphabet = ["O", "B-X", "I-X", "I-Y", "BAD", "B-Y-Z", "I-Y-Z"]
    every = [list(s) for n in range(5) for s in itertools.product(alphabet, repeat=n)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(every)], "id int, t array<string>").repartition(4)
    one = lambda s: F.transform(s, lambda x: F.concat_ws("|", x["type"], x["start"].cast("string"), x["end"].cast("string")))
    rows = df.select("id", bio.repair(F.col("t")).alias("r"), bio.violations(F.col("t")).alias("v"), one(bio.spans(F.col("t"))).alias("s"), one(bio.spans(F.col("t"), "lenient")).alias("l"), one(bio.spans(bio.repair(F.col("t")))).alias("f")).collect()
    shown = lambda spans: ["|".join(map(str, s)) for s in spans]
    for r in rows:
        t = every[r.id]
        assert r.r == plain_repair(t) and r.v == sum(a != b for a, b in zip(t, r.r, strict=True))
        assert r.s == shown(plain_spans(t, False)) == r.f and r.l == shown(plain_spans(t, True))
    long = df.filter(F.size("t") > 0).select("id", F.posexplode("t").alias("p", "x"))
    fixed = bio.repair_rows(long, "id", "p", "x").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "fixed"))).alias("f")).collect()
    assert all([x.fixed for x in r.f] == plain_repair(every[r.id]) for r in fixed)
    assert df.select(bio.repair(F.col("t"), "IOBES").alias("r"), "t").filter("r <> t").count() == 0


def test_validation(spark):
    df = spark.createDataFrame([(["a"], ["O"]), (["a"], ["O", "O"]), ([], []), (None, ["O"])], "tokens array<string>, labels array<string>")
    assert [r.reason for r in bio.validate(df).collect()] == [None, "length mismatch", "empty", "missing field"]


# events

FAVOR, AGAINST = "Favor", "Against"
OUTCOMES = [
    ([], [], [], None),
    (["rejeitada"], [], [("A Câmara Municipal", FAVOR)], "Approved"),
    (["rejeitada"], [], [("o executivo municipal", FAVOR)], "Approved"),
    (["rejeitada"], [], [("o executivo câmarário municipal", FAVOR)], "Approved"),
    (["rejeitada"], [], [("o executivo", FAVOR)], "Rejected"),
    (["foi rejeitada", "aprovada"], [], [], "Rejected"),
    (["não aprovada"], [], [], "Rejected"),
    (["não foi aprovada"], [], [], "Approved"),
    (["indeferido"], [], [], "Rejected"),
    (["deliberou"], [("por unanimidade", "Unanimity")], [], "Approved"),
    (["votou"], [], [("João", FAVOR), ("a", AGAINST), ("b", AGAINST)], "Rejected"),
    (["votou"], [], [("João", FAVOR), ("a", AGAINST)], None),
]


def test_outcomes(spark):
    schema = "said array<string>, counts array<struct<text:string,type:string>>, voters array<struct<text:string,position:string>>, want string"
    df = spark.createDataFrame(OUTCOMES, schema)
    got = df.select("want", events.outcome(F.col("said"), F.col("counts"), F.col("voters")).alias("o")).collect()
    assert [r.o for r in got] == [r.want for r in got]


def test_event(spark):
    tokens = "A câmara aprovou por unanimidade a proposta um e dois".split()
    labels = "B-VOTER-FAVOR I-VOTER-FAVOR B-VOTING B-COUNTING-UNANIMITY I-COUNTING-UNANIMITY O B-SUBJECT I-SUBJECT O B-SUBJECT".split()
    df = spark.createDataFrame([(tokens, labels), (tokens, ["O"] * 9 + ["B-SUBJECT"]), ([], [])], "t array<string>, l array<string>")
    e, none, empty = (r.e for r in df.select(events.construct(F.col("t"), F.col("l")).alias("e")).collect())
    assert none is None and empty is None
    assert e.subject == "proposta um" and e.voting_expressions == ["aprovou"] and e.outcome == "Approved"
    assert [tuple(p) for p in e.participants] == [("A câmara", "Favor")] and [tuple(c) for c in e.counting] == [("por unanimidade", "Unanimity")]


# metrics

EVENT = "struct<subject:string,participants:array<struct<text:string,position:string>>,counting:array<struct<text:string,type:string>>,voting_expressions:array<string>,outcome:string>"


def event(subject=None, people=(), counts=(), said=("v",)):
    return (subject, list(people), list(counts), list(said), None)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), f"gold_event {EVENT}, pred_event {EVENT}")


def counts(df):
    r = df.first()
    return r.tp, r.fp, r.fn


def test_event_metrics(spark):
    e = event
    assert counts(metrics.subject_f1(pairs(spark, (e(" a "), e("A"))))) == (1, 0, 0)
    assert counts(metrics.subject_f1(pairs(spark, (e("a"), e("b"))))) == (0, 1, 0)
    assert counts(metrics.subject_f1(pairs(spark, (e("a"), e("b"))), mismatch="both")) == (0, 1, 1)
    assert counts(metrics.subject_f1(pairs(spark, (e("a"), e(None)), (e("a"), None)))) == (0, 0, 2)
    assert counts(metrics.subject_f1(pairs(spark, (e(None), e(None)), (None, e("x"))))) == (0, 0, 0)
    assert counts(metrics.counting_f1(pairs(spark, (e(), e()), (e(counts=[("A", "x")]), e(counts=[("a", "X")])), (e(counts=[("a", "x")]), None)))) == (1, 0, 1)
    assert counts(metrics.detection(pairs(spark, (e(), e()), (None, e()), (e(), None), (None, None)))) == (1, 1, 1)
    two = pairs(spark, (e(people=[("a", "Favor")]), e(people=[("a", "Favor"), ("b", "Favor")])))
    r = metrics.participant_f1(two).first()
    assert (r.precision, r.recall, r.f1) == (0.5, 1.0, 0.666667)
    assert metrics.complete(two).first().verdict == "participants"
    assert metrics.participant_f1(pairs(spark, (e(), e()))).first().f1 == 1.0
    none = metrics.event_summary(pairs(spark, (None, e()))).first()
    assert none.num_examples == 1 and none.event_detection_f1 == none.subject_f1 == none.counting_f1 == none.participant_vote_f1 == none.complete_event_f1 == 0
    verdicts = [r.verdict for r in metrics.complete(pairs(spark, (None, None), (None, e()), (e(), None), (e("a"), e("b")), (e(counts=[("a", "x")]), e()), (e("a"), e(" A ")))).collect()]
    assert verdicts == ["true_negative", "false_positive", "missed", "subject", "counting", "true_positive"]


def test_soft_overlap(spark):
    e = event
    df = spark.createDataFrame([("a b c", "b c d"), ("", ""), ("", "a"), (None, None), ("A  b", "b a")], "a string, b string")
    assert [r.j for r in df.select(T.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.5, 1.0, 0.0, 1.0, 1.0]
    rows = pairs(
        spark, (None, None), (None, e()), (e(counts=[("t", "X")]), e(counts=[("t", "x")])), (e(people=[("a b", "Favor"), ("a", "Favor")]), e(people=[("a b", "Favor")])), (e("s", said=["x"]), e("s", said=["y"]))
    )
    got = metrics.soft(rows).collect()
    assert [r.overall for r in got[:2]] == [1.0, 0.0] and got[2].counting == 0.0 and got[3].participants == 1.0
    assert got[4].overall == 1.0  # a missed expression has no weight of its own
    m = metrics.soft_metrics(pairs(spark, (None, None), (e("s"), e("s")))).first()
    assert m.correct == 2 and m.precision == 2.0  # segments without events count as correct


# windows and alignment


@pytest.mark.parametrize("n,want", [(459, [(0, 459)]), (460, [(0, 459), (409, 460)]), (868, [(0, 459), (409, 868)]), (869, [(0, 459), (409, 868), (818, 869)]), (0, [])])
def test_uniform_windows(spark, n, want):
    w = spark.range(1).select(windows.uniform_windows(F.lit(n)).alias("w")).first().w
    assert [(x.start, x.end) for x in w] == want == windows.greedy_windows([1] * n, None)


def test_windows_cover_long_texts(spark):
    n = 100_001
    docs = spark.range(1).select("id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.lit("x")).alias("tokens")).withColumn("n", F.size("tokens"))
    pieces = windows.windowed(docs).select("id", "n", "window_idx", "start", "end", F.col("tokens").alias("labels"))
    assert pieces.agg(F.count(F.lit(1)), F.max("end")).first()[:] == (245, n)
    assert windows.merge(pieces, "id", F.col("n"), "labels").select(F.count_if(F.array_contains("labels", "O"))).first()[0] == 0


def test_any_tokenizer(spark):
    df = spark.createDataFrame([(1, ["aa"] * 700), (2, ["b"] * 5), (3, ["x" * 1000, "y"]), (4, None)], "id int, tokens array<string>")
    got = {r.id: [tuple(w) for w in r.windows] for r in windows.tokenizer_windows(df, lambda t: [len(x) for x in t]).collect()}
    assert got[2] == [(0, 5)] and got[3] == [(1, 2)] and got[4] == []
    assert got[1][0] == (0, 229) and got[1][-1][1] == 700 and all(b > a for a, b in got[1])
    labels = ["O"] * 445 + ["B-X"] + ["I-X"] * 254
    assert windows.greedy_windows([1] * 700, labels)[0] == (0, 445)


def test_merge_takes_the_first_window(spark):
    rows = [(1, 6, 0, 0, ["a", "a", "a"]), (1, 6, 1, 2, ["b", "b"]), (1, 6, 2, 5, ["c", "c", "c"]), (2, 2, 0, 0, ["z"])]
    df = spark.createDataFrame(rows, "id int, n int, window_idx int, start int, labels array<string>")
    got = {r.id: r.label for r in windows.merge(df, "id", F.col("n")).collect()}
    assert got == {1: ["a", "a", "a", "b", "O", "c"], 2: ["z", "O"]}


def test_subwords(spark):
    df = spark.createDataFrame([([[1, 2], [], [3]], ["B-X", "O", "??"], [5, 6, 7, 8, 9], [0, 0, -1, 1, None])], "s array<array<int>>, l array<string>, v array<int>, w array<int>")
    ids = F.create_map(F.lit("O"), F.lit(0), F.lit("B-X"), F.lit(1))
    f = df.select(windows.align(F.col("s"), F.col("l"), ids, 6, 101, 102).alias("f"), windows.align(F.col("s"), F.col("l"), ids, 5, 101, 102).alias("short")).first()
    assert [tuple(x)[:3] for x in f.f] == [(101, -100, -1), (1, 1, 0), (2, -100, 0), (100, 0, 1), (3, 0, 2), (102, -100, -1)]
    assert [x.token for x in f.short] == [-1, 0, 0, 1, -1]
    r = df.select(windows.first_subwords(F.col("v"), F.col("w")).alias("a"), windows.masked(F.col("v"), F.array(*map(F.lit, [1, 0, 1, 1, 0])), F.array(*map(F.lit, [1, 1, 0, 1, 1]))).alias("b")).first()
    assert r.a == [5, 8] and r.b == [5, 8]


def test_offsets(spark):
    df = spark.createDataFrame([("Ele votou. Ele saiu", ["Ele", "VOTOU", "falta", ".", "ele", "saiu"])], "x string, t array<string>")
    got = df.select(align.offsets(F.col("x"), F.col("t")).alias("o")).first().o
    assert got == [0, 4, None, 9, 11, 15]
    p = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(s).alias("start"), F.lit(s + 1).alias("end")) for l, s in (("A", 2), ("B", 7), ("C", 9), ("D", 9), ("E", 18), ("F", -1))])  # noqa: E741
    labels = df.select(align.labels_by_offset(align.offsets(F.col("x"), F.col("t")), p).alias("l")).first().l
    assert labels == ["A", "A", "O", "C", "C", "O"]


def test_long_forms_of_offsets_and_nearest_labels(spark):
    rng = random.Random(11)
    data = []
    for k in range(40):
        words = [rng.choice(["Ele", "votou", "a", "favor", "Ação", "."]) for _ in range(rng.randrange(0, 30))]
        data.append((k, " ".join(words), [w.upper() if rng.random() < 0.3 else rng.choice([w, "falta"]) for w in words], [(f"L{i}", rng.choice([None, -1, *range(120)]), rng.choice([None, -1, 5, 9])) for i in range(rng.randrange(12))]))
    data += [(100, None, ["a"], []), (101, "a", None, []), (102, "", [], [])]
    df = spark.createDataFrame(data, "id int, text string, tokens array<string>, preds array<struct<label:string,start:int,end:int>>")
    rows = align.locate(df).withColumn("want", align.offsets(F.col("text"), F.col("tokens"))).withColumn("labels", align.labels_by_offset(F.col("starts"), F.col("preds")))
    got = rows.collect()
    assert all(r.starts == r.want for r in got if r.id < 100) and {r.id: r.starts for r in got if r.id >= 100} == {100: None, 101: None, 102: []}
    tokens = rows.filter("id < 100").select("id", F.posexplode("starts").alias("pos", "start"))
    preds = df.select("id", F.posexplode("preds").alias("k", "p")).select("id", "k", "p.*")
    near = {(r.id, r.pos): r.label for r in align.nearest_rows(tokens, preds).collect()}
    assert near == {(r.id, i): x for r in got if r.id < 100 for i, x in enumerate(r.labels)} and len(set(near.values())) > 5


def test_batches_are_filled_to_their_longest(spark):
    data = [(k, [1] * (k % 7), None if k == 5 else [2] * (k % 7)) for k in range(20)]
    df = spark.createDataFrame(data, "id int, ids array<int>, labels array<int>").coalesce(1)
    got = windows.collate(df, {"ids": 0, "labels": -100}, 8).orderBy("id").collect()
    assert [r.batch for r in got] == [k // 8 for k in range(20)] and [r.longest for r in got] == [6] * 16 + [5] * 4
    assert all(len(r.ids) == r.longest and r.ids == [1] * (r.id % 7) + [0] * (r.longest - r.id % 7) for r in got)
    assert got[5].labels is None and got[1].labels == [2] + [-100] * 5
    assert windows.collate(df.filter("id > 90"), {"ids": 0}).count() == 0


# text


def test_characters(spark):
    df = spark.createDataFrame([("", "•"), ("a\x07b", "ab"), ("\n", ""), ("  ", ""), ("a\tb", "a\tb"), ("\x85x\x7f", "x")], "a string, want string")
    assert all(r.c == r.want for r in df.select("want", T.clean(F.col("a")).alias("c")).collect())
    bad = spark.createDataFrame([("",), ("  ",), ("a\x01",), ("",), ("ok",), (None,)], "a string").select(T.is_problematic(F.col("a")).alias("b")).collect()
    assert [r.b for r in bad] == [True, True, True, True, False, True]
    n = spark.createDataFrame([("  Uma  CASA \n",)], "a string").select(T.normal(F.col("a")).alias("n"), T.strict(F.col("a")).alias("s")).first()
    assert n.n == "uma casa"


def test_word_features(spark):
    words = ["Câmara", "n.º", "2023", "x²", "MAIÚSC", "d'Água-", "", "Ação"]
    rows = features.featurise(spark.createDataFrame([(1, words)], "id int, tokens array<string>"), "id", {"verb": ["ação"]}, ["dr."], {"article": ["a"]}).orderBy("pos").collect()
    assert [r.word_shape for r in rows] == ["Xxxxxx", "x.x", "9999", "x9", "XXXXXX", "x'Xxxx-", "", "Xxxx"]
    assert [r.short_shape for r in rows][:3] == ["Xx", "x.x", "9"]
    for r, w in zip(rows, words, strict=True):
        assert (r.is_upper, r.is_title, r.is_digit, r.is_alpha) == (w.isupper(), w.istitle(), w.isdigit(), w.isalpha())
        assert (r.has_hyphen, r.has_apostrophe, r.starts_with_upper) == ("-" in w, "'" in w, w[:1].isupper())
        assert r.num_lowercase == sum(c.islower() for c in w) and r.prefix_3 == (w.lower()[:3] if len(w) > 2 else None)
    assert rows[7]["ends_with_ção"] and rows[7].is_verb and rows[7].is_voting_related and rows[6].is_punct
    assert rows[0]["ctx-1_word"] == "<PAD>" and rows[0]["ctx+1_word"] == "n.º" and rows[0].bigram_prev is None and rows[0].trigram_next == "câmara_n.º_2023"
    assert [r.relative_position for r in rows][:2] == [0.0, 0.125] and rows[7].is_last


def test_feature_array_is_the_exploded_form(spark):
    df = spark.createDataFrame([(1, ["Câmara", "2023", "d'Água-"]), (2, ["x"]), (3, []), (4, None), (5, [None, "a"])], "id int, tokens array<string>")
    options = {"lexicon": {"verb": ["x"]}, "titles": ["dr."], "function_words": {"article": ["a"]}}
    rows = df.select("id", features.feature_array(**options).alias("fs"))
    assert {r.id: r.fs for r in rows.filter("id IN (3, 4)").collect()} == {3: [], 4: None}
    want = features.featurise(df, "id", **options)
    assert sorted(map(repr, rows.select("id", F.inline("fs")).select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    few = df.select(features.feature_array(only=("is_first", "ctx+1_word")).alias("fs")).select(F.inline("fs"))
    assert few.columns == ["pos", "word", "is_first", "ctx+1_word"]


def test_vocabularies(spark):
    words = spark.createDataFrame([(0, 0, "B"), (0, 1, "a"), (1, 0, "b"), (1, 1, "A"), (1, 2, "c")], "doc_id long, pos int, word string")
    assert [tuple(r) for r in stats.word_vocabulary(words).orderBy("word_id").collect()] == [("b", 2, 2), ("a", 2, 3)]
    assert [r.word for r in stats.word_vocabulary(words, 3).collect()] == ["b"]
    vectors = spark.createDataFrame([("b", [1.0, 2.0])], "word string, vector array<double>")
    m = {r.word_id: r.vector for r in stats.embedding_matrix(stats.word_vocabulary(words), vectors, 2).collect()}
    assert m[2] == [1.0, 2.0] and all(abs(x) <= 0.1 for x in m[3])
    assert tuple(stats.oov(words, vectors).first()) == (5, 3, 40.0)
    h = spark.createDataFrame([("r", e, s) for e, s in enumerate([0.1, 0.5, 0.5, 0.4, 0.3, 0.9])], "run string, epoch long, score double")
    assert tuple(stats.best_epochs(h).first()) == ("r", 0.5, 1, 4)


# taggers and extraction


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    for _ in range(20):
        e, t, s = rng.standard_normal((5, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
        value = lambda p: s[p[0]] + e[range(5), p].sum() + sum(t[a, b] for a, b in itertools.pairwise(p))  # noqa: E731,B023
        assert list(max(itertools.product(range(3), repeat=5), key=lambda p: value(list(p)))) == scoring.viterbi(e, t, s)
    assert scoring.viterbi(np.zeros((0, 3)), np.zeros((3, 3)), np.zeros(3)) == []


def test_tagger_learns_and_is_stored(spark, tmp_path):
    rng = random.Random(1)
    data = []
    for _ in range(60):
        t = [rng.choice(["a", "b", "Voto", "sim", "nada"]) for _ in range(8)]
        data.append((t, ["B-V" if w == "Voto" else "I-V" if w == "sim" and i and t[i - 1] == "Voto" else "O" for i, w in enumerate(t)]))
    tagger = scoring.Tagger(["O", "B-V", "I-V"]).train(data, 8)
    scoring.save(tagger, spark, str(tmp_path / "m"))
    again = scoring.load(spark, str(tmp_path / "m"))
    df = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(data)], "id int, tokens array<string>, gold array<string>")
    got = scoring.score("tagger", df, tagger=again).collect()
    assert sum(a == b for r in got for a, b in zip(r.gold, r.pred_labels, strict=True)) >= 0.98 * 480
    assert scoring.score("outside", df).first().pred_labels == ["O"] * 8
    with pytest.raises(ValueError):
        scoring.score("nothing", df)


def test_taggers_score_words_in_their_places():
    rng = np.random.default_rng(3)
    tagger = scoring.Tagger(["O", "B-V", "I-V"])
    segments = [["A", "b", "c"], [], None, ["b"], ["c", "c", "A", "x", None]]
    plain = [[w or "" for w in s or []] for s in segments]
    for f in {f for s in plain for i in range(len(s)) for f in scoring.Tagger.features(s, i)}:
        tagger.weights[f] = rng.standard_normal(3)
    tagger.transition, tagger.start = rng.standard_normal((3, 3)), rng.standard_normal(3)
    words = scoring.Words(pa.array([["out"], *segments], pa.list_(pa.string()))[1:])
    want = [[sum(tagger.weights[f] for f in scoring.Tagger.features(s, i)) for i in range(len(s))] for s in plain]
    assert np.allclose(tagger.emission(words), [e for s in want for e in s])
    assert tagger.predict_all(words).tolist() == [k for s in want if s for k in scoring.viterbi(np.array(s), tagger.transition, tagger.start)]


def test_crf_likelihood_and_gradient_against_all_paths():
    rng = np.random.default_rng(5)
    model = crf.Crf(["O", "B-V", "I-V"], 4)
    model.values[:] = rng.standard_normal(len(model.values))
    segments = [["a", "b", "c", "a"], [], ["b"], ["c", "A"]]
    words, gold = scoring.Words(pa.array(segments, pa.list_(pa.string()))), np.array([0, 1, 2, 0, 1, 1, 2])
    emission, want, at = model.emission(words), 0.0, 0
    for s in segments:
        if s:
            n, e = len(s), emission[at : at + len(s)]
            value = lambda p: model.start[p[0]] + sum(e[i, p[i]] for i in range(n)) + sum(model.transition[a, b] for a, b in itertools.pairwise(p))  # noqa: E731,B023
            want += np.log(sum(np.exp(value(p)) for p in itertools.product(range(3), repeat=n))) - value(gold[at : at + n])
            at += n
    slope = np.zeros_like(model.values)
    assert np.isclose(crf.loss(model, words, gold, slope), want)
    for k in range(len(slope)):
        ahead, behind = model.values.copy(), model.values.copy()
        ahead[k] += 1e-5
        behind[k] -= 1e-5
        up, down = (crf.loss(crf.Crf(model.labels, 4, x), words, gold, np.zeros_like(x)) for x in (ahead, behind))
        assert abs((up - down) / 2e-5 - slope[k]) < 1e-5


def test_minimise_with_a_penalty_on_size():
    rng = np.random.default_rng(7)
    scale, centre = rng.uniform(0.5, 4, 30), rng.normal(0, 0.5, 30)
    got = crf.minimise(lambda x: (float((scale * (x - centre) ** 2).sum() / 2), scale * (x - centre)), np.zeros(30), 0.6, 200, tolerance=1e-14)
    want = np.sign(centre) * np.maximum(np.abs(centre) - 0.6 / scale, 0)
    assert np.allclose(got, want, atol=1e-5) and (got == 0).sum() == (want == 0).sum() > 0


def test_crf_learns_and_is_stored(spark, tmp_path):
    rng, data = random.Random(1), []
    for k in range(60):
        t = [rng.choice(["a", "b", "Voto", "sim", "nada"]) for _ in range(1 + k % 9)]
        data.append((k, t, ["B-V" if w == "Voto" else "I-V" if w == "sim" and i and t[i - 1] == "Voto" else "O" for i, w in enumerate(t)]))
    odd = [(90, None, ["O"]), (91, ["a"], None), (92, ["a", "b"], ["O"]), (93, [], []), (94, ["a"], [None])]
    df = spark.createDataFrame([*data, *odd], "id int, tokens array<string>, gold array<string>")
    model = crf.train(df, labels="gold", rounds=40, bits=10)
    assert model.labels == ["O", "B-V", "I-V"] and 0 < np.count_nonzero(model.weights) < 150
    crf.save(model, spark, str(tmp_path / "m"))
    got = {r.id: r.pred_labels for r in scoring.score("crf", df, model=crf.load(spark, str(tmp_path / "m"))).collect()}
    assert all(got[k] == g for k, _, g in data)
    assert got[90] == [] and got[93] == [] and len(got[92]) == 2
    assert not crf.train(df.filter("id > 900"), labels="gold", bits=6).values.any()
    with pytest.raises(ValueError):
        crf.train(spark.createDataFrame([([str(k) for k in range(300)],) * 2], "tokens array<string>, labels array<string>"))


def test_calls_retry_quota_errors_only(spark):
    def client(text):
        if "parse" in text:
            raise ValueError("bad JSON")
        if "quota" in text:
            raise RuntimeError("429 quota exceeded")
        return '{"has_voting_event": true, "event": {"subject": "s"}}'

    df = spark.createDataFrame([("ok",), ("parse",), ("quota",)], "prompt string")
    got = {r.prompt: r for r in extract.call(df, client, retries=2, wait=0.0).collect()}
    assert got["ok"].error is None and got["parse"].error == "bad JSON" and "quota" in got["quota"].error
    e = spark.createDataFrame([(r.error,) for r in got.values()], "error string").select(extract.is_quota_error(F.col("error")).alias("q"))
    assert sorted(r.q for r in e.collect()) == [False, False, True]
    parsed = spark.createDataFrame([(got["ok"].reply,), ("[1]",), ("{}",), ("x" * 2000,), (None,)], "r string").select(extract.parse_reply(F.col("r")).alias("p")).collect()
    assert [r.p.has_voting_event for r in parsed] == [True, False, False, False, False]
    assert json.loads(parsed[0].p.event) == {"subject": "s"} and parsed[0].p.error is None and len(parsed[3].p.raw_response) == 1000


# files


def test_readers(spark, tmp_path):
    good = {"id": "1", "text": "t", "tokens": ["a", "b"], "labels": ["I-X", "B-X"], "municipality": "m"}
    lines = [json.dumps(good), "", '{"id": "2", "tok', json.dumps({"id": "3", "tokens": ["a"]}), json.dumps({"id": "4", "tokens": ["a"], "labels": []}), json.dumps({"id": "5", "tokens": [], "labels": []})]
    p = tmp_path / "s.jsonl"
    p.write_text("\n".join(lines))
    got = files.segments(spark, str(p)).collect()
    assert [r.id for r in got] == ["1"] and got[0].labels == ["O", "B-X"]
    assert files.labelled(spark, str(p)).count() == 3
    assert files.segments(spark, str(tmp_path / "none.jsonl")).count() == 0
    pred = {"id": "1", "tokens": ["a"], "pred_labels": ["O"]}
    for name, text in (("a.json", json.dumps([pred, pred])), ("b.jsonl", json.dumps(pred) + "\n" + json.dumps(pred)), ("c.jsonl", json.dumps(pred))):
        (tmp_path / name).write_text(text)
        rows = files.predictions(spark, str(tmp_path / name)).collect()
        assert len(rows) == (1 if name[0] == "c" else 2) and rows[0].gold_labels == ["O"]
    (tmp_path / "d.jsonl").write_text('{"id": "1", "tokens": ["a"]}')
    with pytest.raises(Exception, match="missing field"):
        files.predictions(spark, str(tmp_path / "d.jsonl")).collect()
    (tmp_path / "e.json").write_text(json.dumps([{"id": "1", "has_voting_event": False, "event": None}]))
    assert files.events(spark, str(tmp_path / "e.json")).first().has_voting_event is False
    (tmp_path / "f.json").write_text(json.dumps({"examples": [good]}))
    assert files.examples(spark, str(tmp_path / "f.json")).first().tokens == ["a", "b"]
    assert files.first_rows(files.labelled(spark, str(p)), 2).count() == 2


def test_writers_and_config(spark, tmp_path):
    df = spark.createDataFrame([("2", "é"), ("1", "a")], "id string, x string")
    files.write_json(df, str(tmp_path / "j"), "id")
    assert [r.id for r in spark.read.json(str(tmp_path / "j")).orderBy("id").collect()] == ["1", "2"]
    files.write_array(df, str(tmp_path / "a"), "id")
    assert json.loads(spark.read.text(str(tmp_path / "a")).first().value) == [{"id": "1", "x": "a"}, {"id": "2", "x": "é"}]
    (tmp_path / "c.yaml").write_text("training:\n  lr: 5e-5\n  name: x\n  list: [1e-4, 2]\n")
    assert files.config(str(tmp_path / "c.yaml")) == {"training": {"lr": 5e-5, "name": "x", "list": [1e-4, 2]}}
    from spanloom.plans import catalog, synth

    sf = "/root/testdata/sf0.001"
    rows = synth.segments(spark, sf)
    doc = files.metrics_document(metrics.entity_micro(rows), metrics.entity_per_type(rows), metrics.event_summary(catalog._events(spark, sf)), "p.jsonl", "now").first()
    assert doc.metadata.include_events and len(doc.entity_level_metrics.per_type_metrics) == 8 and 0 < doc.event_level_metrics.event_detection_f1 < 1


def test_streams_give_the_same_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [{"id": str(i), "tokens": ["Aprovado", "o", "ponto"], "labels": ["B-VOTING", "O", "B-SUBJECT"]} for i in range(3)] + [{"id": "bad", "tokens": ["x"], "labels": []}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, rows)))
    q = stream.events_of(stream.read(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT * FROM seen").collect()
    assert len(got) == 3 and all(r.event.outcome == "Approved" and r.event.subject == "ponto" for r in got)


# joins by id, windows of any tokenizer, predictions, sinks


def test_pairs_by_id(spark):
    from spanloom.operators import pairing

    schema = "id string, x int, pred int"
    pred = spark.createDataFrame([("a", 1, 0), ("b", 2, 0), ("b", 3, 0), (None, 4, 0), ("d", 5, 0)], schema)
    gold = spark.createDataFrame([("d", 50, 0), ("c", 30, 0), ("b", 20, 0), (None, 40, 0)], schema)
    rows = lambda df: sorted(((r.id, r.pred and r.pred.x, r.gold and r.gold.x) for r in df.collect()), key=str)
    assert rows(pairing.pair(pred, gold)) == [("b", 2, 20), ("b", 3, 20), ("d", 5, 50)]
    full = rows(pairing.pair(pred, gold, how="full"))
    assert full == sorted([("a", 1, None), ("b", 2, 20), ("b", 3, 20), ("c", None, 30), ("d", 5, 50), (None, 4, None), (None, None, 40)], key=str)
    assert sorted(tuple(r) for r in pairing.differences(pred, gold).collect()) == [("a", 1, 0), ("b", 2, 1), ("c", 0, 1)]
    one = pred.filter("id IN ('a', 'd')")
    assert rows(pairing.pair(one, one, how="strict")) == [("a", 1, 1), ("d", 5, 5)]
    for left, right in ((pred.filter("id = 'b'"), gold.filter("id = 'b'")), (one, gold.filter("id = 'd'")), (gold.filter("id = 'd'"), one)):
        with pytest.raises(Exception, match="differ at id"):
            pairing.pair(left, right, how="strict").collect()
    assert pairing.pair(pred.limit(0), gold.limit(0), how="strict").count() == 0
    with pytest.raises(ValueError):
        pairing.pair(pred, gold, how="left")
    assert sorted(r.y or 0 for r in pairing.union(pred, gold.withColumn("y", F.lit(1))).collect()) == [0] * 5 + [1] * 4


def plain_windows(cost, labels, limit=459, overlap=50):
    """The rule step by step, on lists of tokens' costs."""
    if not cost or sum(cost) <= limit:
        return [(0, len(cost))] if cost else []
    out, at = [], 0
    while at < len(cost):
        size = min(limit // 2, len(cost) - at)
        while sum(cost[at : at + size]) < limit and at + size < len(cost):
            wider = min(size + 10, len(cost) - at)
            if sum(cost[at : at + wider]) > limit:
                break
            size = wider
        tries = 0
        while sum(cost[at : at + size]) > limit and size > 1 and tries < 50:
            size, tries = max(1, int(size * 0.9)), tries + 1
        if sum(cost[at : at + size]) > limit:
            size = 1
        if sum(cost[at : at + size]) > limit:
            at += 1
            continue
        if at + size < len(cost) and size > overlap:
            tail = [i for i in range(max(0, size - 20) + 1, size) if labels[at + i] == "O"]
            size = tail[-1] + 1 if tail else size
        out.append((at, at + size))
        if at + size >= len(cost) or len(out) > 100:
            break
        at += max(size - overlap, 1)
    return out


def test_greedy_windows_against_plain():
    rng = random.Random(11)
    for k in range(400):
        n = rng.choice([1, 30, 200, 230, 459, 460, 600, 1500])
        cost = [rng.choice([[1], [1, 2, 3], [1, 1, 1, 400], [0, 1, 2], [500, 1], [3, 9, 40]][k % 6]) for _ in range(n)]
        labels = [rng.choice(["O", "B-X", "I-X"] if k % 2 else ["B-X"] * 30 + ["O"]) for _ in range(n)]
        assert windows.greedy_windows(cost, labels) == plain_windows(cost, labels)
    assert len(windows.greedy_windows([1] * 60_000, None)) == 101
    assert windows.greedy_windows([1] * 60_000, None, most=None)[-1][1] == 60_000


def test_repair_of_nulls_and_long_labels(spark):
    tags = [None, "B-X", "I-X", None, "I-X", "O"]
    df = spark.createDataFrame([(tags,), ([],), (["B-X"] + ["I-X"] * 5000,), (None,)], "t array<string>")
    got = [r.r for r in df.select(bio.repair(F.col("t")).alias("r")).collect()]
    assert got[0] == ["O", "B-X", "I-X", "O", "O", "O"] and got[1] == [] and got[2] == ["B-X"] + ["I-X"] * 5000 and got[3] is None


def test_predictions_of_windows_keep_their_places(spark):
    tokens = [f"t{k}" if k % 7 else " " for k in range(1000)]
    df = spark.createDataFrame([(1, tokens), (2, []), (3, ["a"]), (4, None), (5, [" ", "\u0001"])], "id int, tokens array<string>")
    short = lambda rows: rows.withColumn("pred_labels", F.slice(F.transform("tokens", lambda t: F.concat(F.lit("L"), t)), 1, F.greatest(F.lit(0), F.size("tokens") - 1)))
    whole = lambda rows: rows.withColumn("pred_labels", F.transform("tokens", lambda t: F.concat(F.lit("L"), t)))
    got = {r.id: r.labels for r in windows.predict(df, whole, "id").collect()}
    assert got == {1: ["O" if t == " " else "L" + t for t in tokens], 2: [], 3: ["La"], 4: [], 5: ["O", "O"]}
    got = {r.id: r.labels for r in windows.predict(df, short, "id").collect()}  # a scorer that forgets the last label
    assert got[3] == ["O"] and len(got[1]) == 1000 and got[1][-1] == "O" and got[1][:400] == ["O" if t == " " else "L" + t for t in tokens[:400]]


def test_window_names(spark):
    df = spark.createDataFrame([("a", ["x"] * 500), ("b", ["x"])], "id string, tokens array<string>")
    assert sorted(r.window_id for r in windows.named_windows(df).collect()) == ["a_w0", "a_w1", "b"]


def test_prompts_of_both_forms(spark):
    one = spark.range(1).select(extract.prompt(F.lit("T"), "S", [("  a  ", "{}"), ("b" * 9, "{}")], most=5).alias("p")).first().p
    parts = ["S", "\n\n# Examples\n", "\n## Example 1\n", "Input: a\n", "Output: {}\n", "\n## Example 2\n", "Input: bbbbb...\n", "Output: {}\n", "\n\n# Your Task\n", "Extract the voting event from the following text and return ONLY the JSON object:\n\n"]
    assert one == "\n".join(parts) + "\nInput: T\n\n\nOutput:"
    assert spark.range(1).select(extract.prompt(F.lit("T"), "S").alias("p")).first().p == "\n".join(["S", *parts[-2:]]) + "\nInput: T\n\n\nOutput:"
    other = extract.example_prompt("S", [("a", "{}")])
    assert "Input:**\na...\n" in other and other.endswith("as specified.\n")


def test_characters_and_clamps(spark):
    vocab = F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3))
    df = spark.createDataFrame([(["aBc", "", "ab" * 20], [-100, -5, 3, 99])], "w array<string>, l array<int>")
    r = df.select(T.char_ids(F.col("w"), vocab, 4).alias("c"), T.clamp(F.col("l"), 9).alias("l")).first()
    assert r.c == [[2, 3, 1, 0], [0] * 4, [2, 3, 2, 3]] and r.l == [0, 0, 3, 8]


def test_evaluation_from_files_and_sinks(spark, tmp_path):
    from spanloom.plans import evaluate

    rows = [{"id": "1", "tokens": ["approved", "by", "all"], "pred_labels": ["B-VOTING", "O", "B-SUBJECT"], "gold_labels": ["B-VOTING", "O", "O"]}, {"id": "2", "tokens": ["x"], "pred_labels": ["O"]}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    got = evaluate.evaluate(spark, str(tmp_path / "p.json"), str(tmp_path / "out")).first()
    assert got.metadata.num_examples == 2 and got.entity_level_metrics.precision == 0.5 and got.event_level_metrics.event_detection_f1 == 1.0
    assert json.loads(next((tmp_path / "out").glob("*.json")).read_text())["entity_level_metrics"]["recall"] == 1.0
    assert evaluate.evaluate(spark, str(tmp_path / "p.json"), include_events=False).first().event_level_metrics.subject_f1 is None
    results = spark.createDataFrame([("1", True), ("2", False)], "id string, has_voting_event boolean")
    files.write_extraction(results, spark.range(1).selectExpr("0.5D AS precision", "3 AS correct"), str(tmp_path / "llm"), "stub", "now")
    assert json.loads((tmp_path / "llm/evaluation_results_events.json").read_text())["metadata"]["total_documents"] == 2
    assert "| precision | 0.5000 |" in (tmp_path / "llm/evaluation_summary_events.md").read_text()
    assert spark.read.json(str(tmp_path / "llm/predictions_events.jsonl")).count() == 2
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "word string, word_id long")
    files.write_vocabulary(vocab, str(tmp_path / "v"))
    assert files.read_vocabulary(spark, str(tmp_path / "v")).count() == 2
    files.write_vocabulary(vocab.union(vocab), str(tmp_path / "v2"))
    with pytest.raises(ValueError):
        files.read_vocabulary(spark, str(tmp_path / "v2"))
    assert files.extraction_config("S", str(tmp_path / "none.json"))["examples"] == [] and str(files.config_path("/r", "crf")) == "/r/configs/main_experiment/crf.yaml"


def test_scorer_follows_from_the_stored_model(spark, tmp_path):
    rows = [(k, ["a", "b", "c"][: 1 + k % 3], ["O", "B-V", "I-V"][: 1 + k % 3]) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>, labels array<string>")
    model = crf.train(df, rounds=20, bits=8)
    crf.save(model, spark, str(tmp_path / "c"))
    tagger = scoring.Tagger(["O", "B-V", "I-V"]).train([(t, x) for _, t, x in rows], 8)
    scoring.save(tagger, spark, str(tmp_path / "t"))
    for path, name in (("c", "crf"), ("t", "tagger")):
        assert scoring.stored(spark, str(tmp_path / path))[0] == name
        got = scoring.score_stored(df, str(tmp_path / path))
        assert all(r.pred_labels == r.labels for r in got.collect())


def test_corpus_windowing_and_its_rate(spark):
    df = spark.createDataFrame([("a", ["x"] * 1000), ("b", ["y"] * 10), ("c", [])], "id string, tokens array<string>")
    out, counts = windows.corpus(df)
    assert sorted(r.window_id for r in out.collect()) == ["a_w0", "a_w1", "a_w2", "b"]
    assert tuple(counts.first()) == (3, 4, 1, 1, 1.333333)
    out, counts = windows.corpus(df, enabled=False)
    assert sorted((r.window_id, len(r.tokens)) for r in out.collect()) == [("a", 1000), ("b", 10), ("c", 0)] and tuple(counts.first()) == (3, 3, 3, 0, 1.0)


def test_spans_of_a_very_long_segment(spark):
    n = 200_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i % 4 == 0, "B-X").when(i % 4 == 3, "O").otherwise("I-X")).alias("labels"))
    got = df.select(bio.spans(F.col("labels")).alias("s")).select(F.size("s").alias("n"), F.element_at("s", -1).alias("last")).first()
    assert (got.n, tuple(got.last)) == (n // 4, ("X", n - 4, n - 1))
