"""Taggers: a linear-chain decoder over batches, a perceptron, and a registry of scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import bio

#: name -> factory(rows, **options) -> DataFrame with pred_labels
SCORERS: dict[str, Callable[..., DataFrame]] = {}


def scorer(name: str):
    def add(f):
        SCORERS[name] = f
        return f

    return add


def score(name: str, rows: DataFrame, **options) -> DataFrame:
    if name not in SCORERS:
        raise ValueError(f"unknown scorer {name!r}; there are {sorted(SCORERS)}")
    return SCORERS[name](rows, **options)


def paths(emission: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best path of labels of each of some segments of one size; ties go to the lower label."""
    many, size, labels = emission.shape
    best, back = start + emission[:, 0], np.zeros((many, size, labels), np.int16)
    for t in range(1, size):
        steps = best[:, :, None] + transition
        back[:, t] = steps.argmax(1)
        best = steps.max(1) + emission[:, t]
    out = np.empty((many, size), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(size - 1, 0, -1):
        out[:, t - 1] = back[np.arange(many), t, out[:, t]]
    return out


def viterbi(emission: np.ndarray, transition: np.ndarray, start: np.ndarray) -> list[int]:
    """The best path of labels of one segment."""
    return paths(emission[None], transition, start)[0].tolist() if len(emission) else []


def argmax(scores: Column) -> Column:
    """0-based place of the largest entry, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def features(word: str, place: str) -> list[str]:
    """The features that a word gives to its own token, or to the one after (`before` it stands) or ahead of it."""
    low = word.lower()
    if place == "here":
        return [f"w={low}", f"s={low[-3:]}", f"p={low[:3]}", f"u={word[:1].isupper()}"]
    return [f"{place[0]}={low}"]


class Words:
    """The tokens of a batch of segments: each distinct word once, and by number at every token."""

    def __init__(self, column: pa.Array):
        coded = pc.fill_null(column.flatten().cast(pa.string()), "").dictionary_encode()
        self.sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.words = coded.dictionary.to_pylist()
        self.here = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def of(self, place: str) -> list[str]:
        """The words of a place, that of an edge last."""
        return self.words + {"here": [], "before": ["<s>"], "after": ["</s>"]}[place]

    def places(self) -> Iterator[tuple[str, np.ndarray]]:
        """Each place, and for every token the number of the word there."""
        full = self.sizes > 0
        first, last = self.starts[full], (self.starts + self.sizes)[full] - 1
        before, after = np.roll(self.here, 1), np.roll(self.here, -1)
        before[first] = after[last] = len(self.words)
        return iter((("here", self.here), ("before", before), ("after", after)))


class Model:
    """What has labels, weights of label pairs and of first labels, and rows(): the weights that words give at a place."""

    labels: list[str]
    transition: np.ndarray
    start: np.ndarray

    def rows(self, words: list[str], place: str) -> np.ndarray:
        raise NotImplementedError

    def emission(self, words: Words) -> np.ndarray:
        """(token, label) scores of a batch; each distinct word is looked up once."""
        out = np.zeros((len(words.here), len(self.labels)))
        if len(out):
            for place, at in words.places():
                out += self.rows(words.of(place), place)[at]
        return out

    def predict_all(self, words: Words) -> np.ndarray:
        """The label numbers of all tokens of a batch, segments of one size decoded together."""
        emission, out = self.emission(words), np.zeros(len(words.here), np.int64)
        order = np.argsort(words.sizes, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(words.sizes[order])) + 1):
            size = int(words.sizes[group[0]]) if len(group) else 0
            together = max(1, (1 << 16) // max(1, size))
            for k in range(0, len(group) if size else 0, together):
                spots = words.starts[group[k : k + together]][:, None] + np.arange(size)
                out[spots] = paths(emission[spots], self.transition, self.start)
        return out


class Tagger(Model):
    """Weights of token features and label pairs, learned by the averaged perceptron; features are words around."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights: dict[str, np.ndarray] = {}
        self.transition = np.zeros((len(labels), len(labels)))
        self.start = np.zeros(len(labels))

    @staticmethod
    def features(tokens: list[str], i: int) -> list[str]:
        before = tokens[i - 1] if i else "<s>"
        after = tokens[i + 1] if i + 1 < len(tokens) else "</s>"
        return features(tokens[i], "here") + features(before, "before") + features(after, "after")

    def rows(self, words: list[str], place: str) -> np.ndarray:
        none = np.zeros(len(self.labels))
        return np.array([sum((self.weights.get(f, none) for f in features(w, place)), none) for w in words])

    def predict(self, tokens: list[str]) -> list[str]:
        return [self.labels[k] for k in self.predict_all(Words(pa.array([tokens], pa.list_(pa.string()))))]

    def train(self, data: list[tuple[list[str], list[str]]], epochs: int = 5) -> Tagger:
        ids, step = {x: k for k, x in enumerate(self.labels)}, 1
        sums: dict[str, np.ndarray] = {}
        tsum, ssum = np.zeros_like(self.transition), np.zeros_like(self.start)
        for _ in range(epochs):
            for tokens, gold in data:
                want = [ids[x] for x in gold]
                got = self.predict_all(Words(pa.array([tokens], pa.list_(pa.string())))).tolist()
                if got != want:
                    for i, (g, w) in enumerate(zip(got, want, strict=True)):
                        if g != w:
                            for f in self.features(tokens, i):
                                for k, by in ((w, 1.0), (g, -1.0)):
                                    self.weights.setdefault(f, np.zeros(len(self.labels)))[k] += by
                                    sums.setdefault(f, np.zeros(len(self.labels)))[k] += by * step
                        if i:
                            for a, b, by in ((want[i - 1], w, 1.0), (got[i - 1], g, -1.0)):
                                self.transition[a, b] += by
                                tsum[a, b] += by * step
                        else:
                            for k, by in ((w, 1.0), (g, -1.0)):
                                self.start[k] += by
                                ssum[k] += by * step
                step += 1
        for f, s in sums.items():
            self.weights[f] = self.weights[f] - s / step
        self.transition, self.start = self.transition - tsum / step, self.start - ssum / step
        return self

    def table(self) -> list[tuple[str, str, float]]:
        """(feature, label, weight); label pairs and starts have features of their own."""
        out = [(f, x, float(v)) for f, w in self.weights.items() for x, v in zip(self.labels, w, strict=True) if v]
        out += [(f"transition={a}", b, float(self.transition[i, j])) for i, a in enumerate(self.labels) for j, b in enumerate(self.labels)]
        return out + [("start", x, float(v)) for x, v in zip(self.labels, self.start, strict=True)]

    @classmethod
    def of_table(cls, rows: list[tuple[str, str, float]]) -> Tagger:
        out = cls([x for f, x, _ in rows if f == "start"])
        at = {x: k for k, x in enumerate(out.labels)}
        for f, x, v in rows:
            if f == "start":
                out.start[at[x]] = v
            elif f.startswith("transition="):
                out.transition[at[f.removeprefix("transition=")], at[x]] = v
            else:
                out.weights.setdefault(f, np.zeros(len(at)))[at[x]] = v
        return out


def save(tagger: Tagger, spark, path: str) -> None:
    """The weights as a Parquet table."""
    spark.createDataFrame(tagger.table(), "feature string, label string, weight double").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Tagger:
    """A saved tagger; the table of weights is as large as the model."""
    return Tagger.of_table([tuple(r) for r in spark.read.parquet(path).select("feature", "label", "weight").collect()])


def decode(rows: DataFrame, model: Model, tokens: str = "tokens") -> DataFrame:
    """rows with pred_labels, decoded in batches by a model that is broadcast once, and repaired. Null tokens have none."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = [c for c in rows.columns if c != "pred_labels"]
    at = names.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = pa.array(held.value.labels, pa.string())
        for batch in batches:
            words = Words(batch.column(at))
            ends = pa.array(np.append(words.starts, len(words.here)).astype(np.int32))
            got = pa.ListArray.from_arrays(ends, labels.take(pa.array(held.value.predict_all(words))))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*names, "pred_labels"])

    kept = rows.select(*[F.col(f"`{c}`") for c in names])
    out = kept.mapInArrow(run, kept.withColumn("pred_labels", F.lit(None).cast("array<string>")).schema)
    return out.withColumn("pred_labels", bio.repair(F.col("pred_labels")))


@scorer("tagger")
def tag(rows: DataFrame, tagger: Tagger, tokens: str = "tokens") -> DataFrame:
    """rows with pred_labels of a tagger, whose size is that of the features it was trained on."""
    return decode(rows, tagger, tokens)


@scorer("outside")
def outside(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """All tokens outside: a floor for comparisons."""
    return rows.withColumn("pred_labels", F.transform(tokens, lambda _: F.lit("O")))


def stored(spark, path: str) -> tuple[str, Model]:
    """The scorer's name and the model of a table that save() of this module or of crf wrote, told by what the table holds."""
    from spanloom.operators import crf

    kind = "crf" if spark.read.parquet(path).filter("feature = 'bits'").limit(1).count() else "tagger"
    return kind, (crf.load if kind == "crf" else load)(spark, path)


def score_stored(rows: DataFrame, path: str, **options) -> DataFrame:
    """score() by a stored model, whatever its kind."""
    kind, model = stored(rows.sparkSession, path)
    return score(kind, rows, **{"model" if kind == "crf" else "tagger": model}, **options)
