"""Language identification by unigram piece models that sum over all segmentations of a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from spanloom.llm import hashing
from spanloom.llm.decontam import LETTERS
from spanloom.llm.shared import least, ship

#: Most documents of a language that a model is fitted on, most distinct words of all of them, and most languages.
SAMPLE, SAMPLE_WORDS, LANGUAGES = 2000, 1_000_000, 200
#: Bytes up to which a word is summed at once, with the space before it, and of the runs that longer ones are summed in.
WHOLE, RUN = 40, 16
#: Words whose scores a task remembers. Others are scored again when they come again.
MEMORY = 1_500_000


class Pieces:
    """A trie of a public tokenizer's pieces that are letters in lower case, and of all single bytes.

    A space stands for the start of a word. State 0 is no piece's beginning, state 1 the root.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i)}
        words = {p.replace("▁", " ").encode() for p in every if p == p.lower() and p.count("▁") == p.startswith("▁") and p.replace("▁", "").isalnum()}
        pieces = sorted(words | {bytes([b]) for b in range(256)})
        self.longest = max(map(len, pieces))
        self.count = len(pieces)
        used = sorted({b for p in pieces if len(p) > 1 for b in p})
        self.code = np.zeros(256, np.int16)  # bytes that are in no longer piece share code 0
        self.code[used] = np.arange(1, len(used) + 1)
        nodes: dict[bytes, int] = {}
        for p in pieces:
            if len(p) > 1:
                for k in range(1, len(p) + 1):
                    nodes.setdefault(p[:k], len(nodes) + 2)
        self.next = np.zeros((len(nodes) + 2, len(used) + 1), np.int32)
        self.piece = np.full(len(nodes) + 2, -1, np.int32)
        for p, k in nodes.items():
            self.next[nodes[p[:-1]] if len(p) > 1 else 1, self.code[p[-1]]] = k
        for k, p in enumerate(pieces):
            if p in nodes and len(p) > 1:
                self.piece[nodes[p]] = k
        self.single = np.zeros(256, np.int32)
        for k, p in enumerate(pieces):
            if len(p) == 1:
                self.single[p[0]] = k


def _steps(pieces: Pieces, b: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Every piece in every word: start, end, rows of b and piece numbers; starts in ascending order."""
    for s in range(b.shape[1]):
        rows = np.flatnonzero(size > s)
        yield s, s + 1, rows, pieces.single[b[rows, s]]
        state = pieces.next[1, pieces.code[b[rows, s]]]
        for e in range(s + 1, min(s + pieces.longest, b.shape[1])):
            live = (state > 0) & (size[rows] > e)
            rows, state = rows[live], state[live]
            if not len(rows):
                break
            state = pieces.next[state, pieces.code[b[rows, e]]]
            whole = pieces.piece[state]
            got = whole >= 0
            if got.any():
                yield s, e + 1, rows[got], whole[got]


def forward(pieces: Pieces, prob: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """alpha[word, t, language]: the summed probability of all segmentations of the first t bytes."""
    alpha = np.zeros((len(b), b.shape[1] + 1, prob.shape[1]))
    alpha[:, 0] = 1.0
    for s, e, rows, ids in _steps(pieces, b, size):
        alpha[rows, e] += alpha[rows, s] * prob[ids]
    return alpha


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(w) for w in words])
    width = int(size.max())
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width), size


def _long(pieces: Pieces, prob: np.ndarray, word: bytes) -> np.ndarray:
    """Log probability of one long word in each language, the sum over all its segmentations.

    The forward sums of the last places before a cut, as many as the longest piece has bytes, tell all that comes after. So
    each run of the word is a linear map from those before it to those at its end: the maps of many runs are taken side
    by side, from one unit sum for each place, and then applied in order.
    """
    deep, langs = pieces.longest, prob.shape[1]
    cuts = list(range(0, len(word), RUN))
    state, scale = np.zeros((deep, langs)), np.zeros(langs)
    state[-1] = 1.0  # state[i]: the forward sum deep - 1 - i places before the cut
    filled = b"\0" * (deep - 1) + word
    for a in range(0, len(cuts), 256):
        some = cuts[a : a + 256]
        parts = [filled[c : c + deep - 1 + RUN] for c in some]
        b, size = padded(parts)
        grid = np.zeros((len(parts), b.shape[1] + 1, deep, langs))
        grid[:, np.arange(deep), np.arange(deep)] = 1.0
        for s, e, rows, ids in _steps(pieces, b, size):
            if e >= deep:
                grid[rows, e] += grid[rows, s] * prob[ids][:, None, :]
        for k, n in enumerate(size.tolist()):
            state = np.einsum("oil,il->ol", grid[k, n - deep + 1 : n + 1], state)
            top = state.max(axis=0)
            state, scale = state / top, scale + np.log(top)
    return np.log(state[-1]) + scale


def scores(pieces: Pieces, prob: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log probability of each word in each language, summed over all segmentations."""
    words = [b" " + w for w in words]
    out = np.zeros((len(words), prob.shape[1]))
    size = np.array([len(w) for w in words], np.int64)
    order = np.flatnonzero(size <= WHOLE)
    order = order[np.argsort(size[order], kind="stable")]
    for a in range(0, len(order), 8192):
        own = order[a : a + 8192]
        b, n = padded([words[i] for i in own])
        out[own] = np.log(forward(pieces, prob, b, n)[np.arange(len(own)), n])
    for i in np.flatnonzero(size > WHOLE).tolist():
        out[i] = _long(pieces, prob, words[i])
    return out


def cut_long(word: bytes) -> list[bytes]:
    """A word with the space before it, in parts of up to WHOLE bytes that end with a whole letter."""
    word, out, at = b" " + word, [], 0
    while len(word) - at > WHOLE:
        to = at + WHOLE
        while to > at + WHOLE - 4 and word[to] & 0xC0 == 0x80:
            to -= 1
        out.append(word[at:to])
        at = to
    return [*out, word[at:]]


def fit_one(pieces: Pieces, words: list[bytes], counts: np.ndarray, rounds: int = 4, smooth: float = 0.05) -> np.ndarray:
    """Piece probabilities of one language by expectation maximisation over all segmentations of words, or of parts of words
    as cut_long() gives them, with the space where one stands."""
    parts = list(zip(words, counts.tolist(), strict=True))
    parts.sort(key=lambda x: len(x[0]))
    batches = [(padded([p for p, _ in parts[a : a + 8192]]), np.array([c for _, c in parts[a : a + 8192]], float)) for a in range(0, len(parts), 8192)]
    prob = np.full((pieces.count, 1), 1.0 / pieces.count)
    for _ in range(rounds):
        expected = np.full(pieces.count, smooth)
        for (b, size), c in batches:
            alpha = forward(pieces, prob, b, size)[:, :, 0]
            total = alpha[np.arange(len(b)), size]
            beta = np.zeros_like(alpha)
            beta[np.arange(len(b)), size] = 1.0
            for s, e, rows, ids in sorted(_steps(pieces, b, size), key=lambda x: -x[0]):
                here = prob[ids, 0] * beta[rows, e]
                beta[rows, s] += here
                np.add.at(expected, ids, c[rows] * alpha[rows, s] * here / total[rows])
        prob = (expected / expected.sum())[:, None]
    return prob[:, 0]


def _spelled(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    return hashing.spans(pc.utf8_lower(column), LETTERS, hashing.SAME)


def fit(docs: DataFrame, path: str, sample: int = SAMPLE, most_words: int = SAMPLE_WORDS, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """The languages of docs (text, lang) and their piece probabilities.

    A model is fitted on the words of at most `sample` documents of each language, those with the least hash of
    text and doc_id, and on the most frequent of their distinct words, an equal share of `most_words` for each language;
    so the words that reach the driver are bounded however many languages there are. Of more than `languages` values
    of lang the most frequent are learned. Longer words, as in scripts without spaces, are learned from in parts of up to WHOLE
    bytes, so what the driver reads is bounded in bytes, too (40 MB by default). Null texts and languages are left
    out; long texts are read whole; equal rows count once; an empty table learns no language.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = [F.col("doc_id")] if "doc_id" in docs.columns else []
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), *ids).filter("lang IS NOT NULL AND text IS NOT NULL")
    known = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()]
    rows = rows.filter(F.col("lang").isin(known))
    chosen = least(rows, "lang", ["text", *(["doc_id"] if "doc_id" in rows.columns else [])], sample).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, got = batch.column(0).to_pylist(), {}
            for row, b, _, starts, ends, bounds in _spelled(batch.column(1)):
                raw = b.tobytes()
                for i in range(len(bounds) - 1):
                    for k in range(bounds[i], bounds[i + 1]):
                        for part in cut_long(raw[starts[k] : ends[k]]):
                            key = (langs[row + i], part)
                            got[key] = got.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.binary()), pa.array(list(got.values()), pa.int64())], schema=schema)

    counts = chosen.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    most = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = counts.withColumn("__r", F.row_number().over(most)).filter(F.col("__r") <= max(most_words // max(len(known), 1), 1)).select("lang", "word", "n").toPandas()
    pieces, langs, probs = Pieces(path), sorted(words["lang"].unique()), []
    for lang in langs:
        own = words[words["lang"] == lang].sort_values("word")
        probs.append(fit_one(pieces, [bytes(w) for w in own["word"]], own["n"].to_numpy()))
    return langs, np.stack(probs, axis=1) if probs else np.zeros((pieces.count, 0))


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, path: str, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score, the share of the predicted language in the texts' probability.

    Both replace columns of the same names; keep names the columns of docs to return, all by default. A text that
    is null or has no letter is `und` with score 0, as is every text if no language was learned. Ties go to the
    first language by code point. Long texts and words are read whole; equal texts get equal results; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast((Pieces(path), prob))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rest = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    names = [*kept, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, p = held.value
        memory: dict[int, int] = {}
        known, size = np.zeros((1024, len(langs))), 0
        for batch in batches:
            *columns, text = batch.columns
            total = np.zeros((batch.num_rows, len(langs)))
            for row, b, h, starts, ends, bounds in _spelled(text) if langs else ():
                found, at, which = np.unique(h, return_index=True, return_inverse=True)
                keys = found.tolist()
                slot = np.array([memory.get(k, -1) for k in keys], np.int64)
                new = np.flatnonzero(slot < 0)
                if len(new):
                    if size + len(new) > MEMORY:
                        memory.clear()
                        size, new = 0, np.arange(len(keys))
                    raw = b.tobytes()
                    fresh = scores(pieces, p, [raw[starts[i] : ends[i]] for i in at[new]])
                    while len(known) < size + len(new):
                        known = np.concatenate([known, np.zeros_like(known)])
                    known[size : size + len(new)] = fresh
                    slot[new] = np.arange(size, size + len(new))
                    memory.update(zip(found[new].tolist(), slot[new].tolist(), strict=True))
                    size += len(new)
                each = known[slot][which]
                owner = np.repeat(np.arange(row, row + len(bounds) - 1), np.diff(bounds))
                for k in range(len(langs)):
                    total[:, k] += np.bincount(owner, each[:, k], minlength=batch.num_rows)
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool)
            if langs:
                best = total.argmax(1)
                share = 1 / np.exp(np.clip(total - total.max(1, keepdims=True), -700, 0)).sum(1)
                said = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters, strict=True)]
            else:
                said, share = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string()), pa.array(np.where(letters, share, 0.0), pa.float64())], names=names)

    schema = StructType([*rest.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rest.mapInArrow(run, schema)
