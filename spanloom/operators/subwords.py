"""Subwords of a public byte-level vocabulary: merges by rank over the distinct words of a batch, as steps over arrays."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators import windows

#: Fixed value: how texts are split before merging, as published with the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of like length that are merged together.
GROUP = 1 << 14


class Ranks:
    """A vocabulary of lines `base64 rank`; a token's rank is its id, and of two merges the one to the lower rank comes first."""

    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.split = regex.compile(SPLIT)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.base = max(self.ids.values()) + 1
        pairs: dict[int, int] = {}
        for token, rank in self.ids.items():
            for k in range(1, len(token)):
                left, right = self.ids.get(token[:k]), self.ids.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pairs = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[p] for p in self.pairs.tolist()], np.int64)

    def merged(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece: as long as a pair can be merged, the first of those with the lowest rank is."""
        out: list[list[int]] = [[]] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        while len(order):
            some = order[: max(1, GROUP * 8 // int(size[order[min(GROUP, len(order)) - 1]]))][:GROUP]
            for k, x in zip(some.tolist(), self._group([pieces[k] for k in some.tolist()]), strict=True):
                out[k] = x
            order = order[len(some) :]
        return out

    def _group(self, pieces: list[bytes]) -> list[list[int]]:
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        ids = np.where(np.arange(width) < size[:, None], self.single[raw], -1)
        ranks = self.looked_up(ids[:, :-1], ids[:, 1:])
        live = np.flatnonzero((ranks < self.base).any(axis=1)) if width > 1 else np.zeros(0, np.int64)
        while len(live):
            at = ranks[live].argmin(axis=1)
            ids[live, at] = ranks[live, at]
            # what is behind the merged pair moves up by one
            place = np.arange(width)
            source = np.where(place[None, :] > at[:, None], np.minimum(place + 1, width - 1)[None, :], place[None, :])
            moved = np.take_along_axis(ids[live], source, axis=1)
            moved[:, -1] = -1
            ids[live] = moved
            # only the pairs beside the new token have new ranks
            near = np.take_along_axis(ranks[live], np.minimum(source[:, : width - 1], width - 2), axis=1)
            near[:, -1] = self.base
            rows = np.arange(len(live))
            near[rows, np.minimum(at, width - 2)] = self.looked_up(moved[rows, at], moved[rows, np.minimum(at + 1, width - 1)])
            left = np.maximum(at - 1, 0)
            near[rows, left] = np.where(at > 0, self.looked_up(moved[rows, left], moved[rows, at]), near[rows, left])
            ranks[live] = near
            live = live[(near < self.base).any(axis=1)]
        return [x[x >= 0].tolist() for x in ids]

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; `base` for pairs that are no token, or not there."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pairs[at] == key), self.ranks[at], self.base)

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each word; each distinct piece of all of them is merged once."""
        cut = [[p.encode() for p in self.split.findall(w)] for w in words]
        pieces = list({p for ps in cut for p in ps})
        known = dict(zip(pieces, self.merged(pieces), strict=True))
        return [[i for p in ps for i in known[p]] for ps in cut]


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def tokenize(rows: DataFrame, path: str, tokens: str = "tokens", out: str = "subwords") -> DataFrame:
    """rows with `out`, the ids of the subwords of each token, which has the space before it that it has in a text.

    Each distinct token of a batch is encoded once. Null and empty tokens have no subwords; a null list has a null result.
    """
    names = [c for c in rows.columns if c != out]
    at = names.index(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks(path)
        for batch in batches:
            column = batch.column(at)
            coded = pc.fill_null(column.flatten().cast(pa.string()), "").dictionary_encode()
            found = pa.array(vocabulary.encode([f" {w}" if w else "" for w in coded.dictionary.to_pylist()]), pa.list_(pa.int32()))
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            null = column.is_null().to_numpy(zero_copy_only=False)
            offsets = pa.array(ends, mask=np.append(null, False)) if null.any() else pa.array(ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, found.take(coded.indices))], names=[*names, out])

    kept = rows.select(*[F.col(f"`{c}`") for c in names])
    return kept.mapInArrow(run, kept.withColumn(out, F.lit(None).cast("array<array<int>>")).schema)


def windowed(rows: DataFrame, path: str, tokens: str = "tokens", labels: str | None = None, **how) -> DataFrame:
    """rows with `windows` of a real tokenizer: windows.tokenizer_windows() with the number of each token's subwords."""

    def cost(words: list[str]) -> list[int]:
        own = list(dict.fromkeys(words))
        size = {w: max(1, len(x)) for w, x in zip(own, ranks(path).encode([f" {w}" if w else "" for w in own]), strict=True)}
        return [size[w] for w in words]

    return windows.tokenizer_windows(rows, cost, tokens, labels, **how)
