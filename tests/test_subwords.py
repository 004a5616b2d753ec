"""Merges by rank against the public library that the vocabulary comes with."""

import base64

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import subwords, windows

tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_distinct_word(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = [r.w for r in docs.select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct().collect()]
    words = [f" {w}" for w in words] + words[:500] + ["", " ", "a" * 3000, "ab" * 700, "don't", "naïve—東京 3rd", "\n\n  x", "\x00\x7f", "😀😀", " <|endoftext|>"]
    got = subwords.ranks(PATH).encode(words)
    want = library.encode_ordinary_batch(words)
    assert len(words) > 10_000 and got == want


def test_columns(spark, library):
    rows = [(1, ["Um", "voto", "unânime", "", None, "voto"]), (2, []), (3, None), (4, ["x"])]
    got = {r.id: r.subwords for r in subwords.tokenize(spark.createDataFrame(rows, "id long, tokens array<string>"), PATH).collect()}
    one = lambda w: library.encode_ordinary(f" {w}") if w else []
    assert got == {i: None if t is None else [one(w) for w in t] for i, t in rows}


def test_windows_and_alignment_use_it(spark, library):
    toks = [f"palavra{k % 97}" for k in range(900)]
    df = spark.createDataFrame([(1, toks, ["O"] * 900)], "id long, tokens array<string>, labels array<string>")
    got = subwords.windowed(df, PATH, labels="labels", most=None).first().windows
    cost = [len(library.encode_ordinary(f" {t}")) for t in toks]
    assert [(w.start, w.end) for w in got] == windows.greedy_windows(cost, ["O"] * 900, most=None) and len(got) > 3
    ids = F.create_map(F.lit("O"), F.lit(0))
    short = df.select("id", F.slice("tokens", 1, 5).alias("tokens"), F.slice("labels", 1, 5).alias("labels"))
    aligned = subwords.tokenize(short, PATH).select(windows.align(F.col("subwords"), F.col("labels"), ids, 512, 1, 2).alias("a")).first().a
    want = [i for t in toks[:5] for i in library.encode_ordinary(f" {t}")]
    assert [x.input_id for x in aligned[1:-1]] == want and sum(x.first for x in aligned) == 5
