"""The registered queries themselves, over small whole tables, against plain versions."""

import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__
from spanloom.llm.queries import vocabulary
from spanloom.llm.shared import table
from test_documents import plain_groups, plain_taken, plain_targets
from test_other_tables import plain_vectors
from tests_plain import plain_leaks

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op2_token_files": "doc_id start n_tokens ids_crc32",
    "op3_embedding_dedup": "vec_id n_links component_id kept",
    "op4_language_id": "doc_id held_out lang_pred score",
    "op7_quality": "doc_id held_out score predicted",
    "op8_mixing": "doc_id size source_size target taken",
    "op9_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_ngram_jaccard": "doc_id n_shingles component_id",
}


@pytest.fixture(scope="module")
def run(spark):
    done = {}

    def of(name):
        if name not in done:
            df = __spark_entry__.queries()[name](spark, SF)
            assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
            done[name] = df.collect()
        return done[name]

    return of


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").collect()


def test_op1(spark, run, docs):
    """Shards by the least -ln(u) over 40 and 41 shards, u from the hash of doc_id and shard."""
    from pyspark.sql import functions as F

    from spanloom.llm.sharding import STEP

    hashes = table(spark, SF, "documents").select("doc_id", *[F.xxhash64("doc_id", F.lit((k + 1) * STEP % (1 << 63))).alias(f"h{k}") for k in range(41)]).collect()
    place = {}
    for r in hashes:
        u = [((r[f"h{k}"] & (1 << 64) - 1) >> 11) + 0.5 for k in range(41)]
        place[r.doc_id] = (int(np.argmax(u[:40])), int(np.argmax(u)))  # the least -ln is the largest u
    got = run("op1_sharding")
    text = {r.doc_id: (r.text or "").encode() for r in docs}
    assert len(got) == len(docs)
    slots = defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard) == place[r.doc_id] and r.law == "key"
        assert (r["size"], r.text_crc32) == (len(text[r.doc_id]) + 16, zlib.crc32(text[r.doc_id]))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op2(run, docs):
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0, []
    for r in sorted(docs, key=lambda r: r.doc_id):
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(tuple(r) for r in run("op2_token_files")) == want


def test_op3(spark, run):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in run("op3_embedding_dedup")), key=str)
    assert got == plain_vectors(rows)


@pytest.mark.parametrize("name,mod,rest", [("op4_language_id", 3, 1), ("op7_quality", 4, 2)])
def test_models(spark, run, docs, name, mod, rest):
    got = {r.doc_id: r for r in run(name)}
    assert len(got) == len(docs)
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1
    if name == "op4_language_id":
        right = [got[r.doc_id].lang_pred == r.lang for r in docs if r.lang is not None and got[r.doc_id].held_out and re.search(r"[^\W\d_]", r.text or "")]
        assert np.mean(right) > 0.95 and all(got[r.doc_id].lang_pred == "und" for r in docs if not re.search(r"[^\W\d_]", r.text or ""))
    else:
        assert all(r.predicted == int(r.score >= 0.7) for r in got.values())
        right = [got[r.doc_id].predicted == r.quality for r in table(spark, SF, "labels").collect() if r.quality is not None and got[r.doc_id].held_out]
        assert np.mean(right) > 0.8


def test_op6(spark, run, docs):
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = {(d.doc_id, i) for d in docs for i, t in items if plain_leaks(d.text, [t])}
    assert {(r.doc_id, r.item_id) for r in run("op6_decontamination")} == want and want


def test_op8(spark, run, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    keys = {r.doc_id: r.k for r in table(spark, SF, "documents").selectExpr("doc_id", "xxhash64(doc_id, text) AS k").collect()}
    sizes = defaultdict(int)
    for r in docs:
        sizes[r.source] += size(r.text)
    target = plain_targets(sizes)
    want = plain_taken([(r.doc_id, keys[r.doc_id], r.source, size(r.text)) for r in docs], sizes, target)
    source = {r.doc_id: r.source for r in docs}
    for r in run("op8_mixing"):
        assert r.taken == want[r.doc_id] and abs(r.target - target[source[r.doc_id]]) < 1e-6 and r.source_size == sizes[source[r.doc_id]]


def test_op9(spark, run):
    import hashlib

    rows = [(r.page_id, (r.html or "").encode()) for r in table(spark, SF, "pages").collect()]
    count, last = Counter(b for _, b in rows), {}
    for i, b in rows:
        last[b] = max(i, last.get(b, i))
    want = sorted((i, len(b), hashlib.sha1(b).hexdigest(), *(("revisit", last[b]) if len(b) >= 1000 and count[b] > 1 and i != last[b] else ("response", None))) for i, b in rows)
    assert sorted(tuple(r) for r in run("op9_warc")) == want


def test_op10(run, docs):
    want = plain_groups([(r.doc_id, r.text) for r in docs])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run("op10_ngram_jaccard")} == want
