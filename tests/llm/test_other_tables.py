"""Operators on pages and vectors, and the pipeline."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import embeddings, lines, quality, warc
from spanloom.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


# pages

PAGES = "page_id long, url string, html string, host string, payload string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same " * 400 + "</p>"
    rows = [(i, f"http://User@Site.example:80/{i}", f"<p>Menu</p><p>body {i}</p><p>Menu</p><script>x</script>") for i in range(6)]
    rows += [(10, None, None), (11, "no url", ""), (12, "https://other.example/", "<p>Menu</p>"), (None, "https://other.example/", big), (13, "x://y", big), (14, "x://y", big), (13, "x://y", big), (15, None, "small"), (16, None, "small")]
    rows += [(20, "http://long.example/", "word " * 400_000)]
    return rows, spark.createDataFrame([(*r, "h", "p") for r in rows], PAGES).cache()


def test_line_dedup(spark, pages):
    rows, df = pages
    got = {r.page_id: r for r in lines.dedup_lines(df).collect()}
    assert lines.dedup_lines(df).count() == len(rows) and lines.dedup_lines(df.limit(0)).count() == 0
    for i in range(6):
        assert (got[i].host, got[i].n_lines, got[i].n_kept, got[i].text) == ("site.example", 3, 1, f"body {i}")
    assert got[12].text == "Menu" and got[10].text == "" and got[11].host == ""
    assert got[20].n_kept == 1 and len(got[20].text) == 5 * 400_000 - 1


def test_warc_round_trip(spark, pages, tmp_path):
    rows, df = pages
    index = warc.archive(df, tmp_path.as_uri())
    got = sorted((tuple(r) for r in warc.read_back(index).collect()), key=str)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        again = len(b) >= 1000 and html == rows[9][2] and i != 14
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 14 if again else None))
    assert got == sorted(want, key=str)
    for e in index.collect():
        head, payload = warc.fetch(e.bundle, e.frame, e["at"])
        assert head["WARC-Record-ID"] == e.record_id and warc.page_of(e.record_id) == e.page_id
        assert head["WARC-Type"] == "revisit" or hashlib.sha1(payload).hexdigest() == head["WARC-Payload-Digest"][5:]
    assert warc.read_back(warc.archive(df.limit(0), tmp_path.as_uri())).count() == 0


def test_warc_frames_and_damage(tmp_path):
    b = warc.Bundle(tmp_path.as_uri())
    at = [b.add(warc.record(i, "u", bytes([65 + i]) * 600_000, "d", 600_000, "response", None)) for i in range(4)]
    b.close()
    assert [k for k, _ in at] == [0, 1, 2, 3]
    assert warc.fetch(b.uri, 2, 0)[1] == b"C" * 600_000
    place = tmp_path / b.uri.rsplit("/", 1)[1]
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(place.read_bytes(), read_across_frames=True).read()
    assert len(whole) > 2_400_000  # any reader of the format passes over the seek table
    raw = bytearray(place.read_bytes())
    raw[30] ^= 255
    place.write_bytes(bytes(raw))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.Reader(b.uri).frame(0)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_agrees(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    rel = con.sql(oracle_sql()[name])
    df = queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    assert Counter(map(tuple, df.select(*rel.columns).collect())) == Counter(rel.fetchall())


def test_every_record_has_a_date_and_an_id_of_its_own(spark, tmp_path):
    rows = [(1, "u", "x" * 2000), (1, "u", "x" * 2000), (1, "v", "y"), (2, "u", "x" * 2000), (None, "u", "x" * 2000), (None, None, None), (3, "w", "z" * 1500)]
    pages = spark.createDataFrame([(*r, "bundle", 5) for r in rows], "page_id long, url string, html string, bundle string, twin int")
    index = warc.archive(pages, tmp_path.as_uri())
    entries = index.collect()
    assert len(entries) == len(rows) == len({e.record_id for e in entries})
    names = set()
    for uri in {e.bundle for e in entries}:
        reader = warc.Reader(uri)
        for k in range(len(reader.frames)):
            data, at = reader.frame(k), 0
            while at < len(data):
                first = at == 0 and k == 0
                head, _, at = warc.parse(data, at)
                assert head["WARC-Date"].endswith("Z") and (head["WARC-Type"] == "warcinfo") == first
                assert head["WARC-Record-ID"] not in names
                names.add(head["WARC-Record-ID"])
    for e in entries:
        head, _ = warc.fetch(e.bundle, e.frame, e.at)
        assert head["WARC-Record-ID"] == e.record_id and warc.page_of(e.record_id) == e.page_id
    got = sorted((r.page_id is None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in warc.read_back(index).collect())
    x = (2000, "revisit", 2)
    assert got == sorted([(False, 1, *x), (False, 1, *x), (False, 1, 1, "response", 0), (False, 2, 2000, "response", 0), (True, 0, *x), (True, 0, 0, "response", 0), (False, 3, 1500, "response", 0)])


# vectors


def plain_vectors(rows, cosine=0.93):
    fine = {}
    for k, (i, e, label) in enumerate(rows):
        if i is not None and label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e):
            fine[k] = np.array(e, float)
    parent = {r[0]: r[0] for r in rows if r[0] is not None}
    links = Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ks = sorted(fine)
    for n, a in enumerate(ks):
        for b in ks[n + 1 :]:
            if rows[a][2] == rows[b][2] and len(fine[a]) == len(fine[b]):
                x, y = fine[a], fine[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    p, q = find(rows[a][0]), find(rows[b][0])
                    parent[max(p, q)] = min(p, q)
    return sorted(((i, links[k], None if i is None else (find(i) if k in fine else i)) for k, (i, *_) in enumerate(rows)), key=str)


def test_vectors_against_plain(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for g in range(25):
        base = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((i, base.astype(np.float32).tolist(), g % 3))
            i += 1
            base = base + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.35])
    v = rows[0][1]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 24, 0), (503, [None, *v[1:]], 0), (504, [float("nan"), *v[1:]], 0), (505, [float("inf"), *v[1:]], 0), (506, v, None), (None, v, 0), (507, [x * 3 for x in v], 0), (508, v[:5], 0), (509, v[:5], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, w string, rep int")
    got = embeddings.near_vectors(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == plain_vectors(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_doubles_are_compared_as_doubles(spark):
    """Pairs a hair to either side of the threshold: single precision could not tell them."""
    rows, want = [], {}
    for k in range(200):
        c = 0.93 + (2e-9 if k % 2 else -2e-9)
        rows += [(2 * k, [1.0, 0.0, 0.0], k), (2 * k + 1, [c, float(np.sqrt(1 - c * c)), 0.0], k)]
        want[2 * k] = want[2 * k + 1] = k % 2
    rows += [(1000, [1e200, 1e-200, 0.0], 500), (1001, [1e-200, 0.0, 0.0], 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df).collect()}
    assert got == {**want, 1000: 1, 1001: 1}


def test_near_pairs_are_all_found():
    """Runs and parts that the bounds leave out hold no pair; those of clustered vectors are mostly left out."""
    rng = np.random.default_rng(5)
    middles = rng.standard_normal((40, 32))
    x = np.repeat(middles, 30, axis=0) + rng.standard_normal((1200, 32)) * rng.choice([0.05, 0.3], (1200, 1))
    x = embeddings.unit(x) @ embeddings.rotation(32)
    order = rng.permutation(1200)
    y, z = x[order[:700]], x[order[700:]]
    reach = 2 - 2 * 0.93
    whole = {(i, j) for i, j in zip(*np.nonzero(y @ z.T >= 0.93), strict=True)}
    pairs = [(i, j) for a, b in embeddings.near_pairs(y.astype(np.float32), z.astype(np.float32), reach) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert whole and whole <= set(pairs) and len(set(pairs)) == len(pairs)
    inner = [(i, j) for a, b in embeddings.near_pairs(y.astype(np.float32), None, reach) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    want = {(min(i, j), max(i, j)) for i, j in zip(*np.nonzero(np.triu(y @ y.T >= 0.93, 1)), strict=True)}
    seen = [(min(p), max(p)) for p in inner]
    assert want <= set(seen) and len(seen) == len(set(seen)) and all(i != j for i, j in seen)


def test_different_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (9, [1.0, 0.0], 1), (8, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (8, 1, 8, True), (9, 1, 8, False)]


def test_leaves_hold_every_row_once():
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 9, 100, 333, 2048):
        x = rng.standard_normal((n, 8)).astype(np.float32)
        rows = embeddings.leaves(x)
        assert sorted(rows[rows >= 0].tolist()) == list(range(n)) and rows.shape[1] == embeddings.LEAF
    x = np.zeros((100, 8), np.float32)  # equal points
    assert sorted(embeddings.leaves(x)[embeddings.leaves(x) >= 0].tolist()) == list(range(100))


def test_few_pairs_of_clusters_are_measured():
    """500 clusters: the leaves leave out more than four fifths of the pairs in each block."""
    rng = np.random.default_rng(7)
    x = np.repeat(rng.standard_normal((500, 64)), 4, axis=0) + 0.1 * rng.standard_normal((2000, 64))
    x = (embeddings.unit(x) @ embeddings.rotation(64)).astype(np.float32)
    tally: list[int] = []
    got = {(i, j) for a, b in embeddings.near_pairs(x, None, 0.14, tally) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(x.astype(float) @ x.T >= 0.93, 1)), strict=True)}
    assert want <= got and len(want) == 3000 and sum(tally) < 0.2 * len(tally) * 2000 * 1999 / 2


def test_tiles_of_a_large_label(spark, monkeypatch):
    """Parts of a clustered label by pivots: most pairs of parts are left out, no link is lost."""
    monkeypatch.setattr(embeddings, "CHUNK", 40)
    monkeypatch.setattr(embeddings, "BALLS", 10)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.standard_normal((20, 16)), 60, axis=0) + rng.standard_normal((1200, 16)) * 0.08
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    reps = df.selectExpr("vec_id AS rep", "embedding", "label", "1L AS w", "16 AS dims")
    parts = embeddings.parted(reps)
    count = parts.select("part").distinct().count()
    assert count >= 30 and embeddings.tiles(parts, 0.93).count() < count * (count + 1) / 4
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()), key=str)
    assert got == plain_vectors(rows)


def test_some_block_is_near():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 64))
    y = x + rng.standard_normal((300, 64)) * 0.35
    x, y = (a / np.linalg.norm(a, axis=1)[:, None] for a in (x, y))
    near = (x * y).sum(1) >= 0.93
    r = embeddings.rotation(64)
    got = embeddings.candidates((x @ r).astype(np.float32), (y @ r).astype(np.float32), 2 - 2 * 0.93)
    assert near.sum() > 30 and got[np.arange(300), np.arange(300)][near].all() and got.mean() < 0.2


# the pipeline


def test_pipeline_against_plain_stages(spark):
    import corpus_pipeline as p

    from spanloom.llm.shared import stored, table
    from tests_plain import plain_groups, plain_leaks

    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in p.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        if name != "sharding":
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
            kept = {r.doc_id for r in after}
            good = [i for i, q in labels.items() if q == 1]
            assert sum(i in kept for i in good) >= 0.95 * len(good)
            assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.2 * sum(q == 0 for q in labels.values())
        elif name == "near_duplicates":
            want = plain_groups([(i, r.text) for i, r in before.items()])
            assert sorted(r.doc_id for r in after) == sorted(i for i, c in want.items() if i == c)
        elif name == "decontamination":
            items = [r.text for r in table(spark, SF, "benchmark").collect()]
            assert {r.doc_id for r in after} == {i for i, r in before.items() if not plain_leaks(r.text, items)}
        elif name == "mixing":
            n = Counter(r.doc_id for r in after)
            assert set(n) <= set(before) and max(n.values()) <= 3
            assert all(r == before[r.doc_id] for r in after)
        else:
            assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in rows_before)
            assert len({(r.shard, r.slot) for r in after}) == len(after)
        rows_before, before = after, {r.doc_id: r for r in after} if name != "sharding" else {}


def test_pipeline_of_odd_and_no_rows(spark):
    import corpus_pipeline as p

    from spanloom.llm.shared import stored

    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
    rng = random.Random(1)
    rows = [(0, None), (1, ""), (2, " "), (3, "y" * 1_500_000), (None, "no id here"), (5, "twice the same row of words"), (5, "twice the same row of words"), (6, " ".join(rng.choice("abcdefgh") for _ in range(300_000)))]
    for data in ([(i, t, None, None, None, 0.5, "row") for i, t in rows], []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in p.STAGES:
            docs = stored(stage(spark, docs, SF), f"odd-{name}")
            if name != "sharding":
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        docs.collect()


def test_held_out_rows(spark):
    import zlib

    got = spark.range(200).select("id", quality.held_out("id", 4, 2).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
