"""Alignment of two tokenizers against plain loops over their tokens."""

import hashlib
from collections import Counter, defaultdict

import pytest

from spanloom.llm import alignment
from spanloom.llm.queries import vocabulary
from spanloom.llm.shared import table

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def plain_tokens(texts):
    """Ids and bytes of A and B from the libraries, by their own decoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate_letters()}
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids
        b = m.encode(text)
        yield a, [bytes(letters[c] for c in t.id_to_token(i)) for i in a], b, [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in b]


def enumerate_letters():
    rest = 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            yield b, chr(b)
        else:
            yield b, chr(256 + rest)
            rest += 1


def plain_links(texts):
    docs, seen = [], defaultdict(set)
    for k, (text, (a, wa, b, wb)) in enumerate(zip(texts, plain_tokens([t or "" for t in texts]), strict=True)):
        raw = (" " + (text or "")).encode()
        if not text or b"".join(wa) != raw or b"".join(wb) != raw:
            docs.append(None)
            continue
        groups, i, j, at, to, x, y = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if at <= to and i < len(a):
                x.append(a[i])
                at += len(wa[i])
                i += 1
            else:
                y.append(b[j])
                to += len(wb[j])
                j += 1
            if at == to:
                groups.append((x, y))
                x, y = [], []
        docs.append((len(a), len(b), groups))
        for x, y in groups:
            for p in x:
                for q in y:
                    seen[p, q].add(k)
    count = {k: len(v) for k, v in seen.items()}
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for x, y in d[2] for p in x for q in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in d[2])
        out.append((d[0], d[1], len(d[2]), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


def found(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r.doc_id)]


ODD = [
    "one two  three\n\n four", None, "", " ", "   leading and trailing   ", "<|endoftext|> and </s> <s> <unk> <0x0A> are text", "Ähre ñandú 東京都 and 😀 emoji", "▁ piece mark ▁x",
    "don't we'll I'D", "x" * 3000, " " * 500 + "y", "\x00\x01 control \x7f", "tab\tand no-break space   line", "one two  three\n\n four", "é combining ﬁ ligature ½",
]


@pytest.mark.parametrize("held", [alignment.HELD, 5])
def test_odd_texts(spark, held):
    rows = [(k, t, "doc", 1.5) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pairs string, row double")
    assert found(alignment.links(df, A, B, held=held)) == plain_links(ODD)


def test_wide_groups_go_by_distinct_ids(monkeypatch):
    texts = [t for t in ODD if t]
    how = alignment.aligner(A, B)
    want = [x.tolist() for x in how.align(texts).pairs()]
    monkeypatch.setattr(alignment, "WIDE", 1)
    assert [x.tolist() for x in how.align(texts).pairs()] == want


def test_group_rows(spark):
    df = spark.createDataFrame([(1, "tokens overlap, tokens do not"), (2, None), (3, "naïve")], "doc_id long, text string")
    rows = alignment.group_rows(df, A, B).collect()
    how = alignment.aligner(A, B)
    for i, text in ((1, "tokens overlap, tokens do not"), (3, "naïve")):
        own = [r for r in rows if r.doc_id == i]
        raw = (" " + text).encode()
        assert b"".join(raw[r.start : r.end] for r in own) == raw
        for r in own:
            assert raw[r.start : r.end] == b"".join(how.a.bytes[k] for k in r.a_ids) == b"".join(how.b.bytes[k] for k in r.b_ids)
    assert not [r for r in rows if r.doc_id == 2]


def test_other_ways_to_encode(tmp_path):
    texts = [" " + t for t in ODD if t]
    quick = alignment.ByteLevel(A)
    assert quick.quick is not None
    slow = alignment.ByteLevel(A)
    slow.quick = None
    texts.append("a" + "\n" * 5000 + " b")
    assert [x.tolist() for x in quick.encode(texts)] == [x.tolist() for x in slow.encode(texts)]


def test_very_long_words():
    how = alignment.aligner(A, B)
    for text in ("x" * 1_000_000, " " * 1_000_000 + "a", "ab " * 300_000):
        g = how.align([text])
        assert int((how.sizes[0][g.a]).sum()) == len(text) + 1 and len(g.at) == 1


def test_empty_table(spark):
    assert alignment.links(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_whole_table(spark):
    import __spark_entry__

    sf = "/root/testdata/sf0.001"
    rows = sorted(table(spark, sf, "documents").select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    assert found(__spark_entry__.queries()["op12_token_alignment"](spark, sf)) == plain_links([r.text for r in rows])
