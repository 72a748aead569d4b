import base64
import hashlib
import random

import pytest

from graphloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(9)
    bits = ["a", "Z", " ", "  ", "\n", "\t", "'s", "'LL", "é", "中", "😀", "‍", " ", "123", "<|endoftext|>", "!!", "ñ", "\x00", "٣", "word ", " "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", None, "<|endoftext|>", "x" * 5000, " " * 3000]


def test_same_ids_as_the_ranks_and_exact_round_trip(spark, make_docs, tables, reference):
    all_ = texts()
    got = {r.doc_id: r for r in bpe.op5_byte_bpe(spark, tables(documents=make_docs(all_))).collect()}
    for k, t in enumerate(all_):
        ids = reference.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_ids_offsets_and_decoding(spark, make_docs, reference):
    all_ = texts()
    rows = bpe.encode(make_docs(all_), offsets=True, keep_text=True)
    assert "extra" in rows.columns
    for r in bpe.decode(rows).collect():
        t = r.text or ""
        assert list(r.ids) == reference.encode_ordinary(t) and bytes(r.decoded) == t.encode()
        pos = 0
        for i, a, b in zip(r.ids, r.starts, r.ends):
            raw = reference.decode_single_token_bytes(i)
            assert raw in t[a:b].encode() and t[a:b].encode().find(raw) >= 0
            pos += len(raw)
        assert pos == len(t.encode())


def test_a_full_piece_table_changes_nothing(monkeypatch, reference):
    monkeypatch.setattr(bpe, "PIECES", 5)
    c = bpe.Codec(*bpe.default_vocabulary())
    for t in ["one two three", "four five six seven eight nine", "one ten"]:
        assert c.encode([t]) == [" ".join(map(str, reference.encode_ordinary(t)))]


def test_empty_table(spark, make_docs):
    assert bpe.encode(make_docs(["a"]).limit(0), digests=True).count() == 0
