import io
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from catalune.llm import tokenstore as S

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("mode", ["byte", "bit"])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_planes_round_trip(mode, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint32)
    planes = S.to_planes(ids, mode)
    assert len(planes) == (4 if mode == "byte" else 32) and S.from_planes(planes, n, mode).tolist() == ids.tolist()


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_file_round_trip_and_damage(mode):
    rnd, out = random.Random(1), io.BytesIO()
    docs = [(i if i % 5 else None, np.array([rnd.randrange(49408) for _ in range(rnd.choice([0, 1, 30, 200]))], "<u4")) for i in range(50)]
    w = S.Writer(out, 64, mode)
    for d, ids in docs:
        w.add(d, ids.tobytes())
    w.close()
    got = list(S.Reader(io.BytesIO(out.getvalue())).documents())
    assert [(d, x.tolist()) for d, x in got] == [(d, x.tolist()) for d, x in docs]
    r = S.Reader(io.BytesIO(out.getvalue()))
    at = r.chunks[3][0]
    broken = bytearray(out.getvalue())
    broken[at + 6] ^= 255
    with pytest.raises(Exception):  # noqa: B017  zstandard's error or our checksum
        S.Reader(io.BytesIO(bytes(broken))).chunk(3)
    with pytest.raises(ValueError):
        S.Reader(io.BytesIO(out.getvalue()[:-9]))


def test_pieces_encode_as_whole_texts():
    tok, rnd = Tokenizer.from_file(PATH), random.Random(7)
    alphabet = [*"aeßAÉ '0123.,!?;:-", "’s", "'s", "İ", "Σ", "ς", "é", "́", "x.", "y,.", "\n", "\t", " ", "\x1c", "\x85", "漢", "😀", "٣", "K", "<|endoftext|>", "<|", "word", "don't", "Hello,", "3.14", "A.B.C."]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(25))) for _ in range(3000)]
    got = list(S.PieceEncoder(PATH).encode([t.encode() for t in texts], b""))
    for t, raw in zip(texts, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_cache_that_overflows(monkeypatch):
    monkeypatch.setattr(S, "CACHE", 3)
    tok, e = Tokenizer.from_file(PATH), S.PieceEncoder(PATH)
    for t in ["a b c d, e.", "f g a", "d, d, e. z"]:
        assert np.frombuffer(next(e.encode([t.encode()], b"")), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def brute(rows):
    tok, out, at = Tokenizer.from_file(PATH), [], 0
    import zlib

    for d, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_documents(spark, docs):
    want = brute(sorted((r["doc_id"], r["text"]) for r in docs.collect()))
    for mode in ("byte", "bit"):
        got = S.token_output(docs, PATH, block=1000, mode=mode)
        assert sorted(tuple(r)[:4] for r in got.collect()) == want


def test_odd_documents(spark, odd):
    got = sorted(S.token_output(odd, PATH).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == [None, None, *sorted(i for i in ids if i is not None)] and len(got) == 13
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))
    assert {r["doc_id"]: r["n_tokens"] for r in got}[4] == 1
    assert S.token_output(odd.limit(0), PATH).count() == 0


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    assert not S.PieceEncoder(PATH).whole
    other = PATH.replace("word_bpe_49k", "byte_bpe_50k")
    e, tok = S.PieceEncoder(other), Tokenizer.from_file(other)
    texts = ["Hello  World 42", "a\nb", ""]
    assert e.whole and [np.frombuffer(x, "<u4").tolist() for x in e.encode([t.encode() for t in texts], b"")] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_bytes_that_are_no_text_are_encoded():
    assert len(list(S.PieceEncoder(PATH).encode([b"ab \xff\xc3 z", b"<| \xff"], b"\x01\0\0\0"))) == 2
