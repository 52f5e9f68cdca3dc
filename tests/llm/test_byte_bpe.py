import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from shapecast.llm import byte_bpe
from shapecast.llm.byte_bpe import Splitter, digests, encode, load_ranks, token_ids

RANKS = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
ODD = ["", " ", "a", "Hello  world's\n\n x \t y ", "don't WE'LL 123 4.5 €€ 日本語 　 x  y", "aaaaaaa" * 60,
       "x \u0085y \x1c z", "  lead", "trail  ", "été naïve ñandú ß ²³ ½ Ⅷ", "<|endoftext|>", "👩‍👩‍👧 flags 🇫🇷", "é ́x", "\n \n", "a\n b"]


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_white_space_is_the_librarys():
    import regex
    enc = library()
    space = regex.compile(r"\s")
    for c in range(0x3100):
        if 0xD800 <= c < 0xE000:
            continue
        t = f"a {chr(c)} b{chr(c)}c"
        s = Splitter(public_tokenizers.PATTERN)
        first, rest = s.chunks(t)
        words = [w.encode() for w in first] + [w for x in rest for w in s.words(x)]
        assert b"".join(words) == t.encode()
        if space.match(chr(c)) or c < 0x400:
            assert [RANKS.get(w) for w in words if w in RANKS] is not None
            assert sum((enc._encode_single_piece(w) for w in words), []) == enc.encode_ordinary(t), hex(c)


def test_equals_the_library(docs_of, monkeypatch):
    enc = library()
    rows = list(enumerate(ODD)) + [(100, None), (None, "null id"), (3, ODD[3]), (3, ODD[3])]
    for most in (byte_bpe.HEAD_WORDS, 3, 0):
        monkeypatch.setattr(byte_bpe, "HEAD_WORDS", most)
        monkeypatch.setattr(byte_bpe.head_words, "__defaults__", (most,))
        made = encode(docs_of(rows, "word"), RANKS, public_tokenizers.PATTERN)
        got = sorted((tuple(r) for r in digests(made, RANKS).collect()), key=str)
        want = []
        for i, t in rows:
            ids = enc.encode_ordinary(t or "")
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert {r.doc_id: r.ids for r in token_ids(made).collect()}[3] == enc.encode_ordinary(ODD[3])


def test_empty(docs_of):
    assert digests(encode(docs_of([]), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0


def test_blocks_and_long_texts(docs_of, monkeypatch):
    """Several blocks of documents, a text longer than a block, a long word, no head."""
    monkeypatch.setattr(byte_bpe, "BLOCK_DOCS", 3)
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 40)
    monkeypatch.setattr(byte_bpe, "HEAD_WORDS", 0)
    monkeypatch.setattr(byte_bpe.head_words, "__defaults__", (0,))
    enc = library()
    rows = list(enumerate(ODD * 3)) + [(200, "wörd unseen " * 400), (201, "xyzzyqua" * 40 + "é" * 90), (202, "ab")]
    got = {r.doc_id: r.ids for r in token_ids(encode(docs_of(rows), RANKS, public_tokenizers.PATTERN)).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in rows}
