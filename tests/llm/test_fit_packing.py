import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from shapecast.llm.fit_packing import ChunkEncoder, pack, plan_sequences

VOC = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOC).encode(text, add_special_tokens=False).ids


def test_chunks_equal_the_library():
    odd = ["", " ", "Hello  World's\tx\n\n y", "<|endoftext|>a <|startoftext|>", "é é ΑΣ ΟΔΟΣ x ﬁ İ", "x" * 500,
           "a　b ́c", "don't WE'LL 123 4.5 €€ 日本語", "\x1c \x85y \x00", "L'été ÀÉÎ ÿ's't 1'2 ß×÷ ª º µm ---'ll 'Re 12a3"]
    enc = ChunkEncoder(VOC)
    for t, ids in zip(odd, enc([t.encode().split() for t in odd])):
        assert np.frombuffer(ids, "<u4").tolist() == whole(t), t


@pytest.mark.parametrize("seed", range(8))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 64, 400])
    top = cap if seed % 2 else max(1, cap // 2)
    histogram = dict(Counter(rng.randint(1 if seed % 3 else max(1, cap // 5), top) for _ in range(rng.choice([0, 1, 40, 3000]))))
    slots = plan_sequences(histogram, cap)
    fill, seen = Counter(), Counter()
    for s in slots.itertuples():
        for r in range(s.low, s.high):
            seq = s.first + r - s.low
            fill[seq] += s.length
            seen[s.length] += 1
    assert seen == Counter(histogram) and all(v <= cap for v in fill.values())
    total = sum(k * v for k, v in histogram.items())
    assert len(fill) <= 1.25 * total / cap + 1 or top > cap // 2


def test_reduction_is_optimal_on_small_cases():
    # 6+4, 7+3 fill; 9 alone: three sequences, as no packing can be better
    assert plan_sequences({9: 1, 6: 1, 4: 1, 7: 1, 3: 1}, 10)["first"].max() == 2


def test_pack_places_without_gaps(docs_of):
    rows = [(i, " ".join(["word%d" % (i % 9)] * (i * 7 % 300))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "long " * 9000), (None, "a b"), (5, "again"), (5, "again")]
    got = pack(docs_of(rows, "length"), VOC, 256, 1).collect()
    want = Counter()
    for i, t in rows:
        ids = whole(t or "") + [1]
        for k in range(0, len(ids), 256):
            p = ids[k:k + 256]
            want[(i, k // 256, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.1 * sum(r.length for r in got) / 256 + 1


def test_empty(docs_of):
    assert pack(docs_of([]), VOC).count() == 0


def test_chunks_of_bytes_have_the_tokenizers_ids():
    """Bytes of ASCII, Latin and other chunks; words are remembered by their bytes."""
    from tokenizers import Tokenizer
    whole, enc = Tokenizer.from_file(VOC), ChunkEncoder(VOC)
    rows = ["Hello, WORLD it's 12ab", "Écoute l'ÉTÉ naïve! straße", "日本 語<|x|> a\x00b \x1f", "ab<|endoftext|> DON'T... (x)", "", "ka " * 50]
    got = enc([t.encode().split() for t in rows])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(t, add_special_tokens=False).ids for t in rows]
    assert enc.words and all(type(w) is bytes for w in enc.words)
