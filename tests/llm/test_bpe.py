from __future__ import annotations

import pytest
from tokenizers import Tokenizer

from menuspark.llm import bpe
from menuspark.llm.queries import word_vocabulary

TEXTS = [
    "", "aaaa aaaaaaa", "Hello, World! don't 'S I'LL 1234", "<|endoftext|> x<|startoftext|><|endoftext|>y", "ΑΣ ΣΑΣ İstanbul ẞ", "é ẛ̣ ﬁ ²½Ⅷ",
    "日本語 テスト", "  x\u0085y z w", "\0<|endoftext|>", "😀😀👩‍👩‍👧", "x" * 3000 + " " + "ab" * 2000, "<|endoftext |> <|", "ǅ ŉ", "a\r\nb\tc",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_vocabulary())


def test_ids_and_decoding_match_the_library(library):
    model = bpe.load(word_vocabulary())
    ids = model.encode_batch(TEXTS)
    for text, mine, back in zip(TEXTS, ids, model.decode_batch(ids), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert mine.tolist() == want
        assert back == library.decode(want, skip_special_tokens=False)


def test_cache_reset_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    model = bpe.load(word_vocabulary())
    for _ in range(3):
        for text in TEXTS[:4]:
            assert model.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_on_rows(frame, library):
    rows = [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, None, None), (0, "again", "s"), (0, "again", "s")]
    found = bpe.round_trip(frame(rows).repartition(3), word_vocabulary()).collect()
    assert len(found) == len(rows)
    want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t, _ in rows)
    assert sorted((str(r.id), r.ids) for r in found) == want
    again = bpe.decode(bpe.encode(frame(rows), word_vocabulary()), word_vocabulary()).collect()
    assert sorted((str(r.id), r.ids, r.decoded) for r in again) == sorted((str(r.id), r.ids, r.decoded) for r in found)
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in found)
    assert bpe.round_trip(frame([]), word_vocabulary()).count() == 0


def test_portions_are_bounded():
    import pyarrow as pa

    texts = [None, "a" * 700_000, "b" * 700_000, "c" * 3_000_000, *["d"] * 600]
    parts = [b.column(0).to_pylist() for b in bpe.portions(iter([pa.RecordBatch.from_pydict({"t": texts})]), 0)]
    assert [t for p in parts for t in p] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p) <= bpe.BYTES_AT_ONCE for p in parts) and max(map(len, parts)) <= 256
