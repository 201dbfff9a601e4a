"""What token shards cost: one encoder a worker, symbols packed and unpacked eight at a time."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from graphloom.llm import repair

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_tasks_of_a_worker_share_an_encoder():
    assert repair._encoder(WORDS) is repair._encoder(WORDS)


def test_words_of_letters_are_encoded_apart(monkeypatch):
    """They need no splitting; others and those that the library encodes keep their places."""
    from tokenizers import Tokenizer

    split, e = [], repair.Encoder(WORDS)
    cut = e.split
    monkeypatch.setattr(e, "split", lambda by, text: split.append(text) or cut(by, text))
    t, texts = Tokenizer.from_file(WORDS), ["Plain words", "", "don't a1b2 İstanbul ÉCOLE ﬁn", "日本 ²³ x\x02y Plain \x01", "ªº µ ß ǅ straße's"]
    t.encode_special_tokens = True
    ids, ends = e.encode(pa.array([*texts, None]))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts] + [[]]
    assert "plain" not in "".join(split) and "don't" in "".join(split)


@pytest.mark.parametrize("bits", [1, 3, 8, 15, 16, 17, 18, 23, 31, 32])
def test_symbols_packed_and_any_part_unpacked(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 9, 1000):
        sym = rng.integers(0, 1 << bits, n).astype(np.uint32)
        raw = repair._packed(sym, bits)
        assert raw == np.packbits((sym[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1), bitorder="little").tobytes()
        for a, b in ((0, n), (n // 3, n // 2), (n // 2, n), (n, n)):
            assert repair._unpacked(np.frombuffer(raw, np.uint8), bits, a, b).tolist() == sym[a:b].tolist()
