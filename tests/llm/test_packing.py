import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from trueframe.llm import packing

from .conftest import words

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = list("abAZéßİΣς你かﬁＡ①½Å   ́क़ .,;:!?'\"-_\t\n\r\v\f0129") + ["<|endoftext|>", "'s", "don't", "é", "é", "q̇:"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_equals_the_tokenizer(tokenizer):
    rng, encode = random.Random(1), packing.Encoder(PATH)
    for _ in range(1500):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(50)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_memory_keeps_ids_right_when_it_turns(tokenizer):
    encode = packing.Encoder(PATH)
    encode.memory = packing.Memory(limit=3)
    for text in ("one two three four", "four five one.", "six, seven one two", "", "five five."):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_full_memory_keeps_the_words_still_met(tokenizer):
    """Words met since the last turn stay known; others, and long ones, are given up."""
    encode = packing.Encoder(PATH)
    encode.memory = packing.Memory(limit=8)
    long = "x" * (packing.LONGEST + 1)
    for text in (f"a b c d e f {long}. {long}", "a b", "a c.", "a b c"):
        ids, sizes = encode.batch(pa.array([text, "", text]), 1)
        want = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        assert ids.tolist() == [*want, 1, *want] and sizes.tolist() == [len(want), 1, len(want)]
    assert {"a", "b", "c"} <= set(encode.memory.words.to_pylist()) and long not in encode.memory.words.to_pylist()


def test_known_words_are_not_encoded_again(monkeypatch):
    """A word met before, alone or before a mark, is found by its place and never asked for as text."""
    encode = packing.Encoder(PATH)
    encode.memory = packing.Memory()
    encode("one two three. four")
    asked = []
    monkeypatch.setattr(encode, "ids_of", lambda parts, plain=encode.ids_of: asked.extend(parts) or plain(parts))
    encode.batch(pa.array(["four three. two", None, "one five"]), 1)
    assert asked == ["five"]


def test_many_new_words_are_encoded_in_parts(tokenizer, monkeypatch):
    """The tokenizer's notes stay small, however many words of a batch are new, and the ids stay its own."""
    class Watched:
        most = 0

        def encode_batch_fast(self, texts, **options):
            self.most = max(self.most, sum(len(t.split()) for t in texts))
            return tokenizer.encode_batch_fast(texts, **options)

    encode, watched = packing.Encoder(PATH), Watched()
    encode.memory, encode.tokenizer = packing.Memory(), watched
    monkeypatch.setattr(packing, "TOGETHER", 7, raising=False)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdeé1.", k=6)) for _ in range(40)) for _ in range(5)]
    ids, lengths = encode.batch(pa.array(texts), 1)
    assert ids.tolist() == [i for t in texts for i in (*tokenizer.encode(t, add_special_tokens=False).ids, 1)]
    assert lengths.sum() == len(ids) and 0 < watched.most <= 7


def test_small_batches_are_worked_on_together(documents, tokenizer, monkeypatch):
    rows = [(i, f"text {i} " * (1 + i % 30)) for i in range(200)]
    monkeypatch.setattr(packing, "CHUNK_BYTES", 700)
    check(rows, packing.pack(documents(rows), PATH).collect(), tokenizer)


def test_sum_of_squares_takes_the_least_change():
    rng = random.Random(2)
    sizes = np.array([rng.randrange(1, 21) for _ in range(300)])
    bins, offsets = packing.sum_of_squares(sizes, 20)
    level: dict[int, int] = {}
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        count = np.bincount([20 - v for v in level.values() if v < 20], minlength=21)

        def total(b=None):
            after = dict(level)
            after[b if b is not None else len(level)] = after.get(b, 0) + s
            return sum(int(n) ** 2 for n in np.bincount([20 - v for v in after.values() if v < 20], minlength=21))
        best = min([total()] + [total(x) for x, v in level.items() if v + s <= 20])
        assert total(b if b in level else None) == best and o == level.get(b, 0)
        level[b] = level.get(b, 0) + s
        assert level[b] <= 20 and count.sum() >= 0


def check(rows, out, tokenizer):
    want = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k:k + 4096], "<u4")
            want.append((doc, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    have = [(None if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out]
    assert sorted(have, key=str) == sorted(want, key=str)
    places: dict[int, list] = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places)


def best_fit_falling(sizes, capacity=4096):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fits = [(g, i) for i, g in enumerate(gaps) if g >= size]
        if fits:
            gaps[min(fits)[1]] -= size
        else:
            gaps.append(capacity - size)
    return len(gaps)


def test_pieces_fill_sequences(documents, tokenizer):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([1, 20, 200, 500]))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, words(rng, 9000)), (None, "no id"), (903, "twice"), (903, "twice")]
    out = packing.pack(documents(rows), PATH).collect()
    assert check(rows, out, tokenizer) <= 1.05 * best_fit_falling([r.length for r in out]) + 1


def test_blocks_do_not_change_the_pieces(documents, tokenizer):
    rows = [(i, f"document {i} " * (i % 40)) for i in range(200)]
    check(rows, packing.pack(documents(rows), PATH, block=50).collect(), tokenizer)


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).count() == 0
