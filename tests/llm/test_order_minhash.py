import hashlib
import random
import re
import struct

import pytest
import xxhash

from trueframe.llm import order_minhash

from .conftest import words


def spark_hash(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def long(v):
    return struct.pack("<q", v)


def tuples(text):
    """The sketches' tuples, straight from the definition."""
    hashes = [spark_hash(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if len(hashes) >= 5:
        kmers = [spark_hash(*map(long, hashes[i:i + 5])) for i in range(len(hashes) - 4)]
    else:
        kmers = [spark_hash(" ".join(map(str, hashes)).encode())] if hashes else []
    seen, numbered = {}, []
    for k in kmers:
        seen[k] = seen.get(k, -1) + 1
        numbered.append(spark_hash(long(k), struct.pack("<i", seen[k])))
    out = []
    for sketch in range(-16, 16):
        least = sorted(h for h in numbered if h >> 59 == sketch)[:2]
        if least:
            out.append(f"{sketch + 16:02d}{spark_hash(*map(long, sorted(least, key=numbered.index))) & 0xFFFFFFFF:08x}")
    return out


def likeness(a, b):
    either = {t[:2] for t in a} | {t[:2] for t in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def want(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-(1 << 63) if r[0] is None else r[0], r[1].encode()))
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + following[:cut]
        own, new = tuples(text), tuples(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(own), "".join(new),
                    pytest.approx(likeness(own, new)), pytest.approx(likeness(own, tuples(following)))))
    return out


def check(documents, rows):
    got = [tuple(r) for r in order_minhash.fingerprints(documents(rows)).collect()]
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(got, key=key) == sorted(want(rows), key=key)
    return got


def test_equals_the_definition(documents):
    rng = random.Random(1)
    rows = [(rng.choice([i, i * 5000]), words(rng, rng.choice([0, 1, 4, 5, 6, 60, 400]), rng.choice([2, 5, 500]))) for i in range(1, 60)]
    rows += [(100_000, None), (100_001, ""), (100_002, " \n\t "), (None, "no id at all here"), (-5, "ünïcödé 😀 tëxt " * 9)]
    check(documents, list(dict(rows).items()))


def test_ties_and_repeated_rows(documents):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "other text with the same id"), (2, "two")]
    got = check(documents, rows)
    assert len({r[3] for r in got if r[0] == 1}) == 2


def test_one_word_over_and_over_and_very_long_text(documents):
    rng = random.Random(2)
    check(documents, [(1, "la " * 3000), (2, words(rng, 20_000)), (3, "x" * 50_000)])


def test_single_document_follows_itself_and_empty_table(documents):
    assert check(documents, [(4, "a b c d e f g h i j k l")])[0][6] == 1.0
    assert order_minhash.fingerprints(documents([])).count() == 0


def test_order_of_words_counts(documents):
    rng = random.Random(3)
    lines = [words(rng, 8, 10_000) for _ in range(80)]
    swapped = lines[40:] + lines[:40]
    got = {r.doc_id: r.near_next for r in order_minhash.fingerprints(documents([(1, "\n".join(lines)), (2, "\n".join(swapped)), (3, "end")])).collect()}
    assert 0.2 < got[1] < 0.95
