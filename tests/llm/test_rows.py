"""Rows that share an id or differ in one column only, and column names the operators use themselves."""

from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from trueframe.llm import curriculum, minhash, packing, runindex

from .conftest import words

A, B = "first unique passage " * 9, "another one, quite different " * 9


def test_copies_are_told_by_text_and_not_by_id(documents):
    rows = [(1, A), (5, A), (5, B), (6, B + "!")]
    got = {(r.doc_id, r.n_bytes): (r.n_removed, r.n_spans) for r in runindex.removal(documents(rows)).collect()}
    assert got[5, len(A)] == (len(A), 1) and got[5, len(B)] == (0, 0)
    assert got[1, len(A)] == (0, 0) and got[6, len(B) + 1] == (len(B), 1)


def test_mix_keeps_every_rows_own_columns(work, documents):
    import random
    rng = random.Random(3)
    rows = [(i, words(rng, 20 + i % 7), "ab"[i % 2]) for i in range(40)] + [(7, "same words here", "a")] * 2 + [(None, None, None)] * 3
    docs = documents(rows).withColumn("lang", F.concat(F.lit("l"), F.monotonically_increasing_id().cast("string")))
    docs = work.createDataFrame(docs.collect(), docs.schema)
    taken = curriculum.takes(curriculum.sized(docs)).filter("doc_id = 7 AND size = 3").collect()
    got = curriculum.mix(docs).collect()
    own = {r.lang: tuple(r) for r in docs.collect()}
    assert all(tuple(r) == own[r.lang] for r in got)
    twins = Counter(r.lang for r in got if r.doc_id == 7 and r.text == "same words here")
    assert sorted(twins.values()) == sorted(t.copies for t in taken if t.copies) and len(twins) == sum(t.copies > 0 for t in taken)


def test_clashing_names(documents):
    rng = __import__("random").Random(5)
    base = words(rng, 60)
    rows = [(1, base), (2, base + " tail"), (3, words(rng, 50)), (3, words(rng, 50)), (None, base)]
    names = ["gone_id", "again_id", "mix_id", "mix_source", "mix_positions", "mix_row", "mix_no", "mix_position", "positions", "row_key", "n", "kept"]
    docs = documents(rows).withColumns({n: F.lit(n) for n in names})
    left = minhash.deduplicated(docs)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 3, None] and left.columns == docs.columns
    mixed = curriculum.mix(docs)
    assert mixed.columns == docs.columns and all(r[n] == n for r in mixed.collect() for n in names)
    kept = runindex.cleaned(docs)
    assert kept.columns == docs.columns and all(r[n] == n for r in kept.collect() for n in names)


def test_ids_of_a_batch_equal_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = __import__("random").Random(7)
    texts = ["", " \t\n", "Hello, world!", "don't we'll 12,5 x_y", "é" * 300, "漢字" * 50, "a\x0bb\x0cc", "<|endoftext|> x", "ÀB c.", " x y", "x" * 5000]
    texts += [" ".join(rng.choice(["aba", "Bcd.", "e,f", "(g)", "12", "h!", "naïve", "Áb"]) for _ in range(rng.randrange(40))) for _ in range(200)]
    encode = packing.Encoder(path)
    encode.memory = packing.Memory(limit=5)
    ids, lengths = encode.batch(pa.array(texts), 1)
    want = [[*e.ids, 1] for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(w) for w in want]
    assert ids.tolist() == np.concatenate(want).tolist()
    assert all(len(w) <= packing.LONGEST for w in encode.memory.young)
    none, zero = encode.batch(pa.array([], pa.string()), 1)
    assert len(none) == len(zero) == 0
