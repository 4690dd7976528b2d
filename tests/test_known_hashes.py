"""Digests at any depth of a document, against a plain recursion."""

import json
import random
import re

from trueframe.sources import flatten


def plain(value):
    found = set()
    if isinstance(value, list):
        for item in value:
            found |= plain(item)
    if isinstance(value, dict):
        path, digest, source = (value.get(k) for k in ("path", "sha256", "cgiSourceSha256"))
        names = [digest] if isinstance(path, str) and re.search(r"(?i)\.(mp4|mov|mkv)\Z", path) else []
        found |= {d for d in [*names, source] if isinstance(d, str) and re.fullmatch(r"[0-9a-f]{64}", d)}
        for item in value.values():
            found |= plain(item)
    return found


def tree(rng, depth):
    kind = rng.random()
    if depth == 0 or kind < 0.15:
        return rng.choice([None, 3, 2.5, True, "x.mp4", "f" * 64, "", []])
    if kind < 0.5:
        return [tree(rng, depth - 1) for _ in range(rng.randrange(4))]
    out = {f"k{i}": tree(rng, depth - 1) for i in range(rng.randrange(3))}
    digest = "".join(rng.choice("0123456789abcdef") for _ in range(64))
    if rng.random() < 0.7:
        out["path"] = rng.choice(["a.mp4", "dir/B.MOV", "c.mkv", "d.txt", 7, None, "e.mp4\n", ["x.mp4"]])
        out["sha256"] = rng.choice([digest, digest, digest.upper(), digest[1:], 12, None, {"sha256": digest, "path": "in.mp4"}])
    if rng.random() < 0.3:
        out["cgiSourceSha256"] = rng.choice([digest[::-1], digest + "0", 5, [digest]])
    return out


def test_equals_a_recursion_over_every_document(spark):
    rng = random.Random(4)
    docs = [tree(rng, rng.randrange(1, 9)) for _ in range(300)]
    chain = {"path": "deep.mkv", "sha256": "9" * 64}
    for level in range(150):
        chain = [chain] if level % 2 else {"next": chain, "brackets": "[[{{"}
    docs.append(chain)
    texts = [json.dumps(d) for d in docs]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "no json {"), (-3, "")], "n long, document string")
    want = set().union(*map(plain, docs))
    got = [r.sha256 for r in flatten.known_hashes(df).collect()]
    assert len(want) > 150 and "9" * 64 in want
    assert len(got) == len(set(got)) and set(got) == want
    assert {r.n for r in flatten.unreadable_documents(df, "n").collect()} == {-2, -3}


def test_a_repeated_name_keeps_its_last_value(spark):
    df = spark.createDataFrame([('{"path":"a.txt","path":"a.mp4","sha256":"%s","sha256":"%s"}' % ("1" * 64, "2" * 64),)], "document string")
    assert [r.sha256 for r in flatten.known_hashes(df).collect()] == ["2" * 64]
    assert flatten.known_hashes(df.limit(0)).collect() == []
