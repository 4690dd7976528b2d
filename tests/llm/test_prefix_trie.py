import hashlib
import random
import zlib

import pytest

from trueframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, ids string, node string, range string"


def turn_order(row):
    turn, role, text = row
    digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    return turn is not None, turn or 0, role, digest


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=turn_order)] for c, v in own.items()}
    built = {c: own.get(c - c % 5, [])[:zlib.crc32(str(c).encode()) % 9] + v[zlib.crc32(str(c).encode()) % 9:] for c, v in own.items()}
    nodes, kids = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes.setdefault(tuple(v[:d]), []).append(c)
    for n in nodes:
        if n:
            kids[n[:-1]] = kids.get(n[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for n in nodes:
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in kids
            saved[n[:d]] += (len(nodes[n]) - 1) * len(n[-1][1].encode()) if n else 0
    return sorted(((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), kids.get(n, 0), leaves[n], saved[n],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(n)).encode()).hexdigest())
                   for n, m in nodes.items()), key=str)


def talks(seed, n=300):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        for t in range(rng.choice([1, 1, 2, 4, 9, 14])):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]),
                         rng.choice(["a", "b"] * 6 + ["é" * rng.randrange(9), None, "", f"x{rng.randrange(500)}"])))
    # one first turn, and one whole conversation, that many share
    for c in range(400, 520):
        rows += [(c, 0, "user", "same"), (c, 1, "assistant", "same")] + ([(c, 2, "user", str(c))] if c % 3 == 0 else [])
    return rows + [(None, 1, "user", "q"), (7, 2, "user", "twice"), (7, 2, "user", "twice")]


@pytest.mark.parametrize("turns, block", [(200_000, 65_536), (40, 3), (7, 1)])
def test_equals_the_definition(work, monkeypatch, turns, block):
    """Whole in one range, and cut into many, with shared nodes over several borders."""
    monkeypatch.setattr(prefix_trie, "RANGE_TURNS", turns)
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = talks(turns)
    df = work.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    assert sorted(map(tuple, prefix_trie.prefix_trie(df).collect()), key=str) == plain(rows)


def test_empty_and_turnless(work):
    none = work.createDataFrame([], SCHEMA)
    assert prefix_trie.prefix_trie(none).collect() == []
    convs = work.createDataFrame([(3, [], []), (1, [], [])], "conv_id long, ids array<binary>, sizes array<long>")
    both = hashlib.sha256(b"1,3").hexdigest()
    assert [tuple(r) for r in prefix_trie.trie(convs).collect()] == [(1, 0, None, 2, 0, 1, 0, both)]


def test_layouts_grow():
    rng = random.Random(2)
    for count in (3, 4, 5, 16, 17, 48, 49, 256):
        node = prefix_trie.Inner(b"")
        order = rng.sample(range(256), count)
        for b in order:
            node.put(b, prefix_trie.Leaf(bytes([b]), b))
        node.put(order[0], prefix_trie.Leaf(b"new", 999))
        assert node.size == next(s for s in (4, 16, 48, 256) if s >= count)
        assert [c.first for c in node.children()] == [999 if b == order[0] else b for b in sorted(order)]
        assert node.find(order[0]).path == b"new"
        assert all((node.find(b) is None) == (b not in order) for b in range(256))


def test_paths_are_shared_and_split():
    tree = prefix_trie.RadixTree()
    keys = sorted([b"a" * 16, b"a" * 32, b"a" * 20 + b"b" * 12, b"", b"a" * 16 + b"c" * 32])
    for row, key in enumerate(keys):
        tree.insert(key, row)
    depth, first, last = prefix_trie._turn_nodes(tree)
    # no node inside an id, though "a" * 20 is where two keys part
    assert list(zip(depth.tolist(), first.tolist(), last.tolist())) == [(0, 0, 4), (1, 1, 4), (2, 2, 2), (2, 3, 3), (2, 4, 4), (3, 4, 4)]
