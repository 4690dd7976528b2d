import hashlib
import random

from trueframe.llm import chat
from trueframe.llm.common import written

SCHEMA = "conv_id long, turn long, role string, text string, segment string, loss int"


def make(work, rows):
    return work.createDataFrame([(*r, "other", 3) for r in rows], SCHEMA).repartition(3)


def plain(rows):
    out = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        turns, loss, n = out.get(conv, ("", "", 0))
        out[conv] = (turns + f"{role or ''}\n{text or ''}\n", loss + ((text or "") if role == "assistant" else ""), n + 1)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {c: (n, sha(t), len(x), sha(x)) for c, (t, x, n) in out.items()}


def digests(work, rows):
    found = chat.read_digests(written(chat.format_chats(make(work, rows)), "chat")).collect()
    assert len(found) == len({r.conv_id for r in found})
    return {r.conv_id: r for r in found}


def test_round_trip_of_hostile_texts(work):
    rng = random.Random(1)
    bits = [*chat.INSTRUCT.control, "\\", "/", "<", ">", "[", "]", "s", "\n", "é", "😀", "INST", "<<", "|", "\r", " "]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    roles = ["user", "assistant", "system", "tool", "", None, "<|text|>", "a\\"]
    rows = [(c, t, rng.choice(roles), rng.choice([text(), text(), None])) for c in range(120) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "lost"), (500, None, "user", "no turn"), (500, 1, "assistant", "b"), (500, 1, "assistant", "b")]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = digests(work, rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == plain(rows)


def test_machine_flags_what_it_does_not_allow(work):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", "u"),
            (2, 0, "assistant", "a"), (3, 0, "user", "u"), (3, 1, "user", "u"), (4, 0, "robot", "r")]
    assert {c: r.valid for c, r in digests(work, rows).items()} == {1: True, 2: False, 3: False, 4: False}


def test_segments_and_loss_flags(work):
    got = chat.format_chats(make(work, [(1, 0, "user", "a\\b"), (1, 1, "assistant", "</s>")])).orderBy("segment").collect()
    assert [(r.text, r.loss) for r in got] == [("[INST]", False), ("a\\\\b", False), ("[/INST]", False), ("<s>", False), ("<\\/s>", True), ("</s>", False)]


def test_long_conversation_and_text(work):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i} ") for i in range(3000)] + [(2, 0, "user", "x" * 300_000)]
    got = digests(work, rows)
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == plain(rows)
    assert got[1].valid and got[2].formatted_chars == 300_013


def test_empty_table(work):
    assert digests(work, []) == {}
