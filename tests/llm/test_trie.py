import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from barloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, place long, node string, path int"


def brute(sequences: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out = set()

    def below(k):
        stack, leaves, saved = [k], 0, 0
        while stack:
            x = stack.pop()
            leaves += not kids[x]
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
            stack += kids[x]
        return leaves, saved

    for k, m in list(members.items()):
        ends = ",".join(str(c) for c in sorted(m) if len(sequences[c]) == len(k))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]), *below(k), hashlib.sha256(ends.encode()).hexdigest()))
    return out


def sequences_of(rows) -> dict[int, list[tuple[str, str]]]:
    by = defaultdict(list)
    for c, turn, role, text in (r[:4] for r in rows):
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [t[-1] for t in sorted(x)] for c, x in by.items()}




def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "n", 1) for r in rows], SCHEMA)


def drawn(seed: int) -> list[tuple]:
    """Conversations that share turns of few texts, one of many turns, copies, null turns, roles and texts, ties, repeated rows."""
    draw, rows = random.Random(seed), []
    for c in range(60):
        for t in range(draw.randrange(1, 9)):
            rows.append((c * 3 % 50, t if draw.random() < 0.9 else None, draw.choice(["user", None, "assistant"]), draw.choice(["a", "é", "", None, "b" * 5000])))
    rows += [(400, t, "user", "a") for t in range(300)] + [(c, t, "user", "same") for c in range(500, 560) for t in range(3)]
    return rows + rows[:4] + [(None, 1, "user", "lost")]


def tuples(made):
    return [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in made.collect()]


@pytest.mark.parametrize("segment", [3, 4096])
def test_trie_equals_brute_force(spark, segment):
    rows = drawn(segment)
    got = tuples(trie.conversation_trie(table(spark, rows), segment))
    assert len(got) == len(set(got)) and set(got) == brute(sequences_of(rows))


def test_rebuilt_conversations(spark):
    rows = drawn(1) + [(-7, 1, "user", "below zero"), (9999, 1, "user", "no base")]
    own = sequences_of(rows)
    want = {c: (own.get(c - c % 5 if c >= 0 else c + -c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9 :]) for c in own}
    assert any(not x for x in want.values())  # one that has no turn at all
    got = tuples(trie.trie_of(*trie.rebuilt(trie.turns_of(table(spark, rows))), segment=5))
    assert set(got) == brute(want) and len(got) == len(set(got))


def test_empty_and_texts(spark):
    assert trie.conversation_trie(table(spark, [])).count() == 0
    assert trie.conversation_trie(table(spark, [(None, 1, "user", "x")])).count() == 0
    rows = drawn(2)[:150]
    nodes = trie.conversation_trie(table(spark, rows))
    own = sequences_of(rows)
    made = trie.node_turns(table(spark, rows), nodes).collect()
    assert len(made) == nodes.count() - 1
    assert all((r.role, r.text) == own[r.conv_id][r.depth - 1] for r in made)


def test_paths_are_few(spark):
    """A way down meets at most log2 of the conversations beginnings of paths."""
    rows = table(spark, drawn(3))
    turns = trie.placed(trie.turns_of(rows))
    named = trie.named(turns, 64)
    nodes, _ = trie.paths(named, trie.nodes_of(named), 0, 64)
    n = rows.select("conv_id").distinct().count()
    assert 1 <= nodes.agg({"level": "max"}).first()[0] <= n.bit_length()
