import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from postlake.llm import prefix_trie as P
from postlake.runtime import Scratch

TURNS = "conv_id long, turn long, role string, text string"
KEYS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()


def rebuilt(rows):
    """The contract's conversations, one turn after the other."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, digest(role, text), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]  # the remainder has the sign of c, as in SQL
    return out


def brute(conversations):
    nodes = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    sums = {}
    for path in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[path]) - 1) * len(path[-1][1]) if path else 0
        leaves, saved = (sum(sums[x][i] for x in children[path]) for i in (0, 1))
        sums[path] = (leaves or 1, saved + own)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children[path]), *sums[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, partitions=3):
    scratch = Scratch(spark, "trie")
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", depth int, length string").repartition(partitions)
    got = P.prefix_trie(*P.with_shared_beginnings(P.ordered_turns(df, scratch), scratch), scratch)
    assert tuple(got.columns) == KEYS
    return sorted(map(tuple, got.collect()), key=str)


def some_rows(seed=1, convs=260, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(450), convs):
        script = rng.randrange(4)
        for t in range(rng.randrange(1, longest)):
            text = f"s{script} t{t} é" if rng.random() < 0.85 else f"c{c} t{t}"
            rows.append((c, t, "user" if t % 2 else "assistant", text))
    rng.shuffle(rows)
    return rows


ODD = [(0, None, None, None), (0, 1, "user", None), (0, 1, "user", "b"), (0, 1, "user", "b"), (1, 5, "", "x" * 70_000), (None, 0, "user", "lost"), (7, None, "user", "a"), (7, None, "user", "b"), (-3, 0, "u", "neg"), (-100, 0, "u", "neg"), (108, 0, "user", "日本"), (108, 1, "use", "rx")]


def test_matches_brute_force(spark):
    rows = some_rows()
    want = brute(rebuilt(rows))
    assert found(spark, rows, 7) == want
    assert len(want) > 300 and any(r[3] > 100 for r in want)


def test_odd_rows(spark):
    assert found(spark, ODD) == brute(rebuilt(ODD))


def test_no_rows_and_turnless_conversations(spark):
    assert found(spark, []) == []
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6)  # no base, and all its turns go
    assert found(spark, [(c, 0, "user", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize("block, piece", [(1, 0), (2, 3)])
def test_long_conversations_go_by_blocks(spark, monkeypatch, block, piece):
    """One conversation holds a third of all turns, and others share its beginning."""
    monkeypatch.setattr(P, "BLOCK", block)
    monkeypatch.setattr(P, "PIECE", piece)
    rows = some_rows(2, 60, 9)
    rows += [(c, t, "user", f"long {t}" if t < 40 + c else f"own {c} {t}") for c in (600, 601, 602) for t in range(64 + c % 3)]
    assert found(spark, rows, 5) == brute(rebuilt(rows))


def test_a_third_of_all_turns_in_one_conversation(spark):
    rows = [(500, t, "user", f"long {t}") for t in range(9_000)] + [(c, t, "user", f"long {t}") for c in range(501, 530) for t in range(c % 7)]
    got = found(spark, rows, 6)
    assert got == brute_chain(rows)


def brute_chain(rows):
    """``brute`` for one long chain: paths by their digest."""
    conversations = rebuilt(rows)
    nodes, text, up = defaultdict(list), {}, {}
    for c, turns in conversations.items():
        key = b""
        nodes[key].append(c)
        for t in turns:
            up[new := hashlib.sha256(key + repr(t).encode()).digest()] = key
            key = new
            nodes[key].append(c)
            text[key] = len(t[1])
    depth = {b"": 0}
    for k in nodes:
        stack = []
        while k not in depth:
            stack.append(k)
            k = up[k]
        for x in reversed(stack):
            depth[x] = depth[up[x]] + 1
    children, sums = defaultdict(list), {}
    for k, u in up.items():
        children[u].append(k)
    for k in sorted(nodes, key=depth.get, reverse=True):
        leaves, saved = (sum(sums[x][i] for x in children[k]) for i in (0, 1))
        sums[k] = (leaves or 1, saved + (len(nodes[k]) - 1) * text.get(k, 0))
    ends = lambda k: ",".join(str(c) for c in sorted(nodes[k]) if len(conversations[c]) == depth[k])
    return sorted(((min(m), depth[k], min(nodes[up[k]]) if k else None, len(m), len(children[k]), *sums[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k, m in nodes.items()), key=str)
