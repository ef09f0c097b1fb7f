"""The conversation trie against a dictionary of prefixes; odd rows, copies, long conversations, empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerloom.llm import trie
from ledgerloom.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ROWS = T.StructType([T.StructField(n, k) for n, k in (
    ("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("conv", T.StringType()),
    ("depth", T.StringType()), ("id", T.StringType()), ("n", T.StringType()))])


@pytest.fixture
def chats_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "a", "b", None, "c") for r in rows], ROWS).repartition(3)


def plain(rows):
    """Sorted node rows, from a dictionary of prefixes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - c % 20, [])[:h] + own[h:])
    number, last, depth, above, members, ends = {}, [""], [0], [None], [[]], [[]]  # a node's number from its parent's and its turn
    for c, ts in sorted(built.items()):
        at = 0
        members[0].append(c)
        for turn in ts:
            if (at, turn) not in number:
                number[at, turn] = len(last)
                for column, value in ((last, turn[1]), (depth, depth[at] + 1), (above, at), (members, []), (ends, [])):
                    column.append(value)
            at = number[at, turn]
            members[at].append(c)
        ends[at].append(c)
    children = [0] * len(last)
    for up in above[1:]:
        children[up] += 1
    leaves, saved = [not n for n in children], [(len(m) - 1) * len(WORD.findall(t)) for m, t in zip(members, last)]
    for at in reversed(range(1, len(last))):  # a parent has a smaller number
        leaves[above[at]] += leaves[at]
        saved[above[at]] += saved[at]
    return sorted((min(m), depth[k], None if above[k] is None else min(members[above[k]]), len(m), children[k], int(leaves[k]), saved[k],
                   hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in enumerate(members))


def nodes(frame):
    return sorted(tuple(r) for r in trie.conversation_trie(frame).collect())


def test_trie_equals_dictionary_on_table(spark):
    chats = read(spark, "/root/testdata/sf0.01", "conversations")
    assert nodes(chats) == plain([tuple(r) for r in chats.collect()])


def odd():
    return [(0, 0, "user", "a b"), (0, 1, None, None), (0, None, "user", "first"), (None, 0, "user", "x"), (1, 5, "user", ""),
            (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 0, "user", "other"), (3, None, None, None), (21, 0, "user", "lonely"),
            (-7, 1, "user", "minus"), (-20, 0, "user", "base"), (40, 1, "assistant", "long " * 20_000), (41, 0, "user", "x"), (42, 0, "user", "x")]


def copies(first):
    rng, rows = random.Random(2), []
    for c in range(first, first + 400):
        kind = c % 4
        opening = [("user", "hello there")] if kind else []
        body = [("user", "copied"), ("assistant", "many times over")] if kind == 1 else [
            (rng.choice(["user", "assistant"]), rng.choice(["a", "b b", "c c c"])) for _ in range(rng.randint(0, 6))]
        rows += [(c, k, *t) for k, t in enumerate(opening + body)]
    return rows


def long_ones(first):
    block, rows = trie.BLOCK, []
    words = lambda k: ("user", f"turn {k}")
    for c, length in enumerate([block, block, block + 1, 2 * block, 2 * block + 5, 3 * block, 3 * block]):
        rows += [(first + c * 20, k, *words(k)) for k in range(length)]
    rows += [(first + 1000, k, "user", f"own {k}") for k in range(4000)]  # most rows are in one conversation
    rows += [(first + 1020, k, *(words(k) if k < block + 3 else ("user", f"branch {k}"))) for k in range(2 * block)]
    return rows + [(first + 1040, k, "user", f"turn {k}") for k in range(block)] + [(first + 1040, block, "user", "off")]


def test_odd_rows_copies_and_long_conversations(chats_of):
    rows = odd() + copies(10_000) + long_ones(20_000)
    assert nodes(chats_of(rows)) == plain(rows)


def test_turnless_only_and_empty(chats_of):
    turnless = [c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 >= 2]
    rows = [(c, 0, "user", "gone") for c in turnless]
    assert nodes(chats_of(rows)) == plain(rows) and plain(rows)[0][:2] == (min(turnless), 0)
    assert nodes(chats_of([(None, 0, "user", "x")])) == []


def test_order_and_common_prefixes_equal_sorting():
    rng = random.Random(8)
    ids = [bytes([k]) * trie.WIDTH for k in range(3)]
    sequences = [tuple(rng.choice(ids[:2]) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in range(200)]
    sequences += [sequences[5]] * 30 + [tuple(ids[:1] * n) for n in (60, 64, 64, 70, 128, 129, 200)]
    conv = np.array(rng.sample(range(10_000), len(sequences)))
    trimmed = np.zeros(len(sequences), bool)
    order, common = trie.ranked([b"".join(s) for s in sequences], trimmed, conv)
    assert order.tolist() == sorted(range(len(sequences)), key=lambda i: (sequences[i], conv[i]))
    for place in range(1, len(order)):
        a, b = sequences[order[place - 1]], sequences[order[place]]
        assert common[place] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
