import hashlib
import random
import re
from zlib import crc32

import pytest

from attesta.llm.contraction import subtree_totals
from attesta.llm.trie import grafted, numbered_turns, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, key int"


def by_hand(rows):
    """The nodes of rebuilt conversations by plain dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in own.items() if c is not None}
    full = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 4
        full[c] = tuple(own.get(c - int(c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
    members = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    out = []
    for k, who in members.items():
        below = [x for x in members if x[:len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        leaves = [x for x in below if not any(y[:-1] == x for y in members if y)]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(c for c in who if full[c] == k))
        out.append((min(who), len(k), min(members[k[:-1]]) if k else None, len(who), len(kids), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def nodes_of(spark, rows):
    convs = spark.createDataFrame([(*r, "mine", 1) for r in rows], TURNS)
    return sorted((tuple(r) for r in prefix_trie(*grafted(numbered_turns(convs))).collect()), key=str)


def test_equals_dictionaries(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a b", "c", "a  b\tc\x0bd", "", None, "é ü\x1fz"]))
            for c in [*range(45), 100, 3_000_000_000] for t in range(rng.randint(1, 5)) if c != 20]
    rows += [(c, t, None, "same") for c in range(200, 215) for t in range(6)]  # one group of copies
    rows += [(7, None, "user", "first"), (7, None, "user", "first"), (9, 1, "bot", "tie"), (9, 1, "bot", "tie 2")]
    rows += [(None, 1, "user", "nobody's"), (-5, 0, "user", "a b"), (50, 0, None, "x" * 100_000), (50, 1, None, None)]
    rng.shuffle(rows)
    assert nodes_of(spark, rows) == by_hand(rows)


def test_one_long_conversation_and_turnless_ones(spark):
    rows = [(40, t, "user", f"turn {t % 7}") for t in range(60)]
    rows += [(c, t, "user", "cut off") for c in (1, 2, 5, 61) for t in range(2)]  # no conversation 0 or 60
    assert nodes_of(spark, rows) == by_hand(rows)


def test_no_conversations(spark):
    assert nodes_of(spark, []) == []
    assert nodes_of(spark, [(None, 1, "user", "x")]) == []


def shapes():
    rng = random.Random(4)
    chain = [(i, i - 1 if i else None) for i in range(400)]
    star = [(0, None)] + [(i, 0) for i in range(1, 300)]
    broom = chain[:200] + [(200 + i, 199) for i in range(100)] + [(300 + i, 250 + i // 3) for i in range(60)]
    wild = [(i, rng.randrange(max(0, i - 4), i) if i else None) for i in range(300)]
    forest = [(i, None) for i in range(3)] + [(i, rng.randrange(i)) for i in range(3, 200)]
    return {"chain": chain, "star": star, "broom": broom, "wild": wild, "forest": forest, "none": []}


@pytest.mark.parametrize("shape", list(shapes()))
def test_totals_of_any_shape(spark, shape):
    rng = random.Random(1)
    names = rng.sample(range(-10**12, 10**12), 1000)
    rows = [(names[i], None if p is None else names[p], rng.choice([None, rng.randint(-5, 9)]), i) for i, p in shapes()[shape]]
    want = {i: [v or 0, place] for i, _, v, place in rows}
    for i, p, _, _ in reversed(rows):
        if p is not None:
            want[p] = [a + b for a, b in zip(want[p], want[i])]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "id long, parent long, v long, w long, kids string")
    got = subtree_totals(df, ["v", "w"]).collect()
    assert {r["id"]: [r["v"], r["w"]] for r in got} == want and len(got) == len(rows)


def test_a_cycle_is_an_error(spark):
    df = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (4, None, 1)], "id long, parent long, v long")
    with pytest.raises(ValueError, match="own ancestors"):
        subtree_totals(df, ["v"])
