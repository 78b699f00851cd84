import hashlib
import random
import zlib

import pytest
from oracle import both

from tracequill.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def plain(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 * (1 if c >= 0 else -1))
        whole[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        inner = {p[:-1] for p in members if p}
        ids = ",".join(str(c) for c in sorted(c for c in convs if whole[c] == path))
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in under if p)
        children = sum(len(p) == len(path) + 1 for p in under)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children, sum(p not in inner for p in under), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


def made(seed):
    rng = random.Random(seed)
    say = lambda: (rng.choice(["user", "assistant", None]), rng.choice(["", "hi", "é" * 7, None, "long " * 50]))
    rows = []
    for c in [*range(0, 40), *range(100, 130), -5, -120, 205]:
        for k in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, rng.choice([k, k, k, None, 0]), *say(), "x"))
    for c in range(300, 360):  # copies, and a long path that all share
        rows += [(c, k, "user", f"turn {k}", "x") for k in range(12)] + ([(c, 12, "user", f"own {c % 9}", "x")] if c % 3 else [])
    rows += rows[:7] + [(None, 1, "user", "lost", "x")]
    return rows


@pytest.mark.parametrize("most", [4, 60, None])
def test_nodes_equal_brute_force(spark, most):
    """Groups of any size, split again and again; ties, nulls, copies, repeated rows and a clashing column."""
    rows = made(1)
    turns = spark.createDataFrame(rows, SCHEMA)
    assert result(prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.sequences(turns)), most)) == plain(rows)


def test_one_conversation_and_none(spark):
    rows = [(7, 1, "user", "a", ""), (7, 2, "user", "b", "")]
    turns = spark.createDataFrame(rows, SCHEMA)
    for some in (rows, []):
        df = turns if some else turns.limit(0)
        assert result(prefixtrie.nodes(prefixtrie.rebuilt(prefixtrie.sequences(df)))) == plain(some)


def test_many_ends_are_hashed_in_chunks(spark):
    own = spark.range(2_000).selectExpr("id * 3 - 900 AS conv_id", "IF(id % 5 = 0, 'rare', 'hot') AS seq")
    want = {s: hashlib.sha256(",".join(str(i * 3 - 900) for i in range(2_000) if (i % 5 == 0) == (s == "rare")).encode()).hexdigest() for s in ("rare", "hot")}
    assert {r.end_seq: r.ends_sha256 for r in prefixtrie.ends(own).collect()} == want


def test_query_equals_sql(spark, sf_dir):
    got, want = both(spark, sf_dir, prefixtrie.op13_prefix_trie, prefixtrie.OP13_SQL)
    assert got == want and len(got) > 40
