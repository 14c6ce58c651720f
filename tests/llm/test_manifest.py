import hashlib
import random
import zlib
from functools import reduce
from operator import or_

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillgraph.llm import manifest as m
from quillgraph.llm.manifest import TOP, Forest, beside, fold_range, folded, paths, proved_documents, siblings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, part long, leaf long"
H = lambda s: hashlib.sha256(s.encode()).hexdigest()


def tree(leaves):
    """(levels of a whole tree, proof and side of each leaf)."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([H("".join(x[k : k + 2])) for k in range(0, len(x), 2)])
    return levels


def proof(levels, i):
    out = []
    for x in levels[:-1]:
        if i ^ 1 < len(x):
            out.append((i % 2, x[i ^ 1]))
        else:
            out.append((0, ""))
        i //= 2
    return out


def brute(rows):
    f = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, more=0: H(f(r[0]) + f(r[3]) + f(r[2]) + f(None if r[4] is None else r[4] + more) + f(r[1]))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([leaf(r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))):
            steps = proof(trees[g], i) + proof(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(r, 1) if tampered else leaf(r)
            for right, sibling in steps:
                h = H(sibling + h if right else h + sibling)
            root = top[-1][0]
            out.append((r[0], leaf(r), trees[g][-1][0], root, H("".join(s for _, s in steps)), h, h == root))
    return sorted(out, key=str)


@given(st.integers(1, 70), st.lists(st.integers(0, 70), max_size=6), st.randoms())
def test_monoid_in_any_cut_and_order(n, cuts, rnd):
    leaves = [H(str(k)) for k in range(n)]
    at = sorted({0, n, *(c for c in cuts if c < n)})
    sizes = {0: n, TOP: 1}
    parts = [Forest(fold_range(0, a, leaves[a:b], n) if b - a < n else {(0, 0, k): leaves[k] for k in range(n)}, sizes) for a, b in zip(at, at[1:])]
    rnd.shuffle(parts)
    while len(parts) > 1:  # any shape of merges
        k = rnd.randrange(len(parts) - 1)
        parts[k : k + 2] = [parts[k] | parts[k + 1]]
    assert parts[0].nodes == {(TOP, 0, 0): tree(leaves)[-1][0]}
    assert (parts[0] | Forest(leaves=sizes)).nodes == parts[0].nodes


@given(st.integers(1, 70), st.data())
def test_ranges_of_leaves_keep_few_nodes_and_prove_themselves(n, data):
    a = data.draw(st.integers(0, n - 1))
    b = data.draw(st.integers(a + 1, n))
    leaves = [H(str(k)) for k in range(n)]
    levels = tree(leaves)
    left = fold_range(0, a, leaves[a:b], n)
    assert len(left) <= 2 * len(levels) and left == reduce(or_, [Forest({(0, 0, k): leaves[k]}, {0: n, 5: 9, TOP: 2}) for k in range(a, b)]).nodes or b - a == n
    assert all(levels[lv][k] == v for (_, lv, k), v in left.items())
    outside = beside(a, b, n)
    assert len(outside) <= 2 * len(levels)
    top, own = paths(a, leaves[a:b], n, {p: levels[p[0]][p[1]] for p in outside})
    assert top == levels[-1][0]
    for k, path in zip(range(a, b), own, strict=True):
        assert list(siblings(path)) == [s for _, s in proof(levels, k)]
        assert folded(leaves[k], path) == top and (n == 1 or folded(H("x"), path) != top)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("leaves", [7, 50_000])
def test_against_brute_force(spark, monkeypatch, leaves):
    monkeypatch.setattr(m, "LEAVES", leaves)
    monkeypatch.setattr(m, "FAN_IN", 3)
    rnd = random.Random(4)
    rows = [(i, f"text {i} é", rnd.choice(["en", "en", "de", "", None]), rnd.choice([None, "s", ""]), rnd.choice([None, 5, 7, 2**63 - 1])) for i in range(150)]
    rows += [(7, "same", "en", "s", 4)] * 60 + [(None, None, None, None, None)] * 3 + [(None, "a", "en", None, 1), (500, "", "one", "s", 0), (500, "b" * 100_000, "two", "s", 0)]
    df = spark.createDataFrame([(*r, "k", 0, 1) for r in rows], SCHEMA).repartition(6)
    out = proved_documents(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    found = got(out)
    assert found == brute(rows)
    assert any(not r[-1] for r in found) and any(r[-1] for r in found)


def test_many_groups_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(m, "LEAVES", 20)
    rows = [(i, "t", f"lang{i % 97}", "s", i) for i in range(200)]
    assert got(proved_documents(spark.createDataFrame([(*r, "", 0, 0) for r in rows], SCHEMA))) == brute(rows)
    assert got(proved_documents(spark.createDataFrame([(*rows[0], "", 0, 0)], SCHEMA))) == brute(rows[:1])
    assert got(proved_documents(spark.createDataFrame([], SCHEMA))) == []
