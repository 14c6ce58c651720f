import random

import numpy as np
import xxhash

from quillgraph.llm.simhash import TAU, allocate, dedup_documents, find_links, fingerprint, group_bits, masks, part_values

SCHEMA = "doc_id long, text string, fp string, component_id long"  # clashing extra columns


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= TAU:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def partition(groups):
    out = {}
    for node, root in groups.items():
        out.setdefault(root, set()).add(node)
    return {frozenset(x) for x in out.values()}


def test_fingerprint():
    for t in (None, "", "  ", "One", "one TWO", "a b c d e\tF g", "ÄB äb Éa " * 7, "x " * 5000):
        assert fingerprint(t) == brute_fingerprint(t)
    assert fingerprint("HELLO there you") == fingerprint("hello\nthere  you")


def test_allocation_keeps_the_sum():
    rng = np.random.default_rng(0)
    for m in (2, 3, 4, 5):
        widths = [64 // m + (k < 64 % m) for k in range(m)]
        sizes = rng.integers(1, 10_000, (200, m)).astype(float)
        plan = allocate(sizes, widths, 100_000, TAU)
        assert (plan.sum(1) == TAU - m + 1).all() and plan.min() >= -1


def test_pigeonhole_reaches_every_pair():
    rng = np.random.default_rng(1)
    parts = group_bits(rng.random((64, 64)), 4)
    x = rng.integers(0, 2**63, 300).astype(np.uint64)
    for _ in range(300):
        a = x[rng.integers(300)]
        b = np.uint64(int(a) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)))
        plan = allocate(rng.integers(1, 5000, (1, 4)).astype(float), [16] * 4, 10_000, TAU)[0]
        near = [(int(part_values(np.array([a]), p)[0]) ^ int(part_values(np.array([b]), p)[0])).bit_count() for p in parts]
        assert any(d <= t for d, t in zip(near, plan))
    assert len(masks(16, 2)) == 1 + 16 + 120


def test_links_with_dense_buckets_match_brute_force(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:4]:  # chains and rings around few centres
        for _ in range(120):
            x = b
            for _ in range(rnd.choice([1, 2, 3, 4, 6])):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    want = partition(brute_components(fps))
    df = spark.createDataFrame(signed, "fp long")
    for dense in (1000, 3):
        root = {f: f for f in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in find_links(df, TAU, dense).collect():
            a, b = a % (1 << 64), b % (1 << 64)
            assert (a ^ b).bit_count() <= TAU
            root[find(a)] = find(b)
        assert partition({f: find(f) for f in fps}) == want


def test_documents(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    rows = [(5, "a b c d", "x", 1), (3, "A B c D", "x", 1), (3, "A B c D", "x", 1), (9, None, None, None), (8, "", "", 0), (7, " \t", "", 0), (1, long, "", 0), (2, long.replace("w77 ", "w78 "), "", 0), (None, "q r s", "", 0)]
    out = dedup_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[5].component_id == by[3].component_id == 3
    assert by[9].component_id == by[8].component_id == by[7].component_id == 7 and by[9].fingerprint == "0" * 16
    assert by[1].component_id == by[2].component_id == 1
    assert by[1].fingerprint == f"{brute_fingerprint(long):016x}"


def test_empty(spark):
    assert dedup_documents(spark.createDataFrame([], SCHEMA)).collect() == []
