import random

import pytest

from quillgraph.llm import jaccard, simhash


@pytest.mark.parametrize("cell", [1000, 7])
def test_large_buckets_are_exact(spark, monkeypatch, cell):
    """Pairs of twins that share all band keys with all other texts and are similar to
    none of them: no bucket is small and few twins are anchors."""
    monkeypatch.setattr(jaccard, "CELL", cell)
    r = random.Random(9)
    base = [f"w{i}" for i in range(600)]
    keys = jaccard.band_keys(jaccard.shingle_hashes(" ".join(base))).tolist()
    edits = []  # that leave all band keys as they are
    for at in range(0, 600):
        w = list(base)
        w[at] = f"x{at}"
        if jaccard.band_keys(jaccard.shingle_hashes(" ".join(w))).tolist() == keys:
            edits.append(at)
    texts = []
    while len(texts) < 120:
        w, some = list(base), sorted(r.sample(edits, 13))
        if min(b - a for a, b in zip(some, some[1:])) < 5:
            continue
        extra = r.choice(some)
        for at in some:
            if at != extra:
                w[at] = f"x{at}"
        texts.append(" ".join(w))
        w[extra] = f"x{extra}"
        texts.append(" ".join(w))
    assert all(jaccard.band_keys(jaccard.shingle_hashes(t)).tolist() == keys for t in texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    links = {tuple(x) for x in jaccard.jaccard_links(jaccard.with_keys(docs, ["row"]), docs).collect()}
    hashes, fps = [jaccard.shingle_hashes(t) for t in texts], [simhash.fingerprint(t) for t in texts]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a % 2**64)] = find(b % 2**64)
    true = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard.jaccard(hashes[i], hashes[j]) >= 0.8]
    assert 60 <= len(true) < 500 and [(i, j) for i, j in true if find(fps[i]) != find(fps[j])] == []


def test_unlike_pairs_that_share_shingles_become_no_rows(spark, monkeypatch):
    """Variants of one text that share most shingles and are less similar than 0.8: nearly
    all pairs meet by a shingle, few are kept to be verified, and all true ones are."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    while len(texts) < 240:
        w = list(base)
        for at in r.sample(range(150), r.choice([3, 4, 5])):
            w[at] = f"x{r.randrange(10**9)}"
        texts += [" ".join(w), " ".join([*w[:-1], f"y{len(texts)}"])] if len(texts) < 60 else [" ".join(w)]
    docs = spark.createDataFrame([(k, [5], t) for k, t in enumerate(texts)], "key long, bands array<long>, text string")
    hashes = [jaccard.shingle_hashes(t) for t in texts]
    sets = spark.createDataFrame([(k, bytearray(h.astype("uint32").tobytes())) for k, h in enumerate(hashes)], "key long, shingles binary")
    large = docs.selectExpr("bands[0] as bucket", "key")
    none = spark.createDataFrame([], "node long, component long")
    met = {(x.a, x.b) for x in jaccard.apart(large, none, sets, 0.8).collect()}
    true = {(i, j) for i in range(len(texts)) for j in range(i) if jaccard.jaccard(hashes[i], hashes[j]) >= 0.8}
    assert len(true) >= 30 and true <= met and len(met) < 0.2 * len(texts) * (len(texts) - 1) / 2, (len(true), len(met))


def test_parity_maps_bound_the_difference():
    r = random.Random(6)
    for n in (1, 30, 3000):
        a, b = ({r.randrange(1 << 32) for _ in range(n)} for _ in range(2))
        b |= set(list(a)[: n // 2])
        one, two = (jaccard.parity_map(jaccard.np.array(sorted(x), dtype="uint32")) for x in (a, b))
        assert len(one) == jaccard.WORDS and sum(int(x).bit_count() for x in (one ^ two).view("uint64")) <= len(a ^ b)
