import random

from quillgraph.llm import jaccard, simhash, stages

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def sets(text, k=5):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_stage_merges_similar_texts(spark):
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(5000)}" for _ in range(r.choice([30, 60, 150]))) for _ in range(60)]
    for t in texts[:20] + texts[:1] * 40:  # one group larger than a small bucket
        w = t.split()
        for _ in range(max(1, len(w) // 60)):
            w[r.randrange(len(w))] = f"new{r.randrange(99)}"
        texts.append(" ".join(w))
    texts += ["", None, "a b", "a b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS)
    kept = {x.doc_id for x in stages.drop_near_duplicates(spark, docs, "").collect()}
    fps, shingles, root = [simhash.fingerprint(t) for t in texts], [sets(t or "") for t in texts], list(range(len(texts)))
    wide = 0
    for i in range(len(texts)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            alike = a and b and len(a & b) / len(a | b) >= 0.8
            wide += bool(alike) and (fps[i] ^ fps[j]).bit_count() > 3
            if alike or (fps[i] ^ fps[j]).bit_count() <= 3:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if x == old else x for x in root]
    assert wide > 20 and kept == set(root)


def test_jaccard_is_exact():
    a, b = "a b c d e f g h", "a b c d e f g x"
    assert jaccard.jaccard(jaccard.shingle_hashes(a), jaccard.shingle_hashes(b)) == len(sets(a) & sets(b)) / len(sets(a) | sets(b))
    assert len(jaccard.shingle_hashes(None)) == 0 and len(jaccard.shingle_hashes("a b")) == 1


def test_recall_in_large_buckets(spark):
    """Groups of hundreds of variants and a long drift: of the true pairs, found by brute
    force, 95 of 100 at least end in one component."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(5000)}"
    texts = []
    for _ in range(2):  # variants of one text, alike or just not
        base = [word() for _ in range(150)]
        for _ in range(150):
            w = list(base)
            for _ in range(r.randint(1, 3)):
                w[r.randrange(150)] = word()
            texts.append(" ".join(w))
    drift = [word() for _ in range(100)]
    for _ in range(150):  # each like its neighbours alone
        drift[r.randrange(100)] = word()
        texts.append(" ".join(drift))
    texts = sorted(set(texts))
    docs = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(5)
    links = jaccard.jaccard_links(jaccard.with_keys(docs, ["row"]), docs).collect()
    fps = [simhash.fingerprint(t) for t in texts]
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    root = {f: f for f in signed}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    shingles = [sets(t) for t in texts]
    true = [(i, j) for i in range(len(texts)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j])]
    found = sum(find(signed[i]) == find(signed[j]) for i, j in true)
    assert len(true) > 5000 and found >= 0.95 * len(true), (found, len(true))
    wrong = [(a, b) for a, b in links if all(len(shingles[i] & shingles[j]) < 0.8 * len(shingles[i] | shingles[j]) for i in range(len(texts)) if signed[i] == a for j in range(len(texts)) if signed[j] == b)]
    assert wrong == []
