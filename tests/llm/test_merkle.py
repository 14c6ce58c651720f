import hashlib
import random

from quillgraph.llm import merkle
from quillgraph.llm.merkle import changed_sections, edited, fingerprint, fingerprint_documents, likeness, passages

SCHEMA = "doc_id long, text string, fingerprint string, kind int, part int"
rnd = random.Random(2)


def prose(n):
    return "".join(rnd.choice(["alpha ", "beta ", "gamma. ", "delta, ", "eps!\n", f"w{rnd.randrange(999)} "]) for _ in range(n))


def test_passages_cover_the_text():
    for t in ["", "a", "...", "\n\n", "a.b.c", "x" * 1000, " . . ", prose(500)]:
        assert "".join(passages(t)) == t and all(passages(t))


def test_likeness():
    a, b = prose(400), prose(400)
    assert fingerprint(a) == fingerprint(a) != fingerprint(b)
    assert likeness(fingerprint(a), fingerprint(a)) == 1 and likeness(fingerprint(None), fingerprint("")) == 1
    assert likeness(fingerprint(a), fingerprint("")) == 0
    near, far = likeness(fingerprint(a), fingerprint(edited(a, b))), likeness(fingerprint(a), fingerprint(b))
    assert 0.5 < near < 0.75 and far < 0.3


def test_levels_compare():
    a = prose(6000)
    half = a[: len(a) // 2]
    fa, fh = fingerprint(a), fingerprint(half)
    assert fa.split(":")[2] != fh.split(":")[2] and 0.55 < likeness(fa, fh) < 0.72 and len(fa) < 3000


def test_changes_are_located():
    """In many texts, also around a change of level: the place, and little besides."""
    rnd = random.Random(11)
    for words in [*range(880, 920, 2), 60, 5000]:
        check_location(rnd, words)


def check_location(rnd, words):
    a = "".join(f"Word {rnd.randrange(10**6)} and {rnd.random()} end. " for _ in range(words))
    at = len(a) // 2
    b = a[:at] + "An inserted sentence. " + a[at:]
    spans = changed_sections(fingerprint(a), fingerprint(b))
    assert spans and any(s <= at <= e for s, e in spans) and sum(e - s for s, e in spans) < len(a) / 4
    assert changed_sections(fingerprint(a), fingerprint(a)) == []


def test_borders_follow_content():
    r = random.Random(4)
    words = " ".join(f"w{r.randrange(9999)}" for _ in range(3000))
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000))
    for t in (words, letters):
        assert likeness(fingerprint(t), fingerprint("xy" + t)) > 0.9
        assert likeness(fingerprint(t), fingerprint(t[:5000] + "xy" + t[5000:])) > 0.9


def brute(rows):
    rows = sorted(rows, key=lambda r: (-r[0], r[1] or ""))
    out = {}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        e = edited(t, nxt)
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e), likeness(fingerprint(t), fingerprint(e)), likeness(fingerprint(t), fingerprint(nxt)))
    return out


def test_documents(spark):
    rows = [(i, prose(rnd.choice([0, 1, 5, 80]))) for i in range(200)] + [(500, None), (501, ""), (502, "é" * 100_000)]
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    out = {r.doc_id: tuple(r)[1:] for r in fingerprint_documents(df).collect()}
    assert out == brute(rows)


def test_hot_and_missing_ids(spark):
    """An id, or no id, on a third of the rows: every row follows the order once."""
    rows = [(i * 3 - 100, prose(3)) for i in range(100)] + [(50, prose(2)) for _ in range(60)] + [(None, prose(2)) for _ in range(60)]
    out = fingerprint_documents(spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)).collect()
    assert len(out) == len(rows) and sorted(len(t) for _, t in rows) == sorted(r.n_chars for r in out)
    h = {t: x for t, x in spark.createDataFrame([(t,) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]], r[1]))
    want = [(t and hashlib.sha256(edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (_, t) in enumerate(order)]
    assert sorted(want) == sorted(r.edited_sha256 for r in out)


def test_one_row_repeats_and_empty(spark):
    one = fingerprint_documents(spark.createDataFrame([(7, "abcdef", "", 0, 0)], SCHEMA)).collect()
    assert [(r.doc_id, r.near_next, r.edited_sha256) for r in one] == [(7, 1.0, hashlib.sha256(b"abcdab").hexdigest())]
    many = fingerprint_documents(spark.createDataFrame([(7, "abcdef", "", 0, 0)] * 4 + [(None, "zzz", "", 0, 0)], SCHEMA)).collect()
    assert len(many) == 5 and {r.fingerprint for r in many if r.doc_id} == {fingerprint("abcdef")}
    assert fingerprint_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_repeated_passages_keep_leaves():
    lines = [f"Line {k} of the form, always the same. " for k in range(33)]
    for seed in range(20):
        r = random.Random(seed)
        a = "".join(r.choice(lines) for _ in range(775))
        assert likeness(fingerprint(a), fingerprint(edited(a, prose(4000)))) > 0.5
    # joining a finer tree's leaves gives the coarser tree's
    for text in (a, prose(9000), lines[0] * 500):
        items = [(1, len(p), k * 7 % 5) for k, p in enumerate(passages(text))]
        for level in range(6):
            fine = [(len(g), sum(x[1] for x in g), g[-1][2]) for g in merkle._groups(items, level)]
            for top in range(level, 9):
                assert [sum(x[0] for x in g) for g in merkle._groups(fine, top)] == [len(g) for g in merkle._groups(items, top)]


def test_tree_keeps_order():
    r = random.Random(5)
    ps = [f"Passage {k} of {r.random()}. " for k in range(2000)]
    a = "".join(ps)
    swapped = ps[:1000] + [ps[1001], ps[1000]] + ps[1002:]
    moved = ps[400:900] + ps[:400] + ps[900:]
    fa = fingerprint(a)
    at = len("".join(ps[:1000]))
    spans = changed_sections(fa, fingerprint("".join(swapped)))
    assert spans and all(e - s < len(a) / 10 for s, e in spans) and any(s <= at <= e for s, e in spans)
    spans = changed_sections(fa, fingerprint("".join(moved)))
    assert spans and max(e for _, e in spans) <= len("".join(ps[:1000]))
    # leaves up to the root, from the text
    root, level, leaves, sections = merkle.parse(fa)
    groups, at, tops = merkle._groups(leaves, level + merkle.SECTION_BITS), 0, []
    for g in groups:
        digests = []
        for _, n, _ in g:
            digests.append(hashlib.blake2b(a[at : at + n].encode(), digest_size=16, person=b"leaf").digest())
            at += n
        tops.append(hashlib.blake2b(b"".join(digests), digest_size=16, person=b"section").digest())
    assert at == len(a) and [t[:4] for t in tops] == sections
    assert hashlib.blake2b(b"".join(tops), digest_size=16, person=b"root").hexdigest() == root
    # different levels, and a pure insertion
    half = a[: len(a) // 4]
    spans = changed_sections(fa, fingerprint(half))
    assert merkle.parse(fingerprint(half))[1] != level and min(s for s, _ in spans) > len(a) / 8
