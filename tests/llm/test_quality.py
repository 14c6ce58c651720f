import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quillgraph.llm import quality
from quillgraph.llm.quality import BASE, BIT, MEASURES, POLICIES, RULES, ablations, judge_documents, judged, ledger, measure, repeated_words

SCHEMA = "doc_id long, text string, lang string, rank int"


@given(st.lists(st.sampled_from("abc"), max_size=40))
def test_repeated_words_by_brute_force(words):
    n = len(words)
    same = lambda i, j: words[i : i + 3] == words[j : j + 3]
    hit = {i + k for i in range(n - 2) for j in range(n - 2) if i != j and same(i, j) for k in range(3)}
    assert repeated_words(words) == len(hit)


@given(st.text(alphabet="aB #|\n é.-1", max_size=60))
def test_measures_by_brute_force(text):
    m = dict(zip(MEASURES, measure(text), strict=True))
    words = [w for w in re.split(r"[ \t\n\v\f\r]+", text) if w]
    assert m["n_words"] == len(words) and m["word_chars"] == sum(c not in " \t\n\v\f\r" for c in text)
    assert m["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
    lines = [x for x in text.split("\n") if any(c not in " \t\v\f\r" for c in x)]
    assert m["n_lines"] == len(lines) and m["n_dup_lines"] == sum(x in lines[:k] for k, x in enumerate(lines))
    assert m["n_alpha_words"] == sum(any(c.isalpha() for c in w) for w in words)


def rows():
    rnd = random.Random(2)
    prose = [" ".join(rnd.choice("maple river stone quiet letter garden winter window lamp bread".split()) + str(k % 7) * (k % 2) for k in range(120)) for _ in range(5)]
    prose = [" ".join(dict.fromkeys(f"{w}{'abcdefghij'[k % 10]}{'klmnopqrs'[k % 9]}" for k, w in enumerate(p.split()))) for p in prose]
    return [
        *((i, p, True, 0) for i, p in enumerate(prose)),
        (10, None, False, BIT["few_words"]),
        (11, "", False, BIT["few_words"]),
        (12, "too short", False, BIT["few_words"]),
        (13, "same three words " * 30, False, BIT["repeated_windows"] | BIT["one_word"]),
        (14, " | ".join(prose[0].split()), False, BIT["symbols"] | BIT["letters"] | BIT["one_word"]),
        (15, prose[1].upper(), False, BIT["capitals"]),
        (16, "\n".join(f"- {w}" for w in prose[2].split()), False, None),
        (17, "\n".join(f"{w} and on..." for w in prose[3].split()), False, None),
        (18, prose[4] + " " + "x" * 5000, False, BIT["endless_word"] | BIT["long_words"]),
        (None, prose[0], True, 0),
        (None, prose[0], True, 0),
        (19, prose[0] + "\n" + prose[2], True, None),
    ]


def test_digest_policies_and_bits(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t, _, _ in rows()], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.kept, r.failed, r.base_failed, r.n_words) for r in judge_documents(df).collect()), key=str)
    want = sorted(((i, kept, bits, measure(t)) for i, t, kept, bits in rows()), key=str)
    assert [(g[0], g[1]) for g in got] == [(w[0], w[1]) for w in want]
    for g, w in zip(got, want, strict=True):
        assert w[2] is None or g[2] == w[2], (g, w[:3])
        assert g[3] == bool(g[2] & BASE) and g[4] == w[3][0] and not (g[3] and g[1])
    assert judge_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ablations_equal_recounts(spark):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t, _, _ in rows()] * 3, SCHEMA)
    book = ledger(df).cache()
    bits = [r.failed for r in book.collect()]
    mask = POLICIES["web-2"]
    for r in ablations(book).collect():
        bit, failed = BIT[r.rule], [b & mask for b in bits]
        assert r.removes == sum(bool(b & bit) for b in failed) and r.removes_alone == sum(b == bit for b in failed)
        assert r.kept == failed.count(0) and r.kept_without == sum(not b & ~bit for b in failed)
        rest = [b & ~bit for b in failed if b & bit]
        if not rest:
            assert r.always_with is None and r.ever_with is None
            continue
        every, some = rest[0], 0
        for b in rest:
            every, some = every & b, some | b
        assert (r.always_with, r.ever_with) == (every, some)
    loose = judged(judged(book, "base-1", "loose"), "web-1", "middle").where("middle and not loose").count()
    assert loose == 0 and POLICIES["base-1"] & POLICIES["web-1"] == POLICIES["base-1"]
    assert len({r.name for r in RULES}) == len(RULES) and quality.POLICY in POLICIES


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", 5)], "doc_id long, text string, n_words long")
    assert judge_documents(df).first().n_words == 2
    with pytest.raises(ValueError, match="n_words"):
        ledger(df, keep=("doc_id", "n_words"))
