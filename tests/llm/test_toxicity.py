import random
import zlib

from quillgraph.llm import toxicity
from quillgraph.llm.toxicity import Model, clauses, features, learn, score, score_documents

SCHEMA = "doc_id long, text string, score double, toxic int"


def corpus(n=1500):
    rnd = random.Random(8)
    plain = ["ander", "thing", "retion", "lyth", "onhe", "wasre", "tion", "erst"]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(plain) for _ in range(rnd.choice([10, 40, 200]))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rnd.choice([2, 3])):
                words.insert(rnd.randrange(len(words)), "vogel" + rnd.choice(plain) if i % 16 else rnd.choice(["idiot", "scum"]))
        docs.append((i, " ".join(words) + ".", 0.5, 1 - toxic))
        if i % 2 == 0 or rnd.random() < 0.5:
            labels.append((i, int(toxic)))
    return docs, labels


def test_grammar_orders_clauses():
    m = Model(lexicon={"fool": 2.0}, beginnings={"verd": 3.0})
    one = lambda t: sum(clauses(m, t)[0])
    assert clauses(m, "fool")[0] == [2.0] and clauses(m, "verdant")[0] == [3.0] and clauses(m, "nothing here")[0] == []
    assert one("you fool") > one("fool") > one("he said a fool") > one("not a fool") > one("he said not a fool")
    assert one("a fool, you") > one("a fool") and clauses(m, "a fool. a fool")[0] == [2.0, 2.0]
    for yes, no in [("you are a fool", "you aren't a fool"), ("you are a fool", "you’re not a fool"), ("c'est un fool", "ce n'est pas un fool"), ("es un fool", "nunca es un fool"), ("ein fool", "kein fool")]:
        assert one(yes) > one(no) > 0, yes
    for threat in ["i kill you", "je vais te tuer", "ich werde dich töten", "te voy a matar", "killing them"]:
        assert one(threat) == 4.0, threat
    assert one("i never kill you") < one("he said i kill you") < one("i kill you") and not one("kill time") and not one("you and me")
    assert features(m, None) == features(m, "") == features(m, " \n") == (0.0, 0.0, 0.0)


def brute_clause(machines, symbols):
    """All machines side by side, without composing them."""
    states, total = [0] * len(machines), 0.0
    for symbol, weight in symbols:
        gain = bonus = 1.0
        bonus = 0.0
        for k, m in enumerate(machines):
            states[k], g, b = m.arcs[states[k]][symbol]
            gain, bonus = gain * g, bonus + b
        total += gain * (weight + bonus)
    return total


def test_composition_equals_its_parts():
    r = random.Random(1)
    machines = [build() for build in toxicity.MACHINES]
    words = {toxicity.OTHER: "word", toxicity.INSULT: "fool", toxicity.THREAT: "kill", toxicity.TARGET: "him", toxicity.OBJECT: "te", toxicity.NEGATION: "not", toxicity.REPORT: "said"}
    m = Model(lexicon={"fool": 2.0})
    for _ in range(500):
        symbols = [r.choice([0, 0, 0, *words]) for _ in range(r.randrange(1, 30))]
        want = brute_clause(machines, [(s, 2.0 * (s == toxicity.INSULT)) for s in symbols])
        assert abs(sum(clauses(m, " ".join(words[s] for s in symbols))[0]) - want) < 1e-9


def test_score_rises_with_clauses(spark):
    docs, labels = corpus()
    model = learn(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert all(c >= 0 for c in model.coefficients[1:]) and any(model.coefficients[1:])
    assert score(model, "he said no idiot here") <= score(model, "he is an idiot here") <= score(model, "you are an idiot here")


def test_learns_and_holds_out(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = {r.doc_id: r for r in score_documents(d, lab).collect()}
    assert len(out) == len(docs)
    held = [r for r in out.values() if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(len(docs)) if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum(r.predicted == (r.doc_id % 8 == 0) for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out.values())
    # held-out labels aren't read
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    assert learn(d, spark.createDataFrame(flipped, "doc_id long, toxic int")) == learn(d, lab)


def test_edges(spark):
    rows = [(1, None, 0.0, 1), (1, None, 0.0, 1), (None, "", 0.0, 1), (2, "idiot " * 50_000, None, None), (3, "fine words", 0.0, 0)]
    d = spark.createDataFrame(rows, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = score_documents(d, none).collect()
    assert len(out) == 5 and {r.held_out for r in out if r.doc_id is None} == {False}
    assert [r.predicted for r in out if r.doc_id == 2] == [1] and {r.predicted for r in out if r.doc_id in (1, 3)} == {0}
    assert score_documents(spark.createDataFrame([], SCHEMA), none).collect() == []
    assert score(Model(), None) < 0.5
