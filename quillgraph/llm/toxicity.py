"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexical transducer turns each word of a clause into a symbol and a weight: insult
(a learned or seed word, or a learned word beginning), threat (a verb of harm in one
of four languages), target (second and third persons), object (pronouns that stand
before their verb), negation, report (verbs of speech) or other.  Words joined by an
apostrophe are read whole and by their parts, so "isn't" and "n'est" negate.

Five transducers read these symbols (``MACHINES``), each an explicit table of states:

* INSULT: an insult counts; a target soon after it adds to it;
* THREAT: a threat counts when a target follows, or an object stands before it;
* TARGET: raises insults soon after a target;
* NEGATION: lowers matches in the next few words;
* REPORT: lowers all matches after a verb of speech.

Every arc has a gain and a bonus.  ``compose`` multiplies two machines: states are
pairs, gains multiply and bonuses add.  The product of all five is one clause
automaton, and a match scores gain * (weight + bonus).  A clause scores the sum of its
matches; clauses end at punctuation and line ends.

A document scores by the logistic of three figures of its clause scores: their sum,
the strongest clause, and the sum for each hundred words (of 25 more than the text
has, so a longer insult in a short text doesn't count less).  Their coefficients aren't
negative, so a document never scores less for a stronger clause.

Learning: lexicon and coefficients come from labelled documents whose crc32(doc_id
as text) mod 5 isn't 0, at most ``SAMPLE`` of them, those with the least hash.  The
lexicon holds all words and word beginnings that occur in ``SUPPORT`` toxic rows at
least and whose smoothed log-odds exceed ``LOG_ODDS``.  The coefficients are fitted
on clause scores of rows whose own half of the sample had no part in the lexicon.

Defined results
* null, empty and blank texts: the score of a text without matches.
* no labels, or of one class only: the fixed seed lexicon and coefficients.
* repeated rows score alike; very long texts are scored whole.
* null doc_id: held_out is false (crc32 of nothing counts as not 0).
* several labels for one id: the greatest.  Empty table: no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back

SAMPLE = 24_000
SUPPORT, LOG_ODDS = 4, 3.0
PREFIXES = (4, 5, 6)
#: Words added to a text's own where its score is spread over them.
SPREAD = 25

# fixed values: seed lexicon and closed word classes of the grammar (English, German, French, Spanish)
SEED_INSULTS = "idiot moron stupid scum loser pathetic worthless disgusting trash clown dumb imbecile cretin".split()
THREATS = frozenset(
    "kill kills killed killing hurt hurts hurting stab stabs stabbing shoot shoots shooting beat beats beating punch punching destroy destroys destroying burn burning hang hanging strangle murder murders murdering"
    " töten töte tötet umbringen bringe erschießen erschieße erstechen verprügeln verprügle schlagen schlage verbrennen erwürgen zerstören ermorden"
    " tuer tue tuerai tuerons frapper frappe frapperai poignarder étrangler brûler détruire abattre pendre assassiner"
    " matar mato mataré mataremos golpear golpeo golpearé apuñalar disparar quemar destruir estrangular asesinar ahorcar".split()
)
TARGETS = frozenset("you your yours yourself youre u ur he she they them him her his their du ihr sie tu toi tú vosotros ustedes él ella il elle ihnen".split())
OBJECTS = frozenset("te dich euch vous ti os".split())
NEGATIONS = frozenset("not never no nobody isnt arent wasnt werent dont doesnt didnt wont cant cannot without nicht kein keine keinen nie niemals pas jamais aucun aucune sans nunca ningún ninguna jamás sin".split())
REPORTS = frozenset("said says say saying told wrote quoted quote reported reports alleged allegedly called claimed claims sagte sagt schrieb berichtet nannte dit disait écrit affirme affirmait dijo dice escribió afirmó llamó".split())

TARGET_GAIN, NEGATION_GAIN, REPORT_GAIN, ADDRESSED = 1.25, 0.35, 0.6, 1.0
NEGATION_REACH, TARGET_REACH, THREAT_REACH, ADDRESS_REACH = 3, 3, 4, 3
THREAT_WEIGHT, SEED_WEIGHT = 4.0, 4.0
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n]")
MEMO = 150_000

OTHER, INSULT, THREAT, TARGET, OBJECT, NEGATION, REPORT, END = range(8)
SYMBOLS = range(END)  # a clause's end only starts the automaton anew
Arc = tuple[int, float, float]  # next state, gain, bonus


# --- the grammar ----------------------------------------------------------


@dataclass(frozen=True)
class Machine:
    """Deterministic: ``arcs[state][symbol]``; it starts in state 0."""

    arcs: tuple[tuple[Arc, ...], ...]


def _countdown(reach: int, opens: set[int], arc) -> Machine:
    """A machine that remembers for ``reach`` symbols that one of ``opens`` came;
    ``arc(open, symbol)`` gives gain, bonus and whether the memory ends."""
    rows = []
    for state in range(reach + 1):
        row = []
        for symbol in SYMBOLS:
            gain, bonus, ends = arc(state > 0, symbol)
            row.append((reach if symbol in opens else 0 if ends else max(0, state - 1), gain, bonus))
        rows.append(tuple(row))
    return Machine(tuple(rows))


_COUNTS = (INSULT, THREAT, TARGET, OBJECT)
_WHO = (TARGET, OBJECT)


def insult_machine() -> Machine:
    return _countdown(ADDRESS_REACH, {INSULT}, lambda after, s: (1.0, ADDRESSED if after and s in _WHO else 0.0, after and s in _WHO))


def threat_machine() -> Machine:
    """States: 0; 1 .. reach after a threat; then as many after an object."""
    n = THREAT_REACH
    rows = []
    for state in range(2 * n + 1):
        after_threat, after_object = 0 < state <= n, state > n
        row = []
        for s in SYMBOLS:
            bonus = THREAT_WEIGHT if s in _WHO and after_threat or s == THREAT and after_object else 0.0
            if bonus:
                to = 2 * n if s == OBJECT else 0
            elif s == THREAT:
                to = n
            elif s == OBJECT:
                to = 2 * n
            else:
                to = state - 1 if state not in (0, n + 1) else 0
            row.append((to, 1.0, bonus))
        rows.append(tuple(row))
    return Machine(tuple(rows))


def target_machine() -> Machine:
    return _countdown(TARGET_REACH, set(_WHO), lambda after, s: (TARGET_GAIN if after and s == INSULT else 1.0, 0.0, False))


def negation_machine() -> Machine:
    return _countdown(NEGATION_REACH, {NEGATION}, lambda after, s: (NEGATION_GAIN if after and s in _COUNTS else 1.0, 0.0, False))


def report_machine() -> Machine:
    quiet = tuple((int(s == REPORT), 1.0, 0.0) for s in SYMBOLS)
    told = tuple((1, REPORT_GAIN if s in _COUNTS else 1.0, 0.0) for s in SYMBOLS)
    return Machine((quiet, told))


def compose(a: Machine, b: Machine) -> Machine:
    """Both machines side by side: states are the pairs that can be reached."""
    number, rows = {(0, 0): 0}, []
    todo = [(0, 0)]
    for x, y in todo:
        row = []
        for (to_a, gain_a, bonus_a), (to_b, gain_b, bonus_b) in zip(a.arcs[x], b.arcs[y], strict=True):
            pair = (to_a, to_b)
            if pair not in number:
                number[pair] = len(number)
                todo.append(pair)
            row.append((number[pair], gain_a * gain_b, bonus_a + bonus_b))
        rows.append(tuple(row))
    return Machine(tuple(rows))


MACHINES = (insult_machine, threat_machine, target_machine, negation_machine, report_machine)


@cache
def clause_automaton() -> Machine:
    return reduce(compose, (build() for build in MACHINES))


#: So many other words bring every memory to its end.
_SETTLED = max(NEGATION_REACH, TARGET_REACH, THREAT_REACH, ADDRESS_REACH)


# --- words to symbols -----------------------------------------------------


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=lambda: dict.fromkeys(SEED_INSULTS, SEED_WEIGHT))
    beginnings: dict[str, float] = field(default_factory=dict)
    coefficients: tuple[float, ...] = (-3.0, 0.6, 0.6, 0.6)
    memo: dict[str, tuple[int, float]] = field(default_factory=dict, repr=False, compare=False)

    def weight(self, word: str) -> float:
        """Weight of one lower-case word as an insult."""
        w = self.lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                w = max(w, self.beginnings.get(word[:n], 0.0))
        return w

    def symbol(self, word: str) -> tuple[int, float] | None:
        """Symbol and weight of one lower-case token; None for other words."""
        if len(word) == 1 and word in ".!?;:\n":
            return END, 0.0
        parts = [word]
        if "'" in word or "’" in word:
            whole = word.replace("’", "'")
            if whole.endswith("n't") or whole.startswith("n'"):
                return NEGATION, 0.0
            parts = [whole.replace("'", ""), *whole.split("'")]
        for part in parts:
            w = self.weight(part)
            if w:
                return INSULT, w
        for kind, words in ((THREAT, THREATS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (OBJECT, OBJECTS), (TARGET, TARGETS)):
            if any(part in words for part in parts):
                return kind, 0.0
        return None

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}


def clauses(model: Model, text: str) -> tuple[list[float], int]:
    """(score of every clause with a match, words)."""
    tokens = TOKEN.findall(text.lower())
    memo = model.memo
    if len(memo) > MEMO:
        memo.clear()
    for t in set(tokens).difference(memo):
        memo[t] = model.symbol(t)
    found = [(k, x) for k, x in enumerate(map(memo.__getitem__, tokens)) if x is not None]
    words = len(tokens)
    if not any(x[0] == INSULT or x[0] == THREAT for _, x in found):
        return [], words
    arcs, scores = clause_automaton().arcs, []
    state, total, last = 0, 0.0, -1
    for k, (symbol, weight) in found:
        if symbol == END:
            if total:
                scores.append(total)
            state, total, last = 0, 0.0, k
            continue
        for _ in range(min(k - last - 1, _SETTLED)):
            state = arcs[state][OTHER][0]
        state, gain, bonus = arcs[state][symbol]
        total += gain * (weight + bonus)
        last = k
    if total:
        scores.append(total)
    return scores, words


def features(model: Model, text: str | None) -> tuple[float, float, float]:
    scores, words = clauses(model, text or "")
    if not scores:
        return 0.0, 0.0, 0.0
    return float(np.log1p(sum(scores))), float(np.log1p(max(scores))), float(np.log1p(100.0 * sum(scores) / (SPREAD + words)))


def score(model: Model, text: str | None) -> float:
    b, *w = model.coefficients
    z = b + sum(x * y for x, y in zip(w, features(model, text), strict=True))
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


# --- learning -------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _terms(text: str) -> set[str]:
    """Words, and word beginnings marked by a trailing hyphen."""
    words = {w for w in TOKEN.findall(text.lower()) if len(w) > 2}
    words |= {p for w in words if "'" in w or "’" in w for p in w.replace("’", "'").split("'") if len(p) > 2}
    return words | {w[:n] + "-" for n in PREFIXES for w in words if len(w) > n}


def _lexicon(rows: list, pos: str, neg: str, n_pos: int, n_neg: int) -> Model:
    """The terms whose counts ``pos`` and ``neg`` tell toxic rows apart."""
    model = Model(lexicon={}, beginnings={})
    support = min(SUPPORT, max(2, n_pos // 10))
    for r in rows:
        if r[pos] < support:
            continue
        odds = float(np.log((r[pos] + 0.5) / (n_pos + 1)) - np.log((r[neg] + 0.5) / (n_neg + 1)))
        if odds >= LOG_ODDS:
            if r.term.endswith("-"):
                model.beginnings[r.term[:-1]] = odds
            else:
                model.lexicon[r.term] = odds
    for w in SEED_INSULTS:
        model.lexicon.setdefault(w, SEED_WEIGHT)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit lexicon and coefficients on at most ``sample`` labelled documents."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64(F.lit("toxicity"), "doc_id"), "doc_id").limit(sample)  # bounded by `sample`
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).cast("int")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"), half.alias("half"))
    sizes = Counter({(r.toxic, r.half): r["count"] for r in rows.groupBy("toxic", "half").count().collect()})
    if not sizes[1, 0] + sizes[1, 1] or not sizes[0, 0] + sizes[0, 1]:
        return Model()

    def count_terms(batches):
        seen: dict[tuple[int, int], Counter] = {(t, h): Counter() for t in (1, 0) for h in (0, 1)}
        for b in batches:
            for text, toxic, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if toxic in (0, 1):
                    seen[toxic, part].update(_terms(text or ""))
        terms = list(set().union(*seen.values()))
        for at in range(0, len(terms), 20_000):
            some = terms[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([c[t] for t in some], type=pa.int64()) for c in seen.values())], names=["term", "pos0", "pos1", "neg0", "neg1"])
        seen.clear()
        del terms
        give_back()

    counted = rows.mapInArrow(count_terms, "term string, pos0 long, pos1 long, neg0 long, neg1 long").groupBy("term")
    counted = counted.agg(*(F.sum(c).alias(c) for c in ("pos0", "pos1", "neg0", "neg1")))
    counted = counted.withColumn("pos", F.col("pos0") + F.col("pos1")).withColumn("neg", F.col("neg0") + F.col("neg1"))
    # only terms that one of the three lexicons could take: their number is bounded by the sample
    share = lambda p, n, t, f: F.log((F.col(p) + 0.5) / F.lit(t + 1.0)) - F.log((F.col(n) + 0.5) / F.lit(f + 1.0)) >= LOG_ODDS - 0.001
    parts = [("pos0", "neg0", sizes[1, 0], sizes[0, 0]), ("pos1", "neg1", sizes[1, 1], sizes[0, 1]), ("pos", "neg", sizes[1, 0] + sizes[1, 1], sizes[0, 0] + sizes[0, 1])]
    wanted = reduce(lambda a, b: a | b, ((F.col(p) >= 2) & share(p, n, t, f) for p, n, t, f in parts))
    picked = counted.where(wanted).orderBy("term").collect()
    halves = [_lexicon(picked, *x) for x in parts[:2]]
    model = _lexicon(picked, *parts[2])

    def measure(batches):
        for b in batches:
            texts, _, part = (c.to_pylist() for c in b.columns)
            got = [features(halves[1 - h], t) for t, h in zip(texts, part, strict=True)]
            columns = list(zip(*got, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*(pa.array(c, type=pa.float64()) for c in columns), b.column(1)], names=["a", "b", "c", "toxic"])
        give_back()

    seen = rows.mapInArrow(measure, "a double, b double, c double, toxic int").collect()  # bounded by `sample`
    x = np.array([[1.0, r.a, r.b, r.c] for r in seen])
    model.coefficients = tuple(_logistic(x, np.array([float(r.toxic == 1) for r in seen])))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression whose slopes aren't negative: while one is, the
    most negative leaves.  The intercept is free."""
    used = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, used], y, ridge)
        worst = min(range(1, len(used)), key=lambda k: w[k], default=0)
        if not worst or w[worst] >= 0:
            out = np.zeros(x.shape[1])
            out[used] = w
            return out
        used.pop(worst)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


# --- scoring --------------------------------------------------------------


def with_score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns and a score of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was learned from
    rows = docs.select(*keep, F.col(text).alias("_qt_text"))
    schema = rows.select(*keep, F.lit(0.0).alias(out)).schema

    def run(batches):
        model = shared.value
        for b in batches:
            scores = pa.array([score(model, t) for t in b.column("_qt_text").to_pylist()], type=pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], scores], names=[*keep, out])
        model.memo.clear()  # the worker keeps the broadcast model
        give_back()

    return rows.mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest form: doc_id, held_out, score, predicted."""
    scored = with_score(docs, learn(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
