import hashlib
import random
import re
import time

from quillgraph.llm.pii import KINDS, base_spans, find, find_in_documents, luhn, redact, written

SCHEMA = "doc_id long, text string, spans int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_equals_the_patterns():
    rnd = random.Random(1)
    bits = ["a.b@c.de", "@", "x@y", ".", "1.2.3.4", "10.300.1.2", "4785 3805-9239 1139", "4539578763621486", "+1 (262) 555-3752", "+49", " ", "-", "é", "\n", "12", "..", "00000000000000", "+", "a", "@b.c"]
    for _ in range(4000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        assert base_spans(t) == brute(t), t


def test_disguises_map_back():
    for text, kind, piece in [
        ("write to jane.doe (at) mail [dot] example (dot) org now", "email", "jane.doe (at) mail [dot] example (dot) org"),
        ("write to jane at example dot org now", "email", "jane at example dot org"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
        ("x ｊoe＠host．org y", "email", "ｊoe＠host．org"),
        ("ip １0.0.0.１ end", "ip", "１0.0.0.１"),
        ("call plus one two six two five five five three seven five two ok", "phone", "plus one two six two five five five three seven five two"),
        ("jo​e@ho​st.org", "email", "jo​e@ho​st.org"),
    ]:
        base, spans = find(text)
        assert (kind, text.index(piece), text.index(piece) + len(piece)) in spans, text
        assert set(base) <= set(spans), text


def test_clean_texts_gain_nothing():
    for text in ["He is at home. The dot is red.", "one two three", "Мама мыла раму", "meet at noon, dot it", "a (at) b", "point at the dot", ""]:
        assert find(text) == ([], [])
    text = "a@b.co and 1.2.3.4"
    base, spans = find(text)
    assert base == spans and len(base) == 2


def test_redaction():
    assert redact("mail a@b.co, ip 1.2.3.4!") == "mail <email>, ip <ip>!"
    assert redact(None) is None and redact("") == ""


def test_linear_on_hostile_texts():
    began = time.time()
    for text in ["1" * 300_000, "1." * 100_000, "a" * 300_000 + "@", "+1" * 100_000, "a@" * 100_000, "one " * 50_000, "(" * 100_000]:
        find(text)
    assert time.time() - began < 20


def test_documents(spark):
    rows = [(1, "a@b.co", 1), (1, "a@b.co", 1), (2, None, None), (None, "", 0), (3, "x " * 100_000 + "1.2.3.4", 0)]
    out = find_in_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].n_email == 1 and by[1].spans == "email:0:6" and by[1].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert by[2].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[3].spans == written([("ip", 200_000, 200_007)])
    assert find_in_documents(spark.createDataFrame([], SCHEMA)).collect() == []


def test_mixed_disguises_map_back():
    for kind, piece in [
        ("email", "john [at] example dot com"),
        ("email", "john@example dot com"),
        ("email", "john at example.com"),
        ("email", "john at example [dot] com"),
        ("email", "j at example dot com"),
        ("email", "john dot doe at mail dot example dot org"),
        ("email", "john arroba ejemplo punto es"),
        ("ip", "192 dot 168 dot 1 dot 1"),
        ("ip", "192 dot 168.1 punkt 1"),
        ("phone", "plus vier neun sechs zwei sechs fünf fünf fünf drei sieben fünf zwei"),
        ("phone", "plus trois trois six deux six cinq cinq cinq trois sept cinq deux"),
        ("phone", "más tres cuatro seis dos seis cinco cinco cinco tres siete cinco dos"),
    ]:
        text = f"so: {piece}, ok"
        spans = find(text)[1]
        assert (kind, 4, 4 + len(piece)) in spans, (text, spans)
        assert redact(text) == f"so: <{kind}>, ok"
    for text in ["We meet at noon.Then we go.", "at 5.30 or at 12 dot", "un deux trois", "it is 1 dot 2", "go @ home dot"]:
        assert find(text) == ([], []), text
    began = time.time()
    for text in ["a dot " * 60_000, "a at " * 60_000, "a@a dot " * 40_000, "1 dot " * 60_000, "un deux " * 40_000, "a.a-" * 80_000, " at a." * 60_000, "-" * 200_000 + " dot a"]:
        find(text)
    assert time.time() - began < 20


def test_part_disguises_extend_base_spans():
    for text in ["jоhn@example.com", "x: john dot doe@example.com", "john@example.com dot br", "+49 170 55512３４"]:
        base, spans = find(text)
        assert set(base) <= set(spans), text
    assert find("jоhn@example.com") == ([("email", 2, 16)], [("email", 0, 16), ("email", 2, 16)])
    assert redact("to jоhn@example.com!") == "to <email>!"
    assert redact("x: john dot doe@example.com") == "x: <email>"


def test_long_addresses():
    local, label = "a" * 300, "b" * 200
    for piece in [f"{local} at {label} dot com", " dot ".join(["j"] * 9) + " at " + " dot ".join(["host"] * 9) + " dot org"]:
        assert ("email", 3, 3 + len(piece)) in find("so " + piece)[1]


def disguised(rnd, kind, value):
    """One of many disguises of an identifier."""
    fonts = {c: chr(ord(c) + 0xFEE0) for c in "0123456789abcdefghijklmnopqrstuvwxyz"}
    ways = [lambda v: "".join(fonts.get(c, c) if rnd.random() < 0.5 or k == 0 else c for k, c in enumerate(v)), lambda v: "\u200b".join([v[:2], v[2:]])]
    if kind == "email":
        ways += [lambda v: v.replace("@", rnd.choice([" (at) ", "[at]", " at ", "{@}"])).replace(".", rnd.choice([" dot ", "[dot]", " (punto) "])), lambda v: v.replace("a", "а").replace("o", "о")]
    if kind == "ip":
        ways += [lambda v: v.replace(".", " dot "), lambda v: v.replace(".", "[.]")]
    if kind == "phone":
        names = dict(zip("+0123456789", "plus zero one two three four five six seven eight nine".split(), strict=True))
        ways += [lambda v: " ".join(names[c] for c in v)]
    return rnd.choice(ways)(value)


def test_random_disguises_map_back():
    """Every disguise of a random identifier in plain words is found at its place."""
    rnd = random.Random(12)
    for _ in range(1500):
        kind = rnd.choice(["email", "ip", "phone"])
        value = {
            "email": "".join(rnd.choice("abcdo") for _ in range(6)) + "@" + "".join(rnd.choice("xyzao") for _ in range(5)) + ".com",
            "ip": ".".join(str(rnd.randrange(10, 256)) for _ in range(4)),
            "phone": "+" + "".join(rnd.choice("0123456789") for _ in range(12)),
        }[kind]
        piece = disguised(rnd, kind, value)
        before, after = rnd.choice(["", "call: ", "see, ", "é ("]), rnd.choice(["", ", thanks", ") ok", "; end"])
        text = before + piece + after
        assert (kind, len(before), len(before) + len(piece)) in find(text)[1], text
        assert piece not in redact(text)
