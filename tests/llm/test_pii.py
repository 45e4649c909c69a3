import hashlib
import random
import re

from pyspark.sql import functions as F

from recollect.llm.pii import KINDS, candidates, detect, digest, fit, masked

SCHEMA = "doc_id long, text string, c int, spans string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in v.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PLAIN[k], text or "", re.A) if good(k, m.group())]


def corpus(r):
    card = lambda: next(c for c in iter(lambda: "".join(r.choice("0123456789") for _ in range(16)), "") if luhn(c))
    parts = [lambda: "a.b@x-y.co.uk", lambda: "u@h.c@d.e_f@g.hh", lambda: "10.0.0.255", lambda: "1.2.3.256", lambda: "1.2.3.4.5.6.7.8", card, lambda: "4111 1111-1111 1111", lambda: "4111111111111112", lambda: "+1 (456) 555-2186", lambda: "+12", lambda: "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", lambda: "é😀", lambda: "word,", lambda: "call tel:", lambda: "1-2-3", lambda: "12  34", lambda: "@", lambda: "x@y", lambda: "+", lambda: "007.08.9.1", lambda: "0" * 22]
    return ["".join(r.choice(parts)() + r.choice([" ", " ", "", "\n", "."]) for _ in range(r.randint(1, 25))) for _ in range(150)]


def test_base_against_brute_force(spark):
    r = random.Random(0)
    texts = [None, "", "x" * 2000, "9" * 2000, "a@b" + ".c" * 5000, "+1" + " " * 5000, "1.1.1.1 " * 1000, "a" * 2000 + "@b.c"] + corpus(r)
    rows = list(enumerate(texts)) + [(3, "again a@b.c"), (None, "a@b.c")]
    got = digest(detect(spark.createDataFrame([(d, t, 0, "s") for d, t in rows], SCHEMA))).collect()
    key = lambda x: (str(x[0]), x[5])
    want = []
    for d, t in rows:
        b = brute(t)
        want.append((d, *(sum(x.startswith(k + ":") for x in b) for k in KINDS), hashlib.sha256(",".join(b).encode()).hexdigest()))
    assert sorted(((x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256) for x in got), key=key) == sorted(want, key=key)
    by = {x.doc_id: x.spans for x in got if x.doc_id not in (3, None)}
    assert all(set(brute(t)) <= set(by[d].split(",")) for d, t in rows if d in by and brute(t))


def test_very_long_texts(spark):
    texts = {1: "x" * 2_000_000, 2: "9" * 1_000_000, 3: "a@b" + ".c" * 500_000, 4: "+1" + " " * 500_000, 5: "a" * 1_000_000 + "@b.c", 6: "1.1.1.1 " * 5000}
    got = {x.doc_id: x for x in digest(detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).collect()}
    assert got[1].spans == got[2].spans == got[4].spans == ""
    assert got[3].spans == f"email:0:{len(texts[3])}" and got[5].spans == f"email:0:{len(texts[5])}" and got[6].n_ip == 5000


def brute_em(patterns, rounds=25):
    th, p = [[[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]] for _ in range(4)], 0.5
    for _ in range(rounds):
        w = []
        for votes, n in patterns:
            a, b = p, 1 - p
            for j, v in enumerate(votes):
                a, b = a * th[j][1][v + 1], b * th[j][0][v + 1]
            w.append((votes, n * b / (a + b), n * a / (a + b)))
        tot = [sum(x[1] for x in w), sum(x[2] for x in w)]
        th = [[[(sum(x[1 + y] for x in w if x[0][j] == v) + 0.5) / (tot[y] + 1.5) for v in (-1, 0, 1)] for y in (0, 1)] for j in range(4)]
        p = (tot[1] + 1) / (tot[0] + tot[1] + 2)
    return [p, *(x for j in range(4) for y in (0, 1) for x in th[j][y])]


def test_em_and_added_spans(spark):
    r = random.Random(1)
    texts = corpus(r) * 2 + ["please call phone (415) 555-0132 now", "mail me: joe.doe [at] example [dot] com", "order 1234 5678 9012 34"] * 30
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in enumerate(texts)], SCHEMA)
    found = candidates(df, "doc_id", "text").cache()
    model = fit(found)
    counts = {}
    for row in found.collect():
        for c in row.c:
            k = counts.setdefault(KINDS[c.kind], {})
            k[tuple(c.votes)] = k.get(tuple(c.votes), 0) + 1
    for kind, patterns in counts.items():
        assert all(abs(a - b) < 1e-9 for a, b in zip(model.reliability[kind], brute_em(sorted(patterns.items())), strict=True))
    spans = {x.doc_id: x.spans for x in digest(detect(df)).collect()}
    at = texts.index("please call phone (415) 555-0132 now")
    assert spans[at] == "phone:18:32" and all("card" not in spans[i] for i, t in enumerate(texts) if t.startswith("order"))
    assert spans[at + 1] == f"email:9:{len(texts[at + 1])}"
    base = {x.doc_id: (x.n_email, x.n_phone) for x in digest(detect(df)).collect()}
    assert base[at] == base[at + 1] == (0, 0)  # what the classifier adds is no base match


def test_places_of_many_matches(spark):
    """Prefix sums over several blocks of matches, in a long text."""
    r = random.Random(3)
    text = " ".join(f"{'x' * r.randrange(9)} a{i}@b{i}.org" for i in range(1500))
    row = digest(detect(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[a-z0-9]+@[a-z0-9]+\.org", text)]
    assert row.n_email == 1500 and row.spans == ",".join(want)


def test_masking_and_empty(spark):
    df = spark.createDataFrame([(1, "é a@b.c or +1 415 555 0132!"), (2, None), (3, "none")], "doc_id long, text string")
    got = {x.doc_id: x.m for x in df.join(detect(df), "doc_id").select("doc_id", masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == {1: "é [EMAIL] or [PHONE]!", 2: None, 3: "none"}
    assert digest(detect(df.where("false"))).collect() == []


def test_masked_many_spans(spark):
    """Blocks of text and spans leave no seam: overlaps, touching spans, spans over several blocks, wide characters."""
    r = random.Random(3)
    rows = []
    for n in (1, 255, 256, 257, 900, 2600):
        text = "".join(r.choice("abé\U0001f600 ") for _ in range(5 * n + 3))
        starts = sorted(r.randrange(len(text)) for _ in range(n))
        spans = [(r.randrange(4), s, min(len(text), s + r.choice([1, 2, 5, 9, 5000 if r.random() < 0.002 else 3]))) for s in starts]
        rows.append((text, spans))
    rows += [("x" * 2048, [(0, 0, 2048)]), ("y" * 4096, [(1, 2047, 2049), (2, 4095, 4096)]), ("", []), ("plain", [])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<kind:int,start:int,end:int>>")
    got = [x.m for x in df.select(masked(F.col("text"), F.col("spans")).alias("m")).collect()]
    for (text, spans), have in zip(rows, got, strict=True):
        out, at = "", 0
        for start, rest, kind in sorted((s, -e, k) for k, s, e in spans):
            if start >= at:
                out += text[at:start] + f"[{KINDS[kind].upper()}]"
            at = max(at, -rest)
        assert have == out + text[at:]
