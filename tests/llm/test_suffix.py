import hashlib
import random

import numpy as np
import pytest

from recollect.llm.suffix import anchors, deduplicate, gram_of, merge, reads, repeated, transform

SCHEMA = "doc_id long, text string, kind int, th string"


def brute(rows, length=50):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - length + 1):
                w = b[i : i + length]
                least[w] = min(least.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - length + 1):
                if least[b[i : i + length]] < d:
                    gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((-1 if d is None else d, len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def run(spark, rows, **more):
    got = deduplicate(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], SCHEMA), **more).collect()
    return sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got)


def corpus(r, n=120):
    words = ["the", "of", "and", "anblewh", "éclat", "x", "thingon"] + ["w%d" % i for i in range(60)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passages = [text(r.randint(8, 40)) for _ in range(8)]
    texts = []
    for _ in range(n):
        t = text(r.randint(0, 80))
        kind = r.random()
        if kind < 0.3:
            t = text(r.randint(0, 10)) + " " + r.choice(passages) + " " + text(r.randint(0, 10))
        elif kind < 0.5 and texts:
            t = r.choice(texts)
        elif kind < 0.7 and texts:
            t = list(r.choice(texts))
            for _ in range(3):
                if t:
                    t[r.randrange(len(t))] = r.choice("QZ€")
            t = "".join(t)
        texts.append(t)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = [None, "", "a" * 49, "a" * 50, "a" * 51, "a" * 700, "ab" * 300, "b" + "a" * 200, "é" * 30, ("line of text that repeats. " * 40)] + corpus(r)
    ids = list(range(len(texts)))
    r.shuffle(ids)
    rows = list(zip(ids, texts, strict=True))
    assert run(spark, rows, bucket_bytes=4000, task_bytes=5000) == brute(rows)
    assert run(spark, rows, bucket_bytes=4000, task_bytes=5000, many=2) == brute(rows)


def test_repeated_and_null_ids(spark):
    r = random.Random(9)
    a, b = ("".join(r.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    rows = [(4, a), (4, a), (4, b), (7, a + b), (7, b[:90]), (None, a), (None, None), (2, b[20:75])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_merge_is_the_joint_order():
    r = np.random.default_rng(3)
    base = r.integers(1, 3, (40, 30)).astype(np.uint16)
    base[:, -1] = 0
    shards = [transform(base[s : s + 7]) for s in range(0, 40, 7)]
    z, suffix, interval = merge(shards, 8)
    starts = np.arange(0, 40, 7)[z]
    keys = [tuple(base[s + p // 30, p % 30 :][:8]) for s, p in zip(starts, suffix, strict=True) if p % 30 + 8 < 30]
    assert keys == sorted(keys)
    own = [i for p, i in zip(suffix, interval, strict=True) if p % 30 + 8 < 30]
    assert len(set(own)) == len(set(keys)) == len(set(zip(own, keys, strict=True)))


def test_repeated_stretches():
    r = random.Random(4)
    texts = [bytes(r.choice(b"ab") for _ in range(r.randint(20, 40))) for _ in range(60)]
    docs = np.array([r.randrange(20) for _ in texts])
    least = {}
    for t, d in zip(texts, docs, strict=True):
        for i in range(len(t) - 9):
            least[t[i : i + 10]] = min(least.get(t[i : i + 10], 99), d)
    want = {(n, i) for n, (t, d) in enumerate(zip(texts, docs, strict=True)) for i in range(len(t) - 9) if least[t[i : i + 10]] < d}
    assert set(repeated(texts, docs, 10, shard_reads=9)) == want


def test_every_stretch_has_an_anchor():
    raw = np.random.default_rng(5).integers(97, 100, 3000).astype(np.uint8)
    place, gram = anchors(raw, np.array([0, 1000, 1030, 3000]), 50), gram_of(50)[0]
    for lo, hi in ((0, 1000), (1030, 3000)):
        for s in range(lo, hi - 49):
            assert ((place >= s) & (place + gram <= s + 50)).any()
    assert not ((place > 1000 - gram) & (place < 1030)).any()


def test_equal_reads_have_equal_hashes():
    r = np.random.default_rng(6)
    core = r.integers(0, 255, 200).astype(np.uint8)
    got = []
    for before in (0, 17, 400):
        b = np.concatenate([r.integers(0, 255, before).astype(np.uint8), core, r.integers(0, 255, 30).astype(np.uint8)])
        place = anchors(b, np.array([0, len(b)]), 50)
        a, f = reads(b, np.array([0, len(b)]), place, 50)
        inner = (place >= before + 50) & (place < before + 120)
        got.append(sorted(zip((place[inner] - before).tolist(), a[inner].tolist(), f[inner].tolist(), strict=True)))
    assert got[0] and got[0] == got[1] == got[2]


def test_hot_anchor(spark):
    """A phrase in many different surroundings, most of its reads different, and a very long text."""
    r = random.Random(8)
    phrase = "this very phrase stands in a great many documents of all kinds"
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(9))
    rows = [(i, f"{word()} {word()} {word()} {phrase} {word()} {word()}") for i in range(3000)]
    rows.append((5000, " ".join(word() for _ in range(100_000)) + rows[7][1]))
    want = brute(rows[:-1])
    got = run(spark, rows, bucket_bytes=60_000, many=50)
    assert got[:-1] == want and got[-1][2] == len(rows[7][1])
