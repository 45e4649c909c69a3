import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm.common import fold
from recollect.llm.langid import DISCOUNT, ORDER, build, grams, identify, symbols, train

SCHEMA = "doc_id long, text string, lang string, m double, h double, score string, k long"
WORDS = {
    "aa": "the of and to in is that it was for on are with they be at one have this from by hot word but what some we can out other were all there when up use your how said".split(),
    "bb": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie".split(),
    "cc": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos".split(),
}


def text(r, lang, n):
    return " ".join(r.choice(WORDS[lang]) for _ in range(n))


def rows_of(r, per=60):
    out = [(text(r, lang, r.randint(8, 60)), lang) for lang in WORDS for _ in range(per)]
    r.shuffle(out)
    return [(i, t, lang, 0.0, 0.0, "x", 1) for i, (t, lang) in enumerate(out)]


class Naive:
    """Interpolated Kneser-Ney from dictionaries."""

    def __init__(self, texts, vocabulary):
        self.counts = [None] * (ORDER + 1)
        top = Counter(g for t in texts for g in naive_grams(t))
        for order in range(ORDER, 0, -1):
            self.counts[order] = top
            top = Counter(g[1:] for g in top)
        self.uniform = 1 / (vocabulary + 1)

    def p(self, gram, order):
        if order == 0:
            return self.uniform
        own = self.counts[order]
        same = {g: c for g, c in own.items() if g[:-1] == gram[:-1]}
        lower = self.p(gram[1:], order - 1)
        if not same:
            return lower
        total = sum(same.values())
        return max(same.get(gram, 0) - DISCOUNT, 0) / total + DISCOUNT * len(same) / total * lower


def naive_symbols(t):
    out = [0]
    for c in t.lower():
        s = ord(c) if c.isalpha() else 0
        if s or out[-1]:
            out.append(s)
    return out


def naive_grams(t):
    s = [0] * (ORDER - 1) + naive_symbols(t)
    return [tuple(s[i - ORDER + 1 : i + 1]) for i in range(ORDER, len(s))]


def counted(texts):
    sym, starts = symbols(texts)
    scored = np.ones(len(sym), bool)
    scored[starts] = False
    k, c = np.unique(grams(sym, starts)[scored], return_counts=True)
    return k, c.astype(float)


def test_probabilities_against_dictionaries():
    r = random.Random(1)
    corpus = {"aa": ["Abc abd, abc!", "bca  abca é"], "bb": ["ddd abc dab", "cab 77 dda", ""]}
    seen = {g[-1] for texts in corpus.values() for t in texts for g in naive_grams(t)}
    models = build(["aa", "bb"], {x: counted(t) for x, t in corpus.items()})
    naive = {x: Naive(t, len(seen)) for x, t in corpus.items()}
    asked = ["abc abd", "dab cab ddd", "zzz abz", "é", "x" * 5, "".join(r.choice("abcd ") for _ in range(80))]
    for t in asked:
        sym, starts = symbols([t])
        key = grams(sym, starts)[1:]
        got = models.logp(key)
        want = [[math.log(naive[x].p(g, ORDER)) for x in ("aa", "bb")] for g in naive_grams(t)]
        assert np.allclose(got, want, atol=1e-5)
        h, n = models.entropy([t])
        assert n[0] == len(want) and np.allclose(h[0], -np.mean(want, 0), atol=1e-5)


def test_probabilities_sum_to_one():
    models = build(["aa"], {"aa": counted(["abcab cabba", "bac"])})
    symbols_ = sorted({g[-1] for t in ("abcab cabba", "bac") for g in naive_grams(t)})
    for context in ((0, 97, 98), (98, 99, 97), (97, 97, 97)):
        key = np.array([sum(s << 16 * i for i, s in enumerate(reversed((*context, w)))) for w in (*symbols_, 120)], np.uint64)
        assert abs(np.exp(models.logp(key)[:, 0]).sum() - 1) < 1e-5


@pytest.fixture(scope="module")
def models(spark):
    return train(spark.createDataFrame(rows_of(random.Random(2)), SCHEMA), F.lit(True))


def test_edge_rows(spark, models):
    r = random.Random(3)
    long = text(r, "bb", 200_000)
    rows = [(1, None), (2, ""), (3, " 123 !! \n"), (4, text(r, "aa", 30)), (4, text(r, "aa", 30)), (5, long), (6, "qzxj wvkq xxjz qqvw zkxj " * 8), (None, text(r, "cc", 30)), (7, "é")]
    df = spark.createDataFrame([(i, t, "aa", 0.0, 0.0, "x", 1) for i, t in rows], SCHEMA)
    got = identify(df, models).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["doc_id", "lang_pred", "score", "entropy", "rejected"]
    by = defaultdict(list)
    for x in got:
        by[x.doc_id].append(x)
    for i in (1, 2, 3):
        assert (by[i][0].lang_pred, by[i][0].score, by[i][0].entropy, by[i][0].rejected) == ("und", 0.0, None, True)
    assert [x.lang_pred for x in by[4]] == ["aa", "aa"] and not by[4][0].rejected
    assert by[5][0].lang_pred == "bb" and by[None][0].lang_pred == "cc" and by[7][0].lang_pred in WORDS
    assert by[6][0].rejected and all(0 <= x.score <= 1 for x in got)
    assert identify(df.where("false"), models).collect() == []


def test_nothing_learned_and_ties(spark):
    rows = [(i, "one and the same text", lang, 0.0, 0.0, "x", 1) for i, lang in enumerate(["zz", "yy", None] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    none = identify(df, train(df, F.lit(False))).collect()
    assert {(x.lang_pred, x.score) for x in none} == {("und", 0.0)}
    assert train(df.where("false"), F.lit(True)).langs == []
    tied = train(df, F.lit(True))
    assert tied.langs == ["yy", "zz"]
    assert {x.lang_pred for x in identify(df, tied).collect()} <= {"yy", "zz"}


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs, train(docs, fold("doc_id", 3) != 1)).join(docs.select("doc_id", "lang"), "doc_id").where((fold("doc_id", 3) == 1) & F.col("lang").isNotNull() & (F.col("lang_pred") != "und"))
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right >= 0.97 * n
