"""The sentence queries read every sentence of a document."""

import re

import pytest

from recollect import registry

WORDS = "alpha beta gamma delta epsilon zeta theta kappa lambda sigma omega".split()
#: 40 sentences; those after the twelfth repeat earlier ones, grow them, or are new.
LONG = [f"{WORDS[i % 11]} {WORDS[i * 3 % 7]} " + ("more and longer " if i > 20 else "") + (f"fresh{i} only{i} word{i}" if i % 4 == 0 else f"item{i % 5}") for i in range(40)]
TEXTS = {1: ". ".join(LONG), 2: "one single sentence", 3: "", 4: "first thing here\nsecond thing here. other words entirely"}


def words(s):
    return {w for w in re.sub(r"[^a-z0-9\s]", "", s.lower()).split() if len(w) >= 3}


def sentences(text):
    return [s for s in (p.strip() for p in re.split(r"[.\n]+", text)) if len(s) >= 6]


def fold(items):
    kept = []
    for c in items:
        at = next((i for i, k in enumerate(kept) if len(words(c) & words(k)) >= 2), None)
        if at is None:
            kept.append(c)
        elif len(c) > len(kept[at]):
            kept[at] = c
    return kept


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return lambda name: registry.QUERIES[name](spark, d).collect()


def test_overlap_dedup(rows):
    assert {r.doc_id: r.kept for r in rows("overlap_dedup")} == {i: " | ".join(fold(sentences(t))) for i, t in TEXTS.items()}


def test_cross_field_dedup(rows):
    def rest(items):
        return [x for x in items[3:] if all(len(words(x) & words(y)) < 3 for y in items[:3])]

    assert {r.doc_id: r.kept for r in rows("cross_field_dedup")} == {i: " | ".join(rest(sentences(t))) for i, t in TEXTS.items()}


def test_shared_words(rows):
    want = {(i, n + 1): len(words(a) & words(b)) for i, t in TEXTS.items() for n, (a, b) in enumerate(zip(sentences(t), sentences(t)[1:]))}
    assert {(r.doc_id, r.pair): r.shared for r in rows("shared_words")} == want
