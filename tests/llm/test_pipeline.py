import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from recollect.llm.common import table
from tests.llm.test_minhash import brute as near_groups
from tests.llm.test_mixing import brute_targets
from tests.llm.test_pii import PLAIN, good

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    extra = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "src0", 0), (90003, "Write a@b.co, you!", "en", "zz", 18)], docs.schema)
    out = [docs.union(extra).cache()]
    for _, stage in P.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_filters(spark, stages):
    before, clean, single = (rows(x) for x in stages[:3])
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    gone = set(before) - set(clean)
    assert sum(labels.get(d, 0) == 0 for d in gone if d in labels) <= 2 and {90001, 90002, 90003} <= set(clean)
    assert sum(labels[d] for d in gone if d in labels) >= 0.6 * sum(labels.values())
    kept = {d for d, _, _, k in near_groups([(d, r.text) for d, r in clean.items()], 5) if k}
    assert set(single) == kept and all(single[d] == before[d] for d in single)


def test_masking(stages):
    single, masked = rows(stages[2]), rows(stages[3])
    assert set(single) == set(masked)
    for d, r in single.items():
        if r.text is None:
            assert masked[d].text is None
            continue
        has = any(good(k, m.group()) for k in PLAIN for m in re.finditer(PLAIN[k], r.text, re.A))
        left = any(good(k, m.group()) for k in PLAIN for m in re.finditer(PLAIN[k], masked[d].text, re.A))
        assert not left and (has or masked[d].text == r.text) and masked[d].n_chars == len(masked[d].text)


def test_mixture_and_packing(stages):
    masked, mixed, packed = rows(stages[3]), stages[4].collect(), stages[5].collect()
    copies = Counter(r.doc_id for r in mixed)
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for d, r in masked.items()}
    by, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for d, r in masked.items():
        by[r.source] += size[d]
        taken[r.source] += copies[d] * size[d]
        most[r.source] = max(most[r.source], size[d])
    want = brute_targets(dict(by))
    assert set(copies) <= set(masked) and max(copies.values()) <= 3
    assert all(abs(taken[s] - want[s]) <= most[s] + 1e-6 for s in by)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum((len(lib.encode(masked[d].text or "", add_special_tokens=False).ids) + 1) * n for d, n in copies.items())
    assert sum(x.length for x in packed) == total
    seqs = defaultdict(int)
    for x in packed:
        seqs[x.sequence_id] += x.length
    assert max(seqs.values()) <= 4096 and len(seqs) <= total / 4096 * 1.1 + 2
