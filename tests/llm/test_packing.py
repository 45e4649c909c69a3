import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from recollect.llm.packing import first_fit_decreasing, pack
from recollect.llm.tokens import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, grp long, start string"


def test_tree_is_first_fit_decreasing():
    r = random.Random(2)
    sizes = np.array([r.randint(1, 50) for _ in range(300)])
    bins, offsets = first_fit_decreasing(sizes, 64)
    room, want = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((j for j, x in enumerate(room) if x >= sizes[i]), len(room))
        if b == len(room):
            room.append(64)
        want[i] = (b, 64 - room[b])
        room[b] -= sizes[i]
    assert [(b, o) for b, o in zip(bins.tolist(), offsets.tolist())] == [want[i] for i in range(len(sizes))]


def rows():
    r = random.Random(3)
    texts = [None, "", "  ", "x" * 3000, "word, " * 5000] + [" ".join(r.choice(["alpha", "Beta.", "déjà", "42"]) for _ in range(r.randint(1, 900))) for _ in range(80)]
    return [(i, t, 1, "s") for i, t in enumerate(texts)] + [(3, "twice", 1, "s")]


def test_pack_and_counts(spark):
    data = rows()
    lib = Tokenizer.from_file(PATH)
    ids = [(d, lib.encode(t or "", add_special_tokens=False).ids) for d, t, *_ in data]
    df = spark.createDataFrame(data, SCHEMA)
    counted = sorted((x.doc_id, x.n_bytes, x.n_tokens, x.over_limit) for x in count_tokens(df, PATH, batch_bytes=2000).collect())
    assert counted == sorted((d, len((t or "").encode()), len(v), len(v) > 2048) for (d, t, *_), (_, v) in zip(data, ids))
    got = pack(df, PATH, capacity=512, per_group=40).collect()
    want = sorted((d, s, len(p), zlib.crc32(np.array(p, "<u4").tobytes()), len(v) + 1) for d, v in ids for s in range(0, len(v) + 1, 512) for p in [(v + [2])[s : s + 512]])
    assert sorted((x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got) == want
    seqs = defaultdict(list)
    for x in got:
        seqs[x.sequence_id].append((x.offset, x.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(seqs) * 512 <= 1.1 * sum(w[2] for w in want) + 3 * 512


def test_empty(spark):
    assert pack(spark.createDataFrame([], SCHEMA), PATH).collect() == [] and count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []
