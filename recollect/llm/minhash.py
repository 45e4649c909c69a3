"""Near-duplicate documents by MinHash: banding, signature and exact verification, connected components.

1. Every document becomes a set of hashed word shingles, and that 128 minima of universal hashes. Documents with equal
   sets are one class from here on; only a class's smallest id goes further.
2. Banding puts classes that agree on four minima into one bucket. In each bucket all members meet one centre, the
   member of least hash, so a group of near copies costs a row a member and not a row a pair. Only ids travel; the few
   centres with very many members are listed in a table of proven size, and their joins are dealt out by member too.
3. A pair must agree on enough of its signature (two bits a minimum are carried), then its full sets are compared.
4. Components of the verified links come from alternating large-star and small-star.
5. Whatever the stars missed lies between members of one bucket, so between members of one centre, in different
   components. Those are compared in tiles of bounded size: by signature first, and members that agree with any go on
   to the comparison of full sets. Only links that join components leave a tile. No such link is left out, and links
   within a component change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import by_bytes, cut, lean

MINIMA, ROWS = 128, 4
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += np.uint64(32)
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_R = np.random.default_rng(2024)
MULTIPLIERS = (_R.integers(0, 1 << 63, MINIMA, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
OFFSETS = _R.integers(0, 1 << 63, MINIMA, dtype=np.uint64)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """A 64-bit hash of every word of every text: runs of bytes other than white space, A-Z lower-cased."""
    raw = [t.encode() for t in texts]
    b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = SPACE[b]
    begin = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(begin):
        return [np.zeros(0, np.uint64)] * len(texts)
    at = np.arange(len(b))
    place = at - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, len(b)]))
    value = (LOWER[b] + np.uint64(1)) * (mix((place.astype(np.uint64) + np.uint64(1)) * GOLD) | np.uint64(1))
    value[space] = 0
    h = mix(np.add.reduceat(value, begin))
    edge = np.cumsum([0, *(len(r) + 1 for r in raw)])
    cuts = np.searchsorted(begin, edge)
    return [h[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of `size` words; with fewer words, of the whole sequence; none without words."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    acc = np.full(n, np.uint64(min(size, len(words)))) * GOLD
    for j in range(min(size, len(words))):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + words[j : j + n])
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MINIMA minima of 32-bit universal hashes."""
    low = np.full(MINIMA, np.uint64(0xFFFFFFFF))
    for a in range(0, len(shingles), 2048):
        np.minimum(low, ((MULTIPLIERS[:, None] * shingles[None, a : a + 2048] + OFFSETS[:, None]) >> np.uint64(32)).min(1), out=low)
    return low


def bands(sig: np.ndarray) -> np.ndarray:
    acc = np.arange(MINIMA // ROWS, dtype=np.uint64) * GOLD
    for r in range(ROWS):
        acc = mix(acc + sig[r::ROWS] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    return acc.view(np.int64)


def sketch(sig: np.ndarray) -> bytes:
    """The two lowest bits of each minimum."""
    return np.packbits(np.concatenate([sig & np.uint64(1), sig >> np.uint64(1) & np.uint64(1)]).astype(np.uint8)).tobytes()


_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of minima on which sketches agree; a, b: rows of bytes, broadcast against each other."""
    half, x = MINIMA // 8, a ^ b
    return MINIMA - _BITS[x[..., :half] | x[..., half:]].sum(-1, dtype=np.int32)


def least_agreement(percent: int) -> int:
    """Five deviations below what a pair at the threshold shows (two random bits agree in a quarter of cases)."""
    j = percent / 100
    p = j + (1 - j) / 4
    return int(MINIMA * (p - 5 * (p * (1 - p) / MINIMA) ** 0.5))


PROFILE = "id long, n long, k1 long, k2 long, bands array<long>, sk binary"


def profile(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: set size, 128-bit key of the set, band hashes and sketch (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, 1, rows=128):
                n, k1, k2, band, sk = [], [], [], [], []
                for words in word_hashes([t or "" for t in part.column(1).to_pylist()]):
                    x = shingle_set(words, size)
                    n.append(len(x))
                    if not len(x):
                        for c in (k1, k2, band, sk):
                            c.append(None)
                        continue
                    k1.append(int(mix(x).sum(dtype=np.uint64).astype(np.int64)))
                    k2.append(int(mix(x * GOLD + np.uint64(7)).sum(dtype=np.uint64).astype(np.int64)))
                    sig = signature(x)
                    band.append(bands(sig))
                    sk.append(sketch(sig))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(band, pa.list_(pa.int64())), pa.array(sk, pa.binary())], ["id", "n", "k1", "k2", "bands", "sk"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), PROFILE)


class Hot:
    """Centres of more than `bound` members, with the number of parts that their rows are dealt out to.

    A document is in at most MINIMA / ROWS buckets, so with bound >= 32 * documents / MOST there are at most MOST such
    centres, and the table may be broadcast at any size of the input."""

    MOST = 50_000

    def __init__(self, stars: DataFrame, documents: int, least: int = 1000):
        bound = max(least, -(-(MINIMA // ROWS) * documents // self.MOST))
        self.table = cut(stars.groupBy(F.col("a").alias("hot")).agg(F.ceil(F.count("*") / bound).cast("int").alias("parts")).where("parts > 1"))

    def member(self, df: DataFrame, centre: str, member: str) -> DataFrame:
        """df with part, that of the row's member."""
        df = df.join(F.broadcast(self.table), F.col(centre) == F.col("hot"), "left").drop("hot")
        return df.withColumn("part", F.pmod(F.xxhash64(member), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")

    def centre(self, df: DataFrame, centre: str) -> DataFrame:
        """df, a row a centre, with a row for each part."""
        df = df.join(F.broadcast(self.table), F.col(centre) == F.col("hot"), "left").drop("hot")
        return df.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def verified(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of (a, b, ta, tb) whose full sets have 100 * shared >= percent * joint. An id may have several
    texts: any may give the link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for b in batches:
            for part in by_bytes(b, 3, rows=64):
                ids = part.column(0).to_pylist()
                sets = [shingle_set(w, size) for w in word_hashes([t or "" for t in part.column(3).to_pylist()])]
                keep = []
                for i, text in enumerate(part.column(2).to_pylist()):
                    if (ids[i], text) != last:
                        last, held = (ids[i], text), shingle_set(word_hashes([text or ""])[0], size)
                    shared = len(np.intersect1d(held, sets[i], assume_unique=True))
                    keep.append(100 * shared >= percent * (len(held) + len(sets[i]) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, root of every node of the links (a, b): the smallest id reachable. Alternates large-star and small-star
    until nothing changes; each round is written to the shared folder."""
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m"))
        edges = cut(small.distinct())


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Number of shared shingles of each (left, right) pair that is wanted; others may be left 0.

    Few pairs are intersected one by one; many as a product of incidence matrices, whose columns are the shingles that
    more than one set holds, a block at a time."""
    out = np.zeros(wanted.shape, np.int64)
    value = np.concatenate([*left, *right])
    if wanted.sum() * 60 < wanted.size or len(value) > 40 * len(left) * len(right):
        for i, j in zip(*np.nonzero(wanted), strict=True):
            out[i, j] = len(np.intersect1d(left[i], right[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, code, count = np.unique(value, return_inverse=True, return_counts=True)
    common = count > 1
    column = np.cumsum(common) - 1
    keep = common[code]
    owner, code = owner[keep], column[code[keep]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for first in range(0, int(common.sum()), 2048):
        lo, hi = np.searchsorted(code, [first, first + 2048])
        held = np.zeros((len(left) + len(right), 2048), np.float32)
        held[owner[lo:hi], code[lo:hi] - first] = 1
        out += (held[: len(left)] @ held[len(left) :].T).astype(np.int64)
    return out


def alike(group: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one pair of tiles: rows of either tile that agree with one of another root, and which agree with which."""
    roots, own = group.column("root").to_numpy(), group.column("t").to_numpy()
    sk = np.frombuffer(b"".join(group.column("sk").to_pylist()), np.uint8).reshape(len(roots), -1)
    left, right = np.flatnonzero(own == group.column("i")[0].as_py()), np.flatnonzero(own == group.column("j")[0].as_py())
    like = np.zeros((len(left), len(right)), bool)
    for s in range(0, len(left), 64):
        rows = left[s : s + 64]
        like[s : s + 64] = (agreement(sk[rows][:, None], sk[right][None]) >= least) & (roots[rows][:, None] != roots[right][None])
    keep, also = like.any(1), like.any(0)
    return left[keep], right[also], like[keep][:, also]


def within(group: pa.Table, size: int, percent: int, least: int) -> pa.Table:
    """Links (a, b) between different roots of one pair of tiles, as many as join what is linked and no more."""
    ids, roots = group.column("id").to_numpy(), group.column("root").to_numpy()
    left, right, like = alike(group, least)
    found: list[tuple[int, int]] = []
    if like.any():
        used = np.union1d(left, right)
        column = group.column("text").take(pa.array(used)).to_pylist()
        sets = dict(zip(used.tolist(), (shingle_set(w, size) for w in word_hashes([t or "" for t in column])), strict=True))
        x, y = [sets[i] for i in left.tolist()], [sets[i] for i in right.tolist()]
        shared = shared_counts(x, y, like)
        joint = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y])[None] - shared
        above = {}

        def top(r: int) -> int:
            while (up := above.get(r, r)) != r:
                r = up
            return r

        for i, j in zip(*np.nonzero(like & (100 * shared >= percent * joint)), strict=True):
            p, q = top(int(roots[left[i]])), top(int(roots[right[j]]))
            if p != q:
                above[max(p, q)] = min(p, q)
                found.append((int(ids[left[i]]), int(ids[right[j]])))
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


CELL = "centre long, i int, j int, id long, root long, t int, sk binary"


def leftovers(members: DataFrame, hot: Hot, texts: DataFrame, size: int, percent: int, least: int, tile: int) -> DataFrame:
    """Links between members of different roots around one centre. members: centre, id, root, sk, n.

    A centre's members are cut in tiles of about `tile` documents and 600 shingles each on average; each pair of tiles
    is one group, so no task holds more than two of them, and pairs that are not linked never leave it. A member meets
    every tile by its sketch of 32 bytes, so m members make m * m / tile such rows; texts follow only for members that
    agree with one of another root."""
    weight = F.greatest(F.count("*") / tile, F.sum("n") / (600 * tile))
    apart = members.groupBy("centre").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(weight).cast("int").alias("tiles")).where("r0 <> r1").select("centre", "tiles")
    cells = hot.member(members, "centre", "id").join(hot.centre(apart, "centre"), ["centre", "part"])
    cells = cells.withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    cells = cells.select("centre", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "id", "root", "t", "sk")

    def agreeing(group: pa.Table) -> pa.Table:
        left, right, _ = alike(group, least)
        return group.take(pa.array(np.union1d(left, right)))

    wanted = cut(cells.groupBy("centre", "i", "j").applyInArrow(agreeing, CELL))
    if wanted.isEmpty():
        return wanted.select(F.col("id").alias("a"), F.col("id").alias("b"))
    return wanted.join(texts, "id").select("centre", "i", "j", "id", "root", "t", "sk", "text").groupBy("centre", "i", "j").applyInArrow(lambda g: within(g, size, percent, least), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", tile: int = 2000) -> DataFrame:
    """id, n_shingles, component_id, kept of every row.

    Two documents are linked if their sets of `words`-word shingles share at least percent % of their union.
    component_id is the smallest id reachable, kept tells whether it is the row's own. A text without words, or null,
    has an empty set and is linked with nothing. Rows repeated under one id are one document with the links of all.
    A null id takes no part: component_id null, kept true. An empty table gives no rows; other columns are not read.
    Very long texts are worked on whole, one at a time.
    """
    rows = cut(profile(docs, words, id_col, text_col))
    classes = cut(rows.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sk").alias("sk")))
    member = classes.select("id", F.explode("bands").alias("h"))
    centres = member.groupBy("h").agg(F.min(F.struct(F.xxhash64("id").alias("o"), "id")).alias("c"), F.count("*").alias("total")).where("total > 1").select("h", F.col("c.id").alias("centre"))
    stars = cut(member.join(centres, "h").where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct())
    hot = Hot(stars, classes.count())
    least = least_agreement(percent)
    sketches = classes.select("id", "sk")
    both = hot.member(stars, "a", "b").join(sketches.select(F.col("id").alias("b"), "sk"), "b").join(hot.centre(sketches.select(F.col("id").alias("a"), F.col("sk").alias("csk")), "a"), ["a", "part"])
    x = [F.conv(F.hex(F.substring(c, 1 + 8 * i, 8)), 16, -10).cast("long") for c in ("sk", "csk") for i in range(4)]
    differ = [x[i].bitwiseXOR(x[4 + i]) for i in range(4)]
    agree = MINIMA - F.bit_count(differ[0].bitwiseOR(differ[2])) - F.bit_count(differ[1].bitwiseOR(differ[3]))
    tested = cut(both.where(agree >= least).select("a", "b", "part"))

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # The texts are dealt out by id once, for members and centres; those of the centres go on to their parts.
    centre_texts = tested.select("a", "part").distinct().join(texts, F.col("a") == F.col("id")).select("a", "part", F.col("text").alias("ta"))
    member_texts = tested.join(texts, F.col("b") == F.col("id")).select("a", "b", "part", F.col("text").alias("tb"))
    pairs = member_texts.join(centre_texts, ["a", "part"])
    links = cut(verified(pairs, words, percent))
    same = rows.where("n > 0 AND id IS NOT NULL").join(classes.select("k1", "k2", F.col("id").alias("rep")), ["k1", "k2"]).select("id", "rep")
    roots = components(links)
    # All members of a centre's buckets, tested against it or not: a link a star missed joins two of them.
    members = stars.select(F.col("a").alias("centre"), F.col("b").alias("id")).join(roots, "id", "left").join(classes.select("id", "n", "sk"), "id").select("centre", "id", "sk", "n", F.coalesce("root", "id").alias("root"))
    more = cut(leftovers(members, hot, texts, words, percent, least, tile))
    if not more.isEmpty():
        roots = components(links.union(more))
    linked = same.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    # Copies hang on their class's representative: one more look-up instead of one more round.
    by_id = same.groupBy("id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    if not by_id.where("rep <> other").isEmpty():  # an id with different texts joins their classes
        roots = components(roots.select(F.col("root").alias("a"), F.col("id").alias("b")).union(linked))
    found = by_id.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    out = rows.select("id", "n").join(found, "id", "left")
    component = F.coalesce("root", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of near copies, that of the smallest id; null ids and other rows stay. Of rows
    repeated under one id one stays. An empty table stays empty."""
    found = near_duplicates(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    gone = found.where("NOT kept").select(F.col(id_col).alias("_gone")).distinct()
    left = docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
    n = docs.where(F.col(id_col).isNotNull()).agg(F.count(id_col), F.countDistinct(id_col)).first()
    if n[0] == n[1]:
        return left
    return left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(left.where(F.col(id_col).isNull()))
