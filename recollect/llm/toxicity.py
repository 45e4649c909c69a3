"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The labelled rows that may be learned from are cut in three by a hash of their id: the first part gives the learned
lexicon (words and word beginnings far more frequent in toxic texts), the second the trees, the third the calibration,
so no part judges what it has itself shaped. Each class is sampled to a documented bound and weighted back to its true
share. Scoring is one Arrow pass over whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import by_bytes, lean, sent_once

#: Insults in several languages and pronouns of the second person.
INSULTS = "idiot stupid moron loser pathetic disgusting scum trash clown worthless dumb imbecile hate ugly fool garbage vermin idiota estúpido imbécil basura asqueroso stupide crétin ordure abruti dumm trottel abschaum widerlich versager".split()
SECOND = set("you your yours yourself u ur du dein deine dich dir ihr euch tu te toi ton ta tes vous votre tú ti usted ustedes vos".split())
UNMASK = str.maketrans("013457@$!|€", "oieastasile")
STRIP = ".,;:!?\"'()[]{}*#%&-_~…«»"
FEATURES = ["log_words", "base_density", "base_any", "learned_density", "learned_weight", "learned_kinds", "masked_density", "near_second", "second_density", "capital_rate", "shout_rate", "punct_rate", "exclaim_rate", "symbol_rate", "digit_rate", "inside_rate", "repeat_rate"]
PREFIXES = (4, 5, 6)

_CLASS = np.zeros((256, 8), bool)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = [_c.isupper(), _c.isalpha(), _c in ".,;:", _c in "!?", _c in "*#%&@$^~|<>=+_\\", _c.isdigit(), False, False]
_CLASS[128:, 1] = True


def keys(word: str) -> list[str]:
    """The lexicon entries that a word can hit: itself and its beginnings."""
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


class Weigher(dict):
    """word -> (base hit, learned weight, masked base hit), filled as words are met; bounded."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned, self.base = learned, set(INSULTS)

    def __missing__(self, raw: str) -> tuple | None:
        w = raw.strip(STRIP)
        base = w in self.base
        learned = max((self.learned.get(k, 0.0) for k in keys(w)), default=0.0) if w else 0.0
        plain = w.translate(UNMASK) if w and not w.isalpha() else w
        masked = plain != w and plain in self.base
        if len(self) > 500_000:
            self.clear()
        self[raw] = got = (base, learned, masked, w in SECOND) if base or learned or masked or w in SECOND else None
        return got


def features(texts: list[str], weigher: Weigher) -> np.ndarray:
    """A row of FEATURES for each text; an empty text gives zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        n = len(words)
        marks = [(j, m) for j, m in enumerate(map(weigher.__getitem__, words)) if m]
        second = [j for j, m in marks if m[3]]
        hits = [j for j, m in marks if m[0] or m[1] or m[2]]
        near = np.searchsorted(second, np.array(hits) - 5) < np.searchsorted(second, np.array(hits) + 5, "right") if second and hits else np.zeros(1)
        b = np.frombuffer(text.encode(), np.uint8)
        c = _CLASS[b]
        up, letter, punct, exclaim, symbol, digit = c[:, :6].T
        sums = c[:, :6].sum(0) / len(b)
        inside = (letter[:-2] & (symbol[1:-1] | digit[1:-1]) & letter[2:]).sum() / n if len(b) > 2 else 0
        repeat = ((b[:-2] == b[1:-1]) & (b[1:-1] == b[2:]) & letter[2:]).sum() / n if len(b) > 2 else 0
        out[i] = [
            math.log1p(n), sum(m[0] for _, m in marks) / n, min(3, sum(m[0] for _, m in marks)),
            sum(m[1] > 0 for _, m in marks) / n, min(60.0, sum(m[1] for _, m in marks)), min(12, len({words[j] for j, m in marks if m[1]})),
            sum(m[2] for _, m in marks) / n, near.sum() / n, len(second) / n,
            sums[0], (up[1:] & up[:-1]).sum() / len(b), sums[2], sums[3], sums[4], sums[5], inside, repeat,
        ]
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth on quantile-binned features, logistic loss."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    penalty: float = 1.0
    least: float = 1.0  # curvature a child needs
    base: float = 0.0
    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros(x.shape, int)

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
        p = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        if len(x) < 4 or y.min() == y.max():
            return self
        b, score = self._binned(x), np.full(len(x), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-score))
            tree, leaf = self._grow(b, w * (y - q), w * q * (1 - q))
            self.trees.append(tree)
            score += tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, np.ndarray]:
        node, split_on, split_at = np.zeros(len(b), int), [], []
        width = self.bins + 1
        for level in range(self.depth):
            nodes = 1 << level
            best, on, at = np.full(nodes, 1e-6), np.zeros(nodes, int), np.full(nodes, width)
            for j in range(b.shape[1]):
                cell = node * width + b[:, j]
                gl = np.bincount(cell, g, nodes * width).reshape(nodes, width).cumsum(1)
                hl = np.bincount(cell, h, nodes * width).reshape(nodes, width).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty) - gt**2 / (ht + self.penalty)
                gain[(hl < self.least) | (ht - hl < self.least)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(nodes), k] > best
                best[better], on[better], at[better] = gain[np.arange(nodes), k][better], j, k[better]
            split_on.append(on)
            split_at.append(at)
            node = 2 * node + (b[np.arange(len(b)), on[node]] > at[node])
        leaves = 1 << self.depth
        value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)
        return (split_on, split_at, value), node

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, score, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for on, at, value in self.trees:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                node = 2 * node + (b[rows, on[level][node]] > at[level][node])
            score += value[node]
        return score


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted monotone fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for i in np.argsort(x, kind="stable").tolist():
        blocks.append([x[i], x[i], y[i] * w[i], w[i]])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            low = blocks.pop()
            blocks[-1] = [blocks[-1][0], low[1], blocks[-1][2] + low[2], blocks[-1][3] + low[3]]
    at = [v for b in blocks for v in (b[0], b[1])]
    return np.array(at), np.array([v for b in blocks for v in (b[2] / b[3],) * 2])


@dataclass
class Model:
    learned: dict[str, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, texts: list[str], weigher: Weigher) -> np.ndarray:
        raw = self.trees.raw(features(texts, weigher))
        p = 1 / (1 + np.exp(-raw))
        if len(self.knots[0]):
            # A trace of the raw score keeps the order within flat parts of the calibration.
            p = 0.995 * np.interp(raw, *self.knots) + 0.005 * p
        return np.clip(p, 0.0, 1.0)


def _share(seed: int, key: str) -> Column:
    """A number in [0, 1) by the id."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 20)) / float(1 << 20)


def train(docs: DataFrame, labels: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most_toxic: int = 6000, most_clean: int = 12000, seed: int = 31) -> Model:
    """Fit on labelled rows for which `learnable` holds, at most about most_toxic and most_clean of them.

    Several labels of one id count as toxic if any is; null ids and labels are left out. Without rows of both classes
    the trees stay empty and the score is the base rate.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learnable).groupBy(F.col(id_col).alias("lid")).agg(F.max(label_col).cast("int").alias("y"))
    n = dict(known.groupBy("y").count().collect())
    bound = {1: most_toxic, 0: most_clean}
    keep = {y: min(1.0, bound[y] / n[y]) for y in (0, 1) if n.get(y)}
    chosen = known.where(_share(seed, "lid") < F.when(F.col("y") == 1, keep.get(1, 0.0)).otherwise(keep.get(0, 0.0))).withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "lid"), F.lit(3)).cast("int"))
    # About most_toxic + most_clean rows at most, by construction.
    sample = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "lid").select("lid", "y", "part", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held = {w.strip(STRIP) for w in (text or "").lower().split()}
                found[y].update({k for w in held if 3 < len(w) < 40 for k in keys(w)})
                found[y]["\n"] += 1  # the number of texts
            for y in (0, 1):
                if found[y]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found[y])), pa.array([y] * len(found[y]), pa.int32()), pa.array(list(found[y].values()), pa.int64())], ["k", "y", "n"])

    counts = sample.where("part = 0").select("y", "text").mapInArrow(words, "k string, y int, n long").groupBy("k").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"))
    total = {y: max(1, round(n.get(y, 0) * keep.get(y, 0) / 3)) for y in (0, 1)}
    ratio = (F.col("t") / total[1]) / ((F.col("c") + 0.5) / total[0])
    rows = counts.where((F.col("k") != "\n") & (F.col("t") >= max(3, total[1] // 250)) & (ratio >= 12)).select("k", ratio.alias("r")).collect()
    learned = {r.k: min(6.0, math.log(r.r)) for r in rows}

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigher = Weigher(learned)
        for b in batches:
            x = features([t or "" for t in b.column(3).to_pylist()], weigher)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["lid", "y", "part", "x"])

    got = sample.where("part > 0").mapInArrow(dense, "lid long, y int, part int, x array<double>").toPandas().sort_values(["lid", "part"], kind="stable")
    x = np.array(got["x"].tolist()).reshape(len(got), len(FEATURES))
    y, part = got["y"].to_numpy(float), got["part"].to_numpy()
    w = np.where(y == 1, 1 / keep.get(1, 1.0), 1 / keep.get(0, 1.0))
    w = w / max(w.mean(), 1e-9) if len(w) else w
    trees = Trees().fit(x[part == 1], y[part == 1], w[part == 1])
    rest = part == 2
    both = rest.sum() >= 30 and 0 < y[rest].sum() < rest.sum()
    return Model(learned, trees, isotonic(trees.raw(x[rest]), y[rest], w[rest]) if both else (np.zeros(0), np.zeros(0)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted of every row. Null and empty texts score like any text without words; repeated
    rows stay; an empty table gives no rows; other columns are not read. Very long texts are judged whole."""
    sent = sent_once(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weigher = Weigher(model.learned)
        for b in batches:
            for part in by_bytes(b, 1):
                s = model.score([t or "" for t in part.column(1).to_pylist()], weigher)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "id long, score double, predicted int").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns; nothing is shuffled. Null texts stay or go as texts
    without words do; an empty table stays empty."""
    at = docs.columns.index(text_col)

    sent = sent_once(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        weigher = Weigher(model.learned)
        for b in batches:
            for part in by_bytes(b, at):
                s = model.score([t or "" for t in part.column(at).to_pylist()], weigher)
                yield part.filter(pa.array(s < 0.5))

    return docs.mapInArrow(lean(run), docs.schema)
