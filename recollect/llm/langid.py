"""Language identification with interpolated Kneser-Ney character models.

One model of order 4 a language, over lower-cased letters with every run of other characters as one blank. All models
share their arrays: the n-grams of an order, mixed to 64 bits and sorted, and beside them a column of log-probabilities
a language, already interpolated; contexts likewise with their back-off weights. A text is looked up once for all
languages. The lowest cross-entropy a character wins; a temperature fitted on texts kept from the models turns the
margins into a score, and texts that no model explains are marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import by_bytes, sent_once

ORDER, DISCOUNT, CHUNK = 4, 0.75, 400_000
LETTER = np.array([chr(c).isalpha() and not 0xD800 <= c < 0xE000 for c in range(1 << 16)])
UNKNOWN = "und"


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as 16-bit symbols (0: a run of non-letters; characters beyond 16 bits fold), each led by one blank;
    and where each text starts."""
    joined = "\0".join(["", *(t.lower().replace("\0", " ") for t in texts)])
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    start = code == 0
    sym = np.where(code < 1 << 16, np.where(LETTER[np.minimum(code, 0xFFFF)], code, 0), 1 << 15 | code & 0x7FFF).astype(np.uint64)
    keep = (sym != 0) | start
    keep[1:] |= sym[:-1] != 0
    return sym[keep], np.flatnonzero(start[keep])


def grams(sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each symbol, 16 bits each, padded by blanks at the start of a text."""
    at = np.arange(len(sym))
    since = at - np.repeat(starts, np.diff(np.append(starts, len(sym))))
    key = sym.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(sym)
        before[k:] = sym[:-k]
        before[since < k] = 0
        key |= before << np.uint64(16 * k)
    return key


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def low(key: np.ndarray, n: int) -> np.ndarray:
    """The last n symbols."""
    return key & np.uint64((1 << 16 * n) - 1)


@dataclass
class Level:
    """n-grams of one order and their contexts as sorted hash arrays, a column a language."""

    keys: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    back: np.ndarray

    @staticmethod
    def find(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = mixed(key)
        at = np.minimum(np.searchsorted(table, h), max(0, len(table) - 1))
        return at, (table[at] == h) if len(table) else np.zeros(len(h), bool)


@dataclass
class Models:
    langs: list[str]
    levels: list[Level]
    base: np.ndarray
    temperature: float = 1.0
    reject: np.ndarray | None = None

    def logp(self, key: np.ndarray, order: int = ORDER) -> np.ndarray:
        """log-probability of each n-gram's last symbol given the others, a column a language."""
        if order == 0:
            return np.broadcast_to(self.base, (len(key), len(self.langs)))
        level, part = self.levels[order - 1], low(key, order)
        at, hit = Level.find(level.keys, part)
        out = level.logp[at] if len(level.keys) else np.zeros((len(key), len(self.langs)), np.float32)
        if not hit.all():
            miss = ~hit
            lower = self.logp(key[miss], order - 1).copy()
            c, seen = Level.find(level.contexts, part[miss] >> np.uint64(16))
            lower[seen] += level.back[c[seen]]
            out[miss] = lower
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy a symbol of each text in each language, and the number of symbols."""
        total, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        sym, starts = symbols(texts)
        key = grams(sym, starts)
        own = np.repeat(np.arange(len(texts)), np.diff(np.append(starts, len(sym))))
        n += np.bincount(own, minlength=len(texts)) - 1
        scored = np.ones(len(sym), bool)
        scored[starts] = False
        key, own = key[scored], own[scored]
        for a in range(0, len(key), CHUNK):
            lp, o = self.logp(key[a : a + CHUNK]), own[a : a + CHUNK]
            first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
            total[o[first]] -= np.add.reduceat(lp, first, axis=0, dtype=np.float64)
        return total / np.maximum(n, 1)[:, None], n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejection of each text."""
        lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        best, rejected = np.full(len(texts), np.nan), np.ones(len(texts), bool)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        for group in _groups(known, texts):
            h, n = self.entropy([texts[i] for i in group])
            pick = h.argmin(1)
            margin = -(h - h.min(1, keepdims=True)) * (np.sqrt(n)[:, None] * self.temperature)
            p = 1 / np.exp(margin).sum(1)
            for j, i in enumerate(group):
                lang[i], score[i], best[i] = self.langs[pick[j]], p[j], h[j, pick[j]]
                rejected[i] = self.reject is not None and h[j, pick[j]] > self.reject[pick[j]]
        return lang, score, best, rejected


def _groups(rows: list[int], texts: list[str | None]) -> Iterator[list[int]]:
    held, size = [], 0
    for i in rows:
        held.append(i)
        size += len(texts[i])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def build(langs: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]]) -> Models:
    """Interpolated Kneser-Ney models from the ORDER-gram counts of each language."""
    uniform = max(1, len(np.unique(np.concatenate([low(k, 1) for k, _ in counted.values()])))) + 1
    levels: list[Level] = []
    by = {lang: counted[lang] for lang in langs}
    orders: list[dict] = []
    for order in range(ORDER, 0, -1):  # lower orders count the distinct symbols before an n-gram
        orders.insert(0, by)
        by = {lang: np.unique(low(k, order - 1), return_counts=True) for lang, (k, _) in by.items()} if order > 1 else by
    for order, by in enumerate(orders, 1):
        keys = np.unique(np.concatenate([k for k, _ in by.values()]))
        context_of = keys >> np.uint64(16)
        contexts = np.unique(context_of)
        p, back = np.zeros((len(keys), len(langs))), np.zeros((len(contexts), len(langs)))
        suffix = low(keys, order - 1)
        for j, lang in enumerate(langs):
            k, c = by[lang]
            ctx = np.searchsorted(contexts, k >> np.uint64(16))
            total = np.bincount(ctx, c, len(contexts))
            kinds = np.bincount(ctx, minlength=len(contexts))
            back[:, j] = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
            own = np.zeros(len(keys))
            own[np.searchsorted(keys, k)] = np.maximum(c - DISCOUNT, 0) / total[ctx]
            at = np.searchsorted(contexts, context_of)
            lower = np.full(len(keys), 1 / uniform) if order == 1 else probability[np.searchsorted(plain, suffix), j]
            p[:, j] = own + back[at, j] * lower
        probability, plain = p, keys
        ho, co = np.argsort(mixed(keys)), np.argsort(mixed(contexts))
        levels.append(Level(mixed(keys)[ho], np.log(p)[ho].astype(np.float32), mixed(contexts)[co], np.log(back)[co].astype(np.float32)))
    return Models(langs, levels, np.full(len(langs), -np.log(uniform), np.float32))


def train(docs: DataFrame, learnable: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 1500, seed: int = 41) -> Models:
    """Models of every language among learnable rows with text and language.

    Learns from about per_lang whole texts a language at most, drawn by a hash of the id; a tenth of them, and no less
    than what is needed, only sets temperature and rejection. No rows: a model without languages.
    """
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(n)
    if not langs:
        return Models([], [], np.zeros(0, np.float32))
    share = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, per_lang / n[lang]))])
    unit = lambda s: F.pmod(F.xxhash64(F.lit(s), "i"), F.lit(1 << 20)) / float(1 << 20)
    rows = rows.where(unit(seed) < share[F.col("lang")])
    tuning = unit(seed + 1) < 0.1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                sym, starts = symbols(texts)
                scored = np.ones(len(sym), bool)
                scored[starts] = False
                k, c = np.unique(grams(sym, starts)[scored], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c, pa.int64())], ["lang", "k", "c"])

    def counts(part: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        got = part.select("lang", "text").mapInArrow(count, "lang string, k long, c long").groupBy("lang", "k").agg(F.sum("c").alias("c")).toArrow()
        lang, k, c = (np.asarray(got.column(i).to_numpy(zero_copy_only=False)) for i in range(3))
        out = {}
        for x in langs:
            own = lang == x
            o = np.argsort(k[own].view(np.uint64))
            out[x] = (k[own].view(np.uint64)[o], c[own][o].astype(float))
        return out

    counted = counts(rows.where(~tuning))
    empty = [x for x in langs if not len(counted[x][0])]
    if empty:  # few texts: learn from the tuning texts as well
        counted = counts(rows)
    langs = [x for x in langs if len(counted[x][0])]
    if not langs:
        return Models([], [], np.zeros(0, np.float32))
    models = build(langs, {x: counted[x] for x in langs})

    def tune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_bytes(b, 1, rows=200):
                h, m = models.entropy(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(h), pa.list_(pa.float64())), pa.array(m)], ["lang", "h", "m"])

    # At most about a tenth of per_lang texts a language, a few numbers each.
    got = rows.where(tuning & F.col("lang").isin(langs)).select("lang", "text").mapInArrow(tune, "lang string, h array<double>, m double").collect()
    if got:
        h, m = np.array([r.h for r in got]), np.array([r.m for r in got])
        y = np.array([langs.index(r.lang) for r in got])

        def loss(t: float) -> float:
            z = -(h - h.min(1, keepdims=True)) * (np.sqrt(m)[:, None] * t)
            return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())

        models.temperature = min(np.geomspace(0.03, 30, 40).tolist(), key=loss)
        right = h.argmin(1) == y
        top = np.full(len(langs), h.min(1)[right].max() if right.any() else np.inf)
        for j in range(len(langs)):
            if (own := right & (y == j)).sum() >= 20:
                top[j] = np.quantile(h[own, j], 0.995)
        models.reject = top * 1.05
    return models


def identify(docs: DataFrame, models: Models, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, entropy, rejected of every row.

    A null text or one without a letter is `und`, score 0, rejected, entropy null; so is any text if no language was
    learned. Ties go to the language first by name. Repeated rows stay; an empty table gives no rows; other columns
    are not read. Very long texts are judged whole, scored in pieces.
    """
    sent = sent_once(docs.sparkSession, models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            models = sent.value
            for part in by_bytes(b, 1):
                texts = part.column(1).to_pylist()
                lang, score, h, rejected = models.predict(texts if models.langs else [None] * len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score), pa.array(h, from_pandas=True), pa.array(rejected)], ["id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang_pred string, score double, entropy double, rejected boolean").withColumnRenamed("id", id_col)
