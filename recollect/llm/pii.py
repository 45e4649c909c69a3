"""Personal data by weak supervision, in DataFrame expressions alone.

Patterns give candidates with their places in the text. Labelers (strict pattern, gazetteer, context, shape) vote yes,
no or nothing on each. Expectation-maximisation over the counts of vote patterns estimates how reliable every labeler
is for every kind, and with that how likely each pattern is; a logistic span classifier is then trained on those
likelihoods from votes, kind and length. Both fits fold over arrays of bounded size (a row a pattern), so nothing but
counts is shuffled. Strict matches are always spans; the classifier adds others that it takes for personal data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: Matches, and code points of text, that are taken at once.
BLOCK, RUN = 256, 2048

#: The base patterns. Possessive runs and the look-behinds (or the end of the match before) find the same matches as
#: the plain forms, but in linear time and without recursion.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms that only the classifier can turn into spans.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?[A-Za-z0-9-]{1,63}+){1,5}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
}
#: Gazetteers (frequent top domains, calling codes, card issuers) and words nearby for and against.
GAZETTEER = {
    "email": r"(?i)(?:\.|dot ?[\])] ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|us|co)$",
    "ip": r"^(?!0|255\.)[0-9A-Fa-f]",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36)",
    "phone": r"^\+?\(?(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
NEAR = {"email": r"mail|contact|write|adress|correo|courriel", "ip": r"\bip\b|host|server|address|ping|adresse", "card": r"card|visa|mastercard|amex|credit|karte|carte|tarjeta", "phone": r"phone|\btel\b|\bcall\b|mobile|\bfax\b|telefon|téléphone|teléfono"}
AGAINST = r"version|isbn|issn|order|invoice|serial|license|licence|commit|sha\b|\bid\b"
LABELERS = 4


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _places(gaps: Column, found: Column) -> Column:
    """start (code points) of each match, from the gaps before them: prefix sums in two levels, so long lists stay cheap."""
    n = F.size(found)
    both = F.zip_with(F.slice(gaps, 1, n), found, lambda g, m: F.length(g) + F.length(m))
    total = lambda part: F.aggregate(part, F.lit(0), lambda s, x: s + x)
    sums = lambda of: F.transform(F.sequence(F.lit(0), F.floor(F.size(of) / BLOCK).cast("int")), lambda b: total(F.slice(of, b * BLOCK + 1, F.lit(BLOCK))))
    heads = lambda of: F.aggregate(sums(of), F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    block = lambda i: F.floor(i / BLOCK).cast("int")
    starts = lambda of, head: F.transform(gaps, lambda g, i: F.when(i < n, head[block(i)] + total(F.slice(of, block(i) * BLOCK + 1, i % BLOCK)) + F.length(g)))
    return F.when(n > 0, _bound(both, lambda of: _bound(heads(of), lambda head: starts(of, head)))).otherwise(F.array().cast("array<int>"))


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    digit = lambda i: F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)))
    return F.when(F.length(digits).between(1, 19), total % 10 == 0).otherwise(False)


OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})){3}$"


def _strict(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(OCTETS)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(8, 15)


def _shape(kind: str, value: Column) -> Column:
    """1, 0 or -1: digit counts, check digits and separators that fit the kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "email":
        return F.when(F.length(value) < 6, -1).when(F.length(value) <= 80, 1).otherwise(0)
    if kind == "ip":
        return F.when(value.contains(":"), 1).when(value.rlike(OCTETS), 1).otherwise(-1)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), F.when(_luhn(digits), 1).otherwise(-1)).otherwise(-1)
    return F.when(F.length(digits).between(10, 13), 1).when(F.length(digits).between(8, 15), 0).otherwise(-1)


def _votes(kind: str, value: Column, before: Column, strict: Column, loose: Column) -> Column:
    """1, 0 or -1 of each labeler. The strict pattern judges matches of its own form only."""
    near = F.lower(F.substring(before, -40, 40))
    return F.array(
        F.when(strict, 1).when(loose, 0).otherwise(-1),
        F.when(F.regexp_replace(value, "^[(+]", "").rlike(GAZETTEER[kind]) | value.rlike(GAZETTEER[kind]), 1).otherwise(0),
        F.when(near.rlike(NEAR[kind]), 1).when(near.rlike(AGAINST), -1).otherwise(0),
        _shape(kind, value),
    )


def candidates(docs: DataFrame, id_col: str, text_col: str, whole_rows: bool = False) -> DataFrame:
    """_id (with whole_rows a struct of all columns), c: array of (kind, start, end, base, free, votes, size) in the order of kinds and places.

    base: a strict match; free: a looser one that overlaps no strict match; others only teach the labelers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select((F.struct(*(docs[c] for c in docs.columns)) if whole_rows else F.col(id_col).cast("long")).alias("_id"), text.alias("_t"))
    may = {"email": F.col("_t").contains("@"), "phone": F.col("_t").contains("+"), "ip": F.col("_t").rlike("[0-9]"), "card": F.col("_t").rlike("[0-9]")}
    hint = {"email": F.col("_t").rlike(r"[\[(] ?(?:at|AT) ?[\])]"), "ip": F.col("_t").rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), "phone": F.col("_t").rlike("[0-9]{3}[ .-][0-9]{4}")}
    forms = [(k, "b", BASE[k], may[k]) for k in KINDS] + [(k, "l", LOOSE[k], hint[k]) for k in LOOSE]
    none = F.array().cast("array<string>")
    df = df.select("*", *(F.when(cond, F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}_{s}") for k, s, p, cond in forms))
    df = df.select("*", *(F.when(F.size(f"m_{k}_{s}") > 0, F.split("_t", p, -1)).otherwise(none).alias(f"g_{k}_{s}") for k, s, p, _ in forms))
    df = df.select("_id", *(c for k, s, _, _ in forms for c in (f"m_{k}_{s}", f"g_{k}_{s}")), *(_places(F.col(f"g_{k}_{s}"), F.col(f"m_{k}_{s}")).alias(f"p_{k}_{s}") for k, s, _, _ in forms))

    def structs(kind: str, s: str) -> Column:
        m, g, p = (F.col(f"{x}_{kind}_{s}") for x in "mgp")

        def one(value: Column, i: Column) -> Column:
            strict = _strict(kind, value) if s == "b" else F.lit(False)
            loose = F.lit(s == "l")
            if kind == "card":
                digits = F.regexp_replace(value, "[^0-9]", "")
                loose = F.when(F.length(digits).between(13, 15), _luhn(digits)).otherwise(False)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), p[i].alias("start"), (p[i] + F.length(value)).alias("end"), strict.alias("base"), loose.alias("free"),
                _votes(kind, value, g[i], strict, loose).alias("votes"), F.least(F.lit(3), F.floor(F.length(value) / 8)).cast("int").alias("size"),
            )

        return F.transform(m, one)

    joined = F.concat(*(structs(k, s) for k, s, _, _ in forms))
    df = df.select("_id", joined.alias("j")).select("_id", F.filter("j", lambda c: c.base).alias("b"), F.filter("j", lambda c: ~c.base).alias("o"))
    clear = F.transform("o", lambda c: c.withField("free", c.free & ~F.exists("b", lambda x: (x.start < c.end) & (c.start < x.end))))
    return df.select("_id", F.array_sort(F.concat("b", F.when(F.size("o") > 0, clear).otherwise(F.col("o")))).alias("c"))


@dataclass
class Model:
    """reliability: per kind the prior and P(vote | class) of each labeler; weights of the span classifier."""

    reliability: dict[str, list[float]]
    weights: list[float]


ROUNDS, STEPS, WEIGHTS = 25, 80, 1 + len(KINDS) + 2 * LABELERS + 4


def _em(rounds: int) -> str:
    """theta = [prior, P(vote -1, 0, 1 | no) and P(... | yes) of labeler 1, of labeler 2, ...] from column p, an array
    of (votes, n): each round weighs the patterns by their likelihood and counts anew."""
    at = lambda j, y: f"th[1 + {6 * j + 3 * y} + q.votes[{j}] + 1]"
    yes = " * ".join(["th[0]", *(at(j, 1) for j in range(LABELERS))])
    no = " * ".join(["(1 - th[0])", *(at(j, 0) for j in range(LABELERS))])
    weighed = f"transform(p, q -> struct(q.votes AS votes, q.n * ({yes}) / ({yes} + {no}) AS r, q.n * ({no}) / ({yes} + {no}) AS s))"
    total = lambda what, where="true": f"aggregate(w, 0D, (a, x) -> a + IF({where}, {what}, 0D))"
    cells = [f"({total('x.' + 'sr'[y], f'x.votes[{j}] = {v}')} + 0.5D) / ({total('x.' + 'sr'[y])} + 1.5D)" for j in range(LABELERS) for y in (0, 1) for v in (-1, 0, 1)]
    prior = f"({total('x.r')} + 1D) / ({total('x.r')} + {total('x.s')} + 2D)"
    new = f"transform(array({weighed}), w -> array({prior}, {', '.join(cells)}))[0]"
    start = ", ".join(["0.5D", *(["0.7D, 0.2D, 0.1D, 0.1D, 0.2D, 0.7D"] * LABELERS)])
    return f"aggregate(sequence(1, {rounds}), array({start}), (th, i) -> {new})"


def _likely(theta: str) -> str:
    at = lambda j, y: f"{theta}[1 + {6 * j + 3 * y} + votes[{j}] + 1]"
    yes = " * ".join([f"{theta}[0]", *(at(j, 1) for j in range(LABELERS))])
    no = " * ".join([f"(1 - {theta}[0])", *(at(j, 0) for j in range(LABELERS))])
    return f"({yes}) / ({yes} + {no})"


def _inputs(votes: Column, kind: Column, size: Column) -> Column:
    """Inputs of the classifier: 1, kind, yes and no of each labeler, length class."""
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.array(F.lit(1.0), *(one(kind == k) for k in range(len(KINDS))), *(one(votes[j] == v) for j in range(LABELERS) for v in (1, -1)), *(one(size == s) for s in range(4)))


def _logistic(steps: int) -> str:
    """Weights by full-batch gradient steps over column p, an array of (x, n, y); n sums to 1."""
    dot = "aggregate(zip_with(wt, q.x, (a, b) -> a * b), 0D, (a, b) -> a + b)"
    errors = f"transform(p, q -> struct(q.x AS x, q.n * (q.y - 1 / (1 + exp(-({dot})))) AS e))"
    step = f"transform(array({errors}), es -> transform(wt, (v, k) -> v * 0.999D + 4D * aggregate(es, 0D, (a, z) -> a + z.e * z.x[k])))[0]"
    return f"aggregate(sequence(1, {steps}), array_repeat(0D, {WEIGHTS}), (wt, i) -> {step})"


def fit(found: DataFrame) -> Model:
    """Reliabilities and classifier from all candidates. At most 81 vote patterns a kind and four lengths each."""
    one = found.select(F.explode("c").alias("c")).select("c.kind", "c.votes", "c.size").groupBy("kind", "votes", "size").agg(F.count("*").cast("double").alias("n"))
    patterns = cut(one)
    theta = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p")).select("kind", F.expr(_em(ROUNDS)).alias("theta"))
    theta = cut(theta)
    soft = patterns.join(theta, "kind").select("kind", "votes", "size", "n", F.expr(_likely("theta")).alias("y"))
    total = patterns.agg(F.sum("n")).first()[0]
    reliability = {KINDS[r.kind]: list(r.theta) for r in theta.collect()}  # a row a kind
    if not total:
        return Model({}, [0.0] * WEIGHTS)
    p = F.array_sort(F.collect_list(F.struct(_inputs(F.col("votes"), F.col("kind"), F.col("size")).alias("x"), (F.col("n") / total).alias("n"), F.col("y").alias("y"))))
    return Model(reliability, list(soft.agg(p.alias("p")).select(F.expr(_logistic(STEPS)).alias("w")).first().w))


def find(found: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """_id, base, spans: arrays of (kind, start, end), in the order of kinds and places."""
    w = [F.lit(float(x)) for x in model.weights]

    def score(c: Column) -> Column:
        x = _inputs(c.votes, c.kind, c["size"])
        return 1 / (1 + F.exp(-F.aggregate(F.zip_with(F.array(*w), x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)))

    span = lambda c: F.struct(c.kind.alias("kind"), c.start.alias("start"), c.end.alias("end"))
    taken = F.filter("c", lambda c: c.base | (c.free & (score(c) >= least)))
    return found.select("_id", F.transform(F.filter("c", lambda c: c.base), span).alias("base"), F.transform(taken, span).alias("spans"))


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, base and spans (arrays of kind index, start, end in code points) of every row.

    Null and empty texts have none. Repeated rows stay; null ids are rows like others; an empty table gives no rows;
    other columns are not read. Very long texts are searched whole. Labelers and classifier learn from all rows; what
    the classifier takes for personal data with probability `least` or more becomes a span."""
    found = cut(candidates(docs, id_col, text_col))
    return find(found, fit(found), least).withColumnRenamed("_id", id_col)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", names[c.kind], c.start.cast("string"), c.end.cast("string"))), ",")


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone of the base spans, base_sha256, spans."""
    count = lambda k: F.size(F.filter("base", lambda c: c.kind == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def mask(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs with every span in text_col replaced by its kind in brackets; other columns and null texts stay as they are.

    The text is read twice, once to learn and once to mask, and never shuffled. An empty table stays empty."""
    model = fit(cut(candidates(docs, id_col, text_col)))
    found = find(candidates(docs, id_col, text_col, whole_rows=True), model, least)
    return found.select(*((masked(F.col("_id")[c], F.col("spans")) if c == text_col else F.col("_id")[c]).alias(c) for c in docs.columns))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span (overlaps joined) replaced by [KIND] of the one that starts first.

    Text and spans are taken in blocks, so the time is linear in both."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    size = F.length(text)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(size / RUN).cast("int")), lambda b: F.substring(text, b * RUN + 1, F.lit(RUN)))
    by_start = F.array_sort(F.transform(spans, lambda c: F.struct(c.start.alias("start"), (-c.end).alias("rest"), c.kind.alias("kind"))))
    state = lambda out, at: F.struct(out.alias("out"), at.alias("at"))
    none = F.array().cast("array<string>")

    def piece(parts: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / RUN).cast("int"), F.floor((end - 1) / RUN).cast("int")
        return F.when(end > start, F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), start % RUN + 1, end - start)).otherwise("")

    def fold(parts: Column, ordered: Column) -> Column:
        # From the left: what is written so far and where the text goes on.
        one = lambda a, c: F.when(c.start < a["at"], state(a.out, F.greatest(a["at"], -c.rest))).otherwise(state(F.concat(a.out, F.array(piece(parts, a["at"], c.start), names[c.kind])), -c.rest))
        some = lambda a, b: F.aggregate(F.slice(ordered, b * BLOCK + 1, F.lit(BLOCK)), state(none, a["at"]), one, lambda x: state(F.concat(a.out, F.array(F.array_join(x.out, ""))), x["at"]))
        number = F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / BLOCK).cast("int"))
        return F.aggregate(number, state(none, F.lit(0)), some, lambda a: F.concat(F.array_join(a.out, ""), piece(parts, a["at"], size)))

    return F.when(F.size(spans) > 0, _bound(blocks, lambda parts: _bound(by_start, lambda ordered: fold(parts, ordered)))).otherwise(text)
