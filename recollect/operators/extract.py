"""Facts of the old messages without a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T
from recollect.operators.window import COLUMNS, ORDER


def with_lines(old: DataFrame) -> DataFrame:
    """conv_id, turn, role, line_no, line of every message that is not blank."""
    df = old.select("conv_id", "turn", T.role_of(F.col("role")).alias("role"), T.trim(F.coalesce("content", F.lit(""))).alias("content")).where("content <> ''")
    return df.select("conv_id", "turn", "role", F.posexplode(T.lines_of(F.col("content"))).alias("line_no", "line"))


def bucket(line: Column, role: Column, lex: L.Lexicon = L.Lexicon()) -> Column:
    """The category of a line, null if it has none; the first that holds wins."""
    low = F.lower(line)
    return (
        F.when(T.units(line) > L.MAX_LINE, F.lit(None).cast("string"))
        .when(role == "assistant", F.when(T.preference(line, lex), "preferences"))
        .when(T.unresolved(line, role, lex), "open_questions")
        .when(T.contains_any(low, lex.completed), "completed")
        .when(T.contains_any(low, lex.decision), "decisions")
        .when(T.contains_any(low, lex.in_progress), "in_progress")
        .when(line.contains("?") & T.real_question(line, role, lex), "open_questions")
        .when(T.preference(line, lex), "preferences")
    )


def classify(lines: DataFrame, lex: L.Lexicon = L.Lexicon()) -> DataFrame:
    """conv_id, turn, line_no, bucket, fact of the lines that have a category."""
    df = lines.select("conv_id", "turn", "line_no", bucket(F.col("line"), F.col("role"), lex).alias("bucket"), F.substring("line", 1, L.CUT_LINE).alias("fact"))
    return df.where("bucket IS NOT NULL")


def distinct_facts(facts: DataFrame) -> DataFrame:
    """conv_id, bucket, fact, pos: each fact once, where it is first seen. Aggregates before the shuffle."""
    return facts.groupBy("conv_id", "bucket", "fact").agg(F.min(F.struct("turn", "line_no")).alias("pos"))


def top_facts(distinct: DataFrame) -> DataFrame:
    """The first facts of each category, up to its cap; rank from 1."""
    caps = F.create_map(*(F.lit(x) for kv in L.CAPS.items() for x in kv))
    rank = F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy("pos"))
    # The common cap lets Spark drop rows before the shuffle.
    return distinct.withColumn("rank", rank).where(F.col("rank") <= max(L.CAPS.values())).where(F.col("rank") <= caps[F.col("bucket")])


def facts_wide(top: DataFrame) -> DataFrame:
    """One row a conversation, an ordered array a category; no array is longer than its cap."""
    def of(name: str) -> Column:
        mine = F.collect_list(F.when(F.col("bucket") == name, F.struct("rank", "fact")))
        return F.transform(F.array_sort(mine), lambda x: x.fact).alias(name)

    return top.groupBy("conv_id").agg(*(of(b) for b in L.BUCKETS))


def user_messages(old: DataFrame) -> DataFrame:
    """User messages (a missing role is one) with urn, their number within the conversation from 1."""
    users = old.where(T.role_of(F.col("role")) == "user")
    return users.select("conv_id", "turn", F.coalesce("content", F.lit("")).alias("content"), F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER)).alias("urn"))


def named(content: Column, pattern: str, least: int) -> Column:
    """The cleaned first match of a naming pattern, null if there is none of `least` characters."""
    raw = F.regexp_extract(content, pattern, 1)
    return F.when(F.length(raw) >= least, T.clean_identifier(raw))


def names(content: Column) -> dict[str, Column]:
    """The three ways in which a message can name the project; null where it doesn't."""
    text = T.trim(content)
    building = named(text, T.BUILDING, 2)
    return {"called": named(text, T.CALLED, 2), "building": F.when(~F.lower(building).isin("a", "an", "the"), building), "scoped": named(text, T.SCOPED, 1)}


def project_candidates(users: DataFrame) -> DataFrame:
    """conv_id, urn, called, building, scoped of the first user messages."""
    return users.where(F.col("urn") <= L.FIRST_USERS).select("conv_id", "urn", *(c.alias(n) for n, c in names(F.col("content")).items()))


def first_sentence(content: Column, marks: str) -> Column:
    return T.trim(F.split(content, marks)[0])


def fallback_project(content: Column) -> Column:
    s = first_sentence(content, r"[.\n!?]")
    return F.when(T.units(s) >= L.MIN_LINE, T.trim(F.regexp_replace(F.substring(s, 1, L.MAX_PROJECT), "[?!]", ""))).otherwise("Not identified")


def projects(old: DataFrame) -> DataFrame:
    """conv_id, project of conversations with a user message: a name given, else built, else a scoped package, else the
    first sentence."""
    users = user_messages(old).where(F.col("urn") <= L.FIRST_USERS)
    first = lambda c: F.min(F.when(c.isNotNull(), F.struct("urn", c.alias("v"))))["v"]
    given = [first(c) for c in names(F.col("content")).values()]
    fallback = F.max(F.when(F.col("urn") == 1, fallback_project(F.col("content"))))
    return users.groupBy("conv_id").agg(F.coalesce(*given, fallback).alias("project"))


def fallback_sentence(content: Column) -> Column:
    """The first sentence of a message if its length fits, else null."""
    s = first_sentence(F.coalesce(content, F.lit("")), r"[.\n!?]+")
    return F.when(T.units(s).between(L.MIN_LINE, L.MAX_LINE), s)


def fallback_facts(old: DataFrame) -> DataFrame:
    """conv_id, fallback: first sentences of the user messages, the first few of fitting length, repeats included."""
    users = old.where(T.role_of(F.col("role")) == "user").select(*COLUMNS, fallback_sentence(F.col("content")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(*ORDER))
    few = users.where("s IS NOT NULL").withColumn("r", rank).where(F.col("r") <= L.FALLBACK_ITEMS)
    return few.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "s"))), lambda x: x.s).alias("fallback"))


def summaries(old: DataFrame, lex: L.Lexicon = L.Lexicon()) -> DataFrame:
    """conv_id, project and an array a category, for every conversation of old messages."""
    split = old.select(*COLUMNS, F.lit(None).cast("long").alias("n"), F.lit(True).alias("is_old"), F.lit(False).alias("is_tail"))
    return condense(split, lex).drop("n", "n_old", "n_tail", "original_tokens")


def condense(split: DataFrame, lex: L.Lexicon = L.Lexicon()) -> DataFrame:
    """conv_id, n, n_old, n_tail, original_tokens (of the old messages), project and an array a category.

    split: messages with n, is_old and is_tail, dealt by conversation. All steps work within conversations, so they
    need no further exchange, and no join. No array is longer than its cap."""
    order = Window.partitionBy("conv_id").orderBy(*ORDER)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    user = F.col("is_old") & (T.role_of(F.col("role")) == "user")
    df = split.select(*COLUMNS, "n", "is_old", "is_tail", F.when(user, fallback_sentence(F.col("content"))).alias("s"), user.alias("user"))
    count = lambda c: F.sum(c.cast("long")).over(running)
    df = df.select("*", F.row_number().over(order).alias("rn"), count(F.col("user")).alias("urn"), count(F.col("s").isNotNull()).alias("srn"))
    text = T.trim(F.coalesce("content", F.lit("")))
    said = F.coalesce("content", F.lit(""))
    person = F.struct("urn", *(c.alias(n) for n, c in names(said).items()), F.when(F.col("urn") == 1, fallback_project(said)).alias("fallback"))
    df = df.select(
        "conv_id", "n", "rn", "is_old", "is_tail", T.role_of(F.col("role")).alias("role"), F.when(F.col("is_old"), T.message_tokens(F.col("role"), F.col("content"))).alias("cost"),
        F.when(F.col("user") & (F.col("urn") <= L.FIRST_USERS), person).alias("person"), F.when(F.col("srn") <= L.FALLBACK_ITEMS, F.when(F.col("s").isNotNull(), F.struct("srn", "s"))).alias("said"),
        F.when(F.col("is_old") & (text != ""), T.lines_of(text)).alias("lines"),
    )
    df = df.select(*(c for c in df.columns if c != "lines"), F.posexplode_outer("lines").alias("line_no", "line"))
    # What holds for a message counts on the row of its first line.
    once = lambda c: F.when(F.coalesce("line_no", F.lit(0)) == 0, F.col(c))
    df = df.select(
        "conv_id", "n", "rn", "line_no", bucket(F.col("line"), F.col("role"), lex).alias("bucket"), F.substring("line", 1, L.CUT_LINE).alias("fact"),
        *(once(c).alias(c) for c in ("is_old", "is_tail", "cost", "person", "said")),
    )
    total = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    all_of = lambda c: F.flatten(F.collect_list(c)).alias(c)
    fact = F.when(F.col("bucket").isNotNull(), F.col("fact")).alias("fact")
    df = df.groupBy("conv_id", "bucket", fact).agg(F.min(F.struct("rn", "line_no")).alias("pos"), F.max("n").alias("n"), *map(total, ("is_old", "is_tail", "cost")), F.collect_list("person").alias("person"), F.collect_list("said").alias("said"))
    caps = F.create_map(*(F.lit(x) for kv in L.CAPS.items() for x in kv))
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "bucket").orderBy("pos")))
    # Rows beyond the caps lose their fact only: they still carry counts.
    df = df.withColumn("top", F.col("rank") <= caps[F.col("bucket")])
    of = lambda b: F.collect_list(F.when((F.col("bucket") == b) & F.col("top"), F.struct("rank", "fact"))).alias(b)
    df = df.groupBy("conv_id").agg(F.max("n").alias("n"), *map(total, ("is_old", "is_tail", "cost")), all_of("person"), all_of("said"), *map(of, L.BUCKETS))
    people, ordered = F.array_sort("person"), lambda c: F.transform(F.array_sort(c), lambda x: x.fact)
    first = lambda n: F.get(F.filter(F.transform(people, lambda x: x[n]), lambda v: v.isNotNull()), F.lit(0))
    project = F.coalesce(*map(first, ("called", "building", "scoped", "fallback")), F.lit("Not identified"))
    df = df.select(
        "conv_id", "n", F.col("is_old").alias("n_old"), F.col("is_tail").alias("n_tail"), F.coalesce("cost", F.lit(0)).cast("long").alias("original_tokens"), project.alias("project"),
        *(ordered(b).alias(b) for b in L.BUCKETS), F.transform(F.array_sort("said"), lambda x: x.s).alias("fallback"),
    )
    few = (F.size("decisions") + F.size("completed") + F.size("in_progress") + F.size("open_questions") < 3) & (F.col("n_old") > 10)
    more = F.slice(F.array_distinct(F.concat("in_progress", "fallback")), 1, L.FALLBACK_ITEMS)
    return df.withColumn("in_progress", F.when(few, more).otherwise(F.col("in_progress"))).drop("fallback")
