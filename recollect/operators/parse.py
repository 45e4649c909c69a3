"""Replies of a language model to summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T

#: Names of the categories in replies.
JSON_NAMES = {"decisions": "decisions", "completed": "completed", "in_progress": "inProgress", "preferences": "preferences", "open_questions": "openQuestions"}
PLACEHOLDER = "Context from previous conversation"


def strip_fences(reply: Column) -> Column:
    out = F.regexp_replace(T.trim(reply), rf"(?i)^```json[{T.SPACES}]*", "")
    out = F.regexp_replace(out, rf"(?i)^```[{T.SPACES}]*", "")
    return F.regexp_replace(out, rf"[{T.SPACES}]*```$", "")


def json_part(reply: Column) -> Column:
    """From the first opening to the last closing brace, if there are such."""
    bare = strip_fences(reply)
    part = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(part != "", part).otherwise(bare)


def without_done(items: Column, completed: Column, least: int = 3) -> Column:
    """Items that share fewer than `least` words with every completed one. Word sets are computed once an item."""

    def kept(done: Column) -> Column:
        far = lambda w: ~F.exists(done, lambda y: F.size(F.array_intersect(w, y)) >= least)
        return F.filter(items, lambda x: F.transform(F.array(T.word_set(x)), far)[0])

    return F.transform(F.array(F.transform(completed, T.word_set)), kept)[0]


def parse_reply(reply: Column, categories: tuple[str, ...] = ("project", *L.BUCKETS)) -> Column:
    """Struct of project, an array a category, and raw (the reply if it could not be read, else null).

    Fields of another type and categories not asked for are empty. Numbers and other values in lists become text,
    but where completed is not empty a value that is no string in the lists compared with it makes the reply
    unreadable."""
    none = F.array().cast("array<string>")

    def field(v: Column, name: str) -> Column:
        raw = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(raw).startswith("ARRAY"), F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), none)).otherwise(none)

    def kind(v: Column, name: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")), F.lit("VOID"))

    def odd(v: Column, name: str) -> Column:
        return kind(v, name).startswith("ARRAY") & ~kind(v, name).isin("ARRAY<STRING>", "ARRAY<VOID>")

    def read(v: Column) -> Column:
        asked = {b: field(v, JSON_NAMES[b]) if b in categories else none for b in L.BUCKETS}
        project = F.when(kind(v, "project") == "STRING", F.try_variant_get(v, "$.project", "string")).otherwise("") if "project" in categories else F.lit("")
        done = asked["completed"]
        some = F.size(done) > 0
        kept = asked | {b: F.when(some, without_done(asked[b], done)).otherwise(asked[b]) for b in ("decisions", "in_progress")}
        bad = v.isNull() | (F.schema_of_variant(v) == "VOID")
        bad = bad | (some & (odd(v, "completed") | odd(v, "decisions") | odd(v, "inProgress")) & ((F.size(asked["decisions"]) > 0) | (F.size(asked["in_progress"]) > 0)))
        return F.when(F.coalesce(bad, F.lit(True)), failed).otherwise(F.struct(project.alias("project"), *(kept[b].alias(b) for b in L.BUCKETS), F.lit(None).cast("string").alias("raw")))

    failed = F.struct(F.lit(PLACEHOLDER).alias("project"), *(none.alias(b) for b in L.BUCKETS), reply.alias("raw"))
    # The parser reads the first value and ignores what follows: a closing brace must end it.
    return F.transform(F.array(F.try_parse_json(json_part(reply))), read)[0]
