"""Prompt blocks and system prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import lexicon as L


def prompt_block(project: Column, facts: dict[str, Column]) -> Column:
    """The block of a structured summary; empty parts are left out."""
    parts = [F.when(project != "", F.concat(F.lit("Project: "), project))]
    parts += [F.when(F.size(facts[b]) > 0, F.concat(F.lit(f"{L.LABELS[b]}: "), F.array_join(facts[b], " | "))) for b in L.BUCKETS]
    return F.concat_ws("\n", F.lit(L.HEADER), *parts, F.lit(L.FOOTER))


def paragraph_block(paragraph: Column) -> Column:
    return F.concat(F.lit(L.HEADER + "\n"), paragraph, F.lit("\n" + L.FOOTER))


FIELDS = "project (a sentence), decisions, completed, inProgress, preferences, openQuestions (lists of short sentences)"
STRUCTURED_PROMPT = f"Condense the conversation into one JSON object with the fields {FIELDS}. State only what was said, be specific, leave a list empty if nothing fits, and answer with the JSON alone."
ENHANCE_PROMPT = f"You get a draft summary and the messages it came from. Correct and complete the draft, drop repetitions, add nothing that was not said, and answer with one JSON object with the fields {FIELDS} and nothing else."
PARAGRAPH_PROMPT = "Condense the conversation into one factual paragraph of at most five sentences, in the third person: subject, decisions, finished and running work, preferences, open questions. Answer with the paragraph alone."


def system_prompt(style: str) -> str:
    return {"structured": STRUCTURED_PROMPT, "paragraph": PARAGRAPH_PROMPT}[style]


def enhance_request(block: Column, transcript: Column) -> Column:
    """What the model is given to improve a draft."""
    return F.concat(F.lit("Draft:\n"), block, F.lit("\n\nMessages:\n"), transcript)
