"""Words and limits of the extraction rules."""

from __future__ import annotations

from dataclasses import dataclass

# Results must agree with these lists and limits exactly; a trailing blank counts.
DECISION = ("decided", "will use", "the plan", "going to", "we should", "i want", "let's use", "use ", "using ", "switch to", "changed to", "refactored", "installed", "configured", "chose", "selected", "picked", "going with", "decided on", "we will", "we are using", "eight", "three", "all data", "never in")
IN_PROGRESS = ("working on", "in progress", "need to", "still need", "todo", "to do", "not yet", "will do", "planning to", "about to", "currently", "refactor", "now let", "integrating", "next step", "after this", "about to start")
COMPLETED = ("completed", "finished", "built", "fixed", "added", "removed", "updated", "done", "is done", "are done", "shipped", "published", "works", "working", "no code changes", "no compilation")
UNRESOLVED = ("still pending", "fix is still", "pending", "unresolved", "not sure", "haven't decided", "tbd", "open question", "still undecided", "undecided")
QUESTION_WORDS = ("how", "what", "why", "when", "which", "where", "should", "can we", "is it", "will it", "could")
PREFERENCE = ("i prefer", "i want", "i like", "i need", "always respond", "always use", "please", "my style", "my preference", "keep it", "no inline", "in english", "in hindi", "respond in", "tone should", "style should", "format should")
GREETING_STARTS = ("ready ", "shall we", "what do you think", "does that", "make sense", "sound good", "thoughts?", "agree?", "right?", "cool?", "ok?", "good morning", "good evening", "hey ", "hey,", "hi ", "hi,", "hello")
TRIVIAL = ("thoughts", "agree", "right", "cool", "ok", "sure", "yes", "no", "maybe")
CAPS = {"decisions": 8, "completed": 8, "in_progress": 6, "preferences": 5, "open_questions": 6}
LABELS = {"decisions": "Decisions made", "completed": "Completed", "in_progress": "In progress", "preferences": "Preferences", "open_questions": "Open questions"}
HEADER, FOOTER = "=== CONVERSATION CONTEXT ===", "=== END CONTEXT ==="
CHUNK_SIZES = {"groq": 15, "openai": 30, "anthropic": 30, "deepseek": 30, "gemini": 20, "ollama": 30}
DEFAULT_CHUNK, DEFAULT_KEEP = 15, 10
MIN_LINE, MAX_LINE, CUT_LINE, MAX_PROJECT, FALLBACK_ITEMS, FIRST_USERS = 6, 160, 140, 60, 8, 8
BUCKETS = tuple(CAPS)


@dataclass(frozen=True)
class Lexicon:
    """The keyword lists, to be replaced as a whole where other ones are wanted."""

    decision: tuple[str, ...] = DECISION
    in_progress: tuple[str, ...] = IN_PROGRESS
    completed: tuple[str, ...] = COMPLETED
    unresolved: tuple[str, ...] = UNRESOLVED
    question: tuple[str, ...] = QUESTION_WORDS
    preference: tuple[str, ...] = PREFERENCE
    greeting: tuple[str, ...] = GREETING_STARTS
    trivial: tuple[str, ...] = TRIVIAL
