"""Text rules as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions import lexicon as L

# All white space that ECMAScript knows, as a character class for Java patterns and as characters.
SPACES = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BLANKS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A word boundary between ASCII characters only.
NO_WORD_BEFORE, NO_WORD_AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# Text in which DOT stands for a dot is written back as one; the forms in which a message names a project;
# the marks that are cut off behind a name.
DOT = "___DOT___"
IDENT = r"([@A-Za-z0-9_][A-Za-z0-9_\-./@]*)"
CALLED = rf"(?i){NO_WORD_BEFORE}(?:called|named)[{SPACES}]+{IDENT}"
BUILDING = rf"(?i){NO_WORD_BEFORE}(?:i am building|i'm building|building a|building|built|created)[{SPACES}]+{IDENT}"
SCOPED = r"(@[A-Za-z0-9_-]+/[A-Za-z0-9_][A-Za-z0-9_\-./]*)"
TRAILING = r"""[.,;:!?)\]}'"]+$"""


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def spaced(c: Column) -> Column:
    """All white space as blanks: patterns over ASCII alone are several times faster."""
    return F.translate(c, BLANKS, " " * len(BLANKS))


def any_of(words: tuple[str, ...]) -> str:
    """A pattern for one of the words as they are."""
    return "|".join(rf"\Q{w}\E" for w in words)


def units(c: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def contains_any(lower: Column, words: tuple[str, ...]) -> Column:
    return lower.rlike(any_of(words))


def role_of(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("user"))


def lines_of(content: Column) -> Column:
    """Sentences of a trimmed text: cut at line ends, exclamation marks and dots that no name goes on after. Without
    one of MIN_LINE units the whole text is the only line."""
    parts = F.transform(F.split(content, r"(?:[\n!]|\.(?![a-zA-Z0-9_-]))+"), lambda x: trim(F.replace(x, F.lit(DOT), F.lit("."))))
    return F.transform(F.array(F.filter(parts, lambda x: units(x) >= L.MIN_LINE)), lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(content)))[0]


def n_words(c: Column) -> Column:
    return F.regexp_count(spaced(c), F.lit("[^ ]+"))


def greeting_like(line: Column, lex: L.Lexicon = L.Lexicon()) -> Column:
    low = F.lower(trim(line))
    bare = trim(F.regexp_replace(low, r"[?.!,]+$", ""))
    return bare.isin(*lex.trivial) | (n_words(low) < 6) | low.rlike(f"^(?:{any_of(lex.greeting)})")


def real_question(line: Column, role: Column, lex: L.Lexicon = L.Lexicon()) -> Column:
    return (role == "user") & contains_any(F.lower(line), lex.question) & ~greeting_like(line, lex)


def unresolved(line: Column, role: Column, lex: L.Lexicon = L.Lexicon()) -> Column:
    return (role == "user") & contains_any(F.lower(line), lex.unresolved) & ~greeting_like(line, lex)


def preference(line: Column, lex: L.Lexicon = L.Lexicon()) -> Column:
    low = F.lower(line)
    return contains_any(low, lex.preference) | low.rlike(rf"{NO_WORD_BEFORE}(?:i|please)[{SPACES}]+never use{NO_WORD_AFTER}")


def clean_identifier(c: Column) -> Column:
    return trim(F.regexp_replace(c, TRAILING, ""))


def tokens(c: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-16 units, rounded up; null and empty texts have none."""
    return F.coalesce(F.ceil(units(c) / 4), F.lit(0)).cast("long")


def message_tokens(role: Column, content: Column) -> Column:
    """Estimated tokens of one message; a null content counts as the text null."""
    return tokens(F.coalesce(content, F.lit("null"))) + tokens(role) + 4


def word_set(c: Column) -> Column:
    """Distinct words of three letters or more, ASCII letters and digits only."""
    bare = F.regexp_replace(spaced(F.lower(c)), "[^a-z0-9 ]", "")
    return F.array_distinct(F.filter(F.split(bare, " "), lambda w: F.length(w) >= 3))


def shared_words(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(word_set(a), word_set(b)))
