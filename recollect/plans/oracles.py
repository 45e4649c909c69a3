"""DuckDB SQL of the conversation queries, composed from common table expressions."""

from __future__ import annotations

from recollect.functions import lexicon as L
from recollect.plans import event_messages

# White space and the forms of names, as in functions.text.
WS = r"\t\n\v\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
IDENT = r"([@\w][\w\-./@]*)"


#: Conversations of many turns with ties, one of them without an id; read alike by both engines. The chain, which joins
#: by conv_id, has -1 for null.
ODD_ID, ODD_TURN = "CASE WHEN conv_id % 10 > 0 THEN conv_id % 10 END", "CAST(floor(turn / 2) AS BIGINT)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def units(c: str) -> str:
    return f"CAST(length({c}) + length(regexp_replace({c}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')) AS BIGINT)"


def tokens(c: str) -> str:
    return f"coalesce(CAST(ceil({units(c)} / 4.0) AS BIGINT), 0)"


def any_of(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), {q(w)})" for w in words) + ")"


def words(c: str) -> str:
    return f"len(list_filter(string_split_regex({c}, '[{WS}]+'), lambda x: x <> ''))"


def greeting(c: str) -> str:
    low = f"lower({trim(c)})"
    bare = trim(f"regexp_replace({low}, '[?.!,]+$', '')")
    return f"({bare} IN ({', '.join(map(q, L.TRIVIAL))}) OR {words(low)} < 6 OR " + " OR ".join(f"starts_with({low}, {q(p)})" for p in L.GREETING_STARTS) + ")"


def preference(c: str) -> str:
    return f"({any_of(c, L.PREFERENCE)} OR regexp_matches(lower({c}), '\\b(?:i|please)[{WS}]+never use\\b'))"


def real(c: str, list_: tuple[str, ...]) -> str:
    return f"(role = 'user' AND NOT {greeting(c)} AND {any_of(c, list_)})"


def bucket(c: str) -> str:
    return (
        f"CASE WHEN {units(c)} > {L.MAX_LINE} THEN NULL WHEN role = 'assistant' THEN CASE WHEN {preference(c)} THEN 'preferences' END "
        f"WHEN {real(c, L.UNRESOLVED)} THEN 'open_questions' WHEN {any_of(c, L.COMPLETED)} THEN 'completed' WHEN {any_of(c, L.DECISION)} THEN 'decisions' "
        f"WHEN {any_of(c, L.IN_PROGRESS)} THEN 'in_progress' WHEN contains({c}, '?') AND {real(c, L.QUESTION_WORDS)} THEN 'open_questions' WHEN {preference(c)} THEN 'preferences' END"
    )


def clean(c: str) -> str:
    return trim(f"regexp_replace({c}, {q('''[.,;:!?)\\]}'\"]+$''')}, '')")


def named(pattern: str, least: int) -> str:
    raw = f"regexp_extract({trim('content')}, {q(pattern)}, 1)"
    return f"CASE WHEN length({raw}) >= {least} THEN {clean(raw)} END"


CALLED = rf"(?i)\b(?:called|named)[{WS}]+{IDENT}"
BUILDING = rf"(?i)\b(?:i am building|i'm building|building a|building|built|created)[{WS}]+{IDENT}"
SCOPED = r"(@[\w-]+/[\w][\w\-./]*)"


def with_(source: str, keep: int) -> dict[str, str]:
    """The chain of expressions by name; each uses those above it."""
    caps = " ".join(f"WHEN '{b}' THEN {n}" for b, n in L.CAPS.items())
    building = named(BUILDING, 2)
    fallback_sentence = trim("string_split_regex(content, '[.\\n!?]')[1]")
    few = trim("string_split_regex(content, '[.\\n!?]+')[1]")
    part = lambda b: f"CASE WHEN {b} <> '' THEN chr(10) || {q(L.LABELS[b] + ': ')} || {b} ELSE '' END"
    return {
        "msgs": {
            "conversations": "SELECT conv_id, turn, role, text AS content FROM conversations",
            "odd": f"SELECT coalesce({ODD_ID}, -1) AS conv_id, {ODD_TURN} AS turn, role, text AS content FROM conversations",
            "events": event_messages.sql("events"),
        }[source],
        "split": f"SELECT *, n > {keep} AND rn <= n - {keep} AS is_old FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role NULLS FIRST, content NULLS FIRST) AS rn FROM msgs)",
        "old": "SELECT conv_id, turn, rn, coalesce(nullif(role, ''), 'user') AS role, coalesce(content, '') AS content FROM split WHERE is_old",
        "cut": f"SELECT conv_id, turn, rn, role, c, list_filter(list_transform(string_split_regex(regexp_replace(c, '\\.([a-zA-Z0-9_-])', '___DOT___\\1', 'g'), '[.\\n!]+'), lambda x: {trim('''replace(x, '___DOT___', '.')''')}), lambda x: {units('x')} >= {L.MIN_LINE}) AS l FROM (SELECT *, {trim('content')} AS c FROM old) WHERE c <> ''",
        "lines": "SELECT conv_id, turn, rn, role, unnest(generate_series(0, len(ls) - 1)) AS line_no, unnest(ls) AS line FROM (SELECT *, CASE WHEN len(l) > 0 THEN l ELSE [c] END AS ls FROM cut)",
        "classified": f"SELECT * FROM (SELECT conv_id, turn, rn, line_no, {bucket('line')} AS bucket, substr(line, 1, {L.CUT_LINE}) AS fact FROM lines) WHERE bucket IS NOT NULL",
        "facts": "SELECT conv_id, bucket, fact, min(turn) AS turn, min(rn * 1000000 + line_no) AS pos FROM classified GROUP BY conv_id, bucket, fact",
        "ranked": f"SELECT *, row_number() OVER (PARTITION BY conv_id, bucket ORDER BY pos) AS rank FROM facts QUALIFY rank <= CASE bucket {caps} END",
        "users": "SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rn) AS urn FROM old WHERE role = 'user'",
        "candidates": f"SELECT conv_id, urn, {named(CALLED, 2)} AS called, CASE WHEN lower({building}) NOT IN ('a', 'an', 'the') THEN {building} END AS building, {named(SCOPED, 1)} AS scoped FROM users WHERE urn <= {L.FIRST_USERS}",
        "project_fallback": f"SELECT conv_id, CASE WHEN {units('s')} >= {L.MIN_LINE} THEN {trim(f'''regexp_replace(substr(s, 1, {L.MAX_PROJECT}), '[?!]', '', 'g')''')} ELSE 'Not identified' END AS fallback FROM (SELECT conv_id, {fallback_sentence} AS s FROM users WHERE urn = 1)",
        "projects": "SELECT conv_id, coalesce(min_by(called, urn) FILTER (called IS NOT NULL), min_by(building, urn) FILTER (building IS NOT NULL), min_by(scoped, urn) FILTER (scoped IS NOT NULL), max(fallback)) AS project FROM candidates LEFT JOIN project_fallback USING (conv_id) GROUP BY conv_id",
        "few": f"SELECT conv_id, s, row_number() OVER (PARTITION BY conv_id ORDER BY rn) AS r FROM (SELECT conv_id, rn, {few} AS s FROM users) WHERE {units('s')} BETWEEN {L.MIN_LINE} AND {L.MAX_LINE} QUALIFY r <= {L.FALLBACK_ITEMS}",
        "counts": "SELECT o.conv_id, o.n_old, coalesce(f.n, 0) AS n_facts FROM (SELECT conv_id, count(*) AS n_old FROM old GROUP BY conv_id) o LEFT JOIN (SELECT conv_id, count(*) AS n FROM ranked WHERE bucket <> 'preferences' GROUP BY conv_id) f USING (conv_id)",
        "extra": f"SELECT conv_id, fact, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS rank FROM (SELECT conv_id, fact, min(p) AS p FROM (SELECT conv_id, fact, rank AS p FROM ranked WHERE bucket = 'in_progress' UNION ALL SELECT conv_id, s, 1000 + r FROM few) JOIN counts USING (conv_id) WHERE n_facts < 3 AND n_old > 10 GROUP BY conv_id, fact) QUALIFY rank <= {L.FALLBACK_ITEMS}",
        "final": "SELECT conv_id, bucket, fact, rank FROM ranked LEFT JOIN counts USING (conv_id) WHERE bucket <> 'in_progress' OR NOT (n_facts < 3 AND n_old > 10) UNION ALL SELECT conv_id, 'in_progress', fact, rank FROM extra",
        "wide": "SELECT c.conv_id, coalesce(any_value(p.project), 'Not identified') AS project, " + ", ".join(f"coalesce(string_agg(f.fact, ' | ' ORDER BY f.rank) FILTER (f.bucket = '{b}'), '') AS {b}" for b in L.BUCKETS) + " FROM counts c LEFT JOIN final f USING (conv_id) LEFT JOIN projects p USING (conv_id) GROUP BY c.conv_id",
        "blocks": f"SELECT conv_id, {q(L.HEADER)} || CASE WHEN project <> '' THEN chr(10) || 'Project: ' || project ELSE '' END || " + " || ".join(part(b) for b in L.BUCKETS) + f" || chr(10) || {q(L.FOOTER)} AS prompt_block FROM wide",
        "stats": f"SELECT conv_id, count(*) AS n, CAST(sum(CASE WHEN is_old THEN 1 ELSE 0 END) AS BIGINT) AS n_old, CAST(sum(CASE WHEN is_old THEN 0 ELSE 1 END) AS BIGINT) AS n_tail, CAST(coalesce(sum(CASE WHEN is_old THEN {tokens(chr(34) + 'content' + chr(34))} + {tokens('role')} + 4 END), 0) AS BIGINT) AS original_tokens FROM split GROUP BY conv_id",
    }


def sql(source: str, keep: int, select: str) -> str:
    """A query over the chain, which is cut after the last name that it needs."""
    chain = with_(source, keep)
    return "WITH " + ", ".join(f'"{name}" AS ({body})' for name, body in chain.items()) + " " + select
