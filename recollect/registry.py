"""Every query of the conversation engine with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T
from recollect.operators import extract, merge, parse, providers, render, window
from recollect.plans import compaction, oracles
from recollect.plans.event_messages import from_events
from recollect.sources import messages as formats

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Real conversations have 2 to 8 turns; those made from events have dozens.
SOURCES = {"conversations": 2, "events": 10}


def read(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    if source == "events":
        return from_events(spark, sf_dir)
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    if source == "odd":
        table = table.select(F.expr(oracles.ODD_ID).alias("conv_id"), F.expr(oracles.ODD_TURN).alias("turn"), "role", "text")
    return window.messages(table)


def over_both(name: str, build: Callable[[DataFrame], DataFrame], select: str, old: bool = True, keep: dict[str, int] = SOURCES) -> None:
    """Register build over the split messages (the old ones only, if `old`) of both sources, or those of `keep`."""
    for source, keep in keep.items():
        def run(spark: SparkSession, sf_dir: str, source: str = source, keep: int = keep) -> DataFrame:
            split = window.split_window(read(spark, sf_dir, source), keep)
            return build(split.where("is_old") if old else split)

        key = name if source == "conversations" else f"{name}_events"
        QUERIES[key] = run
        ORACLES[key] = oracles.sql(source, keep, select)


def text_of(df: DataFrame, *names: str) -> DataFrame:
    """Arrays as text, so that both engines compare alike."""
    return df.select("conv_id", *(F.array_join(c, " | ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes if c in names))


WIDE = ("project", *L.BUCKETS)
facts = lambda old: extract.top_facts(extract.distinct_facts(extract.classify(extract.with_lines(old))))
lines_of = extract.with_lines

over_both("window_split", lambda s: s.select("conv_id", "turn", "role", "content", "is_old"), "SELECT conv_id, turn, role, content, is_old FROM split", old=False)
over_both("window_counts", lambda s: compaction.token_stats(s).select("conv_id", "n", "n_old", "n_tail"), "SELECT conv_id, n, n_old, n_tail FROM stats", old=False)
over_both("passthrough_meta", lambda s: compaction.token_stats(s).where("n_old = 0").select("conv_id", F.lit("passthrough").alias("mode"), F.col("n").alias("kept_raw")), "SELECT conv_id, 'passthrough' AS mode, n AS kept_raw FROM stats WHERE n_old = 0", old=False, keep=SOURCES | {"events": 60})
over_both("message_tokens", lambda s: s.select("conv_id", "turn", T.message_tokens(F.col("role"), F.col("content")).alias("tokens")), f"SELECT conv_id, turn, CAST({oracles.tokens('content')} + {oracles.tokens('role')} + 4 AS BIGINT) AS tokens FROM split", old=False)
over_both("conversation_tokens", lambda s: compaction.token_stats(s).select("conv_id", "original_tokens"), "SELECT conv_id, original_tokens FROM stats", old=False)
over_both("split_lines", lambda o: lines_of(o).select("conv_id", "turn", F.col("line_no").cast("long").alias("line_no"), "line"), "SELECT conv_id, turn, line_no, line FROM lines")
over_both("line_filter", lambda o: lines_of(o).where(T.units(F.col("line")) <= L.MAX_LINE).select("conv_id", "turn", F.col("line_no").cast("long").alias("line_no"), F.substring("line", 1, L.CUT_LINE).alias("line")), f"SELECT conv_id, turn, line_no, substr(line, 1, {L.CUT_LINE}) AS line FROM lines WHERE {oracles.units('line')} <= {L.MAX_LINE}")
over_both("keyword_flags", lambda o: lines_of(o).select("conv_id", "turn", F.col("line_no").cast("long").alias("line_no"), *(T.contains_any(F.lower("line"), w).alias(n) for n, w in (("decision", L.DECISION), ("completed", L.COMPLETED), ("progress", L.IN_PROGRESS), ("question", L.QUESTION_WORDS))), T.preference(F.col("line")).alias("preference")), f"SELECT conv_id, turn, line_no, {oracles.any_of('line', L.DECISION)} AS decision, {oracles.any_of('line', L.COMPLETED)} AS completed, {oracles.any_of('line', L.IN_PROGRESS)} AS progress, {oracles.any_of('line', L.QUESTION_WORDS)} AS question, {oracles.preference('line')} AS preference FROM lines")
over_both("greeting_flags", lambda o: lines_of(o).select("conv_id", "turn", F.col("line_no").cast("long").alias("line_no"), T.greeting_like(F.col("line")).alias("greeting"), T.real_question(F.col("line"), F.col("role")).alias("real_question"), T.unresolved(F.col("line"), F.col("role")).alias("unresolved")), f"SELECT conv_id, turn, line_no, {oracles.greeting('line')} AS greeting, {oracles.real('line', L.QUESTION_WORDS)} AS real_question, {oracles.real('line', L.UNRESOLVED)} AS unresolved FROM lines")
over_both("classify_lines", lambda o: extract.classify(lines_of(o)).select("conv_id", "turn", F.col("line_no").cast("long").alias("line_no"), "bucket", "fact"), "SELECT conv_id, turn, line_no, bucket, fact FROM classified")
over_both("bucket_counts", lambda o: extract.classify(lines_of(o)).groupBy("bucket").agg(F.count("*").alias("n")), "SELECT bucket, count(*) AS n FROM classified GROUP BY bucket")
over_both("bucket_dedup", lambda o: extract.distinct_facts(extract.classify(lines_of(o))).select("conv_id", "bucket", "fact", F.col("pos.turn").alias("turn")), "SELECT conv_id, bucket, fact, turn FROM facts")
over_both("bucket_topk", lambda o: facts(o).select("conv_id", "bucket", F.col("rank").cast("long").alias("rank"), "fact"), "SELECT conv_id, bucket, rank, fact FROM ranked")
for _name in ("called", "building", "scoped"):
    over_both(f"project_{_name}", lambda o, c=_name: extract.project_candidates(extract.user_messages(o)).where(F.col(c).isNotNull()).select("conv_id", F.col("urn").cast("long").alias("urn"), F.col(c).alias("name")), f"SELECT conv_id, urn, {_name} AS name FROM candidates WHERE {_name} IS NOT NULL", keep={"events": 10})
over_both("project_fallback", lambda o: extract.user_messages(o).where("urn = 1").select("conv_id", extract.fallback_project(F.col("content")).alias("fallback")), "SELECT conv_id, fallback FROM project_fallback")
over_both("project_name", extract.projects, "SELECT conv_id, project FROM projects")
over_both("fallback_facts", lambda o: text_of(extract.fallback_facts(o), "fallback"), "SELECT conv_id, string_agg(s, ' | ' ORDER BY r) AS fallback FROM few GROUP BY conv_id")
over_both("summary_wide", lambda o: text_of(extract.summaries(o), *WIDE), f"SELECT conv_id, {', '.join(WIDE)} FROM wide")
over_both("prompt_block", lambda s: compaction.token_free(s).where("n_old > 0").select("conv_id", "prompt_block"), "SELECT conv_id, prompt_block FROM blocks", old=False)
over_both("chunk_assign", lambda o: window.with_chunks(o, 15).select("conv_id", "turn", "chunk_id"), "SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY rn) - 1) // 15 AS chunk_id FROM old")
over_both("transcript", lambda o: window.transcripts(o, "conv_id"), "SELECT conv_id, string_agg(upper(role) || ': ' || content, chr(10) || chr(10) ORDER BY rn) AS transcript FROM old GROUP BY conv_id")
WORDS = f"list_distinct(list_filter(string_split_regex(regexp_replace(lower(X), '[^a-z0-9{oracles.WS}]', '', 'g'), '[{oracles.WS}]+'), lambda w: length(w) >= 3))"
over_both("word_tokens", lambda o: o.select("conv_id", "turn", F.array_join(F.array_sort(T.word_set(F.col("content"))), " ").alias("words")), f"SELECT conv_id, turn, coalesce(array_to_string(list_sort({WORDS.replace('X', 'content')}), ' '), '') AS words FROM old")
over_both("paragraph_block", lambda o: o.select("conv_id", "turn", render.paragraph_block(T.trim(F.col("content"))).alias("block")), f"SELECT conv_id, turn, {oracles.q(L.HEADER)} || chr(10) || {oracles.trim('content')} || chr(10) || {oracles.q(L.FOOTER)} AS block FROM old")

RESULT = "SELECT s.conv_id, CASE WHEN n_old = 0 THEN 'passthrough' ELSE 'token-free' END AS mode, w.project, " + ", ".join(f"w.{b}" for b in L.BUCKETS) + f", b.prompt_block, s.n AS original_message_count, s.n_old AS compressed_count, s.n_tail AS kept_raw, CAST(0 AS BIGINT) AS token_count, CAST(CASE WHEN n_old = 0 THEN 0 ELSE greatest(0, original_tokens - {oracles.tokens('b.prompt_block')}) END AS BIGINT) AS saved_token_count FROM stats s LEFT JOIN wide w USING (conv_id) LEFT JOIN blocks b USING (conv_id)"
META = ("mode", "original_message_count", "compressed_count", "kept_raw", "token_count", "saved_token_count")


def whole(name: str, build: Callable[[DataFrame, int], DataFrame], select: str | None) -> None:
    """Register build over all messages and the number to keep, of both sources."""
    for source, keep in SOURCES.items():
        key = name if source == "conversations" else f"{name}_events"
        QUERIES[key] = lambda spark, sf_dir, source=source, keep=keep: build(read(spark, sf_dir, source), keep)
        if select:
            ORACLES[key] = oracles.sql(source, keep, select)


whole("compaction", lambda m, k: text_of(compaction.compact(m, k), *WIDE, *META, "prompt_block"), RESULT)
whole("result_meta", lambda m, k: compaction.compact(m, k).select("conv_id", *META), f"SELECT conv_id, {', '.join(META)} FROM ({RESULT})")
whole("savings", lambda m, k: compaction.compact(m, k).where("compressed_count > 0").select("conv_id", "saved_token_count"), f"SELECT conv_id, saved_token_count FROM ({RESULT}) WHERE compressed_count > 0")
whole("result_messages", lambda m, k: compaction.result_messages(m, compaction.compact(m, k), k), "SELECT conv_id, CAST(-1 AS BIGINT) AS turn, 'system' AS role, prompt_block AS content FROM blocks UNION ALL SELECT conv_id, turn, role, content FROM split WHERE NOT is_old")
whole("prompt_format", lambda m, k: formats.prompt_texts(compaction.compact(m, k)), f"SELECT s.conv_id, coalesce(prompt_block, {oracles.q(formats.NOTHING)}) AS prompt FROM stats s LEFT JOIN blocks USING (conv_id)")

# The stub of a model answers with the longest line that it is given, as the only completed item, and counts a token for
# four characters.
_TRANSCRIPT = "string_agg(upper(role) || ': ' || content, chr(10) || chr(10) ORDER BY rn)"
_ASKED = {
    "ai_stub": f"SELECT o.conv_id, 0 AS chunk_id, 'Draft:' || chr(10) || any_value(prompt_block) || chr(10) || chr(10) || 'Messages:' || chr(10) || {_TRANSCRIPT} AS u FROM old o JOIN blocks USING (conv_id) GROUP BY o.conv_id",
    "ai_chunked_stub": f"SELECT conv_id, chunk_id, {_TRANSCRIPT} AS u FROM (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY rn) - 1) // 15 AS chunk_id FROM old) GROUP BY conv_id, chunk_id",
}
_LONGEST = f"list_sort(list_transform(list_filter(list_transform(string_split(u, chr(10)), lambda x: {oracles.trim('x')}), lambda x: x <> ''), lambda x: {{'n': length(x), 's': x}}), 'DESC')[1].s"


def stub_sql(name: str) -> str:
    """The result of compaction by the stub, chunk by chunk or at once."""
    replies = f"SELECT conv_id, chunk_id, length(u) // 4 AS tokens, substr({_LONGEST}, 1, 100) AS longest FROM ({_ASKED[name]})"
    lists = f"SELECT conv_id, sum(tokens) AS tokens, list(longest ORDER BY chunk_id) AS done, list({{'s': longest, 'w': {WORDS.replace('X', 'longest')}}} ORDER BY chunk_id) AS pairs FROM ({replies}) GROUP BY conv_id"
    made = f"SELECT conv_id, tokens, array_to_string(CASE WHEN len(done) > 1 THEN {fold_sql('pairs')} ELSE done END, ' | ') AS done FROM ({lists})"
    block = f"{oracles.q(L.HEADER)} || chr(10) || 'Project: stub' || chr(10) || '{L.LABELS['completed']}: ' || done || chr(10) || {oracles.q(L.FOOTER)}"
    given = lambda v: f"CASE WHEN n_old > 0 THEN {v} END"
    return (
        f"SELECT s.conv_id, CASE WHEN n_old = 0 THEN 'passthrough' ELSE 'ai' END AS mode, {given(oracles.q('stub'))} AS project, done AS completed, "
        + ", ".join(f"{given(oracles.q(''))} AS {b}" for b in L.BUCKETS if b != "completed")
        + ", n AS original_message_count, n_old AS compressed_count, n_tail AS kept_raw, CAST(coalesce(tokens, 0) AS BIGINT) AS token_count, "
        + f"CAST(CASE WHEN n_old = 0 THEN 0 ELSE greatest(0, original_tokens - {oracles.tokens(block)}) END AS BIGINT) AS saved_token_count FROM stats s LEFT JOIN ({made}) USING (conv_id)"
    )


def paragraph_sql() -> str:
    """As stub_sql, for paragraphs: the last reply as it is. Replies are plain ASCII without quotes in the event messages."""
    last = f"SELECT conv_id, sum(length(u) // 4) AS tokens, max_by(substr({_LONGEST}, 1, 100), chunk_id) AS longest FROM ({_ASKED['ai_chunked_stub']}) GROUP BY conv_id"
    made = f"""SELECT conv_id, tokens, '{{"project": "stub", "completed": ["' || longest || '"]}}' AS paragraph FROM ({last})"""
    block = f"{oracles.q(L.HEADER)} || chr(10) || paragraph || chr(10) || {oracles.q(L.FOOTER)}"
    return (
        "SELECT s.conv_id, CASE WHEN n_old = 0 THEN 'passthrough' ELSE 'ai' END AS mode, paragraph, n AS original_message_count, n_old AS compressed_count, n_tail AS kept_raw, "
        f"CAST(coalesce(tokens, 0) AS BIGINT) AS token_count, CAST(CASE WHEN n_old = 0 THEN 0 ELSE greatest(0, original_tokens - {oracles.tokens(block)}) END AS BIGINT) AS saved_token_count FROM stats s LEFT JOIN ({made}) USING (conv_id)"
    )


def fold_sql(items: str) -> str:
    """The fold of merge.overlap_dedup over a list of structs of a text s and its words w."""
    first = "list_position(list_transform(a, lambda k: len(list_intersect(k.w, c.w)) >= 2), true)"
    swapped = f"list_transform(a, lambda k, i: CASE WHEN i = p AND {oracles.units('c.s')} > {oracles.units('k.s')} THEN c ELSE k END)"
    step = f"list_transform([{first}], lambda p: CASE WHEN p > 0 THEN {swapped} ELSE list_append(a, c) END)[1]"
    return f"list_transform(list_reduce({items}, lambda a, c: {step}, {items}[1:0]), lambda k: k.s)"


whole("ai_stub", lambda m, k: text_of(compaction.compact(m, k, ask=providers.stub), *WIDE, *META), stub_sql("ai_stub"))
whole("ai_chunked_stub", lambda m, k: text_of(compaction.compact(m, k, ask=providers.stub, provider="groq", chunked=True), *WIDE, *META), stub_sql("ai_chunked_stub"))
whole("paragraph_stub", lambda m, k: text_of(compaction.compact(m, k, ask=providers.stub, style="paragraph"), "paragraph", *META), None)
ORACLES["paragraph_stub_events"] = oracles.sql("events", 10, paragraph_sql())

# Conversations with a null id and tied turns.
ODD_KEEP = 4
_ODD = lambda select: oracles.sql("odd", ODD_KEEP, f"SELECT * REPLACE (nullif(conv_id, -1) AS conv_id) FROM ({select})")
QUERIES["window_split_odd"] = lambda spark, sf_dir: window.split_window(read(spark, sf_dir, "odd"), ODD_KEEP).select("conv_id", "turn", "role", "content", "is_old")
ORACLES["window_split_odd"] = _ODD("SELECT conv_id, turn, role, content, is_old FROM split")
QUERIES["compaction_odd"] = lambda spark, sf_dir: text_of(compaction.compact(read(spark, sf_dir, "odd"), ODD_KEEP), *WIDE, *META, "prompt_block")
ORACLES["compaction_odd"] = _ODD(RESULT)
QUERIES["ai_stub_odd"] = lambda spark, sf_dir: text_of(compaction.compact(read(spark, sf_dir, "odd"), ODD_KEEP, ask=providers.stub), *WIDE, *META)
ORACLES["ai_stub_odd"] = _ODD(stub_sql("ai_stub"))


def result_odd(spark: SparkSession, sf_dir: str) -> DataFrame:
    msgs = read(spark, sf_dir, "odd")
    return compaction.result_messages(msgs, compaction.compact(msgs, ODD_KEEP), ODD_KEEP)


QUERIES["result_messages_odd"] = result_odd
ORACLES["result_messages_odd"] = _ODD("SELECT conv_id, CAST(-1 AS BIGINT) AS turn, 'system' AS role, prompt_block AS content FROM blocks UNION ALL SELECT conv_id, turn, role, content FROM split WHERE NOT is_old")


def keep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keep_last of 0 and -2, as compat allows them."""
    msgs = read(spark, sf_dir, "conversations")
    one = lambda k: window.split_window(msgs, k, compat=True).select(F.lit(k).alias("keep_last"), "conv_id", "turn", "is_old", "is_tail")
    return one(0).union(one(-2))


QUERIES["window_keep_edges"] = keep_edges
ORACLES["window_keep_edges"] = oracles.sql("conversations", 2, "SELECT k AS keep_last, conv_id, turn, true AS is_old, rn > -k AS is_tail FROM split, (VALUES (0), (-2)) v(k)")


def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as a JSON array of messages, read back."""
    msgs = read(spark, sf_dir, "conversations")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return formats.exploded(msgs.groupBy("conv_id").agg(F.to_json(F.transform(ordered, lambda m: F.struct(m.role.alias("role"), m.content.alias("content")))).alias("value")))


QUERIES["json_source"] = json_source
ORACLES["json_source"] = oracles.sql("conversations", 2, "SELECT conv_id, rn - 1 AS turn, role, content FROM split")


def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([(x,) for x in ("groq", "OpenAI", "anthropic", "deepseek", "GEMINI", "ollama", "other")], "provider string")
    return names.select("provider", window.chunk_size(F.col("provider")).alias("chunk_size"))


QUERIES["chunk_sizes"] = chunk_sizes
ORACLES["chunk_sizes"] = "SELECT * FROM (VALUES ('groq', CAST(15 AS BIGINT)), ('OpenAI', 30), ('anthropic', 30), ('deepseek', 30), ('GEMINI', 20), ('ollama', 30), ('other', 15)) t(provider, chunk_size)"


def sentence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of sentences with common words: those of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parts = F.filter(F.transform(F.split(F.col("text"), r"[.\n]+"), T.trim), lambda x: F.length(x) >= 6)
    return docs.select("doc_id", parts.alias("items"))


def neighbours(lists: DataFrame) -> DataFrame:
    """doc_id, pair, shared: words common to each item and the next; pair counts from 1."""
    words = F.transform("items", T.word_set)
    shared = F.transform(F.sequence(F.lit(1), F.size("items") - 1), lambda i: F.size(F.array_intersect(F.col("words")[i - 1], F.col("words")[i])).cast("long"))
    df = lists.where(F.size("items") > 1).select("doc_id", "items", words.alias("words")).select("doc_id", F.posexplode(shared).alias("pair", "shared"))
    return df.select("doc_id", (F.col("pair") + 1).cast("long").alias("pair"), "shared")


SENTENCES = (
    f"SELECT doc_id, list_transform(items, lambda y: {{'s': y, 'w': {WORDS.replace('X', 'y')}}}) AS items FROM (SELECT doc_id, "
    f"list_filter(list_transform(string_split_regex(text, '[.\\n]+'), lambda x: {oracles.trim('x')}), lambda x: length(x) >= 6) AS items FROM documents)"
)
QUERIES["shared_words"] = lambda spark, sf_dir: neighbours(sentence_lists(spark, sf_dir))
ORACLES["shared_words"] = (
    "SELECT doc_id, CAST(i AS BIGINT) AS pair, CAST(len(list_intersect(items[i].w, items[i + 1].w)) AS BIGINT) AS shared "
    f"FROM (SELECT doc_id, items, unnest(generate_series(1, len(items) - 1)) AS i FROM ({SENTENCES}) WHERE len(items) > 1)"
)


QUERIES["overlap_dedup"] = lambda spark, sf_dir: sentence_lists(spark, sf_dir).select("doc_id", F.array_join(merge.overlap_dedup(F.col("items")), " | ").alias("kept"))
ORACLES["overlap_dedup"] = f"SELECT doc_id, array_to_string({fold_sql('items')}, ' | ') AS kept FROM ({SENTENCES})"


def chunk_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of chunks of 15 messages of the event conversations, each chunk taken for a conversation of its own."""
    old = window.with_chunks(window.split_window(from_events(spark, sf_dir), 10).where("is_old"), 15)
    # conv_id and chunk make the key under which extract sees a chunk.
    keyed = old.withColumn("conv_id", F.struct("conv_id", "chunk_id"))
    wide = extract.facts_wide(facts(keyed)).select("conv_id.conv_id", "conv_id.chunk_id", *L.BUCKETS)
    number = F.col("conv_id") * 1000 + F.col("chunk_id")
    given = F.when(number % 2 == 1, F.concat(F.lit("chunk "), number)).otherwise("")
    return wide.select("conv_id", "chunk_id", given.alias("project"), *L.BUCKETS)


_STRUCTS = lambda c: f"list_transform({c}, lambda y: {{'s': y, 'w': {WORDS.replace('X', 'y')}}})"
_JOINED, _LAST = ("decisions", "completed", "open_questions"), ("in_progress", "preferences")
_NUMBER = "(conv_id.c * 1000 + conv_id.k)"
# As in chunk_facts, conversation and chunk are one key, a struct, for the steps between.
_CHAIN = oracles.with_("events", 10) | {
    "old": "SELECT {'c': conv_id, 'k': (row_number() OVER (PARTITION BY conv_id ORDER BY rn) - 1) // 15} AS conv_id, turn, rn, coalesce(nullif(role, ''), 'user') AS role, coalesce(content, '') AS content FROM split WHERE is_old",
    "chunks": f"SELECT conv_id.c AS conv_id, conv_id.k AS chunk_id, CASE WHEN {_NUMBER} % 2 = 1 THEN 'chunk ' || {_NUMBER} ELSE '' END AS project, "
    + ", ".join(f"coalesce(list(fact ORDER BY rank) FILTER (bucket = '{b}'), []) AS {b}" for b in L.BUCKETS)
    + " FROM ranked GROUP BY ranked.conv_id",
    "merged": "SELECT conv_id, count(*) AS n, coalesce(nullif(max_by(project, chunk_id), ''), min_by(project, chunk_id) FILTER (project <> ''), '') AS project, "
    + ", ".join(f"flatten(list({b} ORDER BY chunk_id)) AS {b}" for b in _JOINED)
    + ", "
    + ", ".join(f"max_by({b}, chunk_id) AS {b}" for b in _LAST)
    + " FROM chunks GROUP BY conv_id",
    "structs": "SELECT conv_id, n, project, " + ", ".join(f"{b}, {_STRUCTS(b)} AS s_{b}" for b in _JOINED) + f", {', '.join(_LAST)} FROM merged",
}
_CHUNKED = (
    "WITH "
    + ", ".join(f'"{k}" AS ({_CHAIN[k]})' for k in ("msgs", "split", "old", "cut", "lines", "classified", "facts", "ranked", "chunks", "merged", "structs"))
    + " SELECT conv_id, project, "
    + ", ".join(f"array_to_string(CASE WHEN n > 1 THEN {fold_sql('s_' + b)} ELSE {b} END, ' | ') AS {b}" for b in _JOINED)
    + ", "
    + ", ".join(f"array_to_string({b}, ' | ') AS {b}" for b in _LAST)
    + " FROM structs"
)
QUERIES["merge_summaries"] = lambda spark, sf_dir: text_of(merge.merge_summaries(chunk_facts(spark, sf_dir)), *WIDE)
ORACLES["merge_summaries"] = _CHUNKED

# Replies made from event properties: plain, fenced, wrapped in text, of wrong types, or no JSON at all.
_OBJECT = "'{\"project\": \"p ' || event_id || '\", \"decisions\": [\"use store ' || event_id || ' for config files\", \"other ' || event_type || '\"], \"completed\": [\"store ' || event_id || ' config files done\"], \"inProgress\": [], \"openQuestions\": [\"why ' || user_id || '?\"]}'"
_REPLY = f"CASE event_id % 6 WHEN 0 THEN {_OBJECT} WHEN 1 THEN '```json' || chr(10) || {_OBJECT} || chr(10) || '```' WHEN 2 THEN 'Here: ' || {_OBJECT} || ' ok' WHEN 3 THEN '{{\"project\": 5, \"decisions\": \"x\", \"extra\": ' || props || '}}' WHEN 4 THEN 'no json ' || event_type ELSE '{{\"project\": \"only ' || event_id || '\"' END"
_FIELD = lambda j, n: f"CASE WHEN json_type({j}, '$.{n}') = 'ARRAY' THEN CAST(json_extract({j}, '$.{n}') AS VARCHAR[]) ELSE CAST([] AS VARCHAR[]) END"
_BARE = f"regexp_replace(regexp_replace(regexp_replace({oracles.trim('reply')}, '(?i)^```json[{oracles.WS}]*', ''), '(?i)^```[{oracles.WS}]*', ''), '[{oracles.WS}]*```$', '')"
_THREE = f"len(list_intersect({WORDS.replace('X', 'a')}, {WORDS.replace('X', 'b')})) >= 3"


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.expr(_REPLY).alias("reply"))


QUERIES["strip_fences"] = lambda spark, sf_dir: replies(spark, sf_dir).select("event_id", parse.json_part(F.col("reply")).alias("part"))
_PART = f"SELECT event_id, reply, CASE WHEN regexp_extract(bare, '(?s)\\{{.*\\}}', 0) <> '' THEN regexp_extract(bare, '(?s)\\{{.*\\}}', 0) ELSE bare END AS part FROM (SELECT event_id, reply, {_BARE} AS bare FROM (SELECT event_id, {_REPLY} AS reply FROM events))"
ORACLES["strip_fences"] = f"SELECT event_id, part FROM ({_PART})"
QUERIES["parse_response"] = lambda spark, sf_dir: replies(spark, sf_dir).select("event_id", parse.parse_reply(F.col("reply")).alias("s")).select("event_id", "s.project", *(F.array_join(f"s.{b}", " | ").alias(b) for b in L.BUCKETS), "s.raw")
_READ = f"SELECT event_id, reply, ok, CASE WHEN NOT ok THEN '{parse.PLACEHOLDER}' WHEN json_type(j, '$.project') = 'VARCHAR' THEN json_extract_string(j, '$.project') ELSE '' END AS project, " + ", ".join(f"{_FIELD('j', n)} AS {b}" for b, n in parse.JSON_NAMES.items()) + f" FROM (SELECT *, json_valid(part) AS ok, CASE WHEN json_valid(part) THEN CAST(part AS JSON) END AS j FROM ({_PART}))"
_DROP = lambda c: f"list_filter({c}, lambda a: len(list_filter(completed, lambda b: {_THREE})) = 0)"
ORACLES["parse_response"] = f"SELECT event_id, project, array_to_string({_DROP('decisions')}, ' | ') AS decisions, array_to_string(completed, ' | ') AS completed, array_to_string({_DROP('in_progress')}, ' | ') AS in_progress, array_to_string(preferences, ' | ') AS preferences, array_to_string(open_questions, ' | ') AS open_questions, CASE WHEN NOT ok THEN reply END AS raw FROM ({_READ})"
QUERIES["cross_field_dedup"] = lambda spark, sf_dir: sentence_lists(spark, sf_dir).select("doc_id", F.array_join(parse.without_done(F.slice("items", F.lit(4), F.greatest(F.size("items"), F.lit(0))), F.slice("items", 1, 3)), " | ").alias("kept"))
ORACLES["cross_field_dedup"] = (
    "SELECT doc_id, array_to_string(list_transform(list_filter(items[4:], lambda a: len(list_filter(items[1:3], lambda b: len(list_intersect(a.w, b.w)) >= 3)) = 0), lambda a: a.s), ' | ') AS kept "
    f"FROM ({SENTENCES})"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole compaction of the conversations."""
    return QUERIES["compaction"](spark, sf_dir)
