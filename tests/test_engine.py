import json

import pytest
from pyspark.sql import functions as F

from recollect.functions import lexicon as L
from recollect.functions import text as T
from recollect.operators import extract, merge, parse, providers, render, window
from recollect.plans.compaction import compact, result_messages, token_stats
from recollect.sources import messages as M

MSG = "conv_id long, turn long, role string, content string"


def conv(spark, *msgs, conv_id=1):
    return spark.createDataFrame([(conv_id, i, r, c) for i, (r, c) in enumerate(msgs)], MSG)


def summary(spark, *msgs):
    return extract.summaries(conv(spark, *msgs)).first()


def value(spark, column, **cols):
    return spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<string>").alias(k) for k, v in cols.items())).select(column.alias("v")).first().v


def test_window(spark):
    df = conv(spark, *[("user" if i % 2 else "assistant", f"Message {i}") for i in range(1, 51)])
    got = window.split_window(df, 10)
    assert got.where("is_old").count() == 40 and [r.content for r in got.where("is_tail").orderBy("turn").collect()][0] == "Message 41"
    assert window.split_window(df.limit(8), 10).where("is_old").count() == 0
    with pytest.raises(ValueError):
        window.split_window(df, 0)
    assert window.split_window(df, 0, compat=True).where("is_old AND is_tail").count() == 50
    assert window.split_window(df, -3, compat=True).where("is_tail").count() == 47
    with pytest.raises(ValueError):
        window.messages(df, "text")


def test_tokens(spark):
    assert value(spark, T.tokens(F.col("a")), a="") == 0 and value(spark, T.tokens(F.lit(None).cast("string")), a="x") == 0
    assert value(spark, T.message_tokens(F.lit("user"), F.col("a")), a="Hello") == 7
    assert value(spark, T.units(F.col("a")), a="a😀b") == 4
    df = conv(spark, *[("user", "the same fairly long message about the project")] * 40)
    assert token_stats(window.split_window(df, 10)).first().original_tokens > 100


def test_lines_and_buckets(spark):
    assert value(spark, T.lines_of(F.col("a")), a="We are using ~/.app/1.json with v1.5. Next one! Short.") == ["We are using ~/.app/1.json with v1.5", "Next one"]
    assert value(spark, T.lines_of(F.col("a")), a="Done!") == ["Done!"]

    def of(line, role="user"):
        return value(spark, extract.bucket(F.col("a"), F.lit(role)), a=line)

    assert of("The working fix is still pending for us") == "open_questions" and of("we are working on it") == "completed"
    assert of("x" * 161) is None and of("decided " + "x" * 152) == "decisions"
    assert of("We decided on A", "system") == "decisions" and of("is the B fix still pending for now", "system") is None
    assert of("We decided on A", "assistant") is None and of("I prefer short answers", "assistant") == "preferences"
    assert of("What do you think about this?") is None and of("Ready when you are, what about it?") is None
    assert of("How should the workers handle this when they fail?") == "open_questions"
    assert of("user never sees the thing at all") is None and of("please never use tabs") == "decisions" and of("tabs are what i never use") == "preferences"


def test_project(spark):
    def of(*texts):
        return summary(spark, *[("user", t) for t in texts]).project

    assert of("hello there", "we have a tool called ai-router for this") == "ai-router" and of("see @scope/name for it") == "@scope/name"
    assert of("I am building a X") == "I am building a X" and of("I want to build a Node.js AI tool") == "I want to build a Node"
    assert of("écalled foo now") == "foo" and of("Hi?") == "Not identified"
    assert summary(spark, ("assistant", "nothing")).project == "Not identified"


def test_caps_dedup_and_fallback(spark):
    s = summary(spark, *[("user", f"We decided on thing {i}") for i in range(10)])
    assert s.decisions == [f"We decided on thing {i}" for i in range(8)]
    s = summary(spark, *[("user", "We decided on A")] * 9, ("user", "We decided on B"))
    assert s.decisions == ["We decided on A", "We decided on B"]
    s = summary(spark, *[("user", f"Topic {i} goes on. More") for i in range(12)])
    assert len(s.in_progress) == 8 and s.in_progress[0] == "Topic 0 goes on"


def test_fuzzy(spark):
    items = ["use SQLite for storage", "prefer SQLite storage everywhere always", "React front end", "React end"]
    assert value(spark, merge.overlap_dedup(F.col("a")), a=items) == ["prefer SQLite storage everywhere always", "React front end"]
    assert value(spark, merge.overlap_dedup(F.col("a")), a=[]) == []
    rows = [(1, 1, "", ["use SQLite for storage"], ["c1"], ["i2"], ["p2"], []), (1, 0, "first", ["SQLite storage"], [], ["i1"], ["p1"], ["q"]), (2, 0, "", ["a b c", "a b c"], [], [], [], [])]
    df = spark.createDataFrame(rows, "conv_id long, chunk_id long, project string, decisions array<string>, completed array<string>, in_progress array<string>, preferences array<string>, open_questions array<string>")
    got = {r.conv_id: r for r in merge.merge_summaries(df).collect()}
    assert (got[1].project, got[1].decisions, got[1].in_progress, got[1].open_questions) == ("first", ["use SQLite for storage"], ["i2"], ["q"]) and got[2].decisions == ["a b c", "a b c"]


def test_parse(spark):
    def of(text, **more):
        return value(spark, parse.parse_reply(F.col("a"), **more), a=text)

    full = {"project": "p", "decisions": ["use SQLite storage layer now", "other thing"], "completed": ["SQLite storage layer is finished"], "inProgress": [], "preferences": ["x"], "openQuestions": ["q?"]}
    for text in (json.dumps(full), f"```json\n{json.dumps(full)}\n```", f"Sure: {json.dumps(full)} ok"):
        r = of(text)
        assert (r.project, r.decisions, r.completed, r.open_questions, r.raw) == ("p", ["other thing"], full["completed"], ["q?"], None)
    r = of('{"project":5,"decisions":"x"}')
    assert (r.project, r.decisions, r.raw) == ("", [], None)
    for bad in ("no json at all", "null", "{broken", ""):
        r = of(bad)
        assert (r.project, r.completed, r.raw) == (parse.PLACEHOLDER, [], bad)
    assert of('[{"project":"p"}]').project == "p" and of(json.dumps(full), categories=("project",)).completed == []


def test_render(spark):
    facts = {b: F.lit(None).cast("array<string>") for b in L.BUCKETS} | {"decisions": F.array(F.lit("a"), F.lit("b"))}
    assert value(spark, render.prompt_block(F.col("a"), facts), a="X") == f"{L.HEADER}\nProject: X\nDecisions made: a | b\n{L.FOOTER}"
    assert value(spark, render.paragraph_block(F.col("a")), a="P") == f"{L.HEADER}\nP\n{L.FOOTER}"
    for style in ("structured", "paragraph"):
        assert "JSON" in render.system_prompt("structured") and render.system_prompt(style)


def test_providers():
    for name in L.CHUNK_SIZES:
        r = providers.request(name.upper(), "sys", "USER: hi", "secret", None)
        assert "secret" not in r.url + json.dumps(r.body) and "sys" in json.dumps(r.body) and providers.reply(name, {}) == ("", 0)
    with pytest.raises(ValueError, match="Unsupported provider"):
        providers.known("nope")
    assert providers.reply("openai", {"choices": [{"message": {"content": "x"}}], "usage": {"total_tokens": 3}}) == ("x", 3)
    assert providers.reply("anthropic", {"content": [{"text": "x"}], "usage": {"input_tokens": 1, "output_tokens": 2}}) == ("x", 3)
    assert providers.reply("gemini", {"candidates": [{"content": {"parts": [{"text": "x"}]}}], "usageMetadata": {"promptTokenCount": 1, "candidatesTokenCount": 2}}) == ("x", 3)
    assert providers.reply("ollama", {"message": {"content": "x"}}) == ("x", 0)


def test_compact_modes(spark):
    long = conv(spark, *[("user", f"We decided to use store {i} for the config") for i in range(20)])
    df = long.union(conv(spark, ("user", "hi"), conv_id=2))
    rows = {r.conv_id: r for r in compact(df).collect()}
    assert rows[2].mode == "passthrough" and rows[2].prompt_block is None and rows[2].kept_raw == 1
    assert rows[1].mode == "token-free" and (rows[1].compressed_count, rows[1].kept_raw) == (10, 10) and rows[1].saved_token_count >= 0
    ai = {r.conv_id: r for r in compact(df, ask=providers.stub).collect()}
    assert ai[1].mode == "ai" and ai[1].project == "stub" and ai[1].token_count > 0
    merged = {r.conv_id: r for r in compact(df, ask=providers.stub, provider="groq", chunked=True, keep_last=2).collect()}
    assert merged[1].mode == "ai" and merged[1].project == "stub"
    para = {r.conv_id: r for r in compact(df, ask=lambda s, u: (f" {len(u)} ", 1), style="paragraph", keep_last=2).collect()}
    assert para[1].paragraph.isdigit() and para[1].token_count == 2

    def broken(system, user):
        raise RuntimeError("down")

    failed = {r.conv_id: r for r in compact(df, ask=broken).collect()}
    assert failed[1].mode == "token-free" and failed[1].note.endswith("down") and failed[1].decisions
    out = result_messages(df, compact(df)).where("conv_id = 1").orderBy("turn").collect()
    assert len(out) == 11 and out[0].role == "system" and out[0].content.startswith(L.HEADER)
    with pytest.raises(ValueError):
        compact(df, style="other")
    assert compact(df.where("false")).collect() == []


def test_sources_and_cli(spark, tmp_path):
    msgs = [{"role": "user", "content": f"We decided on plan {i}"} for i in range(14)]
    (tmp_path / "a.json").write_text(json.dumps(msgs))
    (tmp_path / "bad.json").write_text("{}")
    assert M.from_json_files(spark, str(tmp_path / "a.json")).count() == 14 and M.from_rows(spark, msgs).count() == 14 and M.from_text(spark, json.dumps(msgs)).count() == 14
    with pytest.raises(Exception, match="JSON array"):
        M.from_json_files(spark, str(tmp_path / "bad.json")).collect()
    df = M.from_rows(spark, msgs)
    row = compact(df).first().asDict(recursive=True)
    assert "Decisions made" in M.formatted(row, [], "prompt") and json.loads(M.formatted(row, [], "summary"))["decisions"] and json.loads(M.formatted(row, [], "full"))["meta"]["compressedCount"] == 4
    from recollect import cli

    assert cli.main(["compress"]) == 1 and cli.main([]) == 0
    assert cli.parser().parse_args(["compress", "x.json", "--model", "m"]).model == "m"


def test_stream(spark, tmp_path):
    from recollect.streaming.incremental import follow

    src = tmp_path / "in"
    conv(spark, *[("user", f"We decided on plan {i}") for i in range(12)]).write.parquet(str(src))
    q = follow(spark.readStream.schema(MSG).parquet(str(src)), str(tmp_path / "h"), str(tmp_path / "s"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "s")).first().compressed_count == 2
