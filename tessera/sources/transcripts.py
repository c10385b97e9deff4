"""Transcripts of coding agents: four shapes of JSON, one normalised row per turn.

Line-delimited files are read as text with their path; positions are numbers of lines, so
line ends of any kind do no harm. Broken lines are skipped; a half-written last line is
simply not there yet and comes with the next run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import trim_all

CALL = "struct<name: string, args: string, result_excerpt: string, target_paths: array<string>>"
ROLES = ("user", "assistant", "tool", "system")
# Arguments that name a file. Fixed values.
PATH_KEYS = ("path", "file_path", "filePath", "target_file", "targetFile", "filename")


def slug(path: str) -> str:
    """A project root as one word: runs of other characters than letters and digits become a dash."""
    import re

    return re.sub(r"[^A-Za-z0-9]+", "-", path).strip("-")


def paths_in(args: Column) -> Column:
    return F.array_compact(F.array(*[F.get_json_object(args, f"$.{k}") for k in PATH_KEYS]))


def lines(spark: SparkSession, glob: str) -> DataFrame:
    """(source_path, position, line) of line-delimited files."""
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), "value")
    return raw.select("source_path", F.posexplode(F.split("value", r"\r?\n")).alias("position", "line")).where(F.trim("line") != "")


_BLOCK = "struct<type: string, text: string, name: string, input: string, content: string>"
_ENTRY = f"struct<type: string, role: string, timestamp: string, content: string, message: struct<role: string, content: string>>"


def _blocks(content: Column) -> Column:
    """Content as an array of blocks; plain text is one block."""
    arr = F.from_json(content, f"array<{_BLOCK}>")
    one = F.array(F.from_json(F.to_json(F.struct(F.lit("text").alias("type"), content.alias("text"))), _BLOCK))
    return F.when(content.startswith("["), F.coalesce(arr, one)).when(content.isNotNull(), one).otherwise(F.from_json(F.lit("[]"), f"array<{_BLOCK}>"))


def block_turns(raw: DataFrame, role_field: str = "role") -> DataFrame:
    """Lines whose message holds blocks of text, tool use and tool result; the role is in ``role`` or ``type``. A result belongs to the last call of its line."""
    e = raw.withColumn("e", F.from_json("line", _ENTRY)).where("e is not null")
    role = F.coalesce("e.type", "e.role", "e.message.role") if role_field == "type" else F.coalesce("e.role", "e.message.role")
    b = _blocks(F.coalesce("e.message.content", "e.content"))
    e = e.select("source_path", "position", role.alias("role"), F.expr("try_cast(e.timestamp as bigint)").alias("ts"), b.alias("b")).where(F.col("role").isin(*ROLES))
    text = F.array_join(F.filter(F.transform("b", lambda x: F.when(x["type"].isin("text", "input_text", "output_text"), x["text"])), lambda x: x.isNotNull()), "\n")
    uses = F.filter("b", lambda x: x["type"].isin("tool_use", "tool_call"))
    result = F.substring(F.element_at(F.filter(F.transform("b", lambda x: F.when(x["type"] == "tool_result", x["content"])), lambda x: x.isNotNull()), -1), 1, 2000)
    has_result = F.exists("b", lambda x: x["type"] == "tool_result")
    calls = F.transform(uses, lambda x, i: F.struct(x["name"].alias("name"), x["input"].alias("args"), F.when(has_result & (i == F.size(uses) - 1), result).alias("result_excerpt"), paths_in(x["input"]).alias("target_paths")))
    out = e.select("source_path", "position", "role", trim_all(text).alias("text"), "ts", calls.cast(f"array<{CALL}>").alias("tool_calls"))
    return out.where((F.col("text") != "") | (F.size("tool_calls") > 0))


_ITEM = "struct<type: string, role: string, content: string, name: string, arguments: string, output: string, cwd: string, workspace: string, payload: struct<cwd: string>, timestamp: string>"


def item_turns(raw: DataFrame, project_root: str | None = None) -> DataFrame:
    """Response items: messages, function calls (a turn of the assistant) and their outputs (a turn of the tool). With a root, only files whose first twenty lines name it."""
    e = raw.withColumn("e", F.from_json("line", _ITEM)).where("e is not null")
    if project_root:
        n = F.row_number().over(Window.partitionBy("source_path").orderBy("position"))
        cwd = F.coalesce("e.cwd", "e.workspace", "e.payload.cwd")
        mine = e.select("source_path", "position", cwd.alias("cwd")).withColumn("n", n).where("n <= 20 and cwd is not null")
        mine = mine.groupBy("source_path").agg(F.min_by("cwd", "position").alias("cwd")).where(F.col("cwd") == project_root).select("source_path")
        e = e.join(mine, "source_path", "left_semi")
    b = _blocks(F.col("e.content"))
    text = F.array_join(F.filter(F.transform(b, lambda x: F.when(x["type"].isin("text", "input_text", "output_text"), x["text"])), lambda x: x.isNotNull()), "\n")
    t = F.col("e.type")
    role = F.when(t == "message", F.col("e.role")).when(t == "function_call", "assistant").when(t == "function_call_output", "tool")
    body = F.when(t == "message", trim_all(text)).when(t == "function_call_output", F.substring("e.output", 1, 4000)).otherwise("")
    call = F.struct(F.col("e.name").alias("name"), F.col("e.arguments").alias("args"), F.lit(None).cast("string").alias("result_excerpt"), paths_in(F.col("e.arguments")).alias("target_paths"))
    calls = F.when(t == "function_call", F.array(call)).otherwise(F.array().cast(f"array<{CALL}>"))
    out = e.select("source_path", "position", role.alias("role"), body.alias("text"), F.expr("try_cast(e.timestamp as bigint)").alias("ts"), calls.cast(f"array<{CALL}>").alias("tool_calls"))
    return out.where(F.col("role").isin(*ROLES) & ((F.col("text") != "") | (F.size("tool_calls") > 0)))


_WHOLE = "struct<sessionId: string, requests: array<struct<message: struct<text: string>, response: string>>, history: array<struct<role: string, text: string>>>"


def whole_turns(spark: SparkSession, glob: str) -> DataFrame:
    """Whole JSON files with requests and responses, or a history of roles and texts."""
    raw = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("source_path"), F.from_json("value", _WHOLE).alias("e")).where("e is not null")
    answer = lambda r: F.coalesce(F.get_json_object(r, "$.value"), F.get_json_object(r, "$[0].value"), r)
    pairs = F.flatten(F.transform("e.requests", lambda r: F.array(F.struct(F.lit("user").alias("role"), r["message"]["text"].alias("text")), F.struct(F.lit("assistant").alias("role"), answer(r["response"]).alias("text")))))
    turns = F.coalesce(pairs, F.transform("e.history", lambda h: F.struct(h["role"].alias("role"), h["text"].alias("text"))))
    out = raw.select("source_path", F.posexplode(turns).alias("position", "t")).select("source_path", "position", "t.role", trim_all("t.text").alias("text"), F.lit(None).cast("long").alias("ts"), F.array().cast(f"array<{CALL}>").alias("tool_calls"))
    return out.where(F.col("role").isin(*ROLES) & (F.col("text") != ""))


def read(spark: SparkSession, agent: str, root: str, project: str) -> DataFrame:
    """The turns of an agent's transcripts of a project under a root folder."""
    s = slug(project)
    if agent == "cursor":
        return block_turns(lines(spark, f"{root}/{s}/agent-transcripts/*/*.jsonl"))
    if agent == "claude-code":
        return block_turns(lines(spark, f"{root}/-{s}/*.jsonl"), "type")
    if agent == "codex":
        raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(root, wholetext=True)
        raw = raw.select(F.col("_metadata.file_path").alias("source_path"), F.posexplode(F.split("value", r"\r?\n")).alias("position", "line"))
        return item_turns(raw.where(F.trim("line") != ""), project)
    if agent == "copilot":
        import hashlib

        return whole_turns(spark, f"{root}/{hashlib.md5(('file://' + project).encode()).hexdigest()}/*/*.json")
    raise ValueError(f"no such agent: {agent}")


def as_turns(raw: DataFrame, agent: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, tool_calls) with session ids, dense indices and content-addressed call ids. ``known`` (session_id, position) are the positions of earlier runs, which do not come again."""
    sid = F.substring(F.sha1(F.concat_ws("|", F.lit(agent), "source_path", F.regexp_extract("source_path", r"([^/]+?)(?:\.\w+)?$", 1))), 1, 16)
    t = raw.withColumn("session_id", sid)
    t = t.withColumn("idx", (F.row_number().over(Window.partitionBy("session_id").orderBy("position")) - 1).cast("int"))
    if known is not None:
        t = t.join(known.select("session_id", "position"), ["session_id", "position"], "left_anti")
    t = t.withColumn("id", F.concat_ws("-", "session_id", "idx"))
    turns = t.select("id", "session_id", "idx", "role", "text", F.timestamp_millis("ts").alias("ts"), "position")
    c = t.select(F.col("id").alias("turn_id"), F.posexplode("tool_calls").alias("n", "c"))
    return turns, c.select(F.substring(F.sha1(F.concat_ws("|", "turn_id", "n", "c.name", "c.args")), 1, 16).alias("id"), "turn_id", "c.*")
