"""Sessions and task logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_summary(calls: DataFrame, least: int = 1) -> DataFrame:
    """calls(session_id, line_no, tool, query) -> by session: searches, fetches, the queries in order, and enough."""
    search = F.col("tool") == "WebSearch"
    queries = F.array_sort(F.collect_list(F.when(search, F.struct("line_no", "query"))))
    return calls.groupBy("session_id").agg(
        F.count_if(search).alias("searches"), F.count_if(F.col("tool") == "WebFetch").alias("fetches"), F.transform(queries, lambda q: q["query"]).alias("queries"),
    ).withColumn("sufficient", F.col("searches") >= least)


def usage(results: DataFrame) -> DataFrame:
    """results(session_id, input, cache_creation, cache_read, output, cost, ms): totals, nulls as 0."""
    total = lambda *c: F.sum(sum((F.coalesce(x, F.lit(0)) for x in c[1:]), F.coalesce(c[0], F.lit(0))))
    return results.groupBy("session_id").agg(
        total("input", "cache_creation", "cache_read").alias("input_tokens"), total("output").alias("output_tokens"),
        F.bround(total("cost"), 4).alias("cost"), F.bround(total("ms") / 1000, 1).alias("seconds"),
    )


def accepted_output(outputs: DataFrame, accepted: DataFrame) -> DataFrame:
    """The last output of a session whose block was accepted."""
    ok = outputs.join(accepted.select("session_id", "block"), ["session_id", "block"], "left_semi")
    return ok.groupBy("session_id").agg(F.max_by("value", "line_no").alias("value"))


def _rest(text: Column, n) -> Column:
    """A text from its n-th character on."""
    return F.substring(text, n if isinstance(n, Column) else F.lit(n), F.length(text))


def progress(log: DataFrame) -> DataFrame:
    """log(task_id, line_no, line) -> (task_id, line_no, state, item, result) of the lines that hold progress, wherever in the
    line it begins: `[stage i/n] item`, perhaps a remark in brackets, then `: running` or ` -> result`; the result without the
    duration at its end. A stage is letters, digits, underscores and hyphens. Of several places in a line the first
    counts. Every bracket of a line is a place to try, as an element of an array that the steps below thin out."""
    word = lambda c: c.rlike(r"(?U)^[\w-]+$")
    digits = lambda c: c.rlike(r"(?U)^\d+$")
    get, lit = F.get, F.lit

    def step(rows: DataFrame, f) -> DataFrame:
        return rows.withColumn("at", F.transform("at", f))

    rows = log.where(F.col("line").contains("] ")).withColumn("parts", F.split("line", r"\["))
    rows = rows.withColumn("at", F.slice(F.transform("parts", lambda _, i: F.array_join(F.slice("parts", i + 1, F.size("parts")), "[")), 2, F.size("parts")))
    rows = step(rows, lambda t: F.struct(F.split(F.substring_index(t, "] ", 1), " ").alias("head"), _rest(t, F.instr(t, "] ") + 2).alias("said")))
    rows = step(rows, lambda t: F.struct(t["head"].alias("head"), F.split(get(t["head"], lit(1)), "/").alias("count"), t["said"].alias("said")))
    rows = rows.withColumn("at", F.filter("at", lambda t: (F.size(t["head"]) == 2) & word(get(t["head"], lit(0))) & (F.size(t["count"]) == 2) & digits(get(t["count"], lit(0))) & digits(get(t["count"], lit(1)))))
    rows = step(rows, lambda t: F.struct(t["said"].alias("said"), F.instr(t["said"], ": running").alias("runs"), F.instr(t["said"], " -> ").alias("ends")))
    whole = lambda t: ~_rest(t["said"], t["runs"] + 9).rlike(r"(?U)^\w")
    rows = step(rows, lambda t: F.struct(t["said"].alias("said"), t["runs"].alias("runs"), t["ends"].alias("ends"),
                                         ((t["runs"] > 0) & ((t["ends"] == 0) | (t["runs"] < t["ends"])) & whole(t)).alias("running")))
    rows = rows.withColumn("at", F.filter("at", lambda t: t["running"] | (t["ends"] > 0)))
    what = lambda t: F.substring(t["said"], lit(1), F.when(t["running"], t["runs"]).otherwise(t["ends"]) - 1)
    rows = step(rows, lambda t: F.struct(t["running"].alias("running"), what(t).alias("what"), _rest(t["said"], t["ends"] + 4).alias("result")))
    rows = step(rows, lambda t: F.struct(t["running"].alias("running"), F.substring_index(t["what"], " ", 1).alias("item"), t["what"].alias("what"), t["result"].alias("result")))
    remark = lambda t: _rest(t["what"], F.length(t["item"]) + 2)
    rows = rows.withColumn("at", F.filter("at", lambda t: (t["item"] != "") & ((remark(t) == "") | remark(t).rlike(r"^\([^)]*\)$"))))
    rows = rows.withColumn("found", get("at", lit(0))).where("found is not null").select("task_id", "line_no", "found.running", "found.item", F.when(~F.col("found.running"), F.col("found.result")).alias("said"))
    rows = rows.withColumn("last", F.substring_index("said", " ", -1))
    failed = F.col("said").startswith("FAILED ")
    timed = F.col("last").rlike(r"^\([0-9]+([.][0-9]+)?s\)$")
    result = F.when(failed, _rest(F.col("said"), 8)).when(timed, F.substring("said", F.lit(1), F.length("said") - F.length("last") - 1)).otherwise(F.col("said"))
    state = F.when(F.col("running"), "running").when(failed, "failed").otherwise("done")
    return rows.select("task_id", "line_no", state.alias("state"), "item", F.coalesce(result, F.lit("")).alias("result"))


def task_states(log: DataFrame) -> DataFrame:
    """log(task_id, line_no, line) -> the last state of each item of each task, by first appearance: running, failed or done,
    with its result, without the duration."""
    return progress(log).groupBy("task_id", "item").agg(
        F.min("line_no").alias("first_line"), F.max_by("state", "line_no").alias("state"), F.max_by("result", "line_no").alias("result")
    )


def task_errors(log: DataFrame) -> DataFrame:
    """log(task_id, line_no, line) -> (task_id, error, fix): the last `ERROR: ` line, with the next line if it is a `Fix: `."""
    after = F.lead("line").over(Window.partitionBy("task_id").orderBy("line_no"))
    fix = F.when(F.col("after").startswith("Fix: "), _rest(F.col("after"), 6)).otherwise("")
    rows = log.withColumn("after", after).where(F.col("line").startswith("ERROR: "))
    last = rows.groupBy("task_id").agg(F.max_by(F.struct(_rest(F.col("line"), 8).alias("error"), fix.alias("fix")), "line_no").alias("r"))
    return last.select("task_id", "r.*")


#: The shapes of a session file's lines (fixed values).
_LINE = """type string, session_id string, message struct<content array<struct<type string, id string, name string, input string, tool_use_id string,
 is_error boolean, content string>>>, usage struct<input_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, output_tokens bigint>,
 total_cost_usd double, duration_ms bigint"""


def session_lines(raw: DataFrame) -> DataFrame:
    """raw(session_id, line_no, line): JSON lines of sessions -> the lines read; what can't be read is left out."""
    read = F.from_json("line", _LINE)
    return raw.select("session_id", "line_no", read.alias("r")).where("r.type is not null").select("session_id", "line_no", "r.type", F.col("r.message.content").alias("content"), "r.usage", "r.total_cost_usd", "r.duration_ms")


def tool_calls(lines: DataFrame) -> DataFrame:
    """session_lines -> (session_id, line_no as (line_no, pos), block, tool, query, value): what the assistant called, in order. query: the input's
    `query`; value: the whole input as JSON."""
    blocks = lines.where("type = 'assistant'").select("session_id", "line_no", F.posexplode("content").alias("pos", "b")).where("b.type = 'tool_use'")
    return blocks.select(
        "session_id", F.struct("line_no", "pos").alias("line_no"), F.col("b.id").alias("block"), F.col("b.name").alias("tool"),
        F.get_json_object("b.input", "$.query").alias("query"), F.col("b.input").alias("value"),
    )


#: What the answer to an accepted output says (a fixed value).
ACCEPTED = "provided successfully"


def accepted_blocks(lines: DataFrame, said: str = ACCEPTED) -> DataFrame:
    """session_lines -> (session_id, block): calls whose result says that they were accepted."""
    back = lines.where("type = 'user'").select("session_id", F.explode("content").alias("b")).where("b.type = 'tool_result'")
    return back.where(F.col("b.content").contains(said)).select("session_id", F.col("b.tool_use_id").alias("block")).distinct()


def session_results(lines: DataFrame) -> DataFrame:
    """session_lines -> (session_id, input, cache_creation, cache_read, output, cost, ms) of the closing lines, as usage() takes them."""
    u = lambda c, n: F.col(f"usage.{c}").alias(n)
    return lines.where("type = 'result'").select(
        "session_id", u("input_tokens", "input"), u("cache_creation_input_tokens", "cache_creation"), u("cache_read_input_tokens", "cache_read"),
        u("output_tokens", "output"), F.col("total_cost_usd").alias("cost"), F.col("duration_ms").alias("ms"),
    )
