"""Prompt routing, history, quota, metrics and webhook events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
OVERRIDE = ["vulnerability", "vulnerabilities", "security audit", "owasp", "sql injection", "xss", "csrf", "ssrf", "cve", "exploit", "penetration", "pentest", "authentication bypass", "privilege escalation", "rce", "remote code execution", "injection", "hardened", "threat model", "attack surface"]
HEAVY = ["audit", "refactor", "architecture", "design pattern", "solid principle", "thread-safe", "concurrency", "race condition", "performance bottleneck", "microservice", "distributed", "scale", "optimize the entire", "complete implementation", "production-ready", "code review", "all vulnerabilities", "all issues", "all bugs"]
BALANCED = ["debug", "fix this", "fix the", "error", "exception", "stack trace", "traceback", "write a function", "write a class", "implement", "refactor this", "what's wrong", "why is", "how does", "explain this code", "decorator", "middleware", "async", "thread"]
FAST = ["what is", "what does", "what are", "define", "explain what", "rename", "convert", "translate to comment", "one-liner", "difference between", "when should i use", "simple question"]
CODE = [r"```", r"def [a-zA-Z_]+\(", r"class [A-Z][a-zA-Z]+", r"Traceback \(most recent", r'File ".*", line \d+', r"[A-Z][a-zA-Z]+Error:", r"SELECT .* FROM", r"FROM [a-zA-Z]+\n", r"import [a-z]"]
STEPS = [r"\band then\b", r"\balso\b.*\balso\b", r"\bstep by step\b", r"\band explain\b", r"\band provide\b", r"\band suggest\b", r"[.?!][^.?!]{0,50}[.?!][^.?!]{0,50}[.?!]"]
TIERS = {"FAST": ("qwen2.5-coder:1.5b", 1.5, 1024), "BALANCED": ("qwen2.5-coder:3b", 3.5, 2048), "HEAVY": ("qwen2.5-coder:7b", 7.0, 4096)}


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _matches(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def routed(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Adds score, tier, confidence, model, latency and max_tokens of a prompt."""
    p = F.col(prompt)
    low = F.lower(F.trim(p))
    words = F.size(F.filter(F.split(F.trim(p), r"\s+"), lambda w: w != ""))
    heavy, balanced = _any(low, HEAVY), _any(low, BALANCED)
    score = (
        F.when(words < 12, -2).when(words < 40, 0).otherwise(3)
        + F.when(_matches(p, CODE), 3).otherwise(0)
        + F.when(heavy, 4).when(balanced, 2).when(_any(low, FAST), -2).otherwise(0)
        + F.when(_matches(low, STEPS), 3).otherwise(0)
    )
    override = _any(low, OVERRIDE)
    out = df.withColumns({"__o": override, "score": score})
    tier = F.when(F.col("__o"), "HEAVY").when(F.col("score") <= 1, "FAST").when(F.col("score") <= 5, "BALANCED").otherwise("HEAVY")
    sure = F.when(F.col("__o") | (F.col("score") <= -1) | (F.col("score") >= 8), "high").otherwise("medium")
    out = out.withColumns({"tier": tier, "confidence": sure})
    pick = lambda k: F.create_map(*[F.lit(x) for t, v in TIERS.items() for x in (t, v[k])]).getItem(F.col("tier"))
    return out.withColumns({"model": pick(0), "latency_s": pick(1), "max_tokens": pick(2)}).drop("__o")


def last_turns(turns: DataFrame, n: int = 8) -> DataFrame:
    """(conv_id, history): the last n turns, oldest first; at most n turns of each meet."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)
    return kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("history"))


def segments(requests: DataFrame, seconds: int, by: str) -> DataFrame:
    """Adds ``segment``: each key's time line (column ``micros``) is cut where no request came for longer than
    ``seconds``. Only the first and last time of each key and stretch of ``seconds`` meet in a window; a longer
    gap lies between two stretches."""
    stretch = F.floor(F.col("micros") / (seconds * 1_000_000))
    rows = requests.withColumn("__stretch", stretch)
    ends = rows.groupBy(by, "__stretch").agg(F.min("micros").alias("lo"), F.max("micros").alias("hi"))
    line = Window.partitionBy(by).orderBy("__stretch")
    ends = ends.withColumn("cut", F.coalesce(F.col("lo") - F.lag("hi").over(line) > seconds * 1_000_000, F.lit(False)).cast("long"))
    ends = ends.withColumn("segment", F.sum("cut").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = ends.select(F.col(by).alias("__by"), F.col("__stretch").alias("__of"), "segment")
    return rows.join(ends, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__stretch") == F.col("__of"))).drop("__by", "__of", "__stretch")


def admitted(requests: DataFrame, limit: int = 30, seconds: int = 60, by: str = "user_id") -> DataFrame:
    """Sliding-window quota: rejected requests leave no trace, so requests are folded in order. Where a key
    was silent for longer than the window nothing is left of what came before, so each stretch between such gaps
    is folded by itself and one key is many tasks. The fold keeps at most ``limit`` times; it runs on
    Arrow batches sorted by key, whatever a stretch's size."""
    from collections import deque

    schema = f"{by} long, event_id long, ts timestamp, admitted boolean"

    def run(frames):
        key, kept = None, deque()
        for f in frames:
            out = []
            for k, t in zip(f[by].tolist(), f["micros"].tolist()):
                if k != key:
                    key, kept = k, deque()
                while kept and kept[0] < t - seconds * 1_000_000:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(t)
            yield f[[by, "event_id", "ts"]].assign(admitted=out)

    ts = F.col("ts").cast("timestamp")
    rows = requests.select(F.col(by).cast("long"), F.col("event_id").cast("long"), ts.alias("ts"), F.unix_micros(ts).alias("micros"))
    dealt = segments(rows, seconds, by).repartition(by, "segment").sortWithinPartitions(by, "micros", "event_id")
    return dealt.select(by, "event_id", "ts", "micros").mapInPandas(run, schema)


def demand(requests: DataFrame, seconds: int = 60, by: str = "user_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return requests.withColumn("in_window", F.count("*").over(w))


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def histogram(events: DataFrame, value: str, bounds: list[float], *labels: str) -> DataFrame:
    """Cumulative buckets: (labels, le, n, total, sum); le null is the unbounded bucket."""
    sums = [F.sum((F.col(value) <= b).cast("long")).alias(f"b{k}") for k, b in enumerate(bounds)]
    agg = events.groupBy(*labels).agg(*sums, F.count(value).alias("total"), F.sum(value).alias("sum"))
    rows = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("total").alias("n")))
    return agg.select(*labels, F.explode(rows).alias("r"), "total", "sum").select(*labels, "r.le", "r.n", "total", "sum")


def gauge(events: DataFrame, value: str, order: list[str], *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("value"))


def findings_by_file(findings: DataFrame) -> DataFrame:
    """(file, n, rules): rules is an array of (rule_id, n) by rule, null rules left out. Counted before
    collecting, so the array of a file is bounded by the number of rules."""
    each = findings.groupBy("file", "rule_id").agg(F.count("*").alias("n"))
    rule = F.when(F.col("rule_id").isNotNull(), F.struct("rule_id", "n"))
    return each.groupBy("file").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(rule)).alias("rules"))


PUSH = "project struct<id:string,git_http_url:string>, repository struct<id:string,clone_url:string>, ref string, after string, commits array<struct<added:array<string>,modified:array<string>>>"


def push_jobs(hooks: DataFrame) -> DataFrame:
    """Adds job (project_id, branch, repository_url, changed_files, commit_hash) to webhooks (event_type,
    body as JSON). "Push Hook" bodies have a project, all others a repository. The branch is the last part
    of the ref; paths are those added or modified, each once, in order. Null where no path changed or no
    project is named."""
    j = F.from_json("body", PUSH)
    lab = F.col("event_type") == "Push Hook"
    none = F.array().cast("array<string>")
    files = F.array_distinct(F.flatten(F.transform(F.coalesce(j["commits"], F.array().cast("array<struct<added:array<string>,modified:array<string>>>")), lambda c: F.concat(F.coalesce(c["added"], none), F.coalesce(c["modified"], none)))))
    project = F.coalesce(F.when(lab, j["project"]["id"]).otherwise(j["repository"]["id"]), F.lit(""))
    url = F.coalesce(F.when(lab, j["project"]["git_http_url"]).otherwise(j["repository"]["clone_url"]), F.lit(""))
    branch = F.element_at(F.split(F.coalesce(j["ref"], F.lit("refs/heads/main")), "/"), -1)
    job = F.struct(project.alias("project_id"), branch.alias("branch"), url.alias("repository_url"), files.alias("changed_files"), F.coalesce(j["after"], F.lit("unknown")).alias("commit_hash"))
    return hooks.withColumn("job", F.when((F.size(files) > 0) & (project != ""), job))


def changed_files(jobs: DataFrame, tree: DataFrame) -> DataFrame:
    """(project_id, path, action): changed paths of jobs against the files of the tree (project_id, path,
    size). Paths that exist and may be indexed are replaced, all others only deleted."""
    from .files import indexable

    paths = jobs.where("job is not null").select("job.project_id", F.explode("job.changed_files").alias("path")).distinct()
    found = paths.join(tree.select("project_id", "path", "size", F.lit(True).alias("there")), ["project_id", "path"], "left")
    keep = F.coalesce("there", F.lit(False)) & indexable(F.col("path"), F.col("size"))
    return found.select("project_id", "path", F.when(keep, "replace").otherwise("delete").alias("action"))


def dispatch(event_type: Column, branch: Column, project: Column, paths: Column) -> Column:
    from .files import branch_indexed

    push = event_type.isin("Push Hook", "push")
    empty = project.isNull() | (F.coalesce(F.size(paths), F.lit(0)) <= 0)
    return (
        F.when(push & empty, "skipped:no_changes")
        .when(push & ~branch_indexed(branch), F.concat(F.lit("skipped:branch_excluded:"), branch))
        .when(push, "queued").when(event_type.isin("Repository Delete Hook", "delete"), "purged")
        .otherwise(F.concat(F.lit("ignored:"), event_type))
    )


def diff_sides(diffs: DataFrame) -> DataFrame:
    """(id, target, before, after) of unified diffs (id, diff). The target is the file of the last "--- "
    line without its a/ or b/, or patched_file. Other header lines are left out; what starts with - or +
    belongs to one side, all else to both."""
    line = F.split("diff", "\n")
    begins = lambda x, *ps: reduce(lambda a, b: a | b, [F.startswith(x, F.lit(p)) for p in ps])
    body = F.filter(line, lambda x: ~begins(x, "--- ", "+++ ", "@@", "diff ", "index "))
    cut = lambda x, mark: F.when(F.startswith(x, F.lit(mark)), F.substring(x, 2, F.length(x))).otherwise(x)
    side = lambda own, other: F.array_join(F.transform(F.filter(body, lambda x: ~F.startswith(x, F.lit(other))), lambda x: cut(x, own)), "\n")
    heads = F.filter(line, lambda x: F.startswith(x, F.lit("--- ")))
    target = F.coalesce(F.regexp_replace(F.try_element_at(heads, F.lit(-1)), "^--- [ab]/", ""), F.lit("patched_file"))
    return diffs.select("id", target.alias("target"), side("-", "+").alias("before"), side("+", "-").alias("after"))


def diagnostics(df: DataFrame) -> DataFrame:
    """0-based lines, message and severity level of findings."""
    level = F.create_map(*[F.lit(x) for kv in {"critical": 0, "high": 0, "medium": 1, "low": 2, "info": 2}.items() for x in kv])
    line = F.greatest(F.lit(0), F.col("line") - 1)
    return df.select("file", line.alias("line"), F.greatest(line, F.coalesce("end_line", "line") - 1).alias("end_line"), F.concat(F.lit("["), "rule_id", F.lit("] "), "message", F.lit(" — "), "category").alias("message"), F.coalesce(level.getItem(F.col("severity")), F.lit(1)).alias("level"))


def job_state(events: DataFrame) -> DataFrame:
    """Latest state of each job from its events (job_id, ts, status)."""
    return events.groupBy("job_id").agg(F.max_by("status", "ts").alias("status"), F.min("ts").alias("started_at"), F.max(F.when(F.col("status").isin("success", "error"), F.col("ts"))).alias("finished_at"))


def job_counters(files: DataFrame, job: str = "job_id") -> DataFrame:
    """Counters of each job from its files (status indexed or skipped, reason, chunks, secrets): totals,
    skipped by reason, and progress: 90 percent by files done, 100 when all are."""
    reasons = files.where("status = 'skipped'").groupBy(job, "reason").agg(F.count("*").alias("n")).groupBy(job).agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("skipped_by_reason"))
    done = F.count_if(F.col("status").isin("indexed", "skipped"))
    total = F.count("*")
    sums = files.groupBy(job).agg(
        total.alias("files_total"), F.count_if(F.col("status") == "indexed").alias("files_indexed"), F.count_if(F.col("status") == "skipped").alias("files_skipped"),
        F.sum("chunks").alias("chunks"), F.sum("secrets").alias("secrets"),
        F.when(done == total, 100).otherwise(F.floor(done * 90 / F.greatest(total, F.lit(1)))).cast("int").alias("progress"),
    )
    return sums.join(reasons, job, "left")


def active(events: DataFrame, step: str, *labels: str) -> DataFrame:
    """A gauge that goes up and down: the sum of its steps, and its highest value, by labels in time order
    (columns ts, event_id)."""
    w = Window.partitionBy(*labels).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events.withColumn("__level", F.sum(step).over(w)).groupBy(*labels).agg(F.sum(step).alias("value"), F.max("__level").alias("highest"))


def log_records(df: DataFrame, ts: str = "ts", level: str = "level", event: str = "event") -> DataFrame:
    """(record): one JSON line of each row, ts, level and event first; other columns that hold text are
    masked, all else is kept as it is."""
    from ..functions.text import mask

    rest = [c for c in df.columns if c not in (ts, level, event)]
    fields = [mask(F.col(c)).alias(c) if df.schema[c].dataType.simpleString() == "string" else F.col(c) for c in rest]
    return df.select(F.to_json(F.struct(F.col(ts).alias("ts"), F.col(level).alias("level"), F.col(event).alias("event"), *fields)).alias("record"))
