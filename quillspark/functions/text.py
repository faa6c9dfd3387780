"""Scalar text functions of the retrieval engine, all as built-in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
FILLER = r"(?i)^(can you|please|could you|how do i|how can i|how to)\s+"
LANGUAGE_HINTS = {
    "python": ["def ", "import ", "__init__", "self.", "elif ", "None", "True", "False"],
    "typescript": ["interface ", ": string", ": number", ": boolean", "async ", "=>", "const ", "export "],
    "javascript": ["function ", "const ", "let ", "var ", "require(", "module.exports"],
    "java": ["public class", "void ", "extends ", "implements ", "System.out", "@Override"],
    "go": ["func ", "package ", ":=", "fmt.Print", "goroutine", "chan "],
    "rust": ["fn ", "let mut", "impl ", "use std::", "Option<", "Result<"],
    "sql": ["SELECT ", "INSERT ", "UPDATE ", "DELETE ", "FROM ", "WHERE ", "JOIN "],
}
TYPE_KEYWORDS = {
    "debugging": ["error", "exception", "traceback", "bug", "stacktrace", "crash", "fail", "panic"],
    "security": ["vulnerability", "cve", "injection", "xss", "sqli", "overflow", "auth", "permission", "secret"],
    "refactoring": ["refactor", "optimize", "performance", "clean", "extract", "rename", "simplify", "duplicate"],
    "testing": ["test", "mock", "stub", "assert", "unit test", "coverage", "fixture"],
    "docs": ["document", "explain", "what does", "how does", "readme", "comment"],
}
INJECTIONS = [
    r"(?i)ignore\s+(previous|above|all)\s+instructions",
    r"(?i)system\s*:\s*you\s+are",
    r"(?i)new\s+instructions?\s*:",
    r"(?i)\[INST\]|\[/INST\]",
    r"<\|im_start\|>|<\|im_end\|>",
    r"(?i)disregard\s+(your|all|the)\s+(previous|prior|system)",
    r"(?i)you\s+are\s+now\s+(a|an|acting)",
    r"(?i)jailbreak|DAN mode|developer mode",
    r"(?i)print\s+(your|the)\s+(system\s+)?prompt",
]
MASKS = [
    (r"(?i)(api[_-]?key\s*[=:]\s*)\S+", "$1***"),
    (r"(?i)(token\s*[=:]\s*)\S+", "$1***"),
    (r"(?i)(password\s*[=:]\s*)\S+", "$1***"),
    (r"(?i)(secret\s*[=:]\s*)\S+", "$1***"),
    (r"(?i)(Authorization:\s*Bearer\s*)\S+", "$1***"),
    (r"ghp_[A-Za-z0-9]{36}", "***"),
    (r"sk-[A-Za-z0-9]{48}", "***"),
    (r"AKIA[A-Z0-9]{16}", "***"),
]
STOP_WORDS = ["the", "and", "for", "that", "this", "with", "from", "have", "not", "are", "was", "can", "does", "how", "what", "when", "where", "why", "which", "then", "also", "into", "its", "but", "use", "get", "set"]
NOTICE = "[CONTENT NEUTRALISED — INJECTION PATTERN DETECTED]\n# Source: "
# --- own rules: quoted literals after key-like names, and key formats ---------------------------
REDACTIONS = [
    r"""(?i)((?:api[_-]?key|token|password|secret)\w*\s*[=:]\s*)(["'])[^"'\s]{8,}["']""",
    r"(ghp_|sk-|AKIA)()[A-Za-z0-9]{16,}",
]


def normalise(q: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(q, r"\s+", " ")), FILLER, "")


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text holds; each counts once."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def best_label(text: Column, table: dict[str, list[str]], otherwise: str | None) -> Column:
    """The label with most hits; ties go to the first of the table."""
    scores = {k: hits(text, v) for k, v in table.items()}
    top = F.greatest(*scores.values())
    out = F.lit(otherwise).cast("string")
    for k, s in reversed(scores.items()):
        out = F.when((s == top) & (top > 0), k).otherwise(out)
    return out


def language(q: Column) -> Column:
    return best_label(q, LANGUAGE_HINTS, None)


def query_type(q: Column) -> Column:
    return best_label(F.lower(q), TYPE_KEYWORDS, "general")


def identifiers(q: Column) -> Column:
    words = F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    found = F.filter(words, lambda t: t.rlike("^[a-zA-Z_][a-zA-Z0-9_]{2,}$"))
    stops = F.array(*map(F.lit, STOP_WORDS))
    return F.array_distinct(F.filter(found, lambda t: ~F.array_contains(stops, F.lower(t))))


def tokens(text: Column) -> Column:
    """Search tokens: identifiers cut before each capital, lower-cased, of two characters at least."""
    cut = F.regexp_replace(F.array_join(F.regexp_extract_all(text, F.lit("[a-zA-Z_][a-zA-Z0-9_]*"), F.lit(0)), " "), "([A-Z])", " $1")
    return F.filter(F.split(F.lower(cut), " +"), lambda t: F.length(t) > 1)


def import_names(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:import|from)\s+([a-zA-Z_][\w.]*)"), F.lit(1)))


def matched_injection(text: Column) -> Column:
    """Number of the first injection pattern that the text holds, or null."""
    out = F.lit(None).cast("int")
    for k, p in reversed(list(enumerate(INJECTIONS))):
        out = F.when(text.rlike(p), k).otherwise(out)
    return out


def neutralise(text: Column, path: Column, start: Column, end: Column) -> Column:
    notice = F.concat(F.lit(NOTICE), path, F.lit(" L"), start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when(matched_injection(text).isNotNull(), notice).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def mask(text: Column) -> Column:
    return reduce(lambda c, m: F.regexp_replace(c, *m), MASKS, text)


def redact(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, "$1$2[REDACTED]"), REDACTIONS, text)


def throughput(count: Column, nanos: Column) -> Column:
    ok = (F.coalesce(count, F.lit(0)) != 0) & (F.coalesce(nanos, F.lit(0)) != 0)
    return F.when(ok, F.round(count / (nanos / 1e9), 1)).otherwise(0.0)


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)
