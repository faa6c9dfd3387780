"""Syntax chunks of source files by a Python table function.

Python sources are cut with the standard ``ast`` module: every function and class, nested ones too,
in the order of their text. JavaScript, TypeScript, Java, Go and Rust are cut by their definitions and
braces, with strings and comments blanked out first; what stands in a class is a method. Other
languages, empty files, files that do not parse and files without a definition give one ``module``
chunk of the whole file. Offsets are characters, so non-ASCII sources cut rightly. Calls are those of
Python sources only.
"""

from __future__ import annotations

import ast
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

SCHEMA = "content string, node_type string, node_name string, start_line int, end_line int, parent_class string, imports_context string, docstring string, calls array<string>, imports array<string>"


def python_chunks(source: str):
    """Rows of SCHEMA for a Python source; None if it does not parse or holds no definition."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    lines = source.split("\n")
    text = lambda n: "\n".join(lines[n.lineno - 1 : n.end_lineno])
    head = [n for n in tree.body if isinstance(n, ast.Import | ast.ImportFrom)]
    imports = "\n".join(text(n) for n in head)
    names = sorted({a.name for n in head if isinstance(n, ast.Import) for a in n.names} | {n.module for n in head if isinstance(n, ast.ImportFrom) and n.module})
    rows = []

    def visit(node, parent):
        for n in ast.iter_child_nodes(node):
            inner = parent
            if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(n, ast.ClassDef)
                called = {ast.unparse(c.func) for c in ast.walk(n) if isinstance(c, ast.Call)}
                calls = sorted(c for c in called if 0 < len(c) < 80 and c[0] not in "\"'")
                kind = "class" if is_class else "method" if parent else "function"
                rows.append((text(n), kind, n.name, n.lineno, n.end_lineno, None if is_class else parent, imports, ast.get_docstring(n), calls, names))
                inner = n.name if is_class else parent
            visit(n, inner)

    visit(tree, None)
    return rows or None


_BLANK = {
    lang: re.compile(r"//[^\n]*|/\*.*?\*/|" + quotes, re.S)
    for lang, quotes in {
        "javascript": r"""\"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", "java": r"""\"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+'""",
        "go": r"""\"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.|[^'\\\n])+'""", "rust": r"""\"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\\n])'""",
    }.items()
}
_WORDS = r"(?!(?:if|for|while|switch|catch|function|return|new|else|do|try|synchronized|await|throw)\b)"
#: What begins a chunk: (kind, pattern); methods count inside a class only.
_BEGINS = {
    "javascript": [("class", r"\bclass\s+(?P<name>[\w$]+)"), ("function", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*\("), ("function", r"\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|[\w$]+)\s*(?::[^=\n]+)?=>"), ("method", rf"(?<![.\w$]){_WORDS}(?P<name>[\w$]+)\s*\([^;{{}}]*\)\s*(?::[^{{}};\n]+)?(?=\{{)")],
    "java": [("class", r"\b(?:class|interface|enum|record)\s+(?P<name>\w+)"), ("method", rf"(?<![.\w]){_WORDS}(?P<name>\w+)\s*\([^;{{}}]*\)\s*(?:throws[\w\s.,]+)?(?=\{{)")],
    "go": [("function", r"\bfunc\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\("), ("function", r"\btype\s+(?P<name>\w+)\s+(?:struct|interface)\b")],
    "rust": [("class", r"\bimpl\b(?:<[^{}]*?>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<name>\w+)"), ("function", r"\bfn\s+(?P<name>\w+)"), ("function", r"\b(?:struct|enum|trait)\s+(?P<name>\w+)")],
}
_IMPORTS = {"javascript": r"^import\b[^;\n]*;?", "java": r"^import\b[^;\n]*;?", "go": r"^import\s*(?:\([^)]*\)|[^\n]*)", "rust": r"^(?:pub\s+)?use\b[^;]*;"}
_SAME = {"typescript": "javascript"}


def brace_chunks(source: str, language: str):
    """Rows of SCHEMA for a language with braces; None if it holds no definition."""
    language = _SAME.get(language, language)
    if language not in _BEGINS:
        return None
    code = _BLANK[language].sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)
    ends, open_ = {}, []
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.start() + 1
    found = []
    for kind, pattern in _BEGINS[language]:
        for m in re.finditer(pattern, code):
            stop = re.compile(r"[{;]" if kind != "function" or language != "javascript" else r"[{;\n]").search(code, m.end())
            brace = stop.start() if stop and stop[0] == "{" else None
            end = ends.get(brace, len(code)) if brace is not None else stop.start() + (stop[0] == ";") if stop else len(code)
            start = code.rfind("\n", 0, m.start()) + 1 if kind != "method" else m.start()
            lead = re.match(r"\s*", code[start : m.start()]).end()
            found.append((start + lead, -end, kind, m["name"], m.start()))
    found.sort()
    imports = "\n".join(source[m.start() : m.end()].strip() for m in re.finditer(_IMPORTS[language], code, re.M))
    names = list(dict.fromkeys(re.findall(r"(?:import|from)\s+([a-zA-Z_][a-zA-Z0-9_.]*)", imports)))
    rows, inside, seen = [], [], set()
    for start, end, kind, name, at in found:
        inside = [c for c in inside if -end <= c[0]]
        parent = inside[-1][1] if inside else None
        if at in seen or kind == "method" and not parent:
            continue
        seen.add(at)
        whole, is_class = source[start:-end], kind == "class"
        first = source.count("\n", 0, start) + 1
        rows.append((whole, "class" if is_class else "method" if parent else "function", name, first, first + whole.count("\n"), None if is_class else parent, imports, None, [], names))
        if is_class:
            inside.append((-end, name))
    return rows or None


@udtf(returnType=SCHEMA)
class Chunks:
    def eval(self, content: str, language: str):
        content = content or ""
        rows = python_chunks(content) if language == "python" else brace_chunks(content, language)
        if rows:
            yield from rows
        else:
            yield content, "module", "module", 1, content.count("\n") + 1, None, "", None, [], []


def chunk_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Chunks of (file_path, content, language, project_id, repository_name), with content hash; other
    columns of the files go through."""
    spark.udtf.register("quill_chunks", Chunks)
    view = f"quill_files_{uuid.uuid4().hex}"
    files.createOrReplaceTempView(view)
    got = spark.sql(f"SELECT f.* EXCEPT (content), c.* FROM {view} f, LATERAL quill_chunks(f.content, f.language) c")
    spark.catalog.dropTempView(view)
    from ..functions.ids import chunk_id, fqn, normalised_hash

    whole = F.when(F.col("node_type") == "module", F.col("content")).otherwise(F.concat_ws("\n", "imports_context", F.concat(F.lit("# "), "file_path"), "content"))
    got = got.withColumn("chunk_hash", normalised_hash(whole))
    return got.withColumns({"chunk_id": chunk_id(F.col("project_id"), F.col("chunk_hash")), "fqn": fqn(F.col("repository_name"), F.col("file_path"), F.col("parent_class"), F.col("node_name"))})
