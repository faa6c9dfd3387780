"""File and branch policies, access and request predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import small

# --- fixed values -----------------------------------------------------------------------------
EXCLUDED_DIRS = ["node_modules", ".git", "__pycache__", "vendor", ".venv", "venv", ".env", "dist", "build", "out", "target", "bin", "obj", ".idea", ".vscode", ".eclipse", "coverage", ".nyc_output", ".pytest_cache", "migrations", "fixtures", "__snapshots__"]
EXCLUDED_ENDINGS = [".min.js", ".min.css", ".bundle.js", ".d.ts"]
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".go": "go", ".rs": "rust",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".cs": "csharp", ".rb": "ruby", ".php": "php", ".tf": "terraform",
    ".hcl": "hcl", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".sql": "sql",
    ".md": "markdown", ".rst": "text", ".txt": "text",
}
NAMED_FILES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "Rakefile": "ruby", "Gemfile": "ruby", "Pipfile": "toml", "Cargo.toml": "toml", "go.mod": "go", "go.sum": "text", "pyproject.toml": "toml", "setup.py": "python", "setup.cfg": "text"}
MAX_FILE_BYTES = 500_000
PRIORITY_BRANCHES = ["main", "master", "develop", "staging"]
ALLOWED = [("python", "pytest"), ("python", "lint"), ("python", "format-check"), ("python", "bandit"), ("python", "pip-audit"), ("node", "jest"), ("node", "eslint"), ("node", "prettier-check"), ("security", "semgrep"), ("security", "bandit-scan"), ("security", "detect-secrets"), ("security", "pip-audit"), ("security", "checkov")]
ALSO_ONE = [("python", "lint"), ("python", "bandit"), ("python", "pip-audit"), ("security", "bandit-scan"), ("security", "semgrep"), ("security", "detect-secrets"), ("security", "pip-audit"), ("security", "checkov")]


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last suffix of the file name, lower-cased; names that only start with a dot have none."""
    return F.lower(F.regexp_extract(_name(path), r"^.+(\.[^.]+)$", 1))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv]).getItem(key)


def language(path: Column) -> Column:
    return F.coalesce(_lookup(_name(path), NAMED_FILES), _lookup(suffix(path), LANGUAGES))


def indexable(path: Column, size: Column) -> Column:
    excluded = F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, EXCLUDED_DIRS)))
    low = F.lower(_name(path))
    ending = F.lit(False)
    for e in EXCLUDED_ENDINGS:
        ending = ending | F.endswith(low, F.lit(e))
    return F.when(excluded, False).when(_name(path).isin(*NAMED_FILES), True).when(size.isNull() | (size > MAX_FILE_BYTES), False).when(ending, False).otherwise(suffix(path).isin(*LANGUAGES))


def branch_indexed(branch: Column) -> Column:
    return branch.isin(PRIORITY_BRANCHES) | branch.rlike("^(release|hotfix|fix)/")


def permitted(df: DataFrame, project: str, roles: list[str]) -> DataFrame:
    """Rows of a project that any of the roles may see; before any ranking."""
    return df.where(F.col("project_id") == project).where(F.arrays_overlap("allowed_roles", F.array(*map(F.lit, roles))))


def narrowed(df: DataFrame, language: list[str] | None = None, node_types: list[str] | None = None, prefix: str | None = None, branch: str | None = None) -> DataFrame:
    df = df.where(F.col("language").isin(language)) if language else df
    df = df.where(F.col("node_type").isin(node_types)) if node_types else df
    df = df.where(F.startswith("file_path", F.lit(prefix))) if prefix else df
    return df.where(F.col("branch") == branch) if branch else df


def single_project(projects: Column) -> Column:
    """The compatible guard: a request names exactly one project. Retrieval itself takes several."""
    return F.coalesce(F.size(projects) == 1, F.lit(False))


def keyed(requests: DataFrame, keys: DataFrame | None) -> DataFrame:
    """Open if no keys are configured, else requests whose api_key is known."""
    return requests if keys is None else requests.join(small(keys.select("api_key").distinct()), "api_key", "left_semi")


def command_allowed(tool: Column, command: Column) -> Column:
    return F.struct(tool, command).isin([F.struct(F.lit(t), F.lit(c)) for t, c in ALLOWED])


def exit_accepted(tool: Column, command: Column, code: Column) -> Column:
    more = F.struct(tool, command).isin([F.struct(F.lit(t), F.lit(c)) for t, c in ALSO_ONE])
    return (code == 0) | ((code == 1) & more)


def message_valid(text: Column) -> Column:
    return F.coalesce(F.length(F.trim(text)) >= 1, F.lit(False)) & (F.length(text) <= 10_000)


def snippet_valid(code: Column) -> Column:
    return F.octet_length(code) <= 200_000


def request_valid(query: Column, user: Column, projects: Column, roles: Column, top_k: Column, sensitivity: Column) -> Column:
    return (
        F.length(query).between(3, 2000) & (F.length(user) > 0) & (F.size(projects) >= 1) & (F.size(roles) >= 1)
        & ~F.exists(projects, lambda p: F.trim(p) == "") & top_k.between(1, 20) & sensitivity.isin("public", "internal", "confidential", "top_secret")
    )
