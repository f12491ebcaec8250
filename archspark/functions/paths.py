"""Path predicates and classifications, all plain column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archspark.functions.frames import rank_in

# Globs left out of every scan.
DEFAULT_EXCLUDES = (
    "**/.git/**", "**/.hg/**", "**/.svn/**", "**/node_modules/**", "**/bower_components/**",
    "**/vendor/**", "**/dist/**", "**/build/**", "**/out/**", "**/bin/**", "**/obj/**",
    "**/target/**", "**/.venv/**", "**/venv/**", "**/env/**", "**/__pycache__/**",
    "**/.mypy_cache/**", "**/.pytest_cache/**", "**/.tox/**", "**/.idea/**", "**/.vs/**",
    "**/.gradle/**", "**/coverage/**", "**/*.min.js", "**/*.min.css", "**/*.lock",
    "**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml",
)
# Directory names never entered.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "bower_components", "dist", "build", "out", "bin",
    "obj", "target", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache",
    ".tox", ".idea", ".vs", ".gradle", "coverage", ".next", ".nuxt", ".terraform",
)
# Extension to language.
LANGUAGE_BY_EXTENSION = {
    ".py": "python", ".pyi": "python", ".c": "c", ".h": "c", ".cc": "cpp", ".cpp": "cpp",
    ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp", ".cs": "csharp",
    ".java": "java", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go",
    ".rs": "rust", ".sql": "sql", ".yml": "yaml", ".yaml": "yaml", ".json": "json",
    ".toml": "toml", ".xml": "xml", ".md": "markdown", ".rst": "markdown",
    ".tf": "terraform", ".proto": "proto", ".gradle": "gradle", ".csproj": "xml",
    ".sln": "text", ".sh": "shell", ".ps1": "powershell", ".dockerfile": "docker",
    ".cfg": "config", ".ini": "config", ".env": "config",
}
# Lower-cased file name to infrastructure kind.
INFRA_BY_NAME = {
    "dockerfile": "docker", "docker-compose.yml": "compose", "docker-compose.yaml": "compose",
    "compose.yml": "compose", "compose.yaml": "compose", "package.json": "npm",
    "requirements.txt": "pip", "pyproject.toml": "pip", "pipfile": "pip", "go.mod": "gomod",
    "cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle", "makefile": "make",
    "procfile": "proc", "serverless.yml": "serverless", "helmfile.yaml": "helm",
    "chart.yaml": "helm",
}
# Binary extensions.
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".svg", ".pdf", ".zip", ".gz",
    ".tar", ".7z", ".rar", ".jar", ".war", ".exe", ".dll", ".so", ".dylib", ".class", ".pyc",
    ".pyd", ".o", ".a", ".lib", ".bin", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4",
    ".mov", ".avi", ".db", ".sqlite", ".sqlite3", ".parquet", ".pkl",
)
# Path patterns.
TEST_PATH = r"(?i)(^|/)(tests?|__tests__|spec|specs|testing|e2e|it|integration[-_]tests?)(/|$)"
TEST_NAME = (
    r"(?i)(^|[._-])(test|tests|spec|specs)([._-]|$)|(^|/)test_[^/]+$|_test\.[a-z]+$|Tests?\.(cs|java)$"
)
CI_PATH = (
    r"(?i)(^|/)(\.github/workflows/|\.gitlab-ci\.yml|azure-pipelines\.yml|Jenkinsfile|\.circleci/"
    r"|bitbucket-pipelines\.yml|\.travis\.yml)"
)
COVERAGE_PATH = (
    r"(?i)(^|/)(\.coveragerc|codecov\.ya?ml|jest\.config\.[jt]s|vitest\.config\.[jt]s|karma\.conf\.js)$"
)
CONTAINER_PATH = r"(?i)(^|/)(dockerfile|docker-compose\.ya?ml|compose\.ya?ml)$"
README_NAME = r"(?i)^readme(\.[a-z]+)?$"
LICENSE_NAME = r"(?i)^(license|licence|copying)(\.[a-z]+)?$"
CONTRIBUTING_NAME = r"(?i)^(contributing|code_of_conduct|changelog|security)(\.[a-z]+)?$"
# Path tokens of each layer, outermost layer first.
LAYER_TOKENS = (
    ("presentation", ("ui", "web", "frontend", "client", "views", "pages", "components", "widgets",
                      "screens", "static", "templates")),
    ("api", ("api", "controllers", "controller", "routes", "route", "endpoints", "handlers",
             "resources", "rest", "graphql", "rpc", "grpc")),
    ("application", ("application", "usecases", "use_cases", "commands", "queries", "workflows",
                     "orchestration", "jobs", "tasks")),
    ("domain", ("domain", "core", "business", "services", "service", "logic", "model", "models",
                "entities", "engine")),
    ("data", ("data", "dal", "repository", "repositories", "persistence", "storage", "store", "db",
              "database", "migrations", "orm", "dao")),
    ("infrastructure", ("infra", "infrastructure", "config", "configuration", "common", "shared",
                        "utils", "util", "helpers", "lib", "internal", "platform", "security",
                        "logging", "deploy", "scripts", "build")),
)
STEREOTYPE_LAYER = {
    "controller": "api", "view": "presentation", "component": "presentation", "service": "domain",
    "manager": "domain", "handler": "application", "repository": "data", "entity": "data",
    "model": "domain", "store": "data", "configuration": "infrastructure", "middleware": "api",
    "client": "infrastructure", "adapter": "infrastructure",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    """Constant map lookup; missing keys give null."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot; empty for none and for dot-files."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def infra_kind_of(path: Column) -> Column:
    name = F.lower(file_name(path))
    return F.coalesce(
        _lookup(INFRA_BY_NAME, name), F.when(name.startswith("dockerfile"), F.lit("docker")), F.lit("")
    )


def language_of(path: Column) -> Column:
    name = F.lower(file_name(path))
    return F.coalesce(
        _lookup(LANGUAGE_BY_EXTENSION, extension(path)),
        F.when(name.isin("dockerfile", "makefile", "procfile"), F.lit("config")),
        F.lit(""),
    )


def with_infra_kind(files: DataFrame, path: str = "path") -> DataFrame:
    return files.withColumn("infra_kind", infra_kind_of(F.col(path)))


def with_language(files: DataFrame, path: str = "path") -> DataFrame:
    """Add language and infra kind; rows that have neither are dropped, infra-only is ``config``."""
    typed = with_infra_kind(files, path).withColumn("language", language_of(F.col(path)))
    kept = typed.filter((F.col("language") != "") | (F.col("infra_kind") != ""))
    return kept.withColumn("language", F.when(F.col("language") == "", "config").otherwise(F.col("language")))


def glob_to_regex(glob: str) -> str:
    """Shell glob where ``*`` crosses ``/``, written as one anchored pattern."""
    special = {"*": ".*", "?": "."}
    body = "".join(special.get(c) or (c if c.isalnum() or c in "/_" else "\\" + c) for c in glob)
    return f"(?s)^{body}$"


def matches_any(path: Column, globs: Iterable[str]) -> Column:
    """The path, or the path with a leading slash, matches one of the globs."""
    bodies = [glob_to_regex(g)[len("(?s)^"):-1] for g in globs]
    if not bodies:
        return F.lit(False)
    pattern = "(?s)^(?:" + "|".join(bodies) + ")$"
    return path.rlike(pattern) | F.concat(F.lit("/"), path).rlike(pattern)


def exclude_paths(files: DataFrame, globs: Sequence[str] = (), path: str = "path") -> DataFrame:
    return files.filter(~matches_any(F.col(path), (*DEFAULT_EXCLUDES, *globs)))


def include_paths(files: DataFrame, globs: Sequence[str] = (), path: str = "path") -> DataFrame:
    return files.filter(matches_any(F.col(path), globs)) if globs else files


def exclude_dirs(files: DataFrame, path: str = "path") -> DataFrame:
    parts = F.split(F.col(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return files.filter(
        ~F.exists(dirs, lambda d: d.isin(*SKIP_DIRS) | d.startswith(".terraform"))
    )


def exclude_binary(files: DataFrame, path: str = "path") -> DataFrame:
    return files.filter(~extension(F.col(path)).isin(*BINARY_EXTENSIONS))


def module_of(path: Column, depth: int = 3) -> Column:
    """First ``depth`` directories of the path, ``(root)`` for none."""
    dirs = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    n = F.greatest(F.size(dirs) - 1, F.lit(0))
    return F.when(n == 0, F.lit("(root)")).otherwise(
        F.array_join(F.slice(dirs, 1, F.least(F.lit(depth), n)), "/")
    )


def top_package(path: Column) -> Column:
    """First directory of the path, ``(root)`` for none."""
    return F.when(F.instr(path, "/") > 0, F.split(path, "/").getItem(0)).otherwise(F.lit("(root)"))


component_of = top_package


def is_test_file(path: Column) -> Column:
    return path.rlike(TEST_PATH) | file_name(path).rlike(TEST_NAME)


def classify_layer(path: Column, stereotype: Column | None = None) -> Column:
    """First layer that owns one of the path tokens, else the stereotype's layer."""
    tokens = F.split(F.lower(path), r"[/\\._-]+")
    chain = None
    for layer, words in LAYER_TOKENS:
        test = F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))
        chain = F.when(test, F.lit(layer)) if chain is None else chain.when(test, F.lit(layer))
    fallback = F.lit("unassigned")
    if stereotype is not None:
        fallback = F.coalesce(_lookup(STEREOTYPE_LAYER, F.coalesce(stereotype, F.lit(""))), fallback)
    return chain.otherwise(fallback)


def stereotype_layer(stereotype: Column) -> Column:
    return F.coalesce(_lookup(STEREOTYPE_LAYER, F.coalesce(stereotype, F.lit(""))), F.lit("unassigned"))


def layer_rank(layer: Column) -> Column:
    from archspark.schema import LAYERS

    return rank_in(layer, LAYERS)


def project_file_flags(files: DataFrame, keys, path: str = "path") -> DataFrame:
    """Presence of readme, licence, contributing, CI, coverage and container files per key.

    ``files`` needs ``infra_kind`` (see :func:`with_infra_kind`).
    """
    p, name = F.col(path), file_name(F.col(path))
    return files.groupBy(*keys).agg(
        F.bool_or(name.rlike(README_NAME)).alias("readme"),
        F.bool_or(name.rlike(LICENSE_NAME)).alias("license"),
        F.bool_or(name.rlike(CONTRIBUTING_NAME)).alias("contributing"),
        F.bool_or(p.rlike(CI_PATH)).alias("ci"),
        F.bool_or(p.rlike(COVERAGE_PATH)).alias("coverage_config"),
        F.bool_or(p.rlike(CONTAINER_PATH) | F.col("infra_kind").isin("docker", "compose", "helm")).alias(
            "containerised"
        ),
    )
