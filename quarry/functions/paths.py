"""Paths and addresses: languages, tests, repository and pull-request links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages that are parsed, by extension.
PARSED = {
    "py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx",
    "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp",
    "cs": "csharp", "kt": "kotlin", "swift": "swift", "scala": "scala",
}
#: Formats that are only read, by extension, and by the beginning of a name.
TEXT_ONLY = {
    "md": "markdown", "rst": "rst", "txt": "text", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "cfg": "ini",
    "ini": "ini", "sql": "sql", "sh": "bash", "html": "html", "css": "css", "scss": "css", "vue": "vue", "svelte": "svelte",
    "proto": "proto", "graphql": "graphql", "tf": "hcl", "dockerfile": "dockerfile", "gradle": "gradle", "xml": "xml", "lua": "lua",
    "dart": "dart", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hs": "haskell", "ml": "ocaml", "r": "r", "jl": "julia",
    "zig": "zig", "nim": "nim",
}
NAMES = {"Dockerfile": "dockerfile", "Makefile": "make", "README": "markdown"}
#: What marks a test, in folders and in lower-case file names.
TEST_DIRS = ["/test/", "/tests/", "/__tests__/", "/spec/", "/testing/", "/src/test/"]
TEST_STARTS, TEST_PARTS = ["test_"], [".test.", ".spec."]
TEST_ENDS = ["_test.py", "_test.go", "test.java", "tests.cs", "_spec.rb"]
TEST_NAMES = ["conftest.py"]
#: An owner, a repository, and what may follow their link on github.com.
_OWNER, _NAME = r"[A-Za-z0-9][A-Za-z0-9-]{0,38}", r"[A-Za-z0-9._-]{1,100}"
_HOST = r"^https?://(?:www\.)?github\.com/"
_REPOSITORY = rf"{_HOST}({_OWNER}/{_NAME}?)(?:\.git)?(?:/(?:tree|blob)/[^?#]+)?/?(?:[?#].*)?$"
_PULL = rf"{_HOST}({_OWNER}/{_NAME})/pull/(\d{{1,7}})(?:/[a-z]*)?/?(?:[?#].*)?$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(Column.__or__, conditions, F.lit(False))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the file name, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))


def language(path: Column) -> Column:
    """By extension, else by the beginning of the name; null if neither is known."""
    table = F.create_map(*[F.lit(x) for item in (PARSED | TEXT_ONLY).items() for x in item])
    by_name = F.coalesce(*[F.when(file_name(path).startswith(start), F.lit(lang)) for start, lang in NAMES.items()])
    return F.coalesce(F.try_element_at(table, extension(path)), by_name)


def is_parsed(path: Column) -> Column:
    return extension(path).isin(*PARSED)


def is_test_path(path: Column) -> Column:
    low = F.concat(F.lit("/"), F.lower(path))
    name = file_name(low)
    return any_of([
        *[F.contains(low, F.lit(d)) for d in TEST_DIRS], *[name.startswith(s) for s in TEST_STARTS],
        *[F.contains(name, F.lit(p)) for p in TEST_PARTS], *[name.endswith(e) for e in TEST_ENDS], name.isin(*TEST_NAMES),
    ])


def repository_of(url: Column) -> Column:
    """owner/name in lower case of a repository's link, or of a file or folder in it; else null."""
    found = F.lower(F.regexp_extract(F.trim(url), _REPOSITORY, 1))
    return F.when((found != "") & ~file_name(found).isin(".", ".."), found)


def pull_of(url: Column) -> Column:
    """(repository, number) of a pull request's link, else null."""
    repo = F.regexp_extract(F.trim(url), _PULL, 1)
    return F.when(repo != "", F.struct(F.lower(repo).alias("repo"), F.regexp_extract(F.trim(url), _PULL, 2).try_cast("int").alias("number")))
