"""Languages and file names."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .severity import lookup

# Extension to language, as the scanner sees it.
SCAN_LANGUAGES = {
    ".js": "javascript", ".jsx": "javascript", ".ts": "javascript", ".tsx": "javascript", ".py": "python",
    ".go": "go", ".java": "java", ".rb": "ruby", ".php": "php", ".c": "c", ".cpp": "cpp", ".h": "c",
    ".hpp": "cpp", ".cs": "csharp", ".rs": "rust", ".swift": "swift", ".kt": "kotlin", ".scala": "scala",
    ".sh": "bash", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".xml": "xml", ".sql": "sql",
}
# The shorter table, which tells TypeScript apart.
DETECT_LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".go": "go", ".java": "java", ".cpp": "cpp",
    ".c": "c", ".h": "c", ".hpp": "cpp", ".rs": "rust", ".rb": "ruby", ".php": "php",
}
# Language to extension.
LANGUAGE_EXTENSION = {"python": ".py", "javascript": ".js", "typescript": ".ts", "go": ".go", "java": ".java"}

# What a scan passes over.
SKIP_DIRECTORIES = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".tox", ".pytest_cache", "dist", "build", ".idea",
    ".vscode", "target", "vendor", ".next", "out", "coverage",
]
SKIP_EXTENSIONS = [".min.js", ".min.css", ".map", ".lock", ".sum"]


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix in lower case; names that only begin with a dot have none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1))


def language_of(path: Column, table: str = "scan") -> Column:
    return lookup(SCAN_LANGUAGES if table == "scan" else DETECT_LANGUAGES, extension(path))


def extension_of(language: Column) -> Column:
    return F.coalesce(lookup(LANGUAGE_EXTENSION, language), F.lit(".txt"))


def guess_language(code: Column) -> Column:
    """Language of a snippet from words in it; the order decides."""

    def has(*words):
        found = F.lit(False)
        for word in words:
            found = found | code.contains(word)
        return found

    # The words and their order.
    return (F.when(has("def ", "import "), "python")
            .when(has("function ", "const ", "let "), "javascript")
            .when(has("func "), "go")
            .when(has("fn ", "impl ", "use std::", "let mut "), "rust")
            .otherwise("generic"))


def in_skipped_directory(relative_path: Column) -> Column:
    return F.arrays_overlap(F.split(relative_path, "/"), F.array(*[F.lit(d) for d in SKIP_DIRECTORIES]))


def is_skipped(relative_path: Column) -> Column:
    """Names and folders that are not scanned; the path is relative to the scan's root."""
    name = F.lower(file_name(relative_path))
    skipped = in_skipped_directory(relative_path) | file_name(relative_path).startswith(".")
    for ending in SKIP_EXTENSIONS:
        skipped = skipped | name.endswith(ending)
    return skipped
