"""Source trees: which files are read, and their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, extension
from . import tree

#: Names of files and folders that are left out (fixed values).
IGNORE = [
    ".git", "node_modules", "dist", "build", "coverage", ".next", "__pycache__", ".venv", "venv", "env", "vendor", "target", ".gradle", ".idea", ".vscode", "bin", "obj", "out", "tmp", ".cache",
    "__tests__", "__mocks__", "test", "tests", "spec", "specs", "e2e", "cypress",
]
#: Ends of names of test files, in lower case (fixed values).
TEST_SUFFIXES = [".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", ".test.mjs", ".spec.mjs", "-test.ts", "-test.js"]
#: Extensions and names that are read (fixed values).
EXTENSIONS = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".pyw", ".java", ".kt", ".kts", ".scala", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".hxx", ".cs", ".go", ".rs", ".rb", ".php",
    ".swift", ".sh", ".bash", ".dart", ".ex", ".exs", ".erl", ".lua", ".r", ".R", ".json", ".yaml", ".yml", ".toml", ".ini", ".properties", ".xml",
]
FILENAMES = ["dockerfile", "compose.yml", "compose.yaml", "codeowners"]


def is_scanned(path: Column, extensions: list[str] | None = None, ignore: list[str] | None = None) -> Column:
    """Whether a path relative to its root is read. Given extensions take the place of the default ones, as they are
    written, and are compared with a lower-case extension; given names to ignore are added."""
    segments = F.split(path, "/")
    names = sorted({*IGNORE, *(ignore or [])})
    lower = F.lower(base_name(path))
    tests = F.lit(False)
    for s in TEST_SUFFIXES:
        tests = tests | lower.endswith(s)
    known = F.lower(extension(path)).isin(extensions if extensions is not None else EXTENSIONS) | lower.isin(FILENAMES)
    return ~F.arrays_overlap(segments, F.array(*map(F.lit, names))) & ~tests & known


def scan(spark: SparkSession, root: str, extensions: list[str] | None = None, ignore: list[str] | None = None) -> DataFrame:
    """(rel_path, extension, content) of the files below a root. Ignored folders are not entered, other files not opened; what cannot be read is passed
    over, and bytes that are no UTF-8 become U+FFFD. Filters on the start of rel_path and on extension reach the listing where the session lets them."""
    spark.dataSource.register(tree.SourceTree)
    names = tree.Names(sorted({*IGNORE, *(ignore or [])}), TEST_SUFFIXES, EXTENSIONS if extensions is None else extensions, FILENAMES)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("source_tree").option("names", tree.options(names)).option("prune", prune).option("partitions", 2 * spark.sparkContext.defaultParallelism).load(root)


def parse_repository(url: str) -> tuple[str, str]:
    """(URL, name) of `owner/repo`, a host's path, or a URL, with or without `.git`."""
    text = url.strip().rstrip("/").removesuffix(".git")
    if "://" not in text and not text.startswith("git@"):
        text = f"https://{text}" if text.split("/")[0].count(".") else f"https://github.com/{text}"
    parts = text.replace(":", "/").split("/")
    if len(parts) < 2 or not parts[-1]:
        raise ValueError(f"not a repository: {url}")
    return f"{text}.git", parts[-1]


def clone_command(url: str, folder: str, present: bool) -> list[str]:
    """The git command that brings a repository: a shallow clone, or a pull where it is present already."""
    return ["git", "-C", folder, "pull", "--ff-only"] if present else ["git", "clone", "--depth", "1", parse_repository(url)[0], folder]


def read_env(text: str, env: dict[str, str]) -> dict[str, str]:
    """`key=value` lines of a file; what is set already stays."""
    out = dict(env)
    for line in text.splitlines():
        key, sep, value = line.strip().partition("=")
        if sep and key and not key.startswith("#"):
            out.setdefault(key.strip(), value.strip().strip("\"'"))
    return out
