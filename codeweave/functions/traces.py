"""Stack traces: frames, the error's header, and the frame at which to look.

A trace is split into lines once; each line is matched natively, and Go's two-line frames take their function from the last
line before that names one, by a window over the trace's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of frames and headers (fixed values).
JAVA = r"^\s*at\s+([\w$.]+)\.([\w$<>]+)\((\w+\.(?:java|kt|groovy)):(\d+)\)"
NODE = r"^\s*at\s+(?:([\w.<>$\s]+?)\s+\()?([^\s()]+\.(?:ts|tsx|js|jsx|mjs|cjs)):(\d+):\d+\)?"
PYTHON = r'^\s*File\s+"([^"]+\.py)",\s+line\s+(\d+),\s+in\s+(\S+)'
GO_FUNC = r"^(?:\S+\.)?(\w+)\("
GO_FILE = r"^\s+(.+\.go):(\d+)"
ERROR = r"(?i)^(?:[\w$.]+(?:Exception|Error|Panic|Fault|Throwable)\b.*|(?:Exception|Error|Fatal|panic):.*)"
INTERNAL_CLASS = r"^(sun|java|javax|jdk|com\.sun|org\.junit|org\.mockito|org\.springframework\.test)\b"
HINTS = [r"(\w+\.(?:java|kt|ts|tsx|js|go|py|cs|rb|rs))\s*[:#]\s*(\d+)", r"\bline\s+(\d+)\s+in\s+(\w+)", r"\b(\w+)\s+(?:at\s+)?line\s+(\d+)\b"]


def _text(line: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(line, pattern, group), F.lit(""))


def lines(traces: DataFrame) -> DataFrame:
    """(trace_id, pos, line, kind): each line and what it is: error, java, node, python, go_file, go_func or other."""
    rows = traces.select("trace_id", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))
    bare = F.regexp_replace("line", r"^\s+|\s+$", "")
    head = F.min(F.when(bare.rlike(ERROR), F.col("pos"))).over(Window.partitionBy("trace_id"))
    left = F.regexp_replace("line", r"^\s+", "")
    kind = (
        F.when(F.col("pos") == F.col("_head"), "error")
        .when(F.col("line").rlike(JAVA), "java")
        .when(F.col("line").rlike(NODE), "node")
        .when(F.col("line").rlike(PYTHON), "python")
        .when(left.rlike(GO_FUNC) & ~left.startswith("at ") & ~F.col("line").rlike(GO_FILE), "go_func")
        .when(F.col("line").rlike(GO_FILE), "go_file")
        .otherwise("other")
    )
    return rows.withColumn("_head", head).withColumn("kind", kind).drop("_head")


def frames(traces: DataFrame) -> DataFrame:
    """(trace_id, pos, lang, class_name, method_name, file_path, line, qualifier) of each frame, in the order of the text.

    A Go function waits for its file through unrelated lines; a frame of another language, or a file line, ends the wait. A file line
    without a waiting function may itself be one.
    """
    rows = lines(traces)
    order = Window.partitionBy("trace_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    func = F.regexp_extract(F.regexp_replace("line", r"^\s+", ""), GO_FUNC, 1)
    mark = F.when(F.col("kind") == "go_func", func).when(F.col("kind").isin("java", "node", "python", "go_file"), "")
    rows = rows.withColumn("_go", F.last(mark, ignorenulls=True).over(order))
    fqn = F.regexp_extract("line", JAVA, 1)
    named = F.split(F.regexp_replace(_text(F.col("line"), NODE, 1), r"^\s+|\s+$", ""), r"\.", -1)
    method = F.try_element_at(named, F.lit(-1))
    k = F.col("kind")
    python = _text(F.col("line"), PYTHON, 3)
    frame = rows.where(k.isin("java", "node", "python") | ((k == "go_file") & (F.coalesce("_go", F.lit("")) != "")))
    return frame.select(
        "trace_id",
        "pos",
        F.when(k == "go_file", "go").otherwise(k).alias("lang"),
        F.when(k == "java", F.element_at(F.split(fqn, r"\.", -1), -1)).when(k == "node", F.try_element_at(named, F.lit(-2))).alias("class_name"),
        F.when(k == "java", F.regexp_extract("line", JAVA, 2)).when(k == "node", F.nullif(F.nullif(method, F.lit("<anonymous>")), F.lit(""))).when(k == "python", F.nullif(python, F.lit("<module>"))).otherwise(F.col("_go")).alias("method_name"),
        F.when(k == "java", F.regexp_extract("line", JAVA, 3)).when(k == "node", F.regexp_extract("line", NODE, 2)).when(k == "python", F.regexp_extract("line", PYTHON, 1)).otherwise(F.regexp_extract("line", GO_FILE, 1)).alias("file_path"),
        F.when(k == "java", F.regexp_extract("line", JAVA, 4)).when(k == "node", F.regexp_extract("line", NODE, 3)).when(k == "python", F.regexp_extract("line", PYTHON, 2)).otherwise(F.regexp_extract("line", GO_FILE, 2)).cast("int").alias("line"),
        F.when(k == "java", fqn).alias("qualifier"),
    )


def errors(traces: DataFrame) -> DataFrame:
    """(trace_id, error_message): the first line that looks like an error's header."""
    return lines(traces).where("kind = 'error'").select("trace_id", F.regexp_replace("line", r"^\s+|\s+$", "").alias("error_message"))


def epicentres(frames_: DataFrame, strict_internal: bool = False) -> DataFrame:
    """The first frame of each trace that has a place and is no library's. Java's classes are compared by their short
    name, so its libraries pass, unless `strict_internal` compares the whole one."""
    name = F.coalesce(F.col("qualifier") if strict_internal else F.col("class_name"), "class_name", F.lit(""))
    path = F.coalesce("file_path", F.lit(""))
    own = F.col("line").isNotNull() & (path != "") & ~name.rlike(INTERNAL_CLASS) & ~path.startswith("node:") & ~path.contains("node_modules")
    rest = [c for c in frames_.columns if c != "trace_id"]
    return frames_.where(own).groupBy("trace_id").agg(F.min_by(F.struct(*rest), "pos").alias("f")).select("trace_id", "f.*")


def line_hints(text: Column) -> Column:
    """array<struct<file_hint, line>>: places that a text names, by pattern and then in order."""

    def part(pattern: str, file_group: int, line_group: int) -> Column:
        files, numbers = F.regexp_extract_all(text, F.lit(pattern), F.lit(file_group)), F.regexp_extract_all(text, F.lit(pattern), F.lit(line_group))
        return F.zip_with(files, numbers, lambda f, n: F.struct(f.alias("file_hint"), n.try_cast("int").alias("line")))

    return F.concat(part(HINTS[0], 1, 2), part(HINTS[1], 2, 1), part(HINTS[2], 1, 2))
