"""Source trees against `os.walk`, and parsers that users register, on workers."""

import os
import random

import pytest
from pyspark.sql import functions as F

from codeweave.plans import index
from codeweave.plans.api import CodeGraph
from codeweave.sources import parsers, scan, tree


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top, rng = tmp_path_factory.mktemp("tree"), random.Random(3)
    names = ["_a.ts", ".b.java", "c.TS", "__init__.py", "d.test.ts", "e.md", "Dockerfile", "f.R", ".g", "..h.ts", "i.", "j.spec.JS", "bin", "k.tsx.bak", "ünï.cs"]
    folders = ["", "_in", ".hid", "src", "src/test", "src/main", "src/main/_deep", "node_modules/x", "a/b/c/d", "build.ts", "Dist", "src/main/tests/more"]
    for i, folder in enumerate(folders * 3):
        at = top / folder / (f"n{i // len(folders)}" if i >= len(folders) else "")
        at.mkdir(parents=True, exist_ok=True)
        for n in rng.sample(names, 9):
            if not (at / n).is_dir():
                (at / n).write_bytes(rng.choice([b"", b"plain", "zwölf".encode(), b"\xff\xfe\x00bad", b"cut \xc3", b"a\r\nb"]))
    os.symlink(top / "src", top / "loop")
    return str(top)


def walked(root, names):
    out = {}
    for at, folders, files in os.walk(root):
        folders[:] = [f for f in folders if f not in names.ignore and not os.path.islink(f"{at}/{f}")]
        for f in files:
            path = os.path.relpath(f"{at}/{f}", root)
            core = f.lstrip(".")
            ext = core[core.rfind(".") :].lower() if core.rfind(".") > 0 else ""
            if f in names.ignore or any(f.lower().endswith(t) for t in names.test_ends):
                continue
            if ext in names.extensions or f.lower() in names.files:
                with open(f"{at}/{f}", "rb") as x:
                    out[path] = (ext, x.read().decode("utf-8", "replace"))
    return out


@pytest.mark.parametrize("extensions,ignore", [(None, None), ([".ts", ".R", ".bak"], ["_in", "c.TS"])])
def test_scan_equals_a_walk(spark, root, extensions, ignore):
    names = tree.Names([*scan.IGNORE, *(ignore or [])], scan.TEST_SUFFIXES, extensions or scan.EXTENSIONS, scan.FILENAMES)
    rows = scan.scan(spark, root, extensions, ignore).collect()
    got = {r["rel_path"]: (r["extension"], r["content"]) for r in rows}
    assert len(got) == len(rows) and got == walked(root, names)
    assert scan.scan(spark, f"file://{root}/", extensions, ignore).count() == len(rows)
    # The filter of tables of paths says the same.
    paths = spark.createDataFrame([(os.path.relpath(f"{a}/{f}", root),) for a, _, fs in os.walk(root) for f in fs], "p string")
    assert {r[0] for r in paths.where(scan.is_scanned(F.col("p"), extensions, ignore)).collect()} == set(got)


@pytest.mark.parametrize("spread", [1, 3, 100])
def test_partitions_hold_each_file_once(root, spread):
    names = tree.Names(scan.IGNORE, scan.TEST_SUFFIXES, scan.EXTENSIONS, scan.FILENAMES)
    reader = tree.TreeReader(root, names, spread)
    found = [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column("rel_path").to_pylist()]
    assert sorted(found) == sorted(walked(root, names))


def test_what_cannot_be_read_is_passed_over(spark, root, monkeypatch):
    files, scandir = tree.Files(root), os.scandir
    monkeypatch.setattr(os, "scandir", lambda at: (_ for _ in ()).throw(PermissionError(at)) if at.endswith("_in") else scandir(at))
    assert files.entries("_in") == [] and files.entries("")
    assert files.text("no such file") is None and files.text("src") is None
    assert scan.scan(spark, f"{root}/no such folder").count() == 0


def test_filters_cut_folders_and_files(spark, root):
    names = tree.Names(scan.IGNORE, scan.TEST_SUFFIXES, scan.EXTENSIONS, scan.FILENAMES)
    reader = tree.PruningReader(root, names, 4)
    given = [tree.StringStartsWith(("rel_path",), "src/ma"), tree.In(("extension",), (".ts", ".cs")), tree.EqualTo(("content",), "plain")]
    assert list(reader.pushFilters(given)) == given
    opened: list[str] = []
    entries = tree.Files.entries
    tree.Files.entries = lambda self, folder: opened.append(folder) or entries(self, folder)
    try:
        found = {p for part in reader.partitions() for batch in reader.read(part) for p in batch.column("rel_path").to_pylist()}
    finally:
        tree.Files.entries = entries
    assert found == {p for p, (ext, _) in walked(root, names).items() if p.startswith("src/ma") and ext in (".ts", ".cs")}
    assert opened and all(f in ("", "src") or f.startswith("src/ma") for f in opened)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = scan.scan(spark, root).where(F.col("rel_path").startswith("src/ma") & F.col("extension").isin(".ts", ".cs"))
        assert {r["rel_path"] for r in got.collect()} == found
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


class Lines:
    """A node for each line; lines that say so are errors."""

    extensions = (".Foo", ".cs")

    def parse(self, path, source):
        if "fail" in source:
            raise ValueError("as told")
        lines = source.split("\n")
        return parsers.Parsed(nodes=[{"id": f"{path}:{i}", "type": "METHOD", "name": x, "file_path": path, "start_line": i, "end_line": i} for i, x in enumerate(lines, 1)])


@pytest.fixture
def lines():
    before = parsers.registry()
    parsers.register(Lines())
    yield
    parsers._BY_EXTENSION.clear()
    parsers._BY_EXTENSION.update(before)


FILES = [("a.foo", "x\ny"), ("b.CS", "class Z { }"), ("c.foo", "fail"), ("d.ts", "function f() { g(); }"), ("e.none", "x")]


def test_registered_parsers_run_on_workers(spark, lines):
    files = spark.createDataFrame(FILES, "rel_path string, content string")
    records = index.parse(files)
    assert {(r["id"], r["name"], r["first_line"]) for r in records.where("record = 'node' AND type = 'METHOD'").collect()} == {("a.foo:1", "x", "x"), ("a.foo:2", "y", "y"), ("b.CS:1", "class Z { }", "class Z { }")}
    assert [tuple(r) for r in index.errors(records).collect()] == [("c.foo", "ValueError: as told")]
    assert index.parse(files, {}).count() == 0
    parsers.register_function(spark)
    files.createOrReplaceTempView("files_to_parse")
    say = "SELECT f.rel_path, r.* FROM files_to_parse f, LATERAL parse_source(f.rel_path, f.content, '{}') r"
    assert {(r["rel_path"], r["name"]) for r in spark.sql(say.format("node")).collect()} == {("a.foo", "x"), ("a.foo", "y"), ("b.CS", "class Z { }"), ("d.ts", "d.ts"), ("d.ts", "f")}
    assert [(r["source"], r["target"]) for r in spark.sql(say.format("edge")).where("type = 'CALLS'").collect()] == [("d.ts:FUNCTION:f:1", "g")]
    assert spark.sql(say.format("error")).columns == ["rel_path", "file_path", "error"]
    with pytest.raises(Exception, match="third argument"):
        spark.sql(say.format("nothing")).collect()


def test_an_index_reads_hidden_files_and_keeps_errors(spark, lines, tmp_path):
    top = tmp_path / "code"
    for name, text in [("_p/.x.ts", b"function hid() { }\xff"), ("y.foo", b"fail")]:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(text)
    graph = CodeGraph(spark, str(tmp_path / "store"))
    graph.index_repo(str(top), "one", extensions=[".ts", ".foo"])
    (top / "y.foo").write_text("fine")
    graph.index_repo(str(top), "two", extensions=[".ts", ".foo"])
    assert {r["id"] for r in graph.table("nodes", "one").where("type = 'FUNCTION'").collect()} == {"one::_p/.x.ts:FUNCTION:hid:1"}
    assert [tuple(r) for r in graph.index_errors("one").collect()] == [("y.foo", "ValueError: as told")]
    assert graph.index_errors("two").count() == 0


def test_an_index_counts_while_it_writes(spark, tmp_path):
    from codeweave.operators import stats

    top = tmp_path / "code"
    top.mkdir()
    (top / "A.java").write_text("class A extends B { void f() { g(); } void g() { } }\nclass B { }\n")
    (top / "b.ts").write_text("function f() { missing(); }")
    graph = CodeGraph(spark, str(tmp_path / "store"))
    row = graph.index_repo(str(top), "one").first()
    records = graph.store.read("records", index.RECORD, "one")
    same = stats.index_summary(scan.scan(spark, str(top)), graph.table("nodes", "one"), records.where("record = 'edge'").select("type")).first()
    assert tuple(row)[:4] == tuple(same) == (2, 7, 10, 0) and row["duration_ms"] > 0
    low = graph.index_repo(str(top), "two", "low").first()
    assert tuple(low)[:4] == (2, 2, 0, 0)
    counts = stats.IndexCounts(["CALLS"])
    counts.nodes(spark.range(5)).write.parquet(str(tmp_path / "n"))
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup())
    row = counts.row(spark)
    assert len(tracker.getJobIdsForGroup()) == before  # no job beyond the write's
    assert row.first()["nodes_found"] == 5


def test_embeddings_of_other_dimensions_are_refused(spark, tmp_path):
    from codeweave.functions import embed

    top = tmp_path / "code"
    top.mkdir()
    (top / "b.ts").write_text("function findMe() { }")
    graph = CodeGraph(spark, str(tmp_path / "store"))
    graph.index_repo(str(top), "one", embedder="local")
    assert graph.dimensions() == 256
    embed.register("tiny", lambda: embed.HashingEmbedder(8))
    with pytest.raises(ValueError, match="256 dimensions, the embedder 8"):
        graph.index_repo(str(top), "two", embedder="tiny")
    with pytest.raises(ValueError, match="no such embedder: other"):
        graph.index_repo(str(top), "two", embedder="other")
    graph.build_vector_index()
    assert [r["name"] for r in graph.query_codebase("find me", repo="one").collect()] == ["findMe"]
    graph.reset_index()
    graph.index_repo(str(top), "two", embedder="tiny")
    assert graph.dimensions() == 8


def test_files_of_one_partition_are_parsed_by_many_tasks(spark):
    files = spark.range(400).select(F.concat(F.lit("a/B"), F.col("id").cast("string"), F.lit(".java")).alias("rel_path"), F.lit("class B { }").alias("content")).coalesce(1)
    parsed = index.parse(files).where("type = 'CLASS'")
    assert parsed.count() == 400
    assert parsed.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_records_of_the_kinds_that_are_asked_for_leave_the_workers(spark):
    files = spark.createDataFrame([("a/A.java", "package p; import q.R; class A extends B { void f() { g(); } void g() { } }"), ("a/b.ts", "export function h() { return k(); }")], "rel_path string, content string")
    every = index.parse(files)
    for kind in ("node", "edge", "ref"):
        got = index.parse(files, kinds=(kind,))
        assert got.count() > 0
        assert sorted(map(str, got.collect())) == sorted(map(str, every.where(F.col("record") == kind).collect()))
