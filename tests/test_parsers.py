from codeweave.sources.parsers import Parsed, parse_source, register, supported_extensions


def nodes(parsed, *keys):
    return [tuple(n[k] for k in keys) for n in parsed.nodes]


def calls(parsed):
    return [(e["source"].split(":")[2], e["target"], e["source_line"]) for e in parsed.edges if e["type"] == "CALLS"]


def refs(parsed, kind):
    return [(r["source_id"].split(":")[2], r["target_name"]) for r in parsed.refs if r["kind"] == kind]


JAVA = """package org.store.core;

class Till {
  void charge() {
    record();
  }
  void record() {
  }
}
"""


def test_java_call_between_methods():
    p = parse_source("src/Till.java", JAVA)
    charge = next(n for n in p.nodes if n["name"] == "charge")
    assert charge["language"] == "java" and charge["qualified_name"] == "org.store.core.Till.charge" and (charge["start_line"], charge["end_line"]) == (4, 6)
    (edge,) = [e for e in p.edges if e["type"] == "CALLS"]
    assert edge == {"source": charge["id"], "target": "record", "type": "CALLS", "confidence": 0.6, "resolution": "ast", "source_line": 5}
    assert nodes(p, "type", "name") == [("FILE", "Till.java"), ("CLASS", "Till"), ("METHOD", "charge"), ("METHOD", "record")]
    assert charge["id"] == "src/Till.java:METHOD:charge:4" and len(charge["hash"]) == 12


def test_java_nesting_injection_and_configuration():
    p = parse_source(
        "A.java",
        """package p;
import java.util.List;
/**
 * Outer one.
 */
@Bean(name = "x{")
public class A<T> extends B<T> implements I, J<T>, q.K {
  @Inject Instance<Clock> clock;
  @Autowired private Store store;
  @Inject A self;
  private String s = "class X { void y() {} }"; // void z() {}
  enum E { ONE(1) { void inner() { go(); } }, TWO(2); E(int n) { init(n); } }
  record R(int a) implements I { R { check(a); } }
  interface N extends O, P<Q> { void n(); }
  @Override public <X> List<X> run(String a) throws Err {
    String v = this.cfg.getConfigurationItem(LIMIT_MAX, lower);
    new Helper(a).help(); helper(); helper(); run(a);
    return List.of(x -> other(x));
  }
}
""",
    )
    names = {n["name"]: n for n in p.nodes if n["type"] != "METHOD" or n["name"] != "E"}
    assert names["E"]["qualified_name"] == "p.E" and names["inner"]["qualified_name"] == "p.A.E.inner"
    assert names["A"]["documentation"] == "Outer one." and names["A"]["start_line"] == 6
    assert refs(p, "extends") == [("A", "B"), ("N", "O"), ("N", "P")]
    assert refs(p, "implements") == [("A", "I"), ("R", "I")]
    assert refs(p, "injects") == [("A", "Clock"), ("A", "Store")]
    assert refs(p, "import") == [("A.java", "java.util.List")]
    assert [c for c in calls(p) if c[0] == "run"] == [("run", "getConfigurationItem", 16), ("run", "help", 17), ("run", "helper", 17), ("run", "of", 18), ("run", "other", 18)]
    assert [(e["target"], e["confidence"]) for e in p.edges if e["type"] == "READS_CONFIG"] == [("LIMIT_MAX", 0.9)]
    assert ("inner", "go", 12) in calls(p) and not any(n["name"] in ("y", "z", "X") for n in p.nodes)


CS = """using System;
namespace Shop.Core;
interface IRun : IBase { }
class Job : Task, IRun {
  void Start() { Step(); }
  void Step() { }
}
struct Key : IEq<Key> { }
"""


def test_csharp_inheritance_and_calls():
    p = parse_source("Job.cs", CS)
    assert [(n["name"], n["qualified_name"]) for n in p.nodes[1:]] == [("IRun", "Shop.Core.IRun"), ("Job", "Shop.Core.Job"), ("Start", "Shop.Core.Job.Start"), ("Step", "Shop.Core.Job.Step"), ("Key", "Shop.Core.Key")]
    assert {n["language"] for n in p.nodes} == {"csharp"}
    assert calls(p) == [("Start", "Step", 5)]
    assert refs(p, "extends") == [("IRun", "IBase"), ("Job", "Task")]
    assert refs(p, "implements") == [("Job", "IRun"), ("Key", "IEq")]
    assert refs(p, "import") == [("Job.cs", "System")]
    assert ("Job.cs:CLASS:Job:4", "Job.cs:METHOD:Start:5") in [(e["source"], e["target"]) for e in p.edges if e["type"] == "CONTAINS"]


def test_csharp_nested_namespaces_and_enum():
    p = parse_source("N.cs", "namespace Outer {\n namespace Inner {\n  enum Size : byte { S, L }\n  class Use { void Go(Dep d) { d.Work(); int Add(int x) => Sum(x); } int P => Field(1); }\n }\n}\n")
    assert {n["qualified_name"] for n in p.nodes[1:]} == {"Outer.Inner.Size", "Outer.Inner.Use", "Outer.Inner.Use.Go", "Outer.Inner.Use.Go.Add"}
    assert calls(p) == [("Go", "Work", 4), ("Add", "Sum", 4)]
    assert not refs(p, "extends") and not refs(p, "implements")


def test_typescript():
    p = parse_source(
        "web/app.tsx",
        """import { x } from './x';
/* the app */
export class App extends ns.Base<P> implements IApp, Gen<T> {
  private n = load();
  constructor(private y: string) { super(y); }
  over(a: string): void;
  over(a: any) { return this.#do(`n ${call(1)} class Z {}`); }
  field = () => { hidden(); };
}
export interface IApp extends A, B<C> { go(x: number): void }
export const add = (a: number): number => a + sum(a);
const f = async function () { return deep(); }, k = 3;
export default function main() { const inner = x => g(x); add(1); new Foo(); obj?.m(); main(); }
const re = /a"(b/.test(s) ? 1 : 2;
function* gen() { yield step(); }
enum Color { Red }
""",
    )
    assert nodes(p, "type", "name")[1:] == [
        ("CLASS", "App"), ("METHOD", "constructor"), ("METHOD", "over"), ("METHOD", "over"), ("INTERFACE", "IApp"), ("METHOD", "go"), ("FUNCTION", "add"), ("FUNCTION", "f"), ("FUNCTION", "main"), ("FUNCTION", "inner"), ("FUNCTION", "gen"),
    ]
    assert calls(p) == [("App", "load", 4), ("over", "#do", 7), ("over", "call", 7), ("App", "hidden", 8), ("add", "sum", 11), ("f", "deep", 12), ("inner", "g", 13), ("main", "add", 13), ("main", "m", 13), ("gen", "step", 15)]
    assert refs(p, "extends") == [("App", "Base"), ("IApp", "A"), ("IApp", "B")] and refs(p, "implements") == [("App", "IApp"), ("App", "Gen")]
    assert refs(p, "import") == [("web/app.tsx", "./x")]
    assert p.nodes[1]["documentation"] == "the app" and {n["language"] for n in p.nodes} == {"typescript"}
    assert not any(e["type"] == "DEFINES" and ":METHOD:" in e["target"] for e in p.edges)


def test_registry():
    assert parse_source("a.py", "def f(): pass").nodes == []
    assert ".java" in supported_extensions()

    class Lines:
        extensions = (".Txt",)

        def parse(self, path, source):
            return Parsed(nodes=[{"id": path}])

    register(Lines())
    assert parse_source("A.TXT", "x").nodes == [{"id": "A.TXT"}]


def test_broken_sources_do_not_raise():
    for ext in ("java", "ts", "cs"):
        for text in ("", "class", "class A {", "}}}} class B { void f( }", '"', "/* x", "`${`${", "class A<", "void f() {", "@", "a.b.c(", "const x ="):
            assert parse_source(f"a.{ext}", text).nodes[0]["type"] == "FILE"
