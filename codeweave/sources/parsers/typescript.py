"""TypeScript and JavaScript: classes, interfaces, methods, functions, inheritance, imports and calls."""

from __future__ import annotations

from .records import Declaration, Parsed, assemble, block_comment
from .tokens import Source

_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "typeof", "await", "void", "delete", "new", "super", "import", "function", "with", "case", "of", "in", "else", "do", "throw", "yield", "async", "instanceof", "keyof"}
_METHOD_MODIFIERS = {"public", "private", "protected", "static", "readonly", "async", "override", "abstract", "declare", "get", "set", "*", "accessor"}
_STATEMENT = {"", ";", "{", "}", "export", "default", "declare", ")"}
_OBJECT_BEFORE = {"=", "(", ",", ":", "[", "return", "?", "??", "||", "&&", "=>", "default"}


class TypeScriptParser:
    extensions = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs")

    def parse(self, path: str, source: str) -> Parsed:
        s = Source(source, script=True)
        declarations, names = self._declarations(s)
        out, _ = assemble(path, s, "typescript", declarations, self._calls(s, names), lambda d, _: d.name, block_comment, path, lambda k: k != "METHOD")
        out.refs += [{"kind": "import", "source_id": out.nodes[0]["id"], "target_name": m} for m in self._imports(s)]
        return out

    def _imports(self, s: Source) -> list[str]:
        out = []
        for i, t in enumerate(s.tokens):
            if t.text != "import" or s.at(i - 1) == "." or s.at(i + 1) in ("(", "."):
                continue
            j = i + 1
            while j < len(s.tokens) and s.tokens[j].kind != "str" and s.at(j) not in (";", "="):
                j = s.partner[j] if s.at(j) == "{" and s.partner[j] > j else j
                j += 1
            if j < len(s.tokens) and s.tokens[j].kind == "str":
                out.append(s.at(j).strip("'\""))
        return out

    def _declarations(self, s: Source) -> tuple[list[Declaration], set[int]]:
        out: list[Declaration] = []
        names: set[int] = set()
        bodies: dict[int, str] = {}
        open_: list[int] = []
        for i, t in enumerate(s.tokens):
            if t.text in ("{", "(", "["):
                if t.text == "{" and i not in bodies and s.at(i - 1) in _OBJECT_BEFORE:
                    bodies[i] = "block" if s.at(i - 1) == "=>" else "object"
                open_.append(i)
            elif t.text in ("}", ")", "]") and open_ and s.partner[i] == open_[-1]:
                open_.pop()
            place = bodies.get(open_[-1], "") if open_ else ""
            if t.text == "class" and s.at(i - 1) not in (".", "?.") and s.at(i + 1) != ":" and (s.is_name(i + 1) or s.at(i + 1) == "{"):
                out += self._class(s, i, bodies)
            elif t.text == "interface" and s.is_name(i + 1) and s.at(i - 1) not in (".", "?."):
                out += self._interface(s, i, bodies)
            elif t.text == "function" and (d := self._function(s, i)):
                out.append(d)
                names.add(i + 1 + (s.at(i + 1) == "*"))
            elif t.text in ("const", "let", "var") and s.at(i - 1) not in (".", "?."):
                out += self._variables(s, i)
            elif place in ("class", "interface", "object") and (d := self._method(s, i, open_[-1], place)):
                out.append(d)
                names.add(i)
        return out, names

    def _clause(self, s: Source, a: int, b: int) -> list[str]:
        """Names of the types between commas: of a generic type its own, of a dotted one the last part."""
        out = []
        for x, y in s.split(a, b):
            name = ""
            while x < y:
                if s.is_name(x):
                    name = s.at(x)
                    x += 1
                elif s.at(x) == ".":
                    x += 1
                elif s.at(x) == "<":
                    x = y
                else:  # a call or another expression has no name
                    name = ""
                    break
            if name:
                out.append(name)
        return out

    def _head(self, s: Source, j: int) -> tuple[int, dict[str, tuple[int, int]]]:
        """The brace that opens a type's body, and the spans of its clauses."""
        clauses: dict[str, tuple[int, int]] = {}
        clause, begin = "", j
        while j < len(s.tokens) and s.at(j) not in ("{", ";"):
            if s.at(j) in ("extends", "implements"):
                if clause:
                    clauses[clause] = (begin, j)
                clause, begin = s.at(j), j + 1
            elif s.at(j) == "(" and s.partner[j] > j:
                j = s.partner[j]
            elif s.at(j) == "<" and s.skip_angles(j) > j:
                j = s.skip_angles(j) - 1
            j += 1
        if clause:
            clauses[clause] = (begin, j)
        return j, clauses

    def _class(self, s: Source, i: int, bodies: dict[int, str]) -> list[Declaration]:
        named = s.is_name(i + 1) and s.at(i + 1) not in ("extends", "implements")
        body, clauses = self._head(s, i + 1 + named)
        if s.at(body) != "{" or s.partner[body] < 0:
            return []
        bodies[body] = "class"
        extends, implements = (self._clause(s, *clauses[c]) if c in clauses else [] for c in ("extends", "implements"))
        return [Declaration("CLASS", s.at(i + 1) if named else "<anonymous>", i - (s.at(i - 1) == "abstract"), s.partner[body], extends, implements)]

    def _interface(self, s: Source, i: int, bodies: dict[int, str]) -> list[Declaration]:
        body, clauses = self._head(s, i + 2)
        if s.at(body) != "{" or s.partner[body] < 0:
            return []
        bodies[body] = "interface"
        return [Declaration("INTERFACE", s.at(i + 1), i, s.partner[body], self._clause(s, *clauses["extends"]) if "extends" in clauses else [])]

    def _params(self, s: Source, j: int) -> int:
        """The place after (parameters) and a type of result that begin at j, type parameters first; -1 for none."""
        j = s.skip_angles(j)
        if s.at(j) != "(" or s.partner[j] < 0:
            return -1
        j = s.partner[j] + 1
        return self._type_end(s, j + 1) if s.at(j) == ":" else j

    def _type_end(self, s: Source, j: int) -> int:
        """The place after a type: what follows it ends a signature or opens a body."""
        first = j
        while j < len(s.tokens):
            x = s.at(j)
            if x == "{" and j > first and s.at(j - 1) not in ("|", "&", ":", "is", "=>"):
                return j
            if x in (";", ",", ")", "}", "]", "="):
                return j
            if x == "=>" and s.at(j - 1) != ")":
                return j
            if j > first and s.tokens[j].line > s.tokens[j - 1].end_line and x not in ("|", "&", "{", ">") and s.at(j - 1) not in ("|", "&", ":", "<", ","):
                return j
            if x in ("(", "[", "{") and s.partner[j] > j:
                j = s.partner[j]
            elif x == "<" and s.skip_angles(j) > j:
                j = s.skip_angles(j) - 1
            j += 1
        return j

    def _function(self, s: Source, i: int) -> Declaration | None:
        first = i - (s.at(i - 1) == "async")
        name = i + 1 + (s.at(i + 1) == "*")
        before = s.at(first - 1)
        own_line = first == 0 or s.tokens[first].line > s.tokens[first - 1].end_line
        if not s.is_name(name) or not (before in _STATEMENT or (own_line and before not in _OBJECT_BEFORE)):
            return None
        j = self._params(s, name + 1)
        return Declaration("FUNCTION", s.at(name), first, s.partner[j]) if j > 0 and s.at(j) == "{" and s.partner[j] > j else None

    def _method(self, s: Source, i: int, body: int, place: str) -> Declaration | None:
        t = s.tokens[i]
        name, j = t.text, i + 1
        if t.text == "[" and s.partner[i] > i and s.at(i - 1) in {"{", ";", "}", ","} | _METHOD_MODIFIERS:
            name, j = "".join(x.text for x in s.tokens[i : s.partner[i] + 1]), s.partner[i] + 1
        elif t.kind not in ("id", "str", "num"):
            return None
        j += s.at(j) in ("?", "!")
        if s.at(j) not in ("(", "<") or t.text in _NOT_CALLS - {"delete", "import", "of", "in", "with", "do", "catch", "throw", "return", "get", "set"} and s.at(i - 1) not in _METHOD_MODIFIERS | {"{", ";", "}", ","}:
            return None
        if t.text in ("if", "for", "while", "switch", "function", "new", "super"):
            return None
        first = i
        while s.at(first - 1) in _METHOD_MODIFIERS:
            first -= 1
        before = s.at(first - 1)
        own_line = s.tokens[first].line > s.tokens[first - 1].end_line
        if place == "object":
            if before not in ("{", ","):
                return None
        elif not (before in ("{", "}", ";", ",") or (own_line and before not in ("=", "=>", "(", "?", ":", ".", "&&", "||", "+", "return")) or (before == ")" and s.tokens[first - 1].line <= s.tokens[first].line and self._decorated(s, first - 1))):
            return None
        end = self._params(s, j)
        if end < 0:
            return None
        if s.at(end) == "{" and s.partner[end] > end:
            return Declaration("METHOD", name, first, s.partner[end])
        if place == "object":
            return None
        return Declaration("METHOD", name, first, end - 1)

    def _decorated(self, s: Source, paren: int) -> bool:
        j = s.partner[paren] - 1
        while s.at(j - 1) == ".":
            j -= 2
        return s.at(j).startswith("@") or s.at(j - 1) == "@"

    def _variables(self, s: Source, i: int) -> list[Declaration]:
        """Functions that a declaration gives names to; a span is the declarator's."""
        out, j = [], i + 1
        while j < len(s.tokens):
            if not s.is_name(j):
                return out  # a pattern has no one name
            name, k = j, j + 1
            if s.at(k) == ":":
                k = self._type_end(s, k + 1)
            if s.at(k) != "=":
                return out
            end = self._value(s, k + 1)
            body = self._function_body(s, k + 1)
            if body >= 0:
                last = s.partner[body] if s.at(body) == "{" and s.partner[body] > body else self._value(s, body) - 1
                out.append(Declaration("FUNCTION", s.at(name), name, last))
                end = max(end, last + 1)
            if s.at(end) != ",":
                return out
            j = end + 1
        return out

    def _function_body(self, s: Source, j: int) -> int:
        """The first token of the body of the function that a value is; -1 where it is none."""
        j += s.at(j) == "async" and s.at(j + 1) != "=>"
        if s.at(j) == "function":
            j += 1 + (s.at(j + 1) == "*")
            end = self._params(s, j + (s.is_name(j)))
            return end if end > 0 and s.at(end) == "{" else -1
        if s.is_name(j) and s.at(j + 1) == "=>":
            return j + 2
        end = self._params(s, j)
        return end + 1 if end > 0 and s.at(end) == "=>" else -1

    def _value(self, s: Source, j: int) -> int:
        """The place after an expression."""
        first = j
        while j < len(s.tokens):
            x = s.at(j)
            if x in (";", ",", ")", "]", "}"):
                return j
            new_line = j > first and s.tokens[j].line > s.tokens[j - 1].end_line
            if new_line and (s.tokens[j].kind in ("id", "str") or x in ("{", "@")) and s.at(j - 1) not in ("=>", "=", "+", "&&", "||", "?", ":", "??", ".", "?.", "(", "return", "<", ">", "|", "&") and x not in ("instanceof", "in", "of", "as"):
                return j
            j = s.partner[j] if x in ("(", "[", "{") and s.partner[j] > j else j
            j += 1
        return j

    def _calls(self, s: Source, names: set[int]) -> list[tuple[int, str]]:
        out = []
        for i, t in enumerate(s.tokens):
            if t.kind != "id" or i in names or t.text.startswith("@") or s.at(i - 1) in ("new", "function", "@"):
                continue
            j = i + 1
            if s.at(j) == "<":
                after = s.skip_angles(j)
                if after == j or s.at(after) != "(" or any(s.at(k) in ("+", "-", "*") for k in range(j, after)):
                    continue
                j = after
            j += s.at(j) == "?." and s.at(j + 1) == "("
            if s.at(j) != "(" or (t.text in _NOT_CALLS and s.at(i - 1) not in (".", "?.")):
                continue
            if s.at(s.chain_start(i) - 1) == "new" and s.at(i - 1) == "." and all(s.at(k) != "(" for k in range(s.chain_start(i), i)):
                continue
            out.append((i, t.text))
        return out
