"""C#: namespaces, types, methods, local functions, inheritance, usings and calls."""

from __future__ import annotations

import re

from .java import member_starts
from .records import Declaration, Parsed, assemble, line_comment
from .tokens import Source

_KINDS = {"class": "CLASS", "struct": "CLASS", "record": "CLASS", "enum": "CLASS", "interface": "INTERFACE"}
_MODIFIERS = {"public", "private", "protected", "internal", "static", "sealed", "abstract", "virtual", "override", "async", "partial", "readonly", "extern", "unsafe", "new", "ref", "required", "file"}
_NOT_CALLS = {"if", "for", "foreach", "while", "switch", "catch", "using", "lock", "return", "typeof", "sizeof", "default", "checked", "unchecked", "when", "base", "this", "new", "await", "throw", "fixed", "stackalloc", "is", "as", "in", "and", "or", "not", "where", "else", "do", "case", "yield", "out", "ref", "delegate", "operator", "var"}
_NOT_TYPES = _NOT_CALLS - {"var", "ref", "base", "this"} | {"namespace", "class", "struct", "enum", "interface", "get", "set"}


class CSharpParser:
    extensions = (".cs",)

    def parse(self, path: str, source: str) -> Parsed:
        s = Source(source)
        starts = member_starts(s)
        spaces = self._namespaces(s)
        declarations, names = self._declarations(s, starts)

        def qualify(d: Declaration, owners: list[Declaration]) -> str:
            around = [n for a, b, n in spaces if a <= d.first <= b]
            return ".".join([*around, *[o.name for o in owners], d.name])

        out, _ = assemble(path, s, "csharp", declarations, self._calls(s, names), qualify, line_comment, path, lambda k: k in ("CLASS", "INTERFACE"), lambda k: k in ("METHOD", "FUNCTION"))
        out.refs += [{"kind": "import", "source_id": out.nodes[0]["id"], "target_name": n} for n in self._usings(s, starts)]
        return out

    def _name(self, s: Source, i: int) -> tuple[str, int]:
        parts = []
        while s.is_name(i) or s.at(i) in (".", "::"):
            parts.append(s.at(i))
            i += 1
        return "".join(parts), i

    def _namespaces(self, s: Source) -> list[tuple[int, int, str]]:
        out = []
        for i, t in enumerate(s.tokens):
            if t.text == "namespace":
                name, j = self._name(s, i + 1)
                out.append((i, s.partner[j] if s.at(j) == "{" and s.partner[j] > j else len(s.tokens), name))
        return sorted(out)

    def _usings(self, s: Source, starts: list[int]) -> list[str]:
        out = []
        for i, t in enumerate(s.tokens):
            if t.text == "using" and starts[i] in (i, i - 1) and s.at(i + 1) not in ("(", "var"):
                name, j = self._name(s, i + 1 + (s.at(i + 1) == "static"))
                if name and s.at(j) in (";", "=", "<"):
                    out.append(name)
        return out

    def _declarations(self, s: Source, starts: list[int]) -> tuple[list[Declaration], set[int]]:
        out: list[Declaration] = []
        names: set[int] = set()
        bodies: dict[int, Declaration] = {}
        code: dict[int, Declaration] = {}
        open_: list[int] = []
        for i, t in enumerate(s.tokens):
            if t.text == "{":
                open_.append(i)
            elif t.text == "}" and open_ and s.partner[i] == open_[-1]:
                open_.pop()
            elif t.kind != "id":
                continue
            elif t.text in _KINDS and s.at(i - 1) not in (".", ":", ",", "where", "record") and (s.is_name(i + 1) or s.at(i + 1) in ("class", "struct")):
                if d := self._type(s, i, starts[i], bodies):
                    out.append(d)
            elif open_ and open_[-1] in bodies and (d := self._method(s, i, starts[i], bodies[open_[-1]], code)):
                out.append(d)
                names.add(i)
            elif open_ and any(o in code for o in open_) and (d := self._local(s, i, starts[i], code)):
                out.append(d)
                names.add(i)
        return out, names

    def _type(self, s: Source, i: int, first: int, bodies: dict[int, Declaration]) -> Declaration | None:
        word = s.at(i)
        at = i + 1 + (s.at(i + 1) in ("class", "struct") and word == "record")
        if not s.is_name(at):
            return None
        j = s.skip_angles(at + 1)
        j = s.partner[j] + 1 if s.at(j) == "(" and s.partner[j] > j else j
        bases: list[str] = []
        if s.at(j) == ":":
            begin = j + 1
            while j < len(s.tokens) and s.at(j) not in ("{", ";", "where"):
                j = s.partner[j] if s.at(j) == "(" and s.partner[j] > j else j
                j += 1
            bases = [self._base(s, a, b) for a, b in s.split(begin, j)]
        while j < len(s.tokens) and s.at(j) not in ("{", ";"):
            j = s.partner[j] if s.at(j) == "(" and s.partner[j] > j else j
            j += 1
        if j >= len(s.tokens) or (s.at(j) == "{" and s.partner[j] < 0):
            return None
        kind = _KINDS[word]
        d = Declaration(kind, s.at(at), first, s.partner[j] if s.at(j) == "{" else j)
        for n, base in enumerate(bases if word != "enum" else []):
            as_interface = kind == "CLASS" and (word == "struct" or n > 0 or bool(re.match(r"I[A-Z]", base)))
            (d.implements if as_interface else d.extends).append(base)
        if s.at(j) == "{":
            bodies[j] = d
        return d

    def _base(self, s: Source, a: int, b: int) -> str:
        """A generic base's own name, a dotted one's last part."""
        name = s.at(a)
        for k in range(a, b):
            if s.at(k) in ("<", "("):
                break
            if s.is_name(k):
                name = s.at(k)
        return name

    def _end(self, s: Source, i: int, code: dict[int, Declaration], kind: str, first: int, open_end: bool) -> Declaration | None:
        """The declaration whose parameters begin after name i, if a body or an end follows them."""
        j = s.partner[s.skip_angles(i + 1)] + 1
        if s.at(j) == ":" and s.at(j + 1) in ("base", "this"):
            j = s.partner[j + 2] + 1 if s.partner[j + 2] > 0 else j
        while s.at(j) == "where":
            while s.at(j) not in ("{", ";", "=>", ""):
                j += 1
        if s.at(j) == "{" and s.partner[j] > j:
            d = Declaration(kind, s.at(i), first, s.partner[j])
            code[j] = d
            return d
        if s.at(j) == "=>":
            while j < len(s.tokens) and s.at(j) != ";":
                j = s.partner[j] if s.at(j) in ("(", "[", "{") and s.partner[j] > j else j
                j += 1
            return Declaration(kind, s.at(i), first, min(j, len(s.tokens) - 1))
        return Declaration(kind, s.at(i), first, j) if open_end and s.at(j) == ";" else None

    def _typed(self, s: Source, i: int) -> bool:
        j = i - 1
        while s.at(j) == "." and s.is_name(j - 1):  # an interface's member, named with the interface
            j -= 2
        before = s.tokens[j] if j >= 0 else None
        return bool(before) and ((before.kind == "id" and before.text not in _NOT_TYPES | _MODIFIERS) or before.text in (">", "]", "?"))

    def _takes(self, s: Source, i: int) -> bool:
        j = s.skip_angles(i + 1)
        return s.at(j) == "(" and s.partner[j] > j

    def _method(self, s: Source, i: int, first: int, owner: Declaration, code: dict[int, Declaration]) -> Declaration | None:
        if not self._takes(s, i) or s.at(i) in _NOT_CALLS or any(s.at(k) in ("=", "=>") for k in range(first, i)):
            return None
        makes = s.at(i) == owner.name and (i == first or s.at(i - 1) in _MODIFIERS | {"]"}) and s.at(i - 1) != "new"
        return self._end(s, i, code, "METHOD", first, True) if makes or self._typed(s, i) else None

    def _local(self, s: Source, i: int, first: int, code: dict[int, Declaration]) -> Declaration | None:
        plain = all(s.is_name(k) or s.at(k) in ("<", ">", "[", "]", "?", ",", ".") for k in range(first, i))
        if not self._takes(s, i) or i == first or not plain or s.at(i) in _NOT_CALLS or s.at(first) in _NOT_TYPES or s.at(i - 1) == "." or not self._typed(s, i):
            return None
        return self._end(s, i, code, "FUNCTION", first, False)

    def _calls(self, s: Source, names: set[int]) -> list[tuple[int, str]]:
        out = []
        for i, t in enumerate(s.tokens):
            if t.kind != "id" or i in names or t.text in _NOT_CALLS or not self._takes(s, i):
                continue
            start = i
            while s.at(start - 1) in (".", "?.", "::") and s.is_name(start - 2):
                start -= 2
            if s.at(start - 1) == "new" or s.at(start - 2) == "new" and s.at(start - 1) == ")":
                continue
            if s.at(i - 1) in _KINDS or (s.at(start - 1) in ("[", ",") and self._attribute(s, start - 1)):
                continue
            out.append((i, t.text))
        return out

    def _attribute(self, s: Source, j: int) -> bool:
        while j >= 0 and s.at(j) != "[":
            j = s.partner[j] if s.at(j) in (")", "}", "]") and s.partner[j] >= 0 else j
            j -= 1
        return s.at(j) == "[" and s.at(j - 1) in ("", ";", "{", "}", "]", "(", ",")
