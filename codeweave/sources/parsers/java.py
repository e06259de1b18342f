"""Java: types, methods, inheritance, injected fields, calls and configuration reads."""

from __future__ import annotations

import re

from .records import Declaration, Parsed, assemble, block_comment
from .tokens import Source

_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "sealed", "strictfp", "default", "synchronized", "native", "transient", "volatile"}
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "super", "this", "new", "try", "assert", "throw", "else", "do", "case", "yield"}
_NOT_TYPES = {"new", "return", "throw", "else", "case", "assert", "instanceof", "yield", "package", "import", "extends", "implements", "throws"}
_KINDS = {"class": "CLASS", "enum": "CLASS", "record": "CLASS", "interface": "INTERFACE"}
#: Fixed values.
_WRAPPERS = {"Instance", "Event", "Provider", "InjectableInstance"}
_INJECT = {"Inject", "Autowired"}
_CONFIG = {"getConfiguration", "getConfigurationItem", "getConfigItem"}


def member_starts(s: Source) -> list[int]:
    """For each token, where the statement or member around it begins."""
    out, open_, start = [0] * len(s.tokens), [], 0
    for i, t in enumerate(s.tokens):
        out[i] = start
        if t.kind != "op":
            continue
        if t.text in ("{", "(", "["):
            open_.append((t.text, start))
            if t.text == "{":
                start = i + 1
        elif t.text in ("}", ")", "]") and open_:
            kind, before = open_.pop()
            start = i + 1 if t.text == "}" and not (open_ and open_[-1][0] != "{") else before
        elif t.text == ";" and not (open_ and open_[-1][0] != "{"):
            start = i + 1
    return out


class JavaParser:
    extensions = (".java",)

    def parse(self, path: str, source: str) -> Parsed:
        s = Source(source, annotations=True)
        starts = member_starts(s)
        declarations, bodies = self._declarations(s, starts)
        named = {d.first for d in declarations}
        package = self._package(s)

        def qualify(d: Declaration, owners: list[Declaration]) -> str:
            # A type's qualified name leaves out the innermost owner; a method's has them all.
            kept = owners if d.kind == "METHOD" else owners[:-1]
            return ".".join(x for x in [package, *[o.name for o in kept], d.name] if x)

        def config(owner: str, at: int, line: int, edges: list[dict]) -> None:
            if s.at(at) not in _CONFIG:
                return
            for a, b in s.split(at + 2, s.partner[at + 1]):
                if b - a == 1 and re.fullmatch(r"[A-Z][A-Z0-9_]+", s.at(a)) and not any(e["type"] == "READS_CONFIG" and e["source"] == owner and e["target"] == s.at(a) for e in edges):
                    edges.append({"source": owner, "target": s.at(a), "type": "READS_CONFIG", "confidence": 0.9, "resolution": "ast", "source_line": line})

        out, ids = assemble(path, s, "java", declarations, self._calls(s, self._names, bodies), qualify, block_comment, package or path, lambda k: k != "METHOD", on_call=config)
        file_id = out.nodes[0]["id"]
        out.refs += [{"kind": "import", "source_id": file_id, "target_name": n} for n in self._imports(s)]
        out.refs += self._injects(s, starts, bodies, declarations, ids, named)
        return out

    def _package(self, s: Source) -> str:
        for i, t in enumerate(s.tokens):
            if t.text == "package":
                return self._dotted(s, i + 1)
            if t.text in ("import", "class", "{"):
                break
        return ""

    def _dotted(self, s: Source, i: int) -> str:
        parts = []
        while s.at(i) not in (";", "") and s.tokens[i].line:
            if s.is_name(i):
                parts.append(s.at(i))
            i += 1
        return ".".join(parts)

    def _imports(self, s: Source) -> list[str]:
        return [self._dotted(s, i + 1 + (s.at(i + 1) == "static")) for i, t in enumerate(s.tokens) if t.text == "import" and s.at(i - 1) in ("", ";")]

    def _declarations(self, s: Source, starts: list[int]) -> tuple[list[Declaration], dict[int, Declaration | None]]:
        """Declarations, and the braces that are bodies of types (None for anonymous ones)."""
        out: list[Declaration] = []
        bodies: dict[int, Declaration | None] = {}
        self._names: set[int] = set()
        open_: list[int] = []
        for i, t in enumerate(s.tokens):
            if t.text == "{":
                before = s.at(i - 1)
                if i not in bodies and before == ")" and self._new_before(s, s.partner[i - 1]):
                    bodies[i] = None
                elif i not in bodies and open_ and isinstance(bodies.get(open_[-1]), Declaration) and starts[i] == starts[open_[-1] + 1] and self._enum.get(open_[-1]):
                    bodies[i] = None  # the body of an enum's constant
                open_.append(i)
            elif t.text == "}" and open_ and s.partner[i] == open_[-1]:
                open_.pop()
            elif t.kind != "id":
                continue
            elif t.text in _KINDS and s.is_name(i + 1) and s.at(i - 1) not in (".", "@", "::") and (t.text != "record" or s.at(s.skip_angles(i + 2)) == "("):
                d = self._type(s, i, starts[i], bodies)
                if d:
                    out.append(d)
            elif open_ and open_[-1] in bodies and (d := self._method(s, i, starts[i], bodies[open_[-1]])):
                out.append(d)
                self._names.add(i)
        return out, bodies

    _enum: dict[int, bool] = {}

    def _new_before(self, s: Source, paren: int) -> bool:
        """Whether the bracket follows `new Type` or `new Type<...>`."""
        j = paren - 1
        if s.at(j) == ">":
            j = s.back_over_angles(j) - 1
        while s.is_name(j):
            if s.at(j - 1) == "new":
                return True
            if s.at(j - 1) != ".":
                return False
            j -= 2
        return False

    def _type(self, s: Source, i: int, first: int, bodies: dict) -> Declaration | None:
        j, extends, implements, clause, begin = i + 2, [], [], "", 0

        def close(end: int) -> None:
            for a, b in s.split(begin, end) if clause else []:
                while s.at(a) == "@":  # annotations of types
                    a = s.partner[a + 2] + 1 if s.at(a + 2) == "(" else a + 2
                if clause == "extends":
                    extends.append(s.at(a))
                elif clause == "implements" and b - a == 1:
                    implements.append(s.at(a))

        while j < len(s.tokens) and s.at(j) not in ("{", ";"):
            if s.at(j) in ("extends", "implements", "permits"):
                close(j)
                clause, begin = s.at(j), j + 1
            elif s.at(j) == "(" and s.partner[j] > j:
                j = s.partner[j]
            elif s.at(j) == "<" and s.skip_angles(j) > j:
                j = s.skip_angles(j) - 1
            j += 1
        close(j)
        if s.at(j) != "{" or s.partner[j] < 0:
            return None
        d = Declaration(_KINDS[s.at(i)], s.at(i + 1), first, s.partner[j], extends, implements)
        bodies[j] = d
        self._enum = {**self._enum, j: s.at(i) == "enum"}
        return d

    def _method(self, s: Source, i: int, first: int, owner: Declaration | None) -> Declaration | None:
        if s.at(i + 1) != "(" or s.partner[i + 1] < 0 or s.at(i) in _NOT_CALLS or any(s.at(k) == "=" for k in range(first, i)):
            return None
        before = s.tokens[i - 1] if i else None
        returns = before and ((before.kind == "id" and before.text not in _NOT_TYPES | _MODIFIERS and s.at(i - 2) != "@") or before.text in (">", "]"))
        makes = owner is not None and s.at(i) == owner.name and (i == first or s.at(i - 1) in _MODIFIERS | {")", ">"} or s.at(i - 2) == "@")
        if not returns and not makes:
            return None
        j = s.partner[i + 1] + 1
        while s.at(j) in ("[", "]"):
            j += 1
        if s.at(j) == "throws":
            while s.at(j) not in ("{", ";", ""):
                j += 1
        if s.at(j) == "{" and s.partner[j] > j:
            return Declaration("METHOD", s.at(i), first, s.partner[j])
        return Declaration("METHOD", s.at(i), first, j) if s.at(j) == ";" else None

    def _calls(self, s: Source, names: set[int], bodies: dict) -> list[tuple[int, str]]:
        out = []
        for i, t in enumerate(s.tokens):
            if t.kind != "id" or s.at(i + 1) != "(" or i in names or t.text in _NOT_CALLS:
                continue
            j = i
            while s.at(j - 1) == "." and s.is_name(j - 2):
                j -= 2
            if s.at(j - 1) in ("new", "@") or (s.at(j - 1) == "record" and s.at(j - 2) != "."):
                continue
            if s.at(i - 1) in ("{", ",") and self._constant(s, i, bodies):
                continue
            out.append((i, t.text))
        return out

    def _constant(self, s: Source, i: int, bodies: dict) -> bool:
        """Whether a name with arguments is a constant of an enum."""
        j = i - 1
        while j >= 0 and s.at(j) not in ("{", ";"):
            j = s.partner[j] if s.at(j) in (")", "}", "]") and s.partner[j] >= 0 else j
            j -= 1
        return s.at(j) == "{" and bool(self._enum.get(j)) and isinstance(bodies.get(j), Declaration)

    def _injects(self, s: Source, starts: list[int], bodies: dict, declarations: list[Declaration], ids: dict[int, str], named: set[int]) -> list[dict]:
        out = []
        for i, t in enumerate(s.tokens):
            if t.text != "@" or s.at(i + 1) not in _INJECT or s.at(i + 2) == ".":
                continue
            j, first = starts[i], starts[i]
            if first in named:  # a method or a type
                continue
            while s.at(j) == "@" or s.at(j) in _MODIFIERS:
                if s.at(j) == "@":
                    j += 2
                    while s.at(j) == ".":
                        j += 2
                    j = s.partner[j] + 1 if s.at(j) == "(" and s.partner[j] > j else j
                else:
                    j += 1
            around = [d for d in declarations if d.kind == "CLASS" and d.first <= first <= d.last]
            name = s.at(j) if s.is_name(j) and s.at(j + 1) != "." else None
            if name in _WRAPPERS and s.at(j + 1) == "<":
                plain = [s.at(a) for a, b in s.split(j + 2, s.skip_angles(j + 1) - 1) if b - a == 1 and s.is_name(a)]
                name = plain[0] if plain else name
            if around and name and not name[0].islower():
                owner = max(around, key=lambda d: d.first)
                if name != owner.name:
                    out.append({"kind": "injects", "source_id": ids[owner.first], "target_name": name})
        return out
