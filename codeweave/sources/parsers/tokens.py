"""Tokens of languages with braces, and the partner of each bracket."""

from __future__ import annotations

import re
from dataclasses import dataclass

_PATTERN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))
      | (?P<str>\"\"\".*?(?:\"\"\"|\Z)|@"(?:[^"]|"")*(?:"|\Z)|\$?"(?:\\.|[^"\\\n])*(?:"|$)|'(?:\\.|[^'\\\n])*(?:'|$))
      | (?P<num>\d[\w.]*)
      | (?P<id>[#@]?[^\W\d][\w$]*|\$[\w$]*)
      | (?P<op>=>|->|\?\.|\?\?|::|&&|\|\||[=!<>]=|\.\.\.|.)""",
    re.S | re.X | re.M,
)
#: After these a slash begins a regular expression in JavaScript.
_BEFORE_REGEX = {"(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "=>", "return", "typeof", "case", "in", "of", "??", "+", "-", "*", "%", "==", "!="}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_PAIRS = {")": "(", "]": "[", "}": "{"}


@dataclass
class Token:
    kind: str
    text: str
    line: int
    end_line: int


class Source:
    def __init__(self, text: str, script: bool = False, annotations: bool = False) -> None:
        self.text, self.lines = text, text.split("\n")
        self.tokens: list[Token] = []
        self._line, self._script, self._annotations = 1, script, annotations
        self._read(0, len(text))
        self.partner = self._match()

    def _add(self, kind: str, text: str) -> None:
        end = self._line + text.count("\n")
        self.tokens.append(Token(kind, text, self._line, end))
        self._line = end

    def _read(self, at: int, end: int, inside: bool = False) -> int:
        """Tokens up to `end`, or to the brace that ends a template's expression."""
        depth = 0
        while at < end:
            c = self.text[at]
            if self._script and c == "`":
                at = self._template(at, end)
                continue
            if self._script and c == "/" and (not self.tokens or self.tokens[-1].text in _BEFORE_REGEX) and (m := _REGEX.match(self.text, at)):
                self._add("str", m[0])
                at = m.end()
                continue
            if inside and c == "}" and depth == 0:
                return at
            m = _PATTERN.match(self.text, at)
            at = m.end()
            kind, text = m.lastgroup, m[0]
            if kind == "blank":
                self._line += text.count("\n")
            elif kind == "id" and text[0] == "@" and self._annotations:
                self._add("op", "@")
                self._add("id", text[1:])
            else:
                depth += (text == "{") - (text == "}") if inside else 0
                self._add(kind, text)
        return at

    def _template(self, at: int, end: int) -> int:
        """A template: its text is one string; expressions in it are read as code, in brackets of their own."""
        begin, at = at, at + 1
        while at < end and self.text[at] != "`":
            if self.text[at] == "\\":
                at += 2
            elif self.text.startswith("${", at):
                self._add("str", self.text[begin:at])
                self._add("op", "(")
                at = self._read(at + 2, end, inside=True)
                self._add("op", ")")
                begin, at = at + 1, at + 1
            else:
                at += 1
        self._add("str", self.text[begin : at + 1])
        return at + 1

    def _match(self) -> list[int]:
        partner, open_ = [-1] * len(self.tokens), []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in "([{" and len(t.text) == 1:
                open_.append(i)
            elif t.text in _PAIRS:
                while open_ and self.tokens[open_[-1]].text != _PAIRS[t.text]:
                    open_.pop()
                if open_:
                    partner[i] = open_.pop()
                    partner[partner[i]] = i
        return partner

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "id"

    def skip_angles(self, i: int) -> int:
        """The place after a list of type arguments that begins at i; i where none does."""
        if self.at(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.tokens):
            x = self.at(j)
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif x in ("(", "[", "{"):
                j = self.partner[j] if self.partner[j] > j else len(self.tokens)
            elif x in (";", "&&", "||", "=", ")", "}"):
                return i
            j += 1
        return i

    def back_over_angles(self, i: int) -> int:
        """The place of the `<` whose list ends at i; i where none does."""
        depth, j = 0, i
        while j >= 0:
            x = self.at(j)
            depth += (x == ">") - (x == "<")
            if depth == 0:
                return j
            if x in (";", "{", "}", "="):
                return i
            j -= 1
        return i

    def chain_start(self, i: int) -> int:
        """Where the dotted expression that ends at name i begins: a.b(c).d is one."""
        j = i
        while self.at(j - 1) in (".", "?.") and j >= 2:
            j -= 2
            while self.at(j) in (")", "]") and self.partner[j] >= 0:
                j = self.partner[j] - 1
            if j < 0 or not (self.is_name(j) or self.tokens[j].kind == "str"):
                return j + 1
        return j

    def line_of_call(self, i: int) -> int:
        return max(0, self.chain_start(i))

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Spans between commas from a to b, brackets and type arguments kept whole."""
        out, start, j = [], a, a
        while j < b:
            x = self.at(j)
            if x in ("(", "[", "{") and self.partner[j] > j:
                j = self.partner[j]
            elif x == "<" and self.skip_angles(j) > j:
                j = self.skip_angles(j) - 1
            elif x == ",":
                out.append((start, j))
                start = j + 1
            j += 1
        return [*out, (start, b)] if start < b else out
