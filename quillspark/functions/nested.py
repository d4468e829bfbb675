"""Frontmatter of any depth: maps, lists, block and flow values, by the indentation of lines.

A small reader, not all of YAML: anchors, tags, several documents and keys that aren't text make a block unreadable.
"""

from __future__ import annotations

import json
import math
import re

_KEY = re.compile(r"""(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([A-Za-z_][\w .\-/]*?))\s*:(?:\s+(.*))?$""")
_ITEM_KEY = re.compile(r"""(?:"(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[A-Za-z_][\w-]*):(?:\s|$)""")
_BLOCK = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)\s*(?:#.*)?$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}


class Unreadable(ValueError):
    """Not in the form that this reader knows."""


def _quoted(raw: str) -> str:
    if raw[0] == "'":
        return raw[1:-1].replace("''", "'")
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), raw[1:-1])


def _plain(raw: str):
    """A scalar without quotes: a number, true, false, null or text."""
    raw = raw.strip()
    if raw in ("", "~", "null"):
        return None
    if raw in ("true", "false"):
        return raw == "true"
    if raw[0] in "&*!%@`":
        raise Unreadable(raw)
    for kind in (int, float):
        try:
            found = kind(raw)
            return found if math.isfinite(found) and "_" not in raw else raw
        except ValueError:
            continue
    return raw


def _bare(raw: str) -> str:
    """Without a comment at the end."""
    return re.split(r"(?:^|\s)#", raw, maxsplit=1)[0].strip()


class _Flow:
    """[a, {b: c}] in one line."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def whole(self):
        found = self.value()
        if _bare(self.text[self.at :]):
            raise Unreadable(self.text)
        return found

    def _skip(self) -> str:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at : self.at + 1]

    def value(self):
        c = self._skip()
        if c == "[":
            return self._many("]", lambda: self.value())
        if c == "{":
            found = {}
            for k, v in self._many("}", self._pair):
                if k in found:
                    raise Unreadable(self.text)
                found[k] = v
            return found
        if c and c in "\"'":
            m = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\']|\'\')*\'').match(self.text, self.at)
            if not m:
                raise Unreadable(self.text)
            self.at = m.end()
            return _quoted(m[0])
        m = re.compile(r"(?:[^,\[\]{}:]|:(?!\s))*").match(self.text, self.at)
        self.at = m.end()
        return _plain(m[0])

    def _pair(self):
        key = self.value()
        if not isinstance(key, str) or self._skip() != ":":
            raise Unreadable(self.text)
        self.at += 1
        return key, self.value()

    def _many(self, end: str, one):
        self.at += 1
        found = []
        while True:
            if self._skip() == end:
                self.at += 1
                return found
            found.append(one())
            c = self._skip()
            if c == ",":
                self.at += 1
            elif c != end:
                raise Unreadable(self.text)


class _Reader:
    def __init__(self, lines: list[str]):
        self.raw, self.at = lines, 0
        if any(re.match(r" *\t", x) and x.strip() for x in lines):
            raise Unreadable("a tab before a value")
        #: a line's text in place of its own, where an item's map begins in the middle of a line
        self.instead: dict[int, str] = {}

    def _line(self, n: int) -> str:
        return self.instead.get(n, self.raw[n])

    def peek(self) -> tuple[int, str] | None:
        """(indentation, text) of the next line that isn't blank or a comment."""
        while self.at < len(self.raw):
            line = self._line(self.at)
            if line.strip() and not line.lstrip().startswith("#"):
                return len(line) - len(line.lstrip(" ")), line.strip()
            self.at += 1
        return None

    def node(self, indent: int):
        _, text = self.peek()
        return self.items(indent) if text == "-" or text.startswith("- ") else self.map(indent)

    def map(self, indent: int) -> dict:
        found: dict = {}
        while (here := self.peek()) is not None and here[0] >= indent:
            m = _KEY.match(here[1])
            if here[0] > indent or not m:
                raise Unreadable(here[1])
            key = _quoted(f'"{m[1]}"') if m[1] is not None else m[2].replace("''", "'") if m[2] is not None else m[3]
            if key in found:
                raise Unreadable(f"{key} twice")
            self.at += 1
            found[key] = self.after((m[4] or "").strip(), indent, True)
        return found

    def items(self, indent: int) -> list:
        found = []
        while (here := self.peek()) is not None and here[0] == indent and (here[1] == "-" or here[1].startswith("- ")):
            rest = here[1][1:].strip()
            if _ITEM_KEY.match(rest):
                inner = indent + len(here[1]) - len(here[1][1:].lstrip())
                self.instead[self.at] = " " * inner + rest
                found.append(self.map(inner))
            elif rest == "-" or rest.startswith("- "):
                inner = indent + len(here[1]) - len(here[1][1:].lstrip())
                self.instead[self.at] = " " * inner + rest
                found.append(self.items(inner))
            else:
                self.at += 1
                found.append(self.after(rest, indent, False))
        if here is not None and here[0] > indent:
            raise Unreadable(here[1])
        return found

    def after(self, rest: str, indent: int, in_map: bool):
        """The value that begins with `rest`, on the line of its key or item, or on the lines below."""
        block = _BLOCK.match(rest)
        if block:
            return self.block(block[1], block[2] or block[4], int(block[3] or 0), indent)
        if not _bare(rest):
            here = self.peek()
            if here is not None and (here[0] > indent or in_map and here[0] == indent and (here[1] == "-" or here[1].startswith("- "))):
                return self.node(here[0])
            return None
        if rest[0] in "[{":
            return _Flow(rest).whole()
        if rest[0] in "\"'":
            return _Flow(rest).whole()
        if rest[0] in "&*!%@`":
            raise Unreadable(rest)
        text = _bare(rest)
        # a plain value may go on, on lines that lie deeper
        while (here := self.peek()) is not None and here[0] > indent and not _KEY.match(here[1]):
            text += " " + _bare(here[1])
            self.at += 1
        return _plain(text)

    def block(self, kind: str, chomp: str, deep: int, indent: int) -> str:
        lines: list[str] = []
        inner = indent + deep if deep else None
        while self.at < len(self.raw):
            line = self.raw[self.at]
            own = len(line) - len(line.lstrip(" "))
            if line.strip() and (own <= indent if inner is None else own < inner):
                break
            if line.strip() and inner is None:
                inner = own
            lines.append(line[inner:] if inner is not None and line.strip() else "")
            self.at += 1
        more = len(lines)
        while lines and not lines[-1]:
            lines.pop()
        more -= len(lines)
        if kind == "|":
            text = "\n".join(lines)
        else:
            text = re.sub(r"(?<!\n)\n(?!\n|\s)|(\n+)\n", lambda m: m[1] or " ", "\n".join(lines)) if lines else ""
        return text + ("" if chomp == "-" or not text else "\n" * (1 + more) if chomp == "+" else "\n")


def tree(lines: list[str]) -> dict:
    """The map that lines of frontmatter, without their fences, are."""
    reader = _Reader(lines)
    here = reader.peek()
    if here is None:
        return {}
    found = reader.map(here[0])
    if reader.peek() is not None:
        raise Unreadable(reader.peek()[1])
    return found


def as_json(found: dict) -> str:
    return json.dumps(found, ensure_ascii=False)
