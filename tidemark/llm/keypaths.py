"""Configuration formats within any text as key paths with offsets: YAML, JSON and its likes, INI, TOML and XML.

Readers are tolerant: they start wherever something of their format stands, keep what they have read when it ends or
breaks off, and go over a text once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

NAMES = frozenset(("name", "key", "id", "variable", "var", "field", "parameter", "parametername", "parameterkey", "env_name", "property"))
VALUES = frozenset(("value", "val", "default", "plaintext", "parametervalue", "stringvalue", "secretstring"))
DEEPEST = 15  # keys kept of a longer path, the innermost


class Pair(NamedTuple):
    """path: keys from the outermost in; start, end: the value within the text, quotes included; named: the key is what a
    sibling or attribute beside the value says; line: key and value fill a line, as in YAML and dotenv files."""

    path: tuple[str, ...]
    start: int
    end: int
    named: bool = False
    line: bool = False


class _Level:
    """One mapping being read: its path, the key last seen, and the members met so far."""

    __slots__ = ("path", "indent", "key", "members", "close")

    def __init__(self, path: tuple[str, ...], indent: int = -1, close: str = "") -> None:
        self.path, self.indent, self.key, self.members, self.close = path, indent, None, {}, close

    def below(self) -> tuple[str, ...]:
        return self.path if self.key is None else (*self.path[-DEEPEST:], self.key)

    def siblings(self, text: str) -> Iterator[Pair]:
        """The value under the name that stands beside it."""
        name = next((s for k, s in self.members.items() if k in NAMES), None)
        if name:
            said = text[slice(*name)].strip("\"'")
            for k, span in self.members.items():
                if k in VALUES and said:
                    yield Pair((*self.path, said), *span, True)


# ---- YAML -----------------------------------------------------------------------------------------------------------
LINE = re.compile(r"[^\n]+")
_YAML = re.compile(r"(?P<in>[ ]*(?:-[ ]+)*)(?P<k>\"[^\"]*\"|'[^']*'|[\w./-]+)[ ]*:(?:[ ]+(?P<v>\S.*))?$")
_SCALAR = re.compile(r"(?P<in>[ ]*(?:-[ ]+)*)(?P<v>\"[^\"]*\"|'[^']*'|[^\s\"'#-]\S*)$")
_BLOCK = re.compile(r"[|>][-+\d]{0,2}(?:\s+#.*)?$")


def _yaml(text: str) -> Iterator[Pair]:
    stack = [_Level(())]
    waits = None  # indent of a key that has no value on its line
    block: tuple[int, tuple[str, ...], str] | None = None
    start = end = -1

    def lines() -> Iterator[tuple[int, str]]:
        for m in LINE.finditer(text):
            yield m.start(), m[0].rstrip()
        yield len(text), ""

    for at, line in lines():
        indent = len(line) - len(line.lstrip(" "))
        if block is not None:
            if line and (indent > block[0] or not line.strip()):
                if line.strip():
                    start, end = (at + indent if start < 0 else start), at + len(line)
                continue
            if start >= 0:
                yield Pair(block[1], start, end)
                stack[-1].members[block[2]] = (start, end)
            block, start = None, -1
        if not line.strip():
            continue
        m = _YAML.match(line)
        if m is None:
            s = _SCALAR.match(line) if waits is not None else None
            item = s is not None and "-" in s["in"]
            if s is not None and (indent > waits or item and indent == waits):
                yield Pair(stack[-1].below(), at + s.start("v"), at + s.end("v"))
            if not item:
                waits = None
            continue
        deep, dash = len(m["in"]), "-" in m["in"]
        while len(stack) > 1 and (stack[-1].indent > deep or dash and stack[-1].indent == deep):
            yield from stack.pop().siblings(text)
        if stack[-1].indent < deep:
            stack.append(_Level(stack[-1].below(), deep))
        level, waits = stack[-1], None
        level.key = m["k"].strip("\"'")
        if m["v"] is None:
            waits = deep
        elif _BLOCK.match(m["v"]):
            block = (deep, level.below(), level.key.lower())
        else:
            v = m["v"] if m["v"][0] in "\"'" else m["v"].split(" #")[0].rstrip()
            level.members[level.key.lower()] = span = (at + m.start("v"), at + m.start("v") + len(v))
            yield Pair(level.below(), *span, False, True)
    for level in reversed(stack):
        yield from level.siblings(text)


# ---- JSON, flow mappings, inline tables, literals ---------------------------------------------------------------------
_TOKEN = re.compile(r"\s*(?:(?P<s>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(?P<p>[{}\[\],])|(?P<e>=>|[:=])|(?P<w>[^\s{}\[\],:=\"']+(?:=+(?=[\s,}\]]))?))")


def _json(text: str) -> Iterator[Pair]:
    at = text.find("{")
    while at >= 0:
        stack = [_Level(())]
        last: tuple[int, int] | None = None
        value = False  # a value is due
        while (m := _TOKEN.match(text, at)) is not None:
            at, p = m.end(), m["p"]
            level = stack[-1]
            if p and p in "{[":
                stack.append(_Level(level.below() if value else level.path, close="}" if p == "{" else "]"))
                last, value = None, False
            elif p == ",":
                last, value = None, False
                if level.close == "}":
                    level.key = None
            elif p:
                if level.close != p:
                    break
                yield from stack.pop().siblings(text)
                last, value = None, False
                if len(stack) == 1:
                    break
            elif m["e"]:
                if last is None or level.close != "}":
                    last = None
                    continue
                level.key, value, last = text[slice(*last)].strip("\"'"), True, None
            else:
                last = m.span("s" if m["s"] else "w")
                if value:
                    level.members.setdefault(level.key.lower(), last)
                    yield Pair(level.below(), *last)
                    value, last = False, None
                elif level.close == "]" and level.path:
                    yield Pair(level.path, *last)
        for level in reversed(stack):
            yield from level.siblings(text)
        at = text.find("{", at)


# ---- INI, TOML, dotenv, properties ------------------------------------------------------------------------------------------------------
_INI = re.compile(r"^[ \t]*(?:\[{1,2}(?P<t>[^\[\]\n]+)\]{1,2}[ \t]*(?:[#;].*)?$|(?:export[ \t]+)?(?P<k>[\w.\"'-]+)(?P<o>[ \t]*=[ \t]*)(?P<v>\"[^\"\n]*\"|'[^'\n]*'|[^\s#;]+))", re.M)


def _ini(text: str) -> Iterator[Pair]:
    level = _Level(())
    for m in _INI.finditer(text):
        if m["t"]:
            yield from level.siblings(text)
            level = _Level(tuple(x.strip(" \"'") for x in re.split(r"[.:/ ]", m["t"]) if x.strip(" \"'")))
        else:
            level.key = m["k"].strip("\"'")
            level.members[level.key.lower()] = m.span("v")
            alone = text[m.end() : m.end() + 1] in ("", "\n", "\r")
            if level.path or alone:
                yield Pair(level.below(), *m.span("v"), False, alone and m["o"] == "=")
    yield from level.siblings(text)


# ---- XML ------------------------------------------------------------------------------------------------------------
_TAG = re.compile(r"<(?P<c>/?)(?P<t>[A-Za-z][\w.:-]*)(?P<a>[^<>]*)>(?P<x>[^<]*)")
_ATTRIBUTE = re.compile(r"([\w.:-]+)[ \t]*=[ \t]*(\"[^\"]*\"|'[^']*')")


def _xml(text: str) -> Iterator[Pair]:
    stack = [_Level(())]
    for m in _TAG.finditer(text):
        tag = m["t"]
        if m["c"]:
            if any(x.close == tag for x in stack[-8:]):
                while stack[-1].close != tag:
                    yield from stack.pop().siblings(text)
                yield from stack.pop().siblings(text)
            continue
        level = _Level((*stack[-1].path[-DEEPEST:], tag), close=tag)
        for a in _ATTRIBUTE.finditer(text, m.start("a"), m.end("a")):
            level.members[a[1].lower()] = a.span(2)
        said = next((text[slice(*s)].strip("\"'") for k, s in level.members.items() if k in NAMES), None)
        x = m["x"].strip()
        if m["a"].endswith("/"):
            yield from level.siblings(text)
            continue
        if x:
            s = m.start("x") + m["x"].index(x)
            stack[-1].members.setdefault(tag.lower(), (s, s + len(x)))
            yield Pair(level.path, s, s + len(x))
        if said:  # what stands below a named element has its name in the path
            yield from level.siblings(text)
            level = _Level((*level.path, said), close=tag)
        stack.append(level)
    for level in reversed(stack):
        yield from level.siblings(text)


def pairs(text: str) -> Iterator[Pair]:
    """Every key path of the text with its value's offsets, format by format; a value may come more than once."""
    if ":" in text:
        yield from _yaml(text)
    if "{" in text:
        yield from _json(text)
    if "=" in text:
        yield from _ini(text)
    if "</" in text or "/>" in text:
        yield from _xml(text)
