"""A reader of the YAML that models write: block and flow collections, plain,
quoted and block scalars, comments. Anchors, aliases, tags, complex keys and
several documents are errors (ValueError), as is what YAML itself rejects."""

from __future__ import annotations

import re
from typing import Any

_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'\[\]{},#&*!|>%@`?-](?:[^:#]|:(?=\S)|(?<=\S)\#)*?|[?-](?=[^\s:])(?:[^:#]|:(?=\S)|(?<=\S)\#)*?)\s*:(?=\s|$)""")
_BLOCK = re.compile(r"([|>])([+-]?)([1-9]?)([+-]?)\s*(?:#.*)?$")
_ESCAPES = {"0": "\0", "a": "\a", "b": "\b", "t": "\t", "n": "\n", "v": "\v", "f": "\f", "r": "\r", "e": "\x1b", " ": " ", '"': '"', "/": "/", "\\": "\\", "N": "\x85", "_": "\xa0", "L": "\u2028", "P": "\u2029"}
_INT = re.compile(r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?")
_SPECIAL = {"": None, "~": None, "null": None, "Null": None, "NULL": None, "true": True, "True": True, "TRUE": True, "false": False, "False": False, "FALSE": False}
_ODD = re.compile(r"([-+]?)\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN)")


def resolve(plain: str) -> Any:
    """The value of a plain scalar under the core schema."""
    if plain in _SPECIAL:
        return _SPECIAL[plain]
    if _INT.fullmatch(plain):
        return int(plain[2:], 8) if plain.startswith("0o") else int(plain[2:], 16) if plain.startswith("0x") else int(plain)
    if _FLOAT.fullmatch(plain):
        return float(plain)
    if m := _ODD.fullmatch(plain):
        return float(f"{m[1]}inf") if m[1] is not None else float("nan")
    return plain


def _folded(lines: list[str]) -> str:
    """Lines of a plain or quoted scalar: a break is a space, an empty line a break."""
    out = lines[0].rstrip() if len(lines) > 1 else lines[0]
    breaks = 0
    for i, line in enumerate(lines[1:], 2):
        part = line.lstrip() if i == len(lines) else line.strip()
        if part == "" and i < len(lines):
            breaks += 1
            continue
        out += ("\n" * breaks or " ") + part
        breaks = 0
    return out


def _unquoted(raw: str) -> str:
    inside = _folded(raw[1:-1].split("\n"))
    if raw[0] == "'":
        return inside.replace("''", "'")

    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1][1:], 16))
        if m[2] not in _ESCAPES:
            raise ValueError(f"unknown escape \\{m[2]}")
        return _ESCAPES[m[2]]

    return re.sub(r"\\(?:(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8})|(.))", one, inside, flags=re.S)


def _quoted_end(text: str, at: int) -> int:
    """Where the quoted scalar that starts at ``at`` ends; -1 if it is not closed."""
    m = re.compile(r'"(?:[^"\\]|\\.)*"' if text[at] == '"' else r"'(?:[^']|'')*'(?!')", re.S).match(text, at)
    return m.end() if m else -1


class _Flow:
    """[...] and {...} in a string."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> None:
        while m := re.compile(r"\s+|(?:(?<=\s)|^)#[^\n]*").match(self.text, self.at):
            self.at = m.end()

    def value(self) -> Any:
        self.space()
        c = self.text[self.at : self.at + 1]
        if c and c in "[{":
            return self.several(c)
        if c and c in "\"'":
            end = _quoted_end(self.text, self.at)
            if end < 0:
                raise EOFError
            raw, self.at = self.text[self.at : end], end
            return _unquoted(raw)
        m = re.compile(r"(?:[^\s,\[\]{}:#&*!|>%@`]|:(?=[^\s,\[\]{}]))(?:[^,\[\]{}:#]|:(?=[^\s,\[\]{}])|(?<=\S)#)*").match(self.text, self.at)
        if not m:
            if not c:
                raise EOFError
            if c in ",]}:":
                return None
            raise ValueError(f"unexpected {c!r}")
        self.at = m.end()
        return resolve(_folded(m[0].strip().split("\n")))

    def several(self, opening: str) -> Any:
        self.at += 1
        out: Any = [] if opening == "[" else {}
        while True:
            self.space()
            c = self.text[self.at : self.at + 1]
            if not c:
                raise EOFError
            if c == ("]" if opening == "[" else "}"):
                self.at += 1
                return out
            key = self.value()
            self.space()
            pair = self.text[self.at : self.at + 1] == ":"
            if pair:
                self.at += 1
                value = self.value()
                self.space()
            if opening == "{":
                out[key if not isinstance(key, (list, dict)) else str(key)] = value if pair else None
            else:
                out.append({key: value} if pair else key)
            c = self.text[self.at : self.at + 1]
            if not c:
                raise EOFError
            if c == ",":
                self.at += 1
            elif c != ("]" if opening == "[" else "}"):
                raise ValueError(f"unexpected {c!r}")


class _Blocks:
    def __init__(self, text: str):
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.i = 0

    def peek(self) -> tuple[int, str] | None:
        """Indent and content of the next line that has any."""
        while self.i < len(self.lines):
            line = self.lines[self.i]
            content = line.lstrip(" ")
            if content.strip() and not content.startswith("#"):
                if content.startswith("\t"):
                    raise ValueError("a tab indents a line")
                return len(line) - len(content), content.rstrip()
            self.i += 1
        return None

    def node(self, least: int) -> Any:
        found = self.peek()
        if found is None or found[0] < least:
            return None
        indent, content = found
        if re.match(r"-(?:\s|$)", content):
            return self.sequence(indent)
        if _KEY.match(content):
            return self.mapping(indent)
        self.lines[self.i] = ""
        return self.scalar(content, least - 1)

    def sequence(self, indent: int) -> list:
        out = []
        while (found := self.peek()) and found[0] == indent and re.match(r"-(?:\s|$)", found[1]):
            rest = found[1][1:].lstrip(" ")
            if not rest or rest.startswith("#"):
                self.i += 1
                out.append(self.node(indent + 1))
            elif m := _BLOCK.match(rest):
                self.i += 1
                out.append(self.block(m, indent))
            else:
                self.lines[self.i] = " " * (indent + len(found[1]) - len(rest)) + rest
                out.append(self.node(indent + 1))
        return out

    def mapping(self, indent: int) -> dict:
        out: dict = {}
        while (found := self.peek()) and found[0] == indent and (m := _KEY.match(found[1])):
            key = _unquoted(m[1]) if m[1][0] in "\"'" else resolve(m[1].strip())
            rest = found[1][m.end() :].strip()
            if not rest or rest.startswith("#"):
                self.i += 1
                below = self.peek()
                level = below is not None and below[0] == indent and re.match(r"-(?:\s|$)", below[1])
                out[key] = self.sequence(indent) if level else self.node(indent + 1)
            elif b := _BLOCK.match(rest):
                self.i += 1
                out[key] = self.block(b, indent)
            else:
                out[key] = self.scalar(rest, indent)
        if (found := self.peek()) and found[0] >= indent and found[0] > 0:
            if found[0] > indent or not re.match(r"-(?:\s|$)", found[1]):
                raise ValueError(f"a line does not fit its map: {found[1][:40]}")
        return out

    def scalar(self, first: str, indent: int) -> Any:
        """A value that begins with ``first`` on the current line; lines below
        that are indented further than ``indent`` may go on with it."""
        self.i += 1
        if first[0] in "\"'[{":
            text = first
            while True:
                try:
                    if first[0] in "\"'":
                        end = _quoted_end(text, 0)
                        if end < 0:
                            raise EOFError
                        value = _unquoted(text[:end])
                    else:
                        flow = _Flow(text)
                        value, end = flow.value(), flow.at
                    break
                except EOFError:
                    if self.i >= len(self.lines):
                        raise ValueError("a value is not closed") from None
                    text += "\n" + self.lines[self.i]
                    self.i += 1
            if not re.fullmatch(r"\s*(?:\s#.*)?", text[end:]):
                raise ValueError(f"text after a value: {text[end:][:40]}")
            return value
        if first[0] in "&*!%@`|>,]}" or re.match(r"[?:](?:\s|$)", first):
            raise ValueError(f"a value cannot begin like this: {first[:40]}")
        lines, closed = [], False
        part = first
        while True:
            cut = re.search(r"\s#", part)
            closed = cut is not None
            part = part[: cut.start()] if cut else part
            if re.search(r":(?:\s|$)", part):
                raise ValueError(f"a map within a value: {part[:40]}")
            lines.append(part.strip())
            blank = 0
            while self.i + blank < len(self.lines) and not self.lines[self.i + blank].strip():
                blank += 1
            at = self.i + blank
            if closed or at >= len(self.lines):
                break
            line = self.lines[at]
            if len(line) - len(line.lstrip(" ")) <= indent or line.lstrip().startswith("#"):
                break
            lines += [""] * blank
            part = line.strip()
            self.i = at + 1
        return resolve(_folded(lines))

    def block(self, m: re.Match, indent: int) -> str:
        """A literal (|) or folded (>) scalar below its head."""
        chomp = m[2] or m[4]
        body: list[str] = []
        width = indent + int(m[3]) if m[3] else None
        while self.i < len(self.lines):
            line = self.lines[self.i]
            if line.strip():
                here = len(line) - len(line.lstrip(" "))
                if width is None:
                    width = here
                if here < width or here <= indent:
                    break
            body.append(line[width:] if width is not None else "")
            self.i += 1
        end = len(body)
        while end and not body[end - 1].strip():
            end -= 1
        text = body[:end]
        if m[1] == "|":
            out = "\n".join(text)
        else:
            out, breaks = "", 0
            for i, line in enumerate(text):
                if not line:
                    breaks += 1
                    continue
                more = line[0] in " \t" or (i - breaks > 0 and text[i - breaks - 1][:1] in (" ", "\t"))
                out += ("\n" * (breaks + 1) if more else "\n" * breaks or " ") + line if out else "\n" * breaks + line
                breaks = 0
        if not text:
            return "\n" * len(body) if chomp == "+" else ""
        return out + ("" if chomp == "-" else "\n" + "\n" * (len(body) - end if chomp == "+" else 0))


def load(text: str) -> Any:
    """The value of a YAML document."""
    reader = _Blocks(text)
    found = reader.peek()
    if found and found[0] == 0 and re.match(r"---(?:\s|$)", found[1]):
        reader.lines[reader.i] = "   " + found[1][3:]
    value = reader.node(0)
    found = reader.peek()
    if found and not (found[0] == 0 and found[1] == "..."):
        raise ValueError(f"a line is left over: {found[1][:40]}")
    return value
