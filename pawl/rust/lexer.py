"""Token trees of Rust source, and the lines that hold code."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

SPACE = b" \t\n\r\x0c"
#: What can change the state of code_lines inside code.
STOP = re.compile(rb"[\n/\"r']")


class Malformed(ValueError):
    """Source that cannot be read."""


@dataclass(slots=True)
class Token:
    """kind: ident, life, lit, punct or group. A group's text is its opening bracket."""

    kind: str
    text: str
    line: int
    last: int
    inner: list[Token] = field(default_factory=list)
    joint: bool = False  # a punct that the next punct touches

    def is_(self, *texts: str) -> bool:
        return self.kind in ("punct", "ident") and self.text in texts

    def group(self, bracket: str) -> bool:
        return self.kind == "group" and self.text == bracket


BLANKS = re.compile("[^\\S\n]+|\ufeff")
IDENT = re.compile(r"(?:r#)?[^\W\d]\w*")
NUMBER = re.compile(r"0[xob][0-9a-fA-F_]+\w*|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*")
RAW = re.compile(r"(?:b|c)?r(#*)\"")
QUOTED = re.compile(r"(?:b|c)?\"(?:[^\"\\]|\\.)*\"\w*", re.S)
CHAR = re.compile(r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'\w*", re.S)
LIFE = re.compile(r"'[^\W\d]\w*")
CLOSE = {"(": ")", "[": "]", "{": "}"}


def tokenize(source: str) -> list[Token]:
    """Token trees. Doc comments become ``#[doc = "..."]``, as the compiler has them."""
    stack: list[tuple[str, int, list[Token]]] = []
    here: list[Token] = []
    at, line, size = 0, 1, len(source)
    if source.startswith("#!") and not source.startswith("#!["):
        at = source.find("\n") if "\n" in source else size
    while at < size:
        c = source[at]
        if c == "\n":
            line += 1
            at += 1
            continue
        if c.isspace() or c == "﻿":
            at = BLANKS.match(source, at).end()
            continue
        if c == "/" and source.startswith("//", at):
            end = source.find("\n", at)
            end = size if end < 0 else end
            text = source[at:end]
            if text.startswith("//!") or (text.startswith("///") and not text.startswith("////")):
                here += doc(text[3:], line, line, text[2] == "!")
            at = end
            continue
        if c == "/" and source.startswith("/*", at):
            depth, end = 1, at + 2
            while depth:
                step = re.compile(r"/\*|\*/").search(source, end)
                if step is None:
                    raise Malformed("a comment does not end")
                depth += 1 if step[0] == "/*" else -1
                end = step.end()
            text = source[at:end]
            last = line + text.count("\n")
            if text.startswith("/*!") or (text.startswith("/**") and not text.startswith("/***") and text != "/**/"):
                here += doc(text[3:-2], line, last, text[2] == "!")
            line, at = last, end
            continue
        if c in CLOSE:
            stack.append((c, line, here))
            here = []
            at += 1
            continue
        if c in ")]}":
            if not stack or CLOSE[stack[-1][0]] != c:
                raise Malformed(f"line {line}: {c} closes nothing")
            bracket, first, outer = stack.pop()
            outer.append(Token("group", bracket, first, line, here))
            here = outer
            at += 1
            continue
        raw = RAW.match(source, at) if c in "bcr" else None
        if raw:
            mark = '"' + raw[1]
            end = source.find(mark, raw.end())
            if end < 0:
                raise Malformed("a raw string does not end")
            text = source[at : end + len(mark)]
        else:
            found = (QUOTED.match(source, at) or CHAR.match(source, at)) if c in "bc\"'" else None
            text = found[0] if found else ""
        if text:
            last = line + text.count("\n")
            here.append(Token("lit", text, line, last))
            line, at = last, at + len(text)
            continue
        found = LIFE.match(source, at) if c == "'" else None
        if found:
            here.append(Token("life", found[0], line, line))
            at = found.end()
            continue
        found = IDENT.match(source, at)
        if found:
            here.append(Token("ident", found[0], line, line))
            at = found.end()
            continue
        found = NUMBER.match(source, at) if c in "0123456789" else None
        if found:
            # a field of a tuple in a tuple: x.0.1
            text = found[0]
            if here and here[-1].is_(".") and "." in text and (len(here) < 2 or not here[-2].is_(".")):
                text = text.split(".")[0]
            here.append(Token("lit", text, line, line))
            at += len(text)
            continue
        joint = at + 1 < size and source[at + 1] in "!#$%&*+,-./:;<=>?@^|~"
        here.append(Token("punct", c, line, line, joint=joint))
        at += 1
    if stack:
        raise Malformed("a bracket does not close")
    return here


def doc(text: str, line: int, last: int, inner: bool) -> list[Token]:
    content = [Token("ident", "doc", line, line), Token("punct", "=", line, line), Token("lit", '"' + text + '"', line, last)]
    marks = [Token("punct", "#", line, line)] + ([Token("punct", "!", line, line)] if inner else [])
    return [*marks, Token("group", "[", line, last, content)]


def code_lines(source: str) -> list[int]:
    """Lines, from 1, that hold code and not only blanks or comments.

    Only the first line of a string over several lines counts, and a backslash at a line's end
    inside a string joins two lines into one.
    """
    data = source.encode()
    at, line, size = 0, 1, len(data)
    state, depth, marked = "code", 0, False
    found: list[int] = []
    while at < size:
        b = data[at]
        if b == 10:
            if marked:
                found.append(line)
            line, marked = line + 1, False
            if state == "line":
                state = "code"
            at += 1
        elif state == "code":
            pair = data[at : at + 2]
            if pair == b"//":
                state, at = "line", at + 2
            elif pair == b"/*":
                state, depth, at = "block", 1, at + 2
            elif b == 34:
                state, marked, at = "text", True, at + 1
            elif b == 114 and (raw := re.compile(rb'r(#*)"').match(data, at)):
                state, depth, marked, at = "raw", len(raw[1]), True, raw.end()
            elif b == 39 and (end := quoted_end(data, at)) is not None:
                marked, at = True, end + 1
            elif marked:
                stop = STOP.search(data, at + 1)
                at = stop.start() if stop else size
            else:
                marked = b not in SPACE
                at += 1
        elif state == "line":
            end = data.find(b"\n", at)
            at = size if end < 0 else end
        elif state == "block":
            pair = data[at : at + 2]
            if pair == b"/*":
                depth, at = depth + 1, at + 2
            elif pair == b"*/":
                depth, at = depth - 1, at + 2
                state = "block" if depth else "code"
            else:
                at += 1
        elif state == "text":
            state = "code" if b == 34 else state
            at += 2 if b == 92 else 1
        else:
            if b == 34 and data[at + 1 : at + 1 + depth] == b"#" * depth:
                state, at = "code", at + 1 + depth
            else:
                at += 1
    if marked:
        found.append(line)
    return found


def quoted_end(data: bytes, start: int) -> int | None:
    """The closing quote of a character literal, None for a lifetime."""
    at = start + 1
    if data[at : at + 1] == b"\\":
        at += 2
        while at < len(data) and data[at] != 39 and at - start < 12:
            at += 1
    else:
        at += 1
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
    return at if data[at : at + 1] == b"'" else None
