"""PDF syntax to Python values, by regular expressions over the bytes.

Names become Name, references Ref, strings bytes, dictionaries dict (a later key wins), arrays list,
anything else that is a word Word. Content streams have tokens of their own: brackets other than
those of arrays and strings are operators there, and references do not exist.
"""

from __future__ import annotations

import re
from typing import Any, NamedTuple

from .limits import Budget, limit

SPACE = rb"\x00\t\n\x0c\r "
REGULAR = rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]"
BLANK = re.compile(rb"(?:[" + SPACE + rb"]+|%[^\r\n]*)*")
BLANK_STARTS = frozenset((b"\x00", b"\t", b"\n", b"\x0c", b"\r", b" ", b"%"))
NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d*)(?:[eE][+-]?\d+)?")
NUMBER_START = re.compile(rb"[+-]?[\d.]")
REFERENCE = re.compile(rb"(\d+)[" + SPACE + rb"]+(\d+)[" + SPACE + rb"]+R\b")
NAME = re.compile(rb"/(" + REGULAR + rb"*)")
WORD = re.compile(REGULAR + rb"+")
OCTAL = re.compile(rb"[0-7]{1,3}")
RUN = re.compile(rb"[^()\\]+")
PLAIN = re.compile(rb"([^()\\]*+)\)")
END_OF_TOKEN = re.compile(rb"(?=[\x00\t\n\x0c\r ()<>\[\]{}/%])|\Z")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name without its slash, its #xx escapes undone (bytes read as Latin-1)."""

    __slots__ = ()


class Word(bytes):
    """A bare word: an operator, or something that is no value."""

    __slots__ = ()


class Ref(NamedTuple):
    id: int
    generation: int


class Nothing:
    """What stands where no value could be read."""


NOTHING = Nothing()
CONSTANTS: dict[bytes, Any] = {b"true": True, b"false": False, b"null": None}


def ends(data: bytes, at: int) -> bool:
    """Whether a token ends before `at`."""
    return END_OF_TOKEN.match(data, at) is not None


def name_of(raw: bytes) -> Name:
    if b"#" in raw:
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
    return Name(raw.decode("latin-1"))


def number_of(raw: bytes) -> int | float:
    try:
        return int(raw)
    except ValueError:
        try:
            return float(raw)
        except ValueError:
            return 0.0


class Lexer:
    def __init__(self, data: bytes, budget: Budget, at: int = 0):
        self.data, self.budget, self.at = data, budget, at

    def blank(self) -> None:
        if self.data[self.at : self.at + 1] in BLANK_STARTS:
            self.at = BLANK.match(self.data, self.at).end()

    def string(self) -> bytes:
        """From an opening parenthesis; one that never closes takes the rest."""
        data, at, depth, parts, size = self.data, self.at + 1, 1, [], 0
        most = self.budget.options.maxStreamBytes
        if (m := PLAIN.match(data, at)) and m.end() - at <= most:
            self.at = m.end()
            return m[1]
        while at < len(data):
            if run := RUN.match(data, at):
                parts.append(run[0])
                size += len(run[0])
                if size > most:
                    raise limit("String token exceeds maxStreamBytes.")
                at = run.end()
                continue
            c = data[at : at + 1]
            at += 1
            if c == b"\\":
                c = data[at : at + 1]
                at += 1
                if c in ESCAPES:
                    parts.append(ESCAPES[c])
                elif octal := OCTAL.match(data, at - 1):
                    at = octal.end()
                    parts.append(bytes([int(octal[0], 8) & 0xFF]))
                elif c == b"\r":
                    at += data[at : at + 1] == b"\n"
                elif c != b"\n":
                    parts.append(c)
            else:
                depth += 1 if c == b"(" else -1
                if not depth:
                    break
                parts.append(c)
        self.at = at
        return b"".join(parts)

    def hex_string(self) -> bytes:
        """From an opening bracket. A digit short: padded by 0; something else inside: empty."""
        end = self.data.find(b">", self.at)
        end = len(self.data) if end < 0 else end
        raw = bytes(self.data[self.at + 1 : end]).translate(None, b"\x00\t\n\x0c\r ")
        self.at = end + 1
        if len(raw) > 2 * self.budget.options.maxStreamBytes:
            raise limit("String token exceeds maxStreamBytes.")
        try:
            return bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode("ascii"))
        except ValueError:
            return b""

    def value(self, depth: int = 0) -> Any:
        """The value at the cursor; NOTHING at the end or before a closing bracket."""
        self.blank()
        data, at = self.data, self.at
        c = data[at : at + 1]
        if not c:
            return NOTHING
        if c == b"/":
            m = NAME.match(data, at)
            self.at = m.end()
            return name_of(m[1])
        if c == b"(":
            return self.string()
        if c == b"<":
            return self.dictionary(depth) if data[at + 1 : at + 2] == b"<" else self.hex_string()
        if c == b"[":
            return self.array(depth)
        if c in b"])>}":
            return NOTHING
        if c == b"{":
            self.at += 1
            return Word(c)
        if m := REFERENCE.match(data, at):
            self.at = m.end()
            return Ref(int(m[1]), int(m[2]))
        if NUMBER_START.match(data, at):
            m = NUMBER.match(data, at)
            self.at = m.end()
            return number_of(m[0])
        m = WORD.match(data, at)
        self.at = m.end()
        return CONSTANTS.get(m[0], Word(m[0]))

    def _deep(self, depth: int) -> None:
        if depth > self.budget.options.maxRecursionDepth:
            raise limit("Dictionary/array nesting exceeds maxRecursionDepth.")

    def array(self, depth: int = 0) -> list:
        self._deep(depth)
        self.at += 1
        out: list = []
        while True:
            self.blank()
            c = self.data[self.at : self.at + 1]
            if c == b"]" or not c:
                self.at += 1
                return out
            item = self.value(depth + 1)
            if item is NOTHING:
                self.at += 1
                continue
            out.append(item)
            if len(out) > self.budget.options.maxArrayElements:
                raise limit("PDF array exceeds maxArrayElements.")

    def dictionary(self, depth: int = 0) -> dict[str, Any]:
        self._deep(depth)
        self.at += 2
        out: dict[str, Any] = {}
        seen = 0
        while True:
            self.blank()
            two = self.data[self.at : self.at + 2]
            if two == b">>" or not two:
                self.at += 2
                return out
            if two[:1] != b"/":
                if self.value(depth + 1) is NOTHING:
                    self.at += 1
                continue
            key = self.value()
            self.blank()
            if self.data[self.at : self.at + 2] == b">>":
                continue
            seen += 1
            if seen > self.budget.options.maxArrayElements:
                raise limit("Dictionary exceeds maxArrayElements.")
            item = self.value(depth + 1)
            if item is not NOTHING:
                out[key] = item


STRING, NAME_TOKEN, NUMBER_TOKEN, ARRAY, OPERATOR = range(5)


#: Blanks, then a number, a name, a word or one character of another token.
TOKEN = re.compile(
    rb"(?:[" + SPACE + rb"]++|%[^\r\n]*+)*+(?:([+-]?(?:\d+\.?\d*|\.\d*)(?:[eE][+-]?\d+)?)|/(" + REGULAR + rb"*)|(" + REGULAR + rb"+)|(.))", re.DOTALL
)


#: What arrays hold most: blanks, then a string without brackets or escapes, or a number.
ITEM = re.compile(rb"(?:[" + SPACE + rb"]++|%[^\r\n]*+)*+(?:\(([^()\\]*+)\)|([+-]?(?:\d+\.?\d*|\.\d*)(?:[eE][+-]?\d+)?))")


class ContentLexer(Lexer):
    """(kind, value) tokens of a content stream."""

    def __init__(self, data: bytes, budget: Budget, at: int = 0):
        super().__init__(data, budget, at)
        self.counts, self.most, self.room = budget.counts, budget.options.maxContentTokens, budget.options.maxOperandBytes

    def token(self) -> tuple[int, Any] | None:
        data, budget = self.data, self.budget
        m = TOKEN.match(data, self.at)
        if m is None:
            self.at = len(data)
            return None
        counts = self.counts
        counts["content_tokens"] += 1
        if counts["content_tokens"] > self.most:
            raise limit("Content tokens exceed maxContentTokens.")
        budget.operand_bytes += 512
        if budget.operand_bytes > self.room:
            budget.operands(0)
        kind = m.lastindex
        if kind == 3:
            self.at = m.end()
            return OPERATOR, m[3]
        if kind == 1:
            self.at = m.end()
            return NUMBER_TOKEN, number_of(m[1])
        if kind == 2:
            self.at = m.end()
            return NAME_TOKEN, self._charged(name_of(m[2]))
        c, self.at = m[4], m.start(4)
        if c == b"(":
            return STRING, self._charged(self.string())
        if c == b"<":
            if data[self.at + 1 : self.at + 2] == b"<":
                self.at += 2
                return OPERATOR, b"<<"
            return STRING, self._charged(self.hex_string())
        if c == b"[":
            return ARRAY, self._items()
        at = self.at
        self.at += 2 if data[at : at + 2] == b">>" else 1
        return OPERATOR, data[at : self.at]

    def _charged(self, value: Any) -> Any:
        self.budget.operands(2 * len(value))
        return value

    def _items(self) -> list[tuple[int, Any]]:
        """An array's tokens; nested arrays count towards the same limit. Iterative, so depth is bounded by the option alone."""
        options = self.budget.options
        self.at += 1
        stack: list[list] = [[]]
        total = 0
        data, counts, budget, most = self.data, self.counts, self.budget, options.maxStreamBytes
        while True:
            if (m := ITEM.match(data, self.at)) and m.end() - m.start() <= most:
                total += 1
                if total > options.maxArrayElements:
                    raise limit("Content array exceeds maxArrayElements.")
                counts["content_tokens"] += 1
                if counts["content_tokens"] > self.most:
                    raise limit("Content tokens exceed maxContentTokens.")
                self.at = m.end()
                text = m[1]
                budget.operand_bytes += 512 if text is None else 512 + 2 * len(text)
                if budget.operand_bytes > self.room:
                    budget.operands(0)
                stack[-1].append((STRING, text) if text is not None else (NUMBER_TOKEN, number_of(m[2])))
                continue
            self.blank()
            c = self.data[self.at : self.at + 1]
            if not c:
                return stack[0]
            if c == b"]":
                self.at += 1
                done = stack.pop()
                if not stack:
                    return done
                stack[-1].append((ARRAY, done))
                continue
            total += 1
            if total > options.maxArrayElements:
                raise limit("Content array exceeds maxArrayElements.")
            if c == b"[":
                if len(stack) >= options.maxRecursionDepth:
                    raise limit("Content array nesting exceeds maxRecursionDepth.")
                self.budget.operands(512)
                self.at += 1
                stack.append([])
                continue
            item = self.token()
            if item is not None:
                stack[-1].append(item)
