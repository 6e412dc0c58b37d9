"""A position in a text and what can be read from there; the grammars of this package are built on it."""

from __future__ import annotations

from collections.abc import Iterable


class Scanner:
    """Reads a text from left to right. Every method that takes something moves on only if it found it."""

    def __init__(self, text: str, at: int = 0):
        self.text, self.at = text, at

    def done(self) -> bool:
        return self.at >= len(self.text)

    def peek(self, ahead: int = 0) -> str:
        return self.text[self.at + ahead : self.at + ahead + 1]

    def before(self) -> str:
        return self.text[self.at - 1 : self.at] if self.at else ""

    def run(self, inside) -> str:
        """The longest run of characters that ``inside`` accepts."""
        start = self.at
        while self.at < len(self.text) and inside(self.text[self.at]):
            self.at += 1
        return self.text[start : self.at]

    def spaces(self) -> str:
        return self.run(str.isspace)

    def one_of(self, characters: str) -> str:
        c = self.peek()
        if c and c in characters:
            self.at += 1
            return c
        return ""

    def longest(self, names: Iterable[str], fold: bool = False) -> str:
        """The longest of the names that stands here; fold ignores case."""
        rest = self.text[self.at :]
        rest = rest.lower() if fold else rest
        found = max((n for n in names if rest.startswith(n.lower() if fold else n)), key=len, default="")
        self.at += len(found)
        return found

    def braces(self) -> str | None:
        """The inside of a brace group that holds no other, or None."""
        end = self.text.find("}", self.at)
        if self.peek() != "{" or end < 0 or "{" in self.text[self.at + 1 : end]:
            return None
        inside, self.at = self.text[self.at + 1 : end], end + 1
        return inside


def is_digit(c: str) -> bool:
    return "0" <= c <= "9"


def is_word(c: str) -> bool:
    return c.isalnum() or c == "_"
