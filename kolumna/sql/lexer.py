"""Tokens of the language."""

from __future__ import annotations

import re
from dataclasses import dataclass

from kolumna.errors import ParseError

KEYWORDS = frozenset("SELECT FROM WHERE GROUP BY AS AND OR CREATE TABLE INSERT INTO VALUES PRIMARY KEY DROP SET MODE EXPLAIN".split())

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<number>\d+\.\d*|\.\d+|\d+)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<string>'(?:[^']|'')*')
      | (?P<symbol><=|>=|!=|<>|[-+*=<>(),;])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    """``kind``: number, word, keyword, string, symbol or end; keywords are upper case whatever the text has."""

    kind: str
    text: str
    at: int


def tokens(sql: str) -> list[Token]:
    """All tokens and an end. Characters outside the language and open strings or comments are errors."""
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"unexpected character {sql[at]!r} at {at}")
        kind, text = m.lastgroup, m.group()
        if kind == "word" and text.upper() in KEYWORDS:
            out.append(Token("keyword", text.upper(), at))
        elif kind == "string":
            out.append(Token("string", text[1:-1].replace("''", "'"), at))
        elif kind == "symbol":
            out.append(Token("symbol", "!=" if text == "<>" else text, at))
        elif kind != "space":
            out.append(Token(kind, text, at))
        at = m.end()
    return [*out, Token("end", "", len(sql))]
