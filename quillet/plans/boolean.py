"""Boolean queries: lexer, postfix form, and compilation to one column over per-document flags.

compat: AND, OR, NOT and parentheses are recognised anywhere, even inside a word; NOT is taken off the operator stack right after the next
word only, so `NOT (a OR b) AND c` is NOT ((a OR b) AND c). standard: keywords are whole words and NOT binds to the word or group
behind it. Both: AND before OR, left to right, case matters.
"""

from __future__ import annotations

import re
from enum import IntEnum

from pyspark.sql import Column


class Operator(IntEnum):
    """Operators by precedence."""

    OR = 1
    AND = 2
    NOT = 3


class QueryError(ValueError):
    """A query that can't be read."""


#: What splits a query in compat mode, and in standard mode. Fixed values.
COMPAT, STANDARD = r"(AND|OR|NOT|\(|\))", r"([()])"


def lex(query: str, mode: str = "compat") -> list[str]:
    if query is None or not query.strip():
        raise QueryError("the query is empty")
    return re.sub(COMPAT if mode == "compat" else STANDARD, r" \1 ", query).split()


class _Reader:
    """Reads a query by climbing precedences; each part is given in postfix form. A missing operand is an empty part, which compile_rpn() finds."""

    def __init__(self, tokens: list[str], mode: str):
        self.tokens, self.mode, self.at = tokens, mode, 0

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, token: str) -> bool:
        found = self.peek() == token
        self.at += found
        return found

    def chain(self, least: int) -> list[str]:
        """Operands joined by operators of `least` precedence or more, left to right."""
        out = self.operand()
        while (token := self.peek()) in ("AND", "OR") and Operator[token] >= least:
            self.at += 1
            out += [*self.chain(Operator[token] + 1), token]
        return out

    def group(self) -> list[str]:
        """Chains up to the group's end; several stand side by side only in a query that can't be evaluated."""
        out = self.chain(Operator.OR)
        while self.peek() not in (None, ")"):
            out += self.chain(Operator.OR)
        return out

    def operand(self) -> list[str]:
        if self.take("NOT"):
            if self.mode == "standard" or self.peek() not in ("(", "NOT", "AND", "OR", ")", None):
                return [*self.operand(), "NOT"]
            # compat: before anything but a word, NOT takes all that is left of its group
            return [*(self.operand() if self.negated_word() else self.group()), "NOT"]
        if self.take("("):
            inner = self.group()
            if not self.take(")"):
                raise QueryError("an opening parenthesis has no partner")
            return inner
        token = self.peek()
        if token in (None, ")") or token in Operator.__members__:
            return []
        self.at += 1
        return [token]

    def negated_word(self) -> bool:
        """Whether NOTs and then a word come next."""
        k = self.at
        while k < len(self.tokens) and self.tokens[k] == "NOT":
            k += 1
        return k > self.at and k < len(self.tokens) and self.tokens[k] not in ("(", ")", "AND", "OR")


def to_rpn(query: str, mode: str = "compat") -> str:
    """The query in postfix form."""
    reader = _Reader(lex(query, mode), mode)
    out = reader.group()
    if reader.peek() is not None:
        raise QueryError("a closing parenthesis has no partner")
    return " ".join(out)


def operands(rpn: str) -> list[str]:
    return list(dict.fromkeys(t for t in rpn.split() if t not in Operator.__members__))


def compile_rpn(rpn: str, flag: dict[str, Column]) -> Column:
    """One boolean column; flag: whether a document holds a term."""
    if not rpn.strip():
        raise QueryError("the query is empty")
    stack: list[Column] = []

    def pop() -> Column:
        if not stack:
            raise QueryError("an operator lacks an operand")
        return stack.pop()

    for token in rpn.split():
        if token == "NOT":
            stack.append(~pop())
        elif token in Operator.__members__:
            b, a = pop(), pop()
            stack.append(a & b if token == "AND" else a | b)
        else:
            stack.append(flag[token])
    if len(stack) != 1:
        raise QueryError("two operands stand side by side")
    return stack[0]
