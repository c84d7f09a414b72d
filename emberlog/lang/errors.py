"""Diagnostics with a place in the query text and a hint."""

from __future__ import annotations

from difflib import get_close_matches


class QueryError(ValueError):
    """A code (E: syntax, S: meaning), what is wrong, where, and what might be meant."""

    def __init__(self, code: str, message: str, at: int = 0, text: str = "", hint: str = ""):
        self.code, self.message, self.at, self.hint, self.text = code, message, at, hint, text
        super().__init__(self.render())

    def render(self) -> str:
        out = f"{self.code}: {self.message}"
        if self.text:
            begin = self.text.rfind("\n", 0, self.at) + 1
            end = self.text.find("\n", self.at)
            line = self.text[begin : len(self.text) if end < 0 else end]
            out += f"\n  {line}\n  {' ' * (self.at - begin)}^"
        return out + (f"\nhint: {self.hint}" if self.hint else "")


class QueryErrors(QueryError):
    """All errors of one text; parsing goes on at the next pipe."""

    def __init__(self, errors: list[QueryError]):
        self.errors = errors
        first = errors[0]
        super().__init__(first.code, first.message, first.at, first.text, first.hint)

    def render(self) -> str:
        return "\n".join(e.render() for e in self.errors)


def did_you_mean(name: str, names) -> str:
    close = get_close_matches(name, list(names), 1)
    return f"did you mean `{close[0]}`?" if close else ""
