"""What a query text stands for."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Node:
    pass


@dataclass(frozen=True)
class Literal(Node):
    """kind: int, float, string, bool, null, timestamp (text) or duration (microseconds)."""

    value: object
    kind: str
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Field(Node):
    name: str
    quoted: bool = False
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Member(Node):
    target: Node
    name: str
    safe: bool = False
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Index(Node):
    target: Node
    index: Node
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Call(Node):
    """where: the condition of an aggregate; strict: the ! form."""

    name: str
    args: tuple[Node, ...] = ()
    where: Node | None = None
    strict: bool = False
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Unary(Node):
    op: str
    arg: Node
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Between(Node):
    value: Node
    low: Node
    high: Node
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Array(Node):
    items: tuple[Node, ...]
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Object(Node):
    items: tuple[tuple[str, Node], ...]
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Lambda(Node):
    param: str
    body: Node
    at: int = field(default=0, compare=False)


@dataclass(frozen=True)
class Assign:
    name: str
    value: Node


@dataclass(frozen=True)
class Agg:
    call: Call
    name: str


@dataclass(frozen=True)
class Key:
    """A sort key."""

    value: Node
    desc: bool = False


@dataclass(frozen=True)
class Source:
    """A name or glob, or $cte; excluded with !."""

    name: str
    cte: bool = False
    exclude: bool = False


@dataclass(frozen=True)
class Range:
    """A bracket range: what each bound is is left to `sources.timerange`."""

    low: object
    high: object


@dataclass(frozen=True)
class Stage:
    """name and the arguments that the stage's parser has found."""

    name: str
    args: dict = field(default_factory=dict, hash=False)
    at: int = field(default=0, compare=False)

    def get(self, key, default=None):
        value = self.args.get(key)
        return default if value is None else value


@dataclass(frozen=True)
class Pipeline:
    stages: tuple[Stage, ...]


@dataclass(frozen=True)
class Query:
    lets: tuple[tuple[str, Pipeline], ...]
    pipeline: Pipeline
    text: str = field(default="", compare=False)


def walk(node):
    """The node and all below it."""
    yield node
    for value in vars(node).values() if hasattr(node, "__dict__") else ():
        for x in value if isinstance(value, tuple) else (value,):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Node):
                    yield from walk(y)
