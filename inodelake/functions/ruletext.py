"""The text form of rules: blocks of settings, conditions and class algebra, read into small trees with their lines.

Keywords (``not and or union inter``) are read whatever their case. ``and`` and ``or`` bind alike and to the right:
``a and b or c`` is ``a and (b or c)``; ``not`` takes one test or one parenthesis, but in class algebra all that follows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

KEYWORDS = ("not", "and", "or", "union", "inter")
OPERATORS = {"==": "==", "!=": "!=", "<>": "!=", ">=": ">=", "<=": "<=", ">": ">", "<": "<"}
#: How deep texts may include others.
DEPTH = 10

_TOKEN = re.compile(
    r"""(?P<space>[ \t\r\f]+|\#[^\n]*|//[^\n]*)|(?P<line>\n)|(?P<include>%include)|(?P<text>"(?:\\[\s\S]|[^"\\\n])*"|'[^'\n]*')|(?P<sign>==|!=|<>|>=|<=|[=<>{}();,])|(?P<word>[^ \t\r\n\f"'#(),;=<>!{}]+)""",
)
_NAME = re.compile(r"[A-Za-z_.][\w.\-]*\Z", re.ASCII)


class RuleError(ValueError):
    """What is wrong, and at which line."""

    def __init__(self, line: int, message: str) -> None:
        super().__init__(f"line {line}: {message}")
        self.line = line


@dataclass(frozen=True)
class Token:
    kind: str  # name, value, sign or a keyword
    text: str
    line: int


@dataclass(frozen=True)
class Test:
    """``criterion op value``."""

    name: str
    op: str
    value: str
    line: int = 0


@dataclass(frozen=True)
class Named:
    """A class in class algebra."""

    name: str
    line: int = 0


@dataclass(frozen=True)
class Constant:
    value: bool


@dataclass(frozen=True)
class Not:
    of: Node


@dataclass(frozen=True)
class And:
    left: Node
    right: Node


@dataclass(frozen=True)
class Or:
    left: Node
    right: Node


Node = Test | Named | Constant | Not | And | Or


@dataclass(frozen=True)
class Setting:
    name: str
    value: str
    args: tuple[str, ...] = ()
    line: int = 0


@dataclass(frozen=True)
class Block:
    """A block with settings and blocks in ``items``, or with one condition or class in ``node``."""

    kind: str
    name: str | None
    items: tuple[Setting | Block, ...] = ()
    node: Node | None = None
    line: int = 0

    def settings(self, name: str) -> list[Setting]:
        return [i for i in self.items if isinstance(i, Setting) and i.name.lower() == name]

    def blocks(self, *kinds: str) -> list[Block]:
        return [i for i in self.items if isinstance(i, Block) and i.kind.lower() in kinds]

    def setting(self, name: str, default: str | None = None) -> str | None:
        found = self.settings(name)
        if len(found) > 1:
            raise RuleError(found[1].line, f"{name} is set twice in {self.kind}")
        return found[0].value if found else default


def tokens(text: str, include: Callable[[str], str] | None = None, variables: Mapping[str, str] | None = None, seen: tuple[str, ...] = ()) -> Iterator[Token]:
    line, at = 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(line, "the closing quote is missing" if text[at] in "\"'" else f"unexpected {text[at]!r}")
        at, word = m.end(), m[0]
        if m["line"]:
            line += 1
        elif m["include"]:
            quoted = re.compile(r'\s*"([^"\n]*)"').match(text, at)
            if not quoted or include is None:
                raise RuleError(line, "a file name in quotes must follow %include" if include else "nothing can be included here")
            name, at = _resolved(quoted[1], variables, line), quoted.end()
            if name in seen or len(seen) >= DEPTH:
                raise RuleError(line, f"{name} includes itself" if name in seen else "includes are too deep")
            yield from tokens(include(name), include, variables, (*seen, name))
        elif m["text"]:
            yield Token("value", re.sub(r"\\(\n?)([\s\S]?)", lambda e: e[2], word[1:-1]) if word[0] == '"' else word[1:-1], line)
            line += word.count("\n")
        elif m["sign"]:
            yield Token("sign", word, line)
        elif m["word"]:
            kind = word.lower() if word.lower() in KEYWORDS else "name" if _NAME.match(word) else "value"
            yield Token(kind, _resolved(word, variables, line) if kind == "value" else word, line)


def _resolved(word: str, variables: Mapping[str, str] | None, line: int) -> str:
    if not re.match(r"\$[A-Za-z_.]", word):
        return word
    if word[1:] not in (variables or {}):
        raise RuleError(line, f"variable {word} is not set")
    return variables[word[1:]]


@dataclass
class _Reader:
    list: list[Token]
    at: int = 0
    last: Token = field(default=Token("end", "the end", 1))

    def peek(self, ahead: int = 0) -> Token:
        return self.list[self.at + ahead] if self.at + ahead < len(self.list) else Token("end", "the end", self.list[-1].line if self.list else 1)

    def take(self, kind: str | None = None, text: str | None = None) -> Token:
        t = self.peek()
        if (kind and t.kind != kind) or (text and t.text != text):
            raise RuleError(t.line, f"{text or kind} expected, not {t.text!r}")
        self.at += 1
        return t

    def given(self, text: str) -> bool:
        if self.peek().kind == "sign" and self.peek().text == text:
            self.at += 1
            return True
        return False

    def value(self) -> str:
        t = self.peek()
        if t.kind not in ("name", "value"):
            raise RuleError(t.line, f"a value expected, not {t.text!r}")
        self.at += 1
        return t.text

    def arguments(self) -> tuple[str, ...]:
        if not self.given("("):
            return ()
        out = [self.value()]
        while self.given(","):
            out.append(self.value())
        self.take("sign", ")")
        return tuple(out)

    def block(self) -> Block:
        head = self.take("name")
        name = self.take("name").text if self.peek().kind == "name" else None
        self.take("sign", "{")
        kind = self.content()
        if kind == "items":
            items: list[Setting | Block] = []
            while not self.given("}"):
                items.append(self.item())
            return Block(head.text, name, tuple(items), None, head.line)
        node = self.condition() if kind == "condition" else self.classes()
        self.take("sign", "}")
        return Block(head.text, name, (), node, head.line)

    def content(self) -> str:
        """What a block holds: items, a condition, or a class made of others."""
        ahead = 0
        while self.peek(ahead).kind == "not" or (self.peek(ahead).kind == "sign" and self.peek(ahead).text == "("):
            ahead += 1
        first, then = self.peek(ahead), self.peek(ahead + 1)
        if first.kind != "name":
            return "items" if ahead == 0 else "condition"
        if then.kind == "sign" and (then.text in OPERATORS or then.text == "("):
            return "condition"
        return "classes" if ahead or then.kind in KEYWORDS or (then.kind == "sign" and then.text == "}") else "items"

    def item(self) -> Setting | Block:
        t, then = self.take("name"), self.peek()
        if then.kind == "sign" and then.text == "=":
            self.at += 1
            value, args = self.value(), self.arguments()
            self.take("sign", ";")
            return Setting(t.text, value, args, t.line)
        self.at -= 1
        return self.block()

    def condition(self) -> Node:
        left = self.term()
        if self.peek().kind not in ("and", "or"):
            return left
        kind = self.take().kind
        return (And if kind == "and" else Or)(left, self.condition())

    def term(self) -> Node:
        if self.peek().kind == "not":
            self.at += 1
            return Not(self.parenthesis(self.condition) if self.peek().text == "(" else self.test())
        return self.parenthesis(self.condition) if self.peek().kind == "sign" and self.peek().text == "(" else self.test()

    def parenthesis(self, inner: Callable[[], Node]) -> Node:
        self.take("sign", "(")
        node = inner()
        self.take("sign", ")")
        return node

    def test(self) -> Test:
        t = self.take("name")
        op = self.take("sign")
        if op.text == "(":
            raise RuleError(t.line, f"{t.text}(...) runs a command, which no query can")
        if op.text not in OPERATORS:
            raise RuleError(op.line, f"a comparison expected, not {op.text!r}")
        value = self.value()
        if self.peek().text == "(" and self.peek().kind == "sign":
            raise RuleError(t.line, f"{t.text} takes no arguments")
        return Test(t.text, OPERATORS[op.text], value, t.line)

    def classes(self) -> Node:
        t = self.peek()
        if t.kind == "not":
            self.at += 1
            return Not(self.classes())
        left = self.parenthesis(self.classes) if t.kind == "sign" and t.text == "(" else Named(self.take("name").text, t.line)
        if self.peek().kind not in ("union", "inter"):
            return left
        kind = self.take().kind
        return (Or if kind == "union" else And)(left, self.classes())


def read(text: str, include: Callable[[str], str] | None = None, variables: Mapping[str, str] | None = None) -> list[Block]:
    """The blocks of a text. ``include`` gives the text of an included name; ``variables`` replace ``$NAME``."""
    r = _Reader(list(tokens(text, include, variables)))
    out = []
    while r.peek().kind != "end":
        out.append(r.block())
    return out


def condition(text: str) -> Node:
    """One condition, without a block around it."""
    r = _Reader(list(tokens(text)))
    node = r.condition()
    r.take("end")
    return node
