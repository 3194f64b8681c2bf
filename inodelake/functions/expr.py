"""Criteria as Columns: ordered three-valued logic, globs, literals and comparisons.

An unknown attribute gives an unknown (null) result. Evaluation goes from left to right and stops at an unknown, so
``or_`` of an unknown and a match is unknown: Spark's own ``|`` would match.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import sounds


def and_(*terms: Column) -> Column:
    return reduce(lambda a, b: F.when(a.isNull(), F.lit(None).cast("boolean")).when(~a, F.lit(False)).otherwise(b), terms)


def or_(*terms: Column) -> Column:
    return reduce(lambda a, b: F.when(a.isNull(), F.lit(None).cast("boolean")).when(a, F.lit(True)).otherwise(b), terms)


def not_(a: Column) -> Column:
    return ~a


def matched(a: Column) -> Column:
    """Only a clear match selects a row."""
    return F.coalesce(a, F.lit(False))


def all_of(*terms: Column) -> Column:
    """Filter builder: plain conjunction of whatever was given."""
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def glob_regex(glob: str, path: bool = False) -> str:
    """A whole-string regex for ``* ? [..] [!..]`` and backslash escapes. For paths, ``*`` and ``?`` stay within one
    component, and ``**`` between slashes crosses them (it may not be mixed with a single ``*``)."""
    if path and "**" in glob:
        if re.search(r"(?<!\*)\*(?!\*)", glob) or re.search(r"[^/]\*\*|\*\*[^/]", glob):
            raise ValueError(f"** must stand between slashes and alone: {glob}")
    out, i, any_one = [], 0, "[^/]" if path else "."
    while i < len(glob):
        c = glob[i]
        if c == "*":
            double = path and glob.startswith("**", i)
            out.append(".*" if double or not path else "[^/]*")
            i += double
        elif c == "?":
            out.append(any_one)
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            negated = inner[0] in "!^"
            inner = (inner[1:] if negated else inner).replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' if negated else ''}{inner}]")
            i = end
        else:
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
            out.append(re.sub(r"([\\.^$|()\[\]{}*+?])", r"\\\1", c))
        i += 1
    return f"(?s)^{''.join(out)}$"


def like_glob(column: Column, glob: str, ignore_case: bool = False, path: bool = False) -> Column:
    return column.rlike(("(?i)" if ignore_case else "") + glob_regex(glob, path))


def in_tree(path: Column, tree: str) -> Column:
    """The directory itself or anything below it."""
    if re.search(r"[*?\[]", tree):
        body = glob_regex(tree.rstrip("/"), path=True)
        return path.rlike(body[:-1] + "(/.*)?$")
    tree = tree.rstrip("/")
    return (path == tree) | path.startswith(tree + "/")


def compare(column: Column, op: str, value: object) -> Column:
    return {"==": column == value, "!=": column != value, "<=": column <= value, ">=": column >= value, "<": column < value, ">": column > value}[op]


def allow_null(column: Column, op: str, value: object, text: bool) -> Column:
    """Database form of a condition: unknown values pass, for text only where '' would."""
    loose = not text or (op == "!=" and value != "") or (op == "==" and value == "")
    plain = compare(column, op, value)
    return F.coalesce(plain | column.isNull(), F.lit(True)) if loose else plain


def int_set(literal: str) -> list[int]:
    """``3,5-8`` as numbers."""
    out: list[int] = []
    for part in literal.split(","):
        a, _, b = part.strip().partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def parse_size(text: str) -> int:
    m = re.fullmatch(r"(\d+)([KMGTPE]?)B?", text.strip(), re.I)
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) << 10 * " KMGTPE".index(m[2].upper() or " ")


def parse_duration(text: str) -> int:
    m = re.fullmatch(r"(\d+)\s*(s|sec|second|m|min|minute|h|hour|d|day|w|week|y|year)?s?", text.strip(), re.I)
    if not m:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}[(m[2] or "s")[0].lower()]


def time_modify(duration: float, factor: float = 1.0, least: float = 0.0) -> float:
    """Maintenance modifier: durations at or below the minimum stay, longer ones shrink down to it."""
    return duration if duration <= least else max(duration * factor, least)


def age(column: Column, op: str, duration: float, now: int) -> Column:
    """``now - t <op> duration`` in the inverted form ``t <op'> now - duration``, which reaches the parquet scan."""
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}[op]
    return compare(column, turned, now - int(duration))


def sounds_like(column: Column, text: str) -> Column:
    return sounds(column) == sounds(F.lit(text))


def row_access(uids: list[str], gids: list[str], names: bool = False) -> Column:
    """Rows that a user may see: their own, those of their groups and, in listings of names, those that others may write or
    execute."""
    own = F.col("uid").isin(*uids) | F.col("gid").isin(*gids)
    return own | (F.col("mode").bitwiseAND(3) > 0) if names else own


def dircount(kind: Column, count: Column, op: str, value: int) -> Column:
    return F.when(kind.isNull(), F.lit(None).cast("boolean")).when(kind != "dir", F.lit(False)).otherwise(compare(count, op, value))


def status(column: Column, value: str) -> Column:
    return F.coalesce(column, F.lit("")) == value


def has_class(classes: Column, glob: str, negate: bool = False) -> Column:
    """Membership by name pattern; an unknown list counts as empty."""
    regex = glob_regex(glob)
    found = F.exists(F.coalesce(classes, F.array().cast("array<string>")), lambda c: c.rlike(regex))
    return ~found if negate else found


def ost_index(osts: Column, index: int, negate: bool = False) -> Column:
    found = F.coalesce(F.array_contains(osts, index), F.lit(False))
    return ~found if negate else found


def ost_pool(kind: Column, pool: Column, glob: str) -> Column:
    return F.when(kind.isNull(), F.lit(None).cast("boolean")).when(kind != "file", F.lit(False)).otherwise(like_glob(pool, glob))


def xattr(attrs: Column, name: str, glob: str) -> Column:
    return like_glob(F.coalesce(attrs[name], F.lit("")), glob)


def duration_info(column: Column, op: str, value: int, now: int) -> Column:
    """A stored moment; 0 or unknown means never, which matches only ``== 0``."""
    never = F.coalesce(column, F.lit(0)) == 0
    if value == 0:
        return never if op == "==" else ~never if op == "!=" else F.lit(False)
    return ~never & F.coalesce(age(column, op, value, now), F.lit(False))


def find_number(literal: str, negate: bool = False) -> tuple[str, str]:
    """The comparator and number of ``[+-]N``; ``negate`` turns it around."""
    op = {"+": ">", "-": "<"}.get(literal[:1], "==")
    if negate:
        op = {">": "<=", "<": ">=", "==": "!="}[op]
    return op, literal.lstrip("+-")


def find_size(column: Column, literal: str, negate: bool = False) -> Column:
    op, number = find_number(literal, negate)
    return compare(column, op, parse_size(number))


def find_time(column: Column, literal: str, now: int, unit: int = 86400, negate: bool = False) -> Column:
    op, number = find_number(literal, negate)
    digits = re.match(r"\d+", number)[0]
    suffix = number[len(digits) :]
    seconds = int(digits) * ({"s": 1, "m": 60, "h": 3600, "d": 86400, "y": 31557600}[suffix] if suffix else unit)
    return age(column, op, seconds, now)


def path_filter(path: Column, wanted: str, root: str = "/") -> Column | None:
    """The entry named by ``wanted`` (a glob, relative to ``root`` or absolute) and all below it. None, which is no
    filter, where that is the root or one of its ancestors."""
    full = wanted if wanted.startswith("/") else f"{root.rstrip('/')}/{wanted}"
    full = full.rstrip("/")
    if f"{root.rstrip('/')}/".startswith(f"{full}/"):
        return None
    return path.rlike(glob_regex(full)[:-1] + "(/.*)?$")


class Filters:
    """A filter that grows test by test: all of its parts, or any of them. A part is a test of an attribute in its database
    form (unknown values pass as ``allow_null`` says), or a block with parts of its own."""

    def __init__(self, any_of: bool = False) -> None:
        self.any_of, self.parts = any_of, []

    def add(self, attribute: str, op: str, value: object, text: bool = False) -> Filters:
        self.parts.append((attribute, allow_null(F.col(attribute), op, value, text)))
        return self

    def replace(self, attribute: str, op: str, value: object, text: bool = False) -> Filters:
        """One test of the attribute in the place of the first that is there."""
        at = next((i for i, (a, _) in enumerate(self.parts) if a == attribute), len(self.parts))
        rest = [p for p in self.parts if p[0] != attribute]
        self.parts = [*rest[:at], (attribute, allow_null(F.col(attribute), op, value, text)), *rest[at:]]
        return self

    def add_if_absent(self, attribute: str, op: str, value: object, text: bool = False) -> Filters:
        return self if any(a == attribute for a, _ in self.parts) else self.add(attribute, op, value, text)

    def block(self, any_of: bool = False) -> Filters:
        """A new block inside this one."""
        inner = Filters(any_of)
        self.parts.append((None, inner))
        return inner

    def column(self) -> Column:
        """True without any part."""
        tests = [p.column() if isinstance(p, Filters) else p for _, p in self.parts if not isinstance(p, Filters) or p.parts]
        return reduce((lambda a, b: a | b) if self.any_of else (lambda a, b: a & b), tests) if tests else F.lit(True)
