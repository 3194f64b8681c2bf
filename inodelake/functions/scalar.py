"""Scalar functions of sizes, times, modes, paths and lists, as built-in Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Labels of the size profile, from empty files up.
SIZE_LABELS = ("0", "1~31", "32~1K-", "1K~31K", "32K~1M-", "1M~31M", "32M~1G-", "1G~31G", "32G~1T-", "+1T")


def wide(column: str, schema: T.StructType) -> Column:
    """A column of longs as decimals, so that its sums have room beyond 64 bits; others as they are."""
    return F.col(column).cast("decimal(20,0)") if isinstance(schema[column].dataType, T.LongType) else F.col(column)


def total(column: str) -> Column:
    """The exact sum of a column of whole numbers, as a decimal."""
    return F.sum(F.col(column).cast("decimal(20,0)"))


def mean(column: Column) -> Column:
    """The average of whole numbers, rounded to one. It comes from the whole quotient of the exact sum and its rest: a sum
    of doubles would lose what lies beyond their 53 bits."""
    summed, n = F.sum(column.cast("decimal(20,0)")), F.nullif(F.count(column), F.lit(0))
    whole = F.call_function("div", summed, n)
    return F.round(whole.cast("double") + (summed - whole.cast("decimal(20,0)") * n).cast("double") / n).cast("long")


def sz_range(size: Column) -> Column:
    """-1 for empty, else floor(log2(size) / 5), by exact integer bounds."""
    out = F.when(size == 0, -1)
    for k in range(1, 13):
        out = out.when(size < 1 << 5 * k, k - 1)
    return out.otherwise(12).cast("int")


def size_bucket(size: Column) -> Column:
    return F.least(sz_range(size), F.lit(8))


def size_label(size: Column) -> Column:
    return F.get(F.array(*map(F.lit, SIZE_LABELS)), size_bucket(size) + 1)


def human_size(size: Column) -> Column:
    """Two digits after the point; halves go to the even digit, as C prints them."""
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB", "TB", "PB"), 1):
        out = out.when(size < 1 << 10 * (k + 1), F.format_string(f"%.2f {unit}", F.bround(size / float(1 << 10 * k), 2)))
    return out.otherwise(F.format_string("%.2f EB", F.bround(size / float(1 << 60), 2)))


def du_size(size: Column, mode: str = "b") -> Column:
    if mode in "km":
        return F.ceil(size / (1024 if mode == "k" else 1 << 20)).cast("string")
    if mode == "h":
        out = F.when(size < 1024, size.cast("string"))
        for k, unit in enumerate("KMGT", 1):
            out = out.when((size < 1 << 10 * (k + 1)) | F.lit(k == 4), F.format_string(f"%.1f{unit}", size / float(1 << 10 * k)))
        return out
    return size.cast("string")


def duration(seconds: Column) -> Column:
    """Days, hours, minutes and seconds, leading zeros left out."""
    d, h, m, s = F.floor(seconds / 86400), F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60, seconds % 60
    return F.when(seconds >= 86400, F.format_string("%dd %02dh %02dmin %02ds", d, h, m, s)).when(seconds >= 3600, F.format_string("%dh %02dmin %02ds", h, m, s)).when(seconds >= 60, F.format_string("%dmin %02ds", m, s)).otherwise(F.format_string("%ds", s))


def parse_date(text: Column) -> Column:
    """``yyyymmddHHMM[SS]`` as epoch seconds; null if it is no date."""
    return F.unix_timestamp(F.try_to_timestamp(F.rpad(text, 14, "0"), F.lit("yyyyMMddHHmmss")))


def mode_string(mode: Column) -> Column:
    return F.concat(*[F.when(mode.bitwiseAND(1 << (8 - i)) != 0, "rwx"[i % 3]).otherwise("-") for i in range(9)])


def octal(mode: Column) -> Column:
    return F.conv(mode.cast("string"), 10, 8)


def type_letter(kind: Column) -> Column:
    letters = {"file": "f", "dir": "d", "symlink": "l", "chr": "c", "blk": "b", "fifo": "p", "sock": "s"}
    return F.coalesce(F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])[kind], F.lit("?"))


def depth(path: Column, root: str = "") -> Column:
    return F.size(F.split(path, "/")) - len(root.split("/")) - 1


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def relative(path: Column, root: str) -> Column:
    return F.when(path == root, F.lit("")).when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 30))


def absolute(path: Column, root: str) -> Column:
    return F.when(path == "", F.lit(root)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def encode_list(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit("+"), F.array_join(values, "+"), F.lit("+"))).otherwise("")


def decode_list(text: Column) -> Column:
    return F.filter(F.split(text, "\\+"), lambda x: x != "")


def colour(label: Column) -> Column:
    return F.concat(F.lit("#"), F.substring(F.md5(label), 1, 6))


def time_bucket(t: Column, unit: str, compat: bool = False) -> Column:
    """Start of the hour, day, week, month or year of fixed length. ``compat`` uses the long months and years that
    older dashboards were built with."""
    n = {"hour": 3600, "day": 86400, "week": 604800, "month": 26280030 if compat else 2628000, "year": 315360365 if compat else 31536000}[unit]
    return (F.floor(t / n) * n).cast("long")


def log2_bucket(x: Column, k: int = 1) -> Column:
    """floor(floor(log2 x) / k), exact: the position of the highest bit."""
    return F.floor((F.length(F.bin(x)) - 1) / k).cast("long")


def mode_guard(mode: Column, must: int, never: int) -> Column:
    return F.when((mode.bitwiseAND(must) == must) & (mode.bitwiseAND(never) == 0), "ok").otherwise("invalid")


def fixed_mode(mode: Column, must: int, never: int) -> Column:
    return mode.bitwiseOR(must).bitwiseAND(0o7777 & ~never)


def printable(name: Column) -> Column:
    """Bytes that are not printable ASCII, and backslashes, as \\NNN (octal)."""
    byte = lambda x: F.conv(x, 16, 10).cast("int")
    shown = lambda x: F.when(byte(x).between(32, 126) & (byte(x) != 92), F.char(byte(x))).otherwise(F.concat(F.lit("\\"), F.lpad(F.conv(x, 16, 8), 3, "0")))
    escaped = F.array_join(F.transform(F.regexp_extract_all(F.hex(F.encode(name, "UTF-8")), F.lit("(..)"), 1), shown), "")
    return F.when(name.rlike(r"^[\x20-\x5B\x5D-\x7E]*$"), name).otherwise(escaped)


def sounds(text: Column) -> Column:
    """Soundex of any length: first letter and codes of the others; vowels, h, w and y go before repeats do."""
    letters = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    codes = F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    kept = F.concat(F.substring(codes, 1, 1), F.regexp_replace(F.substring(codes, 2, 1 << 30), "0", ""))
    out = F.concat(F.substring(letters, 1, 1), F.substring(F.regexp_replace(kept, r"(.)\1+", "$1"), 2, 1 << 30))
    return F.when(letters == "", "").when(F.length(out) < 4, F.rpad(out, 4, "0")).otherwise(out)


def blocks_on_ost(size: Column, stripe_size: Column, count: Column, place: Column) -> Column:
    """512-byte blocks of a file on the OST at ``place`` (from 0) of its stripes, round robin by stripe size. None without a
    stripe there (null place)."""
    width = F.nullif(stripe_size * count, F.lit(0))
    full = F.floor(size / width)
    rest = size - full * width
    own = F.greatest(F.lit(0), F.least(stripe_size, rest - place * stripe_size))
    return F.coalesce(F.ceil((full * stripe_size + own) / 512).cast("long"), F.lit(0))


def placeholders(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each ``{name}`` replaced by its column; an unknown name is an error, a null value is empty."""
    parts = []
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            if name not in values:
                raise ValueError(f"unknown placeholder {{{name}}} in {template}")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def utc_text(t: Column, template: str = "%Y/%m/%d %H:%M:%S") -> Column:
    """Epoch seconds as UTC text by %Y %m %d %H %M %S %F %T %s %%; null is empty, another directive an error."""
    day = F.date_from_unix_date(F.floor(t / 86400).cast("int"))
    clock = F.pmod(t, F.lit(86400)).cast("int")
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    known = {
        "Y": F.date_format(day, "yyyy"), "m": F.date_format(day, "MM"), "d": F.date_format(day, "dd"), "F": F.date_format(day, "yyyy-MM-dd"), "s": t.cast("string"),
        "H": two(clock / 3600), "M": two(clock % 3600 / 60), "S": two(clock % 60), "%": F.lit("%"),
    }
    known["T"] = F.concat_ws(":", known["H"], known["M"], known["S"])
    parts = []
    for letter, text in re.findall(r"%(.?)|([^%]+)", template):
        if not text and letter not in known:
            raise ValueError(f"unknown date directive %{letter} in {template}")
        parts.append(F.lit(text) if text else known[letter])
    return F.coalesce(F.when(t.isNotNull(), F.concat(*parts)), F.lit(""))


def printed(template: str, values: dict[str, Column]) -> Column:
    """``template`` with each directive, %[-][0][width]letters, replaced by its value in ``values``, null as empty. A value
    of a date directive (A, C, T, RC) is epoch seconds and takes its form from ``{...}``; ``%Rm{manager.attribute}`` prints
    the value ``Rm{manager.attribute}``. Escapes: \\n, \\t, \\\\, \\NNN
    (octal) and \\xHH; an unknown directive or escape is an error."""
    token = re.compile(r"%%|%(?P<left>-?)(?P<zero>0?)(?P<width>\d*)(?P<name>R?[A-Za-z])(?:\{(?P<form>[^}]*)\})?|\\(?P<escape>[0-7]{3}|x[0-9A-Fa-f]{2}|[nt\\])|[^%\\]+")
    parts, at = [], 0
    while at < len(template):
        found = token.match(template, at)
        name = found and found["name"]
        if name == "Rm":
            name = f"Rm{{{found['form']}}}"
        if not found or name and name not in values:
            raise ValueError(f"unknown directive at {template[at:]!r}")
        at = found.end()
        if name:
            dated = name in ("A", "C", "T", "RC")
            value = utc_text(values[name], found["form"] or "%Y/%m/%d %H:%M:%S") if dated else F.coalesce(values[name].cast("string"), F.lit(""))
            if found["width"]:
                width, fill = int(found["width"]), "0" if found["zero"] and not found["left"] else " "
                pad = F.rpad if found["left"] else F.lpad
                value = F.when(F.length(value) < width, pad(value, width, fill)).otherwise(value)
            parts.append(value)
        elif code := found["escape"]:
            own = {"n": "\n", "t": "\t", "\\": "\\"}
            parts.append(F.lit(own[code] if code in own else chr(int(code[1:], 16) if code[0] == "x" else int(code, 8))))
        else:
            parts.append(F.lit("%" if found[0] == "%%" else found[0]))
    return F.concat(*parts) if parts else F.lit("")


def listed(e: dict[str, Column], *more: Column) -> Column:
    """A long listing line: id, type, mode, links, owner, group, size, time of change (UTC), then ``more`` (status, class),
    and the path. Unknown values are empty, an unknown type is ?."""
    head = printed(r"[%Rf] %-4y %M %3n  %-10u %-10g %15s %20T ", {
        "Rf": e["id"], "y": F.coalesce(e["type"], F.lit("?")), "M": mode_string(e["mode"]), "n": e["nlink"], "u": e["uid"], "g": e["gid"], "s": e["size"], "T": e["last_mod"],
    })
    return F.concat(head, *[printed(" %-15s ", {"s": x}) for x in more], F.coalesce(e["path"], F.lit("")))


def stripe_list(items: Column) -> Column:
    """Stripes (an array of structs of ostidx and objid) as ``ost#index:object`` with commas; ``(none)`` without any."""
    each = F.transform(items, lambda s: F.concat(F.lit("ost#"), s["ostidx"].cast("string"), F.lit(":"), F.coalesce(s["objid"].cast("string"), F.lit("0"))))
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(each, ", ")).otherwise("(none)")


def listed_briefly(e: dict[str, Column], *more: Column, stripes: Column | None = None) -> Column:
    """A short listing line: id, type, size, then ``more`` (status, class), the path, and for entries with stripes those."""
    head = printed("[%Rf] %-4y %15s ", {"Rf": e["id"], "y": F.coalesce(e["type"], F.lit("?")), "s": e["size"]})
    tail = F.when(F.coalesce(F.size(stripes), F.lit(0)) > 0, F.concat(F.lit("  "), stripe_list(stripes))).otherwise("") if stripes is not None else F.lit("")
    return F.concat(head, *[printed(" %-15s ", {"s": x}) for x in more], F.coalesce(e["path"], F.lit("")), tail)
