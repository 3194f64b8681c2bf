"""Document fingerprints: a homomorphic multiset hash of a text's paragraphs (native functions only).

A paragraph is a line with a word (``[^\\x20\\x09-\\x0D]+``). It is hashed to a wide vector, and the fingerprint is the sum of
its paragraphs' vectors, lane by lane modulo powers of two: 8 lanes modulo 2^32 from the paragraph's SHA-256, which tell
texts apart, and 60 lanes modulo 2^20 that add a sign for each of the paragraph's pairs of neighbouring words (the last
word alone), which tell how alike two texts are. So paragraphs may come in any order, and ``add`` and ``subtract`` insert
or delete some without the rest. The inner product of two texts' sign lanes estimates that of their word-pair counts
(standard error 1 / sqrt(60) of the norms' product); ``likeness`` is twice that over the sum of both squared norms, cut
to 0 to 1. A lane wraps where signs sum up to over 2^19.

``apply`` deals the texts once, into ranges of (doc_id, hash of the text), each with a copy of the next range's first
row; texts, fingerprints and their neighbours are then worked out within the ranges. A range holds a whole number of
documents; there are as many as shuffle partitions, which a cluster sets by its input's size.

Edge cases: a null text counts as empty; texts without a word have the zero vector, which is like (1.0) another zero
vector and unlike (0.0) all others; rows that repeat a doc_id follow one another by their texts' hash, equal rows in any
order; a null doc_id comes first; one row alone is its own next; an empty table gives an empty result; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import let

IDENTITY, SIGNS = 8, 60
IDENTITY_BITS, SIGN_BITS = 32, 20
MODULI = [1 << IDENTITY_BITS] * IDENTITY + [1 << SIGN_BITS] * SIGNS
DIGITS = [IDENTITY_BITS // 4] * IDENTITY + [SIGN_BITS // 4] * SIGNS
#: Two bits of a hash are counted in one long, so far apart that the lower count cannot reach the upper one: a text of
#: under 2^31 bytes has under 2^30 pairs.
APART = SIGNS // 2
#: A pair's CRC-32 times each of these (odd, under 2^31) gives 30 signs, its bits from 16 on: the bits above and below
#: are less even.
MULTIPLIERS, DROPPED = (1_540_483_477, 1_013_904_223), 16
FANOUT = 64

_SPACES = r"[\x20\x09-\x0D]+"


def _moduli() -> Column:
    return F.array(*[F.lit(m).cast("long") for m in MODULI])


def add(a: Column, b: Column) -> Column:
    """The vector of both texts' paragraphs."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), _moduli(), F.pmod)


def subtract(a: Column, b: Column) -> Column:
    """The vector of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x - y), _moduli(), F.pmod)


def encode(vector: Column) -> Column:
    """The lanes as lower-case hex digits, in order."""
    return F.concat(*[F.lpad(F.lower(F.hex(vector[i])), n, "0") for i, n in enumerate(DIGITS)])


def decode(fingerprint: Column) -> Column:
    """The vector of an encoded fingerprint."""
    starts = [1 + sum(DIGITS[:i]) for i in range(len(DIGITS))]
    return F.array(*[_number(F.substring(fingerprint, at, n)) for at, n in zip(starts, DIGITS, strict=True)])


def likeness(a: Column, b: Column) -> Column:
    """How alike the texts of two vectors are, 0 to 1."""
    half = 1 << SIGN_BITS - 1
    signed = lambda x: F.pmod(x + half, F.lit(2 * half)) - half
    lanes = lambda v: F.transform(F.slice(v, IDENTITY + 1, SIGNS), signed)
    total = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)
    both = F.zip_with(lanes(a), lanes(b), lambda x, y: F.struct((x * y).alias("xy"), (x * x + y * y).alias("xx")))
    found = let(both, lambda p: F.struct(total(F.transform(p, lambda x: x["xy"])).alias("xy"), total(F.transform(p, lambda x: x["xx"])).alias("xx")))
    return let(found, lambda s: F.when(a == b, 1.0).when(s["xx"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 2.0 * s["xy"] / s["xx"])))


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _elements(paragraph: Column) -> Column:
    """A line end and the paragraph's digest, then its pairs of words; nothing of a paragraph without a word."""
    words = F.filter(F.split(paragraph, _SPACES), lambda w: w != "")
    pairs = lambda ws: F.transform(ws, lambda w, i: F.concat(w, F.lit(" "), F.coalesce(F.get(ws, i + 1), F.lit(""))))
    digest = F.array(F.concat(F.lit("\n"), F.sha2(paragraph, 256)))
    return let(words, lambda ws: F.when(F.size(ws) > 0, F.concat(digest, pairs(ws))))


def _paragraphs(text: Column, **own: Column) -> Column:
    return F.transform(F.split(text, "\n"), lambda p: F.struct(*[v.alias(k) for k, v in own.items()], p.alias("paragraph")))


def _sums(rows: DataFrame, keys: list[str], paragraphs: str) -> DataFrame:
    """Sums over the paragraphs (an array of structs with ``paragraph`` and those of ``keys`` that the rows lack) of each
    key: ``n`` pairs, the set bits of their hashes (``c0`` and on, two counts to a long), and lanes ``i0`` and on."""
    have = [k for k in keys if k in rows.columns]
    each = rows.select(*have, F.explode_outer(paragraphs).alias("one"))
    each = each.select(*have, *[F.col(f"one.{k}").alias(k) for k in keys if k not in have], _elements(F.col("one.paragraph")).alias("elements"))
    each = each.select(*keys, F.explode_outer("elements").alias("element"))
    digest = F.col("element").startswith("\n")
    crc = F.when(~digest, F.crc32(F.col("element").cast("binary")))
    middle = [F.shiftright(crc * m, DROPPED).bitwiseAND((1 << APART) - 1) for m in MULTIPLIERS]
    hashed = each.select(*keys, digest.alias("is_digest"), "element", middle[0].bitwiseOR(F.shiftleft(middle[1], APART)).alias("h"))
    two = F.lit(1 | 1 << APART)
    counts = [F.sum(F.shiftright("h", s).bitwiseAND(two)).alias(f"c{s}") for s in range(APART)]
    lanes = [F.sum(F.when(F.col("is_digest"), _number(F.substring("element", 8 * k + 2, 8)))).alias(f"i{k}") for k in range(IDENTITY)]
    return hashed.groupBy(*keys).agg(F.count("h").alias("n"), *counts, *lanes)


def _vector(sums: dict[str, Column]) -> Column:
    lanes = [F.pmod(sums[f"i{k}"], F.lit(1 << IDENTITY_BITS)) for k in range(IDENTITY)]
    low = [sums[f"c{s}"].bitwiseAND((1 << APART) - 1) for s in range(APART)]
    high = [F.shiftright(sums[f"c{s}"], APART) for s in range(APART)]
    return F.array(*lanes, *[F.pmod(2 * c - sums["n"], F.lit(1 << SIGN_BITS)) for c in [*low, *high]])


_NAMES = ["n", *[f"c{s}" for s in range(APART)], *[f"i{k}" for k in range(IDENTITY)]]


def vectors(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key`` and the vector of all paragraphs of its rows: the documents, or parts of them, of one key are added up."""
    rows = docs.select(F.col(f"`{key}`").alias("own_key"), _paragraphs(F.coalesce(F.col("text"), F.lit(""))).alias("all_paragraphs"))
    sums = _sums(rows, ["own_key"], "all_paragraphs")
    return sums.select(F.col("own_key").alias(key), _vector({c: F.coalesce(F.col(c), F.lit(0)) for c in _NAMES}).alias("vector"))


def _ranges(rows: DataFrame, parts: int) -> tuple[Column, Column, int]:
    """The range of a row by its ``place``, whether the row is the first place of it, and the number of ranges. Only one
    place for each range comes to the driver."""
    kind = rows.schema["place"].dataType
    dealt = rows.select("place").repartitionByRange(parts, "place").groupBy(F.spark_partition_id()).agg(F.min("place").alias("place"))
    bounds = [F.struct(F.lit(b["doc_id"]), F.lit(b["h"])).cast(kind) for b in sorted((r["place"] for r in dealt.collect()), key=lambda b: (b["doc_id"] is not None, *b))]
    if not bounds:
        return F.lit(0), F.lit(False), 1
    groups = [F.array(*bounds[i : i + FANOUT]) for i in range(0, len(bounds), FANOUT)]
    place = F.col("place")
    passed = lambda values: F.size(F.filter(values, lambda b: b <= place))
    coarse = passed(F.array(*bounds[::FANOUT])) - 1
    of_group = let(coarse, lambda c: F.struct(c.alias("c"), F.get(F.array(*groups), c).alias("g")))
    found = let(of_group, lambda x: F.struct((x["c"] * FANOUT + passed(x["g"]) - 1).alias("no"), F.exists(x["g"], lambda b: b == place).alias("first")))
    return found["no"], found["first"], len(bounds)


def apply(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of ``docs``.

    The edited text is the text whose last quarter (of its code points, rounded down) gives way to as many of the next
    document's first ones. What both have in common, the paragraphs before the edit, is hashed once."""
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("doc_id", F.xxhash64(text).alias("h")).alias("place"), text.alias("text"))
    number, first, ranges = _ranges(rows, parts)
    at = lambda no, copy: F.struct(no.cast("int").alias("range_no"), F.lit(copy).alias("copy"))
    before = F.pmod(number - 1, F.lit(ranges))
    dealt = rows.withColumn("at", F.explode(F.when(first, F.array(at(number, False), at(before, True))).otherwise(F.array(at(number, False))))).select("at.*", "place", "text")
    order = Window.partitionBy("range_no").orderBy("copy", "place")
    sized = dealt.repartitionById(ranges, "range_no").select(
        "range_no", "copy", F.col("place.doc_id").alias("doc_id"), F.row_number().over(order).alias("own_no"), "text", F.lead("text").over(order).alias("next"), F.length("text").cast("long").alias("n_chars"),
    )
    cut = F.when(F.col("copy"), F.lit(0)).otherwise(F.floor(F.col("n_chars") / 4)).cast("int")
    parted = sized.select("*", cut.alias("cut"))
    parted = parted.select("*", F.substring("text", F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")).alias("kept"), F.when(F.col("cut") > 0, F.substring("next", F.lit(1), F.col("cut"))).otherwise("").alias("tail"))
    parted = parted.select("*", F.substring_index("kept", "\n", -1).alias("stub"))
    head = F.substring("kept", F.lit(1), F.length("kept") - F.length("stub"))
    old = F.concat("stub", F.substring("text", F.length("kept") + 1, F.col("cut")))
    about = F.struct("copy", "doc_id", "n_chars", F.sha2(F.concat("kept", "tail"), 256).alias("edited_sha256"))
    none = F.lit(None).cast(parted.select(about).schema[0].dataType)
    part = lambda side, of: _paragraphs(of, side=F.lit(side), about=none)
    alone = F.array(F.struct(F.lit(3).alias("side"), about.alias("about"), F.lit("").alias("paragraph")))
    everything = F.concat(alone, part(0, head), part(1, old), part(2, F.concat("stub", "tail")))
    sides = _sums(parted.select("range_no", "own_no", everything.alias("all_paragraphs")), ["range_no", "own_no", "side", "about"], "all_paragraphs")
    without = lambda side: [F.sum(F.when(F.col("side") != side, F.coalesce(F.col(c), F.lit(0))).otherwise(0)).alias(f"{c}_{side}") for c in _NAMES]
    summed = sides.groupBy("range_no", "own_no").agg(F.max("about").alias("about"), *without(2), *without(1))
    made = summed.select("range_no", "own_no", "about.*", *[_vector({c: F.col(f"{c}_{side}") for c in _NAMES}).alias(name) for side, name in ((2, "vector"), (1, "edited_vector"))])
    neighbours = made.withColumn("next_vector", F.lead("vector").over(Window.partitionBy("range_no").orderBy("own_no"))).filter(~F.col("copy"))
    return neighbours.select(
        "doc_id", "n_chars", "edited_sha256", encode(F.col("vector")).alias("fingerprint"), encode(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def _crc_step(byte: int) -> int:
    """The CRC-32 register after a byte (reflected polynomial)."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


def oracle_sql() -> str:
    """DuckDB SQL for ``apply`` over ``documents`` whose ids do not repeat."""
    bit = lambda k: f"({_crc_step(1 << k)} * ((xor(c & 255, x) >> {k}) & 1))"
    table = reduce(lambda a, b: f"xor({a}, {b})", map(bit, range(8)))
    half_of = lambda m: f"((c * {m} >> {DROPPED}) & {(1 << APART) - 1})"
    halves = f"{half_of(MULTIPLIERS[0])} | ({half_of(MULTIPLIERS[1])} << {APART})"
    bits = ", ".join(f"sum((h >> {s}) & 1)::BIGINT AS b{s}" for s in range(SIGNS))
    ids = ", ".join(f"sum(('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT)::BIGINT AS i{k}" for k in range(IDENTITY))
    half, whole = 1 << SIGN_BITS - 1, 1 << SIGN_BITS
    signs = ", ".join(f"((2 * coalesce(b{s}, 0) - coalesce(n, 0)) % {whole} + {whole}) % {whole}" for s in range(SIGNS))
    lanes = ", ".join(f"coalesce(i{k}, 0) % {1 << IDENTITY_BITS}" for k in range(IDENTITY))
    hexed = " || ".join([f"lpad(printf('%x', v[{k + 1}]), 8, '0')" for k in range(IDENTITY)] + [f"lpad(printf('%x', v[{IDENTITY + s + 1}]), 5, '0')" for s in range(SIGNS)])
    signed = lambda v: f"list_transform({v}[{IDENTITY + 1}:], lambda x: (x + {half}) % {whole} - {half})"
    dot = lambda a, b: f"list_sum(list_transform(list_zip({signed(a)}, {signed(b)}), lambda p: p[1] * p[2]))::BIGINT"
    like = lambda a, b: f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {dot(a, a)} + {dot(b, b)} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 2.0::DOUBLE * {dot(a, b)} / ({dot(a, a)} + {dot(b, b)})) END"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars FROM documents),
ordered AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM docs),
edits AS (SELECT *, substr(text, 1, n_chars - n_chars // 4) || substr(next, 1, n_chars // 4) AS edited FROM ordered),
texts AS (SELECT doc_id, 0 AS side, text FROM edits UNION ALL SELECT doc_id, 1, edited FROM edits),
lines AS (SELECT row_number() OVER () AS line_no, * FROM (SELECT doc_id, side, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
words AS (SELECT line_no, doc_id, side, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines),
pairs AS (SELECT doc_id, side, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i] || ' ' || coalesce(w[i + 1], ''))) AS pair FROM words),
bytes AS (SELECT pair, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT pair, hex(encode(pair)) AS x FROM (SELECT DISTINCT pair FROM pairs))),
crcs AS (SELECT pair, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, {table})), 4294967295) AS c FROM bytes),
hashes AS (SELECT doc_id, side, {halves} AS h FROM pairs JOIN crcs USING (pair)),
bits AS (SELECT doc_id, side, count(*) AS n, {bits} FROM hashes GROUP BY ALL),
ids AS (SELECT doc_id, side, {ids} FROM (SELECT doc_id, side, sha256(line) AS digest FROM lines) GROUP BY ALL),
vectors AS (SELECT t.doc_id, t.side, [{lanes}, {signs}] AS v FROM texts t LEFT JOIN bits b ON t.doc_id = b.doc_id AND t.side = b.side LEFT JOIN ids i ON t.doc_id = i.doc_id AND t.side = i.side),
shown AS (SELECT *, {hexed} AS fingerprint FROM vectors)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.fingerprint, b.fingerprint AS edited_fingerprint, {like("a.v", "b.v")} AS near_edited, {like("a.v", "c.v")} AS near_next
FROM edits e JOIN shown a ON a.doc_id = e.doc_id AND a.side = 0 JOIN shown b ON b.doc_id = e.doc_id AND b.side = 1 JOIN vectors c ON c.doc_id = e.next_id AND c.side = 0"""
