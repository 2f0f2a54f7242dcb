"""Several values packed into one field: minimum-description-length dialects.

A dialect says which kinds of delimiters are active, whether quotes wrap, and which names that hold a delimiter
stand as one. Every field keeps the parse whose description is shortest:

    bits = header + sum over values + what is read literally

* a value with count c of n in the code table costs log2(n / c); another costs the escape to spelling and
  SPELL_BITS a character, where a name inside it costs its own code instead of its characters;
* a delimiter of a kind that is not active, and a quote read as a letter, cost -log2 of their chance to be literal.

The code table is counted over *all* fields of the column, under each field's cheapest parse of the round before
(`value_codes`). The first round knows the reference names only. The chances (escape to spelling, literal
delimiter, literal quote) come from the same counts (Krichevsky-Trofimov estimates), so nothing is tuned. The table
keeps values with a share of at least 1 / MAX_CODES, so it has at most MAX_CODES entries whatever the size of the
data; that bound is what makes it safe to ship.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import written

MAX_CODES = 1 << 14
SPELL_BITS = 5.0
DIALECT_BITS = 3.0
#: Names with a delimiter that stand in one value are decided jointly up to this many, then one after the other.
JOINTLY = 4

# What separates, by kind.
KINDS = {",": "comma", ";": "semicolon", "|": "bar", "/": "slash", "\n": "line", "\r": "line", "\t": "tab"}
BULLETS = "•‣◦▪●·∙"
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "«": "»", "‘": "’", "`": "`"}
BRACKETS = {"[": "]", "{": "}", "(": ")", "<": ">"}

_MARK = re.compile(r"^(?:[-*–—+>#]|\(?\d{1,3}[.)])\s+")
_TAIL = r"(?=\s*(?:$|[,;|/\n\r\t" + BULLETS + r"\]])|\s+(?:and|&)\s)"
_SIGN = re.compile(r"[,;|/\n\r\t" + BULLETS + "]")
_INNER = re.compile(r"[,;|/\n\r\t" + BULLETS + r"]|(?<=\s)(?:and|&)(?=\s)", re.I)
_HEAD = r"(?:^|(?<=[,;|/\n\r\t\[" + BULLETS + r"  ]))"


def name_pattern(names: Iterable[str | None]) -> str:
    """An alternation of the names in which a separator stands; others need no protection."""
    inner = re.compile(r"[,;|/\n\r\t" + BULLETS + r"]|\s(?:and|&)\s", re.I)
    held = sorted({n.strip() for n in names if n and inner.search(n.strip())}, key=lambda n: (-len(n), n))
    return "|".join(re.escape(n) for n in held)


def _scanner(names: str) -> re.Pattern:
    quoted = "|".join(rf"{re.escape(a)}(?:[^{re.escape(b)}]|{re.escape(b)}{re.escape(b)})*{re.escape(b)}" for a, b in QUOTES.items())
    parts = [rf"(?P<quote>{_HEAD}(?:{quoted}){_TAIL})", r"(?P<paren>\([^()]*\))"]
    if names:
        parts.append(rf"(?P<name>(?<!\w)(?:{names})(?!\w))")
    parts.append(rf"(?P<sep>[,;|/\n\r\t{BULLETS}]|(?<=\s)(?:and|&)(?=\s))")
    return re.compile("|".join(parts), re.I)


def _outer(text: str) -> str:
    """The field without a bracket pair around all of it."""
    text = text.strip()
    while len(text) > 1 and text[0] in "[{" and text[-1] == BRACKETS[text[0]]:
        depth = 0
        for i, c in enumerate(text):
            depth += (c == text[0]) - (c == BRACKETS[text[0]])
            if not depth:
                break
        if i < len(text) - 1:
            break
        text = text[1:-1].strip()
    return text


def _bare(value: str, quotes: bool) -> str:
    """A value without white space, list mark and the quotes or brackets that merely wrap it."""
    value = value.strip()
    while value:
        before = value
        value = _MARK.sub("", value).strip()
        if value in ("-", "*", "–", "—", "+"):
            return ""
        if quotes and len(value) > 1 and value[0] in QUOTES and value[-1] == (end := QUOTES[value[0]]):
            inner = value[1:-1]
            if end not in inner.replace(end + end, ""):
                return _tidy(inner.replace(end + end, end))
        if len(value) > 1 and value[0] in BRACKETS and value[-1] == (end := BRACKETS[value[0]]) and end not in value[1:-1] and value[0] not in value[1:-1]:
            value = value[1:-1].strip()
        if value == before:
            break
    return value


def _tidy(value: str) -> str:
    return value.strip()


@dataclass
class Codes:
    """Code lengths of one column: of values (lower case), of the escape to spelling, of a delimiter and of a quote read literally."""

    values: dict[str, float] = field(default_factory=dict)
    rare: float = 8.0
    literal: float = 16.0
    quote: float = 16.0


class Parser:
    """Parses fields of one column by their cheapest dialect."""

    def __init__(self, names: str, codes: Codes | None = None):
        self.scan = _scanner(names)
        self.codes = codes or Codes()
        self.seen: dict[str, float] = {}

    def bits(self, value: str, inside: tuple[str, ...] = ()) -> float:
        """Description length of a value; inside: names in it that have a code of their own."""
        got = self.seen.get(value)
        if got is None:
            low = value.lower()
            got = self.codes.values.get(low)
            if got is None:
                got = self.codes.rare + SPELL_BITS * len(value)
                for n in inside:
                    if n in low:
                        got += self.name_bits(n) - SPELL_BITS * len(n)
            if len(self.seen) < 1 << 16:
                self.seen[value] = got
        return got

    def name_bits(self, name: str) -> float:
        """A reference name that never occurred costs the escape, and no more than a character."""
        return self.codes.values.get(name, self.codes.rare + SPELL_BITS)

    def _values(self, text: str, cuts: list[tuple[int, int]], quotes: bool, names: list[tuple[str, list[tuple[int, int]]]]) -> tuple[float, list[str]]:
        """Bits and values of a text cut at the given places and, where that is shorter, inside the names."""
        out, bits, at = [], 0.0, 0
        held = iter(names)
        name = next(held, None)
        for a, b in [*cuts, (len(text), len(text))]:
            own = []
            while name is not None and name[1][0][0] < a:
                own.append(name)
                name = next(held, None)
            if own:
                cost, values = self._piece(text, at, a, quotes, own)
                bits += cost
                out += values
            else:
                v = _bare(text[at:a], quotes)
                if v:
                    bits += self.bits(v)
                    out.append(v)
            at = b
        return bits, out

    def _piece(self, text: str, lo: int, hi: int, quotes: bool, names: list) -> tuple[float, list[str]]:
        """A piece with names that hold delimiters: each name stands as one, or its delimiters separate."""
        def cut(split: tuple[bool, ...]) -> tuple[float, list[str]]:
            places = [p for s, (_, seps) in zip(split, names) if s for p in seps]
            whole = tuple(n for s, (n, _) in zip(split, names) if not s)
            at, values = lo, []
            for a, b in [*places, (hi, hi)]:
                values.append(_bare(text[at:a], quotes))
                at = b
            values = [v for v in values if v]
            return sum(self.bits(v, whole) for v in values), values

        if len(names) <= JOINTLY:
            return min((cut(s) for s in product((False, True), repeat=len(names))), key=lambda x: x[0])
        split = [False] * len(names)
        best = cut(tuple(split))
        for k in range(len(names)):
            split[k] = True
            other = cut(tuple(split))
            if other[0] < best[0]:
                best = other
            else:
                split[k] = False
        return best

    def parse(self, text: str | None) -> list[str]:
        if text is None:
            return []
        text = _outer(text)
        if not text:
            return []
        seps: list[tuple[int, int, str]] = []
        hidden: list[tuple[int, int, str]] = []
        names: list[tuple[str, list[tuple[int, int]]]] = []
        wraps = 0
        for m in self.scan.finditer(text):
            kind = m.lastgroup
            if kind == "sep":
                c = m.group()
                seps.append((m.start(), m.end(), KINDS.get(c, "word" if len(c) > 1 or c == "&" else "bullet")))
            elif kind == "name":
                names.append((m.group().lower(), [(m.start() + k.start(), m.start() + k.end()) for k in _INNER.finditer(m.group())]))
            elif kind == "quote":
                wraps += 1
                hidden += [(m.start() + k.start(), m.start() + k.end(), KINDS.get(k.group(), "bullet")) for k in _SIGN.finditer(m.group())]
        best, values = self._values(text, [(a, b) for a, b, _ in seps], True, names)
        best += DIALECT_BITS
        kinds = {k for _, _, k in seps}
        for active in [{k} for k in kinds] * (len(kinds) > 1) + [set()] * bool(kinds):
            cuts = [(a, b) for a, b, k in seps if k in active]
            floor = DIALECT_BITS + self.codes.literal * (len(seps) - len(cuts))
            if floor < best:  # what is literal alone must not cost more
                bits, other = self._values(text, cuts, True, names)
                if floor + bits < best:
                    best, values = floor + bits, other
        if wraps:
            floor = DIALECT_BITS + 2 * wraps * self.codes.quote
            if floor < best:
                bits, other = self._values(text, sorted((a, b) for a, b, _ in seps + hidden), False, names)
                if floor + bits < best:
                    best, values = floor + bits, other
        return values


def value_codes(fields: DataFrame, columns: dict[str, str], rounds: int = 1) -> dict[str, Codes]:
    """Code tables of the columns (column -> pattern of names), counted over every field.

    Each round parses all fields with the tables of the round before and counts the values; the first knows the
    names only. Null and blank fields count nothing. Bounded: values with a share of at least 1 / MAX_CODES.
    """
    codes = {c: Codes() for c in columns}
    for _ in range(rounds):
        parsed = parse_fields(fields.select(*columns), columns, codes)
        one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.transform(c, F.lower).alias("items")) for c in columns])).alias("f")
        flat = parsed.select(one).select("f.column", F.explode("f.items").alias("v"))
        counted = written(flat.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c")), "codes")
        totals = {r.column: r.n for r in counted.groupBy("column").agg(F.sum("c").alias("n")).collect()}
        tables: dict[str, dict[str, int]] = {c: {} for c in columns}
        share = F.col("c") * MAX_CODES >= F.create_map(*[F.lit(x) for c in columns for x in (c, totals.get(c, 0))])[F.col("column")]
        for r in counted.where(share).collect():
            tables[r.column][r.v] = r.c
        codes = {}
        for c, table in tables.items():
            n = totals.get(c, 0)
            # in the parse counted, every delimiter outside names, quotes and parentheses separates and every wrapping quote wraps
            chance = lambda k: -math.log2((k + 0.5) / (n + 1))  # noqa: E731, B023
            codes[c] = Codes({v: math.log2(n / k) for v, k in table.items()}, chance(n - sum(table.values())), chance(0), chance(0))
    return codes


def parse_fields(fields: DataFrame, columns: dict[str, str], codes: dict[str, Codes] | None = None) -> DataFrame:
    """Replace each column by the array of its values, parsed by the cheapest dialect of every field.

    fields: any DataFrame; columns: column -> pattern of protected names (see `name_pattern`).
    Other columns pass unchanged. Null and blank fields give empty arrays; repeats are kept.
    codes: code tables by column; counted over `fields`, which are then written once, where absent.
    """
    if codes is None:
        fields = written(fields, "fields")
        codes = value_codes(fields, columns)
    schema = fields.schema
    out = ", ".join(f"`{f.name}` array<string>" if f.name in columns else f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers = {c: Parser(names, codes.get(c)) for c, names in columns.items()}
        for batch in batches:
            arrays, labels = [], []
            for name, col in zip(batch.schema.names, batch.columns):
                if name in parsers:
                    parse = parsers[name].parse
                    col = pa.array([parse(x) for x in col.to_pylist()], pa.list_(pa.string()))
                arrays.append(col)
                labels.append(name)
            yield pa.RecordBatch.from_arrays(arrays, names=labels)

    return fields.mapInArrow(run, out)


def unpack(fields: DataFrame, key: str, columns: dict[str, str], codes: dict[str, Codes] | None = None) -> DataFrame:
    """One row per value: (record_id, field_name, pos, item); pos counts from 1 within a field.

    fields must hold `key` once per record. Fields without a value give no row.
    """
    parsed = parse_fields(fields.select(F.col(key).alias("record_id"), *columns), columns, codes)
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("items")) for c in columns])).alias("f")
    return parsed.select("record_id", one).select("record_id", "f.field_name", F.posexplode("f.items").alias("pos", "item")).select(
        "record_id", "field_name", (F.col("pos") + 1).cast("int").alias("pos"), "item"
    )
