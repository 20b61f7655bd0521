"""Secret scans: three base patterns, and an assignment-aware lexer.

The lexer looks at every `=`, `:`, `:=` and `=>` of a text, takes the name before it (quoted or not, of any length, `export`, attributes and subscripts allowed) and the
literal or name after it, and so turns source code and configuration into name-literal pairs. A type between name and operator is stepped over (`name: type =`, and
`name type =` with a plain type or after `var` or `const`). A name on the right, also as $NAME or ${NAME}, is replaced by the value it was last bound to
(constants propagate through chains of names), and literals and names joined by `+` or `.` are one value with a span for each of its literals, however many. Members of lists, literals in
triple quotes, blocks of indented lines behind `name: |` and arguments of setters (`setPassword("...")`) are values too; what is called or indexed (`os.environ["HOME"]`) is none. A value is
scored by the words of its target's name and by its own entropy; those of at least THRESHOLD are reported as kind `literal`, or `constant` where the value came
through another name (the span is then that of the literal itself).

Values are ropes: a join refers to its two sides, and what scoring needs (length, counts of characters, the first and last few of them) is made from theirs. So nothing is cut off and a name
may be joined to itself without end; each part is reported once. Time is linear in the text for any kind of repetition of names, operators, quotes and joins.

Null texts are empty and have no spans. Very long texts are read as a whole, by one task each. Rows are judged on their own, so the plan has no shuffle; repeated rows and ties need no
care, further columns are ignored, and an empty table gives an empty result.
Positions are code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkquarry.llm.common import text_of

#: The base patterns, in the order of kinds.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORD = re.compile(r"password|passwd|secret|token|api_?key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: How much each word of a name counts; adjacent words may count together.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api key": 3.0, "access key": 3.0, "private key": 3.0,
    "secret key": 3.0, "signing key": 3.0, "encryption key": 3.0, "credential": 2.5, "credentials": 2.5, "auth": 2.0, "authorization": 2.0, "bearer": 2.0, "key": 1.0, "pin": 1.0, "salt": 1.0,
}
THRESHOLD, LEAST_LENGTH = 3.5, 8
OPERATOR = re.compile(r":=|=>|(?<![=!<>])=(?!=)|:(?![:/=])")
#: The name before an operator, read backwards in the reversed text, so that it has no longest length.
NAME_BEFORE = re.compile(r"""[ \t]*\]?(?:(["'])([A-Za-z0-9_.\- ]*[A-Za-z_])\1|([A-Za-z0-9_.$-]*[A-Za-z_$]))""")
#: A literal in quotes (groups 1 to 4: triple ones first), with a prefix as in f"..."; what is in single quotes takes no references.
QUOTED = r"""[fFrRbBuU]{0,2}(?:\"{3}([\s\S]*?)\"{3}|'{3}([\s\S]*?)'{3}|"([^"\\\n]*(?:\\.[^"\\\n]*)*)"|'([^'\\\n]*(?:\\.[^'\\\n]*)*)')"""
VALUE_AFTER = re.compile(rf"[ \t]*(?:{QUOTED}|(\$\{{[A-Za-z_][A-Za-z0-9_]*\}}(?![A-Za-z0-9+/_.=$-])|[A-Za-z0-9+/_.=$-]))")
UNQUOTED = re.compile(r"[A-Za-z0-9+/_.=$-]+")
LIST_AFTER = re.compile(r"[ \t]*[\[(]\s*(?=[fFrRbBuU]{0,2}[\"'])")
MEMBER = re.compile(rf"{QUOTED}\s*(,?)\s*")
BLOCK_AFTER = re.compile(r"[ \t]*[|>][+-]?[ \t]*\n")
LINE = re.compile(r"([ \t]*)([^\n]*)(?:\n|$)")
#: A setter and its first argument.
SETTER = re.compile(rf"(?<![A-Za-z0-9_])(?:set|with|use)_?([A-Za-z0-9_]+)[ \t]*\(\s*{QUOTED}")
#: What joins two literals into one.
JOINED = re.compile(r"[ \t]*(?:\+|\.(?!\.))(?!=)")
REFERENCE = re.compile(r"\$(?:\{([A-Za-z_][A-Za-z0-9_]*)\}|([A-Za-z_][A-Za-z0-9_]*))")
#: `: type =` after a name, with brackets three deep and unions; and, read backwards, `name type` before an operator, with a keyword before it.
_ARGUMENTS = r"[^\[\]<>=:\n]*"
for _ in range(2):
    _ARGUMENTS = rf"[^\[\]<>=:\n]*(?:[\[<]{_ARGUMENTS}[\]>][^\[\]<>=:\n]*)*"
_TYPE = rf"""[&*?]*(?:'[a-z]+[ \t]+)?(?:(?:mut|const)[ \t]+)?["']?[A-Za-z_][A-Za-z0-9_.]*(?:::[A-Za-z0-9_]+)*["']?(?:[\[<]{_ARGUMENTS}[\]>])*[!?*&]*"""
TYPE_AFTER = re.compile(rf"[ \t]*{_TYPE}(?:[ \t]*\|[ \t]*{_TYPE})*[ \t]*(?==(?![=>]))")
TYPED_BEFORE = re.compile(r"[ \t]*([A-Za-z0-9_.]*[A-Za-z_])[*&\[\]]*[ \t]+([A-Za-z0-9_$]*[A-Za-z_$])([ \t]+(?:rav|tsnoc)(?![A-Za-z0-9_]))?")
PLAIN_TYPES = frozenset({"string", "str", "byte", "rune", "char", "any", "text", "varchar"})
IDENTIFIER = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*")
NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: Words of values that are none; so is a `<` with a `>` somewhere behind it.
PLACEHOLDER = re.compile(r"(?i)change_?me|example|placeholder|your[_-]|xxxx|\*\*\*|\$\{")
PLACEHOLDER_STARTS = re.compile(rf"(?=(?:{PLACEHOLDER.pattern[4:]}))", re.IGNORECASE)
#: One character less than the longest of these words.
BORDER = 10


def base_spans(text: str, lowered: str | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and kind."""
    lowered = text.lower() if lowered is None else lowered
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if KEYWORD.search(lowered) else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def name_score(name: str) -> float:
    words = [w.lower() for w in NAME_WORDS.findall(name)]
    words = [w[:-1] if w.endswith("s") and w[:-1] in SENSITIVE else w for w in words]
    return max([SENSITIVE.get(w, 0.0) for w in words] + [SENSITIVE.get(f"{a} {b}", 0.0) for a, b in zip(words, words[1:])], default=0.0)


@dataclass(slots=True)
class Traits:
    """What a value's score depends on. Counts are floats, as a value may be joined to itself without end; head and tail are its first and last BORDER characters."""

    counts: dict[str, float]
    placeholder: bool
    opens: bool
    closes: bool
    head: str
    tail: str

    @classmethod
    def of(cls, text: str) -> Traits:
        opens = text.find("<")
        held = bool(PLACEHOLDER.search(text)) or (opens >= 0 and text.find(">", opens) >= 0)
        return cls({c: float(n) for c, n in Counter(text).items()}, held, opens >= 0, ">" in text, text[:BORDER], text[-BORDER:])

    def __add__(self, other: Traits) -> Traits:
        counts = dict(self.counts)
        for c, n in other.counts.items():
            counts[c] = counts.get(c, 0.0) + n
        if sum(counts.values()) > 1e200:  # only proportions matter from here on
            counts = {c: n / 1e100 for c, n in counts.items()}
        held = self.placeholder or other.placeholder or (self.opens and other.closes) or bool(PLACEHOLDER.search(self.tail + other.head))
        return Traits(counts, held, self.opens or other.opens, self.closes or other.closes, (self.head + other.head)[:BORDER], (self.tail + other.tail)[-BORDER:])

    def score(self) -> float:
        """-10 for short values and placeholders, else up to 2 by entropy per character, and more for mixed classes."""
        n = sum(self.counts.values())
        if n < LEAST_LENGTH or self.placeholder:
            return -10.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values() if c)
        letters = "".join(self.counts)
        mixed = sum(map(bool, (re.search("[a-z]", letters), re.search("[A-Z]", letters), re.search(r"\d", letters), re.search(r"[^A-Za-z0-9]", letters))))
        return min(entropy / 2, 2.0) + 0.25 * (mixed - 1) - (1.0 if " " in self.counts else 0.0)


class Value:
    """A literal of the text (start, end), or the join of two values."""

    __slots__ = ("start", "end", "left", "right", "traits")

    def __init__(self, start: int = 0, end: int = 0, left: Value | None = None, right: Value | None = None, traits: Traits | None = None):
        self.start, self.end, self.left, self.right, self.traits = start, end, left, right, traits

    def known(self, text: str) -> Traits:
        """The traits, made from those of the sides, without recursion: a value may be joined very often."""
        open_values = [self]
        while open_values:
            v = open_values[-1]
            if v.traits is None and v.left is not None:
                lacking = [x for x in (v.left, v.right) if x.traits is None]
                if lacking:
                    open_values += lacking
                    continue
                v.traits = v.left.traits + v.right.traits
            elif v.traits is None:
                v.traits = Traits.of(text[v.start : v.end])
            open_values.pop()
        return self.traits

    def literals(self, seen: set[int]) -> Iterator[tuple[int, int]]:
        """The places of its literals, but for those of values that were seen before."""
        waiting = [self]
        while waiting:
            v = waiting.pop()
            if id(v) in seen:
                continue
            seen.add(id(v))
            if v.left is None:
                yield v.start, v.end
            else:
                waiting += [v.right, v.left]


class Runs:
    """Values without quotes, which may hold further assignments (`a=b=c`). Such a run's values end together and begin one behind the other, so their traits are made by taking away what
    the next one lacks, and every character is counted once."""

    def __init__(self, text: str):
        self.text, self.end, self.at = text, -1, -1
        self.counts: Counter[str] = Counter()
        self.last_placeholder = -1

    def value(self, start: int) -> Value:
        if start >= self.end or start < self.at:
            self.at, self.end = start, UNQUOTED.match(self.text, start).end()
            self.several = self.text.find("=", start, self.end) >= 0
            if self.several:
                self.counts = Counter(self.text[start : self.end])
                self.last_placeholder = max((m.start() for m in PLACEHOLDER_STARTS.finditer(self.text, start, self.end)), default=-1)
        elif self.several:
            for c, n in Counter(self.text[self.at : start]).items():
                self.counts[c] -= n
                if not self.counts[c]:
                    del self.counts[c]
        self.at = start
        if not self.several:
            return Value(start, self.end)
        head, tail = self.text[start : min(start + BORDER, self.end)], self.text[max(start, self.end - BORDER) : self.end]
        return Value(start, self.end, traits=Traits({c: float(n) for c, n in self.counts.items()}, self.last_placeholder >= start, False, False, head, tail))


class Lexer:
    """Reads one text from its start to its end; bound: what each name was last bound to."""

    def __init__(self, text: str):
        self.text, self.bound, self.runs = text, {}, Runs(text)

    def operand(self, at: int) -> tuple[Value, bool, bool, int] | None:
        """The literal or name at a place: its value, whether it came through a name, whether it is a quoted literal, and where it ends."""
        text, after = self.text, VALUE_AFTER.match(self.text, at)
        if not after:
            return None
        group = next(k for k in range(1, 6) if after[k] is not None)
        start, end = after.span(group)
        if group == 5 and end - start == 1:  # the whole run is not part of the pattern, as runs may hold each other
            value = self.runs.value(start)
            end = value.end
            if text[end : end + 1] in ("[", "("):  # called or indexed: code, not a value
                return None
            name = IDENTIFIER.match(text, start)
            source = name[0] if name and name.end() == end and name[0] in self.bound else None
            stop = end
        else:
            value, source, stop = Value(start, end), None, after.end()
        if source is None and group not in (2, 4) and (reference := REFERENCE.match(text, start)) and reference.end() == end:
            source = reference[1] or reference[2]
        if source in self.bound:
            return self.bound[source], True, False, stop
        return value, False, group != 5, stop

    def values(self, at: int) -> list[tuple[Value, bool]]:
        """The values after an operator, and whether each came through a name: the members of a list, or one value with what is joined to it (quoted literals and bound names only)."""
        if opening := LIST_AFTER.match(self.text, at):
            out, place = [], opening.end()
            while member := MEMBER.match(self.text, place):
                start, end = next(member.span(k) for k in range(1, 5) if member[k] is not None)
                out.append((Value(start, end), False))
                place = member.end()
                if not member[5]:
                    break
            return out
        found = self.operand(at)
        if not found:
            return []
        value, through, quoted, place = found
        while (quoted or through) and (plus := JOINED.match(self.text, place)):
            more = self.operand(plus.end())
            if not more or not (more[1] or more[2]):
                break
            value, through, place = Value(left=value, right=more[0]), through or more[1], more[3]
        return [(value, through)]

    def block(self, name_at: int, at: int) -> Value | None:
        """The indented lines of a block behind `name: |`, as one value."""
        opening = BLOCK_AFTER.match(self.text, at)
        if not opening:
            return None
        line_start = self.text.rfind("\n", 0, name_at) + 1
        indent = len(self.text[line_start:name_at]) - len(self.text[line_start:name_at].lstrip(" \t-"))
        value, place = None, opening.end()
        while place < len(self.text):
            line = LINE.match(self.text, place)
            if line[2].strip() and len(line[1]) <= indent:
                break
            if line[2].strip():
                part = Value(line.start(2), line.start(2) + len(line[2].rstrip()))
                value = part if value is None else Value(left=value, right=part)
            place = line.end()
        return value

    def pairs(self) -> Iterator[tuple[str, Value, bool]]:
        """(name, value, whether it came through another name) in order; where a type stands between name and operator, both words are names."""
        text, bound = self.text, self.bound
        typed: dict[int, str] = {}
        backwards = text[::-1]
        for op in OPERATOR.finditer(text):
            at = len(text) - op.start()
            before = NAME_BEFORE.match(backwards, at)
            names = [(before[2] or before[3])[::-1]] if before else []
            if op[0] == ":" and before and (kind := TYPE_AFTER.match(text, op.end())):
                typed[kind.end()] = names[0]
            if op[0] == "=":
                if op.start() in typed:
                    names.append(typed.pop(op.start()))
                elif (go := TYPED_BEFORE.match(backwards, at)) and (go[3] or go[1][::-1] in PLAIN_TYPES):
                    names.append(go[2][::-1])
            if not names:
                continue
            found = self.values(op.end())
            if not found and op[0] == ":" and (block := self.block(len(text) - before.end(), op.end())):
                found = [(block, False)]
            for name in names:
                for value, through in found:
                    bound[name] = bound[name.rsplit(".", 1)[-1]] = value
                    yield name, value, through
        for m in SETTER.finditer(text):
            yield m[1], Value(*next(m.span(k) for k in range(2, 6) if m[k] is not None)), False


def method_spans(text: str) -> list[tuple[int, str, int]]:
    found: dict[tuple[int, int], str] = {}
    seen: set[int] = set()
    held, targets = [], {}
    for name, value, through in Lexer(text).pairs():
        target = targets[name] if name in targets else targets.setdefault(name, name_score(name))
        if target and target + value.known(text).score() >= THRESHOLD:
            held.append(value)  # values are told apart by id(), so they stay
            for part in value.literals(seen):
                found.setdefault(part, "constant" if through else "literal")
    return sorted((start, kind, end) for (start, end), kind in found.items())


def scan(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, str, int]]]:
    return base_spans(text), method_spans(text) if "=" in text or ":" in text or "(" in text else []


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and its spans: array of (kind, start, end), by start, base kinds first."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part, out = batch.slice(lo, 1000), []
                for text in part.column(1).to_pylist():
                    base, more = scan(text)
                    rows = [(s, k, KINDS[k], e) for s, k, e in base] + [(s, 3 if k == "literal" else 4, k, e) for s, k, e in more]
                    out.append([{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(rows)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, spans)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


MASK = "[SECRET]"


def masked(text: str) -> str:
    """The text with every span (overlaps merged) replaced by MASK."""
    base, more = scan(text)
    out, at = [], 0
    for start, end in sorted([(s, e) for s, _, e in base] + [(s, e) for s, _, e in more]):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with their secrets masked and n_chars put right; null texts stay null, all other columns stay as they are."""
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = pa.array([x if x is None else masked(x) for x in part.column(where).to_pylist()], part.schema.field(where).type)
                yield pa.RecordBatch.from_arrays([texts if k == where else part.column(k) for k in range(part.num_columns)], schema=part.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text").cast(docs.schema["n_chars"].dataType), "n_chars")) if "n_chars" in docs.columns else out


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*KINDS))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
