"""Secret scans over a trigram inverted index.

From every rule's pattern a Boolean query over trigrams is derived: an AND of
clauses, each an OR of alternatives, each an AND of trigrams that a match must
hold.  Every partition of the documents is indexed in segments (bounded runs
of rows): for each trigram that some query names, the postings are the rows
of the segment that hold it.  Postings are intersected and united as the
query says, and the pattern runs over the candidates only.  Rules without a
mandatory trigram scan every row.  Segments need no shuffle, as the index of a
document lies where its text lies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser as P

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Clause = frozenset[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, of which ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The first three are the base kinds; the order is that of kinds with the same start.  Possessive repeats and what may not
#: come before keep the time of a search in proportion to the text, whatever it holds.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++", 0, 30),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1),
    Rule("login", r"(?<![a-z0-9+])[a-z][a-z0-9+]*+://[A-Za-z0-9._-]++:[^\s@:/]++@[A-Za-z0-9.-]++", 0, 12),
)
BASE = ("assign", "access", "hex")
_MOST = 64


def _strings(parsed) -> set[str] | None:
    """All strings (lower-cased) that a part of a pattern can match, if they are few."""
    out = {""}
    for op, value in parsed:
        if op is C.LITERAL:
            own = {chr(value).lower()}
        elif op is C.IN:
            own = set()
            for kind, x in value:
                if kind is C.LITERAL:
                    own.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < 8:
                    own |= {chr(k).lower() for k in range(x[0], x[1] + 1)}
                else:
                    return None
        elif op is C.SUBPATTERN:
            own = _strings(value[3])
        elif op is C.BRANCH:
            parts = [_strings(p) for p in value[1]]
            own = None if None in parts else set().union(*parts)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[1] <= 2 and (one := _strings(value[2])) is not None:
            own = set().union(*({"".join(x) for x in product(one, repeat=k)} for k in range(value[0], value[1] + 1)))
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            own = {""}
        else:
            return None
        if own is None or len(out) * len(own) > _MOST:
            return None
        out = {a + b for a, b in product(out, own)}
    return out


def _clause(strings: set[str]) -> list[Clause]:
    alternatives = [frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings]
    return [frozenset(alternatives)] if alternatives and all(alternatives) else []


def _derive(parsed) -> list[Clause]:
    clauses: list[Clause] = []
    run = {""}
    for item in parsed:
        op, value = item
        own = _strings([item])
        if own is not None and len(run) * len(own) <= _MOST:
            run = {a + b for a, b in product(run, own)}
            continue
        clauses += _clause(run)
        run = {""} if own is None else own
        if op is C.SUBPATTERN:
            clauses += _derive(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] >= 1:
            clauses += _derive(value[2])
        elif op is C.BRANCH:
            parts = [_derive(p) for p in value[1]]
            if all(parts):  # one clause of each branch, in whichever one matches
                clauses.append(frozenset().union(*(p[0] for p in parts)))
    return clauses + _clause(run)


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses that the lower-cased text of every match satisfies; empty: no trigram is mandatory."""
    return _derive(P.parse(pattern))


class Segment:
    """The inverted index of a run of texts, over the given trigrams alone."""

    def __init__(self, texts: list[str], trigrams: list[str]):
        lowered = [t.lower() for t in texts]
        self.size = len(texts)
        self.postings = {g: np.array([k for k, t in enumerate(lowered) if g in t], np.int64) for g in trigrams}

    def candidates(self, query: list[Clause]) -> np.ndarray:
        """The rows that satisfy a query."""
        rows = np.arange(self.size)
        for clause in query:
            either = np.empty(0, np.int64)
            for trigrams in clause:
                both = rows
                for g in sorted(trigrams, key=lambda g: len(self.postings[g])):
                    both = np.intersect1d(both, self.postings[g], assume_unique=True)
                    if not len(both):
                        break
                either = np.union1d(either, both)
            rows = either
        return rows


def spans(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches in code points, without those that are too short."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, segment: int = 1024) -> DataFrame:
    """documents -> (doc_id, spans), a row for each row; spans: array of (kind, start, end) by start, then kind.

    Offsets are code points, ends exclusive.  Null and empty texts have no
    span; a text of any length is searched whole, in time proportional to its
    length.  A doc_id may be null or repeated; other columns are not looked
    at.  Spans of different kinds may overlap; an empty table gives an empty
    one.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    search = Search(rules)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, segment):
                some = batch.slice(at, segment)
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in search.found(some.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    name = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scanned, f"doc_id {name}, spans array<struct<kind: string, start: long, end: long>>")


class Search:
    """Rules with their trigram queries."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.plan = [(r, trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted({g for _, q in self.plan for clause in q for a in clause for g in a})

    def found(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """For each text of a segment its spans (kind, start, end) by start, then in the order of the rules."""
        texts = [t or "" for t in texts]
        index = Segment(texts, self.trigrams)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for order, (rule, query) in enumerate(self.plan):
            pattern = re.compile(rule.pattern)
            for k in index.candidates(query).tolist():
                out[k] += [(a, order, b) for a, b in spans(texts[k], rule, pattern)]
        return [[(self.plan[o][0].kind, a, b) for a, o, b in sorted(f)] for f in out]


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[{}]", segment: int = 1024) -> DataFrame:
    """The rows of ``docs`` with every secret in their texts replaced by a mark; all columns stay, null texts stay null."""
    at, search = docs.columns.index("text"), Search(rules)

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, segment):
                some = batch.slice(start, segment)
                texts = some.column(at).to_pylist()
                new = [t if t is None else redact(t, f, mark) for t, f in zip(texts, search.found(texts))]
                columns = list(some.columns)
                columns[at] = pa.array(new, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=some.schema)

    return docs.mapInArrow(cleaned, docs.schema)


def redact(text: str, found: list[tuple[str, int, int]], mark: str = "[{}]") -> str:
    """The text with every span (overlapping ones as one) replaced by the mark of its first kind."""
    out, done = [], 0
    for kind, a, b in found:
        if a >= done:
            out += [text[done:a], mark.format(kind)]
        done = max(done, b)
    return "".join([*out, text[done:]])


def digest(found: str) -> str:
    """Lower-case hexadecimal SHA-256 of a joined list of spans."""
    return hashlib.sha256(found.encode()).hexdigest()
