"""Line-first cleaning: rules judge lines, failing lines go, and documents that lose too much go."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trackframe.llm.storage import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
_MARKS = re.compile(r"[!?]{2,}|\.{4,}|…{2,}")
_CODE = re.compile(r"[{}]|</?\w[^<>]*+>|\bfunction\s*\(|\bvar\s+\w+\s*=")
_MENU = re.compile(r"(?:^|\s)(?:\||›|»|·|/|>)(?=\s|$)")
_BOILERPLATE = re.compile(
    r"all rights reserved|copyright (?:\(c\)|©|\d{4})|©\s*\d{4}|terms of (?:use|service)|privacy policy|cookie policy|(?:uses?|accept) cookies"
    r"|licensed under|released under the .{1,40} licen[cs]e|subscribe to our|sign up for our|click here|enable javascript|lorem ipsum|powered by \w+"
    r"|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|newsletter abonnieren|hier klicken"
    r"|tous droits réservés|conditions d['’]utilisation|politique de confidentialité|mentions légales|cliquez ici"
    r"|todos los derechos reservados|términos (?:de uso|del servicio)|política de (?:privacidad|cookies)|aviso legal|haga clic aquí"
)
#: The end of a sentence, perhaps quoted.
_ENDS = (".", "!", "?", "…", ":", ";", '."', '!"', '?"', ".»", ".”", ".)")
#: What a lower-cased text holds if a rule's pattern can match in it; texts without any of it are not searched.
_HINTS = {
    "marks": ("!!", "??", "!?", "?!", "....", "……"),
    "code": ("{", "}", "<", "function", "var"),
    "menu": ("|", "›", "»", "·", "/", ">"),
    "boilerplate": ("rights reserved", "copyright", "©", "terms of", "policy", "cookies", "licensed under", "released under", "subscribe to", "sign up", "click here", "javascript", "lorem", "powered by",
        "rechte", "nutzungs", "datenschutz", "newsletter", "hier klicken", "droits", "utilisation", "confidentialité", "mentions", "cliquez", "derechos", "términos", "política", "aviso", "haga clic"),
}


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document's verdict."""

    max_symbols: float = 0.05  # of a line's characters
    max_marks: float = 0.2  # runs of exclamation and question marks a word
    max_capitals: float = 0.7  # of the words of a line of five words or more
    max_stutter: float = 0.5  # words of a line of five words or more that repeat the word before
    max_separators: int = 2  # menu separators that stand alone
    menu_lines: int = 4  # lines in a row of at most two words without an end mark make a menu
    boilerplate_words: int = 40  # longer lines are prose that happens to hold such a phrase
    max_lost: float = 0.4  # of a document's word characters
    min_words: int = 20
    max_repeated_percent: int = 30
    window: int = 8


def hints(text: str) -> frozenset[str]:
    """The rules whose patterns may match somewhere in a text."""
    low = text.lower()
    found = {rule for rule, some in _HINTS.items() if any(x in low for x in some)}
    return frozenset(found | {"symbols"} if any(x in text for x in SYMBOLS) else found)


def line_fault(line: str, words: list[bytes], rules: Rules, may: frozenset[str]) -> str | None:
    """The first rule that a line with a word fails: punctuation, repeated, navigation, boilerplate or None."""
    n = len(words)
    menu = len(_MENU.findall(line)) > rules.max_separators if "menu" in may else False
    if "symbols" in may and sum(map(line.count, SYMBOLS)) > rules.max_symbols * word_chars(line):
        return "navigation" if menu else "punctuation"
    if n >= 3 and "marks" in may and len(_MARKS.findall(line)) > rules.max_marks * n:
        return "punctuation"
    if n >= 5:
        if sum(map(str.isupper, b" ".join(words).decode("utf-8", "surrogatepass").split(" "))) > rules.max_capitals * n:
            return "punctuation"
        if sum(map(bytes.__eq__, words, words[1:])) > rules.max_stutter * n:
            return "repeated"
    if menu or ("code" in may and _CODE.search(line)):
        return "navigation"
    if n <= rules.boilerplate_words and "boilerplate" in may and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return None


def menu_lines(lines: list[str], rules: Rules) -> set[int]:
    """The places of lines that stand in a row of short ones without an end mark; lines without a word do not break a row."""
    found: set[int] = set()
    row: list[int] = []
    for at, line in enumerate([*lines, "."]):
        if len(line) <= 60 and not (own := line.strip(BLANKS)):
            continue
        if len(line) <= 60 and len(WORD.findall(own)) <= 2 and not own.endswith(_ENDS):
            row.append(at)
            continue
        if len(row) >= rules.menu_lines:
            found.update(row)
        row = []
    return found


def word_chars(text: str) -> int:
    """Code points that are not blanks."""
    return len(text) - sum(map(text.count, BLANKS))


def repeated_words(words: list[bytes], width: int) -> int:
    """Words within windows of ``width`` words that occur twice or more, the first ones included.

    Windows whose rolled hashes all differ all differ; only else they are
    compared themselves.
    """
    if len(words) <= width:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    count = len(words) - width + 1
    rolled = np.zeros(count, np.uint64)
    for k in range(width):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    if len(np.unique(rolled)) == count:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    times = Counter(windows)
    total, covered = 0, 0
    for at, window in enumerate(windows):
        if times[window] > 1:
            total += at + width - max(at, covered)
            covered = at + width
    return total


def judge(text: str | None, rules: Rules) -> dict:
    """All figures of one text, its verdict and what is left of it."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes are split at the six ASCII blanks alone
    may = hints(text)
    seen: set[str] = set()
    duplicates = lost = 0
    left, why = [], []
    lines = text.split("\n")
    menu = menu_lines(lines, rules) if len(lines) >= rules.menu_lines else ()
    for at, line in enumerate(lines):
        own = line.encode("utf-8", "surrogatepass").split()
        if not own:
            left.append(line)
            continue
        again = line in seen
        duplicates += again
        seen.add(line)
        fault = "repeated" if again else "navigation" if at in menu else line_fault(line, own, rules, may)
        if fault is None:
            left.append(line)
        else:
            why.append(fault)
            lost += word_chars(line)
    size = word_chars(text)
    repeats = repeated_words(words, rules.window)
    base = len(words) < rules.min_words or 100 * repeats > rules.max_repeated_percent * len(words)
    return {
        "n_words": len(words),
        "word_chars": size,
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": duplicates,
        "n_repeat_words": repeats,
        "base_failed": base,
        "kept": not base and lost <= rules.max_lost * size,
        "lost_chars": lost,
        "line_faults": why,
        "cleaned": "\n".join(left) if why else text,
    }


FIGURES = pa.schema(
    [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64())]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64()), ("line_faults", pa.list_(pa.string())), ("cleaned", pa.string())]
)
FIGURES_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "lost_chars long, line_faults array<string>, cleaned string"
)


def figures(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """documents -> (doc_id, figures, verdict, cleaned text), a row for each row.

    ``cleaned`` is the text without the lines that fail; lines without a word
    stay.  ``kept`` is false for texts under ``min_words`` words, with too many
    repeated windows, or that lose more than ``max_lost`` of their word
    characters.  Null and empty texts have zeros and are not kept.  A doc_id
    may be null or repeated; each row is judged by itself, in one pass without
    a shuffle.  Texts of any length are judged whole, in time that grows with
    their length; an empty table gives an empty one, and further columns are
    not looked at.
    """

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            own = pa.RecordBatch.from_pylist([judge(t, rules) for t in some.column(1).to_pylist()], schema=FIGURES)
            yield pa.RecordBatch.from_arrays([some.column(0), *own.columns], names=["doc_id", *FIGURES.names])

    return docs.select("doc_id", "text").mapInArrow(judged, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIGURES_DDL}")


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with cleaned texts; all columns stay.

    ``n_chars``, where there is such a column, is counted anew.  Columns of
    any other name, ``cleaned`` or ``kept`` among them, pass through.
    """
    at = docs.columns.index("text")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches):
            found = [judge(t, rules) for t in some.column(at).to_pylist()]
            columns = list(some.columns)
            columns[at] = pa.array([f["cleaned"] for f in found], columns[at].type)
            if "n_chars" in some.schema.names:
                k = some.schema.names.index("n_chars")
                columns[k] = pa.array([len(f["cleaned"]) for f in found], pa.int64()).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=some.schema).filter(pa.array([f["kept"] for f in found], pa.bool_()))

    return docs.mapInArrow(cleaned, docs.schema)
