"""Line-first quality rules.

Every line of a text is judged alone (boilerplate, navigation and punctuation rules),
and so are runs of lines (lists of short lines without an end of sentence, lines that
come again and again in one text); failing lines are removed, and the document is rejected
when too little of its text is left, or when the whole-document base rules fail. But for
a few fixed phrases in four languages the rules look at the form of lines only.

Words are runs of what is not ASCII white space, everywhere.

Edge cases: null or empty text has no words and so fails the base rule; repeated
rows are judged one by one; an empty table gives an empty result; columns of the
input other than doc_id and text are ignored by apply_rules() and kept by clean(). A text's
work and memory follow its own length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import bounded, chunks, doc_columns

SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Fixed phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "licensed under", "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "accept all cookies", "enable javascript",
    "sign up for our newsletter", "subscribe to our", "skip to content", "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "todos los derechos reservados", "política de privacidad", "aceptar cookies",
)
PHRASES = re.compile("|".join(map(re.escape, BOILERPLATE)))
SPACES = "\t\n\x0b\x0c\r "
#: Signs that separate entries of a menu, and signs with which a sentence ends.
SEPARATORS = "|»·›•"
ENDS = '.!?…:;,"»”’)'
LINE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class LineRules:
    """Limits of the line and document rules; shares of words or characters, or numbers of lines and words."""

    separators_per_word: float = 0.2
    shouts_per_word: float = 0.25
    symbols_per_char: float = 0.05
    list_lines: int = 4
    list_words: int = 4
    line_copies: int = 4
    min_kept: float = 0.5
    min_words: int = 50
    max_repeat: float = 0.5

    def fault(self, line: str, words: int) -> str | None:
        """Name of the first rule that a ``line`` of so many words fails by itself, or None."""
        if not words:
            return None
        if PHRASES.search(line.lower()):
            return "boilerplate"
        if sum(map(line.count, SEPARATORS)) > self.separators_per_word * words:
            return "navigation"
        if line.count("!") > self.shouts_per_word * words and words > 2:
            return "punctuation"
        if len(SYMBOLS.findall(line)) > self.symbols_per_char * len(line):
            return "punctuation"
        return None

    def listed(self, line: str, words: int) -> bool:
        """Whether a line could stand in a menu: short, and not ended like a sentence."""
        return 0 < words <= self.list_words and line.rstrip(SPACES)[-1] not in ENDS


def word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in SPACES)


def repeat_words(words: list[bytes]) -> int:
    """Words lying in some 3-word window that the text holds at least twice."""
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen, covered, upto = Counter(grams), 0, 0
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def faults(lines: list[str], counts: list[int], rules: LineRules) -> list[bool]:
    """Which lines fail: by themselves, in a run of ``list_lines`` listed lines, or as one of ``line_copies`` equal ones."""
    out = [rules.fault(line, n) is not None for line, n in zip(lines, counts, strict=True)]
    if len(lines) < min(rules.list_lines, rules.line_copies):
        return out
    again = Counter(line for line, n in zip(lines, counts, strict=True) if n)
    run = 0
    for i, (line, n) in enumerate(zip(lines, counts, strict=True)):
        out[i] |= n > 0 and again[line] >= rules.line_copies
        run = run + 1 if rules.listed(line, n) else 0
        if run >= rules.list_lines:
            out[i - run + 1 : i + 1] = [True] * run if run == rules.list_lines else [*out[i - run + 1 : i], True]
    return out


def judge(text: str, rules: LineRules) -> tuple:
    words = text.encode("utf-8", "replace").split()
    n, chars = len(words), word_chars(text)
    lines = text.split("\n")
    counts = [n] if len(lines) == 1 else [len(LINE_WORDS.findall(x)) for x in lines]
    bad = faults(lines, counts, rules)
    seen: set[str] = set()
    dup, kept, lost, removed = 0, [], 0, 0
    for line, own, gone in zip(lines, counts, bad, strict=True):
        if own:
            dup += line in seen
            seen.add(line)
        if gone:
            lost += word_chars(line)
            removed += 1
        else:
            kept.append(line)
    repeated = repeat_words(words)
    base_failed = n < rules.min_words or repeated > rules.max_repeat * n
    ok = not base_failed and (chars - lost) >= rules.min_kept * chars
    return n, chars, len(SYMBOLS.findall(text)), dup, repeated, removed, lost, base_failed, ok, "\n".join(kept) if removed else text


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_removed_lines long, lost_chars long, base_failed boolean, kept boolean, clean_text string"


def apply_rules(docs: DataFrame, rules: LineRules | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, the counts, base_failed, kept and (``with_text``) clean_text for every row of ``docs``.

    One pass without a shuffle; a document's work and memory follow its own length.
    """
    rules = rules or LineRules()
    names = [x.split()[0] for x in FIELDS.split(", ")][: None if with_text else -1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            rows = [judge(t, rules) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True))[: len(names)]
            kinds = [pa.int64()] * 7 + [pa.bool_()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], ["doc_id", *names])

    fields = FIELDS if with_text else FIELDS.rpartition(", ")[0]
    return doc_columns(docs).mapInArrow(run, f"doc_id long, {fields}")


def clean(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """The kept documents with their failing lines removed; other columns as they were.

    Rows are cleaned in place, so repeated doc_ids and ties need no join.
    """
    rules = rules or LineRules()
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            out = [judge(t or "", rules) for t in b.column(at).to_pylist()]
            keep = pa.array([r[-2] for r in out], pa.bool_())
            cols = list(b.columns)
            cols[at] = pa.array([r[-1] for r in out], b.schema.field(at).type)
            if size is not None:
                cols[size] = pa.array([len(r[-1]) for r in out], b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(keep)

    return bounded(docs).withColumn("text", F.coalesce("text", F.lit(""))).mapInArrow(run, docs.schema)
