"""Licence scans: one Aho-Corasick automaton finds notice phrases and identifier tags in the words of a text, and a shunting-yard parser evaluates the expression after a tag.

Words are lower-cased runs of ASCII digits, letters and all beyond ASCII; phrases are sought in the words set apart by single blanks, so a hit is always of whole words. BASE phrases count
wherever they stand. The method adds to them: NOTICES, which name further licences or stand for one without its name; the version that follows a phrase
(a number after ``version`` or ``v``, or at once for the families in NUMBERED); and the identifiers of expressions after TAGS.

An expression is read from the text itself up to the end of its line: identifiers, ``and``, ``or``, ``with`` and parentheses. ``with`` binds closest, then ``and``, then ``or``. It ends at the
first token that does not fit; an operator left without its right side goes, open parentheses are closed. After a SPDX tag any identifier counts, after another tag only a known one, as prose
follows these too. Its value says whether one may use the text under permissive terms alone: ``or`` asks for one side, ``and`` for both, and an exception after ``with`` makes its
licence permissive if it is one for linking.

score joins independent evidence: 1 less the product of what each label's best evidence leaves open.

Defined cases: null and empty texts have no words, labels or places (null), and score 0; rows with a null doc_id are scanned too, repeated rows each; an empty table gives no rows; other columns are
ignored. Texts are read whole, whatever their length, one at a time; hits overlap freely, but a notice inside a longer one does not count beside it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

#: The phrases that count as base, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases of licences, with the label of each.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "this program is free software you can redistribute it and or modify": "gpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "european union public licence": "eupl",
    "artistic license": "artistic",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution non commercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
}
#: Tags that an expression follows; the first takes any identifier.
TAGS = ("spdx license identifier", "license expression", "license", "licence", "licensed under", "released under", "licenses")
#: Families whose version follows without a word between.
NUMBERED = ("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "cc0", "gpl", "lgpl", "agpl", "mpl")
#: Identifiers known without a SPDX tag: these, with a version or an ending after a hyphen.
KNOWN = ("mit", "apache", "gpl", "lgpl", "agpl", "bsd", "isc", "mpl", "epl", "bsl", "zlib", "unlicense", "cc0", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "artistic", "eupl", "gfdl", "0bsd", "wtfpl", "python", "psf", "postgresql", "unicode", "openssl", "ofl")
PERMISSIVE = ("mit", "apache", "bsd", "isc", "bsl", "zlib", "unlicense", "cc0", "cc-by", "0bsd", "wtfpl", "python", "psf", "postgresql", "unicode", "openssl", "artistic")
LINKING = ("classpath-exception", "gcc-exception", "llvm-exception", "linking-exception", "openjdk-assembly-exception", "bison-exception", "font-exception")
#: How much a label is believed by its best evidence: a base phrase, a notice, a phrase with its version, an expression.
BELIEF = {"base": 0.6, "notice": 0.7, "version": 0.8, "expression": 0.95}

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BETWEEN = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
VERSION = re.compile(r"(?:(version |v )|(v))?([0-9]{1,2})(?: ([0-9]{1,2}))? ")
TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+:-]*))")
ONSET = re.compile(r"[ \t:=\"'`>]*")
RANK = {"or": 1, "and": 2, "with": 3}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean, "
    "expressions array<struct<word: long, expression: string, permissive: boolean>>, notices array<struct<word: long, label: string, evidence: string>>"
)


@functools.cache
def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    found: dict[str, list[tuple[str, str]]] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label))
    for phrase, label in NOTICES.items():
        found.setdefault(phrase, []).append(("notice", label))
    for tag in TAGS:
        found.setdefault(tag, []).append(("tag", tag))
    for phrase, means in found.items():
        a.add_word(f" {phrase} ", (phrase, means))
    a.make_automaton()
    return a


def family(identifier: str) -> str | None:
    """The longest of KNOWN that an identifier is, or begins with before a hyphen."""
    low = identifier.lower().rstrip("+")
    return max((k for k in KNOWN if low == k or low.startswith(f"{k}-")), key=len, default=None)


def postfix(tokens: list[str]) -> list[str]:
    """The tokens of the longest beginning that is an expression, operators after their operands (shunting-yard). Open parentheses are closed, an operator without a right side goes."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # what is awaited
    for token in tokens:
        op = token.lower()
        if operand:
            if token == "(":
                held.append(token)
            elif op in RANK or token == ")":
                break
            else:
                out.append(token)
                operand = False
        elif op in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[op]:
                out.append(held.pop())
            held.append(op)
            operand = True
        elif token == ")":
            if "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
    if operand:  # what is held back to the last operand waits for one that never came
        while held and held[-1] == "(":
            held.pop()
        if held:
            held.pop()
    return out + [op for op in reversed(held) if op != "("]


def evaluated(rpn: list[str]) -> tuple[str, set[str], bool] | None:
    """(the expression in full parentheses, its licences, whether it can be used under permissive terms alone)."""
    stack: list[tuple[str, set[str], bool]] = []
    for token in rpn:
        if token in RANK:
            if len(stack) < 2:
                return None
            (b, b_ids, b_free), (a, a_ids, a_free) = stack.pop(), stack.pop()
            free = {"or": a_free or b_free, "and": a_free and b_free, "with": a_free or any(b.startswith(x) for x in LINKING)}[token]
            stack.append((f"({a} {token} {b})", a_ids if token == "with" else a_ids | b_ids, free))
        else:
            low = token.lower()
            stack.append((low, {low}, family(low) in PERMISSIVE))
    return stack[0] if len(stack) == 1 else None


def expression(text: str, at: int, any_identifier: bool) -> tuple[str, set[str], bool] | None:
    """The value of the expression that begins at a place in a text, or None."""
    stop = text.find("\n", at)
    stop = len(text) if stop < 0 else stop
    at, tokens = ONSET.match(text, at, stop).end(), []
    while (m := TOKEN.match(text, at, stop)) and len(m[0]):
        token = m[1] or m[2].rstrip(".:-")
        if token not in ("(", ")") and token.lower() not in RANK and not any_identifier and not family(token) and not (tokens and tokens[-1].lower() == "with"):
            break
        if not token:
            break
        # two operands in a row end it, and so does the end of a sentence
        if tokens and m[2] and token.lower() not in RANK and tokens[-1].lower() not in RANK and tokens[-1] != "(":
            break
        tokens.append(token)
        at = m.end()
        if m[2] and m[2] != token:
            break
    return evaluated(rpn) if (rpn := postfix(tokens)) else None


def scan_text(text: bytes) -> tuple:
    """The row of a text, without its id: see SCHEMA."""
    low = text.translate(LOWER)
    words = BETWEEN.sub(b" ", low).strip(b" ")
    n_words = words.count(b" ") + 1 if words else 0
    norm = f" {words.decode()} "
    hits = sorted((end - len(phrase) - 1, -len(phrase), phrase, means) for end, (phrase, means) in automaton().iter(norm)) if words else []
    base, notes, tags = [], [], []
    belief: dict[str, float] = {}
    seen, counted, reach = 0, 0, -1

    def believed(label: str, evidence: str) -> None:
        belief[label] = max(belief.get(label, 0.0), BELIEF[evidence])

    for start, length, phrase, means in hits:
        seen += norm.count(" ", counted, start)  # blanks before the one the hit begins with
        counted = start
        inside = start - length <= reach
        for kind, label in means:
            if kind == "tag":
                tags.append((seen + phrase.count(" "), label, seen))
                continue
            if kind == "base":
                base.append((seen, label))
                believed(label, "base")
            if kind == "notice" and inside:
                continue
            after = VERSION.match(norm, start - length + 2)
            full = label
            if after and (after[1] or after[2] or label in NUMBERED) and not (kind == "base" and inside):
                full = f"{label}-{after[3]}.{after[4] or 0}"
                notes.append((seen, full, "version"))
                believed(full, "version")
            elif kind == "notice":
                notes.append((seen, full, "notice"))
                believed(full, "notice")
        if any(kind == "notice" for kind, _ in means):
            reach = max(reach, start - length)
    read = []
    if tags:
        original, ends, done, runs = text.decode(), {}, 0, WORD.finditer(low.decode())
        for k in sorted({t[0] for t in tags}):  # where the last word of each tag ends
            ends[k] = next(islice(runs, k - done, None)).end()
            done = k + 1
        at_end: dict[int, tuple] = {}
        for k, tag, first in tags:  # of tags that end alike the longest one counts
            if k not in at_end or len(tag) > len(at_end[k][0]):
                at_end[k] = (tag, first)
        for k, (tag, first) in sorted(at_end.items()):
            if value := expression(original, ends[k], tag == TAGS[0]):
                read.append((first, value[0], value[2]))
                for label in value[1]:
                    believed(label, "expression")
    open_ = 1.0
    for label in sorted(belief):
        open_ *= 1.0 - belief[label]
    firsts = [p for p, _ in base]
    return (
        n_words, len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(belief)),
        round(1.0 - open_, 6), any(x[2] for x in read) if read else None, [dict(zip(("word", "expression", "permissive"), x)) for x in read], [dict(zip(("word", "label", "evidence"), x)) for x in notes],
    )


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as rows of SCHEMA: places of base phrases, labels, expressions after tags with their value, and notices."""
    names = [c.strip().split(" ")[0] for c in re.sub(r"<.*?>>", "", SCHEMA).split(",")]
    long, text = pa.int64(), pa.string()
    types = [
        long, long, long, long, long, text, text, pa.float64(), pa.bool_(), pa.list_(pa.struct([("word", long), ("expression", text), ("permissive", pa.bool_())])),
        pa.list_(pa.struct([("word", long), ("label", text), ("evidence", text)])),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(raw.to_pybytes() if (raw := t.as_buffer()) is not None else b"") for t in batch.column("text")]
            cols = list(zip(*rows)) if rows else [()] * (len(types) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, types[1:])]], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), SCHEMA)
