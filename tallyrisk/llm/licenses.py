"""License scan: an Aho-Corasick automaton finds notice phrases and identifier tags in one pass over
a text's words, and a shunting-yard parser evaluates the licence expression behind each tag.

Words are runs of letters a-z, digits and non-ASCII characters after A-Z are lower-cased; a phrase matches
where its words stand consecutively, whatever separates them. ``score`` is 1 for a text with a readable
tag expression, else 1 - 2^-n for n phrase places.

Defined cases: a null or empty text has no words, no places, empty labels, score 0, null positions; an
expression that cannot be parsed gives no label; an unknown identifier is its own label; repeated rows
are scanned each; further columns are ignored.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame, functions as F, types as T

from tallyrisk.llm.common import PerWorker, field_type, map_arrow

# Phrases that count as base places, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Further notices and the label each stands for.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"

# Identifiers, whole or as the beginning before a hyphen; the label and whether its terms are permissive.
FAMILIES = [
    ("apache", "apache", True),
    ("agpl", "agpl", False),
    ("lgpl", "lgpl", False),
    ("gpl", "gpl", False),
    ("bsd", "bsd", True),
    ("mpl", "mpl", False),
    ("epl", "epl", False),
    ("bsl", "bsl", True),
    ("cc0", "cc0", True),
    ("cc-by", "cc-by", True),
    ("mit", "mit", True),
    ("isc", "isc", True),
    ("unlicense", "unlicense", True),
]

_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PARTS = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> tuple[str, bool]:
    low = identifier.lower()
    for start, label, free in FAMILIES:
        if low == start or low.startswith(f"{start}-"):
            return label, free
    return low, False


def to_postfix(expression: str) -> list[str] | None:
    """Operands and operators in postfix order (``with`` binds closest, then ``and``, then ``or``); None if the
    text is no expression. Text after a complete expression is left out, as in a comment's rest."""
    out: list[str] = []
    held: list[str] = []
    operand_next, depth = True, 0
    for part in _PARTS.findall(expression):
        low = part.lower()
        if operand_next:
            if part == "(":
                held.append(part)
                depth += 1
            elif part == ")" or low in _RANK:
                return None
            else:
                out.append(part)
                operand_next = False
        elif low in _RANK:
            while held and held[-1] != "(" and _RANK[held[-1]] >= _RANK[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        elif part == ")" and depth:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            depth -= 1
        else:
            break
    if operand_next or depth:
        return None
    return out + held[::-1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool] | None:
    """The labels of an expression, and whether it can be used under permissive terms: ``or`` needs one
    side, ``and`` both; ``with`` takes the licence's own, the exception grants more."""
    stack: list[tuple[set[str], bool]] = []
    for part in postfix:
        if part in _RANK:
            if len(stack) < 2:
                return None
            (right, free_r), (left, free_l) = stack.pop(), stack.pop()
            if part == "with":
                stack.append((left, free_l))
            else:
                stack.append((left | right, free_l or free_r if part == "or" else free_l and free_r))
        else:
            label, free = family(part)
            stack.append(({label}, free))
    return stack[0] if len(stack) == 1 else None


def build_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            automaton.add_word(f" {phrase} ", (kind, label, len(phrase) + 1))
    automaton.make_automaton()
    return automaton


def tag_expressions(data: bytes, starts: list[int]) -> list[str]:
    """What follows the tag whose first word has the given number: the rest of its line."""
    spans = [m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data)]
    found = []
    for start in starts:
        line = data[spans[start + len(TAG.split()) - 1][1] :].split(b"\n", 1)[0]
        if line.lstrip()[:1] == b":":
            found.append(line.lstrip()[1:].decode("utf-8", "replace").strip())
    return found


def scan(text: str, automaton: ahocorasick.Automaton) -> dict:
    data = text.encode("utf-8")
    words = data.translate(_CLEAN).split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    base: list[int] = []
    labels: set[str] = set()
    base_labels: set[str] = set()
    notices, tags = 0, []
    at = word = 0
    for end, (kind, label, length) in sorted(automaton.iter(joined), key=lambda x: x[0] - x[1][2]):
        start = end - length  # of the space before the phrase
        word += joined.count(" ", at, start)
        at = start
        if kind == "base":
            base.append(word)
            base_labels.add(label)
        elif kind == "notice":
            notices += 1
            labels.add(label)
        else:
            tags.append(word)
    expressions, permissive = [], None
    for expression in tag_expressions(data, tags) if tags else ():
        postfix = to_postfix(expression)
        value = evaluate(postfix) if postfix else None
        if value:
            expressions.append(expression)
            labels |= value[0]
            permissive = value[1] if permissive is None else permissive and value[1]
    score = 1.0 if expressions else 1.0 - 0.5 ** (len(base) + notices)
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": base[0] if base else None,
        "last_word": base[-1] if base else None,
        "base_labels": ",".join(sorted(base_labels)),
        "labels": ",".join(sorted(labels | base_labels)),
        "score": score,
        "expressions": expressions,
        "permissive": permissive,
    }


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: number of words, base places with first and last start, labels, score, the tag
    expressions that were read, and whether they all allow permissive use (null without any). No shuffle."""
    shared = PerWorker(docs.sparkSession, None, lambda _: build_automaton())

    def run(batch):
        automaton = shared.get()
        rows = [scan(x or "", automaton) for x in batch.column(1).to_pylist()]
        return {"doc_id": batch.column(0), **{f.name: [r[f.name] for r in rows] for f in schema.fields[1:]}}

    schema = T.StructType([
        T.StructField("doc_id", field_type(docs, doc_id)),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("expressions", T.ArrayType(T.StringType())),
        T.StructField("permissive", T.BooleanType()),
    ])
    return map_arrow(docs.select(F.col(doc_id), F.col(text)), run, schema)
