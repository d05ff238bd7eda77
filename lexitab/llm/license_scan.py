"""Licence scans: Aho-Corasick over words for notices and tags, and a shunting-yard parser for licence expressions.

Expressions come from tags ("SPDX-License-Identifier: MIT OR X") and from what prose says: notices with their versions, joined by
the and, or and with between them, as in "licensed under the Apache License, Version 2.0 or the MIT License".
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexitab.llm._support import arrow_column, ship, utf8_parts

#: Fixed values of the contract.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices whose labels the method adds.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "bsd license": "bsd",
    "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
}
TAG = "spdx license identifier"
#: Identifiers that may be used freely; `+`, case and `-only`/`-or-later` aside.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "cc-by-4.0", "unlicense", "zlib", "bsl-1.0"})
#: Folds A-Z to a-z and everything below 0x80 that is neither letter nor digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAGGED = re.compile(rb"spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier", re.IGNORECASE)
_LEAD = re.compile(rb"^[^0-9a-z\x80-\xff(]*", re.IGNORECASE)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_BINDS = {"or": 1, "and": 2, "with": 3}
#: Words that may stand between two licences of one statement, and how many words may.
_BETWEEN = frozenset("a an any at both either of option terms the this under your licence license licensed".split()) | _BINDS.keys()
BETWEEN = 8


@dataclass(frozen=True)
class Expression:
    """A licence expression in postfix order, its identifiers, and whether a permissive choice satisfies it."""

    postfix: tuple[str, ...]
    identifiers: tuple[str, ...]
    permitted: bool


def parse_expression(text: str, permissive: frozenset[str] = PERMISSIVE) -> Expression | None:
    """Shunting-yard with or < and < with, all from the left; reads the longest valid start; None if there is none.

    `a with e` is permitted as a is, `and` needs both sides, `or` one.
    """
    output: list[str] = []
    operators: list[str] = []
    best: list[str] = []
    operand_next, depth = True, 0
    for token in _TOKEN.findall(text):
        word = token.lower()
        if word in _BINDS:
            if operand_next:
                break
            while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= _BINDS[word]:
                output.append(operators.pop())
            operators.append(word)
            operand_next = True
        elif token == "(":
            if not operand_next:
                break
            operators.append(token)
            depth += 1
        elif token == ")":
            if operand_next or not depth:
                break
            while operators[-1] != "(":
                output.append(operators.pop())
            operators.pop()
            depth -= 1
        else:
            if not operand_next:
                break
            output.append(word)
            operand_next = False
        if not operand_next and not depth:
            best = output + operators[::-1]
    if not best:
        return None
    stack: list[bool] = []
    names: list[str] = []
    for item in best:
        if item not in _BINDS:
            names.append(item)
            stack.append(_family(item) in permissive)
            continue
        right, left = stack.pop(), stack.pop()
        stack.append(left if item == "with" else left and right if item == "and" else left or right)
    exceptions = _exceptions(best)
    return Expression(tuple(best), tuple(dict.fromkeys(n for i, n in enumerate(names) if i not in exceptions)), stack[-1])


def _family(identifier: str) -> str:
    return identifier.rstrip("+").removesuffix("-only").removesuffix("-or-later")


def _exceptions(postfix: list[str]) -> set[int]:
    """Numbers of the operands that stand right of `with`."""
    out: set[int] = set()
    stack: list[int] = []
    n = 0
    for item in postfix:
        if item not in _BINDS:
            stack.append(n)
            n += 1
        else:
            right = stack.pop()
            if item == "with":
                out.add(right)
    return out


@cache
def automaton() -> ahocorasick.Automaton:
    """All phrases between spaces; a value is (kind, label, length)."""
    out = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            out.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    out.make_automaton()
    return out


def tagged_text(rest: bytes) -> str:
    """What a tag says: the rest of its line, given the text from the tag up to the next one."""
    return _LEAD.sub(b"", rest.split(b"\n", 1)[0], count=1).decode("utf-8", "replace")


#: What makes a version a least one.
_LATER = ([b"or", b"later"], [b"or", b"any", b"later", b"version"])


def version_after(words: list[bytes], at: int) -> tuple[str, int]:
    """The version that stands at a word ("version 2 0 or later" gives "2.0+"), empty if there is none, and the word after it."""
    start = at + 1 if words[at : at + 1] in ([b"version"], [b"v"]) else at
    said: list[str] = []
    for word in words[start : start + 2]:
        digits = word[1:] if not said and word.startswith(b"v") else word
        if not digits.isdigit() or len(digits) > 2 - len(said):  # no years and no numbers of what follows
            break
        said.append(digits.decode("ascii"))
    if not said:
        return "", at
    end = start + len(said)
    for later in _LATER:
        if words[end : end + len(later)] == later:
            return ".".join(said) + "+", end + len(later)
    return ".".join(said), end


def statements(words: list[bytes], mentions: list[tuple[int, int, str]]) -> list[str]:
    """Licence expressions of a text's mentions (first word, word after the last, label), the longest first where they overlap."""
    out: list[list[str]] = []
    last = 0
    for start, end, label in sorted(mentions, key=lambda m: (m[0], -m[1])):
        if out and start < last:
            continue
        between = [w.decode("utf-8", "replace") for w in words[last:start]] if out and start - last <= BETWEEN else ["."]
        binds = [w for w in between if w in _BINDS]
        version, after = version_after(words, end)
        name = f"{label}-{version}" if version else label
        if len(binds) == 1 and _BETWEEN.issuperset(between):
            out[-1] += [binds[0], name]
        else:
            out.append([name])
        last = after
    return list(dict.fromkeys(map(" ".join, out)))


def scan(raw: bytes | None) -> dict:
    """What one text (UTF-8, None: empty) holds."""
    words = (raw or b"").translate(_FOLD).split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places, base, labels, others, tagged, found = [], set(), set(), 0, False, []
    for end, (kind, label, size) in automaton().iter(line):
        if kind != "tag":
            found.append((end - size + 1, end, label))
        if kind == "base":
            places.append(end - size + 1)
            base.add(label)
        elif kind == "notice":
            labels.add(label)
            others += 1
        else:
            tagged = True
    expressions = []
    if tagged:
        tags = [m.span() for m in _TAGGED.finditer(raw)]
        ends = [start for start, _ in tags[1:]] + [len(raw)]
        parsed = (parse_expression(tagged_text(raw[a:b])) for (_, a), b in zip(tags, ends))
        expressions = [e for e in parsed if e]
    weight = len(places) + others + 2 * len(expressions)
    if found:
        spaces = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        starts, ends = (np.searchsorted(spaces, [m[i] for m in found]).tolist() for i in (0, 1))
        said = statements(words, [(a, b, label) for a, b, (_, _, label) in zip(starts, ends, found)])
        expressions += [parse_expression(s) for s in said]
    labels.update(i for e in expressions for i in e.identifiers)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": line.count(" ", 0, min(places)) if places else None,
        "last_word": line.count(" ", 0, max(places)) if places else None,
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)),
        "score": 1.0 - 0.5**weight,
        "expressions": [" ".join(e.postfix) for e in expressions],
        "permitted": all(e.permitted for e in expressions) if expressions else None,
    }


_RESULT = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permitted", pa.bool_())])


def scan_documents(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permitted.

    Words are runs of ASCII letters and digits and of bytes above 0x7F, A-Z lower-cased. Null and empty texts have no words,
    no labels and score 0; first_word and last_word are null without a base place. labels adds those of other notices and
    the identifiers in expressions, such as apache-2.0; expressions are in postfix order, tagged ones first, equal statements
    of prose once; permitted says that a permissive choice satisfies each, and is null without one. score is
    1 - 0.5 ** (places and notices + 2 * tagged expressions). Null ids and repeated rows are passed on, other columns ignored. No shuffle.
    """
    ship(df.sparkSession)
    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean"
    scanned = arrow_column("license", lambda texts: pa.array([scan(raw) for raw in utf8_parts(texts)], _RESULT), kind)
    return df.select(F.col(id_column).alias("doc_id"), scanned(F.col(text_column)).alias("s")).select("doc_id", "s.*")
