"""Operator 4, licence scans: Aho-Corasick finds phrases and identifier tags, a shunting-yard parser weighs expressions.

A text is lower-cased in A-Z and taken apart into words (everything but ASCII marks and white space). Phrases match as
whole consecutive words; one automaton finds the places of all of them in one pass over the text. After an identifier
tag the rest of the line is read as a licence expression of identifiers, AND, OR, WITH and parentheses.

A null text counts as empty: no words, no labels, score 0. Repeated rows and ties need no rule, as every row stands for
itself. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from podium.llm.common import map_texts

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Phrases that this operator adds, with labels of its own.
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons": "cc",
    "isc license": "isc",
    "all rights reserved": "reserved",
    "public domain": "public-domain",
}
TAG = "spdx license identifier"
#: Obligations of licence families, from none (0) to those that reach network use (4); first match of a prefix counts.
LEVELS = [
    ("cc0", 0), ("unlicense", 0), ("0bsd", 0), ("public-domain", 0), ("mit", 1), ("apache", 1), ("bsd", 1), ("isc", 1),
    ("zlib", 1), ("cc-by-sa", 2), ("cc", 1), ("lgpl", 2), ("mpl", 2), ("epl", 2), ("cddl", 2), ("agpl", 4), ("gpl", 3),
    ("reserved", 4),
]
UNKNOWN_LEVEL = 4
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*")
TAG_LINE = re.compile(r"spdx-license-identifier\s*:?[ \t]*([^\r\n]*)")

# Bytes outside words become spaces and A-Z becomes a-z; bytes of other characters stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def level(identifier: str) -> int:
    return next((n for prefix, n in LEVELS if identifier.startswith(prefix)), UNKNOWN_LEVEL)


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: WITH binds tighter than AND, AND tighter than OR; operators associate to the left."""
    output, waiting = [], []
    operand_next = True
    for token in tokens:
        if token == "(":
            if not operand_next:
                raise ValueError("an operator is missing before (")
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting or operand_next:
                raise ValueError("unbalanced )")
            waiting.pop()
        elif token in PRECEDENCE:
            if operand_next:
                raise ValueError(f"an operand is missing before {token}")
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[token]:
                output.append(waiting.pop())
            waiting.append(token)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError(f"an operator is missing before {token}")
            output.append(token)
            operand_next = False
    if operand_next or "(" in waiting:
        raise ValueError("the expression ends early")
    return output + waiting[::-1]


def evaluate(expression: str) -> tuple[int, list[str]]:
    """Least obligation that meets the expression, and its licence identifiers.

    OR leaves the choice (the smaller level), AND asks for both (the larger), WITH an exception takes one level off.
    """
    stack: list[tuple[int, str]] = []
    identifiers = []
    postfix = to_postfix(TOKEN.findall(expression.lower()))
    exceptions = set()
    for token in postfix:
        if token == "with":
            (_, exception), (base, name) = stack.pop(), stack.pop()
            exceptions.add(exception)
            stack.append((max(base - 1, 0), name))
        elif token in PRECEDENCE:
            (b, name), (a, _) = stack.pop(), stack.pop()
            stack.append((min(a, b) if token == "or" else max(a, b), name))
        else:
            identifiers.append(token)
            stack.append((level(token), token))
    return stack[0][0], sorted(set(identifiers) - exceptions)


def longest_expression(line: str) -> tuple[int, list[str]] | None:
    """The longest start of the line that reads as an expression; what follows is prose."""
    tokens = TOKEN.findall(line.lower())
    end, operand_next, depth, best = 0, True, 0, None
    for end, token in enumerate(tokens, 1):
        if token == "(":
            if not operand_next:
                break
            depth += 1
        elif token == ")":
            if operand_next or depth == 0:
                break
            depth -= 1
        elif token in PRECEDENCE:
            if operand_next:
                break
            operand_next = True
        elif operand_next:
            operand_next = False
        else:
            break
        if depth == 0 and not operand_next:
            best = end
    return evaluate(" ".join(tokens[:best])) if best else None


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", (phrase, len(phrase) + 2))
    found.make_automaton()
    return found


def scanner():
    search = automaton()

    def scan(text: str):
        words = words_of(text)
        # one character for each byte, so that places are byte places
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        n_base, first, last, base, labels, obligations, tagged = 0, None, None, set(), set(), [], False
        at, word = 0, 0
        places = []
        for end, (phrase, size) in search.iter(line):
            places.append((end - size + 1, phrase))
        for start, phrase in sorted(places):
            word += line.count(" ", at, start)
            at = start
            if phrase in BASE:
                n_base += 1
                first = word if first is None else first
                last = word
                base.add(BASE[phrase])
                obligations.append(level(BASE[phrase]))
            elif phrase in NOTICES:
                labels.add(NOTICES[phrase])
                obligations.append(level(NOTICES[phrase]))
            else:
                tagged = True
        if tagged:
            for match in TAG_LINE.finditer(text.lower()):
                if value := longest_expression(match[1]):
                    obligations.append(value[0])
                    labels.update(f"spdx:{name}" for name in value[1])
        score = max(obligations) / UNKNOWN_LEVEL * 0.5 + 0.5 if obligations else 0.0
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), score

    return scan


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    score: 0 without licence text; else 0.5 for licences without obligations up to 1 for the strictest found.
    """
    return map_texts(
        docs,
        scanner,
        [
            ("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"),
            ("base_labels", "string"), ("labels", "string"), ("score", "double"),
        ],
    )
