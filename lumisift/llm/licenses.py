"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags; tagged expressions are parsed by a shunting-yard.

Words are runs of ASCII letters and digits and of all bytes from 0x80 on, A-Z lower-cased. A phrase
is found where its words stand consecutively, whatever lies between them.
"""

from __future__ import annotations

import re
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumisift.llm.common import arrow_schema, extended, fresh, lean

# The base phrases and the labels they stand for.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases of further licences; the word "licensed" or "license" is part of most of them.
NOTICE_PHRASES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "boost",
    "unlicense org": "unlicense",
    "creative commons": "cc",
    "licensed under cc by": "cc-by",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under cc by nd": "cc-by-nd",
    "licensed under cc0": "cc0",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
# Families of identifiers, longest first where one begins another.
FAMILIES = {"mit": "mit", "apache": "apache", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "bsd": "bsd", "isc": "isc", "mpl": "mpl", "epl": "epl", "bsl": "boost", "unlicense": "unlicense", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by", "cc0": "cc0"}

# Identifiers that stand for themselves though they have no version; others do if they have one, or begin with LicenseRef-.
NAMES = {"0bsd", "artistic", "beerware", "curl", "ftl", "icu", "ijg", "libpng", "ncsa", "ofl", "openssl", "php", "postgresql", "python", "ruby", "sleepycat", "vim", "wtfpl", "x11", "zlib"}
#: An expression with more choices than this keeps its operators.
MOST_CHOICES = 64

_WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b < 128 else 127 for b in range(256))
_REST_OF_LINE = re.compile(rb"[\x20\t]*:[\x20\t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_OTHER = re.compile(r"licenseref-[a-z0-9.-]+|[a-z][a-z0-9.]*(-[a-z0-9.]+)*-[0-9][a-z0-9.-]*\+?")
_BINDING = {"or": 1, "and": 2, "with": 3}


def family(identifier: str) -> str | None:
    """The label of a licence identifier such as Apache-2.0 or GPL-3.0-or-later: that of its family, or itself in lower case if it
    looks like one; None for anything else."""
    low = identifier.lower()
    known = next((label for start, label in FAMILIES.items() if low == start or low.startswith((start + "-", start + "+"))), None)
    return known or (low if low in NAMES or _OTHER.fullmatch(low) else None)


def to_postfix(expression: str) -> list[str] | None:
    """The expression's leading well-formed part in postfix order; None if there is none.

    Tokens that follow a complete expression without an operator end it, so comment marks or prose
    after the expression do no harm.
    """
    out, stack, operand = [], [], False
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if low in _BINDING:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _BINDING[stack[-1]] >= _BINDING[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif token == "(":
            if operand:
                break
            stack.append(token)
        elif token == ")":
            if not operand or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                break
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def absorbed(choices: set[frozenset[str]]) -> set[frozenset[str]]:
    """The choices without those that ask for all of another one and more."""
    least: list[frozenset[str]] = []
    for c in sorted(choices, key=len):
        if not any(x <= c for x in least):
            least.append(c)
    return set(least)


def expression_choices(expression: str) -> set[frozenset[str]] | None:
    """The least sets of labels any one of which fulfils the expression; empty if it can't be parsed or names no known licence,
    None if there are more than MOST_CHOICES on the way."""
    stack: list[set[frozenset[str]]] = []
    for token in to_postfix(expression) or ():
        if token in _BINDING:
            right, left = stack.pop(), stack.pop()
            # an exception after `with` changes terms, not the licence; what is not known asks for nothing
            found = left if token == "with" or not right - {frozenset()} else right if not left - {frozenset()} else left | right if token == "or" else {a | b for a in left for b in right}
            stack.append(absorbed(found))
            if len(stack[-1]) > MOST_CHOICES:
                return None
        else:
            stack.append({frozenset(x for x in [family(token)] if x)})
    return {c for c in (stack[0] if stack else ()) if c}


def normal_form(expression: str) -> tuple[str, int]:
    """An expression evaluated, labels of a choice joined by '+' and choices by '|', and the number of choices. One with
    too many keeps its operators, behind its labels in postfix order, and counts as MOST_CHOICES."""
    choices = expression_choices(expression)
    if choices is None:
        return " ".join(t if t in _BINDING else family(t) or "?" for t in to_postfix(expression) or ()), MOST_CHOICES
    return "|".join(sorted("+".join(sorted(c)) for c in choices)), len(choices)


def expression_labels(expression: str) -> set[str]:
    """All labels that stand in any of expression_choices(), without spelling the choices out."""
    stack: list[set[str]] = []
    for token in to_postfix(expression) or ():
        if token in _BINDING:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left | right)
        else:
            stack.append({x for x in [family(token)] if x})
    return stack[0] if stack else set()


def tag_automaton():
    """Finds the identifier tag as it is written, its words joined by hyphens or spaces."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for joints in product("- ", repeat=2):
        spelled = TAG.replace(" ", joints[0], 1).replace("license ", "license" + joints[1])
        found.add_word(spelled, len(spelled))
    found.make_automaton()
    return found


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrases, base in ((NOTICE_PHRASES, False), (BASE_PHRASES, True)):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (phrase, label, base))
    found.add_word(f" {TAG} ", (TAG, None, False))
    found.make_automaton()
    return found


def scan_text(text: bytes, phrases, tags) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, declared of one text."""
    words = text.translate(_WORD_TABLE).split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    base, starts, more, tagged = set(), [], set(), False
    at = word = 0  # words before a place are counted on from the place before
    for end, (phrase, label, is_base) in phrases.iter(joined):
        if is_base:
            base.add(label)
            start = end - len(phrase) - 1
            word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            starts.append(word)
        elif label:
            more.add(label)
        else:
            tagged = True
    declared, forms = set(), {}
    if tagged:
        for end, _ in tags.iter(text.translate(_LOWER).decode("ascii")):
            if line := _REST_OF_LINE.match(text, end + 1):
                expression = line[1].decode("utf-8", "replace")
                if own := expression_labels(expression):
                    declared |= own
                    form, choices = normal_form(expression)
                    forms[form] = choices
    labels = base | more | declared
    # declared terms are sure, the less so the more choices they leave; notices are weaker, and the more places the surer
    score = 0.9 + 0.1 / max(forms.values()) if declared else 0.0 if not labels else 1.0 - 0.5 ** (1 + len(starts) + len(more))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, ";".join(sorted(forms))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns n_words, n_base, first_word, last_word, base_labels, labels, score and declared.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest
    word such a place starts at (null without one). Labels are distinct, sorted and joined by commas
    ('' for none). declared has the tagged expressions evaluated, distinct and sorted, joined by semicolons: 'mit|gpl' leaves the choice,
    'gpl+mit' asks for both; it moves the score, labels name all licences an expression has. Null text counts as empty. New columns whose names are taken get leading
    underscores. The scan is narrow: no shuffle.
    """
    extra = T.StructType([T.StructField(fresh(docs, n), t) for n, t in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("declared", T.StringType()))])
    schema = extended(docs, extra)
    to, at = arrow_schema(schema), docs.columns.index(text_col)

    @lean
    def scan(batches):
        phrases, tags = automaton(), tag_automaton()
        for b in batches:
            rows = [scan_text(x or b"", phrases, tags) for x in b.column(at).cast(pa.binary()).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(extra)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, to.field(len(b.columns) + i).type) for i, c in enumerate(columns))], schema=to)

    return docs.mapInArrow(scan, schema)
