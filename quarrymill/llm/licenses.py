"""License scans: identifier tags and notice phrases by Aho-Corasick, expressions by shunting-yard.

Words are the runs of ASCII letters and digits and of all characters above ASCII, in
lower case (A-Z only). One automaton holds every phrase and tag as words with a space
on each side and runs over a text's words joined by spaces. After the tag "SPDX
License Identifier" the original text is read as a licence expression: a
shunting-yard parser turns it into postfix (with binds tighter than and, and tighter
than or), and its evaluation gives the identifiers and whether an allow-list permits it.

Identifiers are those of a list, or start with LicenseRef-; an expression ends before the
first other word (but for exceptions, which follow with).

A null text counts as empty: no words, no places. Texts are scanned whole, in time that
grows with their length; each row on its own, so repeated rows give repeated results and
null ids null ids. Of phrases at one place all count. A tag with a malformed expression,
or none of a known identifier, counts as a tag without identifiers. Columns other than
doc_id and text, whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notices: words, label, weight of the evidence.
NOTICES = (
    ("mit license", "mit", 0.9), ("apache license", "apache", 0.8), ("apache license version 2 0", "apache-2.0", 0.95), ("licensed under the apache license", "apache", 0.9),
    ("bsd license", "bsd", 0.9), ("bsd 2 clause", "bsd-2-clause", 0.95), ("bsd 3 clause", "bsd-3-clause", 0.95), ("mozilla public license", "mpl", 0.9),
    ("gnu general public license", "gpl", 0.95), ("gnu general public license version 2", "gpl-2.0", 0.95), ("gnu general public license version 3", "gpl-3.0", 0.95),
    ("gnu lesser general public license", "lgpl", 0.95), ("gnu affero general public license", "agpl", 0.95), ("eclipse public license", "epl", 0.9),
    ("creative commons attribution", "cc-by", 0.9), ("creative commons zero", "cc0", 0.9), ("cc0 1 0", "cc0", 0.9), ("cc by sa", "cc-by-sa", 0.9), ("cc by nc", "cc-by-nc", 0.9), ("cc by nd", "cc-by-nd", 0.9), ("cc by nc sa", "cc-by-nc-sa", 0.9), ("cc by nc nd", "cc-by-nc-nd", 0.9),
    ("dedicated to the public domain", "public-domain", 0.8), ("released into the public domain", "public-domain", 0.8), ("the unlicense", "unlicense", 0.7), ("boost software license", "bsl", 0.9), ("isc license", "isc", 0.9),
)
BASE_WEIGHTS = {"cc by": 0.6, "general public license": 0.85, "all rights reserved": 0.7}
TAG = "spdx license identifier"
ALLOWED = frozenset("mit apache-2.0 bsd-2-clause bsd-3-clause isc cc0-1.0 cc-by-4.0 unlicense bsl-1.0 0bsd zlib".split())
#: Licence identifiers, in lower case.
IDENTIFIERS = frozenset(
    "0bsd afl-3.0 agpl-3.0 agpl-3.0-only agpl-3.0-or-later apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 "
    "cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 "
    "gfdl-1.3 gpl-1.0 gpl-2.0 gpl-2.0+ gpl-2.0-only gpl-2.0-or-later gpl-3.0 gpl-3.0+ gpl-3.0-only gpl-3.0-or-later isc lgpl-2.0 lgpl-2.1 lgpl-2.1+ lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0 lgpl-3.0+ lgpl-3.0-only lgpl-3.0-or-later lppl-1.3c "
    "mit mit-0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 ruby unicode-dfs-2016 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()
)

_WORDS = bytes(b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_PIECE = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_TAG = re.compile(r"SPDX[^A-Za-z0-9\x80-\U0010ffff]+License[^A-Za-z0-9\x80-\U0010ffff]+Identifier[ \t]*:?[ \t]*([^\r\n]*)", re.I | re.A)
BINDS = {"or": 1, "and": 2, "with": 3}


def known_part(expression: str) -> str:
    """The expression up to the last place at which it is whole and all its operands are known."""
    end = depth = 0
    before = "("
    for m in _PIECE.finditer(expression):
        piece = m[0].lower()
        if piece in BINDS:
            if before in BINDS or before == "(":
                break
        elif piece == "(":
            depth += 1
        elif piece == ")":
            depth -= 1
        elif not (before == "with" or piece.rstrip(".") in IDENTIFIERS or piece.startswith("licenseref-")):
            break
        if depth < 0:
            break
        if depth == 0 and piece not in BINDS:
            end = m.end()
        before = piece
    return expression[:end]


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the operands (lower case) and operators of an expression in postfix order. Reads as far as the expression goes; raises ValueError where it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False  # whether the last piece ended an operand
    at = 0
    for m in _PIECE.finditer(expression):
        piece = m[0].lower()
        if operand and (piece not in BINDS and piece != ")" or expression[at : m.start()].strip()):
            break  # prose follows the expression
        at = m.end()
        if piece == "(":
            stack.append(piece)
        elif piece == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        elif piece in BINDS:
            if not operand:
                raise ValueError(f"operator without a left side: {piece}")
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[piece]:
                out.append(stack.pop())
            stack.append(piece)
            operand = False
            continue
        else:
            out.append(piece.rstrip("."))
            operand = True
    while stack:
        top = stack.pop()
        if top != "(":
            out.append(top)
        else:
            raise ValueError("unclosed parenthesis")
    if not operand:
        raise ValueError("expression without an operand at its end")
    return out


def evaluate(rpn: list[str], allowed: frozenset[str] = ALLOWED) -> tuple[list[str], bool]:
    """The identifiers of a postfix expression and whether it is permitted: or takes either side, and needs both, with keeps its licence's verdict."""
    stack: list[tuple[list[str], bool]] = []
    for piece in rpn:
        if piece in BINDS:
            if len(stack) < 2:
                raise ValueError("operator without operands")
            (right, r), (left, w) = stack.pop(), stack.pop()
            if piece == "with":
                stack.append(([f"{left[-1]}-with-{right[0]}"] if len(left) == 1 else left, w))
            else:
                stack.append((left + right, (w or r) if piece == "or" else (w and r)))
        else:
            stack.append(([piece], piece in allowed))
    if len(stack) != 1:
        raise ValueError("operands without an operator")
    return stack[0]


_BUILT: list = []


def _automaton():
    if not _BUILT:
        a = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for phrase, label in BASE.items():
            found.setdefault(phrase, []).append((True, label, BASE_WEIGHTS[phrase]))
        for phrase, label, weight in NOTICES:
            found.setdefault(phrase, []).append((False, label, weight))
        found[TAG] = [(False, "", 0.0)]
        for phrase, meant in found.items():
            a.add_word(f" {phrase} ", (len(phrase) + 1, meant))
        a.make_automaton()
        _BUILT.append(a)
    return _BUILT[0]


def scan_text(text: str | None) -> dict:
    """What a text says of licences: n_words, n_base, first_word, last_word, base and all labels, score, and the tags' expressions."""
    words = (text or "").encode().translate(_WORDS).split()
    joined = " " + b" ".join(words).decode() + " "
    n_base, first, last = 0, None, None
    base: set[str] = set()
    labels: set[str] = set()
    miss, tagged = 1.0, False
    seen, at = 0, 0  # spaces before at, so that words are counted once along the text
    for end, (size, meant) in _automaton().iter(joined):
        start = end - size
        if start >= at:
            seen += joined.count(" ", at, start)
            at, where = start, seen
        else:
            where = seen - joined.count(" ", start, at)
        for is_base, label, weight in meant:
            if is_base:
                n_base += 1
                first = where if first is None else min(first, where)
                last = where if last is None else max(last, where)
                base.add(label)
            tagged |= not label
            if label:
                labels.add(label)
                miss *= 1.0 - weight
    tags = []
    if tagged:
        for m in _TAG.finditer(text):
            try:
                rpn = postfix(known_part(m[1]))
                ids, permitted = evaluate(rpn)
            except ValueError:
                rpn, ids, permitted = [], [], False
            tags.append({"expression": m[1].strip(), "postfix": rpn, "identifiers": ids, "permitted": permitted})
            labels.update(ids)
            miss *= 0.05 if ids else 0.5
    return {"n_words": len(words), "n_base": n_base, "first_word": first, "last_word": last, "base": sorted(base), "found": sorted(labels | base), "score": 1.0 - miss, "tags": tags}


_TAG_TYPE = pa.struct([("expression", pa.string()), ("postfix", pa.list_(pa.string())), ("identifiers", pa.list_(pa.string())), ("permitted", pa.bool_())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base", pa.list_(pa.string())), ("found", pa.list_(pa.string())), ("score", pa.float64()), ("tags", pa.list_(_TAG_TYPE))])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, found array<string>, score double, tags array<struct<expression:string,postfix:array<string>,identifiers:array<string>,permitted:boolean>>"


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to one row of scan_text() each; no shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            got = [scan_text(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([g[f.name] for g in got], f.type) for f in list(_OUT)[1:])], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The labels joined by commas, the tags' expressions in postfix order, and whether all of them are permitted (null without a tag); the rest as it is."""
    verdict = F.when(F.size("tags") > 0, F.forall("tags", lambda t: t["permitted"]))
    expressions = F.array_join(F.transform("tags", lambda t: F.array_join(t["postfix"], " ")), ",")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("found", ",").alias("labels"), "score", expressions.alias("expressions"), verdict.alias("permitted"))
