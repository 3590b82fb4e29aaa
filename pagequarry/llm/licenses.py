"""Licence scans: one Aho-Corasick pass finds notice phrases and identifier tags, a shunting-yard parser
evaluates the and/or/with expression that they form."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

# Fixed values of the contract: phrase, label.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further notices, as normalised words, with the label each stands for.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "bsd license": "bsd",
    "isc license": "isc",
    "gnu general public license": "gpl",
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}

#: How freely a text under the label may be reused, 0 to 1, by the first prefix that the label has.
PERMISSION = [
    ("public-domain", 1.0),
    ("cc0", 1.0),
    ("unlicense", 1.0),
    ("mit", 0.9),
    ("isc", 0.9),
    ("bsd", 0.9),
    ("apache", 0.9),
    ("cc-by-nc", 0.3),
    ("cc-by-nd", 0.3),
    ("cc-by-sa", 0.6),
    ("cc-by", 0.8),
    ("mpl", 0.6),
    ("lgpl", 0.6),
    ("agpl", 0.4),
    ("gpl", 0.5),
    ("proprietary", 0.0),
]
UNKNOWN = 0.5

# Identifiers of the public list that stand without a version, and the families that a version follows. With them a word of prose is never
# taken for a licence.
BARE = {
    "0bsd", "aal", "adsl", "antlr-pd", "apafml", "bahyph", "barr", "beerware", "bitstream-vera", "borceux", "bzip2-1", "caldera", "clartistic", "condor", "crossword", "crystalstacker", "cube", "curl", "diffmark", "doc",
    "dotseqn", "dsdp", "dvipdfm", "egenix", "eurosym", "fair", "freeimage", "fsfap", "fsful", "fsfullr", "ftl", "giftware", "gl2ps", "glide", "glulxe", "gnuplot", "haskellreport", "hpnd", "icu", "ijg", "imagemagick",
    "imatix", "imlib2", "info-zip", "intel", "intel-acpi", "ipa", "isc", "jasper-2", "json", "latex2e", "leptonica", "libpng", "libpng-2.0", "libtiff", "linux-openib", "makeindex", "miros", "mit", "mit-0", "mit-advertising",
    "mit-cmu", "mit-enna", "mit-feh", "mit-modern-variant", "mitnfa", "motosoto", "mpich2", "ms-pl", "ms-rl", "mtll", "multics", "mup", "naumen", "ncsa", "net-snmp", "netcdf", "newsletr", "ngpl", "nlpl", "noassertion",
    "nokia", "none", "noweb", "nrl", "ntp", "oml", "openssl", "plexus", "postgresql", "psfrag", "psutils", "qhull", "rdisc", "rsa-md", "ruby", "saxpath", "scea", "sendmail", "sleepycat", "smppl", "snia", "swl", "tcl",
    "tcp-wrappers", "tmate", "unlicense", "vim", "vostrom", "w3c", "wsuipa", "wtfpl", "x11", "xerox", "xinetd", "xnet", "xpp", "xskat", "zed", "zlib", "zlib-acknowledgement",
}
FAMILIES = {
    "afl", "agpl", "apache", "apl", "apsl", "artistic", "bittorrent", "blueoak", "bsd", "bsl", "busl", "bzip2", "catosl", "cc0", "cc-by", "cc-by-nc", "cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nd", "cc-by-sa", "cddl", "cdla-permissive",
    "cdla-sharing", "cecill", "cnri-python", "cpal", "cpl", "cpol", "cua-opl", "ecl", "efl", "elastic", "entessa", "epl", "erlpl", "etalab", "eudatagrid", "eupl", "frameworx", "gfdl", "gpl", "gsoap", "hippocratic", "ipl", "jasper",
    "lgpl", "lgpllr", "lpl", "lppl", "mpl", "mulanpsl", "nasa", "nbpl", "nosl", "npl", "nposl", "oclc", "odbl", "odc-by", "ofl", "ogc", "ogl-uk", "oldap", "osl", "oset-pl", "pddl", "php", "polyform-noncommercial", "polyform-small-business",
    "psf", "python", "qpl", "rhecos", "rpl", "rpsl", "rscpl", "sgi-b", "simpl", "sissl", "spl", "sspl", "sugarcrm", "tosl", "unicode-dfs", "unicode", "upl", "vsl", "w3c", "watcom", "ypl", "zimbra", "zpl",
}
#: Those that are plain words too count only as the first of an expression.
PLAIN = {"barr", "caldera", "condor", "crossword", "cube", "curl", "doc", "fair", "glide", "intel", "json", "none", "plexus", "ruby", "vim", "zed"}
EXCEPTION = re.compile(r"[a-z0-9.+-]*-(?:exception|note)(?:-[0-9.]+)?")

TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:")
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
TAG_TOKEN = re.compile(rf"[ \t]*({TOKEN.pattern})")
LINE_END = re.compile(r"[ \t]*(?:[\r\n]|\Z)")
OPERATORS = {"or": 1, "and": 2, "with": 3}
#: Between two notices, words that let them join into one expression; the operator among them decides.
JOINERS = {"or", "and", "with", "the", "a", "either", "both", "under", "licensed", "of", "terms", "at", "your", "option"}
GAP = 6

_SPACED = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands, and/or/with and parentheses to postfix; None if they form no expression."""
    out: list[str] = []
    stack: list[str] = []
    operand_next = True
    for t in tokens:
        if t == "(":
            if not operand_next:
                return None
            stack.append(t)
        elif t == ")":
            if operand_next:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in OPERATORS:
            if operand_next:
                return None
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[t]:
                out.append(stack.pop())
            stack.append(t)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(t)
            operand_next = False
    if operand_next or "(" in stack:
        return None
    return out + stack[::-1]


def is_identifier(token: str) -> bool:
    """Whether a token in lower case is a licence's identifier: a known one, one of a known family with its version, or a reference."""
    if token in BARE or token.startswith(("licenseref-", "documentref-")):
        return True
    head = token[: m.start()] if (m := re.search(r"-[0-9]", token)) else ""
    return head in FAMILIES


def tag_tokens(text: str, at: int) -> list[str]:
    """The expression that follows a tag on its line: its longest well-formed prefix of tokens parted by blanks only, up to an
    operand after an operand or one that no licence has as its identifier (after ``with``, no exception). Where the line ends before the expression does, all its tokens."""
    tokens: list[str] = []
    depth = whole = 0
    operand_next = True
    while m := TAG_TOKEN.match(text, at):
        t = m[1].rstrip(".:-")  # a sentence may end here
        if operand_next == (t in OPERATORS or t == ")") or (t == ")" and not depth):
            return tokens[:whole] or tokens
        if t not in OPERATORS and t not in "()" and not (EXCEPTION.fullmatch(t) if tokens and tokens[-1] == "with" else is_identifier(t) and not (t in PLAIN and set(tokens) - {"("})):
            return tokens[:whole]
        depth += (t == "(") - (t == ")")
        operand_next = t == "(" or t in OPERATORS
        tokens.append(t)
        at = m.end()
        if not operand_next and not depth:
            whole = len(tokens)
        if t != m[1]:
            break
    ended = LINE_END.match(text, at)
    return tokens if ended else tokens[:whole] or tokens


def permission(label: str) -> float:
    return next((p for prefix, p in PERMISSION if label.startswith(prefix)), UNKNOWN)


def evaluate(postfix: list[str]) -> float:
    """``and`` binds to the stricter side, ``or`` lets the freer one be chosen, ``with`` grants an
    exception: half of what was missing."""
    stack: list[float] = []
    for t in postfix:
        if t in OPERATORS:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if t == "and" else max(a, b) if t == "or" else (a + 1) / 2)
        else:
            stack.append(permission(t))
    return stack[0]


@functools.lru_cache(maxsize=4)
def _matcher(phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    held: dict[str, list] = {}
    for p, label in phrases:
        held.setdefault(p, []).append(("base", label))
    for p, label in notices:
        held.setdefault(p, []).append(("notice", label))
    held.setdefault(TAG, []).append(("tag", ""))
    found = ahocorasick.Automaton()
    for p, what in held.items():
        found.add_word(f" {p} ".encode().decode("latin-1"), (len(p.encode()) + 2, p.count(" ") + 1, what))
    found.make_automaton()
    return found


def _places(raw: bytes) -> tuple[str, list[int]]:
    """The text in lower case, a character a byte, and the byte at which each word starts."""
    solid = np.frombuffer(raw.translate(_SPACED), np.uint8) != 32
    return raw.translate(_LOWER).decode("latin-1"), np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]])).tolist()


def scan_text(text: str | None, matcher: ahocorasick.Automaton) -> dict:
    raw = (text or "").encode()
    words = raw.translate(_SPACED).split()
    line = b" " + b" ".join(words) + b" "
    hits = list(matcher.iter(line.decode("latin-1")))
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "expression": None, "score": 0.0}
    if not hits:
        return out
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    places = []  # first word, word after the last, kind, label
    for end, (size, n, what) in hits:
        at = int(np.searchsorted(spaces, end - size + 1))
        places += [(at, at + n, kind, label) for kind, label in what]
    base = [p for p in places if p[2] == "base"]
    out |= {"n_base": len(base), "base_labels": sorted({p[3] for p in base})}
    if base:
        out |= {"first_word": min(p[0] for p in base), "last_word": max(p[0] for p in base)}

    # notices: at each stretch of words the longest match speaks; tags bring the expression that follows
    labels = set(out["base_labels"])
    lower, starts = _places(raw) if any(p[2] == "tag" for p in places) else ("", [])
    terms: list[list[str]] = []
    ends: list[tuple[int, int]] = []
    reach = -1
    for at, after, kind, label in sorted(places, key=lambda p: (p[0], -p[1], p[2])):
        if kind == "tag":
            stated = TAG_LINE.match(lower, starts[at])  # without a colon the tag is only mentioned
            if not stated:
                continue
            tokens = tag_tokens(lower, stated.end())
            ids = [t for t in tokens if t not in OPERATORS and t not in "()"]
            postfix = to_postfix(tokens)
            # an exception's name after "with" is no licence
            labels |= {t for i, t in enumerate(tokens) if t in ids and not (i and tokens[i - 1] == "with")}
            if postfix:
                terms.append(["(", *tokens, ")"])
                ends.append((at, after + sum(len(re.findall(r"[a-z0-9]+", t)) for t in tokens)))
                reach = max(reach, ends[-1][1])
            continue
        labels.add(label) if kind == "base" or at >= reach else None
        if at >= reach:
            terms.append([label])
            ends.append((at, after))
            reach = after
    if terms:
        tokens = list(terms[0])
        for k in range(1, len(terms)):
            gap = [w.decode("latin-1") for w in words[ends[k - 1][1] : ends[k][0]]]
            joined = len(gap) <= GAP and all(w in JOINERS for w in gap)
            tokens += [next((w for w in gap if w in OPERATORS), "and") if joined else "and", *terms[k]]
        postfix = to_postfix(tokens)
        if postfix:
            out |= {"expression": " ".join(tokens), "score": evaluate(postfix)}
    out["labels"] = sorted(labels)
    return out


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expression string, score double"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [*[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.float64()]


def scan(docs: DataFrame, base: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: word count, places and labels of the base phrases, all labels, the
    licence expression and its permission score.

    Null text counts as empty: no words, no labels, null places, score 0. Texts are scanned whole.
    Repeated rows give repeated results; null ids stay; an empty table gives an empty result; other
    columns are ignored. Phrases may overlap, and every place counts. Words after a tag's expression don't belong to it. A tag whose expression is malformed
    gives its identifiers as labels and no value. Words that are no identifiers end an expression and are never labels. No shuffle.
    """
    key = tuple((BASE if base is None else base).items()), tuple((NOTICES if notices is None else notices).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(*key)
        for batch in batches:
            for part in common.slices(batch, "text"):
                found = [scan_text(t, matcher) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), *[pa.array([r[n] for r in found], t) for n, t in zip(_NAMES[1:], _TYPES[1:], strict=True)]], names=_NAMES)

    return common.plain(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
