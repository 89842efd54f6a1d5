"""License detection by ordered signature rules.

Texts are brought to lower-case words with one blank between, and rules are regular expressions on that form.
About 140 are passages of license texts and notices, written by hand (``license_texts``). Every license of ``LICENSES``
gives more in five shapes (identifier tag, grant, title, address, plain name), each with a priority and a score; names that
are words as well (``AMBIGUOUS``) need a license word after them, those of products (``PRODUCTS``) an article before, too. Two gates come before any expression: a text
must hold one of the ``triggers`` of all rules, then literals that every match of the rule holds; both are taken from the
patterns (``necessary``), and so only few rules are tried on few texts.
Detections are resolved in order of priority, then length, then place: one that lies inside a
detection already kept is suppressed, so that ``apache license version 2`` inside a longer
grant, or a plain name inside a title, does not count twice.

Besides, base phrases are counted in every text, wherever their words stand consecutively. Base labels always stay.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Null and empty texts have
no words, no detection and score 0. Equal rows give equal results. Only the text is looked at, so nulls and
clashing names in other columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import os
import re
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cedarlog.llm import text as tx
from cedarlog.llm.common import fresh
from cedarlog.llm.license_texts import passages

#: Phrases that are always counted, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
BASE_SCORE = 0.9

_V1, _V2, _V3 = (rf"(?:v ?|version )?{n}(?: 0)?" for n in "123")
_GNU = r"(?:the )?(?:gnu )?"
#: Label, name, identifier, words of an address. Fixed values.
LICENSES = (
    ("mit", r"mit(?: x11| expat)?", r"mit", r"opensource org licenses? mit"),
    ("mit-0", r"mit(?: license)? no attribution", r"mit 0", r"opensource org licenses? mit 0"),
    ("apache-2", rf"apache(?: software)?(?: license)? {_V2}", r"apache 2 0", r"apache org licenses license 2 0"),
    ("apache-1.1", r"apache(?: software)?(?: license)? (?:v ?|version )?1 1", r"apache 1 1", r"apache org licenses license 1 1"),
    ("gpl-3.0", rf"{_GNU}(?:gpl ?|general public license ){_V3}", r"gpl 3 0(?: only| or later)?", r"gnu org licenses gpl 3 0"),
    ("gpl-2.0", rf"{_GNU}(?:gpl ?|general public license ){_V2}", r"gpl 2 0(?: only| or later)?", r"gnu org licenses (?:old licenses )?gpl 2 0"),
    ("gpl-1.0", rf"{_GNU}(?:gpl ?|general public license ){_V1}", r"gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0"),
    ("gpl", r"(?:the )?(?:(?:gnu )?gpl|gnu general public)", r"gpl", r"gnu org licenses gpl"),
    ("lgpl-3.0", rf"{_GNU}(?:lgpl ?|lesser general public license ){_V3}", r"lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl 3 0"),
    ("lgpl-2.1", rf"{_GNU}(?:lgpl ?|lesser general public license )(?:v ?|version )?2 1", r"lgpl 2 1(?: only| or later)?", r"gnu org licenses (?:old licenses )?lgpl 2 1"),
    ("lgpl-2.0", rf"{_GNU}(?:lgpl ?|library general public license ){_V2}", r"lgpl 2 0(?: only| or later)?", r"gnu org licenses old licenses lgpl 2 0"),
    ("lgpl", r"(?:the )?(?:(?:gnu )?lgpl|gnu lesser general public)", r"lgpl", r"gnu org licenses lgpl"),
    ("agpl-3.0", rf"{_GNU}(?:agpl ?|affero general public license ){_V3}", r"agpl 3 0(?: only| or later)?", r"gnu org licenses agpl 3 0"),
    ("agpl", r"(?:the )?(?:gnu )?(?:agpl|affero general public)", r"agpl", r"gnu org licenses agpl"),
    ("gfdl", r"(?:the )?gnu free documentation", r"gfdl 1 [123](?: only| or later)?", r"gnu org licenses fdl"),
    ("bsd-2-clause", r"(?:bsd 2 clause|(?:simplified|freebsd|2 clause|two clause) bsd)", r"bsd 2 clause", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", r"(?:bsd 3 clause|(?:new|revised|modified|3 clause|three clause) bsd)", r"bsd 3 clause", r"opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", r"(?:bsd 4 clause|(?:original|old|4 clause|four clause) bsd)", r"bsd 4 clause", r"directory fsf org wiki license bsd 4clause"),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)", r"0bsd", r"opensource org licenses? 0bsd"),
    ("bsd", r"bsd(?: style)?", r"bsd", r"opensource org licenses? bsd license"),
    ("mpl-2.0", rf"(?:mozilla public(?: license)?|mpl) ?{_V2}", r"mpl 2 0", r"mozilla org mpl 2 0"),
    ("mpl-1.1", r"(?:mozilla public(?: license)?|mpl) ?(?:v ?|version )?1 1", r"mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl", r"mozilla public", r"mpl", r"mozilla org mpl"),
    ("epl-2.0", rf"(?:eclipse public(?: license)?|epl) ?{_V2}", r"epl 2 0", r"eclipse org legal epl (?:2 0|v20)"),
    ("epl-1.0", rf"(?:eclipse public(?: license)?|epl) ?{_V1}", r"epl 1 0", r"eclipse org legal epl v10"),
    ("cddl-1.0", r"common development and distribution", r"cddl 1 [01]", r"opensource org licenses? cddl 1 0"),
    ("eupl-1.2", r"(?:european union public(?: licence)?|eupl)(?: (?:v ?|version )?1 2)?", r"eupl 1 [12]", r"joinup ec europa eu software page eupl"),
    ("isc", r"isc", r"isc", r"opensource org licenses? isc"),
    ("zlib", r"zlib(?: libpng)?", r"zlib", r"opensource org licenses? zlib"),
    ("libpng", r"(?:png reference library|libpng)", r"libpng(?: 2 0)?", r"libpng org pub png src libpng license"),
    ("boost-1.0", r"boost software(?: license)?(?: (?:v ?|version )?1 0)?", r"bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", r"business source(?: license)?(?: (?:v ?|version )?1 1)?", r"busl 1 1", r"mariadb com bsl11"),
    ("artistic-2.0", rf"artistic(?: license)? {_V2}", r"artistic 2 0", r"opensource org licenses? artistic 2 0"),
    ("artistic-1.0", r"artistic", r"artistic 1 0", r"opensource org licenses? artistic license"),
    ("unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", r"do what the fuck you want to public", r"wtfpl", r"wtfpl net"),
    ("postgresql", r"postgresql", r"postgresql", r"opensource org licenses? postgresql"),
    ("python-2.0", r"python software foundation", r"(?:psf|python) 2 0", r"docs python org 3 license"),
    ("ruby", r"ruby", r"ruby", r"ruby lang org en about license"),
    ("php-3.01", r"php(?: license)?(?: (?:v ?|version )?3 01?)?", r"php 3 01?", r"php net license 3 01"),
    ("openssl", r"openssl", r"openssl", r"openssl org source license"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa", r"opensource org licenses? ncsa"),
    ("ofl-1.1", r"(?:sil )?open font(?: license)?(?: (?:v ?|version )?1 1)?", r"ofl 1 1", r"scripts sil org ofl"),
    ("ms-pl", r"microsoft public", r"ms pl", r"opensource org licenses? ms pl"),
    ("ms-rl", r"microsoft reciprocal", r"ms rl", r"opensource org licenses? ms rl"),
    ("upl-1.0", r"universal permissive", r"upl 1 0", r"opensource org licenses? upl"),
    ("osl-3.0", r"open software(?: license)? (?:v ?|version )?3 0", r"osl 3 0", r"opensource org licenses? osl 3 0"),
    ("afl-3.0", r"academic free(?: license)?(?: (?:v ?|version )?3 0)?", r"afl 3 0", r"opensource org licenses? afl 3 0"),
    ("odbl-1.0", r"(?:odc )?open database", r"odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", r"open data commons attribution", r"odc by 1 0", r"opendatacommons org licenses by"),
    ("pddl-1.0", r"public domain dedication and", r"pddl 1 0", r"opendatacommons org licenses pddl"),
    ("cc0-1.0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cc-by-nc-nd", r"(?:creative commons )?(?:cc )?(?:by nc nd|attribution non ?commercial no ?deriv\w*)(?: [1-4] 0)?", r"cc by nc nd [1-4] 0", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", r"(?:creative commons )?(?:cc )?(?:by nc sa|attribution non ?commercial share ?alike)(?: [1-4] 0)?", r"cc by nc sa [1-4] 0", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc", r"(?:creative commons )?cc by nc(?: [1-4] 0)?", r"cc by nc [1-4] 0", r"creativecommons org licenses by nc"),
    ("cc-by-nd", r"(?:creative commons )?cc by nd(?: [1-4] 0)?", r"cc by nd [1-4] 0", r"creativecommons org licenses by nd"),
    ("cc-by-sa", r"(?:creative commons )?cc by sa(?: [1-4] 0)?", r"cc by sa [1-4] 0", r"creativecommons org licenses by sa"),
    ("cc-by", r"(?:creative commons )?(?:cc by|creative commons attribution)(?: [1-4] 0)?", r"cc by [1-4] 0", r"creativecommons org licenses by"),
    ("openrail-m", r"(?:bigscience |creativeml )?open ?rail(?: ?\+*m)?", r"(?:creativeml |bigscience )?openrail m", r"huggingface co spaces bigscience license"),
    ("elastic-2.0", rf"elastic(?: license)? {_V2}", r"elastic 2 0", r"elastic co licensing elastic license"),
    ("sspl-1.0", r"server side public", r"sspl 1 0", r"mongodb com licensing server side public license"),
    ("vim", r"vim", r"vim", r"vimhelp org uganda txt html license"),
    ("tcl", r"tcl(?: tk)?", r"tcl", r"tcl tk software tcltk license"),
    ("unicode", r"unicode(?: inc)?", r"unicode (?:3 0|dfs 201[56])", r"unicode org license"),
    ("w3c", r"w3c software(?: notice and)?", r"w3c", r"w3 org consortium legal copyright software"),
    ("curl", r"curl", r"curl", r"curl se docs copyright"),
    ("public-domain", r"public domain", r"publicdomain", r"creativecommons org publicdomain mark 1 0"),
)
_GRANT = (r"(?:licensed|released|distributed|available|published|provided|redistributed|covered|governed|offered|shared) "
          r"(?:\w+ ){0,3}?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:a )?")
#: Names that mean the license even with no other word about licenses.
PLAIN = frozenset(
    "gpl-3.0 gpl-2.0 lgpl-3.0 lgpl-2.1 agpl-3.0 apache-2 bsd-2-clause bsd-3-clause mpl-2.0 epl-2.0 cc0-1.0 cc-by-nc-nd "
    "cc-by-nc-sa cc-by-nc cc-by-nd cc-by-sa cc-by eupl-1.2 gpl lgpl agpl gfdl 0bsd boost-1.0".split()
)

#: Names that are words or abbreviations too: a license word must follow them.
AMBIGUOUS = frozenset("mit isc ncsa artistic-1.0 bsd".split())
#: Names of products: besides, an article must stand before them.
PRODUCTS = frozenset("zlib libpng unlicense postgresql ruby php-3.01 openssl vim tcl unicode w3c curl elastic-2.0".split())
#: Words after "license" that make it something else.
_OTHER = rb"(?! (?:plates?|keys?|servers?|fees?|numbers?|holders?|managers?|renewals?|office) )"

#: Texts that a part of a pattern may stand for; beyond, its literals are taken by smaller parts. Letters of a literal
#: that are looked for, and literals of a set, unless the rule has no smaller one. They bound work, not what is found.
SPREAD, REACH, FEW = 16, 16, 16
#: Letters of a trigger, and how many letters are taken as equally common to tell rare sets.
HEAD, LETTERS = 12, 20.0


class Rule(NamedTuple):
    name: str
    label: str
    gate: tuple[tuple[bytes, ...], ...]
    pattern: re.Pattern
    priority: int
    score: float


class Found(NamedTuple):
    start: int
    end: int
    label: str
    rule: str
    score: float
    priority: int


def _shortest(texts: set[str]) -> frozenset[str]:
    """Without those that hold another."""
    kept: list[str] = []
    for t in sorted(texts, key=lambda t: (len(t), t)):
        if not any(k in t for k in kept):
            kept.append(t)
    return frozenset(kept)


def _spread(items) -> tuple[set[str] | None, list[frozenset[str]]]:
    """All texts that a parsed pattern matches, None if many; and sets of which each match holds a member."""
    run, clauses, whole = {""}, [], True
    for op, arg in items:
        texts, inner = _spread_one(op, arg)
        if texts is not None and len(run) * len(texts) <= SPREAD:
            run = {a + b for a in run for b in texts}
            continue
        whole = False
        clauses += [_shortest(run), *inner]
        # What all texts so far end with stands right before the next part.
        end = os.path.commonprefix([t[::-1] for t in run])[::-1]
        run = {""} if texts is None else {end + t for t in texts}
    clauses = {c for c in [*clauses, _shortest(run)] if "" not in c}
    weaker = {c for c in clauses for d in clauses if c != d and all(any(a in b for a in c) for b in d)}
    return (run if whole else None), sorted(clauses - weaker, key=sorted)


def _spread_one(op, arg) -> tuple[set[str] | None, list[frozenset[str]]]:
    if op is _parser.LITERAL:
        return {chr(arg)}, []
    if op is _parser.IN and all(o is _parser.LITERAL for o, _ in arg):
        return {chr(a) for _, a in arg}, []
    if op is _parser.IN and all(o is _parser.RANGE for o, _ in arg):
        return {chr(a) for _, (low, high) in arg for a in range(low, high + 1)}, []
    if op is _parser.SUBPATTERN:
        return _spread(arg[-1])
    if op in (_parser.MAX_REPEAT, _parser.MIN_REPEAT):
        low, high, part = arg
        texts, clauses = _spread(part)
        if (low, high) == (0, 1) and texts is not None:
            return texts | {""}, []
        return None, clauses if low else []
    if op is _parser.BRANCH:
        parts = [_spread(p) for p in arg[1]]
        if all(texts is not None for texts, _ in parts):
            return set().union(*(texts for texts, _ in parts)), []
        return None, [_shortest(set().union(*c)) for c in itertools.product(*(clauses for _, clauses in parts))]
    return None, []


def necessary(pattern: str) -> tuple[tuple[bytes, ...], ...]:
    """Sets of literals, of each of which every match of the pattern, with its blanks around, holds one at least."""
    _, clauses = _spread(_parser.parse(f" (?:{pattern}) "))
    clauses = {_shortest({t[:REACH] for t in c}) for c in clauses}
    small = [c for c in clauses if len(c) <= FEW] or [min(clauses, key=lambda c: (len(c), sorted(c)))]
    return tuple(tuple(t.encode() for t in sorted(c)) for c in sorted(small, key=lambda c: (len(c), sorted(c))))


def _rule(name: str, label: str, pattern: str, priority: int, score: float, worded: bool) -> Rule:
    """``worded``: what follows must not turn the license into another thing."""
    compiled = re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?= )" + (_OTHER if worded else rb""))
    return Rule(name, label, necessary(pattern), compiled, priority, score)


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, the more telling ones first."""
    out = []
    for label, name, tag, address in LICENSES:
        shapes = [
            ("tag", rf"spdx license identifier {tag}", 5, 1.0),
            ("grant", rf"{_GRANT}{name}(?: (?:public )?licen[sc]es?)?", 4, 0.95),
            ("address", rf"{address}", 3, 0.9),
        ]
        if label in AMBIGUOUS | PRODUCTS:
            article = "(?:the|an?|its|this|license|licence) " if label in PRODUCTS else "(?:the )?"
            shapes.append(("title", rf"{article}{name} (?:public )?licen[sc]e", 2, 0.8))
            shapes.append(("field", rf"licen[sc]e (?:is |type )(?:the )?{name}", 2, 0.7))
        else:
            shapes.append(("title", rf"(?:the )?(?:{name} (?:public )?licen[sc]es?|licen[sc]es? (?:is |type )?{name})", 2, 0.8))
        if label in PLAIN:
            shapes.append(("name", name, 1, 0.5))
        for shape, pattern, priority, score in shapes:
            out.append(_rule(f"{label}/{shape}", label, pattern, priority, score, shape in ("title", "grant")))
    nth: dict[str, int] = {}
    for label, pattern in passages():
        nth[label] = nth.get(label, 0) + 1
        out.append(_rule(f"{label}/text-{nth[label]}", label, pattern, 6, 0.97, False))
    return tuple(sorted(out, key=lambda r: -r.priority))


@functools.cache
def triggers() -> tuple[bytes, ...]:
    """Beginnings of literals, of which every match of any rule holds one at least: each rule gives its rarest set."""
    chosen = (min(rule.gate, key=lambda c: (sum(LETTERS ** -len(t) for t in c), c)) for rule in rules())
    return tuple(sorted(t.encode("latin-1") for t in _shortest({t[:HEAD].decode("latin-1") for c in chosen for t in c})))


def resolve(found: list[Found]) -> list[Found]:
    """Drop what lies inside a detection that comes first by priority, length and place."""
    kept: list[Found] = []
    for f in sorted(set(found), key=lambda f: (-f.priority, f.start - f.end, f.start, f.rule)):
        if not any(k.start <= f.start and f.end <= k.end for k in kept):
            kept.append(f)
    return sorted(kept, key=lambda f: (f.start, f.end, f.label))


def scan(words: bytes) -> list[Found]:
    """Detections in a normalised text: a blank before and after each word."""
    found, held = [], {}
    for rule in rules():
        for clause in rule.gate:
            if clause not in held:
                held[clause] = any(part in words for part in clause)
        if all(held[clause] for clause in rule.gate):
            for m in rule.pattern.finditer(words):
                start = words.count(b" ", 0, m.start()) - 1
                size = m.group().count(b" ") + 1
                found.append(Found(start, start + size, rule.label, rule.name, rule.score, rule.priority))
    return resolve(found)


def _normalise(raw: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with a blank before each and at the end; where each word begins; each text's first word."""
    starts, ends = tx.runs(tx.ALNUM[raw], bounds)
    size = ends - starts + 1
    to = np.cumsum(size) - size
    out = np.full(int(size.sum()) + 1, 0x20, np.uint8)
    source = np.arange(len(out) - 1) + np.repeat(starts - to - 1, size)
    inside = np.ones(len(out) - 1, bool)
    inside[to] = False
    out[:-1][inside] = tx.LOWER[raw[source[inside]]]
    return out.tobytes(), np.append(to, len(out) - 1), np.searchsorted(starts, bounds)


def _triggered(text: bytes, ends: list[int]) -> set[int]:
    """The texts, each given by its end, that hold a trigger."""
    own: set[int] = set()
    for part in triggers():
        place = text.find(part)
        while place >= 0:
            d = bisect.bisect_right(ends, place)
            if d == len(ends):
                break
            own.add(d)
            # On to the next text: one place of each is enough.
            place = text.find(part, ends[d])
    return own


def _places(text: bytes, part: bytes) -> np.ndarray:
    out, at = [], text.find(part)
    while at >= 0:
        out.append(at)
        at = text.find(part, at + 1)
    return np.asarray(out, np.int64)


RESULT = (
    "struct<n_words:long,n_base:long,first_word:long,last_word:long,base_labels:string,labels:string,score:double,"
    "detections:array<struct<start:int,end:int,label:string,rule:string,score:double>>>"
)


def scan_batch(column: pa.Array) -> pa.Array:
    """``RESULT`` for an Arrow column of texts."""
    raw, bounds = tx.text_bytes(column)
    rows: list[dict] = []
    for i, j in tx.blocks(bounds):
        words, at, first = _normalise(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        here = [{"n_words": int(n), "n_base": 0, "base": set(), "first": None, "last": None} for n in np.diff(first)]
        for phrase, label in BASE.items():
            places = _places(words, f" {phrase} ".encode())
            begin = np.searchsorted(at, places)
            doc = np.searchsorted(first, begin, side="right") - 1
            last = begin + phrase.count(" ")
            for d, w in zip(doc[last < first[doc + 1]], begin[last < first[doc + 1]] - first[doc[last < first[doc + 1]]], strict=True):
                row = here[d]
                row["n_base"] += 1
                row["base"].add(label)
                row["first"] = int(w) if row["first"] is None else min(row["first"], int(w))
                row["last"] = int(w) if row["last"] is None else max(row["last"], int(w))
        own = _triggered(words, at[first[1:]].tolist())
        for d, row in enumerate(here):
            found = scan(words[at[first[d]] : at[first[d + 1]]] + b" ") if d in own and row["n_words"] else []
            labels = row["base"] | {f.label for f in found}
            scores = [f.score for f in found] + [BASE_SCORE] * bool(row["base"])
            rows.append(
                {
                    "n_words": row["n_words"], "n_base": row["n_base"], "first_word": row["first"], "last_word": row["last"],
                    "base_labels": ",".join(sorted(row["base"])), "labels": ",".join(sorted(labels)),
                    "score": max(scores, default=0.0),
                    "detections": [
                        {"start": f.start, "end": f.end, "label": f.label, "rule": f.rule, "score": f.score} for f in found
                    ],
                }
            )
    part = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("rule", pa.string()), ("score", pa.float64())])
    kind = pa.struct(
        [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
        + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("detections", pa.list_(part))]
    )
    return pa.array(rows, kind)


def scan_documents(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``license``, a struct of ``RESULT``; the name gets underscores in front if it is taken."""
    (name,) = fresh(documents, "license")
    return documents.withColumn(name, F.arrow_udf(scan_batch, RESULT)(F.col(text_col)))
