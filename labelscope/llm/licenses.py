"""License scans: ordered signature rules over word sequences.

A rule is a regular expression over a text's words (lower-cased, one blank in
between), gated by keywords: a text without a rule's keywords never meets its
expression. Rules are ordered by priority; a detection inside the interval of
one of higher priority is suppressed. The contract's base phrases are found by
exact search and always stay.

Defined results: a NULL or empty text has no words, places or labels and score
0; overlapping places are all counted; repeated rows are judged alike.
"""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import table, utf8

RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, detections array<struct<label:string,first:long,last:long,priority:int>>")
#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Families: label, names, versions (in words; empty: unversioned names are a rule too).
FAMILIES = (
    ("gpl", ("gnu general public licen[cs]e", "gnu gpl", "gpl"), ("1", "2", "3")),
    ("lgpl", ("gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "gnu lgpl", "lgpl"), ("2", "2 1", "3")),
    ("agpl", ("gnu affero general public licen[cs]e", "gnu agpl", "agpl"), ("1", "3")),
    ("gfdl", ("gnu free documentation licen[cs]e", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache licen[cs]e", "apache software licen[cs]e", "apache"), ("1", "1 1", "2")),
    ("mpl", ("mozilla public licen[cs]e", "mpl"), ("1", "1 1", "2")),
    ("epl", ("eclipse public licen[cs]e", "epl"), ("1", "2")),
    ("cddl", ("common development and distribution licen[cs]e", "cddl"), ("1", "1 1")),
    ("eupl", ("european union public licen[cs]e", "eupl"), ("1 1", "1 2")),
    ("osl", ("open software licen[cs]e", "osl"), ("1", "2", "2 1", "3")),
    ("afl", ("academic free licen[cs]e", "afl"), ("1 2", "2", "2 1", "3")),
    ("artistic", ("artistic licen[cs]e",), ("1", "2")),
    ("zpl", ("zope public licen[cs]e", "zpl"), ("1 1", "2", "2 1")),
    ("lppl", ("latex project public licen[cs]e", "lppl"), ("1", "1 2", "1 3")),
    ("bsl", ("boost software licen[cs]e",), ("1",)),
    ("ofl", ("sil open font licen[cs]e", "open font licen[cs]e"), ("1", "1 1")),
    ("odbl", ("open database licen[cs]e", "odbl"), ("1",)),
    ("php", ("php licen[cs]e",), ("3", "3 1")),
)
#: Licences known by name alone.
NAMED = (
    ("mit", ("mit licen[cs]e", "expat licen[cs]e", "mit x11 licen[cs]e")), ("isc", ("isc licen[cs]e",)), ("zlib", ("zlib licen[cs]e", "zlib libpng licen[cs]e")),
    ("unlicense", ("the unlicense",)), ("wtfpl", ("wtfpl",)),
    ("cc0", ("cc0", "cc zero", "creative commons zero")), ("public-domain", ("released into the public domain", "dedicated to the public domain")),
    ("ms-pl", ("microsoft public licen[cs]e", "ms pl")), ("ms-rl", ("microsoft reciprocal licen[cs]e", "ms rl")),
    ("ncsa", ("university of illinois ncsa open source licen[cs]e", "ncsa licen[cs]e")), ("postgresql", ("postgresql licen[cs]e",)),
    ("python", ("python software foundation licen[cs]e", "psf licen[cs]e")), ("all-rights-reserved", ("all rights reserved",)),
    ("bsd-2-clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd licen[cs]e")), ("bsd-3-clause", ("bsd 3 clause", "3 clause bsd", "modified bsd licen[cs]e", "new bsd licen[cs]e")),
    ("bsd-4-clause", ("bsd 4 clause", "4 clause bsd", "original bsd licen[cs]e")), ("bsd", ("bsd licen[cs]e", "bsd style licen[cs]e")),
)
COMMONS_PARTS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd")
COMMONS_WORDS = {"by": "attribution", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative|ativ)e?s?"}
COMMONS_VERSIONS = ("1", "2", "2 5", "3", "4")
#: Tokens of the full text of a licence, whatever it calls itself.
CLAUSES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"),
    ("apache-2", "licensed under the apache licen[cs]e version 2 0 the licen[cs]e"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms"),
    ("zlib", "this software is provided as is without any express or implied warranty"),
)
_LEAD = "(?:(?:under|by) the (?:terms of the )?)?"
#: Words too common to gate by, and one of every base phrase.
_COMMON = {"mit", "version", "the", "of", "by", "under", "and", "any", "or", "later", "public", "general", "software", "free", "open", "this", "to", "for"}
_BASE_WORDS = (b"license", b"apache", b"nc")
_WORD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rule:
    priority: int  # smaller goes first
    place: int  # in the order of all rules
    label: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    confidence: float


def _keywords(pattern: str) -> tuple[bytes, ...]:
    """A text that meets the expression has one of these words: its longest plain word, or either spelling of licence."""
    if pattern.startswith(("cc ", "creative ")):
        return (pattern.split()[0].encode(),)
    plain = sorted((w for w in pattern.split() if re.fullmatch(r"[a-z0-9]+", w) and w not in _COMMON), key=len)
    if "licen[cs]e" in pattern and (not plain or len(plain[-1]) < 7):
        return (b"license", b"licence")
    return (plain[-1].encode(),)


def _rule(priority: int, label: str, words: str, confidence: float, keywords: tuple[bytes, ...] | None = None) -> Rule:
    return Rule(priority, -1, label, keywords or _keywords(words.removeprefix(_LEAD)), re.compile(f"(?<= ){words}(?= )".encode()), confidence)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: whole clauses, versions, then names."""
    made = [_rule(0, label, words, 0.99) for label, words in CLAUSES]
    for label, names, versions in FAMILIES:
        for name in names:
            # The longest version first: 2 1 is not 2. A lead belongs to the detection.
            for version in sorted(versions, key=lambda v: -len(v.split())):
                short = version.removesuffix(" 0")
                tail = short if " " in short else f"{short}(?: 0)?"
                tag = f"{label}-{short.replace(' ', '.')}"
                made.append(_rule(1, f"{tag}-or-later", f"{_LEAD}{name} (?:version |v )?{tail} or (?:any )?later", 0.98))
                made.append(_rule(2, tag, f"{_LEAD}{name} version {tail}", 0.97))
                made.append(_rule(2, tag, f"{_LEAD}{name} v ?{tail}", 0.95))
                made.append(_rule(3, tag, f"version {tail} of the {name}", 0.95))
                made.append(_rule(4, tag, f"{_LEAD}{name} {tail}", 0.8))
                if " " not in name:  # name and version in one word
                    for mark, confidence in (("v", 0.95), ("", 0.8)):
                        word = (f"{name}{mark}{short.split()[0]}".encode(),)
                        made.append(_rule(1, f"{tag}-or-later", f"{_LEAD}{name}{mark}{tail} or (?:any )?later", confidence, word))
                        made.append(_rule(2, tag, f"{_LEAD}{name}{mark}{tail}", confidence, word))
            if " " in name:
                made.append(_rule(6, label, f"(?:under|by) the (?:terms of the )?{name}", 0.8))
                made.append(_rule(7, label, name, 0.6))
    for parts in COMMONS_PARTS:
        spelled = " ".join(COMMONS_WORDS[p] for p in parts.split())
        label = f"cc-{parts.replace(' ', '-')}"
        # More parts first, so that by nc sa is not by nc.
        rank = 5 - len(parts.split())
        for version in COMMONS_VERSIONS:
            tail = version if " " in version else f"{version}(?: 0)?"
            made.append(_rule(rank, f"{label}-{version.replace(' ', '.')}", f"cc {parts} {tail}", 0.97))
            made.append(_rule(rank, f"{label}-{version.replace(' ', '.')}", f"creative commons {spelled} {tail}", 0.97))
        made.append(_rule(rank + 3, label, f"cc {parts}", 0.9))
        made.append(_rule(rank + 3, label, f"creative commons {spelled}", 0.9))
    for label, names in NAMED:
        for name in names:
            made.append(_rule(5, label, f"(?:under|by) the {name}", 0.9))
            made.append(_rule(7, label, name, 0.6 if label == "all-rights-reserved" else 0.7))
    made.sort(key=lambda r: r.priority)
    return tuple(replace(r, place=i) for i, r in enumerate(made))


@lru_cache(maxsize=1)
def by_keyword() -> dict[bytes, tuple[Rule, ...]]:
    """Rules under each of their keywords."""
    found: dict[bytes, list[Rule]] = {k: [] for k in _BASE_WORDS}
    for rule in rules():
        for k in rule.keywords:
            found.setdefault(k, []).append(rule)
    return {k: tuple(r) for k, r in found.items()}


@lru_cache(maxsize=1)
def _gate() -> frozenset[bytes]:
    return frozenset(by_keyword())


def split_words(text: bytes) -> list[bytes]:
    return text.lower().translate(_WORD).split()


class _Outermost:
    """Intervals of which none holds another, by start and so by end."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def holds(self, first: int, last: int) -> bool:
        i = bisect_right(self.starts, first)
        return i > 0 and self.ends[i - 1] >= last

    def add(self, first: int, last: int) -> None:
        """Those that the new one holds go: what they hold it holds too."""
        i, j = bisect_left(self.starts, first), bisect_right(self.ends, last)
        self.starts[i:max(i, j)] = [first]
        self.ends[i:max(i, j)] = [last]


def blanks_of(joined: bytes) -> list[int]:
    return np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20).tolist()


def detect(joined: bytes, hits: Iterable[bytes], blanks: list[int] | None = None) -> list[tuple[int, int, int, str, float]]:
    """``(first word, last word, priority, label, confidence)`` of kept detections.

    ``joined`` holds the words with a blank before and after each, ``hits`` the
    keywords among them, ``blanks`` the blanks' places.
    """
    blanks = blanks_of(joined) if blanks is None else blanks
    kept, outermost = [], _Outermost()
    index = by_keyword()
    for rule in sorted({r.place: r for k in hits for r in index[k]}.values(), key=lambda r: r.place):
        for m in rule.pattern.finditer(joined):
            first = bisect_left(blanks, m.start()) - 1
            last = first + m.group().count(b" ")
            if not outermost.holds(first, last):
                outermost.add(first, last)
                kept.append((first, last, rule.priority, rule.label, rule.confidence))
    return sorted(kept)


def base_places(joined: bytes, blanks: list[int] | None = None) -> list[tuple[int, str]]:
    blanks = blanks_of(joined) if blanks is None else blanks
    places = []
    for phrase, label in BASE:
        needle = f" {phrase} ".encode()
        at = joined.find(needle)
        while at >= 0:
            places.append((bisect_left(blanks, at), label))
            at = joined.find(needle, at + 1)
    return places


def scan(text: bytes) -> tuple:
    words = split_words(text)
    hits = _gate().intersection(words)
    if not hits:
        return len(words), 0, None, None, "", "", 0.0, []
    joined = b" " + b" ".join(words) + b" "
    blanks = blanks_of(joined)
    base, found = base_places(joined, blanks), detect(joined, hits, blanks)
    labels = {label for _, label in base}
    doubt = 1.0
    for _ in base:
        doubt *= 0.05
    for *_, confidence in found:
        doubt *= 1 - confidence
    places = [p for p, _ in base]
    return (
        len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {d[3] for d in found})), 1 - doubt if base or found else 0.0,
        [{"label": d[3], "first": d[0], "last": d[1], "priority": d[2]} for d in found],
    )


def scan_column(text: Column) -> Column:
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ")]
        for texts in parts:
            out = pd.DataFrame([scan(t) for t in texts.tolist()], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, RESULT).asNondeterministic()(utf8(text))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the scan of each whole text, with every kept detection."""
    return docs.select("doc_id", scan_column(F.col("text")).alias("_scan")).select("doc_id", "_scan.*")


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    """License places and labels of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
