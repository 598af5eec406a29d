"""License scans by ordered signature rules.

A text becomes its words, lower-cased, with one space between.  Some 230 rules are
signatures of license texts, headers and notices, written out by hand in
``licensetexts``.  Every license also has hand-written patterns for its name; each
is put into the phrases in which a license is granted, named or tagged.  All rules
stand in a fixed order.  A keyword prefilter, a vectorised look-up of word hashes, finds the few
texts and the few rules that can match.  Where detections overlap, one that lies
within another of higher or equal priority, or within a longer one of the same
priority, is suppressed.

Base phrases are looked for apart from the rules and are never suppressed.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textbuf
from .licensetexts import BODIES, NOTICES
from .store import input_table

#: The base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: (label, pattern of the name in normalised words, keywords of which the text must have one).
LICENSES = (
    ("agpl-3", r"(?:gnu )?affero general public licen[cs]e(?: (?:version|v) ?3(?: 0)?)?|agplv?3?(?: 0)?", "affero agpl agplv3 agpl3"),
    ("lgpl-3", r"(?:gnu )?lesser general public licen[cs]e (?:version |v) ?3(?: 0)?|lgpl ?v?3(?: 0)?", "lesser lgpl lgplv3 lgpl3"),
    ("lgpl-2.1", r"(?:gnu )?lesser general public licen[cs]e(?: (?:version|v) ?2 1)?|lgpl ?v?2 1|lgpl", "lesser lgpl lgplv2 lgpl2"),
    ("lgpl-2", r"(?:gnu )?library general public licen[cs]e(?: (?:version|v) ?2(?: 0)?)?|lgpl ?v?2(?: 0)?", "library lgpl lgplv2 lgpl2"),
    ("gpl-3", r"(?:gnu )?general public licen[cs]e (?:version |v) ?3(?: 0)?|gpl ?v?3(?: 0)?", "general gpl gplv3 gpl3"),
    ("gpl-2", r"(?:gnu )?general public licen[cs]e (?:version |v) ?2(?: 0)?|gpl ?v?2(?: 0)?", "general gpl gplv2 gpl2"),
    ("gpl", r"(?:gnu )?general public licen[cs]e|gnu gpl|gpl", "general gnu gpl"),
    ("fdl", r"(?:gnu )?free documentation licen[cs]e(?: (?:version|v) ?1 [123])?|gfdl", "documentation gfdl"),
    ("apache-1.1", r"apache (?:software )?licen[cs]e (?:version |v)?1 1", "apache"),
    ("apache-2", r"apache (?:software )?licen[cs]e(?: (?:version |v)?2(?: 0)?)?|apache 2(?: 0)?", "apache"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?|mit 0", "mit"),
    ("mit", r"mit(?: x11| expat)? licen[cs]e|expat licen[cs]e|mit", "mit expat"),
    ("x11", r"x11 licen[cs]e|x11", "x11"),
    ("bsd-4-clause", r"(?:4|four) clause bsd(?: licen[cs]e)?|bsd 4 clause(?: licen[cs]e)?|original bsd(?: licen[cs]e)?", "bsd"),
    ("bsd-3-clause", r"(?:3|three) clause bsd(?: licen[cs]e)?|bsd 3 clause(?: licen[cs]e)?|(?:new|modified|revised) bsd(?: licen[cs]e)?", "bsd"),
    ("bsd-2-clause", r"(?:2|two) clause bsd(?: licen[cs]e)?|bsd 2 clause(?: licen[cs]e)?|(?:simplified|freebsd) bsd(?: licen[cs]e)?|freebsd licen[cs]e", "bsd freebsd"),
    ("0bsd", r"(?:0|zero) clause bsd(?: licen[cs]e)?|0bsd", "bsd 0bsd"),
    ("bsd", r"bsd(?: style)? licen[cs]e|bsd", "bsd"),
    ("isc", r"isc licen[cs]e|internet systems consortium licen[cs]e", "isc consortium"),
    ("mpl-1.1", r"mozilla public licen[cs]e (?:version |v)?1 1|mpl ?v?1 1", "mozilla mpl"),
    ("mpl-2", r"mozilla public licen[cs]e(?: (?:version |v)?2(?: 0)?)?|mpl(?: ?v?2(?: 0)?)?", "mozilla mpl mpl2"),
    ("epl-1", r"eclipse public licen[cs]e (?:version |v)?1(?: 0)?|epl ?v?1(?: 0)?", "eclipse epl"),
    ("epl-2", r"eclipse public licen[cs]e(?: (?:version |v)?2(?: 0)?)?|epl(?: ?v?2(?: 0)?)?", "eclipse epl"),
    ("eupl", r"european union public licen[cs]e(?: (?:version |v)?1 [12])?|eupl(?: ?v?1 [12])?", "european eupl"),
    ("cddl", r"common development and distribution licen[cs]e(?: (?:version |v)?1 [01])?|cddl(?: ?1 [01])?", "development cddl"),
    ("cpl", r"common public licen[cs]e(?: (?:version |v)?1(?: 0)?)?|cpl 1 0", "common cpl"),
    ("artistic-2", r"artistic licen[cs]e (?:version |v)?2(?: 0)?", "artistic"),
    ("artistic", r"(?:perl )?artistic licen[cs]e", "artistic"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib"),
    ("libpng", r"libpng licen[cs]e", "libpng"),
    ("boost", r"boost software licen[cs]e(?: (?:version |v)?1(?: 0)?)?|bsl 1 0", "boost bsl"),
    ("busl", r"business source licen[cs]e(?: (?:version |v)?1 [01])?|busl 1 1", "business busl"),
    ("unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"do what the f\w+ you want to public licen[cs]e|wtfpl", "wtfpl want"),
    ("ms-pl", r"microsoft public licen[cs]e|ms pl", "microsoft ms"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e|ms rl", "microsoft ms"),
    ("python", r"python software foundation licen[cs]e(?: (?:version |v)?2(?: 0)?)?|psf licen[cs]e", "python psf"),
    ("php", r"php licen[cs]e(?: (?:version |v)?3 0?1)?", "php"),
    ("ruby", r"ruby(?: s)? licen[cs]e", "ruby"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql"),
    ("openssl", r"openssl licen[cs]e", "openssl"),
    ("sil-ofl", r"(?:sil )?open font licen[cs]e(?: (?:version |v)?1 1)?|ofl 1 1", "font ofl"),
    ("odbl", r"open (?:data commons open )?database licen[cs]e(?: (?:version |v)?1 0)?|odbl", "database odbl"),
    ("odc-by", r"open data commons attribution licen[cs]e|odc by", "commons odc"),
    ("pddl", r"public domain dedication and licen[cs]e|pddl", "dedication pddl"),
    ("elastic-2", r"elastic licen[cs]e(?: (?:version |v)?2(?: 0)?)?", "elastic"),
    ("sspl", r"server side public licen[cs]e(?: (?:version |v)?1)?|sspl(?: ?v?1)?", "server sspl"),
    ("openrail", r"(?:bigscience |creativeml )?open ?rail(?: m)?(?: licen[cs]e)?", "openrail rail"),
    ("cc0", r"cc0(?: 1 0)?|creative commons (?:zero|cc0|public domain dedication)(?: 1 0)?", "cc0 creative"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?|creative commons attribution non ?commercial no ?deriv\w+(?: [1-4] [05])?", "cc creative"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?|creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc creative"),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?|creative commons attribution non ?commercial(?: [1-4] [05])?", "cc creative"),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?|creative commons attribution no ?deriv\w+(?: [1-4] [05])?", "cc creative"),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?|creative commons attribution share ?alike(?: [1-4] [05])?", "cc creative"),
    ("cc-by", r"cc by(?: [1-4] [05])?|creative commons attribution(?: [1-4] [05])?", "cc creative"),
    ("public-domain", r"public domain", "domain"),
)

#: The phrases that hold a license's name: (priority, confidence, before the name, after it).
PHRASES = (
    (1, 0.99, r"spdx licen[cs]e identifier (?:\w+ (?:or|and|with) )?", r"(?: only| or later)?"),
    (2, 0.97, r"permission is (?:hereby )?granted (?:free of charge )?under (?:the )?(?:terms of )?(?:the )?", ""),
    (2, 0.95, r"(?:re)?licen[cs]ed under (?:the |a )?(?:terms of )?(?:the )?", r"(?: licen[cs]e)?"),
    (2, 0.95, r"(?:re)?distributed under (?:the |a )?(?:terms of )?(?:the )?", r"(?: licen[cs]e)?"),
    (2, 0.94, r"(?:released|available|published|provided|redistribute\w*|modify it|used?) under (?:the |a )?(?:terms of )?(?:the )?", r"(?: licen[cs]e)?"),
    (3, 0.9, r"licen[cs]e ", ""),
    (4, 0.8, r"", r" licen[cs]e"),
)
#: Names that are ordinary words too: they count only within a phrase; the others also by themselves.
AMBIGUOUS = ("mit", "bsd", "x11", "unlicense", "gpl", "apache-2", "public-domain")
#: Signatures that are no license's name: (label, priority, confidence, pattern, keywords).
OTHERS = (
    ("proprietary", 5, 0.6, r"all rights reserved", "reserved"),
    ("proprietary", 4, 0.8, r"(?:confidential and proprietary|proprietary and confidential)", "proprietary"),
    ("proprietary", 5, 0.6, r"(?:may not|do not|no part (?:of \w+ ){0,4}may) be (?:copied|reproduced|redistributed)(?: or (?:copied|reproduced|redistributed))?", "reproduced copied redistributed"),
    ("copyright", 6, 0.4, r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?|copyright c", "copyright"),
    ("mit", 3, 0.9, r"permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("isc", 3, 0.9, r"permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("bsd", 3, 0.9, r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("unlicense", 3, 0.9, r"this is free and unencumbered software released into the public domain", "unencumbered"),
)


@dataclass(frozen=True)
class Rule:
    """One signature; a lower priority number goes first."""

    label: str
    priority: int
    confidence: float
    pattern: re.Pattern
    keywords: frozenset[str]


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules in their order."""
    out = [Rule(label, p, c, re.compile(rf"\b{before}(?:{name}){after}\b"), frozenset(words.split())) for p, c, before, after in PHRASES for label, name, words in LICENSES]
    out += [Rule(label, 5, 0.7, re.compile(rf"\b(?:{name})\b"), frozenset(words.split())) for label, name, words in LICENSES if label not in AMBIGUOUS]
    out += [Rule(label, p, c, re.compile(rf"\b(?:{pattern})\b"), frozenset(words.split())) for label, p, c, pattern, words in OTHERS + NOTICES]
    out += [Rule(label, 3, 0.9, re.compile(rf"\b(?:{pattern})\b"), frozenset(words.split())) for label, pattern, words in BODIES]
    return tuple(sorted(out, key=lambda r: r.priority))


@dataclass(frozen=True)
class Detection:
    """Words ``first`` to ``last`` (exclusive) that a rule matched."""

    label: str
    first: int
    last: int
    priority: int
    confidence: float


def base_places(text: str) -> list[tuple[int, str]]:
    """First word and label of every place of a base phrase in normalised text."""
    room, out = f" {text} ", []
    for phrase, label in BASE:
        at = room.find(f" {phrase} ")
        while at >= 0:
            out.append((room.count(" ", 0, at), label))
            at = room.find(f" {phrase} ", at + 1)
    return sorted(out)


def detect(text: str, keywords: set[str]) -> list[Detection]:
    """What the rules find in normalised text, after suppression; ``keywords``: those the text has."""
    found: list[Detection] = []
    for order, r in enumerate(rules()):
        if not keywords.isdisjoint(r.keywords):
            for m in r.pattern.finditer(text):
                first = text.count(" ", 0, m.start())
                found.append(Detection(r.label, first, first + 1 + m[0].count(" "), r.priority * 1000 + order, r.confidence))
    # Best first: priority class, then length, then the order of rules.
    found.sort(key=lambda d: (d.priority // 1000, d.first - d.last, d.priority))
    kept: list[Detection] = []
    reach: dict[int, list[Detection]] = {}
    for d in found:
        if not any(k.first <= d.first and d.last <= k.last for k in reach.get(d.first // 64, ())):
            kept.append(d)
            for block in range(d.first // 64, (d.last - 1) // 64 + 1):
                reach.setdefault(block, []).append(d)
    return sorted(kept, key=lambda d: (d.first, d.last, d.label))


@functools.cache
def _keywords() -> tuple[list[str], np.ndarray, np.ndarray]:
    """The prefilter's words, their hashes in order, and a table of hash ends."""
    words = sorted(frozenset().union(*(r.keywords for r in rules()), *(p.split() for p, _ in BASE)) - {"under", "the", "by", "2", "version"})
    h = textbuf.Words([w.encode() for w in words], textbuf.WORD).hashes()
    order = np.argsort(h)
    table = np.zeros(1 << 16, bool)
    table[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
    return [words[i] for i in order], h[order], table


def _scan(texts: list[bytes]) -> list[tuple]:
    """For each text: words, base places, and detections."""
    words, hashes, table = _keywords()
    w = textbuf.Words(texts, textbuf.WORD)
    h = w.hashes()
    near = np.flatnonzero(table[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(hashes, h[near]), len(hashes) - 1)
    hit = hashes[at] == h[near]
    near, at = near[hit], at[hit]
    owner = np.searchsorted(w.first, near, "right") - 1
    out = [(int(n), [], []) for n in w.counts]
    data = w.bytes.tobytes()
    for d in np.unique(owner).tolist():
        has = {words[k] for k in np.unique(at[owner == d] if len(owner) < 5000 else at[np.searchsorted(owner, d) : np.searchsorted(owner, d, "right")])}
        a, b = w.first[d], w.first[d + 1]
        text = b" ".join([data[i:j] for i, j in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)]).decode("utf-8", "replace")
        out[d] = (b - a, base_places(text), detect(text, has))
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, base, detections`` of every row: places by word number.

    ``base`` are (first, label), ``detections`` (label, first, last, confidence)
    after suppression.  Null and empty texts have no words and no places.
    Repeated rows stay; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    base = pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string())]))
    places = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("confidence", pa.float64())]))

    def run(batches):
        for batch in batches:
            texts = textbuf.texts_of(batch.column(1))
            for i, j in textbuf.blocks(texts):
                rows = _scan(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j],
                        pa.array([n for n, _, _ in rows], pa.int64()),
                        pa.array([[{"first": f, "label": x} for f, x in b] for _, b, _ in rows], base),
                        pa.array([[{"label": x.label, "first": x.first, "last": x.last, "confidence": x.confidence} for x in d] for _, _, d in rows], places),
                    ],
                    ["doc_id", "n_words", "base", "detections"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, base array<struct<first:long,label:string>>, detections array<struct<label:string,first:long,last:long,confidence:double>>")


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """The query: every document's base places and labels.

    The score is the chance that any detection is right, taking them as
    independent; base places count 0.95 together.
    """
    return scanned(input_table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "cast(size(base) as long) as n_base", "array_min(transform(base, b -> b.first)) as first_word", "array_max(transform(base, b -> b.first)) as last_word",
        "array_join(array_sort(array_distinct(transform(base, b -> b.label))), ',') as base_labels",
        "array_join(array_sort(array_union(transform(base, b -> b.label), transform(detections, d -> d.label))), ',') as labels",
        "1 - aggregate(detections, if(size(base) > 0, 0.05D, 1D), (acc, d) -> acc * (1 - d.confidence)) as score", "cast(size(detections) as long) as n_detections",
    )
