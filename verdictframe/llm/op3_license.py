"""License scan: ordered signature rules behind a keyword prefilter.

Rules are regular expressions over a text whose words are joined by single spaces. A text is searched only with the
rules one of whose keywords it holds. Detections compete: a detection inside a longer one, or inside an equal one of
a rule with a better priority, is suppressed; the survivors give the labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordhash import ALNUM, slices, split

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)


@dataclass(frozen=True)
class Rule:
    """``priority``: lower wins among equal spans; ``weight``: how sure a detection is, 0 to 1; every text that the
    pattern can match holds one of ``keywords``."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    weight: float


# Names of license families with the words that texts use for them, and the versions they have.
_VERSIONED = (
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", ("general public license", "gpl"), ("1", "2", "3"), True),
    ("lgpl", r"(?:gnu )?(?:(?:lesser|library) general public license|lgpl)", ("general public license", "lgpl"), ("2", "2 1", "3"), True),
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)", ("affero", "agpl"), ("1", "3"), True),
    ("gfdl", r"(?:gnu )?(?:free documentation license|fdl|gfdl)", ("documentation license", "fdl"), ("1 1", "1 2", "1 3"), True),
    ("apache", r"apache (?:software )?license", ("apache",), ("1 0", "1 1", "2 0"), False),
    ("mpl", r"(?:mozilla public license|mpl)", ("mozilla", "mpl"), ("1 0", "1 1", "2 0"), False),
    ("epl", r"(?:eclipse public license|epl)", ("eclipse", "epl"), ("1 0", "2 0"), False),
    ("eupl", r"(?:european union public licen[cs]e|eupl)", ("european union", "eupl"), ("1 0", "1 1", "1 2"), False),
    ("cddl", r"(?:common development and distribution license|cddl)", ("common development", "cddl"), ("1 0", "1 1"), False),
    ("osl", r"(?:open software license|osl)", ("open software", "osl"), ("1 0", "2 0", "2 1", "3 0"), False),
    ("afl", r"(?:academic free license|afl)", ("academic free", "afl"), ("1 1", "1 2", "2 0", "2 1", "3 0"), False),
    ("artistic", r"artistic license", ("artistic",), ("1 0", "2 0"), False),
    ("bsl", r"boost software license", ("boost",), ("1 0",), False),
    ("cecill", r"cecill(?: free software license)?", ("cecill",), ("1 0", "1 1", "2 0", "2 1"), False),
    ("cpl", r"common public license", ("common public",), ("1 0",), False),
    ("ofl", r"sil open font license", ("open font",), ("1 0", "1 1"), False),
    ("lppl", r"(?:latex project public license|lppl)", ("latex project", "lppl"), ("1 0", "1 1", "1 2", "1 3", "1 3a", "1 3c"), False),
    ("zpl", r"zope public license", ("zope",), ("1 1", "2 0", "2 1"), False),
    ("psf", r"python software foundation license", ("python software",), ("2", "2 0"), False),
    ("odbl", r"open (?:data commons open )?database license", ("database license",), ("1 0",), False),
)
_PLAIN = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", ("hereby granted",), 0.95),
    ("mit", r"(?:licensed|released|available|distributed) under (?:the )?mit(?: license)?", ("under",), 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", ("permission to use",), 0.95),
    ("isc", r"isc license", ("isc license",), 0.8),
    ("bsd", r"redistribution and use in source and binary forms", ("redistribution",), 0.9),
    ("bsd-2-clause", r"(?:2|two|simplified) (?:clause )?bsd(?: 2 clause)? license|bsd 2 clause", ("bsd",), 0.9),
    ("bsd-3-clause", r"(?:3|three|new|modified|revised) (?:clause )?bsd(?: 3 clause)? license|bsd 3 clause", ("bsd",), 0.9),
    ("bsd-4-clause", r"(?:4|four|original) (?:clause )?bsd(?: 4 clause)? license|bsd 4 clause", ("bsd",), 0.9),
    ("bsd", r"bsd license", ("bsd",), 0.7),
    ("apache-2.0", r"licensed under the apache license version 2 0", ("apache",), 0.98),
    ("apache-2.0", r"www apache org licenses license 2 0", ("apache",), 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",), 0.95),
    ("wtfpl", r"do what the fuck you want to public license", ("public license",), 0.95),
    ("zlib", r"zlib license|this software is provided as is without any express or implied warranty in no event will the authors", ("zlib license", "provided as is"), 0.8),
    ("public-domain", r"(?:dedicated|released) to the public domain|placed in(?:to)? the public domain", ("public domain",), 0.7),
    ("proprietary", r"all rights reserved", ("all rights",), 0.4),
    ("proprietary", r"unauthorized (?:copying|reproduction|use) (?:of this file )?(?:is )?(?:strictly )?prohibited", ("unauthorized",), 0.6),
    ("gpl", r"this program is free software you can redistribute it and or modify", ("free software",), 0.9),
    ("gpl-or-later", r"either version \d of the license or (?:at your option )?any later version", ("later version",), 0.8),
    ("json", r"the software shall be used for good not evil", ("not evil",), 0.95),
    ("beerware", r"the beer ?ware license", ("beer",), 0.9),
    ("postgresql", r"postgresql license", ("postgresql",), 0.8),
    ("x11", r"x11 license", ("x11",), 0.8),
    ("ncsa", r"university of illinois ncsa open source license", ("ncsa",), 0.9),
    ("ms-pl", r"microsoft public license", ("microsoft",), 0.9),
    ("ms-rl", r"microsoft reciprocal license", ("microsoft",), 0.9),
    ("cc0", r"cc0(?: 1 0)?|creative commons zero", ("cc0", "commons zero"), 0.9),
)
_CC_TERMS = (
    ("by", r"(?:attribution|by)"),
    ("by-sa", r"(?:attribution share ?alike|by sa)"),
    ("by-nd", r"(?:attribution no ?deriv(?:ative)?s?|by nd)"),
    ("by-nc", r"(?:attribution non ?commercial|by nc)"),
    ("by-nc-sa", r"(?:attribution non ?commercial share ?alike|by nc sa)"),
    ("by-nc-nd", r"(?:attribution non ?commercial no ?deriv(?:ative)?s?|by nc nd)"),
)
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules in order of priority: versions before families, statements and tags before bare names."""
    out: list[tuple[int, str, str, tuple[str, ...], float]] = []
    spdx, commons = ("spdx license",), ("creative commons", "cc by", "cc attribution")
    for phrase, label in BASE:
        out.append((40, label, phrase, (phrase,), 0.6))
    for name, words, keys, versions, later in _VERSIONED:
        out.append((30, name, words, keys, 0.6))
        for v in versions:
            dotted = v.replace(" ", ".")
            named = rf"{words}(?: version| v)? ?v?{v}"
            out.append((20, f"{name}-{dotted}", named, keys, 0.9))
            if later:
                out.append((10, f"{name}-{dotted}-or-later", rf"{named} or (?:any )?later(?: version)?", keys, 0.95))
        for v in versions:
            tag = v if not later else f"{v}(?: 0)?"
            out.append((5, f"{name}-{v.replace(' ', '.')}", rf"spdx license identifier {name} {tag}(?: only)?", spdx, 1.0))
            if later:
                out.append((4, f"{name}-{v.replace(' ', '.')}-or-later", rf"spdx license identifier {name} {tag} or later", spdx, 1.0))
    for name, words in _CC_TERMS:
        out.append((30, f"cc-{name}", rf"(?:creative commons|cc) {words}", commons, 0.6))
        for v in _CC_VERSIONS:
            out.append((20, f"cc-{name}-{v.replace(' ', '.')}", rf"(?:creative commons|cc) {words}(?: version)? {v}(?: (?:international|unported|generic))?", commons, 0.9))
            out.append((20, f"cc-{name}-{v.replace(' ', '.')}", rf"creativecommons org licenses {name.replace('-', ' ')} {v}", ("creativecommons",), 0.95))
            out.append((5, f"cc-{name}-{v.replace(' ', '.')}", rf"spdx license identifier cc {name.replace('-', ' ')} {v}", spdx, 1.0))
    for label, pattern, keys, weight in _PLAIN:
        out.append((15 if weight >= 0.9 else 35, label, pattern, keys, weight))
    for label in ("mit", "isc", "zlib", "unlicense", "wtfpl", "bsd 2 clause", "bsd 3 clause", "cc0 1 0", "x11", "ncsa", "json", "postgresql"):
        out.append((5, label.replace(" 1 0", "").replace(" ", "-"), rf"spdx license identifier {label}", spdx, 1.0))
    out.sort(key=lambda r: r[0])
    return tuple(Rule(label, pattern, keys, i, weight) for i, (_, label, pattern, keys, weight) in enumerate(out))


@lru_cache(1)
def _compiled():
    found = ahocorasick.Automaton()
    by_key: dict[str, list[int]] = {}
    compiled = []
    for i, r in enumerate(rules()):
        compiled.append((re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])"), r))
        for k in r.keywords:
            by_key.setdefault(k, []).append(i)
    for phrase, label in BASE:
        by_key.setdefault(phrase, [])
    for k, own in by_key.items():
        found.add_word(k, (k, own))
    found.make_automaton()
    return found, compiled


def survivors(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, end, priority), those that no other contains; of equal spans the best priority stays."""
    best: dict[tuple[int, int], int] = {}
    for s, e, p in spans:
        best[s, e] = min(p, best.get((s, e), p))
    out, reach = [], -1
    for (s, e), p in sorted(best.items(), key=lambda x: (x[0][0], -x[0][1])):
        if e > reach:
            out.append((s, e, p))
            reach = e
    return out


def detect(joined: str) -> tuple[list[tuple[int, str]], list[tuple[int, int, str, float]]]:
    """(base places, detections) of a text of lower-case words joined by spaces; places are word numbers.

    Base places are never suppressed. Detections are (first word, end word, label, weight) after suppression.
    """
    machine, compiled = _compiled()
    hits = {k: own for _, (k, own) in machine.iter(joined)}
    if not hits:
        return [], []
    word = lambda at: joined.count(" ", 0, at)
    base, spans = [], []
    for phrase, label in BASE:
        if phrase in hits:
            base += [(word(m.start()), label) for m in re.finditer(rf"(?<![^ ])(?={phrase}(?![^ ]))", joined)]
    for i in sorted({i for own in hits.values() for i in own}):
        pattern, rule = compiled[i]
        spans += [(m.start(), m.end(), rule.priority) for m in pattern.finditer(joined)]
    kept = survivors(spans)
    every = rules()
    return sorted(base), [(word(s), word(e - 1) + 1, every[p].label, every[p].weight) for s, e, p in kept]


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_GAPS = bytes(b if ALNUM[b] else 0x20 for b in range(256))
_SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


def _gates() -> list[bytes]:
    """First words of all keywords: a text without any of them is not joined and searched."""
    machine, _ = _compiled()
    return sorted({k.split()[0].encode() for k, _ in machine.values()})


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    gates = _gates()
    for b in batches:
        cols: list[list] = [[] for _ in range(8)]
        for _, data, off in slices(b.column(b.num_columns - 1)):
            w = split(data, off)
            low = data.tobytes().translate(_LOWER)
            near = [g for g in gates if g in low]
            for i, n in enumerate(w.counts):
                raw = low[off[i] : off[i + 1]]
                base, found = [], []
                if any(g in raw for g in near):
                    joined = b" ".join(raw.translate(_GAPS).split()).decode()
                    base, found = detect(joined)
                miss = 1.0
                for *_, weight in found:
                    miss *= 1.0 - weight
                starts = [p for p, _ in base]
                row = (int(n), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
                       ",".join(sorted({x for _, x in base} | {x[2] for x in found})), round(1.0 - miss, 9), ";".join(f"{s}-{e}:{x}" for s, e, x, _ in found))
                for c, v in zip(cols, row):
                    c.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        names = [x.split()[0] for x in _SCAN.split(", ")]
        keys = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays(keys + [pa.array(c, k) for c, k in zip(cols, kinds)], [f.name for f in list(b.schema)[:-1]] + names)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and the scan of its whole text.

    Null and empty texts have no words, places and labels, score 0. score is 1 minus the product of (1 - weight) over the
    detections. ``detections`` lists them as first-end:label. Rows are independent: repeated and null ids are rows like
    any other, an empty table gives an empty result, other columns are not read. No shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_scan, f"doc_id {kind}, {_SCAN}")
