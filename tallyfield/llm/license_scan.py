"""License scans: ordered signature rules behind a keyword filter.

A text becomes its words, lower-cased in A-Z and joined by single spaces. A rule is a regular expression over words with a
keyword that each of its matches contains; only rules whose keyword occurs in the text run at all. All matches are
intervals of words with a priority; an interval that lies inside one of higher priority (or of the same priority and
longer) is suppressed, so "lesser general public license" is not also reported by a rule for the shorter name. The three
base phrases are matched like all others and never suppressed.

The scan is map only and reads whole texts; matching is linear in the text for every rule that runs.

Defined cases: a missing or empty text has no words and no detections; a missing doc_id stays missing; repeated rows are
scanned one by one; other columns never take part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose places count in the base columns, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class LicenseRule:
    label: str
    pattern: str
    keyword: str
    priority: int
    base: bool = False


@dataclass(frozen=True)
class Detection:
    start: int
    end: int
    rule: LicenseRule


# Label, name as it stands in running text, identifier (None if another row has it), and keyword, all as
# words without punctuation. Every alternative of a name holds the keyword.
NAMES = (
    ("mit", r"mit(?: x11| expat)?", r"mit", "mit"),
    ("mit-0", r"mit(?: license)? no attribution", r"mit 0", "mit"),
    ("apache-1.0", r"apache(?: software)?(?: license)?(?: version)? 1 0", r"apache 1 0", "apache"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version)? 1 1", r"apache 1 1", "apache"),
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?", r"apache 2 0", "apache"),
    ("gpl-1.0", r"(?:gnu )?gpl(?: version| v)? ?1(?: 0)?", r"gpl 1 0(?: only| or later)?", "gpl"),
    ("gpl-1.0", r"(?:gnu )?general public license(?: version| v)? ?1(?: 0)?", None, "general public"),
    ("gpl-2.0", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?", r"gpl 2 0(?: only| or later)?", "gpl"),
    ("gpl-3.0", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?", r"gpl 3 0(?: only| or later)?", "gpl"),
    ("gpl-2.0", r"(?:gnu )?general public license (?:version |v)2(?: 0)?", r"gpl 2", "general public"),
    ("gpl-3.0", r"(?:gnu )?general public license (?:version |v)3(?: 0)?", r"gpl 3", "general public"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", r"lgpl", "general public"),
    ("lgpl-2.0", r"(?:gnu )?lgpl ?(?:version |v)?2(?: 0)?", r"lgpl 2 0(?: only| or later)?", "lgpl"),
    ("lgpl-2.1", r"(?:gnu )?lgpl ?(?:version |v)?2 1", r"lgpl 2 1(?: only| or later)?", "lgpl"),
    ("lgpl-3.0", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?", r"lgpl 3 0(?: only| or later)?", "lgpl"),
    ("agpl", r"(?:gnu )?affero general public", r"agpl", "affero"),
    ("agpl-3.0", r"(?:gnu )?agpl ?(?:version |v)?3(?: 0)?", r"agpl 3 0(?: only| or later)?", "agpl"),
    ("gfdl", r"(?:gnu )?free documentation", r"gfdl 1 [123](?: only| or later)?", "free documentation"),
    ("bsd", r"bsd(?: style)?", r"bsd", "bsd"),
    ("bsd-1-clause", r"(?:bsd 1 clause|one clause bsd)", r"bsd 1 clause", "bsd"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", r"bsd 2 clause", "bsd"),
    ("bsd-3-clause", r"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)", r"bsd 3 clause", "bsd"),
    ("bsd-4-clause", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd)", r"bsd 4 clause", "bsd"),
    ("0bsd", r"(?:zero clause bsd|bsd zero clause)", r"0bsd", "bsd"),
    ("0bsd", r"free public", None, "free public"),
    ("isc", r"isc", r"isc", "isc"),
    ("mpl-1.1", r"mozilla public license(?: version| v)? 1 1", r"mpl 1 1", "mozilla"),
    ("mpl-2.0", r"mozilla public license(?: version| v)? 2(?: 0)?", r"mpl 2 0", "mozilla"),
    ("mpl", r"mozilla public", r"mpl", "mozilla"),
    ("epl-1.0", r"eclipse public license(?: version| v)? 1 0", r"epl 1 0", "eclipse"),
    ("epl-2.0", r"eclipse public license(?: version| v)? 2 0", r"epl 2 0", "eclipse"),
    ("epl", r"eclipse public", r"epl", "eclipse"),
    ("edl-1.0", r"eclipse distribution", r"edl 1 0", "eclipse"),
    ("cpl-1.0", r"common public", r"cpl 1 0", "common public"),
    ("cddl-1.0", r"common development and distribution", r"cddl 1 0", "common development"),
    ("eupl-1.2", r"european union public", r"eupl 1 [12]", "european union"),
    ("osl-3.0", r"open software", r"osl 3 0", "open software"),
    ("afl-3.0", r"academic free", r"afl 3 0", "academic free"),
    ("artistic-1.0", r"artistic license(?: version| v)? 1 0", r"artistic 1 0", "artistic"),
    ("artistic-2.0", r"artistic license(?: version| v)? 2 0", r"artistic 2 0", "artistic"),
    ("artistic", r"artistic", r"artistic", "artistic"),
    ("zlib", r"zlib(?: libpng)?", r"zlib", "zlib"),
    ("libpng", r"libpng", r"libpng 2 0", "libpng"),
    ("bsl-1.0", r"boost software", r"bsl 1 0", "boost"),
    ("busl-1.1", r"business source", r"busl 1 1", "business source"),
    ("sspl-1.0", r"server side public", r"sspl 1 0", "server side"),
    ("elastic-2.0", r"elastic", r"elastic 2 0", "elastic"),
    ("unlicense", r"(?:the )?unlicense", r"unlicense", "unlicense"),
    ("wtfpl", r"wtfpl", r"wtfpl", "wtf"),
    ("wtfpl", r"do what the fuck you want to public", None, "want to public"),
    ("ms-pl", r"microsoft public", r"ms pl", "microsoft"),
    ("ms-rl", r"microsoft reciprocal", r"ms rl", "microsoft"),
    ("python-2.0", r"python(?: software foundation)?", r"python 2 0", "python"),
    ("php-3.01", r"php", r"php 3 01", "php"),
    ("ruby", r"ruby", r"ruby", "ruby"),
    ("vim", r"vim", r"vim", "vim"),
    ("openssl", r"openssl", r"openssl", "openssl"),
    ("postgresql", r"postgresql", r"postgresql", "postgresql"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)?", r"ncsa", "ncsa"),
    ("ofl-1.1", r"(?:sil )?open font", r"ofl 1 1", "open font"),
    ("odbl-1.0", r"open database", r"odbl 1 0", "open database"),
    ("pddl-1.0", r"public domain dedication and", r"pddl 1 0", "public domain"),
    ("cc0-1.0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", r"cc0 1 0", "cc0"),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?(?: international| unported)?", r"cc by [1-4] [05]", "creative commons"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)?", r"cc by sa [1-4] [05]", "creative commons"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)?", r"cc by nc [1-4] [05]", "creative commons"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?", r"cc by nd [1-4] [05]", "creative commons"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"cc by nc sa [1-4] [05]", "creative commons"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?", r"cc by nc nd [1-4] [05]", "creative commons"),
)

# Sentences that only the text or notice of one license holds.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", "permission notice shall"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", "with or without fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "source and binary forms"),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software", "endorse or promote"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", "advertising materials"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance"),
    ("apache-2.0", "www apache org licenses license 2 0", "apache org"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser general"),
    ("agpl", "under the terms of the gnu affero general public license", "affero"),
    ("gpl", "www gnu org licenses(?: old licenses)?(?: gpl(?: [123] 0)?)?", "gnu org"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("mpl", "mozilla org mpl", "mozilla"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy", "hereby granted free"),
    ("zlib", "this software is provided as is without any express or implied warranty", "express or implied"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("proprietary", "all rights reserved unauthorized (?:copying|reproduction|use)", "unauthorized"),
    ("cc", "creativecommons org licenses", "creativecommons"),
)

GRANTED = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered) (?:to you )?(?:under|by|with) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
FORMS = (("spdx license identifier {id}", 90), (GRANTED + "{name}(?: licen[cs]es?)?", 70), ("licen[cs]e (?:is )?(?:the )?{id}", 60), ("{name} licen[cs]es?", 50))


@lru_cache(maxsize=1)
def license_rules() -> tuple[LicenseRule, ...]:
    """Base phrases first, then every form of every name, then sentences."""
    base = [LicenseRule(label, phrase, phrase, 0, True) for phrase, label in BASE]
    named = [
        LicenseRule(label, form.format(id=id_, name=name), keyword if "{name}" in form else "licen", priority)
        for label, name, id_, keyword in NAMES
        for form, priority in FORMS
        if id_ is not None or "{id}" not in form
    ]
    return (*base, *named, *(LicenseRule(label, text, keyword, 100) for label, text, keyword in SENTENCES))


# Lower-cases A-Z and turns every other ASCII character that is no word character into a space.
_LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


class Scanner:
    """Rules compiled once per worker, filed under their keywords."""

    def __init__(self, rules: tuple[LicenseRule, ...]):
        self.by_keyword: dict[bytes, list[tuple[LicenseRule, re.Pattern]]] = {}
        for rule in rules:
            compiled = re.compile(rb"(?<![^ ])(?:" + rule.pattern.encode() + rb")(?![^ ])")
            self.by_keyword.setdefault(rule.keyword.encode(), []).append((rule, compiled))
        self.gate = re.compile(b"|".join(sorted(map(re.escape, self.by_keyword), key=len, reverse=True)))

    def words(self, text: str | None) -> list[bytes]:
        return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []

    def detect(self, words: list[bytes]) -> list[Detection]:
        """All matches of the rules whose keyword occurs, as intervals of words."""
        joined = b" ".join(words)
        if not self.gate.search(joined):
            return []
        found = []
        for keyword, rules in self.by_keyword.items():
            if keyword in joined:
                for rule, pattern in rules:
                    at, place = 0, 0
                    for m in pattern.finditer(joined):
                        place += joined.count(b" ", at, m.start())
                        at = m.start()
                        found.append(Detection(place, place + 1 + m.group().count(b" "), rule))
        return found


def unsuppressed(found: list[Detection]) -> list[Detection]:
    """Detections that none of higher priority, and no longer one of equal priority, contains; equal ones all stay.

    One sweep by start: per priority the furthest end so far tells whether anything contains a detection.
    """
    kept: list[Detection] = []
    furthest: dict[int, int] = {}  # of all starts up to the present one
    for _, group in groupby(sorted(found, key=lambda d: d.start), key=lambda d: d.start):
        here = list(group)
        earlier = dict(furthest)
        for d in here:
            furthest[d.rule.priority] = max(furthest.get(d.rule.priority, 0), d.end)
        for d in here:
            p = d.rule.priority
            inside = earlier.get(p, -1) >= d.end or furthest[p] > d.end or any(end >= d.end for q, end in furthest.items() if q > p)
            if not inside:
                kept.append(d)
    return sorted(kept, key=lambda d: (-d.rule.priority, d.start - d.end, d.start))


@lru_cache(maxsize=2)
def scanner(rules: tuple[LicenseRule, ...]) -> Scanner:
    return Scanner(rules)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[LicenseRule, ...] | None = None) -> DataFrame:
    """One row per document: base places, labels, the best rule's weight as score, and the detections that stand."""
    rules = rules or license_rules()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("priority", pa.int64())]))
    schema = (
        f"doc_id {dict(rows.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, spans array<struct<label:string,start:long,end:long,priority:long>>"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan_ = scanner(rules)
        for batch in batches:
            out = [[] for _ in names[1:]]
            for body in batch.column(1):
                words = scan_.words(body.as_py())
                found = scan_.detect(words)
                base = [d for d in found if d.rule.base]
                kept = unsuppressed([d for d in found if not d.rule.base])
                starts = [d.start for d in base]
                labels = sorted({d.rule.label for d in base})
                both = sorted({d.rule.label for d in kept} | set(labels))
                best = max([d.rule.priority for d in kept] + [40] * bool(base), default=0)
                row = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(labels), ",".join(both), best / 100)
                shown = [{"label": d.rule.label, "start": d.start, "end": d.end, "priority": d.rule.priority} for d in kept]
                for column, value in zip(out, (*row, shown), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=names)

    return rows.mapInArrow(scan, schema)
