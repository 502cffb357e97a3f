"""License scans: ordered signature rules behind a filter of implied literals, with suppression of weaker overlapping detections.

Texts are cut into words: A-Z lower-cased, words are runs of letters, digits and all characters beyond ASCII. Rules are
regular expressions over the words joined by single spaces. A rule is tried only if the text holds the literals that its
expression implies: of each of some sets of them every match has one. Of all
detections, those of the best priority come first (then the longer, then the earlier); a detection whose words lie
within the words of an accepted one is suppressed. The score is ``1 - product(1 - weight)`` over accepted detections.

Besides the rules, base phrases are counted at every place where their words stand consecutively; rules never remove them.

Cases: null and empty texts have 0 words, empty labels, null places and score 0; texts are scanned whole; repeated rows
give repeated results; only the key and the text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from re import _parser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.batches import slices

SLICE_BYTES = 16_000_000

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Families: label, how the name is written (regex over words), identifier words, words of its web address.
FAMILIES = [
    ("agpl", r"(?:gnu )?affero general public", r"agpl(?: \d)?(?: \d)?(?: only| or later)?", r"gnu org licenses agpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", r"lgpl(?: \d)?(?: \d)?(?: only| or later)?", r"gnu org (?:licenses|copyleft) (?:lgpl|lesser)"),
    ("gpl", r"(?:gnu )?general public", r"gpl(?: \d)?(?: \d)?(?: only| or later)?", r"gnu org (?:licenses|copyleft) gpl"),
    ("fdl", r"(?:gnu )?free documentation", r"gfdl(?: \d)?(?: \d)?", r"gnu org licenses fdl"),
    ("apache", r"apache(?: software)?", r"apache(?: \d)?(?: \d)?", r"apache org licenses"),
    ("mit", r"(?:the )?mit(?: x11)?", r"mit(?: 0)?", r"opensource org licenses mit"),
    ("bsd", r"(?:(?:2|3|4|two|three|four) clause |(?:new|modified|simplified) )?bsd", r"(?:0)?bsd(?: \d clause)?", r"opensource org licenses bsd"),
    ("mpl", r"mozilla public", r"mpl(?: \d)?(?: \d)?", r"mozilla org mpl"),
    ("epl", r"eclipse public", r"epl(?: \d)?(?: \d)?", r"eclipse org legal epl"),
    ("edl", r"eclipse distribution", r"edl(?: \d)?(?: \d)?", r"eclipse org (?:org )?documents edl"),
    ("cddl", r"common development and distribution", r"cddl(?: \d)?(?: \d)?", r"opensource org licenses cddl"),
    ("cpl", r"common public", r"cpl(?: \d)?(?: \d)?", r"opensource org licenses cpl"),
    ("isc", r"isc", r"isc", r"opensource org licenses isc"),
    ("zlib", r"zlib(?: libpng)?", r"zlib(?: acknowledgement)?", r"zlib net zlib license"),
    ("boost", r"boost software", r"bsl 1 0", r"boost org license"),
    ("artistic", r"(?:perl )?artistic", r"artistic(?: \d)?(?: \d)?", r"opensource org licenses artistic"),
    ("unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense org"),
    ("wtfpl", r"wtfpl|do what the fuck you want to public", r"wtfpl", r"wtfpl net"),
    ("python", r"python(?: software foundation)?", r"(?:python|psf)(?: \d)?(?: \d)?", r"python org (?:psf )?license"),
    ("ruby", r"ruby", r"ruby", r"ruby lang org (?:en )?license"),
    ("php", r"php", r"php(?: \d)?(?: \d+)?", r"php net license"),
    ("ofl", r"(?:sil )?open font", r"ofl(?: \d)?(?: \d)?", r"scripts sil org ofl"),
    ("openssl", r"openssl", r"openssl", r"openssl org source license"),
    ("postgresql", r"postgresql", r"postgresql", r"postgresql org about licence"),
    ("ncsa", r"(?:university of )?illinois(?: ncsa)?(?: open source)?", r"ncsa", r"opensource org licenses ncsa"),
    ("mspl", r"microsoft public", r"ms pl", r"opensource org licenses ms pl"),
    ("msrl", r"microsoft reciprocal", r"ms rl", r"opensource org licenses ms rl"),
    ("eupl", r"european union public", r"eupl(?: \d)?(?: \d)?", r"eupl eu"),
    ("osl", r"open software", r"osl(?: \d)?(?: \d)?", r"opensource org licenses osl"),
    ("afl", r"academic free", r"afl(?: \d)?(?: \d)?", r"opensource org licenses afl"),
    ("qpl", r"q public", r"qpl(?: \d)?(?: \d)?", r"opensource org licenses qpl"),
    ("cecill", r"cecill(?: [bc])?", r"cecill(?: [bc])?(?: \d)?(?: \d)?", r"cecill info"),
    ("odbl", r"open (?:data commons )?(?:open )?database", r"odbl(?: \d)?(?: \d)?", r"opendatacommons org licenses odbl"),
    ("sspl", r"server side public", r"sspl(?: \d)?(?: \d)?", r"mongodb com licensing server side public license"),
    ("busl", r"business source", r"busl(?: \d)?(?: \d)?", r"mariadb com bsl"),
    ("cc0", r"cc0(?: \d \d)?|creative commons zero", r"cc0(?: \d)?(?: \d)?", r"creativecommons org publicdomain zero"),
    ("cc-by-nc-nd", r"cc by nc nd(?: \d \d)?|creative commons attribution non ?commercial no ?deriv(?:ative)?s", r"cc by nc nd(?: \d)?(?: \d)?", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", r"cc by nc sa(?: \d \d)?|creative commons attribution non ?commercial share ?alike", r"cc by nc sa(?: \d)?(?: \d)?", r"creativecommons org licenses by nc sa"),
    ("cc-by-nc", r"cc by nc(?: \d \d)?|creative commons attribution non ?commercial", r"cc by nc(?: \d)?(?: \d)?", r"creativecommons org licenses by nc"),
    ("cc-by-nd", r"cc by nd(?: \d \d)?|creative commons attribution no ?deriv(?:ative)?s", r"cc by nd(?: \d)?(?: \d)?", r"creativecommons org licenses by nd"),
    ("cc-by-sa", r"cc by sa(?: \d \d)?|creative commons attribution share ?alike", r"cc by sa(?: \d)?(?: \d)?", r"creativecommons org licenses by sa"),
    ("cc-by", r"cc by(?: \d \d)?|creative commons attribution", r"cc by(?: \d)?(?: \d)?", r"creativecommons org licenses by"),
]

# Names that stand for their license after "under" without the word itself; other names are ordinary words, too.
BARE = {
    "agpl": r"(?:gnu )?affero general public", "lgpl": r"gnu (?:lesser|library) general public", "gpl": r"gnu general public", "fdl": r"gnu free documentation",
    "apache": r"apache(?: software)?", "mit": r"mit(?: x11)?", "bsd": r"(?:(?:2|3|4|two|three|four) clause |(?:new|modified|simplified) )?bsd",
    "mpl": r"mozilla public", "epl": r"eclipse public", "unlicense": r"unlicense", "wtfpl": r"wtfpl", "cc0": r"cc0(?: \d \d)?",
    "cc-by-nc-nd": r"cc by nc nd(?: \d \d)?", "cc-by-nc-sa": r"cc by nc sa(?: \d \d)?", "cc-by-nc": r"cc by nc(?: \d \d)?", "cc-by-nd": r"cc by nd(?: \d \d)?",
    "cc-by-sa": r"cc by sa(?: \d \d)?", "cc-by": r"cc by(?: \d \d)?",
}
_GIVEN = r"(?:licensed|released|distributed|published|available|provided|covered)(?: \w+)?"

# Forms in which a family is named: priority (lower is better), weight, pattern.
FORMS = [
    (2, 0.95, r"spdx licen[sc]e identifier (?:{id})"),
    (3, 0.9, _GIVEN + r" (?:under|by)(?: (?:the )?terms (?:and conditions )?of)?(?: the)? (?:{name}) licen[sc]e(?: (?:version |v ?)?\d(?: \d)*)?"),
    (3, 0.9, _GIVEN + r" (?:under|by)(?: (?:the )?terms (?:and conditions )?of)?(?: the)? (?:{name}) (?:version |v ?)?\d(?: \d)*"),
    (3, 0.9, _GIVEN + r" under(?: (?:the )?terms (?:and conditions )?of)?(?: the)? (?:{bare})"),
    (3, 0.9, _GIVEN + r" by(?: (?:the )?terms (?:and conditions )?of)?(?: the)? (?:{gnu})"),
    (4, 0.85, r"(?:www )?(?:{url})"),
    (5, 0.8, r"(?:{name}) licen[sc]es?(?: (?:version |v ?)\d(?: \d)*)?"),
    (6, 0.7, r"licen[sc]e (?:is |id |type |name )?(?:the )?(?:{name})"),
    (7, 0.6, r"(?:terms|copy|text|version|conditions) of (?:the )?(?:{name}) licen[sc]es?"),
]

# Sentences of license texts, and words that concern licenses in general: label, priority, weight, pattern.
TEXTS = [
    ("mit", 1, 0.99, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 1, 0.97, r"permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", 1, 0.98, r"redistributions? (?:and use )?in source and binary forms"),
    ("bsd", 1, 0.97, r"redistributions of source code must retain the above copyright notice"),
    ("apache", 1, 0.98, r"you may not use this file except in compliance with the license"),
    ("gpl", 1, 0.95, r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 1, 0.97, r"under the terms of the gnu lesser general public license"),
    ("mpl", 1, 0.98, r"this source code form is subject to the terms of the mozilla public license"),
    ("zlib", 1, 0.9, r"this software is provided as is without any express or implied warranty"),
    ("boost", 1, 0.97, r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("unlicense", 1, 0.97, r"this is free and unencumbered software released into the public domain"),
    ("gpl", 1, 0.97, r"this program is free software you can redistribute it and or modify"),
    ("gpl", 1, 0.9, r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 1, 0.95, r"you should have received a copy of the gnu general public license along with this (?:program|file)"),
    ("gpl", 1, 0.95, r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("gpl", 1, 0.95, r"the licenses for most software (?:and other practical works )?are designed to take away your freedom"),
    ("gpl", 2, 0.9, r"either version [123] of the license or at your option any later version"),
    ("lgpl", 1, 0.97, r"this library is free software you can redistribute it and or modify"),
    ("lgpl", 1, 0.95, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("lgpl", 1, 0.95, r"work that uses the library"),
    ("agpl", 1, 0.97, r"under the terms of the gnu affero general public license"),
    ("agpl", 1, 0.95, r"you should have received a copy of the gnu affero general public license"),
    ("agpl", 1, 0.95, r"interacting with it remotely through a computer network"),
    ("fdl", 1, 0.97, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("fdl", 2, 0.85, r"with no invariant sections no front cover texts and no back cover texts"),
    ("apache", 1, 0.97, r"licensed under the apache license version 2 0 the license"),
    ("apache", 1, 0.95, r"you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses"),
    ("apache", 1, 0.93, r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache", 1, 0.95, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", 1, 0.93, r"this product includes software developed (?:by|at) the apache software foundation"),
    ("apache", 1, 0.93, r"terms and conditions for use reproduction and distribution"),
    ("mit", 1, 0.93, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 1, 0.93, r"to deal in the software without restriction including without limitation the rights"),
    ("mit", 2, 0.85, r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", 2, 0.8, r"permission is hereby granted free of charge to any person obtaining a copy of this software .{0,400}so subject to no conditions"),
    ("bsd", 1, 0.97, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 1, 0.95, r"neither the name of .{1,120}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd", 1, 0.93, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 2, 0.85, r"this software is provided by the (?:copyright holders? and contributors?|regents and contributors|authors?) as is"),
    ("bsd", 2, 0.85, r"use of this source code is governed by a bsd style license"),
    ("isc", 1, 0.95, r"the author disclaims all warranties with regard to this software including all implied warranties"),
    ("isc", 2, 0.85, r"with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", 1, 0.95, r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", 1, 0.95, r"the contents of this file are subject to the mozilla public license"),
    ("epl", 1, 0.97, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", 1, 0.93, r"the accompanying program is provided under the terms of this eclipse public license"),
    ("edl", 1, 0.95, r"the eclipse distribution license is available at"),
    ("cddl", 1, 0.97, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", 1, 0.93, r"when distributing covered code include this cddl header"),
    ("cpl", 1, 0.95, r"the accompanying program is provided under the terms of this common public license"),
    ("zlib", 1, 0.93, r"altered source versions must be plainly marked as such and must not be misrepresented"),
    ("zlib", 1, 0.93, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 2, 0.85, r"this notice may not be removed or altered from any source distribution"),
    ("boost", 1, 0.95, r"distributed under the boost software license"),
    ("artistic", 1, 0.93, r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic", 1, 0.93, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble this license establishes"),
    ("unlicense", 1, 0.95, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 1, 0.93, r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate"),
    ("wtfpl", 1, 0.97, r"you just do what the fuck you want to"),
    ("python", 1, 0.95, r"this license agreement is between the python software foundation"),
    ("python", 1, 0.93, r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ruby", 1, 0.93, r"you may redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl) .{0,60}or the conditions below"),
    ("ruby", 2, 0.85, r"this (?:file|library|software) is (?:distributed|licensed) under the (?:same )?(?:terms as|ruby license)"),
    ("php", 1, 0.95, r"this source file is subject to version \d(?: \d+)? of the php license"),
    ("php", 1, 0.93, r"products derived from this software may not be called php"),
    ("ofl", 1, 0.97, r"this font software is licensed under the sil open font license"),
    ("ofl", 1, 0.93, r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("openssl", 1, 0.95, r"this product includes software developed by the openssl project"),
    ("openssl", 1, 0.93, r"the names openssl toolkit and openssl project must not be used to endorse"),
    ("postgresql", 1, 0.93, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("postgresql", 1, 0.93, r"in no event shall the university of california be liable to any party"),
    ("ncsa", 1, 0.93, r"to deal with the software without restriction including without limitation"),
    ("ncsa", 1, 0.95, r"distributed under the university of illinois open source license"),
    ("mspl", 1, 0.95, r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("eupl", 1, 0.97, r"licensed under the eupl"),
    ("eupl", 1, 0.93, r"unless required by applicable law or agreed to in writing software distributed under the licence is distributed"),
    ("osl", 1, 0.95, r"licensed under the open software license version"),
    ("afl", 1, 0.95, r"licensed under the academic free license version"),
    ("qpl", 1, 0.93, r"this license applies to any software containing a notice placed by the copyright holder saying that it may be distributed under the terms of the q public license"),
    ("cecill", 1, 0.95, r"this software is governed by the cecill(?: [bc])? license"),
    ("cecill", 1, 0.93, r"ce logiciel est regi par la licence cecill"),
    ("odbl", 1, 0.95, r"this .{1,60}is made available under the open database license"),
    ("sspl", 1, 0.95, r"you can redistribute it and or modify it under the terms of the server side public license"),
    ("sspl", 2, 0.85, r"offering the program as a service"),
    ("busl", 1, 0.95, r"use of this software is governed by the business source license"),
    ("busl", 2, 0.85, r"change date .{0,60}change license"),
    ("cc0", 1, 0.97, r"has waived all copyright and related or neighbou?ring rights"),
    ("cc0", 1, 0.95, r"to the extent possible under law .{1,120}waived all copyright"),
    ("cc-by", 2, 0.85, r"this work is licensed under a creative commons attribution \d"),
    ("cc-by-sa", 1, 0.95, r"this work is licensed under (?:a|the) creative commons attribution share ?alike"),
    ("cc-by-nc", 1, 0.9, r"this work is licensed under (?:a|the) creative commons attribution non ?commercial \d"),
    ("cc-by-nd", 1, 0.95, r"this work is licensed under (?:a|the) creative commons attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", 1, 0.95, r"this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", 1, 0.95, r"this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv(?:ative)?s"),
    ("public-domain", 5, 0.8, r"this (?:work|file|software|document) is in the public domain"),
    ("public-domain", 6, 0.7, r"the author(?:s)? (?:hereby )?disclaims? copyright to this source code"),
    ("proprietary", 5, 0.8, r"unauthori[sz]ed (?:copying|use|reproduction) (?:or distribution )?of this (?:file|software|document|program)"),
    ("proprietary", 6, 0.7, r"no part of this (?:work|document|publication|software) may be reproduced"),
    ("proprietary", 6, 0.7, r"this software is the (?:confidential and )?proprietary (?:information|property) of"),
    ("public-domain", 6, 0.7, r"(?:released|placed|dedicated)(?: \w+)? (?:in|into|to) the public domain"),
    ("proprietary", 6, 0.7, r"proprietary and confidential"),
    ("proprietary", 7, 0.5, r"all rights reserved"),
    ("copyright", 8, 0.4, r"copyright (?:c )?(?:19|20)\d\d"),
    ("no-warranty", 8, 0.4, r"without warrant(?:y|ies) (?:of|or) (?:any kind|conditions)"),
]

_SEPARATORS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes(0x20 if b in _SEPARATORS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


class Rule(NamedTuple):
    priority: int
    weight: float
    label: str
    implied: list[tuple[bytes, ...]]
    pattern: re.Pattern


class Found(NamedTuple):
    label: str
    first: int
    last: int
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules in the order in which they are tried: every family in every form, then the sentences."""
    found = []
    for priority, weight, form in FORMS:
        for label, name, ident, url in FAMILIES:
            bare = BARE.get(label)
            parts = {"name": name, "id": ident, "url": url, "bare": bare, "gnu": bare if bare and "gnu " in bare else None}
            if all(parts[k] for k in re.findall(r"\{([a-z]+)\}", form)):
                found.append((priority, weight, label, form.format(**parts)))
    found += [(p, w, label, x) for label, p, w, x in TEXTS]
    found = [Rule(p, w, label, implied(x), _whole(x)) for p, w, label, x in found]
    return sorted(found, key=lambda r: r.priority)


def implied(pattern: str) -> list[tuple[bytes, ...]]:
    """Sets of literals, of each of which every match of the pattern holds at least one; the smallest sets first."""

    def of(parts) -> list[tuple[str, ...]]:
        found, run = [], ""
        for kind, value in [*parts, (None, None)]:
            if kind is _parser.LITERAL:
                run += chr(value)
                continue
            if len(run) > 1:
                found.append((run,))
            run = ""
            if kind is _parser.SUBPATTERN:
                found += of(value[3])
            elif kind is _parser.MAX_REPEAT and value[0] > 0:
                found += of(value[2])
            elif kind is _parser.BRANCH:
                ways = [of(way) for way in value[1]]
                if all(ways):
                    # of each way its most telling set
                    found.append(tuple(sorted({x for way in ways for x in max(way, key=lambda s: min(map(len, s)))})))
        return found

    return sorted((tuple(x.encode() for x in s) for s in of(_parser.parse(pattern))), key=len)


def _whole(pattern: str) -> re.Pattern:
    return re.compile(rb"(?<![^ ])(?:" + pattern.encode() + rb")(?![^ ])")


_RULES: list[Rule] = []


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def suppressed(found: list[Found]) -> list[Found]:
    """Without detections whose words lie within an accepted detection of the same or a better priority.

    An index of the accepted ones holds, for every first word, how far those reach that begin there or before.
    """
    place = {first: i for i, first in enumerate(sorted({x.first for x in found}), 1)}
    reach = [-1] * (len(place) + 1)
    kept: list[Found] = []
    for x in sorted(found, key=lambda x: (x.priority, x.first - x.last, x.first, x.label)):
        at, last = place[x.first], -1
        while at:
            last = max(last, reach[at])
            at &= at - 1
        if last >= x.last:
            continue
        kept.append(x)
        at = place[x.first]
        while at < len(reach):
            reach[at] = max(reach[at], x.last)
            at += at & -at
    return sorted(kept, key=lambda x: (x.first, x.last))


def detect(words: list[bytes]) -> list[Found]:
    """Accepted detections in a text's words, by place."""
    if not _RULES:
        _RULES.extend(rules())
    line = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    has: dict[tuple[bytes, ...], bool] = {}
    found = []
    for rule in _RULES:
        for some in rule.implied:
            if some not in has:
                has[some] = any(x in line for x in some)
            if not has[some]:
                break
        else:
            for m in rule.pattern.finditer(line):
                first, last = bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1) - 1
                found.append(Found(rule.label, first, last, rule.priority, rule.weight))
    return suppressed(found)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """First word and label of every place of a base phrase."""
    found = []
    for phrase, label in BASE.items():
        want = phrase.encode().split()
        at = -1
        while True:
            try:
                at = words.index(want[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(want)] == want:
                found.append((at, label))
    return found


def scan_text(text: str | None) -> dict:
    words = words_of(text)
    out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "found": []}
    present = set(words) if words else ()
    if not present:
        return out
    base = base_places(words) if b"license" in present else []
    found = detect(words)
    rest = 1.0
    for x in found:
        rest *= 1 - x.weight
    for _ in base:
        rest *= 0.2
    out |= {
        "n_base": len(base),
        "first_word": min(base)[0] if base else None,
        "last_word": max(base)[0] if base else None,
        "base_labels": ",".join(sorted({label for _, label in base})),
        "labels": ",".join(sorted({x.label for x in found} | {label for _, label in base})),
        "score": round(1 - rest, 6),
        "found": [{"label": x.label, "first_word": x.first, "last_word": x.last, "priority": x.priority} for x in found],
    }
    return out


_SCHEMA = pa.schema([
    ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
    ("found", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("priority", pa.int32())]))),
])
_TYPES = ("n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
          "found array<struct<label: string, first_word: bigint, last_word: bigint, priority: int>>")


def scan(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: words, places and labels of base phrases, all labels, score and ``found``, the accepted detections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE_BYTES):
            rows = pa.RecordBatch.from_pylist([scan_text(t) for t in part.column(1).to_pylist()], _SCHEMA)
            yield pa.RecordBatch.from_arrays([part.column(0), *rows.columns], names=["key", *_SCHEMA.names])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, {_TYPES}").withColumnRenamed("key", key)
