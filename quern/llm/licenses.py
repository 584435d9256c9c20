"""License scans by ordered signature rules (operator 3).

Rules are regular expressions over the lower-cased UTF-8 bytes of a text. A text is searched only if one of a few gate words
occurs in it, and a rule only if all of its keywords do. Detections are taken in order of priority, then length, then
place; one that lies inside a detection taken before is suppressed. Base rules, a phrase's words standing
consecutively, are counted at all their places before any suppression and their labels always stay.

Sentences of license texts are written out one by one, with their variants. Names, versions and identifiers are listed once
per license, and each form of reference is one template. An SPDX expression gives each of its terms. Scores
combine the certainty of the rules kept: 1 - product of (1 - certainty).

Defined cases. Null or empty text: no words, no labels, score 0. Texts are searched whole, of any length. A place is a start
position; the same words at one place count once for each phrase. Rows keep their number and order has
no meaning. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import bounded_batches, lean, slices

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label: names as written in prose | SPDX identifiers | further signature phrases
LICENSES = {
    "mit": ("mit license|mit licence|expat license|x11 license", "mit|x11", "permission is hereby granted, free of charge, to any person obtaining a copy|the above copyright notice and this permission notice shall be included in all copies"),
    "apache": ("apache license|apache licence|apache software license", "apache-1.0|apache-1.1|apache-2.0", "http://www.apache.org/licenses/license-2.0|https://www.apache.org/licenses/license-2.0|apache license, version 2.0"),
    "gpl": ("gnu general public license|general public license|gnu gpl|gpl license", "gpl-1.0|gpl-2.0|gpl-3.0|gpl-2.0-only|gpl-2.0-or-later|gpl-3.0-only|gpl-3.0-or-later", "either version 2 of the license, or (at your option) any later version|either version 3 of the license, or (at your option) any later version|gplv2|gplv3"),
    "lgpl": ("gnu lesser general public license|lesser general public license|gnu library general public license|gnu lgpl", "lgpl-2.0|lgpl-2.1|lgpl-3.0|lgpl-2.1-only|lgpl-2.1-or-later|lgpl-3.0-only|lgpl-3.0-or-later", "lgplv2|lgplv3"),
    "agpl": ("gnu affero general public license|affero general public license|gnu agpl", "agpl-1.0|agpl-3.0|agpl-3.0-only|agpl-3.0-or-later", "agplv3"),
    "bsd-2-clause": ("simplified bsd license|2-clause bsd license|freebsd license", "bsd-2-clause", ""),
    "bsd-3-clause": ("new bsd license|modified bsd license|3-clause bsd license|revised bsd license", "bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors"),
    "bsd-4-clause": ("original bsd license|4-clause bsd license", "bsd-4-clause", "all advertising materials mentioning features or use of this software"),
    "bsd": ("bsd license|bsd licence|bsd-style license", "bsd", "redistribution and use in source and binary forms, with or without modification"),
    "bsd-0-clause": ("zero-clause bsd license|0-clause bsd license", "0bsd", ""),
    "isc": ("isc license|isc licence", "isc", "permission to use, copy, modify, and/or distribute this software for any purpose"),
    "mpl": ("mozilla public license|mozilla public licence", "mpl-1.0|mpl-1.1|mpl-2.0", "http://mozilla.org/mpl/2.0|https://mozilla.org/mpl/2.0"),
    "epl": ("eclipse public license", "epl-1.0|epl-2.0", "http://www.eclipse.org/legal/epl"),
    "cddl": ("common development and distribution license", "cddl-1.0|cddl-1.1", ""),
    "cpl": ("common public license", "cpl-1.0", ""),
    "eupl": ("european union public licence|european union public license", "eupl-1.1|eupl-1.2", ""),
    "artistic": ("artistic license|perl artistic license", "artistic-1.0|artistic-2.0", ""),
    "boost": ("boost software license", "bsl-1.0", "http://www.boost.org/license_1_0.txt"),
    "zlib": ("zlib license|zlib/libpng license", "zlib", "altered source versions must be plainly marked as such"),
    "unlicense": ("the unlicense|unlicense license", "unlicense", "this is free and unencumbered software released into the public domain"),
    "cc0": ("creative commons zero|cc0 license|cc0 1.0 universal", "cc0-1.0", "creativecommons.org/publicdomain/zero"),
    "cc-by": ("creative commons attribution license|creative commons attribution", "cc-by-2.0|cc-by-2.5|cc-by-3.0|cc-by-4.0", "creativecommons.org/licenses/by/"),
    "cc-by-sa": ("creative commons attribution-sharealike|creative commons attribution sharealike", "cc-by-sa-2.0|cc-by-sa-2.5|cc-by-sa-3.0|cc-by-sa-4.0", "creativecommons.org/licenses/by-sa/"),
    "cc-by-nc": ("creative commons attribution-noncommercial|creative commons attribution noncommercial", "cc-by-nc-2.0|cc-by-nc-3.0|cc-by-nc-4.0", "creativecommons.org/licenses/by-nc/"),
    "cc-by-nd": ("creative commons attribution-noderivatives|creative commons attribution-noderivs", "cc-by-nd-3.0|cc-by-nd-4.0", "creativecommons.org/licenses/by-nd/"),
    "gfdl": ("gnu free documentation license|free documentation license", "gfdl-1.1|gfdl-1.2|gfdl-1.3", ""),
    "wtfpl": ("do what the fuck you want to public license", "wtfpl", ""),
    "python": ("python software foundation license|psf license", "psf-2.0|python-2.0", ""),
    "postgresql": ("postgresql license|postgresql licence", "postgresql", ""),
    "openssl": ("openssl license", "openssl", "this product includes software developed by the openssl project"),
    "php": ("php license", "php-3.0|php-3.01", ""),
    "ruby": ("ruby license", "ruby", ""),
    "vim": ("vim license", "vim", ""),
    "ms-pl": ("microsoft public license", "ms-pl", ""),
    "ms-rl": ("microsoft reciprocal license", "ms-rl", ""),
    "osl": ("open software license", "osl-1.0|osl-2.0|osl-2.1|osl-3.0", ""),
    "afl": ("academic free license", "afl-2.0|afl-2.1|afl-3.0", ""),
    "ncsa": ("university of illinois/ncsa open source license|ncsa open source license", "ncsa", ""),
    "upl": ("universal permissive license", "upl-1.0", ""),
    "sspl": ("server side public license", "sspl-1.0", ""),
    "busl": ("business source license", "busl-1.1", ""),
    "elastic": ("elastic license", "elastic-2.0", ""),
    "ofl": ("sil open font license|open font license", "ofl-1.0|ofl-1.1", ""),
    "odbl": ("open database license|open data commons open database license", "odbl-1.0", ""),
    "openrail": ("open responsible ai license|responsible ai license", "openrail", ""),
    "public-domain": ("", "", "released into the public domain|dedicated to the public domain|placed in the public domain|in the public domain"),
    "proprietary": ("", "", "all rights reserved|proprietary and confidential|may not be reproduced without permission|unauthorized copying of this file"),
    "no-warranty": ("", "", "without warranty of any kind|without any warranty|warranties or conditions of any kind"),
}
#: label, certainty, pattern: sentences of license texts and notices. A blank stands for any gap between words.
SIGNATURES = (
    ("mit", 0.95, r"permission is hereby granted free of charge to any (?:person|entity) obtaining (?:a copy|copies) of (?:this|the) (?:software|font|program|work)"),
    ("mit", 0.8, r"the (?:software|program) is provided as is without warrant(?:y|ies) of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", 0.7, r"rights to use copy modify merge publish distribute sublicense and or sell copies of the (?:software|program)"),
    ("mit", 0.7, r"licensed under (?:the )?(?:terms of (?:the )?)?mit(?: x11)?(?: license)?"),
    ("apache", 0.95, r"licensed under the apache license version (?:1 0|1 1|2 0) the license you may not use this (?:file|work|software) except in compliance with the license"),
    ("apache", 0.9, r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache", 0.85, r"distributed (?:under the license is distributed )?on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions"),
    ("apache", 0.8, r"grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache", 0.8, r"licensed under (?:the )?(?:terms of (?:the )?)?apache(?: license)?(?: version)? v?[12](?: [01])?"),
    ("gpl", 0.95, r"redistribute it and or modify it under the terms of (?:version [123] of )?the gnu general public license"),
    ("gpl", 0.9, r"either version (?:1|2|3|2 1) of the license or (?:at|by) your option any later version"),
    ("gpl", 0.85, r"you should have received a copy of the gnu general public license along with (?:this|the) (?:program|file|library|software|package)"),
    ("gpl", 0.85, r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", 0.8, r"distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability"),
    ("gpl", 0.8, r"licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?gpl ?(?:v ?|version )?[123]?"),
    ("lgpl", 0.95, r"redistribute it and or modify it under the terms of (?:version [23](?: [01])? of )?the gnu (?:lesser|library) general public license"),
    ("lgpl", 0.85, r"you should have received a copy of the gnu (?:lesser|library) general public license along with"),
    ("lgpl", 0.8, r"licensed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?lgpl ?(?:v ?|version )?[23]?(?: [01])?"),
    ("agpl", 0.95, r"redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl", 0.85, r"you should have received a copy of the gnu affero general public license along with"),
    ("agpl", 0.8, r"offer all users interacting with it remotely through a computer network (?:if your version supports such interaction )?an opportunity to receive the corresponding source"),
    ("bsd", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 0.7, r"redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 0.7, r"redistributions in binary form must reproduce the (?:above )?copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 0.9, r"neither the names? of (?:the )?(?:copyright holders?|university|author|company|organi[sz]ation|[a-z0-9]+(?: [a-z0-9]+){0,5}) nor the names of (?:its|the|any) (?:other )?contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ments?"),
    ("isc", 0.9, r"permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-0-clause", 0.9, r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("mpl", 0.95, r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", 0.85, r"the contents of this file are subject to the mozilla public license version (?:1 0|1 1|2 0)"),
    ("epl", 0.9, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", 0.9, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", 0.9, r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("eupl", 0.9, r"licensed under the eupl(?: version)?(?: v)? ?1 [0-2]"),
    ("artistic", 0.85, r"(?:redistribute it and or modify it )?under the same terms as perl itself"),
    ("boost", 0.95, r"(?:distributed|licensed|released) under the boost software license version 1 0"),
    ("boost", 0.85, r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("zlib", 0.9, r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 0.85, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 0.85, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", 0.9, r"to the extent possible under law (?:[a-z0-9]+ ){1,8}(?:has|have) (?:dedicated|waived) all copyright and related (?:or|and) neighboring rights"),
    ("cc-by", 0.9, r"licensed under (?:a |the )?creative commons attribution(?: (?:[1-4] [05])?(?: international| generic| unported)?)? license"),
    ("cc-by-sa", 0.9, r"(?:licensed |available )?under (?:a |the )?creative commons attribution share ?alike(?: [1-4] [05])?(?: international| generic| unported)?(?: license)?"),
    ("cc-by-nc", 0.9, r"under (?:a |the )?creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| generic| unported)?(?: license)?"),
    ("cc-by-nd", 0.9, r"under (?:a |the )?creative commons attribution no ?derivs(?: [1-4] [05])?(?: international| generic| unported)?(?: license)?"),
    ("gfdl", 0.95, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("wtfpl", 0.9, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("python", 0.9, r"psf hereby grants licensee a nonexclusive royalty free world ?wide license"),
    ("openssl", 0.9, r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php", 0.85, r"this product includes php software freely available from"),
    ("ms-pl", 0.85, r"this license governs use of the accompanying software (?:if you use the software you accept this license|published by microsoft)"),
    ("osl", 0.85, r"licensed under the open software license version [123] [01]"),
    ("afl", 0.85, r"licensed under the academic free license version [123] [01]"),
    ("ncsa", 0.85, r"to deal with the software without restriction including without limitation the rights to use copy modify merge"),
    ("upl", 0.9, r"a perpetual worldwide non exclusive no charge royalty free irrevocable copyright and patent license to the extent"),
    ("sspl", 0.9, r"offer(?:ing)? the functionality of the program or modified version to third parties as a service"),
    ("busl", 0.9, r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic", 0.9, r"you may not provide the software to third parties as a hosted or managed service"),
    ("ofl", 0.95, r"this font software is licensed under the sil open font license version 1 [01]"),
    ("odbl", 0.9, r"made available under the open database license"),
    ("openrail", 0.85, r"use based restrictions (?:as )?(?:referenced|set forth) in (?:paragraph|attachment)"),
    ("public-domain", 0.85, r"the author disclaims copyright to this source code"),
    ("public-domain", 0.8, r"(?:is |was |been |hereby )(?:dedicated|released|placed|put)(?: by its authors?)? (?:in|into|to) the public domain"),
    ("proprietary", 0.6, r"(?:contains|is) (?:the )?(?:trade secrets? or )?confidential (?:and|or) proprietary information of"),
    ("proprietary", 0.6, r"no part of this (?:publication|document|work|book) may be reproduced(?: stored)?(?: in a retrieval system)?(?: or transmitted)?"),
    ("proprietary", 0.5, r"copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)?[0-9][0-9])?(?: [a-z0-9]+){1,6} all rights reserved"),
    ("no-warranty", 0.5, r"in no event (?:shall|will) the (?:authors?|copyright holders?|contributors|regents)(?: or (?:copyright holders?|contributors|licensors))? be liable for any (?:claim|direct|damages)"),
)
#: Identifiers that say enough where they stand alone, beside all that hold a hyphen and a version.
ALONE = ("wtfpl", "0bsd", "unlicense", "gplv2", "gplv3", "lgplv2", "lgplv3", "agplv3")
#: Single words, since any gap may stand between two. A text without any of them, or of those that gates() adds, can't match a rule.
GATES = ("licen", "copyright", "spdx", "gpl", "domain", "reserved", "commons", "cc0", "warrant", "proprietary", "unauthorized", "permission", "redistribution", "bsd", "mozilla", "apache", "boost", "eclipse", "advertising", "altered", "openssl")

_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BEFORE, _AFTER = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    certainty: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern[bytes]


def _words(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower().encode())


def _phrase(text: str) -> bytes:
    return _GAP.join(map(re.escape, _words(text)))


def _rule(label: str, priority: int, certainty: float, body: bytes, keywords: list[bytes]) -> Rule:
    return Rule(label, priority, certainty, tuple(sorted(set(keywords), key=lambda k: (-len(k), k))[:4]), re.compile(_BEFORE + body + _AFTER))


def _needed(pattern: str) -> list[bytes]:
    """Words, or parts of words, that all texts have which a signature matches: those outside groups, classes and what is optional."""
    at = "(?:"
    while at:
        pattern, at = re.subn(r"\((?:\?:)?[^()]*\)(?:\?|\{[^}]*\})?", "|", pattern)
    pattern = re.sub(r"\[[^\]]*\](?:\?|\+|\{[^}]*\})?|.\?", "|", pattern)
    return [w.encode() for w in re.findall(r"[a-z0-9]+", pattern)]


def rules() -> list[Rule]:
    """All rules, of highest priority (smallest number) first."""
    out = []
    version = _GAP + rb"(?:(?:version|v)" + _GAP + rb")?v?[0-9]+(?:" + _GAP + rb"[0-9]+)*"
    for label, (names, identifiers, signatures) in LICENSES.items():
        for text in filter(None, signatures.split("|")):
            out.append(_rule(label, 1, 0.9 if label not in ("proprietary", "no-warranty") else 0.5, _phrase(text), _words(text)))
        for text in filter(None, identifiers.split("|")):
            tag = _phrase("spdx license identifier") + _GAP + _phrase(text)
            out.append(_rule(label, 0, 0.99, tag, [b"spdx", b"identifier", *_words(text)]))
            field = rb"licen[cs]e" + _GAP + _phrase(text)
            out.append(_rule(label, 4, 0.7, field, [b"licen", *_words(text)]))
        for text in filter(None, names.split("|")):
            own = _words(text)
            out.append(_rule(label, 2, 0.95, rb"(?:licen[cs]ed|released|distributed|available|published)" + _GAP + rb"under" + _GAP + rb"(?:the" + _GAP + rb"terms" + _GAP + rb"of" + _GAP + rb")?(?:the" + _GAP + rb")?" + _phrase(text), [b"under", *own]))
            out.append(_rule(label, 3, 0.9, _phrase(text) + version, own))
            out.append(_rule(label, 5, 0.8, _phrase(text), own))
    term = rb"[0-9a-z]+(?:[-.+][0-9a-z]+)*\+?"
    for label, (_, identifiers, _) in LICENSES.items():
        for text in filter(None, identifiers.split("|")):
            before = _phrase("spdx license identifier") + rb"(?:" + _GAP + term + _GAP + rb"(?:and|or|with)){1,12}" + _GAP
            out.append(_rule(label, 0, 0.99, before + rb"(?P<at>" + _phrase(text) + rb")", [b"spdx", b"identifier", *_words(text)]))
            if text in ALONE or ("-" in text and text[-1].isdigit()):
                out.append(_rule(label, 7, 0.5, _phrase(text), _words(text)))
    for label, certainty, text in SIGNATURES:
        out.append(_rule(label, 1, certainty, text.encode().replace(b" ?", b"(?:" + _GAP + b")?").replace(b" ", _GAP), _needed(text)))
    for phrase, label in BASE.items():
        out.append(_rule(label, 6, 0.6, _phrase(phrase), _words(phrase)))
    return sorted(out, key=lambda r: r.priority)


def gates(every: list[Rule]) -> list[bytes]:
    """Words of which each rule needs one: GATES, and the longest keyword of a rule that needs none of them."""
    out = [g.encode() for g in GATES]
    for rule in every:
        if not any(g in k for g in out for k in rule.keywords):
            out.append(rule.keywords[0])
    return out


class Scanner:
    """Searches texts given as lower-cased bytes."""

    def __init__(self) -> None:
        self._rules = rules()
        self._gates = gates(self._rules)
        self._keywords = sorted({k for r in self._rules for k in r.keywords})
        self._base = [(label, _words(p), re.compile(_BEFORE + _phrase(p) + _AFTER)) for p, label in BASE.items()]

    def base(self, low: bytes) -> list[tuple[int, int, str]]:
        """Start, end and label of all base places."""
        out = []
        for label, words, pattern in self._base:
            if all(w in low for w in words):
                at = pattern.search(low)
                while at:
                    out.append((at.start(), at.end(), label))
                    at = pattern.search(low, at.start() + 1)
        return sorted(out)

    def spans(self, low: bytes) -> list[tuple[int, int, Rule]]:
        """Detections that are kept, by place."""
        if not any(g in low for g in self._gates):
            return []
        there = {k for k in self._keywords if k in low}
        found = []
        for n, r in enumerate(self._rules):
            if there.issuperset(r.keywords):
                at = "at" if r.pattern.groupindex else 0
                found += [(r.priority, m.start(at) - m.end(at), m.start(at), m.end(at), n) for m in r.pattern.finditer(low)]
        kept: list[tuple[int, int, Rule]] = []
        near: dict[int, list[tuple[int, int]]] = {}  # intervals taken, by the blocks of bytes that they touch
        for _, _, a, b, n in sorted(found):
            if not any(s <= a and b <= e for s, e in near.get(a >> 7, ())):
                kept.append((a, b, self._rules[n]))
                for block in range(a >> 7, (b >> 7) + 1):
                    near.setdefault(block, []).append((a, b))
        return sorted(kept, key=lambda x: x[:2])

    def scan(self, low: bytes) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, Rule]], list[str], float]:
        """Base places, detections kept, all labels and the score."""
        base = self.base(low)
        kept = self.spans(low)
        doubt = {}
        for _, _, rule in kept:
            doubt[rule.label] = min(doubt.get(rule.label, 1.0), 1 - rule.certainty)
        for _, _, label in base:
            doubt.setdefault(label, 0.4)
        return base, kept, sorted(doubt), 1 - float(np.prod(list(doubt.values()))) if doubt else 0.0


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def scan_licenses(docs: DataFrame, with_spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and, if asked for, spans (label, start, end in bytes)."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", *["spans"] * with_spans]
    long, string = pa.int64(), pa.string()
    span = pa.list_(pa.struct([("label", string), ("start", long), ("end", long)]))
    kinds = [long, long, long, long, long, string, string, pa.float64(), *[span] * with_spans]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scanner()
        for batch in batches:
            for piece in slices(batch, 1024, "text"):
                out = []
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    low = _LOWER[np.frombuffer((text or "").encode(), dtype=np.uint8)]
                    inside = _IS_WORD[low]
                    starts = inside.copy()
                    starts[1:] &= ~inside[:-1]
                    raw = low.tobytes()
                    base, kept, labels, score = own.scan(raw)
                    at = [int(np.count_nonzero(starts[:a])) for a in (base[0][0], base[-1][0])] if base else [None, None]
                    row = (doc_id, int(np.count_nonzero(starts)), len(base), *at, ",".join(sorted({x for _, _, x in base})), ",".join(labels), score)
                    out.append(row + ([{"label": r.label, "start": a, "end": b} for a, b, r in kept],) * with_spans)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    shape = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(scan), shape + ", spans array<struct<label: string, start: long, end: long>>" * with_spans)
