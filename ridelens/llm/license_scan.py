"""License mentions by ordered signature rules.

Each rule is a regular expression over the words of a text, joined by single spaces,
with words that gate it: only the rules whose gate words occur in a text run on it.
Rules have a priority. Of overlapping detections, one that lies inside the interval of
a detection of higher priority (or of the same priority and longer) is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelens.llm.tables import table

#: Labels and phrases that are counted at every place, fixed values of the scan.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Names of licenses as they are written out: label, gate words (any of them), pattern.
# ``~`` stands for "license" in either spelling, ``#`` for "version" or "v" and nothing.
_NAMES = r"""
gpl | gpl general | gnu gpl|gpl ~|(?:gnu )?general public ~
gpl-3.0 | gpl gnu general | (?:gnu )?(?:general public ~|gpl) #3(?: 0)?
gpl-2.0 | gpl gnu general | (?:gnu )?(?:general public ~|gpl) #2(?: 0)?
gpl-1.0 | gpl gnu general | (?:gnu )?(?:general public ~|gpl) #1(?: 0)?
gpl-3.0-or-later | gpl gnu general | (?:gnu )?(?:general public ~|gpl) #3(?: 0)? or(?: at your option)?(?: any)? later
gpl-2.0-or-later | gpl gnu general | (?:gnu )?(?:general public ~|gpl) #2(?: 0)? or(?: at your option)?(?: any)? later
gpl-3.0-only | gpl gnu general | (?:gnu )?(?:general public ~|gpl) #3(?: 0)? only
gpl-2.0-only | gpl gnu general | (?:gnu )?(?:general public ~|gpl) #2(?: 0)? only
lgpl-3.0 | lgpl lesser | (?:gnu )?(?:lesser general public ~|lgpl) #3(?: 0)?
lgpl-2.1 | lgpl lesser | (?:gnu )?(?:lesser general public ~|lgpl) #2 1
lgpl-2.0 | lgpl library | (?:gnu )?(?:library general public ~|lgpl) #2(?: 0)?
lgpl | lgpl lesser library | (?:gnu )?(?:(?:lesser|library) general public ~|lgpl)
agpl-3.0 | agpl affero | (?:gnu )?(?:affero general public ~|agpl) #3(?: 0)?
agpl-1.0 | affero | affero general public ~ #1(?: 0)?
agpl | agpl affero | (?:gnu )?(?:affero general public ~|agpl)
gfdl-1.3 | gfdl documentation | (?:gnu free documentation ~|gfdl) #1 3
gfdl-1.2 | gfdl documentation | (?:gnu free documentation ~|gfdl) #1 2
gfdl-1.1 | gfdl documentation | (?:gnu free documentation ~|gfdl) #1 1
gfdl | gfdl documentation | (?:gnu free documentation ~|gfdl)
apache-2.0 | apache asl | (?:the )?apache(?: software)? ~ #2(?: 0)?|apache 2 0|asl 2 0
apache-1.1 | apache | apache(?: software)? ~ #1 1|apache 1 1
apache-1.0 | apache | apache(?: software)? ~ #1 0|apache 1 0
apache | apache | (?:the )?apache(?: software)? ~
cc-by-4.0 | cc attribution | (?:cc by|creative commons attribution) 4 0
cc-by-3.0 | cc attribution | (?:cc by|creative commons attribution) 3 0
cc-by-2.5 | cc attribution | (?:cc by|creative commons attribution) 2 5
cc-by-2.0 | cc attribution | (?:cc by|creative commons attribution) 2 0
cc-by-1.0 | cc attribution | (?:cc by|creative commons attribution) 1 0
cc-by-sa-4.0 | cc attribution | (?:cc by sa|creative commons attribution share ?alike) 4 0
cc-by-sa-3.0 | cc attribution | (?:cc by sa|creative commons attribution share ?alike) 3 0
cc-by-sa-2.5 | cc attribution | (?:cc by sa|creative commons attribution share ?alike) 2 5
cc-by-sa-2.0 | cc attribution | (?:cc by sa|creative commons attribution share ?alike) 2 0
cc-by-sa | cc attribution | (?:cc by sa|creative commons attribution share ?alike)
cc-by-nc-4.0 | cc attribution | (?:cc by nc|creative commons attribution non ?commercial) 4 0
cc-by-nc-3.0 | cc attribution | (?:cc by nc|creative commons attribution non ?commercial) 3 0
cc-by-nc-2.5 | cc attribution | (?:cc by nc|creative commons attribution non ?commercial) 2 5
cc-by-nc-2.0 | cc attribution | (?:cc by nc|creative commons attribution non ?commercial) 2 0
cc-by-nc | cc attribution | (?:cc by nc|creative commons attribution non ?commercial)
cc-by-nd-4.0 | cc attribution | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?) 4 0
cc-by-nd-3.0 | cc attribution | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?) 3 0
cc-by-nd | cc attribution | (?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?(?: works)?)
cc-by-nc-sa-4.0 | cc attribution | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0
cc-by-nc-sa-3.0 | cc attribution | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 3 0
cc-by-nc-sa-2.0 | cc attribution | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 2 0
cc-by-nc-sa | cc attribution | (?:cc by nc sa|creative commons attribution non ?commercial share ?alike)
cc-by-nc-nd-4.0 | cc attribution | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?) 4 0
cc-by-nc-nd-3.0 | cc attribution | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?) 3 0
cc-by-nc-nd | cc attribution | (?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?)
cc-by | attribution | creative commons attribution
cc0-1.0 | cc0 zero | cc0(?: 1 0)?|creative commons zero(?: #1 0)?|cc zero
cc-pdm-1.0 | mark | public domain mark(?: 1 0)?
creative-commons | commons | creative commons(?: ~)?
mit | license licence | (?:the )?mit(?: x11)? ~
mit-0 | mit | mit no attribution|mit 0 ~
mit-modern | mit | mit ~ modern variant
x11 | x11 | x11 ~
expat | expat | expat ~
isc | isc internet | isc ~|internet systems consortium ~
bsd-4-clause | bsd | (?:original |old )bsd ~|bsd 4 clause(?: ~)?|four clause bsd ~|4 clause bsd ~
bsd-3-clause | bsd | (?:new |revised |modified )bsd ~|bsd 3 clause(?: ~)?|three clause bsd ~|3 clause bsd ~
bsd-2-clause | bsd freebsd | simplified bsd ~|freebsd ~|bsd 2 clause(?: ~)?|two clause bsd ~|2 clause bsd ~
bsd-1-clause | bsd | bsd 1 clause(?: ~)?
0bsd | 0bsd bsd | 0bsd(?: ~)?|zero clause bsd(?: ~)?|free public ~ 1 0 0
bsd | bsd | (?:the )?bsd(?: style)? ~
mpl-2.0 | mpl mozilla | (?:mozilla public ~|mpl) #2(?: 0)?
mpl-1.1 | mpl mozilla | (?:mozilla public ~|mpl) #1 1
mpl-1.0 | mpl mozilla | (?:mozilla public ~|mpl) #1 0
mpl | mozilla | mozilla public ~
epl-2.0 | epl eclipse | (?:eclipse public ~|epl) #2(?: 0)?
epl-1.0 | epl eclipse | (?:eclipse public ~|epl) #1(?: 0)?
epl | eclipse | eclipse public ~
edl-1.0 | eclipse | eclipse distribution ~(?: #1 0)?
cddl-1.1 | cddl | (?:common development and distribution ~(?: cddl)?|cddl) #1 1
cddl-1.0 | cddl development | (?:common development and distribution ~(?: cddl)?|cddl) #1 0
cddl | cddl development | common development and distribution ~|cddl
cpl-1.0 | common | common public ~(?: #1 0)?
ipl-1.0 | ibm | ibm public ~(?: #1 0)?
eupl-1.2 | eupl european | (?:european union public ~(?: eupl)?|eupl) #1 2
eupl-1.1 | eupl european | (?:european union public ~(?: eupl)?|eupl) #1 1
eupl | eupl european | european union public ~|eupl
artistic-2.0 | artistic | artistic ~ #2(?: 0)?
artistic-1.0 | artistic | artistic ~ #1(?: 0)?
artistic | artistic | artistic ~
bsl-1.0 | boost | boost software ~(?: #1 0)?
busl-1.1 | business busl | (?:business source ~|busl) #1 1
busl | business | business source ~
sspl-1.0 | sspl server | server side public ~(?: #1)?|sspl(?: #1)?
elastic-2.0 | elastic | elastic ~(?: #?2(?: 0)?)?
unlicense | unlicense | (?:the )?unlicense(?: ~)?
wtfpl | wtfpl fuck | wtfpl|do what the fuck you want to public ~
zlib | zlib | zlib(?: libpng)? ~
libpng | libpng | libpng ~(?: #2)?
openssl | openssl | openssl ~
ssleay | ssleay | (?:original )?ssleay ~
psf-2.0 | python psf | python software foundation ~(?: #2)?|psf ~(?: #2)?
python-2.0 | python | python ~ #2(?: 0)?
ruby | ruby | ruby ~
php-3.01 | php | php ~(?: #3 0?1)?
perl | perl | same terms as perl(?: itself)?
ofl-1.1 | ofl sil | sil open font ~(?: #1 1)?|ofl 1 1
ofl-1.0 | ofl sil | sil open font ~ #1 0|ofl 1 0
ubuntu-font-1.0 | ubuntu | ubuntu font ~(?: #?1 0)?
bitstream-vera | bitstream | bitstream vera(?: fonts)? ~
odbl-1.0 | odbl database | open (?:data commons open )?database ~|odbl(?: #?1 0)?
odc-by-1.0 | odc commons | odc by(?: 1 0)?|open data commons attribution ~(?: #?1 0)?
pddl-1.0 | pddl commons | (?:open data commons )?public domain dedication and ~|pddl(?: 1 0)?
cdla-permissive-2.0 | cdla community | community data ~ agreement permissive #2 0|cdla permissive 2 0
cdla-permissive-1.0 | cdla community | community data ~ agreement permissive #1 0|cdla permissive 1 0
cdla-sharing-1.0 | cdla community | community data ~ agreement sharing #1 0|cdla sharing 1 0
ogl-uk-3.0 | ogl government | open government ~ #3(?: 0)?|ogl 3 0
ogl-uk-2.0 | ogl government | open government ~ #2(?: 0)?|ogl 2 0
ogl-uk-1.0 | government | open government ~ #1(?: 0)?
ogl | government | open government ~
etalab-2.0 | etalab | etalab(?: open)? ~ 2 0|etalab 2 0
dl-de-by-2.0 | datenlizenz | datenlizenz deutschland namensnennung #?2 0
dl-de-zero-2.0 | datenlizenz | datenlizenz deutschland zero #?2 0
cecill-2.1 | cecill | cecill(?: ~)? #?2 1
cecill-b | cecill | cecill b(?: ~)?
cecill-c | cecill | cecill c(?: ~)?
cecill | cecill | cecill(?: ~)?
ms-pl | microsoft | microsoft public ~|ms pl
ms-rl | microsoft | microsoft reciprocal ~|ms rl
apsl-2.0 | apple | apple public source ~(?: #?2 0)?
ncsa | ncsa illinois | (?:university of illinois )?ncsa(?: open source)? ~
afl-3.0 | afl academic | academic free ~ #?3 0|afl 3 0
afl-2.1 | afl academic | academic free ~ #?2 1|afl 2 1
afl | academic | academic free ~
osl-3.0 | osl open | open software ~ #?3 0|osl 3 0
osl-2.1 | osl open | open software ~ #?2 1|osl 2 1
osl | open | open software ~
qpl-1.0 | qpl public | q public ~(?: #?1 0)?|qpl 1 0
lppl-1.3c | lppl latex | latex project public ~(?: #?1 3c?)?|lppl(?: 1 3c?)?
upl-1.0 | universal | universal permissive ~(?: #?1 0)?
mulan-2.0 | mulan | mulan psl #?2|mulan permissive software ~ #?2
sleepycat | sleepycat | sleepycat ~
vim | vim | vim ~
curl | curl | curl ~
json | json | json ~
postgresql | postgresql | postgresql ~
ntp | ntp | ntp ~
icu | icu | icu ~
unicode-dfs | unicode | unicode(?: data files and software)? ~(?: agreement)?
w3c | w3c | w3c(?: software)?(?: notice and)? ~
intel | intel | intel open source ~
nasa-1.3 | nasa | nasa open source agreement(?: #?1 3)?
naist-2003 | naist | naist ~
blueoak-1.0.0 | oak | blue oak model ~(?: 1 0 0)?
parity-7.0.0 | parity | parity public ~(?: 7 0 0)?
polyform-nc-1.0.0 | polyform | polyform noncommercial ~(?: 1 0 0)?
commons-clause | clause | commons clause(?: ~)?(?: condition)?
hippocratic-2.1 | hippocratic | hippocratic ~(?: 2 1)?
openrail-m | openrail rail | (?:creativeml |bigscience )?open ?rail m?(?: ~)?|bigscience rail ~
llama-community | llama | llama(?: \d)*(?: community)? ~(?: agreement)?
gemma-terms | gemma | gemma terms of use
beerware | beer beerware | beer ?ware(?: ~)?
fair | fair | fair ~
jsr-spec | jsr | jsr \d+ specification ~
"""

# Passages of license texts and notices: label, gate words, pattern.
_PASSAGES = r"""
mit | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | noninfringement | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit-0 | hereby | permission is hereby granted free of charge to any person obtaining a copy of this software(?: \S+){1,40} without restriction(?: \S+){1,40} to do so the software is provided
isc | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
0bsd | purpose | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
bsd | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause | redistributions | redistributions in binary form must reproduce the above copyright notice
bsd-3-clause | endorse | neither the name of(?: \S+){1,20} contributors may be used to endorse or promote products derived from this software
bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
apache-2.0 | compliance | you may not use this file except in compliance with the ~
apache-2.0 | contributor | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public ~
lgpl | redistribute | you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public ~
agpl | redistribute | you can redistribute it and or modify it under the terms of the gnu affero general public ~
gpl-or-later | option | either version \d(?: \d)? of the ~ or at your option any later version
gpl | copyleft | the gnu general public ~ is a free copyleft ~
gpl | foundation | as published by the free software foundation
gpl-preamble | freedom | the ~s for most software(?: and other practical works)? are designed to take away your freedom
gfdl | invariant | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts
mpl-2.0 | mpl | subject to the terms of the mozilla public ~ v 2 0
mpl-2.0 | mpl | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | initial | the initial developer of the original code is
epl | accompanying | this program and the accompanying materials are made available under the terms of the eclipse public ~
cddl | cddl | when distributing covered code include this cddl header
bsl-1.0 | accompanying | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib | altered | altered source versions must be plainly marked as such
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | you just do what the fuck you want to
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer
cc0-1.0 | waive | to the extent possible under law(?: \S+){1,20} waived all copyright and related or neighboring rights
cc-by-sa | alike | if you remix transform or build upon the material you must distribute your contributions under the same ~
cc-by-nc | commercial | you may not use the material for commercial purposes
cc-by-nd | remix | if you remix transform or build upon the material you may not distribute the modified material
cc-by | attribution | you must give appropriate credit provide a link to the ~ and indicate if changes were made
ofl-1.1 | font | this font software is ~d under the sil open font ~
odbl-1.0 | database | made available under the open database ~
artistic | artistic | standard version refers to such a package if it has not been modified
openssl | openssl | this product includes software developed by the openssl project
ssleay | young | this product includes cryptographic software written by eric young
psf-2.0 | psf | psf is making python available to ~e on an as is basis
json | evil | the software shall be used for good not evil
json | evil | for good not evil
unicode-dfs | unicode | data files or software are furnished
sspl-1.0 | service | making the functionality of the program or modified version available to third parties as a service
commons-clause | sell | the ~ does not grant to you the right to sell the software
busl | licensor | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
public-domain | domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | domain | this (?:work|file|document|text|software) is in the public domain
public-domain | government | is a work of the united states government
proprietary | reserved | all rights reserved
proprietary | proprietary | (?:confidential and proprietary|proprietary and confidential)
proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|use)(?: \S+){0,8} (?:is )?(?:strictly )?prohibited
proprietary | permission | may not be (?:copied|reproduced|distributed|used)(?: \S+){0,12} without(?: \S+){0,3} (?:written )?permission
proprietary | eula | end user ~ agreement(?: eula)?
non-commercial | commercial | for (?:personal|educational|academic|research)(?: and| or)? ?(?:personal|educational|academic|research)? ?(?:non ?commercial )?use only
non-commercial | commercial | (?:free )?for non ?commercial use
no-warranty | warranty | (?:provided|distributed) (?:as is|in the hope that it will be useful)(?: but)? without any warranty
copyright | copyright | copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?
contributor-agreement | contributor | contributor ~ agreement
dual-license | dual | dual ~[ds]?e?d? under
"""

_GRANT = (
    r"(?:licensed|released|distributed|available|published|provided|shared|covered|issued|offered)"
    r"(?: (?:by|to) \S+)? under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?(?:conditions of the )?"
)
#: Form of a rule: priority (smaller wins), trust in it.
FORMS = {
    "identifier": (0, 1.0),
    "passage": (1, 0.95),
    "grant": (2, 0.9),
    "name": (3, 0.7),
    "base": (4, 0.6),
}


class Rule(NamedTuple):
    """``pattern`` runs on a text if all sets of ``gates`` have a word in it."""

    label: str
    form: str
    gates: tuple[frozenset[bytes], ...]
    pattern: re.Pattern[bytes]

    @property
    def priority(self) -> int:
        return FORMS[self.form][0]

    @property
    def trust(self) -> float:
        return FORMS[self.form][1]


class Detection(NamedTuple):
    """Words ``start`` up to ``stop`` of a text, found by rule number ``rule``."""

    label: str
    form: str
    rule: int
    start: int
    stop: int
    kept: bool


def rule(label: str, form: str, gates: Iterable[str], pattern: str) -> Rule:
    """A rule from its parts; each of ``gates`` lists words, one of which must occur."""
    spelled = pattern.replace("~", "licen[sc]e").replace("#", "(?:version |ver |v ?)?")
    return Rule(
        label,
        form,
        tuple(frozenset(g.encode().split()) for g in gates),
        re.compile(f" (?:{spelled})(?= )".encode()),
    )


def _lines(lines: str) -> Iterator[tuple[str, str, str]]:
    for line in lines.strip().splitlines():
        label, gate, pattern = line.split(" | ", 2)
        yield label, gate, pattern


def _identifier(label: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", label))


def standard_rules() -> list[Rule]:
    """The signature rules in order: identifiers, passages, grants, names, base phrases."""
    names = list(_lines(_NAMES))
    labels = sorted({label for label, _, _ in names})
    rules = [
        rule(label, "identifier", ["spdx"], f"spdx ~ identifier {_identifier(label)}") for label in labels
    ]
    rules += [rule(label, "passage", [gate], pattern) for label, gate, pattern in _lines(_PASSAGES)]
    rules += [
        rule(label, "grant", ["under", gate], f"{_GRANT}(?:{pattern})") for label, gate, pattern in names
    ]
    rules += [rule(label, "name", [gate], pattern) for label, gate, pattern in names]
    for phrase, label in BASE_PHRASES.items():
        # The rarer of the phrase's words gates it; "mit" is a common word in German.
        gate = {"cc by": "cc", "gnu general public license": "gnu"}.get(phrase, "license")
        rules.append(Rule(label, "base", (frozenset([gate.encode()]),), re.compile(f" {phrase}(?= )".encode())))
    return rules


_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, a to z and all that is not ASCII, with A to Z lower-cased.

    Works on UTF-8: every byte of a character beyond ASCII is above 127.
    """
    return (text or b"").translate(_BYTES).split()


class Scanner:
    """The rules, filed under the words that gate them."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_word: dict[bytes, list[int]] = {}
        for number, r in enumerate(rules):
            for word in r.gates[0]:
                self.by_word.setdefault(word, []).append(number)
        self.gating = frozenset(w for r in rules for g in r.gates for w in g)

    def candidates(self, words: list[bytes]) -> list[int]:
        """The numbers of the rules whose gates are all open."""
        there = self.gating.intersection(words)
        fetched = {n for w in there for n in self.by_word.get(w, ())}
        return sorted(n for n in fetched if all(there & g for g in self.rules[n].gates))

    def scan(self, words: list[bytes]) -> list[Detection]:
        """Every place where a candidate rule matches, by start; ``kept`` tells which are left."""
        chosen = self.candidates(words)
        if not chosen:
            return []
        text, found = b" " + b" ".join(words) + b" ", []
        for number in chosen:
            at = word = 0
            for m in self.rules[number].pattern.finditer(text):
                word += text.count(b" ", at, m.start())
                at = m.start()
                found.append((self.rules[number].priority, word, word + m.group().count(b" "), number))
        kept = uncovered(found)
        out = [
            Detection(self.rules[n].label, self.rules[n].form, n, start, stop, kept[i])
            for i, (_, start, stop, n) in enumerate(found)
        ]
        return sorted(out, key=lambda d: (d.start, -d.stop, d.rule))


def uncovered(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Which of the detections (priority, start, stop, rule) no better one contains.

    Better is a smaller priority; of equal priority a longer interval, then, for equal
    intervals, the earlier rule. Each priority is one sweep by start over its own and the
    better detections, with the furthest stop so far.
    """
    kept = [False] * len(found)
    for level in sorted({f[0] for f in found}):
        own = [i for i, f in enumerate(found) if f[0] == level]
        better = [i for i, f in enumerate(found) if f[0] < level and kept[i]]
        # Better ones come first among equal starts; longer ones before shorter ones.
        order = sorted(own + better, key=lambda i: (found[i][1], found[i][0] == level, -found[i][2], found[i][3]))
        reach = -1
        for i in order:
            if found[i][0] == level:
                kept[i] = found[i][2] > reach
            reach = max(reach, found[i][2])
    return kept


_DETECTION = pa.struct(
    [
        ("label", pa.string()),
        ("form", pa.string()),
        ("rule", pa.int32()),
        ("trust", pa.float64()),
        ("start", pa.int64()),
        ("stop", pa.int64()),
        ("kept", pa.bool_()),
    ]
)
_SCANNED = (
    "n_words long, detections array<struct<label:string,form:string,rule:int,trust:double,"
    "start:long,stop:long,kept:boolean>>"
)


def scan_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None
) -> DataFrame:
    """(doc_id, n_words, detections) of each document's whole text, one row per row.

    ``detections`` holds every place where a rule matches, in order of the first word:
    label, form and number of the rule, its trust, the words it covers and whether it is
    ``kept``, that is, not inside a better detection. Null counts as empty; a text
    without words has none. Ids may be null or repeat; other columns are not read. There
    is no shuffle. Empty in, empty out.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_SCANNED}"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(standard_rules() if rules is None else rules)
        trust = [r.trust for r in scanner.rules]
        for batch in batches:
            counts, found = [], []
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py())
                counts.append(len(words))
                found.append(
                    [
                        {"label": d.label, "form": d.form, "rule": d.rule, "trust": trust[d.rule],
                         "start": d.start, "stop": d.stop, "kept": d.kept}
                        for d in scanner.scan(words)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_DETECTION))],
                names=["doc_id", "n_words", "detections"],
            )

    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return slim.mapInArrow(scan, schema)


def licenses(docs: DataFrame, **options) -> DataFrame:
    """One row per kept detection: doc_id, label, form, trust, first and last word."""
    return (
        scan_documents(docs, **options)
        .select("doc_id", F.explode(F.filter("detections", lambda d: d["kept"])).alias("d"))
        .select(
            "doc_id", "d.label", "d.form", "d.trust",
            F.col("d.start").alias("first_word"), (F.col("d.stop") - 1).alias("last_word"),
        )
    )


def _spelled(detections: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels per document. Base phrases count wherever they stand, also inside a
    detection that suppresses them; ``labels`` adds those of the kept detections. ``score``
    is the trust in the best kept detection, 0 without any. Empty texts have empty labels."""
    scanned = scan_documents(table(spark, sf_dir, "documents"))
    base = F.filter("detections", lambda d: d["form"] == "base")
    kept = F.filter("detections", lambda d: d["kept"])
    starts = F.transform(F.col("base"), lambda d: d["start"])
    return scanned.withColumns({"base": base, "found": kept}).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        _spelled(F.col("base")).alias("base_labels"),
        _spelled(F.concat("base", "found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda d: d["trust"])), F.lit(0.0)).alias("score"),
    )
