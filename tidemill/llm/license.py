"""License scans by ordered signature rules.

A text is lower-cased (A-Z) and cut into words; rules are regular expressions over
the words joined by single spaces.  A rule runs only on texts that hold one of its
keywords.  All detections of a text compete: they are taken by priority, then length,
then place, and one that lies inside the interval of a detection already taken is
suppressed.  Base phrases are reported apart from the rules and are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext

#: Phrases (words joined by a space) and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))


@dataclass(frozen=True)
class Rule:
    label: str
    keywords: tuple[bytes, ...]  # every text that the pattern matches holds one of them at the start of a word
    pattern: re.Pattern[bytes]
    priority: int
    weight: float


# How a notice names its license.  {n} is a name below, {v} its versions.
_LEAD = r"(?:licen[cs]ed|released|distributed|published|available|provided|covered|made available)"
_UNDER = r"(?:under|by|with|in accordance with|subject to|pursuant to)"
_THE = r"(?: the| a| an)?(?: terms(?: and conditions)? of(?: the)?| conditions of(?: the)?)?"
_TITLE = r"(?: public)?(?: software)?(?: licen[cs]e)?"
_VERSION = r"(?: (?:version|v|ver))? ?{v}"

# label | keywords | name, as words | versions, each as words; empty: the license has none
_FAMILIES = """
apache | apache | apache(?: software)? | 1 0, 1 1, 2 0
gpl | gpl | (?:gnu )?gpl | 1, 2, 3
gpl | general public | (?:gnu )?general public | 1, 2, 3
lgpl | lgpl | (?:gnu )?lgpl | 2, 2 1, 3
lgpl | lesser general | (?:gnu )?lesser general public | 2 1, 3
lgpl | library general | (?:gnu )?library general public | 2
agpl | agpl | (?:gnu )?agpl | 1, 3
agpl | affero | (?:gnu )?affero general public | 1, 3
gfdl | free documentation | (?:gnu )?free documentation | 1 1, 1 2, 1 3
mit | mit, expat | (?:mit|expat|mit x11) |
bsd | bsd | (?:new |modified |simplified |original |revised )?bsd |
bsd-2-clause | bsd | (?:2|two) clause bsd |
bsd-3-clause | bsd | (?:3|three) clause bsd |
bsd-4-clause | bsd | (?:4|four) clause bsd |
isc | isc | isc |
mpl | mozilla | mozilla public | 1 0, 1 1, 2 0
mpl | mpl | mpl | 1 0, 1 1, 2 0
epl | eclipse | eclipse public | 1 0, 2 0
edl | eclipse | eclipse distribution | 1 0
cddl | cddl | cddl | 1 0, 1 1
cddl | common development | common development and distribution | 1 0, 1 1
cpl | common public | common public | 1 0
ipl | ibm public | ibm public | 1 0
eupl | eupl | eupl | 1 0, 1 1, 1 2
eupl | european union | european union public | 1 0, 1 1, 1 2
cecill | cecill | cecill(?: [abc])? | 1 0, 2 0, 2 1
artistic | artistic | (?:clarified )?artistic | 1 0, 2 0
perl | perl | same terms as perl(?: itself)? |
zlib | zlib | zlib(?: libpng)? |
libpng | libpng | libpng | 2 0
boost | boost | boost(?: software)? | 1 0
bsl | bsl | bsl | 1 0, 1 1
unlicense | unlicense | (?:the )?unlicense |
wtfpl | wtfpl, do what the fuck | (?:do what the fuck you want to|wtfpl) | 1, 2
ofl | ofl | (?:sil )?ofl | 1 0, 1 1
ofl | open font | (?:sil )?open font | 1 0, 1 1
python | python | python(?: software foundation)? | 2
php | php | php | 3 0, 3 01
ruby | ruby | ruby |
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? |
postgresql | postgresql | postgresql |
openssl | openssl | openssl |
vim | vim | vim |
zope | zope | zope | 1 1, 2 0, 2 1
osl | open software | open software | 1 0, 2 0, 2 1, 3 0
afl | academic free | academic free | 1 1, 2 0, 2 1, 3 0
apsl | apple public | apple public source | 1 0, 2 0
mspl | microsoft public | microsoft public |
msrl | microsoft reciprocal | microsoft reciprocal |
odbl | open database | open database | 1 0
odbl | odbl | odbl | 1 0
odcby | open data commons | open data commons attribution | 1 0
pddl | public domain dedication | public domain dedication and | 1 0
ogl | open government | open government | 1 0, 2 0, 3 0
oasis | oasis | oasis |
w3c | w3c | w3c(?: software notice and)? |
unicode | unicode | unicode(?: data files and)? |
x11 | x11 | x11 |
beerware | beerware, beer ware | beer ?ware | 42
sspl | server side | server side public | 1
elastic | elastic | elastic | 2 0
busl | business source | business source | 1 0, 1 1
polyform | polyform | polyform (?:noncommercial|shield|small business|strict) | 1 0
openrail | openrail, open rail, creativeml | (?:creativeml )?(?:open ?rail|openrail)(?: [ms])? |
llama | llama | llama(?: [23](?: [0-9])?)? community |
"""

# Creative Commons: element words | label | title
_CC_ELEMENTS = """
by nc nd | cc-by-nc-nd | attribution noncommercial noderiv(?:ative)?s(?: works)?
by nc sa | cc-by-nc-sa | attribution noncommercial share ?alike
by nc | cc-by-nc | attribution noncommercial
by nd | cc-by-nd | attribution noderiv(?:ative)?s(?: works)?
by sa | cc-by-sa | attribution share ?alike
by | cc-by | attribution
"""
_CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

# Whole statements: label | keywords | pattern | priority | weight
_STATEMENTS = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy | 80 | 0.95
isc | permission to use copy | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee | 80 | 0.95
bsd | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted | 80 | 0.95
bsd-3-clause | neither the name | neither the name of .{1,120}? may be used to endorse or promote products | 82 | 0.95
bsd-4-clause | advertising materials | all advertising materials mentioning features or use of this software must display | 84 | 0.95
gpl | free software | this program is free software you can redistribute it and or modify it | 70 | 0.9
lgpl | free software | this library is free software you can redistribute it and or modify it | 72 | 0.9
gpl | either version | either version (?:[0-9]+) (?:of the license )?or (?:at your option )?any later version | 60 | 0.7
apache | in compliance with the license | you may not use this file except in compliance with the license | 70 | 0.85
apache | as is basis | distributed on an as is basis without warranties or conditions of any kind | 65 | 0.8
mpl | source code form | this source code form is subject to the terms of the mozilla public license | 80 | 0.95
zlib | provided as is | this software is provided as is without any express or implied warranty | 70 | 0.85
boost | boost software | boost software license version 1 0 (?:august )?(?:17(?:th)? )?(?:2003)? | 75 | 0.9
unlicense | public domain | free and unencumbered software released into the public domain | 80 | 0.95
public-domain | public domain | (?:placed|released|dedicated) (?:in|into|to) the public domain | 60 | 0.85
public-domain | public domain | this (?:work|file|software|text) is (?:in|hereby released into) the public domain | 62 | 0.85
public-domain | no rights reserved | no rights reserved | 55 | 0.8
cc0 | cc0 | cc0(?: 1 0)?(?: universal)? | 75 | 0.9
cc0 | waived all copyright | (?:has )?waived all copyright and related or neighboring rights | 75 | 0.9
copyleft | copyleft | copyleft | 20 | 0.5
proprietary | proprietary and confidential, confidential and proprietary | (?:proprietary and confidential|confidential and proprietary) | 60 | 0.9
proprietary | unauthorized copying | unauthorized copying of this (?:file|document|work) | 60 | 0.9
proprietary | may not be reproduced | (?:no part of this .{1,60}? )?may not be reproduced | 50 | 0.8
proprietary | without prior written, without the prior written | without (?:the )?prior written (?:permission|consent) | 40 | 0.6
proprietary | end user license, end user licence | end user licen[cs]e agreement | 45 | 0.7
proprietary | for internal use only | for internal use only | 40 | 0.6
proprietary | licensor | (?:the )?licensor (?:reserves|retains) all (?:other )?rights | 45 | 0.7
non-commercial | non commercial, noncommercial, for non commercial, for noncommercial | (?:for )?non ?commercial (?:use|purposes) only | 50 | 0.8
non-commercial | personal use | for personal use only | 40 | 0.6
research-only | research | for (?:academic )?research (?:use|purposes) only | 50 | 0.8
copyright | copyright | copyright (?:c )?(?:1[89]|20)[0-9]{2} | 30 | 0.6
copyright | copyrighted | copyrighted (?:material|work) | 25 | 0.5
copyright | protected by copyright | protected by copyright(?: law)? | 25 | 0.5
reserved | all rights reserved | all rights reserved | 15 | 0.6
some-rights | some rights reserved | some rights reserved | 35 | 0.6
unspecified | license, licence | see (?:the )?licen[cs]e(?: file)?(?: txt| md)? for (?:details|more information|terms) | 10 | 0.3
unspecified | license, licence | licen[cs]e (?:agreement|terms) (?:apply|applies) | 8 | 0.3
unspecified | licensed, licenced | this (?:work|software|document) is licen[cs]ed under | 5 | 0.3
mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software | 81 | 0.95
mit | in no event shall the authors | in no event shall the authors or copyright holders be liable for any claim damages or other liability | 64 | 0.8
mit | permission is hereby granted without written agreement | permission is hereby granted without written agreement and without license or royalty fees | 81 | 0.9
mit-0 | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software .{1,300}? to whom the software is furnished to do so the software is provided | 85 | 0.95
isc | provided that the above copyright notice | provided that the above copyright notice and this permission notice appear in all copies | 66 | 0.8
isc | the author disclaims all warranties | the author disclaims all warranties with regard to this software | 64 | 0.8
0bsd | permission to use copy | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted(?: the software is provided)? | 83 | 0.95
bsd | redistributions of source code | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer | 78 | 0.95
bsd-2-clause | redistributions in binary form | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer | 79 | 0.95
bsd | this software is provided by the | this software is provided by the (?:copyright holders|regents|author|authors)(?: and contributors)? as is | 68 | 0.85
bsd-3-clause | the names of its contributors, the name of the author | (?:the names of its contributors|the name of the author) may (?:not )?be used to endorse or promote products | 82 | 0.9
bsd-patent | patent license, patent licence | subject to the terms and conditions of this licen[cs]e each copyright holder .{1,80}? patent licen[cs]e | 76 | 0.85
gpl | without even the implied warranty | without even the implied warranty of merchantability or fitness for a particular purpose | 55 | 0.7
gpl | you should have received a copy of the gnu general public | you should have received a copy of the gnu general public licen[cs]e | 71 | 0.95
lgpl | you should have received a copy of the gnu | you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e | 73 | 0.95
agpl | you should have received a copy of the gnu affero | you should have received a copy of the gnu affero general public licen[cs]e | 74 | 0.95
agpl | remote network interaction | remote network interaction use with the gnu general public licen[cs]e | 72 | 0.9
gpl | everyone is permitted to copy | everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document | 77 | 0.9
gpl | linking this library | linking this library statically or dynamically with other modules is making a combined work | 70 | 0.85
gpl | as a special exception | as a special exception .{1,120}? (?:gives?|give you) permission to link | 69 | 0.8
gpl | copyleft licence, copyleft license | copyleft licen[cs]e for software and other kinds of works | 70 | 0.85
lgpl | this library is distributed in the hope | this library is distributed in the hope that it will be useful | 71 | 0.85
gpl | this program is distributed in the hope | this program is distributed in the hope that it will be useful | 69 | 0.85
gfdl | with no invariant sections | with no invariant sections(?: with)? no front cover texts and(?: with)? no back cover texts | 78 | 0.95
gfdl | permission is granted to copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e | 80 | 0.95
apache | licensed to the apache software foundation | licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements | 80 | 0.95
apache | www apache org licenses | (?:http|https) www apache org licenses(?: license 2 0)? | 66 | 0.9
apache | unless required by applicable law | unless required by applicable law or agreed to in writing | 62 | 0.8
apache | perpetual worldwide non exclusive | perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) licen[cs]e | 74 | 0.9
mpl | if a copy of the mpl | if a copy of the mpl was not distributed with this file you can obtain one | 79 | 0.95
mpl | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public licen[cs]e version 1 [01] | 81 | 0.95
npl | netscape public | (?:the )?netscape public licen[cs]e | 70 | 0.9
cddl | the contents of this file are subject to the terms of the common development | the contents of this file are subject to the terms of the common development and distribution licen[cs]e | 82 | 0.95
epl | this program and the accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse | 80 | 0.95
epl | eclipse org legal | eclipse org legal epl (?:v10|2 0) | 75 | 0.9
zlib | this notice may not be removed | this notice may not be removed or altered from any source distribution | 79 | 0.95
zlib | the origin of this software must not be misrepresented | the origin of this software must not be misrepresented | 78 | 0.95
zlib | altered source versions | altered source versions must be plainly marked as such | 77 | 0.95
boost | permission is hereby granted free of charge to any person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation | 84 | 0.95
unlicense | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software | 82 | 0.95
unlicense | unlicense org | unlicense org | 70 | 0.85
wtfpl | you just do what the fuck | you just do what the fuck you want to | 80 | 0.95
beerware | as long as you retain this notice | as long as you retain this notice you can do whatever you want with this stuff | 80 | 0.9
artistic | the intent of this document is to state the conditions | the intent of this document is to state the conditions under which a package may be copied | 80 | 0.95
perl | you can redistribute it and or modify it under the same terms as perl | you can redistribute it and or modify it under the same terms as perl(?: itself)? | 76 | 0.9
ofl | this font software is licensed | this font software is licensed under the sil open font licen[cs]e | 82 | 0.95
ofl | the goals of the open font license | the goals of the open font license ofl are to stimulate worldwide development | 80 | 0.9
postgresql | permission to use copy modify and distribute this software and its documentation | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement | 83 | 0.95
openssl | this product includes software developed by the openssl | this product includes software developed by the openssl project | 80 | 0.95
ssleay | this product includes cryptographic software | this product includes cryptographic software written by eric young | 80 | 0.95
php | this product includes php software | this product includes php software freely available from | 80 | 0.9
bsd-4-clause | this product includes software developed by | this product includes software developed by | 60 | 0.7
x11 | except as contained in this notice | except as contained in this notice the names? of .{1,80}? shall not be used in advertising | 82 | 0.9
ijg | independent jpeg group | this software is based in part on the work of the independent jpeg group | 80 | 0.9
freetype | portions of this software are copyright | portions of this software are copyright .{1,40}? the freetype project | 80 | 0.9
curl | curl license, curl licence | curl licen[cs]e | 60 | 0.8
icu | icu license, icu licence | icu licen[cs]e(?: icu 1 8 1 and later)? | 60 | 0.8
ms-pl | microsoft public license ms pl, microsoft public licence ms pl | microsoft public licen[cs]e ms pl | 80 | 0.9
ms-limited | microsoft limited public | microsoft limited public licen[cs]e | 80 | 0.9
sspl | making the functionality of the program | making the functionality of the program available to third parties as a service | 80 | 0.9
elastic | you may not provide the software to third parties | you may not provide the software to third parties as a hosted or managed service | 80 | 0.9
commons-clause | commons clause | commons clause(?: licen[cs]e condition)? | 75 | 0.85
commons-clause | the grant of rights under the license will not include | the grant of rights under the license will not include .{1,60}? the right to sell the software | 82 | 0.95
busl | change date | change date .{1,60}? change licen[cs]e | 60 | 0.8
openrail | use based restrictions | use based restrictions as referenced in paragraph 5 | 70 | 0.85
openrail | responsible ai license, responsible ai licence | responsible ai licen[cs]e | 65 | 0.8
llama | llama 2 is licensed, llama 3 is licensed | llama [23] is licensed under the llama [23] community licen[cs]e | 85 | 0.95
gemma | gemma terms of use | gemma terms of use | 70 | 0.9
cc0 | to the extent possible under law | to the extent possible under law .{1,120}? waived all copyright | 78 | 0.95
cc0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0 | 80 | 0.95
public-domain | creativecommons org publicdomain mark | creativecommons org publicdomain mark 1 0 | 80 | 0.95
public-domain | public domain mark | public domain mark 1 0 | 75 | 0.9
public-domain | is not subject to copyright | (?:this )?(?:work|software|document) is not subject to copyright protection in the united states | 70 | 0.9
public-domain | work of the united states government, work of the u s government | (?:a )?work of the (?:united states|u s) government | 58 | 0.8
public-domain | no known copyright | no known copyright restrictions | 56 | 0.8
cc-by | you are free to share | you are free to share copy and redistribute the material in any medium or format | 57 | 0.75
cc-by | you must give appropriate credit | you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made | 57 | 0.8
cc-by-sa | if you remix transform | if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e | 60 | 0.85
cc-by-nc | you may not use the material for commercial purposes | you may not use the material for commercial purposes | 60 | 0.85
cc-by-nd | you may not distribute the modified material | (?:if you remix transform or build upon the material )?you may not distribute the modified material | 61 | 0.85
odbl | this data is made available under the open database | this data is made available under the open database licen[cs]e | 82 | 0.95
odbl | openstreetmap contributors | openstreetmap contributors | 40 | 0.6
ogl | contains public sector information | contains public sector information licen[cs]ed under the open government licen[cs]e | 82 | 0.95
crown | crown copyright | crown copyright(?: and database rights?)? | 45 | 0.7
etalab | licence ouverte, license ouverte | licen[cs]e ouverte(?: open licen[cs]e)? | 70 | 0.85
dl-de | datenlizenz deutschland | datenlizenz deutschland (?:namensnennung|zero)(?: version)? 2 0 | 75 | 0.9
reserved | tous droits r, alle rechte vorbehalten, todos los derechos reservados | (?:tous droits réservés|alle rechte vorbehalten|todos los derechos reservados) | 35 | 0.7
proprietary | this software is the confidential | this software is the confidential and proprietary information of | 65 | 0.9
proprietary | you may not copy modify | you may not copy modify (?:distribute )?(?:sell )?(?:or )?(?:lease )?any part of (?:our|the|this) (?:services?|software) | 55 | 0.8
proprietary | no license express, no licence express | no licen[cs]e express or implied by estoppel or otherwise | 50 | 0.7
proprietary | reverse engineer | (?:may not |not )?reverse engineer decompile or disassemble | 42 | 0.6
proprietary | for evaluation purposes only | for evaluation purposes only | 45 | 0.7
proprietary | do not distribute | (?:confidential )?do not distribute | 30 | 0.5
proprietary | contain trade, contains trade, contain confidential, contains confidential | contains? (?:confidential information and )?trade secrets? of | 45 | 0.6
terms | by using this | by using this (?:site|website|service) you agree to (?:be bound by )?(?:the|these|our) terms | 20 | 0.4
terms | terms of service | (?:see|read) (?:the|our) terms of service | 12 | 0.3
educational | for educational | for educational (?:and research )?purposes only | 45 | 0.7
educational | fair use | (?:constitutes a )?fair use of any such copyrighted material | 40 | 0.6
shareware | shareware | this (?:program|software) is shareware | 45 | 0.7
freeware | freeware | this (?:program|software) is freeware | 45 | 0.7
attribution | reprinted with permission, reproduced with permission, used with permission | (?:reprinted|reproduced|used) with permission(?: of the (?:author|publisher|copyright holder))? | 30 | 0.5
"""


def _table(text: str) -> list[list[str]]:
    return [[x.strip() for x in line.split("|")] if "(" not in line else _cells(line) for line in text.strip().splitlines()]


def _cells(line: str) -> list[str]:
    """Cells split at bars that stand outside brackets."""
    out, depth, cell = [], 0, ""
    for c in line:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append(cell.strip())
            cell = ""
        else:
            cell += c
    return [*out, cell.strip()]


def _rule(label: str, keywords: str, pattern: str, priority: int, weight: float) -> Rule:
    return Rule(label, tuple(k.strip().encode() for k in keywords.split(",")), re.compile(rf"(?<![^ ]){pattern}(?![^ ])".encode()), priority, weight)


@cache
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first.

    Each family of the tables has a notice ("licensed under ..."), a title ("... license
    version n") and an identifier form, for every version and without one.
    """
    found: list[Rule] = []
    for label, keyword, name, versions in _table(_FAMILIES):
        forms = [v.strip() for v in versions.split(",") if v.strip()]
        for v in forms:
            tagged = label + "-" + v.replace(" ", ".")
            found.append(_rule(tagged, keyword, f"{_LEAD} {_UNDER}{_THE} {name}{_TITLE}{_VERSION.format(v=v)}", 95, 0.98))
            found.append(_rule(tagged, keyword, f"{name}{_TITLE}{_VERSION.format(v=v)}(?: or later| only)?", 90, 0.9))
        found.append(_rule(label, keyword, f"{_LEAD} {_UNDER}{_THE} {name}{_TITLE}", 60, 0.9))
        found.append(_rule(label, keyword, f"{name}(?: public)?(?: software)? licen[cs]e", 50, 0.8))
        found.append(_rule(label, "spdx", f"spdx license identifier {name}(?: [0-9]+)*(?: or later| only)?", 97, 0.99))
    for elements, label, title in _table(_CC_ELEMENTS):
        for v in _CC_VERSIONS:
            found.append(_rule(f"{label}-{v.replace(' ', '.')}", "cc by", f"cc {elements} {v}(?: international| unported| generic)?", 92, 0.95))
            found.append(_rule(f"{label}-{v.replace(' ', '.')}", "creative commons", f"creative commons {title} {v}", 93, 0.97))
            found.append(_rule(f"{label}-{v.replace(' ', '.')}", "creativecommons", f"creativecommons org licenses {elements} {v}", 94, 0.99))
        found.append(_rule(label, "cc by", f"cc {elements}", 58, 0.85))
        found.append(_rule(label, "creative commons", f"creative commons {title}(?: licen[cs]e)?", 59, 0.9))
    for label, keyword, pattern, priority, weight in _table(_STATEMENTS):
        found.append(_rule(label, keyword, pattern, int(priority), float(weight)))
    return tuple(sorted(found, key=lambda r: -r.priority))


@cache
def _prefilter() -> ahocorasick.Automaton:
    """Finds, in one pass over a text, the keywords that start at a word, each with its rules."""
    groups: dict[bytes, list[Rule]] = {}
    for rule in rules():
        for keyword in rule.keywords:
            groups.setdefault(keyword, []).append(rule)
    automaton = ahocorasick.Automaton()
    for keyword, group in groups.items():
        automaton.add_word(" " + keyword.decode(), tuple(group))
    automaton.make_automaton()
    return automaton


_SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))
_TO_WORDS = bytes.maketrans(bytes(range(65, 91)) + bytes(c for c in _SEPARATORS if not 65 <= c <= 90), bytes(range(97, 123)) + b" " * sum(not 65 <= c <= 90 for c in _SEPARATORS))


def normalised(text: bytes) -> bytes:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, joined by one space."""
    return b" ".join(text.translate(_TO_WORDS).split())


def places(words: bytes, phrase: bytes) -> list[int]:
    """Start of every occurrence of a phrase as whole words, overlapping ones included."""
    found, at = [], words.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or words[at - 1] == 32) and (end == len(words) or words[end] == 32):
            found.append(at)
        at = words.find(phrase, at + 1)
    return found


def hits(words: bytes) -> list[tuple[Rule, int, int]]:
    """Every match of the rules whose keywords a text holds: (rule, start, end)."""
    groups = {group for _, group in _prefilter().iter(" " + words.decode("latin-1"))}
    return [(r, m.start(), m.end()) for r in {id(r): r for group in groups for r in group}.values() for m in r.pattern.finditer(words)]


def detect(words: bytes) -> list[tuple[Rule, int, int]]:
    """Detections that stay: (rule, start, end) in the normalised text, best first."""
    return unsuppressed(hits(words))


def unsuppressed(found: list[tuple[Rule, int, int]]) -> list[tuple[Rule, int, int]]:
    """By priority, length and place, those that lie in no interval taken before.

    An interval that holds (a, b) starts at a or before and ends at b or after; so the
    furthest end of those taken, by start, is kept in a tree of prefix maxima.
    """
    found = sorted(found, key=lambda h: (-h[0].priority, h[1] - h[2], h[1], h[0].label))
    starts = sorted({a for _, a, _ in found})
    rank = {a: i + 1 for i, a in enumerate(starts)}
    furthest = [-1] * (len(starts) + 1)
    kept: list[tuple[Rule, int, int]] = []
    for hit in found:
        i, end = rank[hit[1]], -1
        while i:
            end = max(end, furthest[i])
            i &= i - 1
        if end < hit[2]:
            kept.append(hit)
            i = rank[hit[1]]
            while i < len(furthest):
                furthest[i] = max(furthest[i], hit[2])
                i += i & -i
    return kept


def scan_text(text: bytes) -> dict:
    """All results for one text, with spans in words from 0."""
    words = normalised(text)
    base = sorted((at, label) for phrase, label in BASE_PHRASES for at in places(words, phrase.encode()))
    kept = detect(words)
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) if base or kept else np.zeros(0, np.int64)
    word_at = lambda at: int(np.searchsorted(spaces, at))
    base_labels = sorted({label for _, label in base})
    return {
        "n_words": words.count(b" ") + 1 if words else 0,
        "n_base": len(base),
        "first_word": word_at(base[0][0]) if base else None,
        "last_word": word_at(base[-1][0]) if base else None,
        "base_labels": ",".join(base_labels),
        "labels": ",".join(sorted({*base_labels, *(r.label for r, _, _ in kept)})),
        "score": max([0.0, *(r.weight for r, _, _ in kept)]) if kept else (0.5 if base else 0.0),
        "detections": [{"label": r.label, "first_word": word_at(a), "last_word": word_at(b), "priority": r.priority} for r, a, b in kept],
    }


SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, detections array<struct<label:string,first_word:bigint,last_word:bigint,priority:int>>"
_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
    + [("detections", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("priority", pa.int32())])))]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, data, offsets in arrowtext.chunks(batch):
            raw = data.tobytes()
            rows = [scan_text(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            columns = [part.column("doc_id"), *(pa.array([r[f.name] for r in rows], f.type) for f in list(_ARROW)[1:])]
            yield pa.RecordBatch.from_arrays(columns, schema=_ARROW)


def scan(documents: DataFrame) -> DataFrame:
    """License findings of every document: base phrases, labels, score and detections.

    A row for each row of documents, in no order.  A null or empty text has no words,
    no labels (empty strings), null first and last word and score 0.  Long texts are
    scanned whole; repeated rows give repeated results; other columns are ignored; an
    empty table gives no rows.
    """
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scan, SCHEMA)
