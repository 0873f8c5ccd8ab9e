"""License scans by ordered signature rules, in SQL functions only.

Texts become words of a-z, 0-9 and characters beyond ASCII.  A rule is a hand-written pattern over words with a
label and a level; rules stand in order of their level, then as written.  Each rule has a keyword, a word that
none of its matches lacks; only rules whose keyword is among a text's words are tried, and most texts have none.

A detection is the interval of words that a rule's pattern covers (of an expression of identifiers joined by
"or" and "and", one interval an identifier).  A detection is suppressed if the interval of another contains it and that
one has a higher level, or the same level and is longer, or stands on the same words by an earlier rule.  Those
that merely overlap stay.  One pass over the detections by start decides it: what contains a detection begins
no later, so the farthest end of each level so far is enough.  Base phrases count always.

Defined cases: null text is empty; a text without words has null places, empty labels and score 0;
ids may be null or repeat, each row is scanned alone; other columns aren't read.
"""

from __future__ import annotations

import json
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._runtime import prepare

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_ASCII = [chr(c) for c in range(128)]
_APART = "".join(c for c in _ASCII if not (c.isdigit() or c.isalpha()))

# The rules, a label and a pattern over words in each line; every group ends or begins at a word's edge with its space inside.
# Level 6: fragments of license texts.
TEXTS = """
mit permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
bsd redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products
bsd all advertising materials mentioning features or use of this software must display the following acknowledge?ment
isc permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc the software is provided as is and (?:[^ ]+ ){1,4}disclaims all warranties with regard to this software
apache you may not use this (?:file|software|work) except in compliance with the license
apache unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache terms and conditions for use reproduction and distribution
apache grant of patent license subject to the terms and conditions of this license each contributor hereby grants
gpl this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl you should have received a copy of the gnu general public license along with this
gpl the gnu general public license is a free copyleft license for software and other kinds of works
gpl the licenses for most software are designed to take away your freedom to share and change it
lgpl this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
lgpl you should have received a copy of the gnu (?:lesser|library) general public license along with this
lgpl this version of the gnu lesser general public license incorporates the terms and conditions of version 3
agpl you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl you should have received a copy of the gnu affero general public license along with this
agpl the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community
gfdl permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl the purpose of this license is to make a manual textbook or other functional and useful document free in the sense of freedom
mpl this source code form is subject to the terms of the mozilla public license
mpl if a copy of the mpl was not distributed with this file you can obtain one at
mpl the contents of this file are subject to the mozilla public license version
epl this program and the accompanying materials are made available under the terms of the eclipse public license
epl the accompanying program is provided under the terms of this eclipse public license
cpl the accompanying program is provided under the terms of this common public license
cddl the contents of this file are subject to the terms of the common development and distribution license
zlib this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib altered source versions must be plainly marked as such and must not be misrepresented as being the original software
boost permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense this is free and unencumbered software released into the public domain
unlicense anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
wtfpl everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl you just do what the fuck you want to
cc0 the person who associated a work with this deed has dedicated the work to the public domain
cc0 to the extent possible under law (?:[^ ]+ ){1,8}(?:has|have) waived all copyright and related or neighboring rights
cc-by you are free to share copy and redistribute the material in any medium or format
cc-by you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-nc you may not use the material for commercial purposes
cc-by-nd if you remix transform or build upon the material you may not distribute the modified material
cc-by-sa if you remix transform or build upon the material you must distribute your contributions under the same license as the original
ofl this font software is licensed under the sil open font license
ofl the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
artistic the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
json the software shall be used for good not evil
beerware as long as you retain this notice you can do whatever you want with this stuff
beerware if we meet some day and you think this stuff is worth it you can buy me a beer in return
postgresql permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
openssl this product includes software developed by the openssl project
php redistribution of (?:[^ ]+ ){0,6}this product includes php software freely available from
ms-pl if you use the software you accept this license if you do not accept the license do not use the software
eupl licensed under the eupl(?: version)? [0-9](?: [0-9])?
ncsa the names of the university of illinois nor the names of its contributors
python psf is making python (?:[^ ]+ ){0,3}available to licensee on an as is basis
w3c permission to copy modify and distribute this software and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
odbl this (?:[^ ]+ ){1,6}is made available under the open database license
proprietary this software is the confidential and proprietary information of
proprietary unauthorized copying of this file via any medium is strictly prohibited
"""
# Level 5: identifiers, each after a marker or further identifiers of the same expression. The first word is there always.
IDS = """
0bsd 0bsd
afl afl [1-3](?: [0-2])?
agpl agpl(?: [13] 0)?(?: only| or later)?
agpl agplv3(?: only| or later)?
apache apache [12] [01]
apache apache2
apache apache license [12] 0
artistic artistic [12] 0
beerware beerware
boost bsl 1 0
bsd bsd [1-4] clause(?: clear| patent| attribution)?
busl busl 1 1
cc-by cc by [1-4] [05]
cc-by-nc cc by nc [1-4] [05]
cc-by-nc-nd cc by nc nd [1-4] [05]
cc-by-nc-sa cc by nc sa [1-4] [05]
cc-by-nd cc by nd [1-4] [05]
cc-by-sa cc by sa [1-4] [05]
cc0 cc0(?: 1 0)?
cddl cddl 1 [01]
cecill cecill [12] [01]
cecill cecill [bc]
cpl cpl 1 0
ecl ecl [12] 0
epl epl [12] 0
eupl eupl 1 [0-2]
gfdl gfdl 1 [1-3](?: only| or later)?
gpl gpl(?: [123] 0)?(?: only| or later)?
gpl gplv2(?: only| or later)?
gpl gplv3(?: only| or later)?
lgpl lgpl(?: (?:2 [01]|3 0))?(?: only| or later)?
lgpl lgplv2(?: 1)?(?: only| or later)?
lgpl lgplv3(?: only| or later)?
lppl lppl 1 [0-3][ac]?
mit mit(?: 0| cmu| modern variant)?
mpl mpl [12] [01](?: no copyleft exception)?
ms-pl ms pl
ms-rl ms rl
ncsa ncsa
odbl odbl 1 0
odc-by odc by 1 0
ofl ofl 1 [01](?: no rfn| rfn)?
osl osl [1-3] [01]
python psf 2 0
php php 3 0[01]?
qpl qpl 1 0
sspl sspl 1 0
unlicense unlicense
upl upl 1 0
wtfpl wtfpl
zpl zpl [12] [01]
"""
# Level 5 too, but these are words of their own, so only the full marker counts.
PLAIN_IDS = """
blueoak blueoak 1 0 0
curl curl
ijg ijg
isc isc
json json
openssl openssl
postgresql postgresql
python python 2 0
ruby ruby
sleepycat sleepycat
vim vim
w3c w3c(?: 20150513| 19980720)?
x11 x11
zlib zlib(?: acknowledgement)?
"""
# Level 4: notices that name a license with a version, or grant it.
NOTICES = """
agpl (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?(?:gnu )?agpl
agpl (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?(?:gnu )?affero general public license
agpl affero general public license (?:version |v )?3(?: 0)?
apache (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?apache(?: software)? license
apache apache(?: software)? license (?:version |v )?[12] [01]
apache apache license v2
artistic (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?artistic license
artistic under (?:the )?same terms as perl itself
artistic artistic license (?:version |v )?[12] 0
boost distributed under the boost software license
boost boost software license (?:version )?1 0
bsd (?:licensed |released |distributed |available )under (?:the |a )?(?:terms of the )?(?:[234] clause |new |modified |simplified |revised )?bsd(?: style)? license
bsd use of this source code is governed by a bsd style license
cc-by (?:licensed |released |distributed |available )under (?:a |the )?creative commons attribution [1-4] [05](?: international| unported| generic)? license
cc-by-nc (?:licensed |released |distributed |available )under (?:a |the )?creative commons attribution non ?commercial [1-4] [05](?: international| unported| generic)? license
cc-by-sa (?:licensed |released |distributed |available )under (?:a |the )?creative commons attribution share ?alike [1-4] [05](?: international| unported| generic)? license
cc0 (?:released |dedicated |available |waived |licensed )(?:to the public domain )?(?:under |using )(?:the )?(?:creative commons )?cc0
cddl common development and distribution license (?:version )?1 [01]
eupl european union public licen[cs]e (?:version |v )?[0-9](?: [0-9])?
epl (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?eclipse public license
epl eclipse public license (?:version |v )?[12] 0
gfdl free documentation license (?:version )?1 [1-3](?: or any later version)?
gpl (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?(?:gnu )?general public license
gpl general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?[123](?: 0)?(?: of the license)?(?: or (?:at your option )?any later version)?
gpl gpl (?:version |v )[123](?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?(?:gnu )?lgpl
lgpl (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?(?:gnu )?(?:lesser|library) general public license
lgpl (?:lesser |library )general public license (?:as published by the free software foundation )?(?:either )?(?:version |v )?(?:2(?: [01])?|3(?: 0)?)(?: of the license)?(?: or (?:at your option )?any later version)?
lgpl lgpl (?:version |v )(?:2(?: [01])?|3(?: 0)?)(?: or (?:any )?later(?: version)?)?
mit (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?mit(?: x11| style)? licen[cs]e
mit (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?(?:expat|x11) license
mit use of this source code is governed by an mit style license
mpl (?:licensed |released |distributed |available )under (?:the )?(?:terms of the )?mozilla public license
mpl mozilla public license (?:version |v )?[12] [01]
ms-pl (?:licensed |released |distributed |available )under (?:the )?microsoft public license
ofl sil open font license (?:version )?1 [01]
osl open software license (?:version |v )?[1-3] [01]
php php license (?:version )?3 0[01]?
public-domain (?:released |placed |dedicated |put )(?:in|into|to) the public domain
public-domain this (?:work|file|software|code|document) is in the public domain
python (?:licensed |released |distributed )under (?:the )?python software foundation license
python (?:licensed |released |distributed )under (?:the )?psf license
proprietary all rights reserved (?:[^ ]+ ){0,6}proprietary and confidential
sspl server side public license (?:version |v )?1
unlicense (?:released |dedicated |licensed )(?:under |by )the unlicense
wtfpl (?:licensed |released )under (?:the )?wtfpl
zlib (?:licensed |released |distributed |available )under (?:the )?zlib(?: libpng)? license
zpl zope public license (?:version )?[12] [01]
"""
# Level 3: addresses of licenses, as words.
LINKS = """
agpl gnu org licenses agpl(?: 3 0)?
apache apache org licenses license [12] [01]
apache opensource org licenses? apache 2 0
artistic opensource org licenses? artistic license 2 0
boost boost org license 1 0
bsd opensource org licenses? bsd [23] clause
bsd opensource org licenses? bsd license
cc-by creativecommons org licenses by [1-4] [05]
cc-by-nc creativecommons org licenses by nc [1-4] [05]
cc-by-nc-nd creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa creativecommons org licenses by nc sa [1-4] [05]
cc-by-nd creativecommons org licenses by nd [1-4] [05]
cc-by-sa creativecommons org licenses by sa [1-4] [05]
cc0 creativecommons org publicdomain zero 1 0
cddl opensource org licenses? cddl 1 0
cecill cecill info licences
epl eclipse org legal epl(?: v10| 2 0| v20)
eupl joinup ec europa eu (?:[^ ]+ ){0,4}eupl
gfdl gnu org (?:copyleft|licenses) fdl(?: 1 [1-3])?
gpl gnu org (?:copyleft|licenses) gpl(?: [23] 0)?
gpl gnu org licenses old licenses gpl 2 0
gpl opensource org licenses? gpl [23] 0
isc opensource org licenses? isc
lgpl gnu org (?:copyleft|licenses) lgpl(?: 3 0)?
lgpl gnu org licenses old licenses lgpl 2 1
mit opensource org licenses? mit
mpl mozilla org mpl(?: [12] [01])?
odbl opendatacommons org licenses odbl
ofl scripts sil org ofl
osl opensource org licenses? osl 3 0
php php net license 3 0[01]?
public-domain creativecommons org publicdomain mark 1 0
python python org psf license
unlicense unlicense org
w3c w3 org consortium legal (?:[0-9]{4} )?copyright software
wtfpl wtfpl net
"""
# Level 2: names.
NAMES = """
afl academic free license
agpl (?:gnu )?affero general public license
apache apache(?: software)? license
artistic (?:perl |clarified )?artistic license
beerware beer ?ware license
blueoak blue oak model license
boost boost software license
bsd bsd license
bsd [0-4] clause bsd(?: license)?
bsd (?:new |modified |simplified |revised |original )bsd license
bsd bsd [0-4] clause(?: license)?
bsd berkeley software distribution license
busl business source license
cc-by creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? license
cc-by-nc creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? license
cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative|s|atives)(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? license
cc-by-nc-sa creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? license
cc-by-nd creative commons attribution no ?deriv(?:ative|s|atives)(?: works)?(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? license
cc-by-sa creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: public)? license
cc0 creative commons zero
cc0 cc0 1 0 universal
cddl common development and distribution license
cecill cecill(?: [bc])?(?: free software)? license
cpal common public attribution license
cpl common public license
curl curl license
ecl educational community license
efl eiffel forum license
epl eclipse public license
eupl european union public licen[cs]e
fsl functional source license
gfdl (?:gnu )?free documentation license
gpl (?:gnu )?general public license
gpl gnu gpl
hpnd historical permission notice and disclaimer
ipl ibm public license
isc isc license
isc internet (?:systems|software) consortium license
json json license
lgpl (?:gnu )?(?:lesser|library) general public license
lgpl gnu lgpl
lppl latex project public license
mit mit license
mit (?:mit x11|expat|x11) license
mit mit style license
mpl mozilla public license
ms-pl microsoft public license
ms-rl microsoft reciprocal license
mulan mulan permissive software license
ncsa university of illinois (?:ncsa )?open source license
odbl open (?:data commons open )?database license
odc-by open data commons attribution license
ofl (?:sil )?open font license
openssl openssl license
osl open software license
php php license
postgresql postgresql licen[cs]e
proprietary commercial license agreement
python python software foundation license
python python license
qpl q public license
rpl reciprocal public license
ruby ruby license
sleepycat sleepycat license
sspl server side public license
sun sun public license
unlicense the unlicense
upl universal permissive license
vim vim license
w3c w3c software(?: and document)? (?:license|notice)
wtfpl do what the fuck you want to public license
zlib zlib(?: libpng)? license
zpl zope public license
"""
# Level 1: mentions in short.
MENTIONS = """
agpl agplv3
agpl agpl 3 0
apache apache 2 0
bsd bsd licensed
cc-by cc by [1-4] [05]
cc-by-nc cc by nc [1-4] [05]
cc-by-nc-nd cc by nc nd [1-4] [05]
cc-by-nc-sa cc by nc sa [1-4] [05]
cc-by-nd cc by nd [1-4] [05]
cc-by-sa cc by sa [1-4] [05]
cc0 cc0
epl epl [12] 0
eupl eupl
gpl gplv2
gpl gplv3
gpl gpl(?: [123](?: 0)?)?
lgpl lgplv2(?: 1)?
lgpl lgplv3
lgpl lgpl(?: (?:2 [01]|3(?: 0)?))?
mit mit licensed
mpl mpl [12] [01]
proprietary all rights reserved
public-domain public domain
unlicense unlicense
"""
# Exceptions as they stand after "with" in an expression of identifiers.
EXCEPTION = "(?:(?!or |and |with )[a-z0-9]+ ){1,3}exception(?: [0-9] [0-9])?|linux syscall note"
# What an identifier follows; the second only for identifiers that aren't words of their own.
MARKS = ("license (?:identifier|expression) ", "(?:license (?:identifier|expression) |licen[cs]ed (?:under |as )(?:the )?|(?:spdx|license) )")
# Words too common in other texts to be a keyword where a rule has another, a word for license first.
COMMON = frozenset((
    "agreement authors blue build business changing compiled cooperation database dedicated development enterprise except freedom good granted included includes indicate information itself maintains material materials mentioning modification not obtain obtaining organization products proprietary reproduction required retain should side stuff subject textbook transform upon "
    "a accept accompanying advertising all an and any applicable appropriate arising as associated available at be by can claim clause code collaborative commercial common community compliance conditions confidential contents contributions contributor contributors copy copyright designed developed distribute distributed distribution do document documentation domain educational evil fee font file for form foundation free from functional general governed government has if in into is it made may medium model modify name net no notice of on one open or org other party permission permitted product program project provided public purpose received return reserved rights same see server scripts share shall software source specifically state style substantial sun system terms that the this to under use used version want warranty what whatever with without work works you your"
).split())
LEVELS = 6


def _lines(table: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 1)) for x in table.strip().splitlines()]


def required_words(pattern: str) -> list[str]:
    """The words that every match of a pattern has: those outside of groups, classes and options."""
    out, depth, at = "", 0, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "(":
            if not depth:
                begin = at
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                inner = pattern[begin:at]
                out += (" " if re.match(r"\((?:\?:)? ", inner) else "") + "\0" + (" " if inner.endswith(" ") else "")
        elif not depth:
            if c == "[":
                at = pattern.index("]", at)
                c = "\0"
            elif c in "?*+{":
                if c == "{":
                    at = pattern.index("}", at)
                c = ""
                if out.endswith("\0 "):
                    pass  # a group with its space
                elif not out.endswith("\0"):
                    out = out[:-1] + "\0"
            out += c
        at += 1
    return [w for w in out.split() if "\0" not in w]


def keyword(pattern: str) -> str:
    """A word that every match has: an uncommon one, else a word for license, else the longest."""
    return min(required_words(pattern), key=lambda w: (2 if w in COMMON or len(w) == 1 else w.startswith("licen"), -len(w), w))


def rules() -> list[tuple[str, int, str, str]]:
    """``label, level, pattern, keyword`` in order, highest level first; a pattern's first group is the interval of the detection."""
    ids = [p for table in (IDS, PLAIN_IDS) for _, p in _lines(table)]
    chain = f"(?:(?:{'|'.join(sorted(ids, key=lambda p: (-len(p), p)))})(?: with (?:{EXCEPTION}))? (?:or|and) )*"
    out = []
    for level, table, mark in ((6, TEXTS, ""), (5, IDS, MARKS[1] + chain), (5, PLAIN_IDS, MARKS[0] + chain), (4, NOTICES, ""), (3, LINKS, ""), (2, NAMES, ""), (1, MENTIONS, "")):
        end = "(?= (?!licen[cs]es? ))" if mark else "(?= )"  # "license mit license" names the license and identifies nothing
        out += [(label, level, f"(?<= ){mark}({p}){end}", p.split(" ")[0].split("(")[0] if mark else keyword(p)) for label, p in _lines(table)]
    return out


def _count(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)


# A rule's detections: its matches and what lies between them give the places, as the interval is the end of the match.
_DETECT = """
    flatten(transform(filter(tried, r -> g rlike r.p), r -> aggregate(
        arrays_zip(split(g, r.p, -1), regexp_extract_all(g, r.p, 0), regexp_extract_all(g, r.p, 1)),
        named_struct('at', 0, 'found', cast(array() as array<struct<s: int, e: int, w: int, n: int, label: string>>)),
        (acc, x) -> named_struct(
            'at', acc.at + length(x.`0`) + coalesce(length(x.`1`), 0),
            'found', if(x.`1` is null, acc.found, array_append(acc.found, named_struct(
                's', acc.at + length(x.`0`) + length(x.`1`) - length(x.`2`), 'e', acc.at + length(x.`0`) + length(x.`1`), 'w', r.w, 'n', r.n, 'label', r.label)))),
        acc -> acc.found)))"""
# Detections by start, longer ones first, then by level and rule; ``ends`` has for each level the farthest end among it and those above.
_RESOLVE = f"""
    aggregate(
        array_sort(detections, (a, b) -> case when a.s <> b.s then a.s - b.s when a.e <> b.e then b.e - a.e when a.w <> b.w then b.w - a.w else a.n - b.n end),
        named_struct('ends', array_repeat(0, {LEVELS}), 'labels', cast(array() as array<string>), 'level', 0, 'n', 0L),
        (acc, d) -> if(acc.ends[d.w - 1] >= d.e, acc, named_struct(
            'ends', transform(acc.ends, (x, k) -> if(k < d.w and x < d.e, d.e, x)),
            'labels', if(array_contains(acc.labels, d.label), acc.labels, array_append(acc.labels, d.label)),
            'level', greatest(acc.level, d.w), 'n', acc.n + 1L)))"""


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections`` for each row; score is the highest level left, as a share of all levels."""
    prepare(docs.sparkSession)
    known = rules()
    words = F.array(*(F.lit(k) for k in sorted({r[3] for r in known} | {p.split()[-1] for p in BASE})))
    table = F.from_json(F.lit(json.dumps([{"label": label, "w": w, "p": p, "k": k, "n": n} for n, (label, w, p, k) in enumerate(known)])), "array<struct<label: string, w: int, p: string, k: string, n: int>>")
    plain = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), string.ascii_uppercase + _APART, string.ascii_lowercase + " " * len(_APART))
    a = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.array_remove(F.split(plain, " "), "").alias("words"))
    a = a.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(F.arrays_overlap("words", words), F.col("words")).alias("words"))
    a = a.select("doc_id", "n_words", F.array_intersect("words", words).alias("present"), F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias("g"))
    a = a.select("*", F.concat(F.lit(" "), F.replace(F.trim("g"), F.lit(" "), F.lit("  ")), F.lit(" ")).alias("t"), F.filter(table, lambda r: F.array_contains("present", r["k"])).alias("tried"))
    firsts, lasts, counts, base = [], [], [], []
    for phrase, label in BASE.items():
        part = " " + phrase.replace(" ", "  ") + " "
        there = F.contains("t", F.lit(part))
        counts.append(F.when(there, _count(F.col("t"), part)).otherwise(0))
        firsts.append(F.when(there, _count(F.substring_index("t", part, 1), " ") / 2))
        lasts.append(F.when(there, F.col("n_words") - _count(F.substring_index("t", part, -1), " ") / 2 - len(phrase.split())))
        base.append(F.when(there, F.lit(label)))
    a = a.select("doc_id", "n_words", "g", "tried", sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*base)).alias("base"))
    a = a.select("*", F.expr(f"if(size(tried) > 0, {_DETECT}, null)").alias("detections"))
    a = a.select("*", F.expr(f"if(size(detections) > 0, {_RESOLVE}, null)").alias("left"))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("left.labels", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("left.level", F.lit(0)), F.when(F.size("base") > 0, 1).otherwise(0)) / LEVELS
    return a.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.cast("double").alias("score"), F.coalesce("left.n", F.lit(0)).cast("long").alias("n_detections"),
    )
