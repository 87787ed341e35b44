"""The signature rules of the license scan, written by hand, and what compiles them.

A line is label, confidence and pattern; lines stand in the order of priority:
identifiers, whole-licence texts, references, names, hints. A blank in a pattern
stands for any run of white space, comment marks and line ends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

try:
    import re._parser as sre
except ImportError:  # Python 3.10 and older
    import sre_parse as sre

RULES = r"""
gpl          1.00  spdx-licen[cs]e-identifier: gpl-[123]\.\d(?:-only|-or-later|\+)?
lgpl         1.00  spdx-licen[cs]e-identifier: lgpl-[23]\.\d(?:-only|-or-later|\+)?
agpl         1.00  spdx-licen[cs]e-identifier: agpl-[13]\.\d(?:-only|-or-later|\+)?
gfdl         1.00  spdx-licen[cs]e-identifier: gfdl-1\.\d(?:-only|-or-later)?
apache       1.00  spdx-licen[cs]e-identifier: apache-[12]\.\d
mit          1.00  spdx-licen[cs]e-identifier: mit(?:-0)?\b
bsd-2-clause 1.00  spdx-licen[cs]e-identifier: bsd-2-clause(?:-patent)?
bsd-3-clause 1.00  spdx-licen[cs]e-identifier: bsd-3-clause(?:-clear)?
bsd-4-clause 1.00  spdx-licen[cs]e-identifier: bsd-4-clause(?:-uc)?
bsd          1.00  spdx-licen[cs]e-identifier: 0bsd
isc          1.00  spdx-licen[cs]e-identifier: isc\b
mpl          1.00  spdx-licen[cs]e-identifier: mpl-[12]\.\d(?:-no-copyleft-exception)?
epl          1.00  spdx-licen[cs]e-identifier: epl-[12]\.0
cddl         1.00  spdx-licen[cs]e-identifier: cddl-1\.[01]
eupl         1.00  spdx-licen[cs]e-identifier: eupl-1\.[012]
artistic     1.00  spdx-licen[cs]e-identifier: artistic-[12]\.0
boost        1.00  spdx-licen[cs]e-identifier: bsl-1\.0
bsl          1.00  spdx-licen[cs]e-identifier: busl-1\.1
zlib         1.00  spdx-licen[cs]e-identifier: zlib(?:-acknowledgement)?\b
unlicense    1.00  spdx-licen[cs]e-identifier: unlicense\b
wtfpl        1.00  spdx-licen[cs]e-identifier: wtfpl\b
postgresql   1.00  spdx-licen[cs]e-identifier: postgresql\b
python       1.00  spdx-licen[cs]e-identifier: (?:psf|python)-2\.0
php          1.00  spdx-licen[cs]e-identifier: php-3\.0\d?
ruby         1.00  spdx-licen[cs]e-identifier: ruby\b
openssl      1.00  spdx-licen[cs]e-identifier: openssl\b
ofl          1.00  spdx-licen[cs]e-identifier: ofl-1\.[01]
odbl         1.00  spdx-licen[cs]e-identifier: odbl-1\.0
odc-by       1.00  spdx-licen[cs]e-identifier: odc-by-1\.0
cc0          1.00  spdx-licen[cs]e-identifier: cc0-1\.0
cc-by-nc-nd  1.00  spdx-licen[cs]e-identifier: cc-by-nc-nd-\d\.\d
cc-by-nc-sa  1.00  spdx-licen[cs]e-identifier: cc-by-nc-sa-\d\.\d
cc-by-nc     1.00  spdx-licen[cs]e-identifier: cc-by-nc-\d\.\d
cc-by-nd     1.00  spdx-licen[cs]e-identifier: cc-by-nd-\d\.\d
cc-by-sa     1.00  spdx-licen[cs]e-identifier: cc-by-sa-\d\.\d
cc-by        1.00  spdx-licen[cs]e-identifier: cc-by-\d\.\d
proprietary  1.00  spdx-licen[cs]e-identifier: licenseref-(?:proprietary|commercial)\b
mit          0.95  permission is hereby granted, free of charge, to any person obtaining a copy
mit          0.80  permission is hereby granted, free of charge
mit          0.80  the above copyright notice and this permission notice shall be included in all copies
mit          0.75  the software is provided "as is", without warranty of any kind
isc          0.95  permission to use, copy, modify, and(?:/or)? distribute this software for any purpose
isc          0.85  permission to use, copy, modify, and(?:/or)? distribute this software
bsd          0.90  redistribution and use in source and binary forms, with or without modification
bsd          0.85  redistribution and use in source and binary forms
bsd          0.75  redistributions of source code must retain the above copyright
bsd          0.75  redistributions in binary form must reproduce the above copyright
bsd-3-clause 0.90  neither the names? of .{1,80}? nor the names of (?:its|any|their) contributors may be used to endorse
bsd-4-clause 0.90  all advertising materials mentioning features or use of this software must display
gpl          0.95  this program is free software[:;,]? you can redistribute it and/or modify it under the terms of the gnu general public licen[cs]e
gpl          0.85  this program is free software[:;,]? you can redistribute it
gpl          0.80  you should have received a copy of the gnu general public licen[cs]e
lgpl         0.95  this library is free software[:;,]? you can redistribute it
lgpl         0.85  you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e
agpl         0.85  you should have received a copy of the gnu affero general public licen[cs]e
gpl          0.75  without even the implied warranty of merchantability or fitness for a particular purpose\. see the gnu general public
gfdl         0.95  permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation
apache       0.95  licen[cs]ed under the apache licen[cs]e, version 2\.0 \(the "?licen[cs]e"?\)
apache       0.80  you may not use this file except in compliance with the licen[cs]e
apache       0.75  unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e
mpl          0.95  this source code form is subject to the terms of the mozilla public licen[cs]e
mpl          0.90  the contents of this file are subject to the mozilla public licen[cs]e
epl          0.90  this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
edl          0.90  this program and the accompanying materials are made available under the terms of the eclipse distribution licen[cs]e
cddl         0.90  the contents of this file are subject to the terms of the common development and distribution
eupl         0.90  licen[cs]ed under the eupl
zlib         0.90  this software is provided 'as-is', without any express or implied warranty
zlib         0.80  altered source versions must be plainly marked as such
unlicense    0.95  this is free and unencumbered software released into the public domain
unlicense    0.90  this is free and unencumbered software
boost        0.90  permission is hereby granted, free of charge, to any person or organization obtaining a copy
openssl      0.85  this product includes software developed by the openssl project
postgresql   0.85  permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee
python       0.80  psf is making python available to licensee
ofl          0.90  this font software is licen[cs]ed under the sil open font licen[cs]e
cc0          0.90  the person who associated a work with this deed has dedicated the work to the public domain
artistic     0.80  under the same terms as perl itself
agpl         0.95  under the terms of the gnu affero general public licen[cs]e(?: version 3)?
lgpl         0.95  under the terms of the gnu (?:lesser|library) general public licen[cs]e
gpl          0.95  under the terms of (?:either )?(?:the )?gnu general public licen[cs]e(?: as published by the free software foundation)?
gpl          0.90  under the terms of the gpl\b
lgpl         0.90  under the terms of the lgpl\b
mit          0.90  under the terms of the mit licen[cs]e
bsd          0.90  under the terms of (?:the|a) bsd(?:-style)? licen[cs]e
apache       0.90  under the terms of the apache licen[cs]e(?:,? version \d(?:\.\d)?)?
mpl          0.90  under the terms of the mozilla public licen[cs]e
isc          0.90  under the terms of the isc licen[cs]e
gfdl         0.90  under the terms of the gnu free documentation licen[cs]e
agpl         0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:gnu )?affero general public licen[cs]e
agpl         0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:gnu )?agpl(?:v?3)?\b
lgpl         0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl         0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:gnu )?lgpl(?:v?\d(?:\.\d)?)?\b
gpl          0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?gnu general public licen[cs]e(?:,? version \d)?
gpl          0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:gnu )?gpl(?:v?\d)?\b
gfdl         0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:gnu free documentation licen[cs]e|gfdl\b)
apache       0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?apache(?: software)? licen[cs]e(?:,? version \d(?:\.\d)?)?
apache       0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?apache (?:version )?2(?:\.0)?\b
mit          0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:mit|expat|x11)(?:/x11)? licen[cs]e
bsd-2-clause 0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:simplified|freebsd|2[- ]clause|two[- ]clause) bsd licen[cs]e
bsd-3-clause 0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:new|modified|revised|3[- ]clause|three[- ]clause) bsd licen[cs]e
bsd          0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the |a )?bsd(?:-style)? licen[cs]e
isc          0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?isc licen[cs]e
mpl          0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:mozilla public licen[cs]e|mpl)(?:,? (?:version |v)?\d\.\d)?
epl          0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?eclipse public licen[cs]e
cc-by-nc-nd  0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?(?:cc[- ]by[- ]nc[- ]nd|attribution[- ]non-?commercial[- ]no-?deriv\w*)
cc-by-nc-sa  0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?(?:cc[- ]by[- ]nc[- ]sa|attribution[- ]non-?commercial[- ]share-?alike)
cc-by-nc     0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?(?:cc[- ]by[- ]nc|attribution[- ]non-?commercial)\b
cc-by-nd     0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?(?:cc[- ]by[- ]nd|attribution[- ]no-?deriv\w*)
cc-by-sa     0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:a |the )?(?:creative commons )?(?:cc[- ]by[- ]sa|attribution[- ]share-?alike)
cc-by        0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:a |the )?(?:creative commons attribution|cc[- ]by)(?: \d\.\d)?(?![- ](?:nc|nd|sa|non|no-?der|share))
cc0          0.90  (?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:cc0|creative commons zero)
public-domain 0.90 (?:released|dedicated|placed|given) (?:in)?to the public domain
public-domain 0.85 (?:is|are|placed) in the public domain
gpl          0.85  (?:subject to|governed by|covered by) the gnu general public licen[cs]e
lgpl         0.85  (?:subject to|governed by|covered by) the gnu (?:lesser|library) general public licen[cs]e
apache       0.85  (?:subject to|governed by|covered by) the apache licen[cs]e
mit          0.85  (?:subject to|governed by|covered by) the mit licen[cs]e
bsd          0.85  (?:subject to|governed by|covered by) (?:the|a) bsd licen[cs]e
mpl          0.85  (?:subject to|governed by|covered by) the mozilla public licen[cs]e
agpl         0.85  gnu affero general public licen[cs]e(?:,? v(?:ersion)?\.? ?\d(?:\.\d)?)?
agpl         0.75  affero general public licen[cs]e
agpl         0.75  \bagpl(?:-?v?3(?:\.0)?)?\b
lgpl         0.85  gnu (?:lesser|library) general public licen[cs]e(?:,? v(?:ersion)?\.? ?\d(?:\.\d)?)?
lgpl         0.75  (?:lesser|library) general public licen[cs]e
lgpl         0.75  \blgpl(?:-?v?[23](?:\.\d)?)?\b
gfdl         0.85  gnu free documentation licen[cs]e(?:,? v(?:ersion)?\.? ?\d(?:\.\d)?)?
gfdl         0.75  \bgfdl\b
gpl          0.85  gnu general public licen[cs]e,? v(?:ersion)?\.? ?[123](?:\.\d)?(?: or (?:any )?later(?: version)?)?
gpl          0.80  gnu general public licen[cs]e
gpl          0.75  \bgnu gpl(?:v?[23])?\b
gpl          0.70  \bgpl-?v[23](?:\.\d)?\+?
gpl          0.70  \bgpl-[123](?:\.\d)?(?:-only|-or-later|\+)?
gpl          0.55  \bgpl(?:-compatible)? licen[cs]ed?\b
gpl          0.50  \bgpl\b
gpl          0.60  \bgeneral public licen[cs]e
apache       0.85  apache(?: software)? licen[cs]e,? v(?:ersion)?\.? ?[12](?:\.\d)?
apache       0.80  apache[- ]2(?:\.0)? licen[cs]ed?
apache       0.75  apache(?: software)? licen[cs]e
apache       0.70  \bapache-[12]\.\d\b
apache       0.70  \basl ?2\.0\b
mit          0.75  \bmit/x11 licen[cs]e
mit          0.75  \bmit licen[cs]ed?\b
mit          0.70  \b(?:expat|x11) licen[cs]e
mit          0.70  licen[cs]e ?[:=] ?["']?mit\b
bsd-4-clause 0.80  (?:original|old|four[- ]clause|4[- ]clause) bsd licen[cs]e
bsd-4-clause 0.75  \bbsd[- ]4[- ]clause\b
bsd-3-clause 0.80  (?:new|modified|revised|three[- ]clause|3[- ]clause) bsd licen[cs]e
bsd-3-clause 0.75  \bbsd[- ]3[- ]clause\b
bsd-2-clause 0.80  (?:simplified|freebsd|two[- ]clause|2[- ]clause) bsd licen[cs]e
bsd-2-clause 0.75  \bbsd[- ]2[- ]clause\b
bsd-2-clause 0.70  \bfreebsd licen[cs]e
bsd          0.70  \bbsd(?:-style|-type|-like)? licen[cs]ed?\b
bsd          0.70  \bberkeley software distribution licen[cs]e
bsd          0.65  licen[cs]e ?[:=] ?["']?bsd\b
isc          0.75  \bisc licen[cs]ed?\b
isc          0.65  licen[cs]e ?[:=] ?["']?isc\b
mpl          0.80  mozilla public licen[cs]e(?:,? v(?:ersion)?\.? ?\d\.\d)?
mpl          0.75  \bmpl[- ]v?[12]\.[01]\b
epl          0.80  eclipse public licen[cs]e(?:,? v(?:ersion)?\.? ?\d\.\d)?
epl          0.75  \bepl[- ]v?[12]\.0\b
edl          0.80  eclipse distribution licen[cs]e
cddl         0.80  common development and distribution licen[cs]e
cddl         0.75  \bcddl(?:[- ]1\.[01])?\b
cpl          0.80  common public licen[cs]e
cpl          0.75  \bcpl-1\.0\b
eupl         0.80  european union public licen[cs]e
eupl         0.75  \beupl(?:[- ]v?1\.\d)?\b
artistic     0.80  (?:perl )?artistic licen[cs]e(?: 2(?:\.0)?)?
boost        0.80  boost software licen[cs]e
bsl          0.80  business source licen[cs]e
zlib         0.80  \bzlib(?:/libpng)? licen[cs]e
zlib         0.75  \blibpng licen[cs]e
unlicense    0.80  \bthe unlicense\b
wtfpl        0.80  do what the f\w+ you want to public licen[cs]e
wtfpl        0.75  \bwtfpl\b
postgresql   0.80  postgresql licen[cs]e
python       0.80  python software foundation licen[cs]e
python       0.75  \bpsf licen[cs]e
php          0.80  \bphp licen[cs]e
ruby         0.80  \bruby licen[cs]e
openssl      0.80  \bopenssl licen[cs]e
curl         0.80  \bcurl licen[cs]e
ncsa         0.80  university of illinois/ncsa open source licen[cs]e
ncsa         0.75  \bncsa open source licen[cs]e
vim          0.80  \bvim licen[cs]e
tcl          0.80  \btcl/tk licen[cs]e
upl          0.80  universal permissive licen[cs]e
ms-pl        0.80  microsoft public licen[cs]e
ms-rl        0.80  microsoft reciprocal licen[cs]e
sspl         0.80  server side public licen[cs]e
elastic      0.80  elastic licen[cs]e(?: 2\.0| v2)?
afl          0.80  academic free licen[cs]e
osl          0.80  open software licen[cs]e
mulan        0.80  mulan (?:permissive|public) (?:software )?licen[cs]e
cecill       0.80  \bcecill(?:-[abc])?\b
blueoak      0.80  blue oak model licen[cs]e
openrail     0.80  \b(?:creativeml )?open rail-m\b|\bopenrail(?:-m|\+\+)?\b
llama        0.80  llama (?:[23](?:\.\d)? )?community licen[cs]e
ofl          0.80  (?:sil )?open font licen[cs]e
odbl         0.80  open (?:data commons open )?database licen[cs]e
odbl         0.75  \bodbl\b
odc-by       0.80  open data commons attribution licen[cs]e
pddl         0.80  public domain dedication and licen[cs]e
ogl          0.80  open government licen[cs]e
cdla         0.80  community data licen[cs]e agreement
cc0          0.80  \bcc0(?:[- ]1\.0)?\b
cc0          0.80  creative commons zero
cc0          0.80  creativecommons\.org/publicdomain/zero
cc-by-nc-nd  0.85  (?:creative commons )?attribution[- ]non-?commercial[- ]no-?deriv\w*(?: \d\.\d)?
cc-by-nc-nd  0.80  \bcc[- ]by[- ]nc[- ]nd\b(?:[- ]\d\.\d)?
cc-by-nc-nd  0.90  creativecommons\.org/licenses/by-nc-nd
cc-by-nc-sa  0.85  (?:creative commons )?attribution[- ]non-?commercial[- ]share-?alike(?: \d\.\d)?
cc-by-nc-sa  0.80  \bcc[- ]by[- ]nc[- ]sa\b(?:[- ]\d\.\d)?
cc-by-nc-sa  0.90  creativecommons\.org/licenses/by-nc-sa
cc-by-nc     0.85  (?:creative commons )?attribution[- ]non-?commercial(?: \d\.\d)?
cc-by-nc     0.80  \bcc[- ]by[- ]nc\b(?:[- ]\d\.\d)?
cc-by-nc     0.90  creativecommons\.org/licenses/by-nc/
cc-by-nd     0.85  (?:creative commons )?attribution[- ]no-?deriv\w*(?: \d\.\d)?
cc-by-nd     0.80  \bcc[- ]by[- ]nd\b(?:[- ]\d\.\d)?
cc-by-nd     0.90  creativecommons\.org/licenses/by-nd
cc-by-sa     0.85  (?:creative commons )?attribution[- ]share-?alike(?: \d\.\d)?
cc-by-sa     0.80  \bcc[- ]by[- ]sa\b(?:[- ]\d\.\d)?
cc-by-sa     0.90  creativecommons\.org/licenses/by-sa
cc-by        0.80  creative commons attribution(?: \d\.\d)?(?: international)?
cc-by        0.75  \bcc[- ]by\b(?:[- ]\d\.\d)?
cc-by        0.90  creativecommons\.org/licenses/by/
public-domain 0.70 public domain dedication
public-domain 0.55 \bpublic domain\b
proprietary  0.70  proprietary and confidential
proprietary  0.65  unauthori[sz]ed (?:copying|reproduction|distribution) of this (?:file|software|document)
proprietary  0.60  all rights reserved
bespoke-eula 0.70  end[- ]user licen[cs]e agreement
bespoke-eula 0.60  \beula\b
"""

#: Words that say little; a keyword is one of them only if a pattern has no other.
COMMON = {"the", "by", "under", "free", "this", "terms", "person", "software", "public", "any", "what", "to", "of", "and"}
#: What a blank in a pattern stands for.
GAP = r"[\s*#/;]+"


@dataclass(frozen=True)
class Rule:
    priority: int
    label: str
    pattern: re.Pattern
    confidence: float
    keywords: tuple[str, ...]  # any of them is in each match


def _spaced(pattern: str) -> str:
    """Blanks of the pattern as GAP, but for those before a quantifier or inside of a character class."""
    out, inside = [], False
    for i, c in enumerate(pattern):
        inside = c == "[" or (inside and c != "]")
        if c != " ":
            out.append(c)
        elif inside:
            out.append(r"\s")
        else:
            out.append(f"(?:{GAP})" if pattern[i + 1 : i + 2] == "?" else GAP)
    return "".join(out)


def needed(pattern: str) -> list[tuple[str, ...]]:
    """Sets of literals, the best first; any match of the pattern holds at least one of each set, as its syntax proves."""

    def best(sets: list[tuple[str, ...]]) -> list[tuple[str, ...]]:
        return sorted(sets, key=lambda words: (any(w in COMMON for w in words), -min(map(len, words)), len(words), words))

    def of(items) -> list[tuple[str, ...]]:
        sets, run = [], ""
        for op, arg in [*items, (None, None)]:
            if op is sre.LITERAL:
                run += chr(arg)
                continue
            if run:
                sets.append((run,))
            run = ""
            if op is sre.SUBPATTERN:
                sets += of(arg[3])
            elif op is sre.BRANCH:
                parts = [of(x) for x in arg[1]]
                if all(parts):
                    sets.append(tuple(sorted({w for p in parts for w in p[0]})))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                sets += of(arg[2])
        return best(sets)

    return of(sre.parse(pattern))


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    out = []
    for line in RULES.strip().splitlines():
        label, confidence, pattern = line.split(None, 2)
        pattern = _spaced(pattern)
        sets = needed(pattern)
        if not sets:
            raise ValueError(f"a rule without a keyword: {line}")
        out.append(Rule(len(out), label, re.compile(pattern), float(confidence), sets[0]))
    return out


@lru_cache(maxsize=1)
def gates() -> list[bytes]:
    """A few literals of which every match of every rule holds one."""
    chosen = ["licen", "gpl"]  # most rules hold one of these
    for r in rules():
        if not any(all(any(c in w for c in chosen) for w in words) for words in needed(r.pattern.pattern)):
            chosen += r.keywords
    return [c.encode() for c in chosen]
