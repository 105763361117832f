"""License scans by ordered signature rules.

Every rule is a signature, hand-written: words of a licence's text, notice or name
that must stand consecutively, whatever stands between them, or a licence identifier;
with a label, a score and a priority. A keyword prefilter finds which rules can match a
text at all: each rule hangs on the word of its own that the fewest rules hold, and
is tried only on texts with that whole word. Overlaps are resolved by interval
containment: a detection inside one of a higher priority or inside a longer one of
equal priority is suppressed. The base phrases are always counted, suppressed or not.

Defined cases: a null or empty text has no words and no detections, score 0;
repeated rows each get their row; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections string"


class Rule(NamedTuple):
    label: str
    source: str
    keyword: bytes
    pattern: re.Pattern[bytes]
    score: float
    priority: int


#: Between two words of a signature: whatever is not a word.
_GAP = rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_WORD = rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_OPEN, _CLOSE = rb"(?<![0-9a-z\x80-\xff])", rb"(?![0-9a-z\x80-\xff])"
#: Most words that ``...`` in a signature stands for.
ANY = 8


def signature(text: str) -> bytes:
    """Expression for the words of ``text``, consecutive; (a|b) is either word, ... is none to ANY words."""
    out = b""
    for k, word in enumerate(text.split()):
        if word == "...":
            out += b"(?:" + _GAP + _WORD + b"){0,%d}?" % ANY
        else:
            out += (_GAP if k else b"") + word.encode().replace(b"(", b"(?:")
    return _OPEN + out + _CLOSE


#: Families: label, names in running text, SPDX identifiers (versions are added to the label).
_FAMILIES = {
    "mit": (("mit license", "mit licence", "expat license", "mit x11 license"), ("mit", "mit-0", "mit-modern-variant", "x11")),
    "apache": (("apache license", "apache licence", "apache software license"), ("apache-1.0", "apache-1.1", "apache-2.0")),
    "gpl": (("general public license", "gnu general public licence", "gnu gpl", "gplv2", "gplv3"), ("gpl-1.0", "gpl-2.0", "gpl-3.0", "gpl-2.0-only", "gpl-2.0-or-later", "gpl-3.0-only", "gpl-3.0-or-later")),
    "lgpl": (("lesser general public license", "library general public license", "gnu lgpl", "lgplv2", "lgplv3"), ("lgpl-2.0", "lgpl-2.1", "lgpl-3.0", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0-only", "lgpl-3.0-or-later")),
    "agpl": (("affero general public license", "gnu agpl", "agplv3"), ("agpl-1.0", "agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later")),
    "bsd": (("bsd license", "bsd licence", "bsd style license", "berkeley software distribution license"), ("bsd-2-clause", "bsd-3-clause", "bsd-4-clause", "0bsd", "bsd-1-clause")),
    "mpl": (("mozilla public license", "mozilla public licence", "mplv2"), ("mpl-1.0", "mpl-1.1", "mpl-2.0")),
    "epl": (("eclipse public license", "eclipse public licence"), ("epl-1.0", "epl-2.0")),
    "cddl": (("common development and distribution license",), ("cddl-1.0", "cddl-1.1")),
    "cpl": (("common public license",), ("cpl-1.0",)),
    "eupl": (("european union public licence", "european union public license"), ("eupl-1.1", "eupl-1.2")),
    "isc": (("isc license", "isc licence"), ("isc",)),
    "zlib": (("zlib license", "zlib libpng license"), ("zlib", "libpng-2.0")),
    "boost": (("boost software license",), ("bsl-1.0",)),
    "artistic": (("artistic license", "artistic licence"), ("artistic-1.0", "artistic-2.0")),
    "unlicense": (("the unlicense", "unlicense org"), ("unlicense",)),
    "cc0": (("creative commons zero", "cc0 public domain", "cc0 1 0 universal"), ("cc0-1.0",)),
    "cc-by": (("creative commons attribution", "cc by (2|3|4)"), ("cc-by-2.0", "cc-by-2.5", "cc-by-3.0", "cc-by-4.0")),
    "cc-by-sa": (("creative commons attribution share alike", "creative commons attribution sharealike", "cc by sa"), ("cc-by-sa-2.0", "cc-by-sa-3.0", "cc-by-sa-4.0")),
    "cc-by-nc": (("creative commons attribution non commercial", "creative commons attribution noncommercial", "cc by nc"), ("cc-by-nc-2.0", "cc-by-nc-3.0", "cc-by-nc-4.0")),
    "cc-by-nd": (("creative commons attribution no derivatives", "creative commons attribution noderivatives", "creative commons attribution noderivs", "cc by nd"), ("cc-by-nd-3.0", "cc-by-nd-4.0")),
    "wtfpl": (("do what the fuck you want to public license",), ("wtfpl",)),
    "python": (("python software foundation license", "psf license"), ("psf-2.0", "python-2.0")),
    "php": (("php license",), ("php-3.0", "php-3.01")),
    "ruby": (("ruby license",), ("ruby",)),
    "postgresql": (("postgresql license", "postgresql licence"), ("postgresql",)),
    "openssl": (("openssl license",), ("openssl",)),
    "ofl": (("sil open font license", "open font license"), ("ofl-1.0", "ofl-1.1")),
    "odbl": (("open database license", "odc open database license"), ("odbl-1.0",)),
    "ms-pl": (("microsoft public license",), ("ms-pl",)),
    "ms-rl": (("microsoft reciprocal license",), ("ms-rl",)),
    "sspl": (("server side public license",), ("sspl-1.0",)),
    "busl": (("business source license",), ("busl-1.1",)),
    "gfdl": (("free documentation license", "gnu fdl"), ("gfdl-1.1", "gfdl-1.2", "gfdl-1.3")),
    "ncsa": (("university of illinois ncsa open source license",), ("ncsa",)),
    "upl": (("universal permissive license",), ("upl-1.0",)),
    "osl": (("open software license",), ("osl-3.0",)),
    "afl": (("academic free license",), ("afl-2.1", "afl-3.0")),
    "qpl": (("q public license",), ("qpl-1.0",)),
    "curl": (("curl license",), ("curl",)),
    "vim": (("vim license",), ("vim",)),
    "proprietary": (("proprietary and confidential", "confidential and proprietary", "unpublished proprietary source code"), ()),
}

#: Sentences of licence texts and notices, a rule a line: label, words.
_TEXTS = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software
mit: to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
mit: the above copyright notice and this permission notice shall be included in all copies
mit: permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee
mit: except as contained in this notice the name of ... shall not be used in advertising or otherwise to promote the sale
mit: distributed under the mit software license
mit: released under the terms of the mit licence
apache: licensed under the apache license version 2 0
apache: you may not use this file except in compliance with the license
apache: distributed on an as is basis without warranties or conditions of any kind
apache: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache: licensed to the apache software foundation asf under one or more contributor license agreements
apache: this product includes software developed by the apache software foundation
apache: the names apache server and apache group must not be used to endorse or promote products
apache: you must cause any modified files to carry prominent notices stating that you changed the files
gpl: this program is free software you can redistribute it and or modify it
gpl: this work is licensed under the gnu general public license version (1|2|3)
gpl: under the terms of the gnu general public license
gpl: you should have received a copy of the gnu general public license along with
gpl: the licenses for most software are designed to take away your freedom to share and change it
gpl: the gnu general public license is a free copyleft license for software and other kinds of works
gpl: you must cause any work that you distribute or publish that in whole or in part contains or is derived from the program
gpl: may be distributed under the terms of version (2|3) of the gpl
gpl: (gplv2|gplv3) or any later version
gpl: dual licensed under the gpl and
gpl: as a special exception to the gnu general public license
lgpl: under the terms of the gnu lesser general public license
lgpl: under the terms of the gnu library general public license
lgpl: this library is free software you can redistribute it and or modify it
lgpl: you should have received a copy of the gnu lesser general public license
lgpl: a work that uses the library
lgpl: this license the lesser general public license applies to some specially designated software packages typically libraries
lgpl: version 3 of the gnu lesser general public license incorporates the terms and conditions
agpl: under the terms of the gnu affero general public license
agpl: you should have received a copy of the gnu affero general public license
agpl: all users interacting with it remotely through a computer network
agpl: remote network interaction use with the gnu general public license
agpl: designed specifically to ensure that in such cases the modified source code becomes available to the community
bsd: redistribution and use in source and binary forms with or without modification are permitted
bsd: redistributions of source code must retain the above copyright notice this list of conditions
bsd: redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd: neither the name of ... nor the names of its contributors may be used to endorse
bsd: neither the name of ... may be used to endorse or promote products derived from this software
bsd: the name of the author may not be used to endorse or promote products derived from this software
bsd: all advertising materials mentioning features or use of this software must display the following acknowledgement
bsd: this product includes software developed by the university of california berkeley
bsd: use of this source code is governed by a bsd style license
bsd: licensed under the (two|three|four) clause bsd
bsd: (simplified|modified|revised|new) bsd license
bsd: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted zero clause
mpl: this source code form is subject to the terms of the mozilla public license
mpl: if a copy of the mpl was not distributed with this file you can obtain one
mpl: the contents of this file are subject to the mozilla public license version
mpl: this source code form is incompatible with secondary licenses
mpl: the original code is ... the initial developer of the original code is
mpl: covered software is provided under this license on an as is basis
epl: this program and the accompanying materials are made available under the terms of the eclipse public license
epl: are dual licensed under the terms of the eclipse public license
epl: the accompanying program is provided under the terms of this eclipse public license
epl: the eclipse foundation is the initial agreement steward
cddl: the contents of this file are subject to the terms of the common development and distribution license
cddl: you can obtain a copy of the license at usr src opensolaris license or
cddl: the sun microsystems inc is the initial license steward
cddl: when distributing covered code include this cddl header in each file
cpl: the accompanying program is provided under the terms of this common public license
cpl: ibm is the initial agreement steward
eupl: licensed under the eupl
eupl: licence for the european union public licence
eupl: this european union public licence the eupl applies to the work
eupl: concesso in licenza a norma dell eupl
isc: permission to use copy modify and or distribute this software for any purpose with or without fee
isc: the software is provided as is and the author disclaims all warranties with regard to this software
isc: isc disclaims all warranties with regard to this software
zlib: altered source versions must be plainly marked as such
zlib: the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib: this notice may not be removed or altered from any source distribution
zlib: libpng versions ... are copyright
boost: permission is hereby granted free of charge to any person or organization obtaining a copy
boost: distributed under the boost software license version 1 0
boost: unless such copies or derivative works are solely in the form of machine executable object code
artistic: this package is free software you may redistribute it and or modify it under the same terms as perl itself
artistic: you may distribute modifications of this package in any way provided that
artistic: the intent of this document is to state the conditions under which a package may be copied
artistic: the copyright holder maintains some semblance of artistic control over the development of the package
artistic: everyone is permitted to copy and distribute verbatim copies of this license document this license establishes the terms under which a given free software package
artistic: under the terms of the artistic license
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software
unlicense: for more information please refer to http unlicense org
cc0: dedicated to the public domain by waiving all of his or her rights
cc0: the person who associated a work with this deed has dedicated the work to the public domain
cc0: to the extent possible under law ... has waived all copyright and related or neighboring rights
cc0: affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc-by: this work is licensed under a creative commons attribution (2|3|4)
cc-by: creativecommons org licenses by (2|3|4)
cc-by: you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa: creativecommons org licenses by sa
cc-by-sa: if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-sa: text is available under the creative commons attribution sharealike license
cc-by-nc: creativecommons org licenses by nc
cc-by-nc: you may not use the material for commercial purposes
cc-by-nd: creativecommons org licenses by nd
cc-by-nd: if you remix transform or build upon the material you may not distribute the modified material
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl: you just do what the fuck you want to
python: psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce
python: this license agreement is between the python software foundation
python: beopen python open source license agreement
python: cnri license agreement
php: this product includes php software freely available from
php: products derived from this software may not be called php
php: this source file is subject to version 3 01 of the php license
ruby: you can redistribute it and or modify it under either the terms of the 2 clause bsdl
ruby: you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices
ruby: is copyrighted free software by yukihiro matsumoto
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
postgresql: in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
postgresql: postgresql database management system formerly known as postgres
openssl: this product includes software developed by the openssl project for use in the openssl toolkit
openssl: this product includes cryptographic software written by eric young
openssl: products derived from this software may not be called openssl
ofl: this font software is licensed under the sil open font license
ofl: neither the font software nor any of its individual components in original or modified versions may be sold by itself
ofl: no modified version of the font software may use the reserved font name
ofl: the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
odbl: this ... is made available under the open database license
odbl: the licensor ... you wish to enter into this agreement as a database
odbl: opendatacommons org licenses odbl
odc-by: opendatacommons org licenses by
odc-by: open data commons attribution license
pddl: opendatacommons org licenses pddl
pddl: open data commons public domain dedication
ms-pl: this license governs use of the accompanying software if you use the software you accept this license
ms-pl: if you bring a patent claim against any contributor over patents that you claim are infringed by the software
ms-rl: for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file
sspl: if you make the functionality of the program or a modified version available to third parties as a service
sspl: subject to the terms of the server side public license
busl: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl: additional use grant
busl: effective on the change date
elastic: elastic license (1|2)
elastic: you may not provide the software to third parties as a hosted or managed service
elastic: licensed under the elastic license
commons-clause: commons clause license condition
commons-clause: the license does not grant to you the right to sell the software
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl: with no invariant sections no front cover texts and no back cover texts
ncsa: to deal with the software without restriction including without limitation
ncsa: neither the names of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
upl: the universal permissive license upl version 1 0
upl: larger works any piece of software and or hardware listed in the lrgrwrks txt file
osl: licensed under the open software license version
osl: this open software license the license applies to any original work of authorship
afl: licensed under the academic free license version
afl: this academic free license the license applies to any original work of authorship
qpl: permission is granted to use this software under the terms of the q public license
qpl: you may make modifications to the software and distribute your modifications in a form that is separate from the software such as patches
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
vim: this software is charityware you can use and copy it as much as you like
vim: you are encouraged to make a donation for needy children in uganda
beerware: as long as you retain this notice you can do whatever you want with this stuff
beerware: you can buy me a beer in return
json: the software shall be used for good not evil
ijg: this software is based in part on the work of the independent jpeg group
ijg: the authors make no warranty or representation either express or implied with respect to this software its quality accuracy
freetype: portions of this software are copyright ... the freetype project
freetype: the freetype license
tcl: the authors hereby grant permission to use copy modify distribute and license this software and its documentation
tcl: the following terms apply to all files associated with the software unless explicitly disclaimed in individual files
w3c: by obtaining using and or copying this work you the licensee agree that you have read understood and will comply
w3c: w3c software notice and license
unicode: unicode license agreement data files and software
unicode: permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
icu: icu license icu 1 8 1 and later
ipl: ibm public license version 1 0
npl: netscape public license version
zpl: zope public license version
zpl: this software consists of voluntary contributions made by zope corporation
sleepycat: redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
mulan: mulan permissive software license
mulan: mulan psl v2
cecill: governed by the cecill license under french law
cecill: abiding by the rules of distribution of free software you can use modify and or redistribute the software under the terms of the cecill
latex: this work may be distributed and or modified under the conditions of the latex project public license
latex: this work has the lppl maintenance status
blueoak: blue oak model license
blueoak: the purpose of this license is to allow use and redistribution
hippocratic: hippocratic license version
llama: llama (2|3) community license agreement
llama: by using or distributing any portion or element of the llama materials
openrail: creativeml open rail m
openrail: responsible ai license
openrail: use restrictions as referenced in paragraph 5 must be included as an enforceable provision
fair-source: fair source license version
polyform: polyform (noncommercial|strict|shield|perimeter) license
polyform: the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe
jquery: dual licensed under the mit or gpl version 2 licenses
ogl: contains public sector information licensed under the open government licence
ogl: open government licence for public sector information
etalab: licence ouverte open licence
oracle: oracle binary code license agreement
oracle: oracle technology network license agreement
nvidia: nvidia software license agreement
nvidia: this source code contains confidential information and is proprietary to nvidia
intel: intel simplified software license
amd: advanced micro devices ... end user license agreement
public-domain: released into the public domain
public-domain: placed in the public domain
public-domain: this file is in the public domain
public-domain: this work is in the public domain
public-domain: dedicated to the public domain by
public-domain: no copyright is claimed
"""

#: Words that most texts hold; a rule hangs on one of these only if it has no other.
_COMMON = frozenset("a all and any are as at be by can copy do for free from has have if in including is it its license may must no not of on or other shall should software terms that the this to under use version was with without you your".split())


def _words(source: str) -> list[str]:
    return [w for w in source.split() if w != "..." and "|" not in w]


def build_rules() -> list[Rule]:
    """All rules in order: licence texts and notices, identifier tags, identifiers, names."""
    plain: list[tuple[str, str, float, int]] = []
    for line in _TEXTS.strip().splitlines():
        label, words = line.split(": ", 1)
        plain.append((label, words, 1.0, 4))
    literal: list[tuple[str, str]] = []
    for label, (names, ids) in _FAMILIES.items():
        for x in ids:
            plain.append((label, "spdx license identifier " + " ".join(re.findall("[0-9a-z]+", x)), 1.0, 3))
            if "-" in x and any(c.isdigit() for c in x):
                literal.append((label, x))
        plain += [(label, x, 0.9 if "licen" in x else 0.6, 1) for x in names]
    held = Counter(w for _, words, _, _ in plain for w in set(_words(words)))
    rarest = lambda words: min(words, key=lambda w: (w in _COMMON, w.isdigit(), held[w], -len(w), w)).encode()
    rules = [Rule(label, words, rarest(_words(words)), re.compile(signature(words)), score, priority) for label, words, score, priority in plain]
    rules += [Rule(label, x, rarest(re.findall("[0-9a-z]+", x)), re.compile(_OPEN + re.escape(x.encode()) + _CLOSE), 0.8, 2) for label, x in literal]
    return rules


class Scanner:
    def __init__(self) -> None:
        self.rules = build_rules()
        self.by_keyword: dict[bytes, list[int]] = {p.split()[0].encode(): [] for p in BASE}
        for k, r in enumerate(self.rules):
            self.by_keyword.setdefault(r.keyword, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for x in self.by_keyword:
            self.automaton.add_word(x.decode(), x)
        self.automaton.make_automaton()
        self.base = {p: re.compile(signature(p)) for p in BASE}

    def keywords(self, low: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, bytes]]:
        """(last byte, keyword) of every keyword in the bytes that is one of the words (their first and end bytes)."""
        first, last = np.zeros(len(low) + 1, bool), np.zeros(len(low) + 1, bool)
        first[starts] = last[ends] = True
        return [(e, x) for e, x in self.automaton.iter(low.decode("latin-1")) if last[e + 1] and first[e + 1 - len(x)]]

    def detections(self, low: bytes, hit: set[bytes]) -> list[tuple[int, int, int]]:
        """(start byte, end byte, rule) of what no other detection contains; ``hit``: the keywords in the text."""
        found = []
        for k in sorted(k for x in hit for k in self.by_keyword[x]):
            found += [(m.start(), m.end(), k) for m in self.rules[k].pattern.finditer(low)]
        return suppress(found, self.rules)


def suppress(found: list[tuple[int, int, int]], rules: list[Rule]) -> list[tuple[int, int, int]]:
    """Drop what lies inside a detection of higher priority, or inside a longer one of its own priority; of equal intervals the earlier rule stays."""
    order = sorted(found, key=lambda x: (-rules[x[2]].priority, x[0] - x[1], x[2], x[0]))
    starts: list[int] = []
    ends: list[int] = []
    kept = []
    for s, e, k in order:
        # ends[i]: the furthest end of kept intervals that start at or before starts[i]
        i = bisect_left(starts, s + 1)
        if i and ends[i - 1] >= e:
            continue
        kept.append((s, e, k))
        starts.insert(i, s)
        ends.insert(i, max(e, ends[i - 1]) if i else e)
        j = i + 1
        while j < len(ends) and ends[j] < e:
            ends[j] = e
            j += 1
    return sorted(kept)


_SCANNER: list[Scanner] = []


def scanner() -> Scanner:
    if not _SCANNER:
        _SCANNER.append(Scanner())
    return _SCANNER[0]


def scan_text(low: bytes, hit: set[bytes], word_starts: np.ndarray, s: Scanner) -> tuple[int, int | None, int | None, str, str, float, str]:
    """n_base, first_word, last_word, base_labels, labels, score, detections of a lower-cased text."""
    base_at: list[int] = []
    base: set[str] = set()
    for phrase, pattern in s.base.items():
        at = [m.start() for m in pattern.finditer(low)]
        if at:
            base_at += at
            base.add(BASE[phrase])
    kept = s.detections(low, hit)
    labels = base | {s.rules[k].label for _, _, k in kept}
    score = max([0.9] * bool(base) + [s.rules[k].score for _, _, k in kept], default=0.0)
    number = lambda b: int(np.searchsorted(word_starts, b))
    shown = ",".join(f"{s.rules[k].label}:{number(a)}:{number(b)}" for a, b, k in kept)
    places = [number(x) for x in base_at]
    return len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, shown


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document; ``detections`` lists label:first word:end word of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch in batches:
            for part in common.chunks(batch):
                data, offsets = common.utf8(part.column("text"))
                data = common.LOWER[data]
                starts, ends, counts = common.words(data, offsets, common.ALNUM)
                whole = data.tobytes()
                rows = [(0, None, None, "", "", 0.0, "")] * part.num_rows
                hits: dict[int, set[bytes]] = {}
                found = s.keywords(whole, starts, ends)
                for d, (_, x) in zip((np.searchsorted(offsets, [e for e, _ in found], side="right") - 1).tolist(), found):
                    hits.setdefault(d, set()).add(x)
                for d, hit in hits.items():
                    a, b = int(offsets[d]), int(offsets[d + 1])
                    own = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
                    rows[d] = scan_text(whole[a:b], hit, own, s)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string())
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=names)

    return common.text_column(docs, "doc_id", "text").mapInArrow(run, SCHEMA)
