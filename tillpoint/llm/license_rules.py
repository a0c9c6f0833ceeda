"""Signature rules of licences (operator 11), written by hand.

A family has a label, an SPDX identifier, names, addresses and sentences that
are its own.  In the patterns a blank stands for any gap between two words;
matching ignores the case of ASCII letters.  Beside each pattern stand
literal keywords, in lower case and apart, that every match of it contains.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Characters that are no part of a word, and a gap of them.
SEPARATOR = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD_CHARACTER = rf"[^{SEPARATOR}]"
GAP = rf"(?:[{SEPARATOR}]{{1,8}})"

#: Kind of a rule: priority (1 is strongest) and confidence.
TAG, NOTICE, CLAUSE, ADDRESS, NAME = (1, 1.0), (2, 0.95), (3, 0.9), (4, 0.85), (5, 0.7)
PRIORITIES = 5

VERBS = r"(?:licen[sc]ed|released|distributed|re-?distributed|available|published|provided|covered|governed|issued|offered|shared|used|copied|modified)"
UNDER = rf"{VERBS}(?: to you)?(?: (?:only|solely|and distributed))? (?:under|by|according to|subject to|pursuant to)(?: the)?(?: (?:terms|conditions|terms and conditions|provisions) of)?(?: the)? "

L = "licen[sc]e"


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    priority: int
    confidence: float
    keys: tuple[str, ...]
    regex: str


def words(keys: str) -> list[str]:
    """Keywords apart: gaps in a match need not be blanks."""
    return keys.replace(",", " ").split()


def worded(pattern: str) -> str:
    """A pattern whose blanks are gaps and whose ends are ends of words."""
    return rf"(?i)(?<!{WORD_CHARACTER}){pattern.replace(' ', GAP)}(?!{WORD_CHARACTER})"


# label, SPDX identifier, names ((keywords, pattern) ...), address (keyword, pattern), sentences ((keywords, pattern) ...)
FAMILIES = [
    ("mit", "MIT", [("mit,licen", rf"MIT(?: X11| Expat)?(?: style)? {L}"), ("expat,licen", rf"Expat {L}")],
     ("opensource.org/licenses/mit", r"opensource\.org/licenses/MIT"),
     [("permission is hereby granted,free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
      ("the software is provided", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability")]),
    ("mit-0", "MIT-0", [("mit,attribution", rf"MIT No Attribution(?: {L})?")], ("spdx.org/licenses/mit-0", r"spdx\.org/licenses/MIT-0"), []),
    ("x11", "X11", [("x11,licen", rf"X11 {L}")], None,
     [("x consortium", r"the name of the X Consortium shall not be used in advertising")]),
    ("apache-2", "Apache-2.0", [("apache,licen", rf"Apache(?: Software)? {L}(?: (?:version|v))? ?2(?:\.0)?"), ("apache", r"Apache(?: v?2\.0|2)"),
                                ("asl", r"ASL ?2\.0")],
     ("apache.org/licenses/license-2.0", r"apache\.org/licenses/LICENSE-2\.0"),
     [("unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the License is distributed on an AS IS BASIS"),
      ("you may not use this file,licen", r"you may not use this file except in compliance with the License")]),
    ("apache-1.1", "Apache-1.1", [("apache,licen", rf"Apache(?: Software)? {L}(?: (?:version|v))? ?1\.1")], ("apache.org/licenses/license-1.1", r"apache\.org/licenses/LICENSE-1\.1"), []),
    ("apache-1", "Apache-1.0", [("apache,licen", rf"Apache(?: Software)? {L}(?: (?:version|v))? ?1\.0")], ("apache.org/licenses/license-1.0", r"apache\.org/licenses/LICENSE-1\.0"), []),
    ("apache", "", [("apache,licen", rf"Apache(?: Software)? {L}")], None, []),
    ("bsd-2-clause", "BSD-2-Clause", [("bsd,clause", rf"BSD (?:2|two) clause(?: (?:simplified|freebsd))?(?: {L})?"), ("simplified bsd", rf"(?:the )?Simplified BSD(?: {L})?"),
                                      ("freebsd,licen", rf"FreeBSD {L}")],
     ("opensource.org/licenses/bsd-2-clause", r"opensource\.org/licenses/BSD-2-Clause"), []),
    ("bsd-3-clause", "BSD-3-Clause", [("bsd,clause", rf"BSD (?:3|three) clause(?: (?:new|revised|modified))?(?: {L})?"), ("bsd,licen", rf"(?:new|revised|modified) BSD {L}")],
     ("opensource.org/licenses/bsd-3-clause", r"opensource\.org/licenses/BSD-3-Clause"),
     [("neither the name", r"neither the name of (?:the )?[^\n]{1,80}? nor the names of its contributors may be used to endorse or promote products")]),
    ("bsd-4-clause", "BSD-4-Clause", [("bsd,clause", rf"BSD (?:4|four) clause(?: {L})?"), ("original bsd", rf"original BSD(?: {L})?")], None,
     [("all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment")]),
    ("bsd-0", "0BSD", [("bsd,clause", rf"(?:BSD (?:zero|0) clause|zero clause BSD)(?: {L})?"), ("0bsd", r"0BSD")], ("opensource.org/licenses/0bsd", r"opensource\.org/licenses/0BSD"), []),
    ("bsd", "", [("bsd,licen", rf"BSD(?: style)? {L}")], ("opensource.org/licenses/bsd-license", r"opensource\.org/licenses/bsd-license"),
     [("redistribution and use in source and binary", r"redistribution and use in source and binary forms with or without modification are permitted")]),
    ("isc", "ISC", [("isc,licen", rf"ISC {L}")], ("opensource.org/licenses/isc", r"opensource\.org/licenses/ISC"),
     [("permission to use", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted")]),
    ("gpl-1", "GPL-1.0", [("general public licen", rf"(?:GNU )?General Public {L} (?:\(?GPL\)? )?(?:version |v ?)1(?:\.0)?"), ("gpl", r"GPL(?: (?:version|v))? ?v?1(?:\.0)?")], ("gpl-1.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-1\.0"), []),
    ("gpl-2", "GPL-2.0", [("general public licen", rf"(?:GNU )?General Public {L} (?:\(?GPL\)? )?(?:as published by the Free Software Foundation )?(?:either )?(?:version |v ?)2(?:\.0)?"),
                          ("gpl", r"GPL(?: (?:version|v))? ?v?2(?:\.0)?")], ("gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0"), []),
    ("gpl-3", "GPL-3.0", [("general public licen", rf"(?:GNU )?General Public {L} (?:\(?GPL\)? )?(?:as published by the Free Software Foundation )?(?:either )?(?:version |v ?)3(?:\.0)?"),
                          ("gpl", r"GPL(?: (?:version|v))? ?v?3(?:\.0)?")], ("gnu.org/licenses/gpl-3.0", r"gnu\.org/licenses/gpl-3\.0"), []),
    ("gpl", "", [("general public licen", rf"(?:GNU )?General Public {L}"), ("gnu gpl", r"GNU GPL")], ("gnu.org/licenses/gpl", r"gnu\.org/licenses/gpl(?:\.html|\.txt)?"),
     [("redistribute,general public licen", r"you can redistribute it and or modify it under the terms of the GNU General Public License")]),
    ("lgpl-2", "LGPL-2.0", [("library general public licen", rf"(?:GNU )?Library General Public {L}(?: (?:version |v ?)2(?:\.0)?)?"), ("lgpl", r"LGPL(?: (?:version|v))? ?v?2\.0")], ("lgpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.0"), []),
    ("lgpl-2.1", "LGPL-2.1", [("lesser general public licen", rf"(?:GNU )?Lesser General Public {L} (?:as published by the Free Software Foundation )?(?:either )?(?:version |v ?)2\.1"),
                              ("lgpl", r"LGPL(?: (?:version|v))? ?v?2\.1")], ("lgpl-2.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"), []),
    ("lgpl-3", "LGPL-3.0", [("lesser general public licen", rf"(?:GNU )?Lesser General Public {L} (?:as published by the Free Software Foundation )?(?:either )?(?:version |v ?)3(?:\.0)?"),
                            ("lgpl", r"LGPL(?: (?:version|v))? ?v?3(?:\.0)?")], ("gnu.org/licenses/lgpl-3.0", r"gnu\.org/licenses/lgpl-3\.0"), []),
    ("lgpl", "", [("lesser general public licen", rf"(?:GNU )?Lesser General Public {L}"), ("gnu lgpl", r"GNU LGPL")], ("gnu.org/licenses/lgpl", r"gnu\.org/licenses/lgpl(?:\.html|\.txt)?"), []),
    ("agpl-3", "AGPL-3.0", [("affero general public licen", rf"(?:GNU )?Affero General Public {L} (?:as published by the Free Software Foundation )?(?:either )?(?:version |v ?)3(?:\.0)?"),
                            ("agpl", r"AGPL(?: (?:version|v))? ?v?3(?:\.0)?")], ("gnu.org/licenses/agpl-3.0", r"gnu\.org/licenses/agpl-3\.0"), []),
    ("agpl", "", [("affero general public licen", rf"(?:GNU )?Affero General Public {L}"), ("gnu agpl", r"GNU AGPL")], ("gnu.org/licenses/agpl", r"gnu\.org/licenses/agpl(?:\.html|\.txt)?"),
     [("remote network interaction", r"remote network interaction use with the GNU General Public License")]),
    ("gfdl", "GFDL-1.3", [("free documentation licen", rf"(?:GNU )?Free Documentation {L}(?: (?:version |v ?)1\.[0-3])?"), ("gfdl", r"GFDL")], ("gnu.org/", r"gnu\.org/(?:licenses|copyleft)/fdl"),
     [("no invariant sections", r"with no Invariant Sections no Front Cover Texts and no Back Cover Texts")]),
    ("mpl-1", "MPL-1.0", [("mozilla public licen", rf"Mozilla Public {L}(?: (?:version|v))? ?1\.0")], ("mozilla.org/mpl/1.0", r"mozilla\.org/MPL/1\.0"), []),
    ("mpl-1.1", "MPL-1.1", [("mozilla public licen", rf"Mozilla Public {L}(?: (?:version|v))? ?1\.1"), ("mpl", r"MPL(?: v)? ?1\.1")], ("mozilla.org/mpl/mpl-1.1", r"mozilla\.org/MPL/MPL-1\.1"), []),
    ("mpl-2", "MPL-2.0", [("mozilla public licen", rf"Mozilla Public {L}(?: (?:version|v))? ?2(?:\.0)?"), ("mpl", r"MPL(?: v)? ?2(?:\.0)?")], ("mozilla.org/mpl/2.0", r"mozilla\.org/MPL/2\.0"),
     [("source code form", r"this Source Code Form is subject to the terms of the Mozilla Public License")]),
    ("mpl", "", [("mozilla public licen", rf"Mozilla Public {L}")], ("mozilla.org/mpl", r"mozilla\.org/MPL"), []),
    ("epl-1", "EPL-1.0", [("eclipse public licen", rf"Eclipse Public {L}(?: (?:version|v))? ?1(?:\.0)?"), ("epl", r"EPL(?: v)? ?1\.0")], ("eclipse.org/legal/epl-v10", r"eclipse\.org/legal/epl-v10"), []),
    ("epl-2", "EPL-2.0", [("eclipse public licen", rf"Eclipse Public {L}(?: (?:version|v))? ?2(?:\.0)?"), ("epl", r"EPL(?: v)? ?2\.0")], ("eclipse.org/legal/epl", r"eclipse\.org/legal/epl-(?:2\.0|v20)"), []),
    ("epl", "", [("eclipse public licen", rf"Eclipse Public {L}")], None, []),
    ("edl", "", [("eclipse distribution licen", rf"Eclipse Distribution {L}(?: (?:version|v))?(?: ?1\.0)?")], ("eclipse.org/org/documents/edl", r"eclipse\.org/org/documents/edl-v10"), []),
    ("cddl-1", "CDDL-1.0", [("common development and distribution", rf"Common Development and Distribution {L}(?: (?:version|v))? ?1\.0"), ("cddl", r"CDDL(?: v)? ?1\.0")], ("opensource.org/licenses/cddl-1.0", r"opensource\.org/licenses/CDDL-1\.0"), []),
    ("cddl-1.1", "CDDL-1.1", [("common development and distribution", rf"Common Development and Distribution {L}(?: (?:version|v))? ?1\.1"), ("cddl", r"CDDL(?: v)? ?1\.1")], None, []),
    ("cddl", "", [("common development and distribution", rf"Common Development and Distribution {L}")], None, []),
    ("cpl-1", "CPL-1.0", [("common public licen", rf"Common Public {L}(?: (?:version|v))?(?: ?1\.0)?")], ("opensource.org/licenses/cpl1.0", r"opensource\.org/licenses/cpl1\.0"), []),
    ("ipl-1", "IPL-1.0", [("ibm public licen", rf"IBM Public {L}(?: (?:version|v))?(?: ?1\.0)?")], None, []),
    ("eupl-1.1", "EUPL-1.1", [("european union public licen", rf"European Union Public {L}(?: (?:version|v))? ?1\.1"), ("eupl", r"EUPL(?: v)? ?1\.1")], None, []),
    ("eupl-1.2", "EUPL-1.2", [("european union public licen", rf"European Union Public {L}(?: (?:version|v))? ?1\.2"), ("eupl", r"EUPL(?: v)? ?1\.2")], ("eupl-1.2", r"joinup\.ec\.europa\.eu/[^\s]{0,80}eupl-1\.2"), []),
    ("eupl", "", [("european union public licen", rf"European Union Public {L}")], None, []),
    ("osl-3", "OSL-3.0", [("open software licen", rf"Open Software {L}(?: (?:version|v))?(?: ?3\.0)?")], ("opensource.org/licenses/osl-3.0", r"opensource\.org/licenses/OSL-3\.0"), []),
    ("afl-3", "AFL-3.0", [("academic free licen", rf"Academic Free {L}(?: (?:version|v))?(?: ?3\.0)?")], ("opensource.org/licenses/afl-3.0", r"opensource\.org/licenses/AFL-3\.0"), []),
    ("artistic-1", "Artistic-1.0", [("artistic licen", rf"(?:original )?Artistic {L}(?: (?:version|v))? ?1\.0")], None, []),
    ("artistic-2", "Artistic-2.0", [("artistic licen", rf"Artistic {L}(?: (?:version|v))? ?2\.0")], ("opensource.org/licenses/artistic-2.0", r"opensource\.org/licenses/Artistic-2\.0"), []),
    ("artistic", "", [("artistic licen", rf"Artistic {L}")], ("dev.perl.org/licenses/artistic", r"dev\.perl\.org/licenses/artistic"), []),
    ("boost-1", "BSL-1.0", [("boost software licen", rf"Boost Software {L}(?: (?:version|v))?(?: ?1\.0)?")], ("boost.org/license_1_0", r"boost\.org/LICENSE_1_0"), []),
    ("zlib", "Zlib", [("zlib,licen", rf"zlib(?: libpng)? {L}")], ("opensource.org/licenses/zlib", r"opensource\.org/licenses/Zlib"),
     [("must not be misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software")]),
    ("libpng", "Libpng", [("libpng,licen", rf"libpng {L}")], None, []),
    ("unlicense", "Unlicense", [("unlicense", r"(?:the )?Unlicense")], ("unlicense.org", r"unlicense\.org"),
     [("unencumbered software", r"this is free and unencumbered software released into the public domain")]),
    ("wtfpl", "WTFPL", [("wtfpl", r"WTFPL"), ("what the fuck,licen", rf"Do What The Fuck You Want To Public {L}")], ("wtfpl.net", r"wtfpl\.net"), []),
    ("public-domain", "", [], None,
     [("public domain", r"(?:released|placed|dedicated|put|donated|is|are) (?:in|into|to) the public domain"), ("public domain", r"public domain (?:dedication|mark)")]),
    ("cc0", "CC0-1.0", [("cc0", r"CC0(?: (?:v )?1\.0)?(?: universal)?"), ("creative commons zero", rf"Creative Commons Zero(?: {L})?(?: v?1\.0)?(?: universal)?")],
     ("creativecommons.org/publicdomain/zero", r"creativecommons\.org/publicdomain/zero"), []),
    ("python-2", "Python-2.0", [("python,licen", rf"Python(?: Software Foundation)? {L}(?: (?:version|v)? ?2(?:\.0)?)?"), ("psf,licen", rf"PSF {L}(?: (?:version|v)? ?2(?:\.0)?)?")], ("docs.python.org", r"docs\.python\.org/[0-9.]{0,6}/?license\.html"), []),
    ("postgresql", "PostgreSQL", [("postgresql,licen", rf"PostgreSQL {L}")], ("opensource.org/licenses/postgresql", r"opensource\.org/licenses/PostgreSQL"), []),
    ("php-3", "PHP-3.01", [("php,licen", rf"PHP {L}(?: (?:version|v))?(?: ?3\.0?1?)?")], ("php.net/license", r"php\.net/license"), []),
    ("ruby", "Ruby", [("ruby,licen", rf"Ruby(?: s)? {L}")], None, []),
    ("perl", "", [("perl", r"under the same terms as Perl(?: itself)?")], None, []),
    ("vim", "Vim", [("vim,licen", rf"Vim {L}")], None, []),
    ("w3c", "W3C", [("w3c,licen", rf"W3C(?: software)?(?: (?:notice|document))?(?: and)? {L}")], ("w3.org/consortium/legal", r"w3\.org/Consortium/Legal"), []),
    ("openssl", "OpenSSL", [("openssl,licen", rf"OpenSSL {L}")], None, [("openssl project", r"this product includes software developed by the OpenSSL Project")]),
    ("ofl-1.1", "OFL-1.1", [("open font licen", rf"(?:SIL )?Open Font {L}(?: (?:version|v))?(?: ?1\.1)?")], ("scripts.sil.org/ofl", r"scripts\.sil\.org/OFL"), []),
    ("ms-pl", "MS-PL", [("microsoft public licen", rf"Microsoft Public {L}"), ("ms-pl", r"MS-PL")], None, []),
    ("ms-rl", "MS-RL", [("microsoft reciprocal licen", rf"Microsoft Reciprocal {L}"), ("ms-rl", r"MS-RL")], None, []),
    ("ncsa", "NCSA", [("ncsa", rf"(?:University of Illinois )?NCSA(?: open source)? {L}")], ("opensource.org/licenses/ncsa", r"opensource\.org/licenses/NCSA"), []),
    ("upl-1", "UPL-1.0", [("universal permissive licen", rf"Universal Permissive {L}(?: (?:version|v))?(?: ?1\.0)?")], ("oss.oracle.com/licenses/upl", r"oss\.oracle\.com/licenses/upl"), []),
    ("bsl-1.1", "BUSL-1.1", [("business source licen", rf"Business Source {L}(?: (?:version|v))?(?: ?1\.1)?")], ("mariadb.com/bsl11", r"mariadb\.com/bsl11"), []),
    ("sspl-1", "SSPL-1.0", [("server side public licen", rf"Server Side Public {L}(?: (?:version|v))?(?: ?1)?"), ("sspl", r"SSPL(?: v?1)?")], None, []),
    ("elastic-2", "Elastic-2.0", [("elastic licen", rf"Elastic {L}(?: (?:version|v))?(?: ?2\.0)?")], ("elastic.co/licensing/elastic-license", r"elastic\.co/licensing/elastic-license"), []),
    ("polyform-nc-1", "PolyForm-Noncommercial-1.0.0", [("polyform", rf"PolyForm Noncommercial {L}(?: 1\.0\.0)?")], ("polyformproject.org/licenses/noncommercial", r"polyformproject\.org/licenses/noncommercial"), []),
    ("odbl-1", "ODbL-1.0", [("open database licen", rf"(?:ODC )?Open Database {L}(?: (?:version|v)? ?1\.0)?"), ("odbl", r"ODbL(?: v?1\.0)?")], ("opendatacommons.org/licenses/odbl", r"opendatacommons\.org/licenses/odbl"), []),
    ("odc-by-1", "ODC-By-1.0", [("open data commons attribution", rf"Open Data Commons Attribution {L}(?: v?1\.0)?"), ("odc-by", r"ODC-By(?: v?1\.0)?")], ("opendatacommons.org/licenses/by", r"opendatacommons\.org/licenses/by"), []),
    ("pddl-1", "PDDL-1.0", [("public domain dedication and licen", rf"Public Domain Dedication and {L}")], ("opendatacommons.org/licenses/pddl", r"opendatacommons\.org/licenses/pddl"), []),
    ("openrail", "", [("open,rail", r"(?:BigScience |CreativeML )?Open ?RAIL(?: \+{1,2})?(?: M)?"), ("responsible ai licen", rf"Responsible AI {L}")], None, []),
    ("all-rights-reserved", "", [], None, [("all rights reserved", r"all rights reserved")]),
]

#: Parts of the Creative Commons licences: letters, long form.
COMMONS = [("by", "Attribution"), ("by-sa", "Attribution Share ?Alike"), ("by-nd", "Attribution No ?Derivs|Attribution No ?Derivatives"),
           ("by-nc", "Attribution Non ?Commercial"), ("by-nc-sa", "Attribution Non ?Commercial Share ?Alike"),
           ("by-nc-nd", "Attribution Non ?Commercial No ?Derivs|Attribution Non ?Commercial No ?Derivatives")]
VERSION = r"(?: (?:version |v ?)?[1-4]\.[05])?"
for _parts, _long in COMMONS:
    _short = f"CC {_parts.replace('-', ' ')}"
    FAMILIES.append((
        f"cc-{_parts}", f"CC-{_parts.upper()}", [("cc,by", _short + VERSION), ("creative commons", rf"Creative Commons (?:{_long})(?: (?:international|unported|public))?(?: {L})?{VERSION}(?: international| unported)?(?: {L})?")],
        (f"creativecommons.org/licenses/{_parts}", rf"creativecommons\.org/licenses/{_parts}(?:/[1-4]\.[05])?"), []))
FAMILIES.append(("cc", "", [("creative commons", rf"Creative Commons {L}")], None, []))


def rules() -> list[Rule]:
    """All rules, in order."""
    found: list[Rule] = []

    def add(label, kind, keys, regex):
        found.append(Rule(len(found), label, *kind, tuple(keys), regex))

    for label, spdx, names, address, sentences in FAMILIES:
        if spdx:
            # a tag's first identifier, or one that it joins by OR or AND
            version = r"(?:-[1-4]\.[05])?" if label.startswith("cc-") else ""
            add(label, TAG, ("spdx-license-identifier", spdx.lower()),
                rf"(?i)(?:SPDX-License-Identifier:[ \t]*\(?|(?-i:OR|AND)[ \t]+\(?){re.escape(spdx).replace(chr(92) + '-', '-')}{version}(?:-only|-or-later|\+)?(?![0-9A-Za-z.-])")
        for keys, name in names:
            add(label, NOTICE, words(keys), worded(UNDER + f"(?:{name})"))
            add(label, NAME, words(keys), worded(f"(?:{name})"))
        if address:
            add(label, ADDRESS, (address[0],), rf"(?i)(?<![0-9A-Za-z-]){address[1]}(?![0-9A-Za-z])")
        for keys, sentence in sentences:
            add(label, CLAUSE, words(keys), worded(f"(?:{sentence})"))
    return found


#: Every rule has a keyword with one of these in it.
STEMS = ("licen", "gpl", "cc", "advertising", "reserved", "apache", "asl", "attribution", "bsd", "cddl", "commo", "consortium", "domain",
         "epl", "gfdl", "invariant", "mariadb", "misrepresented", "mpl", "ms-", "ncsa", "neither", "network", "odbl", "odc-", ".org", "openssl",
         "perl", "permission", "polyform", "provided", "rail", "required", "source", "sspl", "unencumbered", "upl", "wtfpl")
