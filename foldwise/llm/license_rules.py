"""License signatures: families of names and the phrasings that carry them.

Rules are regular expressions over folded text: lower-case words with one space
between them.  Each has keywords that must all occur before it is tried (of one
with alternatives, ``psf|python``, any), a priority that decides between
overlapping detections, and a confidence.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    confidence: float


# Label, regular expression of the names in use, the keyword of any
# such name (every alternative of the expression holds one of its own), SPDX identifier in folded form, and the place of the text on the web.
FAMILIES = [
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "bsd", "0bsd", r"opensource org licenses? 0bsd"),
    ("afl-3.0", r"academic free license(?: v(?:ersion)? ?3(?: 0)?| 3 0)?", "academic", "afl 3 0", r"opensource org licenses? afl 3 0"),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl(?:v?3)?)", "agpl|affero", "agpl 3 0(?: only| or later)?", r"gnu org licenses agpl(?: 3 0)?"),
    ("apache-1.1", r"apache (?:software )?license (?:v|version )?1 1", "apache", "apache 1 1", r"apache org licenses license 1 1"),
    ("apache-2", r"apache (?:software )?(?:license )?(?:v|version )?2(?: 0)?(?: license)?", "apache", "apache 2 0", r"apache org licenses license 2 0"),
    ("artistic-2.0", r"artistic license(?: (?:v|version )?2(?: 0)?)?", "artistic", "artistic 2 0", r"perlfoundation org artistic license 2 0"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd", "bsd 2 clause", r"opensource org licenses? bsd 2 clause"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd", "bsd 3 clause", r"opensource org licenses? bsd 3 clause"),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)", "bsd", "bsd 4 clause", r"spdx org licenses bsd 4 clause"),
    ("bsl-1.0", r"boost software license(?: (?:v|version )?1(?: 0)?)?", "boost", "bsl 1 0", r"boost org license 1 0"),
    ("busl-1.1", r"business source license(?: (?:v|version )?1(?: 1)?)?", "business", "busl 1 1", r"mariadb com bsl11"),
    ("cc-by", r"(?:cc by|creative commons attribution)(?: (?:v|version )?[234](?: [05])?)?(?: international)?(?! (?:nc|sa|nd|non|share|no))", "cc|creative", "cc by [1234] [05]", r"creativecommons org licenses by [1234] [05]"),
    ("cc-by-nc", r"(?:cc by nc|creative commons attribution non ?commercial)(?: (?:v|version )?[234](?: [05])?)?(?! (?:sa|nd|share|no))", "cc|creative", "cc by nc [1234] [05]", r"creativecommons org licenses by nc [1234] [05]"),
    ("cc-by-nc-nd", r"(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?)", "cc|creative", "cc by nc nd [1234] [05]", r"creativecommons org licenses by nc nd"),
    ("cc-by-nc-sa", r"(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc|creative", "cc by nc sa [1234] [05]", r"creativecommons org licenses by nc sa"),
    ("cc-by-nd", r"(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s?)", "cc|creative", "cc by nd [1234] [05]", r"creativecommons org licenses by nd"),
    ("cc-by-sa", r"(?:cc by sa|creative commons attribution share ?alike)", "cc|creative", "cc by sa [1234] [05]", r"creativecommons org licenses by sa"),
    ("cc0-1.0", r"(?:cc0|cc zero|creative commons zero)(?: (?:v|version )?1 0)?(?: universal)?", "cc|creative", "cc0 1 0", r"creativecommons org publicdomain zero 1 0"),
    ("cddl-1.0", r"(?:common development and distribution license|cddl)(?: (?:v|version )?1 0)?", "cddl|development", "cddl 1 0", r"opensource org licenses? cddl1?"),
    ("cecill-2.1", r"cecill(?: (?:b|c))?(?: (?:v|version )?2(?: [01])?)?", "cecill", "cecill 2 1", r"cecill info licences"),
    ("cpl-1.0", r"common public license(?: (?:v|version )?1 0)?", "common", "cpl 1 0", r"opensource org licenses? cpl1"),
    ("ecl-2.0", r"educational community license(?: (?:v|version )?2 0)?", "educational", "ecl 2 0", r"opensource org licenses? ecl 2 0"),
    ("epl-1.0", r"eclipse public license (?:v|version )?1(?: 0)?", "eclipse", "epl 1 0", r"eclipse org legal epl v10"),
    ("epl-2.0", r"eclipse public license(?: (?:v|version )?2(?: 0)?)?(?! 1)", "eclipse", "epl 2 0", r"eclipse org legal epl (?:v20|2 0)"),
    ("eupl-1.2", r"(?:european union public licen[cs]e|eupl)(?: (?:v|version )?1 2)?", "eupl|european", "eupl 1 2", r"joinup ec europa eu .{0,40}eupl"),
    ("fdl-1.3", r"gnu free documentation license(?: (?:v|version )?1 [123])?", "documentation", "gfdl 1 3(?: only| or later)?", r"gnu org licenses fdl(?: 1 3)?"),
    ("gpl-1.0", r"(?:gnu )?(?:general public license|gpl) (?:v|version )?1(?: 0)?", "gpl|general", "gpl 1 0(?: only| or later)?", r"gnu org licenses old licenses gpl 1 0"),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl) ?(?:v|version )?2(?: 0)?", "gpl|general", "gpl 2 0(?: only| or later)?", r"gnu org licenses old licenses gpl 2 0"),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl) ?(?:v|version )?3(?: 0)?", "gpl|general", "gpl 3 0(?: only| or later)?", r"gnu org licenses gpl(?: 3 0)?"),
    ("hpnd", r"historical permission notice and disclaimer", "historical", "hpnd", r"opensource org licenses? hpnd"),
    ("ipl-1.0", r"ibm public license(?: (?:v|version )?1 0)?", "ibm", "ipl 1 0", r"opensource org licenses? ipl 1 0"),
    ("isc", r"isc", "isc", "isc", r"opensource org licenses? isc"),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser|library) general public license (?:v|version )?2(?: [01])?|lgpl ?v?2(?: [01])?", "gpl|general", "lgpl 2 [01](?: only| or later)?", r"gnu org licenses old licenses lgpl 2 1"),
    ("lgpl-3.0", r"(?:gnu )?lesser general public license (?:v|version )?3(?: 0)?|lgpl ?v?3(?: 0)?", "gpl|general", "lgpl 3 0(?: only| or later)?", r"gnu org licenses lgpl(?: 3 0)?"),
    ("lppl-1.3c", r"latex project public license(?: (?:v|version )?1 3c?)?", "latex", "lppl 1 3c", r"latex project org lppl"),
    ("mit", r"(?:mit|expat|mit x11)", "mit|expat", "mit", r"opensource org licenses? mit"),
    ("mit-0", r"mit no attribution", "attribution", "mit 0", r"opensource org licenses? mit 0"),
    ("mpl-1.1", r"mozilla public license (?:v|version )?1 1", "mozilla", "mpl 1 1", r"mozilla org mpl 1 1"),
    ("mpl-2.0", r"mozilla public license(?: (?:v|version )?2(?: 0)?)?(?! 1)", "mozilla", "mpl 2 0", r"mozilla org (?:en us )?mpl 2 0"),
    ("ms-pl", r"microsoft public license", "microsoft", "ms pl", r"opensource org licenses? ms pl"),
    ("ms-rl", r"microsoft reciprocal license", "microsoft", "ms rl", r"opensource org licenses? ms rl"),
    ("ncsa", r"(?:university of illinois ncsa|illinois ncsa open source)", "ncsa", "ncsa", r"opensource org licenses? ncsa"),
    ("odbl-1.0", r"(?:open database license|odbl)(?: (?:v|version )?1 0)?", "odbl|open database", "odbl 1 0", r"opendatacommons org licenses odbl"),
    ("odc-by-1.0", r"open data commons attribution(?: (?:v|version )?1 0)?", "commons", "odc by 1 0", r"opendatacommons org licenses by"),
    ("ofl-1.1", r"(?:sil )?open font license(?: (?:v|version )?1 1)?", "font", "ofl 1 1", r"scripts sil org ofl"),
    ("openssl", r"openssl(?: ssleay)?", "openssl", "openssl", r"openssl org source license"),
    ("osl-3.0", r"open software license(?: (?:v|version )?3 0)?", "open", "osl 3 0", r"opensource org licenses? osl 3 0"),
    ("pddl-1.0", r"public domain dedication and license", "dedication", "pddl 1 0", r"opendatacommons org licenses pddl"),
    ("php-3.01", r"php license(?: (?:v|version )?3 01)?", "php", "php 3 01", r"php net license 3 01"),
    ("postgresql", r"postgresql", "postgresql", "postgresql", r"opensource org licenses? postgresql"),
    ("psf-2.0", r"(?:python software foundation|psf)(?: (?:v|version )?2)?", "psf|python", "psf 2 0", r"python org .{0,30}license"),
    ("ruby", r"ruby", "ruby", "ruby", r"ruby lang org en about license"),
    ("sspl-1.0", r"(?:server side public license|sspl)(?: (?:v|version )?1)?", "sspl|server side", "sspl 1 0", r"mongodb com licensing server side public license"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", "unlicense", r"unlicense org"),
    ("upl-1.0", r"universal permissive license(?: (?:v|version )?1 0)?", "universal", "upl 1 0", r"oss oracle com licenses upl"),
    ("vim", r"vim", "vim", "vim", r"vimhelp org uganda"),
    ("w3c", r"w3c software(?: notice and)?", "w3c", "w3c", r"w3 org consortium legal"),
    ("wtfpl", r"(?:do what the fuck you want to public license|wtfpl)", "wtfpl|fuck", "wtfpl", r"wtfpl net"),
    ("x11", r"(?:x11|x consortium)", "x11|x consortium", "x11", r"xfree86 org .{0,20}license"),
    ("zlib", r"(?:zlib|zlib libpng)", "zlib", "zlib", r"zlib net zlib license"),
    ("zpl-2.1", r"zope public license(?: (?:v|version )?2 1)?", "zope", "zpl 2 1", r"opensource org licenses? zpl"),
]

# Sentences of license texts, with label and keywords.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission", "hereby")),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", ("warranty", "merchantability")),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission", "hereby")),
    ("apache-2", r"you may not use this file except in compliance with the license", ("compliance", "except")),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license", ("applicable", "writing")),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "binary")),
    ("bsd-3-clause", r"neither the name of .{0,80} nor the names of (?:its|the) contributors may be used to endorse or promote products", ("neither", "endorse")),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledg[a-z]*", ("advertising", "acknowledg")),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("redistribute", "gnu")),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", ("redistribute", "gnu")),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", ("received", "gnu")),
    ("agpl-3.0", r"you should have received a copy of the gnu affero general public license", ("received", "affero")),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", ("subject", "mozilla")),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("accompanying", "eclipse")),
    ("unlicense", r"this is free and unencumbered software released into the public domain", ("unencumbered",)),
    ("zlib", r"the origin of this software must not be misrepresented", ("origin", "misrepresented")),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", ("permission", "accompanying")),
    ("public-domain", r"(?:released|placed|dedicated) (?:in)?to the public domain", ("public", "domain")),
    ("public-domain", r"this (?:work|file|text|software) is in the public domain", ("public", "domain")),
    ("all-rights-reserved", r"copyright (?:c )?(?:19|20)\d\d.{0,80} all rights reserved", ("copyright", "rights")),
    ("all-rights-reserved", r"no part of this (?:publication|work|book|document) may be reproduced", ("reproduced",)),
    ("proprietary", r"proprietary and confidential", ("proprietary", "confidential")),
    ("proprietary", r"unauthori[sz]ed copying .{0,60} is strictly prohibited", ("copying", "prohibited")),
    ("cc", r"this work is licensed under (?:a|the) creative commons", ("creative", "commons")),
    ("cc0-1.0", r"to the extent possible under law .{0,80} waived all copyright", ("waived", "copyright")),
    ("ofl-1.1", r"this font software is licensed under the sil open font license", ("font", "sil")),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("substantial", "notice")),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", ("liable", "holders")),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", ("appear", "notice")),
    ("bsd", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions", "retain")),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", ("redistributions", "reproduce")),
    ("bsd", r"in no event shall the (?:copyright (?:holder|owner)s?|regents) or contributors be liable for any direct indirect incidental special exemplary or consequential damages", ("liable", "exemplary")),
    ("bsd-3-clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse", "promote")),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", ("hope", "useful")),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("verbatim", "changing")),
    ("gpl-2.0", r"either version 2 of the license or (?:at your option )?any later version", ("either", "later")),
    ("gpl-3.0", r"either version 3 of the license or (?:at your option )?any later version", ("either", "later")),
    ("lgpl", r"this library is distributed in the hope that it will be useful but without any warranty", ("hope", "library")),
    ("lgpl-2.1", r"either version 2 1 of the license or (?:at your option )?any later version", ("either", "later")),
    ("agpl-3.0", r"remote network interaction use with the gnu general public license", ("remote", "gnu")),
    ("apache-2", r"licensed to the apache software foundation (?:asf )?under one or more contributor license agreements", ("contributor", "apache")),
    ("apache-2", r"subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", ("perpetual", "contributor")),
    ("mpl-2.0", r"if a copy of the mpl was not distributed with this file you can obtain one at", ("mpl", "obtain")),
    ("zlib", r"altered source versions must be plainly marked as such", ("altered", "plainly")),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", ("anyone", "compile")),
    ("bsl-1.0", r"this license grant this restriction and the following disclaimer must be included in all copies of the software", ("restriction", "disclaimer")),
    ("cc", r"you are free to share copy and redistribute the material in any medium or format", ("redistribute", "medium")),
    ("cc", r"no additional restrictions you may not apply legal terms or technological measures", ("technological", "restrictions")),
    ("cc-by", r"you must give appropriate credit provide a link to the licen[cs]e and indicate if changes were made", ("credit", "indicate")),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same licen[cs]e", ("remix", "contributions")),
    ("cc-by-nd", r"if you remix transform or build upon the material you may not distribute the modified material", ("remix", "modified")),
    ("cc-by-nc", r"you may not use the material for commercial purposes", ("material", "commercial")),
    ("eula", r"by (?:installing|downloading|copying|using) (?:or otherwise using )?(?:this|the) (?:software|product) you (?:agree|accept|acknowledge)", ("agree|accept|acknowledge", "software|product")),
    ("eula", r"(?:this|the) (?:software|product) is licensed not sold", ("licensed", "sold")),
    ("eula", r"end user licen[cs]e agreement", ("end", "agreement")),
    ("proprietary", r"you may not (?:modify )?(?:reverse engineer decompile|decompile reverse engineer|decompile disassemble)", ("decompile",)),
    ("proprietary", r"contains (?:confidential and proprietary|proprietary and confidential|trade secrets?) information", ("contains", "proprietary|trade")),
    ("all-rights-reserved", r"may be reproduced (?:stored in a retrieval system |distributed )?or transmitted in any form or by any means", ("transmitted", "means")),
]

_VERB = r"(?:(?:re)?licen[cs]ed|released|distributed|available|published|provided|offered|shared|covered|governed)"
_LEAD = r"(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?"
_VERSION = r"(?:v|version )?\d(?: \d)?"
_TAIL = rf"(?: (?:public )?licen[cs]es?)?(?: {_VERSION})?"
# After "by" and "via" a bare name may be that of an institute, a person or a product.
_STRICT_TAIL = rf"(?: (?:public )?licen[cs]es?(?: {_VERSION})?| {_VERSION}|(?<=[ v]\d))"


# Families whose names are those of makers, too.
_MAKERS = {"bsd-2-clause", "isc", "mit", "ncsa", "openssl", "postgresql", "psf-2.0", "ruby", "vim", "w3c", "x11"}


def _grant(label: str, name: str) -> str:
    named = rf"(?:{name})"
    tail = _STRICT_TAIL if label in _MAKERS else _TAIL
    return rf"{_VERB} (?:under {_LEAD}{named}{_TAIL}|(?:by|via) {_LEAD}{named}{tail})"


def rules() -> list[Rule]:
    """Six phrasings of every family, and the sentences."""
    out = []
    for label, name, keyword, spdx, place in FAMILIES:
        named = rf"(?:{name})"
        phrasings = [
            ("spdx", rf"spdx licen[cs]e identifier {spdx}", ("spdx",), 100, 1.0),
            ("address", place, (place.split()[0].replace("?", "").split("(")[0],), 90, 0.9),
            ("grant", _grant(label, name), (keyword, "under|by|via"), 80, 0.95),
            ("terms", rf"(?:terms|copy|text) (?:and conditions )?of the {named} licen[cs]e", (keyword, "licen"), 70, 0.8),
            ("title", rf"(?:the )?{named} licen[cs]es?", (keyword, "licen"), 40, 0.6),
            ("field", rf"licen[cs]e (?:is )?{named}", (keyword, "licen"), 50, 0.7),
        ]
        out += [Rule(f"{label}:{kind}", label, p, k, rank, c) for kind, p, k, rank, c in phrasings]
    for i, (label, pattern, keywords) in enumerate(SENTENCES):
        out.append(Rule(f"{label}:sentence-{i}", label, pattern, keywords, 60, 0.9))
    return out
