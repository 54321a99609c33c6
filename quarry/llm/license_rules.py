"""The signature rules of the license scan.

A text is matched as its lower-case words with one space between them. A name is written by hand as a regular expression
that starts with a plain word; forms put it into grants, headers and addresses, so that some hundred names make some
hundred rules. Every rule has a keyword, a piece of text that all its matches hold, by which it is left out early.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Words of the longest match; rules with longer ones aren't found whole.
LONGEST = 32


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    priority: int
    confidence: float
    base: bool = False

    @property
    def anchor(self) -> str:
        """The word that every match starts with."""
        return re.match("[a-z0-9]+", self.regex)[0]


#: Pieces that many keywords share, looked for before these are.
STEMS = ("licen", "gpl", "bsd", "cc by", "creative", "apache", "public domain", "permission", "redistribution", "rights reserved", "unlicense")


def stem(keyword: str) -> str:
    """What is looked for first: a stem within the keyword, or it."""
    return next((s for s in STEMS if s in keyword), keyword)


#: Phrases whose places are counted, with their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Label, keyword, name.
NAMES = (
    ("mit", "mit license", "mit license"),
    ("mit", "expat license", "expat license"),
    ("mit-0", "mit no attribution", "mit no attribution(?: license)?"),
    ("x11", "x11 license", "x11 license"),
    ("x11", "mit x11", "mit x11(?: license)?"),
    ("apache-2", "apache license", "apache license(?: version)?(?: v)? ?2(?: 0)?"),
    ("apache-2", "apache software license", "apache software license(?: version)? 2(?: 0)?"),
    ("apache-2", "apache 2", "apache 2(?: 0)? licen[sc]e"),
    ("apache-1.1", "apache", "apache(?: software)? license(?: version)? 1 1"),
    ("apache-1.0", "apache", "apache(?: software)? license(?: version)? 1 0"),
    ("apache", "apache", "apache(?: software)? licen[sc]e"),
    ("bsd-2-clause", "bsd", "bsd (?:2|two) clause(?: simplified)?(?: license)?"),
    ("bsd-2-clause", "simplified bsd", "simplified bsd(?: license)?"),
    ("bsd-2-clause", "freebsd license", "freebsd license"),
    ("bsd-3-clause", "bsd", "bsd (?:3|three) clause(?: new| revised)?(?: license)?"),
    ("bsd-3-clause", "new bsd", "new bsd(?: license)?"),
    ("bsd-3-clause", "modified bsd", "modified bsd(?: license)?"),
    ("bsd-4-clause", "bsd", "bsd (?:4|four) clause(?: original)?(?: license)?"),
    ("bsd-4-clause", "original bsd", "original bsd(?: license)?"),
    ("bsd-0-clause", "bsd", "bsd (?:0|zero) clause(?: license)?"),
    ("bsd-0-clause", "zero clause bsd", "zero clause bsd(?: license)?"),
    ("bsd", "bsd license", "bsd license"),
    ("bsd", "bsd style license", "bsd style license"),
    ("gpl-1", "general public license", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 1(?: 0)?(?: only| or later| or any later version)?"),
    ("gpl-2", "general public license", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?(?: only)?(?: of the license)?"),
    ("gpl-2-or-later", "general public license", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?"),
    ("gpl-3", "general public license", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: only)?(?: of the license)?"),
    ("gpl-3-or-later", "general public license", "gnu general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: of the license)? or(?: at your option)?(?: any)? later(?: version)?"),
    ("gpl", "general public license", "gnu general public license"),
    ("gpl", "general public license", "general public license"),
    ("gpl-2", "gpl", "gpl(?: version)? (?:v2|2)(?: 0)?(?: only)?"),
    ("gpl-2-or-later", "gpl", "gpl(?: version)? (?:v2|2)(?: 0)?(?: or later)"),
    ("gpl-3", "gpl", "gpl(?: version)? (?:v3|3)(?: 0)?(?: only)?"),
    ("gpl-3-or-later", "gpl", "gpl(?: version)? (?:v3|3)(?: 0)?(?: or later)"),
    ("gpl-2", "gplv2", "gplv2"),
    ("gpl-3", "gplv3", "gplv3"),
    ("gpl", "gnu gpl", "gnu gpl"),
    ("lgpl-2", "library general public license", "gnu library general public license(?: version| v)?(?: 2(?: 0)?)?"),
    ("lgpl-2.1", "lesser general public license", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2 1(?: only| or later| of the license)?"),
    ("lgpl-3", "lesser general public license", "gnu lesser general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: only| or later| of the license)?"),
    ("lgpl", "lesser general public license", "gnu lesser general public license"),
    ("lgpl-2.1", "lgpl", "lgpl(?: version)? (?:v2|2) 1(?: only| or later)?"),
    ("lgpl-3", "lgpl", "lgpl(?: version)? (?:v3|3)(?: 0)?(?: only| or later)?"),
    ("lgpl", "gnu lgpl", "gnu lgpl"),
    ("agpl-3", "affero general public license", "gnu affero general public license(?: as published by the free software foundation)?(?: either)?(?: version| v)?(?: 3(?: 0)?)?(?: only| or later| of the license)?"),
    ("agpl-3", "affero general public license", "affero general public license(?: version)? 3(?: 0)?"),
    ("agpl-3", "agpl", "agpl(?: version)? (?:v3|3)(?: 0)?(?: only| or later)?"),
    ("agpl-3", "agplv3", "agplv3"),
    ("gfdl", "free documentation license", "gnu free documentation license(?: version 1 [123])?"),
    ("mpl-1.1", "mozilla public license", "mozilla public license(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla public license", "mozilla public license(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla public license", "mozilla public license"),
    ("mpl-2.0", "mpl 2", "mpl 2(?: 0)?"),
    ("epl-1.0", "eclipse public license", "eclipse public license(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse public license", "eclipse public license(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse public license", "eclipse public license"),
    ("edl-1.0", "eclipse distribution license", "eclipse distribution license(?: version| v)?(?: 1(?: 0)?)?"),
    ("cddl-1.0", "common development and distribution license", "common development and distribution license(?: cddl)?(?: version| v)?(?: 1(?: 0)?)?"),
    ("cddl-1.1", "common development and distribution license", "common development and distribution license(?: cddl)?(?: version| v)? 1 1"),
    ("cpl-1.0", "common public license", "common public license(?: version| v)?(?: 1(?: 0)?)?"),
    ("eupl", "european union public licen", "european union public licen[cs]e(?: version| v)?(?: 1 [012])?"),
    ("isc", "isc license", "isc license"),
    ("zlib", "zlib", "zlib(?: libpng)? license"),
    ("libpng", "libpng license", "libpng license(?: version 2)?"),
    ("bsl-1.0", "boost software license", "boost software license(?: version| v)?(?: 1(?: 0)?)?"),
    ("artistic-1.0", "artistic license", "artistic license(?: version| v)? 1(?: 0)?"),
    ("artistic-2.0", "artistic license", "artistic license(?: version| v)? 2(?: 0)?"),
    ("artistic", "artistic license", "artistic license"),
    ("psf-2.0", "python software foundation license", "python software foundation license(?: version| v)?(?: 2)?"),
    ("php-3.01", "php license", "php license(?: version| v)?(?: 3 0?1?)?"),
    ("ruby", "ruby license", "ruby license"),
    ("openssl", "openssl license", "openssl license"),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e"),
    ("ncsa", "ncsa", "ncsa open source license"),
    ("ncsa", "illinois", "university of illinois ncsa open source license"),
    ("afl-3.0", "academic free license", "academic free license(?: version| v)?(?: 3(?: 0)?)?"),
    ("osl-3.0", "open software license", "open software license(?: version| v)?(?: 3(?: 0)?)?"),
    ("ms-pl", "microsoft public license", "microsoft public license(?: ms pl)?"),
    ("ms-rl", "microsoft reciprocal license", "microsoft reciprocal license(?: ms rl)?"),
    ("ofl-1.1", "open font license", "sil open font license(?: version| v)?(?: 1 [01])?"),
    ("ofl-1.1", "open font license", "open font license(?: version| v)?(?: 1 [01])?"),
    ("lppl", "latex project public license", "latex project public license(?: version| v)?(?: 1 [0-3][abc]?)?"),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("upl-1.0", "universal permissive license", "universal permissive license(?: version| v)?(?: 1(?: 0)?)?"),
    ("blueoak-1.0", "blue oak model license", "blue oak model license(?: 1 0 0)?"),
    ("busl-1.1", "business source license", "business source license(?: version| v)?(?: 1 1)?"),
    ("sspl-1", "server side public license", "server side public license(?: version| v)?(?: 1)?"),
    ("elastic-2.0", "elastic license", "elastic license(?: version| v)?(?: 2(?: 0)?)?"),
    ("openrail", "openrail", "openrail(?: m)?(?: license)?"),
    ("odbl", "open database license", "open database license(?: version| v)?(?: 1(?: 0)?)?"),
    ("odc-by", "open data commons attribution license", "open data commons attribution license(?: version| v)?(?: 1(?: 0)?)?"),
    ("pddl", "public domain dedication and licen", "public domain dedication and licen[cs]e"),
    ("ogl-uk", "open government licen", "open government licen[cs]e(?: version| v)?(?: [123](?: 0)?)?"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", "creative commons zero", "creative commons zero(?: v1 0| 1 0)?(?: universal)?"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [05])?"),
    ("cc-by", "creative commons attribution", "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-sa", "creative commons attribution", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nd", "creative commons attribution", "creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc", "creative commons attribution", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc-sa", "creative commons attribution", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
    ("cc-by-nc-nd", "creative commons attribution", "creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?(?: international| unported| generic)?(?: license)?"),
)

#: How a name is granted: words before it, priority and confidence.
GRANTS = (
    ("licensed under(?: the)?(?: terms of(?: the)?)?", 30, 0.95),
    ("released under(?: the)?(?: terms of(?: the)?)?", 30, 0.95),
    ("distributed under(?: the)?(?: terms of(?: the)?)?", 30, 0.95),
    ("available under(?: the)?(?: terms of(?: the)?)?", 30, 0.9),
    ("terms of the", 25, 0.85),
    ("license", 20, 0.7),
)

#: Label and the words of its identifier, in headers and in addresses.
IDENTIFIERS = (
    ("mit", "mit"), ("mit-0", "mit 0"), ("x11", "x11"), ("apache-2", "apache 2 0"), ("apache-1.1", "apache 1 1"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"), ("bsd-0-clause", "0bsd"),
    ("gpl-2", "gpl 2 0(?: only)?"), ("gpl-2-or-later", "gpl 2 0 or later"), ("gpl-3", "gpl 3 0(?: only)?"), ("gpl-3-or-later", "gpl 3 0 or later"), ("lgpl-2.1", "lgpl 2 1(?: only| or later)?"), ("lgpl-3", "lgpl 3 0(?: only| or later)?"),
    ("agpl-3", "agpl 3 0(?: only| or later)?"), ("mpl-2.0", "mpl 2 0"), ("mpl-1.1", "mpl 1 1"), ("epl-1.0", "epl 1 0"), ("epl-2.0", "epl 2 0"), ("cddl-1.0", "cddl 1 0"), ("isc", "isc"), ("zlib", "zlib"), ("bsl-1.0", "bsl 1 0"),
    ("artistic-2.0", "artistic 2 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0-1.0", "cc0 1 0"), ("cc-by", "cc by [1-4] 0"), ("cc-by-sa", "cc by sa [1-4] 0"), ("cc-by-nd", "cc by nd [1-4] 0"),
    ("cc-by-nc", "cc by nc [1-4] 0"), ("cc-by-nc-sa", "cc by nc sa [1-4] 0"), ("cc-by-nc-nd", "cc by nc nd [1-4] 0"), ("ofl-1.1", "ofl 1 1"), ("upl-1.0", "upl 1 0"), ("postgresql", "postgresql"), ("ncsa", "ncsa"), ("odbl", "odbl 1 0"),
)

#: Label, keyword, sentence: passages of license texts and headers, and addresses, with priority 40.
PASSAGES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd-3-clause", "endorse or promote products", "neither the name of [a-z0-9 ]{1,80} endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", "you may not use this file except", "you may not use this file except in compliance with the license"),
    ("apache-2", "apache org licenses", "apache org licenses license 2 0"),
    ("gpl", "you can redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "you can redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3", "you can redistribute it and or modify", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl-2", "gnu org licenses", "gnu org licenses(?: old licenses)? gpl 2 0"),
    ("gpl-3", "gnu org licenses", "gnu org licenses gpl 3 0"),
    ("gpl", "gnu org licenses", "gnu org licenses gpl"),
    ("lgpl", "gnu org licenses", "gnu org licenses lgpl(?: [23] [01])?"),
    ("agpl-3", "gnu org licenses", "gnu org licenses agpl(?: 3 0)?"),
    ("mpl-2.0", "source code form is subject to", "source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "mozilla org mpl", "mozilla org mpl 2 0"),
    ("zlib", "in no event will the authors be held", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1.0", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "free and unencumbered software", "free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "released into the public domain"),
    ("public-domain", "public domain", "dedicated to the public domain"),
    ("public-domain", "public domain", "placed in the public domain"),
    ("public-domain", "public domain", "in the public domain"),
    ("cc0-1.0", "creativecommons org", "creativecommons org publicdomain zero 1 0"),
    ("cc-by", "creativecommons org licenses", "creativecommons org licenses by(?: [1-4] [05])?"),
    ("cc-by-sa", "creativecommons org licenses", "creativecommons org licenses by sa(?: [1-4] [05])?"),
    ("cc-by-nd", "creativecommons org licenses", "creativecommons org licenses by nd(?: [1-4] [05])?"),
    ("cc-by-nc", "creativecommons org licenses", "creativecommons org licenses by nc(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creativecommons org licenses", "creativecommons org licenses by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creativecommons org licenses", "creativecommons org licenses by nc nd(?: [1-4] [05])?"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("all-rights-reserved", "tous droits", "tous droits réservés"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("non-commercial", "for non commercial use only", "for non commercial use only"),
    ("non-commercial", "for noncommercial use only", "for noncommercial use only"),
    ("research-only", "for research purposes only", "for research purposes only"),
    ("redistribution-prohibited", "redistribution is prohibited", "redistribution is prohibited"),
)


def rules() -> list[Rule]:
    """All rules; a rule's place in the list is its number, and decides between equal ones."""
    out = [Rule(label, phrase, phrase, 10, 0.8, True) for label, phrase in BASE]
    for label, keyword, name in NAMES:
        out.append(Rule(label, keyword, name, 10, 0.6))
        out += [Rule(label, keyword, f"{words} {name}", priority, confidence) for words, priority, confidence in GRANTS]
    for label, name in IDENTIFIERS:
        out.append(Rule(label, "spdx license identifier", f"spdx license identifier {name}", 50, 1.0))
        out.append(Rule(label, "opensource org licenses", f"opensource org licenses {name}", 40, 0.9))
    return out + [Rule(label, keyword, passage, 40, 0.9) for label, keyword, passage in PASSAGES]
