"""The signature rules of the license scan: wordings of licenses, their titles, tags and usual references.

A rule is a regex over lower-cased words joined by single blanks. It begins with a plain word, its keyword, and is tried only
where that word stands. Lower priority numbers are stronger; within a priority, earlier rules are.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Regex class bodies of what stands between words in a text, and of words; case is ignored where they are used.
BETWEEN = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
WORD = "[0-9A-Za-z\u0080-\U0010ffff]"
_OPENING = re.compile(r"([a-z0-9]+)(?: ([a-z0-9]+))?(?=$| (?!\?)|\( )")


class Rule(NamedTuple):
    regex: str
    label: str
    priority: int
    weight: float
    #: The most words that the regex can match. 0: as many as it is written with, which holds where no group repeats.
    longest: int = 0

    @property
    def opening(self) -> tuple[str, str | None]:
        """The keyword, and the plain word after it where there must be one."""
        found = _OPENING.match(self.regex)
        if not found:
            raise ValueError(f"a rule begins with a plain word: {self.regex}")
        return found[1], found[2]

    @property
    def words(self) -> int:
        plain = self.regex.replace("[^ ]+", "x")
        if not self.longest and re.search(r"\)[*+{]| [*+{]|\\s|\\W|\.[*+{]|\[\^|\[[^]]* ", plain):
            raise ValueError(f"say how many words this can match: {self.regex}")
        return self.longest or plain.count(" ") + 1


# The contract's phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: By priority: lines of label, weight and regex.
SIGNATURES = {
    1: r"""
        gpl-1.0 | 1.0 | gnu (general public licen[cs]e|gpl)( as published by the free software foundation)?( either)? (version |v )?1( 0)?
        gpl-2.0 | 1.0 | gnu (general public licen[cs]e|gpl)( as published by the free software foundation)?( either)? (version |v |v)?2( 0)?
        gpl-3.0 | 1.0 | gnu (general public licen[cs]e|gpl)( as published by the free software foundation)?( either)? (version |v |v)?3( 0)?
        gpl-2.0 | 1.0 | gnu general public licen[cs]e version 2 june 1991
        gpl-3.0 | 1.0 | gnu general public licen[cs]e version 3 29 june 2007
        gpl-2.0 | 0.9 | gpl( licen[cs]e)? (version |v |v)?2( 0)?
        gpl-3.0 | 0.9 | gpl( licen[cs]e)? (version |v |v)?3( 0)?
        gpl-2.0 | 0.9 | gplv2
        gpl-3.0 | 0.9 | gplv3
        lgpl-2.0 | 1.0 | gnu (library general public licen[cs]e|lgpl)( as published by the free software foundation)?( either)? (version |v |v)?2( 0)?
        lgpl-2.1 | 1.0 | gnu (lesser general public licen[cs]e|lgpl)( as published by the free software foundation)?( either)? (version |v |v)?2 1
        lgpl-3.0 | 1.0 | gnu (lesser general public licen[cs]e|lgpl)( as published by the free software foundation)?( either)? (version |v |v)?3( 0)?
        lgpl-2.1 | 0.9 | lgpl( licen[cs]e)? (version |v |v)?2 1
        lgpl-3.0 | 0.9 | lgpl( licen[cs]e)? (version |v |v)?3( 0)?
        lgpl-3.0 | 0.9 | lgplv3
        agpl-3.0 | 1.0 | gnu (affero general public licen[cs]e|agpl)( as published by the free software foundation)?( either)? (version |v |v)?3( 0)?
        agpl-3.0 | 0.9 | agpl( licen[cs]e)? (version |v |v)?3( 0)?
        agpl-1.0 | 1.0 | affero general public licen[cs]e version 1
        gfdl-1.1 | 1.0 | gnu free documentation licen[cs]e version 1 1
        gfdl-1.2 | 1.0 | gnu free documentation licen[cs]e version 1 2
        gfdl-1.3 | 1.0 | gnu free documentation licen[cs]e version 1 3
        apache-1.0 | 1.0 | apache( software)? licen[cs]e (version |v |v)?1 0
        apache-1.1 | 1.0 | apache( software)? licen[cs]e (version |v |v)?1 1
        apache-2.0 | 1.0 | apache( software)? licen[cs]e (version |v |v)?2( 0)?
        apache-2.0 | 0.9 | apache 2 0( licen[cs]e)?
        apache-2.0 | 1.0 | apache licen[cs]e version 2 0 january 2004
        apache-2.0 | 0.9 | asl 2 0
        mpl-1.0 | 1.0 | mozilla public licen[cs]e (version |v |v)?1 0
        mpl-1.1 | 1.0 | mozilla public licen[cs]e (version |v |v)?1 1
        mpl-2.0 | 1.0 | mozilla public licen[cs]e (version |v |v)?2 0
        mpl-1.1 | 0.9 | mpl (version |v |v)?1 1
        mpl-2.0 | 0.9 | mpl (version |v |v)?2 0
        epl-1.0 | 1.0 | eclipse public licen[cs]e (version |v |v)?1 0
        epl-2.0 | 1.0 | eclipse public licen[cs]e (version |v |v)?2 0
        edl-1.0 | 1.0 | eclipse distribution licen[cs]e (version |v |v)?1 0
        cddl-1.0 | 1.0 | common development and distribution licen[cs]e( cddl)? (version |v |v)?1 0
        cddl-1.1 | 1.0 | common development and distribution licen[cs]e( cddl)? (version |v |v)?1 1
        cpl-1.0 | 1.0 | common public licen[cs]e (version |v |v)?1 0
        eupl-1.1 | 1.0 | european union public licen[cs]e( eupl)? (version |v |v)?1 1
        eupl-1.2 | 1.0 | european union public licen[cs]e( eupl)? (version |v |v)?1 2
        artistic-1.0 | 1.0 | artistic licen[cs]e (version |v |v)?1 0
        artistic-2.0 | 1.0 | artistic licen[cs]e (version |v |v)?2 0
        bsl-1.0 | 1.0 | boost software licen[cs]e (version |v |v)?1 0
        busl-1.1 | 1.0 | business source licen[cs]e (version |v |v)?1 1
        sspl-1.0 | 1.0 | server side public licen[cs]e( sspl)? (version |v |v)?1( 0)?
        elastic-2.0 | 1.0 | elastic licen[cs]e (version |v |v)?2( 0)?
        psf-2.0 | 1.0 | psf licen[cs]e agreement( for python)?( version)? 2( 0)?
        psf-2.0 | 1.0 | python software foundation licen[cs]e version 2
        php-3.0 | 1.0 | php licen[cs]e (version |v |v)?3 0
        php-3.01 | 1.0 | php licen[cs]e (version |v |v)?3 01
        odbl-1.0 | 1.0 | open database licen[cs]e( odbl)? (version |v |v)?1 0
        odc-by-1.0 | 1.0 | open data commons attribution licen[cs]e (version |v |v)?1 0
        pddl-1.0 | 1.0 | open data commons public domain dedication and licen[cs]e( pddl)?( version| v)? 1 0
        ofl-1.0 | 1.0 | sil open font licen[cs]e (version |v |v)?1 0
        ofl-1.1 | 1.0 | sil open font licen[cs]e (version |v |v)?1 1
        osl-3.0 | 1.0 | open software licen[cs]e (version |v |v)?3 0
        afl-3.0 | 1.0 | academic free licen[cs]e (version |v |v)?3 0
        afl-2.1 | 1.0 | academic free licen[cs]e (version |v |v)?2 1
        qpl-1.0 | 1.0 | q public licen[cs]e (version |v |v)?1 0
        lppl-1.3 | 1.0 | latex project public licen[cs]e( lppl)?( either)? (version |v )?1 3
        wtfpl-2 | 1.0 | do what the fuck you want to public licen[cs]e( version 2)?
        upl-1.0 | 1.0 | universal permissive licen[cs]e( upl)? (version |v |v)?1 0
        cecill-2.1 | 1.0 | cecill( free software licen[cs]e agreement)? (version |v |v)?2 1
        zpl-2.1 | 1.0 | zope public licen[cs]e( zpl)? (version |v |v)?2 1
        mulan-2.0 | 1.0 | mulan psl v2
        w3c-2015 | 1.0 | w3c software (and document )?notice and licen[cs]e
        openrail-1.0 | 1.0 | bigscience rail licen[cs]e (version |v |v)?1 0
        cc-by-1.0 | 1.0 | cc by 1 0
        cc-by-2.0 | 1.0 | cc by 2 0
        cc-by-2.5 | 1.0 | cc by 2 5
        cc-by-3.0 | 1.0 | cc by 3 0
        cc-by-4.0 | 1.0 | cc by 4 0
        cc-by-sa-2.0 | 1.0 | cc by sa 2 0
        cc-by-sa-3.0 | 1.0 | cc by sa 3 0
        cc-by-sa-4.0 | 1.0 | cc by sa 4 0
        cc-by-nc-2.0 | 1.0 | cc by nc 2 0
        cc-by-nc-3.0 | 1.0 | cc by nc 3 0
        cc-by-nc-4.0 | 1.0 | cc by nc 4 0
        cc-by-nd-3.0 | 1.0 | cc by nd 3 0
        cc-by-nd-4.0 | 1.0 | cc by nd 4 0
        cc-by-nc-sa-3.0 | 1.0 | cc by nc sa 3 0
        cc-by-nc-sa-4.0 | 1.0 | cc by nc sa 4 0
        cc-by-nc-nd-3.0 | 1.0 | cc by nc nd 3 0
        cc-by-nc-nd-4.0 | 1.0 | cc by nc nd 4 0
        cc-by-3.0 | 1.0 | creative commons attribution 3 0( unported)?( licen[cs]e)?
        cc-by-4.0 | 1.0 | creative commons attribution 4 0( international)?( public)?( licen[cs]e)?
        cc-by-sa-3.0 | 1.0 | creative commons attribution share ?alike 3 0( unported)?( licen[cs]e)?
        cc-by-sa-4.0 | 1.0 | creative commons attribution share ?alike 4 0( international)?( public)?( licen[cs]e)?
        cc-by-nc-3.0 | 1.0 | creative commons attribution non ?commercial 3 0( unported)?( licen[cs]e)?
        cc-by-nc-4.0 | 1.0 | creative commons attribution non ?commercial 4 0( international)?( public)?( licen[cs]e)?
        cc-by-nd-4.0 | 1.0 | creative commons attribution no ?deriv(ative)?s 4 0( international)?( public)?( licen[cs]e)?
        cc-by-nc-sa-4.0 | 1.0 | creative commons attribution non ?commercial share ?alike 4 0( international)?( public)?( licen[cs]e)?
        cc-by-nc-nd-4.0 | 1.0 | creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( public)?( licen[cs]e)?
        cc0-1.0 | 1.0 | cc0 1 0( universal)?
        cc0-1.0 | 1.0 | creative commons zero( v)? ?1 0( universal)?
        cc-by-4.0 | 1.0 | creativecommons org licenses by 4 0
        cc-by-sa-4.0 | 1.0 | creativecommons org licenses by sa 4 0
        cc-by-nc-4.0 | 1.0 | creativecommons org licenses by nc 4 0
        cc-by-nc-sa-4.0 | 1.0 | creativecommons org licenses by nc sa 4 0
        cc-by-nc-nd-4.0 | 1.0 | creativecommons org licenses by nc nd 4 0
        cc-by-sa-3.0 | 1.0 | creativecommons org licenses by sa 3 0
        cc-by-3.0 | 1.0 | creativecommons org licenses by 3 0
        cc0-1.0 | 1.0 | creativecommons org publicdomain zero 1 0
        gpl-2.0 | 1.0 | spdx license identifier gpl 2 0( only| or later)?
        gpl-3.0 | 1.0 | spdx license identifier gpl 3 0( only| or later)?
        lgpl-2.1 | 1.0 | spdx license identifier lgpl 2 1( only| or later)?
        lgpl-3.0 | 1.0 | spdx license identifier lgpl 3 0( only| or later)?
        agpl-3.0 | 1.0 | spdx license identifier agpl 3 0( only| or later)?
        apache-2.0 | 1.0 | spdx license identifier apache 2 0
        mit | 1.0 | spdx license identifier mit
        bsd-2-clause | 1.0 | spdx license identifier bsd 2 clause
        bsd-3-clause | 1.0 | spdx license identifier bsd 3 clause
        isc | 1.0 | spdx license identifier isc
        mpl-2.0 | 1.0 | spdx license identifier mpl 2 0
        epl-2.0 | 1.0 | spdx license identifier epl 2 0
        unlicense | 1.0 | spdx license identifier unlicense
        cc0-1.0 | 1.0 | spdx license identifier cc0 1 0
        cc-by-4.0 | 1.0 | spdx license identifier cc by 4 0
        bsl-1.0 | 1.0 | spdx license identifier bsl 1 0
        0bsd | 1.0 | spdx license identifier 0bsd
    """,
    2: r"""
        mit | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        mit | 0.9 | permission is hereby granted free of charge
        mit | 0.9 | subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
        mit | 0.9 | above copyright notice and this permission notice shall be included in all copies
        mit | 0.9 | deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense
        mit | 0.8 | software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        mit | 0.8 | holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        x11 | 0.9 | name of the x consortium shall not be used in advertising
        x11 | 0.9 | except as contained in this notice the name of the x consortium
        isc | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        isc | 0.9 | permission to use copy modify and or distribute this software
        isc | 0.9 | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
        0bsd | 0.9 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
        hpnd | 0.9 | permission to use copy modify and distribute this software and its documentation for any purpose
        hpnd | 0.8 | permission to use copy modify distribute and sell this software and its documentation for any purpose
        isc | 0.8 | author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
        bsd | 1.0 | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        bsd | 0.9 | redistribution and use in source and binary forms
        bsd | 0.9 | redistributions of source code must retain the above copyright notice
        bsd | 0.9 | redistributions in binary form must reproduce the above copyright notice
        bsd-3-clause | 1.0 | neither the name of( the)? [^ ]+( [^ ]+)?( [^ ]+)?( [^ ]+)?( [^ ]+)? nor the names of its contributors may be used to endorse or promote products
        bsd-3-clause | 0.9 | names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
        bsd-4-clause | 1.0 | all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment
        bsd | 0.8 | software is provided by the copyright holders and contributors as is and any express or implied warranties
        bsd | 0.8 | software is provided by the regents and contributors as is
        bsd | 0.8 | in no event shall the copyright (holder|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages
        bsd-2-clause | 0.8 | views and conclusions contained in the software and documentation are those of the authors
        gpl | 1.0 | free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
        lgpl | 1.0 | free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[cs]e
        agpl | 1.0 | free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
        gpl | 0.8 | you should have received a copy of the gnu general public licen[cs]e along with this program
        lgpl | 0.8 | you should have received a copy of the gnu (lesser|library) general public licen[cs]e along with this (library|program)
        agpl | 0.8 | you should have received a copy of the gnu affero general public licen[cs]e along with this program
        gpl | 0.8 | see the gnu general public licen[cs]e for more details
        lgpl | 0.8 | see the gnu (lesser|library) general public licen[cs]e for more details
        agpl | 0.8 | see the gnu affero general public licen[cs]e for more details
        gpl | 0.7 | licenses for most software( and other practical works)? are designed to take away your freedom to share and change
        gpl | 0.7 | everyone is permitted to copy and distribute verbatim copies of this license document
        gpl | 0.8 | gpl compatible licen[cs]e
        gpl-exception | 0.8 | as a special exception( the copyright holders of this library| the free software foundation)? gives? (you )?(unlimited )?permission to link
        gpl-exception | 0.8 | classpath exception
        lgpl | 0.8 | work that uses the library
        gfdl | 0.9 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
        gfdl | 0.7 | with no invariant sections no front cover texts and no back cover texts
        apache-2.0 | 1.0 | licensed under the apache licen[cs]e version 2 0 the license you may not use this file except in compliance with the license
        apache | 0.9 | licensed to the apache software foundation asf under one or more contributor license agreements
        apache-2.0 | 0.9 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        apache-2.0 | 0.8 | without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations
        apache-2.0 | 0.9 | apache org licenses license 2 0
        apache-1.1 | 0.9 | this product includes software developed by the apache software foundation
        mpl-2.0 | 1.0 | this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0
        mpl-1.1 | 1.0 | contents of this file are subject to the mozilla public licen[cs]e version 1 1
        mpl | 0.8 | if a copy of the mpl was not distributed with this file you can obtain one
        epl-2.0 | 0.9 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e (v )?2 0
        epl-1.0 | 0.9 | this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v1 0
        cddl | 0.9 | contents of this file are subject to the terms of( either)?( the)?( gnu general public licen[cs]e version 2 only)? ?(or )?the common development and distribution licen[cs]e
        cddl | 0.8 | when distributing covered code include this cddl header notice in each file
        unlicense | 1.0 | this is free and unencumbered software released into the public domain
        unlicense | 0.9 | free and unencumbered software
        unlicense | 0.9 | anyone is free to copy modify publish use compile sell or distribute this software
        cc0 | 0.9 | to the extent possible under law( the author s have| the person who associated cc0 with this work has)? (dedicated|waived) all copyright and related
        public-domain | 0.8 | dedicated to the public domain
        public-domain | 0.8 | released into the public domain
        public-domain | 0.8 | placed in the public domain
        public-domain | 0.8 | this work is in the public domain
        public-domain | 0.7 | no known copyright restrictions
        public-domain | 0.7 | author disclaims copyright to this source code
        zlib | 1.0 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        zlib | 0.9 | origin of this software must not be misrepresented you must not claim that you wrote the original software
        zlib | 0.8 | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        bsl-1.0 | 0.9 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
        bsl-1.0 | 0.9 | boost org license 1 0 txt
        ncsa | 0.9 | university of illinois ncsa open source licen[cs]e
        ncsa | 0.8 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
        ms-pl | 1.0 | microsoft public licen[cs]e( ms pl)?
        ms-rl | 1.0 | microsoft reciprocal licen[cs]e( ms rl)?
        wtfpl | 0.9 | you just do what the fuck you want to
        beerware | 0.9 | beer ware licen[cs]e
        beerware | 0.9 | beerware( licen[cs]e)?
        beerware | 0.9 | you can buy me a beer in return
        json | 0.9 | software shall be used for good not evil
        openssl | 0.9 | this product includes software developed by the openssl project
        openssl | 0.9 | this product includes cryptographic software written by eric young
        ofl | 0.9 | this font software is licensed under the sil open font licen[cs]e
        ofl | 0.8 | font software may be sold as part of a larger software package
        odbl | 0.9 | this database is made available under the open database licen[cs]e
        ogl-uk | 0.9 | open government licen[cs]e( v3 0| version 3 0)?
        ogl-uk | 0.8 | contains public sector information licensed under the open government licen[cs]e
        openrail | 0.8 | use based restrictions as referenced in paragraph 5
        llama | 0.9 | llama (2|3|3 1|3 2|3 3|4) community licen[cs]e( agreement)?
        llama | 0.8 | meta hereby grants you a non exclusive worldwide non transferable and royalty free limited licen[cs]e
        gemma | 0.9 | gemma terms of use
        sspl | 0.9 | if you make the functionality of the program or a modified version available to third parties as a service
        busl | 0.9 | licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
        elastic | 0.9 | you may not provide the software to third parties as a hosted or managed service
        commons-clause | 0.9 | commons clause licen[cs]e condition
        commons-clause | 0.8 | without limiting other conditions in the license the grant of rights under the license will not include
        polyform | 0.9 | polyform (noncommercial|shield|strict|perimeter|small business|free trial|internal use) licen[cs]e
        proprietary | 0.9 | proprietary and confidential
        proprietary | 0.9 | unauthorized copying of this file via any medium is strictly prohibited
        proprietary | 0.8 | unauthorized (copying|reproduction|distribution|use)( or distribution)? (of this [^ ]+ )?is (strictly )?prohibited
        proprietary | 0.8 | no part of this (publication|book|work|document) may be reproduced
        proprietary | 0.7 | may not be reproduced( or)?( distributed)?( or)?( transmitted)?( in any form)? without( the)?( prior)?( written)? (permission|consent)
        proprietary | 0.7 | for internal use only
        proprietary | 0.7 | trade secrets? of [^ ]+
        noncommercial | 0.8 | for non ?commercial( research| educational)?( and educational)? (use|purposes) only
        noncommercial | 0.8 | may not (be used|use this|use the material) for commercial purposes
        noncommercial | 0.7 | personal and non ?commercial use( only)?
        research-only | 0.8 | for research (use|purposes) only
        research-only | 0.7 | academic (research )?(use|purposes) only
        eula | 0.8 | end user licen[cs]e agreement
        eula | 0.7 | by installing( copying)?( or)?( otherwise)?( using)? (the|this) (software|product)( product)? you agree to be bound by
        cc-by | 0.8 | you are free to share copy and redistribute the material in any medium or format
        cc-by | 0.8 | you must give appropriate credit provide a link to the license and indicate if changes were made
        cc-by-sa | 0.8 | if you remix transform or build upon the material you must distribute your contributions under the same license
        cc-by-nd | 0.8 | if you remix transform or build upon the material you may not distribute the modified material
        cc-by-nc | 0.8 | you may not use the material for commercial purposes
        cc-by-sa | 0.8 | text is available under the creative commons attribution share ?alike licen[cs]e
    """,
    3: r"""
        lgpl | 0.8 | gnu (lesser|library) general public licen[cs]e
        agpl | 0.8 | gnu affero general public licen[cs]e
        lgpl | 0.8 | lesser general public licen[cs]e
        agpl | 0.8 | affero general public licen[cs]e
        gpl | 0.7 | general public licen[cs]e
        gpl | 0.8 | gnu gpl
        lgpl | 0.8 | gnu lgpl
        agpl | 0.8 | gnu agpl
        gpl | 0.7 | gpl licen[cs]ed?
        lgpl | 0.7 | lgpl licen[cs]ed?
        agpl | 0.7 | agpl licen[cs]ed?
        gfdl | 0.8 | gnu free documentation licen[cs]e
        gfdl | 0.8 | gnu fdl
        apache | 0.8 | apache software licen[cs]e
        apache | 0.8 | apache licensed
        mit | 0.8 | mit x11 licen[cs]e
        mit | 0.8 | mit licen[cs]ed
        mit | 0.8 | expat licen[cs]e
        bsd | 0.8 | bsd( style)? licen[cs]ed?
        bsd | 0.8 | berkeley software distribution licen[cs]e
        bsd-2-clause | 0.9 | bsd 2 clause( licen[cs]e)?
        bsd-3-clause | 0.9 | bsd 3 clause( licen[cs]e)?
        bsd-2-clause | 0.9 | 2 clause bsd( licen[cs]e)?
        bsd-3-clause | 0.9 | 3 clause bsd( licen[cs]e)?
        bsd-4-clause | 0.9 | 4 clause bsd( licen[cs]e)?
        bsd-2-clause | 0.9 | simplified bsd( licen[cs]e)?
        bsd-3-clause | 0.9 | new bsd licen[cs]e
        bsd-3-clause | 0.9 | modified bsd( licen[cs]e)?
        bsd-3-clause | 0.9 | revised bsd( licen[cs]e)?
        bsd-4-clause | 0.9 | original bsd( licen[cs]e)?
        mpl | 0.8 | mozilla public licen[cs]e
        epl | 0.8 | eclipse public licen[cs]e
        edl | 0.8 | eclipse distribution licen[cs]e
        cddl | 0.8 | common development and distribution licen[cs]e
        cpl | 0.8 | common public licen[cs]e
        ipl | 0.8 | ibm public licen[cs]e
        eupl | 0.8 | european union public licen[cs]e
        artistic | 0.8 | artistic licen[cs]e
        isc | 0.8 | isc licen[cs]e
        zlib | 0.8 | zlib( libpng)? licen[cs]e
        libpng | 0.8 | libpng licen[cs]e
        bsl | 0.8 | boost software licen[cs]e
        busl | 0.8 | business source licen[cs]e
        sspl | 0.8 | server side public licen[cs]e
        elastic | 0.8 | elastic licen[cs]e
        psf | 0.8 | python software foundation licen[cs]e
        php | 0.8 | php licen[cs]e
        ruby | 0.8 | ruby licen[cs]e
        openssl | 0.8 | openssl licen[cs]e
        unlicense | 0.8 | the unlicense
        wtfpl | 0.8 | wtfpl
        odbl | 0.8 | open database licen[cs]e
        odc-by | 0.8 | open data commons attribution licen[cs]e
        pddl | 0.8 | public domain dedication and licen[cs]e
        ofl | 0.8 | sil open font licen[cs]e
        ofl | 0.8 | open font licen[cs]e
        osl | 0.8 | open software licen[cs]e
        afl | 0.8 | academic free licen[cs]e
        qpl | 0.8 | q public licen[cs]e
        upl | 0.8 | universal permissive licen[cs]e
        lppl | 0.8 | latex project public licen[cs]e
        zpl | 0.8 | zope public licen[cs]e
        vim | 0.8 | vim licen[cs]e
        cecill | 0.8 | cecill licen[cs]e
        mulan | 0.8 | mulan permissive software licen[cs]e
        openrail | 0.8 | openrail( m)?( licen[cs]e)?
        cc0 | 0.8 | cc0
        cc0 | 0.8 | creative commons zero
        cc-by-sa | 0.8 | cc by sa
        cc-by-nc | 0.8 | cc by nc
        cc-by-nd | 0.8 | cc by nd
        cc-by-nc-sa | 0.8 | cc by nc sa
        cc-by-nc-nd | 0.8 | cc by nc nd
        cc-by | 0.8 | creative commons attribution( licen[cs]e)?
        cc-by-sa | 0.8 | creative commons attribution share ?alike( licen[cs]e)?
        cc-by-nc | 0.8 | creative commons attribution non ?commercial( licen[cs]e)?
        cc-by-nd | 0.8 | creative commons attribution no ?deriv(ative)?s( licen[cs]e)?
        cc-by-nc-sa | 0.8 | creative commons attribution non ?commercial share ?alike( licen[cs]e)?
        cc-by-nc-nd | 0.8 | creative commons attribution non ?commercial no ?deriv(ative)?s( licen[cs]e)?
        creative-commons | 0.6 | creative commons licen[cs]e
        public-domain | 0.6 | public domain
        all-rights-reserved | 0.6 | all rights reserved
    """,
    4: r"""
        gpl | 0.7 | licensed under( the)?( terms of)?( the)?( gnu)? gpl
        lgpl | 0.7 | licensed under( the)?( terms of)?( the)?( gnu)? lgpl
        agpl | 0.7 | licensed under( the)?( terms of)?( the)?( gnu)? agpl
        mit | 0.7 | licensed under( the)?( terms of)?( the)? mit
        apache | 0.7 | licensed under( the)?( terms of)?( the)? apache
        bsd | 0.7 | licensed under( the)?( terms of)?( the| a)? bsd
        isc | 0.7 | licensed under( the)?( terms of)?( the)? isc
        mpl | 0.7 | licensed under( the)?( terms of)?( the)? (mpl|mozilla)
        epl | 0.7 | licensed under( the)?( terms of)?( the)? epl
        creative-commons | 0.6 | licensed under( the)?( terms of)?( the| a)? creative commons
        mit | 0.7 | released under( the)?( terms of)?( the)? mit
        apache | 0.7 | released under( the)?( terms of)?( the)? apache
        gpl | 0.7 | released under( the)?( terms of)?( the)?( gnu)? gpl
        bsd | 0.7 | released under( the)?( terms of)?( the| a)? bsd
        mit | 0.7 | distributed under( the)?( terms of)?( the)? mit
        apache | 0.7 | distributed under( the)?( terms of)?( the)? apache
        gpl | 0.7 | distributed under( the)?( terms of)?( the)?( gnu)? gpl
        bsd | 0.7 | distributed under( the)?( terms of)?( the| a)? bsd
        dual-license | 0.6 | dual licensed( under)?
        other-license | 0.4 | used (under|with|by) (license|permission)
        other-license | 0.4 | see( the)?( file)? licen[cs]e( txt| md)? for( more)?( licensing)?( details| information)
        other-license | 0.4 | subject to the licen[cs]e terms
        other-license | 0.4 | this file is part of
        copyright-notice | 0.4 | copyright( c)? (19|20)[0-9][0-9]
    """,
    5: r"""
        other-license | 0.3 | licensed (under|by|to)( the| a| an)? [^ ]+
        other-license | 0.3 | license agreement
        other-license | 0.3 | licence agreement
    """,
}


def rules() -> list[Rule]:
    """All rules, the contract's phrases first."""
    out = [Rule(phrase, label, 1, 0.8) for phrase, label in BASE.items()]
    for priority, lines in SIGNATURES.items():
        for line in filter(None, map(str.strip, lines.splitlines())):
            label, weight, regex = line.split(" | ", 2)
            out.append(Rule(regex, label, priority, float(weight)))
    return out


def gate(table: list[Rule]) -> str:
    """Regex of the keyword prefilter of a table: the openings of its rules, tried once a first letter."""
    needs: dict[str, set[str | None]] = {}
    for key, then in (r.opening for r in table):
        needs.setdefault(key, set()).add(then)
    letters: dict[str, list[str]] = {}
    for key, thens in sorted(needs.items()):
        more = "" if None in thens else f"[{BETWEEN}]+(?:{'|'.join(sorted(thens))})"  # type: ignore[type-var]
        letters.setdefault(key[0], []).append(key[1:] + more)
    return f"(?i)(?<!{WORD})(?:" + "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in letters.items()) + f")(?!{WORD})"
