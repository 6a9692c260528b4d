"""Signatures of licences, by hand: each line is a label, the keywords of which one must occur, and a regex.

The regexes run over lower-case words with single spaces between them. A family is a way of stating a licence, with its
priority (1 is the strongest) and score. Every keyword holds one of STEMS, by which whole texts are let in or not.
"""

from __future__ import annotations

STEMS = ("licen", "copyright", "permission", "redistribut", "spdx", "commons", "public domain", "gpl", "gnu", "apache", "mozilla", "cc by", "cc0", "rights reserved", "warranty", "eclipse", "unlicense")

#: Priority and score of each family.
FAMILIES = {"identifier": (1, 1.0), "text": (2, 0.98), "notice": (3, 0.95), "link": (4, 0.9), "name": (5, 0.8), "hint": (6, 0.3)}

IDENTIFIER = """
mit | spdx | spdx licen[cs]e identifier mit(?! 0)
mit-0 | spdx | spdx licen[cs]e identifier mit 0
apache-1-1 | spdx | spdx licen[cs]e identifier apache 1 1
apache-2 | spdx | spdx licen[cs]e identifier apache 2 0
gpl-1 | spdx | spdx licen[cs]e identifier gpl 1 0(?: only| or later)?
gpl-2 | spdx | spdx licen[cs]e identifier gpl 2 0(?: only| or later)?
gpl-3 | spdx | spdx licen[cs]e identifier gpl 3 0(?: only| or later)?
lgpl-2 | spdx | spdx licen[cs]e identifier lgpl 2 0(?: only| or later)?
lgpl-2-1 | spdx | spdx licen[cs]e identifier lgpl 2 1(?: only| or later)?
lgpl-3 | spdx | spdx licen[cs]e identifier lgpl 3 0(?: only| or later)?
agpl-3 | spdx | spdx licen[cs]e identifier agpl 3 0(?: only| or later)?
fdl-1-2 | spdx | spdx licen[cs]e identifier gfdl 1 2(?: only| or later)?
fdl-1-3 | spdx | spdx licen[cs]e identifier gfdl 1 3(?: only| or later)?
bsd-1 | spdx | spdx licen[cs]e identifier bsd 1 clause
bsd-2 | spdx | spdx licen[cs]e identifier bsd 2 clause
bsd-3 | spdx | spdx licen[cs]e identifier bsd 3 clause
bsd-4 | spdx | spdx licen[cs]e identifier bsd 4 clause
0bsd | spdx | spdx licen[cs]e identifier 0bsd
isc | spdx | spdx licen[cs]e identifier isc
mpl-1-1 | spdx | spdx licen[cs]e identifier mpl 1 1
mpl-2 | spdx | spdx licen[cs]e identifier mpl 2 0
epl-1 | spdx | spdx licen[cs]e identifier epl 1 0
epl-2 | spdx | spdx licen[cs]e identifier epl 2 0
cddl-1 | spdx | spdx licen[cs]e identifier cddl 1 [01]
eupl-1-2 | spdx | spdx licen[cs]e identifier eupl 1 2
artistic-1 | spdx | spdx licen[cs]e identifier artistic 1 0(?: perl)?
artistic-2 | spdx | spdx licen[cs]e identifier artistic 2 0
boost-1 | spdx | spdx licen[cs]e identifier bsl 1 0
busl-1-1 | spdx | spdx licen[cs]e identifier busl 1 1
zlib | spdx | spdx licen[cs]e identifier zlib
unlicense | spdx | spdx licen[cs]e identifier unlicense
wtfpl | spdx | spdx licen[cs]e identifier wtfpl
cc0 | spdx | spdx licen[cs]e identifier cc0 1 0
cc-by | spdx | spdx licen[cs]e identifier cc by [1-4] [05]
cc-by-sa | spdx | spdx licen[cs]e identifier cc by sa [1-4] [05]
cc-by-nd | spdx | spdx licen[cs]e identifier cc by nd [1-4] [05]
cc-by-nc | spdx | spdx licen[cs]e identifier cc by nc [1-4] [05]
cc-by-nc-sa | spdx | spdx licen[cs]e identifier cc by nc sa [1-4] [05]
cc-by-nc-nd | spdx | spdx licen[cs]e identifier cc by nc nd [1-4] [05]
python-2 | spdx | spdx licen[cs]e identifier (?:psf|python) 2 0
postgresql | spdx | spdx licen[cs]e identifier postgresql
ofl-1-1 | spdx | spdx licen[cs]e identifier ofl 1 1
ms-pl | spdx | spdx licen[cs]e identifier ms pl
odbl-1 | spdx | spdx licen[cs]e identifier odbl 1 0
"""
TEXT = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | copyright notice and this permission | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
x11 | copyright holders | except as contained in this notice the name of the (?:x consortium|copyright holders?) shall not be used in advertising
boost-1 | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
ofl-1-1 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of the font software
unicode | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
isc | permission to use copy modify | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
postgresql | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
hpnd | permission to use copy modify | permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted
bsd-2 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-3 | specific prior written permission | neither the names? of (?:[^ ]+ ){1,12}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 | redistribution and use;licen;copyright | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-clear | licen | no express or implied licenses to any party s patent rights are granted by this license
zlib | permission is granted | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
unlicense | public domain | this is free and unencumbered software released into the public domain
wtfpl | licen | do what the fuck you want to public license terms and conditions
wtfpl | licen;copyright;permission | you just do what the fuck you want to
beerware | licen | the beer ?ware license
apache-1-1 | apache software foundation | this product includes software developed by the apache software foundation
apache-2 | apache licen | apache license version 2 0 january 2004
apache-2 | licen | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl-2 | gnu general public | gnu general public license version 2 june 1991
gpl-3 | gnu general public | gnu general public license version 3 29 june 2007
gpl-1 | gnu general public | gnu general public license version 1 february 1989
lgpl-2 | gnu library general | gnu library general public license version 2 june 1991
lgpl-2-1 | gnu lesser general | gnu lesser general public license version 2 1 february 1999
lgpl-3 | gnu lesser general | gnu lesser general public license version 3 29 june 2007
agpl-3 | gnu affero general | gnu affero general public license version 3 19 november 2007
fdl-1-2 | gnu free documentation | gnu free documentation license version 1 2 november 2002
fdl-1-3 | gnu free documentation | gnu free documentation license version 1 3 3 november 2008
gpl | licen | the licenses for most software are designed to take away your freedom to share and change it
gpl | licen;gnu | the gnu general public license is a free copyleft license for software and other kinds of works
mpl-1-1 | mozilla public | mozilla public license version 1 1 1 definitions
mpl-2 | mozilla public | mozilla public license version 2 0 1 definitions
mpl-2 | mozilla public | if a copy of the mpl was not distributed with this file you can obtain one at
epl-1 | eclipse public | eclipse public license v 1 0 the accompanying program is provided under the terms
epl-2 | eclipse public | eclipse public license v 2 0 the accompanying program is provided under the terms
cddl-1 | licen | common development and distribution license cddl version 1 [01] 1 definitions
cpl-1 | licen | common public license v 1 0 the accompanying program is provided under the terms
eupl-1-2 | licen | european union public licence v 1 2 eupl
artistic-1 | copyright | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
artistic-2 | licen | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
python-2 | licen | this license agreement is between the python software foundation psf and the individual or organization
cc0 | commons | the person who associated a work with this deed has dedicated the work to the public domain
cc0 | licen | creative commons legal code cc0 1 0 universal
cc-by | commons | you are free to share copy and redistribute the material in any medium or format for any purpose even commercially
ms-pl | licen | this license governs use of the accompanying software if you use the software you accept this license
ncsa | licen;copyright | university of illinois ncsa open source license
odbl-1 | licen | the open database license odbl is a license agreement intended to allow users to freely share
openssl | licen;redistribut | this product includes software developed by the openssl project for use in the openssl toolkit
json | licen;permission;copyright | the software shall be used for good not evil
"""
NOTICE = """
mit | licen | (?:licensed|released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat|x11 mit)(?: open source)?(?: licen[cs]e)?
mit | licen | under the (?:terms of the )?mit licen[cs]e
apache-1-1 | apache | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?apache (?:software )?licen[cs]e (?:version |v)?1 1
apache-2 | apache | licensed under the apache licen[cs]e version 2(?: 0)? the license
apache-2 | apache | (?:licensed|released|distributed|available|published|provided|redistributed) (?:to you )?under (?:the )?(?:terms of )?(?:the )?apache (?:software )?(?:licen[cs]e )?(?:version |v)?2(?: 0)?(?: licen[cs]e)?
apache-2 | apache | licensed to the apache software foundation asf under one or more contributor license agreements
gpl | gnu general public;gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl-2 | gnu general public;gpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?2(?: 0)?(?: only| or later)?
gpl-3 | gnu general public;gpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?3(?: 0)?(?: only| or later)?
gpl-1 | gnu general public;gpl | (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e) ?(?:version |v)?1(?: 0)?
gpl-2 | gnu general public | gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2
gpl-3 | gnu general public | gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3
gpl | gnu general public | you should have received a copy of the gnu general public licen[cs]e along with this program
lgpl | gnu lesser general;gnu library general | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl-2 | gnu library general;lgpl | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|library general public licen[cs]e) ?(?:version |v)?2(?: 0)?(?! 1)
lgpl-2-1 | gnu lesser general;lgpl | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e) ?(?:version |v)?2 1
lgpl-3 | gnu lesser general;lgpl | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e) ?(?:version |v)?3(?: 0)?
agpl-3 | gnu affero;agpl | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public licen[cs]e) ?(?:version |v)?3(?: 0)?
agpl-3 | gnu affero | gnu affero general public licen[cs]e as published by the free software foundation (?:either )?version 3
fdl-1-2 | gnu free documentation | under the terms of the gnu free documentation licen[cs]e version 1 2
fdl-1-3 | gnu free documentation | under the terms of the gnu free documentation licen[cs]e version 1 3
bsd | licen | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?bsd(?: style)? licen[cs]e
bsd-2 | licen | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?
bsd-3 | licen | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?
bsd-4 | licen | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)?
bsd | licen | use of this source code is governed by a bsd style licen[cs]e that can be found in the license file
isc | licen | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?isc licen[cs]e
mpl-1-1 | mozilla public | subject to the mozilla public licen[cs]e version 1 1
mpl-2 | mozilla public | subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-2 | mozilla public | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
epl-1 | eclipse public | made available under the terms of the eclipse public licen[cs]e v1 0
epl-2 | eclipse public | made available under the terms of the eclipse public licen[cs]e (?:v )?2 0
cddl-1 | licen | subject to the terms of the common development and distribution licen[cs]e
eupl-1-2 | licen | licensed under the eupl(?: version| v)? 1 2
artistic-2 | licen | (?:licensed|released|distributed|available|provided) under (?:the )?(?:terms of )?(?:the )?artistic licen[cs]e (?:version )?2(?: 0)?
perl | licen;redistribut | (?:redistribute it and or modify it )?under the same terms as perl itself
ruby | licen;redistribut | under the same terms as ruby
boost-1 | licen | distributed under the boost software licen[cs]e version 1 0
busl-1-1 | licen | (?:licensed|released) under (?:the )?business source licen[cs]e(?: version)? 1 1
elastic-2 | licen | (?:licensed|released) under (?:the )?elastic licen[cs]e(?: version)? 2 0
sspl-1 | licen | (?:licensed|released) under (?:the )?server side public licen[cs]e
cc0 | cc0;commons | (?:licensed|released|dedicated|available|published|waived) (?:to the public domain )?under (?:a |the )?(?:creative commons )?(?:cc0|zero)(?: 1 0)?(?: universal)?
cc-by | commons;cc by | (?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?(?:creative commons attribution|cc by)(?! (?:nc|nd|sa|non|no|share))(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-sa | commons;cc by | (?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?(?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?
cc-by-nd | commons;cc by | (?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?(?:creative commons attribution no ?deriv(?:s|atives)|cc by nd)(?: [1-4] [05])?
cc-by-nc | commons;cc by | (?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?(?:creative commons attribution non ?commercial|cc by nc)(?! (?:sa|nd|share|no))(?: [1-4] [05])?
cc-by-nc-sa | commons;cc by | (?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?(?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?
cc-by-nc-nd | commons;cc by | (?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of )?(?:the )?(?:creative commons attribution non ?commercial no ?deriv(?:s|atives)|cc by nc nd)(?: [1-4] [05])?
public-domain | public domain | (?:placed|released|dedicated|is|are) (?:in|into|to) the public domain
ofl-1-1 | licen | this font software is licensed under the sil open font licen[cs]e version 1 1
psf | licen | (?:licensed|released|distributed) under (?:the )?(?:psf|python software foundation) licen[cs]e
php-3 | licen | this source file is subject to version 3 0[01]? of the php licen[cs]e
zend | licen | this source file is subject to version 2 0 of the zend licen[cs]e
commercial | licen | this software is (?:licensed|provided) under a commercial licen[cs]e
proprietary | rights reserved;licen;copyright;permission | (?:confidential and proprietary|proprietary and confidential)
"""
LINK = """
apache-2 | apache | (?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1-1 | apache | (?:www )?apache org licenses license 1 1
mit | licen | (?:www )?opensource org licenses mit(?: license)?(?: php| html)?
bsd-2 | licen | (?:www )?opensource org licenses bsd 2 clause
bsd-3 | licen | (?:www )?opensource org licenses (?:bsd 3 clause|bsd license)(?: php)?
isc | licen | (?:www )?opensource org licenses isc(?: license)?
zlib | licen | (?:www )?opensource org licenses zlib(?: license)?
artistic-2 | licen | (?:www )?opensource org licenses artistic(?: license)? 2 0
gpl-2 | gnu | (?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3 | gnu | (?:www )?gnu org licenses gpl 3 0(?: html| txt)?
gpl | gnu | (?:www )?gnu org (?:licenses|copyleft) gpl html
lgpl-2-1 | gnu | (?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3 | gnu | (?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
agpl-3 | gnu | (?:www )?gnu org licenses agpl 3 0(?: html| txt)?
fdl-1-3 | gnu | (?:www )?gnu org licenses fdl 1 3(?: html| txt)?
gpl | gnu | if not see https? (?:www )?gnu org licenses
mpl-2 | mozilla | (?:www )?mozilla org (?:en us )?mpl 2 0
mpl-1-1 | mozilla | (?:www )?mozilla org mpl(?: mpl)? 1 1
epl-1 | eclipse | (?:www )?eclipse org legal epl v10(?: html)?
epl-2 | eclipse | (?:www )?eclipse org legal epl (?:v20|2 0)(?: html)?
boost-1 | licen | (?:www )?boost org license 1 0 txt
unlicense | unlicense | (?:www )?unlicense org
cc0 | commons | creativecommons org publicdomain zero 1 0
public-domain | commons | creativecommons org publicdomain mark 1 0
cc-by | commons | creativecommons org licenses by [1-4] [05]
cc-by-sa | commons | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | commons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | commons | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | commons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | commons | creativecommons org licenses by nc nd [1-4] [05]
ofl-1-1 | licen;commons;copyright | scripts sil org ofl
odbl-1 | licen | opendatacommons org licenses odbl
pddl-1 | licen | opendatacommons org licenses pddl
php-3 | licen | (?:www )?php net license 3 0[01]? txt
"""
NAME = """
mit | licen | (?:mit|expat)(?: open source| style)? licen[cs]e
mit | licen | licen[cs]e(?: is| type)? mit
apache-2 | apache | apache (?:software )?licen[cs]e(?: version| v)? 2(?: 0)?
apache-2 | apache | apache 2(?: 0)? licen[cs]e
apache-1-1 | apache | apache (?:software )?licen[cs]e(?: version| v)? 1 1
gpl-1 | gpl;gnu general | (?:gpl|gnu general public licen[cs]e)(?: version| v)? ?1(?: 0)?
gpl-2 | gpl;gnu general | (?:gplv2|gpl 2(?: 0)?|gpl v(?:ersion )?2|gnu general public licen[cs]e(?: version| v)? ?2)
gpl-3 | gpl;gnu general | (?:gplv3|gpl 3(?: 0)?|gpl v(?:ersion )?3|gnu general public licen[cs]e(?: version| v)? ?3)
lgpl-2 | lgpl;gnu library | (?:lgplv2|lgpl 2 0|gnu library general public licen[cs]e)
lgpl-2-1 | lgpl;gnu lesser | (?:lgpl(?: v| version)? ?2 1|gnu lesser general public licen[cs]e(?: version| v)? ?2 1)
lgpl-3 | lgpl;gnu lesser | (?:lgplv3|lgpl 3(?: 0)?|gnu lesser general public licen[cs]e(?: version| v)? ?3)
agpl-3 | agpl;gnu affero | (?:agplv3|agpl 3(?: 0)?|gnu affero general public licen[cs]e(?: version| v)? ?3)
fdl-1-3 | gnu free documentation | gnu free documentation licen[cs]e
bsd-2 | licen | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[cs]e
bsd-3 | licen | (?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[cs]e
bsd-4 | licen | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd) licen[cs]e
0bsd | licen | (?:0bsd|zero clause bsd)(?: licen[cs]e)?
isc | licen | isc licen[cs]e
mpl-1-1 | mozilla public | mozilla public licen[cs]e(?: version| v)? 1 1
mpl-2 | mozilla public | mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
epl-1 | eclipse public | eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?
epl-2 | eclipse public | eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?
cddl-1 | licen | common development and distribution licen[cs]e
eupl-1-2 | licen | european union public licen[cs]e
artistic-1 | licen | artistic licen[cs]e(?: version)? 1 0
artistic-2 | licen | artistic licen[cs]e(?: version)? 2 0
boost-1 | licen | boost software licen[cs]e
zlib | licen | zlib(?: libpng)? licen[cs]e
unlicense | unlicense | the unlicense
wtfpl | licen | wtfpl(?: licen[cs]e)?
cc0 | cc0;commons | (?:cc0(?: 1 0)?(?: universal)?|creative commons zero)
cc-by | commons | creative commons attribution(?! (?:non|no|share))(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-sa | commons;cc by | (?:creative commons attribution share ?alike|cc by sa)(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nd | commons;cc by | (?:creative commons attribution no ?deriv(?:s|atives)|cc by nd)(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc | commons | creative commons attribution non ?commercial(?! (?:share|no))(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-sa | commons;cc by | (?:creative commons attribution non ?commercial share ?alike|cc by nc sa)(?: [1-4] [05])?(?: licen[cs]e)?
cc-by-nc-nd | commons;cc by | (?:creative commons attribution non ?commercial no ?deriv(?:s|atives)|cc by nc nd)(?: [1-4] [05])?(?: licen[cs]e)?
python-2 | licen | python (?:software foundation )?licen[cs]e
ruby | licen | ruby licen[cs]e
php-3 | licen | php licen[cs]e
postgresql | licen | postgresql licen[cs]e
openssl | licen | openssl licen[cs]e
ofl-1-1 | licen | (?:sil )?open font licen[cs]e
ncsa | licen | (?:university of illinois )?ncsa(?: open source)? licen[cs]e
ms-pl | licen | microsoft public licen[cs]e
ms-rl | licen | microsoft reciprocal licen[cs]e
afl-3 | licen | academic free licen[cs]e(?: version| v)?(?: 3 0)?
odbl-1 | licen | open database licen[cs]e
json | licen | json licen[cs]e
ibm-pl | licen | ibm public licen[cs]e
qpl | licen | q public licen[cs]e
intel | licen | intel open source licen[cs]e
vim | licen | vim licen[cs]e
"""
HINT = """
copyright | copyright | copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?
rights-reserved | rights reserved | all rights reserved
rights-reserved | rights reserved | (?:some|certain) rights reserved
no-warranty | warranty | (?:without|absolutely no) (?:any )?warranty(?: of any kind)?
"""


def rules() -> list[tuple[int, str, list[str], str, int, float]]:
    """(order, label, keywords, regex, priority, score) of every signature, strongest family first."""
    out = []
    for family, block in zip(FAMILIES, (IDENTIFIER, TEXT, NOTICE, LINK, NAME, HINT)):
        priority, score = FAMILIES[family]
        for line in block.strip().splitlines():
            label, words, signature = line.split(" | ", 2)
            out.append((len(out), label, words.split(";"), f"(?<= ){signature}(?= )", priority, score))
    return out
