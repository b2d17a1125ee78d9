"""Signature rules of the license scan.

Rules are written over a text's words (A-Z lower-cased; runs of 0-9, a-z and
non-ASCII characters), one space between words. ``keyword`` is a literal run
of words that every match contains; a rule is only tried on texts that hold
it. Tiers are priorities, 1 first. To add a rule, add a line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Confidence of a detection by tier; base phrases have tier 0.
CONFIDENCE = {0: 0.8, 1: 1.0, 2: 0.95, 3: 0.9, 4: 0.85, 5: 0.7, 6: 0.4}

BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# SPDX identifiers: each gives a tag rule (tier 1) and a bare-identifier rule (tier 5).
SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CAL-1.0 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1
CECILL-2.1 CPAL-1.0 CPL-1.0 ECL-2.0 EFL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP GFDL-1.2 GFDL-1.3 GPL-1.0
GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later HPND IPL-1.0 ISC LGPL-2.0 LGPL-2.1
LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPL-1.02 LPPL-1.3c MIT MIT-0 MPL-1.1
MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NASA-1.3 NCSA ODbL-1.0 ODC-By-1.0 OFL-1.1 OLDAP-2.8 OSL-3.0 PDDL-1.0 PostgreSQL
PSF-2.0 Python-2.0 QPL-1.0 RPL-1.5 SISSL Sleepycat SSPL-1.0 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1
"""

# tier ; label ; keyword ; pattern
SIGNATURES = r"""
2 ; gpl-3.0 ; gnu general public license ; (?:licen[cs]ed|released|distributed|available|covered) under(?: the)?(?: terms of)?(?: the)? gnu general public license(?: v| version)? 3(?: 0)?
2 ; gpl-2.0 ; gnu general public license ; (?:licen[cs]ed|released|distributed|available|covered) under(?: the)?(?: terms of)?(?: the)? gnu general public license(?: v| version)? 2(?: 0)?
2 ; gpl ; gnu general public license ; (?:licen[cs]ed|released|distributed|available|covered) under(?: the)?(?: terms of)?(?: the)? gnu general public license
2 ; gpl-or-later ; gnu general public license ; under the terms of the gnu general public license as published by the free software foundation
2 ; gpl-3.0-or-later ; any later version ; gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
2 ; gpl-2.0-or-later ; any later version ; gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
2 ; lgpl-2.1-or-later ; any later version ; gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
2 ; lgpl-3.0-or-later ; any later version ; gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
2 ; agpl-3.0-or-later ; any later version ; gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
2 ; lgpl-2.1 ; lesser general public license ; licen[cs]ed under(?: the)? gnu lesser general public license(?: v| version)? 2 1
2 ; lgpl-3.0 ; lesser general public license ; licen[cs]ed under(?: the)? gnu lesser general public license(?: v| version)? 3(?: 0)?
2 ; lgpl ; lesser general public license ; licen[cs]ed under(?: the)? gnu lesser general public license
2 ; agpl-3.0 ; affero general public license ; licen[cs]ed under(?: the)? gnu affero general public license(?:(?: v| version)? 3(?: 0)?)?
2 ; apache-2.0 ; apache license ; (?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? apache license(?: v| version)? 2(?: 0)?
2 ; apache-1.1 ; apache ; (?:licen[cs]ed|released|distributed|available) under(?: the)? apache (?:software )?license(?: v| version)? 1 1
2 ; apache-2.0 ; apache 2 0 ; (?:licen[cs]ed|released|distributed|available) under(?: the)? apache 2 0(?: license)?
2 ; apache ; apache license ; (?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? apache license
2 ; mit ; mit license ; (?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? mit license
2 ; mit ; under the mit ; (?:licen[cs]ed|released|distributed|available) under the mit
2 ; mit ; x11 license ; (?:licen[cs]ed|released|distributed|available) under(?: the)? (?:mit )?x11 license
2 ; cc-by-nc-nd-4.0 ; cc by nc nd ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by nc nd 4 0(?: license)?
2 ; cc-by-nc-sa-4.0 ; cc by nc sa ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by nc sa 4 0(?: license)?
2 ; cc-by-nc-4.0 ; cc by nc ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by nc 4 0(?: license)?
2 ; cc-by-nc-3.0 ; cc by nc ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by nc 3 0(?: license)?
2 ; cc-by-nc ; cc by nc ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by nc(?: license)?
2 ; cc-by-nd-4.0 ; cc by nd ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by nd 4 0(?: license)?
2 ; cc-by-sa-4.0 ; cc by sa ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by sa 4 0(?: license)?
2 ; cc-by-sa-3.0 ; cc by sa ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by sa 3 0(?: license)?
2 ; cc-by-sa ; cc by sa ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by sa(?: license)?
2 ; cc-by-4.0 ; cc by 4 0 ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by 4 0(?: license)?
2 ; cc-by-3.0 ; cc by 3 0 ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? cc by 3 0(?: license)?
2 ; cc0-1.0 ; cc0 ; (?:licen[cs]ed|released|distributed|available|dedicated) under(?: the| a)? cc0(?: 1 0)?(?: license)?
2 ; cc-by-4.0 ; creative commons attribution ; under(?: the| a)? creative commons attribution 4 0(?: international)?(?: license| licence)?
2 ; cc-by-3.0 ; creative commons attribution ; under(?: the| a)? creative commons attribution 3 0(?: unported)?(?: license| licence)?
2 ; cc-by-sa-4.0 ; creative commons attribution sharealike ; under(?: the| a)? creative commons attribution sharealike 4 0(?: international)?(?: license| licence)?
2 ; cc-by-sa-3.0 ; creative commons attribution sharealike ; under(?: the| a)? creative commons attribution sharealike 3 0(?: unported)?(?: license| licence)?
2 ; cc-by-nc-4.0 ; creative commons attribution noncommercial ; under(?: the| a)? creative commons attribution noncommercial 4 0(?: international)?(?: license| licence)?
2 ; cc-by-nc-sa-4.0 ; noncommercial sharealike ; under(?: the| a)? creative commons attribution noncommercial sharealike 4 0(?: international)?(?: license| licence)?
2 ; cc-by-nc-nd-4.0 ; noncommercial noderivatives ; under(?: the| a)? creative commons attribution noncommercial noderivatives 4 0(?: international)?(?: license| licence)?
2 ; cc-by-nd-4.0 ; attribution noderivatives ; under(?: the| a)? creative commons attribution noderivatives 4 0(?: international)?(?: license| licence)?
2 ; bsd-3-clause ; bsd ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
2 ; bsd-2-clause ; bsd ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? (?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?
2 ; bsd ; bsd ; (?:licen[cs]ed|released|distributed|available) under(?: the| a)? bsd(?: style)?(?: license)?
2 ; mpl-2.0 ; mozilla public license ; (?:licen[cs]ed|released|distributed|available|subject to the terms of)(?: under)?(?: the)?(?: terms of the)? mozilla public license(?: v| version)? 2(?: 0)?
2 ; mpl-1.1 ; mozilla public license ; (?:licen[cs]ed|released|distributed|available) under(?: the)? mozilla public license(?: v| version)? 1 1
2 ; mpl-2.0 ; mozilla public ; this source code form is subject to the terms of the mozilla public license v 2 0
2 ; epl-2.0 ; eclipse public license ; (?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? eclipse public license(?: v| version)? 2(?: 0)?
2 ; epl-1.0 ; eclipse public license ; (?:licen[cs]ed|released|distributed|available) under(?: the)?(?: terms of the)? eclipse public license(?: v| version)? 1 0
2 ; isc ; isc license ; (?:licen[cs]ed|released|distributed|available) under(?: the)? isc license
2 ; zlib ; zlib ; (?:licen[cs]ed|released|distributed|available) under(?: the)? zlib(?: libpng)? license
2 ; bsl-1.0 ; boost software license ; (?:licen[cs]ed|released|distributed|available) under(?: the)? boost software license(?: version 1 0)?
2 ; unlicense ; unlicense ; (?:licen[cs]ed|released|distributed|available) under(?: the)? unlicense
2 ; wtfpl ; wtfpl ; (?:licen[cs]ed|released|distributed|available) under(?: the)? wtfpl
2 ; artistic-2.0 ; artistic license ; (?:licen[cs]ed|released|distributed|available) under(?: the)? artistic license(?: version)? 2(?: 0)?
2 ; perl ; same terms as perl ; under the same terms as perl(?: itself)?
2 ; ofl-1.1 ; open font license ; (?:licen[cs]ed|released|distributed|available) under(?: the)? sil open font license(?: version 1 1)?
2 ; odbl-1.0 ; open database license ; (?:licen[cs]ed|made available|released|available) under(?: the)? open database license
2 ; eupl-1.2 ; european union public licence ; (?:licen[cs]ed|released|distributed|available) under(?: the)? european union public licence(?: v| version)? 1 2
2 ; public-domain ; public domain ; (?:released|placed|dedicated|put) (?:into|in|to)(?: the)? public domain
2 ; public-domain ; public domain ; free and unencumbered software released into the public domain
2 ; dual-mit-apache ; apache ; dual licen[cs]ed under(?: the)? (?:mit(?: license)? and(?: the)? apache(?: license)?(?: version)?(?: 2 0)?|apache(?: license)?(?: 2 0)? and(?: the)? mit(?: license)?)
2 ; dual-mit-apache ; at your option ; either of apache license version 2 0 or mit license at your option
2 ; llama-community ; community license ; llama(?: \d+)+ community license(?: agreement)?
2 ; openrail ; openrail ; (?:licen[cs]ed|released) under(?: the)? (?:creativeml |bigscience )?openrail(?: m)?(?: license)?
2 ; ogl-3.0 ; open government licence ; (?:licen[cs]ed|contains public sector information licensed) under the open government licence(?: v3| v 3| version 3)(?: 0)?
3 ; apache-2.0 ; you may not use this file except ; you may not use this file except in compliance with the license you may obtain a copy of the license at
3 ; apache-2.0 ; as is basis ; distributed on an as is basis without warranties or conditions of any kind
3 ; apache-2.0 ; specific language governing permissions ; see the license for the specific language governing permissions and limitations under the license
3 ; mit ; permission is hereby granted ; permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
3 ; mit ; portions of the software ; the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
3 ; mit ; the software is provided as is ; the software is provided as is without warranty of any kind express or implied
3 ; isc ; permission to use copy modify ; permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3 ; hpnd ; permission to use copy modify ; permission to use copy modify and distribute this software and its documentation for any purpose
3 ; bsd ; redistribution and use in source and binary forms ; redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
3 ; bsd ; redistributions of source code ; redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
3 ; bsd ; redistributions in binary form ; redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
3 ; bsd-3-clause ; endorse or promote ; neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products
3 ; bsd-4-clause ; advertising materials ; all advertising materials mentioning features or use of this software must display the following acknowledgement
3 ; gpl ; without any warranty ; but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
3 ; gpl ; gnu general public license ; you should have received a copy of the gnu general public license along with this program
3 ; gpl ; free software ; this program is free software you can redistribute it and or modify it
3 ; lgpl ; free software ; this library is free software you can redistribute it and or modify it
3 ; gpl-3.0 ; gnu general public license version 3 ; gnu general public license version 3 29 june 2007
3 ; gpl-2.0 ; gnu general public license version 2 ; gnu general public license version 2 june 1991
3 ; lgpl-3.0 ; lesser general public license version 3 ; gnu lesser general public license version 3 29 june 2007
3 ; agpl-3.0 ; affero general public license version 3 ; gnu affero general public license version 3 19 november 2007
3 ; zlib ; altered source versions ; altered source versions must be plainly marked as such and must not be misrepresented as being the original software
3 ; zlib ; in no event will the authors ; in no event will the authors be held liable for any damages arising from the use of this software
3 ; bsl-1.0 ; boost software license version 1 0 ; boost software license version 1 0 17 august 2003
3 ; unlicense ; anyone is free to copy ; anyone is free to copy modify publish use compile sell or distribute this software
3 ; wtfpl ; do what the ; do what the fuck you want to public license
3 ; mpl-2.0 ; copy of the mpl ; if a copy of the mpl was not distributed with this file you can obtain one at
3 ; cc0-1.0 ; copyright and related ; to the extent possible under law .{1,80}? waived all copyright and related or neighboring rights
3 ; ofl-1.1 ; reserved font name ; with reserved font name
3 ; ms-pl ; accompanying software ; this license governs use of the accompanying software if you use the software you accept this license
3 ; postgresql ; permission to use copy modify and distribute ; permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
3 ; non-commercial ; non commercial ; (?:for|only for) non commercial (?:use|purposes)(?: only)?
3 ; non-commercial ; noncommercial ; (?:for|only for) noncommercial (?:use|purposes)(?: only)?
3 ; non-commercial ; commercial ; (?:not|may not be used) for commercial (?:use|purposes)
3 ; research-only ; research ; for research (?:use|purposes) only
3 ; research-only ; academic ; for academic(?: and research)? (?:use|purposes) only
4 ; gpl-3.0 ; gnu general public license ; gnu general public license(?: v| version) 3(?: 0)?
4 ; gpl-2.0 ; gnu general public license ; gnu general public license(?: v| version) 2(?: 0)?
4 ; gpl-1.0 ; gnu general public license ; gnu general public license(?: v| version) 1(?: 0)?
4 ; gpl-3.0 ; gpl ; (?:gnu )?gpl(?: v| version)? 3(?: 0)?
4 ; gpl-2.0 ; gpl ; (?:gnu )?gpl(?: v| version)? 2(?: 0)?
4 ; gpl-3.0 ; gplv3 ; (?:gnu )?gplv3
4 ; gpl-2.0 ; gplv2 ; (?:gnu )?gplv2
4 ; lgpl-3.0 ; lgplv3 ; (?:gnu )?lgplv3
4 ; lgpl-2.1 ; lgpl ; (?:gnu )?lgpl(?: v| version)? 2 1
4 ; lgpl-3.0 ; lgpl ; (?:gnu )?lgpl(?: v| version)? 3(?: 0)?
4 ; lgpl-2.1 ; lgplv2 ; (?:gnu )?lgplv2(?: 1)?
4 ; lgpl-2.1 ; lesser general public license ; gnu lesser general public license(?: v| version) 2 1
4 ; lgpl-3.0 ; lesser general public license ; gnu lesser general public license(?: v| version) 3(?: 0)?
4 ; lgpl-2.0 ; library general public license ; gnu library general public license(?: v| version) 2(?: 0)?
4 ; agpl-3.0 ; affero general public license ; gnu affero general public license(?: v| version) 3(?: 0)?
4 ; agpl-3.0 ; agplv3 ; (?:gnu )?agplv3
4 ; agpl-3.0 ; agpl ; (?:gnu )?agpl(?: v| version)? 3(?: 0)?
4 ; gfdl-1.3 ; free documentation license ; gnu free documentation license(?: version)? 1 3
4 ; gfdl-1.2 ; free documentation license ; gnu free documentation license(?: version)? 1 2
4 ; apache-2.0 ; apache license ; apache license(?: v| version)? 2(?: 0)?
4 ; apache-1.1 ; apache ; apache (?:software )?license(?: v| version)? 1 1
4 ; apache-1.0 ; apache ; apache (?:software )?license(?: v| version)? 1 0
4 ; cc-by-4.0 ; cc by 4 0 ; cc by 4 0
4 ; cc-by-3.0 ; cc by 3 0 ; cc by 3 0
4 ; cc-by-2.0 ; cc by 2 0 ; cc by 2 0
4 ; cc-by-sa-4.0 ; cc by sa ; cc by sa 4 0
4 ; cc-by-sa-3.0 ; cc by sa ; cc by sa 3 0
4 ; cc-by-nc-4.0 ; cc by nc ; cc by nc 4 0
4 ; cc-by-nc-3.0 ; cc by nc ; cc by nc 3 0
4 ; cc-by-nc-sa-4.0 ; cc by nc sa ; cc by nc sa 4 0
4 ; cc-by-nc-sa-3.0 ; cc by nc sa ; cc by nc sa 3 0
4 ; cc-by-nc-nd-4.0 ; cc by nc nd ; cc by nc nd 4 0
4 ; cc-by-nc-nd-3.0 ; cc by nc nd ; cc by nc nd 3 0
4 ; cc-by-nd-4.0 ; cc by nd ; cc by nd 4 0
4 ; cc0-1.0 ; cc0 1 0 ; cc0 1 0(?: universal)?
4 ; cc-by-4.0 ; creative commons attribution ; creative commons attribution 4 0(?: international)?
4 ; cc-by-sa-4.0 ; attribution sharealike ; creative commons attribution sharealike 4 0(?: international)?
4 ; cc-by-nc-4.0 ; attribution noncommercial ; creative commons attribution noncommercial 4 0(?: international)?
4 ; cc-by-4.0 ; creativecommons org licenses by ; creativecommons org licenses by 4 0
4 ; cc-by-sa-4.0 ; creativecommons org licenses by sa ; creativecommons org licenses by sa 4 0
4 ; cc-by-sa-3.0 ; creativecommons org licenses by sa ; creativecommons org licenses by sa 3 0
4 ; cc-by-nc-4.0 ; creativecommons org licenses by nc ; creativecommons org licenses by nc 4 0
4 ; cc-by-nc-sa-4.0 ; creativecommons org licenses by nc sa ; creativecommons org licenses by nc sa 4 0
4 ; cc-by-nc-nd-4.0 ; creativecommons org licenses by nc nd ; creativecommons org licenses by nc nd 4 0
4 ; cc-by-nd-4.0 ; creativecommons org licenses by nd ; creativecommons org licenses by nd 4 0
4 ; cc0-1.0 ; creativecommons org publicdomain zero ; creativecommons org publicdomain zero 1 0
4 ; public-domain ; creativecommons org publicdomain mark ; creativecommons org publicdomain mark 1 0
4 ; apache-2.0 ; apache org licenses ; apache org licenses license 2 0
4 ; gpl ; gnu org licenses ; gnu org licenses gpl(?: (?:2|3) 0)?
4 ; lgpl ; gnu org licenses ; gnu org licenses lgpl(?: (?:2 1|3 0))?
4 ; agpl-3.0 ; gnu org licenses ; gnu org licenses agpl(?: 3 0)?
4 ; mit ; opensource org licenses ; opensource org licenses mit(?: license)?
4 ; bsd-3-clause ; opensource org licenses ; opensource org licenses bsd 3 clause
4 ; bsd-2-clause ; opensource org licenses ; opensource org licenses bsd 2 clause
4 ; mpl-2.0 ; mozilla org mpl ; mozilla org mpl 2 0
4 ; mpl-2.0 ; mozilla public license ; mozilla public license(?: v| version)? 2(?: 0)?
4 ; mpl-1.1 ; mozilla public license ; mozilla public license(?: v| version)? 1 1
4 ; mpl-1.0 ; mozilla public license ; mozilla public license(?: v| version)? 1 0
4 ; epl-2.0 ; eclipse public license ; eclipse public license(?: v| version)? 2(?: 0)?
4 ; epl-1.0 ; eclipse public license ; eclipse public license(?: v| version)? 1(?: 0)?
4 ; eupl-1.2 ; european union public licence ; european union public licence(?: v| version)? 1 2
4 ; eupl-1.1 ; european union public licence ; european union public licence(?: v| version)? 1 1
4 ; cddl-1.0 ; common development and distribution license ; common development and distribution license(?: v| version)? 1 0
4 ; cddl-1.1 ; common development and distribution license ; common development and distribution license(?: v| version)? 1 1
4 ; cpl-1.0 ; common public license ; common public license(?: v| version)? 1 0
4 ; artistic-2.0 ; artistic license ; artistic license(?: version)? 2(?: 0)?
4 ; artistic-1.0 ; artistic license ; artistic license(?: version)? 1(?: 0)?
4 ; afl-3.0 ; academic free license ; academic free license(?: v| version)? 3 0
4 ; osl-3.0 ; open software license ; open software license(?: v| version)? 3 0
4 ; ofl-1.1 ; open font license ; (?:sil )?open font license(?: version)? 1 1
4 ; odbl-1.0 ; open database license ; open database license(?: v| version)? 1 0
4 ; odc-by-1.0 ; open data commons attribution ; open data commons attribution license(?: v)? 1 0
4 ; pddl-1.0 ; public domain dedication and license ; public domain dedication and license(?: v)? 1 0
4 ; bsd-3-clause ; bsd ; (?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)(?: license)?
4 ; bsd-2-clause ; bsd ; (?:2 clause bsd|bsd 2 clause|simplified bsd)(?: license)?
4 ; bsd-2-clause ; freebsd license ; freebsd license
4 ; bsd-4-clause ; bsd ; (?:4 clause bsd|bsd 4 clause|original bsd|old bsd)(?: license)?
4 ; python-2.0 ; python software foundation license ; python software foundation license(?: version)? 2
4 ; zpl-2.1 ; zope public license ; zope public license(?: version)? 2 1
4 ; lppl-1.3c ; latex project public license ; latex project public license(?: version)? 1 3c?
4 ; sspl-1.0 ; server side public license ; server side public license(?: version)? 1
4 ; busl-1.1 ; business source license ; business source license(?: version)? 1 1
4 ; ogl-3.0 ; open government licence ; open government licence(?: v| version)? 3(?: 0)?
4 ; ncsa ; ncsa ; university of illinois ncsa open source license
4 ; mulanpsl-2.0 ; mulan ; mulan permissive software license(?: v| version)? 2
4 ; upl-1.0 ; universal permissive license ; universal permissive license(?: v| version)? 1 0
4 ; cecill-2.1 ; cecill ; cecill(?: free software license agreement)?(?: version)? 2 1
4 ; w3c ; w3c ; w3c software(?: and document)?(?: notice and)? license
4 ; apsl-2.0 ; apple public source license ; apple public source license(?: version)? 2 0
4 ; rpl-1.5 ; reciprocal public license ; reciprocal public license(?: version)? 1 5
4 ; qpl-1.0 ; q public license ; q public license(?: version)? 1 0
4 ; blueoak-1.0.0 ; blue oak ; blue oak model license(?: 1 0 0)?
4 ; elastic-2.0 ; elastic license ; elastic license(?: v)? 2(?: 0)?
5 ; lgpl ; lesser general public license ; gnu lesser general public license
5 ; lgpl ; library general public license ; gnu library general public license
5 ; agpl ; affero general public license ; gnu affero general public license
5 ; gpl ; general public license ; general public license
5 ; gpl ; gnu gpl ; gnu gpl
5 ; gfdl ; free documentation license ; gnu free documentation license
5 ; gpl-exception ; classpath exception ; (?:with )?(?:the )?classpath exception
5 ; gpl-exception ; linking exception ; (?:with )?(?:a |the )?(?:static )?linking exception
5 ; llvm-exception ; llvm exceptions ; (?:with )?llvm exceptions
5 ; mit ; expat license ; expat license
5 ; mit ; mit licensed ; mit licensed
5 ; mit ; mit licenced ; mit licenced
5 ; mpl ; mozilla public license ; mozilla public license
5 ; epl ; eclipse public license ; eclipse public license
5 ; eupl ; european union public licence ; european union public licence
5 ; cddl ; common development and distribution license ; common development and distribution license
5 ; bsd ; bsd license ; bsd license
5 ; bsd ; bsd style license ; bsd style license
5 ; bsl-1.0 ; boost software license ; boost software license
5 ; isc ; isc license ; isc license
5 ; zlib ; zlib license ; zlib license
5 ; artistic ; artistic license ; artistic license
5 ; ofl ; open font license ; open font license
5 ; odbl ; open database license ; open database license
5 ; cc-by-sa ; attribution sharealike ; creative commons attribution sharealike
5 ; cc-by-nc ; attribution noncommercial ; creative commons attribution noncommercial
5 ; cc-by-nd ; attribution noderivatives ; creative commons attribution noderivatives
5 ; cc-by ; creative commons attribution ; creative commons attribution
5 ; cc ; creative commons ; creative commons(?: licen[cs]e)?
5 ; cc-by-nc-nd ; cc by nc nd ; cc by nc nd
5 ; cc-by-nc-sa ; cc by nc sa ; cc by nc sa
5 ; cc-by-nc ; cc by nc ; cc by nc
5 ; cc-by-nd ; cc by nd ; cc by nd
5 ; cc-by-sa ; cc by sa ; cc by sa
5 ; cc0 ; cc zero ; cc zero
5 ; psf ; python software foundation license ; python software foundation license
5 ; w3c ; w3c license ; w3c license
5 ; php-3.01 ; php license ; php license(?: version 3 01)?
5 ; ruby ; ruby license ; ruby license
5 ; vim ; vim license ; vim license
5 ; postgresql ; postgresql license ; postgresql license
5 ; openssl ; openssl license ; openssl license
5 ; libpng ; libpng license ; libpng license
5 ; curl ; curl license ; curl license
5 ; ijg ; independent jpeg group ; independent jpeg group license
5 ; beerware ; beer ware license ; the beer ware license
5 ; json ; shall be used for good ; the software shall be used for good not evil
5 ; commons-clause ; commons clause ; commons clause(?: license condition)?
5 ; polyform ; polyform ; polyform (?:noncommercial|small business|shield|strict|internal use) license(?: 1 0 0)?
5 ; openrail ; openrail ; (?:creativeml |bigscience )?openrail(?: m)?
5 ; rail ; responsible ai license ; responsible ai license
5 ; ogl ; open government licence ; open government licence
5 ; public-domain ; public domain ; (?:in )?(?:the )?public domain
5 ; unlicense ; unlicense org ; unlicense org
6 ; all-rights-reserved ; all rights reserved ; all rights reserved
6 ; all-rights-reserved ; alle rechte vorbehalten ; alle rechte vorbehalten
6 ; all-rights-reserved ; tous droits ; tous droits réservés
6 ; all-rights-reserved ; todos los derechos reservados ; todos los derechos reservados
6 ; copyright ; copyright ; copyright(?: c| ©)? (?:19|20)\d\d(?: (?:19|20)\d\d)?
6 ; copyright ; copyright ; (?:c|©) copyright
6 ; proprietary ; proprietary and confidential ; proprietary and confidential
6 ; proprietary ; confidential and proprietary ; confidential and proprietary
6 ; proprietary ; unauthorized ; unauthorized (?:copying|reproduction|distribution|use)(?: of this (?:file|work|document))?(?: via any medium)? is (?:strictly )?prohibited
6 ; proprietary ; trade secret ; trade secret
6 ; proprietary ; trade secrets ; (?:contains )?trade secrets
6 ; license-notice ; licensed under ; licensed under(?: the)?(?: terms of(?: the)?)?
6 ; license-notice ; see the license file ; see the license file(?: for details)?
6 ; license-notice ; end user license agreement ; end user license agreement
6 ; license-notice ; terms of use ; terms of use
6 ; license-notice ; terms of service ; terms of service
6 ; no-redistribution ; may not be ; may not be (?:reproduced|redistributed|copied)(?: or (?:reproduced|redistributed|distributed|copied))*
6 ; permission-required ; written permission ; without (?:the )?(?:prior |express )*written permission
6 ; used-with-permission ; used with permission ; used with permission
6 ; reprinted-with-permission ; reprinted with permission ; reprinted with permission
"""


@dataclass(frozen=True)
class Rule:
    number: int
    tier: int
    label: str
    keyword: str
    pattern: str

    @property
    def regex(self) -> str:
        """The rule over texts whose words stand between two spaces of their own."""
        return f" {self.pattern.replace(' ', '  ')} "

    @property
    def literal(self) -> str:
        return f" {self.keyword.replace(' ', '  ')} "


def _spdx_words(identifier: str) -> str:
    return " ".join(re.findall(r"[0-9a-z]+", identifier.lower()))


def rules() -> list[Rule]:
    """All rules, base phrases first; a rule's number is its place."""
    rows = [(0, label, phrase, phrase) for label, phrase in BASE]
    for name in SPDX.split():
        words = _spdx_words(name)
        rows.append((1, name.lower(), "spdx license identifier", f"spdx license identifier {words}"))
        if "-" in name and any(c.isdigit() for c in name) and words.split()[0] != "python":  # "mit" or "python 2 0" alone name no licence
            rows.append((5, name.lower(), words, words))
    for line in SIGNATURES.strip().splitlines():
        tier, label, keyword, pattern = (x.strip() for x in line.split(" ; "))
        rows.append((int(tier), label, keyword, pattern))
    return [Rule(i, *row) for i, row in enumerate(rows)]
