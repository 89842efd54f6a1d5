"""Signatures of license texts and notices, written by hand.

Each line is a label and a passage that tells the license: words in lower case with single blanks, as scanned texts
have them, with a few alternatives. ``X`` stands for one to ten words, for names and years that differ.
"""

from __future__ import annotations

import re

#: Passages of published license texts.
_PASSAGES = """
mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
mit | the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software
mit | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | distributed under the mit software license
mit | use of this source code is governed by an? mit (?:style )?license
x11 | except as contained in this notice the name of X shall not be used in advertising or otherwise to promote the sale use or other dealings in this software
bsd | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions of source code must retain the (?:above )?copyright notice this list of conditions and the following disclaimer
bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd | this software is provided by X as is and any express or implied warranties including but not limited to the implied warranties of merchantability
bsd | use of this source code is governed by a bsd style license that can be found in the license file
bsd-3-clause | neither the names? of X (?:nor|or) the names of (?:its|their|any|the) contributors may be used to endorse or promote products derived from this software
bsd-3-clause | the names? of (?:its|the) (?:contributors|authors?) may (?:not )?be used to endorse or promote products derived from this software
bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-clause | the views and conclusions contained in the software and documentation are those of the authors and should not be interpreted as representing official policies
isc | permission to use copy modify (?:and or|and) distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
isc | the software is provided as is and the author disclaims all warranties with regard to this software
0bsd | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
hpnd | permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted provided that
hpnd | in no event shall X be liable for any special indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
zlib | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
libpng | the png reference library is supplied as is
apache-2 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
apache-2 | see the license for the specific language governing permissions and limitations under the license
apache-2 | apache license version 2 0 january 2004 http www apache org licenses
apache-2 | subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2 | you must cause any modified files to carry prominent notices stating that you changed the files
apache-2 | if the work includes a notice text file as part of its distribution
apache-1.1 | this product includes software developed by the apache software foundation
apache-1.1 | products derived from this software may not be called apache nor may apache appear in their name
gpl-2.0 | (?:this (?:program|file|software) is free software you can redistribute it and or modify it )?under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0 | (?:this (?:program|file|software) is free software you can redistribute it and or modify it )?under the terms of (?:the )?(?:gnu )?general public license version 2 (?:only )?as published by the free software foundation
gpl-2.0 | gnu general public license version 2 june 1991
gpl-2.0 | the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom
gpl-2.0 | you may copy and distribute verbatim copies of the program s source code as you receive it in any medium
gpl-2.0 | you may modify your copy or copies of the program or any portion of it thus forming a work based on the program
gpl-2.0 | write to the free software foundation inc (?:59 temple place|51 franklin street|675 mass ave)
gpl-3.0 | (?:this (?:program|file|software) is free software you can redistribute it and or modify it )?under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0 | (?:this (?:program|file|software) is free software you can redistribute it and or modify it )?under the terms of the gnu general public license version 3 (?:only )?as published by the free software foundation
gpl-3.0 | gnu general public license version 3 29 june 2007
gpl-3.0 | the gnu general public license is a free copyleft license for software and other kinds of works
gpl-3.0 | to propagate a work means to do anything with it that without permission would make you directly or secondarily liable for infringement
gpl-3.0 | you may convey verbatim copies of the program s source code as you receive it in any medium
gpl-3.0 | no covered work shall be deemed part of an effective technological measure
gpl-1.0 | gnu general public license version 1 february 1989
gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | you should have received a copy of the gnu general public license along with
gpl | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
lgpl-2.1 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-2.1 | gnu lesser general public license version 2 1 february 1999
lgpl-2.1 | this license the lesser general public license applies to some specially designated software packages
lgpl-2.0 | gnu library general public license as published by the free software foundation either version 2 of the license
lgpl-2.0 | gnu library general public license version 2 june 1991
lgpl-3.0 | gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-3.0 | this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl | you should have received a copy of the gnu (?:lesser|library) general public license along with
agpl-3.0 | gnu affero general public license as published by the free software foundation either version 3 of the license
agpl-3.0 | gnu affero general public license version 3 19 november 2007
agpl-3.0 | your modified version must prominently offer all users interacting with it remotely through a computer network
agpl | you should have received a copy of the gnu affero general public license along with
gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | with no invariant sections no front cover texts and no back cover texts
mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-2.0 | this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-2.0 | covered software is provided under this license on an as is basis without warranty of any kind
mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.1 | software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations
mpl-1.0 | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | the contents of this file are subject to the netscape public license version 1 1
epl-1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0
epl-1.0 | the accompanying program is provided under the terms of this eclipse public license agreement
epl-2.0 | this source code may also be made available under the following secondary licenses when the conditions for such availability set forth in the eclipse public license
cpl-1.0 | the accompanying program is provided under the terms of this common public license agreement
ipl-1.0 | the accompanying program is provided under the terms of this ibm public license
cddl-1.0 | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.0 | when distributing covered code include this cddl header notice in each file
eupl-1.2 | licensed under the eupl version 1 2 or as soon they will be approved by the european commission
eupl-1.2 | this european union public licence the eupl applies to the work
artistic-2.0 | this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed
artistic-2.0 | you are permitted to use the standard version and create and use modified versions for any purpose without restriction
artistic-1.0 | the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control
boost-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
boost-1.0 | distributed under the boost software license version 1 0
unlicense | this is free and unencumbered software released into the public domain
unlicense | anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary
unlicense | we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
cc0-1.0 | the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights
cc0-1.0 | to the extent possible under law X has waived all copyright and related or neighboring rights to this work
cc0-1.0 | statement of purpose the laws of most jurisdictions throughout the world automatically confer exclusive copyright and related rights
cc-by | this work is licensed under (?:a|the) creative commons attribution (?:[1-4] 0 )?(?:international |unported )?licen[sc]e
cc-by-sa | this work is licensed under (?:a|the) creative commons attribution share ?alike (?:[1-4] 0 )?(?:international |unported )?licen[sc]e
cc-by-nc | this work is licensed under (?:a|the) creative commons attribution non ?commercial (?:[1-4] 0 )?(?:international |unported )?licen[sc]e
cc-by-nd | this work is licensed under (?:a|the) creative commons attribution no ?deriv[a-z]* (?:[1-4] 0 )?(?:international |unported )?licen[sc]e
cc-by-nc-sa | this work is licensed under (?:a|the) creative commons attribution non ?commercial share ?alike (?:[1-4] 0 )?(?:international |unported )?licen[sc]e
cc-by-nc-nd | this work is licensed under (?:a|the) creative commons attribution non ?commercial no ?deriv[a-z]* (?:[1-4] 0 )?(?:international |unported )?licen[sc]e
cc-by | you are free to share copy and redistribute the material in any medium or format adapt remix transform and build upon the material for any purpose even commercially
cc-by-sa | if you remix transform or build upon the material you must distribute your contributions under the same license as the original
cc-by-nc | you may not use the material for commercial purposes
cc-by-nd | if you remix transform or build upon the material you may not distribute the modified material
wtfpl | everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed
wtfpl | you just do what the fuck you want to
wtfpl | this program is free software it comes without any warranty to the extent permitted by applicable law you can redistribute it
postgresql | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
python-2.0 | this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software
ncsa | to deal with the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
ncsa | university of illinois ncsa open source license
ofl-1.1 | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects
ofl-1.1 | neither the font software nor any of its individual components in original or modified versions may be sold by itself
ms-pl | this license governs use of the accompanying software if you use the software you accept this license
ms-rl | for any file you distribute that contains code from the software in source code or binary format you must provide recipients the source code to that file along with a copy of this license
openssl | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | this product includes cryptographic software written by eric young
php-3.01 | this product includes php software freely available from
upl-1.0 | subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data
osl-3.0 | licensed under the open software license version 3 0
afl-3.0 | licensed under the academic free license version (?:2 1|3 0)
sleepycat | redistributions in any form must be accompanied by information on how to obtain complete source code for the db software
unicode | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
w3c | permission to copy modify and distribute this (?:software|work) and its documentation with or without modification for any purpose and without fee or royalty is hereby granted
curl | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software
vim | there are no restrictions on distributing unmodified copies of vim except that they must include this license text
ruby | you may make and give away verbatim copies of the source form of the software without restriction provided that you duplicate all of the original copyright notices
tcl | this software is copyrighted by the regents of the university of california sun microsystems inc
odbl-1.0 | this X is made available under the open database license
odc-by-1.0 | this X is made available under the open data commons attribution license
pddl-1.0 | this X is made available under the public domain dedication and license
elastic-2.0 | you may not provide the software to third parties as a hosted or managed service where the service provides users with access to any substantial set of the features
sspl-1.0 | if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available
busl-1.1 | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
openrail-m | you agree not to use the model or derivatives of the model in any way that violates any applicable national federal state local or international law
openrail-m | section i preamble the creativeml openrail m license governs the use of the model
public-domain | this (?:work|software|file|code|document) (?:is|has been placed|is placed|is hereby placed) in the public domain
public-domain | the authors? (?:of this \\w+ )?(?:hereby )?disclaims? copyright to this source code
proprietary | all rights reserved no part of this (?:publication|work|software|document|book) may be reproduced
proprietary | this software is the confidential and proprietary information of X you shall not disclose such confidential information
proprietary | unauthorized copying of this file via any medium is strictly prohibited
"""
_X = r"(?:[^ ]+ ){1,10}?"


def passages() -> list[tuple[str, str]]:
    """``label, pattern``; several passages may share a label."""
    out = []
    for line in _PASSAGES.strip().split("\n"):
        label, text = (x.strip() for x in line.split(" | ", 1))
        out.append((label, re.sub(r"\bX ", lambda _: _X, text)))
    return out
