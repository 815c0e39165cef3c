"""Signature rules of license texts, in order: label, level, words that must occur, pattern.

Patterns are matched against a text's words (lower-cased, parted by single
spaces), from the start of a word to the end of one. Levels: 4 wording of a
license or a grant, 3 identifier or address, 2 title with version, 1 family name.
Of equal levels the earlier rule goes first.
"""

# Phrases that count as base whatever else is found, fixed values.
BASE = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

RULES = r"""
gpl-3.0-or-later  4  redistribute gnu version   :: redistribute it and or modify it under the terms of the gnu general public license(?: [^ ]+){0,12} version 3(?: [^ ]+){0,8} any later version
gpl-2.0-or-later  4  redistribute gnu version   :: redistribute it and or modify it under the terms of the gnu general public license(?: [^ ]+){0,12} version 2(?: [^ ]+){0,8} any later version
lgpl-3.0-or-later 4  redistribute lesser gnu    :: redistribute it and or modify it under the terms of the gnu lesser general public license(?: [^ ]+){0,12} version 3(?: [^ ]+){0,8} any later version
lgpl-2.1-or-later 4  redistribute lesser gnu    :: redistribute it and or modify it under the terms of the gnu lesser general public license(?: [^ ]+){0,12} version 2 1(?: [^ ]+){0,8} any later version
lgpl-2.0-or-later 4  redistribute library gnu   :: redistribute it and or modify it under the terms of the gnu library general public license(?: [^ ]+){0,12} version 2(?: [^ ]+){0,8} any later version
agpl-3.0-or-later 4  redistribute affero gnu    :: redistribute it and or modify it under the terms of the gnu affero general public license(?: [^ ]+){0,12} version 3(?: [^ ]+){0,8} any later version
gpl-2.0-only      4  redistribute gnu version   :: redistribute it and or modify it under the terms of the gnu general public license version 2 (?:only|as published by the free software foundation)
gpl-3.0-only      4  redistribute gnu version   :: redistribute it and or modify it under the terms of the gnu general public license version 3 (?:only|as published by the free software foundation)
gpl-warranty      4  merchantability gnu        :: without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |affero |library )?general public license for more details
gpl-copy          4  received gnu               :: you should have received a copy of the gnu (?:lesser |affero |library )?general public license along with this (?:program|library|software|file)
gpl-text          4  copyleft gnu               :: the gnu general public license is a free copyleft license
lgpl-text         4  lesser incorporates        :: this version of the gnu lesser general public license incorporates the terms and conditions
agpl-text         4  affero copyleft            :: the gnu affero general public license is a free copyleft license
gpl-exception     4  exception permission          :: as a special exception(?: [^ ]+){0,12} permission to link
gpl-classpath     4  linking statically          :: linking this library statically or dynamically with other modules
apache-2.0        4  apache compliance          :: licensed under the apache license version 2 0(?: the license)? you may not use this file except in compliance with the license
apache-2.0        4  contributor perpetual     :: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
apache-2.0        4  warranties conditions      :: distributed on an as is basis without warranties or conditions of any kind
apache-1.1        4  apache foundation      :: this product includes software developed by the apache software foundation
apache-1.0        4  apache group               :: this product includes software developed by the apache group
mit               4  charge obtaining           :: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit               4  sublicense merge           :: to use copy modify merge publish distribute sublicense and or sell copies of the software
mit               4  claim liable     :: in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit-notice        4  substantial portions       :: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0             4  charge furnished           :: permission is hereby granted free of charge(?: [^ ]+){0,45} to permit persons to whom the software is furnished to do so the software is provided as is
x11               4  consortium advertising     :: the name of the x consortium shall not be used in advertising
isc               4  permission fee             :: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that
0bsd              4  permission fee             :: permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software
hpnd              4  permission fee             :: permission to use copy modify and distribute this software and its documentation for any purpose(?: and)?(?: with or)? without fee is hereby granted
bsd               4  redistributions source     :: redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd               4  redistributions binary     :: redistributions in binary form must reproduce the above copyright notice
bsd-3-clause      4  endorse promote            :: neither the name of(?: [^ ]+){1,16} may be used to endorse or promote products derived from this software
bsd-3-clause      4  endorse promote            :: the names? of(?: [^ ]+){1,12} may not be used to endorse or promote products derived from this software
bsd-4-clause      4  advertising materials :: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-2-patent      4  patent contributor        :: each copyright holder and contributor hereby grants(?: [^ ]+){0,12} patent license
bsd-disclaimer    4  consequential liable    :: in no event shall the (?:copyright (?:holders?|owners?)|regents|authors?)(?: [^ ]+){0,6} be liable for any direct indirect incidental special exemplary or consequential damages
mpl-2.0           4  mozilla form             :: this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0
mpl-1.1           4  mozilla contents         :: the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0           4  mozilla contents         :: the contents of this file are subject to the mozilla public license version 1 0
npl-1.1           4  netscape contents        :: the contents of this file are subject to the netscape public license version 1 1
epl-2.0           4  eclipse accompanying       :: this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?2(?: 0)?
epl-1.0           4  eclipse accompanying       :: this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1(?: 0)?
cddl-1.0          4  development distribution   :: subject to the terms of the common development and distribution license(?: [^ ]+){0,6}
cpl-1.0           4  accompanying common        :: accompanying materials are made available under the terms of the common public license
eupl              4  eupl licensed             :: licensed under the eupl(?: version 1 [0-2])?
zlib              4  misrepresented origin      :: the origin of this software must not be misrepresented
zlib              4  altered plainly            :: altered source versions must be plainly marked as such
zlib              4  anyone commercial         :: permission is granted to anyone to use this software for any purpose including commercial applications
bsl-1.0           4  machine executable         :: unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
unlicense         4  unencumbered public        :: this is free and unencumbered software released into the public domain
unlicense         4  heirs dedication             :: we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
wtfpl             4  fuck just                :: you just do what the fuck you want to
cc0-1.0           4  waived related             :: to the extent possible under law(?: [^ ]+){0,16} waived all copyright and related or neighboring rights
cc-by             4  appropriate credit    :: you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa          4  remix contributions        :: if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc          4  material commercial        :: you may not use the material for commercial purposes
cc-by-nd          4  remix modified             :: if you remix transform or build upon the material you may not distribute the modified material
gfdl              4  documentation gnu          :: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
ofl-1.1           4  font sil                   :: this font software is licensed under the sil open font license version 1 1
artistic          4  perl redistribute              :: redistribute it and or modify it under the same terms as perl itself
artistic-1.0      4  package intent             :: the intent of this document is to state the conditions under which a package may be copied
openssl           4  openssl toolkit            :: this product includes software developed by the openssl project for use in the openssl toolkit
ssleay            4  cryptographic young        :: this product includes cryptographic software written by eric young
php-3.01          4  php freely                 :: this product includes php(?: software)? freely available from
python-2.0        4  psf python          :: psf is making python(?: [^ ]+){0,6} available to licensee on an as is basis
ncsa              4  illinois endorse              :: university of illinois(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse
beerware          4  beer buy                 :: you can buy me a beer in return
json              4  evil software              :: the software shall be used for good not evil
curl              4  permission fee             :: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
ms-pl             4  governs accompanying           :: this license governs use of the accompanying software if you use the software you accept this license
sspl-1.0          4  service functionality      :: if you make the functionality of the program or a modified version available to third parties as a service
commons-clause    4  sell grant               :: the grant of rights under the license will not include and the license does not grant to you the right to sell the software
busl-1.1          4  licensor production        :: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use
elastic-2.0       4  hosted managed             :: you may not provide the software to third parties as a hosted or managed service
openrail          4  derivatives model           :: you agree not to use the model or derivatives of the model
llama             4  meta transferable            :: granted a non exclusive worldwide non transferable and royalty free limited license under meta s intellectual property
tcl               4  authors permission         :: the authors hereby grant permission to use copy modify distribute and license this software and its documentation
icu               4  charge provided           :: permission is hereby granted free of charge(?: [^ ]+){0,45} provided that the above copyright notice s and this permission notice appear in all copies
bzip2             4  origin misrepresented      :: the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated
proprietary       4  confidential proprietary   :: (?:this software|this document|this file|the information)(?: [^ ]+){0,10} confidential and proprietary
proprietary       4  unauthorized copying       :: unauthorized copying of this (?:file|software|document|work)(?: [^ ]+){0,6} (?:is )?(?:strictly )?prohibited
proprietary       4  prior written              :: (?:may not|must not|cannot) be (?:reproduced|copied|distributed|redistributed)(?: [^ ]+){0,12} without(?: the)? prior written (?:permission|consent)
all-rights        4  reserved rights            :: all rights reserved
public-domain     4  public domain              :: (?:placed|released|dedicated|put|is|are) (?:in|into|to) the public domain
no-ai-training    4  used not           :: (?:may|must|shall) not be used (?:for|to)(?: [^ ]+){0,6} train(?:ing)?(?: [^ ]+){0,6} (?:models?|machine learning|ai)
spdx-gpl-2.0      3  spdx identifier gpl        :: spdx license identifier gpl 2 0
spdx-gpl-2.0-only 3  spdx identifier gpl        :: spdx license identifier gpl 2 0 only
spdx-gpl-2.0-or-later 3 spdx identifier gpl     :: spdx license identifier gpl 2 0 or later
spdx-gpl-3.0      3  spdx identifier gpl        :: spdx license identifier gpl 3 0
spdx-gpl-3.0-only 3  spdx identifier gpl        :: spdx license identifier gpl 3 0 only
spdx-gpl-3.0-or-later 3 spdx identifier gpl     :: spdx license identifier gpl 3 0 or later
spdx-lgpl-2.1     3  spdx identifier lgpl       :: spdx license identifier lgpl 2 1(?: only| or later)?
spdx-lgpl-3.0     3  spdx identifier lgpl       :: spdx license identifier lgpl 3 0(?: only| or later)?
spdx-agpl-3.0     3  spdx identifier agpl       :: spdx license identifier agpl 3 0(?: only| or later)?
spdx-apache-2.0   3  spdx identifier apache     :: spdx license identifier apache 2 0
spdx-apache-1.1   3  spdx identifier apache     :: spdx license identifier apache 1 1
spdx-mit          3  spdx identifier mit        :: spdx license identifier mit
spdx-mit-0        3  spdx identifier mit        :: spdx license identifier mit 0
spdx-bsd-2-clause 3  spdx identifier bsd        :: spdx license identifier bsd 2 clause
spdx-bsd-3-clause 3  spdx identifier bsd        :: spdx license identifier bsd 3 clause
spdx-bsd-4-clause 3  spdx identifier bsd        :: spdx license identifier bsd 4 clause
spdx-0bsd         3  spdx identifier 0bsd       :: spdx license identifier 0bsd
spdx-isc          3  spdx identifier isc        :: spdx license identifier isc
spdx-mpl-2.0      3  spdx identifier mpl        :: spdx license identifier mpl 2 0
spdx-mpl-1.1      3  spdx identifier mpl        :: spdx license identifier mpl 1 1
spdx-epl-1.0      3  spdx identifier epl        :: spdx license identifier epl 1 0
spdx-epl-2.0      3  spdx identifier epl        :: spdx license identifier epl 2 0
spdx-cddl-1.0     3  spdx identifier cddl       :: spdx license identifier cddl 1 [01]
spdx-eupl-1.2     3  spdx identifier eupl       :: spdx license identifier eupl 1 [12]
spdx-cc0-1.0      3  spdx identifier cc0        :: spdx license identifier cc0 1 0
spdx-cc-by-4.0    3  spdx identifier cc         :: spdx license identifier cc by 4 0
spdx-cc-by-3.0    3  spdx identifier cc         :: spdx license identifier cc by 3 0
spdx-cc-by-sa-4.0 3  spdx identifier cc         :: spdx license identifier cc by sa 4 0
spdx-cc-by-sa-3.0 3  spdx identifier cc         :: spdx license identifier cc by sa 3 0
spdx-cc-by-nc-4.0 3  spdx identifier cc         :: spdx license identifier cc by nc 4 0
spdx-cc-by-nd-4.0 3  spdx identifier cc         :: spdx license identifier cc by nd 4 0
spdx-cc-by-nc-sa-4.0 3 spdx identifier cc       :: spdx license identifier cc by nc sa 4 0
spdx-cc-by-nc-nd-4.0 3 spdx identifier cc       :: spdx license identifier cc by nc nd 4 0
spdx-zlib         3  spdx identifier zlib       :: spdx license identifier zlib
spdx-bsl-1.0      3  spdx identifier bsl        :: spdx license identifier bsl 1 0
spdx-busl-1.1     3  spdx identifier busl       :: spdx license identifier busl 1 1
spdx-unlicense    3  spdx identifier unlicense  :: spdx license identifier unlicense
spdx-wtfpl        3  spdx identifier wtfpl      :: spdx license identifier wtfpl
spdx-ofl-1.1      3  spdx identifier ofl        :: spdx license identifier ofl 1 1
spdx-artistic-2.0 3  spdx identifier artistic   :: spdx license identifier artistic 2 0
spdx-ncsa         3  spdx identifier ncsa       :: spdx license identifier ncsa
spdx-postgresql   3  spdx identifier postgresql :: spdx license identifier postgresql
spdx-sspl-1.0     3  spdx identifier sspl       :: spdx license identifier sspl 1 0
spdx-elastic-2.0  3  spdx identifier elastic    :: spdx license identifier elastic 2 0
spdx-odbl-1.0     3  spdx identifier odbl       :: spdx license identifier odbl 1 0
url-gpl           3  gnu org           :: (?:www )?gnu org (?:licenses gpl(?: [23] 0)?(?: (?:html|txt|en html))?|copyleft gpl html)
url-lgpl          3  gnu licenses org           :: (?:www )?gnu org licenses lgpl(?: [23] [01])?(?: (?:html|txt))?
url-agpl          3  gnu licenses org           :: (?:www )?gnu org licenses agpl(?: 3 0)?(?: (?:html|txt))?
url-gfdl          3  fdl gnu org           :: (?:www )?gnu org (?:licenses|copyleft) fdl(?: html)?
url-apache-2.0    3  apache licenses org        :: (?:www )?apache org licenses license 2 0(?: (?:html|txt))?
url-mit           3  opensource mit org         :: (?:www )?opensource org licenses? mit(?: license)?(?: (?:php|html))?
url-bsd           3  opensource org             :: (?:www )?opensource org licenses? bsd [234] clause
url-isc           3  opensource isc org         :: (?:www )?opensource org licenses? isc(?: license)?
url-mpl-2.0       3  mozilla org mpl            :: (?:www )?mozilla org (?:en us )?mpl 2 0
url-mpl-1.1       3  mozilla org mpl            :: (?:www )?mozilla org mpl mpl 1 1(?: html)?
url-epl           3  eclipse org                :: (?:www )?eclipse org (?:legal epl|org documents epl) (?:v10|v20|2 0|v 1 0|v 2 0)(?: html)?
url-cc-by         3  creativecommons licenses   :: creativecommons org licenses by [1-4] [05]
url-cc-by-sa      3  creativecommons licenses   :: creativecommons org licenses by sa [1-4] [05]
url-cc-by-nc      3  creativecommons licenses   :: creativecommons org licenses by nc [1-4] [05]
url-cc-by-nd      3  creativecommons licenses   :: creativecommons org licenses by nd [1-4] [05]
url-cc-by-nc-sa   3  creativecommons licenses   :: creativecommons org licenses by nc sa [1-4] [05]
url-cc-by-nc-nd   3  creativecommons licenses   :: creativecommons org licenses by nc nd [1-4] [05]
url-cc0           3  creativecommons zero       :: creativecommons org publicdomain zero 1 0
url-cc-pdm        3  creativecommons mark       :: creativecommons org publicdomain mark 1 0
url-unlicense     3  unlicense org              :: (?:www )?unlicense org
url-wtfpl         3  wtfpl net                  :: (?:www )?wtfpl net
url-ofl           3  scripts sil org            :: scripts sil org ofl
url-boost         3  boost org license          :: (?:www )?boost org license 1 0 txt
url-odbl          3  opendatacommons            :: (?:www )?opendatacommons org licenses odbl(?: 1 0)?
url-pddl          3  opendatacommons            :: (?:www )?opendatacommons org licenses pddl(?: 1 0)?
url-odc-by        3  opendatacommons            :: (?:www )?opendatacommons org licenses by(?: 1 0)?
gpl-1.0           2  gnu general                :: gnu general public license(?: gpl)?(?: as)? (?:version|v) ?1
gpl-2.0           2  gnu version                :: gnu general public license(?: gpl)?(?: as)? version 2(?: 0)?
gpl-3.0           2  gnu version                :: gnu general public license(?: gpl)?(?: as)? version 3(?: 0)?
gpl-2.0           2  gpl                        :: (?:gnu )?gpl (?:version |v )?(?:2 0|2|v2)
gpl-3.0           2  gpl                        :: (?:gnu )?gpl (?:version |v )?(?:3 0|3|v3)
gpl-2.0           2  gplv2                      :: gplv2(?: only| or later)?
gpl-3.0           2  gplv3                      :: gplv3(?: only| or later)?
lgpl-2.0          2  library gnu                :: gnu library general public license(?: version 2(?: 0)?)?
lgpl-2.1          2  lesser gnu                 :: gnu lesser general public license(?: lgpl)?(?: as)? version 2 1
lgpl-3.0          2  lesser gnu                 :: gnu lesser general public license(?: lgpl)?(?: as)? version 3(?: 0)?
lgpl-2.1          2  lgpl                       :: lgpl (?:version |v )?2 1
lgpl-3.0          2  lgpl                       :: lgpl (?:version |v )?(?:3 0|3|v3)
agpl-3.0          2  affero gnu                 :: gnu affero general public license(?: agpl)?(?: as)? version 3(?: 0)?
agpl-3.0          2  agpl                       :: agpl (?:version |v )?(?:3 0|3|v3)
agpl-3.0          2  agplv3                     :: agplv3
gfdl              2  documentation gnu          :: gnu free documentation license version 1 [123]
apache-2.0        2  apache license             :: apache license(?: version)? 2 0
apache-2.0        2  apache                     :: apache (?:software )?(?:license )?(?:version |v )?2 0
apache-1.1        2  apache                     :: apache (?:software )?license(?: version)? 1 1
apache-2.0        2  asl                        :: asl 2 0
bsd-2-clause      2  bsd                        :: (?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?
bsd-3-clause      2  bsd                        :: (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?
bsd-4-clause      2  bsd                        :: (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: license)?
bsd-0-clause      2  bsd                        :: (?:bsd zero clause|zero clause bsd)(?: license)?
mpl-2.0           2  mozilla                    :: mozilla public license(?: mpl)?(?: version| v)? 2 0
mpl-1.1           2  mozilla                    :: mozilla public license(?: mpl)?(?: version| v)? 1 1
mpl-1.0           2  mozilla                    :: mozilla public license(?: mpl)?(?: version| v)? 1 0
epl-2.0           2  eclipse                    :: eclipse public license(?: epl)?(?: version| v)? ?2(?: 0)?
epl-1.0           2  eclipse                    :: eclipse public license(?: epl)?(?: version| v)? ?1(?: 0)?
cddl-1.1          2  development distribution   :: common development and distribution license(?: cddl)? version 1 1
cc-by-4.0         2  cc                         :: cc by 4 0
cc-by-3.0         2  cc                         :: cc by 3 0
cc-by-2.0         2  cc                         :: cc by 2 [05]
cc-by-sa          2  cc                         :: cc by sa(?: [1-4] [05])?
cc-by-nc          2  cc                         :: cc by nc(?: [1-4] [05])?
cc-by-nd          2  cc                         :: cc by nd(?: [1-4] [05])?
cc-by-nc-sa       2  cc                         :: cc by nc sa(?: [1-4] [05])?
cc-by-nc-nd       2  cc                         :: cc by nc nd(?: [1-4] [05])?
cc0-1.0           2  cc0                        :: cc0(?: 1 0)?(?: universal)?
cc-by-sa          2  creative attribution       :: creative commons attribution share ?alike(?: [1-4] [05])?(?: (?:international|unported))?(?: license)?
cc-by-nc          2  creative attribution       :: creative commons attribution non ?commercial(?: [1-4] [05])?(?: (?:international|unported))?(?: license)?
cc-by-nd          2  creative attribution       :: creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?(?: license)?
cc-by             2  creative attribution       :: creative commons attribution(?: [1-4] [05])?(?: (?:international|unported))?(?: license)?
artistic-2.0      2  artistic                   :: artistic license(?: version)? 2 0
artistic-1.0      2  artistic                   :: artistic license(?: version)? 1 0
bsl-1.0           2  boost                      :: boost software license(?: version)?(?: 1 0)?
busl-1.1          2  business source            :: business source license(?: version)?(?: 1 1)?
eupl-1.2          2  european union             :: european union public licen[cs]e(?: version)?(?: 1 [0-2])?
osl-3.0           2  open software              :: open software license(?: version| v)?(?: 3 0)?
afl-3.0           2  academic                   :: academic free license(?: version| v)?(?: 3 0)?
ofl-1.1           2  font sil                   :: sil open font license(?: version)?(?: 1 1)?
odbl-1.0          2  database commons           :: open data commons open database license
ms-pl             2  microsoft                  :: microsoft public license
ms-rl             2  microsoft                  :: microsoft reciprocal license
upl-1.0           2  universal permissive       :: universal permissive license
cecill            2  cecill                     :: cecill(?: [bc])?(?: (?:free software )?license)?
polyform          2  polyform                   :: polyform (?:noncommercial|small business|shield|strict|perimeter)(?: license)?
openrail          2  openrail                   :: (?:creativeml |bigscience |bigcode )?openrail(?: [ms])?(?: license)?
llama             2  llama                      :: llama(?: [0-9])*(?: community)? license
gemma             2  gemma                      :: gemma terms of use
sspl-1.0          2  server side                :: server side public license
elastic-2.0       2  elastic                    :: elastic license(?: v2| 2 0)?
gpl               1  gnu                        :: gnu general public licen[cs]e
lgpl              1  lesser                     :: (?:gnu )?lesser general public licen[cs]e
agpl              1  affero                     :: (?:gnu )?affero general public licen[cs]e
gpl               1  gpl                        :: (?:gnu )?gpl(?: licen[cs]ed?)?
lgpl              1  lgpl                       :: (?:gnu )?lgpl(?: licen[cs]ed?)?
agpl              1  agpl                       :: (?:gnu )?agpl(?: licen[cs]ed?)?
gfdl              1  documentation gnu          :: gnu free documentation license
apache            1  apache license             :: apache license
apache            1  apache license             :: apache software license
mit               1  license mit                :: mit license
mit               1  licensed mit               :: licensed under(?: the)? mit
mit               1  expat                      :: expat license
cc-by             1  cc by                      :: cc by
creative-commons  1  creative commons           :: creative commons(?: license)?
bsd               1  bsd                        :: bsd(?: style)? licen[cs]ed?
isc               1  isc                        :: isc license
mpl               1  mozilla                    :: mozilla public license
epl               1  eclipse                    :: eclipse public license
zlib              1  zlib                       :: zlib(?: libpng)? license
unlicense         1  unlicense                  :: the unlicense
wtfpl             1  wtfpl                      :: wtfpl
artistic          1  artistic                   :: artistic license
postgresql        1  postgresql                 :: postgresql license
python            1  python                     :: python (?:software foundation )?license
php               1  php                        :: php license
ruby              1  ruby                       :: ruby license
vim               1  vim                        :: vim license
x11               1  x11                        :: x11 license
ncsa              1  ncsa                       :: (?:university of illinois )?ncsa open source license
w3c               1  w3c                        :: w3c (?:software (?:notice and )?license|license)
unicode           1  unicode                    :: unicode license(?: agreement)?
ftl               1  freetype                   :: freetype (?:project )?license
ijg               1  jpeg                       :: independent jpeg group
bitstream         1  bitstream                  :: bitstream vera(?: fonts?)? copyright
ubuntu-font       1  ubuntu                     :: ubuntu font licence
qpl               1  public                     :: q public license
sleepycat         1  sleepycat                  :: sleepycat license
public-domain     1  domain public              :: public domain
shareware         1  shareware                  :: shareware
freeware          1  freeware                   :: freeware
eula              1  eula                       :: eula
eula              1  agreement license          :: end user license agreement
proprietary       1  license proprietary        :: proprietary license
commercial        1  license commercial         :: commercial license
copyright         1  copyright                  :: copyright(?: c)?(?: [12][0-9]{3})+
"""
