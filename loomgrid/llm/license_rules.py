"""Signatures of licences, as regular expressions over a text's lower-case words joined by single spaces.

Each licence has lines of a kind, a keyword that every match holds, and the expression:
T titles and names, U addresses, X clauses of the licence's own text, G mentions of a
family without a version. {L} and {V} stand for the spellings of `license` and for an
optional `version` or `v`. Two more rules follow from each licence: its SPDX tag from its
label, and a statement that something is licensed under it from its titles.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Kinds from strong to weak, with the confidence of a detection in hundredths.
KINDS = {"S": 98, "P": 95, "T": 85, "U": 85, "X": 75, "G": 50}
#: Fixed phrases, which are told of wherever they stand.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

SIGNATURES = r"""
apache-2.0
  T apache apache (?:software )?(?:foundation )?{L} {V}2(?: 0)?
  T apache apache 2(?: 0)? {L}
  T asl2 asl2(?: 0)?
  U apache apache org licenses license 2 0(?: txt| html)?
  U licenses opensource org licen[cs]es? apache(?: license)? 2 0(?: php)?
  X conditions without warranties or conditions of any kind either express or implied see the {L} for the specific language governing permissions and limitations
  X compliance you may not use this file except in compliance with the {L}
  X apache grant of patent license .{{0,80}}?apache
  G apache (?:the )?apache {L}
apache-1.1
  T apache apache (?:software )?{L} {V}1 1
  U apache apache org licenses license 1 1
  X acknowledgment this product includes software developed by the apache software foundation
apache-1.0
  T apache apache (?:software |group )?{L} {V}1 0
  U apache apache org licenses license 1 0
  X apache this product includes software developed by the apache group
mit
  T mit (?:the )?mit(?: x11| expat)? {L}
  T expat (?:the )?expat {L}
  U licenses opensource org licen[cs]es? mit(?: license)?(?: php| html)?
  U mit mit license org
  X sublicense to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
  X portions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
  X noninfringement merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable
mit-0
  T mit mit (?:0|no attribution)(?: {L})?
  U mit github com aws mit 0
x11
  T x11 (?:the )?x11 {L}
  X consortium the name of the x consortium shall not be used in advertising
isc
  T isc (?:the )?isc {L}
  U licenses opensource org licen[cs]es? isc(?: license)?(?: txt)?
  X fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
0bsd
  T 0bsd 0bsd(?: {L})?
  T bsd (?:bsd zero clause|zero clause bsd)(?: {L})?
  U 0bsd opensource org licen[cs]es? 0bsd
bsd-2-clause
  T bsd (?:bsd 2 clause|2 clause bsd|two clause bsd)(?: {L})?
  T simplified simplified bsd {L}
  T freebsd freebsd {L}
  U bsd opensource org licen[cs]es? bsd 2 clause
  X binary redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is
bsd-3-clause
  T bsd (?:bsd 3 clause|3 clause bsd|three clause bsd)(?: {L})?
  T new new bsd {L}
  T modified modified bsd {L}
  T revised revised bsd {L}
  U bsd opensource org licen[cs]es? bsd 3 clause
  X endorse may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause
  T bsd (?:bsd 4 clause|4 clause bsd|four clause bsd)(?: {L})?
  T original original bsd {L}
  X advertising all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd
  T bsd bsd style {L}
  T berkeley berkeley software distribution {L}
  X redistribution redistribution and use in source and binary forms with or without modification are permitted
  G bsd (?:the )?bsd {L}
gpl-1.0
  T gpl (?:gnu )?gpl {V}1(?: 0)?
  T gnu gnu general public {L} {V}1(?: 0)?
  U gnu gnu org licenses (?:old licenses )?gpl 1 0(?: html| txt)?
gpl-2.0
  T gpl (?:gnu )?gpl ?{V}2(?: 0)?
  T gplv2 gplv2
  T general (?:gnu )?general public {L} {V}2(?: 0)?
  U gnu gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
  U licenses opensource org licen[cs]es? gpl 2 0(?: php)?
  X temple free software foundation inc 5[19] (?:franklin street|temple place)
gpl-2.0-or-later
  T general (?:gnu )?general public {L} as published by the free software foundation either version 2 of the {L} or at your option any later version
  T general (?:gnu )?general public {L} {V}2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
  T gpl (?:gnu )?gpl ?{V}2(?: 0)?(?: plus| or later| or any later version)
gpl-3.0
  T gpl (?:gnu )?gpl ?{V}3(?: 0)?
  T gplv3 gplv3
  T general (?:gnu )?general public {L} {V}3(?: 0)?
  U gnu gnu org licenses gpl(?: 3 0)?(?: en)?(?: html| txt)?
  U licenses opensource org licen[cs]es? gpl 3 0(?: php)?
gpl-3.0-or-later
  T general (?:gnu )?general public {L} as published by the free software foundation either version 3 of the {L} or at your option any later version
  T general (?:gnu )?general public {L} {V}3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
  T gpl (?:gnu )?gpl ?{V}3(?: 0)?(?: plus| or later| or any later version)
gpl-unversioned
  X redistribute you can redistribute it and or modify it under the terms of the gnu general public {L}
  X gnu you should have received a copy of the gnu general public {L} along with this program
  X warranty this program is distributed in the hope that it will be useful but without any warranty
  G gpl gnu gpl
  G gnu gnu general public {L}
lgpl-2.0
  T library (?:gnu )?library general public {L} {V}2(?: 0)?
  T lgpl (?:gnu )?lgpl ?{V}2(?: 0)?
  U gnu gnu org licenses old licenses lgpl 2 0
lgpl-2.1
  T lesser (?:gnu )?lesser general public {L} {V}2 1
  T lgpl (?:gnu )?lgpl ?{V}2 1
  U gnu gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-2.1-or-later
  T lesser (?:gnu )?lesser general public {L} as published by the free software foundation either version 2 1 of the {L} or at your option any later version
  T lgpl (?:gnu )?lgpl ?{V}2 1(?: plus| or later)
lgpl-3.0
  T lesser (?:gnu )?lesser general public {L} {V}3(?: 0)?
  T lgpl (?:gnu )?lgpl ?{V}3(?: 0)?
  U gnu gnu org licenses lgpl(?: 3 0)?(?: en)?(?: html| txt)?
lgpl-unversioned
  X lesser you can redistribute it and or modify it under the terms of the gnu lesser general public {L}
  G lgpl gnu lgpl
  G lesser (?:gnu )?lesser general public {L}
agpl-3.0
  T affero (?:gnu )?affero general public {L} {V}3(?: 0)?
  T agpl (?:gnu )?agpl ?{V}3(?: 0)?
  T agplv3 agplv3
  U gnu gnu org licenses agpl(?: 3 0)?(?: en)?(?: html| txt)?
  X affero under the terms of the gnu affero general public {L} as published by the free software foundation
agpl-unversioned
  G affero (?:gnu )?affero general public {L}
  G agpl gnu agpl
gfdl-1.1
  T documentation (?:gnu )?free documentation {L} {V}1 1
gfdl-1.2
  T documentation (?:gnu )?free documentation {L} {V}1 2
  U gnu gnu org licenses old licenses fdl 1 2
gfdl-1.3
  T documentation (?:gnu )?free documentation {L} {V}1 3
  U gnu gnu org licenses fdl(?: 1 3)?(?: en)?(?: html| txt)?
gfdl-unversioned
  X invariant with no invariant sections no front cover texts and no back cover texts
  G documentation (?:gnu )?free documentation {L}
  G gfdl (?:gnu )?gfdl
mpl-1.1
  T mozilla mozilla public {L} {V}1 1
  T mpl mpl ?{V}1 1
  U mozilla mozilla org mpl 1 1
  X mozilla the contents of this file are subject to the mozilla public {L}
mpl-2.0
  T mozilla mozilla public {L} {V}2(?: 0)?
  T mpl mpl ?{V}2 0
  U mozilla mozilla org (?:en us )?mpl 2 0
  X mpl this source code form is subject to the terms of the mozilla public {L}(?: {V}2 0)?(?: if a copy of the mpl was not distributed with this file)
mpl-unversioned
  G mozilla mozilla public {L}
epl-1.0
  T eclipse eclipse public {L} {V}1(?: 0)?
  U eclipse eclipse org legal epl {V}1(?: ?0)?
epl-2.0
  T eclipse eclipse public {L} {V}2(?: 0)?
  U eclipse eclipse org legal epl 2 0
  X eclipse this program and the accompanying materials are made available under the terms of the eclipse public {L}
edl-1.0
  T eclipse eclipse distribution {L} {V}1(?: 0)?
cddl-1.0
  T cddl common development and distribution {L}(?: cddl)? {V}1(?: 0)?
  T cddl cddl {V}1 0
  U cddl opensource org licen[cs]es? cddl ?1?(?: 0)?
cddl-1.1
  T cddl cddl {V}1 1
cpl-1.0
  T common common public {L} {V}1(?: 0)?
ipl-1.0
  T ibm ibm public {L} {V}1(?: 0)?
  G ibm ibm public {L}
artistic-1.0
  T artistic artistic {L} {V}1(?: 0)?
artistic-2.0
  T artistic artistic {L} {V}2(?: 0)?
  U artistic perlfoundation org artistic license 2 0
  G perl under the same terms as perl itself
bsl-1.0
  T boost boost software {L}(?: {V}1(?: 0)?)?
  U boost boost org license 1 0(?: txt)?
  X machine must be included in all copies of the software .{{0,120}}?machine executable object code
zlib
  T zlib (?:the )?zlib(?: libpng)? {L}
  U zlib opensource org licen[cs]es? zlib
  X misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
libpng
  T libpng (?:the )?libpng {L}
unlicense
  T unlicense (?:the )?unlicense
  U unlicense unlicense org
  X encumbered this is free and unencumbered software released into the public domain
wtfpl
  T wtfpl wtfpl
  T fuck do what the fuck you want to public {L}
cc0-1.0
  T cc0 cc0(?: 1 0)?(?: universal)?
  T creative creative commons zero(?: v?1 0)?(?: universal)?
  U creativecommons creativecommons org publicdomain zero 1 0
  X waived to the extent possible under law .{{0,100}}? has waived all copyright and related or neighboring rights
cc-by-1.0
  U creativecommons creativecommons org licenses by 1 0
  T by cc by 1 0
cc-by-2.0
  U creativecommons creativecommons org licenses by 2 [05]
  T by cc by 2 [05]
cc-by-3.0
  U creativecommons creativecommons org licenses by 3 0
  T by cc by 3 0
  T attribution creative commons attribution 3 0(?: unported)?(?: {L})?
cc-by-4.0
  U creativecommons creativecommons org licenses by 4 0
  T by cc by 4 0
  T attribution creative commons attribution 4 0(?: international)?(?: public)?(?: {L})?
cc-by-sa-2.0
  U creativecommons creativecommons org licenses by sa 2 [05]
  T sa cc by sa 2 [05]
cc-by-sa-3.0
  U creativecommons creativecommons org licenses by sa 3 0
  T sa cc by sa 3 0
  T sharealike creative commons attribution share ?alike 3 0(?: unported)?(?: {L})?
cc-by-sa-4.0
  U creativecommons creativecommons org licenses by sa 4 0
  T sa cc by sa 4 0
  T sharealike creative commons attribution sharealike 4 0(?: international)?(?: {L})?
cc-by-nd-3.0
  U creativecommons creativecommons org licenses by nd 3 0
  T nd cc by nd 3 0
cc-by-nd-4.0
  U creativecommons creativecommons org licenses by nd 4 0
  T nd cc by nd 4 0
  T noderivatives creative commons attribution noderivatives 4 0(?: international)?
cc-by-nc-2.0
  U creativecommons creativecommons org licenses by nc 2 [05]
  T nc cc by nc 2 [05]
cc-by-nc-3.0
  U creativecommons creativecommons org licenses by nc 3 0
  T nc cc by nc 3 0
cc-by-nc-4.0
  U creativecommons creativecommons org licenses by nc 4 0
  T nc cc by nc 4 0
  T noncommercial creative commons attribution noncommercial 4 0(?: international)?
cc-by-nc-sa-3.0
  U creativecommons creativecommons org licenses by nc sa 3 0
  T nc cc by nc sa 3 0
cc-by-nc-sa-4.0
  U creativecommons creativecommons org licenses by nc sa 4 0
  T nc cc by nc sa 4 0
  T noncommercial creative commons attribution noncommercial sharealike 4 0(?: international)?
cc-by-nc-nd-3.0
  U creativecommons creativecommons org licenses by nc nd 3 0
  T nc cc by nc nd 3 0
cc-by-nc-nd-4.0
  U creativecommons creativecommons org licenses by nc nd 4 0
  T nc cc by nc nd 4 0
  T noncommercial creative commons attribution noncommercial noderivatives 4 0(?: international)?
cc-by-sa
  G sa cc by sa
  G sharealike creative commons attribution sharealike
cc-by-nc
  G nc cc by nc
  G noncommercial creative commons attribution noncommercial
cc-by-nd
  G nd cc by nd
cc-by-nc-sa
  G nc cc by nc sa
cc-by-nc-nd
  G nc cc by nc nd
creative-commons
  G creative (?:under (?:a |the )?)?creative commons(?: attribution)?(?: {L})?
public-domain
  T domain (?:released|dedicated|placed|donated) (?:in|into|to) the public domain
  U creativecommons creativecommons org publicdomain mark 1 0
  G domain (?:is |are )?in the public domain
odbl-1.0
  T database open database {L}(?: odbl)?(?: {V}1(?: 0)?)?
  T odbl odbl(?: {V}1 0)?
  U opendatacommons opendatacommons org licenses odbl
odc-by-1.0
  T commons open data commons attribution {L}(?: {V}1 0)?
  U opendatacommons opendatacommons org licenses by
pddl-1.0
  T commons (?:open data commons )?public domain dedication and {L}
  U opendatacommons opendatacommons org licenses pddl
ogl-uk-3.0
  T government open government licen[cs]e {V}3(?: 0)?
  U nationalarchives nationalarchives gov uk doc open government licence version 3
  G government open government licen[cs]e
etalab-2.0
  T ouverte licence ouverte(?: open licence)?(?: {V}2(?: 0)?)?
  U etalab etalab gouv fr .{{0,40}}?licence ouverte
ofl-1.1
  T sil sil open font {L}(?: {V}1 1)?
  T ofl ofl {V}1 1
  U sil scripts sil org ofl
  X reserved this font software is licensed under the sil open font {L}
ms-pl
  T microsoft microsoft public {L}
  T pl ms pl
ms-rl
  T microsoft microsoft reciprocal {L}
  T rl ms rl
eupl-1.1
  T european european union public licen[cs]e {V}1 1
  T eupl eupl {V}1 1
eupl-1.2
  T european european union public licen[cs]e {V}1 2
  T eupl eupl {V}1 2
  U eupl joinup ec europa eu .{{0,60}}?eupl
cecill-2.1
  T cecill cecill(?: free software)?(?: {L}| licence)? (?:agreement )?{V}2 1
cecill
  T cecill (?:licence )?cecill(?: [bc])?(?: free software)?(?: {L})?
  U cecill cecill info licences
  X cea this software is governed by the cecill
psf-2.0
  T python python software foundation {L}(?: {V}2(?: 0)?)?
  T psf psf {L}(?: agreement)?
  U python docs python org (?:3 )?license
ruby
  T ruby (?:the )?ruby {L}
  X ruby under the same terms as ruby
php-3.01
  T php php {L} {V}3 0?1
  U php php net license 3 01(?: txt)?
zpl-2.1
  T zope zope public {L}(?: {V}2 1)?
w3c
  T w3c w3c software(?: notice)?(?: and)? (?:document )?{L}
  U w3 w3 org consortium legal
ncsa
  T ncsa (?:university of illinois )?ncsa open source {L}
  U ncsa opensource org licen[cs]es? ncsa
upl-1.0
  T universal universal permissive {L}(?: {V}1(?: 0)?)?
  U upl oss oracle com licenses upl
afl-3.0
  T academic academic free {L}(?: {V}3(?: 0)?)?
osl-3.0
  T open open software {L} {V}3(?: 0)?
qpl-1.0
  T q (?:the )?q public {L}(?: {V}1 0)?
sleepycat
  T sleepycat sleepycat {L}
openssl
  T openssl openssl {L}
  X openssl this product includes software developed by the openssl project
ssleay
  X eric this product includes (?:cryptographic )?software written by eric young
postgresql
  T postgresql postgresql {L}
  U postgresql postgresql org about licence
  X agreement without a written agreement is hereby granted provided that the above copyright notice and this paragraph
curl
  T curl (?:the )?curl {L}
vim
  T vim vim {L}
ijg
  X jpeg this software is based in part on the work of the independent jpeg group
freetype
  T freetype (?:the )?freetype (?:project )?{L}
  X freetype portions of this software are copyright .{{0,20}}? the freetype project
imagemagick
  T imagemagick imagemagick {L}
unicode
  T unicode unicode (?:license agreement|terms of use|inc {L} agreement)
  U unicode unicode org (?:copyright|license)(?: html| txt)?
icu
  T icu icu {L}
ntp
  X suitability makes no representations about the suitability of this software for any purpose it is provided as is
hpnd
  T historical historical permission notice and disclaimer
beerware
  T beerware (?:the )?beerware {L}
  T beer the beer ware {L}
  X beer you can buy me a beer in return
json
  X evil the software shall be used for good not evil
blueoak-1.0.0
  T blue blue oak model {L}(?: 1 0 0)?
  U blueoakcouncil blueoakcouncil org license 1 0 0
bsl-1.1
  T business business source {L}(?: {V}1 1)?
  U mariadb mariadb com bsl11
  X change additional use grant .{{0,200}}?change date
sspl-1.0
  T server server side public {L}(?: {V}1)?
  U mongodb mongodb com licensing server side public license
elastic-2.0
  T elastic elastic {L}(?: {V}2(?: 0)?)?
  U elastic elastic co licensing elastic license
commons-clause
  T clause commons clause(?: {L})? condition(?: {V}1 0)?
  U commonsclause commonsclause com
polyform
  T polyform polyform (?:noncommercial|shield|perimeter|small business|strict|free trial|internal use) {L}(?: 1 0 0)?
  U polyformproject polyformproject org licenses
confluent-community
  T confluent confluent community {L}
rail
  T rail (?:bigscience |bigcode )?open ?rail(?: m)?(?: {L})?
  T responsible responsible ai {L}
llama-community
  T llama llama (?:2 |3 |3 1 |3 2 )?community {L}(?: agreement)?
mulan-psl-2.0
  T mulan mulan (?:psl|permissive software {L})(?: {V}2)?
  U coscl license coscl org cn mulanpsl2
anti-996
  T 996 anti 996 {L}
  U 996 996 icu
lppl-1.3
  T latex latex project public {L}(?: {V}1 3c?)?
  T lppl lppl {V}1 3c?
  U lppl latex project org lppl
cc-sampling
  U creativecommons creativecommons org licenses sampling
free-art-1.3
  T art free art {L}(?: 1 3)?
  T libre licence art libre
opl-1.0
  T publication open publication {L}(?: {V}1(?: 0)?)?
d-fsl-1.0
  T freie deutsche freie software lizenz
  T lizenz lizenziert unter (?:der )?.{{1,40}}? lizenz
dl-de-by-2.0
  T datenlizenz datenlizenz deutschland (?:namensnennung )?(?:version )?2 0
  U govdata govdata de dl de by 2 0
proprietary
  T proprietary (?:proprietary and confidential|confidential and proprietary)
  T proprietary proprietary {L}
  X reproduction unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or [a-z]+)* .{{0,60}}?(?:strictly )?(?:is )?prohibited
  X reproduced no part of this (?:publication|book|document|work) may be reproduced
  X consent without (?:the )?(?:express |prior )*(?:written )?(?:consent|permission) of the (?:author|publisher|copyright (?:holder|owner))
  G eula end user {L} agreement
  G agreement end user {L} agreement
rights-fr
  G droits tous droits r\xc3\xa9serv\xc3\xa9s
rights-de
  G rechte alle rechte vorbehalten
rights-es
  G derechos todos los derechos reservados
copyright
  G copyright copyright (?:c |\xc2\xa9 )?(?:1[89]|20)[0-9][0-9]
  G \xc2\xa9 \xc2\xa9 (?:copyright )?(?:1[89]|20)[0-9][0-9]
  G copyright copyright (?:c |\xc2\xa9 )?(?:by )?the (?:author|authors|contributors|regents)
"""


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    gate: bytes
    pattern: re.Pattern[bytes]

    @property
    def rank(self) -> int:
        """Rules are ordered by it: the less, the stronger."""
        return list(KINDS).index(self.kind)


def _compiled(expression: str) -> re.Pattern[bytes]:
    spelled = expression.replace("{L}", "licen[cs]e").replace("{V}", "(?:version |ver |v ?)?").replace("{{", "{").replace("}}", "}").replace("\\xc2\\xa9", "©").replace("\\xc3\\xa9", "é")
    return re.compile(b"(?<![^ ])(?:" + spelled.encode() + b")(?![^ ])")


def _rules() -> list[Rule]:
    out, label, titles = [], "", {}
    for line in SIGNATURES.strip().splitlines():
        if not line.startswith(" "):
            label = line
            words = re.findall("[a-z0-9]+", label)
            out.append(Rule(label, "S", b"spdx", _compiled("spdx license identifier " + " ".join(words) + "(?: only)?")))
            continue
        kind, gate, expression = line.split(None, 2)
        gate = gate.replace("\\xc2\\xa9", "©")
        out.append(Rule(label, kind, gate.encode(), _compiled(expression)))
        if kind == "T":
            titles.setdefault((label, gate), []).append(expression)
    for (label, gate), own in titles.items():
        said = "(?:licensed|released|distributed|available|published|provided|shared|offered|governed|covered) (?:under|by)(?: the)?(?: terms of)?(?: the| a| an)? "
        out.append(Rule(label, "P", gate.encode(), _compiled(f"{said}(?:gnu )?(?:{'|'.join(own)})")))
    return sorted(out, key=lambda r: r.rank)


RULES = _rules()
