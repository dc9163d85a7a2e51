"""The licence signatures of operator 4, written out: names, grants, notices and sentences of licence texts.

A line is `keyword | label | expression`.  The expression is over lower-case words joined by single spaces, with punctuation gone ("GPL-2.0" is
`gpl 2 0`); the keyword is a whole word that every match holds.  {l} stands for license or licence, {v} for an optional "version" or
"v", {later} for "or any later version".  A line of a more particular licence stands before that of a more general one.
"""

from __future__ import annotations

MACROS = {"{l}": "licen[cs]e", "{v}": "(?:version |v ?)?", "{later}": "(?: or (?:at your option )?(?:any )?(?:later|newer|higher)(?: versions?)?| only or later| and later| plus)"}

#: Names with a version: priority 1, score 0.95.
VERSIONED = """
gnu | gpl-1.0-or-later | gnu (?:general public {l}|gpl) {v}1(?: 0)?{later}
gnu | gpl-1.0 | gnu (?:general public {l}|gpl) {v}1(?: 0)?
gnu | gpl-2.0-or-later | gnu (?:general public {l}|gpl) {v}2(?: 0)?{later}
gnu | gpl-2.0-only | gnu (?:general public {l}|gpl) {v}2(?: 0)? only
gnu | gpl-2.0 | gnu (?:general public {l}|gpl) {v}2(?: 0)?
gnu | gpl-3.0-or-later | gnu (?:general public {l}|gpl) {v}3(?: 0)?{later}
gnu | gpl-3.0-only | gnu (?:general public {l}|gpl) {v}3(?: 0)? only
gnu | gpl-3.0 | gnu (?:general public {l}|gpl) {v}3(?: 0)?
gpl | gpl-1.0 | gpl {v}1(?: 0)?
gpl | gpl-2.0-or-later | gpl {v}2(?: 0)?{later}
gpl | gpl-2.0-only | gpl {v}2(?: 0)? only
gpl | gpl-2.0 | gpl {v}2(?: 0)?
gpl | gpl-3.0-or-later | gpl {v}3(?: 0)?{later}
gpl | gpl-3.0-only | gpl {v}3(?: 0)? only
gpl | gpl-3.0 | gpl {v}3(?: 0)?
gplv2 | gpl-2.0-or-later | (?:gnu )?gplv2{later}
gplv2 | gpl-2.0 | (?:gnu )?gplv2
gplv3 | gpl-3.0-or-later | (?:gnu )?gplv3{later}
gplv3 | gpl-3.0 | (?:gnu )?gplv3
classpath | gpl-2.0-with-classpath-exception | gpl {v}2(?: 0)? with (?:the )?classpath exception
linking | gpl-with-linking-exception | gpl (?:{v}[23](?: 0)? )?with (?:a |the )?(?:static )?linking exception
lesser | lgpl-2.1-or-later | (?:gnu )?lesser general public {l} {v}2 1{later}
lesser | lgpl-2.1 | (?:gnu )?lesser general public {l} {v}2 1
lesser | lgpl-3.0-or-later | (?:gnu )?lesser general public {l} {v}3(?: 0)?{later}
lesser | lgpl-3.0 | (?:gnu )?lesser general public {l} {v}3(?: 0)?
library | lgpl-2.0-or-later | (?:gnu )?library general public {l} {v}2(?: 0)?{later}
library | lgpl-2.0 | (?:gnu )?library general public {l} {v}2(?: 0)?
lgpl | lgpl-2.0-or-later | (?:gnu )?lgpl {v}2 0{later}
lgpl | lgpl-2.1-or-later | (?:gnu )?lgpl {v}2 1{later}
lgpl | lgpl-2.1 | (?:gnu )?lgpl {v}2 1
lgpl | lgpl-2.0 | (?:gnu )?lgpl {v}2(?: 0)?
lgpl | lgpl-3.0-or-later | (?:gnu )?lgpl {v}3(?: 0)?{later}
lgpl | lgpl-3.0 | (?:gnu )?lgpl {v}3(?: 0)?
lgplv3 | lgpl-3.0 | (?:gnu )?lgplv3
affero | agpl-1.0 | affero general public {l} {v}1(?: 0)?
affero | agpl-3.0-or-later | (?:gnu )?affero general public {l} {v}3(?: 0)?{later}
affero | agpl-3.0 | (?:gnu )?affero general public {l} {v}3(?: 0)?
agpl | agpl-3.0-or-later | (?:gnu )?agpl {v}3(?: 0)?{later}
agpl | agpl-3.0 | (?:gnu )?agpl {v}3(?: 0)?
agplv3 | agpl-3.0 | (?:gnu )?agplv3
documentation | gfdl-1.1 | (?:gnu )?free documentation {l} {v}1 1
documentation | gfdl-1.2 | (?:gnu )?free documentation {l} {v}1 2
documentation | gfdl-1.3 | (?:gnu )?free documentation {l} {v}1 3
gfdl | gfdl-1.3 | (?:gnu )?gfdl {v}1 3
apache | apache-1.0 | apache (?:software )?(?:{l} )?{v}1 0
apache | apache-1.1 | apache (?:software )?(?:{l} )?{v}1 1
apache | apache-2.0-with-llvm-exception | apache (?:{l} )?{v}2(?: 0)? with llvm exceptions?
apache | apache-2.0 | apache (?:software )?(?:{l} )?{v}2(?: 0)?
bsd | bsd-1-clause | bsd 1 clause(?: {l})?
bsd | bsd-2-clause-patent | bsd (?:2 clause )?plus patent(?: {l})?
bsd | bsd-2-clause-freebsd | (?:bsd 2 clause|2 clause bsd) freebsd(?: {l})?
bsd | bsd-2-clause | (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: {l})?
bsd | bsd-3-clause-clear | (?:bsd 3 clause clear|clear bsd)(?: {l})?
bsd | bsd-3-clause-lbnl | lawrence berkeley national labs bsd variant {l}
bsd | bsd-3-clause | (?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|revised|modified) bsd)(?: {l})?
bsd | bsd-4-clause-uc | bsd 4 clause (?:uc|university of california)(?: specific)?
bsd | bsd-4-clause | (?:bsd (?:4|four) clause|(?:4|four) clause bsd|(?:original|old) bsd)(?: {l})?
bsd | 0bsd | (?:zero clause bsd|bsd zero clause|bsd 0 clause)(?: {l})?
0bsd | 0bsd | 0bsd
mit | mit-0 | mit (?:no attribution|0) {l}
mit | mit-modern-variant | mit {l} modern variant
cmu | mit-cmu | cmu {l}
enlightenment | mit-advertising | enlightenment {l}(?: e16)?
mozilla | mpl-1.0 | mozilla public {l} {v}1 0
mozilla | mpl-1.1 | mozilla public {l} {v}1 1
mozilla | mpl-2.0-no-copyleft-exception | mozilla public {l} {v}2(?: 0)? no copyleft exception
mozilla | mpl-2.0 | mozilla public {l} {v}2(?: 0)?
mpl | mpl-1.0 | mpl {v}1 0
mpl | mpl-1.1 | mpl {v}1 1
mpl | mpl-2.0 | mpl {v}2(?: 0)?
eclipse | epl-1.0 | eclipse public {l} {v}1(?: 0)?
eclipse | epl-2.0 | eclipse public {l} {v}2(?: 0)?
epl | epl-1.0 | epl {v}1 0
epl | epl-2.0 | epl {v}2 0
eclipse | edl-1.0 | eclipse distribution {l} {v}1(?: 0)?
distribution | cddl-1.0 | common development and distribution {l} {v}1 0
distribution | cddl-1.1 | common development and distribution {l} {v}1 1
cddl | cddl-1.0 | cddl {v}1 0
cddl | cddl-1.1 | cddl {v}1 1
common | cpl-1.0 | common public {l} {v}1(?: 0)?
attribution | cpal-1.0 | common public attribution {l} {v}1(?: 0)?
artistic | artistic-1.0-perl | artistic {l} {v}1 0 perl
artistic | artistic-1.0 | (?:perl )?artistic {l} {v}1(?: 0)?
artistic | artistic-2.0 | (?:perl )?artistic {l} {v}2(?: 0)?
boost | bsl-1.0 | boost software {l} {v}1(?: 0)?
bsl | bsl-1.0 | bsl 1 0
python | python-2.0 | python {l} {v}2(?: 0)?
python | psf-2.0 | python software foundation {l} (?:agreement )?{v}2(?: 0)?
psf | psf-2.0 | psf {l} (?:agreement )?{v}2(?: 0)?
cnri | cnri-python | cnri (?:open source )?(?:python )?{l} agreement
php | php-3.0 | php {l} {v}3 0
php | php-3.01 | php {l} {v}3 01
zend | zend-2.0 | zend {l} {v}2(?: 0)?
zope | zpl-1.1 | zope public {l} {v}1 1
zope | zpl-2.0 | zope public {l} {v}2 0
zope | zpl-2.1 | zope public {l} {v}2 1
european | eupl-1.0 | european union public {l} {v}1 0
european | eupl-1.1 | european union public {l} {v}1 1
european | eupl-1.2 | european union public {l} {v}1 2
eupl | eupl-1.1 | eupl {v}1 1
eupl | eupl-1.2 | eupl {v}1 2
cecill | cecill-1.0 | cecill (?:free software {l} agreement )?{v}1(?: 0)?
cecill | cecill-2.0 | cecill (?:free software {l} agreement )?{v}2 0
cecill | cecill-2.1 | cecill (?:free software {l} agreement )?{v}2 1
cecill | cecill-b | cecill b(?: free software {l} agreement)?
cecill | cecill-c | cecill c(?: free software {l} agreement)?
sil | ofl-1.0 | sil open font {l} {v}1 0
sil | ofl-1.1 | sil open font {l} {v}1 1
ofl | ofl-1.1 | ofl 1 1
academic | afl-1.1 | academic free {l} {v}1 1
academic | afl-2.0 | academic free {l} {v}2 0
academic | afl-2.1 | academic free {l} {v}2 1
academic | afl-3.0 | academic free {l} {v}3 0
open | osl-1.0 | open software {l} {v}1 0
open | osl-2.0 | open software {l} {v}2 0
open | osl-2.1 | open software {l} {v}2 1
open | osl-3.0 | open software {l} {v}3 0
apple | apsl-1.0 | apple public source {l} {v}1 0
apple | apsl-1.1 | apple public source {l} {v}1 1
apple | apsl-2.0 | apple public source {l} {v}2 0
reciprocal | rpl-1.1 | reciprocal public {l} {v}1 1
reciprocal | rpl-1.5 | reciprocal public {l} {v}1 5
latex | lppl-1.0 | latex project public {l} {v}1 0
latex | lppl-1.2 | latex project public {l} {v}1 2
latex | lppl-1.3c | latex project public {l} {v}1 3c?
lppl | lppl-1.3c | lppl {v}1 3c?
ibm | ipl-1.0 | ibm public {l} {v}1(?: 0)?
lucent | lpl-1.02 | lucent public {l} {v}1 02
nokia | nokia | nokia open source {l} {v}1 0a?
sun | sissl | sun industry standards source {l} {v}1 [12]
sun | spl-1.0 | sun public {l} {v}1 0
netscape | npl-1.0 | netscape public {l} {v}1 0
netscape | npl-1.1 | netscape public {l} {v}1 1
qt | qpl-1.0 | qt public {l} {v}1 0
q | qpl-1.0 | q public {l} {v}1 0
nasa | nasa-1.3 | nasa open source agreement {v}1 3
ncsa | ncsa | (?:university of illinois )?(?:uiuc )?ncsa open source {l}
mulan | mulanpsl-1.0 | mulan (?:psl|permissive software {l}) {v}1(?: 0)?
mulan | mulanpsl-2.0 | mulan (?:psl|permissive software {l}) {v}2(?: 0)?
blueoak | blueoak-1.0.0 | blueoak(?: model {l})? 1 0 0
blue | blueoak-1.0.0 | blue oak model {l} 1 0 0
upl | upl-1.0 | upl {v}1 0
universal | upl-1.0 | universal permissive {l} {v}1 0
elastic | elastic-2.0 | elastic {l} {v}2(?: 0)?
server | sspl-1.0 | server side public {l} {v}1
sspl | sspl-1.0 | sspl {v}1(?: 0)?
business | busl-1.1 | business source {l} {v}1 1
busl | busl-1.1 | busl 1 1
polyform | polyform-noncommercial-1.0.0 | polyform noncommercial {l} 1 0 0
polyform | polyform-small-business-1.0.0 | polyform small business {l} 1 0 0
wtfpl | wtfpl-2.0 | wtfpl {v}2(?: 0)?
ogl | ogl-uk-1.0 | (?:uk )?ogl {v}1 0
ogl | ogl-uk-2.0 | (?:uk )?ogl {v}2 0
ogl | ogl-uk-3.0 | (?:uk )?ogl {v}3 0
government | ogl-uk-1.0 | open government {l} {v}1 0
government | ogl-uk-2.0 | open government {l} {v}2 0
government | ogl-uk-3.0 | open government {l} {v}3 0
database | odbl-1.0 | (?:odc )?open database {l} {v}1 0
odbl | odbl-1.0 | odbl {v}1 0
commons | odc-by-1.0 | open data commons attribution {l} {v}1 0
commons | pddl-1.0 | open data commons public domain dedication (?:and|&) {l} {v}1 0
cdla | cdla-permissive-1.0 | cdla permissive 1 0
cdla | cdla-permissive-2.0 | cdla permissive 2 0
cdla | cdla-sharing-1.0 | cdla sharing 1 0
cc0 | cc0-1.0 | (?:cc )?cc0 {v}1 0(?: universal)?
creative | cc0-1.0 | creative commons (?:cc0|zero) {v}1 0(?: universal)?
openrail | openrail-m | (?:bigscience|creativeml|bigcode)? ?openrail(?: m)?(?: v1)?(?: {l})?
"""

#: Creative Commons: short and long words of each licence; each of the versions 1.0 to 4.0 makes a line of priority 1.
CREATIVE = (
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives|ative works)"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nd", "by nd", "attribution no ?deriv(?:s|atives|ative works)"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by", "by", "attribution"),
)
CREATIVE_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Names without a version: priority 3, score 0.7.
NAMES = """
gnu | gpl | gnu (?:general public {l}|gpl)
gpl | gpl | gpl
lesser | lgpl | (?:gnu )?lesser general public {l}
library | lgpl | (?:gnu )?library general public {l}
lgpl | lgpl | (?:gnu )?lgpl
affero | agpl | (?:gnu )?affero general public {l}
agpl | agpl | (?:gnu )?agpl
documentation | gfdl | (?:gnu )?free documentation {l}
apache | apache | apache(?: software)? {l}
mit | mit | mit(?: x11| expat)? {l}
x11 | mit | x11 {l}
expat | mit | expat {l}
bsd | bsd | bsd(?: style| type)? {l}
mozilla | mpl | mozilla public {l}
eclipse | epl | eclipse public {l}
distribution | cddl | common development and distribution {l}
artistic | artistic | (?:perl )?artistic {l}
boost | bsl-1.0 | boost software {l}
isc | isc | isc {l}
zlib | zlib | zlib(?: libpng)? {l}
libpng | libpng | libpng {l}
curl | curl | curl {l}
icu | icu | icu {l}
unicode | unicode | unicode (?:dfs|tou|inc) {l}(?: agreement)?
python | psf | python(?: software foundation)? {l}
postgresql | postgresql | postgresql {l}
php | php | php {l}
ruby | ruby | ruby {l}
openssl | openssl | openssl {l}
ssleay | openssl | (?:original )?ssleay {l}
vim | vim | vim {l}
beerware | beerware | (?:the )?beerware(?: {l})?
beer | beerware | (?:the )?beer ware {l}
json | json | json {l}
unlicense | unlicense | (?:the )?unlicense
wtfpl | wtfpl | wtfpl
fuck | wtfpl | do what the fuck you want to public {l}
european | eupl | european union public {l}
microsoft | ms-pl | microsoft public {l}
microsoft | ms-rl | microsoft reciprocal {l}
sil | ofl | sil open font {l}
government | ogl | open government {l}
database | odbl | open database {l}
academic | afl | academic free {l}
open | osl | open software {l}
apple | apsl | apple public source {l}
latex | lppl | latex project public {l}
zope | zpl | zope public {l}
educational | ecl | educational community {l}
sleepycat | sleepycat | (?:the )?sleepycat {l}
intel | intel | intel open source {l}
freetype | ftl | (?:the )?freetype (?:project )?{l}
imagemagick | imagemagick | imagemagick {l}
w3c | w3c | w3c (?:software (?:notice and )?)?{l}
jpeg | ijg | independent jpeg group {l}
ijg | ijg | ijg {l}
bitstream | bitstream-vera | bitstream vera font {l}
ubuntu | ubuntu-font | ubuntu font {l}
eiffel | eiffel | eiffel forum {l}
condor | condor | condor public {l}
hippocratic | hippocratic | hippocratic {l}
parity | parity | parity public {l}
commons | commons-clause | commons clause(?: {l} condition)?
elastic | elastic | elastic {l}
business | busl | business source {l}
server | sspl | server side public {l}
creative | cc | creative commons {l}
"""

#: Sentences of licence texts, grants and notices: priority 2, score 0.8.
SENTENCES = """
permission | mit | permission is hereby granted free of charge to any person obtaining a copy
permission | mit | the above copyright notice and this permission notice shall be included in all copies
permission | isc | permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
permission | hpnd | permission to use copy modify and distribute this software and its documentation for any purpose
permission | bsl-1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software
permission | ofl | permission is hereby granted free of charge to any person obtaining a copy of the font software
permission | unicode | permission is hereby granted free of charge to any person obtaining a copy of (?:the )?(?:unicode )?data files
permission | gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {l}
permission | verbatim | permission is granted to make and distribute verbatim copies
permission | zlib | permission is granted to anyone to use this software for any purpose including commercial applications
copying | fsf-all-permissive | copying and distribution of this file with or without modification are permitted in any medium
permission | mit-0 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
sublicense | mit | the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
redistribution | bsd | redistribution and use in source and binary forms with or without modification are permitted
redistributions | bsd | redistributions of source code must retain the above copyright notice this list of conditions
redistributions | bsd | redistributions in binary form must reproduce the above copyright notice this list of conditions
endorse | bsd-3-clause | neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse
advertising | bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
misrepresented | zlib | the origin of this software must not be misrepresented
altered | zlib | altered source versions must be plainly marked as such
foundation | gpl | this program is free software you can redistribute it and or modify it under the terms of the gnu general public {l} as published by the free software foundation
foundation | lgpl | this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public {l} as published by the free software foundation
foundation | agpl | under the terms of the gnu affero general public {l} as published by the free software foundation
merchantability | gpl | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser |affero |library )?general public {l}
received | gpl | you should have received a copy of the gnu general public {l}
received | lgpl | you should have received a copy of the gnu (?:lesser|library) general public {l}
received | agpl | you should have received a copy of the gnu affero general public {l}
compliance | apache | you may not use this file except in compliance with the {l}
obtain | apache-2.0 | you may obtain a copy of the {l} at (?:http |https )?(?:www )?apache org {l}s {l} 2 0
unless | apache | unless required by applicable law or agreed to in writing software distributed under the {l} is distributed on an as is basis
asf | apache | licensed to the apache software foundation asf under one or more contributor {l} agreements
subject | mpl | this source code form is subject to the terms of the mozilla public {l}
contents | mpl-1.1 | the contents of this file are subject to the mozilla public {l} version 1 1
accompanying | epl | this program and the accompanying materials are made available under the terms of the eclipse public {l}
contents | cddl | the contents of this file are subject to the terms of (?:either )?(?:the )?(?:gnu general public {l} version 2 only gpl or )?the common development and distribution {l}
boost | bsl-1.0 | distributed under the boost software {l}
unencumbered | unlicense | this is free and unencumbered software released into the public domain
waiving | cc0-1.0 | has dedicated the work to the public domain by waiving all of his or her rights
waived | cc0-1.0 | has waived all (?:of his or her |of their )?(?:copyright|rights)
dedicated | public-domain | dedicated to the public domain
domain | public-domain | (?:released|placed|put) (?:in|into) the public domain
domain | public-domain | (?:is|are) in the public domain
domain | public-domain | public domain
beer | beerware | if we meet some day and you think this stuff is worth it you can buy me a beer
evil | json | the software shall be used for good not evil
copying | artistic | you may charge a reasonable copying fee for any distribution of this package
psf | psf | psf hereby grants (?:individual or organization )?licensee a nonexclusive royalty free world wide {l}
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
cryptographic | openssl | this product includes cryptographic software written by eric young
regents | bsd | copyright (?:c )?(?:[0-9]+ )*the regents of the university of california
jpeg | ijg | this software is based in part on the work of the independent jpeg group
freetype | ftl | portions of this software are copyright (?:c )?(?:[0-9]+ )?the freetype project
creative | cc | this work is licensed under (?:a|the) creative commons
creativecommons | cc | creativecommons org {l}s
summary | cc | this is a human readable summary of and not a substitute for the {l}
noncommercial | non-commercial | for (?:personal and )?noncommercial (?:use|purposes) only
commercial | non-commercial | for (?:personal and )?non commercial (?:use|purposes) only
commercial | non-commercial | may not be used for commercial purposes
internal | internal-use | for internal use only
evaluation | evaluation | for evaluation purposes only
educational | educational-use | for educational (?:use|purposes) only
research | research-use | for (?:academic and )?research (?:use|purposes) only
confidential | proprietary | (?:proprietary and confidential|confidential and proprietary)
unauthorized | proprietary | unauthorized (?:copying|reproduction|distribution|use) (?:[^ ]+ ){0,8}is strictly prohibited
reproduced | proprietary | no part of this (?:publication|book|document|work|file) may be reproduced
trade | proprietary | contains trade secrets
agreement | eula | end user {l} agreement
installing | eula | by installing (?:[^ ]+ ){0,6}you agree to (?:be bound by )?the terms
reserved | all-rights-reserved | all rights reserved
reserved | some-rights-reserved | some rights reserved
reserved | no-rights-reserved | no rights reserved
warranty | warranty-disclaimer | without (?:any )?warranty of any kind
warranties | warranty-disclaimer | without warranties or conditions of any kind
implied | warranty-disclaimer | any express or implied warranties including but not limited to
liable | liability-disclaimer | in no event shall (?:[^ ]+ ){1,12}be liable for any
spdx | spdx-mit | spdx {l} identifier mit
spdx | spdx-apache-2.0 | spdx {l} identifier apache 2 0
spdx | spdx-gpl-2.0-or-later | spdx {l} identifier gpl 2 0 (?:or later|plus)
spdx | spdx-gpl-2.0 | spdx {l} identifier gpl 2 0(?: only)?
spdx | spdx-gpl-3.0-or-later | spdx {l} identifier gpl 3 0 (?:or later|plus)
spdx | spdx-gpl-3.0 | spdx {l} identifier gpl 3 0(?: only)?
spdx | spdx-lgpl-2.1 | spdx {l} identifier lgpl 2 1(?: only| or later)?
spdx | spdx-agpl-3.0 | spdx {l} identifier agpl 3 0(?: only| or later)?
spdx | spdx-bsd-2-clause | spdx {l} identifier bsd 2 clause
spdx | spdx-bsd-3-clause | spdx {l} identifier bsd 3 clause
spdx | spdx-mpl-2.0 | spdx {l} identifier mpl 2 0
spdx | spdx-epl-2.0 | spdx {l} identifier epl 2 0
spdx | spdx-isc | spdx {l} identifier isc
spdx | spdx-cc0-1.0 | spdx {l} identifier cc0 1 0
spdx | spdx | spdx {l} identifier [^ ]+
"""
