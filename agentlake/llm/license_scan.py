"""License scans: ordered signature rules over the words of a text.

A text is brought to a canonical line of words (lower case, one space between).
Every rule is a regular expression over that line with a keyword; a rule is
only run on lines that contain its keyword. All matches become intervals of
words; then, in the order of the rules' priority, an interval that lies within
another one is suppressed (a name inside a grant sentence inside a licence
text), so overlapping detections resolve to the widest, then the most certain.
Rules with label None only suppress ("not licensed under ...").

All of it is one row-local projection of built-in functions: no shuffle, no
Python, and cost per text, so hot sources and copies need no special care.

Defined results: null and empty texts have no words and no detections; repeated
rows are scanned each on their own; ties are settled by rule order; an empty
table gives an empty result; extra columns are passed through, those named like a
result are replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agentlake.llm.common import ascii_lower

NON_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str | None
    keyword: str
    regex: str
    priority: int  # small wins between equal intervals
    weight: float  # what a detection adds to the certainty that the text is licence text
    base: bool = False  # never suppressed, reported separately
    also: str = ""  # a second keyword, tested first


#: label, keyword, regex of the name over canonical words. Hand-written.
NAMES = (
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?"),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?2(?: 0)?"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e (?:as published by the free software foundation )?(?:either )?v(?:ersion)? ?3(?: 0)?"),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[sc]e(?: v(?:ersion)? ?[23](?: [01])?)?"),
    ("lgpl-2.0", "library general", r"(?:gnu )?library general public licen[sc]e(?: v(?:ersion)? ?2(?: 0)?)?"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: v(?:ersion)? ?1(?: [123])?)?"),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e v(?:ersion)? ?1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e(?: v(?:ersion)? ?2(?: 0)?)?"),
    ("mit", "mit ", r"mit (?:x11 )?licen[sc]e"),
    ("x11", "x11", r"x11 licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|simplified bsd|freebsd)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|original bsd)(?: licen[sc]e)?"),
    ("bsd", "bsd", r"bsd(?: style)? licen[sc]e"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e v(?:ersion)? ?1 [01]"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?: v(?:ersion)? ?2(?: 0)?)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e(?: v(?:ersion)? ?[12](?: 0)?)?"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("cddl", "common development", r"common development and distribution licen[sc]e(?: v(?:ersion)? ?1(?: [01])?)?"),
    ("cpl", "common public", r"common public licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("isc", "isc", r"isc licen[sc]e"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", r"libpng licen[sc]e(?: v(?:ersion)? ?2)?"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("artistic", "artistic", r"artistic licen[sc]e(?: v(?:ersion)? ?[12](?: 0)?)?"),
    ("perl", "perl", r"same terms as perl(?: itself)?"),
    ("psf", "python", r"python software foundation licen[sc]e(?: v(?:ersion)? ?2)?"),
    ("php", "php", r"php licen[sc]e(?: v(?:ersion)? ?3(?: 0[01]?)?)?"),
    ("ruby", "ruby", r"ruby licen[sc]e"),
    ("unlicense", "unlicen", r"the unlicen[sc]e"),
    ("wtfpl", "wtfpl", r"wtfpl(?: v(?:ersion)? ?2)?"),
    ("openssl", "openssl", r"openssl licen[sc]e"),
    ("ofl-1.1", "open font", r"(?:sil )?open font licen[sc]e(?: v(?:ersion)? ?1(?: 1)?)?"),
    ("eupl", "european union", r"european union public licen[sc]e(?: v(?:ersion)? ?1(?: [12])?)?"),
    ("cecill", "cecill", r"cecill(?: [abc])?(?: licen[sc]e)?"),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e"),
    ("afl-3.0", "academic free", r"academic free licen[sc]e(?: v(?:ersion)? ?[123](?: [01])?)?"),
    ("osl-3.0", "open software", r"open software licen[sc]e(?: v(?:ersion)? ?[123](?: [01])?)?"),
    ("ecl-2.0", "educational", r"educational community licen[sc]e(?: v(?:ersion)? ?2(?: 0)?)?"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e"),
    ("upl-1.0", "universal", r"universal permissive licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("qpl", "q public", r"q public licen[sc]e"),
    ("odbl", "open database", r"open database licen[sc]e"),
    ("odc-by", "open data", r"open data commons attribution licen[sc]e"),
    ("pddl", "public domain", r"public domain dedication and licen[sc]e"),
    ("cc0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "noncommercial", r"attribution non ?commercial no ?deriv(?:ative)?s(?: [1234] 0)?"),
    ("cc-by-nc-sa", "noncommercial", r"attribution non ?commercial share ?alike(?: [1234] 0)?"),
    ("cc-by-nc", "noncommercial", r"(?:creative commons )?attribution non ?commercial(?: [1234] 0)?"),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1234] 0)?"),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1234] 0)?"),
    ("creative-commons", "creative commons", r"creative commons(?: attribution)?(?: [1234] 0)?(?: international| unported)?(?: licen[sc]e)?"),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?: v(?:ersion)? ?2(?: 0)?)?"),
    ("sspl", "server side", r"server side public licen[sc]e(?: v(?:ersion)? ?1)?"),
    ("busl-1.1", "business source", r"business source licen[sc]e(?: v(?:ersion)? ?1(?: 1)?)?"),
    ("openrail", "openrail", r"(?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?"),
    ("llama", "llama", r"llama [23](?: [0-9])? community licen[sc]e"),
)

#: Further licences, one hand-written rule each: label, keyword, regex. All hold the word itself, so they are only
#: looked at in texts that have it.
MORE_NAMES = (
    ("aal", "attribution assurance", r"attribution assurance licen[sc]e"),
    ("abstyles", "abstyles", r"abstyles licen[sc]e"),
    ("adobe-source", "adobe systems", r"adobe systems incorporated (?:open )?source code licen[sc]e(?: agreement)?"),
    ("adsl", "amazon digital", r"amazon digital services licen[sc]e"),
    ("aladdin", "aladdin", r"aladdin free public licen[sc]e"),
    ("aml", "apple mit", r"apple mit licen[sc]e"),
    ("apafml", "adobe postscript", r"adobe postscript afm licen[sc]e"),
    ("apl-1.0", "adaptive public", r"adaptive public licen[sc]e"),
    ("apsl", "apple public source", r"apple public source licen[sc]e(?: v(?:ersion)? ?[12](?: [012])?)?"),
    ("beerware", "beer", r"(?:the )?beer ?ware licen[sc]e(?: revision 42)?"),
    ("bittorrent", "bittorrent", r"bittorrent open source licen[sc]e(?: v(?:ersion)? ?1(?: [01])?)?"),
    ("blueoak", "blue oak", r"blue oak model licen[sc]e(?: 1 0 0)?"),
    ("bzip2", "bzip2", r"bzip2 and libbzip2 licen[sc]e"),
    ("cal-1.0", "cryptographic autonomy", r"cryptographic autonomy licen[sc]e"),
    ("caldera", "caldera", r"caldera licen[sc]e"),
    ("catosl", "computer associates", r"computer associates trusted open source licen[sc]e"),
    ("cdla", "community data", r"community data licen[sc]e(?: agreement)?(?: permissive| sharing)?"),
    ("cern-ohl", "cern open hardware", r"cern open hardware licen[sc]e(?: v(?:ersion)? ?[12](?: [012])?)?"),
    ("clartistic", "clarified artistic", r"clarified artistic licen[sc]e"),
    ("cnri-python", "cnri", r"cnri (?:python|jython) (?:open source )?licen[sc]e(?: agreement)?"),
    ("condor", "condor", r"condor public licen[sc]e"),
    ("cpal-1.0", "public attribution", r"common public attribution licen[sc]e"),
    ("cpol", "code project", r"(?:the )?code project open licen[sc]e"),
    ("crossword", "crossword", r"crossword licen[sc]e"),
    ("cua-opl", "cua office", r"cua office public licen[sc]e"),
    ("curl", "curl licen", r"curl licen[sc]e"),
    ("doc", "doc software", r"doc software licen[sc]e"),
    ("drl-1.0", "detection rule", r"detection rule licen[sc]e"),
    ("ecos", "ecos licen", r"ecos licen[sc]e"),
    ("efl", "eiffel forum", r"eiffel forum licen[sc]e(?: v(?:ersion)? ?[12])?"),
    ("egenix", "egenix", r"egenix com public licen[sc]e(?: agreement)?"),
    ("entessa", "entessa", r"entessa public licen[sc]e"),
    ("erlpl", "erlang", r"erlang public licen[sc]e"),
    ("etalab", "licence ouverte", r"licence ouverte(?: open licen[sc]e)?(?: v(?:ersion)? ?[12](?: 0)?)?"),
    ("eudatagrid", "datagrid", r"eu datagrid software licen[sc]e"),
    ("fair", "fair licen", r"fair licen[sc]e"),
    ("frameworx", "frameworx", r"frameworx open licen[sc]e"),
    ("free-art", "free art", r"free art licen[sc]e(?: v(?:ersion)? ?1(?: [123])?)?"),
    ("freeimage", "freeimage", r"freeimage public licen[sc]e"),
    ("ftl", "freetype", r"freetype (?:project )?licen[sc]e"),
    ("gl2ps", "gl2ps", r"gl2ps licen[sc]e"),
    ("glide", "3dfx", r"3dfx glide (?:source code general public )?licen[sc]e"),
    ("gsoap", "gsoap", r"gsoap public licen[sc]e"),
    ("gust-font", "gust font", r"gust font licen[sc]e"),
    ("hippocratic", "hippocratic", r"hippocratic licen[sc]e(?: v(?:ersion)? ?[23](?: [01])?)?"),
    ("icu", "icu licen", r"icu licen[sc]e"),
    ("ijg", "independent jpeg", r"independent jpeg group licen[sc]e"),
    ("imagemagick", "imagemagick", r"imagemagick licen[sc]e"),
    ("info-zip", "info zip", r"info zip licen[sc]e"),
    ("intel", "intel open source", r"intel open source licen[sc]e"),
    ("interbase", "interbase", r"interbase public licen[sc]e"),
    ("ipa-font", "ipa font", r"ipa font licen[sc]e(?: agreement)?"),
    ("ipl-1.0", "ibm public", r"ibm public licen[sc]e"),
    ("jasper", "jasper", r"jasper licen[sc]e(?: version 2 0)?"),
    ("jpnic", "jpnic", r"jpnic (?:idn )?licen[sc]e"),
    ("json", "json licen", r"json licen[sc]e"),
    ("kicad", "kicad", r"kicad libraries licen[sc]e"),
    ("latex2e", "latex2e", r"latex2e licen[sc]e"),
    ("leptonica", "leptonica", r"leptonica licen[sc]e"),
    ("liliq", "quebec", r"(?:licence libre du quebec|quebec free and open source licen[sc]e)"),
    ("lpl", "lucent", r"lucent public licen[sc]e(?: v(?:ersion)? ?1(?: 0[0-9]*)?)?"),
    ("lppl", "latex project", r"latex project public licen[sc]e(?: v(?:ersion)? ?1(?: [0-3][abc]?)?)?"),
    ("makeindex", "makeindex", r"makeindex licen[sc]e"),
    ("miros", "miros", r"miros licen[sc]e"),
    ("motosoto", "motosoto", r"motosoto (?:open source )?licen[sc]e"),
    ("mpich2", "mpich2", r"mpich2 licen[sc]e"),
    ("mulan", "mulan", r"mulan (?:permissive software|public) licen[sc]e(?: v(?:ersion)? ?[12])?"),
    ("multics", "multics", r"multics licen[sc]e"),
    ("naumen", "naumen", r"naumen public licen[sc]e"),
    ("net-snmp", "net snmp", r"net snmp licen[sc]e"),
    ("netcdf", "netcdf", r"netcdf licen[sc]e"),
    ("newsletr", "newsletr", r"newsletr licen[sc]e"),
    ("ngpl", "nethack", r"nethack general public licen[sc]e"),
    ("nlod", "norwegian", r"norwegian licen[sc]e for open government data"),
    ("nokia", "nokia", r"nokia open source licen[sc]e"),
    ("nosl", "netizen", r"netizen open source licen[sc]e"),
    ("npl", "netscape", r"netscape public licen[sc]e(?: v(?:ersion)? ?1(?: [01])?)?"),
    ("nposl-3.0", "non profit", r"non profit open software licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?"),
    ("ntp", "ntp licen", r"ntp licen[sc]e"),
    ("oclc", "oclc", r"oclc research public licen[sc]e"),
    ("ogl", "open government", r"open government licen[sc]e(?: v(?:ersion)? ?[123](?: 0)?)?"),
    ("oldap", "openldap", r"openldap public licen[sc]e(?: v(?:ersion)? ?[12](?: [0-9])?)?"),
    ("omniorb", "omniorb", r"omniorb licen[sc]e"),
    ("open-content", "opencontent", r"opencontent licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("opl", "open public licen", r"open public licen[sc]e"),
    ("opubl", "open publication", r"open publication licen[sc]e(?: v(?:ersion)? ?1(?: 0)?)?"),
    ("oset", "oset", r"oset public licen[sc]e"),
    ("parity", "parity public", r"parity public licen[sc]e(?: [67] 0 0)?"),
    ("phorum", "phorum", r"phorum licen[sc]e"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|free trial|internal use) licen[sc]e(?: 1 0 [01])?"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e"),
    ("prosperity", "prosperity", r"prosperity public licen[sc]e(?: 3 0 0)?"),
    ("qhull", "qhull", r"qhull licen[sc]e"),
    ("ricoh", "ricoh", r"ricoh source code public licen[sc]e"),
    ("rpl", "reciprocal public", r"reciprocal public licen[sc]e(?: v(?:ersion)? ?1(?: [15])?)?"),
    ("rpsl", "realnetworks", r"realnetworks public source licen[sc]e"),
    ("rsa-md", "rsa message", r"rsa message digest licen[sc]e"),
    ("saxpath", "saxpath", r"saxpath licen[sc]e"),
    ("sendmail", "sendmail", r"sendmail (?:open source )?licen[sc]e"),
    ("sgi-b", "sgi free", r"sgi free software licen[sc]e b(?: version [12](?: [01])?)?"),
    ("shareware", "shareware", r"shareware licen[sc]e"),
    ("simpl-2.0", "simple public", r"simple public licen[sc]e"),
    ("sissl", "sun industry", r"sun industry standards source licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat (?:public )?licen[sc]e"),
    ("snia", "snia", r"snia public licen[sc]e"),
    ("spl-1.0", "sun public", r"sun public licen[sc]e"),
    ("swig", "swig licen", r"swig licen[sc]e"),
    ("tapr-ohl", "tapr", r"tapr open hardware licen[sc]e"),
    ("tcl", "tcl tk", r"tcl tk licen[sc]e"),
    ("tmate", "tmate", r"tmate open source licen[sc]e"),
    ("torque", "torque", r"torque (?:v2 5 )?software licen[sc]e"),
    ("ucl-1.0", "upstream compatibility", r"upstream compatibility licen[sc]e"),
    ("unicode", "unicode", r"unicode (?:inc )?licen[sc]e(?: agreement)?(?: v3)?"),
    ("vim", "vim licen", r"vim licen[sc]e"),
    ("vostrom", "vostrom", r"vostrom public licen[sc]e"),
    ("vsl-1.0", "vovida", r"vovida software licen[sc]e"),
    ("w3c", "w3c", r"w3c software (?:notice and )?licen[sc]e"),
    ("watcom", "watcom", r"(?:sybase )?open watcom public licen[sc]e"),
    ("wxwindows", "wxwindows", r"wxwindows library licen[sc]e"),
    ("xfree86", "xfree86", r"xfree86 licen[sc]e(?: 1 [01])?"),
    ("xnet", "x net", r"x net licen[sc]e"),
    ("ypl", "yahoo", r"yahoo public licen[sc]e(?: v(?:ersion)? ?1(?: [01])?)?"),
    ("zed", "zed licen", r"zed licen[sc]e"),
    ("zend", "zend", r"zend (?:engine )?licen[sc]e(?: version 2 00)?"),
    ("zimbra", "zimbra", r"zimbra public licen[sc]e(?: v(?:ersion)? ?1(?: [34])?)?"),
    ("zpl", "zope", r"zope public licen[sc]e(?: v(?:ersion)? ?[12](?: [01])?)?"),
)

#: Forms in which any of the names of ``NAMES`` may stand: a wider interval, a smaller priority number.
FORMS = (
    ("grant", r"(?:this (?:work|software|program|file|text|page|document|content|data ?set) is )?(?:dual )?(?:licen[sc]ed|released|distributed|available|published|provided|made available|redistributed)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?{name}", 1, 0.9),
    ("conditions", r"(?:terms|conditions|provisions) (?:and conditions )?of (?:the )?{name}", 2, 0.7),
    ("notice", r"(?:see|read|view) (?:the )?{name}(?: for (?:more )?details)?", 3, 0.5),
    ("name", r"{name}", 5, 0.6),
)

#: Hand-written rules that are no licence names: notices, tags, clauses, links.
OTHERS = (
    Rule("spdx", "spdx", r"spdx licen[sc]e identifier(?: [a-z0-9]+)(?: [0-9]+){0,2}(?: (?:only|or later))?", 0, 0.95),
    Rule("spdx", "spdx", r"spdx filecopyrighttext(?: [0-9]{4})?", 0, 0.8),
    Rule("cc-by-sa", "cc by", r"cc by sa(?: [1234] 0)?", 1, 0.8),
    Rule("cc-by-nc", "cc by", r"cc by nc(?: [1234] 0)?", 1, 0.8),
    Rule("cc-by-nd", "cc by", r"cc by nd(?: [1234] 0)?", 1, 0.8),
    Rule("cc-by-nc-sa", "cc by", r"cc by nc sa(?: [1234] 0)?", 1, 0.8),
    Rule("cc-by-nc-nd", "cc by", r"cc by nc nd(?: [1234] 0)?", 1, 0.8),
    Rule("cc-by-versioned", "cc by", r"cc by [1234] 0(?: international| unported)?", 1, 0.85),
    Rule("cc-link", "creativecommons", r"creativecommons org licen[sc]es by(?: nc)?(?: nd| sa)?(?: [1234] 0)?", 1, 0.9),
    Rule("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?", 1, 0.9),
    Rule("gnu-link", "gnu", r"(?:www )?gnu org licen[sc]es(?: [a-z0-9]+)?", 1, 0.9),
    Rule("apache-2.0", "apache", r"(?:www )?apache org licen[sc]es(?: licen[sc]e 2 0)?", 1, 0.9),
    Rule("mit", "opensource", r"(?:www )?opensource org licen[sc]es mit", 1, 0.9),
    Rule("osi-link", "opensource", r"(?:www )?opensource org licen[sc]es [a-z0-9]+", 2, 0.8),
    Rule("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0, 0.98),
    Rule("isc", "permission", r"permission to use copy modify and or distribute this software", 0, 0.95),
    Rule("bsd", "redistribution", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?", 0, 0.98),
    Rule("bsd-clause", "redistributions", r"redistributions (?:of source code|in binary form) must (?:retain|reproduce) the above copyright notice", 1, 0.9),
    Rule("bsd-clause", "endorse", r"neither the name of (?:[^ ]+ ){1,12}?may be used to endorse or promote products", 1, 0.9),
    Rule("warranty", "warrant", r"without warrant(?:y|ies)(?: or conditions)? of any kind", 2, 0.6),
    Rule("warranty", "warrant", r"(?:software|work) is provided (?:by the copyright holders )?as is(?: without warranty of any kind)?", 1, 0.8),
    Rule("warranty", "merchantability", r"(?:implied )?warranty of merchantability(?: or fitness for a particular purpose)?", 2, 0.7),
    Rule("warranty", "merchantability", r"merchantability (?:and |or )?fitness for a particular purpose", 3, 0.7),
    Rule("liability", "liab", r"in no event (?:shall|will) (?:the )?(?:[^ ]+ ){1,10}?be liable", 2, 0.7),
    Rule("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser |affero )?general public licen[sc]e", 0, 0.98),
    Rule("gpl", "gpl", r"gpl ?v?[23](?: 0)?(?: or later| only)?", 2, 0.6),
    Rule("gpl", "gnu", r"gnu (?:l|a)?gpl", 2, 0.6),
    Rule("lgpl", "lgpl", r"lgpl ?v?[23](?: [01])?(?: or later| only)?", 2, 0.6),
    Rule("agpl-3.0", "agpl", r"agpl ?v?3(?: 0)?(?: or later| only)?", 2, 0.6),
    Rule("bsd", "bsd", r"bsd (?:[234] clause )?licen[sc]ed", 3, 0.6),
    Rule("mit", "mit ", r"mit licen[sc]ed", 3, 0.6),
    Rule("copyright", "copyright", r"copyright(?: c)?(?: [0-9]{4})+(?: by)?", 3, 0.5),
    Rule("copyright", "copyright", r"copyright (?:holders?|owners?|notice)", 4, 0.4),
    Rule("copyright", "copyright", r"all copyrights? (?:are )?reserved", 3, 0.6),
    Rule("rights-statement", "rights reserved", r"(?:all|some|no) rights reserved(?: worldwide)?(?: unless otherwise (?:noted|stated))?", 4, 0.5),
    Rule("rights-statement", "without permission", r"(?:may not be )?(?:reproduced|copied|distributed|used)(?: or (?:reproduced|copied|distributed|used|transmitted))* without (?:prior )?(?:written )?permission", 2, 0.7),
    Rule("public-domain", "public domain", r"(?:released (?:in)?to|dedicated to|placed in|is in|in) the public domain", 2, 0.8),
    Rule("public-domain", "unencumbered", r"free and unencumbered software released into the public domain", 0, 0.98),
    Rule("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)(?: information)?", 2, 0.6),
    Rule("proprietary", "proprietary", r"proprietary licen[sc]e", 3, 0.6),
    Rule("commercial", "commercial", r"(?:commercial|enterprise) licen[sc]e(?: agreement)?", 4, 0.4),
    Rule("noncommercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes) only", 3, 0.6),
    Rule("eula", "end user", r"end user licen[sc]e agreement", 2, 0.8),
    Rule("trademark", "trademark", r"(?:registered )?trademarks? of(?: the)?(?: [^ ]+){1,3}", 5, 0.2),
    Rule("terms-of-use", "terms of", r"terms of (?:use|service)", 5, 0.2),
    Rule("licence-file", "licen", r"see (?:the )?(?:accompanying )?licen[sc]e(?: (?:file|txt|md))?(?: for (?:more )?(?:details|information))?", 4, 0.5),
    Rule(None, "licen", r"(?:not|never|isn t|no longer) (?:licen[sc]ed|released|available|distributed) under(?: the| a| an)?(?: [^ ]+){1,5}? licen[sc]e", -1, 0.0),
    Rule(None, "licen", r"(?:driving|driver s|drivers|marriage|fishing|hunting|gun|liquor|poetic) licen[sc]es?", -1, 0.0),
)

#: The phrases whose places are counted and whose labels always stay.
BASE = (
    Rule("cc-by", "cc by", "cc by", 9, 0.5, True),
    Rule("gpl", "general public license", "general public license", 9, 0.5, True),
    Rule("reserved", "all rights reserved", "all rights reserved", 9, 0.3, True),
)

RULES = (*OTHERS, *(Rule(label, kw, form.replace("{name}", f"(?:{name})"), prio, weight) for _, form, prio, weight in FORMS for label, kw, name in NAMES),
         *(Rule(label, kw, name, 5, 0.6, also="licen") for label, kw, name in MORE_NAMES), *BASE)

SPAN = "array<struct<start:long,stop:long,priority:int,rule:int,label:string,weight:double,base:boolean>>"


def canonical(text) -> Column:
    """' w0 w1 ... ' (a single space if there are no words)."""
    line = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, " "))
    return F.when(line == "", " ").otherwise(F.concat(F.lit(" "), line, F.lit(" ")))


def _spaces(s: Column) -> Column:
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _matches(line: Column, rule: Column) -> Column:
    """Intervals [start, stop) of words. Between matches the line is cut into
    pieces that begin and end with a space, so words are counted by spaces."""
    found = F.regexp_extract_all(line, rule["regex"], F.lit(0))
    pieces = F.split(line, rule["regex"], -1)

    def step(acc: Column, pair: Column) -> Column:
        start = acc["at"] + _spaces(pair["piece"]) - 1
        stop = start + _spaces(pair["match"]) + 1
        span = F.struct(start.alias("start"), stop.alias("stop"), rule["priority"].alias("priority"), rule["rule"].alias("rule"),
                        rule["label"].alias("label"), rule["weight"].alias("weight"), rule["base"].alias("base"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    # zip stops at the last match: the piece after it holds no further start
    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))
    return F.aggregate(pairs, zero, step, lambda acc: acc["spans"])


def _suppress(spans: Column) -> Column:
    """Spans that lie within no other, widest first, then by priority and rule
    order. After sorting, a span lies within an earlier one exactly if the
    furthest stop so far reaches its own: one pass."""
    wide_first = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["stop"]).alias("b"), s["priority"].alias("c"), s["rule"].alias("d"), s.alias("s"))))

    def step(acc: Column, x: Column) -> Column:
        s = x["s"]
        free = s["stop"] > acc["upto"]
        return F.struct(F.greatest(acc["upto"], s["stop"]).alias("upto"),
                        F.when(free, F.concat(acc["kept"], F.array(s))).otherwise(acc["kept"]).alias("kept"))

    zero = F.struct(F.lit(-1).cast("long").alias("upto"), F.array().cast(SPAN).alias("kept"))
    return F.aggregate(wide_first, zero, step, lambda acc: acc["kept"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds n_words, base (all base detections) and detections (what suppression
    leaves of the others, without pure suppressors), each an array of SPAN."""
    keywords = sorted({(r.also, r.keyword) for r in rules})
    table = F.array(*[F.struct(F.lit(keywords.index((r.also, r.keyword))).alias("keyword"), F.lit(f"(?<= )(?:{r.regex})(?= )").alias("regex"), F.lit(r.priority).alias("priority"),
                               F.lit(i).alias("rule"), F.lit(r.label).cast("string").alias("label"), F.lit(r.weight).alias("weight"), F.lit(r.base).alias("base"))
                      for i, r in enumerate(rules)])
    cols = [c for c in docs.columns if c.lower() not in ("n_words", "base", "detections")]
    out = docs.select(*cols).withColumn("__line", canonical(F.col(text)))
    firsts = {a: F.contains("__line", F.lit(a)) for a in sorted({a for a, _ in keywords if a})}
    out = out.withColumns({f"__has_{i}": has for i, has in enumerate(firsts.values())})
    has = {a: F.col(f"__has_{i}") for i, a in enumerate(firsts)}
    # a keyword beside another is looked for only where that one stands
    held = [F.contains("__line", F.lit(k)) if not a else F.when(has[a], F.contains("__line", F.lit(k))) for a, k in keywords]
    out = out.withColumn("__found", F.array_compact(F.array(*[F.when(h, F.lit(i)) for i, h in enumerate(held)])))
    spans = F.flatten(F.transform(F.filter(table, lambda r: F.array_contains(F.col("__found"), r["keyword"])), lambda r: _matches(F.col("__line"), r)))
    none = F.array().cast(SPAN)
    out = out.withColumn("__spans", F.when(F.size("__found") > 0, spans).otherwise(none))
    rest = F.filter("__spans", lambda s: ~s["base"])
    return out.select(*cols, F.greatest(_spaces(F.col("__line")) - 1, F.lit(0).cast("long")).alias("n_words"),
                      F.filter("__spans", lambda s: s["base"]).alias("base"),
                      F.filter(_suppress(rest), lambda s: s["label"].isNotNull()).alias("detections"))


def score(base: Column, detections: Column) -> Column:
    """0 without detections; else the strongest weight, raised a little by every further label."""
    every = F.concat(base, detections)
    labels = F.size(F.array_distinct(F.transform(every, lambda s: s["label"])))
    top = F.coalesce(F.array_max(F.transform(every, lambda s: s["weight"])), F.lit(0.0))
    return F.least(F.lit(1.0), top + F.greatest(labels - 1, F.lit(0)) * 0.02)
