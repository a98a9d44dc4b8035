"""The signature rules of the licence scan: hand-written patterns over words, put together from licences and sentence shapes.

A pattern is a regular expression over lower-case words with one space between two of them: `(the )?` is a word that may be
there, `[^:]+` is any one word. `gate` is a word that stands in every match: a text without it is not searched for the rule.
"""

from __future__ import annotations

from typing import NamedTuple

ANY = "[^:]+"


class Rule(NamedTuple):
    rule_id: str
    label: str
    priority: int        # 1 is the most telling
    confidence: float
    gate: str
    pattern: str


def _v(number: str) -> str:
    """A version as it is written: `version 2 0`, `v 2`, `v2`, `2 0`; a final zero may be missing."""
    major, *rest = number.split(" ")
    minor = "".join(f" {r}" if r != "0" else "( 0)?" for r in rest) or "( 0)?"
    return f"(version |ver |v )?v?{major}{minor}"


_LESSER, _GPL, _AFFERO = "(gnu )?(lesser|library) general public licen[cs]e", "(gnu )?general public licen[cs]e", "(gnu )?affero general public licen[cs]e"
_OR_LATER = "( or (any )?later( version)?)?"
_CC = "(creative commons|cc) "
_BY, _SA, _NC, _ND = "(attribution|by)", "(share ?alike|sa)", "(non ?commercial|nc)", "(no ?deriv(ative)?s|nd)"

# label; gate; words of the short identifier; words of the full name; words of an address, if any
LICENCES = (
    ("mit", "mit", "mit( license)?", "mit licen[cs]e", "opensource org licenses mit"),
    ("mit", "expat", "expat", "expat licen[cs]e", ""),
    ("x11", "x11", "x11", "x11 licen[cs]e", ""),
    ("isc", "isc", "isc", "isc licen[cs]e", "opensource org licenses isc"),
    ("0bsd", "0bsd", "0bsd", "0bsd( licen[cs]e)?", ""),
    ("bsd", "bsd", "bsd( license)?", "bsd( style| type)? licen[cs]e", "opensource org licenses bsd"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", "((simplified|freebsd) bsd|bsd 2 clause|2 clause bsd|two clause bsd) licen[cs]e", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "((new|modified|revised) bsd|bsd 3 clause|3 clause bsd|three clause bsd) licen[cs]e", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "((original|old) bsd|bsd 4 clause|4 clause bsd) licen[cs]e", ""),
    ("apache", "apache", "apache( license)?", "apache( software)? licen[cs]e", "apache org licenses"),
    ("apache-1.1", "apache", "apache 1 1", f"apache( software)?( licen[cs]e)? {_v('1 1')}", "apache org licenses license 1 1"),
    ("apache-2.0", "apache", "apache 2 0", f"apache( software)?( licen[cs]e)? {_v('2 0')}", "apache org licenses license 2 0"),
    ("gpl", "gpl", "gpl", "gnu gpl|gpl licen[cs]e", "gnu org licenses gpl"),
    ("gpl", "general", "", _GPL, ""),
    ("gpl-1.0", "gpl", "gpl 1 0( only| or later)?", f"(gnu )?gpl {_v('1')}{_OR_LATER}", ""),
    ("gpl-2.0", "gpl", "gpl 2 0( only| or later)?", f"(gnu )?gpl {_v('2')}{_OR_LATER}", "gnu org licenses gpl 2 0"),
    ("gpl-2.0", "general", "", f"{_GPL} {_v('2')}{_OR_LATER}", ""),
    ("gpl-3.0", "gpl", "gpl 3 0( only| or later)?", f"(gnu )?gpl {_v('3')}{_OR_LATER}", "gnu org licenses gpl 3 0"),
    ("gpl-3.0", "general", "", f"{_GPL} {_v('3')}{_OR_LATER}", ""),
    ("lgpl", "lgpl", "lgpl", "gnu lgpl|lgpl licen[cs]e", "gnu org licenses lgpl"),
    ("lgpl", "general", "", _LESSER, ""),
    ("lgpl-2.0", "general", "lgpl 2 0( only| or later)?", f"{_LESSER} {_v('2')}{_OR_LATER}", ""),
    ("lgpl-2.1", "lgpl", "lgpl 2 1( only| or later)?", f"(gnu )?lgpl {_v('2 1')}{_OR_LATER}", "gnu org licenses lgpl 2 1"),
    ("lgpl-2.1", "general", "", f"{_LESSER} {_v('2 1')}{_OR_LATER}", ""),
    ("lgpl-3.0", "lgpl", "lgpl 3 0( only| or later)?", f"(gnu )?lgpl {_v('3')}{_OR_LATER}", "gnu org licenses lgpl 3 0"),
    ("lgpl-3.0", "general", "", f"{_LESSER} {_v('3')}{_OR_LATER}", ""),
    ("agpl-3.0", "agpl", "agpl 3 0( only| or later)?", f"(gnu )?agpl {_v('3')}{_OR_LATER}", "gnu org licenses agpl"),
    ("agpl-3.0", "affero", "", f"{_AFFERO}( {_v('3')})?{_OR_LATER}", ""),
    ("gfdl", "documentation", "gfdl 1 [123]", "(gnu )?free documentation licen[cs]e", "gnu org licenses fdl"),
    ("mpl-1.1", "mozilla", "mpl 1 1", f"mozilla public licen[cs]e {_v('1 1')}", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", "mpl 2 0", f"mozilla public licen[cs]e {_v('2 0')}", "mozilla org mpl 2 0"),
    ("mpl", "mozilla", "mpl", "mozilla public licen[cs]e", "mozilla org mpl"),
    ("epl-1.0", "eclipse", "epl 1 0", f"eclipse public licen[cs]e {_v('1 0')}", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", "epl 2 0", f"eclipse public licen[cs]e {_v('2 0')}", "eclipse org legal epl 2 0"),
    ("epl", "eclipse", "epl", "eclipse public licen[cs]e", ""),
    ("edl", "eclipse", "edl", "eclipse distribution licen[cs]e", ""),
    ("cddl", "development", "cddl 1 [01]", "common development and distribution licen[cs]e", ""),
    ("cpl", "common", "cpl 1 0", "common public licen[cs]e", ""),
    ("ipl", "ibm", "ipl 1 0", "ibm public licen[cs]e", ""),
    ("eupl", "union", "eupl 1 [012]", "european union public licen[cs]e", ""),
    ("artistic", "artistic", "artistic( [12] 0)?", "(the )?artistic licen[cs]e", "opensource org licenses artistic"),
    ("artistic-2.0", "artistic", "artistic 2 0", f"artistic licen[cs]e {_v('2 0')}", ""),
    ("boost", "boost", "bsl 1 0", "boost software licen[cs]e", "boost org license"),
    ("busl", "business", "busl 1 1", "business source licen[cs]e", ""),
    ("sspl", "server", "sspl 1 0", "server side public licen[cs]e", ""),
    ("elastic", "elastic", "elastic 2 0", "elastic licen[cs]e", ""),
    ("zlib", "zlib", "zlib", "zlib( libpng)? licen[cs]e", ""),
    ("libpng", "libpng", "libpng( 2 0)?", "libpng licen[cs]e", ""),
    ("openssl", "openssl", "openssl", "openssl licen[cs]e", ""),
    ("php", "php", "php 3 0[01]?", "php licen[cs]e", ""),
    ("python", "python", "psf 2 0|python 2 0", "python( software foundation)? licen[cs]e", ""),
    ("ruby", "ruby", "ruby", "ruby licen[cs]e", ""),
    ("perl", "perl", "", "same terms as perl( itself)?", ""),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[cs]e", ""),
    ("ofl", "font", "ofl 1 [01]", "(sil )?open font licen[cs]e", "scripts sil org ofl"),
    ("odbl", "database", "odbl 1 0", "open (data commons open )?database licen[cs]e", "opendatacommons org licenses odbl"),
    ("odc-by", "attribution", "odc by 1 0", "open data commons attribution licen[cs]e", "opendatacommons org licenses by"),
    ("unlicense", "unlicense", "unlicense", "the unlicense", "unlicense org"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl", ""),
    ("beerware", "beer", "beerware", "beer ware licen[cs]e", ""),
    ("ms-pl", "microsoft", "ms pl", "microsoft public licen[cs]e", ""),
    ("ms-rl", "microsoft", "ms rl", "microsoft reciprocal licen[cs]e", ""),
    ("ncsa", "illinois", "ncsa", "university of illinois( ncsa)?( open source)? licen[cs]e", ""),
    ("upl", "universal", "upl 1 0", "universal permissive licen[cs]e", ""),
    ("unicode", "unicode", "unicode( dfs)? 201[56]|unicode 3 0", "unicode( inc)? licen[cs]e( agreement)?", ""),
    ("osl", "open", "osl 3 0", "open software licen[cs]e", ""),
    ("afl", "academic", "afl 3 0", "academic free licen[cs]e", ""),
    ("cecill", "cecill", "cecill( [bc]| 2 [01])?", "cecill( [bc])?( free software)? licen[cs]e", ""),
    ("cc0", "cc0", "cc0 1 0", "cc0( 1 0)?( universal)?", "creativecommons org publicdomain zero"),
    ("cc-by", "cc", "cc by( [1234] 0)?", "cc by( [1234] 0)?( licen[cs]e)?", "creativecommons org licenses by"),
    ("cc-by", "creative", "", f"creative commons {_BY}( [1234] 0)?( international)?( licen[cs]e)?", ""),
    ("cc-by-sa", "cc", "cc by sa( [1234] 0)?", "cc by sa( [1234] 0)?", "creativecommons org licenses by sa"),
    ("cc-by-sa", "creative", "", f"{_CC}{_BY} {_SA}( [1234] 0)?", ""),
    ("cc-by-nc", "cc", "cc by nc( [1234] 0)?", "cc by nc( [1234] 0)?", "creativecommons org licenses by nc"),
    ("cc-by-nc", "creative", "", f"{_CC}{_BY} {_NC}( [1234] 0)?", ""),
    ("cc-by-nd", "cc", "cc by nd( [1234] 0)?", "cc by nd( [1234] 0)?", "creativecommons org licenses by nd"),
    ("cc-by-nd", "creative", "", f"{_CC}{_BY} {_ND}( [1234] 0)?", ""),
    ("cc-by-nc-sa", "cc", "cc by nc sa( [1234] 0)?", "cc by nc sa( [1234] 0)?", "creativecommons org licenses by nc sa"),
    ("cc-by-nc-sa", "creative", "", f"{_CC}{_BY} {_NC} {_SA}( [1234] 0)?", ""),
    ("cc-by-nc-nd", "cc", "cc by nc nd( [1234] 0)?", "cc by nc nd( [1234] 0)?", "creativecommons org licenses by nc nd"),
    ("cc-by-nc-nd", "creative", "", f"{_CC}{_BY} {_NC} {_ND}( [1234] 0)?", ""),
    ("creative-commons", "creative", "", "creative commons( public)?( licen[cs]e)?", "creativecommons org"),
)

_TERMS = "(the )?(terms (and conditions )?of )?(the )?(version [0-9]+ of the )?"
_UNDER = "(licen[cs]ed|released|distributed|available|published|provided|covered|governed|redistributed|used|offered|shared)( is| are| as is)? (under|by|with|according to)"

# kind; priority; confidence; which part of a licence; the shape around it
SHAPES = (
    ("tag", 1, 1.0, "short", "spdx licen[cs]e identifier {}"),
    ("notice", 2, 0.95, "name", f"{_UNDER} {_TERMS}({{}})"),
    ("address", 2, 0.9, "address", "{}"),
    ("field", 3, 0.8, "short", "license( is| type| name)? ({})"),
    ("name", 4, 0.6, "name", "{}"),
)

# label; gate; a sentence of the licence itself
SENTENCES = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies"),
    ("isc", "hereby", "permission to use copy modify and or distribute this (software|program|code) for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", f"neither the names? of ({ANY} ){{1,12}}?(may|nor) ({ANY} ){{1,12}}?be used to endorse or promote products"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the licen[cs]e"),
    ("apache-2.0", "warranties", "distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "redistribute", "(this|the) (program|software|file) is free software you can redistribute it and or modify"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "received", "you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", "library", "this library is free software you can redistribute it and or modify"),
    ("lgpl", "received", "you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl-3.0", "received", "you should have received a copy of the gnu affero general public licen[cs]e"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "implied", "this software is provided as is without any express or implied warranty"),
    ("boost", "executable", "machine executable object code generated by a source language processor"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "you just do what the fuck you want to"),
    ("beerware", "beer", "you can buy me a beer in return"),
    ("public-domain", "domain", "(released|placed|dedicated|is) (in|into|to) the public domain"),
    ("cc0", "waived", f"({ANY} )?has waived all copyright and related( or neighboring)? rights"),
    ("ofl", "fonts", "the fonts and derivatives however cannot be released under any other type of licen[cs]e"),
    ("python", "licensee", "psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl", "this product includes software developed by the openssl project"),
    ("bsd-4-clause", "acknowledgement", "must display the following acknowledgement"),
    ("proprietary", "confidential", "(confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "unauthorized", "unauthorized (copying|use|distribution|reproduction) of this (file|software|document|material)"),
    ("proprietary", "prohibited", "(copying|reproduction|distribution) ({0} )?is strictly prohibited".format(ANY)),
    ("eula", "user", "end user licen[cs]e agreement"),
)

# What only says that something is licensed. label; gate; pattern
HINTS = (
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("copyright-notice", "copyright", "copyright (c )?[12][0-9]{3}"),
    ("unknown-license", "licensed", "licensed under"),
    ("unknown-license", "license", "see (the )?license(s)?( txt| md)? file"),
    ("unknown-license", "license", "(open source|free software|public) license"),
)


def _built() -> tuple[Rule, ...]:
    rules = []
    for n, licence in enumerate(LICENCES):
        label, gate, parts = licence[0], licence[1], dict(zip(("short", "name", "address"), licence[2:]))
        for kind, priority, confidence, part, shape in SHAPES:
            if parts[part]:
                # An address and an identifier hold other words than the name: their own gate is a word that the shape needs.
                own = {"tag": "spdx", "address": parts["address"].split(" ")[0], "field": "license"}.get(kind, gate)
                rules.append((kind, f"{n:03d}-{label}", label, priority, confidence, own, shape.format(parts[part])))
    rules += [("text", f"{n:03d}-{label}", label, 2, 0.95, gate, p) for n, (label, gate, p) in enumerate(SENTENCES)]
    rules += [("hint", f"{n:03d}-{label}", label, 5, 0.3, gate, p) for n, (label, gate, p) in enumerate(HINTS)]
    return tuple(Rule(f"{kind}-{name}", label, priority, confidence, gate, f"({pattern})")
                 for kind, name, label, priority, confidence, gate, pattern in rules)


RULES = _built()
