"""Operator 6: license scans by sentence rules.

Method: a text is cut into sentences and normalised (case, comment marks, quotes, punctuation, web addresses, white
space); a table of known licence sentences, kept as a tree of words so that a lookup takes as many steps as the sentence
has words, maps each to its identifier; the sequence of identifiers is matched against ordered rules, at each place the
first rule that fits. Other sentences may stand between those of a rule. A notice ("released under the ... license",
"license: ...", a licence's name on a line of its own) is a sentence whose parameter is a list of licence names.

A line break, a semicolon or an abbreviation may end a sentence or stand in one: a known sentence is looked for at the
beginning of every sentence and line, and may run over any of them within its paragraph. The body of a full licence text
runs from its title to its end mark; if the mark is missing its sentences are unknown ones. A sentence that speaks of a
licence but is not known, or that no rule takes, is reported as unknown, never dropped.

A null or empty text has no sentences. Whole texts are read; a text without any of the words that every known sentence
and every unknown licence sentence holds is not cut. Rows that repeat an id are scanned each; other columns are not read.
One narrow pass, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provlake.runtime import bounded_batches, ship

# Licence sentences in normalised form. {a|b}: either; <v>: a version; <x>: up to GAP words; "..." at the
# end: the rest of the sentence may differ.
SENTENCES = [
    ("MITtitle", "{the |}mit license{ mit|}"),
    ("MITperm", "permission is hereby granted free of charge to any person obtaining a copy of this software and {associated documentation files the software|<x>} to deal in the software without restriction ..."),
    ("MITcond", "the above copyright notice and this permission notice {including the next paragraph |}shall be included in all copies or substantial portions of the software"),
    ("MITwarr", "the software is provided as is without warranty of any kind express or implied ..."),
    ("MITliable", "in no event shall the authors or copyright holders be liable for any claim ..."),
    ("ISCtitle", "isc license"),
    ("ISCperm", "permission to use copy modify and {or |}distribute this software {and its documentation |}for any purpose with or without fee is hereby granted ..."),
    ("ISCwarr", "the software is provided as is and {the author|<x>} disclaims all warranties ..."),
    ("ISCliable", "in no event shall {the author|<x>} be liable for any special direct indirect or consequential damages ..."),
    ("ApacheTitle", "apache license version 2.0 january 2004{ url|}"),
    ("ApacheTerms", "terms and conditions for use reproduction and distribution"),
    ("ApacheDefs", "{1 |}definitions license shall mean the terms and conditions for use reproduction and distribution ..."),
    ("ApacheDefs", "license shall mean the terms and conditions for use reproduction and distribution ..."),
    ("EndTerms", "end of terms and conditions"),
    ("ApacheHow", "appendix how to apply the apache license to your work ..."),
    ("ApacheUse", "you may not use this file except in compliance with the license"),
    ("ApacheCopy", "you may obtain a copy of the license at{ url|} ..."),
    ("ApacheDist", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis ..."),
    ("ApacheSee", "see the license for the specific language governing permissions and limitations under the license"),
    ("GPLtitle", "gnu general public license version <v> {june 1991|29 june 2007}"),
    ("LGPLtitle", "gnu {lesser|library} general public license version <v> {june 1991|february 1999|29 june 2007}"),
    ("AGPLtitle", "gnu affero general public license version <v> 19 november 2007"),
    ("GNUverbatim", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("GPL3intro", "{preamble |}the gnu {general|affero general} public license is a free copyleft license for software and other kinds of works ..."),
    ("GPL2intro", "{preamble |}the licenses for most software are designed to take away your freedom to share and change it"),
    ("LGPL3intro", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license ..."),
    ("GPLfree", "{this program|this file|<x>} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version <v> of the license or at your option any later version"),
    ("GPLonly", "{this program|this file|<x>} is free software you can redistribute it and or modify it under the terms of the gnu general public license {version <v> |}as published by the free software foundation{ version <v>|}{ of the license|}"),
    ("GPLuse", "{this program|this library|this file|<x>} is distributed in the hope that it will be useful but without any warranty ..."),
    ("GPLsee", "see the gnu general public license for more details"),
    ("GPLcopy", "you should have received a copy of the gnu general public license along with {this program|<x>} ..."),
    ("LGPLfree", "{this library|this program|<x>} is free software you can redistribute it and or modify it under the terms of the gnu {lesser|library} general public license as published by the free software foundation either version <v> of the license or at your option any later version"),
    ("LGPLonly", "{this library|this program|<x>} is free software you can redistribute it and or modify it under the terms of the gnu {lesser|library} general public license {version <v> |}as published by the free software foundation{ version <v>|}{ of the license|}"),
    ("LGPLsee", "see the gnu {lesser|library} general public license for more details"),
    ("LGPLcopy", "you should have received a copy of the gnu {lesser|library} general public license along with {this library|this program|<x>} ..."),
    ("AGPLfree", "{this program|<x>} is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version <v> of the license or at your option any later version"),
    ("AGPLsee", "see the gnu affero general public license for more details"),
    ("AGPLcopy", "you should have received a copy of the gnu affero general public license along with {this program|<x>} ..."),
    ("FSFwrite", "if not {see url|see|write to the free software foundation} ..."),
    ("MPLlic", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    ("MPLcopy", "if a copy of the mpl was not distributed with this file you can obtain one at ..."),
    ("MPLtitle", "mozilla public license version <v>"),
    ("EPLlic", "{this program|this source code|<x>} and the accompanying materials are made available under the terms of the eclipse public license {v |version |}<v> ..."),
    ("EPLtitle", "eclipse public license {v |version |}<v>"),
    ("EPLterms", "the accompanying program is provided under the terms of this eclipse public license ..."),
    ("EPLaccept", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("BSDredist", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSDsource", "{1 |}redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSDbinary", "{2 |}redistributions in binary form must reproduce the above copyright notice ..."),
    ("BSDads", "{3 |}all advertising materials mentioning features or use of this software must display the following acknowledgement ..."),
    ("BSDname", "{3 |4 |}neither the name of <x> may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDwarr", "this software is provided by {the copyright holders and contributors|the copyright holder and contributors|<x>} as is ..."),
    ("BSDliable", "in no event shall {the copyright holder or contributors|the copyright owner or contributors|<x>} be liable for any direct indirect incidental ..."),
    ("BSLtitle", "boost software license version 1.0{ august 17th 2003|}"),
    ("BSLperm", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license ..."),
    ("BSLcond", "the copyright notices in the software and this entire statement ..."),
    ("BSLwarr", "in no event shall the copyright holders or anyone distributing the software be liable for any damages ..."),
    ("BSLsee", "see accompanying file license 1 0 txt or copy at ..."),
    ("ZlibTitle", "{the |}zlib license"),
    ("ZlibWarr", "this software is provided as is without any express or implied warranty"),
    ("ZlibLiable", "in no event will the {authors|author} be held liable for any damages arising from the use of this software"),
    ("ZlibPerm", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("ZlibOrigin", "{1 |}the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("ZlibThanks", "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"),
    ("ZlibAltered", "{2 |}altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("ZlibNotice", "{3 |}this notice may not be removed or altered from any source distribution"),
    ("Unlicense", "this is free and unencumbered software released into the public domain"),
    ("UnlicenseAny", "anyone is free to copy modify publish use compile sell or distribute this software ..."),
    ("PublicDomain", "{this work|this file|this software|this code|<x>} is {hereby |}{in the public domain|placed in the public domain|released into the public domain|dedicated to the public domain} ..."),
    ("PublicDomain", "released into the public domain"),
    ("CC0", "{this work is |}{licensed under |released under |}cc0{ 1.0|}{ universal|}"),
    ("WTFPL", "do what the fuck you want to public license ..."),
    ("Rights", "all rights reserved"),
]
# Ordered rules; the first whose identifiers follow in the sequence names the licence.
RULES = [
    ("BSD-4-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDads")),
    ("BSD-3-Clause", ("BSDredist", "BSDsource", "BSDbinary", "BSDname")),
    ("BSD-2-Clause", ("BSDredist", "BSDsource", "BSDbinary")),
    ("MIT", ("MITtitle", "MITperm")),
    ("MIT", ("MITperm",)),
    ("MIT", ("MITtitle",)),
    ("ISC", ("ISCtitle", "ISCperm")),
    ("ISC", ("ISCperm",)),
    ("ISC", ("ISCtitle",)),
    ("Apache-2.0", ("ApacheTitle",)),
    ("Apache-2.0", ("ApacheTerms", "ApacheDefs")),
    ("Apache-2.0", ("ApacheDefs",)),
    ("GPL-{v}", ("GPLtitle",)),
    ("LGPL-{v}", ("LGPLtitle",)),
    ("AGPL-{v}", ("AGPLtitle",)),
    ("GPL-{v}-or-later", ("GPLfree",)),
    ("GPL-{v}", ("GPLonly",)),
    ("LGPL-{v}-or-later", ("LGPLfree",)),
    ("LGPL-{v}", ("LGPLonly",)),
    ("AGPL-{v}-or-later", ("AGPLfree",)),
    ("MPL-2.0", ("MPLlic",)),
    ("MPL-{v}", ("MPLtitle",)),
    ("EPL-{v}", ("EPLlic",)),
    ("EPL-{v}", ("EPLtitle",)),
    ("BSL-1.0", ("BSLtitle", "BSLperm")),
    ("BSL-1.0", ("BSLperm",)),
    ("BSL-1.0", ("BSLtitle",)),
    ("Zlib", ("ZlibTitle", "ZlibPerm")),
    ("Zlib", ("ZlibPerm",)),
    ("Zlib", ("ZlibTitle",)),
    ("Unlicense", ("Unlicense",)),
    ("CC0-1.0", ("CC0",)),
    ("LicenseRef-PublicDomain", ("PublicDomain",)),
    ("WTFPL", ("WTFPL",)),
]
#: Sentences that name licences themselves.
NAMING = ("Notice", "SPDX")
# Sentences that may stand with a rule's first one, before it (those that precede it) or after it.
_GNU = ("GNUverbatim", "GPL3intro", "GPL2intro", "LGPL3intro")
_USE = ("GPLuse", "GPLsee", "GPLcopy", "FSFwrite")
WITH = {
    "MITtitle": ("MITperm", "MITcond", "MITwarr", "MITliable"),
    "MITperm": ("MITcond", "MITwarr", "MITliable"),
    "ISCtitle": ("ISCperm", "ISCwarr", "ISCliable"),
    "ISCperm": ("ISCwarr", "ISCliable"),
    "ApacheTitle": ("ApacheTerms", "ApacheDefs", "ApacheHow"),
    "ApacheTerms": ("ApacheHow",),
    "GPLtitle": _GNU,
    "LGPLtitle": _GNU,
    "AGPLtitle": _GNU,
    "GPLfree": _USE,
    "GPLonly": _USE,
    "LGPLfree": (*_USE, "LGPLsee", "LGPLcopy"),
    "LGPLonly": (*_USE, "LGPLsee", "LGPLcopy"),
    "AGPLfree": (*_USE, "AGPLsee", "AGPLcopy"),
    "MPLlic": ("MPLcopy",),
    "EPLtitle": ("EPLterms", "EPLaccept"),
    "BSDredist": ("BSDname", "BSDwarr", "BSDliable"),
    "BSLtitle": ("BSLperm", "BSLcond", "MITwarr", "BSLwarr", "BSLsee"),
    "BSLperm": ("BSLcond", "MITwarr", "BSLwarr"),
    "ZlibTitle": ("ZlibWarr", "ZlibLiable", "ZlibOrigin", "ZlibThanks", "ZlibAltered", "ZlibNotice"),
    "ZlibPerm": ("ZlibOrigin", "ZlibThanks", "ZlibAltered", "ZlibNotice"),
    "Unlicense": ("UnlicenseAny", "MITwarr", "MITliable"),
    "Notice": ("ApacheUse", "ApacheCopy", "ApacheDist", "ApacheSee", "BSLsee", *_USE, "LGPLsee", "LGPLcopy", "AGPLsee", "AGPLcopy"),
}
BEFORE = {"ZlibPerm": ("ZlibWarr", "ZlibLiable")}
#: First sentences of full texts, whose body runs to an end mark.
BODIES = ("ApacheTitle", "ApacheTerms", "ApacheDefs", "GPLtitle", "LGPLtitle", "AGPLtitle", "MPLtitle", "EPLtitle")
# Names of licences in notices, in normalised form, and what they stand for; {v}: the version, and after a
# colon the one meant where none is given.
NAMES = [
    ("{mit|expat}", "MIT"),
    ("x11", "X11"),
    ("isc", "ISC"),
    ("{apache|apache software|asl}", "Apache-{v:2.0}"),
    ("{gpl|gnu gpl|gnu general public|general public}", "GPL-{v}"),
    ("{lgpl|gnu lgpl|gnu lesser general public|gnu library general public|lesser general public}", "LGPL-{v}"),
    ("{agpl|gnu agpl|gnu affero general public|affero general public}", "AGPL-{v}"),
    ("{gfdl|gnu fdl|gnu free documentation}", "GFDL-{v}"),
    ("{mpl|mozilla public}", "MPL-{v}"),
    ("{epl|eclipse public}", "EPL-{v}"),
    ("{cddl|common development and distribution}", "CDDL-{v}"),
    ("{eupl|european union public}", "EUPL-{v}"),
    ("{osl|open software}", "OSL-{v}"),
    ("{afl|academic free}", "AFL-{v}"),
    ("artistic", "Artistic-{v}"),
    ("{2 clause bsd|bsd 2 clause|simplified bsd|freebsd|two clause bsd}", "BSD-2-Clause"),
    ("{3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd|three clause bsd}", "BSD-3-Clause"),
    ("{4 clause bsd|bsd 4 clause|original bsd}", "BSD-4-Clause"),
    ("{0bsd|zero clause bsd|bsd zero clause}", "0BSD"),
    ("bsd", "BSD"),
    ("{zlib|zlib libpng}", "Zlib"),
    ("{boost software|boost|bsl 1.0}", "BSL-1.0"),
    ("{unlicense|the unlicense}", "Unlicense"),
    ("{cc0|cc 0|creative commons zero|creative commons cc0}", "CC0-1.0"),
    ("{cc by|creative commons by|creative commons attribution|cc attribution}", "CC-BY"),
    ("wtfpl", "WTFPL"),
    ("{psf|python software foundation}", "PSF-2.0"),
    ("openssl", "OpenSSL"),
    ("postgresql", "PostgreSQL"),
    ("{ms pl|microsoft public}", "MS-PL"),
    ("{ofl|sil ofl|sil open font|open font}", "OFL-{v:1.1}"),
]
_CC_PARTS = {"nc": "NC", "noncommercial": "NC", "sa": "SA", "sharealike": "SA", "nd": "ND", "noderivatives": "ND", "noderivs": "ND"}
_LEADS = frozenset(
    "licensed released distributed available provided published covered redistributed shared issued offered redistributable relicensed governed".split()
)
_BETWEEN = frozenset("the terms and conditions of a an either both its your choice any following in our new same".split())
_LATER = tuple(
    tuple(x.split()) for x in (
        "or any later version",
        "or at your option any later version",
        "or later version",
        "or later",
        "and later",
        "or newer",
    )
)
#: The most words of <x>; sentences of a rule may stand so many sentences apart.
GAP, APART = 12, 24

# One of these is in every text that holds a licence sentence, whatever the case of its letters.
_NEEDLES = """licen|copyright|©|(c)|permission|redistribut|warrant|public domain|all rights reserved|unencumbered|cc0|
mpl was|gpl|notice shall|notice may|without any|free software|held liable|misrepresented|under the terms|
terms and conditions|wtfpl""".replace("\n", "").split("|")
_SPEAKS = re.compile(
    r"\blicensed? (?:(?:\w+ ){0,3}under|agreement|terms|version|v \d|text)\b|\bunder (?:\w+ ){0,6}licenses?\b|\bpermission (?:\w+ ){0,3}granted\b|"
    r"\bredistribut\w* (?:\w+ ){0,20}(?:permitted|must|allowed)\b|\bwarrant(?:y|ies) of any kind\b|\bexpress or implied warrant|"
    r"\bthis licenses?\b|\bpublic license\b|\bsoftware license\b|\bopen source license\b|\blicense(?:e|d|s|r)? (?:\w+ ){0,6}(?:copyright|redistribut\w*|software|source code)\b|"
    r"\bcopies of (?:this|the) license\b|\bcopyright (?:holder|owner|notice)s?\b|\bfree software foundation\b|\bwithout any warranty\b"
)
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() \t-]+)")
_COPYRIGHT = re.compile(r"(?:copyright|\(c\)|©)\b|©")
_COMMENT = re.compile(r"^[ \t]*(?:(?:[#*;%]+|//+|/\*+|<!--|--+|\"\"\"|'''|rem\b|\.\\\")[ \t]*)+|[ \t]*(?:\*+/|-->)[ \t]*$", re.M | re.I)
_PARAGRAPH = re.compile(r"\n[ \t]*\n")
_URL = re.compile(r"<?\bhttps?://[^\s>)\"']*>?|<?\bwww\.[^\s>)\"']*>?", re.I)
_TOKEN = re.compile(r"\(c\)|©|[0-9]+(?:\.[0-9]+)+|[^\W_]+|[.!?;:]|\n")
_NUMBER = re.compile(r"[0-9]{1,2}(?:\.[0-9]+)*")
_JOINED = re.compile(r"\b(a?l?gpl|gfdl|mpl|epl|cddl|eupl|apache|osl|afl|v|version)[ -]?v?(?=\d)", re.I)


def _expanded(pattern: str) -> Iterator[str]:
    parts = [x[1:-1].split("|") if x[:1] == "{" else [x] for x in re.split(r"(\{[^}]*\})", pattern)]
    for chosen in product(*parts):
        yield " ".join("".join(chosen).split())


def _tree(entries: list[tuple[str, str]]) -> dict:
    """Nested dictionaries by word; under "" what ends there, and whether the rest of the sentence belongs to it."""
    root: dict = {}
    for name, pattern in entries:
        for words in _expanded(pattern):
            node, tail = root, words.endswith("...")
            for w in words.removesuffix("...").split():
                node = node.setdefault(w, {})
            node.setdefault("", (name, tail))
    return root


_KNOWN = _tree(SENTENCES)
_NAMED = _tree([(to, name) for name, to in NAMES])


def normalise(text: str) -> str:
    text = _JOINED.sub(
        lambda m: ("v" if m[1].lower() == "v" else m[1]) + (" " if m[1].lower() in ("v", "version") else " v "),
        _URL.sub(" url ", text),
    )
    return re.sub(r"\blicence", "license", text.lower())


def holds(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _NEEDLES)


class Words:
    """The words of a paragraph, where its sentences and lines begin, and which end which sentence."""

    def __init__(self, paragraph: str):
        self.words: list[str] = []
        self.starts: set[int] = {0}
        ends = []
        source = normalise(paragraph)
        for m in _TOKEN.finditer(source):
            t = m[0]
            if t in ".!?":
                if m.end() == len(source) or source[m.end()] in " \t\n\"')":
                    ends.append(len(self.words))
                    self.starts.add(len(self.words))
            elif t in ";:\n":
                self.starts.add(len(self.words))
            else:
                self.words.append(t)
        self.ends = sorted({e for e in ends if e} | {len(self.words)})

    def sentence_end(self, at: int) -> int:
        return self.ends[bisect_right(self.ends, at)]


def _version(words: list[str], at: int) -> tuple[str, int]:
    """A version at that place, and the place after it."""
    return (words[at], at + 1) if at < len(words) and _NUMBER.fullmatch(words[at]) else ("", at)


Match = tuple[int, str, bool, str]


def _longest(words: list[str], at: int, node: dict = _KNOWN, version: str = "") -> Match | None:
    """(end, identifier, whether the tail belongs, version) of the longest entry that begins there."""
    found: list[Match | None] = [(at, *node[""], version)] if "" in node else []
    if at < len(words) and words[at] in node:
        found.append(_longest(words, at + 1, node[words[at]], version))
    if "<v>" in node:
        v, end = _version(words, at)
        found.append(_longest(words, end, node["<v>"], v) if v else None)
    if after := node.get("<x>"):
        places = [k for k in range(at + 1, min(len(words), at + GAP + 1)) if words[k] in after]
        found += [_longest(words, k, after, version) for k in places]
        if "" in after and at < len(words):
            found.append((at + 1, *after[""], version))
    return max(filter(None, found), key=lambda x: x[0], default=None)


def _name(words: list[str], at: int) -> tuple[str, int] | None:
    """A licence's name at that place and the place after it."""
    while at < len(words) and words[at] in ("the", "a", "an", "either", "license"):
        at += 1
    got = _longest(words, at, _NAMED)
    if got is None:
        return None
    end, to, _, _ = got
    if to == "CC-BY":
        parts, numbers = [], ""
        while end < len(words) and (
            words[end] in _CC_PARTS or words[end] in ("share", "alike", "non", "commercial", "no", "derivatives", "derivs", "license", "by")
        ):
            two = "".join(words[end : end + 2])
            if words[end] in _CC_PARTS or two in _CC_PARTS:
                parts.append(_CC_PARTS[words[end] if words[end] in _CC_PARTS else two])
                end += 1 if words[end] in _CC_PARTS else 2
            else:
                end += 1
        end += end < len(words) and words[end] in ("v", "version")
        numbers, end = _version(words, end)
        while end < len(words) and words[end] in ("international", "unported", "generic", "license"):
            end += 1
        return "-".join(["CC-BY", *parts, *([numbers] if numbers else [])]), end
    version = ""
    for _ in range(2):  # "License, Version 2.0", "2.0 License"
        while end < len(words) and words[end] in ("license", "licenses", "public", "software"):
            end += 1
        if not version:
            shift = end < len(words) and words[end] in ("v", "version")
            version, after = _version(words, end + shift)
            end = after if version else end
    if re.search(r"\{v", to):
        usual = re.search(r"\{v:?([^}]*)\}", to)[1]
        version = version or usual
        to = re.sub(r"-\{v[^}]*\}", f"-{version if '.' in version else version + '.0'}" if version else "", to)
    for words_later in _LATER:
        if tuple(words[end : end + len(words_later)]) == words_later and ("GPL" in to or "GFDL" in to):
            return to + "-or-later", end + len(words_later)
    return to, end


def _names(words: list[str], at: int) -> tuple[str, int] | None:
    """One or more names, joined by "or" or "and", as one expression, and the place after them."""
    got = _name(words, at)
    if got is None:
        return None
    out, end = got
    while end < len(words):
        sign = words[end] if words[end] in ("or", "and") else ""
        more = _name(words, end + 1) if sign else _name(words, end) if words[end] in ("the", "apache", "mit", "gpl", "bsd") else None
        if more is None:
            break
        out, end = f"{out} {(sign or 'or').upper()} {more[0]}", more[1]
    return out, end


def _notice(words: list[str]) -> tuple[str, int] | None:
    """The licences that a sentence names, and where that part of it ends."""
    for k, w in enumerate(words):
        if w == "under" and k and (
            words[k - 1] in _LEADS or words[k - 1] in (
                "only",
                "is",
                "are",
                "and",
                "code",
                "software",
            ) or words[max(0, k - 3) : k] and _LEADS & set(words[max(0, k - 3) : k])
        ):
            at = k + 1
            while at < len(words) and words[at] in _BETWEEN:
                at += 1
            if got := _names(words, at):
                return got
        elif w in ("license", "licenses") and k + 1 < len(words) and (k == 0 or words[k - 1] in ("the", "its", "project")):
            at = k + 1 + (words[k + 1] in ("is", "osi"))
            at += at < len(words) and words[at] == "approved"
            if (got := _names(words, at)) and got[1] >= min(len(words), k + 2):
                return got
        elif w in ("licensed",) and k and (got := _longest(words, k - 1, _NAMED)) and got[0] == k:
            return got[1], k + 1
    # A name alone on its line.
    if len(words) <= 14 and ("license" in words or {"v", "version"} & set(words)):
        got = _names(words, 0)
        if got and got[1] >= len(words) - (words[-1:] == ["url"]):
            return got
    return None


def sentences(paragraph: str) -> list[tuple[str, str]]:
    """(identifier, parameter) of the licence sentences of a paragraph, in order."""
    text = Words(paragraph)
    words, found, at = text.words, [], 0
    starts = sorted(s for s in text.starts if s < len(words))

    def between(a: int, b: int) -> list[int]:
        return starts[bisect_left(starts, a) : bisect_left(starts, b)]

    known: list[tuple[int, int, str, str]] = []
    for s in starts:
        if s >= at and (got := _longest(words, s)):
            end, name, tail, version = got
            if tail:
                stop = text.sentence_end(max(s, end - 1))
                for t in between(end, stop):
                    if _longest(words, t) or _SPEAKS.search(" ".join(words[t:stop])) and _notice(words[t:stop]):
                        stop = t
                        break
                end = max(end, stop)
            known.append((s, end, name, version))
            at = end
    known.append((len(words), len(words), "", ""))
    at = 0
    for s, end, name, version in known:
        # What lies between known sentences, sentence by sentence.
        while at < s:
            stop = min(s, text.sentence_end(at))
            found += _left_over(words, at, stop, between(at + 1, stop))
            at = stop
        if name:
            found.append((name, version))
        at = max(at, end)
    return found


def _left_over(words: list[str], at: int, stop: int, lines: list[int]) -> list[tuple[str, str]]:
    """What an unknown sentence says of licences; its lines and parts are read alone where the whole names none, or only
    later on."""
    part = words[at:stop]
    if (got := _notice(part)) and not any(a - at < got[1] and _SPEAKS.search(" ".join(words[at:a])) for a in lines[:1]):
        rest = part[got[1] :]
        more = _left_over(rest, 0, len(rest), []) if rest and _SPEAKS.search(" ".join(rest)) and _notice(rest) else []
        return [("Notice", got[0]), *more]
    if lines:
        cuts = [at, *lines, stop]
        each = [_left_over(words, a, b, []) for a, b in zip(cuts, cuts[1:])]
        if any(x == "Notice" for part_found in each for x, _ in part_found):
            return [x for part_found in each for x in part_found]
    text = " ".join(part)
    if _COPYRIGHT.match(text):
        return [("Copyright", "")]
    return [("UNKNOWN", "")] if _SPEAKS.search(text) else []


def _label(rule: str, parameters: list[str]) -> str:
    v = next((x for x in parameters if x), "")
    if "{v}" in rule:
        return rule.replace("-{v}", f"-{v if '.' in v else v + '.0'}" if v else "")
    return rule


def by_rules(chain: list[tuple[str, str]]) -> tuple[list[str], int]:
    """Licences in order of their first sentence, and how many sentences no rule took."""
    taken = [name in ("Copyright", "Rights") for name, _ in chain]
    names = []

    def next_of(name: str, after: int, first: str) -> int | None:
        for k in range(after + 1, min(len(chain), after + 1 + APART)):
            if not taken[k] and chain[k][0] == name:
                return k
            if chain[k][0] == first:
                return None
        return None

    for at in range(len(chain)):
        if taken[at]:
            continue
        for rule, wanted in [(chain[at][1], (chain[at][0],))] if chain[at][0] in NAMING else RULES:
            if chain[at][0] != wanted[0]:
                continue
            places = [at]
            while len(places) < len(wanted) and (k := next_of(wanted[len(places)], places[-1], wanted[0])) is not None:
                places.append(k)
            if len(places) < len(wanted):
                continue
            names.append((at, _label(rule, [chain[k][1] for k in places])))
            first = chain[at][0]
            for k in places:
                taken[k] = True
            for name in WITH.get(first, ()):
                if (k := next_of(name, at, first)) is not None:
                    taken[k] = True
            for k in range(max(0, at - APART), at):
                taken[k] = taken[k] or chain[k][0] in BEFORE.get(first, ())
            if first in BODIES:
                end = next((k for k in range(at + 1, len(chain)) if chain[k][0] == "EndTerms"), None)
                for k in range(at + 1, -1 if end is None else end + 1):
                    taken[k] = taken[k] or chain[k][0] in ("UNKNOWN", "EndTerms") or chain[k][0] in BODIES
            break
    return [n for _, n in names], taken.count(False)


def recognise(text: str | None) -> tuple[list[str], list[str], int]:
    """Licences in order, the identifiers of the licence sentences in order, and how many of these no rule took."""
    if not text or not holds(text):
        return [], [], 0
    chain: list[tuple[str, str]] = []
    for paragraph in _PARAGRAPH.split(_COMMENT.sub("", text.replace("\r\n", "\n"))):
        if not holds(paragraph):
            continue
        at = 0
        for m in _SPDX.finditer(paragraph):
            chain += sentences(paragraph[at : m.start()]) if holds(paragraph[at : m.start()]) else []
            chain.append(("SPDX", " ".join(m[1].split()).upper()))
            at = m.end()
        rest = paragraph[at:]
        chain += sentences(rest) if holds(rest) else []
    names, unknown = by_rules(chain)
    return names, [name for name, _ in chain], unknown


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, licenses and sentence_ids (comma-joined, in order), n_sentences and n_unknown of every row."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)

    @F.pandas_udf("licenses string, sentence_ids string, n_sentences long, n_unknown long")
    def scan(texts: pd.Series) -> pd.DataFrame:
        got = [recognise(t) for t in texts]
        rows = [(",".join(n), ",".join(i), len(i), u) for n, i, u in got]
        return pd.DataFrame(rows, columns=["licenses", "sentence_ids", "n_sentences", "n_unknown"])

    return df.select(df[id_col].alias(id_col), scan(df[text_col]).alias("__s")).select(id_col, "__s.*")
