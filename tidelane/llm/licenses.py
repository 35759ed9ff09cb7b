"""License scans by sentences: normalised sentences have identifiers, and rules are ordered lists of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from tidelane.llm.common import rows_to_arrow

#: Sentences of licenses in normal form, by identifier.
SENTENCES = {
    "apache2-obey": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-copy-at": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache2-asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "permit-all": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "permit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "permit-asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-permit": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-permit-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-head": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl2-copy-s": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "epl2-terms": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-asis": "this software is provided as is without any express or implied warranty",
    "zlib-permit": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "bsl1-permit": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "psf-grant": "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation",
}
#: How short notices name a license, by the license's name.
NAMES = {
    "Apache-2.0": ("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache 2 0 license"),
    "MIT": ("mit license",),
    "BSD-2-Clause": ("bsd 2 clause license", "simplified bsd license"),
    "BSD-3-Clause": ("bsd 3 clause license", "new bsd license"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "EPL-2.0": ("eclipse public license 2 0", "eclipse public license version 2 0"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license",),
    "Unlicense": ("unlicense",),
    "PSF-2.0": ("python software foundation license version 2", "psf license agreement"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons by nc 4 0"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons by sa 4 0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons by 4 0"),
    "CC0-1.0": ("cc0 1 0",),
}
#: The licenses of one family, with their versions; each may be followed by "or later".
FAMILIES = {"GPL": ("gnu general public license", ("2", "3")), "LGPL": ("gnu lesser general public license", ("2 1", "3")), "AGPL": ("gnu affero general public license", ("3",))}


def version_of(text: str) -> str:
    return ".".join(text.split()) if " " in text else f"{text}.0"


#: Titles that stand for a license by themselves.
TITLES = {
    "mit license": "title-MIT",
    "mit license mit": "title-MIT",
    "isc license": "title-ISC",
    "apache license version 2 0 january 2004": "title-Apache-2.0",
    "apache license version 2 0 january 2004 http www apache org licenses": "title-Apache-2.0",
    "apache license version 2 0 january 2004 https www apache org licenses": "title-Apache-2.0",
    "boost software license version 1 0": "title-BSL-1.0",
    "boost software license version 1 0 august 17th 2003": "title-BSL-1.0",
    "mozilla public license version 2 0": "title-MPL-2.0",
    "eclipse public license v 2 0": "title-EPL-2.0",
    "bsd 2 clause license": "title-BSD-2-Clause",
    "bsd 3 clause license": "title-BSD-3-Clause",
    "zlib license": "title-Zlib",
    "gnu general public license version 2 june 1991": "title-GPL-2.0-only",
    "gnu general public license version 3 29 june 2007": "title-GPL-3.0-only",
    "gnu lesser general public license version 2 1 february 1999": "title-LGPL-2.1-only",
    "gnu lesser general public license version 3 29 june 2007": "title-LGPL-3.0-only",
    "gnu affero general public license version 3 19 november 2007": "title-AGPL-3.0-only",
}
#: Every known sentence in normal form -> its identifier. An identifier name-X names license X by itself.
TABLE = {text: name.removesuffix("-at").removesuffix("-and").removesuffix("-s") for name, text in SENTENCES.items()} | TITLES
for _license, _names in NAMES.items():
    TABLE |= {f"licensed under {n}": f"name-{_license}" for n in _names}
TABLE |= {"dedicated to public domain under cc0 1 0": "name-CC0-1.0", "under cc0 1 0": "name-CC0-1.0"}
#: SPDX identifiers in normal form -> themselves.
SPDX = {" ".join(re.findall("[a-z0-9]+", n.lower())): n for n in (*NAMES, "ISC", "Python-2.0", "0BSD")}
for _family, (_title, _versions) in FAMILIES.items():
    for _v in _versions:
        _only, _later = f"{_family}-{version_of(_v)}-only", f"{_family}-{version_of(_v)}-or-later"
        for _word in ("version ", "v", ""):
            TABLE[f"licensed under {_title} {_word}{_v}"] = f"name-{_only}"
            TABLE[f"licensed under {_title} {_word}{_v} or later"] = f"name-{_later}"
        for _start in ("this program is free software you can", "you can", "this library is free software you can"):
            _text = f"{_start} redistribute it and or modify it under terms of {_title} as published by the free software foundation either version {_v} of the license or at your option any later version"
            TABLE[_text] = f"free-{_later}"
        _plain = f"{_family.lower()} {' '.join(version_of(_v).split('.'))}"
        SPDX |= {f"{_plain} only": _only, _plain: _only, f"{_plain} or later": _later}
#: A field of a package's description, such as "License: MIT".
TABLE |= {f"license {n}": f"name-{license_}" for n, license_ in SPDX.items()}
#: License -> the lists of identifiers any of which, in that order and with other known sentences between, shows it.
#: An earlier rule takes its sentences before a later one.
RULES = {
    "Apache-2.0": [("name-Apache-2.0", "apache2-obey", "apache2-copy", "apache2-asis"), ("name-Apache-2.0",)],
    "MIT": [("title-MIT", "permit-all", "permit-notice", "permit-asis"), ("permit-all", "permit-notice", "permit-asis"), ("name-MIT",), ("title-MIT",)],
    "BSD-3-Clause": [("bsd-head", "bsd-source", "bsd-binary", "bsd-endorse"), ("name-BSD-3-Clause",)],
    "BSD-2-Clause": [("bsd-head", "bsd-source", "bsd-binary"), ("name-BSD-2-Clause",)],
    "ISC": [("isc-permit",), ("name-ISC",)],
    "MPL-2.0": [("mpl2-subject", "mpl2-copy"), ("mpl2-subject",), ("name-MPL-2.0",)],
    "EPL-2.0": [("epl2-terms",), ("name-EPL-2.0",)],
    "Unlicense": [("unlicense-free", "unlicense-anyone"), ("unlicense-free",), ("name-Unlicense",)],
    "Zlib": [("zlib-asis", "zlib-permit"), ("name-Zlib",)],
    "BSL-1.0": [("bsl1-permit",), ("name-BSL-1.0",)],
    "PSF-2.0": [("psf-grant",), ("name-PSF-2.0",)],
    "Python-2.0": [("name-Python-2.0",)],
    "0BSD": [("name-0BSD",)],
}
for _family, (_title, _versions) in FAMILIES.items():
    for _v in _versions:
        for _end in ("only", "or-later"):
            _name = f"{_family}-{version_of(_v)}-{_end}"
            RULES[_name] = [(f"free-{_name}", "gpl-hope"), (f"free-{_name}",), (f"name-{_name}",)]
RULES |= {n: [(f"name-{n}",)] for n in ("CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC-BY-4.0", "CC0-1.0")} | {"unnamed-bsd": [("bsd-head",)]}
for _name in sorted({n.removeprefix("title-") for n in TITLES.values()} - {"MIT"}):
    RULES[_name].append((f"title-{_name}",))
#: What differs between notices of one kind, and how it is written in normal form.
ONE_FORM = (
    (re.compile(r"^[1-9] (?=redistributions|neither)"), ""),
    (re.compile(r"^this \w+ is (?=licensed|released|distributed|available|dedicated)"), ""),
    (re.compile(r"^(released|distributed|available|provided)(?= under)"), "licensed"),
    (re.compile(r"\b(?:the )?terms of (?:the )?(?=gnu|mit|bsd|apache)|(?<=under )(?:the |a )(?!license)|(?<=to )the (?=public domain)"), ""),
    (re.compile(r"^the (?=mit license)"), ""),
    (re.compile(r"(?<=^neither the name of ).+(?= nor the names of its contributors)"), "holder"),
    (re.compile(r"(?<=modify it )under (?=gnu)"), "under terms of "),
)


def one_form(sentence: str) -> str:
    for pattern, form in ONE_FORM:
        sentence = pattern.sub(form, sentence)
    return sentence


TABLE = {one_form(text): name for text, name in TABLE.items()}
#: Words that known sentences begin with, and the most words that one has beside a holder's name.
FIRST = frozenset(t.split()[0] for t in TABLE) | frozenset("this you it released distributed available provided dedicated the spdx 1 2 3 4".split())
MOST = max(len(t.split()) for t in TABLE) + 14
#: How an SPDX line begins, and what stands before and after a holder's name in its sentence.
SPDX_START = "spdx license identifier".split()
BEFORE, AFTER = "neither the name of".split(), "nor the names of its contributors".split()
#: Every known sentence has one of these words; fragments without one are unknown without being looked up.
CUES = re.compile(r"licen|permi|warrant|redistribut|copyright|public domain|\bcc0\b|merchantab|compliance with|\bmpl\b|anyone is free")
END = re.compile(r"[.!?;](?=\s|$)|:$")
WORDS = re.compile(r"[a-z0-9]+")


def normal(sentence: str) -> str:
    return " ".join(WORDS.findall(sentence.lower()))


def spdx_names(words: list[str]) -> list[str]:
    """Licenses of an expression: at each word the longest known name; what is unknown stands for itself, in lower case."""
    out, unknown, i = [], [], 0

    def close():
        if unknown:
            out.append("-".join(unknown))
            unknown.clear()

    while i < len(words):
        for j in range(min(len(words), i + 8), i, -1):
            if name := SPDX.get(" ".join(words[i:j])):
                close()
                out.append(name)
                i = j
                break
        else:
            if words[i] in ("or", "and", "with"):
                close()
            else:
                unknown.append(words[i])
            i += 1
    close()
    return out


def identify(sentence: str) -> str | None:
    """Identifier of a normalised sentence, or None: what differs is brought to one form, which is looked up."""
    if not CUES.search(sentence):
        return None
    if sentence.startswith("spdx license identifier "):
        names = spdx_names(sentence.split()[3:])
        return f"spdx={'+'.join(names)}" if names else None
    return TABLE.get(one_form(sentence))


def without_holder(words: list[str]) -> list[str]:
    """The beginning of a sentence, with a holder's name of any length cut to one word.

    Until what follows the name has come in full, the last words are kept as they may be its beginning.
    """
    at = next((i for i in (0, 1) if words[i : i + len(BEFORE)] == BEFORE), None)
    if at is None:
        return words
    at += len(BEFORE)
    end = next((i for i in range(at + 1, len(words)) if words[i] == AFTER[0] and words[i : i + len(AFTER)] == AFTER), None)
    if end is None:
        end = max(at + 1, len(words) - len(AFTER) + 1)
    return words[:at] + ["holder"] + words[end:] if end > at + 1 else words


def fragments(text: str):
    """(start, end) of what lies between ends of sentences and of lines, and whether a sentence ends there."""
    start = 0
    for line in text.split("\n"):
        at = start
        for m in END.finditer(line):
            yield at, start + m.start(), True
            at = start + m.end()
        if at < start + len(line):
            yield at, start + len(line), False
        start += len(line) + 1


def known_parts(run: list[tuple[int, int]], text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences in a run of fragments, each one or more whole fragments.

    From the left, the longest known sentence that begins with a fragment is taken; an SPDX line ends with its fragment.
    Nothing is looked for beyond the longest known sentence, but an SPDX line and a holder's name may have any length; a
    name ends at the next "neither the name of", which keeps the work in proportion to the run.
    """
    if not CUES.search(normal(text[run[0][0] : run[-1][1]])):
        return []
    words = [WORDS.findall(text[a:b].lower()) for a, b in run]
    found, i = [], 0
    while i < len(run):
        last = None
        if words[i] and words[i][0] in FIRST:
            so_far = []
            for j in range(i, len(run)):
                if j > i and any(words[j][k : k + len(BEFORE)] == BEFORE for k in (0, 1)):
                    break
                so_far = without_holder(so_far + words[j])
                if len(so_far) > MOST and so_far[: len(SPDX_START)] != SPDX_START:
                    break
                if words[j] and (name := identify(" ".join(so_far))):
                    last = j, name
                    if name.startswith("spdx="):
                        break
                if len(so_far) > MOST:  # an SPDX line without a name
                    break
        if last:
            found.append((run[i][0], run[last[0]][1], last[1]))
            i = last[0]
        i += 1
    return found


def sentences(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of the known sentences; they don't go on after a sentence's end or an empty comment line."""
    if not CUES.search(text.lower()):
        return []
    found, run = [], []
    for a, b, ends in fragments(text):
        if run and not text[a:b].strip(" \t#*/|"):
            found += known_parts(run, text)
            run = []
        run.append((a, b))
        if ends:
            found += known_parts(run, text)
            run = []
    return found + known_parts(run, text) if run else found


def recognise(known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, license): rules in order take the sentences that no earlier rule has taken."""
    left = dict(enumerate(known))
    out = [(a, b, one) for a, b, name in known if name.startswith("spdx=") for one in name[5:].split("+")]
    for license_, rules in RULES.items():
        for rule in rules:
            while True:
                taken, want = [], 0
                for i, s in left.items():
                    if want < len(rule) and s[2] == rule[want]:
                        taken.append(i)
                        want += 1
                if want < len(rule):
                    break
                out.append((known[taken[0]][0], known[taken[-1]][1], license_))
                for i in taken:
                    del left[i]
    return sorted(out)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted, joined by commas), n_sentences (known ones), spans (license:start:end) for each row.

    Licenses have their SPDX names. Offsets are in code points, the end exclusive. Null and empty texts have no license;
    repeated rows and null ids give a row each; a sentence may lie anywhere in a text of any length; an empty table gives
    an empty result. doc_id must be a whole number. Columns of `docs` other than doc_id and text are ignored.
    """

    def run(texts: list[str | None]) -> dict:
        known = [sentences(t or "") for t in texts]
        found = [recognise(k) for k in known]
        return {
            "licenses": [",".join(sorted({s[2] for s in f})) for f in found],
            "n_sentences": [len(k) for k in known],
            "spans": [",".join(f"{c}:{a}:{b}" for a, b, c in f) for f in found],
        }

    return rows_to_arrow(docs, run, "doc_id long, licenses string, n_sentences long, spans string")
