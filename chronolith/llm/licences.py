"""Licence scans by sentence rules.

A text is cut into paragraphs at blank lines, these into lines (comment marks before and after them go), and lines at
sentence marks. A sentence is a run of such fragments of which none but the last ends with a mark, so a sentence may be
wrapped over lines, and a line without a mark may be a sentence of its own. Semicolons and colons part fragments but
need not end a sentence, as licences print them inside sentences too. Sentences are normalised (lower case;
letters, digits and dots within numbers; one space). A whole normalised sentence that is known becomes its identifier,
any other becomes nothing: a known sentence inside a longer one, or over a sentence mark, is none. From each fragment on
the longest known sentence counts.

SPDX lines are read as expressions: known identifiers joined by OR and AND, with known exceptions. Sentences with a
holder's name match by their beginning and end; notices ("this file is licensed under the ...") are
made by a rule from subjects, verbs and licence names. The identifiers, in the order of the text, are matched against
the rules in their order: a rule is a sequence of identifiers that follow one another with at most GAP unknown fragments
between two; its identifiers are used up, and what no rule takes is reported as unmatched.

Defined cases: null and empty texts have no identifiers and no licences; a sentence that repeats is found each time;
a text of any length is read whole; rows that repeat each have a row, as have null ids; an empty table gives none;
columns but doc_id and text are not read, so their names can't clash. One row per document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, rows_out, slices

# Sentences of public licence texts, normalised, with identifiers.
SENTENCES = [
    ("mit-title", "mit license"),
    ("mit-title", "the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-liability", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc-title", "isc license"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-as-is", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc-liability", "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("0bsd-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-liability", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services"),
    ("apache-2-title", "apache license version 2.0"),
    ("apache-2-comply", "you may not use this file except in compliance with the license"),
    ("apache-2-copy", "you may obtain a copy of the license at"),
    ("apache-2-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2-see", "see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-title", "gnu general public license"),
    ("gpl-2-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2-only", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2 of the license"),
    ("lgpl-2.1-or-later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("lgpl-3-or-later", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3-or-later", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-see", "see the gnu general public license for more details"),
    ("lgpl-see", "see the gnu lesser general public license for more details"),
    ("agpl-see", "see the gnu affero general public license for more details"),
    ("gpl-copy", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl-copy", "you should have received a copy of the gnu lesser general public license along with this library"),
    ("agpl-copy", "you should have received a copy of the gnu affero general public license along with this program"),
    ("mpl-2-subject", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("mpl-2-copy", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-liability", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1-title", "boost software license version 1.0"),
    ("bsl-1-distributed", "distributed under the boost software license version 1.0"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("unlicense-grant", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc0-dedicated", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law"),
    ("wtfpl-title", "do what the fuck you want to public license"),
    ("public-domain", "this work is in the public domain"),
    ("public-domain", "this file is in the public domain"),
    ("all-rights", "all rights reserved"),
]
# Sentences with a name in them, by their normalised beginning and end.
NAMED = [
    ("bsd-endorse", "neither the name of ", " may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advert", "all advertising materials mentioning features or use of this software must display the following acknowledgement", ""),
    ("bsd-disclaimer", "this software is provided by ", " are disclaimed"),
]
# What notices are made of.
SUBJECTS = ["", *(f"this {x} is " for x in ("work", "software", "program", "file", "code", "source code", "project", "package", "library", "document", "documentation", "repository", "dataset"))]
VERBS = ["licensed under", "released under", "distributed under", "available under", "made available under", "published under", "provided under"]
TERMS = ["", "the ", "a ", "the terms of the ", "the terms of ", "the terms and conditions of the "]
LICENCES = [
    ("MIT", "mit license"), ("MIT", "mit licence"), ("Apache-2.0", "apache license version 2.0"), ("Apache-2.0", "apache license 2.0"), ("Apache-2.0", "apache 2.0 license"),
    ("GPL-2.0-only", "gnu general public license version 2"), ("GPL-3.0-only", "gnu general public license version 3"), ("GPL-3.0-only", "gnu gpl version 3"), ("GPL-2.0-only", "gnu gpl version 2"),
    ("LGPL-2.1-only", "gnu lesser general public license version 2.1"), ("LGPL-3.0-only", "gnu lesser general public license version 3"), ("AGPL-3.0-only", "gnu affero general public license version 3"),
    ("MPL-2.0", "mozilla public license version 2.0"), ("MPL-2.0", "mozilla public license v. 2.0"), ("EPL-2.0", "eclipse public license 2.0"), ("EPL-2.0", "eclipse public license v2.0"),
    ("BSD-2-Clause", "bsd 2 clause license"), ("BSD-3-Clause", "bsd 3 clause license"), ("BSD", "bsd license"), ("ISC", "isc license"), ("BSL-1.0", "boost software license version 1.0"), ("Zlib", "zlib license"),
    ("CC-BY-4.0", "cc by 4.0"), ("CC-BY-SA-4.0", "cc by sa 4.0"), ("CC-BY-NC-4.0", "cc by nc 4.0"), ("CC-BY-ND-4.0", "cc by nd 4.0"), ("CC-BY-NC-SA-4.0", "cc by nc sa 4.0"), ("CC-BY-NC-ND-4.0", "cc by nc nd 4.0"), ("CC0-1.0", "cc0 1.0"),
    ("CC-BY-4.0", "creative commons attribution 4.0 international license"), ("CC-BY-SA-4.0", "creative commons attribution sharealike 4.0 international license"), ("Unlicense", "unlicense"),
]
SPDX = [
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "ECL-2.0",
    "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0+", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0+", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1+", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "PostgreSQL", "Python-2.0", "Unlicense", "UPL-1.0", "WTFPL", "Zlib",
]
EXCEPTIONS = ["Classpath-exception-2.0", "Linux-syscall-note", "GCC-exception-3.1", "LLVM-exception", "Font-exception-2.0", "Bison-exception-2.2"]
#: Ordered rules: the first that matches takes its identifiers. Notices and SPDX lines (id "notice:X") are rules of one.
RULES = [
    ("MIT", ("mit-title", "mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("ISC", ("isc-title", "isc-grant", "isc-as-is", "isc-liability")),
    ("ISC", ("isc-grant", "isc-as-is", "isc-liability")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is", "isc-liability")),
    ("BSD-4-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advert", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer", "bsd-liability")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-disclaimer")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-disclaimer", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-disclaimer")),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("notice:Apache-2.0", "apache-2-comply", "apache-2-copy", "apache-2-basis", "apache-2-see")),
    ("Apache-2.0", ("notice:Apache-2.0", "apache-2-comply", "apache-2-copy", "apache-2-basis")),
    ("Apache-2.0", ("notice:Apache-2.0", "apache-2-comply", "apache-2-copy")),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-3-or-later", "gpl-hope", "gpl-see")),
    ("GPL-3.0-or-later", ("gpl-3-or-later",)),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl-2-or-later", "gpl-hope", "gpl-see")),
    ("GPL-2.0-or-later", ("gpl-2-or-later",)),
    ("GPL-2.0-only", ("gpl-2-only", "gpl-hope", "gpl-see", "gpl-copy")),
    ("GPL-2.0-only", ("gpl-2-only", "gpl-hope", "gpl-see")),
    ("GPL-2.0-only", ("gpl-2-only",)),
    ("LGPL-3.0-or-later", ("lgpl-3-or-later", "lgpl-hope", "lgpl-see", "lgpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl-3-or-later", "lgpl-hope", "lgpl-see")),
    ("LGPL-3.0-or-later", ("lgpl-3-or-later",)),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later", "lgpl-hope", "lgpl-see", "lgpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later", "lgpl-hope", "lgpl-see")),
    ("LGPL-2.1-or-later", ("lgpl-2.1-or-later",)),
    ("AGPL-3.0-or-later", ("agpl-3-or-later", "gpl-hope", "agpl-see", "agpl-copy")),
    ("AGPL-3.0-or-later", ("agpl-3-or-later", "gpl-hope", "agpl-see")),
    ("AGPL-3.0-or-later", ("agpl-3-or-later",)),
    ("MPL-2.0", ("mpl-2-subject", "mpl-2-copy")),
    ("MPL-2.0", ("mpl-2-subject",)),
    ("Zlib", ("zlib-as-is", "zlib-liability", "zlib-grant")),
    ("BSL-1.0", ("bsl-1-distributed",)),
    ("Unlicense", ("unlicense-free", "unlicense-grant")),
    ("Unlicense", ("unlicense-free",)),
    ("CC0-1.0", ("cc0-dedicated",)),
    ("WTFPL", ("wtfpl-title",)),
    ("Public-domain", ("public-domain",)),
]
#: Unknown fragments that may lie between two sentences of a rule.
GAP = 2
#: Every known sentence holds one of these, so a text without any of them has no identifier.
TRIGGERS = re.compile(rb"licen[cs]e|permission|copyright|software|redistribut|advertis|public\W+domain|warrant|spdx|all\W+rights|endorse|free|gpl|mpl|cc\W*by|cc0", re.I)
BLANK, LEADERS = re.compile(r"\n[^\S\n]*(?:[#*;%]+[^\S\n]*)?(?=\n)"), re.compile(r"^[\s#*/;%<!>|-]+|[\s#*/<>|-]+$")
#: A mark ends a sentence before white space or the end; a single letter and a dot ("v. 2.0") is no end.
MARK, ENUMERATION = re.compile(r"(?<!\bv)[.!?:;]+[\"')\]]*(?=\s|$)"), re.compile(r"^\s*(?:\(?[0-9a-zA-Z]{1,2}[.)]|\([0-9a-zA-Z]{1,2}\))\s+")


def normalised(text: str) -> str:
    """Lower case; runs of anything but letters, digits and dots between digits (or after a single v) become one space."""
    text = re.sub(r"\(c\)|\u00a9", " ", text.lower())
    return " ".join(re.sub(r"(?<![0-9]|\bv)\.|(?<=[0-9])\.(?![0-9])|[^\w.]+|_", " ", text).split())


def fragments(text: str) -> list[tuple[str, bool]]:
    """Normalised pieces of lines between sentence marks, and whether a sentence ends with each."""
    out: list[tuple[str, bool]] = []
    for paragraph in BLANK.split(text.replace("\r\n", "\n").replace("\r", "\n")):
        first = len(out)
        for line in paragraph.split("\n"):
            line, at = ENUMERATION.sub("", LEADERS.sub("", line)), 0
            for m in MARK.finditer(line):
                ends = not set(m[0]) <= set(";:")
                if piece := normalised(line[at : m.start()]):
                    out.append((piece, ends))
                elif ends and len(out) > first:
                    out[-1] = (out[-1][0], True)
                at = m.end()
            if piece := normalised(line[at:]):
                out.append((piece, False))
        if len(out) > first:
            out[-1] = (out[-1][0], True)
    return out


@lru_cache(1)
def known() -> tuple[dict[str, str], int]:
    """Identifiers by sentence, and the most words of a sentence."""
    found = {s: name for name, s in SENTENCES}
    for name, licence in LICENCES:
        for subject in SUBJECTS:
            for verb in VERBS:
                for term in TERMS:
                    for tail in ("", " the license"):  # (the "License")
                        found.setdefault(f"{subject}{verb} {term}{licence}{tail}", f"notice:{name}")
    return found, max(len(s.split()) for s in found)


SPDX_LINE = "spdx license identifier "


@lru_cache(1)
def spdx_names() -> tuple[dict[str, str], dict[str, str]]:
    """Identifiers and exceptions by their normalised names; a plus is no letter, so names with one come by their words."""
    names = {normalised(n): n for n in SPDX if not n.endswith("+")}
    return names, {normalised(n): n for n in EXCEPTIONS}


def expression(sentence: str) -> str | None:
    """An SPDX expression of known names as one identifier, or nothing; the longest name counts ("gpl 2.0 or later")."""
    words, at, out, wants = sentence.split(), 0, [], 0
    while at < len(words):
        if wants == 2:  # after a name: an operator
            if words[at] not in ("or", "and", "with"):
                return None
            out.append(words[at].upper())
            wants, at = int(words[at] == "with"), at + 1
            continue
        names = spdx_names()[wants]
        end = next((e for e in range(min(at + 6, len(words)), at, -1) if " ".join(words[at:e]) in names), None)
        if end is None:
            return None
        out.append(names[" ".join(words[at:end])])
        at, wants = end, 2
    return f"notice:{' '.join(out)}" if wants == 2 else None


def identifier(sentence: str) -> str | None:
    if name := known()[0].get(sentence):
        return name
    if sentence.startswith(SPDX_LINE):
        return expression(sentence[len(SPDX_LINE) :])
    for name, start, end in NAMED:
        if sentence.startswith(start) and sentence.endswith(end) and len(sentence) >= len(start) + len(end):
            return name
    return None


#: Words that are tried as one sentence, unless a known one is longer: no text of a licence has a named sentence near that.
NAMED_WORDS = 400


def identifiers(text: bytes | None) -> list[tuple[int, int, str]]:
    """First and last fragment and identifier of the known sentences in a text, in its order."""
    if not text or not TRIGGERS.search(text):
        return []
    pieces, out, at = fragments(text.decode("utf-8", "replace")), [], 0
    most = max(known()[1], NAMED_WORDS)
    while at < len(pieces):
        joined, words, best = "", 0, None
        for end in range(at, len(pieces)):
            joined = f"{joined} {pieces[end][0]}" if joined else pieces[end][0]
            words += pieces[end][0].count(" ") + 1
            if words > most:
                break
            if name := identifier(joined):
                best = (at, end, name)
            if pieces[end][1]:
                break
        if best:
            out.append(best)
            at = best[1] + 1
        else:
            at += 1
    return out


def recognise(ids: list[tuple[int, int, str]], rules=None) -> tuple[list[tuple[int, str]], list[str]]:
    """(place of the first identifier, licence) of every match, and the identifiers that no rule takes."""
    free, found = [True] * len(ids), []
    names = [name for *_, name in ids]
    singles = [(n.partition(":")[2], (n,)) for n in dict.fromkeys(names) if n.startswith("notice:")]
    for licence, wanted in [*(RULES if rules is None else rules), *singles]:
        n = len(wanted)
        for at in range(len(ids) - n + 1):
            near = all(ids[k + 1][0] - ids[k][1] <= GAP + 1 for k in range(at, at + n - 1))
            if near and all(free[at : at + n]) and tuple(names[at : at + n]) == wanted:
                free[at : at + n] = [False] * n
                found.append((at, licence))
    return sorted(found), [i for i, f in zip(names, free, strict=True) if f]


FOUND = pa.schema([("doc_id", pa.int64()), ("n_sentences", pa.int64()), ("sentences", pa.string()), ("licences", pa.string()), ("unmatched", pa.string())])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: identifiers, licences in the order of the text, and identifiers that no rule took, each joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = identifiers(text)
                found, rest = recognise(ids)
                rows.append((doc, len(ids), ",".join(x for *_, x in ids), ",".join(x for _, x in found), ",".join(rest)))
            yield rows_out(FOUND, zip(*rows, strict=True))

    return id_text(docs).mapInArrow(run, "doc_id long, n_sentences long, sentences string, licences string, unmatched string")


def op7_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
