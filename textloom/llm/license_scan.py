"""License scans by sentence rules.

Texts are cut into sentences behind . ! ? ; : before white space, and at line ends. Wrapped lines are read a second time with
single line ends taken as spaces. A tag (SPDX-License-Identifier) and what it names are one sentence. Every sentence of either reading is normalised to its words in lower case, and those
that a table knows, word for word or with a name of up to ``SLOT_WORDS`` words in its slot, become identifiers, in order of the words before them; what both readings find counts once. The
identifiers of a text are matched against ordered rules: a rule fires where its identifiers follow one another with at most
``GAP`` other words between two of them. A rule that another one contains gives way where both fire, and a
fallback rule where any other fires. Both tables are looked up by hash (sentences) and in a trie (rules), so they may
hold many thousands of entries. No rows move.

Defined results: null and empty texts hold no sentence; a license named twice is reported once; an empty table gives an
empty result; repeated rows are scanned alike; other columns never matter; no sentence is too long to be read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, text_or_empty

#: Words that may lie between two sentences of a rule (a copyright line, an address).
GAP = 60
#: Licences that notices name, by identifier (fixed values: SPDX identifiers and the names in common use).
NAMES: dict[str, tuple[str, ...]] = {
    "0BSD": ("Zero-Clause BSD License",),
    "AFL-3.0": ("Academic Free License version 3.0",),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPL-3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "2-clause BSD license"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "3-clause BSD license"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "CDDL-1.0": ("Common Development and Distribution License, Version 1.0",),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0", "Eclipse Public License, Version 2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2",),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"),
    "MIT": ("MIT License", "Expat License"),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "PostgreSQL": ("PostgreSQL License",),
    "Python-2.0": ("Python Software Foundation License Version 2",),
    "Unlicense": ("Unlicense",),
    "WTFPL": ("Do What The Fuck You Want To Public License",),
    "Zlib": ("zlib License",),
}
#: Creative Commons licences, which notices name without an article (fixed values).
COMMONS: dict[str, tuple[str, ...]] = {
    f"CC-{kind}-{version}": (f"CC {kind} {version}",) for version in ("3.0", "4.0") for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")
}
#: Notices that a name is put into.
NOTICES = (
    "Released under the {}.",
    "Licensed under the {}.",
    "This work is licensed under the {}.",
    "This software is released under the {}.",
    "Distributed under the {}.",
    *[f"{start} under the terms of the {{}}." for start in ("Released", "Licensed", "Distributed", "This project is released", "This project is licensed", "This software is licensed", "This work is licensed")],
    *[f"{start} under the {{}}." for start in ("This project is released", "This project is licensed", "This software is licensed", "This program is licensed", "This library is licensed")],
)
NOTICES_PLAIN = ("Released under {}.", "Licensed under {}.", "This work is licensed under {}.")
#: Further identifiers that files are tagged with (fixed values: SPDX identifiers).
TAGGED = tuple(f"{name}-{end}" for name in ("GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "GFDL-1.2", "GFDL-1.3") for end in ("only", "or-later")) + ("CC0-1.0", "MPL-1.1", "Artistic-1.0", "BSD-4-Clause")
#: Words that a slot, {}, of a known sentence may hold.
SLOT_WORDS = 12
#: Known sentences and their identifiers (fixed values: the wording of public licences and notices); {} stands for a name.
WORDINGS: dict[str, str] = {
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "version-2": "Version 2, June 1991",
    "version-2.1": "Version 2.1, February 1999",
    "version-3": "Version 3, 29 June 2007",
    "version-3-agpl": "Version 3, 19 November 2007",
    "gpl-free": "This program is free software:",
    "gpl-free-old": "This program is free software;",
    "lgpl-free": "This library is free software;",
    "gpl1-later-tail": "either version 1, or (at your option) any later version.",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "lgpl-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "gpl2-later-tail": "either version 2 of the License, or (at your option) any later version.",
    "lgpl2.1-later-tail": "either version 2.1 of the License, or (at your option) any later version.",
    "gpl2-only-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl3-later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-later": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc0-title": "CC0 1.0 Universal",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-endorse-author": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "mpl-title": "Mozilla Public License",
    "version-1.1": "Version 1.1",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "mpl1.1-subject": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\");",
    "gfdl-title": "GNU Free Documentation License",
    "version-1.2-gfdl": "Version 1.2, November 2002",
    "version-1.3-gfdl": "Version 1.3, 3 November 2008",
    "library-title": "GNU LIBRARY GENERAL PUBLIC LICENSE",
    "version-1": "Version 1, February 1989",
    "artistic-title": "The \"Artistic License\"",
    "artistic-intent": "The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "epl2-made": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-provided": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-granted": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "wtfpl-do": "You just DO WHAT THE FUCK YOU WANT TO.",
    "public-domain": "This work is in the public domain.",
    "reserved": "All rights reserved.",
}
#: (license, ordered sentence identifiers) of the wordings; each notice is a rule of its own
WORDING_RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit-title", "mit-grant")),
    ("MIT", ("mit-title-the", "mit-grant")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant", "mit-notice", "as-is", "liability")),
    ("Apache-2.0", ("apache-title", "apache-version")),
    ("Apache-2.0", ("apache-licensed-the",)),
    ("Apache-2.0", ("apache-licensed-the", "apache-comply")),
    ("Apache-2.0", ("apache-licensed-the", "apache-comply", "apache-copy")),
    ("Apache-2.0", ("apache-licensed-the", "apache-comply", "apache-copy", "apache-basis")),
    ("GPL-2.0-only", ("gpl-title", "version-2")),
    ("GPL-3.0-only", ("gpl-title", "version-3")),
    ("LGPL-2.1-only", ("lgpl-title", "version-2.1")),
    ("LGPL-3.0-only", ("lgpl-title", "version-3")),
    ("AGPL-3.0-only", ("agpl-title", "version-3-agpl")),
    ("GPL-1.0-or-later", ("gpl-free-old", "gpl-terms", "gpl1-later-tail")),
    ("GPL-2.0-only", ("gpl-free-old", "gpl2-only-terms")),
    ("GPL-2.0-or-later", ("gpl-free-old", "gpl-terms", "gpl2-later-tail")),
    ("GPL-2.0-or-later", ("gpl-free-old", "gpl-terms", "gpl2-later-tail", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "lgpl2.1-later-tail")),
    ("LGPL-2.1-or-later", ("lgpl-free", "lgpl-terms", "lgpl2.1-later-tail", "lgpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl3-later", "gpl-hope")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl3-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl3-later", "gpl-hope")),
    ("CC0-1.0", ("cc0",)),
    ("CC0-1.0", ("cc0-title",)),
    ("BSD-2-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-3-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse-author")),
    ("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("MIT", ("mit-grant",)),
    ("MPL-1.1", ("mpl-title", "version-1.1")),
    ("MPL-1.1", ("mpl1.1-subject",)),
    ("MPL-2.0", ("mpl2-title",)),
    ("GFDL-1.2-only", ("gfdl-title", "version-1.2-gfdl")),
    ("GFDL-1.3-only", ("gfdl-title", "version-1.3-gfdl")),
    ("LGPL-2.0-only", ("library-title", "version-2")),
    ("GPL-1.0-only", ("gpl-title", "version-1")),
    ("Artistic-1.0", ("artistic-title",)),
    ("Artistic-1.0", ("artistic-title", "artistic-intent")),
    ("Artistic-1.0", ("artistic-intent",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("MPL-2.0", ("mpl2-subject",)),
    ("EPL-2.0", ("epl2-made",)),
    ("Unlicense", ("unlicense-free",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-provided", "zlib-granted")),
    ("BSL-1.0", ("bsl-grant",)),
    ("WTFPL", ("wtfpl-do",)),
    ("LicenseRef-public-domain", ("public-domain",)),
    ("Proprietary", ("reserved",)),
)
#: Licenses that count only where no other is found: BSD and other headers say "All rights reserved." too.
FALLBACK = frozenset({"Proprietary"})


def notices() -> dict[str, tuple[str, str]]:
    """Identifier to (sentence, license) of every notice of every name."""
    out = {}
    for names, forms in ((NAMES, NOTICES), (COMMONS, NOTICES_PLAIN)):
        for license_, own in names.items():
            for i, name in enumerate(own):
                for j, form in enumerate(forms):
                    out[f"{license_.lower()}:{i}:{j}"] = (form.format(name), license_)
    return out


def tags() -> dict[str, tuple[str, str]]:
    """Identifier to (sentence, license) of the line that names each license by its SPDX identifier."""
    return {f"spdx:{x.lower()}": (f"SPDX-License-Identifier:{x}", x) for x in (*NAMES, *COMMONS, *TAGGED)}


SENTENCES: dict[str, str] = {k: s for k, (s, _) in (notices() | tags()).items()} | WORDINGS
RULES: tuple[tuple[str, tuple[str, ...]], ...] = tuple((name, (k,)) for k, (_, name) in (notices() | tags()).items()) + WORDING_RULES

_BREAK = re.compile(r"([.!?;:])[ \t\r]+")
#: A tag and its identifier are one sentence.
_TAG = re.compile(r"(SPDX-License-Identifier:)[ \t]+")
_WRAP = re.compile(r"(?<=[^\n])\n(?=[^\n])")
_WORD = re.compile(r"[a-z0-9]+")
#: Letters whose lower case holds ASCII letters though they are none themselves.
_FOLDING = str.maketrans({"\u0130": " ", "\u212a": " "})


def words_of(sentence: str) -> list[str]:
    """Words of ASCII letters and digits, in lower case."""
    return _WORD.findall(sentence.translate(_FOLDING).lower() if not sentence.isascii() else sentence.lower())


def normalised(sentence: str) -> str:
    return " ".join(words_of(sentence))


def _parts(text: str) -> list[str]:
    return _BREAK.sub("\\1\n", _TAG.sub("\\1", text)).split("\n")


def known_sentences(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence, without its slot if it has one, to identifier. A known text of several sentences would never match, which is an error."""
    out = {}
    for name, text in sentences.items():
        if len(_parts(text)) != 1 or not words_of(text) or text.count("{}") > 1:
            raise ValueError(f"{name} holds more than one sentence, or none, or more than one slot")
        out.setdefault(normalised(text), name)
    return out


def slotted(sentences: dict[str, str]) -> list[tuple[str, str, str]]:
    """(words before the slot, words behind it, identifier) of the known sentences with a slot; there must be some of either."""
    same, out = known_sentences(sentences), {}
    for text in sentences.values():
        if "{}" in text:
            head, tail = map(normalised, text.split("{}"))
            if not head or not tail:
                raise ValueError(f"a slot at the end of a sentence: {text}")
            out.setdefault((head, tail), same[normalised(text)])
    return [(head, tail, name) for (head, tail), name in out.items()]


class Scanner:
    """Sentences by hash, rules in a trie of identifiers."""

    def __init__(self, sentences: dict[str, str], rules: tuple[tuple[str, tuple[str, ...]], ...], fallback: frozenset[str] = FALLBACK, gap: int = GAP):
        self.known, self.rules, self.fallback, self.gap = known_sentences(sentences), rules, fallback, gap
        self.same = {k: self.known[normalised(s)] for k, s in sentences.items()}
        #: by first word, sentences with a slot
        self.slots: dict[str, list[tuple[list[str], list[str], str]]] = {}
        for head, tail, name in slotted(sentences):
            self.slots.setdefault(head.split()[0], []).append((head.split(), tail.split(), name))
        self.trie: dict = {}
        for i, (_, ids) in enumerate(rules):
            at = self.trie
            for x in ids:
                at = at.setdefault(self.same[x], {})
            at.setdefault(None, []).append(i)
        #: words that one of the known sentences begins with: most sentences are ruled out by their first
        self.first = frozenset(s.split(" ", 1)[0] for s in self.known)
        #: the longest word of each: a text without any of them holds no known sentence and isn't cut
        self.needed = frozenset(max(s.split(), key=len) for s in self.known)

    def _named(self, words: list[str]) -> list[str]:
        """Identifiers of a sentence: its own, or those of the slotted ones that it fits."""
        exact = self.known.get(" ".join(words))
        if exact is not None:
            return [exact]
        fits = lambda h, t: len(h) + len(t) <= len(words) <= len(h) + len(t) + SLOT_WORDS and words[: len(h)] == h and words[-len(t) :] == t
        return [name for h, t, name in self.slots.get(words[0], ()) if fits(h, t)]

    def _read(self, text: str) -> Iterator[tuple[int, str, int]]:
        """(words before, identifier, words) of the known sentences."""
        before = 0
        for part in _parts(text):
            words = words_of(part)
            if words and words[0] in self.first:
                for name in self._named(words):
                    yield before, name, len(words)
            before += len(words)

    def sentences(self, text: str) -> list[tuple[int, str, int]]:
        if self.needed.isdisjoint(words_of(text)):
            return []
        found = set(self._read(text))
        if "\n" in text:
            found.update(self._read(_WRAP.sub(" ", text)))
        return sorted(found)

    def fired(self, found: list[tuple[int, str, int]]) -> list[int]:
        """The rules that fire, without those that a longer one that fires contains, and without fallbacks where others fire."""
        spans: set[tuple[int, int, int]] = set()
        for i in range(len(found)):
            at, j = self.trie.get(found[i][1]), i
            while at is not None:
                spans.update((rule, i, j) for rule in at.get(None, ()))
                if j + 1 == len(found) or found[j + 1][0] - found[j][0] - found[j][2] > self.gap:
                    break
                j += 1
                at = at.get(found[j][1])
        rules = {r for r, _, _ in spans}
        if any(self.rules[r][0] not in self.fallback for r in rules):
            rules = {r for r in rules if self.rules[r][0] not in self.fallback}
        line = {r: ">" + ">".join(self.same[x] for x in self.rules[r][1]) + ">" for r in rules}
        return sorted(r for r in rules if not any(o != r and line[r] in line[o] and line[r] != line[o] for o in rules))

    def row(self, text: str) -> tuple[str, str, int, str]:
        found = self.sentences(text)
        fired = self.fired(found)
        licenses = sorted({self.rules[r][0] for r in fired})
        return ",".join(n for _, n, _ in found), ",".join(licenses), len(licenses), ",".join(">".join(self.rules[r][1]) for r in fired)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES, fallback: frozenset[str] = FALLBACK, gap: int = GAP) -> DataFrame:
    """One row per document: doc_id, its sentence identifiers, its licenses in order of name, their number, and the rules that fired."""
    for _, ids in rules:
        if missing := set(ids) - set(sentences):
            raise ValueError(f"rules name unknown sentences {sorted(missing)}")
    scanner = Scanner(sentences, rules, fallback, gap)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scanner.row(t.as_py()) for t in batch["text"]]
            cols = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *cols], names=["doc_id", "sentence_ids", "licenses", "n_licenses", "rules"])

    return rows.mapInArrow(run, f"doc_id {kind}, sentence_ids string, licenses string, n_licenses long, rules string")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle_sql(sentences: dict[str, str] = SENTENCES, rules: tuple[tuple[str, tuple[str, ...]], ...] = RULES, fallback: frozenset[str] = FALLBACK, gap: int = GAP) -> str:
    table = known_sentences(sentences)
    same = {k: table[normalised(s)] for k, s in sentences.items()}
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in table.items())
    slots = ", ".join(f"({_quoted(h + ' ')}, {_quoted(' ' + t)}, {len((h + ' ' + t).split())}, {_quoted(v)})" for h, t, v in slotted(sentences)) or "('', '', 0, '')"
    rule = ", ".join(f"({i}, {_quoted(n)}, {_quoted('>' + '>'.join(same[x] for x in ids) + '>')}, {_quoted('>'.join(ids))}, {str(n in fallback).lower()})" for i, (n, ids) in enumerate(rules))
    folded = "lower(translate({}, chr(304) || chr(8490), '  '))"
    once = "regexp_replace({}, '([^\\n])\\n([^\\n])', '\\1 \\2', 'g')"
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
slots(head, tail, fewest, name) AS (SELECT * FROM (VALUES {slots}) s(head, tail, fewest, name) WHERE fewest > 0),
rule(i, license, line, ids, weak) AS (VALUES {rule}),
modes AS (
  SELECT doc_id, 0 AS mode, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT doc_id, 1, {once.format(once.format("coalesce(text, '')"))} FROM documents
), parts AS (
  SELECT doc_id, mode, {folded.format('unnest(p)')} AS part, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, mode, string_split(regexp_replace(regexp_replace(text, '(SPDX-License-Identifier:)[ \\t]+', '\\1', 'g'), '([.!?;:])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS p FROM modes)
), counted AS (
  SELECT doc_id, mode, part, pos, len(regexp_extract_all(part, '[a-z0-9]+')) AS n FROM parts
), placed AS (
  SELECT *, sum(n) OVER (PARTITION BY doc_id, mode ORDER BY pos) - n AS before FROM counted
), plain AS (
  SELECT doc_id, before, n, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS words FROM placed
), exact AS (
  SELECT doc_id, before, name, n, sentence FROM plain JOIN known ON words = sentence
), named AS (
  SELECT doc_id, before, name, n FROM exact
  UNION SELECT doc_id, before, name, n FROM plain JOIN slots ON starts_with(words || ' ', head) AND ends_with(' ' || words, tail) AND n BETWEEN fewest AND fewest + {SLOT_WORDS} WHERE words NOT IN (SELECT sentence FROM known)
), apart AS (
  SELECT *, coalesce(before - lag(before + n) OVER o > {gap}, false) AS far FROM named WINDOW o AS (PARTITION BY doc_id ORDER BY before, name, n)
), lines AS (
  SELECT d.doc_id, coalesce(string_agg(name, ',' ORDER BY before, name, n), '') AS sentence_ids, coalesce('>' || string_agg(CASE WHEN far THEN '|>' ELSE '' END || name || '>', '' ORDER BY before, name, n), '') AS line
  FROM documents d LEFT JOIN apart a USING (doc_id) GROUP BY d.doc_id
), every AS (
  SELECT doc_id, i, license, rule.line, ids, weak FROM lines JOIN rule ON contains(lines.line, rule.line) WHERE lines.line <> ''
), hits AS (
  SELECT * FROM every e WHERE NOT weak OR NOT EXISTS (SELECT 1 FROM every o WHERE o.doc_id = e.doc_id AND NOT o.weak)
), best AS (
  SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.doc_id = h.doc_id AND o.line <> h.line AND contains(o.line, h.line))
), found AS (
  SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT license) AS n, string_agg(ids, ',' ORDER BY i) AS rules FROM best GROUP BY doc_id
)
SELECT l.doc_id, l.sentence_ids, coalesce(f.licenses, '') AS licenses, coalesce(f.n, 0)::BIGINT AS n_licenses, coalesce(f.rules, '') AS rules
FROM lines l LEFT JOIN found f USING (doc_id)
"""
