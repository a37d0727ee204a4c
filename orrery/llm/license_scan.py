"""Licence scan by sentence rules.

A text is cut into sentences, each is normalised and looked up among the known licence sentences, and
the sequence of their identifiers is matched against ordered rules.  All of it happens within a row
by built-in functions: no shuffle, so neither hot sources nor copies matter, and memory is one row's.
Texts without any of a few words, of which every known sentence holds one, are known to have none at once.

Two readings are made: in one every line end also ends a sentence, in the other only blank lines do
(texts wrapped at a column); lines of punctuation alone, as within comment blocks, count as blank.  A known
sentence that holds a stop itself ("v. 2.0") is known by the sequence of its pieces.  A rule's count is the greater of both.

Defined results: null and empty texts have no sentences (empty licences, 0 hits).  Repeated rows give
repeated results.  A rule matches when its sentences occur in its order, others between them allowed;
it counts as often as it fits without overlap.  Headings of full texts make one match where the licence has no other.
Statements in one line ("this file is released under the ...") are cut to the licence's name; a sentence that names a
holder ("neither the name of ...") is known whoever that is, up to SLOT_WORDS words.  Where another licence's longer rule holds a rule's sentences,
its matches are taken off: a text of three BSD clauses isn't one of two.  Other columns, whatever their names,
pass; n_sentences and licenses replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, as they are normalised here.
SENTENCES: dict[str, str] = {
    "mit-short": "Released under the MIT License",
    "mit-short-2": "Licensed under the MIT License",
    "mit-short-3": "This project is licensed under the MIT License",
    "mit-title": "MIT License",
    "mit-1": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-2": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-3": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-1": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-2": "you may not use this file except in compliance with the License",
    "apache-3": "You may obtain a copy of the License at",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl3-short-2": "Licensed under the GNU General Public License v3.0",
    "gpl-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-2": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0-short": "Released under CC0 1.0 Universal",
    "bsd-intro": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-1": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-2": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-3": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl-1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "isc-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense-1": "This is free and unencumbered software released into the public domain",
    "gpl2-1": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-short": "Licensed under the GNU General Public License v2.0",
    "lgpl21-1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl21-2": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "lgpl3-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl3-short": "Licensed under the GNU Lesser General Public License v3.0",
    "agpl3-1": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-short": "Licensed under the GNU Affero General Public License v3.0",
    "epl-1": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl-short": "Licensed under the Eclipse Public License 2.0",
    "bsl-short": "Distributed under the Boost Software License, Version 1.0",
    "zlib-1": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-2": "In no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-3": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "0bsd-1": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "bsd3-short": "Licensed under the BSD 3-Clause License",
    "bsd2-short": "Licensed under the BSD 2-Clause License",
    "mpl-short": "Licensed under the Mozilla Public License 2.0",
    "isc-short": "Licensed under the ISC License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nd-long": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0",
    "cc-by-nc-sa-long": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nc-sa-short": "Licensed under CC BY-NC-SA 4.0",
}
#: Licence -> its rules; each rule is an ordered sequence of sentence names.
RULES: dict[str, list[list[str]]] = {
    "MIT": [["mit-short"], ["mit-short-2"], ["mit-short-3"], ["mit-1", "mit-2", "mit-3"]],
    "Apache-2.0": [["apache-short"], ["apache-1", "apache-2", "apache-3"]],
    "GPL-3.0": [["gpl3-short"], ["gpl3-short-2"], ["gpl-1", "gpl-2"]],
    "CC-BY-NC-4.0": [["cc-by-nc-short"], ["cc-by-nc-long"]],
    "CC-BY-4.0": [["cc-by-short"], ["cc-by-long"]],
    "CC-BY-SA-4.0": [["cc-by-sa-short"], ["cc-by-sa-long"]],
    "CC-BY-ND-4.0": [["cc-by-nd-short"], ["cc-by-nd-long"]],
    "CC-BY-NC-SA-4.0": [["cc-by-nc-sa-short"], ["cc-by-nc-sa-long"]],
    "CC0-1.0": [["cc0-short"]],
    "BSD-3-Clause": [["bsd-intro", "bsd-1", "bsd-2", "bsd-3"], ["bsd3-short"]],
    "BSD-2-Clause": [["bsd-intro", "bsd-1", "bsd-2"], ["bsd2-short"]],
    "MPL-2.0": [["mpl-1"], ["mpl-short"]],
    "ISC": [["isc-1"], ["isc-short"]],
    "Unlicense": [["unlicense-1"]],
    "GPL-2.0": [["gpl2-1", "gpl-2"], ["gpl2-short"]],
    "LGPL-2.1": [["lgpl21-1", "lgpl21-2"]],
    "LGPL-3.0": [["lgpl3-1"], ["lgpl3-short"]],
    "AGPL-3.0": [["agpl3-1"], ["agpl3-short"]],
    "EPL-2.0": [["epl-1"], ["epl-short"]],
    "BSL-1.0": [["bsl-short"]],
    "Zlib": [["zlib-1", "zlib-2", "zlib-3"]],
    "0BSD": [["0bsd-1"]],
}
# How licences are called in one-line statements, and the headings of their full texts.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT License", "MIT", "Expat License"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache License, Version 2", "Apache License v2.0", "Apache License v2", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License", "Apache-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU General Public License v3", "GNU General Public License 3.0", "GNU GPL v3", "GNU GPLv3", "GPL v3", "GPLv3", "GPL-3.0", "GPL-3.0 License", "GPLv3 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL v2", "GNU GPLv2", "GPL v2", "GPLv2", "GPL-2.0", "GPLv2 License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License v3", "LGPLv3", "LGPL v3", "LGPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL v2.1", "LGPL-2.1"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU Affero General Public License v3", "AGPLv3", "AGPL v3", "AGPL-3.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0", "Mozilla Public License v2.0", "MPL 2.0", "MPL-2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "EPL 2.0", "EPL-2.0"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0", "BSL-1.0"],
    "ISC": ["ISC License", "ISC"],
    "Zlib": ["zlib License"],
    "Unlicense": ["Unlicense"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
}
HEADINGS: dict[str, list[list[str]]] = {
    "MIT": [["MIT License"], ["The MIT License"], ["The MIT License (MIT)"]],
    "Apache-2.0": [["Apache License", "Version 2.0, January 2004"]],
    "GPL-3.0": [["GNU GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"]],
    "GPL-2.0": [["GNU GENERAL PUBLIC LICENSE", "Version 2, June 1991"]],
    "LGPL-3.0": [["GNU LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007"]],
    "LGPL-2.1": [["GNU LESSER GENERAL PUBLIC LICENSE", "Version 2.1, February 1999"]],
    "AGPL-3.0": [["GNU AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007"]],
    "MPL-2.0": [["Mozilla Public License Version 2.0"]],
    "EPL-2.0": [["Eclipse Public License - v 2.0"]],
    "BSL-1.0": [["Boost Software License - Version 1.0 - August 17th, 2003"]],
    "BSD-3-Clause": [["BSD 3-Clause License"]],
    "BSD-2-Clause": [["BSD 2-Clause License"]],
    "ISC": [["ISC License"]],
    "CC0-1.0": [["CC0 1.0 Universal"]],
    "CC-BY-4.0": [["Attribution 4.0 International"]],
    "CC-BY-SA-4.0": [["Attribution-ShareAlike 4.0 International"]],
}
# Each licence also by its tag in a line of its own.
for _name, _rules in RULES.items():
    SENTENCES[f"spdx {_name}"] = f"SPDX-License-Identifier: {_name}"
    _rules.append([f"spdx {_name}"])
#: Sentences that name a holder: what stands for it is up to so many words between a beginning and an end.
SLOT_WORDS = 40
_ENDORSE = "endorse or promote products derived from this software(?: without specific prior(?: written)? permission)?"
SLOTS: list[tuple[str, str, str]] = [("bsd-3", "neither the names?", _ENDORSE), ("bsd-3", "the names? of", f"(?:may|must) not be used to {_ENDORSE}")]
#: One-line statements begin alike whatever they say it of, and may point to a file.
STATEMENT = r"(?:th(?:is|e) (?:[a-z0-9]+ ){1,4}(?:is|are) )?(?:released|licensed|distributed|made available|available|provided|published) under (?:the terms of )?(?:the )?"
POINTER = r" see (?:the )?(?:[a-z0-9]+ ){1,4}for (?:more |full )?(?:details|information)"
#: A full stop ends a sentence before white space or the end; so do line ends (all, or blank lines).
STOP = r"(?<![.!?;])[.!?;]++(?=\s|$)"
END_LINES, END_BLANKS = rf"{STOP}|[\r\n]+", rf"{STOP}|[\r\n][\s\p{{Punct}}]*[\r\n]"
#: Cuts are marked by a control character, which so ends a sentence where a text holds it.
MARK = "\x01"
JUNK = r"[^a-z0-9\x01]+"


def normalise(sentence: str) -> str:
    """The form in which a single sentence is looked up."""
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in sentence.lower()).split())


def known_as(sentence: str) -> str:
    """The form in which a text's sentence is compared: statements are cut to what they say."""
    return re.sub(POINTER + "$", "", re.sub("^" + STATEMENT, "under ", normalise(sentence)))


def _extend() -> dict[str, list[list[str]]]:
    """Adds the sentences and rules of NAMES that the tables above lack, and those of HEADINGS; the latter's rules."""
    have = {known_as(x) for x in SENTENCES.values()}
    for lic, names in NAMES.items():
        for text in [f"{how} {n}" for n in names for how in ("Licensed under the", "License:")]:
            if known_as(text) not in have:
                have.add(known_as(text))
                SENTENCES[f"named {text}"] = text
                RULES[lic].append([f"named {text}"])
    name = {known_as(x): n for n, x in reversed(SENTENCES.items())}
    out = {}
    for lic, rules in HEADINGS.items():
        for text in [t for r in rules for t in r]:
            if known_as(text) not in name:
                SENTENCES[name.setdefault(known_as(text), f"heading {text}")] = text
        out[lic] = [[name[known_as(t)] for t in r] for r in rules]
    return out


#: Licence -> rules of its headings, which count once, and only where nothing else of the licence is found.
TITLES = _extend()


def anchors(sentences: dict[str, str], letters: tuple[int, ...] = (7, 5, 1)) -> list[str]:
    """A few words, of the first of these numbers of letters that a sentence has, of which every sentence holds one."""
    left = [known_as(x) for x in sentences.values()]
    words = sorted({w for x in left for w in next(filter(None, ([w for w in x.split() if len(w) >= n] for n in letters)))})
    out = []
    while left:
        best = max(words, key=lambda w: (sum(w in x for x in left), len(w)))
        out.append(best)
        left = [x for x in left if best not in x]
    return out


def identifiers(text: Column, sentences: dict[str, str], ends: str) -> Column:
    """array<int>: the 1-based numbers of the known sentences in the order of the text."""
    known = F.split(F.lit(MARK.join(map(known_as, sentences.values()))), MARK)
    flat = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), ends, MARK), JUNK, " ")
    for sentence in sentences.values():
        pieces = [x for x in map(normalise, re.split(STOP, sentence)) if x]
        if len(pieces) > 1:  # its pieces become one sentence again
            flat = F.regexp_replace(flat, rf"(?<![^{MARK}]) ?{f' *+(?:{MARK} *+)++'.join(pieces)} ?(?={MARK}|$)", normalise(sentence))
    for name, begin, end in SLOTS:
        if name in sentences:
            flat = F.regexp_replace(flat, rf"\b{begin}(?:[ {MARK}]++[a-z0-9]++){{1,{SLOT_WORDS}}}?[ {MARK}]++{end}\b", MARK + known_as(sentences[name]) + MARK)
    flat = F.regexp_replace(F.regexp_replace(flat, rf"(^|{MARK}) ?{STATEMENT}", "$1under "), rf"{POINTER} ?(?={MARK}|$)", "")
    # The lookup is by equal bytes among constants; the blanks beside the cuts go first.
    return F.filter(F.transform(F.split(flat, MARK), lambda s: F.array_position(known, F.trim(s)).cast("int")), lambda i: i > 0)


def count_rule(ids: Column, rule: list[int]) -> Column:
    """How often the rule's sentences occur in its order, one match after another."""
    r = F.array(*[F.lit(i) for i in rule])
    n = len(rule)
    if n == 1:
        return F.size(F.filter(ids, lambda i: i == rule[0]))
    return F.floor(F.aggregate(ids, F.lit(0), lambda p, i: F.when(i == F.element_at(r, (p % n + 1).cast("int")), p + 1).otherwise(p)) / n).cast("int")


def _holds(long: list[str], short: list[str]) -> bool:
    """Whether the sentences of short occur in long in their order."""
    rest = iter(long)
    return all(x in rest for x in short)


def longer_rules(rules: dict[str, list[list[str]]], lic: str, rule: list[str]) -> list[list[str]]:
    """The rules of other licences that hold all of the rule's sentences, and more."""
    return [r for other, rs in rules.items() if other != lic for r in rs if len(r) > len(rule) and _holds(r, rule)]


def scan(docs: DataFrame, *, text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: dict[str, list[list[str]]] = RULES, titles: dict[str, list[list[str]]] | None = None) -> DataFrame:
    """docs with n_sentences (known sentences found) and licenses: map of licence -> matches."""
    number = {name: i for i, name in enumerate(sentences, 1)}
    titles = (TITLES if rules is RULES else {}) if titles is None else titles
    text = F.col(f"`{text_col}`")
    names = [c for c in docs.columns if c not in ("n_sentences", "licenses")]
    low = F.lower(F.coalesce(text, F.lit("")))
    some = reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in anchors(sentences)], F.lit(False))
    none = F.array().cast("array<int>")
    boxed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.when(some, F.array(identifiers(text, sentences, END_LINES), identifiers(text, sentences, END_BLANKS))).otherwise(F.array(none, none)).alias("ids"))

    def matches(lic: str) -> Callable[[Column], Column]:
        def of(ids: Column) -> Column:
            # Most rules are one sentence that no longer rule holds: these are counted together.
            alone = [number[r[0]] for r in rules[lic] if len(r) == 1 and not longer_rules(rules, lic, r)]
            parts = [F.size(F.filter(ids, lambda i: i.isin(*alone)))] if alone else []
            for r in rules[lic]:
                if len(r) == 1 and number[r[0]] in alone:
                    continue
                n = count_rule(ids, [number[x] for x in r])
                over = [count_rule(ids, [number[x] for x in long]) for long in longer_rules(rules, lic, r)]
                parts.append(F.greatest(n - sum(over[1:], over[0]), F.lit(0)) if over else n)
            whole = sum(parts[1:], parts[0])
            heads = [F.least(count_rule(ids, [number[x] for x in r]), F.lit(1)) for r in titles.get(lic, [])]
            return F.greatest(whole, *heads) if heads else whole

        return of

    found = F.array(*[F.struct(F.lit(lic).alias("k"), F.array_max(F.transform("ids", matches(lic))).alias("v")) for lic in rules if rules[lic]])
    any_ = F.exists("ids", lambda x: F.size(x) > 0)
    licenses = F.when(any_, F.map_from_entries(F.filter(found, lambda x: x["v"] > 0))).otherwise(F.create_map().cast("map<string,int>"))
    return boxed.select("row.*", F.array_max(F.transform("ids", lambda x: F.size(x))).alias("n_sentences"), licenses.alias("licenses"))


def report(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_sentences, n_licenses, licenses as 'name:count' in alphabetical order)."""
    names = F.array_sort(F.transform(F.map_entries("licenses"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))))
    return scanned.select(id_col, F.col("n_sentences").cast("bigint").alias("n_sentences"), F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join(names, ",").alias("licenses"))


def oracle() -> str:
    """DuckDB SQL for report(scan(documents)): every text is searched for the sentences, without cutting it into pieces."""
    number = {name: i for i, name in enumerate(SENTENCES, 1)}
    whole = {name: known_as(x) for name, x in SENTENCES.items()}
    # An end is two marks, so that sentences that follow each other are both found between marks.
    cut = {name: [x for x in map(normalise, re.split(STOP, SENTENCES[name])) if x] for name in SENTENCES}
    pieces = {name: "[ \\x01]*\\x01[ \\x01]*".join(cut[name]) if len(cut[name]) > 1 else whole[name] for name in SENTENCES}
    # Longer ones first: RE2 takes the first alternative that fits.
    search = "\\x01 ?(" + "|".join(sorted(pieces.values(), key=len, reverse=True)) + ") ?\\x01"
    names = "[" + ", ".join(f"'{whole[n]}'" for n in SENTENCES) + "]"
    plain = "trim(regexp_replace(x, '[ \\x01]+', ' ', 'g'))"
    # RE2 has no look-ahead: a stop takes the white space after it along, which is no part of a sentence.
    def ids(ends: str) -> str:
        flat = f"chr(1) || regexp_replace(regexp_replace(lower(replace(coalesce(text, ''), chr(1), chr(1) || chr(1))), '{ends}', chr(1) || chr(1), 'g'), '[^a-z0-9\\x01]+', ' ', 'g') || chr(1)"
        for name, begin, end in SLOTS:
            flat = f"regexp_replace({flat}, '\\b{begin}(?:[ \\x01]+[a-z0-9]+){{1,{SLOT_WORDS}}}?[ \\x01]+{end}\\b', chr(1) || chr(1) || '{whole[name]}' || chr(1) || chr(1), 'g')"
        flat = f"regexp_replace(regexp_replace({flat}, '\\x01 ?{STATEMENT}', chr(1) || 'under ', 'g'), '{POINTER} ?\\x01', chr(1), 'g')"
        return f"list_transform(regexp_extract_all({flat}, '{search}'), lambda x: list_position({names}, {plain}))"

    lines, blanks = ids(r"[.!?;]+(?:\s|$)|[\r\n]+"), ids(r"[.!?;]+(?:\s|$)|[\r\n][\s[:punct:]]*[\r\n]")
    one = lambda c, r: f"(list_reduce(list_prepend(0, {c}), lambda p, h: CASE WHEN h = [{', '.join(str(number[x]) for x in r)}][p % {len(r)} + 1] THEN p + 1 ELSE p END) // {len(r)})"

    def rule(c: str, lic: str, r: list[str]) -> str:
        over = longer_rules(RULES, lic, r)
        return f"greatest({one(c, r)} - ({' + '.join(one(c, x) for x in over)}), 0)" if over else one(c, r)

    heads = lambda c, lic: "".join(f", least({one(c, r)}, 1)" for r in TITLES.get(lic, []))
    counts = ", ".join(f"{{'k': '{lic}', 'v': greatest({', '.join('+'.join(rule(c, lic, r) for r in rs) + heads(c, lic) for c in ('a', 'b'))})}}" for lic, rs in sorted(RULES.items()))
    return f"WITH s AS MATERIALIZED (SELECT doc_id, {lines} AS a, {blanks} AS b FROM documents), f AS (SELECT doc_id, greatest(len(a), len(b)) AS n_sentences, list_filter([{counts}], lambda x: x.v > 0) AS m FROM s) SELECT doc_id, n_sentences, len(m) AS n_licenses, array_to_string(list_transform(m, lambda x: x.k || ':' || x.v), ',') AS licenses FROM f"
