import textwrap
import time

import duckdb

from orrery.llm import license_scan as L

NAMED = {
    "MPL-2.0": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.',
    "MIT": 'MIT License\n\nCopyright (c) 2020 A. Writer\n\n' + L.SENTENCES["mit-1"] + '\n\n' + L.SENTENCES["mit-2"] + '.\n\n' + L.SENTENCES["mit-3"] + '. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law, software is distributed on an "AS IS" BASIS.',
    "GPL-3.0": L.SENTENCES["gpl-1"] + '.\n\n' + L.SENTENCES["gpl-2"] + '; without even the implied warranty of MERCHANTABILITY.',
    "BSD-3-Clause": L.SENTENCES["bsd-intro"] + '\n\n1. ' + '.\n\n2. '.join(L.SENTENCES[f"bsd-{i}"] for i in (1, 2)) + '.\n\n3. ' + L.SENTENCES["bsd-3"] + '.',
    "BSD-2-Clause": L.SENTENCES["bsd-intro"] + '\n\n* ' + L.SENTENCES["bsd-1"] + '.\n\n* ' + L.SENTENCES["bsd-2"] + '.\n\nTHIS SOFTWARE IS PROVIDED "AS IS".',
    "ISC": 'Copyright (c) 2020, A. Writer\n\n' + L.SENTENCES["isc-1"] + '.\n\nTHE SOFTWARE IS PROVIDED "AS IS".',
    "Unlicense": L.SENTENCES["unlicense-1"] + '.\n\nAnyone is free to copy this software.',
    "CC-BY-4.0": L.SENTENCES["cc-by-long"] + '.',
    "CC-BY-NC-4.0": L.SENTENCES["cc-by-nc-long"] + '.',
    "CC-BY-SA-4.0": L.SENTENCES["cc-by-sa-short"] + '.',
    "CC0-1.0": L.SENTENCES["cc0-short"] + '.',
}


# The others by each of their rules, as the table has it.
NAMED |= {name: "\n\n".join(L.SENTENCES[x] + "." for x in rules[0]) for name, rules in L.RULES.items() if name not in NAMED}


def test_every_rule_and_sentence_fires(spark):
    """Each rule's text gives its licence, once, and no other; each sentence of the table is found."""
    rows = [(f"{name} {i}", name, "\n\n".join(L.SENTENCES[x] + "." for x in rule)) for name, rules in L.RULES.items() for i, rule in enumerate(rules)]
    rows += [(f"sentence {n}", None, f"before. {x}. after") for n, x in L.SENTENCES.items()]
    got = L.scan(spark.createDataFrame(rows, "id string, name string, text string")).collect()
    assert [r["id"] for r in got if r["name"] and r["licenses"] != {r["name"]: 1}] == []
    assert [r["id"] for r in got if not r["name"] and r["n_sentences"] != 1] == []


def test_every_licence_wrapped_and_commented(spark):
    assert set(NAMED) == set(L.RULES)
    rows = []
    for name, text in NAMED.items():
        lines = "\n\n".join(textwrap.fill(x, 70) for x in text.split("\n\n")).split("\n")
        rows += [(name, "plain", "\n".join(lines)), (name, "hash", "\n".join(f"# {x}".rstrip() for x in lines) + "\n\nimport os\n"), (name, "star", "/*\n" + "\n".join(f" * {x}".rstrip() for x in lines) + "\n */\nint x;\n")]
    got = L.scan(spark.createDataFrame(rows, "name string, kind string, text string")).collect()
    assert [(r["name"], r["kind"]) for r in got if r["licenses"] != {r["name"]: 1}] == []


HOLDERS = ["the copyright holder", "Google Inc.", "the University of California, Berkeley", "Acme & Sons (Holding) Ltd."]
ONE_LINE = [
    "This file is released under the {}.", "This project is licensed under the terms of the {}.", "License: {}", "Distributed under the {}.",
    "The source code is available under the {}", "This project is licensed under the {} - see the LICENSE file for details.", "# Licensed under {}.",
]


def variants():
    """(licence, text) that the tables don't hold as they are: other holders, one-line forms of each name, headings."""
    out = [(lic, form.format(n)) for lic, names in L.NAMES.items() for n in names for form in ONE_LINE]
    for holder in HOLDERS:
        body = L.SENTENCES["bsd-intro"] + "\n\n1. " + ".\n\n2. ".join(L.SENTENCES[f"bsd-{i}"] for i in (1, 2))
        end = "used to endorse or promote products derived from this software without specific prior written permission."
        out += [("BSD-3-Clause", f"{body}.\n\n3. {x} be {end}") for x in (f"Neither the name of {holder} nor the names of its contributors may", f"Neither the names of {holder} nor the names of their contributors may", f"The name of {holder} may not")]
        out.append(("MIT", f"MIT License\n\nCopyright (c) 2021 {holder}\n\n{L.SENTENCES['mit-1']}\n\n{L.SENTENCES['mit-2']}.\n\n{L.SENTENCES['mit-3']}."))
    out += [(lic, "\n".join(f"{x:^70}" for x in r) + "\n\nTERMS AND CONDITIONS\n") for lic, rs in L.HEADINGS.items() for r in rs]
    return out


def test_variants_are_named(spark):
    rows = variants()
    got = L.scan(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [(r["name"], r["text"], r["licenses"]) for r in got if r["licenses"] != {r["name"]: 1}] == []
    none = ["under the sun", "The MIT campus", "Released under pressure", "the name of the rose", "Neither the name nor the age", "A license: none", "version 2.0, January 2004", "I walked under the MIT dome."]
    assert L.scan(spark.createDataFrame([(x,) for x in none], "text string")).filter("size(licenses) > 0").count() == 0


def test_long_runs_take_no_time(spark):
    """1 MB of stops, line ends, pieces of a sentence and beginnings of slots, each with an anchor word."""
    n = 1_000_000
    texts = ["MIT License" + "." * n + "a", "MIT License\n" + "\n." * (n // 2) + "a", "Mozilla Public License, v" + ". " * (n // 2) + "x", "neither the name of " * (n // 20) + "License", "License " + "this a b c is " * (n // 14), "neither the name of " + "x" * n + " license"]
    rows = [r["licenses"] for r in L.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    began = time.time()
    assert rows == [r["licenses"] for r in L.scan(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert rows[1] == {"MIT": 1} and not any(rows[:1] + rows[2:]) and time.time() - began < 60


def test_pieces_alone_are_no_sentence(spark):
    rows = [("Version v. 2.0. And 2.0. More",), ("the Mozilla Public License, v. 2.0.",)]
    assert [(r["n_sentences"], r["licenses"]) for r in L.scan(spark.createDataFrame(rows, "text string")).collect()] == [(0, {}), (0, {})]


def test_sql_on_the_same_texts(spark, tmp_path):
    """The SQL finds by search what the operator finds by cutting."""
    rows = [(i, t) for i, t in enumerate([*NAMED.values(), *(t for _, t in variants()), *["\n".join(f"# {x}".rstrip() for x in t.split("\n")) for t in NAMED.values()], None, "", "A. Released under the MIT License. Released under the MIT License.\nB", "x\x01Released under the MIT License\x01Licensed under CC BY 4.0"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = sorted(con.execute(L.oracle()).fetchall())
    assert sorted(tuple(r) for r in L.report(L.scan(df)).collect()) == want
