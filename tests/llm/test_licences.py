"""Licence texts as they occur: wrapped, in comments, with their own punctuation."""

import textwrap

import duckdb
import pytest

from pagewright.llm import licences
from pagewright.llm.queries import ORACLES

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE."""
BSD2 = """Copyright (c) 2020, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD3 = BSD2 + """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."
WANT = [(MIT, 1, "MIT", 3), (BSD3, 3, "BSD-3-Clause", 5), (BSD2, 4, "BSD-2-Clause", 4), (APACHE, 5, "Apache-2.0", 3), (GPL, 6, "GPL-3.0-or-later", 2), (MPL, 11, "MPL-2.0", 1)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_licences(spark, end):
    rows, want = [], {}
    for text, rule, name, n in WANT:
        for width in (30, 72, 78, 10_000):
            for sign in ("", "# ", " * ", "// "):
                lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(part, width), ""]]
                want[len(rows)] = (rule, name, n)
                rows.append((len(rows), end.join((sign + x).rstrip() for x in ["Some code", "", *lines, "more"])))
    got = {r["doc_id"]: (r["rule"], r["licence"], r["n_known"]) for r in licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_sentences_do_not_run_over_blank_lines_or_into_others(spark):
    rows = [(1, "All rights\n\nreserved."), (2, "All rights\n#\n# reserved."), (3, "not all rights reserved here"), (4, "All rights reserved\nReleased under\nthe MIT License"), (5, "-" * 5000 + "\n" * 5000 + "." * 5000)]
    got = {r["doc_id"]: r["sentence_ids"] for r in licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "", 4: "all-rights,mit-tag", 5: ""}


LGPL = GPL.replace("This program is", "This library is").replace("GNU General", "GNU Lesser General")
MORE = [
    (LGPL, "LGPL-3.0-or-later"),
    (LGPL.replace("version 3 of", "version 2.1 of"), "LGPL-2.1-or-later"),
    (GPL.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"),
    (GPL.replace("version 3 of", "version 2 of"), "GPL-2.0-or-later"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT", "ISC"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "0BSD"),
    ("This software is provided 'as-is', without any express or implied warranty. In no event\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "Zlib"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/", "EPL-2.0"),
    ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache-2.0"),
    ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
    ("CC0 1.0 Universal", "CC0-1.0"),
    ("MIT License", "MIT"),
]


def test_further_licences(spark):
    rows = [(i, "\n".join(("// " + x).rstrip() for x in part.split("\n")), "rule") for i, (part, _) in enumerate(MORE)]
    rows += [(100 + i, "\n".join(x for part in t.split("\n") for x in textwrap.wrap(part, 60) or [""]), "x") for i, (t, _) in enumerate(MORE)]
    rows += [(200, MIT + "\nx" * 400_000, "long"), (201, MIT, "a"), (201, MIT, "a")]
    got = licences.recognise(spark.createDataFrame(rows, "doc_id long, text string, rule string")).collect()
    assert {r["doc_id"]: r["licence"] for r in got if r["doc_id"] < 200} == {k + i: name for i, (_, name) in enumerate(MORE) for k in (0, 100)}
    assert [r["licence"] for r in got if r["doc_id"] >= 200] == ["MIT"] * 3


def test_every_sentence_has_a_telling_word():
    for sentences in (licences.SENTENCES, {"a": "one two", "b": "two three four", "c": "fifth sixth"}):
        words = set(licences.telling_words(sentences))
        assert all(words & set(s.split()) for s in sentences.values())
    assert set(licences.telling_words(licences.SENTENCES)) <= set(licences.TELLING) | {"unencumbered"}
    ids = {i for _, sequence in licences.RULES for i in sequence}
    assert ids <= set(licences.SENTENCES)


def test_sql_finds_what_the_operator_finds(spark):
    texts = [t for t, *_ in WANT] + [t for t, _ in MORE]
    rows = [(i, "\n".join((sign + x).rstrip() for part in t.split("\n\n") for x in [*textwrap.wrap(part, width), ""])) for i, (t, width, sign) in enumerate((t, w, s) for t in texts for w in (25, 70, 9999) for s in ("", "# "))]
    rows += [(1000, None), (1001, ""), (1002, "All rights\n\nreserved."), (1003, MIT + BSD3), (1004, "MIT License\n\n" + MIT), (1005, "all rights reserved. All rights reserved!")]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(map(repr, con.sql(f"SELECT doc_id, sentence_ids, n_known, rule, licence FROM ({ORACLES['op9_licences']})").fetchall()))
    got = licences.recognise(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "sentence_ids", "n_known", "rule", "licence").collect()
    assert sorted(repr(tuple(r)) for r in got) == want
