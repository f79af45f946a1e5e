import re

import duckdb
import pytest

from ragspark.llm import licenses

MIT = '''MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.'''

GPL = '''This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.'''

MPL = '''This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.'''

APACHE = '''Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0'''

BSD2 = '''Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
'''
BSD3 = BSD2 + '''
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
'''
ISC = '''Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.'''


def commented(text, mark):
    return "\n".join(f"{mark} {line}".rstrip() for line in text.split("\n"))


NOTICES = [(MIT, {"MIT"}), (GPL, {"GPL-3.0-or-later"}), (GPL.replace("software:", "software;").replace("version 3", "version 2"), {"GPL-2.0-or-later"}),
           (MPL, {"MPL-2.0"}), (APACHE, {"Apache-2.0"}), (BSD2, {"BSD-2-Clause"}), (BSD3, {"BSD-3-Clause"}), (ISC, {"ISC"}),
           ("// SPDX-License-Identifier: Apache-2.0\nint x;", {"Apache-2.0"}), ("# SPDX-License-Identifier: GPL-3.0-or-later", {"GPL-3.0-or-later"}),
           ("SPDX-License-Identifier: GPL-2.0-only", {"GPL-2.0"}), (MIT + "\n\n" + APACHE, {"MIT", "Apache-2.0"})]

TEXTS = [
    "Intro.\nReleased under the MIT License.\nMore",
    "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.",
    BSD2.replace("\n", " "),
    "this work is licensed under the gnu general public license, version 3", "  * MIT   License  *  ", "The licence is unlike.", "", None,
    "filler words here. " * 40000 + "Released under the MIT License.",
    "A title\nReleased under the\nMIT License\nand no more", "Not released under the MIT License at all.", ";:;:" * 50000 + "MIT License", "法" * 50000 + ".\nMIT License",
]


def rows_of_texts():
    full = TEXTS + [t for t, _ in NOTICES] + [commented(t, m) for t, _ in NOTICES for m in ("//", " *", "#", ";;")]
    return list(enumerate(full))


@pytest.fixture(scope="module")
def scanned(docs):
    got = {}
    for r in licenses.scan_licenses(docs(rows_of_texts())).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    return got


def test_notices_as_they_stand_wrapped_and_commented(scanned):
    base = len(TEXTS)
    for k, (text, want) in enumerate(NOTICES):
        for i in (base + k, *(base + len(NOTICES) + 4 * k + m for m in range(4))):
            assert scanned.get(i) == want, (i, text[:60])


def test_every_known_sentence_can_be_found(docs):
    rows = [(i, s) for i, (_, s) in enumerate(licenses.ALL_SENTENCES)]
    one = [(f"L{i}", (name,)) for i, (name, _) in enumerate(licenses.ALL_SENTENCES)]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan_licenses(docs(rows), rules=one).collect()}
    assert got == {i: name for i, (name, _) in enumerate(licenses.ALL_SENTENCES)}


def test_rules_nulls_and_long_texts(docs, clashes):
    rows = list(enumerate(TEXTS)) + [(1, TEXTS[1]), (None, TEXTS[0])]
    got = sorted((str(r["doc_id"]), r["license"]) for r in licenses.scan_licenses(docs(rows, extra=clashes)).collect())
    assert got == sorted([
        ("0", "MIT"), ("1", "Apache-2.0"), ("1", "CC-BY-NC-4.0"), ("1", "Apache-2.0"), ("1", "CC-BY-NC-4.0"), ("2", "BSD-2-Clause"),
        ("3", "GPL-3.0"), ("4", "MIT"), ("8", "MIT"), ("9", "MIT"), ("11", "MIT"), ("12", "MIT"), ("None", "MIT")])
    assert licenses.scan_licenses(docs([])).count() == 0


def test_order_of_sentences_matters(docs):
    rules = [("X", ("A", "B"))]
    known = [("A", "first thing"), ("B", "second thing")]
    rows = [(1, "First thing. Second thing."), (2, "Second thing. First thing."), (3, "First thing. Else. Second thing"), (4, "First\nthing:\nsecond thing;")]
    got = {r["doc_id"] for r in licenses.scan_licenses(docs(rows), sentences=known, rules=rules).collect()}
    assert got == {1, 3, 4}


def test_same_as_sql(spark, tmp_path, docs):
    docs(rows_of_texts()).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(map(str, con.execute(f"SELECT doc_id, license, rule, sentence_ids, n_sentences FROM ({licenses.OP8_SQL})").fetchall()))
    assert sorted(str(tuple(r)) for r in licenses.op8_license_scans(spark, str(tmp_path)).collect()) == want


def test_known_sentences_are_normal_and_rules_known():
    assert all(re.sub("[^a-z0-9]+", " ", s).strip() == s for _, s in licenses.ALL_SENTENCES)
    assert {i for _, ids in licenses.ALL_RULES for i in ids} <= {i for i, _ in licenses.ALL_SENTENCES}
