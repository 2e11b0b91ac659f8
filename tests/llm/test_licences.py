"""Licence sentences and rules."""

import textwrap

from compare import compare, connect
from srcloom.llm import licences
from srcloom.llm.queries import ORACLES, QUERIES


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.sentence_ids, r.licences, r.n_unmatched) for r in licences.scan(docs, ["doc_id"]).collect()}


def test_texts(spark):
    wording = dict(line.split(" ", 1) for line in licences.SENTENCES.strip().splitlines())
    rows = found(
        spark,
        [
            None,
            "",
            "Nothing to see. At all!",
            "Some words. Licensed under the Apache License, Version 2.0. More words",
            "# RELEASED under\tthe MIT   licence... no.\n * Released under the MIT License!",
            f"{wording['gplfree']}\n{wording['gplhope']} {wording['gplsee']}",
            f"{wording['gplsee']} {wording['gplfree']}",
            f"{wording['gpl2free']}",
            f"{wording['mitnotice']}\n\n{wording['mitgrant']}",
            "All rights reserved.\nAll rights reserved.\nReleased under the MIT License.",
            "x " * 200_000 + ". Licensed under CC0 1.0.",
        ],
    )
    assert rows[0] == rows[1] == rows[2] == ([], [], 0)
    assert rows[3] == (["apachename"], ["Apache-2.0"], 0)
    assert rows[4] == (["mitname"], ["MIT"], 0)
    assert rows[5][1:] == (["GPL-3.0-or-later"], 0) and len(rows[5][0]) == 5
    assert rows[6][1:] == (["GPL-3.0-or-later"], 1)
    assert rows[7][1:] == (["GPL-2.0-or-later"], 0)
    assert rows[8][1] == [] and rows[8][2] == 2
    assert rows[9] == (["reserved", "reserved", "mitname"], ["MIT", "All-Rights-Reserved"], 0)
    assert rows[10][1] == ["CC0-1.0"]


def test_wrapped_and_commented_texts(spark):
    wording = dict(line.split(" ", 1) for line in (licences.SENTENCES + licences.CLAUSES.lstrip()).strip().splitlines())

    def wrapped(names, mark, width):
        """Paragraphs hard-wrapped behind a comment mark, with a mark alone between them."""
        return f"\n{mark}\n".join("\n".join(f"{mark} {x}" for x in textwrap.wrap(wording[n], width)) for n in names.split())

    bsd = wrapped("bsdgrant bsdsource bsdbinary", " *", 60)
    third = wording["bsdendorse"].replace("of *", "of Example Inc.", 1).replace("*", "its")
    author = wording["bsdauthor"].replace("*", "the author")
    cases = {
        "GPL-3.0-or-later": [wrapped("gplfree gplhope gplsee", m, w) for m in (" *", "#", ";;", "//", "dnl", "") for w in (30, 72)],
        "GPL-2.0-or-later": ["/*\n" + wrapped("gpl2free", " *", 40) + "\n */\nint x;"],
        "MIT": [wrapped("mitgrant mitnotice", "#", 70).replace("\n", "\r\n")],
        "Apache-2.0": [wrapped("apachelong", "#", 40) + "\n" + wrapped("apacheuse", "#", 40)],
        "BSD-2-Clause": [bsd, " * a table |\n" + bsd],
        "BSD-3-Clause": [f"{bsd}\n *\n" + "\n".join(f" * {x}" for x in textwrap.wrap(f"{n} {t}", 60))
                         for n in ("3.", "(3)", "c)") for t in (third, author)],
        "BSD-4-Clause": [f"{bsd}\n" + wrapped("bsdads", " *", 60) + f"\n * This product includes software.\n * {third}"],
    }
    texts = [(name, text) for name, own in cases.items() for text in own]
    rows = found(spark, [t for _, t in texts])
    assert [(rows[i][1], rows[i][2]) for i in range(len(texts))] == [([name], 0) for name, _ in texts]
    split = wording["mitgrant"].replace("any person", "any\n\nperson")
    assert found(spark, [split, "Released under. The MIT License.", "\n" * 100_000 + "MIT"])[0][0] == []


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.", "x"), (1, "All rights reserved.", "x"), (None, None, None)],
                                 "doc_id long, text string, Licences string")
    rows = licences.scan(docs, docs.columns).collect()
    assert len(rows) == 3 and rows[0].asDict().keys() == {"doc_id", "text", "sentence_ids", "licences", "n_unmatched"}
    assert licences.scan(docs.limit(0), ["doc_id"]).count() == 0


def test_query_equals_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf_dir), QUERIES["op7_licences"], ORACLES["op7_licences"], sf_dir) == []


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op7_licences"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


WORDINGS = {
    "// SPDX-License-Identifier: MIT\nint x;": ["MIT"],
    "# SPDX-License-Identifier: GPL-3.0-or-later\n": ["GPL-3.0-or-later"],
    "/* SPDX-License-Identifier: BSD-3-Clause */": ["BSD-3-Clause"],
    "mit. und so weiter": [],
    "This project is licensed under the MIT License - see the LICENSE file for details.": ["MIT"],
    "Licensed under the MIT License - see LICENSE.": ["MIT"],
    " * This library is free software; you can redistribute it and/or\n * modify it under the terms of the GNU Lesser General Public\n"
    " * License as published by the Free Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.\n": ["LGPL-2.1-or-later"],
    "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
    "copyright notice and this permission notice appear in all copies.\n": ["ISC"],
    "This is free and unencumbered software released into the public domain.": ["Unlicense"],
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ["AGPL-3.0-or-later"],
}


def test_further_wordings(spark):
    docs = spark.createDataFrame(list(enumerate(WORDINGS)), "doc_id int, text string")
    found = {r.doc_id: r.licences for r in licences.scan(docs, ["doc_id"]).collect()}
    assert [found[i] for i in range(len(WORDINGS))] == list(WORDINGS.values())
