"""Known licences in every wrapping, and in their published texts."""

import textwrap

import duckdb
import pyarrow

from quernal.llm import licences


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licence for r in licences.licences(rows).orderBy("doc_id").collect()]


def test_wrapped_at_any_width(spark):
    known = [(name, f"Copyright (c) 2020, Some Body\n\n{textwrap.fill(text, width, break_long_words=False, break_on_hyphens=False)}") for name, text in licences.LICENCES for width in range(40, 100, 3)]
    assert found(spark, [text for _, text in known]) == [name for name, _ in known]


def test_isc_as_published(spark):
    isc = """ISC License

Copyright 2019 Some Body

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

""" + licences._AS_IS
    assert found(spark, [isc]) == ["ISC"]


def test_published_texts(spark):
    texts = licences.published()
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= {name for name, _ in texts}
    assert found(spark, [text for _, text in texts]) == [name for name, _ in texts]
    own = dict(reversed(texts))["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2021 Some Body")
    # one line a paragraph, so that '(c) You must retain' and the like are at other places of their lines
    flat = [" ".join(p.split()) for p in own.split("\n\n")]
    assert found(spark, [own, "\n\n".join(flat), "\n\n".join(textwrap.fill(p, 66) for p in flat)]) == ["Apache-2.0"] * 3


def test_copyright_lines(spark):
    lines = ["Copyright (c) 2020 A", "(c) 2020 A", "(C) Some Body", "© A", "# Copyright 2020 A, B", "Copyright: A", "Copyright <year> <name>", "Copyright by The Authors", "Copyright The X Project Developers"]
    assert set(found(spark, [f"{line}\n{licences._MIT}" for line in lines])) == {"MIT"}


def test_wraps_and_points(spark):
    mit = "\n".join(textwrap.wrap(licences._MIT.split(" IN NO EVENT")[0], 70)) + "\nIN NO EVENT SHALL THE AUTHORS OR\nCOPYRIGHT HOLDERS BE LIABLE" + licences._MIT.split("COPYRIGHT HOLDERS BE LIABLE")[1]
    three = licences._BSD + licences._BSD_NAME + licences._BSD_AS_IS
    starred = [text.replace(" 1. ", "\n\n  * ").replace(" 2. ", "\n  * ").replace(" 3. ", "\n  * ") for text in (licences._BSD + licences._BSD_AS_IS, three)]
    dashed = starred[1].replace("* ", "- ")
    assert found(spark, ["Copyright (c) 2020 A\n\n" + mit, *starred, dashed]) == ["MIT", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause"]


def test_rows_are_judged_by_themselves(spark):
    rows = [(None, "nothing"), (None, "x\nReleased under the MIT licence."), (7, "licensed UNDER cc by 4.0"), (7, "plain"), (8, None), (9, ""), (10, "word " * 300_000 + "\nLicensed under CC BY 4.0")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as licence", "'y' as digest", "'z' as plain", "1 as notices")
    got = licences.licences(frame).collect()
    assert sorted((r.doc_id or 0, r.licence, r.notices) for r in got) == sorted([(0, None, []), (0, None, ["MIT"]), (7, None, ["CC-BY-4.0"]), (7, None, []), (8, None, []), (9, None, []), (10, None, ["CC-BY-4.0"])])
    assert len({r.digest for r in got if r.doc_id in (8, 9)}) == 1


def test_notices(spark):
    lines = {
        "Licensed under the Apache License, Version 2.0 (the": [], "// SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"], "# This project is licenced under the MIT licence": ["MIT"],
        "Licensed under the GNU AGPL v3.": ["AGPL-3.0"], "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"], "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.": ["CC-BY-NC-4.0"],
        "We licensed under protest": [], "Released under the MIT License.\nSPDX-License-Identifier: Apache-2.0\nreleased under the mit license": ["Apache-2.0", "MIT"],
    }
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert [r.notices for r in licences.licences(rows).orderBy("doc_id").collect()] == list(lines.values())


def planted():
    """Whole licences, wrapped and with holders, among notices and prose."""
    texts = [None, "", "© notice of a thing", "plain prose", "Copyright notices\nare prose", "(c) Some Body\nwords", "copyright\nnotice", "SPDX-License-Identifier: 0BSD\nx"]
    for name, text in licences.LICENCES + licences.published():
        texts += [text, f"Copyright (c) 2020, Some Body\nAll rights reserved.\n\n{text}", f"{name}\n{text}", text.upper()]
        texts += [f"(c) 1999 A\n\n{textwrap.fill(text, width, break_long_words=False, break_on_hyphens=False)}" for width in (41, 66, 79)]
    return texts


def test_sql_says_the_same_of_planted_rows(spark):
    texts = planted()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    documents = pyarrow.table({"doc_id": list(range(len(texts))), "text": texts})
    with duckdb.connect() as db:
        db.register("documents", documents)
        other = {r[0]: r[1:] for r in db.sql(licences.ORACLE).fetchall()}
    ours = {r.doc_id: (r.digest, r.licence, r.notices) for r in licences.licences(rows).collect()}
    assert ours == other and len({licence for _, licence, _ in ours.values()}) > 20
    asked = [i for i, text in enumerate(texts) if text is not None and text.isascii()]
    assert [licences.plain_digest(texts[i]) for i in asked] == [ours[i][0] for i in asked]


def test_known_texts_of_ones_own(spark):
    own = spark.createDataFrame([("Own-1.0", "Do as you like,\nbut tell."), ("Also", "do as you like but tell"), ("None", None)], "licence string, text string")
    rows = spark.createDataFrame([(1, "DO AS YOU LIKE but tell!"), (2, licences._MIT), (3, "x"), (4, None), (5, "")], "doc_id long, text string")
    assert [r.licence for r in licences.licences(rows, own).orderBy("doc_id").collect()] == ["Also", "MIT", None, None, None]
