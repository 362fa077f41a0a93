import re
import textwrap

import duckdb
import pandas as pd

from shelfwatch.llm import licenses, queries
from shelfwatch.llm.license_texts import LICENSES

from ..compare import rows_of, rows_of_sql


def test_each_licence_in_any_wrap(spark):
    rows, want = [], {}

    def add(name, text):
        want[len(rows)] = name
        rows.append((len(rows), text))

    names = licenses.known_digests(spark, LICENSES).count()
    texts = [x for k, x in enumerate(LICENSES) if not x[0].startswith("BSD") or k % 17 == 0]
    assert len({n for n, _ in LICENSES}) >= 20 and names > 100
    for k, (name, text) in enumerate(texts):
        paragraphs = [" ".join(p.split()) for p in re.split(r"\n[ \t]*\n", text.strip())]
        for width in (47, 72, 10**6):
            body = "\n\n".join(textwrap.fill(p, width, break_on_hyphens=False) for p in paragraphs)
            for notice in ("", "Copyright (c) 2020 Someone\n\n", "Copyright 2019-2021, A Holder. All rights reserved.\n\n", "© 2020 Someone\nCopyright 2021 Someone Else with a long name\nand others\n\n"):
                add(name, notice + body)
            add(name, body.upper())
            add(name, "\n".join(f"// {line}" for line in body.split("\n")))
        add(name, re.sub(r"\blicense\b", "licence", body).replace('"', "“"))
    for name, text in LICENSES[:19]:
        if text.startswith(("Permission", "This software", "MIT", "The MIT")):
            first, _, rest = text.partition("Permission") if "MIT" in text[:12] else ("", "", text)
            add(name, f"{first} Copyright (c) 2020 Someone Permission {rest}" if first else "Copyright (c) 2020 Someone " + " ".join(text.split()))  # all in one line
        add(None, text + " and more")
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    wrong = [(want[k], got[k], rows[k][1][:90]) for k in want if want[k] != got[k]]
    assert (len(wrong), wrong) == (0, [])


def test_only_notices_are_dropped(spark):
    dropped = ["Copyright (c) 2020 X", "copyright © X", "(c) 1999 Y", "(C) Y", "Copyright 2020 X", "# Copyright (c) X", "All rights reserved.", "© X", "Copyright: X", "Copyright by X", "Copyright <year> <holder>", "Copyright [yyyy] [name]", "Copyright Jane Doe, 2020"]
    kept = ["copyright notice and this permission notice", "COPYRIGHT HOLDERS BE LIABLE", "copyright law applies", "All rights reserved to the holder stay", "Copyright owners may sue"]
    rows = spark.createDataFrame([(t,) for t in dropped + kept], "t string").select("t", licenses.canonical(licenses.F.col("t")).alias("c")).collect()
    assert {r.t for r in rows if r.c} == set(kept)


def test_the_sql_finds_the_same_licences(spark):
    rows = []
    for name, text in LICENSES[::3]:
        for notice in ("", "Copyright (c) 2020 Someone\n\n"):
            rows += [(len(rows), notice + text), (len(rows) + 1, text.upper() + " and more")]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["doc_id", "text"])
    con.register("documents", frame)
    # Names, not digests: the SQL's paragraphs leave other words of a few notices on both sides.
    got, wanted = ([r[1:] for r in found] for _, found in (rows_of(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"))), rows_of_sql(con, queries.ORACLE_SQL["op4_license_scan"])))
    assert sorted(got) == sorted(wanted)
    assert sum(r[1] != "null" for r in got) == len(rows) / 2
