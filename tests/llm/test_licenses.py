import llm_fixtures as X
import pytest
from llm_fixtures import docs, empty  # noqa: F401

from clauselens.llm import licenses as L

TEXT = {f"{n}#{i:02d}": t for i, (n, t, _) in enumerate(L.TEMPLATES)}
MIT_LINE, MIT_TEXT = (t for n, t, _ in L.TEMPLATES if n == "MIT")


def rows(spark, data):
    return spark.createDataFrame([(d, t, "x", "y") for d, t in data], "doc_id long, text string, license string, keys string")


def test_notices_are_found_anywhere(spark):
    filler = " ".join(f"filler{i}" for i in range(333))
    data = [(i * 10 + k, f"{filler[:n]} {t} {filler}") for i, t in enumerate(TEXT.values()) for k, n in enumerate((0, 117, 700, 2500))]
    data += [(900, "Released under  the\nMIT license!"), (901, "Released under the ISC License."), (902, None), (903, ""), (904, "MIT License"),
             (None, MIT_LINE), (905, MIT_LINE * 40), (905, MIT_LINE)]
    got = {}
    for r in L.scan(rows(spark, data), L.known_templates(spark)).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["containment"]
    for i, (name, _, _) in enumerate(L.TEMPLATES):
        for k in range(4):
            assert got[i * 10 + k] == {name: 1.0}, (name, k)           # and no other license
    assert got[900] == {"MIT": 1.0} and got[905] == {"MIT": 1.0} and got[None] == {"MIT": 1.0}
    assert not {901, 902, 903, 904} & set(got)


def test_changed_notice_needs_four_fifths(spark):
    words = MIT_TEXT.split()
    near, far = list(words), list(words)
    near[20] = "changed"
    far[5::6] = ["changed"] * len(far[5::6])
    got = L.scan(rows(spark, [(1, " ".join(near)), (2, " ".join(far))]), L.known_templates(spark)).collect()
    assert [r["doc_id"] for r in got] == [1] and 0.8 <= got[0]["containment"] < 1


def test_many_blocks_give_the_same(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, L.scan(df, L.known_templates(spark)).collect()))
    monkeypatch.setattr(L, "BLOCK_KEYS", 40)
    assert sorted(map(tuple, L.scan(df, L.known_templates(spark)).collect())) == want and want


def test_edge_rows_and_empty_tables(spark, docs, empty):
    known = L.known_templates(spark)
    assert L.scan(docs, known).count() == 0
    assert L.scan(empty, known).count() == 0 and L.scan(docs, known.limit(0)).count() == 0
    short = spark.createDataFrame([("s", "s", "too short")], "template string, license string, text string")
    with pytest.raises(ValueError):
        L.scan(docs, short)


def test_no_python_in_the_plan(spark, docs):
    plan = L.scan(docs, L.known_templates(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def licenses_of(spark, texts):
    got = {k: {} for k in texts}
    ids = dict(enumerate(texts))
    for r in L.scan(rows(spark, [(i, texts[k]) for i, k in ids.items()]), L.known_templates(spark)).collect():
        got[ids[r["doc_id"]]][r["license"]] = r["containment"]
    return got


def test_near_misses_are_told_apart(spark):
    gpl = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
           "by the Free Software Foundation; either version {} of the License, or (at your option) any later version.")
    no_third = L._BSD_HEAD + L._BSD_TAIL
    third = L._BSD_HEAD + L._BSD_THIRD + L._BSD_TAIL
    # The usual later wording of the head, and another holder's name in the third clause.
    got = licenses_of(spark, {
        "gpl2": gpl.format(2), "gpl3": gpl.format(3), "gpl4": gpl.format(4), "lgpl": gpl.format(3).replace("GNU General", "GNU Lesser General"),
        "lgpl21": gpl.format("2.1").replace("GNU General", "GNU Lesser General").replace("program", "library"),
        "agpl": gpl.format(3).replace("GNU General", "GNU Affero General"), "bsd2": no_third, "bsd3": third,
        "bsd3 other holder": third.replace("the copyright holder nor", "ACME Research Inc. nor"),
        "lgpl line": "This work is licensed under the GNU Lesser General Public License, version 3.",
        "agpl line": "This work is licensed under the GNU Affero General Public License, version 3.",
        "gpl2 line": "This work is licensed under the GNU General Public License, version 2.",
        "cc 3": "Licensed under CC BY-NC 3.0.", "cc by-nc-sa": "Licensed under CC BY-NC-SA 4.0.", "apache 1": "Licensed under the Apache License, Version 1.1.",
        "bsd head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"})
    assert {k: set(v) for k, v in got.items()} == {
        "gpl2": {"GPL-2.0"}, "gpl3": {"GPL-3.0"}, "gpl4": set(), "lgpl": {"LGPL-3.0"}, "lgpl21": {"LGPL-2.1"}, "agpl": {"AGPL-3.0"},
        "bsd2": {"BSD-2-Clause"}, "bsd3": {"BSD-3-Clause"}, "bsd3 other holder": {"BSD-3-Clause"}, "lgpl line": {"LGPL-3.0"}, "agpl line": {"AGPL-3.0"},
        "gpl2 line": {"GPL-2.0"}, "cc 3": set(), "cc by-nc-sa": set(), "apache 1": set(), "bsd head": set()}


def test_neighbouring_notices_are_all_found(spark):
    lines = {n: t for n, t, _ in reversed(L.TEMPLATES) if len(t.split()) < 16}
    texts = {"all": " ".join(lines.values()), "back": " ".join(reversed(list(lines.values()))),
             "bsd": " ".join([L._BSD_HEAD + L._BSD_TAIL, "and", L._BSD_HEAD + L._BSD_THIRD + L._BSD_TAIL]),
             "cc": "Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0. Licensed under CC BY-NC 4.0."}
    got = licenses_of(spark, texts)
    assert set(got["all"]) == set(got["back"]) == set(lines)
    assert set(got["bsd"]) == {"BSD-2-Clause", "BSD-3-Clause"} and set(got["cc"]) == {"CC-BY-NC-4.0", "CC-BY-SA-4.0"}


def test_spans_lie_where_the_notice_is(spark):
    text = " ".join(f"filler{i}" for i in range(100)) + " " + MIT_LINE + " " + " ".join(f"more{i}" for i in range(100))
    (r,) = L.matches(rows(spark, [(1, text)]), L.known_templates(spark)).collect()
    assert (r["license"], r["start"], r["end"], r["containment"]) == ("MIT", 100, 102, 1.0)


def test_scan_equals_sql_on_planted_notices(spark, tmp_path):
    import random

    import duckdb
    rng = random.Random(5)
    data = []
    for i in range(120):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(L.TEMPLATES)[1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                w[rng.randrange(len(w))] = rng.choice(["changed", "the", "2", "3", "version"])
            parts += [*w, *(f"f{rng.randrange(99)}" for _ in range(rng.choice([0, 2, 40])))]
        data.append((i, " ".join(parts)))
    spark.createDataFrame(data, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = sorted(con.execute(L.oracle_sql()).fetchall())
    got = sorted(map(tuple, L.scan(spark.read.parquet(str(tmp_path / "d")), L.known_templates(spark)).collect()))
    assert got == want and len(got) > 120


def test_required_words_must_be_in_the_template(spark, docs):  # noqa: F811
    bad = spark.createDataFrame([("t", "t", "six words are in this template", ["not in it"])], "template string, license string, text string, required array<string>")
    with pytest.raises(ValueError):
        L.scan(docs, bad)
