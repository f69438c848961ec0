"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import pytest

from chronoloom.llm import bpe, chat, embed_dedup, jaccard_join, licenses, line_dedup, mixing, token_counts, toxicity
from chronoloom.llm import ann
from . import brute, messy

ROWS = messy.rows()
ON_DOCS = {
    "mixing": lambda d, lab: mixing.mix_sources(d, lab), "licenses": lambda d, lab: licenses.scan_licenses(d), "jaccard": lambda d, lab: jaccard_join.jaccard_classes(d),
    "bpe": lambda d, lab: bpe.encode_documents(d), "token_counts": lambda d, lab: token_counts.prefix_token_counts(d), "toxicity": lambda d, lab: toxicity.score_documents(d, lab),
    "line_dedup": lambda d, lab: line_dedup.dedup_lines(d, with_count=True),
}
KEEPING = {
    "mixing": lambda d, lab: mixing.mixed_documents(d, lab), "line_dedup": lambda d, lab: line_dedup.dedup_lines(d),
    "jaccard": lambda d, lab: jaccard_join.drop_near_duplicates(d), "toxicity": lambda d, lab: toxicity.keep_clean(d, lab),
}


@pytest.mark.parametrize("name", ON_DOCS)
def test_empty_tables(spark, name):
    assert ON_DOCS[name](messy.docs(spark, []), messy.labels(spark, [])).collect() == []


@pytest.mark.parametrize("name", KEEPING)
def test_columns_stay_with_clashing_names(spark, name):
    docs = messy.clashing(messy.docs(spark))
    out = KEEPING[name](docs, messy.labels(spark))
    assert out.columns == docs.columns and out.count() > 0
    assert all(r[c] == c for r in out.collect() for c in messy.CLASHES)


@pytest.mark.parametrize("name", ON_DOCS)
def test_extra_columns_change_nothing(spark, name):
    docs, lab = messy.docs(spark), messy.labels(spark)
    plain = ON_DOCS[name](docs, lab)
    wide = ON_DOCS[name](messy.clashing(docs), lab).select(*plain.columns)
    assert sorted(map(str, wide.collect())) == sorted(map(str, plain.collect()))


@pytest.mark.parametrize("name", ["licenses", "bpe", "token_counts", "toxicity", "line_dedup"])
def test_a_row_for_every_row(spark, name):
    got = ON_DOCS[name](messy.docs(spark), messy.labels(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)


def test_jaccard_by_brute_force(spark):
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard_join.jaccard_pairs(messy.docs(spark)).collect()}
    assert got == pytest.approx(brute.jaccard_pairs([(r[0], r[1]) for r in ROWS]))


def test_jaccard_classes_by_brute_force(spark):
    assert {tuple(r) for r in jaccard_join.jaccard_classes(messy.docs(spark)).collect()} == brute.jaccard_classes([(r[0], r[1]) for r in ROWS])


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("1", "a b c d"), ("x", "a b c d"), ("2", "a b c d")], "doc_id string, text string")
    assert {tuple(r) for r in jaccard_join.jaccard_classes(docs).collect()} == {(1, 1, 0, 2), (2, 1, 0, 2)}
    for got in (toxicity.score_documents(docs, messy.labels(spark)), bpe.encode_documents(docs), token_counts.prefix_token_counts(docs)):
        assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "None"]
    vectors_ = spark.createDataFrame([("1", [1.0, 0.0]), ("x", [1.0, 0.0]), ("2", [1.0, 0.01])], "vec_id string, embedding array<float>")
    assert {tuple(r) for r in embed_dedup.embedding_classes(vectors_).collect()} == {(1, 1, 1, 1), (2, 1, 1, 1)}


def test_jaccard_keeps_rows_without_group(spark):
    left = jaccard_join.drop_near_duplicates(messy.docs(spark)).collect()
    gone = brute.keep_first([(r[0], r[1]) for r in ROWS])
    assert sorted(map(str, left)) == sorted(map(str, messy.docs(spark, [r for r in ROWS if r[0] not in gone]).collect()))


def test_line_dedup_by_brute_force(spark):
    got = line_dedup.dedup_lines(messy.docs(spark)).collect()
    expected = brute.line_dedup([(r[0], r[1]) for r in ROWS])
    assert sorted(str((r.doc_id, r.text)) for r in got) == sorted(str((r[0], t)) for r, t in zip(ROWS, expected))


def test_mixing_by_brute_force(spark):
    got = [tuple(r) for r in mixing.mix_sources(messy.docs(spark), messy.labels(spark)).select("doc_id", "source", "copy_no", "position", "n_tokens", "tokens_before").collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute.mixture([(r[0], r[3], r[1]) for r in ROWS], {1: 1, 3: 0, 10: 1, 999: 1})))


def test_licenses_of_null_and_empty(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(messy.docs(spark)).collect()}
    assert (got[4].licenses, got[5].licenses, got[8].sequence) == ("", "", "")


def test_license_rules_in_order(spark):
    s = licenses.SENTENCES
    full = ". ".join(s[i].capitalize() for i in (1, 2, 3)) + "."
    turned = ". ".join(s[i].capitalize() for i in (3, 2, 1)) + "."
    wrapped = "Intro line.\nRedistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\nBye."
    texts = [(1, full), (2, turned), (3, full + "\nSomething else. " + full), (4, wrapped), (5, "Licensed under the MIT license. All rights reserved."), (6, "mitigate license")]
    got = {r.doc_id: (r.sequence, r.matches) for r in licenses.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == ("<1><2><3>", "MIT:text") and got[2] == ("<3><2><1>", "MIT:part") and got[3][0] == "<1><2><3><0><1><2><3>"
    assert got[4][0] == "<0><21><0>" and got[5] == ("<5><80>", "MIT:reference,Proprietary:reference") and got[6] == ("", "")


@pytest.mark.parametrize("marks", [("1. ", "2. ", "3. "), ("  (a) ", "  (b) ", "  (c) "), ("* ", "* ", "* "), ("i) ", "ii) ", "iii) "), ("", "", "")])
def test_licenses_with_numbered_clauses(spark, marks):
    clauses = [
        "Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.",
    ]
    head = "Copyright (c) 2020, A. Person\nAll rights kept.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    rows = [(n, head + "\n\n".join(m + c for m, c in zip(marks, clauses[:n])) + "\n\nTHIS SOFTWARE IS PROVIDED AS IS.", "en", "a", 0) for n in (2, 3)]
    got = {r.doc_id: r for r in licenses.scan_licenses(messy.docs(spark, rows)).collect()}
    assert got[2].matches == "BSD-2-Clause:text" and "BSD-3-Clause:text" in got[3].matches
    assert "<20><21><22><23>" in got[3].sequence


def test_bpe_of_null_and_empty(spark):
    got = {r.doc_id: r for r in bpe.encode_documents(messy.docs(spark)).collect()}
    assert got[5].ids is None and got[5].n_tokens == 0 and got[5].exact is None and got[4].ids == [] and got[4].exact
    assert all(r.exact for r in got.values() if r.ids is not None)


def test_toxicity_of_one_class_or_null(spark):
    assert {r.score for r in toxicity.score_documents(messy.docs(spark), messy.labels(spark)).collect()} == {0.0}
    assert toxicity.keep_clean(messy.docs(spark), messy.labels(spark, [(1, 1, 1), (2, 0, 1)])).count() == len(ROWS)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("turns, error, at", [
    ([(1, 0, "user", "a"), (1, 1, "user", "b")], "role out of order", 1), ([(1, 0, "assistant", "a")], "role out of order", 0), ([(1, 0, "user", "a"), (1, 1, None, "b")], "null role", 1),
    ([(1, None, "user", "a"), (1, 1, "user", "b")], "null turn", None), ([(1, 0, "user", "a"), (1, 0, "user", "a")], "repeated turn", 0), ([(1, 0, "tool", "a")], "unknown role", 0),
    ([(1, 0, "user", None)], "null text", 0), ([(1, 0, "system", "a"), (1, 1, "user", "b"), (1, 2, "system", "c")], "role out of order", 2),
])
def test_broken_chats(spark, turns, error, at):
    got = chat.format_chats(spark.createDataFrame(turns, TURNS)).collect()
    assert [(r.error, r.turn, r.text, r.complete) for r in got] == [(error, at, None, False)]


def test_chat_segments_and_flags(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", ""), (1, 2, "assistant", messy.LONG), (2, 5, "user", "hi"), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, TURNS).selectExpr("*", "'x' AS part", "'y' AS error", "'z' AS complete")
    got = sorted(chat.format_chats(df).collect(), key=lambda r: (r.conv_id, r.turn, r.part_no))
    one = [r for r in got if r.conv_id == 1]
    assert "".join(r.text for r in one) == f"<|startoftext|><|system|>\ns<|end|>\n<|user|>\n<|end|>\n<|assistant|>\n{messy.LONG}<|end|>\n"
    assert [(r.turn, r.part) for r in one if r.loss] == [(2, "body"), (2, "tail")] and all(r.complete for r in one)
    assert not any(r.complete for r in got if r.conv_id == 2) and {r.conv_id for r in got} == {1, 2}
    assert chat.format_chats(spark.createDataFrame([], TURNS)).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (2, [1.0, 0.0, 0.0]), (3, [0.99, 0.05, 0.0]), (4, None), (5, [0.0, 0.0, 0.0]), (6, [nan, 1.0, 0.0]), (7, [inf, 1.0, 0.0]),
            (8, [1.0, 0.0]), (9, [None, 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (10, [0.0, 1.0, 0.0]), (11, [-1.0, 0.0, 0.0]), (12, [2.0, 0.0, 0.0])]
    return spark.createDataFrame([(i, v, 0) for i, v in data], VECTORS)


def test_embeddings_with_odd_vectors(spark):
    odd = vectors(spark).selectExpr("*", "1 AS t", "2 AS region", "3 AS x", "4 AS id", "5 AS mark")
    assert {(r.vec_a, r.vec_b) for r in embed_dedup.embedding_pairs(odd).collect()} == {(1, 3), (1, 12), (3, 12)}
    got = {tuple(r) for r in embed_dedup.embedding_classes(odd).collect()}
    assert got == {(1, 1, 2, 2), (2, 1, 2, 2), (3, 1, 2, 1), (12, 1, 2, 1), (4, 4, 0, 0)} | {(i, i, 0, 1) for i in (5, 6, 7, 8, 9, 10, 11)}
    assert embed_dedup.embedding_classes(spark.createDataFrame([], VECTORS)).collect() == []
    assert [tuple(r) for r in embed_dedup.embedding_classes(spark.createDataFrame([(1, [], 0), (2, [], 0), (3, [1.0], 0)], VECTORS)).orderBy("vec_id").collect()] == [(1, 1, 0, 2), (2, 1, 0, 2), (3, 3, 0, 1)]
    left = embed_dedup.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    assert sorted(str(r.vec_id) for r in left.collect()) == sorted(map(str, [1, 4, 5, 6, 7, 8, 9, None, 10, 11]))


def test_nearest_of_odd_vectors(spark):
    got = ann.nearest_neighbours(vectors(spark).selectExpr("*", "1 AS cell", "2 AS kind", "3 AS x"), k=3).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.vec_id, r.rank)):
        by.setdefault(r.vec_id, []).append(r.neighbour_id)
    assert by[1] == [2, 12, 3] and by[12] == [1, 2, 3] and set(by) == {1, 2, 3, 10, 11, 12}
    assert by[2] == [1, 12, 3] and ann.nearest_neighbours(spark.createDataFrame([], VECTORS)).collect() == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details."""
AGPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
MIT = """MIT License

Copyright (c) 2020 A Person

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
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
STYLES = {
    "plain": lambda t: t, "hash": lambda t: "#!/bin/sh\n" + "\n".join(f"# {x}".rstrip() for x in t.split("\n")) + "\nx=1\n",
    "slashes": lambda t: "\n".join(f"// {x}".rstrip() for x in t.split("\n")) + "\nint x;\n", "block": lambda t: "/*\n" + "\n".join(f" * {x}".rstrip() for x in t.split("\n")) + "\n */\nint x;\n",
    "block without stars": lambda t: f"/* {t} */\nint x;\n", "markup": lambda t: f"<!--\n{t}\n-->\n<a/>\n", "lisp": lambda t: "\n".join(f";; {x}".rstrip() for x in t.split("\n")), "sql": lambda t: "\n".join(f"-- {x}".rstrip() for x in t.split("\n")),
}


def test_licenses_in_comments(spark):
    """Standard notices as source files have them, wrapped and behind comment marks; the SQL agrees."""
    import duckdb

    texts = {"Apache-2.0:notice": APACHE, "LGPL-2.1:notice": LGPL, "AGPL-3.0:notice": AGPL, "MIT:text": MIT}
    rows = [(i, style(text), expected) for i, (expected, text, style) in enumerate((e, t, s) for e, t in texts.items() for s in STYLES.values())]
    rows += [(1000 + i, f"{p} SPDX-License-Identifier: {n}", f"{n}:tag") for i, (p, n) in enumerate([("//", "Apache-2.0"), ("#", "MIT"), ("/*", "MPL-2.0"), (";", "ISC")])]
    rows += [(2000, "# SPDX-License-Identifier: GPL-3.0-or-later\n\nimport os", "GPL-3.0:tag"), (2001, "GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n", "GPL-2.0:text"), (2002, "We remember the license debate; nothing here.", "")]
    rows += [(2003, "\n".join(reversed(APACHE.split("\n\n"))), "Apache-2.0:notice")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    assert [(r[0], r[2], got[r[0]].matches, got[r[0]].sequence) for r in rows if r[2] not in got[r[0]].matches.split(",")] == []
    assert got[2002].matches == "" and all("<13><14>" in got[i].sequence for i in range(len(STYLES)))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert {r[0]: r[1:] for r in con.execute(licenses.ORACLE_SQL).fetchall()} == {d: (r.sequence, r.licenses, r.matches) for d, r in got.items()}


@pytest.mark.parametrize("targets", [{"a": 3, "b": 1}, {"a": 1.0, None: 1, "c": 0, "zz": 5}])
def test_mixing_to_target_weights(spark, targets):
    """Each source's tokens come near its share of the budget, and sources without weight don't come."""
    docs = messy.docs(spark, [(i, " ".join(["w"] * (1 + i % 7)), "en", "abc"[i % 3] if i % 10 else None, 0) for i in range(600)])
    got = mixing.mix_sources(docs, messy.labels(spark), targets=targets, percent=50).collect()
    total = sum(1 + i % 7 for i in range(600)) * 0.5
    here = {k: v for k, v in targets.items() if v > 0 and k != "zz"}
    for source, weight in here.items():
        tokens = sum(r.n_tokens for r in got if r.source == source)
        assert total * weight / sum(here.values()) - 7 <= tokens <= total * weight / sum(here.values())
    assert {r.source for r in got} == set(here)
    table_ = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "source string, weight double")
    again = mixing.mix_sources(docs, messy.labels(spark), targets=table_, percent=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


@pytest.mark.parametrize("percent", [3, 40, 100, 250])
def test_mixed_documents_are_the_mixture(spark, percent):
    """Also where the end of a budget lies among repeated rows, of which as many are taken as fit."""
    rows = [(i % 90, " ".join(["w"] * (1 + i % 90 % 7)), "en", "abc"[i % 3] if i % 10 else None, i % 90) for i in range(600)] + [(None, "a b c", "en", "d", 0)] * 40 + [(None, None, "en", "d", 0), (7, " ", "en", "e", 0)]
    docs, labels = messy.docs(spark, rows), messy.labels(spark, [(i, i % 2, 0) for i in range(0, 90, 4)])
    got = mixing.mixed_documents(docs, labels, percent=percent).select("doc_id", "source", "text", "n_chars")
    expected = mixing.mix_sources(docs, labels, percent=percent, keep=["text", "n_chars"]).select("doc_id", "source", "text", "n_chars")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect())) and (expected.count() > 0)


def test_mixed_documents_stay_where_they_lie(spark, monkeypatch):
    """Whole documents are neither sorted nor shuffled for the mixture, and once where labels are many."""
    docs, labels = messy.docs(spark), messy.labels(spark)
    few = mixing.mixed_documents(docs, labels)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    monkeypatch.setattr(mixing, "MAX_BROADCAST_ROWS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, mixing.mixed_documents(docs, labels).collect())) == sorted(map(str, few.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lines_of_a_long_document(spark):
    """Work is linear where most of very many lines go."""
    lines = [f"line {i % 50}" for i in range(60_000)]
    got = line_dedup.dedup_lines(messy.docs(spark, [(1, "\n".join(lines), "en", "a", 0), (2, "\n\nx", "en", "a", 0)]), with_count=True).collect()
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed + by[1].text.count("\n") + 1 == 60_000 and by[1].text.startswith("line 0\nline 1\n") and by[2].text == "\n\nx"


def test_decoding_of_no_rows(spark):
    assert bpe.decode_documents(spark.createDataFrame([], "doc_id long, ids array<int>")).collect() == []
