"""Mixing and licence scans, against their SQL and small loops."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from docgrain.llm import licenses, mixing
from oracle import norm, same


@pytest.mark.parametrize(("query", "sql"), [(mixing.op6_mix, mixing.OP6_SQL), (licenses.op10_licenses, licenses.OP10_SQL)], ids=["mix", "licenses"])
def test_query_equals_sql(spark, small, query, sql):
    same(spark, small, query, sql)


def sql_rows(df, sql, tmp_path):
    df.select("doc_id", "text", "source").coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    rel = con.sql(sql)
    return sorted((tuple(norm(x) for x in r) for r in rel.fetchall()), key=repr), rel.columns


@pytest.mark.parametrize(("run", "sql"), [(mixing.mix, mixing.OP6_SQL), (licenses.scan, licenses.OP10_SQL)], ids=["mix", "licenses"])
def test_odd_rows_equal_sql(odd, run, sql, tmp_path):
    want, columns = sql_rows(odd, sql, tmp_path)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in run(odd).collect()), key=repr)
    assert got == want


def level(sizes, share=1.5, weights=(5, 2, 1)):
    """Targets by handing the excess on again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    cap = {s: 2.0 * sizes[s] for s in order}
    left, open_, out = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > cap[s]}
        if not over:
            return out | part
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= over
    return out


def test_targets_equal_the_loop(spark):
    sizes = {"a": 100, "b": 5000, "c": 300, "d": 40, None: 900, "é": 20, "z": 0}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    want = level(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_taken_words_meet_targets(spark, small):
    per = {}
    for r in mixing.op6_mix(spark, small).collect():
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["first_slot"] is None) == (r["taken"] == 0)
        t = per.setdefault((r["target"], r["source_size"]), [0, 0])
        t[0] += r["taken"]
    assert all(abs(t[0] - target) <= 0.5 for (target, _), t in per.items())


def test_every_stretch_of_the_mix_is_near_the_shares(spark):
    """The schedule's slots: of any 200 in a row, each source has its share but for a few."""
    per = spark.createDataFrame([(i, float(t)) for i, t in enumerate([50_000, 30_000, 15_000, 5_000])], "idx int, target double")
    slots = sorted((r["slot"], r["idx"], r["rank"]) for r in mixing.schedule(per, 1000, 100).collect())
    for i, t in enumerate([0.5, 0.3, 0.15, 0.05]):
        assert sorted(r for _, x, r in slots if x == i) == list(range(int(1000 * t)))
        for a in range(0, 800, 50):
            n = sum(x == i for s, x, _ in slots if a <= s < a + 200)
            assert abs(n - 200 * t) <= 6


def test_mix_does_not_depend_on_partitions(odd):
    key = lambda df: sorted(map(repr, df.collect()))
    assert key(mixing.mix(odd)) == key(mixing.mix(odd.repartition(7)))


def test_mix_of_nothing(docs):
    assert mixing.mix(docs([])).count() == 0
    assert [r["taken"] for r in mixing.mix(docs([(1, None), (2, " ")])).collect()] == [0, 0]
    assert mixing.repeat_taken(docs([(1, None)])).count() == 0


def test_small_sources_beside_a_large_one_are_taken(spark):
    rows = [(10 * i + k, "w " * 20, f"small{i}") for i in range(8) for k in range(3)] + [(100, "w " * 400, "tiny")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    large = spark.range(1000, 1400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 30_000).alias("text"), F.lit("large").alias("source"))
    every = df.union(large)
    times = {r["source"]: r["count"] for r in mixing.repeat_taken(every).groupBy("source").count().collect()}
    assert times.pop("large") in range(598, 603)
    assert times == {f"small{i}": 6 for i in range(8)} | {"tiny": 2}
    rows = mixing.mix(every).collect()
    small = [r for r in rows if r["source_size"] < 1000]
    assert len(small) == 25 and all(r["taken"] == 2 * r["size"] for r in small)
    assert abs(sum(r["taken"] for r in rows) - 1.5 * sum(r["size"] for r in rows)) <= 10


def test_repeat_taken_tells_sources_apart(docs):
    """Rows of one id and size from two sources: one source is taken twice over, the other less."""
    rows = [(1, "a b c d", None, "a"), (1, "a b c d", None, "b")] + [(10 + i, "w " * 40, None, "b") for i in range(40)]
    taken = {(r["doc_id"], r["source_size"]): r["taken"] for r in mixing.mix(docs(rows)).collect()}
    got = [(r["doc_id"], r["source"]) for r in mixing.repeat_taken(docs(rows)).collect()]
    for source, size in (("a", 4), ("b", 4 + 1600)):
        assert got.count((1, source)) == round(taken[1, size] / 4)
    assert got.count((1, "a")) == 2


def test_repeat_taken_keeps_columns(odd):
    got = mixing.repeat_taken(odd)
    assert got.columns == odd.columns
    assert all(r["text"] and r["k"] == "k" for r in got.collect())


def first(key):
    own = licenses.SENTENCES[key]
    return own if isinstance(own, str) else own[0]


def test_rules_take_longest_runs_first(docs):
    full = f"The MIT License\n{first('mit-grant')}: \n{first('mit-condition')}.\nReleased under the MIT License."
    part = f"{first('mit-condition')}. {first('mit-grant')}."
    rows = {r["doc_id"]: r for r in licenses.scan(docs([(1, full), (2, part), (3, "Licensed under the Apache License, Version 2.0."), (4, "It was released under the MIT license once.")])).collect()}
    assert rows[1]["licenses"] == "MIT:full|MIT:notice"
    assert rows[2]["licenses"] == "MIT:grant" and rows[2]["sentence_ids"] == "mit-condition,mit-grant"
    assert rows[3]["licenses"] == "Apache-2.0:notice"
    assert rows[4]["licenses"] == ""


APACHE = """
# Copyright 2020 Some Body
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""
GPL = """/*
 * This file is part of Thing.
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
 *
 * You should have received a copy of the GNU General Public License
 * along with this program.  If not, see <https://www.gnu.org/licenses/>.
 */"""
BSD = """Copyright (c) 2020, Some Body
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"""
WRAPPED = [
    (APACHE, "Apache-2.0:header"), (GPL, "GPL-3.0-or-later:header"), (BSD, "BSD-2-Clause:full"), (BSD + BSD3, "BSD-3-Clause:full"), (MPL, "MPL-2.0:header"),
    ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", "GPL-2.0-only:tag"), ("some prose\nLicensed under CC BY 4.0\nmore prose", "CC-BY-4.0:notice"), ("Permission slips, warranty cards and licences are other things.", ""),
    ("This is free and unencumbered\nsoftware released into the public domain.", "Unlicense:full"),
]


def test_wrapped_originals_are_met(docs, tmp_path):
    df = docs([(i, t, None, None) for i, (t, _) in enumerate(WRAPPED)])
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(df).collect()}
    assert [got[i] for i in range(len(WRAPPED))] == [want for _, want in WRAPPED]
    rows = sorted((tuple(norm(x) for x in r) for r in licenses.scan(df).collect()), key=repr)
    assert sql_rows(df, licenses.OP10_SQL, tmp_path)[0] == rows


def test_every_sentence_and_rule_can_be_met(docs):
    """Each known wording by itself, and each rule by its own sentences with an unknown one between."""
    pairs = licenses.known()
    filled = [s.replace("...", "some body") for s, _ in pairs]
    got = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan(docs([(i, s.capitalize() + ".") for i, s in enumerate(filled)])).collect()}
    assert [got[i] for i in range(len(pairs))] == [k for _, k in pairs]
    by_id = {k: s for (_, k), s in zip(pairs, filled)}
    rules = licenses.expanded()
    texts = [(i, ".\nSomething else. ".join(by_id[k] for k in run) + ".") for i, (_, run) in enumerate(rules)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs(texts)).collect()}
    assert [got[i] for i in range(len(rules))] == [name for name, _ in rules]


def test_scan_of_nothing_and_of_a_long_text(docs):
    assert licenses.scan(docs([])).count() == 0
    long = "word and word. " * 100_000 + "\nReleased under the MIT License.\n" + "x" * 1_000_000
    r = licenses.scan(docs([(1, long), (2, None), (3, "")])).orderBy("doc_id").collect()
    assert [x["licenses"] for x in r] == ["MIT:notice", "", ""] and [x["n_known"] for x in r] == [1, 0, 0]


def test_no_python_in_the_plans(odd):
    for df in (mixing.mix(odd), licenses.scan(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
