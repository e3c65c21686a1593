import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm import licences, quality_rules, quality_votes, url_lists

from .fixtures import documents, prose


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def labels(spark, docs):
    rows = [(r.doc_id, 1 if r.doc_id is None or r.doc_id % 3 else 0, 0) for r in docs.collect()] + [(None, 1, 0), (7, None, None), (99999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_base_counts(spark):
    docs = documents(spark, 80)
    extra = spark.createDataFrame([(1001, "a b c d e a b c d e a b c d e f"), (1002, "x#*$%&|<>\x0by\r\n \n.\n.\x1c"), (1003, "w " * 300), (1004, "é" * 20 + " ß z")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    got = quality_rules.judged(both, labels(spark, docs))
    want = sorted((str(r.doc_id), *base(r.text)) for r in both.collect())
    assert sorted((str(r.doc_id), *(r[c] for c in quality_rules.COUNTS), r.base_failed) for r in got.collect()) == want


def test_ratios_and_verdict(spark):
    docs = documents(spark, 80).select("doc_id", "text")
    lab = labels(spark, docs)
    got = quality_rules.judged(docs, lab, threshold=-0.02, buckets=64).collect()
    rows = docs.collect()
    h = spark.createDataFrame([(w,) for w in sorted({w for r in rows for w in (r.text or "").split()})], "w string").select("w", F.xxhash64("w").alias("h")).collect()
    code = {r.w: r.h for r in h}
    pairs = sorted({(code[a], code[b]) for r in rows for w in [(r.text or "").split()] for a, b in zip(w, w[1:])})
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()}
    buckets = lambda t: [code[w] & 63 for w in t] + [two[code[a], code[b]] & 63 for a, b in zip(t, t[1:])]
    good = {r.doc_id for r in lab.collect() if r.quality == 1 and r.toxic != 1 and r.doc_id is not None}
    raw, target = np.zeros(64), np.zeros(64)
    for r in rows:
        for b in buckets((r.text or "").split()):
            raw[b] += 1
            target[b] += r.doc_id in good
    log = np.round((np.log((target + 1) / (target.sum() + 64)) - np.log((raw + 1) / (raw.sum() + 64))) * quality_rules.UNIT)
    want = []
    for r in rows:
        bs = buckets((r.text or "").split())
        kept = not base(r.text)[-1] and log[bs].sum() >= round(-0.02 * quality_rules.UNIT) * len(bs)
        want.append((str(r.doc_id), bool(kept), round(float(log[bs].sum() / len(bs) / quality_rules.UNIT), 6) if bs else None))
    key = lambda x: (x[0], x[1], str(x[2]))
    assert sorted(((str(r.doc_id), r.kept, None if r.llr is None else round(r.llr, 6)) for r in got), key=key) == sorted(want, key=key)
    assert {r.kept for r in got} == {True, False}


def test_rules_keep_columns_and_empty_tables(spark):
    docs = documents(spark, 60)
    lab = labels(spark, docs)
    kept = quality_rules.keep_passing(docs, lab)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_rules.judged(docs.limit(0), lab).collect() == []
    assert quality_rules.judged(docs, lab.limit(0)).where("llr <> 0").count() == 0


def graded(spark, n=300):
    rnd = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        good = rnd.random() < 0.7
        t = prose(rnd, 60) if good else " ".join(w + rnd.choice(["***", "$$$", "!!"]) for w in prose(rnd, 60).split())
        rows.append((i, t, "en", "s", 1))
        marks.append((i, int(good), 0))
    rows += [(n, None, "en", "s", 1), (n + 1, "", "en", "s", 1), (None, "abc", "en", "s", 1), rows[0]]
    marks += [(n, None, 0), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, __x string, n_chars long"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_votes_on_held_out_labels(spark):
    docs, lab = graded(spark)
    got = quality_votes.scores(docs, lab)
    assert got.count() == docs.count()
    both = got.join(lab, "doc_id").where("held_out and quality is not null")
    assert both.where("predicted = quality").count() >= 0.95 * both.count() > 0
    prior = {r.score for r in got.where(F.col("doc_id").isin(300, 301)).collect()}
    assert len(prior) == 1 and 0.6 < prior.pop() < 0.8
    want = spark.range(200).selectExpr("id", "pmod(crc32(cast(cast(id as string) as binary)), 4) = 2 as h").collect()
    mine = {r.doc_id: r.held_out for r in got.collect()}
    assert all(mine[r.id] == r.h for r in want)


def test_votes_do_not_read_held_out_labels(spark):
    docs, lab = graded(spark)
    other = lab.withColumn("quality", F.when(quality_votes.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((str(r.doc_id), r.score) for r in quality_votes.scores(docs, x).collect()) for x in (lab, other))
    assert a == b


def test_votes_keep_rows_and_empty_tables(spark):
    docs, lab = graded(spark)
    kept = quality_votes.keep_good(docs, lab)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_votes.scores(docs.limit(0), lab).collect() == []
    assert {r.score for r in quality_votes.scores(docs, lab.limit(0)).collect()} == {0.5}


def test_blocked_cosines_are_exact():
    rnd = np.random.default_rng(2)
    x, y = rnd.random((50, quality_votes.BINS + quality_votes.PATTERNS)).astype(np.float32), rnd.integers(0, 2, 50)
    m = quality_votes.Votes(x, y, 0.6, rank=8)
    whole = m.score(x[:20], 5)
    assert np.allclose(whole, np.concatenate([m.score(x[i : i + 7], 5) for i in (0, 7, 14)])[:20], atol=1e-5)
    for i in range(20):  # every row by itself, from its cosines with every reference
        v = x[i] * m.idf
        a, b = v[: quality_votes.BINS], v[quality_votes.BINS :]
        z = np.concatenate([a / np.linalg.norm(a), b / np.linalg.norm(b)]) @ m.basis
        cos = [float(r @ z) / float(np.linalg.norm(z)) for r in m.latent]
        near = sorted(range(len(cos)), key=lambda k: -cos[k])[:5]
        w = [max(cos[k], 0) ** quality_votes.SHARP * m.weight[k] for k in near]
        assert abs(whole[i] - sum(a for a, k in zip(w, near, strict=True) if y[k]) / sum(w)) < 1e-4


def test_patterns_of_word_windows():
    found = quality_votes.grams(b"a b a a c " * 3)[quality_votes.BINS :]
    words, want = ("a b a a c " * 3).split(), {}
    for i in range(len(words) - 3):
        w = words[i : i + 4]
        code = 0
        for j in range(1, 4):
            code = code * 4 + w.index(w[j])
        want[code] = want.get(code, 0) + 1
    assert {int(k): round(float(np.expm1(found[k]))) for k in np.flatnonzero(found)} == want


def test_votes_on_the_supplied_labels(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    got = quality_votes.scores(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out and quality is not null").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got) > 0


def test_url_lists_keep_the_columns_of_captures(spark):
    """Names that the operator uses too, a hot host in one month, and no rows or no list at all."""
    rows = [(i, "http://hot.example.org/a", "2024-03-05 10:00:00", "r", "e", "x", i) for i in range(700)] + [(9000, None, None, None, "e", None, 1), (9001, "http://other.org/", "2024-03-05 00:00:00", "r", None, "x", 2)]
    c = spark.createDataFrame(rows, "id long, url string, fetched_at string, row string, entry string, x string, capture long").repartition(3)
    changes = spark.createDataFrame([("hot.example.org", "block", "2024-03-05 09:00:00"), ("example.org", "review", "2024-01-01 00:00:00"), ("hot.example.org", None, "2024-03-06 00:00:00")], "entry string, action string, at string")
    got = url_lists.filter_captures(c, changes)
    assert got.columns == [*c.columns, "list_entry", "action"]
    found = got.collect()
    assert sorted(tuple(r)[:7] for r in found if r.id < 9000) == sorted(r for r in rows if r[0] < 9000)
    assert all((r.list_entry, r.action) == (("hot.example.org", "block") if r.id < 9000 else (None, "keep")) for r in found) and len(found) == len(rows)
    assert url_lists.filter_captures(c.limit(0), changes).collect() == []
    assert {r.action for r in url_lists.filter_captures(c, changes.limit(0)).collect()} == {"keep"}


def test_url_lists(spark):
    changes = spark.createDataFrame([("bad.org", "block", "2024-01-10"), ("bad.org", None, "2024-02-10"), ("bad.org", "review", "2024-02-20"), ("sub.bad.org/ok", "keep", "2024-01-01"), ("BAD.org", "block", "2024-01-10"), (None, "block", "2024-01-01"), ("x.com", "block", None)], "entry string, action string, at string")
    rows = [
        ("http://bad.org/", "2024-01-09 23:59:59", None, "none"), ("http://bad.org/", "2024-01-10 00:00:00", "bad.org", "block"), ("https://u:p@A.Bad.ORG:8080/x?y#z", "2024-02-09 12:00:00", "bad.org", "block"),
        ("http://bad.org", "2024-02-10 00:00:00", None, "none"), ("http://bad.org", "2024-03-01 00:00:00", "bad.org", "review"), ("http://notbad.org", "2024-01-15 00:00:00", None, "none"),
        ("http://sub.bad.org/ok/p.html", "2024-01-20 00:00:00", "sub.bad.org/ok", "keep"), ("http://sub.bad.org/okay", "2024-01-20 00:00:00", "bad.org", "block"), (None, "2024-01-20 00:00:00", None, "none"),
        ("", "2024-01-20 00:00:00", None, "none"), ("no url", "2024-01-20 00:00:00", None, "none"), ("http://bad.org/", None, None, "none"), ("http://bad.org/", "2024-01-10 00:00:00", "bad.org", "block"),
    ]
    caps = spark.createDataFrame([(u, t, a, v) for u, t, a, v in rows], "url string, fetched_at string, want_entry string, want string")
    got = url_lists.filter_captures(caps, changes, "none").collect()
    assert len(got) == len(rows) and all((r.entry, r.action) == (r.want_entry, r.want) for r in got)
    assert url_lists.filter_captures(caps.limit(0), changes).collect() == []
    assert {r.action for r in url_lists.filter_captures(caps, changes.limit(0)).collect()} == {"keep"}


def test_url_query_as_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    want = con.execute(url_lists.ORACLE).fetchall()
    got = url_lists.op9_url_lists(spark, small).select("page_id", "fetched_us", "entry", "action").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {w[3] for w in want} > {"keep"}



MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
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
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#
# 1. Redistributions of source code must retain the above copyright notice,
#    this list of conditions and the following disclaimer.
# 2. Redistributions in binary form must reproduce the above copyright notice,
#    this list of conditions and the following disclaimer in the documentation
#    and/or other materials provided with the distribution.
# 3. Neither the name of the Example Project nor the names of its contributors
#    may be used to endorse or promote products derived from this software
#    without specific prior written permission."""
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0"""


def slow_sentences(text):
    """[(normalised fragment, whether it ends a sentence)], letter by letter."""
    out, first = [], 0
    lines = text.split("\n")
    for k, line in enumerate(lines):
        bare = line.strip(" \t#*;%") == "" and 0 < k < len(lines) - 1
        if bare:
            if len(out) > first:
                out[-1] = (out[-1][0], True)
            first = len(out)
            continue
        line = line.lstrip(" \t#*/;%<!>|-").rstrip(" \t#*/<>|-")
        head = line.split(" ")[0]
        if " " in line and head.rstrip(".)").lstrip("(").isalnum() and len(head.strip("().")) <= 2 and head[-1:] in (".", ")"):
            line = line[len(head) :].lstrip()
        now = ""
        at = 0
        while at <= len(line):
            mark = at
            while mark < len(line) and line[mark] in ".!?:;":
                mark += 1
            close = mark
            while mark > at and close < len(line) and line[close] in "\"')]":
                close += 1
            v = at > 0 and line[at - 1] == "v" and (at == 1 or not (line[at - 2].isalnum() or line[at - 2] == "_"))
            if at == len(line) or (mark > at and not v and (close == len(line) or line[close].isspace())):
                words, ends = slow_normal(now), any(c in ".!?" for c in line[at:close]) or any(c in "\"')]" for c in line[at:close])
                if words:
                    out.append((words, at < len(line) and ends))
                elif at < len(line) and ends and len(out) > first:
                    out[-1] = (out[-1][0], True)
                now, at = "", max(close, at + 1)
                if at > len(line) or at == len(line):
                    if at > len(line) or not line[at:]:
                        break
            else:
                now += line[at]
                at += 1
    if out and len(out) > first:
        out[-1] = (out[-1][0], True)
    return out


def slow_normal(x):
    x, out = x.lower().replace("(c)", " ").replace("\u00a9", " "), ""
    for k, c in enumerate(x):
        if c == ".":
            before = x[k - 1] if k else ""
            after = x[k + 1] if k + 1 < len(x) else ""
            single = before == "v" and (k == 1 or not (x[k - 2].isalnum() or x[k - 2] == "_"))
            out += "." if (before.isdigit() and after.isdigit()) or single else " "
        else:
            out += c if c.isalnum() else " "
    return " ".join(out.split())


def slow_scan(text):
    sentences = [(n, x) for n, x in licences.SENTENCES]
    for n, x in licences.LICENCES:
        sentences += [(f"notice:{n}", f"{a}{b} {c}{x}{z}") for a in licences.SUBJECTS for b in licences.VERBS for c in licences.TERMS for z in ("", " the license")]
    pieces, ids, at = slow_sentences(text), [], 0
    while at < len(pieces):
        best = None
        for end in range(at, len(pieces)):
            if any(e for _, e in pieces[at:end]):
                break
            x = " ".join(p for p, _ in pieces[at : end + 1])
            for name, s in sentences:
                if s == x:
                    best = (at, end, name)
                    break
            else:
                if x.startswith("spdx license identifier mit") and x in ("spdx license identifier mit", "spdx license identifier mit or apache 2.0"):
                    best = (at, end, "notice:MIT" if x.endswith("mit") else "notice:MIT OR Apache-2.0")
                for name, a, z in licences.NAMED:
                    if x.startswith(a) and x.endswith(z) and len(x) >= len(a + z):
                        best = (at, end, name)
        ids += [best] if best else []
        at = best[1] + 1 if best else at + 1
    used, found = set(), []
    rules = licences.RULES + [(n[7:], (n,)) for n in dict.fromkeys(i[2] for i in ids) if n.startswith("notice:")]
    for licence, wanted in rules:
        for k in range(len(ids)):
            part = ids[k : k + len(wanted)]
            if [p[2] for p in part] == list(wanted) and not used & set(range(k, k + len(wanted))) and all(q[0] - p[1] - 1 <= licences.GAP for p, q in zip(part, part[1:])):
                used |= set(range(k, k + len(wanted)))
                found.append((k, licence))
    return [i[2] for i in ids], [x for _, x in sorted(found)], [i[2] for k, i in enumerate(ids) if k not in used]


def test_known_sentences_are_found_and_rules_use_known_identifiers():
    made, _ = licences.known()
    for sentence, name in made.items():
        assert licences.TRIGGERS.search(sentence.encode()), sentence
        assert licences.normalised(sentence) == sentence
    for name, sentence in licences.SENTENCES:
        text = f"Some words before.\n{sentence.capitalize()}.\nAnd more, after.".encode()
        assert [x for *_, x in licences.identifiers(text)] == [name], sentence
    names = {n for n, _ in licences.SENTENCES} | {n for n, *_ in licences.NAMED} | {f"notice:{n}" for n, _ in licences.LICENCES}
    assert {i for _, ids in licences.RULES for i in ids} <= names


CASES = [
    (MIT, "MIT", ""), (BSD, "BSD-3-Clause", ""), (APACHE, "Apache-2.0", ""), (BSD + "\n\n" + MIT, "BSD-3-Clause,MIT", ""),
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0", ""), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", ""),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only", ""), ("words | and words\nReleased under the MIT License.", "MIT", ""),
    ("This is released under. The MIT license of the town.", "", ""), ("relicensed under the mit licenses", "", ""), ("We had it released under the MIT license before.", "", ""),
    ("This file is licensed under the\nMIT License\n\nAll rights reserved.", "MIT", "all-rights"), ("Released under\n\nthe MIT License.", "", "mit-title"),
    ("subject to the terms of the Mozilla Public License, v. 2.0", "", ""), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0", ""),
    ("SPDX-License-Identifier: MIT", "MIT", ""), (MIT.replace("Permission is", "No permission is"), "", "mit-notice,mit-as-is"), ("", "", ""), ("\n\n...\n! ?", "", ""),
]


@pytest.mark.parametrize("text, want, rest", CASES)
def test_licences_of_texts(text, want, rest):
    found, left = licences.recognise(licences.identifiers(text.encode()))
    assert (",".join(x for _, x in found), ",".join(left)) == (want, rest)


def test_licences_as_brute_force(spark):
    rnd, docs = random.Random(6), []
    parts = [MIT, BSD, APACHE, *(c[0] for c in CASES), *(s + "." for _, s in licences.SENTENCES[::5]), *MIT.split("\n"), *BSD.split("\n"), "Words in between. And more", "no mark here", ""]
    for i in range(120):
        docs.append((i, "\n".join(rnd.choice(parts) for _ in range(rnd.randint(1, 8)))))
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        ids, found, rest = slow_scan(t)
        assert (got[i].sentences, got[i].licences, got[i].unmatched) == (",".join(ids), ",".join(found), ",".join(rest)), t


def test_licence_rows(spark):
    docs = documents(spark)
    more = spark.createDataFrame([(9001, "x" * 100000 + "\nReleased under the MIT License.\nAll rights reserved.")], "doc_id long, text string")
    got = licences.scan(docs.select("doc_id", "text").unionByName(more)).collect()
    assert len(got) == docs.count() + 1
    assert [(r.licences, r.unmatched) for r in got if r.n_sentences] == [("MIT", "all-rights")]
    assert licences.scan(docs.limit(0)).collect() == []


# Notices as they are printed.
GPL3 = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL3.replace("free software: you", "free software; you").replace("version 3 of the License", "version 2 of the License")
PRINTED = [
    (GPL3, "GPL-3.0-or-later"), (GPL2, "GPL-2.0-or-later"), ("\n".join(f" * {x}" for x in GPL3.split("\n")), "GPL-3.0-or-later"),
    (GPL2.replace("either version 2 of the License, or\n    (at your option) any later version.", "version 2 of the License."), "GPL-2.0-only"),
    (GPL3.replace("GNU General", "GNU Affero General"), "AGPL-3.0-or-later"),
    (GPL2.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 2 of", "version 2.1 of"), "LGPL-2.1-or-later"),
    (GPL3.replace("program", "library").replace("GNU General", "GNU Lesser General"), "LGPL-3.0-or-later"),
    ("/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */", "MPL-2.0"),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0-or-later"), ("# SPDX-License-Identifier: MIT OR Apache-2.0", "MIT OR Apache-2.0"),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note"), ("SPDX-License-Identifier: (MIT AND BSD-3-Clause)", "MIT AND BSD-3-Clause"),
    ("SPDX-License-Identifier: Mine-1.0", ""), ("SPDX-License-Identifier: MIT OR", ""), ("MIT License\n\n" + MIT, "MIT"),
]


@pytest.mark.parametrize("text,want", PRINTED)
def test_printed_notices(text, want):
    found, _ = licences.recognise(licences.identifiers(text.encode()))
    assert ",".join(x for _, x in found) == want


def test_all_trusted_documents_count(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40_000 if i else None, f"w{i % 7}") for i in range(41_000)], "doc_id long, text string").repartition(4)
    labels = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 1000 == 0).cast("int").alias("toxic"))
    known = quality_rules.trusted_ids(labels)
    assert known.count() == 30_000 - 30  # over what was once a sample of 20,000
    want = quality_rules.ratios(docs, labels).first().weights
    marks = lambda: sorted(quality_rules.marked(docs, labels).groupBy("_id", "text", "_trusted").count().collect(), key=repr)
    before = marks()
    monkeypatch.setattr(quality_rules.common, "BROADCAST_ROWS", 100)
    assert marks() == before and quality_rules.ratios(docs, labels).first().weights == want
