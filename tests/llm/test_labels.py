import math
import random
from collections import Counter

from pyspark.sql import functions as F

from threadloom.llm import licenses as L
from threadloom.llm import weak_quality as W

FILES = "file_id long, path string, text string"


def brute_cosine(a, b, corpus):
    import re

    words = lambda t: Counter(re.findall(r"[^\W_]+(?:\.\d+)*", t.lower()))
    n, df = len(corpus), Counter(w for t in corpus for w in words(t))
    df = Counter(w for t in corpus for w in set(words(t)))
    vec = lambda t: {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[w])) + 1) for w, c in words(t).items()}
    x, y = vec(a), vec(b)
    return sum(v * y.get(w, 0) for w, v in x.items()) / math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))


def test_scores_match_brute_force(spark):
    corpus = sorted({t for _, t in L.TEMPLATES})
    units = ["Licensed under the Apache License, Version 2.0", "licensed under the MIT License ok", "Licensed under CC BY-NC 4.0.", "a license of my own", "This work is licensed under the GNU General Public License, version 3!"]
    got = {r.unit_id: (r.license, r.similarity) for r in L.score(spark.createDataFrame([(u, u) for u in units], "unit_id string, unit string"), L.templates(spark)).collect()}
    for u in units:
        best = max((round(brute_cosine(u, t, corpus), 6), name) for name, t in L.TEMPLATES)
        assert (u in got) == (best[0] >= L.SIMILARITY)
        if u in got:
            assert abs(got[u][1] - best[0]) < 1e-5


def test_inheritance_from_the_nearest_directory(spark):
    rows = [
        (1, "a/b/x.py", "code"), (2, "a/LICENSE", "Released under the MIT License."), (3, "a/b/c/y.py", "code"), (4, "a/b/c/z.py", "x\nLicensed under the Apache License, Version 2.0.\ny"),
        (5, "a/b/c/d/COPYING", "Licensed under CC BY 4.0."), (6, "a/b/c/d/e/q", "t"), (7, "other/q", "t"), (8, None, None), (9, "ab/q", "t"), (9, "ab/q", "t"),
    ]
    files = spark.createDataFrame(rows, FILES).withColumn("license", F.lit("z")).withColumn("unit", F.lit(1))
    got = [(r.file_id, r.license, r.how) for r in L.license_scan(files).orderBy("file_id").collect()]
    assert got == [
        (1, "MIT", "inherited"), (2, "MIT", "own"), (3, "MIT", "inherited"), (4, "Apache-2.0", "own"), (5, "CC-BY-4.0", "own"), (6, "CC-BY-4.0", "inherited"),
        (7, None, None), (8, None, None), (9, None, None), (9, None, None),
    ]
    assert L.license_scan(files.limit(0)).collect() == []
    assert L.license_scan(files, L.templates(spark).limit(0)).where("license is not null").count() == 0


def test_real_licence_files_and_headers(spark):
    mit = f"MIT License\n\nCopyright (c) 2020 Some One\n\n" + "\n\n".join(x.strip() for x in L.TEXTS[1][1].split("Copyright (c) ")[1].replace("conditions: The above", "conditions:\n\nThe above").replace("Software. THE", "Software.\n\nTHE").split("\n\n"))
    bsd = f"BSD 3-Clause License\n\nCopyright (c) 2021, The Team\nAll rights reserved.\n\n{L._BSD}\n\n{L._BSD_THIRD}\n\n{L._BSD_AS_IS}\n"
    gpl = "\n".join(["/* x.c", " *", " * This program is free software: you can redistribute it and/or modify", " * it under the terms of the GNU General Public License as published by", " * the Free Software Foundation, either version 3 of the License, or", " * (at your option) any later version.", " *", " * more text", " */", "int main;"])
    long_gpl = "                    GNU GENERAL PUBLIC LICENSE\r\n                       Version 3, 29 June 2007\r\n\r\n" + "Everyone may copy this. " * 3000
    rows = [
        (1, "mit/LICENSE", mit), (2, "mit/src/deep/x.py", "code"), (3, "bsd/LICENSE.txt", bsd), (4, "bsd/y", ""), (5, "g/x.c", gpl), (6, "g/z.c", "z"), (7, "s/a.py", "#!/bin/sh\n# SPDX-License-Identifier: MIT\ncode"), (8, "s/b.py", "// SPDX-License-Identifier: Zlib"),
        (9, "all/COPYING", long_gpl), (10, "all/q", "t"), (11, "two/LICENSE-MIT", mit), (12, "two/LICENSE-BSD", bsd), (13, "two/q", "t"), (14, "r/x", "text\nAll rights reserved."), (15, "r/y", "text"), (16, "mit/other", "word " * 50_000 + "license"),
    ]
    got = {r.file_id: (r.license, r.how, r.from_path) for r in L.license_scan(spark.createDataFrame(rows, FILES)).collect()}
    assert {k: v[0] for k, v in got.items()} == {
        1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-3-Clause", 5: "GPL-3.0", 6: None, 7: "MIT", 8: None, 9: "GPL-3.0", 10: "GPL-3.0", 11: "MIT", 12: "BSD-3-Clause", 13: "BSD-3-Clause AND MIT", 14: "Proprietary", 15: None, 16: "MIT",
    }
    assert got[2][1:] == ("inherited", "mit/LICENSE") and got[13][1:] == ("inherited", "two/LICENSE-BSD") and got[5][1:] == ("own", "g/x.c")


def test_ties_go_by_place_then_name(spark):
    known = spark.createDataFrame([("B", "licensed by terms of one kind"), ("A", "licensed by terms of one kind"), ("C", "license two of another sort")], "license string, text string")
    text = "license two of another sort\nlicensed by terms of one kind"
    rows = [(1, "x", text), (2, "y", "license z\nlicensed by terms of one kind\n"), (3, "x", text)]
    got = {r.file_id: r.license for r in L.license_scan(spark.createDataFrame(rows, FILES), known).collect()}
    assert got == {1: "C", 2: "A", 3: "C"}


def simulated(seed, right, share, speaks, n=20_000):
    """Vote patterns of labellers that are right so often on [bad, good] documents, when they vote."""
    rnd, patterns = random.Random(seed), Counter()
    for _ in range(n):
        good = rnd.random() < share
        patterns[tuple(-1 if rnd.random() > speaks else int(good) if rnd.random() < r[good] else 1 - good for r in right)] += 1
    return sorted(patterns.items())


def test_em_recovers_the_accuracies_of_both_sides():
    right = [(0.7, 0.95), (0.9, 0.8), (0.6, 0.99), (0.8, 0.9), (0.75, 0.7)]
    for share in (0.8, 0.5, 0.3):
        good, table, _ = W.fit_votes(simulated(1, right, share, 0.8))
        assert abs(good - share) < 0.04
        for (bad, fine), (on_bad, on_good) in zip(right, table):
            assert abs(on_bad[0] - bad) < 0.06 and abs(on_good[1] - fine) < 0.06


def test_posteriors_match_brute_force():
    patterns = simulated(2, [(0.7, 0.95), (0.9, 0.8), (0.6, 0.99)], 0.7, 0.7)
    good, table, post = W.fit_votes(patterns)
    for p, _ in patterns:
        joint = [1 - good, good]
        for k, v in enumerate(p):
            for c in (0, 1):
                joint[c] *= table[k][c][v] if v >= 0 else 1
        assert abs(post[p] - joint[1] / sum(joint)) < 1e-6
    assert abs(sum(n * post[p] for p, n in patterns) / sum(n for _, n in patterns) - good) < 1e-3  # a fixed point
    assert W.fit_votes([]) == (0.5, [], {})


def test_scores_and_training():
    rnd = random.Random(3)
    rows = [([i, 9], [0.8, 0.6], float(i < 4)) for i in (rnd.randint(0, 7) for _ in range(400))]
    w = W.train(rows)
    z = W.scores(w, [r[:2] for r in rows])
    assert all(abs(a - (w[i[0]] * v[0] + w[i[1]] * v[1] + w[-1])) < 1e-9 for a, (i, v, _) in zip(z, rows))
    assert all((a > 0) == (y == 1) for a, (_, _, y) in zip(z, rows))


def test_held_out_labels(spark):
    """The labels table is used here only."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    r = {(x.quality, x.keep): x["count"] for x in W.classify(docs).join(labels, "doc_id").groupBy("quality", "keep").count().collect()}
    assert r[1, True] / (r[1, True] + r.get((1, False), 0)) > 0.98
    assert r[0, False] / (r[0, False] + r.get((0, True), 0)) > 0.9


def test_classifier_on_odd_tables(make):
    docs = make([(None, None), (1, ""), (2, "x " * 100_000), (3, "Some words of a text."), (3, "Some words of a text.")], {"score": F.lit(1), "votes": F.lit(2), "key": F.lit(3)})
    rows = W.classify(docs).collect()
    assert len(rows) == 5 and len({r.score for r in rows if r.doc_id == 3}) == 1 and len({r.score for r in rows if r.doc_id in (None, 1)}) == 1
    assert W.classify(docs.limit(0)).collect() == []


def test_every_template_holds_a_cue(spark):
    assert spark.createDataFrame(L.TEMPLATES, "license string, text string").where(~F.col("text").rlike(L.CUE)).collect() == []
