"""Licence notices inside lines and full licence texts, through the registered query."""

import random

from pawl.llm import license_scan, queries


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_license_query_finds_notices_inside_lines(spark, tmp_path):
    notice = "Licensed under the Apache License, Version 2.0."
    wrapped = "as you may know. This project is licensed under the terms\nof the MIT license. " + "And so it goes on and on. " * 9
    both = f"x {notice} " + "y z " * 50 + "This work is licensed under the GNU General Public License, version 2. " + "z y " * 9
    texts = [None, "", f"x {notice} " + "y z " * 50, wrapped, both, "under the terms of nothing " * 40, f"a b c {notice} " * 3]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op4_license_scan(spark, str(tmp_path)).collect()}
    assert [found[k].licenses for k in range(len(texts))] == ["", "", "Apache-2.0", "MIT", "Apache-2.0,GPL-2.0", "", "Apache-2.0"]
    assert found[2].best_dice == 1.0 and [found[k].n_notices for k in (2, 4, 6)] == [1, 2, 3]


def test_license_windows_are_all_runs_of_words():
    rng = random.Random(2)
    for _ in range(300):
        own = license_scan.Templates([("L", " ".join(rng.choice("abcde") for _ in range(rng.randint(2, 9))))], 80)
        words = [rng.choice("abcdefgh") for _ in range(rng.randint(2, 40))]
        pairs, grams = list(zip(words, words[1:])), own.grams[0]
        dice = [2 * len(grams & set(pairs[i:j])) / (len(grams) + len(set(pairs[i:j]))) for i in range(len(pairs)) for j in range(i + 1, len(pairs) + 1)]
        found = own.windows(pairs, own.possible(set(pairs)))
        assert bool(found) == (max(dice) >= 0.8)
        if found:
            assert found[0][0] / found[0][1] == max(dice)


def test_license_query_knows_full_texts_and_headers(spark, tmp_path):
    full = dict(license_scan.full_texts()[::-1])
    names = sorted(full)
    header = "This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version."
    prose = "and then we went on to say "
    texts = [f"{prose * 30} Copyright (c) 2020 A. Body\n\n{full['MIT']} {prose * 30}", prose * 9 + " ".join(full["BSD-3-Clause"].split()) + prose * 9, header, *(full[n] for n in names)]
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op4_license_scan(spark, str(tmp_path)).collect()}
    assert [found[k].licenses for k in range(3)] == ["MIT", "BSD-3-Clause", "GPL-2.0"]
    assert [(found[k + 3].best_license, found[k + 3].best_dice) for k in range(len(names))] == [(n, 1.0) for n in names]
