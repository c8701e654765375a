from lendscope.llm import licenses
from lendscope.llm.common import FOLD


def fold(t):
    return (t or "").encode().translate(FOLD).split()


def brute(text):
    w = fold(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w))
              if w[i:i + len(fold(p))] == fold(p)]
    found = {}
    starts = range(0, max(1, len(w) - licenses.BLOCK // 2), licenses.BLOCK // 2)
    for label, texts in licenses.TEMPLATES.items():
        for t in texts:
            s = set(fold(t))
            for b in starts:
                share = len(s & set(w[b:b + licenses.BLOCK])) / len(s)
                if share >= licenses.THRESHOLD:
                    found[label] = max(found.get(label, 0), share)
    base = sorted({p[1] for p in places})
    at = [p[0] for p in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(base),
            ",".join(sorted({*base, *found})), 1.0 if base else max(found.values(), default=0.0))


def test_scan_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    full = " ".join(t for texts in licenses.TEMPLATES.values() for t in texts)
    odd = ["", None, "cc by cc by CC-BY, general public license", full, "lorem " * 40 + full + " ipsum" * 40,
           "Permission is granted, free of charge, to any person obtaining copy of software", "all rights\nreserved É",
           "permission hereby " * 2000, " ".join(full.split()[::-1]), "xcc by", "cc byx"]
    extra = spark.createDataFrame([(-1 - i, t, "x") for i, t in enumerate(odd)], docs.schema)
    rows = docs.unionByName(extra)
    text = {r.doc_id: r.text for r in rows.collect()}
    got = licenses.scan(rows).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(text[r.doc_id]), r.doc_id
    assert licenses.scan(rows.limit(0)).count() == 0


def test_look_alikes_are_told_apart(spark):
    far = " lorem" * 12
    lines = {
        "Released under the MIT License": {"mit"}, "released, under the (MIT) license.": {"mit"},
        "Released under the Apache License": set(), "Released under the GNU General Public License": {"gpl"},
        "Licensed under CC BY-NC 4.0": {"cc-by", "cc-by-nc"}, "Licensed under CC BY 4.0": {"cc-by"},
        "Licensed under the Apache License, Version 2.0": {"apache"},
        "Licensed under the Mozilla Public License, Version 2.0": set(),
        "This work is licensed under the GNU General Public License, version 3": {"gpl"},
        "This work is licensed under the Mozilla Public License, version 3": set(),
        "This Source Code Form is subject to the terms of the Mozilla Public License": {"mpl"},
        "This Source Code Form is subject to the terms of the Eclipse Public License": set(),
        "Permission granted, free of charge, to any person obtaining a copy of this software": {"mit"},
        f"MIT{far} released under{far} the license": set(),
        "lorem " * 30 + "Released under the MIT License" + " ipsum" * 70: {"mit"},
    }
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licenses.scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(lines)} == lines
