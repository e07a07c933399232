import math
import re
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from tessera.llm import license_scan as op
from tests.llm.conftest import MIDDLE, ROWS, read


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", text or "")]


def own(texts):
    """(licence, cosine, share) of each text, every unit against every template."""
    df = Counter(w for t in texts for w in set(terms(t)))
    idf = defaultdict(lambda: math.log(1 + len(texts)) + 1, {w: math.log((1 + len(texts)) / (1 + n)) + 1 for w, n in df.items()})
    vector = lambda ws: {w: c * idf[w] for w, c in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, vector(terms(t))) for name, t in op.TEMPLATES]
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        first = next((i for i, x in enumerate(lines) if terms(x)), 0)
        head = []
        for x in lines[first:]:
            if not terms(x):
                break
            head += terms(x)
        whole = terms(t)
        units = [terms(x) for x in lines] + [whole] + ([head] if len(head) < len(whole) else [])
        best = []
        for u in filter(None, units):
            v = vector(u)
            for name, k in known:
                c = sum(x * k[w] for w, x in v.items() if w in k) / norm(v) / norm(k)
                if c >= op.LEAST:
                    best.append((-round(c, 9), name, -len(u)))
        out.append((min(best)[1], -min(best)[0], -min(best)[2] / len(whole)) if best else (None, 0.0, 0.0))
    return out


def inherit(files, found):
    votes = defaultdict(Counter)
    up = lambda p: p.rpartition("/")[0]
    for (_, path, _), (name, _, share) in zip(files, found, strict=True):
        if name and (share >= op.SHARE or re.match(op.NAMES, (path or "").rpartition("/")[2])):
            votes[up(path or "")][name] += 1
    out = []
    for (i, path, _), (name, sim, _) in zip(files, found, strict=True):
        path, d = path or "", up(path or "")
        while d not in votes and d:
            d = up(d)
        near = min((-n, x) for x, n in votes[d].items())[1] if d in votes else None
        out.append((i, path, name, round(sim, 9), name or near, path if name else d if near else None))
    return sorted(out, key=repr)


def compare(spark, files):
    got = op.license_scan(spark.createDataFrame(files, "doc_id long, path string, text string"), "doc_id").collect()
    rows = sorted(((r.id, r.path, r.own_license, round(r.own_similarity, 9), r.license, r.license_from) for r in got), key=repr)
    assert rows == inherit(files, own([t for _, _, t in files]))


def test_whole_table_against_all_pairs(spark):
    files = [(r[0], f"{r[3]}/{r[2]}/{r[0]}", r[1]) for r in read(MIDDLE, "documents")]
    assert sum(1 for x in own([t for _, _, t in files]) if x[0]) > 5
    compare(spark, files)


def test_directories(spark):
    mit, gpl = "Released under the MIT License.", "words before\n\nThis work is licensed under the GNU General Public License, version 3."
    compare(spark, [(1, "a/LICENSE", mit), (2, "a/b/c/x.py", "nothing here"), (3, "a/b/COPYING.txt", gpl + "\n" + "more words " * 20), (4, "z.py", None),
                    (5, None, ""), (6, "a/y.py", "text " * 50 + "\nLicensed under the Apache License, Version 2.0."), (7, "a/b/c/x.py", "again"),
                    (8, "q/n1", mit), (9, "q/n2", gpl.split("\n\n")[1]), (10, "q/n3", "plain"), (11, "q/deep/er/n4", "plain"), (12, "ab/f", "plain"),
                    (13, "h/f.c", "Licensed under the Apache\nLicense, Version 2.0.\n\nint main and much more text of code follows here")])


@pytest.mark.parametrize("rows", [ROWS, []])
def test_awkward_rows_and_empty_table(spark, awkward, rows):
    files = awkward.withColumn("path", awkward["text"]) if rows else awkward.limit(0).withColumn("path", awkward["text"])
    assert op.license_scan(files, "doc_id").count() == len(rows)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0"""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU{1} General Public License as published by
the Free Software Foundation{2} either version {3} of the License, or
(at your option) any later version."""


def test_standard_files_and_wrapped_headers(spark):
    """Licence files and headers as real files have them, beside the corpus that sets the weights."""
    code = "\nimport os\n" + "".join(f"def f{i}(a):\n    return os.path.join(a, 'the name of {i}')\n" for i in range(40))
    mark = lambda m, t: "".join(f"{m} {x}".rstrip() + "\n" for x in ["Copyright 2020 Some Body", "", *t.split("\n")])
    want, files = {}, []

    def add(path, name, text):
        want[path] = name
        files.append((len(files), path, text))

    texts = dict(op.standard_texts())
    assert len(texts) >= 12
    for name, text in texts.items():
        add(f"{name}/LICENSE", name, f"The {name} Licence\n\nCopyright (c) 2020 Some Body\n\n{text}")
        add(f"{name}/src/a.py", name, code)                                    # handed down
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC"):
        add(f"x/{name}.py", name, mark("#", texts[name]) + code)
        add(f"x/{name}.c", name, f"/*\n Copyright 2020 Some Body\n\n{texts[name]}*/\n{code}")
        add(f"x/{name}.md", name, f"About\n\nwords on what this does\n\n{texts[name]}\n\n{code}")
    for m in ("#", "//", " *", "--"):
        add(f"x/apache-{len(files)}", "Apache-2.0", mark(m, APACHE) + code)
        for name, how in (("GPL-2.0", (";", "", ";", "2")), ("GPL-3.0", (":", "", ",", "3")), ("AGPL-3.0", (":", " Affero", ",", "3")),
                          ("LGPL-3.0", (":", " Lesser", ",", "3"))):
            add(f"x/{name}-{len(files)}", name, mark(m, GPL.format(*how)) + code)
    plain = Path(op.__file__).parents[2] / "README.md"
    add("y/plain.md", None, plain.read_text().split("op5_license_scan")[0])
    docs = [(1000 + r[0], f"corpus/{r[0]}", r[1]) for r in read(MIDDLE, "documents")]
    got = op.license_scan(spark.createDataFrame(files + docs, "doc_id long, path string, text string"), "doc_id")
    got = {r.path: r.license for r in got.filter("id < 1000").collect()}
    assert {p: (got[p], n) for p, n in want.items() if got[p] != n} == {}
