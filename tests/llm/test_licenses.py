import math
import textwrap
from collections import Counter

from tempora.llm import licenses as L

ROWS = [
    (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    (2, "a/b/x.py", "code\nmore code"),
    (3, "a/b/y.py", "# Released under the MIT License\ncode code\nthe end"),
    (4, "a/b/c/d/z", None),
    (5, "top", "plain words of the house"),
    (6, "q/b/LICENSE", "no notice here at all"),
    (7, "q/b/f", "the Apache tribe lives under the sun"),
    (8, None, "This work is licensed under the GNU General Public License, version 3."),
    (9, "a/b/COPYING", "Licensed under CC BY-NC 4.0."),
    (10, "r/n", "Licensed under CC BY-SA 4.0."),
    (11, "r/m", ""),
    (12, "a/bb/x", "Licensed under the Apache License, version two point oh, or else\nLicensed under CC BY 4.0"),
]


def wrapped(text, width, mark):
    return "\n".join(mark + x for x in textwrap.wrap(text, width))


FULL = {n: x for n, x in L.TEMPLATES if n in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-3-Clause", "ISC")}  # the last of each
CODE = "import os\nimport sys\n\ndef main():\n    return os.path.join(sys.argv[1], 'x')"
ROWS += [(100 + 10 * i + j, f"w/{n}{j}.py", f"#!/usr/bin/python\n{wrapped(x, width, mark)}\n{CODE}") for i, (n, x) in enumerate(FULL.items()) for j, (width, mark) in enumerate(((72, "# "), (50, " * "), (34, "// ")))]
ROWS += [(200, "v/COPYING", "Copyright 2020 Someone\n\n" + wrapped(FULL["MIT"], 70, "")), (201, "v/x/y.c", CODE), (None, "n/a", "Released under the MIT License"), (None, "n/b", CODE)]


def brute(rows):
    texts = [set(L.terms(t or "")) for _, _, t in rows]
    df = Counter(w for t in texts for w in t)
    idf, vectors = L.weights(len(rows), df, L.TEMPLATES)
    own = {}
    for key, path, text in rows:
        best = None
        lines = [x for x in (text or "").split("\n") if any(map(str.isalnum, x))]
        spans = {(k, 1) for k in range(len(lines))}
        for _, v in vectors:
            close = [sum(t in v for t in L.terms(x)) >= L.COVERED * len(L.terms(x)) for x in lines] + [False]
            if sum(close) > 1 and 2 * sum(close) >= len(lines):
                spans.add((0, len(lines)))
            begun = None
            for k, c in enumerate(close):
                if c and begun is None:
                    begun = k
                elif not c and begun is not None:
                    spans.add((begun, k - begun))
                    begun = None
        for k, n in spans:
            said = "\n".join(lines[k : k + n])
            tf = Counter(L.terms(said))
            norm = math.sqrt(sum((c * idf.get(t, 1.0)) ** 2 for t, c in tf.items()))
            for i, (name, v) in enumerate(vectors):
                s = round(sum(c * idf[t] * v[t] for t, c in tf.items() if t in v) / norm, 6) if norm else 0
                if s >= L.THRESHOLD and (best is None or (s, -k, -n, -i) > best[:4]):
                    best = (s, -k, -n, -i, name, len(said) / len(text))
        own[path, text] = best
    given = {}
    for _, path, text in rows:
        best = own[path, text]
        if path and best and (path.rpartition("/")[2].lower().startswith(("license", "copying", "notice")) or best[5] > 0.5):
            given.setdefault(path.rpartition("/")[0], []).append((-best[0], path, best[4]))
    out = {}
    for key, path, text in rows:
        if best := own[path, text]:
            out[key, path] = (best[4], best[0], "header", None)
            continue
        out[key, path] = (None, None, None, None)
        folder = path
        while folder:
            folder = folder.rpartition("/")[0]
            if folder in given:
                _, src, name = min(given[folder])
                out[key, path] = (name, None, "inherited", src)
                break
    return out


def test_scan_equals_brute_force(spark):
    got = {(r.key, r.path): (r.license, r.score, r.how, r.from_path) for r in L.scan(spark.createDataFrame(ROWS, "key long, path string, text string")).collect()}
    assert got == brute(ROWS)
    by_key = {k: v for (k, _), v in got.items()}
    assert by_key[4] == ("CC-BY-NC-4.0", None, "inherited", "a/b/COPYING") and by_key[3][0] == "MIT" and by_key[7][0] is None and by_key[11][0] == "CC-BY-SA-4.0"
    for i, n in enumerate(FULL):
        assert [by_key[100 + 10 * i + j][0] for j in range(3)] == [n] * 3
    assert by_key[200][0] == "MIT" and by_key[201] == ("MIT", None, "inherited", "v/COPYING")
    assert got[None, "n/a"][2] == "header" and got[None, "n/b"][0] == "MIT" and got[None, "n/b"][2] == "inherited"


def test_empty_and_odd_columns(spark):
    assert L.scan(spark.createDataFrame([], "key long, path string, text string")).count() == 0
    df = spark.createDataFrame([(1, "a/b", "Released under the MIT License", "x", 1), (1, "a/b", "Released under the MIT License", "x", 1), (None, None, None, None, 2)], "key long, path string, text string, license string, score int")
    assert sorted(str(r.license) for r in L.scan(df).collect()) == ["MIT", "MIT", "None"]
