import math
import re
from collections import Counter

from fixtures import prose

from gopmill.llm import licenses


def terms(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha() or c in "0123456789":
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(files):
    """files: (path, text) -> licence, score, inherited, from."""
    vectors = [Counter(terms(t)) for _, t in licenses.NOTICES]
    vocabulary = set().union(*vectors)
    df = Counter(t for _, text in files for t in set(terms(text)) & vocabulary)
    idf = {t: math.log((len(files) + 1) / (df[t] + 1)) + 1 for t in vocabulary}
    other = sum(idf.values()) / len(idf)
    weight = lambda c: {t: n * idf.get(t, other) for t, n in c.items()}
    norm = lambda w: math.sqrt(sum(x * x for x in w.values()))
    notices = [weight(v) for v in vectors]
    own = []
    for _, text in files:
        best = (0.0, 0, None)
        for unit in re.split(r"\n|(?<=[.!?;])[\x20\x09-\x0D]+", text or ""):
            w = weight(Counter(terms(unit)))
            for i, v in enumerate(notices):
                if w:
                    score = round(sum(w[t] * v[t] for t in w if t in v) / norm(w) / norm(v), 6)
                    if score >= licenses.THRESHOLD:
                        best = max(best, (score, -i, licenses.NOTICES[i][0]))
        own.append((best[2], best[0]))
    held = {}
    for (path, _), (name, score) in sorted(zip(files, own, strict=True), key=lambda x: (-x[1][1], x[0][0] or "")):
        if path is not None and name and re.search(r"(?i)(?:^|/)(?:license|licence|copying|notice)[^/]*$", path):
            held.setdefault(path.rpartition("/")[0], (name, path))
    out = []
    for (path, _), (name, score) in zip(files, own, strict=True):
        found, folder = (None, None), path.rpartition("/")[0] if path is not None else None
        while name is None and folder is not None:
            if folder in held:
                found = held[folder]
                break
            folder = folder.rpartition("/")[0] if folder else None
        out.append((str(path), name, score, *found, name or found[0]))
    return sorted(out, key=str)


def got(df):
    return sorted(((str(r.path), r.licence, r.score, r.inherited, r.inherited_from, r.effective) for r in licenses.scan(df).collect()), key=str)


def test_documents_against_brute_force(docs):
    files = licenses.as_files(docs)
    assert got(files) == brute([(r.path, r.text) for r in files.collect()])


def test_inheritance(spark):
    data = [
        ("a/LICENSE", "x\nReleased under the MIT License."), ("a/b/c/file", prose(20)), ("a/b/COPYING.txt", "Licensed under CC BY 4.0."), ("a/file", None), ("ab/file", ""),
        ("a/b/c/d/own", prose(5) + ". Licensed under the Apache License, Version 2.0. " + prose(6)), ("file", "nothing"), (None, "All rights reserved."), (None, "nothing"),
        ("a/b/NOTICE", "All rights reserved."), ("a/LICENSE", "x\nReleased under the MIT License."), ("/root", "text"), ("a//b", "text"), ("a/LICENSE/file", "text"),
    ]
    df = spark.createDataFrame(data, "path string, text string")
    assert got(df) == brute(data)
    root = [("LICENSE", "Released under the MIT License."), ("a/b", "text")]
    assert got(spark.createDataFrame(root, "path string, text string")) == brute(root)


def test_columns_stay(spark):
    df = spark.createDataFrame([("a/b", "text", "x", "y")], "path string, text string, _file string, _folder string")
    out = licenses.scan(df)
    assert out.columns[:4] == df.columns and out.first()[:4] == ("a/b", "text", "x", "y")
