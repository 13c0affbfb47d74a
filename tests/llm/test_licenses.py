"""Licence scans against plain cosines of every segment with every template, and inheritance against a walk up the path."""

import math
import random
import re
from collections import Counter

from strandline.llm import licenses


def plain(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9.+-]*[A-Za-z0-9]|[A-Za-z0-9]", text)]


class Brute:
    def __init__(self, templates):
        self.docs = [(n, Counter(plain(x))) for n in sorted(templates) for x in templates[n]]
        n = len(self.docs)
        df = Counter(w for _, c in self.docs for w in c)
        self.idf = lambda w: math.log((1 + n) / (1 + df.get(w, 1))) + 1 if w in df else math.log((1 + n) / 2) + 1
        self.tags = {x.lower() for x in templates if any(c.isdigit() for c in x)}
        self.norm = [math.sqrt(sum((f * self.idf(w)) ** 2 for w, f in c.items())) for _, c in self.docs]

    def cosines(self, segment):
        c = Counter(plain(segment))
        norm = math.sqrt(sum((f * self.idf(w)) ** 2 for w, f in c.items()))
        out = {}
        for (name, t), size in zip(self.docs, self.norm, strict=True):
            both = c.keys() & t.keys()
            if len(both) > 1 or both & self.tags:
                out[name] = max(out.get(name, 0.0), sum(c[w] * t[w] * self.idf(w) ** 2 for w in both) / norm / size)
        return out


def segments(text):
    yield text
    yield from text.split("\n")
    yield from re.split(r"\n\s*\n", text)
    yield from re.split(r"(?<=[.!?])\s+(?=[A-Z])|\n\s*\n", text)


def test_scan_against_all_cosines():
    templates = licenses.all_templates()
    t, brute = licenses.Templates(templates), Brute(templates)
    r = random.Random(3)
    all_ = [x for v in templates.values() for x in v]
    pool = sorted({w for x in all_ for w in plain(x)})
    texts = []
    for _ in range(400):
        words = plain(r.choice(all_))
        at = r.randrange(len(words))
        words = [r.choice(pool) if r.random() < 0.1 else w for w in words[at : at + r.randint(2, 40)] + (words if r.random() < 0.2 and len(words) < 400 else []) if r.random() < 0.85]
        other = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "the", "of"]) for _ in range(r.randint(0, 12)))
        texts.append(f"{other()}\n\n{' '.join(words)}\n\n{other()}." if r.random() < 0.5 else " ".join(words))
    found = 0
    for text, (name, cosine, start, end) in zip(texts, t.scan_all(texts), strict=True):
        best = max((max(c.values()) for s in segments(text) if plain(s) and (c := brute.cosines(s))), default=0.0)
        assert (name is not None) >= (best >= licenses.THRESHOLD + 1e-9), text
        if name is not None:
            have = brute.cosines(text[start:end])
            assert abs(max(have.values()) - cosine) < 1e-9
            assert name == " OR ".join(sorted(n for n, c in have.items() if c > cosine - 1e-11))
            assert " OR " in name or cosine > max((max(c.values()) for s in segments(text) if plain(s) and (c := brute.cosines(s)) and sum(v > max(c.values()) - 1e-11 for v in c.values()) == 1), default=0.0) - 1e-9
            found += 1
    assert found > 150
    assert [t.scan(x) for x in texts] == t.scan_all(texts)


def test_passages_of_long_licences_and_shared_terms():
    templates = licenses.all_templates()
    t = licenses.Templates(templates)
    middle = "\n".join(templates["GPL-3.0"][-1].split("\n")[60:330])
    assert t.scan(middle)[0] == "GPL-3.0"
    name, _, start, end = t.scan("other words of a file. " * 5000 + middle + " and more of it" * 5000)
    assert name == "GPL-3.0" and start == 115_000 + len(middle) - len(middle.lstrip()) and abs(end - start - len(middle)) < 50
    for n in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD"):
        assert t.scan(f"Copyright (c) 2001 Some Body\n\n{templates[n][-1]}")[0] == n
    assert t.scan(licenses.BSD)[0] == "BSD-2-Clause OR BSD-3-Clause" and t.scan(licenses.FEE)[0] == "0BSD OR ISC"
    assert [t.scan(x)[0] for x in ("apache-2.0", "license: agpl-3.0", "mit", "isc", "", "\n \n")] == ["Apache-2.0", "AGPL-3.0", None, None, None, None]
    assert [x[0] for x in t.scan_all(["", "MIT License", "", "words", "", "ISC License", ""])] == [None, "MIT", None, None, None, "ISC", None]


def test_nearest_ancestor_against_a_walk(spark):
    r = random.Random(8)
    notes = {"MIT": "Released under the MIT License.", "ISC": "ISC License", "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"}
    files = []
    for k in range(300):
        dir_ = [r.choice("abc") for _ in range(r.randint(0, 4))]
        own = r.choice(list(notes)) if r.random() < 0.15 else None
        files.append((k, "/".join([*dir_, f"LICENSE.{k}" if own else f"f{k}.py"]), notes[own] if own else "plain words of a file", own))
    t = licenses.Templates(licenses.all_templates())
    said = {}
    for k, path, text, own in files:
        if own:
            d = path.rpartition("/")[0]
            said[d] = min(said.get(d, (1.0, "~", "")), (-t.scan(text)[1], path, own))
    got = {x.doc_id: x for x in licenses.licenses(spark.createDataFrame(files, "doc_id long, path string, text string, dir string")).collect()}
    assert len(got) == 300
    for k, path, _, own in files:
        d = path.rpartition("/")[0]
        while own is None and d not in said and d:
            d = d.rpartition("/")[0]
        want = (own, None) if own else (said[d][2], d) if d in said else (None, None)
        assert (got[k].license, got[k].license_dir) == want, path
