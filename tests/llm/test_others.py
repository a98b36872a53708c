import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from lattica.llm import html_text, licenses, packing, toxicity, warc
from lattica.llm.common import components, shared_path
from lattica.llm.embedding_dedup import near_vectors
from lattica.llm.minhash import near_duplicates
from tokenizers import Tokenizer

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (9, 8), (8, 7), (20, 20)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


# ---- vectors ----

def brute_vectors(rows, t):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(good))}
    for a in range(len(good)):
        for b in range(len(good)):
            x, y = good[a][1], good[b][1]
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                links[a].add(b)
    out = []
    for a, (i, _) in enumerate(good):
        seen, todo = {a}, [a]
        while todo:
            todo += [b for b in links[todo.pop()] if b not in seen and not seen.add(b)]
        out.append((i, len(links[a]), min(good[s][0] for s in seen)))
    return sorted(out)


@pytest.mark.parametrize("tile", [7, 4096])
def test_vectors(spark, tile):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 12))
    rows = [(k, (centre[k % 6] * (1 + k % 3) + rng.normal(size=12) * 0.12).tolist()) for k in range(60)]
    rows += [(70, rows[3][1]), (71, rows[3][1]), (71, rows[3][1]), (72, [2 * x for x in rows[3][1]]), (73, [1.0, 0.0]), (74, [5.0, -0.0])]
    odd = [(80, None), (81, []), (82, [0.0] * 12), (83, [float("nan")] * 12), (84, [None] * 12), (85, [float("inf")] + [1.0] * 11), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows + odd], "vec_id long, embedding array<double>, label int, v string")
    got = near_vectors(df, tile=tile).collect()
    assert len(got) == len(rows + odd)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 80) == brute_vectors(rows, 0.95)
    assert all(r.n_links == 0 and r.kept for r in got if r.vec_id is None or r.vec_id >= 80)
    assert near_vectors(df.limit(0)).collect() == []


# ---- packing ----

def naive_bins(lengths, window):
    free = []
    for n in sorted(lengths, reverse=True):
        fit = min((c for c in free if c >= n), default=None)
        if fit is None:
            free.append(window - n)
        else:
            free[free.index(fit)] -= n
    return len(free)


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(2)
    for _ in range(60):
        window = int(rng.choice([7, 16, 50]))
        lengths = rng.integers(1, window + 1, rng.integers(0, 80)).tolist()
        rows, used = packing.plan({n: lengths.count(n) for n in set(lengths)}, window), set()
        for n in set(lengths):
            own = [r for r in sorted(rows) if r[0] == n]
            for rank in range(lengths.count(n)):
                _, start, first, _, each = [r for r in own if r[1] <= rank][-1]
                used.add(first + (rank - start) // each)
        assert len(used) == naive_bins(lengths, window)


def test_packing(spark, docs, none):
    rows = packing.pack(docs, TOKENIZER, window=64).collect()
    tokenizer, total, windows = Tokenizer.from_file(TOKENIZER), 0, {}
    ids = [tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2] for r in docs.collect()]
    crcs = {zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes()) for x in ids for s in range(0, len(x), 64)}
    for r in rows:
        total += r.length
        assert r.ids_crc32 in crcs and r.start % 64 == 0
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert total == sum(map(len, ids))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    lengths = [min(64, len(x) - s) for x in ids for s in range(0, len(x), 64)]
    assert len(windows) == naive_bins(lengths, 64)
    assert packing.pack(none, TOKENIZER).collect() == []


def test_ids_equal_the_tokenizer():
    texts = ["", "  ", "Don't WE'LL 'S", "a\x1cb \x1f c", "été ÉTÉ İ ŉ ß ſ's", "ΑΣ ΣΑΣ ́e", "日本語 😀👍🏽", "x<|endoftext|>y <|startoftext|>", "“quotes” — dash… €5", "１２ ½ ª", "a b　c\x85d", "_a__b1_2"]
    tokenizer = Tokenizer.from_file(TOKENIZER)
    assert packing.Ids(TOKENIZER).of(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


# ---- toxicity ----

def test_machine_learns_a_pair():
    rng = np.random.default_rng(3)
    texts, label = [], []
    for _ in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"w{rng.integers(60)}" for _ in range(8)] + ["insult"] * insult + ["groupname"] * group))
        label.append(float(insult and group))
    m = toxicity.train([toxicity.terms_of(t) for t in texts], np.array(label))
    score = lambda t: m.logits(*m.placed([toxicity.terms_of(t)]), 1)[0][0]
    assert score("insult groupname w1 w2") > 0 > max(score("insult w1 w2"), score("groupname w1 w2"), score(""))


def test_scores(spark, docs, none):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic", "lang")
    machine = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, machine).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(none, toxicity.fit(none, labels.limit(0))).collect() == []


# ---- web pages ----

def test_blocks():
    page = '<html><head><title>T</title></head><body><header>H</header><nav>N<aside>S</aside></nav><div id="cookie-notice">C</div><article><header><h1>A &amp; B</h1></header><p>one<br>two &nbsp; three<p>four <form>F</form><script>if (a < b) "</p>"</script><div class="ad">AD</div><ul><li>x<li>y</ul><section class="comments"><p>no</p></section></article><footer>f'
    assert html_text.main_text(html_text.blocks_of(page), []) == "A & B\none two three\nfour\nx\ny"
    loose = '<article><p class="notice">N<div>kept</div><p class="side-bar">S<p>also <b>this<p>and that</article>'
    assert html_text.main_text(html_text.blocks_of(loose), []) == "N\nkept\nS\nalso this\nand that"
    assert html_text.main_text(html_text.blocks_of(loose), [0, 2]) == "kept\nalso this\nand that"
    for kept in ('<div class="related-work">x</div>', '<section id="alert-systems">x</section>', '<div class="login-history">x</div>', '<p class="notice">x</p>', "<label>x</label>"):
        assert html_text.main_text(html_text.blocks_of(f"<article><p>a</p>{kept}</article>"), []) == "a\nx"
    for gone in ('<div class="ad">x</div>', '<div id="adSlot1">x</div>', '<section class="reader-comments">x</section>', '<ul class="share-buttons"><li>x</ul>', '<div class="cookie-banner">x</div>', "<nav>x</nav>", '<div role="navigation">x</div>'):
        assert html_text.main_text(html_text.blocks_of(f"<article><p>a</p>{gone}</article>"), []) == "a"
    assert html_text.main_text(html_text.blocks_of("<article>teaser</article><div>story</div>"), []) == "teaser\nstory"
    assert html_text.blocks_of(None) == [] and html_text.blocks_of("a < b & c") == [("open", "a < b & c")]


def test_differencing(spark):
    plain = lambda n: f"<body><div>Site name</div><p>Story {n} tells of {n}.</p><div>All rights</div></body>"
    rows = [(i, f"http://h.example/{i}", plain(i)) for i in range(8)] + [(20, "http://other.example/a", plain(20)), (21, None, None), (22, "http://c.example/a", "<p>same</p>"), (23, "http://c.example/b", "<p>same</p>"), (23, "http://c.example/b", "<p>same</p>")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, host string")).collect()}
    assert all(got[i].text == f"Story {i} tells of {i}." for i in range(8))
    assert got[20].text.startswith("Site name\n") and got[21].text == "" and got[22].text == "same" and got[4].n_chars == len(got[4].text)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_extraction_by_brute_force(spark):
    """Whole extraction of pages whose lines come in one order, so that a longest common subsequence is what two pages share."""
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for i in range(60):
        own = sorted(set(rng.integers(0, 14, rng.integers(0, 9)).tolist()))
        path = "".join(rng.choice(list("abc"), rng.integers(1, 7)))
        rows.append((i, f"https://h{i % 3}.example/{path}", own, bool(rng.random() < 0.3)))
    rows.append((60, None, [1, 2], False))
    line = lambda k, art: f"<p>line {k}</p>" if k % 3 or not art else f'<p class="notice">line {k}</p>'
    page = lambda own, art: ("<nav>line 3</nav><article>" if art else "") + "".join(line(k, art) for k in own) + ("</article>" if art else "")
    table = [(i, u, page(own, art)) for i, u, own, art in rows]
    blocks = lambda own, art: [("nav", 3)] * art + [("line", k) for k in own]
    host = lambda u: (u or "").split("//")[-1].split("/")[0]
    path = lambda u: "/" + (u or "").split("//")[-1].partition("/")[2]
    for i, u, own, art in rows:
        near = sorted((path(v), j) for j, v, _, _ in rows if host(v) == host(u))
        at = near.index((path(u), i))
        alike = lambda other: len([1 for n in range(1, len(path(u)) + 1) if other[0][:n] == path(u)[:n] and len(other[0]) >= n])  # noqa: B023, E731
        sides = [near[k] for k in (at - 1, at + 1) if 0 <= k < len(near)]
        other = max(sides, key=alike, default=None)
        theirs = {k for _, k in blocks(rows[other[1]][2], rows[other[1]][3])} if other else set()
        open_ = [k for k in own if not art or k % 3 == 0]
        gone = set(open_) & theirs if not set(own) <= theirs else set()
        want[i] = (own, gone, sorted({a for a, _ in near}) == [a for a, _ in near], art, other is not None and rows[other[1]][3])
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(table, "page_id long, url string, html string")).collect()}
    checked = 0
    for i, (own, gone, apart, art, their_art) in want.items():
        if apart and not art and not their_art:  # equal paths have no order of their own, a menu's line may stand before others
            checked += bool(gone)
            assert got[i] == "\n".join(f"line {k}" for k in own if k not in gone), i
    assert len(got) == 61 and got[60] == "line 1\nline 2"
    for i, (own, _, _, art, _) in want.items():  # an article's own text stays whatever its neighbours hold
        assert not art or set(f"line {k}" for k in own if k % 3) <= set(got[i].split("\n"))


def test_long_pages():
    for page in ("<div>x</div>" * 20_000, "</p>" * 50_000 + "x", "<b>" * 20_000 + "<div>x</div>" * 20_000, "<p>" + "y " * 500_000):
        blocks = html_text.blocks_of(page)
        lines = [t for _, t in blocks]
        assert html_text.common_places(lines, lines[1:]) == list(range(len(lines) - 1)) or len(set(lines)) == 1
    a, b = np.random.default_rng(8).integers(0, 2, (2, 6000)).tolist()
    assert 0.83 * 6000 > len(html_text.common_places(a, b)) > 0.79 * 6000


@pytest.mark.parametrize("bound", [1 << 22, 1])
def test_common_places(monkeypatch, bound):
    monkeypatch.setattr(html_text, "_TABLE", bound)
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)).tolist(), rng.integers(0, 4, rng.integers(0, 12)).tolist()
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        places, rest = html_text.common_places(a, b), iter(b)
        assert len(places) == table[-1, -1] and all(a[p] in rest for p in places)


# ---- archives ----

PAGES = [(5, "http://a/x", "same"), (3, "http://b/y", "same"), (3, "http://b/y", "same"), (9, None, None), (7, "u", ""), (None, "http://n/", "same"), (1, "q\r\nz", "é\r\n\r\nWARC/1.1\r\nx"), (2, "q", "é\r\n\r\nWARC/1.1\r\nx"), (11, "l", "y" * 100_000)]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "c") for p in PAGES], "page_id long, url string, html string, type string")
    path = shared_path(spark, "test-warc")
    warc.write_captures(df, path, file_records=2)
    rows = warc.assemble(warc.read_records(spark, path)).collect()
    want = sorted((p or -1, t or "") for p, _, t in PAGES)
    assert sorted((r.page_id or -1, r.payload) for r in rows) == want
    assert all(r.payload_bytes == len(r.payload.encode()) and r.request is not None and re.fullmatch("[A-Z2-7]{32}", r.payload_digest) for r in rows)
    first = Counter((r.page_id, r.capture.refers_to_page) for r in rows)
    assert first == Counter([(5, 3), (3, None), (3, 3), (9, 7), (7, None), (None, None), (1, None), (2, 1), (11, None)])
    ids = [r.record_id for r in warc.read_records(spark, path).collect()]
    assert len(set(ids)) == len(ids) == 3 * len(PAGES)
    whole = shared_path(spark, "test-warc")
    warc.write_captures(df, whole, dedup_bytes=10**6)
    ids = [r.record_id for r in warc.read_records(spark, whole).where("type <> 'revisit'").collect()]
    assert len(set(ids)) == len(ids) == 3 * len(PAGES)
    assert warc.round_trip(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="byte 0"):
        list(warc.parse_records([b"junk"]))
    with pytest.raises(ValueError, match="not complete"):
        list(warc.parse_records([b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 5\r\n\r\nab"]))
    bare = shared_path(spark, "test-warc")
    warc.write_captures(df, bare, compression="none")
    assert sorted((r.page_id or -1, r.payload) for r in warc.assemble(warc.read_records(spark, bare)).collect()) == want


def test_records_in_pieces():
    block = b"a\r\n\r\nb\r\n"
    record = b"WARC/1.1\r\nWARC-Type: request\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for n in (1, 7, 30, 10_000):
        data = record * 5
        assert len(list(warc.parse_records(data[i : i + n] for i in range(0, len(data), n)))) == 5


# ---- licences ----

def test_inheritance(spark):
    rows = [("/a/LICENSE", "Licensed under the MIT License"), ("/a/b/x.py", "code"), ("/a/b/c/y.py", "code here and more words than that\nLicensed under CC BY-NC 4.0.\n"), ("/z/q", "none"), (None, None), ("/a/b/c/k", None), ("/a/b/c/k", None), ("/z/w/e", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, dir int")
    got = {(r.path, r.text): (r.license, r.license_from) for r in licenses.scan(df).collect()}
    assert got["/a/b/x.py", "code"] == ("MIT", "/a") and got["/a/b/c/y.py", rows[2][1]] == ("CC-BY-NC-4.0", "own") and got["/a/b/c/k", None] == ("MIT", "/a")
    assert got["/z/q", "none"] == (None, None) and got[None, None] == (None, None) and licenses.scan(df).count() == len(rows)
    assert licenses.scan(df.limit(0)).collect() == []


def test_anchors_are_necessary():
    forms, _, _ = licenses.vectors(100, {w: 5 for v in licenses.TEMPLATES.values() for t in v for w in licenses._words(t)})
    held = set(licenses.anchors(forms, 0.75))
    for v in forms.values():
        assert sum(x * x for w, x in v.items() if w not in held) < 0.75**2


PLANTED = {
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "LicenseRef-proprietary",
}


def test_planted_statements_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "concat('/', doc_id) path").dropDuplicates(["doc_id"])
    bags = {r.doc_id: [Counter(re.findall("[a-z0-9]+", x.lower())) for x in {r.text or "", *(r.text or "").split("\n")}] for r in docs.collect()}
    df = Counter(w for lines in bags.values() for w in set().union(*lines))
    forms = [(n, Counter(re.findall("[a-z0-9]+", f.lower()))) for n, of in licenses.TEMPLATES.items() for f in of]
    idf = lambda w: math.log((len(bags) + 1) / (df[w] + 1)) + 1
    rare = max(idf(w) for _, f in forms for w in f)
    known = {w for _, f in forms for w in f}
    size = lambda bag: math.sqrt(sum((n * (idf(w) if w in known else rare)) ** 2 for w, n in bag.items()))
    forms = [(n, f, size(f)) for n, f in forms]
    best = {}
    for i, lines in bags.items():
        for bag in lines:
            if "license" in bag or "reserved" in bag or "cc" in bag:
                s = size(bag)
                for n, f, t in forms:
                    cosine = sum(k * bag[w] * idf(w) ** 2 for w, k in f.items()) / (s * t)
                    if cosine >= 0.75:
                        best.setdefault(i, {}).update({n: max(cosine, best.get(i, {}).get(n, 0))})
    got = {r.doc_id: r for r in licenses.scan(docs).where("license_from = 'own'").collect()}
    assert set(got) == set(best)
    for i, r in got.items():
        assert r.license_score == pytest.approx(max(best[i].values())) and best[i][r.license] == pytest.approx(r.license_score)
    planted = {r.doc_id: {n for x, n in PLANTED.items() if x in (r.text or "").split("\n")} for r in docs.collect()}
    assert {n for x in planted.values() for n in x} == set(PLANTED.values())
    assert all(got[i].license in x and got[i].license_score == 1 for i, x in planted.items() if x)


def test_headers_files_and_spans(spark):
    mit = "MIT License\n\nCopyright (c) 2021 Jo Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND.\n"
    gnu = "# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU {n} as published by\n# the Free Software Foundation; either version {v} of the License, or\n# (at your option) any later version.\n#\nimport os\n"
    bsd = "Copyright (c) 2020, Jo. All rights reserved.\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    cases = [
        ("/m/text", mit, "MIT"), ("/g/text", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n" + "Preamble of many other words. " * 400, "GPL-3.0"),
        ("/t/1", gnu.format(n="General Public License", v="2"), "GPL-2.0"), ("/t/2", gnu.format(n="General Public License", v="3"), "GPL-3.0"), ("/t/3", gnu.format(n="Lesser General Public License", v="2.1"), "LGPL-2.1"),
        ("/t/4", gnu.format(n="Affero General Public License", v="3"), "AGPL-3.0"), ("/t/5", "// SPDX-License-Identifier: MIT\nint main", "MIT"), ("/t/6", "// SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("/t/7", "Copyright 2019 Jo Doe. All rights reserved. Licensed under the MIT License. See LICENSE in the root for details and terms of use.", "MIT"),
        ("/t/8", "The figures here were drawn by hand over a year. This work is licensed under a Creative Commons Attribution 4.0 International License. Mail us with any question about them.", "CC-BY-4.0"),
        ("/t/9", "/* Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n */", "Apache-2.0"),
        ("/t/10", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.", "ISC"),
        ("/t/11", bsd, "BSD-2-Clause"), ("/t/12", bsd + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
        ("/n/13", "SPDX-License-Identifier: Foo", None), ("/n/14", "All the rights of way over the hill are public", None), ("/t/15", "Copyright Jo. All rights reserved, whatever the use.", "LicenseRef-proprietary"),
    ]
    below = [("/m/src/a", "code"), ("/g/src/b", "code")]
    prose = [(f"/p/{i}", " ".join(f"w{(i * 31 + j) % 97}" for j in range(40)) + " and the or of it to a in this any use by with is are") for i in range(300)]
    df = spark.createDataFrame([c[:2] for c in cases] + below + prose, "path string, text string")
    got = {r.path: (r.license, r.license_from) for r in licenses.scan(df).collect()}
    assert [(p, got[p]) for p, _, _ in cases] == [(p, (n, n and "own")) for p, _, n in cases]
    assert got["/m/src/a"] == ("MIT", "/m") and got["/g/src/b"] == ("GPL-3.0", "/g") and all(got[p] == (None, None) for p, _ in prose)


def test_raw_elements_that_close_themselves_or_never():
    text = lambda page: " ".join(t for _, t in html_text.blocks_of(page))
    assert text("<p>one <svg viewBox='0 0 1 1'/> two</p><p>three <svg><text>no</text></svg> four</p>") == "one two three four"
    assert text("<p>one <math/> two</p>") == "one two"
    assert text("<p>one <canvas> two</p>") == text("<p>one <object data=x> two</p>") == "one two"
    assert text("<p>one</p><script src=x />no</script><p>two</p>") == "one two" and text("<p>one</p><script>no") == "one"


# ---- clashing names and long texts ----

def test_columns_that_clash(spark):
    names = ("_key", "_l", "_s", "_path", "near", "_text", "__text", "_scored", "score", "license", "key", "whole")
    row = tuple(f"x{i}" for i in range(len(names)))
    df = spark.createDataFrame([(1, "/a/f", "Released under the MIT License.", *row), (2, None, None, *row)], "doc_id long, path string, text string, " + ", ".join(f"{n} string" for n in names))
    made = licenses.scan(df).where("doc_id = 1").first().asDict()
    assert made["license"] == "MIT" and made["license_from"] == "own" and all(made[n] == x for n, x in zip(names, row, strict=True) if n != "license")
    machine = toxicity.fit(df, df.selectExpr("doc_id", "1 as toxic"))
    scored = {r.doc_id: r.asDict() for r in toxicity.score(df, machine).collect()}
    assert all(isinstance(r["score"], float) for r in scored.values()) and all(scored[2][n] == x for n, x in zip(names, row, strict=True) if n != "score")


def test_long_texts(spark):
    words = " ".join(f"w{i % 7919}" for i in range(150_000))
    rows = [(1, "/a/1", words), (2, "/a/2", words + " end"), (3, "/a/3", words + " Licensed under the MIT License"), (4, "/a/4", "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    assert {r.doc_id: r.class_id for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert {r.doc_id: r.license for r in licenses.scan(df).collect()} == {1: None, 2: None, 3: "MIT", 4: None}
    assert toxicity.score(df, toxicity.fit(df, df.selectExpr("doc_id", "cast(doc_id = 4 as int) toxic"))).where("score between 0 and 1").count() == 4


def test_repeated_ids_and_null_labels(spark):
    df = spark.createDataFrame([(i % 5, f"text {i} {'bad' if i % 2 else 'fine'}") for i in range(40)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 0), (9, 1)], "doc_id long, toxic int")
    seen = []
    real = toxicity.train
    toxicity.train = lambda terms, label, **k: seen.append((len(terms), sorted(label))) or real(terms, label, **k)
    try:
        toxicity.fit(df, labels)
    finally:
        toxicity.train = real
    assert seen == [(2, [0.0, 1.0])]  # one row an id, its largest label
