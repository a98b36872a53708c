import re

from lattica.llm.decontaminate import contamination

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate(LOW))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, "Quick brown fox jumps over the lazy dog and runs far"), (2, "ONE"), (3, None), (4, "..."), (5, "wörds and ascii"), (6, "quick BROWN fox jumps over the lazy dog and runs far"), (10, "a " * 12), (7, "never seen anywhere")]


def same(a, b):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    return sorted(a, key=key) == sorted(b, key=key)


def test_brute_force(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)
    assert same([tuple(r) for r in contamination(docs, items).collect()], expected)
    monkeypatch.setattr("lattica.llm.decontaminate.BROADCAST_BYTES", -1)  # the shuffled form
    assert same([tuple(r) for r in contamination(docs, items).collect()], expected)


def test_empty_tables(spark, docs, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(none, items).collect() == []
    assert all(r.n_hit == 0 for r in contamination(docs, items.limit(0)).collect())
