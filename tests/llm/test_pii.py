import re

import pytest
from lattica.llm.pii import EM_ROUNDS, KINDS, find_pii, joined, redact, reliabilities
from pyspark.sql import functions as F

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == 0) or (kind == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (kind == 2 and 14 <= len(digits) <= 19 and luhn(digits)) or (kind == 3 and 10 <= len(digits) <= 15):
                out.append((m.start(), kind, m.end()))
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans(docs):
    rows = find_pii(docs).select("text", joined(F.col("base")).alias("base"), joined(F.col("spans")).alias("spans")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.base == brute(r.text)
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_long_runs(spark):
    texts = ["a" * 50_000, "1" * 50_000, "1 " * 20_000, "+1" * 10_000, "a@" * 10_000, "é" * 100 + " x@y.zz " * 300]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in find_pii(df).select("text", joined(F.col("base")).alias("base")).collect():
        assert r.base == brute(r.text)


def test_classifier_adds_what_labelers_agree_on(spark):
    rows = [(f"please write e-mail to user{i}@mail.example.com today",) for i in range(200)] + [("please write e-mail to name [at] mail.example [dot] com today",)] * 20 + [("meet me [at] noon",)] * 20
    found = find_pii(spark.createDataFrame(rows, "text string"))
    assert found.where("size(base) = 0 and size(spans) > 0").count() == 20


def test_reliabilities_follow_votes(spark):
    seen = {(1, 1, 0, 1): 80, (0, 0, 1, 0): 60, (1, 0, 0, 1): 7}
    rows = [(0, list(v), [1], n) for v, n in seen.items()]
    m = reliabilities(spark.createDataFrame(rows, "kind int, v array<int>, f array<int>, n long")).first().m
    assert m.a[0] > 0.9 > 0.1 > m.b[0] and m.a[2] < 0.1
    pi, a, b = brute_em(seen)
    assert [m.pi, *m.a, *m.b] == pytest.approx([pi, *a, *b])


def brute_em(seen, rounds=EM_ROUNDS):
    pi, a, b = 0.5, [0.8] * 4, [0.2] * 4
    for _ in range(rounds):
        q = {}
        for v in seen:
            one, nil = pi, 1 - pi
            for j in range(4):
                one *= a[j] if v[j] else 1 - a[j]
                nil *= b[j] if v[j] else 1 - b[j]
            q[v] = one / (one + nil)
        n1, n0 = sum(n * q[v] for v, n in seen.items()), sum(n * (1 - q[v]) for v, n in seen.items())
        pi = (n1 + 1) / (n1 + n0 + 2)
        a = [(sum(n * q[v] * v[j] for v, n in seen.items()) + 4) / (n1 + 5) for j in range(4)]
        b = [(sum(n * (1 - q[v]) * v[j] for v, n in seen.items()) + 1) / (n0 + 5) for j in range(4)]
    return pi, a, b


def test_driver_tables_get_spans_added_and_rejected(spark):
    """Secrets are added, card numbers that fail their sum are not: the classifier decides both."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    made = find_pii(docs).select("text", joined(F.col("base")).alias("base"), joined(F.col("spans")).alias("spans")).collect()
    secrets = rejected = 0
    for r in made:
        added = set(filter(None, r.spans.split(","))) - set(filter(None, r.base.split(",")))
        want = {f"secret:{m.start(1)}:{m.end(1)}" for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', r.text or "")}
        assert r.base == brute(r.text) and added == want
        secrets += len(want)
        rejected += sum(not luhn(m[0]) for m in re.finditer(r"(?<!\d)\d{16}(?!\d)", r.text or ""))
    assert secrets > 5 and rejected > 5


def test_columns_that_clash(spark):
    names = ("_text", "_raw", "_cands", "_model", "__text", "t", "whole", "kind", "v", "f", "n", "base", "spans", "text")
    df = spark.createDataFrame([tuple(f"x{i}" for i in range(len(names) - 1)) + ("mail a@b.cc",)], ", ".join(f"{n} string" for n in names))
    r = find_pii(df).first().asDict()
    assert all(r[n] == f"x{i}" for i, n in enumerate(names[:-3])) and len(r["spans"]) == len(r["base"]) == 1
    assert redact(df).first().asDict() == {**{n: f"x{i}" for i, n in enumerate(names)}, "text": "mail <EMAIL>"}


def test_redaction(spark, docs, none):
    df = spark.createDataFrame([("mail a@b.cc and +1 (212) 555-0100.",), (None,)], "text string")
    assert [r.text for r in redact(df).collect()] == ["mail <EMAIL> and <PHONE>.", None]
    assert redact(none).collect() == [] and redact(docs).columns == docs.columns
