"""The jobs against plain Python; the incremental one over input that grows and after a run that broke off."""

import json
import os
import re
import subprocess
import sys
from collections import Counter
from datetime import datetime, timedelta
from math import sqrt
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import DataFrameWriter

from jobs import label_agreement, queries, text_fingerprints

ROOT = str(Path(__file__).parent.parent)
EVENTS = "event_id long, ts timestamp, event_type string"


def some_events(first, many):
    day = datetime(2024, 1, 1)
    return [(i, None if i % 50 == 49 else day + timedelta(minutes=(i * 797) % 4320), (None, "click", "view")[(i * 7) % 3]) for i in range(first, first + many)]


def brute_agreement(events):
    cells = Counter()
    for _, ts, kind in events:
        minute = None if ts is None else ts.hour * 60 + ts.minute
        cells[kind or "unknown", 0 if minute is None else minute // 180 + 1, 0 if minute is None else minute // 210 + 1] += 1
    out = set()
    for kind, u in {(k, u) for k, u, _ in cells if u}:
        total = lambda at, x: sum(n for c, n in cells.items() if c[0] == kind and c[at] == x)  # noqa: B023, E731
        scored = [(-n / (total(1, u) + total(2, v) - n), v, n) for (k, uu, v), n in cells.items() if k == kind and uu == u and v]
        s, v, n = min(scored)
        out.add((kind, u, v, n, round(-s, 6)))
    return out


def write(spark, rows, path):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def cells_of(spark, output):
    return Counter({r.batch: r["sum(n)"] for r in spark.read.parquet(f"{output}/cells").groupBy("batch").sum("n").collect()})


def test_agreement_takes_only_what_is_new(spark, tmp_path):
    events, output, mark = (f"file://{tmp_path}/{x}" for x in ("events", "out", "mark"))
    first, second = some_events(0, 700), some_events(700, 500)
    write(spark, first, events)
    assert {tuple(r) for r in label_agreement.run(spark, events, output, mark).collect()} == brute_agreement(first)
    assert cells_of(spark, output) == {0: 700}
    write(spark, second, events)
    got = {tuple(r) for r in label_agreement.run(spark, events, output, mark).collect()}
    assert got == brute_agreement(first + second)
    assert cells_of(spark, output) == {0: 700, 1: 500}  # the second batch is the new file
    assert {tuple(r) for r in label_agreement.run(spark, events, output, mark).collect()} == got and cells_of(spark, output) == {0: 700, 1: 500}


def test_agreement_after_a_run_that_broke_off(spark, tmp_path, monkeypatch):
    events, output, mark = (f"file://{tmp_path}/{x}" for x in ("events", "out", "mark"))
    write(spark, some_events(0, 300), events)
    label_agreement.run(spark, events, output, mark)
    write(spark, some_events(300, 200), events)
    wrote = DataFrameWriter.parquet

    def fails_behind(self, path, *a, **b):
        wrote(self, path, *a, **b)
        if str(path).endswith("/cells"):
            raise RuntimeError("lost after the write")

    monkeypatch.setattr(DataFrameWriter, "parquet", fails_behind)
    with pytest.raises(Exception, match="lost after the write"):
        label_agreement.run(spark, events, output, mark)
    monkeypatch.undo()
    assert {tuple(r) for r in label_agreement.run(spark, events, output, mark).collect()} == brute_agreement(some_events(0, 500))
    assert cells_of(spark, output) == {0: 300, 1: 200}


def test_agreement_of_no_events(spark, tmp_path):
    events = f"file://{tmp_path}/events"
    spark.createDataFrame([], EVENTS).write.parquet(events)
    assert label_agreement.run(spark, events, f"file://{tmp_path}/out", f"file://{tmp_path}/mark").collect() == []


def brute_network(docs, k):
    counts = {}
    for _, text, lang, source in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        if words:
            counts.setdefault((lang or "unknown", source or "unknown"), Counter()).update(words)
    norm = {r: sqrt(sum(n * n for n in c.values())) for r, c in counts.items()}
    cos = {(a, b): round(sum(n * counts[b][w] for w, n in counts[a].items()) / norm[a] / norm[b], 9) for a in counts for b in counts if a != b}
    near = {(a, b) for a in counts for b in sorted((x for x in counts if x != a and set(counts[x]) & set(counts[a])), key=lambda x: (-cos[a, x], x))[:k]}  # noqa: B023
    weight = Counter()
    for a, b in near:
        weight[a, b] += 0.5
        weight[b, a] += 0.5
    deg = Counter()
    for (a, _), w in weight.items():
        deg[a] += w
    own = {a: {b for x, b in weight if x == a} for a in deg}
    linked = {a: sum(1 for b in own[a] for c in own[a] if b < c and (b, c) in weight) for a in own}
    clustering = {a: 2 * linked[a] / (len(own[a]) * (len(own[a]) - 1)) if len(own[a]) > 1 else 0.0 for a in own}
    return {(*a, *b, round(cos[a, b], 6), w, round(w / sqrt(deg[a] * deg[b]), 6), len(own[a]), round(clustering[a], 6)) for (a, b), w in weight.items()}


DOCS = "doc_id long, text string, lang string, source string"


def some_documents():
    docs = [(i, " ".join(f"w{(i * i + j * (1 + i % 7)) % 40}" for j in range(20 + i % 9)), ("en", "de", None)[i % 3], f"s{i % 4}") for i in range(120)]
    return docs + [(200, None, "en", "s0"), (201, "", "fr", "s9"), (202, "Über ÜBER über", "fr", None), (203, "!!!", None, None), (203, "W1 w1", "fr", "s1"), (204, "alone", "xx", "s1")]


def test_fingerprints(spark, tmp_path):
    docs = some_documents()
    spark.createDataFrame(docs, DOCS).withColumnRenamed("doc_id", "col").repartition(3).write.parquet(f"{tmp_path}/documents")  # a name that the job has too
    first = text_fingerprints.run(spark, f"{tmp_path}/documents", f"{tmp_path}/out", neighbours=3)
    got = {tuple(r[c] for c in ("lang", "source", "to_lang", "to_source", "similarity", "weight", "normalized", "degree", "clustering")) for r in first.collect()}
    assert got == brute_network(docs, 3)
    assert sorted(p.name for p in (tmp_path / "out").glob("lang=*")) == sorted({f"lang={r[0]}" for r in got})
    again = text_fingerprints.run(spark, f"{tmp_path}/documents", f"{tmp_path}/out", neighbours=3)
    assert again.count() == len(got) and {tuple(r[c] for c in ("lang", "source", "to_lang")) for r in again.collect()} == {x[:3] for x in got}
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none")
    assert text_fingerprints.run(spark, f"{tmp_path}/none", f"{tmp_path}/none-out").collect() == []


def test_queries_and_their_sql(spark, tmp_path):
    spark.createDataFrame(some_documents(), DOCS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(some_events(0, 900), EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for t in ("documents", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    con.execute("set timezone = 'UTC'")
    for name, query in queries.QUERIES.items():
        got = query(spark, str(tmp_path))
        columns = sorted(got.columns)
        want = con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall()
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want), name


@pytest.mark.parametrize("name", ["text_fingerprints", "label_agreement"])
def test_command_lines(spark, tmp_path, name):
    spark.createDataFrame(some_documents(), DOCS).write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame(some_events(0, 100), EVENTS).write.parquet(f"{tmp_path}/events")
    settings = json.loads((Path(ROOT) / "jobs" / f"{name}.json").read_text()) | {"output": f"{tmp_path}/out"}
    settings |= {"documents": f"{tmp_path}/documents"} if name == "text_fingerprints" else {"events": f"{tmp_path}/nothing", "checkpoint": f"{tmp_path}/mark"}
    (tmp_path / "settings.json").write_text(json.dumps(settings))
    more = [] if name == "text_fingerprints" else ["--events", f"{tmp_path}/events"]  # the command line's path goes first
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell", "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-m", f"jobs.{name}", "--config", str(tmp_path / "settings.json"), *more], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert re.search("read 126 documents|took 100 new events", done.stderr) and "wrote" in done.stderr
    assert list((tmp_path / "out").rglob("*.parquet"))


def test_words_are_split_and_then_lowered(spark):
    from jobs.text_fingerprints import counted

    docs = spark.createDataFrame([("a", " Été, ÉTÉ abc-Abc\x00ABC 12x\u00a0y. "), ("a", "abc"), ("b", "... 12"), (None, "Straße"), ("b", None), ("b", "")], "lang string, text string")
    got = {(r.lang, r.col): r.n for r in counted(docs, ["lang"], "text").collect()}
    assert got == {("a", "Été"): 1, ("a", "ÉtÉ"): 1, ("a", "abc"): 4, ("a", "12x\u00a0y"): 1, ("b", "12"): 1, ("unknown", "straße"): 1}
    assert "regexp_extract_all" not in counted(docs, ["lang"], "text")._jdf.queryExecution().optimizedPlan().toString()
