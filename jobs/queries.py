"""The jobs as queries: each runs twice into a new folder of the shared one, and returns what the second run leaves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import label_agreement, text_fingerprints
from lattica.plans.staging import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_text_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "job1")
    for _ in range(2):
        out = text_fingerprints.run(spark, f"{sf_dir}/documents.parquet", output)
    return out


def job2_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _folder(spark, "job2")
    for _ in range(2):
        out = label_agreement.run(spark, f"{sf_dir}/events.parquet", output, f"{output}-mark")
    return out


QUERIES = {"job1_text_fingerprints": job1_text_fingerprints, "job2_label_agreement": job2_label_agreement}

ORACLES = {
    "job1_text_fingerprints": r"""
        with d as (select coalesce(lang, 'unknown') lang, coalesce(source, 'unknown') source,
                          unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) w from documents),
        c as (select lang, source, w, count(*) n from d group by all),
        r as (select *, row_number() over (order by lang, source) id from (select distinct lang, source from c)),
        f as (select id, w, n / sum(n) over (partition by id) x from c join r using (lang, source)),
        q as (select id, w, x / sqrt(sum(x * x) over (partition by id)) x from f),
        s as (select a.id i, b.id j, round(sum(a.x * b.x), 9) x from q a join q b on a.w = b.w and a.id <> b.id group by 1, 2),
        k as (select i, j from (select *, row_number() over (partition by i order by x desc, j) p from s) where p <= 5),
        e as (select i, j, count(*) * 0.5 w from (select i, j from k union all select j, i from k) group by 1, 2),
        g as (select i, sum(w) w, count(*) d from e group by 1),
        t as (select a.i, count(*) / 2 t from e a join e b on a.j = b.i join e c on b.j = c.i and c.j = a.i group by 1)
        select x.lang, x.source, y.lang to_lang, y.source to_source, round(s.x, 6) similarity, cast(e.w as double) weight, round(e.w / sqrt(g.w * h.w), 6) normalized,
               g.d degree, round(case when g.d < 2 then 0 else 2 * coalesce(t.t, 0) / (g.d * (g.d - 1)) end, 6) clustering
        from e join s using (i, j) join g on g.i = e.i join g h on h.i = e.j left join t on t.i = e.i join r x on x.id = e.i join r y on y.id = e.j
    """,
    "job2_label_agreement": """
        with m as (select coalesce(event_type, 'unknown') event_type, coalesce(cast((hour(ts) * 60 + minute(ts)) // 180 + 1 as int), 0) u, coalesce(cast((hour(ts) * 60 + minute(ts)) // 210 + 1 as int), 0) v from events),
        c as (select event_type, u, v, count(*) n from m group by all),
        z as (select *, sum(n) over (partition by event_type, u) nu, sum(n) over (partition by event_type, v) nv from c),
        j as (select *, n / (nu + nv - n) x from z where u <> 0 and v <> 0),
        b as (select *, row_number() over (partition by event_type, u order by x desc, v) p from j)
        select event_type, u, v, n, round(x, 6) jaccard from b where p = 1
    """,
}
