"""The queries opN_<name>: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_scoring
from .decontaminate import contamination
from .embedding_dedup import near_vectors
from .html_text import extract
from .licenses import scan
from .minhash import near_duplicates
from .packing import pack
from .pii import BASE, KINDS, find_pii, joined
from .suffix_dedup import remove_repeats
from .toxicity import fit, score
from .vector_codes import books_digest, compress
from .warc import round_trip


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    many = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS) if k in BASE]
    return made.select("doc_id", *many, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_read(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _fold() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit(docs, _read(spark, sf_dir, "labels").where(_fold() != 0))
    made = score(docs, machine)
    return made.select("doc_id", F.coalesce(_fold() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = round_trip(_read(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", F.col("capture.type").alias("record_type"), F.col("capture.refers_to_page").alias("refers_to"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, in it one for each language."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("/"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))).alias("path"))
    return scan(docs).select("doc_id", "path", "license", "license_score", "license_from")


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = _read(spark, sf_dir, "documents").select("doc_id", held.alias("held_out"), "text")
    made = lm_scoring.score(docs, lm_scoring.fit(docs.where("not held_out")))
    return made.select("doc_id", "held_out", *lm_scoring.OUT)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compress(_read(spark, sf_dir, "embeddings"), keep=("label",))
    # sums may pass what a long holds
    errors = made.rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("label_error"))
    own, of = made.rows.alias("own"), errors.alias("of")
    digests = {size: books_digest(books) for size, books in made.books.items()}
    digest = F.lit(books_digest([]))
    for size, sha in digests.items():
        digest = F.when(F.col("size") == size, F.lit(sha)).otherwise(digest)
    out = own.join(of, F.col("own.label").eqNullSafe(F.col("of.label")))
    return out.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_warc": op2_warc,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_html_text": op4_html_text,
    "op5_licenses": op5_licenses,
    "op6_minhash": op6_minhash,
    "op7_packing": op7_packing,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_decontamination": op9_decontamination,
    "op10_toxicity": op10_toxicity,
    "op11_lm_score": op11_lm_score,
    "op12_vector_codes": op12_vector_codes,
}

_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_QUINTETS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(sha, {5 * i + 1}, 5) as bigint) >> {s}) & 31 as bigint) + 1, 1)" for i in range(8) for s in (15, 10, 5, 0)
)

def _code_rounds(rounds: int = 4) -> str:
    """k-means of vector parts in integers; cb0 to cb4 are the codebooks before and after the rounds."""
    out = """
        with v as (select vec_id, label, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] q from embeddings
                   where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        parts as (select vec_id, label, p, q[p * len(q) // 4 + 1 : (p + 1) * len(q) // 4] x from v, range(4) r(p)),
        cb0 as (select p, cast(row_number() over (partition by p order by vec_id) as bigint) - 1 e, x from parts qualify e < 256)"""
    for r in range(rounds + 1):
        out += f""",
        near{r} as (select vec_id, label, p, arg_min(e, (d, e)) e, min(d) d from (
            select a.vec_id, a.label, a.p, c.e, cast(list_inner_product(list_transform(list_zip(a.x, c.x), lambda z: cast(z[1] - z[2] as double)), list_transform(list_zip(a.x, c.x), lambda z: cast(z[1] - z[2] as double))) as bigint) d
            from parts a join cb{r} c on a.p = c.p) group by vec_id, label, p)"""
        if r < rounds:
            out += f""",
        mean{r} as (select p, e, list(m order by i) x from (select n.p, n.e, u.i, cast(floor(sum(u.c)::hugeint / count(*)) as bigint) m from near{r} n join (select vec_id, p, unnest(x) c, unnest(range(len(x))) i from parts) u on n.vec_id = u.vec_id and n.p = u.p group by n.p, n.e, u.i) group by p, e),
        cb{r + 1} as (select c.p, c.e, coalesce(m.x, c.x) x from cb{r} c left join mean{r} m on c.p = m.p and c.e = m.e)"""
    return out + f""",
        own as (select vec_id, label, string_agg(printf('%02x', e), '' order by p) code, cast(sum(d) as bigint) error from near{rounds} group by vec_id, label)
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error,
               (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from cb{rounds}) codebooks_sha256
        from own"""


ORACLES = {
    "op2_warc": f"""
        with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) sha from pages),
        q as (select *, min(page_id) over (partition by html) f from p)
        select page_id, cast(octet_length(encode(html)) as bigint) payload_bytes, {_QUINTETS} payload_digest,
               case when f < page_id then 'revisit' else 'response' end record_type, case when f < page_id then f end refers_to
        from q
    """,
    "op8_embedding_dedup": """
        with recursive v as (select vec_id, cast(embedding as double[]) x from embeddings),
        good as (select * from v where x is not null and len(list_filter(x, lambda e: e is null or not isfinite(e))) = 0 and len(list_filter(x, lambda e: e <> 0)) > 0),
        links as (select a.vec_id a, b.vec_id b from good a join good b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.95),
        reach as (select vec_id a, vec_id b from v union select r.a, l.b from reach r join links l on r.b = l.a)
        select v.vec_id, (select count(*) from links l where l.a = v.vec_id) n_links, c.component_id, v.vec_id = c.component_id kept
        from v join (select a, min(b) component_id from reach group by a) c on c.a = v.vec_id
    """,
    "op9_decontamination": f"""
        with d as (select doc_id, {_WORDS} w from documents),
        b as (select cast(item_id as varchar) item, {_WORDS} w from benchmark),
        bw as (select item, least(10, len(w)) n, unnest(range(1, len(w) - least(10, len(w)) + 2)) i, w from b where len(w) > 0),
        wins as (select distinct item, n, array_to_string(w[i:i+n-1], ' ') win from bw),
        sizes as (select distinct n from wins),
        dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) i, w from d, sizes where len(w) >= n),
        hits as (select x.doc_id, x.i, x.n, y.item from (select doc_id, n, i, array_to_string(w[i:i+n-1], ' ') win from dw) x join wins y on x.n = y.n and x.win = y.win),
        cover as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from hits)) group by doc_id),
        named as (select doc_id, count(distinct item) n_items, string_agg(item, ',' order by item) s from (select distinct doc_id, item from hits) group by doc_id)
        select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(c.n_hit, 0) as bigint) n_hit, cast(coalesce(n.n_items, 0) as bigint) n_items,
               sha256(coalesce(n.s, '')) items_sha256, coalesce(c.n_hit, 0) > 0 contaminated
        from d left join cover c using (doc_id) left join named n using (doc_id)
    """,
    "op12_vector_codes": _code_rounds(),
}
