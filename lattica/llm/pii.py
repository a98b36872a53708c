"""Personal data by weak supervision, in built-in functions only.

Base spans are the matches of four fixed patterns that pass their checks. Candidates are these matches, the matches
that fail, and those of wider patterns, among them a fifth kind: secrets such as tokens and keys. Four labelers vote on
every candidate, none of which knows whether it is a base span: its written form, a gazetteer, context words, and
a checksum. Expectation-maximisation estimates each labeler's reliability per kind from the counts of the 16 possible
votes; its posteriors are the soft labels on which a naive-Bayes span classifier over hashed context and
shape features is trained. Candidates the classifier accepts are added; base spans always stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let, table

KINDS = ("email", "ip", "card", "phone", "secret")
#: Base patterns. A possessive run that starts where the last match ended, or after a character outside the
#: run, matches just what the plain pattern matches, without trying every suffix of a long run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns for candidates: spelled-out addresses, long and defanged network addresses, digit groups with other
#: separators, local numbers and numbers with a trunk prefix, runs as long as keys.
WIDE = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}|[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3})(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./-]{1,2}[0-9]{4}){2}[\x20./-]{1,2}[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![+0-9)] ?)(?:(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9]{1,2}(?:[ .-][0-9]{2,4}){2,4})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=.@-])(?=[A-Za-z_+/-]{0,127}[0-9])(?=[0-9_+/-]{0,127}[A-Za-z])[A-Za-z0-9_+/-]{20,128}+(?![A-Za-z0-9_+/@-])",
}
#: What the written form labeler takes for well written.
FORM = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:@|[\[(]at[\])]) ?(?:[A-Za-z0-9-]{1,63}(?:\.| ?[\[(]dot[\])] ?))+[A-Za-z]{2,24}$",
    "ip": r"^(?:(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|\[\.\])){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])|[0-9A-Fa-f:]{7,39})$",
    "card": r"^(?:[0-9]{14,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{4,5})$",
    "phone": r"^(?:\+[1-9][0-9]{0,2}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|00[1-9][0-9 .-]+)$",
    "secret": r"^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[A-Za-z0-9_-]{35})$",
}
#: Fixed values, the gazetteers: generic and country top-level domains; beginnings of addresses that name no host in public; issuers'
#: first digits; country calling codes; lengths of digests and keys.
TLDS = (
    "com org net edu gov mil int info biz name pro io ai app dev cloud online site shop tech me tv cc eu us ca mx br ar cl co pe uk ie fr de es pt it nl be lu ch at dk se no fi is pl cz sk hu ro bg gr hr si rs ua ru by "
    "lt lv ee tr il sa ae eg za ng ke ma in pk bd lk cn hk tw jp kr sg my th vn id ph au nz"
).split()
NOT_PUBLIC = ("0.", "10.", "127.", "169.254.", "192.168.", "192.0.0.", "198.18.", "198.19.", "255.", "fe80:", "fc", "fd", "::")
ISSUERS = ("34", "37", "36", "38", "4", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "6011", "65", "644", "645", "646", "647", "648", "649", "3528", "353", "354", "355", "356", "357", "358", "62", "5018", "5020", "5038", "6304")
CALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 218 220 221 233 234 249 251 254 255 256 260 263 351 352 353 354 355 356 "
    "357 358 359 370 371 372 373 374 375 380 381 385 386 387 389 420 421 502 503 504 505 506 507 591 593 595 598 852 853 855 880 886 961 962 963 964 965 966 967 968 971 972 973 974 977 992 993 994 995 996 998"
).split()
KEY_LENGTHS = (20, 24, 32, 36, 39, 40, 44, 48, 56, 64, 86, 88, 96, 128)
#: Context words that a labeler looks for near a candidate, in English, French, German and Spanish.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|correo|courriel|contacto|kontakt|schreib\w*|adresse)\b",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|address|server|login|from|serveur|adresse|servidor|direcci[oó]n)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|amex|mastercard|tarjeta|carte|karte|kreditkarte)\b",
    "phone": r"(?i)\b(?:phone|call|tel|fax|mobile|cell|whatsapp|telefon|tel[eé]fono|t[eé]l[eé]phone|handy|m[oó]vil|appelez)\b",
    "secret": r"(?i)(?:token|passw(?:or)?d|passwort|secret|api.?key|access.?key|bearer|credential|contrase[nñ]a|mot de passe|schl[uü]ssel)",
}
EM_ROUNDS, BUCKETS, WINDOW = 25, 4096, 40
_SPAN = "array<struct<kind:int,start:bigint,end:bigint,hit:string>>"


def _matches(text: Column, pattern: str, kind: int, can: Column) -> Column:
    """(kind, start, end, hit) of all leftmost matches: offsets are sums of the gaps' and matches' lengths. can: what a text with a match has."""

    def placed(gaps, hits):
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))
        step = lambda a, x: let(a["at"] + F.length(x["gap"]), lambda s: F.struct(
            (s + F.length(x["hit"])).cast("bigint").alias("at"),
            F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), s.cast("bigint").alias("start"), (s + F.length(x["hit"])).cast("bigint").alias("end"), x["hit"].alias("hit")))).alias("out"),
        ))
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, zero, step, lambda a: a["out"])

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda gaps: placed(gaps, hits))).otherwise(F.array().cast(_SPAN)))
    return F.when(can, found).otherwise(F.array().cast(_SPAN))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def total(d):
        at = F.sequence(F.lit(1), F.length(d))
        worth = lambda i: let(F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
        return F.aggregate(at, F.lit(0), lambda a, i: a + worth(i))
    return (F.length(digits) > 0) & (total(digits) % 10 == 0)


def _passes(span: Column) -> Column:
    """The fixed check of the span's kind."""
    hit, kind = span["hit"], span["kind"]
    ip = F.forall(F.split(hit, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 4) & (F.coalesce(q.try_cast("int"), F.lit(0)) <= 255)))
    card = let(_digits(hit), lambda d: F.length(d).between(14, 19) & F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    phone = F.length(_digits(hit)).between(10, 15)
    return F.when(kind == 0, F.lit(True)).when(kind == 1, ip).when(kind == 2, card).otherwise(phone)


def _by_kind(kind: Column, of: dict[str, Column]) -> Column:
    out = F.lit(False)
    for i, name in enumerate(KINDS):
        out = F.when(kind == i, of[name]).otherwise(out)
    return F.coalesce(out, F.lit(False)).cast("int")


def _votes(c: Column, around: Column) -> Column:
    """The four labelers' votes on a candidate; each looks at its own evidence only."""
    hit, kind = c["hit"], c["kind"]
    begins = lambda text, words: F.exists(F.array(*map(F.lit, words)), lambda w: F.startswith(text, w))
    code = F.regexp_replace(F.regexp_replace(hit, r"^(?:\+|00)", ""), "[^0-9]", "")
    known = {
        "email": F.array_contains(F.array(*map(F.lit, TLDS)), F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1))),
        "ip": ~begins(F.lower(hit), NOT_PUBLIC),
        "card": begins(_digits(hit), ISSUERS),
        "phone": F.when(F.rlike(hit, F.lit(r"^(?:\+|00)")), begins(code, CALLING)).otherwise(F.rlike(hit, F.lit(r"^\(?[2-9]"))),
        "secret": F.array_contains(F.array(*map(F.lit, KEY_LENGTHS)), F.length(hit)),
    }
    letters = lambda text: F.size(F.array_distinct(F.split(text, "")))
    sums = {
        "email": ~F.rlike(hit, F.lit(r"\.\.|[.-]@|@-|-\.|\.-|-$")),
        # a host's first number, and not one number over and over
        "ip": F.rlike(hit, F.lit("^(?:0*(?:[1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])[.\\[]|[0-9A-Fa-f]{1,4}:)")) & (F.size(F.array_distinct(F.split(hit, r"[.:\[\]]+"))) > 1),
        "card": let(_digits(hit), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False))),
        "phone": F.length(_digits(hit)).between(10, 15),
        "secret": letters(F.lower(hit)) >= 10,
    }
    form = {name: F.rlike(hit, F.lit(FORM[name])) for name in KINDS}
    cues = {name: F.rlike(around, F.lit(CUES[name])) for name in KINDS}
    return F.array(_by_kind(kind, form), _by_kind(kind, known), _by_kind(kind, cues), _by_kind(kind, sums))


def _inspected(docs: DataFrame, text: str, at: str) -> DataFrame:
    """docs with, named from ``at`` on, the text, its base spans (base), and all candidates with votes and features: others (cands) and base ones (seen)."""
    body, raw, more, base = (F.col(f"{at}{x}") for x in ("text", "raw", "more", "base"))
    docs = docs.withColumn(f"{at}text", F.coalesce(F.col(text), F.lit("")))
    digits, has = F.rlike(body, F.lit("[0-9]")), lambda x: F.contains(body, F.lit(x))
    can = {"email": has("@"), "ip": digits, "card": digits, "phone": has("+")}
    wider = {"email": has("(at") | has("[at"), "ip": (has(":") | has("[.]")) & digits, "card": digits, "phone": digits, "secret": digits}
    every = [_matches(body, BASE[name], i, can[name]) for i, name in enumerate(KINDS) if name in BASE]
    other = [_matches(body, WIDE[name], i, wider[name]) for i, name in enumerate(KINDS)]
    docs = docs.withColumn(f"{at}raw", F.concat(*every)).withColumn(f"{at}more", F.concat(*other))
    docs = docs.withColumn(f"{at}base", F.filter(raw, _passes))
    apart = lambda c, base: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    short = F.filter(raw, lambda s: ~_passes(s) & (F.length(s["hit"]) >= 9))
    docs = docs.withColumn(f"{at}others", F.filter(F.array_union(short, more), lambda c: apart(c, base)))

    def voted(c):
        left = F.substring(body, F.greatest(c["start"] - WINDOW, F.lit(0)).cast("int") + 1, F.least(c["start"], F.lit(WINDOW)).cast("int"))
        right = F.substring(body, (c["end"] + 1).cast("int"), F.lit(WINDOW))
        shape = F.when(c["kind"] == 4, F.concat_ws(".", F.length(c["hit"]).cast("string"), F.rlike(c["hit"], F.lit("^[0-9A-Fa-f]+$")).cast("string"))).otherwise(F.regexp_replace(F.regexp_replace(c["hit"], "[0-9]", "9"), "[A-Za-z]+", "a"))
        return let(F.struct(left.alias("l"), right.alias("r")), lambda x: let(
            _votes(c, F.concat(x["l"], F.lit(" "), x["r"])),
            lambda v: F.struct(
                c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), v.alias("v"),
                F.transform(
                    F.array(
                        F.concat(F.lit("p:"), F.lower(F.regexp_extract(x["l"], r"(\S+)\s*$", 1))),
                        F.concat(F.lit("n:"), F.lower(F.regexp_extract(x["r"], r"^\s*(\S+)", 1))),
                        F.concat(F.lit("s:"), shape),
                        F.concat(F.lit("v:"), F.array_join(v.cast("array<string>"), "")),
                    ),
                    lambda f: (c["kind"] * BUCKETS + F.pmod(F.xxhash64(f), F.lit(BUCKETS))).cast("int"),
                ).alias("f"),
            ),
        ))

    return docs.withColumn(f"{at}cands", F.transform(f"{at}others", voted)).withColumn(f"{at}seen", F.transform(base, voted))


_POSTERIOR = """
    transform(pats, p -> transform(array(struct(
        log(m.pi) + aggregate(sequence(0, 3), 0D, (s, j) -> s + if(p.v[j] = 1, log(m.a[j]), log(1 - m.a[j]))) as one,
        log(1 - m.pi) + aggregate(sequence(0, 3), 0D, (s, j) -> s + if(p.v[j] = 1, log(m.b[j]), log(1 - m.b[j]))) as nil)),
        z -> 1 / (1 + exp(z.nil - z.one)))[0])"""
#: One round on (m, pats): posteriors q, then the reliabilities that they imply, smoothed.
_ROUND = f"""
    transform(array({_POSTERIOR}), q ->
      transform(array(struct(
          aggregate(zip_with(pats, q, (p, w) -> p.n * w), 0D, (s, x) -> s + x) as n1,
          aggregate(zip_with(pats, q, (p, w) -> p.n * (1 - w)), 0D, (s, x) -> s + x) as n0)), t ->
        named_struct(
          'pi', (t.n1 + 1) / (t.n1 + t.n0 + 2),
          'a', transform(sequence(0, 3), j -> (aggregate(zip_with(pats, q, (p, w) -> p.n * w * p.v[j]), 0D, (s, x) -> s + x) + 4) / (t.n1 + 5)),
          'b', transform(sequence(0, 3), j -> (aggregate(zip_with(pats, q, (p, w) -> p.n * (1 - w) * p.v[j]), 0D, (s, x) -> s + x) + 1) / (t.n0 + 5))))[0])[0]"""
#: Labelers start as right four times in five, which fixes which class is which.
_EM = f"""
    aggregate(sequence(1, {EM_ROUNDS}),
      named_struct('pi', 0.5D, 'a', array(0.8D, 0.8D, 0.8D, 0.8D), 'b', array(0.2D, 0.2D, 0.2D, 0.2D)),
      (m, i) -> {_ROUND})"""


def reliabilities(cands: DataFrame) -> DataFrame:
    """(kind, pats, m): the votes seen with their counts, prior and reliabilities after EM. cands has (kind, v, n); at most 5 rows of 16 patterns come out."""
    pats = cands.groupBy("kind", "v").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("pats"))
    return pats.select("kind", "pats", F.expr(_EM).alias("m"))


def _model(cands: DataFrame) -> DataFrame:
    """One row: (prior, weight) of the classifier; prior has an entry for each kind, weight BUCKETS for each. cands has (kind, v, f, n)."""
    last = len(KINDS) - 1
    em = reliabilities(cands)
    soft = em.select("kind", F.explode(F.expr(f"zip_with(pats, {_POSTERIOR}, (p, q) -> struct(p.v as v, q as q))")).alias("x")).select(F.col("kind").alias("k"), "x.v", "x.q")
    known = cands.alias("c").join(F.broadcast(soft.alias("s")), F.expr("c.kind = s.k and c.v = s.v")).select("kind", "f", "n", "q")  # 80 rows at most
    per = known.select("kind", F.explode("f").alias("f"), "n", "q").groupBy("kind", "f").agg(F.sum(F.expr("n * q")).alias("c1"), F.sum(F.expr("n * (1 - q)")).alias("c0"))
    one = per.agg(F.map_from_entries(F.collect_list(F.struct("f", F.struct("c1", "c0")))).alias("w"), F.collect_list(F.struct("kind", "c1", "c0")).alias("t"))  # BUCKETS entries for each kind at most
    sums = F.expr(f"transform(sequence(0, {last}), k -> aggregate(filter(t, x -> x.kind = k), named_struct('c1', 0D, 'c0', 0D), (a, x) -> named_struct('c1', a.c1 + x.c1, 'c0', a.c0 + x.c0)))")
    one = one.select("w", sums.alias("n"))
    # the four features of a candidate all count, so the class totals are a quarter of the sums
    prior = F.expr("transform(n, x -> log((x.c1 / 4 + 1) / (x.c0 / 4 + 1)))")
    return one.select(F.struct(
        prior.alias("prior"),
        F.expr(f"transform(sequence(0, {len(KINDS) * BUCKETS - 1}), i -> coalesce(transform(array(w[i]), x -> log(((x.c1 + 0.5) / (n[i div {BUCKETS}].c1 / 4 + 1)) / ((x.c0 + 0.5) / (n[i div {BUCKETS}].c0 / 4 + 1))))[0], 0D))").alias("weight"),
    ).alias("model"))


def votes(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """(kind, v, f, n): votes and features of all candidates with their number, written: the text is read once for the whole model."""
    seen = _inspected(docs.select(F.col(text).alias("t")), "t", "_")
    cands = seen.select(F.explode(F.concat("_cands", "_seen")).alias("c")).select("c.kind", "c.v", "c.f")
    return table(cands.groupBy("kind", "v", "f").agg(F.count("*").alias("n")), "votes")


def find_pii(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with ``base`` and ``spans``: arrays of (start, kind, end), code points, end exclusive, sorted by start, then kind.

    A null text is an empty one and has no span; every row gives one row, repeated rows included; a text may
    be of any length. An added span never overlaps a base span. Without candidates nothing is added. Columns
    of docs stay, whatever their names, but for ``base`` and ``spans``, which the result's replace.
    """
    docs = docs.drop("base", "spans")
    at = free(docs)
    cands, base, model = (F.col(f"{at}{x}") for x in ("cands", "base", "model"))
    made = _inspected(docs, text, at).withColumn(f"{at}model", F.when(F.size(cands) > 0, _model(votes(docs, text=text)).scalar()))
    score = lambda c: F.aggregate(c["f"], F.get(model["prior"], c["kind"]), lambda s, f: s + F.get(model["weight"], f))
    kept = F.filter(cands, lambda c: F.coalesce(score(c) >= 0, F.lit(False)))
    bare = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    return made.select(*(F.col(f"`{c}`") for c in docs.columns), F.array_sort(F.transform(base, bare)).alias("base"), F.array_sort(F.array_union(F.transform(base, bare), F.transform(kept, bare))).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by <KIND>; of overlapping spans the first one names the whole run.

    A text without spans stays as it is, null included; all columns stay, ``base`` and ``spans`` of the caller too.
    """
    at = free(docs)
    body = F.coalesce(F.col(f"{at}t"), F.lit(""))
    made = find_pii(docs.select(F.struct("*").alias(f"{at}whole"), F.col(text).alias(f"{at}t")), text=f"{at}t")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        s["end"].alias("at"),
        F.concat(a["out"], F.array(F.substring(body, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.get(names, s["kind"]))).alias("out"),
    )).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))
    clean = F.aggregate("spans", zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(body, (a["at"] + 1).cast("int"), F.length(body))))
    made = made.select(f"{at}whole", F.when(F.size("spans") > 0, clean).otherwise(F.col(f"{at}t")).alias(f"{at}clean"))
    return made.select(*(F.col(f"{at}clean" if c == text else f"{at}whole.`{c}`").alias(c) for c in docs.columns))
