"""The queries over these operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineferry.llm import fingerprints, infill, lines, minhash, packing, passages, periodic, personal, quality, subwords, toxicity, urls, vectors
from lineferry.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_passages")
def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that a document shares with a smaller one: where it is in both, in words."""
    found = passages.repeated(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("source").alias("source_doc_id"), "start", "words", "source_start", "source_words", "similarity")


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(read(spark, sf_dir, "documents"))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: lines before, lines removed, and a digest of what is left."""
    left = lines.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("op4_packing")
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_vectors")
def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


SITE_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
BLOCKED_WORDS = ["adult", "bets", "casino", "poker", "porn", "spam", "xxx"]
_SITES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in SITE_RULES)


@query("op6_url_filters", f"""
with u as (
  select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) as h,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
k as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
r(v, rh, rp) as (values {_SITES}),
fit as (
  select page_id, max_by(rh || rp, length(rh || rp)) as rule, max_by(v, length(rh || rp)) as v
  from k join r on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by page_id)
select k.page_id, host, path, rule, case when v is not null then v
         when regexp_matches(host || path, '(^|[^A-Za-z0-9])({"|".join(BLOCKED_WORDS)})([^A-Za-z0-9]|$)') then 'block' else 'allow' end as verdict
from k left join fit using (page_id)
""")
def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site rules decide; where none fits, pages with a blocked word in host or path are blocked."""
    rules = [urls.site_rule(*r) for r in SITE_RULES] + [urls.word_rule("block", w) for w in BLOCKED_WORDS]
    judged = urls.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    rule = F.when(~F.col("rule").isin(BLOCKED_WORDS), F.col("rule"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), "verdict")


@query("op10_subwords")
def op10_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids and back: how many, their checksum, and whether the text came back."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = docs.withColumn("ids", subwords.encode("text", model)).withColumn("back", subwords.decode("ids", model))
    return coded.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.size("ids").cast("bigint").alias("n_ids"),
        F.xxhash64("ids").alias("ids_hash"), F.sha2("back", 256).alias("decoded_sha256"), (F.col("back") == F.col("text")).alias("same"),
    )


@query("op7_minhash")
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), minhash.Near(size=2))


#: Scores from here on predict label 1.
THRESHOLD = 0.3


def remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def scored(docs: DataFrame, held_out) -> DataFrame:
    predicted = (F.col("score") >= THRESHOLD).cast("int")
    return docs.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, learn=remainder(5) != 0)
    return scored(quality.score(docs, model), remainder(5) == 0)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels, learn=remainder(4) != 2)
    return scored(toxicity.score(docs, model), remainder(4) == 2)


@query("op13_infill", """
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || doc_id::varchar) as g from documents),
h as (select *, ('0x' || substr(g, 1, 8))::bigint as h1, ('0x' || substr(g, 9, 8))::bigint as h2, ('0x' || substr(g, 17, 8))::bigint as h3,
             ('0x' || substr(g, 25, 8))::bigint as h4, string_split(t, chr(10)) as parts,
             length(t) - length(replace(t, chr(10), '')) + (t <> '' and not ends_with(t, chr(10)))::bigint as n from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
                  when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
e as (select *, case when a = n then length(t) else list_sum(list_transform(parts[:a], lambda x: length(x) + 1)) end as i,
             case when b = n then length(t) else list_sum(list_transform(parts[:b], lambda x: length(x) + 1)) end as j from c),
s as (select *, t[:coalesce(i, 0)] as p, t[coalesce(i, 0) + 1:coalesce(j, 0)] as m, t[coalesce(j, 0) + 1:] as x from e)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256 from s
""")
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its middle moved to the end, and rebuilt from that."""
    done = infill.fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = F.sha2(infill.restore(F.col("output"), F.col("form")), 256)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored.alias("restored_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, drawn by a hash of their id, with the words from some place on repeating."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    # Out of one-element generators, or each word would split the text again.
    drawn = docs.select("doc_id", "text", F.inline(F.array(F.struct(words.alias("words"), F.floor(h / 10).alias("g")))))
    n = F.size("words")
    a, folds = F.col("g") % n, 3 + F.col("g") % 8
    drawn = drawn.select("doc_id", "text", "words", F.inline(F.array(F.struct(F.when(n > 0, a).cast("int").alias("a"), F.when(n > 0, folds).alias("folds")))))
    period = (1 + F.floor((F.size("words") - F.col("a")) / F.col("folds"))).cast("int")
    drawn = drawn.select("doc_id", "text", "words", "a", F.inline(F.array(F.struct(period.alias("p")))))
    at = lambda i: F.col("a") + (i - F.col("a")) % F.col("p")
    said = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", at(i)))), " ")
    return drawn.select("doc_id", F.when(F.col("a").isNotNull(), said).otherwise(F.col("text")).alias("text"))


@query("op11_periodic")
def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its runs of repeated words, the strongest of them, and what is left without the repeats."""
    found = periodic.periodic_runs(with_repeats(read(spark, sf_dir, "documents")))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_personal")
def op12_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: strict occurrences of each kind and their digest, and all spans, those found by context too."""
    found = personal.find_personal(read(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*map(F.lit, personal.KINDS))

    def shown(spans):
        line = lambda x: F.concat(F.get(kinds, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
        return F.array_join(F.transform(spans, line), ",")

    counts = [F.expr(f"bigint(size(filter(base, x -> x.kind = {i})))").alias(f"n_{k}") for i, k in enumerate(personal.KINDS)]
    spans = F.array_sort(F.concat("base", "added"))
    return found.select("doc_id", *counts, F.sha2(shown(F.col("base")), 256).alias("base_sha256"), shown(spans).alias("spans"))
