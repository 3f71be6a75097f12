"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, licenses, mixing, pieces, quality, rules, runs, simhash, tokens, toxicity, vectors, whitening
from .common import SPACE, UPPER, documents, write_table


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _held_out(column: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves that remainder."""
    return F.crc32(F.col(column).cast("string")) % parts == rest


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, ~_held_out("doc_id", 4, 2))
    out = toxicity.score_toxicity(docs.select("doc_id", "text", "lang"), model)
    return out.select("doc_id", _held_out("doc_id", 4, 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"), "toxic")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, ~_held_out("doc_id", 5, 0))
    out = write_table(quality.score_quality(docs.select("doc_id", "text"), model).drop("text"), "ranked")
    cut = quality.rank_quantile(out, quality.DROP_SHARE)
    best = F.lit(True) if cut is None else F.col("rank") >= cut
    return out.select("doc_id", _held_out("doc_id", 5, 0).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"), "rank", best.alias("best"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_tokens(tokens.write_tokens(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir)).withColumnRenamed("digest", "text_sha256")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(documents(spark, sf_dir))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one of ten documents, chosen by crc32 of the id, the words from place a on repeat with period p."""
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), f"{SPACE}+"), "")
    rows = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"), words.alias("w"))
    rows = rows.withColumns({"n": F.size("w").cast("long"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    again = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), again), " ")
    return rows.select("doc_id", F.when(F.col("a").isNull(), F.col("text")).otherwise(planted).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(with_planted_runs(documents(spark, sf_dir))).withColumn("best", runs.longest(F.col("runs")))
    best = F.col("best")
    milli = F.floor(best["length"] * 1000 / best["period"])
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), milli.alias("exponent_milli"), F.sha2(runs.listing(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    base, kept = rules.BASE.keeps(), rules.CURRENT.keeps()
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & kept).alias("kept"), "failed")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_quality": op4_quality,
    "op5_token_output": op5_token_output,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_licenses": op8_licenses,
    "op9_mixing": op9_mixing,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_whitening": op11_whitening,
    "op12_runs": op12_runs,
    "op13_quality_rules": op13_quality_rules,
}



def _mixing_sql() -> str:
    """Targets, expected copies and the Pareto order by windows over whole sources."""
    phases = ""
    for k in range(mixing.PHASES):
        before = f"l{k}" if k else "(select source, need as gap, 0::double as edge from plan)"
        phases += f"""
        f{k} as (select r.source, r.rank, x.gap, x.edge, sum(r.size) over (partition by r.source order by r.rank) as upto from ranked r
            join {before} x on r.source is not distinct from x.source where r.rank >= x.edge and r.size <= x.gap),
        l{k + 1} as (select x.source, x.edge as from_rank, x.gap as room, coalesce(min(f.rank) filter (f.upto > f.gap), 2) as edge, x.gap - coalesce(max(f.upto) filter (f.upto <= f.gap), 0) as gap
            from {before} x left join f{k} f on f.source is not distinct from x.source group by x.source, x.edge, x.gap),"""
    taken = " or ".join(f"(r.rank >= l{k}.from_rank and r.rank < l{k}.edge and r.size <= l{k}.room)" for k in range(1, mixing.PHASES + 1))
    joins = " ".join(f"join l{k} on r.source is not distinct from l{k}.source" for k in range(1, mixing.PHASES + 1))
    last = f"l{mixing.PHASES}"
    return rf"""
        with n as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
        s as (select source, sum(size)::bigint as words, row_number() over (order by source nulls last) as place from n group by source),
        w as (select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end::double as weight from s),
        x as (select *, row_number() over (order by 3 * words::double / weight) as k, sum(3 * words::double) over (order by 3 * words::double / weight rows unbounded preceding) as used,
            sum(weight) over (order by 3 * words::double / weight rows unbounded preceding) as weights, (select sum(words)::double from w) as total, (select sum(weight) from w) as every, 3 * words::double / weight as ratio from w),
        rates as (select 0 as k, total / every as rate from x union all select k, case when every > weights then (total - used) / (every - weights) end from x),
        rate as (select rate from rates r where not exists (select 1 from x where x.k = r.k + 1 and x.ratio <= r.rate) order by k limit 1),
        t as (select source, words, case when words = 0 then 0 else least(3 * words::double, weight * (select rate from rate)) end as target from w),
        classes as (select source, length(bin(size)) as bits, sum(size)::double as words from n group by all),
        folds as (select c.source, c.bits, (t.target - 3 * coalesce(sum(c.words) over larger, 0)) / sum(c.words * (1 + c.bits::double / 16)) over smaller as c, t.target < 3 * t.words as below
            from classes c join t on c.source is not distinct from t.source
            window larger as (partition by c.source order by c.bits desc rows between unbounded preceding and 1 preceding), smaller as (partition by c.source order by c.bits rows unbounded preceding)),
        c as (select source, max_by(c, bits) filter (c * (1 + bits::double / 16) <= 3 and below) as c from folds group by source),
        d as (select n.*, t.words, t.target, case when c.c is null then 3 else least(3, c.c * (1 + length(bin(n.size))::double / 16)) end as e
            from n join t on n.source is not distinct from t.source join c on n.source is not distinct from c.source),
        plan as (select source, any_value(target) - sum(floor(e) * size) as need from d group by source),
        odds as (select doc_id, source, size, e - floor(e) as p, (('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':42'), 1, 13))::bigint::double + 0.5::double) / 4503599627370496::double as u from d where size > 0 and e > floor(e)),
        ranked as (select doc_id, source, size, o / (1 + o) as rank from (select *, (u / (1 - u)) / (p / (1 - p)) as o from odds)),{phases}
        ends as (select r.source, r.rank, r.size, abs({last}.gap - sum(r.size)) as off from ranked r join {last} on r.source is not distinct from {last}.source where r.rank >= {last}.edge
            group by r.source, r.rank, r.size, {last}.gap having abs({last}.gap - sum(r.size)) < {last}.gap),
        closing as (select source, min({{'off': off, 'rank': rank, 'size': size}}) as pick from ends group by source),
        taken as (select distinct r.doc_id, r.source, r.size from ranked r {joins} left join closing z on r.source is not distinct from z.source
            where {taken} or (r.rank = z.pick.rank and r.size = z.pick.size))
        select d.doc_id, d.source, d.size, d.words as source_size, d.target, (floor(d.e) + (k.size is not null)::int)::int as copies, ((floor(d.e) + (k.size is not null)::int) * d.size)::bigint as taken
        from d left join taken k on k.doc_id is not distinct from d.doc_id and k.source is not distinct from d.source and k.size = d.size"""


def _rules_sql() -> str:
    """The ledger: windows of three words are numbered, and the places that repeated ones cover are counted."""
    failed = " + ".join(f"case when {r.fails} then {1 << k} else 0 end" for k, r in enumerate(rules.RULES))
    return rf"""
        with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
        w as (select *, regexp_extract_all(text, '{rules.NOT_SPACE}+') as w, [x for x in string_split(text, chr(10)) if regexp_matches(x, '{rules.NOT_SPACE}')] as lines from t),
        g as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as s from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
        c as (select distinct r, unnest([i, i + 1, i + 2]) as place from (select *, count(*) over (partition by r, s) as k from g) where k > 1),
        n as (select r, count(*) as n_repeat_words from c group by r),
        m as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '{rules.SYMBOLS}')) as n_symbols, len(lines) as n_lines,
            len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, len([x for x in w if regexp_matches(x, '\p{{L}}')]) as n_letter_words,
            len(regexp_extract_all(text, '\p{{Lu}}')) as n_capitals, len(regexp_extract_all(text, '[0-9]')) as n_digits,
            len([x for x in lines if regexp_matches(x, '^{SPACE}*[-*•]')]) as n_bullets, len([x for x in lines if regexp_matches(x, '(\.\.\.|…){SPACE}*$')]) as n_ellipses from w left join n using (r)),
        f as (select *, ({failed})::bigint as failed from m)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {rules.BASE.mask} <> 0 as base_failed, failed & {rules.BASE.mask | rules.CURRENT.mask} = 0 as kept, failed from f"""


ORACLE_SQL = {
    "op13_quality_rules": _rules_sql(),
    "op7_embedding_dedup": """
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0
            and len([x for x in embedding if x is null or isnan(x) or isinf(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
        l as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id
            where list_cosine_similarity(a.e, b.e) >= 0.93),
        r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
        n as (select x, count(*) as n from l group by x), c as (select x, least(x, min(y)) as c from r group by x)
        select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(c, vec_id) as component_id, coalesce(c, vec_id) = vec_id as kept
        from embeddings e left join n on n.x = e.vec_id left join c on c.x = e.vec_id""",
    "op9_mixing": _mixing_sql(),
    "op6_exact_dedup": f"""
        with n as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') as t from documents),
        g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(n.t) as text_sha256 from n join g using (t)""",
}
