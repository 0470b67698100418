"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import (
    byte_bpe,
    collocations,
    embedding_dedup,
    fill_in_middle,
    lm_scoring,
    ngram_join,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    source_mixing,
    url_filter,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _bin_sql(v: str) -> str:
    return f"""(case when {v} < 32 then {v} else
        (length(bin({v})) - 6) * 32 + ({v} >> (length(bin({v})) - 6)::int) end)"""


def _floor_sql(b: str) -> str:
    return f"(case when {b} < 32 then {b} else ({b} % 32 + 32) * (1::bigint << ({b} // 32 - 1)::int) end)"


def _fence_sql() -> str:
    cuts = []
    for m, both, least in quality_rules.METRICS:
        w = f"greatest(q3 - q1, {least}) * {quality_rules.FENCE}"
        mine = f"case when metric = '{m}' then"
        cuts.append(f"max({mine} q3 + {w} end) hi_{m}")
        if both:
            cuts.append(f"max({mine} q1 - {w} end) lo_{m}")
    return ", ".join(cuts)


def _inside_sql() -> str:
    own = [f"{m} <= hi_{m}" for m, _, _ in quality_rules.METRICS]
    return " and ".join(own + [f"{m} >= lo_{m}" for m, both, _ in quality_rules.METRICS if both])


QUALITY_SQL = f"""
with d as (select row_number() over () rid, doc_id, lang, source, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
g as (select rid, unnest(range(1, len(ws) - 1)) i, ws from w where len(ws) >= 3),
h as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) c from g),
r as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from h where c > 1) group by rid),
c as (select w.rid, doc_id, lang, source, len(ws)::bigint n_words,
      length(array_to_string(ws, ''))::bigint word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, len(ls) n_lines,
      (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words
      from w left join r on w.rid = r.rid),
m as (select *, word_chars * 100 // greatest(n_words, 1) mean_length,
      n_symbols * 1000 // greatest(word_chars, 1) symbol_permille,
      n_dup_lines * 1000 // greatest(n_lines, 1) dup_line_permille,
      n_repeat_words * 1000 // greatest(n_words, 1) repeat_permille,
      n_words < 50 or n_repeat_words * 100 > n_words * 50 base_failed from c),
u as (unpivot (select lang, source, mean_length, symbol_permille, dup_line_permille, repeat_permille from m
      where not base_failed) on mean_length, symbol_permille, dup_line_permille, repeat_permille
      into name metric value v),
b as (select lang, source, metric, {_bin_sql("v")} bin, count(*) n from u group by all),
p as (select lang, source, metric, bin, n from b),
l as (select lang, metric, bin, sum(n) n from b group by all),
a as (select metric, bin, sum(n) n from b group by all),
pc as (select *, sum(n) over (partition by lang, source, metric) total,
       sum(n) over (partition by lang, source, metric order by bin) upto from p),
lc as (select *, sum(n) over (partition by lang, metric) total,
       sum(n) over (partition by lang, metric order by bin) upto from l),
ac as (select *, sum(n) over (partition by metric) total, sum(n) over (partition by metric order by bin) upto from a),
pq as (select lang, source, metric, max(total) total, min(case when upto * 4 >= total then bin end) b1,
       min(case when upto * 4 >= total * 3 then bin end) b3 from pc group by all),
lq as (select lang, metric, max(total) total, min(case when upto * 4 >= total then bin end) b1,
       min(case when upto * 4 >= total * 3 then bin end) b3 from lc group by all),
aq as (select metric, min(case when upto * 4 >= total then bin end) b1,
       min(case when upto * 4 >= total * 3 then bin end) b3 from ac group by all),
q as (select pq.lang, pq.source, pq.metric,
      case when pq.total >= {quality_rules.MIN_DOCS} then pq.b1 when lq.total >= {quality_rules.MIN_DOCS} then lq.b1 else aq.b1 end k1,
      case when pq.total >= {quality_rules.MIN_DOCS} then pq.b3 when lq.total >= {quality_rules.MIN_DOCS} then lq.b3 else aq.b3 end k3
      from pq join lq on pq.lang is not distinct from lq.lang and pq.metric = lq.metric join aq on pq.metric = aq.metric),
f as (select lang fl, source fs, {_fence_sql()} from
      (select lang, source, metric, {_floor_sql("k1")} q1, {_floor_sql("k3")} q3 from q) group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce({_inside_sql()}, false) kept
from m left join f on lang is not distinct from fl and source is not distinct from fs
"""


@query("op1_quality_rules", QUALITY_SQL)
def op1(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.judge(table(spark, d, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op2_quality_classifier")
def op2(spark: SparkSession, d: str) -> DataFrame:
    rated = quality_classifier.classify(table(spark, d, "documents"), table(spark, d, "labels"))
    return rated.select("doc_id", "held_out", "score", "predicted")


@query("op3_lm_scoring")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return lm_scoring.score(table(spark, d, "documents"))


@query("op4_byte_bpe")
def op4(spark: SparkSession, d: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, d, "documents"), decoded=True)
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query("op5_source_mixing")
def op5(spark: SparkSession, d: str) -> DataFrame:
    draws = F.col("draws")
    return source_mixing.mix_plan(table(spark, d, "documents")).select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.size("draws") * F.col("size")).alias("taken"),
        F.transform(draws, lambda x: x["shard"]).alias("shards"),
        F.transform(draws, lambda x: source_mixing.spot(F.col("h"), x)).alias("places"),
    )


def _spans(kinds) -> object:
    some = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


@query("op6_secret_scan")
def op6(spark: SparkSession, d: str) -> DataFrame:
    found = secret_scan.scan(table(spark, d, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secret_scan.KINDS[:3]],
        F.sha2(_spans(secret_scan.KINDS[:3]), 256).alias("base_sha256"),
        _spans(secret_scan.KINDS).alias("spans"),
    )


@query("op7_warc")
def op7(spark: SparkSession, d: str) -> DataFrame:
    archives = warc.write_archives(table(spark, d, "pages"))
    return warc.read_archives(archives, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op8_embedding_dedup")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, d, "embeddings"))


@query("op9_ngram_join")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, d, "documents"))


URL_SQL = """
with u as (select page_id, url, regexp_extract(url, '(?s)^.*?://(.*)$', 1) rest, coalesce(contains(url, '://'), false) ok from pages),
s as (select page_id, case when ok then translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end host,
      case when ok then regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) else '' end path from u),
r as (select *, case
        when (host = 'example.net' or suffix(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or suffix(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or suffix(host, '.net')) and starts_with(path, '/') then 'net/' end rule from s)
select page_id, host, path, rule, case
        when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
        when regexp_matches('.' || host || path,
          '(?s)^(.*/wp-admin/.*|.*/cgi-bin/.*|.*/login|.*/logout|.*\\.exe|.*\\.zip|.*/ads/..*)$') then 'block'
        else 'allow' end verdict
from r
"""


@query("op10_url_filter", URL_SQL)
def op10(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.classify(table(spark, d, "pages")).select("page_id", "host", "path", "rule", "verdict")


PHRASE_SQL = """
with d as (select row_number() over () rid, coalesce(lang, 'und') lang, translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
s as (select lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') ws from s),
i as (select lang, ws, unnest(range(1, len(ws) + 1)) i from w),
g as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') phrase from i, (select unnest([1, 2, 3, 4]) k) where i + k - 1 <= len(ws)),
f as (select lang, k, phrase, count(*) f from g group by all),
t as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') ws from f where k > 1 and f >= 30),
h as (select lang, a, ws, k, unnest(range(2, k)) j from c),
o as (select lang, a, ws, j, unnest(range(1, k - j + 2)) i from h),
m as (select lang, array_to_string(ws[i:i + j - 1], ' ') phrase, max(a) over_a from o group by all),
kept as (select c.* from c left join m using (lang, phrase) where over_a is null or 100 * over_a::hugeint < 80 * a::hugeint),
x as (select *, unnest(range(1, k)) cut from kept),
y as (select x.lang, x.phrase, x.a, x.cut, l.f l, r.f r, (2000000 * x.a::hugeint // (l.f + r.f))::bigint score from x
      join f l on l.lang = x.lang and l.phrase = array_to_string(x.ws[1:x.cut], ' ')
      join f r on r.lang = x.lang and r.phrase = array_to_string(x.ws[x.cut + 1:], ' ')),
z as (select * from y qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) rank, phrase, a, l, r, n, score
from z join t using (lang) qualify rank <= 2000
"""


@query("op11_phrase_mining", PHRASE_SQL)
def op11(spark: SparkSession, d: str) -> DataFrame:
    return collocations.mine(table(spark, d, "documents"))


FIM_SQL = """
with d as (select doc_id, coalesce(text, '') t, sha256('7:' || coalesce(doc_id::varchar, '')) h,
           regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') u from documents),
h as (select *, len(u)::bigint n, ('0x' || h[1:8])::bigint h1, ('0x' || h[9:16])::bigint h2,
      ('0x' || h[17:24])::bigint h3, ('0x' || h[25:32])::bigint h4 from d),
f as (select *, least(h1 % (n + 1), h2 % (n + 1)) a, greatest(h1 % (n + 1), h2 % (n + 1)) b,
      case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end form from h),
p as (select *, array_to_string(u[1:a], '') pre, array_to_string(u[a + 1:b], '') mid, array_to_string(u[b + 1:], '') suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre) end prefix_chars,
       case when form <> 'plain' then length(mid) end middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
              else '<S>' || suf || '<P>' || pre || '<M>' || mid end) output_sha256,
       sha256(t) restored_sha256
from p
"""


@query("op12_fill_in_middle", FIM_SQL)
def op12(spark: SparkSession, d: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, d, "documents"))
    back = fill_in_middle.restore(F.col("form"), F.col("output"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


@query("op13_best_fit_packing")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), ids=False)
