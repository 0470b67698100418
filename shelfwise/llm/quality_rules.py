"""Quality rules with fences taken from mergeable quantile sketches.

Fixed cutoffs are replaced by fences per language and source. The sketch is a
log-linear histogram: a non-negative integer falls into a bin that is exact
below 32 and at most 1/32 wide above, so two sketches merge by adding counts and
a quantile is off by that relative error at most. Sketches of (language,
source) merge into those of a language and of the corpus, which serve groups
with too few documents. The fences are joined back to the documents.

Everything is DataFrame expressions; no Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import materialize

#: Fixed values of the contract: white space between words, symbols.
GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Metric, whether its lower fence counts too, and the least spread assumed
#: (so that a metric that is constant in clean text gets a fence with room).
METRICS = (
    ("mean_length", True, 20),
    ("symbol_permille", False, 5),
    ("dup_line_permille", False, 100),
    ("repeat_permille", False, 60),
)
FENCE = 6
MIN_DOCS = 200
OWN = tuple(m for m, _, _ in METRICS)


def text_counts(df: DataFrame, text: str, prefix: str = "_q_") -> DataFrame:
    """Adds word and line counts of ``text`` (null: empty) as ``prefix`` columns.

    Repeated windows are found by the hash of three neighbouring words; only a
    text in which two hashes are equal is sorted.
    """
    p = prefix
    t, trimmed, words, grams, ranked, lines = (p + x for x in ("t", "trim", "words", "grams", "ranked", "lines"))
    df = df.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn(trimmed, F.btrim(F.col(t), F.lit(WHITE)))
    empty = F.array().cast("array<string>")
    df = df.withColumn(words, F.when(F.col(trimmed) == "", empty).otherwise(F.split(trimmed, GAP)))
    w = F.col(words)
    n = F.size(w)
    df = df.withColumn(
        grams,
        F.slice(
            F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
            1,
            F.greatest(n - 2, F.lit(0)),
        ),
    )
    g = F.col(grams)
    df = df.withColumn(
        ranked,
        F.when(
            F.size(F.array_distinct(g)) < F.size(g),
            F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    s = F.col(ranked)
    again = F.filter(
        F.transform(
            s,
            lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"]),
        ),
        lambda x: x.isNotNull(),
    )
    covered = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x, x + 1, x + 2))))
    df = df.withColumn(
        lines, F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    )
    df = df.withColumns(
        {
            p + "n_words": n.cast("long"),
            p + "word_chars": F.length(F.array_join(w, "")).cast("long"),
            p + "n_symbols": F.regexp_count(F.col(t), F.lit(SYMBOLS)).cast("long"),
            p + "n_lines": F.size(lines).cast("long"),
            p + "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            p + "n_repeat_words": F.when(s.isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long"),
        }
    )
    return df.drop(t, trimmed, words, grams, ranked, lines)


def sketch_bin(v: Column) -> Column:
    """Bin of a non-negative integer: exact below 32, then 32 bins per octave."""
    e = F.length(F.bin(v)) - 6
    return F.when(v < 32, v).otherwise(e * 32 + F.floor(v / F.pow(F.lit(2.0), e)).cast("long"))


def bin_floor(b: Column) -> Column:
    """Smallest integer in a bin."""
    return F.when(b < 32, b).otherwise(
        ((b % 32 + 32) * F.pow(F.lit(2.0), F.floor(b / 32) - 1)).cast("long")
    )


def fences(stats: DataFrame, min_docs: int = MIN_DOCS, fence: int = FENCE) -> DataFrame:
    """One row per (lang, source) of ``stats`` with low and high fences.

    ``stats`` holds lang, source, the metric columns and base_failed; documents
    that failed the base rules do not count. Quartiles come from the sketch of the pair if it holds
    ``min_docs`` documents, else of the language, else of the corpus.
    """
    entries = F.array(*[F.struct(F.lit(m).alias("metric"), sketch_bin(F.col(m)).alias("bin")) for m in OWN])
    bins = stats.select("lang", "source", "base_failed", F.explode(entries).alias("b"))
    # counted, not filtered: a filter would be pushed below the text counts and make them again
    n = F.sum(F.when(F.col("base_failed"), F.lit(0)).otherwise(F.lit(1))).alias("n")
    pair = bins.groupBy("lang", "source", "b.metric", "b.bin").agg(n).where("n > 0")
    pair = materialize(pair, "quality-sketch")
    by_lang = pair.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("metric", "bin").agg(F.sum("n").alias("n"))

    def quartiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
        group = Window.partitionBy(*keys, "metric")
        ranked = sketch.select(
            *keys,
            "metric",
            "bin",
            F.sum("n").over(group).alias("total"),
            F.sum("n").over(group.orderBy("bin")).alias("upto"),
        )
        at = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("bin")))
        return ranked.groupBy(*keys, "metric").agg(
            F.struct(
                F.first("total").alias("total"), bin_floor(at(1)).alias("q1"), bin_floor(at(3)).alias("q3")
            ).alias(tag)
        )

    groups = pair.select("lang", "source", "metric").distinct()
    pairs = quartiles(pair, ["lang", "source"], "own")
    langs = quartiles(by_lang, ["lang"], "of_lang")
    whole = quartiles(by_all, [], "of_all")
    a, b, c, d = groups.alias("a"), pairs.alias("b"), langs.alias("c"), whole.alias("d")
    same = lambda x, y, *ks: reduce(
        lambda p, q: p & q, [F.col(f"{x}.{k}").eqNullSafe(F.col(f"{y}.{k}")) for k in ks]
    )
    joined = (
        a.join(b, same("a", "b", "lang", "source", "metric"))
        .join(c, same("a", "c", "lang", "metric"))
        .join(d, F.col("a.metric") == F.col("d.metric"))
    )
    q = F.when(F.col("own.total") >= min_docs, F.col("own")).when(
        F.col("of_lang.total") >= min_docs, F.col("of_lang")
    ).otherwise(F.col("of_all"))
    rows = joined.select(F.col("a.lang"), F.col("a.source"), F.col("a.metric"), q.alias("q"))
    cuts = []
    for m, both, least in METRICS:
        width = F.greatest(F.col("q.q3") - F.col("q.q1"), F.lit(least)) * fence
        mine = F.col("metric") == m
        cuts.append(F.max(F.when(mine, F.col("q.q3") + width)).alias(f"hi_{m}"))
        if both:
            cuts.append(F.max(F.when(mine, F.col("q.q1") - width)).alias(f"lo_{m}"))
    return rows.groupBy("lang", "source").agg(*cuts)


def _metrics(p: str) -> dict[str, Column]:
    n, ch = F.col(p + "n_words"), F.col(p + "word_chars")
    rate = lambda a, b: F.floor(a * 1000 / F.greatest(b, F.lit(1))).cast("long")
    return {
        "mean_length": F.floor(ch * 100 / F.greatest(n, F.lit(1))).cast("long"),
        "symbol_permille": rate(F.col(p + "n_symbols"), ch),
        "dup_line_permille": rate(F.col(p + "n_dup_lines"), F.col(p + "n_lines")),
        "repeat_permille": rate(F.col(p + "n_repeat_words"), n),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
PREFIX = "_q_"


def _measured(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the counts (prefixed), the metrics and base_failed."""
    n, rep = F.col(PREFIX + "n_words"), F.col(PREFIX + "n_repeat_words")
    failed = (n < MIN_WORDS) | (rep * 100 > n * MAX_REPEAT_PERCENT)
    return text_counts(docs, text, PREFIX).withColumns(_metrics(PREFIX) | {"base_failed": failed})


def _with_verdict(base: DataFrame, cuts: DataFrame) -> DataFrame:
    """``base`` joined with the fences of its language and source; adds kept."""
    cuts = cuts.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = base.join(
        cuts, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    inside = reduce(
        lambda a, b: a & b,
        [F.col(m) <= F.col(f"hi_{m}") for m in OWN] + [F.col(m) >= F.col(f"lo_{m}") for m, low, _ in METRICS if low],
    )
    # one expression over both sides: the counts below the join are not made again for a pushed-down filter
    return joined.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(inside, F.lit(False))))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", min_docs: int = MIN_DOCS, fence: int = FENCE,
) -> DataFrame:
    """One row per input row: id, counts, metrics, base_failed, kept.

    Defined cases: a null text counts as empty and, like any text with fewer
    than 50 words, fails the base rules; null languages and sources form groups
    of their own; a null id is carried along; repeated rows are judged alike,
    each on its own; an empty table gives no rows; other columns of ``docs`` are
    ignored, whatever their names. The text is read once: the counts are written
    to the shared folder, the sketches and the join use only them.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.col(text_col).alias("_text"),
    )
    base = _measured(base, "_text").select(
        "doc_id", "lang", "source", *[F.col(PREFIX + c).alias(c) for c in COUNTS], *OWN, "base_failed"
    )
    base = materialize(base, "quality-counts")
    cuts = materialize(fences(base, min_docs, fence), "quality-fences")
    return _with_verdict(base, cuts).select("doc_id", "lang", "source", *COUNTS, *OWN, "base_failed", "kept")


def keep(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    min_docs: int = MIN_DOCS, fence: int = FENCE,
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    The counts are made twice, once for the sketches and once beside the rows, so
    that texts are neither written nor shuffled; each row is judged by itself,
    whatever its id. The defined cases are those of :func:`judge`.
    """
    base = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
        F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("_text"),
    )
    stats = _measured(base.drop("row"), "_text").select("lang", "source", *OWN, "base_failed")
    cuts = materialize(fences(stats, min_docs, fence), "quality-fences")
    return _with_verdict(_measured(base, "_text"), cuts).where("kept").select("row.*")
