"""Fill-in-the-middle: a text is cut twice between units and its parts change places.

``regexp_count`` counts the units of a text; two hashed cuts fall between them.
One match of a pattern made for the row, with possessive counted groups
``unit{a}`` and ``unit{b-a}``, captures prefix, middle and suffix, and the
replacement puts them in their new order. Possessive groups are matched in a loop
without backtracking, so neither time nor stack grows beyond the text's length.
Only built-in expressions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its break, or what is left without one.
LINES = r"(?:[^\n]*+\n|[^\n]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, unsigned."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, salt: str = "7",
    rate: int = 100, spm_rate: int = 50,
) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    ``unit`` is a non-capturing group that matches one unit and never nothing.
    ``rate`` of 100 texts are rearranged, ``spm_rate`` of 100 of these with the
    suffix first (spm), the others with the prefix first (psm).

    Defined cases: a null or empty text, and one that holds a mark, stays as it
    is (plain; null becomes empty); a null id is hashed as an empty one; equal ids
    are cut by the same draws; a text of one unit may have empty parts; other
    columns are ignored; an empty table gives no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), digest.alias("_digest")
    ).withColumn("n", F.regexp_count("_text", F.lit(unit)).cast("long"))
    h1, h2, h3, h4 = (_draw(F.col("_digest"), k) for k in range(4))
    marked = F.col("_text").contains(PREFIX) | F.col("_text").contains(SUFFIX) | F.col("_text").contains(MIDDLE)
    x, y = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select(
        "doc_id", "n", "_text", F.least(x, y).alias("_a"), F.greatest(x, y).alias("_b"),
        F.when((F.col("_text") == "") | marked | (h3 % 100 >= rate), "plain")
        .when(h4 % 100 < spm_rate, "spm").otherwise("psm").alias("form"),
    )
    count = lambda n: F.concat(F.lit(f"({unit}{{"), n, F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), count(F.col("_a")), count(F.col("_b") - F.col("_a")), F.lit(r"([\s\S]*)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    out = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", pattern, order))
    rows = rows.select("doc_id", "n", "form", out.alias("output"))
    at = lambda mark: F.instr("output", mark)
    head = F.when(F.col("form") == "psm", at(SUFFIX) - 1).when(F.col("form") == "spm", at(MIDDLE) - at(PREFIX))
    return rows.select(
        "doc_id", "n", "form", (head - 3).cast("long").alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.length("output") - at(MIDDLE) - 2).cast("long").alias("middle_chars"),
        "output",
    )


def restore(form: Column, output: Column) -> Column:
    """The text before :func:`transform`, from form and output alone."""
    first = lambda a, b: rf"\A{a}([\s\S]*?){b}([\s\S]*?){MIDDLE}([\s\S]*)\z"
    return (
        F.when(form == "psm", F.regexp_replace(output, first(PREFIX, SUFFIX), "$1$3$2"))
        .when(form == "spm", F.regexp_replace(output, first(SUFFIX, PREFIX), "$2$3$1"))
        .otherwise(output)
    )
