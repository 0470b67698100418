"""Projections, filters, joins and reshaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLASS_LETTERS = {0: "A", 1: "B", 2: "C", 3: "D", 4: "E"}
UNKNOWN = "-1"


# -- projections -----------------------------------------------------------
def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def select_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols)


def with_provenance(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def select_by_position(df: DataFrame, start: int | None = None, stop: int | None = None) -> DataFrame:
    return df.select(df.columns[start:stop])


def pretty_names(df: DataFrame) -> DataFrame:
    """Underscores in column names become spaces."""
    return df.toDF(*[c.replace("_", " ") for c in df.columns])


def pretty_values(c) -> Column:
    """Underscores in a value (a feature name) become spaces."""
    return F.replace(F.col(c) if isinstance(c, str) else c, F.lit("_"), F.lit(" "))


def feature_subset(
    df: DataFrame, cats: Sequence[str], nums: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    return df.select(*keys, *cats, *nums)


# -- filters ---------------------------------------------------------------
def filter_not_in(df: DataFrame, col: str, values) -> DataFrame:
    """Drop rows whose value is listed; null values stay.

    ``values`` is a short literal list or a one-column DataFrame; a DataFrame
    becomes an anti join whose physical form Spark picks from its size.
    """
    if isinstance(values, DataFrame):
        other = values.toDF("__excluded")
        return df.join(other, F.col(col) == F.col("__excluded"), "left_anti")
    return df.filter(~F.coalesce(F.col(col).isin(*values), F.lit(False)))


def filter_in(df: DataFrame, col: str, values: DataFrame) -> DataFrame:
    """Keep rows whose value occurs in a one-column table."""
    other = values.toDF("__kept")
    return df.join(other, F.col(col) == F.col("__kept"), "left_semi")


def filter_not_matching(df: DataFrame, col: str, regex: str = "TEST|WORK") -> DataFrame:
    """Drop rows whose text matches, ignoring case; null text is dropped too."""
    return df.filter(~F.col(col).rlike(f"(?i){regex}"))


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def split_labeled(
    df: DataFrame, label: str = "category", sentinel: str = UNKNOWN
) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled); both are filters over the same input."""
    unknown = F.col(label).eqNullSafe(F.lit(sentinel))
    return df.filter(~unknown), df.filter(unknown)


def label_disagreements(
    df: DataFrame, manual: str = "category", auto: str = "category_bertopic", auto_known: bool = False
) -> DataFrame:
    """Rows with a manual label that differs from the automatic one."""
    out = df.filter(
        ~F.col(manual).eqNullSafe(F.lit(UNKNOWN)) & ~F.col(manual).eqNullSafe(F.col(auto))
    )
    return out.filter(~F.col(auto).eqNullSafe(F.lit(UNKNOWN))) if auto_known else out


def reconcile_labels(
    df: DataFrame, manual: str = "category", auto: str = "category_bertopic", out: str = "category"
) -> DataFrame:
    """Manual label where known, else the automatic one."""
    known = ~F.col(manual).eqNullSafe(F.lit(UNKNOWN))
    return df.withColumn(out, F.when(known, F.col(manual)).otherwise(F.col(auto)))


TEXT_RULES = (("service kit", "A"), ("tool", "E"))


def override_by_text(
    df: DataFrame, text: str, label: str, rules: Sequence[tuple[str, str]] = TEXT_RULES
) -> DataFrame:
    """Set the label where the text contains a phrase; later rules win."""
    out = F.col(label)
    low = F.lower(F.col(text))
    for phrase, value in rules:
        out = F.when(F.coalesce(low.contains(phrase), F.lit(False)), F.lit(value)).otherwise(out)
    return df.withColumn(label, out)


def fill_missing(df: DataFrame, value, cols: Sequence[str]) -> DataFrame:
    return df.fillna(value, subset=list(cols))


def having(df: DataFrame, minimums: Mapping[str, float]) -> DataFrame:
    for col, low in minimums.items():
        df = df.filter(F.col(col) >= low)
    return df


def decode_class(c, letters: Mapping[int, str] = CLASS_LETTERS) -> Column:
    """Class index to letter; an unknown index passes through as text."""
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(x) for kv in letters.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c.cast("int")), c.cast("string"))


# -- joins -----------------------------------------------------------------
def attach_labels(
    lines: DataFrame, mapping: DataFrame, key: str = "product_id", label: str = "category"
) -> DataFrame:
    """Left join of a label table; rows without a match get '-1'.

    A key listed twice in the mapping multiplies its rows. No broadcast is
    forced: Spark broadcasts the mapping when it is measured to be small and
    otherwise sort-merges with runtime skew splitting.
    """
    out = lines.join(mapping.select(key, label), key, "left")
    return out.withColumn(label, F.coalesce(F.col(label), F.lit(UNKNOWN)))


def attach_topic_category(docs: DataFrame, topics: DataFrame, topic: str = "topic") -> DataFrame:
    return docs.join(topics.select(topic, "category"), topic, "left")


def attach_by_position(a: DataFrame, b: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Left join on the row id that both tables carry from their source."""
    return a.join(b, row_id, "left")


def pair_runs(a: DataFrame, b: DataFrame, key: str = "topic_set_id") -> DataFrame:
    return a.join(b, key)


def map_back_predictions(data: DataFrame, preds: DataFrame, row_id: str = "row_id") -> DataFrame:
    return data.join(preds, row_id)


def param_grid(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Every combination of the values held in array columns of one row."""
    out = df.select(*cols)
    for c in cols:
        out = out.withColumn(c, F.explode(c))
    return out


def importance_matrix(importances: DataFrame, runs: Sequence[str] | None = None) -> DataFrame:
    """(feature, run, importance) -> one column per run, missing = 0."""
    pivot = importances.groupBy("feature").pivot("run", runs)
    return pivot.agg(F.first("importance")).fillna(0.0)


def train_test_table(
    train: DataFrame, test: DataFrame, metric: str, keys: Sequence[str] = ("model", "labeled_percentage")
) -> DataFrame:
    """Mean train and test score per key with their gap."""
    tr = train.groupBy(*keys).agg(F.avg(metric).alias("train_score"))
    te = test.groupBy(*keys).agg(F.avg(metric).alias("test_score"))
    return tr.join(te, list(keys)).withColumn("gap", F.col("train_score") - F.col("test_score"))


# -- set operations and reshaping -------------------------------------------
def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def union_relaxed(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stack_labeled_unlabeled(labeled: DataFrame, unlabeled: DataFrame, label: str = "label") -> DataFrame:
    """One table with ``is_labeled``; unlabelled rows carry a null label."""
    kind = labeled.schema[label].dataType
    a = labeled.withColumn("is_labeled", F.lit(True))
    b = unlabeled.withColumn(label, F.lit(None).cast(kind)).withColumn("is_labeled", F.lit(False))
    return a.unionByName(b)


def unpivot(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "variable", value: str = "value"
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot(df: DataFrame, index: Sequence[str], columns: str, value: str, names=None) -> DataFrame:
    """Long to wide; a repeated (index, column) cell is an error."""
    one = F.when(F.count("*") <= 1, F.first(value)).otherwise(
        F.raise_error(F.lit("pivot: duplicate cell")).cast(df.schema[value].dataType)
    )
    cells = df.groupBy(*index, columns).agg(one.alias(value))
    return cells.groupBy(*index).pivot(columns, names).agg(F.first(value))


def pivot_table(df: DataFrame, index: Sequence[str], columns: str, values: Sequence[str], names=None) -> DataFrame:
    """Long to wide with the mean of every value column."""
    aggs = [F.avg(v).alias(v) for v in values]
    return df.groupBy(*index).pivot(columns, names).agg(*aggs)


def flatten_sections(df: DataFrame, sections: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Lift the fields of struct columns to the top level."""
    return df.select(*keep, *[f"{s}.*" for s in sections])


def flatten_list(df: DataFrame, col: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per element of an array of structs, fields lifted."""
    return df.select(*keep, F.inline(col))


SUMMARY_ROWS = ("accuracy", "macro avg", "weighted avg")


def flatten_report(df: DataFrame, report: str = "report", keep: Sequence[str] = ()) -> DataFrame:
    """class -> struct map to rows; the summary rows are skipped."""
    rows = df.select(*keep, F.explode(report).alias("class", "__m"))
    return rows.filter(~F.col("class").isin(*SUMMARY_ROWS)).select(*keep, "class", "__m.*")


def params_table(df: DataFrame, params: str, index: Sequence[str], names=None) -> DataFrame:
    """A map of parameters to one column per parameter."""
    rows = df.select(*index, F.explode(params).alias("param", "value"))
    return rows.groupBy(*index).pivot("param", names).agg(F.first("value"))


def matrix_to_long(df: DataFrame, matrix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Nested array to (true_class, predicted_class, n)."""
    rows = df.select(*keep, F.posexplode(matrix).alias("true_class", "__row"))
    return rows.select(*keep, "true_class", F.posexplode("__row").alias("predicted_class", "n"))
