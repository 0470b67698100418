"""From raw order lines to one row per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import scalars as S
from shelfwise.operators import relational as R

# Item classes left out of the product table.
EXCLUDED_ITEM_CLASSES = (
    54210, 54220, 54230, 54240, 54250, 54260, 54270, 54280, 54290, 54300, 54310, 54320, 54330,
    54340, 54350, 54360, 54370, 54380, 54390, 54400, 54410, 54420, 54430, 54440, 54450, 55030,
    55040, 55050, 55060, 55070, 55080, 55090, 55100, 55210, 55250, 55270, 55290, 55300, 55400,
    55710, 56110, 56130, 56370, 56380, 56390, 56500, 58000, 58010, 58040, 58050, 58060, 58070,
    58080, 58090, 58100, 59120, 59130, 59140, 59150, 59160, 59170, 59180, 59190, 59200, 59300,
    59310, 59320, 59330, 59340, 59350, 59360, 59370, 59380, 59390, 59400, 59410, 59420, 59430,
    59440, 59450, 71010,
)
METADATA_COLUMNS = ("OBPONR", "MBBCOS", "MMITGR", "MMITCL", "OKCUNM", "MBLEAT")
COLUMN_NAMES = {
    "OBRGDT": "date", "OBORQT": "quantity", "NET_LINE": "price", "MMNEWE": "weight",
    "DESCRIPT": "description", "OBCUOR": "order_id", "OACUNO": "customer_id",
    "OKCSCD": "customer_country", "OBITNO": "product_id",
}
PRICE_SCALE = 10_000  # prices are summed as whole ten-thousandths


def mapping_keys(mapping: DataFrame) -> DataFrame:
    """'id description' texts to bare ids."""
    return mapping.select(S.first_token("OBITNO").alias("OBITNO"), "category")


def label_lines(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Strip the line key and attach the manual category."""
    stripped = lines.withColumn("OBITNO", S.strip_ws("OBITNO"))
    return R.attach_labels(stripped, mapping_keys(mapping), "OBITNO")


def clean_lines(lines: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """Typed, filtered, de-duplicated order lines under their clear names."""
    item_class = F.col("MMITCL").try_cast("int")
    kept = lines.filter(~F.coalesce(item_class.isin(*EXCLUDED_ITEM_CLASSES), F.lit(False)))
    kept = R.filter_not_matching(kept, "OBITNO").drop(*METADATA_COLUMNS)
    typed = kept.withColumns(
        {
            "NET_LINE": S.parse_decimal_comma("NET_LINE"),
            "MMNEWE": S.parse_decimal_comma("MMNEWE"),
            "OBRGDT": S.parse_yyyymmdd("OBRGDT"),
            "OBORQT": S.to_number_or_null("OBORQT"),
            "DESCRIPT": S.to_text("DESCRIPT"),
            "OBCUOR": S.strip_ws("OBCUOR"),
            "OACUNO": S.strip_ws("OACUNO"),
            "OKCSCD": S.strip_ws("OKCSCD"),
        }
    )
    typed = typed.filter(F.col("OBORQT").isNotNull()).withColumn("OBORQT", S.trunc_int("OBORQT"))
    if drop_duplicates:
        typed = typed.dropDuplicates()
    return typed.withColumnsRenamed(COLUMN_NAMES)


def with_date_features(lines: DataFrame) -> DataFrame:
    return lines.withColumns(S.date_parts("date")).drop("date")


# output column -> line column, for the values reduced to their mode
MODES = {
    "description": "description",
    "month_mode": "month",
    "quarter_mode": "quarter",
    "year_mode": "year",
    "day_week_mode": "day_of_week",
    "unit_weight": "weight",
    "customer_country_mode": "customer_country",
    "category": "category",
}


def product_profile(lines: DataFrame, min_quantity: int = 5, min_price: float = 50.0) -> DataFrame:
    """One row per product: modes, sums, distinct counts and mean unit price.

    Every line is turned into one (product, feature, value) row per reduced
    column and counted; map tasks pre-aggregate, so the shuffle carries counts,
    not lines, and a product holding a third of all lines is spread over the
    finer key. The per-product step then picks the largest count per feature.
    Prices are summed as whole ten-thousandths, which makes the sum exact and
    independent of order.
    """
    modes = list(MODES.items())
    kinds = dict(lines.dtypes)
    columns = [c for _, c in modes] + ["customer_id"]
    is_text = {c: kinds[c] == "string" for c in columns}

    def cell(i: int, c: str) -> Column:
        num = F.lit(None).cast("double") if is_text[c] else F.col(c).cast("double")
        txt = F.col(c) if is_text[c] else F.lit(None).cast("string")
        return F.struct(F.lit(i).alias("f"), num.alias("num"), txt.alias("txt"))

    # the first reduced column also carries the sums
    units = F.round(F.col("price") * PRICE_SCALE).cast("bigint")
    tall = (
        lines.filter(F.col("product_id").isNotNull())
        .select(
            "product_id",
            F.col("quantity").alias("q"),
            units.alias("p"),
            F.explode(F.array(*[cell(i, c) for i, c in enumerate(columns)])).alias("cell"),
        )
        .select("product_id", "cell.*", "q", "p")
    )
    counts = tall.groupBy("product_id", "f", "num", "txt").agg(
        F.count("*").alias("n"), F.sum("q").alias("q"), F.sum("p").alias("p")
    )
    filled = F.col("num").isNotNull() | F.col("txt").isNotNull()
    ranked = F.struct((-F.col("n")).alias("n"), "num", "txt")

    def best(i: int) -> Column:
        return F.min(F.when((F.col("f") == i) & filled, ranked))

    def distinct(c: str) -> Column:
        return F.count_if((F.col("f") == columns.index(c)) & filled)

    folded = counts.groupBy("product_id").agg(
        F.coalesce(F.sum(F.when(F.col("f") == 0, F.col("q"))), F.lit(0)).alias("quantity_sum"),
        F.coalesce(F.sum(F.when(F.col("f") == 0, F.col("p"))), F.lit(0)).alias("__units"),
        *[best(i).alias(f"__m{i}") for i in range(len(modes))],
        distinct("customer_country").alias("customer_country_count"),
        distinct("customer_id").alias("customer_id_count"),
    )
    picked = [
        F.col(f"__m{i}.{'txt' if is_text[c] else 'num'}").cast(kinds[c]).alias(out)
        for i, (out, c) in enumerate(modes)
    ]
    out = folded.select(
        "product_id",
        *picked,
        "quantity_sum",
        (F.col("__units") / F.lit(float(PRICE_SCALE))).alias("price_sum"),
        "customer_country_count",
        "customer_id_count",
        "__units",
    )
    kept = out.filter((F.col("quantity_sum") >= min_quantity) & (F.col("price_sum") >= min_price))
    exact = F.col("__units").cast("decimal(20,0)") / F.col("quantity_sum").cast("decimal(20,0)")
    mean = F.when(
        F.col("quantity_sum") != 0, F.bround(exact, 0).cast("double") / F.lit(float(PRICE_SCALE))
    )
    return kept.withColumn("unit_price_mean", mean).drop("__units")


def with_clean_text(products: DataFrame) -> DataFrame:
    """Keep the raw description and clean the working one."""
    return products.withColumn("description_original", F.col("description")).withColumn(
        "description", S.clean_text("description")
    )


def product_table(lines: DataFrame, mapping: DataFrame) -> DataFrame:
    """Raw lines and a label mapping to the finished product table."""
    cleaned = with_date_features(clean_lines(label_lines(lines, mapping)))
    return with_clean_text(product_profile(cleaned))
