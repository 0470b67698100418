"""Run comparison tables with their SQL twins."""

from pyspark.sql import functions as F

from shelfwise.operators import runs as U
from shelfwise.plans import standins as D
from shelfwise.plans.registry import query

# runs made of event groups: one row per (variant, model, labelled percent)
_RUNS = """runs as (select event_type as model, user_id % 5 * 20 + 20 as labeled_percentage, event_id % 2 as variant,
  round(avg(value), 6) as accuracy, round(stddev_pop(value), 6) as std_accuracy, count(*) as pseudo_label_count, max(value) as f1 from events group by all)"""


def run_rows(spark, d):
    e = D.table(spark, d, "events")
    return e.groupBy(
        F.col("event_type").alias("model"), (F.col("user_id") % 5 * 20 + 20).alias("labeled_percentage"), (F.col("event_id") % 2).alias("variant")
    ).agg(
        F.round(F.avg("value"), 6).alias("accuracy"),
        F.round(F.stddev_pop("value"), 6).alias("std_accuracy"),
        F.count("*").alias("pseudo_label_count"),
        F.max("value").alias("f1"),
    )


@query(
    "m17_compare_runs",
    f"""with {_RUNS}, t as (select case variant when 0 then 'SMOTE' else 'graph' end as balancing, model, labeled_percentage::int as labeled_percentage,
          accuracy, case variant when 0 then f1 end as f1 from runs)
        select *, row_number() over (partition by labeled_percentage order by accuracy desc, balancing, model) = 1 as best from t""",
)
def m17(spark, d):
    runs = run_rows(spark, d).withColumn("labeled_fraction", F.col("labeled_percentage") / 100)
    a = runs.filter("variant = 0").select("model", "labeled_fraction", "accuracy", "f1")
    b = runs.filter("variant = 1").select("model", "labeled_fraction", "accuracy")
    return U.compare_runs({"SMOTE": a, "graph": b})


_PCT = (20, 40, 60, 80, 100)


@query(
    "m18_bootstrap_table",
    f"""with {_RUNS} select model, {', '.join(f"max(case when labeled_percentage = {p} then printf('%.2f ± %.2f', accuracy, std_accuracy) end) as " + '"' + str(p) + '"' for p in _PCT)}
        from runs where variant = 0 group by model""",
)
def m18(spark, d):
    runs = run_rows(spark, d).filter("variant = 0").withColumnRenamed("accuracy", "mean_accuracy")
    return U.bootstrap_table(runs, "accuracy", _PCT, 2)


@query(
    "m19_pseudo_label_table",
    f"""with {_RUNS} select variant::varchar as balancing, model, {', '.join(f'sum(pseudo_label_count) filter (labeled_percentage = {p})::bigint as "{p}"' for p in _PCT)}
        from runs group by all""",
)
def m19(spark, d):
    runs = run_rows(spark, d).withColumn("balancing", F.col("variant").cast("string"))
    return U.pseudo_label_table(runs, _PCT)
