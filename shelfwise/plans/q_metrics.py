"""Metrics with their SQL twins over hash-made predictions."""

from pyspark.sql import functions as F

from shelfwise.functions.hashing import hash_uniform
from shelfwise.functions.vectors import argmax
from shelfwise.operators import metrics as M
from shelfwise.operators.sampling import POISSON
from shelfwise.plans import standins as D
from shelfwise.plans.registry import query, sql_hash_int, sql_uniform

CLASSES = range(5)
_TOK = "concat(vec_id, '-', {c})"
_U = ", ".join(f"{sql_uniform(_TOK.format(c=c), 9)} + case when label % 5 = {c} then 0.4::double else 0.0::double end as u{c}" for c in CLASSES)
_SUM = " + ".join(f"u{c}" for c in CLASSES)
_PRED = f"""u as (select vec_id, (label % 5)::int as y, {_U} from embeddings),
  pr as (select vec_id, y, [{', '.join(f'u{c} / ({_SUM})' for c in CLASSES)}] as p from u),
  pred as (select vec_id, y, (list_position(p, list_max(p)) - 1)::int as yhat, p from pr)"""


def predictions(spark, d):
    """Probabilities from hashes of (row, class), leaning to the true class."""
    e = D.table(spark, d, "embeddings").select("vec_id", (F.col("label") % 5).cast("int").alias("y"))
    u = [
        hash_uniform(F.concat_ws("-", F.col("vec_id").cast("string"), F.lit(c)), 9)
        + F.when(F.col("y") == c, F.lit(0.4)).otherwise(F.lit(0.0))
        for c in CLASSES
    ]
    rows = e.withColumn("u", F.array(*u))
    total = F.col("u")[0] + F.col("u")[1] + F.col("u")[2] + F.col("u")[3] + F.col("u")[4]
    rows = rows.withColumn("p", F.transform("u", lambda x: x / total)).drop("u")
    return rows.select("vec_id", "y", argmax("p").alias("yhat"), "p")


_CM = f"with {_PRED}, cm as (select y, yhat, count(*) as n from pred group by all)"
_REPORT = f"""{_CM}, cl as (select unnest([0, 1, 2, 3, 4]) as c),
  pc as (select c, coalesce((select sum(n) from cm where y = c), 0)::double as s, coalesce((select sum(n) from cm where yhat = c), 0)::double as q,
         coalesce((select sum(n) from cm where y = c and yhat = c), 0)::double as tp from cl),
  rp as (select c, s, q, tp, coalesce(tp / nullif(q, 0), 0) as pre, coalesce(tp / nullif(s, 0), 0) as rec from pc where s + q > 0),
  rf as (select *, coalesce(2 * pre * rec / nullif(pre + rec, 0), 0) as f from rp)"""


def _round(df, cols, n=9):
    return df.withColumns({c: F.round(c, n) for c in cols})


@query(
    "m1_confusion_matrix",
    f"{_CM} select a.range::int as y, b.range::int as yhat, coalesce(n, 0) as n from range(5) a join range(5) b on true left join cm on y = a.range and yhat = b.range",
)
def m1(spark, d):
    return M.confusion_matrix(predictions(spark, d), 5)


@query("m2_accuracy", f"with {_PRED} select round(avg((y = yhat)::int), 9) as accuracy, round(1 - avg((y = yhat)::int), 9) as error_rate from pred")
def m2(spark, d):
    return _round(M.label_metrics(M.confusion_counts(predictions(spark, d))).select("accuracy", "error_rate"), ["accuracy", "error_rate"])


@query("m3_balanced_accuracy", f"{_REPORT} select round(avg(rec) filter (s > 0), 9) as balanced_accuracy from rf")
def m3(spark, d):
    return _round(M.label_metrics(M.confusion_counts(predictions(spark, d))).select("balanced_accuracy"), ["balanced_accuracy"])


@query(
    "m4_weighted_prf",
    f"""{_REPORT} select round(sum(s * pre) / sum(s), 9) as precision, round(sum(s * rec) / sum(s), 9) as recall, round(sum(s * f) / sum(s), 9) as f1 from rf""",
)
def m4(spark, d):
    cols = ["precision", "recall", "f1"]
    return _round(M.label_metrics(M.confusion_counts(predictions(spark, d))).select(*cols), cols)


@query(
    "m5_classification_report",
    f"""{_REPORT}, x as (select c::varchar as class, pre as precision, rec as recall, f as f1, s as support from rf
        union all select 'accuracy', sum(tp) / sum(s), sum(tp) / sum(s), sum(tp) / sum(s), sum(s) from rf
        union all select 'macro avg', avg(pre), avg(rec), avg(f), sum(s) from rf
        union all select 'weighted avg', sum(s * pre) / sum(s), sum(s * rec) / sum(s), sum(s * f) / sum(s), sum(s) from rf)
        select class, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from x""",
)
def m5(spark, d):
    return _round(M.classification_report(M.confusion_counts(predictions(spark, d))), ["precision", "recall", "f1"])


@query(
    "m6_cohen_kappa",
    f"{_REPORT} select round((sum(tp) / sum(s) - sum(s * q) / (sum(s) * sum(s))) / (1 - sum(s * q) / (sum(s) * sum(s))), 9) as kappa from rf",
)
def m6(spark, d):
    return _round(M.label_metrics(M.confusion_counts(predictions(spark, d))).select("kappa"), ["kappa"])


@query(
    "m7_mcc",
    f"""{_REPORT} select round((sum(tp) * sum(s) - sum(s * q)) / sqrt((sum(s) * sum(s) - sum(q * q)) * (sum(s) * sum(s) - sum(s * s))), 9) as mcc from rf""",
)
def m7(spark, d):
    return _round(M.label_metrics(M.confusion_counts(predictions(spark, d))).select("mcc"), ["mcc"])


@query("m8_log_loss", f"with {_PRED} select round(-avg(ln(greatest(p[y + 1], 2.220446049250313e-16) / list_sum(p))), 9) as log_loss from pred")
def m8(spark, d):
    return _round(M.log_loss(predictions(spark, d)), ["log_loss"])


@query(
    "m9_top_k_accuracy",
    f"""with {_PRED}, c as (select vec_id, y, p, unnest(p) as x, generate_subscripts(p, 1) - 1 as j from pred),
        r as (select vec_id, count(*) filter (x > p[y + 1] or (x = p[y + 1] and j > y)) as ahead from c group by vec_id)
        select round(avg((ahead < 3)::int), 9) as top_k_accuracy from r""",
)
def m9(spark, d):
    return _round(M.top_k_accuracy(predictions(spark, d), 3), ["top_k_accuracy"])


_CURVE = f"""with {_PRED}, c as (select (generate_subscripts(p, 1) - 1) as j, unnest(p) as score, y from pred),
  lo as (select j::varchar as class, score, (j = y)::int as pos from c union all select 'micro', score, (j = y)::int from c),
  sc as (select class, score, sum(pos)::bigint as pos, count(*) - sum(pos)::bigint as neg from lo group by all),
  cu as (select class, score, pos, neg, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by class) as pp, sum(neg) over (partition by class) as nn
         from sc window w as (partition by class order by score desc)),
  curve as (select class, score as threshold, fp / nn::double as fpr, tp / pp::double as tpr from cu
            union all select distinct class, 'inf'::double, 0.0, 0.0 from cu)"""


@query("m10_roc_curve", f"{_CURVE} select class, round(threshold, 9) as threshold, round(fpr, 9) as fpr, round(tpr, 9) as tpr from curve")
def m10(spark, d):
    c = M.roc_curve(predictions(spark, d), 5)
    inf = F.col("threshold") == float("inf")
    return c.withColumns(
        {"threshold": F.when(inf, F.col("threshold")).otherwise(F.round("threshold", 9)), "fpr": F.round("fpr", 9), "tpr": F.round("tpr", 9)}
    )


_MACRO = f"""{_CURVE}, pt as (select class, fpr, min(tpr) as lo, max(tpr) as hi from curve where class <> 'micro' group by class, fpr),
  g as (select distinct fpr from pt), gc as (select g.fpr, k.class from g, (select distinct class from pt) k),
  x as (select gc.fpr, gc.class, max(b.fpr) as f0, arg_max(b.hi, b.fpr) as t0 from gc join pt b on b.class = gc.class and b.fpr <= gc.fpr group by gc.fpr, gc.class),
  y2 as (select gc.fpr, gc.class, min(b.fpr) as f1, arg_min(b.lo, b.fpr) as t1 from gc join pt b on b.class = gc.class and b.fpr > gc.fpr group by gc.fpr, gc.class),
  mac as (select fpr, avg(case when f0 = fpr or f1 is null then t0 else t0 + (t1 - t0) / (f1 - f0) * (fpr - f0) end) as tpr
          from x left join y2 using (fpr, class) group by fpr)"""


@query("m11_roc_macro", f"{_MACRO} select round(fpr, 9) as fpr, round(tpr, 9) as tpr from mac")
def m11(spark, d):
    return _round(M.roc_macro(M.roc_curve(predictions(spark, d), 5), 5), ["fpr", "tpr"])


@query(
    "m12_roc_auc",
    f"""{_MACRO}, seg as (select class, (fpr - lag(fpr) over w) * (tpr + lag(tpr) over w) / 2 as a from curve window w as (partition by class order by fpr, tpr)),
        per as (select class, sum(a) as auc from seg group by class),
        ms as (select (fpr - lag(fpr) over w) * (tpr + lag(tpr) over w) / 2 as a from mac window w as (order by fpr))
        select class, round(auc, 9) as auc from per union all select 'mean', round(avg(auc), 9) from per where class <> 'micro'
        union all select 'macro', round(sum(a), 9) from ms""",
)
def m12(spark, d):
    return _round(M.roc_auc(predictions(spark, d), 5), ["auc"])


@query(
    "m13_bootstrap_metrics",
    f"""with {_PRED}, rk as (select y, yhat, row_number() over (order by y, yhat) - 1 as position from pred), n as (select count(*) as n from pred),
        g as (select b.range as b, dr.range + 1 as draw from range(200) b, range((select n from n)) dr),
        x as (select b, {sql_hash_int("concat(b, '-', draw)", 42)} % n as position from g, n),
        s as (select b, y, yhat, count(*) as n from x join rk using (position) group by all),
        pc as (select b, c, sum(n) filter (y = c) as s, sum(n) filter (yhat = c) as q, sum(n) filter (y = c and yhat = c) as tp from s, unnest([0, 1, 2, 3, 4]) t(c) group by b, c),
        rp as (select b, coalesce(s, 0)::double as s, coalesce(tp, 0)::double as tp, coalesce(tp / nullif(q, 0)::double, 0) as pre, coalesce(tp / nullif(s, 0)::double, 0) as rec from pc),
        m as (select b, sum(tp) / sum(s) as accuracy, sum(s * pre) / sum(s) as precision, sum(s * rec) / sum(s) as recall,
              sum(s * coalesce(2 * pre * rec / nullif(pre + rec, 0), 0)) / sum(s) as f1 from rp group by b)
        select {', '.join(f'round(avg({m}), 6) as mean_{m}, round(stddev_pop({m}), 6) as std_{m}' for m in ('accuracy', 'precision', 'recall', 'f1'))} from m""",
)
def m13(spark, d):
    out = M.bootstrap_metrics(predictions(spark, d), 200)
    return _round(out, out.columns, 6)


_POISSON = f"[{', '.join(f'{x}::bigint' for x in POISSON)}]"


@query(
    "m13_bootstrap_poisson",
    f"""with {_PRED}, g as (select vec_id, y, yhat, b.range as b from pred, range(200) b),
        w as (select b, y, yhat, len(list_filter({_POISSON}, lambda x: x <= {sql_hash_int("concat(vec_id, '-', b)", 42)})) as n from g),
        s as (select b, y, yhat, sum(n) as n from w group by all),
        pc as (select b, c, sum(n) filter (y = c) as s, sum(n) filter (yhat = c) as q, sum(n) filter (y = c and yhat = c) as tp from s, unnest([0, 1, 2, 3, 4]) t(c) group by b, c),
        rp as (select b, coalesce(s, 0)::double as s, coalesce(tp, 0)::double as tp, coalesce(tp / nullif(q, 0)::double, 0) as pre, coalesce(tp / nullif(s, 0)::double, 0) as rec from pc),
        m as (select b, sum(tp) / sum(s) as accuracy, sum(s * pre) / sum(s) as precision, sum(s * rec) / sum(s) as recall,
              sum(s * coalesce(2 * pre * rec / nullif(pre + rec, 0), 0)) / sum(s) as f1 from rp group by b)
        select {', '.join(f'round(avg({m}), 6) as mean_{m}, round(stddev_pop({m}), 6) as std_{m}' for m in ('accuracy', 'precision', 'recall', 'f1'))} from m""",
)
def m13_poisson(spark, d):
    out = M.bootstrap_metrics(predictions(spark, d), method="poisson", key="vec_id")
    return _round(out, out.columns, 6)


@query("m13_bootstrap_multinomial")
def m13_multinomial(spark, d):
    return M.bootstrap_metrics(predictions(spark, d), 200, method="multinomial")


@query(
    "m14_confidence_histogram",
    f"""with {_PRED}, m as (select list_max(p) as v from pred), s as (select min(v) as lo, max(v) as hi from m),
        c as (select least(floor((v - lo) / ((hi - lo) / 20.0::double)), 19)::int as bin, count(*) as n from m, s group by 1)
        select range::int as bin, round(lo + range * ((hi - lo) / 20.0::double), 6) as low, round(lo + (range + 1) * ((hi - lo) / 20.0::double), 6) as high,
          coalesce(n, 0) as n from range(20) left join c on bin = range, s""",
)
def m14(spark, d):
    return _round(M.confidence_histogram(predictions(spark, d)), ["low", "high"], 6)


@query("m15_predicted_class_distribution", f"with {_PRED} select substr('ABCDE', yhat + 1, 1) as class, count(*) as n from pred group by 1")
def m15(spark, d):
    return M.predicted_class_distribution(predictions(spark, d))


@query("c23_predict_with_confidence", f"with {_PRED} select vec_id, yhat as prediction, round(list_max(p), 9) as confidence from pred")
def c23(spark, d):
    return M.with_confidence(predictions(spark, d)).select("vec_id", "prediction", F.round("confidence", 9).alias("confidence"))
