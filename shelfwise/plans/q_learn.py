"""Classifiers, search and self-training over the driver's tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.operators import learn as L
from shelfwise.operators import metrics as M
from shelfwise.operators import topics as TP
from shelfwise.operators.features import select_by_importance
from shelfwise.operators.kernels import Discriminant
from shelfwise.operators.lloyd import assign_many, kmeans_many
from shelfwise.operators.relational import split_labeled
from shelfwise.operators.runs import RunTimer
from shelfwise.operators.sampling import sample_params, stratified_split
from shelfwise.operators.text import embed
from shelfwise.plans import standins as D
from shelfwise.plans.q_features import vectors
from shelfwise.plans.q_metrics import _PRED, predictions
from shelfwise.plans.registry import query, sql_hash_order
from shelfwise.session import materialize

#: draws and sets of the reference's searches, and its sweep over label shares
DRAWS, SETS = 20, 50
FRACTIONS = (1.0, 0.8, 0.6, 0.4, 0.2)
SWEEP_MODELS = ("RandomForest", "BoostedTrees", "Bagging")
GAMMAS = (2.0, 5.0, 10.0, 20.0, 100.0, 200.0, 500.0)


def five_classes(spark, d):
    """Embeddings with five classes as an ML vector table."""
    v = vectors(spark, d).withColumn("label", (F.col("label") % 5).cast("int"))
    return materialize(L.as_vectors(v), "classes")


def halves(spark, d):
    """(labelled, unlabelled): a stratified half keeps its labels."""
    known, rest = stratified_split(five_classes(spark, d), "label", 0.5)
    return known, rest.drop("label")


def _report(spark, d, kind):
    train, test = stratified_split(five_classes(spark, d), "label", 0.8)
    train, test = materialize(train, "train"), materialize(test, "test")
    model = L.fit_classifier(kind, train, balanced=True)
    out = model.transform(test)
    total = F.aggregate("p", F.lit(0.0), lambda s, x: s + x)
    checked = out.withColumn("sums_to_one", F.abs(total - 1) < 1e-9)
    return checked.groupBy("label").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("correct"), F.min("sums_to_one").alias("sums_to_one")
    )


@query("c7_random_forest")
def c7(spark, d):
    return _report(spark, d, "RandomForest")


@query("c8_boosted_trees")
def c8(spark, d):
    return _report(spark, d, "BoostedTrees")


@query("c9_decision_tree")
def c9(spark, d):
    return _report(spark, d, "DecisionTree")


@query("c10_svm")
def c10(spark, d):
    return _report(spark, d, "SVM")


@query("c11_mlp")
def c11(spark, d):
    return _report(spark, d, "NeuralNetwork")


@query("c13_bagging")
def c13(spark, d):
    return _report(spark, d, "Bagging")


@query("c4_random_search")
def c4(spark, d):
    sizes = spark.range(1, 31).select(F.col("id").alias("maxDepth"))
    grid = sizes.select("maxDepth", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("minInstancesPerNode"))
    draws = [r.asDict() for r in sample_params(grid, DRAWS).collect()]
    best, scores = L.random_search("DecisionTree", five_classes(spark, d), draws)
    return scores.groupBy("draw").agg(F.avg("score").alias("score")).withColumn("best", F.lit(str(best["maxDepth"])))


_LONG = """lt as (select (user_id % 20)::int as draw, (event_id % 5)::int as fold, round(avg(value), 4) as score, count(*)::double as fit_time, max(value) as score_time from events group by all)"""


@query(
    "c5_cv_results",
    f"""with {_LONG}, p as (select draw, avg(score) as m, stddev_pop(score) as s, avg(fit_time) as ft, avg(score_time) as st from lt group by draw)
        select draw, round(m, 9) as mean_test_score, round(s, 9) as std_test_score, round(ft, 6) as mean_fit_time, round(st, 6) as mean_score_time,
          rank() over (order by round(m, 12) desc)::int as rank_test_score from p""",
)
def c5(spark, d):
    e = D.table(spark, d, "events")
    long = e.groupBy((F.col("user_id") % 20).cast("int").alias("draw"), (F.col("event_id") % 5).cast("int").alias("fold")).agg(
        F.round(F.avg("value"), 4).alias("score"), F.count("*").cast("double").alias("fit_time"), F.max("value").alias("score_time")
    )
    out = L.cv_results(long)
    n = {"mean_test_score": 9, "std_test_score": 9, "mean_fit_time": 6, "mean_score_time": 6}
    return out.withColumns({c: F.round(c, k) for c, k in n.items()})


@query(
    "c5_cv_table",
    f"""with {_LONG}, p as (select draw, avg(score) as m, stddev_pop(score) as s, avg(fit_time) as ft, avg(score_time) as st, stddev_pop(fit_time) as sf, stddev_pop(score_time) as ss,
          {', '.join(f'max(score) filter (fold = {f}) as split{f}_test_score' for f in range(5))} from lt group by draw)
        select draw, round(m, 9) as mean_test_score, round(s, 9) as std_test_score, round(ft, 6) as mean_fit_time, round(st, 6) as mean_score_time,
          rank() over (order by round(m, 12) desc)::int as rank_test_score, round(sf, 6) as std_fit_time, round(ss, 6) as std_score_time,
          {', '.join(f'split{f}_test_score' for f in range(5))}, (draw % 7)::varchar as param_depth from p""",
)
def c5_table(spark, d):
    e = D.table(spark, d, "events")
    long = e.groupBy((F.col("user_id") % 20).cast("int").alias("draw"), (F.col("event_id") % 5).cast("int").alias("fold")).agg(
        F.round(F.avg("value"), 4).alias("score"), F.count("*").cast("double").alias("fit_time"), F.max("value").alias("score_time")
    )
    long = long.withColumn("params", F.create_map(F.lit("depth"), (F.col("draw") % 7).cast("string")))
    out = L.cv_table(long, 5, ["depth"])
    n = {"mean_test_score": 9, "std_test_score": 9} | dict.fromkeys(["mean_fit_time", "mean_score_time", "std_fit_time", "std_score_time"], 6)
    return out.withColumns({c: F.round(c, k) for c, k in n.items()})


@query("c6_cross_val_score")
def c6(spark, d):
    row = L.cross_val_score("DecisionTree", five_classes(spark, d))
    return spark.createDataFrame([tuple(row.values())], "model string, cv_score double, error string")


@query("c14_model_bakeoff")
def c14(spark, d):
    scores, _ = L.model_bakeoff(five_classes(spark, d), dict.fromkeys(L.CLASSIFIERS, {}))
    return scores.drop("seconds")


_DISC = """e as (select vec_id as id, (label % 5)::int as y, embedding[1]::double as a, embedding[2]::double as b from embeddings),
  k as (select count(distinct y) as k, count(*) as n from e),
  m as (select y, count(*)::double as c, avg(a) as ma, avg(b) as mb from e group by y),
  s as (select y, sum((a - ma) * (a - ma)) as aa, sum((a - ma) * (b - mb)) as ab, sum((b - mb) * (b - mb)) as bb from e join m using (y) group by y),
  p as (select sum(aa) / (any_value(n) - any_value(k)) as paa, sum(ab) / (any_value(n) - any_value(k)) as pab, sum(bb) / (any_value(n) - any_value(k)) as pbb from s, k)"""


def _disc_sql(aa, ab, bb):
    return f"""with {_DISC}, v as (select y, c, ma, mb, {aa} as vaa, {ab} as vab, {bb} as vbb from m join s using (y), p),
        d as (select e.id, v.y, ln(c / n) - ln(vaa * vbb - vab * vab) / 2
          - (vbb * (a - ma) * (a - ma) - 2 * vab * (a - ma) * (b - mb) + vaa * (b - mb) * (b - mb)) / (vaa * vbb - vab * vab) / 2 as score from e, v, k)
        select id as row_id, y as class, round(score, 6) as score from d"""


def _discriminant(spark, d, **p):
    v = vectors(spark, d).select("row_id", (F.col("label") % 5).cast("int").alias("__y"), F.slice("features", 1, 2).alias("__x"))
    data = L.as_vectors(v, "__x")
    scored = Discriminant(**p).fit(data).transform(data, out="s", raw=True)
    return scored.select("row_id", F.posexplode("s").alias("class", "score")).withColumn("score", F.round("score", 6))


@query("c14_linear_discriminant", _disc_sql("paa", "pab", "pbb"))
def c14_linear(spark, d):
    return _discriminant(spark, d)


@query("c14_quadratic_discriminant", _disc_sql("aa / (c - 1)", "ab / (c - 1)", "bb / (c - 1)"))
def c14_quadratic(spark, d):
    return _discriminant(spark, d, quadratic=True)


@query("c10_kernel_svm")
def c10_kernel(spark, d):
    return _report(spark, d, "KernelSVM")


@query("c15_self_train")
def c15(spark, d):
    known, pool = halves(spark, d)
    _, labels = L.self_train("DecisionTree", known, pool, 0.7)
    return labels.groupBy("labeled_iter").agg(F.count("*").alias("n"), F.count("label").alias("n_labeled"))


@query("c15_accept_step", f"with {_PRED} select vec_id, yhat as label, list_max(p) > 0.3 as accepted from pred")
def c15_accept(spark, d):
    return L.accept_confident(predictions(spark, d), 0.3).select("vec_id", F.col("yhat").alias("label"), "accepted")


@query("c16_self_train_two_pass")
def c16(spark, d):
    known, pool = halves(spark, d)
    _, labels = L.self_train_two_pass("DecisionTree", known, pool, 0.7)
    return labels.groupBy("labeled_iter").agg(F.count("*").alias("n"), F.count("label").alias("n_labeled"))


_F1 = "f as (select event_type as model, (user_id % 12)::int as step, round(avg(value) / 100, 6) as f1 from events group by all)"


@query(
    "c17_adaptive_threshold",
    f"""with recursive {_F1}, w as (
          select model, 0 as step, (case when f1 > 0 then 0.75 else 0.8 end)::double as threshold, f1 as best from f where step = 0
          union all
          select f.model, f.step, case when f1 > best * 1.01 then greatest(threshold - 0.05, 0.5) when f1 < best then least(threshold + 0.05, 0.8) else threshold end::double,
            case when f1 > best * 1.01 then f1 else best end from w join f on f.model = w.model and f.step = w.step + 1)
        select model, step, round(threshold, 6) as threshold from w""",
)
def c17(spark, d):
    e = D.table(spark, d, "events")
    runs = e.groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 12).cast("int").alias("step")).agg(
        F.round(F.avg("value") / 100, 6).alias("f1")
    )
    return L.adaptive_threshold(runs, ["model"], "step", "f1").withColumn("threshold", F.round("threshold", 6))


@query(
    "c18_pseudo_label_summary",
    f"""with {_PRED}, l as (select vec_id, case when vec_id % 4 = 0 then y when list_max(p) > 0.3 then yhat end as label, vec_id % 4 = 0 as given from pred)
        select count(*) filter (not given and label is not null) as pseudo_label_count, count(*) filter (not given and label is null) as not_pseudo_label_count,
          concat_ws(',', {', '.join(f'count(*) filter (not given and label = {c})' for c in range(5))}) as pseudo_label_distribution, 0.3::double as threshold,
          count(*) filter (given) as labeled_samples_count from l""",
)
def c18(spark, d):
    given = F.col("vec_id") % 4 == 0
    scored = L.accept_confident(predictions(spark, d), 0.3)
    label = F.when(given, F.col("y")).when(F.col("accepted"), F.col("yhat"))
    it = F.when(given, 0).when(F.col("accepted"), 1).otherwise(-1)
    out = L.pseudo_label_summary(scored.select(label.alias("label"), it.alias("labeled_iter")), 5, 0.3)
    return out.withColumn("pseudo_label_distribution", F.array_join(F.col("pseudo_label_distribution").cast("array<string>"), ","))


@query("c24_fraction_sweep")
def c24(spark, d):
    known, pool = halves(spark, d)
    out = L.fraction_sweep(known, pool, FRACTIONS, dict.fromkeys(SWEEP_MODELS, {}), n_classes=5, bootstrap=200)
    return out.drop("training_time")


@query("c25_feature_importances")
def c25(spark, d):
    data = five_classes(spark, d)
    model = L.fit_classifier("RandomForest", data)
    return spark.createDataFrame(L.feature_importances(model, [f"e_{i}" for i in range(64)]), "feature string, importance double")


@query("e9_select_from_model")
def e9_model(spark, d):
    data = five_classes(spark, d)
    model = L.fit_classifier("RandomForest", data)
    reduced, keep = select_by_importance(data, model.importances())
    from pyspark.ml.functions import vector_to_array

    return reduced.select("row_id", F.size(vector_to_array("selected")).alias("kept"), F.lit(len(keep)).alias("wanted"))


@query(
    "m16_training_time",
    "select 'DecisionTree' as model, unnest([0.5, 1.0])::double as labeled_fraction, true as measured from (select 1 from embeddings limit 1)",
)
def m16(spark, d):
    data, timer = five_classes(spark, d), RunTimer()
    for frac in (0.5, 1.0):
        part, _ = stratified_split(data, "label", frac)
        with timer.timed("DecisionTree", frac):
            L.fit_classifier("DecisionTree", part)
    return timer.table(spark).select("model", "labeled_fraction", (F.col("training_time") > 0).alias("measured"))


def topic_runs(spark, d):
    """(topic table, document table) of 50 numbers of topics, ten starts each."""
    docs = D.table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), "text")
    vecs = materialize(embed(docs, "text").select("row_id", F.col("embedding").cast("array<double>").alias("features")), "embed")
    # candidate numbers of topics follow the languages found in the table
    langs = D.table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    ranges = langs.agg(F.count("*").cast("int").alias("k")).select(F.explode(F.sequence(F.lit(2), F.col("k") + SETS)).alias("n_topics"))

    def cluster(_, sets):
        return assign_many(vecs, kmeans_many(vecs, [s["n_topics"] for s in sets]))

    return TP.topic_sweep(docs, "text", sample_params(ranges, SETS, 42), cluster)


@query("t15_topic_sweep")
def t15(spark, d):
    infos, _ = topic_runs(spark, d)
    return infos.select("n_topics", "topic", "count", "name")


@query(
    "t15_topic_sweep_totals",
    f"""with r as (select unnest(range(2, (select count(distinct lang) + {SETS + 1} from documents)::int))::int as n_topics),
        s as (select * from r order by {sql_hash_order('n_topics', 42)}, n_topics limit {SETS})
        select n_topics, (select count(*) from documents) as documents, true as in_bounds from s""",
)
def t15_totals(spark, d):
    """Every document is in one topic of every set; no set has more topics than asked
    for, no topic more than ten words."""
    infos, placed = topic_runs(spark, d)
    bounds = F.count("*").between(2, F.col("n_topics")) & (F.max(F.size("representation")) <= 10)
    per = infos.groupBy("n_topics").agg(bounds.alias("in_bounds"))
    return per.join(placed.groupBy("n_topics").agg(F.countDistinct("row_id").alias("documents")), "n_topics")


@query("c22_graph_learning")
def c22_graph(spark, d):
    from shelfwise.operators.graph import graph_learning
    from shelfwise.plans.q_graph import labeled_nodes

    report, predicted = graph_learning(labeled_nodes(spark, d), 5, "propagation", GAMMAS)
    keep = F.lit(report["cv_best_score"]).alias("cv_best_score")
    return predicted.select("id", "prediction", keep)
