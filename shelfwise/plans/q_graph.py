"""Label propagation and spreading with their SQL twins (fixed rounds)."""

from pyspark.sql import functions as F

from shelfwise.operators import graph as G
from shelfwise.operators import neighbors as N
from shelfwise.operators.full_kernel import kernel_propagation
from shelfwise.plans.q_features import vectors
from shelfwise.plans.q_neighbors import _E, _knn_sql
from shelfwise.plans.registry import query
from shelfwise.session import materialize

GAMMA, K, ROUNDS = 5.0, 7, 4
CLASSES = range(5)
# one row in four keeps its class (label modulo 5)
_NODES = "nodes as (select id, case when id % 4 = 0 then label % 5 end as y from e)"
_AFF = f"""{_E}, {_knn_sql(K)}, aff as (select src, dst, exp(-{GAMMA} * min(d) * min(d)) as w
  from (select l as src, r as dst, d from kn{K} union all select r, l, d from kn{K}) group by src, dst)"""


# the kernel of all pairs; a row's weight to itself is 1 in propagation, none in spreading
_FULL = f"{_E}, aff as (select a.id as src, b.id as dst, exp(-{GAMMA} * pow(list_distance(a.v, b.v), 2)) as w from e a join e b on a.id <> b.id)"


def labeled_nodes(spark, d):
    return vectors(spark, d).withColumn("label", F.when(F.col("row_id") % 4 == 0, F.col("label") % 5).cast("int"))


def affinity(spark, d):
    return materialize(N.rbf_affinity(vectors(spark, d), GAMMA, K), "affinity")


def _cols(fmt: str) -> str:
    return ", ".join(fmt.format(c=c) for c in CLASSES)


def _result(final: str) -> str:
    total = " + ".join(f"f{c}" for c in CLASSES)
    best = "case " + " ".join(
        f"when f{c} = greatest({', '.join(f'f{x}' for x in CLASSES)}) then {c}" for c in CLASSES
    ) + " end"
    shares = ", ".join(f"round(case when {total} = 0 then 0 else f{c} / ({total}) end, 6) as p{c}" for c in CLASSES)
    return f"select id, {shares}, case when {total} > 0 then {best} end::int as label from {final}"


def _lp_sql(aff: str = _AFF) -> str:
    ctes = [aff, _NODES, f"r0 as (select id, y, {_cols('coalesce((y = {c})::double, 0.0) as f{c}')} from nodes)"]
    for i in range(ROUNDS):
        total = " + ".join(f"(f{c} + coalesce(g{c}, 0))" for c in CLASSES)
        new = ", ".join(
            f"case when y is not null then f{c} when {total} = 0 then 0 else (f{c} + coalesce(g{c}, 0)) / ({total}) end as f{c}"
            for c in CLASSES
        )
        ctes.append(
            f"g{i} as (select dst, {_cols('sum(w * f{c}) as g{c}')} from aff join r{i} on id = src group by dst), "
            f"r{i + 1} as (select id, y, {new} from r{i} left join g{i} on dst = id)"
        )
    return f"with {', '.join(ctes)} {_result(f'r{ROUNDS}')}"


def _ls_sql(alpha: float, aff: str = _AFF) -> str:
    ctes = [
        aff, _NODES,
        "deg as (select src as id, sum(w) as dg from aff group by src)",
        "sp as (select src, dst, w / sqrt(a.dg * b.dg) as w from aff join deg a on a.id = src join deg b on b.id = dst)",
        f"r0 as (select id, {_cols('coalesce((y = {c})::double, 0.0) as y{c}')}, {_cols('coalesce((y = {c})::double, 0.0) as f{c}')} from nodes)",
    ]
    for i in range(ROUNDS):
        new = ", ".join(f"{1 - alpha}::double * y{c} + {alpha}::double * coalesce(g{c}, 0) as f{c}" for c in CLASSES)
        ctes.append(
            f"g{i} as (select dst, {_cols('sum(w * f{c}) as g{c}')} from sp join r{i} on id = src group by dst), "
            f"r{i + 1} as (select id, {_cols('y{c}')}, {new} from r{i} left join g{i} on dst = id)"
        )
    return f"with {', '.join(ctes)} {_result(f'r{ROUNDS}')}"


def _frame(out):
    return out.select("id", *[F.round(F.col("p")[c], 6).alias(f"p{c}") for c in CLASSES], "label")


@query("c19_label_propagation", _lp_sql())
def c19(spark, d):
    nodes = labeled_nodes(spark, d).select(F.col("row_id").alias("id"), "label")
    return _frame(G.label_propagation(nodes, affinity(spark, d), 5, ROUNDS, None))


@query("c20_label_spreading", _ls_sql(0.4))
def c20(spark, d):
    nodes = labeled_nodes(spark, d).select(F.col("row_id").alias("id"), "label")
    return _frame(G.label_spreading(nodes, affinity(spark, d), 5, 0.4, ROUNDS, None))


@query("c19_full_kernel_propagation", _lp_sql(_FULL))
def c19_full(spark, d):
    return _frame(kernel_propagation(labeled_nodes(spark, d), 5, GAMMA, max_iter=ROUNDS, tol=None))


@query("c20_full_kernel_spreading", _ls_sql(0.2, _FULL))
def c20_full(spark, d):
    return _frame(kernel_propagation(labeled_nodes(spark, d), 5, GAMMA, "spreading", max_iter=ROUNDS, tol=None))


@query("c21_rbf_affinity", f"with {_AFF} select src, dst, round(w, 6) as w from aff")
def c21(spark, d):
    return N.rbf_affinity(vectors(spark, d), GAMMA, K).withColumn("w", F.round("w", 6))


@query(
    "c22_propagate_inductive",
    f"""with {_E}, {_NODES}, tr as (select id, v, y from nodes join e using (id) where y is not null),
        nw as (select id, v from nodes join e using (id) where y is null),
        w as (select nw.id, y, exp(-{GAMMA} * pow(list_distance(nw.v, tr.v), 2)) as w from nw, tr),
        f as (select id, {_cols('coalesce(sum(w) filter (y = {c}), 0) as f{c}')} from w group by id) {_result('f')}""",
)
def c22(spark, d):
    rows = labeled_nodes(spark, d)
    return _frame(G.propagate_inductive(rows.filter("label is not null"), rows.filter("label is null"), GAMMA, 5))


@query("c26_transductive_propagation", _ls_sql(0.2))
def c26(spark, d):
    return _frame(
        G.transductive_propagation(labeled_nodes(spark, d), 5, GAMMA, K, "spreading", alpha=0.2, max_iter=ROUNDS, tol=None)
    )
