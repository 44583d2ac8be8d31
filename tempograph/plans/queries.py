"""Named queries: each operator over graphs of the test tables, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import no_minus_zero, recoded_time
from ..operators import cluster, cuts, dictionary, matrices, metrics, report, sbm, spectral, walks
from ..operators.shared import new_path, written
from ..sources import text
from ..streaming import snapshots
from . import sql
from .graphs import Graph, cosupply, nation_trade, table, user_event

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return put


def six(name: str) -> Column:
    return no_minus_zero(F.col(name)).alias(name)


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(user_event(spark, sf_dir))


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(cosupply(spark, sf_dir))


EVENTS = sql.with_(sql.USER_EVENT, sql.INDEX)
SUPPLY = sql.with_(sql.COSUPPLY, sql.INDEX)


def and_(base: str, *parts: str) -> str:
    return base.rstrip() + "," + ",".join(parts) + " "


# --- dictionaries, bins, edge relations


@query(SUPPLY + "select node, i from nodes")
def node_dictionary(spark, sf_dir):
    return supply_graph(spark, sf_dir).nodes


@query(SUPPLY + "select time, t from times")
def time_dictionary(spark, sf_dir):
    return supply_graph(spark, sf_dir).times


@query(EVENTS + "select t, src, dst from ix")
def edges_indexed(spark, sf_dir):
    return events_graph(spark, sf_dir).indexed


@query(SUPPLY + "select time, t, case when len > 10 then t // greatest(1, len // 10) else t end as bin from times, size")
def time_bin_ordinal(spark, sf_dir):
    return dictionary.bin_ordinal(supply_graph(spark, sf_dir).times, 10)


@query(
    sql.with_(sql.USER_EVENT, "ends as (select min(time) as low, max(time) as high from edges)")
    + "select src, dst, time, cast(least(floor((time - low) / ((high - low) / 7)), 6) as bigint) as bin from edges, ends"
)
def time_bin_equal_width(spark, sf_dir):
    return dictionary.bin_equal_width(user_event(spark, sf_dir), 7)


@query("""with a as (select l_orderkey, l_linenumber, l_discount * 10 as time from lineitem)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, cast(case when time < 0 then 0 when time < 0.2 then 1 when time < 0.4 then 2 when time < 0.6 then 3 when time < 0.8 then 4 else 5 end as bigint) as step from a""")
def time_recode_case(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), recoded_time(F.col("l_discount") * 10).alias("step"))


@query(sql.with_(sql.USER_EVENT) + "select src, dst from edges")
def static_edges(spark, sf_dir):
    return dictionary.static_edges(user_event(spark, sf_dir))


@query(
    sql.with_(sql.USER_EVENT, "b as (select src as u, dst as v, time as ts from edges union select dst, src, time from edges)")
    + "select u, v, ts, row_number() over (order by ts, u, v) as idx from b"
)
def reverse_edges_dedup(spark, sf_dir):
    return dictionary.with_reverse(user_event(spark, sf_dir))


@query(sql.with_(sql.NATION_TRADE) + "select distinct a.dst as src, a.src as dst, a.time from edges a where not exists (select 1 from edges b where b.src = a.dst and b.dst = a.src and b.time = a.time)")
def missing_reverse_edges(spark, sf_dir):
    return dictionary.missing_reverse(nation_trade(spark, sf_dir).select("src", "dst", "time"))


# --- snapshot matrices


@query(SUPPLY + "select t, i, j, w from adj")
def adjacency_coo(spark, sf_dir):
    return supply_graph(spark, sf_dir).adjacency


@query(EVENTS + "select t, i, deg from deg")
def degree(spark, sf_dir):
    return events_graph(spark, sf_dir).degree


@query(and_(EVENTS, sql.CONST) + "select t, i, round(deg, 6) as deg from dreg")
def degree_reg_const(spark, sf_dir):
    return matrices.regularised(events_graph(spark, sf_dir).degree, 0.1, ["t"]).select("t", "i", six("deg"))


@query(EVENTS + "select t, i, round(deg + avg(deg) over (partition by t), 6) as deg from deg")
def degree_reg_avg(spark, sf_dir):
    return matrices.regularised(events_graph(spark, sf_dir).degree, "avg", ["t"]).select("t", "i", six("deg"))


@query(SUPPLY + "select i, sum(deg) as deg from deg group by i")
def degree_aggregated(spark, sf_dir):
    return matrices.degree_aggregated(supply_graph(spark, sf_dir).degree)


@query(and_(EVENTS, "a as (select i, sum(deg) as deg from deg group by i)") + "select i, round(deg + avg(deg) over (), 6) as deg from a")
def degree_aggregated_avg(spark, sf_dir):
    return matrices.degree_aggregated(events_graph(spark, sf_dir).degree, "avg").select("i", six("deg"))


@query(and_(SUPPLY, sql.LAPLACIAN) + "select t, i, j, val + 0.0 as val from lap")
def laplacian_unnormalized(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return matrices.laplacian(g.adjacency, g.degree).select("t", "i", "j", (F.col("val") + 0.0).alias("val"))


@query(and_(SUPPLY, sql.CONST, sql.N1) + "select t, i, j, round(val, 6) + 0.0 as val from n1")
def laplacian_n1(spark, sf_dir):
    return supply_graph(spark, sf_dir).n1().select("t", "i", "j", six("val"))


@query(and_(SUPPLY, sql.CONST, sql.N2) + "select t, i, j, round(val, 6) + 0.0 as val from n2")
def laplacian_n2(spark, sf_dir):
    return supply_graph(spark, sf_dir).n2().select("t", "i", "j", six("val"))


@query(SUPPLY + "select t as i, t as j, case when t = 0 or t = len - 1 then 1.0 else 2.0 end::double as val from times, size union all select t, t + 1, -1.0 from times, size where t < len - 1 union all select t + 1, t, -1.0 from times, size where t < len - 1")
def chain_time_laplacian(spark, sf_dir):
    return matrices.chain_laplacian(supply_graph(spark, sf_dir).times)


@query(SUPPLY + "select i, t * n + j as col, w from adj, size")
def unfolded_coo(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return matrices.unfolded(g.adjacency, F.lit(g.n))


@query(EVENTS + sql.gram("adj", "w"))
def gram_uase(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    return spectral.gram(g.adjacency.withColumnRenamed("w", "val"), 6)


@query(and_(EVENTS, sql.CONST, sql.N1) + sql.gram("n1"))
def gram_ulse_n1(spark, sf_dir):
    return spectral.gram(events_graph(spark, sf_dir).n1(), 6)


@query(and_(EVENTS, sql.CONST, sql.N2) + sql.gram("n2"))
def gram_ulse_n2(spark, sf_dir):
    return spectral.gram(events_graph(spark, sf_dir).n2(), 6)


@query(and_(SUPPLY, "m as (select i, j, sum(w) as val from adj group by all)") + "select a.i, b.j, sum(a.val * b.val) as val from m a join m b on a.j = b.i group by all")
def sparse_product(spark, sf_dir):
    total = supply_graph(spark, sf_dir).adjacency.groupBy("i", "j").agg(F.sum("w").alias("val"))
    return matrices.product(total, total)


@query(and_(EVENTS, "density as (select times.t, count(ix.t) / (n * (n - 1) / 2.0) as density from times join size on true left join ix on ix.t = times.t group by times.t, n)") + "select t, round(density, 9) as density from density")
def edge_density(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    return matrices.edge_density(g.indexed, g.times, g.n).select("t", F.round("density", 9).alias("density"))


JACCARD = """own as (select distinct t, src, dst from ix), met as (select a.t, count(*) as c from own a join own b on b.t = a.t + 1 and b.src = a.src and b.dst = a.dst group by a.t),
num as (select t, count(*) as n from own group by t),
change as (select a.t, 1 - coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)) as change from num a join num b on b.t = a.t + 1 left join met on met.t = a.t)"""


@query(and_(EVENTS, JACCARD) + "select t, round(change, 9) as change from change")
def jaccard_change(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    return matrices.jaccard_change(g.indexed, g.times).select("t", F.round("change", 9).alias("change"))


@query(
    and_(EVENTS, JACCARD, "density as (select ix.t, count(*) / (any_value(n) * (any_value(n) - 1) / 2.0) as density from ix, size group by ix.t)")
    + "select round(greatest(0.1, least(10.0, (1 + 2 * (select avg(density) from density)) * (1 - (select avg(change) from change) / 2) * (sqrt(n) / 10) / sqrt(len))), 6) as beta from size"
)
def beta_suggestion(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    found = matrices.beta_suggestion(matrices.edge_density(g.indexed, g.times, g.n), matrices.jaccard_change(g.indexed, g.times), g.n, g.length)
    return found.select(F.round("beta", 6).alias("beta"))


@query(EVENTS + "select t, i from deg where deg = 0")
def isolated_nodes(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    return matrices.isolated(g.adjacency, g.rows)


@query(SUPPLY + "select t, sum(deg) as volume, cast(count(*) filter (deg > 0) as bigint) as n_active from deg group by t")
def node_volume(spark, sf_dir):
    return matrices.volumes(supply_graph(spark, sf_dir).degree)


# --- temporal cuts


@query(and_(EVENTS, sql.LAPLACIAN) + ", " + sql.supra(False).lstrip())
def supra_laplacian_sparse(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    return cuts.supra_laplacian(g.adjacency, g.rows, g.times, g.n).select("row", "col", six("val"))


@query(and_(EVENTS, "dreg as (select t, i, deg from deg)", sql.N1.replace("-w / sqrt(a.deg) / sqrt(b.deg)", "case when a.deg > 0 and b.deg > 0 then -w / sqrt(a.deg) / sqrt(b.deg) else 0 end")) + ", " + sql.supra(True).lstrip())
def supra_laplacian_normalized(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    return cuts.supra_laplacian(g.adjacency, g.rows, g.times, g.n, normalized=True).select("row", "col", six("val"))


@query(EVENTS + "select deg.t, i, n * deg - sum(deg) over (partition by deg.t) as x from deg, size")
def complete_laplacian_apply(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    return cuts.complete_apply(g.degree.withColumnRenamed("deg", "x"), g.n)


def swept(spark: SparkSession, sf_dir: str, normalized: bool = False, every: int = 1) -> tuple[Graph, DataFrame]:
    g = events_graph(spark, sf_dir)
    return g, cuts.sweep(g.degree.withColumnRenamed("deg", "ev"), g.adjacency, g.n, g.length - 1, normalized=normalized, every=every)


BEST = "select r, round(score, 9) as score, edges, swaps from best"


def best(found: DataFrame) -> DataFrame:
    return cuts.best_cut(found).select("r", F.round("score", 9).alias("score"), "edges", "swaps")


@query(and_(EVENTS, sql.sweep(False)) + BEST)
def sweep_cut_sparse(spark, sf_dir):
    return best(swept(spark, sf_dir)[1])


@query(and_(EVENTS, sql.sweep(True)) + BEST)
def sweep_cut_normalized(spark, sf_dir):
    return best(swept(spark, sf_dir, normalized=True)[1])


@query(and_(EVENTS, sql.sweep(False, 4)) + BEST)
def sweep_cut_sampled(spark, sf_dir):
    return best(swept(spark, sf_dir, every=4)[1])


@query(and_(EVENTS, sql.sweep(True, 4)) + BEST)
def sweep_cut_sampled_normalized(spark, sf_dir):
    return best(swept(spark, sf_dir, normalized=True, every=4)[1])


@query(and_(EVENTS, sql.sweep(False)) + "select r, edges, swaps, cast(balance as double) as balance from swept")
def sweep_prefixes(spark, sf_dir):
    return swept(spark, sf_dir)[1].select("r", "edges", "swaps", "balance")


@query(and_(EVENTS, sql.sweep(False)) + "select spine.t, spine.i, cast(case when swept.r <= (select r from best) then -1 else 1 end as bigint) as side from spine left join swept on swept.t = spine.t and swept.i = spine.i")
def cut_sides(spark, sf_dir):
    g, found = swept(spark, sf_dir)
    return cuts.sides(found, g.rows)


@query("select n as rank from (select cast((row_number() over (order by vec_id) - 1) as bigint) as n from embeddings) where n % greatest(1, (select count(*) from embeddings) // 100) = 0")
def systematic_sample(spark, sf_dir):
    ids = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("t"), F.col("vec_id").alias("i"), F.col("vec_id").cast("double").alias("ev"))
    every = max(1, ids.count() // 100)
    return cuts.steps(ids, every).select(((F.col("r") - 1) * every).cast("long").alias("rank"))


def cut_embedding(method: str, spark: SparkSession, sf_dir: str, normalized: bool = False) -> DataFrame:
    """(t, i, ev, side) of a method's vector and of its sweep, on the whole co-supply graph."""
    g = supply_graph(spark, sf_dir)
    found = written(cuts.vector(method, g.adjacency, g.rows, g.times, g.n, g.length, normalized=normalized), "vector")
    side = cuts.sides(cuts.sweep(found, g.adjacency, g.n, g.length - 1, normalized=normalized), g.rows)
    return found.join(side, ["t", "i"])


@query()
def cut_fast(spark, sf_dir):
    return cut_embedding("fast", spark, sf_dir)


@query()
def cut_fast_normalized(spark, sf_dir):
    return cut_embedding("fast", spark, sf_dir, True)


@query()
def cut_diff(spark, sf_dir):
    return cut_embedding("diff", spark, sf_dir)


@query()
def cut_laplacian(spark, sf_dir):
    return cut_embedding("laplacian", spark, sf_dir)


@query()
def cut_prod(spark, sf_dir):
    return cut_embedding("prod", spark, sf_dir)


# --- spectral embeddings


def components(embedding: DataFrame) -> DataFrame:
    """(t, i, k, x): a row for each component."""
    return embedding.select("t", "i", F.posexplode("emb").alias("k", "x")).select("t", "i", F.col("k").cast("long").alias("k"), six("x"))


@query(and_(SUPPLY, sql.vectors("adj", "w", 3)) + sql.embedded("adj", "w", "k"))
def uase(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return components(spectral.uase(g.adjacency, g.nodes, g.rows, g.n, 3))


@query(and_(SUPPLY, sql.CONST, sql.N1 + ", " + sql.vectors("n1", "val", 4, "(select 4.0 * len from size)")) + sql.embedded("n1", "(c.val - case when c.i = c.j then 1 else 0 end)", "3 - k", "k > 0"))
def ulse_n1(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return components(spectral.ulse_n1(g.n1(), g.nodes, g.rows, g.n, 3, g.length, g.scaled_n1()))


@query(and_(SUPPLY, sql.CONST, sql.N2 + ", " + sql.vectors("n2", "val", 3)) + sql.embedded("n2", "val", "k"))
def ulse_n2(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return components(spectral.ulse_n2(g.n2(), g.nodes, g.rows, g.n, 3, g.scaled_n2(), g.length))


@query()
def omni(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return spectral.omni(g.adjacency, g.rows, g.n, 3)


@query(EVENTS + "select count(*) as n_rows, count(distinct t) as n_times, count(distinct i) as n_nodes from spine")
def embedding_statistics(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    found = spectral.uase(g.adjacency, g.nodes, g.rows, g.n, 3)
    return found.agg(F.count("*").alias("n_rows"), F.countDistinct("t").alias("n_times"), F.countDistinct("i").alias("n_nodes"))


# --- walks


TRADE = sql.with_(sql.NATION_TRADE, sql.INDEX, "we as (select t, a.i as i, b.i as j, w from edges join times using (time) join nodes a on a.node = edges.src join nodes b on b.node = edges.dst)")


def trade(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g = Graph(nation_trade(spark, sf_dir))
    a, b = g.nodes.select(F.col("node").alias("src"), "i"), g.nodes.select(F.col("node").alias("dst"), F.col("i").alias("j"))
    return g, g.edges.join(g.times, "time").join(a, "src").join(b, "dst").select("t", "i", "j", "w")


@query(TRADE + "select t, i, j, round(w / sum(w) over (partition by t, i), 9) as p from we")
def transition_first_order(spark, sf_dir):
    return walks.first_order(trade(spark, sf_dir)[1]).select("t", "i", "j", F.round("p", 9).alias("p"))


@query(
    and_(TRADE, "paths as (select a.t, a.i, a.j, b.j as k, case when b.j = a.i then b.w / 0.5 when c.t is not null then b.w else b.w / 2.0 end as v from we a join we b on b.t = a.t and b.i = a.j left join we c on c.t = a.t and c.i = b.j and c.j = a.i)")
    + "select t, i, j, k, round(v / sum(v) over (partition by t, i, j), 9) as prob from paths"
)
def transition_second_order(spark, sf_dir):
    return walks.second_order(trade(spark, sf_dir)[1], 0.5, 2.0).select("t", "i", "j", "k", F.round("prob", 9).alias("prob"))


@query()
def node2vec_walks(spark, sf_dir):
    g, edges = trade(spark, sf_dir)
    return walks.walks(edges, g.rows, 2, 8, 1.0, 1.0)


@query()
def node2vec_embedding(spark, sf_dir):
    g, edges = trade(spark, sf_dir)
    return walks.skip_gram(written(walks.walks(edges, g.rows, 4, 10, 1.0, 1.0), "paths"), g.rows, 8)


# --- clustering and evaluation


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, i, label, cluster) of users' days: the first event type, and a remainder of the last event's id."""
    events = table(spark, sf_dir, "events")
    kinds = F.broadcast(events.select("event_type").distinct().agg(F.sort_array(F.collect_list("event_type")).alias("kinds")))
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    found = events.join(kinds).select(day.alias("t"), F.col("user_id").alias("i"), "event_id", (F.array_position("kinds", F.col("event_type")) - 1).cast("long").alias("k"))
    return found.groupBy("t", "i").agg(F.min("k").alias("label"), (F.max("event_id") % 5).alias("cluster"))


CLUSTERED = sql.with_(sql.CLUSTERED)


@query(CLUSTERED + "select t, label, cluster, n from tab")
def contingency(spark, sf_dir):
    return metrics.contingency(clustered(spark, sf_dir), ["t"])


NMI = """ha as (select t, -sum(a / total * ln(a / total)) as h from ma join tot using (t) group by t), hb as (select t, -sum(b / total * ln(b / total)) as h from mb join tot using (t) group by t),
mi as (select t, sum(n / total * ln(n * total / (a * b))) as m from tab join ma using (t, label) join mb using (t, cluster) join tot using (t) group by t)"""


@query(and_(CLUSTERED, NMI) + "select t, round(case when ha.h + hb.h > 0 then greatest(0, m) / ((ha.h + hb.h) / 2) else 1 end, 6) as nmi from mi join ha using (t) join hb using (t)")
def nmi(spark, sf_dir):
    return metrics.nmi(metrics.contingency(clustered(spark, sf_dir), ["t"]), ["t"]).select("t", six("nmi"))


ARI = """s as (select t, sum(n * (n - 1) / 2) as s from tab group by t), sa as (select t, sum(a * (a - 1) / 2) as sa from ma group by t), sb as (select t, sum(b * (b - 1) / 2) as sb from mb group by t),
x as (select t, s, (sa + sb) / 2 as most, case when total > 1 then sa * sb / (total * (total - 1) / 2) else 0 end as expected from s join sa using (t) join sb using (t) join tot using (t))"""


@query(and_(CLUSTERED, ARI) + "select t, round(case when most = expected then 1 else (s - expected) / (most - expected) end, 6) + 0.0 as ari from x")
def ari(spark, sf_dir):
    return metrics.ari(metrics.contingency(clustered(spark, sf_dir), ["t"]), ["t"]).select("t", six("ari"))


ACC = """full_ as (select tot.t, l.k as label, c.k as cluster, coalesce(tab.n, 0) as n from tot cross join (select unnest(range(5)) as k) l cross join (select unnest(range(5)) as k) c left join tab on tab.t = tot.t and tab.label = l.k and tab.cluster = c.k),
hits as (select a.t, max(a.n + b.n + c.n + d.n + e.n) as hit from full_ a join full_ b on b.t = a.t and b.label = 1 join full_ c on c.t = a.t and c.label = 2 join full_ d on d.t = a.t and d.label = 3 join full_ e on e.t = a.t and e.label = 4
  where a.label = 0 and b.cluster not in (a.cluster) and c.cluster not in (a.cluster, b.cluster) and d.cluster not in (a.cluster, b.cluster, c.cluster) and e.cluster not in (a.cluster, b.cluster, c.cluster, d.cluster) group by a.t)"""


@query(and_(CLUSTERED, ACC) + "select t, round(hit / total, 6) as acc from hits join tot using (t)")
def acc_hungarian(spark, sf_dir):
    return metrics.matched(metrics.contingency(clustered(spark, sf_dir), ["t"]), ["t"]).select("t", six("acc"))


@query("""with tab as (select quality as label, toxic as cluster, count(*) as n from labels where quality is not null and toxic is not null group by all),
c as (select label as c from tab union select cluster from tab),
f as (select c, coalesce((select sum(n) from tab where label = c), 0) as a, coalesce((select sum(n) from tab where cluster = c), 0) as b, coalesce((select sum(n) from tab where label = c and cluster = c), 0) as hit from c)
select round(avg(2 * hit / (a + b)), 6) as f1 from f""")
def f1_macro(spark, sf_dir):
    return metrics.f1_macro(metrics.contingency(table(spark, sf_dir, "labels"), [], "quality", "toxic"), []).select(six("f1"))


@query(and_(CLUSTERED, "k as (select t, count(distinct label) as k, count(*) as n from rows group by t)") + "select round(avg(k), 6) as label_count from k where n >= 2")
def label_count_avg(spark, sf_dir):
    return metrics.label_count_average(clustered(spark, sf_dir)).select(six("label_count"))


@query("""with a as (select event_type as pq, user_id % 20 as run, cast(ts as date) as t, avg(value) as score from events group by all), r as (select pq, run, avg(score) as score from a group by all)
select pq, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std from r group by pq""")
def metric_mean_std(spark, sf_dir):
    by_time = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pq"), (F.col("user_id") % 20).alias("run"), F.col("ts").cast("date").alias("t")).agg(F.avg("value").alias("score"))
    return by_time.groupBy("pq", "run").agg(F.avg("score").alias("score")).groupBy("pq").agg(F.round(F.avg("score"), 6).alias("mean"), F.round(F.stddev_pop("score"), 6).alias("std"))


WELCH = """with s as (select o_orderstatus as side, o_orderpriority as pq, avg(o_totalprice) as m, stddev_pop(o_totalprice) as sd from orders group by all),
j as (select a.pq, a.m as ma, a.sd * a.sd / 20 as va, b.m as mb, b.sd * b.sd / 20 as vb from s a join s b using (pq) where a.side = 'F' and b.side = 'O')
select pq, round((ma - mb) / sqrt(va + vb), 6) as welch_t, round((va + vb) * (va + vb) / (va * va / 19 + vb * vb / 19), 6) as welch_df, case when ma > mb then '>' else '<' end as direction from j"""


def compared_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").groupBy("o_orderstatus", F.col("o_orderpriority").alias("pq")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"))
    side = lambda status, s: found.where(F.col("o_orderstatus") == status).select("pq", F.col("mean").alias(f"mean_{s}"), F.col("std").alias(f"std_{s}"))
    return metrics.welch(side("F", "a").join(side("O", "b"), "pq"), 20)


@query(WELCH)
def welch_t(spark, sf_dir):
    return compared_prices(spark, sf_dir).select("pq", six("welch_t"), six("welch_df"), "direction")


@query()
def welch_p(spark, sf_dir):
    return metrics.one_tailed(compared_prices(spark, sf_dir)).select("pq", "p", "direction")


@query()
def kmeans_per_time(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("t"), F.col("vec_id").alias("i"), F.col("embedding").alias("emb"))
    return cluster.per_time(vectors, 3, starts=2)


@query()
def kmeans_pooled(spark, sf_dir):
    return cluster.pooled(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb")), 10).select("id", "cluster")


@query()
def evaluation_scores(spark, sf_dir):
    table_ = metrics.contingency(clustered(spark, sf_dir), ["t"])
    return metrics.nmi(table_, ["t"]).join(metrics.ari(table_, ["t"]), "t").join(metrics.matched(table_, ["t"]), "t").agg(*[F.avg(c).alias(c) for c in ("nmi", "ari", "acc", "f1")])


AVAILABLE = "found as (select distinct event_type as method, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as t, user_id % 10 as i from events)"


def available(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), day.alias("t"), (F.col("user_id") % 10).alias("i")).distinct()


COMMON = "common as (select t, i from found group by all having count(distinct method) = (select count(distinct method) from found))"


@query(sql.with_(AVAILABLE, COMMON) + "select t, i from common")
def common_available_nodes(spark, sf_dir):
    return metrics.common_available(available(spark, sf_dir))


@query(sql.with_(AVAILABLE, COMMON, "some_ as (select * from common where t % 3 > 0)") + "select method, t, i from found where (t, i) in (select (t, i) from some_) or t not in (select t from some_)")
def available_semi_join(spark, sf_dir):
    found = available(spark, sf_dir)
    return metrics.semi_available(found, metrics.common_available(found).where("t % 3 > 0")).select("method", "t", "i")


@query(sql.with_(AVAILABLE, "s as (select count(*) as n from (select distinct t, i from found))") + "select method, count(*) as n_available, round(count(*) / any_value(n), 6) as completion from found, s group by method")
def method_availability(spark, sf_dir):
    found = available(spark, sf_dir)
    return report.availability(found, found.select("t", "i").distinct()).select("method", "n_available", six("completion"))


@query("select label, cast(k - 1 as bigint) as k, round(avg(x), 5) as x from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as k from embeddings) group by label, k")
def mean_embedding_by_group(spark, sf_dir):
    found = metrics.mean_embedding(table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("emb")), ["label"])
    return found.select("label", F.posexplode("emb").alias("k", "x")).select("label", F.col("k").cast("long").alias("k"), F.round("x", 5).alias("x"))


# --- reports


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    found = joined.groupBy(F.col("l_returnflag").alias("dataset"), F.col("o_orderpriority").alias("method"))
    return found.agg((F.avg("l_discount") * 10).alias("acc"), (F.avg("l_tax") * 10).alias("nmi"), (F.avg("l_quantity") / 50).alias("ari"))


RECORDS = sql.with_(sql.SCORES)
METRICS = ["acc", "nmi", "ari"]


@query(RECORDS + "select method, round(avg(acc), 6) as acc, round(avg(nmi), 6) as nmi, round(avg(ari), 6) as ari, count(distinct dataset) as datasets from records group by method")
def method_summary(spark, sf_dir):
    return report.summary(records(spark, sf_dir), METRICS).select("method", *map(six, METRICS), "datasets")


@query(RECORDS + "select dataset, metric, method, round(value, 6) as value, place from placed where place <= 2")
def best_second_rank(spark, sf_dir):
    return report.best_second(report.long_form(records(spark, sf_dir), METRICS)).select("dataset", "metric", "method", six("value"), "place")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


@query(
    RECORDS
    + "select dataset, metric, "
    + ", ".join(f"""coalesce(max(case when method = '{m}' then case place when 1 then '**' || printf('%.4f', value) || '**' when 2 then '__' || printf('%.4f', value) || '__' else printf('%.4f', value) end end), 'N/A') as "{m}" """ for m in PRIORITIES)
    + "from placed group by all"
)
def result_pivot(spark, sf_dir):
    return report.pivoted(report.long_form(records(spark, sf_dir), METRICS), PRIORITIES)


@query(RECORDS + "select dataset, method, round(value, 6) as acc from placed where metric = 'ACC' and place = 1")
def best_method(spark, sf_dir):
    return report.best_by(records(spark, sf_dir), "acc").select("dataset", "method", six("acc"))


@query("""with p as (select embedding[1]::double as x, embedding[2]::double as y from embeddings), e as (select min(x) as a, max(x) as b, min(y) as c, max(y) as d from p)
select round(a - (b - a) * 0.05, 6) as x_min, round(b + (b - a) * 0.05, 6) as x_max, round(c - (d - c) * 0.05, 6) as y_min, round(d + (d - c) * 0.05, 6) as y_max from e""")
def plot_frame_limits(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").select(F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return report.frame_limits(points).select(*map(six, ("x_min", "x_max", "y_min", "y_max")))


# --- block models


MAPPINGS = [{0: 0, 1: 1, 2: 2}, {0: 0, 1: 0, 2: 1}, {0: 0}]
MODEL = """nodes as (select s_suppkey, cast(row_number() over (order by s_suppkey) - 1 as bigint) as i, cast(s_nationkey % 3 as bigint) as label from supplier),
lab as (select t, i, case when t = 1 then case label when 1 then 0 when 2 then 1 else label end else label end as label from nodes, (select unnest(range(3)) as t))"""


def model_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    index = dictionary.dense_index(suppliers, "s_suppkey", "i")
    return sbm.relabelled(suppliers.join(index, "s_suppkey").select("i", (F.col("s_nationkey") % 3).cast("long").alias("label")), MAPPINGS)


@query(sql.with_(MODEL) + "select t, i, label from lab")
def relabel_by_map(spark, sf_dir):
    return model_labels(spark, sf_dir)


@query(sql.with_(MODEL) + "select a.t, a.i, b.i as j, case when a.label = b.label then 0.5 else 0.2 end::double as prob from lab a join lab b on a.t = b.t and b.i <= a.i")
def sbm_probability(spark, sf_dir):
    return sbm.probabilities(model_labels(spark, sf_dir), 0.5, 0.2)


@query()
def sbm_sample(spark, sf_dir):
    return sbm.sampled(sbm.probabilities(model_labels(spark, sf_dir), 0.5, 0.2), 42)


@query()
def sbm_sweep(spark, sf_dir):
    """Synthetic graphs over a grid of p, embedded, clustered and scored: the mean over times, then mean and deviation over runs."""
    labels = sbm.relabelled(sbm.static_labels(spark, 60, [0.3, 0.4, 0.3], 42), MAPPINGS[:2])
    out = None
    for p in (0.6, 0.9):
        prob = sbm.probabilities(labels, p, 0.2)
        for run in range(2):
            g = Graph(sbm.sampled(prob, 42 + run))
            found = cluster.per_time(spectral.ulse_n1(g.n1(), g.nodes, g.rows, g.n, 3, g.length), {0: 3, 1: 2})
            score = metrics.nmi(metrics.contingency(found.join(labels, ["t", "i"]), ["t"]), ["t"]).agg(F.avg("nmi").alias("nmi"))
            row = score.select(F.lit(f"p{p}_q0.2").alias("pq"), F.lit(run).alias("run"), "nmi")
            out = row if out is None else out.unionByName(row)
    return out.groupBy("pq").agg(F.avg("nmi").alias("mean"), F.stddev_pop("nmi").alias("std"))


# --- text formats


@query(sql.with_(sql.USER_EVENT) + "select src, dst, time from edges")
def edge_text_round_trip(spark, sf_dir):
    path = new_path(spark, "edges-text")
    text.write_edges(user_event(spark, sf_dir), path)
    return text.read_edges(spark, path)


@query(CLUSTERED + "select u.t, u.i as node, coalesce(rows.label, 5) as label from (select a.t, b.i from (select distinct t from rows) a, (select distinct i from rows) b) u left join rows on rows.t = u.t and rows.i = u.i")
def label_text_round_trip(spark, sf_dir):
    rows = clustered(spark, sf_dir)
    nodes, times = rows.select("i").distinct(), rows.select("t").distinct()
    every = matrices.spine(nodes, times).join(rows, ["t", "i"], "left").select("t", F.col("i").alias("node"), F.coalesce("label", F.lit(5)).cast("long").alias("label"))
    path = new_path(spark, "labels-text")
    text.write_labels(every, path)
    return text.read_labels(spark, path, nodes.count())


@query("select vec_id as node, cast(0 as bigint) as t, round(embedding[1]::double, 6) as a, round(embedding[64]::double, 6) as b from embeddings")
def embedding_text_round_trip(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.lit(0).cast("long").alias("t"), F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("emb"))
    path = new_path(spark, "emb-text")
    text.write_embeddings(vectors, path)
    return text.read_embeddings(spark, path).select("node", "t", F.round(F.col("emb")[0], 6).alias("a"), F.round(F.col("emb")[63], 6).alias("b"))


@query("select date_trunc('day', ts) as start, user_id as src, count(*) as events from events group by all")
def streaming_snapshots(spark, sf_dir):
    stream = snapshots.stream_events(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("src"), F.col("event_type").alias("dst"))
    return snapshots.run_snapshot_counts(stream)
