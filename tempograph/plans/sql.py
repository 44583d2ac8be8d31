"""The graphs and matrices of the queries as DuckDB common table expressions."""

from __future__ import annotations

COSUPPLY = """
supplied as (select distinct l_orderkey as k, l_suppkey as s from lineitem),
edges as (select distinct a.s as src, b.s as dst, cast(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 as double) as time
          from supplied a join supplied b on a.k = b.k and a.s < b.s join orders on o_orderkey = a.k)"""

USER_EVENT = """
kinds as (select event_type, row_number() over (order by event_type) + 1000000000 as kind from (select distinct event_type from events)),
edges as (select user_id as src, cast(kind as bigint) as dst, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as double) as time
          from events join kinds using (event_type))"""

NATION_TRADE = """
edges as (select cast(c_nationkey as bigint) as src, cast(s_nationkey as bigint) as dst, cast(year(o_orderdate) as double) as time, cast(count(*) as double) as w
          from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey group by all)"""

INDEX = """
nodes as (select node, cast(row_number() over (order by node) - 1 as bigint) as i from (select src as node from edges union select dst from edges)),
times as (select time, cast(row_number() over (order by time) - 1 as bigint) as t from (select distinct time from edges)),
ix as (select t, a.i as src, b.i as dst from edges join times using (time) join nodes a on a.node = edges.src join nodes b on b.node = edges.dst),
adj as (select t, src as i, dst as j, cast(1 as double) as w from ix union select t, dst, src, 1.0 from ix),
spine as (select t, i from times, nodes),
size as (select (select count(*) from nodes) as n, (select count(*) from times) as len),
deg as (select spine.t, spine.i, coalesce(sum(w), 0.0) as deg from spine left join adj on adj.t = spine.t and adj.i = spine.i group by all)"""

CONST = "dreg as materialized (select t, i, deg + 0.1 as deg from deg), areg as materialized (select i, sum(deg) + 0.1 as deg from deg group by i)"

N1 = """
n1 as (select t, i, j, sum(val) as val from (
         select adj.t, adj.i, adj.j, -w / sqrt(a.deg) / sqrt(b.deg) as val from adj join dreg a on a.t = adj.t and a.i = adj.i join dreg b on b.t = adj.t and b.i = adj.j
         union all select t, i, i, 1.0 from dreg) group by all)"""

N2 = """
n2 as (select adj.t, adj.i, adj.j, -w / sqrt(a.deg) / sqrt(b.deg) as val from adj join areg a on a.i = adj.i join dreg b on b.t = adj.t and b.i = adj.j)"""

LAPLACIAN = """
lap as (select t, i, j, sum(val) as val from (select t, i, j, -w as val from adj union all select t, i, i, deg from deg) group by all)"""


def gram(cells: str, val: str = "val") -> str:
    return f"""
select a.i, b.i as j, round(sum(a.{val} * b.{val}), 6) + 0.0 as val from {cells} a join {cells} b on a.t = b.t and a.j = b.j and a.i <= b.i group by all"""


def vectors(cells: str, val: str, count: int, bound: str | None = None, squarings: int = 22) -> str:
    """vec(k, i, u, lam): the Gram matrix's eigenvectors of the `count` greatest eigenvalues, or, with a bound on them, of the
    smallest ones; k from 0. A power 2**squarings of the matrix is the first one's projector; each next one is that of
    what is left. Signs are such that the largest entry (the first of equals) is positive."""
    own = f"select a.i, b.i as j, sum(a.{val} * b.{val}) as v from {cells} a join {cells} b on a.t = b.t and a.j = b.j group by all"
    if bound:
        own = f"select a.i, b.i as j, case when a.i = b.i then {bound} else 0 end - coalesce(g.v, 0) as v from nodes a join nodes b on true left join ({own}) g on g.i = a.i and g.j = b.i"
    parts = [f"g0 as materialized ({own})"]
    for k in range(count):
        parts.append(f"p{k}_0 as materialized (select i, j, v / (select sum(v * v) from g{k}) ** 0.5 as v from g{k})")
        for n in range(squarings):
            parts.append(f"p{k}_{n + 1} as materialized (select a.i, b.j, sum(a.v * b.v) / (select sum(v * v) from p{k}_{n}) as v from p{k}_{n} a join p{k}_{n} b on a.j = b.i group by all)")
        last = f"p{k}_{squarings}"
        parts.append(f"w{k} as materialized (select a.i, a.v / sqrt(b.v) as u from {last} a join (select i, v from {last} where i = j order by v desc, i limit 1) b on a.j = b.i)")
        parts.append(f"l{k} as materialized (select sum(a.u * g.v * b.u) / (select sum(u * u) from w{k}) as lam from g{k} g join w{k} a on a.i = g.i join w{k} b on b.i = g.j)")
        parts.append(f"u{k} as materialized (select i, u / (select sqrt(sum(u * u)) from w{k}) * (select case when u < 0 then -1 else 1 end from w{k} order by round(abs(u) / (select sqrt(sum(u * u)) from w{k}), 12) desc, i limit 1) as u from w{k})")
        parts.append(f"g{k + 1} as materialized (select g.i, g.j, g.v - lam * a.u * b.u as v from g{k} g join u{k} a on a.i = g.i join u{k} b on b.i = g.j, l{k})")
    lam = f"{bound} - lam" if bound else "lam"
    return ", ".join([*parts, "vec as (" + " union all ".join(f"select {k} as k, i, u, {lam} as lam from u{k}, l{k}" for k in range(count)) + ")"])


def embedded(cells: str, weight: str, k: str, where: str = "true") -> str:
    """(t, i, k, x): the sum over a column's entries of weight times u, by the fourth root of the eigenvalue, for every row of the spine."""
    return f""" select s.t, s.i, cast(s.k as bigint) as k, round(coalesce(x, 0), 6) + 0.0 as x from (select t, spine.i, {k} as k from spine, (select distinct k from vec) where {where}) s
left join (select c.t, c.j, {k} as k, sum({weight} * u / lam ** 0.25) as x from {cells} c join vec on vec.i = c.i where {where} group by all) f on f.t = s.t and f.j = s.i and f.k = s.k"""


def supra(normalized: bool) -> str:
    blocks = "n1" if normalized else "lap"
    swap = "(select t, i, n from spine, size where t < len - 1)"
    cells = f"""
cells as (select row, col, sum(val) as val from (
  select t * n + i as row, t * n + j as col, val from {blocks}, size
  union all select t * n + i, (t + 1) * n + i, -1.0 from {swap}
  union all select (t + 1) * n + i, t * n + i, -1.0 from {swap}
  union all select t * n + i, t * n + i, 1.0 from {swap}
  union all select (t + 1) * n + i, (t + 1) * n + i, 1.0 from {swap}) group by all)"""
    if not normalized:
        return cells + " select row, col, round(val, 6) + 0.0 as val from cells"
    return cells + """,
roots as (select row, case when round(sum(val), 9) > 0 then 1 / sqrt(round(sum(val), 9)) else 0 end as r from cells group by row)
select cells.row, cells.col, round(val * a.r * b.r, 6) + 0.0 as val from cells join roots a on a.row = cells.row join roots b on b.row = cells.col"""


def sweep(normalized: bool, every: int = 1) -> str:
    """Prefixes of the order by degree, as swept(t, i, r, edges, swaps, balance)."""
    if normalized:
        own = """d * (v - 2 * (sum(d) over (partition by t order by r) - d) - d)"""
    else:
        own = "n - 2 * (count(*) over (partition by t order by r) - 1) - 1"
    return f"""
ranked as (select t, i, row_number() over (order by deg, t, i) as r0 from deg),
ord as (select t, i, (r0 - 1) // {every} + 1 as r from ranked where (r0 - 1) % {every} = 0),
cut as (select a.t, a.i, sum(case when b.r < a.r then -w else w end) as e from adj join ord a on a.t = adj.t and a.i = adj.i left join ord b on b.t = adj.t and b.i = adj.j where adj.i <> adj.j group by all),
vol as (select t, sum(deg) as v from deg group by t),
placed as (select a.t, a.i, a.r, n, coalesce(cut.e, 0.0) as e, dd.deg as d, vol.v as v,
    case when a.t > 0 then case when p.r < a.r then -1.0 else 1.0 end else 0.0 end + case when a.t < len - 1 then case when q.r < a.r then -1.0 else 1.0 end else 0.0 end as s
  from ord a join size on true join deg dd on dd.t = a.t and dd.i = a.i join vol on vol.t = a.t
  left join cut on cut.t = a.t and cut.i = a.i left join ord p on p.t = a.t - 1 and p.i = a.i left join ord q on q.t = a.t + 1 and q.i = a.i),
stepped as (select *, {own} as b from placed),
swept as (select t, i, r, sum(e) over w as edges, cast(sum(s) over w as double) as swaps, sum(b) over w as balance from stepped window w as (order by r)),
best as (select r, (edges + swaps) / balance as score, edges, swaps from swept where balance > 0 order by score, r limit 1)"""


#: Users' days: the label is the number of the first event type in the alphabet, the cluster a remainder of the last event's id.
CLUSTERED = """
ranked as (select event_type, cast(row_number() over (order by event_type) - 1 as bigint) as k from (select distinct event_type from events)),
rows as (select cast(date_diff('day', date '2024-01-01', cast(ts as date)) as bigint) as t, user_id as i, min(k) as label, max(event_id) % 5 as cluster
         from events join ranked using (event_type) group by all),
tab as (select t, label, cluster, count(*) as n from rows group by all),
ma as (select t, label, cast(sum(n) as bigint) as a from tab group by all), mb as (select t, cluster, cast(sum(n) as bigint) as b from tab group by all), tot as (select t, cast(sum(n) as bigint) as total from tab group by t)"""

SCORES = """
records as (select l_returnflag as dataset, o_orderpriority as method, avg(l_discount) * 10 as acc, avg(l_tax) * 10 as nmi, avg(l_quantity) / 50 as ari
            from lineitem join orders on o_orderkey = l_orderkey group by all),
scores as (select dataset, method, 'ACC' as metric, acc as value from records union all select dataset, method, 'NMI', nmi from records union all select dataset, method, 'ARI', ari from records),
placed as (select *, row_number() over (partition by dataset, metric order by value desc, method) as place from scores)"""


def with_(*parts: str) -> str:
    return "with " + ",".join(parts) + " "
