"""Derived views that give the engine realistic input over the driver's tables.

Customers are users, parts films, supplier names cast, brands directors, words of part names genres, order priorities
lists, and events a discovery stream. Both Spark and DuckDB read this SQL as it stands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palate.sources.shared import shared_table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")

VIEWS = {
    "interactions": """
select username, slug, rating, watched, watchlisted, liked, scraped_at from (
 select concat('u', cast(o_custkey as string)) as username, concat('f', cast(l_partkey as string)) as slug,
  case when l_returnflag in ('A','R') then cast(ceil(l_quantity / 5.0) as double) / 2 end as rating,
  (l_returnflag in ('A','R') or l_linestatus = 'F') as watched,
  (l_returnflag = 'N' and l_linestatus = 'O') as watchlisted,
  (l_discount >= 0.08) as liked,
  l_shipdate as scraped_at,
  row_number() over (partition by o_custkey, l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, l_extendedprice desc) as rn
 from lineitem join orders on l_orderkey = o_orderkey) x where rn = 1
""",
    "interactions_dense": """
select username, slug, rating, watched, watchlisted, liked, scraped_at from (
 select concat('u', cast(cast(floor(o_custkey / 3.0) as bigint) * 3 as string)) as username,
  concat('f', cast(cast(floor(l_partkey / 3.0) as bigint) * 3 as string)) as slug,
  case when l_returnflag in ('A','R') then cast(ceil(l_quantity / 5.0) as double) / 2 end as rating,
  (l_returnflag in ('A','R') or l_linestatus = 'F') as watched,
  (l_returnflag = 'N' and l_linestatus = 'O') as watchlisted,
  (l_discount >= 0.08) as liked,
  l_shipdate as scraped_at,
  row_number() over (partition by cast(floor(o_custkey / 3.0) as bigint), cast(floor(l_partkey / 3.0) as bigint) order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_suppkey desc, l_partkey desc, l_extendedprice desc) as rn
 from lineitem join orders on l_orderkey = o_orderkey) x where rn = 1
""",
    "films": """
select concat('f', cast(p_partkey as string)) as slug, p_name as title,
  cast(1950 + (p_partkey * 7) % 75 as int) as year,
  s.avg_rating, (coalesce(s.n, 0) - 10) * (coalesce(s.n, 0) - 10) * 25 as rating_count
from part left join (select l_partkey, count(*) as n,
   avg(case when l_returnflag in ('A','R') then cast(ceil(l_quantity / 5.0) as double) / 2 end) as avg_rating
   from lineitem group by l_partkey) s on p_partkey = s.l_partkey
""",
    "film_attrs": """
with ps as (select l_partkey, l_suppkey, row_number() over (partition by l_partkey order by l_suppkey) as pos
            from (select distinct l_partkey, l_suppkey from lineitem) d)
select concat('f', cast(p_partkey as string)) as slug, 'genre' as attr_type, split_part(p_name,' ',1) as attr_value, 1 as pos from part
union all select concat('f', cast(p_partkey as string)), 'genre', split_part(p_name,' ',2), 2 from part where split_part(p_name,' ',2) <> split_part(p_name,' ',1)
union all select concat('f', cast(p_partkey as string)), 'director', p_brand, 1 from part
union all select concat('f', cast(p_partkey as string)), 'director', concat('Brand#', cast(1 + (p_partkey % 25) as string)), 2 from part where p_size % 10 = 0 and p_brand <> concat('Brand#', cast(1 + (p_partkey % 25) as string))
union all select concat('f', cast(l_partkey as string)), 'actor', s_name, cast(pos as int) from ps join supplier on l_suppkey = s_suppkey where pos <= 10
union all select concat('f', cast(p_partkey as string)), 'theme', lower(p_type), 1 from part
union all select slug, 'country', n_name, cast(row_number() over (partition by slug order by p) as int) from (select concat('f', cast(l_partkey as string)) as slug, n_name, min(pos) as p from ps join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where pos <= 4 group by l_partkey, n_name) c
union all select slug, 'language', r_name, cast(row_number() over (partition by slug order by p) as int) from (select concat('f', cast(l_partkey as string)) as slug, r_name, min(pos) as p from ps join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where pos <= 2 group by l_partkey, r_name) c
union all select concat('f', cast(p_partkey as string)), 'writer', concat('W', cast(p_size as string)), 1 from part
union all select concat('f', cast(p_partkey as string)), 'cinematographer', concat('C', cast(p_partkey % 40 as string)), 1 from part
union all select concat('f', cast(p_partkey as string)), 'composer', concat('M', cast(p_partkey % 60 as string)), 1 from part
""",
    "user_lists": """
select concat('u', cast(o_custkey as string)) as username, lower(o_orderpriority) as list_slug,
  (o_orderpriority = '1-URGENT') as is_favorites, (o_orderpriority = '2-HIGH') as is_ranked,
  case when o_orderpriority = '2-HIGH' then cast(row_number() over (partition by o_custkey, o_orderpriority order by p, l_partkey) as int) end as position,
  concat('f', cast(l_partkey as string)) as film_slug
from (select o_custkey, o_orderpriority, l_partkey, min(l_orderkey * 10 + l_linenumber) as p from lineitem join orders on l_orderkey = o_orderkey
      where o_orderpriority <> '5-LOW' group by o_custkey, o_orderpriority, l_partkey) z
""",
    "user_follows": """
select concat('u', cast(c_custkey as string)) as follower, concat('u', cast(f as string)) as followee from (
 select c_custkey, (c_custkey * 7 + 1) % n as f from customer cross join (select count(*) as n from customer) q
 union select c_custkey, (c_custkey * 13 + 5) % n from customer cross join (select count(*) as n from customer) q) g where c_custkey <> f
""",
    "discovered": """
select concat('e', cast(user_id as string)) as username, case event_type when 'view' then 'film' when 'click' then 'popular' when 'purchase' then 'film_reviews' when 'signup' then 'followers' else 'manual' end as source_type, ts as discovered_at, event_id from events
""",
}
VIEWS["groups"] = """
select concat('g', cast(cast(floor(c_custkey / 3.0) as bigint) as string)) as group_id, concat('u', cast(c_custkey as string)) as username,
  case when c_custkey % 3 = 0 then cast(2.0 as double) else cast(1.0 as double) end as weight
from customer
"""


class Views:
    """The driver's tables and the derived views of one folder, each as a DataFrame when it is asked for.

    stored: a view, and what once() names, is written as a shared table when it is first asked for; queries that read
    one several times derive it once so."""

    def __init__(self, spark: SparkSession, sf_dir: str, stored: bool = False):
        self.spark, self.sf_dir, self.stored = spark, sf_dir, stored
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = shared_table(make(), name) if self.stored else make()
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name not in VIEWS:
            raise AttributeError(name)
        used = {t: self.table(t) for t in TABLES if t in VIEWS[name]}
        return self.once(name, lambda: self.spark.sql(_braced(VIEWS[name]), **used))


def _braced(sql: str) -> str:
    """Table names in braces, as spark.sql takes DataFrames."""
    import re

    return re.sub(r"\b(from|join)\s+(" + "|".join(TABLES) + r")\b", r"\1 {\2} as \2", sql)


def with_views(*names: str) -> str:
    """The views as common table expressions, for DuckDB."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in names) + "\n"
