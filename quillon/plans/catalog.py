"""The registered queries over the operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, text
from ..operators import chaos, compare, generate, joint, multivariate, privacy, profile, quality, relational, resolve, sampling, simulate, univariate, windows, zones
from ..operators.generate import Stream, Table
from ..operators.quality import Rule
from ..streaming import windows as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to so many places: what two engines' summation orders leave equal."""
    return df.select(*[F.round(F.col(f"`{n}`"), places).alias(n) if k in ("double", "float") else F.col(f"`{n}`") for n, k in df.dtypes])


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates as ISO text, which every engine's results compare alike."""
    return df.select(*[F.date_format(F.col(f"`{n}`"), "yyyy-MM-dd").alias(n) if k == "date" else F.col(f"`{n}`") for n, k in df.dtypes])


# --- profiles ---------------------------------------------------------------------------------------------------

NUMERIC_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]


def numeric_sql(table: str, columns: list[str]) -> str:
    one = """select '{c}' as "column", count(*) as rows, count(*) filter (where {c} is null) as nulls, 0::bigint as nans, 0::bigint as infinite,
count(*) filter (where {c} = 0) as zeros, count(*) filter (where {c} < 0) as negative, count(distinct {c}) as "distinct",
round(min({c})::double, 8) as min, round(max({c})::double, 8) as max, round(avg({c})::double, 8) as mean, round(stddev_samp({c})::double, 8) as sd,
round(quantile_cont({c}::double, 0.25), 8) as p25, round(quantile_cont({c}::double, 0.5), 8) as p50, round(quantile_cont({c}::double, 0.75), 8) as p75 from {t}"""
    return "\nunion all\n".join(one.format(c=c, t=table) for c in columns)


@query(numeric_sql("lineitem", NUMERIC_COLUMNS))
def profile_lineitem(spark, d):
    return rounded(profile.numeric_profile(t(spark, d, "lineitem"), NUMERIC_COLUMNS), 8)


@query(numeric_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"]))
def profile_customer(spark, d):
    return rounded(profile.numeric_profile(t(spark, d, "customer")), 8)


@query("\nunion all\n".join(f"""select '{c}' as "column", count(*) as rows, count(*) filter (where {c} is null) as nulls, count(*) filter (where {c} = '') as empty,
count(*) filter (where trim({c}) = '') as blank, count(distinct {c}) as "distinct", min(length({c})) as min_length, max(length({c})) as max_length,
round(avg(length({c})), 6) as mean_length, round(stddev_samp(length({c})), 6) as sd_length from part""" for c in ("p_name", "p_brand", "p_type")))
def profile_text(spark, d):
    return rounded(profile.text_profile(t(spark, d, "part"), ["p_name", "p_brand", "p_type"]))


@query("""with x as (select ts from events), parts as (
select 'hour' as part, hour(ts)::int as value from x union all select 'weekday', (isodow(ts) - 1)::int from x
union all select 'month', month(ts)::int from x union all select 'year', year(ts)::int from x)
select part, value, count(*) as count from parts group by part, value""")
def profile_temporal(spark, d):
    return profile.temporal_profile(t(spark, d, "events"), "ts")


@query("""with x as (select 'l_returnflag' as "column", l_returnflag as value from lineitem union all select 'l_linestatus', l_linestatus from lineitem
union all select 'l_linenumber', l_linenumber::varchar from lineitem), c as (select "column", value, count(*) as count from x group by all)
select "column", rank, value, count from (select *, row_number() over (partition by "column" order by count desc, value)::int as rank from c) where rank <= 5""")
def top_values(spark, d):
    return profile.top_values(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], 5)


@query("""select skeleton, count(*) as count from (select regexp_replace(regexp_replace(regexp_replace(c_name, '\\p{L}+', 'A', 'g'), '\\d+', 'D', 'g'), '#+', '#', 'g') as skeleton from customer)
group by skeleton order by count desc, skeleton limit 10""")
def value_skeletons(spark, d):
    return profile.skeletons(t(spark, d, "customer"), "c_name")


@query("\nunion all\n".join(f"""select 'url' as "column", '{n}' as pattern, count(*) filter (where regexp_matches(url, '{p.replace("'", "''")}')) as matches,
round(avg(regexp_matches(url, '{p.replace("'", "''")}')::int), 6) as share from pages where url is not null""" for n, p in text.PATTERNS.items()))
def pattern_rates(spark, d):
    return rounded(profile.pattern_profile(t(spark, d, "pages"), ["url"]))


@query("""select min(len(embedding)) as min, max(len(embedding)) as max, avg(len(embedding)) as mean, stddev_pop(len(embedding)) as sd,
quantile_cont(len(embedding), 0.5)::double as p50, quantile_cont(len(embedding), 0.95)::double as p95, count(*) filter (where embedding is null) as nulls,
count(*) filter (where len(embedding) = 0) as empty, 0::bigint as null_elements from embeddings""")
def list_lengths(spark, d):
    return profile.length_profile(t(spark, d, "embeddings"), "embedding")


@query("""select count(*) as n, round(avg(v), 4) as mean, round(min(v)::double, 6) as min, round(max(v)::double, 6) as max from (select unnest(embedding)::double as v from embeddings)""")
def nested_elements(spark, d):
    values = profile.nested_children(t(spark, d, "embeddings"))["embedding[].element"]
    v = F.col("value").cast("double")
    return values.agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.min(v), 6).alias("min"), F.round(F.max(v), 6).alias("max"))


@query("\nunion all\n".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 4) as r from lineitem" for a, b in [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")]))
def correlations(spark, d):
    return profile.correlations(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("select round(entropy(event_type), 6) as entropy from events")
def entropy(spark, d):
    return rounded(profile.entropy(t(spark, d, "events"), "event_type"))


@query("""with x as (select case when l_tax > 0.02 then l_tax end as a, case when l_discount > 0.02 then l_discount end as b from lineitem)
select count(*) filter (where a is null and b is null) as "both", count(*) filter (where a is null and b is not null) as only_a, count(*) filter (where a is not null and b is null) as only_b,
count(*) filter (where a is not null and b is not null) as neither, round(corr((a is null)::int::double, (b is null)::int::double), 6) as phi from x""")
def missing_together(spark, d):
    li = t(spark, d, "lineitem").select(F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("a"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("b"))
    return rounded(profile.missing_together(li, "a", "b"))


@query("""select 'orders' as "table", 'o_orderkey' as "column", true as named where (select count(distinct o_orderkey) = count(*) from orders)""")
def primary_key(spark, d):
    return profile.keys_of(t(spark, d, "orders"), "orders")


@query("""with v as (select distinct o_custkey as v from orders where o_custkey is not null), k as (select count(*) as n, count(c_custkey) as f from v left join customer on v = c_custkey)
select n as "distinct", f as found, f / n as share, f / n >= 0.9 as is_fk from k""")
def foreign_key(spark, d):
    return profile.foreign_key(t(spark, d, "orders"), "o_custkey", t(spark, d, "customer"), "c_custkey")


@query("""select 'l_quantity' as "column", count(*) as n, 0.0::double as null_rate, 0.0::double as null_rate_se, round(1 - pow(0.05, 1.0 / count(*)), 9) as min_detectable_share,
case when count(*) >= 1000 then 'adequate' when count(*) >= 30 then 'limited' else 'insufficient' end as grade from lineitem""")
def adequacy(spark, d):
    return rounded(profile.adequacy(t(spark, d, "lineitem"), ["l_quantity"]), 9)


@query("""select 'o_totalprice' as "column", count(*) as n, 0.0::double as "boolean", 0.0::double as "integer", 1.0::double as "float", 0.0::double as "date", 0.0::double as "datetime", 'float' as inferred from orders
union all select 'o_orderkey', count(*), 0.0, 1.0, 1.0, 0.0, 0.0, 'integer' from orders union all select 'o_orderpriority', count(*), 0.0, 0.0, 0.0, 0.0, 0.0, 'string' from orders""")
def type_inference(spark, d):
    o = t(spark, d, "orders").select(F.format_string("%.2f", "o_totalprice").alias("o_totalprice"), F.concat(F.lit("0000"), F.col("o_orderkey").cast("string")).alias("o_orderkey"), "o_orderpriority")
    return profile.infer_types(o, ["o_totalprice", "o_orderkey", "o_orderpriority"])


@query()
def bounded_profile(spark, d):
    return profile.read_sketches(profile.bounded_profile(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query()
def merged_profile(spark, d):
    li = t(spark, d, "lineitem")
    halves = [profile.bounded_profile(li.where(F.col("l_orderkey") % 2 == k), ["l_quantity", "l_extendedprice"]) for k in (0, 1)]
    return profile.read_sketches(profile.merge_profiles(*halves))


# --- joint ------------------------------------------------------------------------------------------------------

@query("select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by all")
def contingency(spark, d):
    return joint.contingency(t(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


ASSOCIATION_SQL = """with c as (select o_orderstatus as a, o_orderpriority as b, count(*)::double as n from orders group by all),
m as (select *, sum(n) over (partition by a) as na, sum(n) over (partition by b) as nb, sum(n) over () as tot from c),
r as (select max(tot) as t, sum(n / tot * ln(n * tot / (na * nb))) as mi, max(tot) * (sum(n * n / (na * nb)) - 1) as chi2, count(distinct a)::double as ka, count(distinct b)::double as kb from m),
h as (select (select -sum(na / tot * ln(na / tot)) from (select distinct a, na, tot from m)) as ha, (select -sum(nb / tot * ln(nb / tot)) from (select distinct b, nb, tot from m)) as hb)
select t::bigint as n, round(greatest(0, mi), 6) as mutual_information, round(least(1, coalesce(sqrt(greatest(0, chi2 / t - (ka - 1) * (kb - 1) / (t - 1)) / (least(ka - pow(ka - 1, 2) / (t - 1), kb - pow(kb - 1, 2) / (t - 1)) - 1)), 0)), 6) as cramers_v,
round(chi2, 4) as chi2, round(case when ha > 1e-12 then greatest(0, mi) / ha else 0 end, 6) as u_ab, round(case when hb > 1e-12 then greatest(0, mi) / hb else 0 end, 6) as u_ba, ka::bigint as levels_a, kb::bigint as levels_b from r, h"""


@query(ASSOCIATION_SQL)
def associations(spark, d):
    return rounded(joint.associations(t(spark, d, "orders"), "o_orderstatus", "o_orderpriority").withColumn("chi2", F.round("chi2", 4)))


@query("""with g as (select l_returnflag as g, count(*) as n, avg(l_extendedprice) as m from lineitem group by 1)
select sum(n)::bigint as n, round(sqrt(sum(n * pow(m - (select avg(l_extendedprice) from lineitem), 2)) / (select var_pop(l_extendedprice) * count(*) from lineitem)), 6) as eta from g""")
def correlation_ratio(spark, d):
    return rounded(joint.correlation_ratio(t(spark, d, "lineitem"), "l_returnflag", "l_extendedprice"))


@query("""with p as (select n_nationkey, n_regionkey, count(*) as n from nation group by all), g as (select n_nationkey, sum(n) as n, max(n) as top, count(*) as k from p group by 1)
select sum(n)::bigint as rows, count(*) as groups, count(*) filter (where n > 1) as repeated_groups, count(*) filter (where k > 1) as violating_groups, round(sum(top) / sum(n), 6)::double as confidence,
round((select max(c) from (select count(*) as c from nation group by n_regionkey)) / sum(n), 6)::double as baseline, 1.0::double as lift from g""")
def functional_dependency(spark, d):
    return rounded(joint.functional_dependency(t(spark, d, "nation"), ["n_nationkey"], "n_regionkey"))


@query("""with p as (select l_suppkey as a, l_returnflag as y, count(*) as n from lineitem group by all), g as (select a, sum(n) as n, max(n) as top, count(*) as k from p group by 1),
b as (select max(c)::double as m from (select count(*) as c from lineitem group by l_returnflag))
select sum(n)::bigint as rows, count(*) as groups, count(*) filter (where n > 1) as repeated_groups, count(*) filter (where k > 1) as violating_groups, round(sum(top) / sum(n), 6)::double as confidence,
round(max(m) / sum(n), 6) as baseline, round((sum(top) / sum(n) - max(m) / sum(n)) / (1 - max(m) / sum(n)), 6) as lift from g, b""")
def weak_dependency(spark, d):
    return rounded(joint.functional_dependency(t(spark, d, "lineitem"), ["l_suppkey"], "l_returnflag"))


@query("""select count(*) as rows, count(distinct (l_orderkey, l_linenumber)) as "distinct", count(*) filter (where l_orderkey is null or l_linenumber is null) as with_null,
count(*) = count(distinct (l_orderkey, l_linenumber)) as is_key from lineitem""")
def candidate_key(spark, d):
    return joint.candidate_key(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""with x as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as a, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 as b from lineitem)
select round(corr(a, b), 6) as rho from x""")
def spearman(spark, d):
    return rounded(joint.spearman(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("""select p_size, count(*) as n, round(max(r), 1) as rank from (select p_size, rank() over (order by p_size) + (count(*) over (partition by p_size) - 1) / 2 as r from part) group by 1""")
def average_ranks(spark, d):
    r = joint.average_ranks(t(spark, d, "part"), "p_size")
    return r.groupBy("p_size").agg(F.count("*").alias("n"), F.round(F.max("rank_p_size"), 1).alias("rank"))


@query("select l_linestatus as category, count(*) as n, round(avg(l_quantity), 6) as mean, round(stddev_samp(l_quantity), 6) as sd from lineitem group by 1 having count(*) >= 20")
def conditional_means(spark, d):
    return rounded(joint.conditional_means(t(spark, d, "lineitem"), "l_linestatus", "l_quantity"))


@query("""with e as (select list_distinct([""" + ", ".join(f"quantile_cont(l_quantity, {k / 10})" for k in range(1, 10)) + """]) as edges from lineitem)
select len(list_filter(edges, lambda x: x <= l_quantity))::int as code, count(*) as n from lineitem, e group by 1""")
def quantile_codes(spark, d):
    return joint.quantile_codes(t(spark, d, "lineitem"), "l_quantity").groupBy(F.col("code_l_quantity").alias("code")).agg(F.count("*").alias("n"))


@query("select count(*) as rows, count(*) filter (where l_linestatus not in ('F')) as violations from lineitem where l_returnflag = 'R'")
def implies(spark, d):
    return joint.implies(t(spark, d, "lineitem"), "l_returnflag", "R", "l_linestatus", ["F"])


@query()
def kendall(spark, d):
    return rounded(joint.kendall(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_orderkey"))


# --- relational -------------------------------------------------------------------------------------------------

@query("select o_orderkey, o_custkey, c_name, c_acctbal from orders left join customer on o_custkey = c_custkey")
def left_join(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return relational.left_join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), c, {"o_custkey": "c_custkey"}).drop("c_custkey")


@query("select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber) as n from lineitem) where n = 1")
def first_per_key(spark, d):
    return relational.first_per_key(t(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber"]).select("l_suppkey", "l_orderkey", "l_linenumber")


SOME_CUSTOMERS = "(select * from customer where c_nationkey <> 3)"


@query(f"select o_orderkey, o_custkey from orders where o_custkey is not null and o_custkey not in (select c_custkey from {SOME_CUSTOMERS})")
def orphans(spark, d):
    return relational.orphans(t(spark, d, "orders"), "o_custkey", t(spark, d, "customer").where("c_nationkey <> 3"), "c_custkey").select("o_orderkey", "o_custkey")


@query("select o_orderkey from orders where o_custkey % 7 = 0 or o_custkey not in (select c_custkey from customer)")
def integrity_violations(spark, d):
    o = t(spark, d, "orders").withColumn("o_custkey", F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey")))
    return relational.integrity_violations(o, "o_custkey", t(spark, d, "customer"), "c_custkey").select("o_orderkey")


@query(f"""with p as {SOME_CUSTOMERS}, c as (select o_custkey, exists (select 1 from p where c_custkey = o_custkey) as found from orders)
select (select count(*) from p) as parents, count(distinct o_custkey) filter (where found) as covered, round(count(distinct o_custkey) filter (where found) / (select count(*) from p), 6) as coverage, count(*) as children,
round(count(*) filter (where found) / (select count(*) from p), 6) as mean_children, count(*) filter (where not found) as orphans, round(count(*) filter (where not found) / count(*), 6) as orphan_rate from c""")
def coverage(spark, d):
    return rounded(relational.coverage(t(spark, d, "orders"), "o_custkey", t(spark, d, "customer").where("c_nationkey <> 3"), "c_custkey"))


@query("select o_orderkey, c_mktsegment from orders left join customer on o_custkey = c_custkey")
def lookup(spark, d):
    return relational.lookup(t(spark, d, "orders"), "o_custkey", t(spark, d, "customer"), "c_custkey", ["c_mktsegment"]).select("o_orderkey", "c_mktsegment")


def children_sql(how: str) -> str:
    return f"select o_orderkey, coalesce(round_even({how}(l_quantity)::double * 100, 0) / 100, 0)::double as value from orders left join lineitem on l_orderkey = o_orderkey group by 1"


for _how in ("sum", "count", "avg", "min", "max"):

    def _children(spark, d, how=_how):
        made = relational.children(t(spark, d, "orders").select("o_orderkey"), "o_orderkey", t(spark, d, "lineitem"), "l_orderkey", "l_quantity", how, "value")
        return made.withColumn("value", F.col("value").cast("double"))

    _children.__name__ = f"children_{_how}"
    query(children_sql(_how))(_children)


@query("""select strftime(x, '%Y%m%d')::int as date_key, x::date::varchar as date, year(x)::int as year, quarter(x)::int as quarter, month(x)::int as month, monthname(x) as month_name, day(x)::int as day, isodow(x)::int as weekday, dayname(x) as weekday_name,
dayofyear(x)::int as day_of_year, weekofyear(x)::int as iso_week, isodow(x) >= 6 as is_weekend, year(x - interval 6 month)::int as fiscal_year, quarter(x - interval 6 month)::int as fiscal_quarter from range(date '1995-01-01', date '1998-01-01', interval 1 day) r(x)""")
def date_dimension(spark, d):
    return iso_dates(relational.date_dimension(spark, "1995-01-01", "1997-12-31", fiscal_month=7))


DIMENSION_SQL = """select row_number() over (order by c_custkey) as sk_customer, c_custkey, c_name, n_name as n_n_name, r_name as r_r_name from customer left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey"""


def customer_dimension(spark, d):
    nation = relational.left_join(t(spark, d, "nation"), t(spark, d, "region"), {"n_regionkey": "r_regionkey"}, prefix="r_")
    dim = relational.dimension(t(spark, d, "customer"), "c_custkey", "customer", [(nation, "c_nationkey", "n_nationkey", "n_")])
    return dim.withColumnRenamed("n_r_r_name", "r_r_name")


@query(DIMENSION_SQL)
def star_dimension(spark, d):
    return customer_dimension(spark, d).select("sk_customer", "c_custkey", "c_name", "n_n_name", "r_r_name")


@query(f"with dim as ({DIMENSION_SQL}) select o_orderkey, sk_customer, strftime(o_orderdate, '%Y%m%d')::int as o_orderdate_key from orders left join dim on o_custkey = c_custkey")
def star_fact(spark, d):
    return relational.fact(t(spark, d, "orders"), [(customer_dimension(spark, d), "o_custkey", "c_custkey", "sk_customer")], ["o_orderdate"]).select("o_orderkey", "sk_customer", "o_orderdate_key")


@query("""with s as (select l_returnflag, count(*)::double as c, round(sum(l_quantity), 2) as q from lineitem group by 1), u as (select l_returnflag, count(*)::double as c, round(sum(l_quantity), 2) as q from lineitem where l_returnflag <> 'R' or l_linenumber > 1 group by 1)
select s.l_returnflag, 'count(*)' as measure, s.c as source, u.c as target, 'both' as side, u.c - s.c as difference, s.c = u.c as ok from s join u using (l_returnflag)
union all select s.l_returnflag, 'sum(l_quantity)', s.q, u.q, 'both', round(u.q - s.q, 2), abs(s.q - u.q) <= 0.01 from s join u using (l_returnflag)""")
def reconcile(spark, d):
    li = t(spark, d, "lineitem")
    return rounded(relational.reconcile(li, li.where("l_returnflag <> 'R' or l_linenumber > 1"), ["l_returnflag"], [("count", "*"), ("sum", "l_quantity")], absolute=0.01), 2)


@query("""with s as (select c_nationkey from customer where c_custkey % 2 = 0), k as (select c_nationkey from customer group by 1 having count(*) = 1)
select count(*) as n from customer c join k using (c_nationkey)""")
def reproduced_rows(spark, d):
    c = t(spark, d, "customer").select("c_nationkey")
    return relational.reproduced(c, c, ["c_nationkey"]).agg(F.count("*").alias("n"))


@query("""select count(*) as complete, count(*) filter (where c_nationkey < 10) as found, count(*) filter (where c_nationkey < 10) / count(*) as share from customer""")
def membership(spark, d):
    return relational.membership(t(spark, d, "customer"), ["c_nationkey"], t(spark, d, "nation").where("n_nationkey < 10").select(F.concat(F.lit(" 00"), F.col("n_nationkey").cast("string")).alias("c_nationkey")))


@query()
def nearest_neighbour(spark, d):
    s = t(spark, d, "supplier")
    out = relational.nearest(s, t(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("s_acctbal"), F.col("c_nationkey").alias("s_nationkey")), ["s_acctbal", "s_nationkey"], "c_custkey")
    return rounded(out)


@query("select count(*) as rows, count(*) filter (where not (l_extendedprice >= l_quantity * 900)) as violations from lineitem")
def business_rule(spark, d):
    return relational.business_rule(t(spark, d, "lineitem"), F.expr("l_extendedprice >= l_quantity * 900"))


@query("select count(*) as rows, count(*) filter (where not (l_shipdate >= o_orderdate)) as violations from lineitem left join orders on l_orderkey = o_orderkey")
def cross_table_rule(spark, d):
    return relational.cross_table_rule(t(spark, d, "lineitem"), "l_orderkey", t(spark, d, "orders"), "o_orderkey", F.expr("l_shipdate >= o_orderdate"))


@query("""select n_nationkey as c_nationkey, coalesce(n, 0) as n, coalesce(total, 0)::double as total, round(mean, 6)::double as mean, coalesce(kinds, 0) as kinds from nation left join (select c_nationkey, count(*) as n, sum(c_acctbal::decimal(38,2)) as total, avg(c_acctbal::decimal(38,2)) as mean,
count(distinct c_mktsegment) as kinds from customer where c_nationkey < 20 group by 1) on n_nationkey = c_nationkey""")
def group_report(spark, d):
    groups = t(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return rounded(relational.trip_report(t(spark, d, "customer").where("c_nationkey < 20"), groups, ["c_nationkey"], "c_acctbal", "c_mktsegment"))


# --- ordered groups ---------------------------------------------------------------------------------------------

@query("""select o_orderkey, (row_number() over w - 1)::int as group_rank, count(*) over (partition by o_custkey) as group_size, row_number() over w = 1 as is_first from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def group_order(spark, d):
    return windows.group_order(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_orderkey", "group_rank", "group_size", "is_first")


@query("select event_id, lead(event_type) over (partition by user_id order by ts, event_id) as next_event_type from events")
def next_in_group(spark, d):
    return windows.next_in_group(t(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "next_event_type")


@query("select event_id from (select event_id, row_number() over (partition by user_id, event_type order by event_id) as n from events) where n > 1")
def repeats(spark, d):
    return windows.repeats(t(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("event_id")


@query("""with o as (select o_custkey, o_orderdate::date as day from orders group by all)
select o_custkey, day::varchar as day, (lead(day) over w - interval 1 day)::date::varchar as end_date, lead(day) over w is null as is_current, (row_number() over w)::int as version from o window w as (partition by o_custkey order by day)""")
def scd2_versions(spark, d):
    o = t(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day")).distinct()
    return iso_dates(windows.versions(o, "o_custkey", "day"))


@query("select o_orderkey, case when n <= 3 then o_custkey else -1 end as o_custkey, n > 3 as over_cap from (select o_orderkey, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)")
def cap_per_parent(spark, d):
    return windows.cap_per_parent(t(spark, d, "orders"), "o_custkey", ["o_orderkey"], 3).select("o_orderkey", F.coalesce("o_custkey", F.lit(-1)).alias("o_custkey"), "over_cap")


@query("""with d as (select distinct user_id, ts::date::timestamp as day from events), g as (select user_id, day, epoch_us(day) - epoch_us(lag(day) over (partition by user_id order by day)) as s from d)
select user_id, count(*) as rows, coalesce(sum(case when s > 86400000000 then s // 86400000000 - 1 end), 0)::bigint as missing, count(*) filter (where s > 86400000000) as gaps, 0::bigint as duplicates, 0::bigint as off_grid from g group by 1""")
def time_gaps(spark, d):
    e = t(spark, d, "events").select("user_id", F.to_date("ts").cast("timestamp_ntz").alias("day")).distinct()
    return windows.gaps(e, "day", "1d", ["user_id"])


@query("""with c as (select user_id, ts, event_id, event_type, case when event_type is distinct from lag(event_type) over w then 1 else 0 end as c from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(c) over (partition by user_id order by ts, event_id) as run from c)
select user_id, min(event_type) as value, count(*) as length from r group by user_id, run having count(*) > 2""")
def stuck_runs(spark, d):
    codes = t(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    # runs are of values of any type: numbers keep the check for NaN, text goes through a code of its own
    coded = codes.withColumn("code", F.xxhash64("event_type"))
    runs = windows.stuck_runs(coded, "code", "at", 2, ["user_id"])
    names = codes.groupBy(F.xxhash64("event_type").alias("value")).agg(F.first("event_type").alias("name"))
    return runs.join(F.broadcast(names), "value").select("user_id", F.col("name").alias("value"), "length")


@query("""with x as (select l_returnflag as g, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as t, l_quantity as x from lineitem), e as (select *, x - avg(x) over (partition by g) as e from x), p as (select *, e * lag(e, 1) over (partition by g order by t) as p from e)
select g, count(*) as n, round(sum(p) / sum(e * e), 6) as autocorrelation from p group by 1""")
def lag_autocorrelation(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("t"), F.col("l_quantity").alias("x"))
    return rounded(windows.lag_autocorrelation(li, "x", "t", 1, ["g"]))


@query("""with d as (select event_type, ts::date as day, count(*)::double as x from events group by all), r as (select *, row_number() over w as i, avg(x) over (partition by event_type order by day rows between 3 preceding and 3 following) as m,
lead(x, 3) over w as l from d window w as (partition by event_type order by day)), q as (select *, case when i > 3 and l is not null then x - m end as e, i % 7 as p from r), s as (select *, e - avg(e) over (partition by event_type, p) as u from q)
select event_type, count(e) as n, round(greatest(0, 1 - var_pop(u) / var_pop(e)), 6) as strength from s group by 1""")
def seasonal_strength(spark, d):
    days = t(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("x"))
    return rounded(windows.seasonal_strength(days, "x", "day", 7, ["event_type"]))


@query("select o_orderstatus, date_trunc('month', o_orderdate)::timestamp as period, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by all")
def period_totals(spark, d):
    return rounded(windows.period_totals(t(spark, d, "orders"), "o_orderdate", "month", "o_totalprice", ["o_orderstatus"]), 2)


@query("""with d as (select ts, (epoch_us(ts) - epoch_us(lag(ts) over (order by event_id))) / 1e6 as s from events)
select count(*) as count, min(ts) as first, max(ts) as last, count(*) filter (where s < 0) as out_of_order, round(median(abs(s)), 3) as median_gap_seconds from d""")
def temporal_evidence(spark, d):
    return rounded(windows.temporal_evidence(t(spark, d, "events"), "ts", "event_id"), 3)


@query("""with r as (select user_id, ts, event_id, event_type, value from events)
select user_id, arg_min(event_type, event_id) as event_type, max(value) as value from r group by 1""")
def survivor(spark, d):
    return windows.survivor(t(spark, d, "events"), ["user_id"], {"event_type": "first", "value": "max"}, "event_id")


@query("""with c as (select user_id, event_type, count(*) as n, min(event_id) as o from events group by all)
select user_id, event_type from (select *, row_number() over (partition by user_id order by n desc, o) as k from c) where k = 1""")
def survivor_most_common(spark, d):
    return windows.survivor(t(spark, d, "events"), ["user_id"], {"event_type": "most_common"}, "event_id")


@query("""with s as (select user_id, event_id, sum(n) over (partition by user_id order by ts, event_id) as session from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as n from events))
select user_id, max(session)::bigint as sessions from s group by 1""")
def sessions(spark, d):
    e = t(spark, d, "events")
    return windows.sessions(e, ["user_id"], "ts", "1h").groupBy("user_id").agg(F.max("session").alias("sessions"))


# --- two samples ------------------------------------------------------------------------------------------------

def halves(spark, d):
    li = t(spark, d, "lineitem")
    return li.where("l_shipdate < '1996-07-01'"), li.where("l_shipdate >= '1996-07-01'")


HALVES = "with a as (select * from lineitem where l_shipdate < '1996-07-01'), b as (select * from lineitem where l_shipdate >= '1996-07-01')"


def psi_sql(bin_: str) -> str:
    return f"""{HALVES}, x as (select {bin_} as k, 0 as s from a union all select {bin_}, 1 from b), c as (select k, count(*) filter (where s = 0) as n0, count(*) filter (where s = 1) as n1 from x group by 1),
s as (select n0 / sum(n0) over () + 1e-10 as e, n1 / sum(n1) over () + 1e-10 as a from c) select round(sum((a - e) * ln(a / e)), 6) as psi from s"""


@query(psi_sql("least(9, floor((l_quantity - (select min(l_quantity) from lineitem)) / ((select max(l_quantity) from lineitem) - (select min(l_quantity) from lineitem)) * 10))::int"))
def psi_numeric(spark, d):
    return rounded(compare.psi_numeric(*halves(spark, d), "l_quantity"))


@query(psi_sql("l_returnflag"))
def psi_categorical(spark, d):
    return rounded(compare.psi_categorical(*halves(spark, d), "l_returnflag"))


@query(f"""{HALVES}, x as (select l_extendedprice as v, 1 as p, 0 as q from a union all select l_extendedprice, 0, 1 from b), g as (select v, sum(p) as p, sum(q) as q from x group by 1),
f as (select sum(p) over (order by v) / (select count(*) from a) as f, sum(q) over (order by v) / (select count(*) from b) as g from g) select round(max(abs(f - g)), 6) as ks, (select count(*) from a) as n_a, (select count(*) from b) as n_b from f""")
def ks(spark, d):
    return rounded(compare.ks(*halves(spark, d), "l_extendedprice"))


@query(f"""{HALVES}, c as (select l_returnflag as v, count(*) filter (where l_shipdate < '1996-07-01')::double as n0, count(*) filter (where l_shipdate >= '1996-07-01')::double as n1 from lineitem group by 1), m as (select *, sum(n0) over () as a, sum(n1) over () as b from c)
select round(sum(pow(n0 - (n0 + n1) * a / (a + b), 2) / ((n0 + n1) * a / (a + b)) + pow(n1 - (n0 + n1) * b / (a + b), 2) / ((n0 + n1) * b / (a + b))), 4) as chi2, count(*) - 1 as df from m""")
def chi_squared(spark, d):
    return rounded(compare.chi_squared(*halves(spark, d), "l_returnflag"), 4)


@query(f"""{HALVES}, x as (select distinct l_partkey from a), y as (select distinct l_partkey from b)
select (select count(*) from x) as in_a, (select count(*) from y) as in_b, (select count(*) from x join y using (l_partkey)) as shared, round((select count(*) from x join y using (l_partkey)) / (select count(*) from (select * from x union select * from y)), 6) as jaccard""")
def category_overlap(spark, d):
    return rounded(compare.category_overlap(*halves(spark, d), "l_partkey"))


@query(f"{HALVES} select distinct l_partkey from b where l_partkey not in (select l_partkey from a)")
def new_values(spark, d):
    return compare.new_values(*halves(spark, d), "l_partkey")


@query(f"{HALVES} select count(*) as rows, count(*) filter (where l_partkey not in (select l_partkey from a)) as unseen, round(count(*) filter (where l_partkey not in (select l_partkey from a)) / count(*), 6) as share from b")
def unseen_share(spark, d):
    return rounded(compare.unseen_share(*halves(spark, d), "l_partkey"))


@query("""with a as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi from lineitem where l_quantity < 40)
select count(*) as rows, count(*) filter (where l_extendedprice < lo or l_extendedprice > hi) as outside, round(count(*) filter (where l_extendedprice < lo or l_extendedprice > hi) / count(*), 6) as share from lineitem, a where l_quantity >= 40""")
def out_of_range_share(spark, d):
    li = t(spark, d, "lineitem")
    return rounded(compare.out_of_range_share(li.where("l_quantity < 40"), li.where("l_quantity >= 40"), "l_extendedprice"))


@query(f"""{HALVES}, c as (select l_returnflag, count(*) filter (where l_shipdate < '1996-07-01') as n0, count(*) filter (where l_shipdate >= '1996-07-01') as n1 from lineitem group by 1)
select round(sum(abs(n0 / (select count(*) from a) - n1 / (select count(*) from b))) / 2, 6) as tvd from c""")
def total_variation(spark, d):
    return rounded(compare.total_variation(*halves(spark, d), "l_returnflag"))


@query(f"""{HALVES}, q as (select """ + ", ".join(f"abs((select quantile_cont(l_extendedprice, {p}) from a) - (select quantile_cont(l_extendedprice, {p}) from b)) as q{k}" for k, p in enumerate((0.05, 0.25, 0.5, 0.75, 0.95))) + """)
select round(greatest(q0, q1, q2, q3, q4) / (select max(l_extendedprice) - min(l_extendedprice) from a), 6) as gap from q""")
def quantile_gap(spark, d):
    return rounded(compare.quantile_gap(*halves(spark, d), "l_extendedprice"))


@query()
def training_skew(spark, d):
    return rounded(compare.skew(*halves(spark, d), ["l_quantity", "l_extendedprice"], ["l_returnflag"]))


@query()
def fidelity(spark, d):
    return rounded(compare.fidelity_numeric(*halves(spark, d), ["l_quantity", "l_extendedprice", "l_discount"]))


@query("""with g as (select unnest(list_transform(range(1, length(s_name) - 1), lambda i: substr(s_name, i, 3))) as g, s_suppkey % 2 as k from supplier), c as (select g, count(*) filter (where k = 0)::double as x, count(*) filter (where k = 1)::double as y from g group by 1)
select round(sum(x * y) / sqrt(sum(x * x)) / sqrt(sum(y * y)), 6) as cosine from c""")
def ngram_cosine(spark, d):
    s = t(spark, d, "supplier")
    return rounded(compare.ngram_cosine(s.where("s_suppkey % 2 = 0"), s.where("s_suppkey % 2 = 1"), "s_name"))


@query()
def profile_diff(spark, d):
    a, b = halves(spark, d)
    return compare.profile_diff(rounded(profile.numeric_profile(a, ["l_quantity", "l_tax"])), rounded(profile.numeric_profile(b, ["l_quantity", "l_discount"])))


# --- quality ----------------------------------------------------------------------------------------------------

RULES = [Rule("l_orderkey", "not_null", dimension="completeness"), Rule("l_quantity", "max", 45.0), Rule("l_returnflag", "in", ["A", "N"]), Rule("l_discount", "between", (0.0, 0.08)), Rule("l_orderkey", "unique", dimension="uniqueness")]
CHECK_SQL = """with r as (select count(*) as n, count(*) filter (where l_orderkey is null) as a, count(*) filter (where l_quantity > 45) as b, count(*) filter (where l_returnflag not in ('A', 'N')) as c, count(*) filter (where not l_discount between 0 and 0.08) as d,
(select sum(k) from (select count(*) as k from lineitem group by l_orderkey having count(*) > 1))::bigint as e from lineitem), x as (
select 'not_null(l_orderkey)' as rule, 'completeness' as dimension, n as rows, a as failures from r union all select 'max(l_quantity)', 'validity', n, b from r union all select 'in(l_returnflag)', 'validity', n, c from r
union all select 'between(l_discount)', 'validity', n, d from r union all select 'unique(l_orderkey)', 'uniqueness', n, e from r)"""


@query(f"{CHECK_SQL} select *, round(failures / rows, 6) as rate from x")
def gates(spark, d):
    return rounded(quality.check(t(spark, d, "lineitem"), RULES))


@query(f"{CHECK_SQL} select dimension, count(*) as rules, round(avg(100 * (1 - failures / rows)), 6) as score from x group by 1")
def scorecard(spark, d):
    return rounded(quality.scorecard(quality.check(t(spark, d, "lineitem"), RULES)))


@query("""select l_orderkey, l_linenumber, concat_ws(',', case when l_quantity > 45 then 'max(l_quantity)' end, case when l_returnflag not in ('A', 'N') then 'in(l_returnflag)' end) as failed_rules from lineitem where l_quantity > 45 or l_returnflag not in ('A', 'N')""")
def failing_rows(spark, d):
    return quality.flag(t(spark, d, "lineitem"), RULES[1:3]).where("failed").select("l_orderkey", "l_linenumber", F.array_join("failed_rules", ",").alias("failed_rules"))


SLICES_SQL = """with s as (select c_nationkey::varchar as slice, count(*) as rows, count(*) filter (where c_acctbal > 0) as p from customer group by 1), m as (select *, count(*) filter (where rows < 30) over () as k from s),
g as (select case when rows < 30 then '(small slices)' else slice end as slice, sum(rows)::bigint as rows, sum(p) as p from m where rows >= 30 or k > 1 group by 1)
select slice, rows, round(rows / sum(rows) over (), 6) as share, round(p / rows, 6) as positive_rate, null::double as null_rate from g"""


def nation_slices(spark, d):
    return quality.slices(t(spark, d, "customer"), ["c_nationkey"], F.col("c_acctbal") > 0)


@query(SLICES_SQL)
def slices(spark, d):
    return rounded(nation_slices(spark, d))


@query(f"""with x as ({SLICES_SQL}), y as (select min(positive_rate) as lowest, max(positive_rate) as highest from x where slice <> '(small slices)') select lowest, highest, round(lowest / highest, 4) as ratio, lowest / highest >= 0.8 as passed from y""")
def disparity(spark, d):
    return quality.disparity(nation_slices(spark, d)).select(F.round("lowest", 6).alias("lowest"), F.round("highest", 6).alias("highest"), F.round("ratio", 4).alias("ratio"), "passed")


# --- privacy ----------------------------------------------------------------------------------------------------

@query("""with g as (select count(*) as n from customer group by c_nationkey, c_mktsegment) select min(n) as k, count(*) as groups, count(*) filter (where n = 1) as singletons, coalesce(sum(n) filter (where n < 5), 0)::bigint as rows_below_5, round(count(*) filter (where n = 1) / sum(n), 6) as risk from g""")
def k_anonymity(spark, d):
    return rounded(privacy.k_anonymity(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"]))


@query("""with g as (select count(distinct c_mktsegment) as l from customer group by c_nationkey) select min(l) as l, count(*) as groups, count(*) filter (where l < 5) as violating from g""")
def l_diversity(spark, d):
    return privacy.l_diversity(t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", 5)


@query("select c_nationkey, c_mktsegment, count(*) as n from customer group by all having count(*) >= 12")
def release_groups(spark, d):
    return privacy.release_groups(t(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], 12)


@query("""with c as (select c_nationkey::varchar as cat, count(*) as n from customer group by 1), k as (select *, sum(n) over (order by n, cat) as upto, max((n < 55)::int) over () as anysmall from c),
f as (select case when anysmall = 1 and (n < 55 or upto - n < 55) then 'other' else cat end as category, n from k) select category, sum(n)::bigint as n from f group by 1 having sum(n) >= 55""")
def suppress(spark, d):
    counts = t(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("category")).agg(F.count("*").alias("n"))
    return privacy.suppress(counts, "category", "n", 55)


@query("""with c as (select user_id, count(*) as n from events group by 1), r as (select n, row_number() over (order by n desc) as k, count(*) over () as m from c) select round(sum(n) filter (where k <= ceil(m * 0.2)) / sum(n), 6) as share from r""")
def key_concentration(spark, d):
    return rounded(privacy.key_concentration(t(spark, d, "events"), "user_id"))


@query()
def masked(spark, d):
    c = t(spark, d, "customer").select("c_custkey", "c_name")
    return privacy.mask_tables({"customer": c}, {"customer": {"c_name": "identifier"}}, b"key")["customer"]


@query()
def noisy_counts(spark, d):
    counts = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return counts.select("c_mktsegment", F.round(privacy.laplace_noise(F.col("n").cast("double"), 1.0, 1.0, 42, F.col("c_mktsegment"), low=0.0), 6).alias("n"))


# --- scalars ----------------------------------------------------------------------------------------------------

@query("""select s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[''’]', '', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) as normal from supplier""")
def text_normal(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", text.normalise(F.col("s_name")).alias("normal"))


@query("""select a.s_suppkey as a, b.s_suppkey as b, levenshtein(a.s_name, b.s_name)::int as distance, round(1 - levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), length(b.s_name)), 6) as similarity from supplier a join supplier b on b.s_suppkey = a.s_suppkey + 1""")
def edit_distance(spark, d):
    s = t(spark, d, "supplier")
    pairs = s.select(F.col("s_suppkey").alias("a"), F.col("s_name").alias("x"), (F.col("s_suppkey") + 1).alias("b")).join(s.select(F.col("s_suppkey").alias("b"), F.col("s_name").alias("y")), "b")
    return pairs.select("a", "b", F.levenshtein("x", "y").alias("distance"), F.round(text.levenshtein_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("""with p as (select a.p_partkey as a, list_distinct(list_transform(range(1, length(a.p_name) - 1), lambda i: substr(a.p_name, i, 3))) as x, list_distinct(list_transform(range(1, length(b.p_name) - 1), lambda i: substr(b.p_name, i, 3))) as y from part a join part b on b.p_partkey = a.p_partkey + 1)
select a, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as jaccard from p""")
def ngram_jaccard(spark, d):
    p = t(spark, d, "part")
    pairs = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), (F.col("p_partkey") + 1).alias("b")).join(p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y")), "b")
    return pairs.select("a", F.round(text.ngram_jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"))


@query()
def phonetic_keys(spark, d):
    return t(spark, d, "part").select("p_partkey", text.soundex(F.col("p_name")).alias("soundex"), text.phonetic_key(F.col("p_name")).alias("phonetic"))


@query()
def jaro_winkler(spark, d):
    p = t(spark, d, "part")
    pairs = p.select(F.col("p_partkey").alias("a"), F.col("p_name").alias("x"), (F.col("p_partkey") + 1).alias("b")).join(p.select(F.col("p_partkey").alias("b"), F.col("p_name").alias("y")), "b")
    return pairs.select("a", F.round(text.jaro_winkler(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%d')::int as date_key, (epoch_us(o_orderdate) - epoch_us(o_orderdate) % 604800000000) as week from orders")
def date_keys(spark, d):
    return t(spark, d, "orders").select("o_orderkey", dates.date_key(F.col("o_orderdate")).alias("date_key"), dates.window_start(F.col("o_orderdate"), "1w").alias("week"))


@query("""with x as (select s_suppkey, (s_suppkey % 90)::double as a, (s_suppkey * 7 % 180)::double as b from supplier)
select s_suppkey, round(2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(40 - a) / 2), 2) + cos(radians(a)) * cos(radians(40)) * pow(sin(radians(-83 - b) / 2), 2)))), 3) as km from x""")
def haversine(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 90).cast("double").alias("a"), (F.col("s_suppkey") * 7 % 180).cast("double").alias("b"))
    return s.select("s_suppkey", F.round(numbers.haversine(F.col("a"), F.col("b"), F.lit(40.0), F.lit(-83.0)), 3).alias("km"))


# --- univariate -------------------------------------------------------------------------------------------------

@query("\nunion all\n".join(f"select {m} as base, round(avg((l_quantity % {m} = 0)::int), 6) as share, round(avg((l_quantity % {m} = 0)::int) * {m}, 6) as excess from lineitem" for m in (5, 10, 100, 1000)))
def heaping(spark, d):
    return rounded(univariate.heaping(t(spark, d, "lineitem"), "l_quantity"))


@query("""with c as (select substr(format('{:.6e}', o_totalprice), 1, 1)::int as digit, count(*) as n from orders where o_totalprice > 0 group by 1), x as (select d::int as digit, coalesce(n, 0) as n from range(1, 10) r(d) left join c on digit = d)
select digit, n, round(n / sum(n) over (), 6) as share, round(log10(1 + 1 / digit), 6) as expected from x""")
def benford(spark, d):
    return rounded(univariate.benford(t(spark, d, "orders"), "o_totalprice").drop("mad"))


@query("""with x as (select o_totalprice as x, row_number() over (order by o_totalprice desc) as i, greatest(10, round(sqrt(count(*) over ())))::int as k, count(*) over () as n from orders where o_totalprice > 0)
select max(n) as n, max(k) as k, round(max(k) / (sum(ln(x)) filter (where i <= k) - max(k) * ln(min(x) filter (where i = k + 1))), 5) as alpha from x where i <= k + 1""")
def hill_tail(spark, d):
    return rounded(univariate.hill(t(spark, d, "orders"), "o_totalprice"), 5)


@query("select count(*) as n, round(avg((l_discount = 0)::int), 6) as zero_share, avg((l_discount = 0)::int) > exp(-avg(l_discount)) as inflated from lineitem")
def zero_share(spark, d):
    return rounded(univariate.zeros(t(spark, d, "lineitem"), "l_discount"))


@query("""select lower(trim(l_returnflag)) as value, count(*) as n, round(count(*) / (select count(*) from lineitem), 6) as share, false as listed from lineitem group by 1 having count(*) >= 0.2 * (select count(*) from lineitem)""")
def placeholders(spark, d):
    return rounded(univariate.placeholders(t(spark, d, "lineitem"), "l_returnflag"))


@query("""with q as (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.75) as b from orders), l as (select a - 1.5 * (b - a) as low, b + 1.5 * (b - a) as high from q)
select count(*) as n, count(*) filter (where o_totalprice < low or o_totalprice > high) as outliers, round(max(low), 3) as low, round(max(high), 3) as high from orders, l""")
def outliers_iqr(spark, d):
    return rounded(univariate.outliers_iqr(t(spark, d, "orders"), "o_totalprice"), 3)


@query("select floor(c_acctbal / 500)::bigint as cell_lat, floor(c_nationkey / 500)::bigint as cell_lon, count(*) as n from customer group by all")
def geo_grid(spark, d):
    return univariate.geo_grid(t(spark, d, "customer"), "c_acctbal", "c_nationkey", 500)


@query()
def fitted_laws(spark, d):
    return rounded(univariate.fit(t(spark, d, "orders"), "o_totalprice"), 4)


# --- resolution -------------------------------------------------------------------------------------------------

def people(spark, d):
    return t(spark, d, "customer").select("c_custkey", F.concat(F.lit("nation "), F.col("c_nationkey").cast("string"), F.lit(" "), F.col("c_mktsegment")).alias("name"), F.col("c_acctbal"))


@query("""with k as (select c_custkey as id, c_nationkey || c_mktsegment || floor(c_acctbal / 100)::int as block from customer) select a.id as a, b.id as b from k a join k b on a.block = b.block and a.id < b.id""")
def blocked_pairs(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.concat(F.col("c_nationkey").cast("string"), "c_mktsegment", F.floor(F.col("c_acctbal") / 100).cast("int").cast("string")).alias("block"))
    # every block, as in the SQL: its size has no limit there
    return resolve.candidate_pairs(c, "c_custkey", [("block", "key")], max_block=None)[0]


@query("""select c_custkey as id, case when c_custkey = 0 then 0 when c_custkey % 5 = 0 and c_custkey > 0 then c_custkey - 4 else c_custkey - (c_custkey % 5) + 1 end as cluster from customer""")
def resolved_clusters(spark, d):
    c = t(spark, d, "customer")
    top = c.agg(F.max("c_custkey")).first()[0]
    edges = c.where((F.col("c_custkey") % 5 != 0) & (F.col("c_custkey") + 1 <= top)).select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1).alias("b"), F.lit(1.0).alias("score"))
    return resolve.clusters(c, "c_custkey", edges)


@query()
def scored_pairs(spark, d):
    p = people(spark, d)
    pairs, _ = resolve.candidate_pairs(p, "c_custkey", [("name", "key")])
    return rounded(resolve.score(p, "c_custkey", pairs, {"name": ("tokens", 2.0), "c_acctbal": ("tolerance:500", 1.0)}))


# --- streams (in batch form) ------------------------------------------------------------------------------------

STATS = "count(*) as rows, count(value) as n, round(sum(value), 3) as sum, round(avg(value), 6) as mean, round(min(value), 6) as min, round(max(value), 6) as max"


def stats_rounded(df):
    return rounded(df.withColumn("sum", F.round("sum", 3)))


@query(f"select time_bucket(interval 6 hour, ts, timestamp '1970-01-01') as window_start, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') + interval 6 hour as window_end, {STATS} from events group by 1, 2")
def window_tumbling(spark, d):
    return stats_rounded(streams.tumbling(t(spark, d, "events"), "ts", "6h", "value"))


@query(f"""with w as (select e.*, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') - k * interval 6 hour as s from events e, range(4) r(k))
select s as window_start, s + interval 24 hour as window_end, event_type, {STATS} from w where ts >= s and ts < s + interval 24 hour group by all""")
def window_sliding(spark, d):
    return stats_rounded(streams.sliding(t(spark, d, "events"), "ts", "24h", "6h", "value", ["event_type"]))


@query(f"""with s as (select *, sum(n) over (partition by user_id order by ts, event_id) as k from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 1 hour then 0 else 1 end as n from events))
select min(ts) as window_start, max(ts) + interval 1 hour as window_end, user_id, {STATS.replace('count(*) as rows', 'count(*) as rows')} from s group by user_id, k""")
def window_session(spark, d):
    return stats_rounded(streams.session(t(spark, d, "events"), "ts", "1h", "value", ["user_id"]))


@query("select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as n from events) where n = 1")
def deduplicated(spark, d):
    return streams.deduplicate(t(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts").select("user_id", "event_type", "event_id")


@query("""select user_id, count(*) as count, round(avg(value), 6) as mean, round(var_samp(value), 6) as variance, min(value) as min, max(value) as max, arg_min(value, event_id) as first, arg_max(value, event_id) as last from events group by 1""")
def keyed_statistics(spark, d):
    return rounded(streams.keyed(t(spark, d, "events"), "user_id", "value", "event_id").drop("distinct")).select("user_id", "count", "mean", "variance", "min", "max", "first", "last")


@query("select event_id, 'ok' as status, (props->>'k')::bigint as k from events")
def decoded(spark, d):
    return streams.decode(t(spark, d, "events").select("event_id", "props"), "k bigint", "props").drop("props")


@query("select 'nation' as \"table\", count(*) as n, min(seq) as first, max(seq) as last from (select row_number() over () - 1 as seq from nation) union all select 'region', count(*), min(seq), max(seq) from (select row_number() over () - 1 as seq from region)")
def event_sequence(spark, d):
    e = streams.events({"nation": t(spark, d, "nation"), "region": t(spark, d, "region")}, {"nation": "n_nationkey", "region": "r_regionkey"})
    return e.groupBy("table").agg(F.count("*").alias("n"), F.min("seq").alias("first"), F.max("seq").alias("last"))


# --- generation and damage --------------------------------------------------------------------------------------

SPEC = [
    Table("customer", 400, {"customer_id": {"strategy": "sequence", "start": 1000}, "segment": {"strategy": "weighted_enum", "weights": {"a": 0.7, "b": 0.3}, "null_rate": 0.2}, "balance": {"strategy": "distribution", "family": "normal", "params": {"loc": 100.0, "scale": 15.0}}, "uid": {"strategy": "uuid"}}),
    Table("order", 1200, {"order_id": {"strategy": "sequence"}, "customer_id": {"strategy": "foreign_key", "parent": "customer", "law": "zipf", "start": 1000}, "placed": {"strategy": "temporal", "start": "2024-01-01", "end": "2025-01-01"}, "total": {"strategy": "uniform", "low": 5.0, "high": 500.0}, "tax": {"strategy": "formula", "expression": "total * 0.2 if total > 100 else 0"}}),
]


@query()
def generated(spark, d):
    tables = generate.generate(spark, SPEC)
    return rounded(relational.coverage(tables["order"], "customer_id", tables["customer"], "customer_id"))


@query()
def generated_laws(spark, d):
    row, out = F.col("id"), []
    laws = {"normal": {}, "uniform": {}, "exponential": {}, "lognormal": {"s": 0.5}, "pareto": {"xm": 1.0, "alpha": 3.0}, "zipf": {"a": 1.5, "n": 50}, "geometric": {"p": 0.3}, "poisson": {"lam": 4.0}, "bernoulli": {"p": 0.25}, "gamma": {"k": 2.0, "theta": 1.5}, "beta": {"a": 2.0, "b": 3.0}, "weibull": {"k": 1.5, "lam": 2.0}, "triangular": {"low": 0.0, "mode": 1.0, "high": 4.0}, "negative_binomial": {"r": 3.0, "p": 0.4}, "power_law_cutoff": {"alpha": 2.5, "lam": 0.1, "xmin": 1.0}, "mixture": {"parts": [("normal", {}), ("normal", {"loc": 10.0})], "weights": [0.5, 0.5]}, "truncated_normal": {"loc": 0.0, "scale": 1.0, "low": -1.0, "high": 2.0}, "histogram": {"edges": [0.0, 1.0, 3.0], "weights": [1.0, 3.0]}}
    for name, p in laws.items():
        x = generate.draw(name, Stream(42, "laws", name), row, **p).cast("double")
        out.append(F.struct(F.lit(name).alias("family"), x.alias("x")))
    rows = spark.range(20_000).select(F.explode(F.array(*out)).alias("s")).select("s.*")
    return rows.groupBy("family").agg(F.count("x").alias("n"), F.round(F.avg("x"), 3).alias("mean"), F.round(F.stddev_samp("x"), 3).alias("sd"))


@query()
def generated_nested(spark, d):
    places = [{"city": "Alma", "zip": "01001"}, {"city": "Birk", "zip": "02002"}]
    tree = {"north": (1.0, {"n1": (1.0, {}), "n2": (2.0, {})}), "south": (3.0, {"s1": (1.0, {})})}
    spec = [
        Table("owner", 50, {"owner_id": {"strategy": "sequence"}, "grade": {"strategy": "choice", "values": ["a", "b"]}}),
        Table("item", 200, {
            "owner_id": {"strategy": "foreign_key", "parent": "owner"}, "grade": {"strategy": "parent", "parent": "owner", "column": "grade", "key": "owner_id"},
            "city": {"strategy": "record", "anchor": "place", "records": places, "field": "city"}, "zip": {"strategy": "record", "anchor": "place", "records": places, "field": "zip"},
            "region": {"strategy": "hierarchy", "anchor": "area", "tree": tree, "level": 0}, "area": {"strategy": "hierarchy", "anchor": "area", "tree": tree, "level": 1},
            "size": {"strategy": "conditional", "column": "grade", "table": {"a": {"S": 1.0, "M": 1.0}, "b": {"L": 1.0}}},
            "tags": {"strategy": "nested", "kind": "list", "of": {"strategy": "choice", "values": ["x", "y"]}, "max": 3},
        }),
    ]
    return generate.generate(spark, spec)["item"].withColumn("tags", F.array_join("tags", ","))


@query("select 'all' as k, count(*) as n from customer")
def daily_batches(spark, d):
    n = t(spark, d, "customer").count()
    parts = [b["t"] for b in generate.batches(spark, [Table("t", n // 2, {"id": {"strategy": "sequence"}})], 2)]
    return parts[0].unionByName(parts[1]).agg(F.count_distinct("id").alias("n")).select(F.lit("all").alias("k"), "n")


@query("select c_custkey from customer order by c_custkey limit 25")
def head_sample(spark, d):
    return sampling.rows(t(spark, d, "customer").select("c_custkey"), "c_custkey", 25, "head")


@query("with x as (select c_custkey, row_number() over (order by c_custkey) - 1 as i, greatest(1, count(*) over () // 50) as s from customer) select c_custkey from x where i % s = 0 and i < s * 50")
def systematic_sample(spark, d):
    return sampling.rows(t(spark, d, "customer").select("c_custkey"), "c_custkey", 50, "systematic")


@query()
def random_sample(spark, d):
    return sampling.rows(t(spark, d, "customer").select("c_custkey"), "c_custkey", 50)


@query("""with h as (select date '1996-07-04' as d, 'Independence Day' as name union all select date '1996-12-25', 'Christmas Day'), n as (select o_orderdate::date as day, count(*) as n from orders group by 1),
o as (select month(day) as m, isodow(day) as w, avg(n) as e from n where not exists (select 1 from h where abs(date_diff('day', h.d, day)) <= 3) group by 1, 2)
select h.name, sum(n.n)::bigint as rows, round(sum(o.e), 6) as expected, round(sum(n.n) / sum(o.e), 6) as lift from h join n on n.day = h.d join o on o.m = month(h.d) and o.w = isodow(h.d) group by 1""")
def holiday_lift(spark, d):
    h = spark.sql("select date'1996-07-04' as date, 'Independence Day' as name union all select date'1996-12-25', 'Christmas Day'")
    return rounded(windows.holiday_lift(t(spark, d, "orders"), "o_orderdate", h))


@query("select o_orderkey, 'nonexistent' as kind from orders where o_orderdate >= timestamp '1996-04-07 02:00:00' and o_orderdate < timestamp '1996-04-07 03:00:00' union all select o_orderkey, 'repeated' from orders where o_orderdate >= timestamp '1996-10-27 01:00:00' and o_orderdate < timestamp '1996-10-27 02:00:00'")
def clock_changes(spark, d):
    return zones.clock_changes(t(spark, d, "orders"), "o_orderdate", "America/New_York", 1996, 1996).select("o_orderkey", "kind")


@query()
def clickstream(spark, d):
    return simulate.clickstream(spark, 300).groupBy("state").agg(F.count("*").alias("n"))


@query()
def sensor_readings(spark, d):
    return rounded(simulate.readings(spark, 5, 200).groupBy("sensor").agg(F.count("*").alias("n"), F.count_if("fault").alias("faults"), F.avg(F.when(~F.col("fault"), F.col("value"))).alias("mean")), 4)


@query()
def payments(spark, d):
    return simulate.payments(spark, 5000, 50).groupBy("channel").agg(F.count("*").alias("n"), F.count_if("fraud").alias("frauds"))


@query()
def cohorts(spark, d):
    out = multivariate.cohorts(t(spark, d, "customer"), ["c_acctbal", "c_nationkey"], 3)
    return out.groupBy("cohort").agg(F.count("*").alias("n"))


@query()
def principal_components(spark, d):
    shares = multivariate.principal_components(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 2)
    return spark.createDataFrame([(k, round(v, 4)) for k, v in enumerate(shares)], "component int, share double")


@query()
def dependency_tree(spark, d):
    tree = joint.dependency_tree(t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return spark.createDataFrame([(a, b, round(w, 6)) for a, b, w in tree], "a string, b string, information double")


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_extension(spark, d):
    return rounded(t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")), 2)


@query()
def bootstrap_sample(spark, d):
    return generate.bootstrap(t(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", 500)


@query()
def damaged_rows(spark, d):
    out, answers = chaos.inject(t(spark, d, "customer"), "c_custkey", "c_acctbal", "null", 0.1)
    return out.where("c_acctbal is null").join(answers, F.col("c_custkey") == F.col("id")).select("c_custkey", "kind", "before")


@query("select day::varchar as date, name from (values (date '2024-01-01', 'New Year''s Day'), (date '2024-01-15', 'Martin Luther King Jr. Day'), (date '2024-02-19', 'Presidents'' Day'), (date '2024-05-27', 'Memorial Day'), (date '2024-06-19', 'Juneteenth'), (date '2024-07-04', 'Independence Day'), (date '2024-09-02', 'Labor Day'), (date '2024-10-14', 'Columbus Day'), (date '2024-11-11', 'Veterans Day'), (date '2024-11-28', 'Thanksgiving'), (date '2024-12-25', 'Christmas Day'), (date '2024-03-31', 'Easter')) v(day, name)")
def holidays(spark, d):
    return iso_dates(generate.calendar(spark, range(2024, 2025)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


from . import catalog_more  # noqa: E402, F401  (registers its queries here)
