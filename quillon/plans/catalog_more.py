"""Registered queries over planted defects, evidence, versions, proposals, design, contract rules and releases, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PATTERNS
from ..operators import defects, evidence, releases, versions
from ..operators.defects import Defect
from ..operators.versions import Consumer
from ..streaming import schedule
from . import design, proposals, rules
from .catalog import query, rounded, t

# --- planted defects --------------------------------------------------------------------------------------------

TENTH = "o_orderkey % 10 = 3"


def planted(spark, d, kind: str, column: str, **details):
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    return defects.plant(orders, Defect(kind, column, TENTH, details=details), "o_orderkey")[0]


@query(f"select o_orderkey, case when {TENTH} then null else o_totalprice end as o_totalprice from orders")
def defect_nulls(spark, d):
    return planted(spark, d, "inject_nulls", "o_totalprice").select("o_orderkey", "o_totalprice")


@query(f"select o_orderkey, o_custkey from orders union all select o_orderkey, o_custkey from orders where {TENTH}")
def defect_duplicate_keys(spark, d):
    return planted(spark, d, "duplicate_keys", "o_orderkey").select("o_orderkey", "o_custkey")


@query(f"select o_orderkey, case when {TENTH} then -abs(o_custkey) - 1 else o_custkey end as o_custkey from orders")
def defect_orphan_keys(spark, d):
    return planted(spark, d, "orphan_keys", "o_custkey").select("o_orderkey", "o_custkey")


@query("select event_id, strftime(case when event_id % 10 = 3 then ts - interval 2 hour else ts end, '%Y-%m-%d %H:%M:%S') as ts from events")
def defect_late_arrivals(spark, d):
    out, _ = defects.plant(t(spark, d, "events"), Defect("late_arrivals", "ts", "event_id % 10 = 3", details={"seconds": 7200}), "event_id")
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("""with a as (select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) as k from orders),
b as (select o_orderpriority, row_number() over (order by o_orderkey) as k from orders) select o_orderkey, o_orderpriority from a join b using (k)""")
def defect_shuffled(spark, d):
    return planted(spark, d, "shuffle_column", "o_orderpriority", order=["o_totalprice"]).select("o_orderkey", "o_orderpriority")


@query(f"select o_orderkey, round(case when {TENTH} then o_totalprice * 100 else o_totalprice end, 2) as o_totalprice from orders")
def defect_scaled(spark, d):
    return rounded(planted(spark, d, "scale_values", "o_totalprice", factor=100).select("o_orderkey", "o_totalprice"), 2)


@query("select event_id, strftime(case when event_id % 10 = 3 then ts + interval 5 hour else ts end, '%Y-%m-%d %H:%M:%S') as ts from events")
def defect_shifted_hours(spark, d):
    out, _ = defects.plant(t(spark, d, "events"), Defect("shift_hours", "ts", "event_id % 10 = 3", details={"hours": 5}), "event_id")
    return out.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(f"select o_orderkey, case when {TENTH} then substr(o_orderpriority, 1, 3) else o_orderpriority end as o_orderpriority from orders")
def defect_truncated(spark, d):
    return planted(spark, d, "truncate_strings", "o_orderpriority", length=3).select("o_orderkey", "o_orderpriority")


@query(f"select o_orderkey, case when {TENTH} then 'N/A' else o_orderpriority end as o_orderpriority from orders")
def defect_placeholders(spark, d):
    return planted(spark, d, "placeholder_values", "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query(f"select o_orderkey, case when {TENTH} then o_orderpriority || chr(65533) else o_orderpriority end as o_orderpriority from orders")
def defect_encoding(spark, d):
    return planted(spark, d, "corrupt_encoding", "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_custkey as customer from orders")
def defect_renamed(spark, d):
    return planted(spark, d, "rename_column", "o_custkey", to="customer").select("o_orderkey", "customer")


@query("select n_nationkey, n_regionkey from nation")
def defect_dropped(spark, d):
    return defects.plant(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), Defect("drop_column", "n_name"), "n_nationkey")[0]


@query("select o_orderkey, o_custkey::varchar as o_custkey from orders")
def defect_retyped(spark, d):
    return planted(spark, d, "retype_column", "o_custkey").select("o_orderkey", "o_custkey")


@query("""select 'inject_nulls' as kind, 'o_totalprice' as "column", count(*) filter (where o_orderkey % 10 = 3) as planted, count(*) filter (where o_orderkey % 10 = 3) as caught, 0::bigint as missed from orders
union all select 'orphan_keys', 'o_custkey', count(*), count(*), 0::bigint from orders where o_orderkey % 7 = 2""")
def canary_check(spark, d):
    orders = t(spark, d, "orders")
    batch, answers = defects.canary(orders, [Defect("inject_nulls", "o_totalprice", TENTH), Defect("orphan_keys", "o_custkey", "o_orderkey % 7 = 2")], "o_orderkey", "canary-1")
    nulls = batch.where("o_totalprice is null").select(F.col("o_orderkey").alias("id"), F.lit("o_totalprice").alias("column"))
    known = t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    lost = batch.join(known, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("id"), F.lit("o_custkey").alias("column"))
    return defects.canary_caught(answers, nulls.unionByName(lost))


@query("select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as n from orders) where n > 1")
def repeated_rows(spark, d):
    return defects.repeated_rows(t(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"])


# --- mergeable evidence -----------------------------------------------------------------------------------------


@query("""select count(*) as count, count(*) filter (where o_totalprice is null) as nulls, count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean,
round(sqrt(var_pop(o_totalprice)), 4) as sd, min(o_totalprice) as minimum, max(o_totalprice) as maximum from orders""")
def evidence_numeric(spark, d):
    orders = t(spark, d, "orders")
    merged = evidence.merge_numeric(evidence.numeric_batch(orders, "o_totalprice", ["o_orderstatus", "o_orderpriority"]))
    return merged.select("count", "nulls", "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt(F.col("m2") / F.col("n")), 4).alias("sd"), "minimum", "maximum")


@query("""select count(*) as count, count(*) filter (where text is null) as nulls, count(*) filter (where text = '') as empty, min(length(text))::int as shortest,
max(length(text))::int as longest, sum(length(text))::bigint as characters, round(avg(length(text)), 6) as mean_length from documents""")
def evidence_text(spark, d):
    return rounded(evidence.merge_text(evidence.text_batch(t(spark, d, "documents"), "text", ["source"])))


@query("select count(url) as n, " + ", ".join(f"(count(*) filter (where regexp_matches(url, '{p}')))::bigint as {n}" for n, p in PATTERNS.items()) + " from pages")
def evidence_patterns(spark, d):
    pages = t(spark, d, "pages").withColumn("batch", F.col("page_id") % 4)
    return evidence.merge_counts(evidence.pattern_batch(pages, "url", ["batch"]).drop("batch"))


@query("""with x as (select case when l_tax > 0.02 then l_tax end as a, case when l_discount > 0.02 then l_discount end as b from lineitem)
select (count(*) filter (where a is not null and b is not null))::bigint as both_present, (count(*) filter (where a is null and b is not null))::bigint as left_missing,
(count(*) filter (where a is not null and b is null))::bigint as right_missing, (count(*) filter (where a is null and b is null))::bigint as both_missing from x""")
def evidence_missing(spark, d):
    li = t(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_tax") > 0.02, F.col("l_tax")).alias("a"), F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("b"))
    return evidence.merge_counts(evidence.missing_batch(li, "a", "b", ["l_returnflag"]).drop("l_returnflag"))


@query("select count(*) as n, round(avg(l_quantity::double), 6) as mx, round(avg(l_extendedprice::double), 2) as my, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def evidence_covariance(spark, d):
    made = evidence.merge_covariance(evidence.covariance_batch(t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag", "l_linenumber"]))
    return made.select("n", F.round("mx", 6).alias("mx"), F.round("my", 2).alias("my"), F.round("r", 6).alias("r"))


@query("select count(o_custkey) as checked, count(*) filter (where o_custkey not in (select c_custkey from customer where c_custkey % 5 <> 0)) as orphans from orders")
def evidence_relational(spark, d):
    parents = t(spark, d, "customer").where("c_custkey % 5 <> 0")
    return evidence.merge_counts(evidence.relational_batch(t(spark, d, "orders"), "o_custkey", parents, "c_custkey", ["o_orderstatus"]).drop("o_orderstatus"))


@query("""with g as (select event_type, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) over (partition by event_type order by ts) as gap from events)
select event_type, count(*) as n, round(max(s) - min(s), 3) as span, round(avg(gap), 3) as mean_gap, round(max(gap), 3) as longest_gap from g group by event_type""")
def evidence_temporal(spark, d):
    made = evidence.temporal_batch(t(spark, d, "events"), "ts", ["event_type"])
    return made.select("event_type", "n", F.round(F.col("last") - F.col("first"), 3).alias("span"), F.round("mean_gap", 3).alias("mean_gap"), F.round("longest_gap", 3).alias("longest_gap"))


@query("""select l_linenumber::varchar as value, count(*) as count, 0::bigint as error from lineitem group by 1""")
def heavy_hitters(spark, d):
    return evidence.space_saving(t(spark, d, "lineitem"), "l_linenumber", 64)


# --- versions ---------------------------------------------------------------------------------------------------


@query("""with v as (select year(o_orderdate) as version, avg(o_totalprice) as value from orders group by 1),
w as (select version, value, lag(value) over (order by version) as previous from v)
select version::int as version, round(value, 4) as value, round(previous, 4) as previous, round(value - previous, 4) as change, round((value - previous) / abs(previous), 6) as relative from w""")
def timelapse(spark, d):
    made = versions.timelapse(t(spark, d, "orders").withColumn("version", F.year("o_orderdate")), "version", "o_totalprice")
    return made.select("version", *[F.round(c, p).alias(c) for c, p in (("value", 4), ("previous", 4), ("change", 4), ("relative", 6))])


@query("""with a as (select count(*)::double as rows, avg((o_totalprice is null)::int) as null_share, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as sd, min(o_totalprice) as min, max(o_totalprice) as max from orders where o_orderstatus = 'F'),
b as (select count(*)::double as rows, avg((o_totalprice is null)::int) as null_share, avg(o_totalprice) as mean, stddev_samp(o_totalprice) as sd, min(o_totalprice) as min, max(o_totalprice) as max from orders where o_orderstatus = 'O'),
x as (select unnest(['rows', 'null_share', 'mean', 'sd', 'min', 'max']) as statistic, unnest([a.rows, a.null_share, a.mean, a.sd, a.min, a.max]) as before, unnest([b.rows, b.null_share, b.mean, b.sd, b.min, b.max]) as after,
unnest([0.5, 0.05, 0.25, 0.5, 0.5, 0.5]) as lim from a, b)
select 'o_totalprice' as "column", statistic, round(before, 4) as before, round(after, 4) as after, round(case when statistic = 'null_share' then abs(after - before) else abs(after - before) / abs(before) end, 6) as change,
case when statistic = 'null_share' then abs(after - before) else abs(after - before) / abs(before) end > lim as drifted from x""")
def univariate_drift(spark, d):
    orders = t(spark, d, "orders")
    made = versions.drifted(*[versions.statistics(orders.where(F.col("o_orderstatus") == s), ["o_totalprice"]) for s in "FO"])
    return made.select("column", "statistic", F.round("before", 4).alias("before"), F.round("after", 4).alias("after"), F.round("change", 6).alias("change"), "drifted")


@query("""with r as (select corr(l_quantity, l_extendedprice) filter (where l_returnflag = 'N') as x1, corr(l_quantity, l_extendedprice) filter (where l_returnflag <> 'N') as y1,
corr(l_discount, l_tax) filter (where l_returnflag = 'N') as x2, corr(l_discount, l_tax) filter (where l_returnflag <> 'N') as y2 from lineitem)
select 'l_quantity' as a, 'l_extendedprice' as b, round(x1, 6) as before, round(y1, 6) as after, abs(y1 - x1) > 0.1 as drifted from r
union all select 'l_discount', 'l_tax', round(x2, 6), round(y2, 6), abs(y2 - x2) > 0.1 from r""")
def joint_drift(spark, d):
    li = t(spark, d, "lineitem")
    made = versions.joint_drift(li.where("l_returnflag = 'N'"), li.where("l_returnflag <> 'N'"), [("l_quantity", "l_extendedprice"), ("l_discount", "l_tax")])
    return made.select("a", "b", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"), "drifted")


@query("""select (select count(*) from orders) as rows_a, (select count(*) from orders where o_orderkey % 11 <> 5) as rows_b, (select count(*) from orders where o_orderkey % 11 = 5) as only_a, 0::bigint as only_b,
(select count(*) from orders where o_orderkey % 11 <> 5 and o_orderkey % 13 = 4) as different, 0 as columns_only_a, 0 as columns_only_b, false as ok""")
def environment_parity(spark, d):
    a = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    b = a.where("o_orderkey % 11 <> 5").withColumn("o_custkey", F.when(F.col("o_orderkey") % 13 == 4, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return versions.parity(a, b, ["o_orderkey"])


@query("""select 'finance' as consumer, 'column(o_totalprice)' as need, null::double as value, true as ok union all select 'finance', 'column(o_currency)', null, false
union all select 'finance', 'min(o_totalprice)', min(o_totalprice), min(o_totalprice) >= 0 from orders union all select 'growth', 'rows(o_custkey)', count(*)::double, count(*) >= 1000000000 from orders""")
def consumer_needs(spark, d):
    return versions.check_consumers(t(spark, d, "orders"), [Consumer("finance", ("o_totalprice", "o_currency"), (("min", "o_totalprice", 0.0, None),)), Consumer("growth", (), (("rows", "o_custkey", 1e9, None),))])


@query("""with v as (select year(o_orderdate)::int as version, count(*) as rows, count(*) filter (where not coalesce(o_totalprice < 450000, true)) as failures from orders group by 1),
i as (select version, rows, failures, failures > 0 as alarm, version in (1995, 1996) as incident from v)
select *, case when alarm and incident then 'hit' when incident then 'miss' when alarm then 'false_alarm' else 'quiet' end as verdict from i""")
def backtest(spark, d):
    history = t(spark, d, "orders").withColumn("version", F.year("o_orderdate"))
    return versions.backtest(history, "version", F.col("o_totalprice") < 450000, spark.createDataFrame([(1995,), (1996,)], "version int"))


@query("""with s as (select year(o_orderdate)::int as version, 100 * (1 - count(*) filter (where o_totalprice >= 200000) / count(*)) as score from orders group by 1)
select version, 'validity' as dimension, round(score, 6) as score, round(score - lag(score) over (order by version), 6) as change from s""")
def scorecard_trend(spark, d):
    made = t(spark, d, "orders").groupBy(F.year("o_orderdate").alias("version")).agg(F.count("*").alias("rows"), F.count_if(F.col("o_totalprice") >= 200000).alias("failures")).withColumn("dimension", F.lit("validity"))
    return rounded(versions.scorecard_trend(made, "version").select("version", "dimension", "score", "change"))


@query("""with a as (select o_custkey, count(*) as before from orders group by 1), b as (select o_custkey, count(*) as after from orders where o_orderkey % 17 <> 3 group by 1),
x as (select o_custkey, coalesce(before, 0) as before, coalesce(after, 0) as after from a full join b using (o_custkey)) select *, abs(after - before) as delta from x where abs(after - before) between 1 and 4""")
def differencing_risk(spark, d):
    orders = t(spark, d, "orders")
    return versions.differencing_risk(orders, orders.where("o_orderkey % 17 <> 3"), ["o_custkey"])


# --- proposals and design ---------------------------------------------------------------------------------------


@query("""with x as (select 'orders' as child, 'o_custkey' as "column", 'customer' as parent, 'c_custkey' as key, 1.0 as name_score, count(distinct o_custkey) as n, count(distinct o_custkey) filter (where o_custkey in (select c_custkey from customer)) as f from orders
union all select 'nation', 'n_regionkey', 'region', 'r_regionkey', 1.0, count(distinct n_regionkey), count(distinct n_regionkey) filter (where n_regionkey in (select r_regionkey from region)) from nation
union all select 'customer', 'c_nationkey', 'nation', 'n_nationkey', 1.0, count(distinct c_nationkey), count(distinct c_nationkey) filter (where c_nationkey in (select n_nationkey from nation)) from customer)
select child, "column", parent, key, name_score::double as name_score, f / n as containment, (name_score + f / n) / 2 as confidence from x where f / n >= 0.9""")
def proposed_relationships(spark, d):
    tables = {"orders": t(spark, d, "orders").select("o_orderkey", "o_custkey"), "customer": t(spark, d, "customer").select("c_custkey", "c_nationkey"), "nation": t(spark, d, "nation").select("n_nationkey", "n_regionkey"), "region": t(spark, d, "region").select("r_regionkey")}
    return proposals.propose_relationships(tables)


@query("""select 'c_name' as "column", 'name' as kind, 'name' as name_kind, null::varchar as value_kind, 0.0::double as value_rate, 0.6::double as confidence""")
def proposed_pii(spark, d):
    return proposals.propose_pii(t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"))


@query("""select * from (values ('c_custkey', 'identifier', 'name'), ('c_acctbal', 'money', 'name'), ('c_mktsegment', 'status', 'name')) x("column", semantics, "by")""")
def proposed_semantics(spark, d):
    return proposals.propose_semantics(t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"))


@query("""select 'as_integer' as "column", 'string' as declared, 'bigint' as proposed, 1.0::double as rate, false as is_identifier union all select 'as_number', 'string', 'double', 1.0, false
union all select 'as_date', 'string', 'date', 1.0, false union all select 'o_orderstatus', 'string', 'string', 1.0, false union all select 'padded', 'string', 'string', 1.0, true""")
def proposed_types(spark, d):
    orders = t(spark, d, "orders")
    return proposals.propose_types(orders.select((F.col("o_custkey") % 97).cast("string").alias("as_integer"), F.format_string("%.2f", F.col("o_totalprice").cast("double")).alias("as_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("as_date"), "o_orderstatus", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("padded")))


@query("""with o as (select o_orderkey, o_orderstatus from orders) select 'not_null(o_orderkey)' as rule, count(o_orderkey) as support from o union all select 'not_null(o_orderstatus)', count(o_orderstatus) from o
union all select 'between(o_orderkey)', count(*) from o union all select 'in(o_orderstatus)', count(*) from o union all select 'unique(o_orderkey)', count(*) from o""")
def proposed_rules(spark, d):
    return proposals.propose_rules(t(spark, d, "orders").select("o_orderkey", "o_orderstatus")).select("rule", "support")


def fd_sql(table: str, columns: list[str]) -> str:
    one = "select '{a}' as determinant, '{b}' as dependent where not exists (select 1 from {t} group by {a} having count(distinct {b}) > 1 or count({b}) not in (0, count(*)))"
    return "\nunion all\n".join(one.format(a=a, b=b, t=table) for a in columns for b in columns if a != b)


@query(fd_sql("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]))
def found_dependencies(spark, d):
    return design.dependencies(t(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


ORDER, FDS = ["order", "customer", "city", "region", "item", "price"], [("order", "customer"), ("customer", "city"), ("city", "region"), ("order item", "price")]


@query("""select * from (values ('closure', 'city customer order region'), ('cover', 'city -> region; customer -> city; item order -> price; order -> customer'), ('keys', 'order item'),
('is_3nf', 'false'), ('relations', 'city region; customer city; order customer; order item price'), ('lossless', 'true')) x(what, value)""")
def design_theory(spark, d):
    fds = [design.FD.of(a, b) for a, b in FDS]
    relations = design.synthesize_3nf(ORDER, fds)
    told = [
        ("closure", " ".join(sorted(design.closure({"order"}, fds)))),
        ("cover", "; ".join(sorted(f"{' '.join(sorted(x.left))} -> {' '.join(x.right)}" for x in design.minimal_cover([*fds, design.FD.of("order", "city")], ORDER)))),
        ("keys", "; ".join(" ".join(k) for k in design.candidate_keys(ORDER, fds))),
        ("is_3nf", str(design.is_3nf(ORDER, fds)).lower()),
        ("relations", "; ".join(sorted(" ".join(r) for r in relations))),
        ("lossless", str(design.is_lossless(ORDER, relations, fds)).lower()),
    ]
    return spark.createDataFrame(told, "what string, value string")


# --- contract rules ---------------------------------------------------------------------------------------------


@query("""with g as (select c_nationkey, c_mktsegment, count(*) as n from customer group by 1, 2), m as (select c_nationkey, max(n) as top, sum(n) as n from g group by 1)
select 'fd' as rule, 'c_nationkey -> c_mktsegment' as "on", round(sum(top) / sum(n), 6) as value, sum(top) / sum(n) >= 0.99 as ok from m
union all select 'reference_pair', 'n_nationkey n_regionkey', 1.0, true
union all select 'implausible', 'o_totalprice', round(avg((o_totalprice > 400000)::int), 6), avg((o_totalprice > 400000)::int) <= 0.01 from orders
union all select 'no_placeholder', 'o_orderpriority', round(avg((o_orderpriority in ('N/A', 'NULL', 'UNKNOWN', '-', '?', 'NONE', 'TBD', 'TEST'))::int), 6), avg((o_orderpriority in ('N/A', 'NULL', 'UNKNOWN', '-', '?', 'NONE', 'TBD', 'TEST'))::int) = 0 from orders
union all select 'valid_as', 'lang iso639_1', round(avg((lang in ('en', 'de', 'fr', 'es', 'it', 'nl', 'pt'))::int), 6), avg((lang in ('en', 'de', 'fr', 'es', 'it', 'nl', 'pt'))::int) >= 0.99 from documents where lang is not null
union all select 'regex', 'o_orderpriority', round(avg(regexp_full_match(o_orderpriority, '[1-5]-.+')::int), 6), avg(regexp_full_match(o_orderpriority, '[1-5]-.+')::int) = 1 from orders""")
def contract_rules(spark, d):
    orders, nation = t(spark, d, "orders"), t(spark, d, "nation")
    out = rules.fd_rule(t(spark, d, "customer"), ["c_nationkey"], "c_mktsegment", 0.99)
    out = out.unionByName(rules.reference_pair(nation, ["n_nationkey", "n_regionkey"], nation, 1.0))
    out = out.unionByName(rules.implausible(orders, "o_totalprice", F.col("o_totalprice") > 400000, 0.01))
    out = out.unionByName(rules.no_placeholder(orders, "o_orderpriority")).unionByName(rules.valid_as(t(spark, d, "documents"), "lang", "iso639_1", 0.99))
    return rounded(out.unionByName(rules.regex_rule(orders, "o_orderpriority", "[1-5]-.+")))


# --- releases ---------------------------------------------------------------------------------------------------


@query("""select c_mktsegment, c_nationkey, n from (select c_mktsegment, c_nationkey, count(*) as n from customer group by 1, 2) where n >= 10""")
def suppressed_cells(spark, d):
    return releases.suppress_joint(t(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n")), "n", 10)


@query("""select c_nationkey::varchar as value, count(*) as n from customer group by 1 having count(*) < 60""")
def leakage_summary(spark, d):
    return releases.rare_categories(t(spark, d, "customer"), "c_nationkey", 60)


@query("""select c_custkey, 'confidential' as level, '***' as c_name, c_mktsegment from customer""")
def redacted(spark, d):
    out = releases.redact(t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_name": "confidential", "c_mktsegment": "internal"}, "confidential")
    return out.withColumn("level", F.lit(releases.highest(["public", "internal", "confidential"])))


@query("""with a as (select c_name as x from customer) select 'c_acctbal' as "column", count(*) as rows, round(avg(c_acctbal::double), 4) as mean, null::double as min, null::double as max from customer""")
def safe_profile(spark, d):
    made = releases.safe_profile(versions.statistics(t(spark, d, "customer"), ["c_acctbal"]), {"c_acctbal": "confidential"})
    return made.select("column", "rows", F.round("mean", 4).alias("mean"), "min", "max")


# --- schedules of emission --------------------------------------------------------------------------------------


@query("""select event_id, round(case when hour(ts) < 12 then 0.5 + (floor(epoch(ts))::bigint % 86400) / 43200.0 else 1.5 - ((floor(epoch(ts))::bigint % 86400) - 43200) / 43200.0 end, 6) as factor from events""")
def daily_curve(spark, d):
    return rounded(t(spark, d, "events").select("event_id", schedule.daily_curve(F.col("ts"), [(0, 0.5), (12, 1.5), (24, 0.5)]).alias("factor")))


@query("select event_id, round(case when event_id <= 100 then 1.0 when event_id >= 600 then 3.0 else 1 + 2 * (event_id - 100) / 500 end, 6) as factor from events")
def ramp(spark, d):
    return rounded(t(spark, d, "events").select("event_id", schedule.ramp(F.col("event_id"), 100, 500, 1.0, 3.0).alias("factor")))


@query("""with x as (select event_id, user_id, event_type, count(*) over (partition by event_type, user_id order by event_id) as n from events) select event_type, user_id, event_id from x where n = 1""")
def events_read_once(spark, d):
    return schedule.read_once(t(spark, d, "events"), ["event_type", "user_id"], "event_id").select("event_type", "user_id", "event_id")
