"""Splits, concatenation, samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import combine, splits
from .query_index import docs
from .registry import query

RATIOS = {"train": 0.8, "test": 0.2}
_PART = "case when r < floor(0.8::double * n) then 'train' when r < floor(0.8::double * n) + floor(0.2::double * n) then 'test' end"


def _by_label(label, key="doc_id", table="documents"):
    return f"""with l as (select distinct {label} as label from {table}), p as (select label, {_PART} as split from
(select label, row_number() over (order by md5('3:' || label), label) - 1 as r, count(*) over () as n from l)) select {key}, split from {table} join p on p.label = {label}"""


@query(f"select doc_id, {_PART} as split from (select doc_id, row_number() over (order by md5('3:' || doc_id), doc_id) - 1 as r, count(*) over () as n from documents)")
def split_random(spark, d):
    return splits.split_rows(docs(spark, d).select("doc_id"), "doc_id", RATIOS, 3).select("doc_id", "split")


@query(_by_label("coalesce(source, '')"))
def split_by_label(spark, d):
    return splits.split_labels(docs(spark, d), ["source"], RATIOS, 3).select("doc_id", "split")


@query(_by_label("coalesce(lang, '') || '|' || coalesce(source, '')"))
def split_multi_feature(spark, d):
    return splits.split_labels(docs(spark, d), ["lang", "source"], RATIOS, 3).select("doc_id", "split")


@query(_by_label("cast(o_custkey as varchar)", "o_orderkey", "orders"))
def split_meta(spark, d):
    """Orders by customer: no customer is in two parts."""
    return splits.split_labels(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], RATIOS, 3).select("o_orderkey", "split")


@query("""with recursive s as (select coalesce(source, '') as label, count(*) as n from documents group by 1),
o as (select label, n, row_number() over (order by n, label) - 1 as i, sum(n) over () as total from s),
r as (select floor(0.8::double * max(total)) + 0.1::double * max(total) * 0.8::double as train, floor(0.2::double * max(total)) + 0.1::double * max(total) * 0.2::double as test from o),
a(i, label, split, in_train, in_test) as (
  select -1::bigint, '', null::varchar, 0::bigint, 0::bigint
  union all
  select i, label, split, in_train + case when split = 'train' then n else 0 end, in_test + case when split = 'test' then n else 0 end
  from (select o.i, o.label, o.n::bigint as n, a.in_train, a.in_test,
    case when o.i % 2 = 0 then (case when a.in_train + o.n < r.train then 'train' when a.in_test + o.n < r.test then 'test' end)
         else (case when a.in_test + o.n < r.test then 'test' when a.in_train + o.n < r.train then 'train' end) end as split
    from a join o on o.i = a.i + 1, r))
select doc_id, a.split from documents join a on a.label = coalesce(source, '') and a.i >= 0""")
def split_balanced(spark, d):
    return splits.split_balanced(docs(spark, d), "source", RATIOS).select("doc_id", "split")


def _members(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return combine.concatenate([c, s], [1.0, 5.0])


_ALL = "(select c_custkey as key, c_name as name, 0 as ds_id, 1.0::double as weight from customer union all select s_suppkey, s_name, 1, 5.0::double from supplier)"


@query(f"select ds_id, count(*) as n, min(name) as first_name, max(key) as last_key from {_ALL} group by ds_id")
def combined_concat(spark, d):
    return _members(spark, d).groupBy("ds_id").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("key").alias("last_key"))


@query(f"select ds_id, key, row_number() over (order by ds_id, key) - 1 as position from {_ALL}")
def combined_position(spark, d):
    return combine.positions(_members(spark, d), "key").select("ds_id", "key", "position")


@query("""with s as (select 0 as ds_id, (select count(*) from customer) as n union all select 1, (select count(*) from supplier)),
r as (select ds_id, sum(n) over (order by ds_id) - n as low, sum(n) over (order by ds_id) as high from s),
p as (select distinct event_id % (select cast(sum(n) as bigint) from s) as position from events)
select position, ds_id, cast(position - low as bigint) as local from p join r on position >= low and position < high""")
def combined_member(spark, d):
    """The positions that events ask for, all over the concatenation, to their datasets and places there."""
    sizes = _members(spark, d).groupBy("ds_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0]
    wanted = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % F.lit(total)).alias("position")).distinct()
    return combine.member_of(sizes, wanted)


@query("""with s as (select 0 as ds_id, (select count(*) from customer) as n union all select 1, (select count(*) from supplier)),
r as (select ds_id, sum(n) over (order by ds_id) - n as low, sum(n) over (order by ds_id) as high from s),
p as (select unnest(range(0, (select cast(sum(n) as bigint) from s))) as position)
select position, ds_id, cast(position - low as bigint) as local from p join r on position >= low and position < high""")
def combined_member_all(spark, d):
    """Every position in the concatenation to its dataset and place there."""
    sizes = _members(spark, d).groupBy("ds_id").agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return combine.member_of(sizes, spark.range(total).select(F.col("id").alias("position")))


@query(f"""select ds_id, key from (select *, -ln(greatest(cast(cast('0x' || md5('5:' || ds_id || '/' || key)[1:13] as bigint) as double) / 4503599627370496.0::double, 1e-16)) / weight as draw from {_ALL}) order by draw, ds_id, key limit 50""")
def combined_weighted(spark, d):
    """A weighted sample of 50 (the limit is the sample's size)."""
    return combine.weighted_sample(_members(spark, d), "key", 50, 5).select("ds_id", "key")


@query("select vec_id, row_number() over (order by md5('9:' || vec_id), vec_id) - 1 as position from embeddings")
def random_permutation(spark, d):
    return combine.random_order(spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id"), "vec_id", 9).select("vec_id", "position")


@query("""with recursive c as (select label::varchar as l, count(*)::bigint as n from embeddings group by 1),
m as (select min(n) as least from c),
s(k, live, done, slot, batch_id, l, num) as (
  select 0::bigint, (select list({'l': l, 'n': n, 't': 0::bigint} order by l) from c), 0::bigint, 0::bigint, null::bigint, null::varchar, null::bigint
  union all
  select k + 1,
    case when spent then list_concat(live[1:place - 1], live[place + 1:len(live)]) else list_concat(live[1:place - 1], [{'l': live[place].l, 'n': live[place].n, 't': live[place].t + 1}], live[place + 1:len(live)]) end,
    case when not spent and slot = 7 then done + 1 else done end, case when spent then slot else (slot + 1) % 8 end,
    case when spent then null else done end, case when spent then null else live[place].l end, case when spent then null else live[place].t + 1 end
  from (select *, live[place].n - live[place].t <= (select least from m) as spent from (select *, cast('0x' || md5('4:' || k)[1:8] as bigint) % len(live) + 1 as place from s where len(live) >= 8))),
full_ as (select * from s where batch_id is not null qualify count(*) over (partition by batch_id) = 8),
r as (select label, vec_id, row_number() over (partition by label order by md5('4:' || vec_id)) as num from embeddings)
select batch_id, label, vec_id from full_ join r on r.label::varchar = full_.l and r.num = full_.num""")
def balanced_batches(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select("label", "vec_id")
    return combine.balanced_batches(rows, "label", "vec_id", 8, 4)
