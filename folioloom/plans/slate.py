"""Registered queries of the library's own operators, with the SQL that checks them.

Each query applies one operator to a whole test table, standing in for the
document tables it is meant for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioloom.functions import text as fx
from folioloom.operators import bank, interval, match, rank, segment, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, tables) under its own name; ``tables`` reads a table by name."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_TOKENS = """list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]{{2,}}'), lambda t: t not in ('the','and','of')))"""


@query(f"""
with q as (select doc_id as q, {_TOKENS.format('text')} as ts from documents),
c as (select item_id as pos, {_TOKENS.format('text')} as ts from benchmark),
qt as (select q, unnest(ts) as t from q), ct as (select pos, unnest(ts) as t from c),
s as (select q, pos, cast(sum(5 + least(length(t), 6)) as bigint) as score from qt join ct using (t) group by all),
a as (select q.q, c.pos, coalesce(s.score, 0) as score from q cross join c left join s on s.q = q.q and s.pos = c.pos),
r as (select *, row_number() over (partition by q order by score desc, pos) as rank from a)
select q, pos, score, rank, cast(case when score <= 0 then 35 else least(96, 48 + 2 * score) end as bigint) as confidence from r where rank <= 6
""")
def token_overlap_topk(spark, t):
    """Questions (documents) against the catalogue (benchmark): the six best rows of each."""
    toks = lambda c: fx.tokens(F.col(c), "[a-z0-9]{2,}", (), ("the", "and", "of"))
    questions = t("documents").select(F.col("doc_id").alias("q"), toks("text").alias("tokens"))
    return rank.rank_catalogue(questions, t("benchmark").select(F.col("item_id").alias("pos"), toks("text").alias("tokens")))


@query("select doc_id, length(regexp_replace(text, '[^à-ÿ]', '', 'g')) as n_marked, length(text) as n_chars from documents")
def glyph_audit(spark, t):
    """Characters of an audited class; letters with marks stand in for private-use glyphs."""
    return t("documents").select("doc_id", fx.glyph_count(F.col("text"), "[à-ÿ]").cast("bigint").alias("n_marked"), F.length("text").cast("bigint").alias("n_chars"))


@query(r"""select doc_id, length(trim(regexp_replace(text, '[\s]+', ' ', 'g'))) as n_clean, length(regexp_replace(text, '[\s]+', '', 'g')) as n_compact,
sha256(trim(regexp_replace(text, '[\s]+', ' ', 'g'))) as digest from documents""")
def normalize_clean(spark, t):
    cleaned = fx.clean(F.col("text"))
    return t("documents").select("doc_id", F.length(cleaned).cast("bigint").alias("n_clean"), F.length(fx.compact(F.col("text"))).cast("bigint").alias("n_compact"), F.sha2(cleaned.cast("binary"), 256).alias("digest"))


@query("""with s as (select lang, source, count(*) as n, max(length(text)) as score, min(doc_id) as first from documents group by all)
select lang, max(score) as best_score, arg_max(first, struct_pack(a := score, b := -first)) as best_first from s group by lang""")
def subject_best(spark, t):
    """Best score of each subject with the row that carries it."""
    scores = t("documents").groupBy("lang", "source").agg(F.max(F.length("text")).cast("bigint").alias("score"), F.min("doc_id").alias("first"))
    return rank.best_by(scores, ["lang"], "score", "first")


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(l_quantity as bigint) - 10 as score,
cast(case when cast(l_quantity as bigint) - 10 <= 0 then 35 else least(96, 48 + 2 * (cast(l_quantity as bigint) - 10)) end as bigint) as confidence from lineitem""")
def score_confidence(spark, t):
    score = F.col("l_quantity").cast("bigint") - 10
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", score.alias("score"), rank.confidence(score).alias("confidence"))


@query(r"""with d as (select doc_id, regexp_replace(case when doc_id % 3 = 0 then text || text else text end, '[\s]+', '', 'g') as b from documents)
select doc_id, length(b) >= 240 and length(b) % 2 = 0 and b[1:length(b) // 2] = b[length(b) // 2 + 1:] as duplicated from d""")
def duplicated_stem(spark, t):
    """Every third text is written twice, so that both outcomes occur."""
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", "text")).otherwise(F.col("text"))
    return t("documents").select("doc_id", fx.duplicated_stem(text).alias("duplicated"))


@query("""select doc_id, array_to_string(list_filter([
case when length(text) < 200 then 'too_short' end, case when contains(text, '|') then 'table_mark' end,
case when contains(text, '$') then 'math_mark' end, case when quality is null then 'unlabelled' end,
case when quality = 0 then 'low_quality' end, case when toxic = 1 then 'toxic' end], lambda x: x is not null), ',') as codes
from documents left join (select doc_id, min(quality) as quality, max(toxic) as toxic from labels group by 1) using (doc_id)""")
def validation_flags(spark, t):
    labels = t("labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    text = F.col("text")
    rules = [("too_short", F.length(text) < 200), ("table_mark", F.contains(text, F.lit("|"))), ("math_mark", F.contains(text, F.lit("$"))), ("unlabelled", F.col("quality").isNull()), ("low_quality", F.col("quality") == 0), ("toxic", F.col("toxic") == 1)]
    return t("documents").join(labels, "doc_id", "left").select("doc_id", F.array_join(validate.flags(rules), ",").alias("codes"))


@query("""with p as (select *, case when p_size % 5 = 0 then 'fifth' else p_brand end as code from part),
c as (select *, count(*) over (partition by code) as n, count(*) over () as total from p)
select p_partkey, code, n, total, total >= 10 and n > 0.15 * total and code is not null as code_overused from c""")
def code_overused(spark, t):
    """Brands stay below the limit; the code that a fifth of the parts share exceeds it."""
    parts = t("part").withColumn("code", F.when(F.col("p_size") % 5 == 0, "fifth").otherwise(F.col("p_brand")))
    return validate.overused(parts, "code").select("p_partkey", "code", "n", "total", "code_overused")


@query("""select l_orderkey, count(*) as n, count(*) > 1 and count(l_returnflag) = count(*) and min(l_returnflag) = max(l_returnflag) as uniform from lineitem group by 1""")
def set_uniform(spark, t):
    return validate.uniform_sets(t("lineitem"), "l_orderkey", "l_returnflag")


_ENTRIES = """e as (select o_orderkey as entry, case when o_orderkey % 4 = 0 then 'c' || o_orderkey end as code, o_orderkey as number,
case when o_orderkey % 3 = 0 then o_orderstatus end as scope, o_orderpriority as value from orders),
q as (select c_custkey as question, case when c_custkey % 8 = 0 then 'c' || c_custkey end as code, c_custkey // 2 as number,
case when c_custkey % 5 = 0 then 'F' end as scope, case when c_custkey % 7 = 0 then '1-URGENT' end as answer from customer)"""


@query(f"""with {_ENTRIES},
p as (select entry, question, answer from e join q on e.code = q.code where e.code is not null
union all select entry, question, answer from e join q on e.number = q.number where e.code is null and (e.scope is null or q.scope is null or e.scope = q.scope)),
f as (select entry, count(*) as n, min(question) as question, min(answer) as answer from p group by 1)
select entry, case when n is null then 'unmatched' when n > 1 then 'ambiguous' when answer is not null and answer <> value then 'conflict' else 'matched' end as status,
coalesce(n, 0) as n, case when n = 1 then question end as question from e left join f using (entry)""")
def answer_match(spark, t):
    o, c = F.col("o_orderkey"), F.col("c_custkey")
    entries = t("orders").select(o.alias("entry"), F.when(o % 4 == 0, F.concat(F.lit("c"), o)).alias("code"), o.alias("number"), F.when(o % 3 == 0, F.col("o_orderstatus")).alias("scope"), F.col("o_orderpriority").alias("value"))
    questions = t("customer").select(c.alias("question"), F.when(c % 8 == 0, F.concat(F.lit("c"), c)).alias("code"), F.floor(c / 2).alias("number"), F.when(c % 5 == 0, "F").alias("scope"), F.when(c % 7 == 0, "1-URGENT").alias("answer"))
    return match.match_status(entries, questions)


@query("""select l_partkey, count(*) as n, case when min(l_returnflag) <> max(l_returnflag) then 'conflict' else 'ambiguous' end as status from lineitem group by 1 having count(*) > 1""")
def duplicate_conflict(spark, t):
    return match.target_conflicts(t("lineitem"), "l_partkey", "l_returnflag")


@query("""select c_custkey, n_name, n_nationkey is not null as in_catalog from customer left join nation on c_nationkey + c_custkey % 5 = n_nationkey""")
def dimension_lookup(spark, t):
    """Catalogue membership; some customers name a nation past the last one."""
    nation = t("nation").dropDuplicates(["n_nationkey"])
    return t("customer").join(nation, F.col("c_nationkey") + F.col("c_custkey") % 5 == F.col("n_nationkey"), "left").select("c_custkey", "n_name", F.col("n_nationkey").isNotNull().alias("in_catalog"))


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def scope_semi(spark, t):
    return t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select o_orderkey from orders o where not exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey)")
def unreferenced_anti(spark, t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""with p as (select case when p_size % 10 = 0 then ' ' else p_brand end as code, p_type, p_partkey from part)
select case when trim(code) = '' then '분류 확인 필요' else p_type end as domain, case when trim(code) = '' then '미분류' else trim(code) end as code,
count(*) as n, string_agg(cast(p_partkey as varchar), ',' order by p_partkey) as members from p group by 1, 2""")
def group_by_standard(spark, t):
    parts = t("part").withColumn("code", F.when(F.col("p_size") % 10 == 0, " ").otherwise(F.col("p_brand")))
    return bank.grouped(parts, "p_type", "code", "p_partkey", "p_partkey")


@query("""with l as (select o_custkey, o_orderkey, count(l_orderkey) as n_lines from orders left join lineitem on o_orderkey = l_orderkey group by all)
select o_custkey, count(*) as n_orders, cast(sum(n_lines) as bigint) as n_captures, count(*) filter (where n_lines = 0) as n_missing,
array_to_string(list(o_orderkey order by o_orderkey) filter (where n_lines = 0)[1:5], ',') as missing_labels from l group by 1""")
def export_summary(spark, t):
    """Captures of each set, how many items lack one, and the first five of those."""
    lines = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_lines"))
    rows = t("orders").join(lines, F.col("o_orderkey") == F.col("k"), "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))
    none = F.col("n_lines") == 0
    missing = F.slice(F.array_sort(F.collect_list(F.when(none, F.col("o_orderkey")))), 1, 5)
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.sum("n_lines").alias("n_captures"), F.count_if(none).alias("n_missing"), F.when(F.count_if(none) > 0, F.array_join(missing, ",")).alias("missing_labels"))


@query("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderpriority, o_orderkey) as pos from orders""")
def bank_list(spark, t):
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderpriority", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("pos"))


@query("""select doc_id, source from documents where contains(lower(concat_ws(' ', source, lang, text)), 'the er') and source = 'src1'""")
def bank_search(spark, t):
    return bank.search(t("documents"), " The ER ", ["source", "lang", "text"], ("source", "src1")).select("doc_id", "source")


@query("""with w as (select row_number() over (order by c_custkey) - 1 as pos, (c_custkey * 37) % 20000 as id from customer)
select pos, id, o_totalprice, o_orderkey is not null as found from w left join orders on o_orderkey = id""")
def bank_select(spark, t):
    """Ids in the order of the request; those that are missing are told."""
    asked = bank.numbered(t("customer").select("c_custkey"), "c_custkey", "n")
    ids = asked.select((F.col("n") - 1).alias("pos"), ((F.col("c_custkey") * 37) % 20000).alias("id"))
    return bank.select_ordered(t("orders"), "o_orderkey", ids).select("pos", "id", "o_totalprice", "found")


@query("""select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1""")
def snapshot_replace(spark, t):
    return bank.last_snapshot(t("events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'NEW' else c_mktsegment end as c_mktsegment, c_custkey % 3 = 0 as applied from customer""")
def cas_update(spark, t):
    """Every customer gets an update; two thirds of them name an old revision."""
    current = t("customer").select("c_custkey", "c_mktsegment")
    rev = match.revision(F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lit("old")))
    updates = current.select("c_custkey", rev.alias("expected"), F.lit("NEW").alias("c_mktsegment"))
    return match.compare_and_swap(current, updates, "c_custkey", ["c_mktsegment"])


@query("""with v as (select o_orderkey, o_orderpriority as base, case when o_orderkey % 2 = 0 then 'edited' else o_orderpriority end as cur,
case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then 'edited' else o_orderpriority end as inc from orders)
select o_orderkey, case when cur is distinct from base then cur else inc end as merged,
cur is distinct from base and inc is distinct from cur and inc is distinct from base as conflict from v""")
def three_way_merge(spark, t):
    k, base = F.col("o_orderkey"), F.col("o_orderpriority")
    cur = F.when(k % 2 == 0, "edited").otherwise(base)
    inc = F.when(k % 3 == 0, F.lit(None)).when(k % 5 == 0, "edited").otherwise(base)
    merged, conflict = match.three_way(base, cur, inc)
    return t("orders").select("o_orderkey", merged.alias("merged"), conflict.alias("conflict"))


@query("""select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows unbounded preceding) as carried from events""")
def carry_forward(spark, t):
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t("events").select("event_id", segment.carry_forward(value, ["user_id"], ["ts", "event_id"]).alias("carried"))


@query("""select conv_id, turn, cast(sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn rows unbounded preceding) as bigint) as section from conversations""")
def section_islands(spark, t):
    return t("conversations").select("conv_id", "turn", segment.island(F.col("role") == "user", ["conv_id"], ["turn"]).alias("section"))


@query("""with s as (select conv_id, turn from conversations where role = 'user')
select conv_id, turn, lead(turn) over w as until, coalesce(lead(turn) over w > turn + 1, false) as gap from s window w as (partition by conv_id order by turn)""")
def question_spans(spark, t):
    """A question starts at each turn of the user and holds what follows."""
    return segment.spans(t("conversations").where("role = 'user'").select("conv_id", "turn"), ["conv_id"], "turn")


@query("""select e.event_id, m.event_id as mark_mark_id, m.value as mark_value from events e asof left join (select * from events where event_type = 'click') m
on e.user_id = m.user_id and e.ts >= m.ts where e.event_type <> 'click'""")
def passage_asof(spark, t):
    """Each event with the latest click of its user at or before it."""
    events = t("events").select("user_id", "ts", "event_id", "event_type", "value")
    facts = events.where("event_type <> 'click'").select("user_id", "ts", "event_id")
    marks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("mark_id"), "value")
    return segment.as_of(facts, marks, ["user_id"], "ts", ["mark_id", "value"]).drop("user_id", "ts")


@query("""with l as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, max(l_partkey) over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_extendedprice rows between unbounded preceding and 1 preceding) as m from lineitem)
select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice from l where m is null or l_partkey > m""")
def running_max_accept(spark, t):
    order = ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"]
    rows = t("lineitem").withColumn("ok", segment.accepted(F.col("l_partkey"), ["l_orderkey"], order))
    return rows.where("ok").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")


@query()
def lis_gap12(spark, t):
    """Longest ascending chain of each user's minute values, steps of at most 12."""
    events = t("events").select("user_id", "event_id", F.pmod("event_id", F.lit(97)).alias("n"))
    return segment.longest_chain(events, "user_id", "event_id", "n")


@query("""with recursive n as (select *, row_number() over (partition by l_orderkey order by l_quantity, l_partkey, l_suppkey, l_linenumber) as k from lineitem),
c as (select l_orderkey, l_quantity, l_partkey, l_suppkey, l_linenumber, k, l_quantity as anchor, cast(0 as bigint) as line from n where k = 1
union all select n.l_orderkey, n.l_quantity, n.l_partkey, n.l_suppkey, n.l_linenumber, n.k, case when n.l_quantity - anchor > 2.5 then n.l_quantity else anchor end, line + case when n.l_quantity - anchor > 2.5 then 1 else 0 end
from c join n on n.l_orderkey = c.l_orderkey and n.k = c.k + 1)
select l_orderkey, l_quantity, l_partkey, l_suppkey, l_linenumber, line from c""")
def row_cluster(spark, t):
    """Lines of each order clustered by quantity within 2.5."""
    rows = t("lineitem").select("l_orderkey", "l_quantity", "l_partkey", "l_suppkey", "l_linenumber")
    return segment.row_clusters(rows, ["l_orderkey"], "l_quantity", ["l_partkey", "l_suppkey", "l_linenumber"], 2.5)


_SPAN = "select o_custkey, epoch(o_orderdate) // 86400 as low, epoch(o_orderdate) // 86400 + 30 + o_orderkey % 60 as high from orders"
_MERGE = f"""with s as ({_SPAN}), r as (select *, max(high) over (partition by o_custkey order by low, high rows between unbounded preceding and 1 preceding) as reach from s),
i as (select *, sum(case when reach is null or low > reach then 1 else 0 end) over (partition by o_custkey order by low, high rows unbounded preceding) as island from r),
m as (select o_custkey, cast(min(low) as bigint) as low, cast(max(high) as bigint) as high, count(*) as n from i group by o_custkey, island)"""


def _order_spans(t):
    low = F.floor(F.unix_timestamp("o_orderdate") / 86400)
    return t("orders").select("o_custkey", low.alias("low"), (low + 30 + F.col("o_orderkey") % 60).alias("high"))


@query(_MERGE + " select * from m")
def interval_merge(spark, t):
    return interval.merged(_order_spans(t), ["o_custkey"], "low", "high")


@query(_MERGE + " select o_custkey, cast(sum(high - low) as bigint) as covered, max(high) - min(low) as span from m group by 1")
def interval_coverage(spark, t):
    return interval.coverage(_order_spans(t), ["o_custkey"], "low", "high")


@query("""with c as (select distinct user_id, epoch_us(ts) // 3600000000 as cell from events), n as (select *, lead(cell) over (partition by user_id order by cell) as nx from c)
select user_id, cell + 1 as first_empty, nx - 1 as last_empty from n where nx > cell + 1""")
def gutter_gaps(spark, t):
    return interval.empty_cells(t("events").select("user_id", F.floor(F.unix_timestamp("ts") / 3600).alias("cell")), ["user_id"], "cell")


@query("select event_id, cast(ceil((epoch_us(ts) // 1000000 - 1800.0) / 3600) * 3600 as bigint) as tick from events")
def nearest_tick(spark, t):
    return t("events").select("event_id", interval.nearest_tick(F.unix_timestamp("ts"), 3600).alias("tick"))


@query("""with b as (select p_partkey, p_brand, p_type, p_size as low, p_size + p_partkey % 9 as high, p_partkey % 9 as area from part),
p as (select i.p_partkey, o.p_partkey as outer_key, o.area from b i join b o on i.p_brand = o.p_brand and i.p_type = o.p_type and o.low <= i.low and o.high >= i.high and o.area > i.area)
select p_partkey, arg_min(outer_key, struct_pack(a := area, k := outer_key)) as parent from p group by 1""")
def smallest_container(spark, t):
    k = F.col("p_partkey")
    boxes = t("part").select("p_partkey", "p_brand", "p_type", F.col("p_size").alias("low"), (F.col("p_size") + k % 9).alias("high"), (k % 9).alias("area"))
    return interval.smallest_container(boxes, "p_partkey", ["p_brand", "p_type"], "low", "high", "area")


@query(r"""with p as (select a.conv_id, a.turn, regexp_replace(a.text, '\s', '', 'g') as x, regexp_replace(b.text, '\s', '', 'g') as y from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1),
u as (select conv_id, turn, unnest(string_split(x, '')) as ch from p), v as (select conv_id, turn, unnest(string_split(y, '')) as ch from p),
a as (select conv_id, turn, ch, count(*) as n from u group by all), b as (select conv_id, turn, ch, count(*) as n from v group by all)
select conv_id, turn, cast(sum(a.n) as bigint) as n_chars, cast(sum(least(a.n, coalesce(b.n, 0))) as bigint) as n_covered from a left join b using (conv_id, turn, ch) group by all""")
def char_coverage(spark, t):
    """Characters of each turn that the next turn holds as often."""
    turns = t("conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    pairs = turns.join(after, ["conv_id", "turn"]).withColumn("key", F.struct("conv_id", "turn"))
    return validate.char_coverage(pairs, "key", "text", "next").select("key.conv_id", "key.turn", "n_chars", "n_covered")


@query("select event_type, min(event_id) as first_seen from events group by 1")
def first_seen_distinct(spark, t):
    return bank.first_of(t("events"), "event_type", F.col("event_id"))


@query("""with f as (select sha256(text) as digest, min(doc_id) as first_row, count(*) as n from documents group by 1)
select digest, first_row, n, row_number() over (order by first_row) as image_id from f""")
def dense_payload_ids(spark, t):
    return bank.payload_ids(t("documents"), "text", "doc_id")


@query("""with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(sum(l_extendedprice) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice rows unbounded preceding), 4) as total from lineitem)
select *, total <= 100000 as fits from r""")
def running_total_cap(spark, t):
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return bank.running_total(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_extendedprice", 100000)


@query("""select user_id, count(*) as requests, count(*) filter (where event_type = 'error') as failures, round(sum(value), 4) as amount from events group by 1""")
def usage_rollup(spark, t):
    return t("events").groupBy("user_id").agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.sum("value"), 4).alias("amount"))


@query("""with v as (select p_brand, case when p_partkey % 11 = 0 then 'beta' else 'v' || p_partkey % 3 || '.' || p_size || '.' || p_partkey % 20 end as tag, p_partkey % 3 as a, p_size as b, p_partkey % 20 as c from part)
select p_brand, arg_max(tag, struct_pack(a := a, b := b, c := c)) filter (where tag <> 'beta') as latest from v group by 1""")
def version_argmax(spark, t):
    """Highest stable version of each brand, compared number by number."""
    k = F.col("p_partkey")
    tag = F.when(k % 11 == 0, "beta").otherwise(F.concat(F.lit("v"), k % 3, F.lit("."), F.col("p_size"), F.lit("."), k % 20))
    rows = t("part").withColumn("tag", tag).withColumn("key", fx.version_key(F.col("tag")))
    return rows.groupBy("p_brand").agg(F.max_by("tag", "key").alias("latest"))


@query(r"""with p as (select page_id, case page_id % 6 when 0 then '=' when 1 then '"-' when 2 then '+' when 3 then '  =' when 4 then chr(8203) || '@' else '' end || url as v from pages)
select page_id, '"' || replace(case when regexp_matches(v, '^[\s\p{Z}\p{Cc}\p{Cf}]*[=+@-]') then '''' || v else v end, '"', '""') || '"' as cell from p""")
def csv_neutralise(spark, t):
    """Among the pages' addresses some that begin as formulae do, plainly or behind characters that do not show."""
    k = F.col("page_id") % 6
    value = F.concat(F.when(k == 0, "=").when(k == 1, '"-').when(k == 2, "+").when(k == 3, "  =").when(k == 4, "\u200b@").otherwise(""), F.col("url"))
    return t("pages").select("page_id", fx.csv_cell(value).alias("cell"))


@query("""select r_name as name, row_number() over (order by 0, r_name) as pos from region union all
select n_name, (select count(*) from region) + row_number() over (order by n_name) from nation""")
def union_renumber(spark, t):
    """Catalogues appended, ordinals numbered on; both sides are dimensions."""
    both = t("region").select(F.lit(0).alias("part"), F.col("r_name").alias("name")).unionByName(t("nation").select(F.lit(1).alias("part"), F.col("n_name").alias("name")))
    return both.select("name", F.row_number().over(Window.orderBy("part", "name")).alias("pos"))


@query("select o_custkey from orders except all select c_custkey from customer")
def bag_difference(spark, t):
    return t("orders").select("o_custkey").exceptAll(t("customer").select(F.col("c_custkey").alias("o_custkey")))


@query("""with c as (select conv_id, turn, list_distinct(list_transform(range(1, length(text)), lambda i: text[i:i + 1])) as g from conversations)
select a.conv_id, a.turn, len(a.g) as n_bigrams, len(list_intersect(a.g, b.g)) as n_shared, len(a.g) > 8 and len(list_intersect(a.g, b.g)) > 0.6 * len(a.g) as similar
from c a join c b on a.conv_id = b.conv_id and b.turn = a.turn + 1""")
def bigram_containment(spark, t):
    """Bigrams of each turn that the next turn holds."""
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, F.lit(2))))
    rows = t("conversations").select("conv_id", "turn", F.when(F.length("text") > 1, grams).otherwise(F.array().cast("array<string>")).alias("g"))
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    shared = F.size(F.array_intersect("g", "h"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.size("g").cast("bigint").alias("n_bigrams"), shared.cast("bigint").alias("n_shared"), ((F.size("g") > 8) & (shared > 0.6 * F.size("g"))).alias("similar"))
