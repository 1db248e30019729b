"""Registered queries: record predicates, joins, layout and event windows, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioloom.functions import formula, markup, native, styled
from folioloom.operators import graph, joins, records
from folioloom.plans.slate import query
from folioloom.sources import keytext
from folioloom.streaming import windows

C = F.col


@query("""select lang, count(*) as n_questions, count(distinct nullif(source, 'src1')) as n_standards, count(distinct source) as n_with_blank,
count(*) filter (where length(text) < 200) as n_review from documents group by 1""")
def review_summary(spark, t):
    """Counts of a workspace; one source stands in for the blank code, which one count leaves out."""
    return t("documents").groupBy("lang").agg(F.count("*").alias("n_questions"), F.count_distinct(F.nullif("source", F.lit("src1"))).alias("n_standards"), F.count_distinct("source").alias("n_with_blank"), F.count_if(F.length("text") < 200).alias("n_review"))


@query("""select conv_id, turn, coalesce(min(case when role = 'assistant' then turn end) over (partition by conv_id order by turn rows between 1 following and unbounded following),
min(case when role = 'assistant' then turn end) over (partition by conv_id)) as next_turn from conversations""")
def next_flagged(spark, t):
    return t("conversations").select("conv_id", "turn", records.next_flagged(C("role") == "assistant", "turn", ["conv_id"]).alias("next_turn"))


@query("""select doc_id, case when text is null or trim(text) = '' then 'empty' when length(text) > 20000 then 'too_long' when contains(text, '|') then 'table' when source = 'src2' then 'source' end as error from documents""")
def storage_error(spark, t):
    text = C("text")
    rules = [("empty", text.isNull() | (F.trim(text) == "")), ("too_long", F.length(text) > 20000), ("table", F.contains(text, F.lit("|"))), ("source", C("source") == "src2")]
    return t("documents").select("doc_id", records.first_error(rules).alias("error"))


@query("""with b as (select p_partkey, (p_partkey % 13) / 10.0::double as x1, (p_partkey % 7) / 10.0::double as y1, (p_partkey % 11) / 10.0::double as x2, (p_partkey % 9) / 8.0::double as y2 from part)
select p_partkey, x1 <= 1 and y1 <= 1 and x2 <= 1 and y2 <= 1 and x1 < x2 and y1 < y2 as valid from b""")
def unit_boxes(spark, t):
    k = C("p_partkey")
    return t("part").select(k, records.unit_box(F.array((k % 13) / 10.0, (k % 7) / 10.0, (k % 11) / 10.0, (k % 9) / 8.0)).alias("valid"))


@query("""with b as (select p_partkey as k, (p_partkey % 13)::double as x1, (p_partkey % 7)::double as y1, (p_partkey % 13 + 4)::double as x2, (p_partkey % 7 + 2)::double as y2 from part)
select k as p_partkey, round(greatest(0, least(x2, 9) - greatest(x1, 3)) * greatest(0, least(y2, 6) - greatest(y1, 2)) / 8.0, 9) as share from b""")
def box_overlap(spark, t):
    """Overlap of each part's box (4 by 2) with a region (6 by 4), as a share of the smaller."""
    k = C("p_partkey")
    x, y = (k % 13).cast("double"), (k % 7).cast("double")
    return t("part").select(k, F.round(records.overlap_share([x, y, x + 4, y + 2], [F.lit(v) for v in (3.0, 2.0, 9.0, 6.0)]), 9).alias("share"))


@query("""select p_partkey, round(2.0 * p_size - 0.5 * p_retailprice + 10, 6) as x, round(0.5 * p_size + 1.5 * p_retailprice - 3, 6) as y from part""")
def affine_points(spark, t):
    x, y = records.affine([2, 0.5, -0.5, 1.5, 10, -3], C("p_size"), C("p_retailprice"))
    return t("part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("select l_orderkey, list_sort(list(l_quantity))[count(*) // 2 + 1] as median from lineitem group by 1")
def upper_median(spark, t):
    return records.upper_median(t("lineitem"), "l_orderkey", "l_quantity")


@query("""select l_orderkey, min(l_quantity) as x1, min(l_extendedprice) as y1, max(l_quantity) as x2, max(l_extendedprice) as y2 from lineitem group by 1""")
def bounding_box(spark, t):
    return t("lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x1"), F.min("l_extendedprice").alias("y1"), F.max("l_quantity").alias("x2"), F.max("l_extendedprice").alias("y2"))


@query("""with d as (select distinct l_orderkey, l_quantity from lineitem), w as (select *, lag(l_quantity) over (partition by l_orderkey order by l_quantity) as b from d)
select l_orderkey, l_quantity from w where b is null or l_quantity - b > 3""")
def tolerance_distinct(spark, t):
    return records.apart(t("lineitem"), ["l_orderkey"], "l_quantity", 3)


@query("""select l_orderkey, bool_or(l_returnflag = 'R') as any_returned, bool_and(l_linestatus = 'O') as all_open from lineitem group by 1""")
def quantifiers(spark, t):
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_or(C("l_returnflag") == "R").alias("any_returned"), F.bool_and(C("l_linestatus") == "O").alias("all_open"))


@query("""select c_mktsegment, c_custkey, c_nationkey, row_number() over (partition by c_mktsegment order by c_nationkey = 7 desc, c_acctbal desc, c_custkey) as pos from customer
qualify pos <= 6""")
def pinned_topk(spark, t):
    """The pinned nation first, then by balance; six of each segment."""
    return records.head_of(t("customer").select("c_mktsegment", "c_custkey", "c_nationkey", "c_acctbal"), ["c_mktsegment"], [F.desc(C("c_nationkey") == 7), F.desc("c_acctbal"), "c_custkey"], 6).drop("c_acctbal")


@query("""select source, doc_id, row_number() over (partition by source order by doc_id) as pos from documents qualify pos <= 80""")
def head_truncation(spark, t):
    """The first 80 of each source, as the limit of one request has it."""
    return records.head_of(t("documents").select("source", "doc_id"), ["source"], ["doc_id"], 80)


@query("""with n as (select o_orderstatus, o_orderkey, row_number() over (partition by o_orderstatus order by o_orderdate desc, o_orderkey) - 1 as n from orders)
select o_orderstatus, o_orderkey, n // 20 + 1 as page, n % 20 + 1 as pos from n""")
def paging(spark, t):
    return records.paged(t("orders").select("o_orderstatus", "o_orderkey", "o_orderdate"), ["o_orderstatus"], [F.desc("o_orderdate"), "o_orderkey"]).drop("o_orderdate")


@query("""select conv_id, string_agg(role || ' ' || length(text), ' · ' order by turn) as outline from conversations group by 1""")
def outline(spark, t):
    """Strings of a group joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(" ", "role", F.length("text")).alias("s"))))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["s"]), " · ").alias("outline"))


@query("""select c_custkey, cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint) as part, row_number() over (partition by c_nationkey order by cast(regexp_extract(c_name, '([0-9]+)$', 1) as bigint) desc) as pos from customer""")
def suffix_sort(spark, t):
    """Parts in the order of the number that ends their name."""
    rows = t("customer").select("c_custkey", "c_nationkey", F.regexp_extract("c_name", r"(\d+)\z", 1).try_cast("bigint").alias("part"))
    return records.head_of(rows, ["c_nationkey"], [F.desc("part")], 1 << 30).select("c_custkey", "part", "pos")


@query("""select l_partkey, arg_max(l_shipdate, struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey, d := l_extendedprice, e := l_shipdate)) as last_ship from lineitem group by 1""")
def last_wins(spark, t):
    """Distinct by key; the last row wins."""
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    return t("lineitem").groupBy("l_partkey").agg(F.max_by("l_shipdate", order).alias("last_ship"))


@query("""with k as (select o_custkey as k, 1 as side from orders where o_orderstatus = 'P' union all select c_custkey, 0 from customer where c_acctbal < 0)
select k, min(side) as first_list from k group by 1""")
def union_selection(spark, t):
    """Two selections united, each key once with the list that named it first."""
    a = t("customer").where("c_acctbal < 0").select(C("c_custkey").alias("k"), F.lit(0).alias("side"))
    b = t("orders").where("o_orderstatus = 'P'").select(C("o_custkey").alias("k"), F.lit(1).alias("side"))
    return a.unionByName(b).groupBy("k").agg(F.min("side").alias("first_list"))


@query(r"""with d as (select doc_id, string_split(text, chr(10)) as ls from documents) select doc_id, unnest(range(1, len(ls) + 1)) as line, length(unnest(ls)) as n_chars from d""")
def line_split(spark, t):
    """One record becomes several, in order."""
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "x"))
    return lines.select("doc_id", (C("p") + 1).cast("bigint").alias("line"), F.length("x").cast("bigint").alias("n_chars"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(least(greatest(cast(json_extract_string(props, '$.k') as double), 10.0), 60.0) as double) as held from events""")
def json_props(spark, t):
    """A JSON column under a declared schema, a number of it held between bounds."""
    props = F.from_json("props", "k string")
    return t("events").select("event_id", props["k"].cast("bigint").alias("k"), records.clamped(props["k"], 10, 60).alias("held"))


@query("""select page_id, sha256(html) as digest, md5(url) as url_digest, to_base64(encode(url)) as coded from pages""")
def digests(spark, t):
    """Digests of a text and its Base64 form, on one line: Spark may break it after 76 characters."""
    coded = F.translate(F.base64(F.encode("url", "UTF-8")), "\r\n", "")
    return t("pages").select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.md5(F.encode("url", "UTF-8")).alias("url_digest"), coded.alias("coded"))


@query("""select event_id, cast((greatest(year(ts) - 1980, 0) * 512 + month(ts) * 32 + day(ts)) * 65536 + hour(ts) * 2048 + minute(ts) * 32 + second(ts) // 2 as bigint) as stamp from events""")
def dos_stamp(spark, t):
    return t("events").select("event_id", records.dos_time(C("ts")).alias("stamp"))


@query(r"""with c as (select conv_id, turn, length(text) as n, length(regexp_replace(text, '[^\x{0}-\x{7F}]', '', 'g')) as a from conversations)
select conv_id, cast(least(2800, greatest(400, max(a * 55 + (n - a) * 100))) + 200 as bigint) as width from c group by 1""")
def column_width(spark, t):
    """Width of a column in hundredths: its longest cell between 4 and 28, and 2 of padding."""
    return t("conversations").groupBy("conv_id").agg((F.least(F.lit(2800), F.greatest(F.lit(400), F.max(records.line_width(C("text"))))) + 200).cast("bigint").alias("width"))


@query("""with e as (select l_orderkey as k, arg_max(l_returnflag, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_returnflag)) as v from lineitem where l_discount > 0.05 group by 1)
select o_orderkey, o_custkey, coalesce(v, o_orderstatus) as o_orderstatus from orders left join e on k = o_orderkey""")
def overlay_edits(spark, t):
    """Answers applied by number: the last edit wins, others stay."""
    edits = t("lineitem").where("l_discount > 0.05").select(C("l_orderkey").alias("o_orderkey"), C("l_returnflag").alias("o_orderstatus"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").alias("ord"))
    return records.overlay(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), edits, "o_orderkey", ["o_orderstatus"])


@query("select l_orderkey, min(l_partkey) as l_partkey from lineitem where l_returnflag = 'R' group by 1 having count(*) = 1")
def exactly_one(spark, t):
    return joins.exactly_one(t("lineitem").where("l_returnflag = 'R'"), "l_orderkey", "l_partkey")


@query("""with o as (select n_regionkey, count(*) as n, min(n_nationkey) as f from nation group by 1)
select s_suppkey, case when n_regionkey is null then 'full' else 'own' end as scope, coalesce(n, (select count(*) from nation)) as n_rows, coalesce(f, (select min(n_nationkey) from nation)) as first_row
from supplier left join o on n_regionkey = s_nationkey % 7""")
def scope_fallback(spark, t):
    """Regions 5 and 6 do not exist, so their suppliers get the whole catalogue."""
    wanted = t("supplier").select("s_suppkey", (C("s_nationkey") % 7).alias("__want"))
    return joins.scope_sizes(wanted, t("nation"), "__want", "n_regionkey", "n_nationkey").drop("__want")


_RULES = "(1, 'tion', 'src1', 'th', true), (2, 'ing', 'src2', 'en', false), (3, 'th.*ed', 'src1', 'er', false), (4, 'que', 'src3', 'a', true)"


@query(rf"""with rules as (select * from (values {_RULES}) r(rule, test, area, statements, preferred)),
c as (select 'src' || item_id % 5 as area, item_id as code, text as statement from benchmark),
m as (select rule, code, case when preferred then 2 else 1 end as rank from rules join c using (area) where regexp_matches(statement, statements)),
f as (select conv_id * 1000 + turn as q, rule from conversations join rules on regexp_matches(text, test, 's')),
g as (select q, code, max(rank) as rank from f join m using (rule) group by 1, 2)
select q, code, rank, row_number() over (partition by q order by rank desc, code) as pos from g qualify pos <= 6""")
def rule_mapping(spark, t):
    """Questions mapped to standards by a table of rules over both texts."""
    rules = spark.sql(f"select * from values {_RULES} as r(rule, test, area, statements, preferred)").withColumn("test", F.concat(F.lit("(?s)"), "test"))
    catalogue = t("benchmark").select(F.concat(F.lit("src"), C("item_id") % 5).alias("area"), C("item_id").alias("code"), C("text").alias("statement"))
    questions = t("conversations").select((C("conv_id") * 1000 + C("turn")).alias("q"), "text")
    return joins.top_candidates(joins.rule_candidates(questions, "text", rules, catalogue, "statement", 6))


@query("""with r as (select event_id as rid, user_id, event_id as low, event_id + 40 + event_id % 50 as high from events where event_type = 'signup')
select e.event_id, rid from events e join r on e.user_id = r.user_id and e.event_id between low and high where event_type = 'click'""")
def point_in_range(spark, t):
    """Clicks within the range that a signup of the user opens."""
    k = C("event_id")
    ranges = t("events").where("event_type = 'signup'").select("user_id", k.alias("rid"), k.alias("low"), (k + 40 + k % 50).alias("high"))
    return joins.range_join(t("events").where("event_type = 'click'").select("user_id", "event_id"), ranges, ["user_id"], "event_id", "low", "high", 64).select("event_id", "rid")


@query("""with r as (select event_id as a, user_id, event_id as al, event_id + 30 as ah from events where event_type = 'signup'), s as (select event_id as b, user_id, event_id - 20 as bl, event_id + event_id % 25 as bh from events where event_type = 'error')
select a, b from r join s using (user_id) where al <= bh and bl <= ah""")
def overlap_join(spark, t):
    k = C("event_id")
    left = t("events").where("event_type = 'signup'").select("user_id", k.alias("a"), k.alias("al"), (k + 30).alias("ah"))
    right = t("events").where("event_type = 'error'").select("user_id", k.alias("b"), (k - 20).alias("bl"), (k + k % 25).alias("bh"))
    return joins.overlap_join(left, right, ["user_id"], ("al", "bl"), ("ah", "bh"), 64).select("a", "b")


@query("""with e as (select event_id, user_id, event_id as at from events where event_type <> 'click'), m as (select event_id as mark, user_id, event_id as at from events where event_type = 'click'),
p as (select event_id, mark, row_number() over (partition by event_id order by abs(m.at - e.at), mark) as r from e left join m using (user_id)) select event_id, mark from p where r = 1""")
def nearest_mark(spark, t):
    """The click of the same user that is nearest to each other event."""
    events = t("events").select("user_id", "event_id", C("event_id").alias("at"), "event_type")
    marks = events.where("event_type = 'click'").select("user_id", "at", C("event_id").alias("mark"))
    return joins.nearest(events.where("event_type <> 'click'").drop("event_type"), marks, ["user_id"], "at", "mark").select("event_id", "mark")


@query()
def connected_components(spark, t):
    """Orders linked to others by a step that their customer sets."""
    links = t("orders").select(C("o_orderkey").alias("a"), (C("o_orderkey") + C("o_custkey") % 40).alias("b"))
    return graph.components(links)


_HOUR = "count(*) as n, round(sum(value), 4) as amount from events"


@query(f"select event_type, date_trunc('hour', ts) as since, date_trunc('hour', ts) + interval 1 hour as until, {_HOUR} group by all")
def event_tumbling(spark, t):
    return windows.tumbling(t("events"), "ts", ["event_type"], "value", "1 hour")


@query(f"""with e as (select *, unnest([0, 1]) as back from events), w as (select *, date_trunc('hour', ts) - back * interval 1 hour as since from e)
select event_type, since, since + interval 2 hours as until, {_HOUR.replace('events', 'w')} group by all""")
def event_sliding(spark, t):
    return windows.tumbling(t("events"), "ts", ["event_type"], "value", "2 hours", "1 hour")


@query("""with g as (select *, ts - lag(ts) over (partition by user_id order by ts, event_id) as pause from events),
s as (select *, sum(case when pause is null or pause >= interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from g)
select user_id, min(ts) as since, max(ts) + interval 30 minutes as until, count(*) as n, round(sum(value), 4) as amount from s group by user_id, session""")
def event_sessions(spark, t):
    return windows.sessions(t("events"), "ts", ["user_id"], "value", "30 minutes")


def _ordered_lines(t, line):
    """One text for each order, a line for each of its items in the order of their columns."""
    listed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    lines = F.transform(listed, line)
    return t("lineitem").groupBy("l_orderkey").agg(F.array_join(lines, "\n").alias("lines"))


@query("""select l_orderkey, l_linenumber as number, cast(cast(l_quantity as bigint) as varchar) as value, count(*) as n from lineitem where l_linenumber > 0 group by 1, 2, 3""")
def key_text(spark, t):
    """Orders written as answer keys and parsed again: every item comes back."""
    texts = _ordered_lines(t, lambda r: F.concat(r["l_linenumber"], F.lit(". "), r["l_quantity"].cast("bigint")))
    entries = keytext.parsed_keys(texts.withColumn("lines", F.concat(F.lit("정답\n"), "lines")), "l_orderkey", "lines")
    return entries.where("warning is null").groupBy("l_orderkey", "number", "value").agg(F.count("*").alias("n"))


@query("""select l_orderkey, 3 as n_blocks, count(*) + 1 as n_rows, cast(sum(l_partkey) as bigint) as parts from lineitem group by 1""")
def markup_tables(spark, t):
    """Orders written as pipe tables between prose and parsed again."""
    texts = _ordered_lines(t, lambda r: F.concat(F.lit("| "), r["l_partkey"], F.lit(" | $|x|$ |")))
    text = F.concat(F.lit("before\n| part | note |\n|---|---|\n"), "lines", F.lit("\nafter"))
    found = markup.parsed(texts.select("l_orderkey", text.alias("text")), "l_orderkey", "text")
    body = F.slice(C("blocks")[1]["rows"], 2, 1 << 30)
    total = F.aggregate(F.transform(body, lambda r: r[0].cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select("l_orderkey", F.size("blocks").alias("n_blocks"), F.size(C("blocks")[1]["rows"]).cast("bigint").alias("n_rows"), total.alias("parts"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, '{{it x}} _ {' || l_partkey || '} = {' || l_suppkey || '} OVER {' || l_linenumber || '}' as script, true as same_numbers from lineitem""")
def equation_script(spark, t):
    """Items written as LaTeX and converted; the Office form must hold the same numbers in order."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    latex = F.format_string("x_{%d}=\\frac{%d}{%d}", "l_partkey", "l_suppkey", "l_linenumber")
    found = formula.converted(t("lineitem").select(key.alias("item"), latex.alias("latex")), "item", "latex")
    shown = F.regexp_replace("office", "<[^>]*>", "")
    expected = F.concat(F.lit("x"), C("item.l_partkey"), F.lit("="), C("item.l_suppkey"), C("item.l_linenumber"))
    return found.select("item.*", "script", (shown == expected).alias("same_numbers"))


@query("""select l_orderkey, count(*) as n_formulae, cast(sum(length('' || l_partkey)) + 4 * count(*) as bigint) as n_chars, count(*) filter (where l_quantity > 25) as n_display from lineitem group by 1""")
def math_split(spark, t):
    """Orders written as prose with a formula for each item, in four notations, and split again."""
    body = lambda r: F.concat(F.lit("a_{"), r["l_partkey"], F.lit("}"))
    marked = lambda r: F.when(r["l_quantity"] > 40, F.concat(F.lit("$$"), body(r), F.lit("$$"))).when(r["l_quantity"] > 25, F.concat(F.lit("\\["), body(r), F.lit("\\]"))).when(r["l_quantity"] > 10, F.concat(F.lit("\\("), body(r), F.lit("\\)"))).otherwise(F.concat(F.lit("$"), body(r), F.lit("$")))
    texts = _ordered_lines(t, lambda r: F.concat(F.lit("① $5 "), marked(r), F.lit(" end")))
    texts = texts.withColumn("lines", F.regexp_replace("lines", "① \\$5 ", "item "))
    parts = formula.spans(texts, "l_orderkey", "lines").where("is_math")
    return parts.groupBy("l_orderkey").agg(F.count("*").alias("n_formulae"), F.sum(F.length("text")).alias("n_chars"), F.count_if("display").alias("n_display"))


@query(r"""with d as (select doc_id, case when doc_id % 3 = 0 then '$x ' else '' end || case when doc_id % 5 = 0 then chr(1) else '' end || text as text from documents)
select doc_id, len(regexp_extract_all(replace(text, '\$', ''), '[$]')) % 2 = 1 as unbalanced, regexp_matches(text, '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]') as damaged from d""")
def math_audit(spark, t):
    """Every third text opens a formula that it does not close and every fifth holds a control character, so that all outcomes occur."""
    spoilt = F.concat(F.when(C("doc_id") % 3 == 0, "$x ").otherwise(""), F.when(C("doc_id") % 5 == 0, "\x01").otherwise(""), "text")
    found = formula.audited(t("documents").select("doc_id", spoilt.alias("text")), "doc_id", "text")
    return found.select("doc_id", F.array_contains("issues", "latex_unbalanced").alias("unbalanced"), F.array_contains("issues", "invalid_control_character").alias("damaged"))


@query(r"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when l_quantity > 25 then '\frac{{' || l_partkey || '}}{{' || l_suppkey || '}} = x_{' || l_linenumber || '}' end as latex from lineitem""")
def script_latex(spark, t):
    """Items written as native scripts; those of small quantity leave out the braces, which is outside the subset."""
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ratio = F.when(C("l_quantity") > 25, F.format_string("{%d} OVER {%d} = x _ %d", "l_partkey", "l_suppkey", "l_linenumber")).otherwise(F.lit("a + b OVER c"))
    return native.to_latex(t("lineitem").select(key.alias("item"), ratio.alias("script")), "item", "script").select("item.*", "latex")


@query("""select l_orderkey, count(*) as n_bold, cast(sum(length('' || l_partkey)) as bigint) as n_chars, count(*) filter (where l_quantity > 25) as n_underlined from lineitem group by 1""")
def styled_runs(spark, t):
    """Orders written with each part in bold, some underlined too, and cut into runs again."""
    part = lambda r: F.when(r["l_quantity"] > 25, F.concat(F.lit("<u><b>"), r["l_partkey"], F.lit("</b></u>"))).otherwise(F.concat(F.lit("[b]"), r["l_partkey"], F.lit("[/b]")))
    texts = _ordered_lines(t, lambda r: F.concat(F.lit("part "), part(r)))
    found = styled.split_runs(texts, "l_orderkey", "lines").where("bold")
    return found.groupBy("l_orderkey").agg(F.count("*").alias("n_bold"), F.sum(F.length("text")).alias("n_chars"), F.count_if("underline").alias("n_underlined"))
