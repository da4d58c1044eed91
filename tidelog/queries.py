"""Registered queries over the test tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import wire
from tidelog.log import Log
from tidelog.operators import introspect, series, vector
from tidelog.plans import frontends
from tidelog.plans.compiler import query, recent, run
from tidelog.plans.language import interval, parse
from tidelog.sources import formats, store
from tidelog.streaming import tail

#: Order columns, time and message field of the tables.
TABLES = {
    "events": {"time": "ts", "order": ("ts", "event_id"), "msg": "event_type", "stream": ("event_type",)},
    "documents": {"order": ("doc_id",), "msg": "text"},
    "orders": {"time": "o_orderdate", "order": ("o_orderdate", "o_orderkey")},
    "lineitem": {"time": "l_shipdate", "order": ("l_shipdate", "l_orderkey", "l_linenumber")},
    "customer": {"order": ("c_custkey",), "msg": "c_name"},
    "nation": {"order": ("n_nationkey",), "msg": "n_name"},
    "pages": {"order": ("page_id",), "msg": "html"},
    "conversations": {"order": ("conv_id", "turn"), "msg": "text"},
}
DAY = 86400 * 10**9


def log(spark: SparkSession, sf_dir: str, table: str, **changes) -> Log:
    return Log(spark.read.parquet(f"{sf_dir}/{table}.parquet"), **(TABLES[table] | changes))


#: name: (table, query, SQL)
CATALOGUE = {
    "scan_all": ("events", "*", "select event_id, ts, user_id, event_type, value, props from events"),
    "filter_eq": ("events", "event_type:=error | fields event_id, ts, value", "select event_id, ts, value from events where event_type='error'"),
    "filter_ne": ("events", "event_type:!=error | fields event_id", "select event_id from events where event_type<>'error'"),
    "filter_message": ("documents", "the | fields doc_id", "select doc_id from documents where contains(text,'the')"),
    "filter_prefix": ("events", "event_type:s* | fields event_id, event_type", "select event_id, event_type from events where starts_with(event_type,'s')"),
    "filter_substring": ("documents", "text:*the* | fields doc_id", "select doc_id from documents where contains(text,'the')"),
    "filter_regex": ("documents", 'text:~"[0-9]{3,}" | fields doc_id', "select doc_id from documents where regexp_matches(text,'[0-9]{3,}')"),
    "filter_icontains": ("documents", 'text:i("THE") | fields doc_id', "select doc_id from documents where contains(lower(text), 'the')"),
    "filter_seq": ("documents", 'text:seq("a","the") | fields doc_id', "select doc_id from documents where instr(text,'a')>0 and instr(substr(text, instr(text,'a')+1),'the')>0"),
    "filter_num_cmp": ("events", "value:>=100 | fields event_id, value", "select event_id, value from events where value >= 100"),
    "filter_range_open": ("events", "value:range(50,100) | fields event_id, value", "select event_id, value from events where value > 50 and value < 100"),
    "filter_range_closed": ("events", "value:range[50,100] | fields event_id, value", "select event_id, value from events where value between 50 and 100"),
    "filter_len_range": ("documents", "text:len_range(1,200) | fields doc_id", "select doc_id from documents where octet_length(encode(text)) between 1 and 200"),
    "filter_string_range": ("events", "event_type:string_range(a,f) | fields event_id", "select event_id from events where event_type >= 'a' and event_type < 'f'"),
    "filter_in": ("events", "event_type:in(error,view) | fields event_id", "select event_id from events where event_type in ('error','view')"),
    "filter_bool": ("events", "(event_type:=error OR event_type:=view) AND NOT value:<50 | fields event_id", "select event_id from events where (event_type='error' or event_type='view') and not (value < 50)"),
    "filter_empty": ("documents", 'lang:="" | fields doc_id', "select doc_id from documents where coalesce(lang,'')=''"),
    "filter_any": ("documents", "lang:* | fields doc_id", "select doc_id from documents where coalesce(lang,'')<>''"),
    "filter_field_cmp": ("lineitem", "l_quantity:gt_field(l_linenumber) | fields l_orderkey, l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_quantity > l_linenumber"),
    "filter_eq_field": ("lineitem", "l_orderkey:eq_field(l_partkey) | fields l_orderkey, l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_orderkey = l_partkey"),
    "filter_stream": ("events", '_stream:{event_type=~"e.*|v.*",event_type!="view"} | fields event_id', "select event_id from events where regexp_matches(event_type,'e.*|v.*') and event_type<>'view'"),
    "filter_mid": ("events", "* | stats by (user_id) count() n | filter n:>10", "select user_id, count(*) n from events group by 1 having count(*) > 10"),
    "filter_in_subquery": ("orders", "o_custkey:in(o_totalprice:>400000 | fields o_custkey) | fields o_orderkey", "select o_orderkey from orders where o_custkey in (select o_custkey from orders where o_totalprice > 400000)"),
    "filter_not_in_subquery": ("orders", "NOT o_custkey:in(o_totalprice:>100000 | fields o_custkey) | fields o_orderkey", "select o_orderkey from orders where o_custkey not in (select o_custkey from orders where o_totalprice > 100000)"),
    "filter_or_subquery": ("orders", "o_orderstatus:=F OR o_custkey:in(o_totalprice:>400000 | fields o_custkey) | fields o_orderkey", "select o_orderkey from orders where o_orderstatus='F' or o_custkey in (select o_custkey from orders where o_totalprice > 400000)"),
    "time_day": ("events", "_time:2024-01-15 | fields event_id", "select event_id from events where ts >= timestamp '2024-01-15' and ts < timestamp '2024-01-16'"),
    "time_range": ("events", "_time:[2024-01-10, 2024-01-12] | fields event_id", "select event_id from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-13'"),
    "time_after": ("events", "_time:>2024-01-10T12:30 | fields event_id", "select event_id from events where ts >= timestamp '2024-01-10 12:31:00'"),
    "time_day_range": ("events", "_time:day_range[09:00, 17:30] | fields event_id", "select event_id from events where hour(ts)*60+minute(ts) between 540 and 1050"),
    "time_week_range": ("events", "_time:week_range[Mon, Fri] | fields event_id", "select event_id from events where dayofweek(ts) between 1 and 5"),
    "stats_by": ("events", "* | stats by (event_type) count() n, min(value) lo, max(value) hi, sum(user_id) s", "select event_type, count(*) n, min(value) lo, max(value) hi, cast(sum(user_id) as bigint) s from events group by 1"),
    "stats_if": ("events", "* | stats count() if (event_type:=error) errors, count() total", "select count(*) filter (where event_type='error') errors, count(*) total from events"),
    "stats_count_uniq": ("events", "* | stats by (event_type) count_uniq(user_id) u, uniq(props) p", "select event_type, count(distinct user_id) u, count(distinct props) p from events group by 1"),
    "stats_quantile": ("events", "* | stats by (event_type) quantile(0.5, value) p50, quantile(0.9, value) p90, median(value) m", "select event_type, list_sort(list(value))[cast(floor(0.5*count(*)) as bigint)+1] p50, list_sort(list(value))[cast(floor(0.9*count(*)) as bigint)+1] p90, list_sort(list(value))[cast(floor(0.5*count(*)) as bigint)+1] m from events group by 1"),
    "stats_uniq_values": ("events", "* | stats by (event_type) uniq_values(user_id) v", "select event_type, cast(to_json(list_sort(list_distinct(list(cast(user_id as varchar))))) as varchar) v from events group by 1"),
    "stats_values": ("orders", "* | stats by (o_orderpriority) values(o_orderkey) v", "select o_orderpriority, cast(to_json(list(cast(o_orderkey as varchar) order by o_orderdate, o_orderkey)[1:10000]) as varchar) v from orders group by 1"),
    "stats_sum_len": ("documents", "* | stats by (lang) sum_len(text) n", "select coalesce(lang,'') lang, cast(sum(octet_length(encode(text))) as bigint) n from documents group by 1"),
    "stats_count_empty": ("documents", "* | stats count_empty(text) n", "select count(*) filter (where coalesce(text,'')='') n from documents"),
    "stats_row_any": ("events", "* | stats by (event_type) row_any(props) p", "select event_type, arg_min(props, (ts, event_id)) p from events group by 1"),
    "stats_row_max": ("events", "* | stats by (event_type) row_max(value, event_id) e, row_min(value, event_id) f", "select event_type, arg_max(event_id, (value, -epoch_us(ts), -event_id)) e, arg_min(event_id, (value, epoch_us(ts), event_id)) f from events group by 1"),
    "time_window_stats": ("events", "_time:2024-01 | stats by (event_type) count() n", "select event_type, count(*) n from events where ts >= timestamp '2024-01-01' and ts < timestamp '2024-02-01' group by 1"),
    "uniq_by": ("events", "* | uniq by (event_type, user_id)", "select distinct event_type, user_id from events"),
    "top_n": ("events", "* | top 5 by (user_id)", "select user_id, count(*) hits from events group by 1 order by 2 desc, cast(user_id as varchar) limit 5"),
    "sort_limit": ("orders", "* | sort by (o_totalprice, o_orderkey) desc limit 10 | fields o_orderkey, o_totalprice", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 10"),
    "first_n": ("orders", "* | first 5 by (o_totalprice) | fields o_orderkey", "select o_orderkey from orders order by o_totalprice, o_orderdate, o_orderkey limit 5"),
    "last_n": ("orders", "* | last 5 by (o_totalprice) | fields o_orderkey", "select o_orderkey from orders order by o_totalprice desc, o_orderdate, o_orderkey limit 5"),
    "limit_n": ("events", "event_type:=error | fields event_id | limit 10", "select event_id from events where event_type='error' order by ts, event_id limit 10"),
    "offset_limit": ("orders", "* | sort by (o_orderkey) | offset 10 | limit 20 | fields o_orderkey", "select o_orderkey from orders order by o_orderkey limit 20 offset 10"),
    "tail_n": ("events", "* | tail 10 | fields event_id", "select event_id from events order by ts desc, event_id desc limit 10"),
    "sample_n": ("events", "* | sample 10 | fields event_id", "select event_id from (select event_id, row_number() over (order by ts, event_id)-1 i from events) where i%10=0"),
    "rename_copy_delete": ("nation", "* | rename n_name as nm | copy nm as nm2 | delete n_regionkey", "select n_nationkey, n_name nm, n_name nm2 from nation"),
    "math": ("lineitem", "* | math l_extendedprice * (1 - l_discount) as net | fields l_orderkey, l_linenumber, net", "select l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) net from lineitem"),
    "math_div": ("lineitem", "* | math l_extendedprice / (l_linenumber - 1) as d | fields l_orderkey, l_linenumber, d", "select l_orderkey, l_linenumber, case when l_linenumber=1 then 0.0 else l_extendedprice/(l_linenumber-1) end d from lineitem"),
    "format": ("nation", '* | format "<n_name>/<n_regionkey>" as k | fields n_nationkey, k', "select n_nationkey, n_name||'/'||n_regionkey k from nation"),
    "len": ("documents", "* | len(text) as n | fields doc_id, n", "select doc_id, coalesce(octet_length(encode(text)),0) n from documents"),
    "replace": ("customer", '* | replace ("Customer","C") at c_name | fields c_custkey, c_name', "select c_custkey, replace(c_name,'Customer','C') c_name from customer"),
    "replace_regexp": ("customer", '* | replace_regexp ("([0-9])[0-9]*","N$1") at c_name | fields c_custkey, c_name', r"select c_custkey, regexp_replace(c_name,'([0-9])[0-9]*','N\1','g') c_name from customer"),
    "extract": ("pages", '* | extract "://<host>/" from url | fields page_id, host', "select page_id, case when strpos(substr(url,strpos(url,'://')+3),'/')>0 then split_part(substr(url,strpos(url,'://')+3),'/',1) else substr(url,strpos(url,'://')+3) end host from pages"),
    "extract_regexp": ("pages", '* | extract_regexp "https?://(?P<host>[^/]+)" from url | fields page_id, host', "select page_id, regexp_extract(url,'https?://([^/]+)',1) host from pages"),
    "collapse_nums": ("customer", "* | collapse_nums at c_name | stats by (c_name) count() n", "select regexp_replace(c_name,'[0-9]+','<N>','g') c_name, count(*) n from customer group by 1"),
    "decolorize": ("conversations", "* | decolorize text | fields conv_id, turn, text", r"select conv_id, turn, regexp_replace(text,'\x1b\[[0-9;?]*[ -/]*[@-~]','','g') as text from conversations"),
    "unpack_json": ("events", "* | unpack_json from props | stats by (k) count() n", "select json_extract_string(props,'$.k') k, count(*) n from events group by 1"),
    "unpack_json_prefix": ("events", "* | unpack_json from props prefix p_ | filter p_k:>50 | fields event_id, p_k", "select event_id, json_extract_string(props,'$.k') p_k from events where cast(json_extract_string(props,'$.k') as double) > 50"),
    "unpack_words": ("conversations", "* | unpack_words from text as w | json_array_len(w) as n | fields conv_id, turn, n", "select conv_id, turn, coalesce(len(list_distinct(regexp_extract_all(text,'[A-Za-z0-9_]+'))),0) n from conversations"),
    "pack_json": ("nation", "* | pack_json fields (n_name, n_regionkey) as j | fields n_nationkey, j", """select n_nationkey, '{"n_name":"'||n_name||'","n_regionkey":"'||n_regionkey||'"}' j from nation"""),
    "pack_logfmt": ("orders", "* | pack_logfmt fields (o_orderkey, o_orderstatus) as j | fields o_orderkey, j", "select o_orderkey, 'o_orderkey='||o_orderkey||' o_orderstatus='||o_orderstatus j from orders"),
    "unroll": ("conversations", "* | unroll (text) | stats by (text) count() n | filter text:*", r"select tok as text, count(*) n from (select unnest(regexp_extract_all(text,'[^ \t\r\n]+')) tok from conversations) group by 1"),
    "rank": ("documents", '* | rank "the and" at text | fields doc_id, _score', "select doc_id, cast(coalesce((length(text)-length(replace(text,'the','')))/3 + (length(text)-length(replace(text,'and','')))/3, 0) as bigint) _score from documents"),
    "union": ("events", "event_type:=error | union (event_type:=view) | fields event_id", "select event_id from events where event_type='error' union all select event_id from events where event_type='view'"),
    "join_left": ("orders", "o_totalprice:>300000 | join by (o_custkey) (* | stats by (o_custkey) count() orders) | fields o_orderkey, orders", "select o_orderkey, n as orders from orders join (select o_custkey, count(*) n from orders group by 1) using (o_custkey) where o_totalprice > 300000"),
    "stream_context": ("events", "event_type:=error value:>300 | stream_context before 1 after 1 | fields event_id", "with o as (select *, row_number() over (order by ts, event_id) i from events), m as (select i from o where event_type='error' and value>300) select distinct o.event_id from o join m on o.i between m.i-1 and m.i+1"),
    "field_values": ("events", "* | field_values event_type", "select event_type as value, count(*) hits from events group by 1"),
    "filter_ne_field": ("lineitem", "l_orderkey:ne_field(l_partkey) | fields l_orderkey, l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_orderkey <> l_partkey"),
    "filter_lt_field": ("lineitem", "l_quantity:lt_field(l_linenumber) | fields l_orderkey, l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_quantity < l_linenumber"),
    "filter_le_field": ("lineitem", "l_quantity:le_field(l_linenumber) | fields l_orderkey, l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_quantity <= l_linenumber"),
    "filter_ge_field": ("lineitem", "l_quantity:ge_field(l_linenumber) | fields l_orderkey, l_linenumber", "select l_orderkey, l_linenumber from lineitem where l_quantity >= l_linenumber"),
    "filter_ipv4_range": ("customer", '* | format "10.0.<c_nationkey>.<c_custkey>" as ip | filter ip:ipv4_range("10.0.3.0", "10.0.9.255") | fields c_custkey', "select c_custkey from customer where c_custkey <= 255 and c_nationkey between 3 and 9"),
    "filter_posix_class": ("customer", 'c_name:~"^[[:alpha:]]+#[[:digit:]]*7[[:digit:]]$" | fields c_custkey', "select c_custkey from customer where regexp_matches(c_name, '^[a-zA-Z]+#[0-9]*7[0-9]$')"),
    "filter_time_window": ("events", "_time:[2024-01-05, 2024-01-06] event_type:=view | stats by (user_id) count() n", "select user_id, count(*) n from events where event_type='view' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-07' group by 1"),
    "sort_sample": ("events", "* | sort by (user_id) desc | sample 25 | fields event_id", "select event_id from (select event_id, row_number() over (order by user_id desc, ts, event_id)-1 i from events) where i%25=0"),
    "sort_text_sample": ("events", "* | sort by (event_type) | sample 40 | fields event_id", "select event_id from (select event_id, row_number() over (order by event_type, ts, event_id)-1 i from events) where i%40=0"),
    "sort_tail": ("orders", "* | sort by (o_totalprice) desc | tail 7 | fields o_orderkey", "select o_orderkey from orders order by o_totalprice, o_orderdate desc, o_orderkey desc limit 7"),
    "sort_values": ("orders", "o_orderkey:<2000 | sort by (o_totalprice) desc | stats by (o_orderpriority) values(o_orderkey) v, row_any(o_orderstatus) s", "select o_orderpriority, cast(to_json(list(cast(o_orderkey as varchar) order by o_totalprice desc, o_orderdate, o_orderkey)[1:10000]) as varchar) v, arg_max(o_orderstatus, (o_totalprice, -epoch(o_orderdate), -o_orderkey)) s from orders where o_orderkey < 2000 group by 1"),
    "sort_fields_limit": ("orders", "* | sort by (o_totalprice) desc | fields o_orderkey | limit 9", "select o_orderkey from orders order by o_totalprice desc, o_orderdate, o_orderkey limit 9"),
    "union_limit": ("events", "value:>=50 | union (value:<50) | limit 2000 | fields event_id", "select event_id from (select event_id, 0 s, ts from events where value>=50 union all select event_id, 1, ts from events where value<50) order by s, ts, event_id limit 2000"),
    "offset_alone": ("events", "event_type:=error | offset 100 | fields event_id", "select event_id from (select event_id, row_number() over (order by ts, event_id) i from events where event_type='error') where i > 100"),
    "sample_by_text_order": ("nation", "* | sort by (n_name) desc | sample 4 | fields n_nationkey", "select n_nationkey from (select n_nationkey, row_number() over (order by n_name desc, n_nationkey)-1 i from nation) where i%4=0"),
    "number_text": ("nation", '* | math n_nationkey * 250000 as a | math n_nationkey / 8 as b | format "<a>;<b>" as k | fields n_nationkey, k', "select n_nationkey, (case when n_nationkey*250000 < 1000000 then cast(n_nationkey*250000 as varchar) else regexp_replace(regexp_replace(cast(n_nationkey*250000/1000000.0 as varchar), '0+$', ''), '[.]$', '') || 'e+06' end) || ';' || regexp_replace(regexp_replace(cast(n_nationkey/8.0 as varchar), '0+$', ''), '[.]$', '') k from nation"),
    "replace_regexp_dollar": ("nation", '* | replace_regexp ("([A-Z])[A-Z]*","${1}$$x$") at n_name | fields n_nationkey, n_name', r"select n_nationkey, regexp_replace(n_name, '([A-Z])[A-Z]*', '\1$x$', 'g') n_name from nation"),
    "replace_regexp_bad": ("nation", '* | replace_regexp ("(","x") at n_name | fields n_nationkey, n_name', "select n_nationkey, n_name from nation"),
    "pattern": ("customer", "* | pattern at c_name | stats by (c_name) count() n", "select regexp_replace(c_name,'[0-9]+','<N>','g') c_name, count(*) n from customer group by 1"),
    "drop_empty_fields": ("documents", "* | drop_empty_fields | fields doc_id, lang", "select doc_id, nullif(lang,'') lang from documents"),
    "unpack_logfmt": ("orders", "* | pack_logfmt fields (o_orderkey, o_orderpriority) as j | unpack_logfmt from j prefix p_ | fields o_orderkey, p_o_orderpriority", "select o_orderkey, o_orderpriority p_o_orderpriority from orders"),
    "unpack_logfmt_flag": ("nation", '* | format "flag id=<n_nationkey> done" as j | unpack_logfmt from j | fields n_nationkey, flag, id, done', "select n_nationkey, '' flag, cast(n_nationkey as varchar) id, '' done from nation"),
    "unpack_syslog": ("nation", '* | format "PRIOct 11 22:14:15 host<n_nationkey> app[<n_regionkey>]: <n_name>" as m | replace ("PRI","<34>") at m | unpack_syslog from m | fields n_nationkey, severity, hostname, proc_id, message', "select n_nationkey, '2' severity, 'host'||n_nationkey hostname, cast(n_regionkey as varchar) proc_id, n_name message from nation"),
    "unpack_words_list": ("conversations", "* | unpack_words from text as w | fields conv_id, turn, w", "select conv_id, turn, coalesce(cast(to_json(list_sort(list_distinct(regexp_extract_all(text,'[A-Za-z0-9_]+')))) as varchar),'[]') w from conversations"),
    "unroll_json": ("conversations", "* | unpack_words from text as w | unroll (w) | stats by (w) count() n | filter w:*", "select w, count(*) n from (select unnest(list_distinct(regexp_extract_all(text,'[A-Za-z0-9_]+'))) w from conversations) group by 1"),
    "stats_count_uniq_hash": ("events", "* | stats count_uniq_hash(event_type) n", "select count(distinct event_type) n from events"),
    "join_prefix": ("nation", "* | join by (n_regionkey) (n_nationkey:<3 | stats by (n_regionkey) count() n) prefix r_ | len(r_n) as l | fields n_nationkey, l", "select n_nationkey, coalesce(length(cast(c.n as varchar)), 0) l from nation left join (select n_regionkey, count(*) n from nation where n_nationkey < 3 group by 1) c using (n_regionkey)"),
    "field_names_pipe": ("nation", "* | field_names", "select 'n_nationkey' as name, count(*) hits from nation union all select 'n_name', count(*) from nation union all select 'n_regionkey', count(*) from nation"),
    "facets_pipe": ("nation", "* | fields n_regionkey | facets 3", "select 'n_regionkey' field, cast(n_regionkey as varchar) as value, count(*) hits from nation group by 2 order by hits desc, value limit 3"),
    "blocks_count": ("nation", "* | blocks_count", "select 1::bigint blocks_count"),
    "flagship": ("events", "event_type:=error | stats by (user_id) count() n, avg(value) a | sort by (n, user_id) desc limit 10 | fields user_id, n", "select user_id, count(*) n from events where event_type='error' group by 1 order by 2 desc, 1 desc limit 10"),
}

JANUARY = (interval("2024-01")[0], interval("2024-01")[1])


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _stats_avg(spark, sf_dir):
    return _rounded(query(log(spark, sf_dir, "events"), "* | stats by (event_type) avg(value) a, sum(value) s"), "a", "s")


def _stats_rate(spark, sf_dir):
    return query(log(spark, sf_dir, "events", window=JANUARY), "* | stats rate() r")


def _histogram(spark, sf_dir):
    out = query(log(spark, sf_dir, "events"), "* | stats histogram(value) h")
    items = F.from_json("h", "array<struct<vmrange:string,hits:bigint>>")
    return out.select(F.inline(items)).select("vmrange", "hits")


def _stats_range(spark, sf_dir):
    out = series.stats_range(log(spark, sf_dir, "events"), parse("* | stats by (event_type) count() n"), DAY, JANUARY[0])
    return out.select((F.col("bucket_ns") / 10**9).cast("bigint").alias("t"), "event_type", "n")


def _stats_instant(spark, sf_dir):
    out = series.stats_instant(log(spark, sf_dir, "events"), parse("* | stats by (event_type) count() n"))
    return out.select(F.col("labels")["event_type"].alias("event_type"), "name", "value")


def _hits(spark, sf_dir):
    out = series.hits(log(spark, sf_dir, "events", window=JANUARY), 3600 * 10**9)
    return out.select((F.col("bucket_ns") / 10**9).cast("bigint").alias("t"), "hits")


def _hits_by(spark, sf_dir):
    out = series.hits(log(spark, sf_dir, "events", window=JANUARY), DAY, "event_type", 2)
    return out.groupBy("event_type").agg(F.count("bucket_ns").alias("buckets"), F.sum("hits").alias("hits"))


def _facets(spark, sf_dir):
    return introspect.facets(log(spark, sf_dir, "events"), 3, ["event_type", "user_id"])


def _vector(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    held = df.where("vec_id = 0").select("embedding").first()[0]
    return vector.nearest(df, "embedding", held, 10, "vec_id").select("vec_id", "_score")


def _sql(spark, sf_dir):
    return run(log(spark, sf_dir, "events"), frontends.sql("SELECT event_type, count(*) FROM logs WHERE value > 100 GROUP BY event_type ORDER BY count(*) DESC LIMIT 3")).df.select("event_type", "count")


def _search(spark, sf_dir):
    body = {"query": {"bool": {"must": [{"term": {"event_type": "error"}}], "filter": [{"range": {"@timestamp": {"gte": "2024-01-05", "lt": "2024-01-20"}}}]}}}
    return run(log(spark, sf_dir, "events"), frontends.search(body)).df.select("event_id")


def _hash(spark, sf_dir):
    return query(log(spark, sf_dir, "nation"), "* | hash(n_name) as h | fields n_nationkey, h")


def _folder(spark) -> str:
    """A new folder that the cluster shares."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared}/store-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tidelog-store-") + "/store"


def _records(spark, sf_dir):
    rows = log(spark, sf_dir, "events")
    return rows.df.select(rows.ns().alias("_time_ns"), "event_id", "event_type", F.concat(F.lit('{event_type="'), F.col("event_type"), F.lit('"}')).alias("_stream"))


def _ns(day: str) -> int:
    return interval(day)[0]


def _store(change=None, window=(None, None)):
    def made(spark, sf_dir):
        path = _folder(spark)
        store.write(_records(spark, sf_dir), path)
        if change:
            path = change(spark, path) or path
        return store.read(spark, path, *window).select("event_id", "event_type")

    return made


def _cold(spark, path):
    store.demote(spark, path, path + "-cold", _ns("2024-01-10"))
    store.promote(spark, path + "-cold", path)


def _demoted(spark, path):
    store.demote(spark, path, path + "-cold", _ns("2024-01-10"))
    return path + "-cold"


def _restored(spark, path):
    store.backup(spark, path, path + "-backup")
    store.restore(spark, path + "-backup", path + "-again")
    return path + "-again"


def _ingested(text, read, columns, **options):
    """Lines made of a table's rows, read as a wire format."""

    def made(spark, sf_dir):
        rows = log(spark, sf_dir, "events")
        lines = rows.df.withColumn("ns", rows.ns()).withColumn("us", F.expr("ns div 1000")).select(F.expr(text).alias("value"))
        rows = formats.load(read(lines), list(columns), **options)
        return rows.select(F.expr("_time_ns div 1000").alias("us"), *columns)

    return made


#: A time as RFC 3339 text and as nanoseconds, in UTC.
_STAMP = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"


def _live(spark, sf_dir):
    import uuid

    path, name = _folder(spark), f"tail_{uuid.uuid4().hex}"
    store.write(_records(spark, sf_dir), path)
    stream = tail.tail(spark, path, spark.read.parquet(path).schema, "event_type:=error", _ns("2024-01-05")).select("event_id")
    stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _continuous(spark, sf_dir):
    source, path = _folder(spark), _folder(spark)
    _records(spark, sf_dir).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query_ = tail.ingest(stream, path, path + "-state")
    query_.processAllAvailable()
    query_.stop()
    return store.read(spark, path).select("event_id", "event_type")


def _tumbling(spark, sf_dir):
    import uuid

    source, name = _folder(spark), f"windows_{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    out = tail.windowed(stream, "ts", "1 day", "1 hour", "event_type").select(F.unix_seconds("window.start").alias("t"), "event_type", "hits")
    out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _alert(spark, sf_dir):
    state = tail.alert(log(spark, sf_dir, "events"), "errors", "event_type:=error", ">", 10)
    return spark.createDataFrame([(state["name"], state["firing"], state["value"])], "name string, firing boolean, value long")


def _envelope(df, schema, *columns):
    return df.select(F.from_json("value", schema).alias("r")).select(*columns)


def _hits_envelope(spark, sf_dir):
    body = wire.hits(series.hits(log(spark, sf_dir, "events", window=JANUARY), DAY, "event_type"), "event_type")
    out = _envelope(body, "struct<hits:array<struct<fields:map<string,string>,timestamps:array<string>,values:array<bigint>,total:bigint>>>", F.explode("r.hits").alias("s"))
    out = out.select(F.col("s.fields")["event_type"].alias("event_type"), "s.total", F.inline(F.arrays_zip(F.col("s.timestamps").alias("t"), F.col("s.values").alias("hits"))))
    return out


def _vector_envelope(spark, sf_dir):
    body = wire.vector(series.stats_instant(log(spark, sf_dir, "events"), parse("* | stats by (event_type) count() n, max(user_id) m")), _ns("2024-02-01"))
    out = _envelope(body, "struct<status:string,data:struct<resultType:string,result:array<struct<metric:map<string,string>,value:array<string>>>>>", "r.status", "r.data.resultType", F.explode("r.data.result").alias("s"))
    return out.select("status", F.col("resultType").alias("kind"), F.col("s.metric")["__name__"].alias("name"), F.col("s.metric")["event_type"].alias("event_type"), F.col("s.value")[0].cast("bigint").alias("t"), F.col("s.value")[1].alias("v"))


def _matrix_envelope(spark, sf_dir):
    body = wire.matrix(series.stats_range(log(spark, sf_dir, "events"), parse("* | stats by (event_type) count() n"), DAY, JANUARY[0]), ("event_type",), ("n",))
    out = _envelope(body, "struct<data:struct<resultType:string,result:array<struct<metric:map<string,string>,values:array<array<string>>>>>>", "r.data.resultType", F.explode("r.data.result").alias("s"))
    out = out.select(F.col("resultType").alias("kind"), F.col("s.metric")["event_type"].alias("event_type"), F.explode("s.values").alias("p"))
    return out.select("kind", "event_type", F.col("p")[0].cast("bigint").alias("t"), F.col("p")[1].alias("v"))


def _facets_envelope(spark, sf_dir):
    out = _envelope(wire.facets(_facets(spark, sf_dir)), "struct<facets:array<struct<field_name:string,values:array<struct<field_value:string,hits:bigint>>>>>", F.explode("r.facets").alias("s"))
    return out.select(F.col("s.field_name").alias("field"), F.inline("s.values")).select("field", F.col("field_value").alias("value"), "hits")


def _values_envelope(spark, sf_dir):
    out = _envelope(wire.values(introspect.field_values(log(spark, sf_dir, "events"), "event_type")), "struct<values:array<struct<value:string,hits:bigint>>>", F.explode("r.values").alias("s"))
    return out.select("s.value", "s.hits")


_TERM = {"query": {"term": {"event_type": "error"}}}


def _search_hits(spark, sf_dir):
    body = wire.search_hits(run(log(spark, sf_dir, "events"), frontends.search(_TERM)))
    out = _envelope(body, "struct<hits:struct<total:struct<value:bigint,relation:string>,hits:array<struct<_source:map<string,string>>>>>", F.col("r.hits.total.value").alias("total"), F.explode("r.hits.hits").alias("h"))
    return out.select("total", F.col("h._source")["event_id"].cast("bigint").alias("event_id"), F.col("h._source")["@timestamp"].alias("t"))


def _search_count(spark, sf_dir):
    return _envelope(wire.count(run(log(spark, sf_dir, "events"), frontends.search(_TERM))), "struct<count:bigint>", "r.count")


def _ndjson_rows(spark, sf_dir):
    rows = wire.ndjson(log(spark, sf_dir, "orders"))
    return rows.select(F.from_json("value", "map<string,string>").alias("m")).select(F.col("m")["o_orderkey"].cast("bigint").alias("o_orderkey"), F.col("m")["_time"].alias("t"), F.col("m")["o_orderstatus"].alias("o_orderstatus"))


def _window(spark, sf_dir):
    """Start as seconds, end as a date."""
    return query(log(spark, sf_dir, "events", window=frontends.window("1704844800", "2024-01-12")), "* | stats by (event_type) count() n")


def _relative(spark, sf_dir):
    return query(log(spark, sf_dir, "events"), "_time:36h | fields event_id", now_ns=_ns("2024-01-20"))


def _field_stats(spark, sf_dir):
    return introspect.block_stats(log(spark, sf_dir, "events")).select("rows")


#: Records that the formats' readers leave.
_READ = "select cast(epoch_us(ts) as bigint) us, event_type, cast(event_id as varchar) event_id from events"
_ALL = "select event_id, event_type from events"

SPECIAL = {
    "envelope_hits": (_hits_envelope, "with d as (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval 1 day)) t), j as (select * from events where ts < timestamp '2024-02-01'), s as (select event_type, count(*) total from j group by 1) select s.event_type, s.total, strftime(d.t,'%Y-%m-%dT%H:%M:%SZ') t, count(j.ts) hits from s cross join d left join j on j.event_type=s.event_type and date_trunc('day',j.ts)=d.t group by 1,2,3"),
    "envelope_vector": (_vector_envelope, "select 'success' status, 'vector' kind, 'n' as name, event_type, 1706745600::bigint t, cast(count(*) as varchar) v from events group by event_type union all select 'success', 'vector', 'm', event_type, 1706745600, cast(max(user_id) as varchar) from events group by event_type"),
    "envelope_matrix": (_matrix_envelope, "select 'matrix' kind, event_type, cast(epoch(date_trunc('day',ts)) as bigint) t, cast(count(*) as varchar) v from events group by 2,3"),
    "envelope_facets": (_facets_envelope, "select * from (select 'event_type' field, event_type as value, count(*) hits from events group by 2 union all select 'user_id', cast(user_id as varchar), count(*) from events group by 2) qualify row_number() over (partition by field order by hits desc, value)<=3"),
    "envelope_values": (_values_envelope, "select event_type as value, count(*) hits from events group by 1"),
    "envelope_search": (_search_hits, "select count(*) over () total, event_id, regexp_replace(regexp_replace(strftime(ts,'%Y-%m-%dT%H:%M:%S.%f'), '0+$', ''), '[.]$', '') || 'Z' t from events where event_type='error'"),
    "search_count": (_search_count, "select count(*) count from events where event_type='error'"),
    "ndjson_rows": (_ndjson_rows, "select o_orderkey, strftime(o_orderdate,'%Y-%m-%dT%H:%M:%SZ') t, o_orderstatus from orders"),
    "request_window": (_window, "select event_type, count(*) n from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-12' group by 1"),
    "time_relative": (_relative, "select event_id from events where ts >= timestamp '2024-01-18 12:00:00' and ts < timestamp '2024-01-20'"),
    "endpoint_limit": (lambda s, d: recent(log(s, d, "events"), "event_type:=error | fields _time, event_id", 7).select("event_id"), "select event_id from events where event_type='error' order by ts desc, event_id desc limit 7"),
    "stats_rate_sum": (lambda s, d: _rounded(query(log(s, d, "events", window=JANUARY), "* | stats rate_sum(user_id) r"), "r"), "select round(sum(user_id)/2678400.0::double, 6) r from events where ts>=timestamp '2024-01-01' and ts<timestamp '2024-02-01'"),
    "histogram_sparse": (lambda s, d: series.histogram(log(s, d, "events"), 3600 * 10**9).select((F.col("bucket_ns") / 10**9).cast("bigint").alias("t"), "hits"), "select cast(epoch(date_trunc('hour',ts)) as bigint) t, count(*) hits from events group by 1"),
    "stream_ids": (lambda s, d: introspect.stream_ids(log(s, d, "events")).select("hits"), "select count(*) hits from events group by event_type"),
    "stream_field_names": (lambda s, d: introspect.stream_field_names(log(s, d, "events")), "select 'event_type' as value, cast(count(*) as bigint) hits from events"),
    "block_stats": (_field_stats, "select count(*) as rows from events"),
    "facets_rules": (lambda s, d: introspect.facets(log(s, d, "nation"), 2, max_values=10, keep_const=False), "select 'n_regionkey' field, cast(n_regionkey as varchar) as value, count(*) hits from nation group by 2 order by hits desc, value limit 2"),
    "ingest_ndjson": (_ingested(f"to_json(named_struct('_time', {_STAMP}, 'event_type', event_type, 'event_id', event_id))", formats.ndjson, ("event_type", "event_id")), _READ),
    "ingest_logfmt": (_ingested(f"concat('event_type=\"', event_type, '\" flag event_id=', event_id, ' _time=', {_STAMP})", formats.logfmt, ("event_type", "event_id", "flag")), "select cast(epoch_us(ts) as bigint) us, event_type, cast(event_id as varchar) event_id, '' flag from events"),
    "ingest_bulk": (_ingested(f"concat('{{\"create\":{{}}}}\\n', to_json(named_struct('_time', {_STAMP}, 'event_type', event_type, 'event_id', event_id)), '\\n{{\"delete\":{{\"_id\":\"1\"}}}}\\n')", formats.bulk, ("event_type", "event_id")), _READ),
    "ingest_loki": (_ingested("to_json(named_struct('streams', array(named_struct('stream', map('event_type', event_type), 'values', array(array(concat(us, '000'), cast(event_id as string)))))))", formats.loki, ("event_type", "_msg")), "select cast(epoch_us(ts) as bigint) us, event_type, cast(event_id as varchar) _msg from events"),
    "ingest_datadog": (_ingested("to_json(array(named_struct('timestamp', us div 1000, 'message', cast(event_id as string), 'ddtags', concat('event_type:', event_type, ',a:b'))))", formats.datadog, ("event_type", "a", "_msg")), "select (epoch_us(ts) // 1000)*1000 us, event_type, 'b' a, cast(event_id as varchar) _msg from events"),
    "ingest_otlp": (_ingested("to_json(named_struct('resourceLogs', array(named_struct('resource', named_struct('attributes', array(named_struct('key', 'event_type', 'value', named_struct('stringValue', event_type)))), 'scopeLogs', array(named_struct('logRecords', array(named_struct('timeUnixNano', concat(us, '000'), 'body', named_struct('stringValue', cast(event_id as string))))))))))", formats.otlp_json, ("event_type", "_msg")), "select cast(epoch_us(ts) as bigint) us, event_type, cast(event_id as varchar) _msg from events"),
    "ingest_syslog": (_ingested(f"concat('<165>1 ', {_STAMP}, ' ', event_type, ' app 12 ID47 - ', event_id)", lambda lines: formats.syslog(lines, 2024), ("hostname", "severity", "app_name", "_msg")), "select cast(epoch_us(ts) as bigint) us, event_type hostname, 'notice' severity, 'app' app_name, cast(event_id as varchar) _msg from events"),
    "ingest_fields": (_ingested(f"to_json(named_struct('_time', {_STAMP}, 'event_type', event_type, 'line', event_id, 'junk', 1))", formats.ndjson, ("event_type", "_msg", "junk", "site"), msg_field="line", ignore=("junk",), extra={"site": "x"}), "select cast(epoch_us(ts) as bigint) us, event_type, cast(event_id as varchar) _msg, cast(null as varchar) junk, 'x' site from events"),
    "ingest_fallback_time": (_ingested("to_json(named_struct('event_type', event_type, 'event_id', event_id))", formats.ndjson, ("event_type", "event_id"), fallback_ns=1000), "select 1::bigint us, event_type, cast(event_id as varchar) event_id from events"),
    "store_window": (_store(window=(_ns("2024-01-03"), _ns("2024-01-07"))), _ALL + " where ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-07'"),
    "store_retention": (_store(lambda s, p: store.retain(s, p, _ns("2024-01-10")) and None), _ALL + " where ts >= timestamp '2024-01-10'"),
    "store_stream_retention": (_store(lambda s, p: store.retain_streams(s, p, {'{event_type="error"}': _ns("2024-01-10")}) and None), _ALL + " where not (event_type='error' and ts < timestamp '2024-01-10')"),
    "store_recompact": (_store(lambda s, p: store.recompact(s, p, _ns("2024-01-10")) and None), _ALL),
    "store_cold": (_store(_demoted), _ALL + " where ts < timestamp '2024-01-10'"),
    "store_promote": (_store(_cold), _ALL),
    "store_backup": (_store(_restored), _ALL),
    "live_tail": (_live, "select event_id from events where event_type='error' and ts >= timestamp '2024-01-05'"),
    "continuous_ingest": (_continuous, _ALL),
    "tumbling_windows": (_tumbling, "select cast(epoch(date_trunc('day',ts)) as bigint) t, event_type, count(*) hits from events group by 1,2"),
    "rule_metric": (lambda s, d: tail.rule_value(log(s, d, "events"), "value:>100", "event_type"), "select event_type, count(*) as value from events where value>100 group by 1"),
    "rule_alert": (_alert, "select 'errors' as name, count(*)>10 firing, count(*) as value from events where event_type='error'"),
    "stats_avg": (_stats_avg, "select event_type, round(avg(value),6) a, round(sum(value),6) s from events group by 1"),
    "stats_rate": (_stats_rate, "select count(*)/2678400.0::double r from events where ts>=timestamp '2024-01-01' and ts<timestamp '2024-02-01'"),
    "stats_histogram": (_histogram, "select printf('%.3e', pow(10.0, b/18.0-9)) || '...' || printf('%.3e', pow(10.0, (b+1)/18.0-9)) vmrange, hits from (select cast(case when f=floor(f) then floor(f)-1 else floor(f) end as bigint) b, count(*) hits from (select (log10(value)+9)*18 f from events where value>0) group by 1)"),
    "stats_range": (_stats_range, "select cast(epoch(date_trunc('day',ts)) as bigint) t, event_type, count(*) n from events group by 1,2"),
    "stats_instant": (_stats_instant, "select event_type, 'n' as name, cast(count(*) as varchar) as value from events group by 1"),
    "hits_dense": (_hits, "select cast(epoch(t) as bigint) t, count(e.ts) hits from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31 23:00:00', interval 1 hour)) t) g left join events e on date_trunc('hour',e.ts)=g.t group by 1"),
    "hits_by": (_hits_by, "with j as (select * from events where ts < timestamp '2024-02-01'), c as (select event_type, row_number() over (order by count(*) desc, event_type) r from j group by 1) select case when r<=2 then event_type else '' end event_type, 31::bigint buckets, cast(count(*) as bigint) hits from j join c using (event_type) group by 1"),
    "field_names": (lambda s, d: introspect.field_names(log(s, d, "events"), ["event_type", "props"]), "select 'event_type' as name, count(*) filter (where event_type<>'') hits from events union all select 'props', count(*) filter (where props<>'') from events"),
    "facets": (_facets, "select * from (select 'event_type' field, event_type as value, count(*) hits from events group by 2 union all select 'user_id', cast(user_id as varchar), count(*) from events group by 2) qualify row_number() over (partition by field order by hits desc, value)<=3"),
    "streams": (lambda s, d: introspect.streams(log(s, d, "events")), """select '{event_type="'||event_type||'"}' as value, count(*) hits from events group by 1"""),
    "stream_field_values": (lambda s, d: introspect.stream_field_values(log(s, d, "events"), "event_type"), "select event_type as value, cast(count(*) as bigint) hits from events group by 1"),
    "vector_knn": (_vector, "with q as (select embedding e from embeddings where vec_id=0) select vec_id, round(list_cosine_similarity(embedding::double[], (select e::double[] from q)),4) _score from embeddings order by list_cosine_similarity(embedding::double[],(select e::double[] from q)) desc, vec_id limit 10"),
    "sql_subset": (_sql, "select event_type, count(*) as count from events where value>100 group by 1 order by 2 desc limit 3"),
    "search_request": (_search, "select event_id from events where event_type='error' and ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20'"),
    "hash": (_hash, None),
}


def queries() -> dict:
    made = {name: (lambda s, d, t=table, q=text: query(log(s, d, t), q)) for name, (table, text, _) in CATALOGUE.items()}
    return made | {name: f for name, (f, _) in SPECIAL.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, _, sql) in CATALOGUE.items()} | {name: sql for name, (_, sql) in SPECIAL.items() if sql}
