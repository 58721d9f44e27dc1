"""Queries of every operator over the test tables, with SQL for the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources.events import TableCatalog
from .sources.shared import shared_folder

#: (name, query, SQL or None)
PIPES: tuple[tuple[str, str, str | None], ...] = (
    # Search conditions
    ("search_equals", "index=events event_type=purchase | fields event_id value", "SELECT event_id, value FROM events WHERE event_type = 'purchase'"),
    ("search_not_equals", "index=events event_type!=purchase | fields event_id", "SELECT event_id FROM events WHERE event_type <> 'purchase'"),
    ("search_numbers", "index=events value>=100 user_id<5 | fields event_id", "SELECT event_id FROM events WHERE value >= 100 AND user_id < 5"),
    ("search_glob", "index=events event_type=p*e | fields event_id", "SELECT event_id FROM events WHERE event_type LIKE 'p%e'"),
    ("search_term", 'index=events "\\"K\\": 7" | fields event_id', "SELECT event_id FROM events WHERE contains(lower(props), '\"k\": 7')"),
    ("search_boolean", "index=events event_type=click OR event_type=view NOT user_id=3 (value<50 OR value>150) | fields event_id", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id <> 3 AND (value < 50 OR value > 150)"),
    ("search_index_in", "index IN (events, orders) | stats count BY index", "SELECT 'events' AS index, count(*) AS count FROM events UNION ALL SELECT 'orders', count(*) FROM orders"),
    ("search_index_glob", "index=*s sourcetype=* | stats count BY index", "SELECT 'events' AS index, count(*) AS count FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages"),
    ("search_host_prefix", "index=events host=user-1 | stats count BY host", "SELECT 'user-' || user_id AS host, count(*) AS count FROM events WHERE ('user-' || user_id) LIKE 'user-1%' GROUP BY 1"),
    ("search_sourcetype", "index=events sourcetype=cl* | stats count BY sourcetype", "SELECT event_type AS sourcetype, count(*) AS count FROM events WHERE event_type LIKE 'cl%' GROUP BY 1"),
    ("search_field_in", 'index=events event_type IN (click, "err*") | stats count BY event_type', "SELECT event_type, count(*) AS count FROM events WHERE event_type = 'click' OR event_type LIKE 'err%' GROUP BY 1"),
    ("search_time_range", "index=events earliest=2024-01-05T00:00:00 latest=2024-01-09T12:00:00 | fields event_id", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-09 12:00:00'"),
    ("search_timeformat", 'index=events timeformat="%Y-%m-%d" earliest="2024-01-10" latest="2024-01-20" | fields event_id', "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'"),
    ("search_epoch", "index=events starttimeu=1704844800 endtimeu=1705104000 | fields event_id", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'"),
    ("search_relative_time", "index=events earliest=-13mon@mon latest=-12mon@mon | stats count AS n", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'"),
    ("search_command", "index=events | search event_type=view user_id=2 | fields event_id", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id = 2"),
    ("search_subsearch", "index=events [ search index=events event_type=signup | fields props ] | fields event_id", "SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(props) AS p FROM events WHERE event_type = 'signup') s WHERE contains(lower(e.props), s.p))"),
    ("where_command", "index=events | where value > 50 AND user_id <= 3 | fields event_id", "SELECT event_id FROM events WHERE value > 50 AND user_id <= 3"),
    ("where_not_like", 'index=events | where NOT event_type like "%c%" | fields event_id', "SELECT event_id FROM events WHERE event_type NOT LIKE '%c%'"),
    ("regex_command", 'index=events | regex props="\\d{2}" | fields event_id', "SELECT event_id FROM events WHERE regexp_matches(props, '[0-9]{2}')"),
    ("regex_negated", 'index=events | regex props!="\\d{2}" | fields event_id', "SELECT event_id FROM events WHERE NOT regexp_matches(props, '[0-9]{2}')"),
    # Columns
    ("fields_wildcard", "index=customer | fields c_cust* c_n*", "SELECT c_custkey, c_name, c_nationkey FROM customer"),
    ("fields_drop", "index=nation | fields - _* index sourcetype host source partition offset origin", "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    ("table_command", "index=events | table event_id value*", "SELECT event_id, value FROM events"),
    ("rename_command", "index=events | rename event_id AS id, value AS v, nothing AS n | fields id v", "SELECT event_id AS id, value AS v FROM events"),
    ("fillnull_command", 'index=customer | eval x=if(c_nationkey>10,null(),"low") | eval y=mvjoin(x,""), z=case(c_nationkey<5,c_custkey) | fillnull value=none y new | fillnull value=0 z | fields c_custkey y z new', "SELECT c_custkey, CASE WHEN c_nationkey > 10 THEN 'none' ELSE 'low' END AS y, CASE WHEN c_nationkey < 5 THEN c_custkey ELSE 0 END AS z, 'none' AS new FROM customer"),
    ("strcat_command", 'index=events | strcat event_type "-" user_id made | fields event_id made', "SELECT event_id, event_type || '-' || user_id AS made FROM events"),
    ("replace_command", 'index=events | replace "pur*" WITH "buy-*", click WITH tap IN event_type | stats count BY event_type', "SELECT CASE WHEN event_type LIKE 'pur%' THEN 'buy-' || substr(event_type, 4) WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS event_type, count(*) AS count FROM events GROUP BY 1"),
    ("rex_command", 'index=events | rex field=props "\\"k\\":\\s*(?<k_val>\\d+)" | fields event_id k_val', "SELECT event_id, regexp_extract(props, '\"k\":\\s*([0-9]+)', 1) AS k_val FROM events"),
    ("rex_sed", 'index=events | rex field=props mode=sed "s/[0-9]/#/g" | fields event_id props', "SELECT event_id, regexp_replace(props, '[0-9]', '#', 'g') AS props FROM events"),
    ("rex_sed_first", 'index=events | rex field=event_type mode=sed "s;[aeiou];_;1" | fields event_id event_type', "SELECT event_id, regexp_replace(event_type, '[aeiou]', '_') AS event_type FROM events"),
    ("rex4j_command", 'index=orders | rex4j field=o_orderpriority "(?<level>\\d)-(?<word>[A-Z]+)" | fields o_orderkey level word', "SELECT o_orderkey, nullif(regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 1), '') AS level, nullif(regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 2), '') AS word FROM orders"),
    ("convert_command", 'index=events | eval a="1,234", b="01:02:03", c="12.5kB", d="64m", e="x" | convert rmcomma(a) dur2sec(b) AS s rmunit(c) memk(d) num(e) AS f ctime(event_id) AS t | fields event_id a s c d t', "SELECT event_id, '1234' AS a, '3723' AS s, '12.5' AS c, '65536.0' AS d, strftime(to_timestamp(event_id) AT TIME ZONE 'UTC', '%m/%d/%Y %H:%M:%S') AS t FROM events"),
    ("convert_times", 'index=events | eval a="01/02/2024 03:04:05", b="01:02.500", c="7.50" | convert mktime(a) mstime(b) auto(c) none(value) auto(event_type) AS et | fields event_id a b c et', "SELECT event_id, '1704164645' AS a, '62500' AS b, '7.5' AS c, event_type AS et FROM events"),
    ("spath_path", "index=events | spath input=props path=k | eval k=tonumber(k) | fields event_id k", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    ("spath_auto", "index=events | spath input=props | fields event_id k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    ("xmlkv_command", 'index=nation | eval x="<a><name>"+n_name+"</name><key>"+n_nationkey+"</key></a>" | xmlkv x | fields n_nationkey name key', "SELECT n_nationkey, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key FROM nation"),
    ("rangemap_command", "index=events | rangemap field=value low=0-20 mid=20.01-80 default=high | eval range=mvjoin(range, \"/\") | stats count BY range", "SELECT CASE WHEN value BETWEEN 0 AND 20 THEN 'low' WHEN value BETWEEN 20.01 AND 80 THEN 'mid' ELSE 'high' END AS range, count(*) AS count FROM events GROUP BY 1"),
    ("format_command", "index=region | sort r_regionkey | fields r_regionkey r_name | format", "SELECT '( ' || string_agg('( r_regionkey=\"' || r_regionkey || '\" AND r_name=\"' || r_name || '\" )', ' OR ' ORDER BY hash_order) || ' ) ' AS search FROM (SELECT *, r_regionkey AS hash_order FROM region)"),
    ("tokenizer_command", "index=events | lang exec tokenizer input props output t | eval n=mvcount(t), first=mvindex(t,0) | fields event_id n first", "SELECT event_id, CAST(len(regexp_extract_all(props, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS INTEGER) AS n, [regexp_extract_all(props, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')[1]] AS first FROM events"),
    ("regexextract_command", 'index=events | lang exec regexextract regex "[0-9]+" input props output t | eval t=mvjoin(t, "+") | fields event_id t', "SELECT event_id, array_to_string(regexp_extract_all(lower(props), '[0-9]+'), '+') AS t FROM events"),
    ("eval_command", "index=events | eval a=user_id+1, a=a*2 | fields event_id a", "SELECT event_id, CAST((user_id + 1) * 2 AS VARCHAR) AS a FROM events"),
    # Scalar functions
    ("eval_arithmetic", 'index=events | eval a=user_id+2, b=user_id-7, c=user_id*user_id, d=event_id%7, e=event_id/4, f="ab"+"cd", g=user_id+"x" | fields event_id a b c d e f g', "SELECT event_id, CAST(user_id + 2 AS VARCHAR) AS a, CAST(user_id - 7 AS VARCHAR) AS b, CAST(user_id * user_id AS VARCHAR) AS c, CAST(event_id % 7 AS VARCHAR) AS d, CAST(event_id // 4 AS VARCHAR) || CASE event_id % 4 WHEN 1 THEN '.25' WHEN 2 THEN '.5' WHEN 3 THEN '.75' ELSE '' END AS e, 'abcd' AS f, user_id || 'x' AS g FROM events"),
    ("eval_exact", 'index=events | eval a=0.00000000001*1, b=0.1234567890123*1, c=9223372036854775807+event_id, d=9007199254740993+event_id > 9007199254740992.5+event_id, e=event_id*0.1, f=c*2, g=case(9007199254740993>9007199254740992.5,"more") | fields event_id a b c d e f g', "SELECT event_id, '0.00000000001' AS a, '0.1234567890123' AS b, CAST(CAST(9223372036854775807 AS HUGEINT) + event_id AS VARCHAR) AS c, true AS d, regexp_replace(regexp_replace(CAST(CAST(event_id AS DECIMAL(20,1)) * CAST(0.1 AS DECIMAL(2,1)) AS VARCHAR), '0+$', ''), '[.]$', '') AS e, CAST((CAST(9223372036854775807 AS HUGEINT) + event_id) * 2 AS VARCHAR) AS f, 'more' AS g FROM events"),
    ("search_large_numbers", 'index=events | eval x=9007199254740990+event_id%10 | search x>9007199254740992 x<9007199254740998 | fields event_id', "SELECT event_id FROM events WHERE event_id % 10 BETWEEN 3 AND 7"),
    ("eval_comparison", 'index=events | eval a=case(user_id==3,"eq",user_id!=4,"ne",true(),"four"), b=case(event_type<"d","early",event_type>="s","late"), c=case(value<=10,1,value>90,2) | fields event_id a b c', "SELECT event_id, CASE WHEN user_id = 3 THEN 'eq' WHEN user_id <> 4 THEN 'ne' ELSE 'four' END AS a, CASE WHEN event_type < 'd' THEN 'early' WHEN event_type >= 's' THEN 'late' END AS b, CASE WHEN value <= 10 THEN 1 WHEN value > 90 THEN 2 END AS c FROM events"),
    ("eval_if_case", 'index=events | eval i=if(value>50,"hi","lo"), i=mvindex(i,0), v=validate(value<50,"big",user_id<5,"late user"), c=coalesce(null(),event_type), n=nullif(user_id,3), s=isnull(n), t=isnotnull(n), k=in(event_type,"view","error"), f=false() | eval i=mvjoin(i,"") | fields event_id i v c n s t k f', "SELECT event_id, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS i, CASE WHEN NOT value < 50 THEN 'big' WHEN NOT user_id < 5 THEN 'late user' END AS v, event_type AS c, nullif(user_id, 3) AS n, user_id = 3 AS s, user_id <> 3 AS t, event_type IN ('view', 'error') AS k, false AS f FROM events"),
    ("eval_types", 'index=events | eval a=isbool(true()), b=isint(3), c=isnum(value), d=isstr(event_type), e=typeof(12), f=typeof("s"), g=typeof(1==2), h=tonumber("0A4",16), i=tonumber(event_id), j=tostring(true()), k=tostring(user_id,"hex"), l=tostring(12345.6789,"commas"), m=tostring(3723,"duration") | fields event_id a b c d e f g h i j k l m', "SELECT event_id, true AS a, true AS b, true AS c, true AS d, 'Number' AS e, 'String' AS f, 'Boolean' AS g, CAST(164 AS BIGINT) AS h, event_id AS i, 'true' AS j, '0x' || to_hex(user_id) AS k, '12,345.68' AS l, '01:02:03' AS m FROM events"),
    ("eval_math", "index=events | eval a=abs(user_id-7), b=ceil(value), c=floor(value), d=round(sqrt(value),6), e=round(exp(user_id/10),6), f=round(ln(user_id+1),6), g=round(log(user_id+1,2),6), h=round(pow(user_id,2),6), i=round(hypot(user_id,4),6), j=pi(), k=exact(user_id), l=round(value,1), m=ceiling(value) | fields event_id a b c d e f g h i j k l m", "SELECT event_id, CAST(abs(user_id - 7) AS DOUBLE) AS a, CAST(ceil(value) AS BIGINT) AS b, CAST(floor(value) AS BIGINT) AS c, round(sqrt(value), 6) AS d, round(exp(user_id / 10), 6) AS e, round(ln(user_id + 1), 6) AS f, round(log2(user_id + 1), 6) AS g, round(pow(user_id, 2), 6) AS h, round(sqrt(user_id * user_id + 16), 6) AS i, CAST(3.14159265358 AS DOUBLE) AS j, user_id AS k, round(value, 1) AS l, CAST(ceil(value) AS BIGINT) AS m FROM events"),
    ("eval_trig", "index=events | eval x=(user_id%20)/20 | eval a=round(sin(x),6), b=round(cos(x),6), c=round(tan(x),6), d=round(asin(x),6), e=round(acos(x),6), f=round(atan(x),6), g=round(atan2(x,2),6), h=round(sinh(x),6), i=round(cosh(x),6), j=round(tanh(x),6), k=round(asinh(x),6), l=round(acosh(x+1),6), m=round(atanh(x),6) | fields event_id a b c d e f g h i j k l m", "SELECT event_id, round(sin(x), 6) AS a, round(cos(x), 6) AS b, round(tan(x), 6) AS c, round(asin(x), 6) AS d, round(acos(x), 6) AS e, round(atan(x), 6) AS f, round(atan2(x, 2), 6) AS g, round(sinh(x), 6) AS h, round(cosh(x), 6) AS i, round(tanh(x), 6) AS j, round(asinh(x), 6) AS k, round(acosh(x + 1), 6) AS l, round(atanh(x), 6) AS m FROM (SELECT event_id, (user_id % 20) / 20 AS x FROM events)"),
    ("eval_many", 'index=events | eval a=min(user_id,7), b=max(user_id,7), c=sum(user_id,1,3,"foo"), d=avg("foo",user_id,"1","bar"), e=min("9","10","foo"), f=sigfig(1.00*1111), g=random()>=0 | fields event_id a b c d e f g', "SELECT event_id, CAST(least(user_id, 7) AS VARCHAR) AS a, CAST(greatest(user_id, 7) AS VARCHAR) AS b, CAST(user_id + 4 AS VARCHAR) AS c, CAST(round((user_id + 1) / 2) AS INTEGER) AS d, '10' AS e, '1110' AS f, true AS g FROM events"),
    ("eval_text", 'index=events | eval a=len(event_type), b=upper(event_type), c=lower(b), d=substr(event_type,2,3), e=ltrim("  x "), f=rtrim(" x  "), g=trim("zzxzz","z"), h=replace(event_type,"[aeiou]","*"), i=mvjoin(split("a,b,c",","),"-"), j=like(event_type,"%i%"), k=match(event_type,"^[cv]"), l=urldecode("a%20b"), m=substr(event_type,-3) | fields event_id a b c d e f g h i j k l m', "SELECT event_id, CAST(length(event_type) AS INTEGER) AS a, upper(event_type) AS b, event_type AS c, substr(event_type, 2, 3) AS d, 'x ' AS e, ' x' AS f, 'x' AS g, regexp_replace(event_type, '[aeiou]', '*', 'g') AS h, 'a-b-c' AS i, event_type LIKE '%i%' AS j, regexp_matches(event_type, '^[cv]') AS k, 'a b' AS l, right(event_type, 3) AS m FROM events"),
    ("eval_hashes", "index=events | eval a=md5(event_type), b=sha1(event_type), c=sha256(event_type), d=len(sha512(event_type)) | fields event_id a b c d", "SELECT event_id, md5(event_type) AS a, sha1(event_type) AS b, sha256(event_type) AS c, 128 AS d FROM events"),
    ("eval_network", 'index=events | eval ip="10.0."+user_id+".7" | eval a=cidrmatch("10.0.8.0/22",ip), b=cidrmatch(ip,"10.0.3.7"), c=searchmatch("user_id<4 event_type=c*") | fields event_id a b c', "SELECT event_id, user_id BETWEEN 8 AND 11 AS a, user_id = 3 AS b, user_id < 4 AND event_type LIKE 'c%' AS c FROM events"),
    ("eval_commands", 'index=region | eval c=mvjoin(commands("search foo | stats count | sort count"),",") | fields r_regionkey c', "SELECT r_regionkey, 'search,stats,sort' AS c FROM region"),
    ("eval_time", 'index=events | eval a=strftime(_time,"%Y-%m-%d %H:%M:%S"), b=strptime("2018-08-13 11:22:33","%Y-%m-%d %H:%M:%S"), c=relative_time(_time,"-1d@d"), d=relative_time(_time,"@w1"), e=relative_time(_time,"+1mon@mon"), f=strftime(1534188153,"%T %I %p"), g=now()>0, h=tonumber(time())>0 | fields event_id a b c d e f g', "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, CAST(1534159353 AS BIGINT) AS b, CAST(epoch(date_trunc('day', ts - INTERVAL 1 DAY)) AS BIGINT) AS c, CAST(epoch(date_trunc('week', ts)) AS BIGINT) AS d, CAST(epoch(date_trunc('month', ts + INTERVAL 1 MONTH)) AS BIGINT) AS e, '19:22:33 07 PM' AS f, true AS g FROM events"),
    ("eval_multivalue", 'index=events | eval m=mvappend("b",event_type,"b"), a=mvcount(m), b=mvjoin(mvdedup(m),","), c=mvfind(m,"^[cv]"), d=mvjoin(mvindex(m,0,1),","), e=mvjoin(mvindex(m,-1),","), f=mvjoin(mvrange(1,user_id+2,2),","), g=mvjoin(mvsort(m),","), h=mvjoin(mvzip(m,split("x,y",","),"="),";"), i=mvcount(mvfilter(m!="b")) | fields event_id a b c d e f g h i', "SELECT event_id, 3 AS a, 'b,' || event_type AS b, CASE WHEN event_type SIMILAR TO '[cv].*' THEN 1 END AS c, 'b,' || event_type AS d, 'b' AS e, array_to_string(range(1, user_id + 2, 2), ',') AS f, array_to_string(list_sort(['b', event_type, 'b']), ',') AS g, 'b=x;' || event_type || '=y' AS h, 1 AS i FROM events"),
    ("eval_json", 'index=events | eval a=spath(props,"k"), b=json_valid(props), c=json_valid("{x") , d=spath("<p><q>v</q></p>","p.q") | fields event_id a b c d', "SELECT event_id, json_extract_string(props, '$.k') AS a, true AS b, false AS c, 'v' AS d FROM events"),
    # Aggregates
    ("stats_count_sum", "index=events | stats count count(value) AS cv sum(user_id) AS s c(user_id) AS c BY event_type", "SELECT event_type, count(*) AS count, count(value) AS cv, CAST(sum(user_id) AS VARCHAR) AS s, count(user_id) AS c FROM events GROUP BY 1"),
    ("stats_avg_min_max", "index=events | stats avg(user_id) AS a mean(user_id) AS m min(value) AS lo max(value) AS hi range(user_id) AS r min(event_type) AS first_type BY user_id", "SELECT user_id, avg(user_id) AS a, avg(user_id) AS m, CAST(min(value) AS VARCHAR) AS lo, CAST(max(value) AS VARCHAR) AS hi, '0' AS r, min(event_type) AS first_type FROM events GROUP BY 1"),
    ("stats_variance", "index=events | stats sumsq(user_id) AS q var(user_id) AS v varp(user_id) AS vp stdev(user_id) AS s stdevp(user_id) AS sp BY event_type | eval v=round(v,6), vp=round(vp,6), s=round(s,6), sp=round(sp,6)", "SELECT event_type, CAST(sum(user_id * user_id) AS DOUBLE) AS q, round(var_samp(user_id), 6) AS v, round(var_pop(user_id), 6) AS vp, round(stddev_samp(user_id), 6) AS s, round(stddev_pop(user_id), 6) AS sp FROM events GROUP BY 1"),
    ("stats_percentiles", "index=events | stats median(user_id) AS m exactperc50(user_id) AS e50 exactperc90(event_id) AS e90 perc50(user_id) AS p50 p90(user_id) AS p90 upperperc95(user_id) AS u95 BY event_type", "WITH g AS (SELECT event_type, median(user_id) AS m, count(*) AS n, list(user_id ORDER BY user_id) AS u, list(event_id ORDER BY event_id) AS e, quantile_disc(user_id, 0.5) AS p50, quantile_disc(user_id, 0.9) AS p90, quantile_disc(user_id, 0.95) AS u95 FROM events GROUP BY 1), i AS (SELECT *, CAST(ceil(0.5::DOUBLE * (n - 1) - 0.5) AS INTEGER) AS i50, CAST(ceil(0.9::DOUBLE * (n - 1) - 0.5) AS INTEGER) AS i90 FROM g) SELECT event_type, CAST(m AS DOUBLE) AS m, CASE WHEN n % 2 = 0 AND i50 + 1 < n THEN (u[i50 + 1] + u[i50 + 2]) / 2 ELSE CAST(u[i50 + 1] AS DOUBLE) END AS e50, CASE WHEN n % 2 = 0 AND i90 + 1 < n THEN (e[i90 + 1] + e[i90 + 2]) / 2 ELSE CAST(e[i90 + 1] AS DOUBLE) END AS e90, p50, p90, u95 FROM i"),
    ("stats_first_last", "index=events | stats first(event_id) AS f last(event_id) AS l earliest(value) AS e latest(value) AS t earliest_time(value) AS et latest_time(value) AS lt BY user_id", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS f, arg_max(event_id, (ts, event_id)) AS l, CAST(arg_min(value, (ts, event_id)) AS VARCHAR) AS e, CAST(arg_max(value, (ts, event_id)) AS VARCHAR) AS t, CAST(CAST(floor(epoch(min(ts))) AS BIGINT) AS VARCHAR) AS et, CAST(CAST(floor(epoch(max(ts))) AS BIGINT) AS VARCHAR) AS lt FROM events GROUP BY 1"),
    ("stats_rate", "index=events | stats rate(event_id) AS r BY event_type | eval r=round(r,9)", "SELECT event_type, round((arg_max(event_id, ts) - arg_min(event_id, ts)) / (floor(epoch(max(ts))) - floor(epoch(min(ts)))), 9) AS r FROM events GROUP BY 1"),
    ("stats_values_list", "index=events | stats values(event_type) AS v list(event_type) AS l dc(event_type) AS d distinct_count(event_id) AS dd estdc(event_type) AS e estdc_error(event_type) AS ee BY user_id", "SELECT user_id, string_agg(DISTINCT event_type, chr(10) ORDER BY event_type) AS v, array_to_string(list_slice(list(event_type ORDER BY ts, event_id), 1, 100), chr(10)) AS l, CAST(count(DISTINCT event_type) AS INTEGER) AS d, CAST(count(DISTINCT event_id) AS INTEGER) AS dd, count(DISTINCT event_type) AS e, CAST(0 AS DOUBLE) AS ee FROM events GROUP BY 1"),
    ("stats_mode", "index=orders | stats mode(o_orderstatus) AS m BY o_orderpriority", "SELECT o_orderpriority, arg_min(o_orderstatus, (-n, o_orderstatus)) AS m FROM (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1"),
    ("stats_all", "index=lineitem | stats count AS n sum(l_linenumber) AS s dc(l_suppkey) AS d", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS VARCHAR) AS s, CAST(count(DISTINCT l_suppkey) AS INTEGER) AS d FROM lineitem"),
    ("chart_command", "index=lineitem | chart count AS n max(l_quantity) AS q BY l_returnflag l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(max(l_quantity) AS VARCHAR) AS q FROM lineitem GROUP BY 1, 2"),
    ("timechart_filled", 'index=events event_type=error | timechart span=6h count AS n | eval t=tonumber(strftime(_time,"%s")) | fields t n', "WITH e AS (SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS t FROM events WHERE event_type = 'error'), s AS (SELECT unnest(generate_series(min(t), max(t), 21600)) AS t FROM e) SELECT s.t, count(e.t) AS n FROM s LEFT JOIN e ON s.t = e.t GROUP BY 1"),
    ("timechart_by", 'index=orders | timechart span=30d count AS n dc(o_custkey) AS c BY o_orderstatus | eval t=tonumber(strftime(_time,"%s")) | fields t o_orderstatus n c', "WITH e AS (SELECT *, CAST(floor(epoch(o_orderdate) / 2592000) * 2592000 AS BIGINT) AS t FROM orders), s AS (SELECT unnest(generate_series(min(t), max(t), 2592000)) AS t FROM e), g AS (SELECT t, o_orderstatus, count(*) AS n, CAST(count(DISTINCT o_custkey) AS INTEGER) AS c FROM e GROUP BY 1, 2) SELECT s.t, coalesce(o_orderstatus, '0') AS o_orderstatus, coalesce(n, 0) AS n, coalesce(c, 0) AS c FROM s LEFT JOIN g ON s.t = g.t"),
    ("timechart_range", 'index=events earliest=2024-01-03T00:00:00 latest=2024-01-03T12:00:00 | timechart count AS n | eval t=tonumber(strftime(_time,"%s")) | fields t n', "WITH s AS (SELECT unnest(generate_series(1704240000, 1704283200, 1800)) AS t), e AS (SELECT CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS t FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-03 12:00:00') SELECT s.t, count(e.t) AS n FROM s LEFT JOIN e ON s.t = e.t GROUP BY 1"),
    ("eventstats_all", "index=events | eventstats count AS n max(user_id) AS m | fields event_id n m", "SELECT event_id, count(*) OVER () AS n, CAST(max(user_id) OVER () AS VARCHAR) AS m FROM events"),
    ("eventstats_by", "index=events | eventstats avg(user_id) AS a dc(user_id) AS d BY event_type | fields event_id a d", "SELECT event_id, a, d FROM events JOIN (SELECT event_type, avg(user_id) AS a, CAST(count(DISTINCT user_id) AS INTEGER) AS d FROM events GROUP BY 1) USING (event_type)"),
    ("top_command", "index=orders | sort o_orderkey | top 7 o_orderstatus | fields o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7"),
    ("dedup_command", "index=events | dedup user_id event_type | fields event_id", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1"),
    ("dedup_sortby", "index=events | dedup 2 user_id sortby -num(value) | fields event_id", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts, event_id) <= 2"),
    ("dedup_consecutive", "index=events | dedup event_type consecutive=true | fields event_id", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type"),
    ("dedup_keepevents", "index=events | dedup event_type keepevents=true | fields event_id event_type", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1 THEN event_type END AS event_type FROM events"),
    ("addtotals_row", "index=nation | addtotals fieldname=t n_nationkey n_regionkey | fields n_nationkey t", "SELECT n_nationkey, CAST(CAST(n_nationkey + n_regionkey AS DOUBLE) AS VARCHAR) AS t FROM nation"),
    ("addtotals_col", "index=nation | fields n_name n_nationkey n_regionkey | addtotals row=false col=true labelfield=n_name label=all n_nationkey n_regionkey", "SELECT n_name, CAST(n_nationkey AS VARCHAR) AS n_nationkey, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation UNION ALL SELECT 'all', CAST(sum(n_nationkey) AS VARCHAR), CAST(sum(n_regionkey) AS VARCHAR) FROM nation"),
    ("accum_command", "index=events | accum user_id AS running | fields event_id running", "SELECT event_id, CAST(sum(user_id) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS running FROM events"),
    ("predict_command", "index=events | timechart span=1d count AS n | predict n AS p algorithm=LLT future_timespan=5 upper 98=u lower 98=l", None),
    # Order
    ("sort_top", "index=lineitem | sort 20 -num(l_extendedprice) l_orderkey l_linenumber | fields l_orderkey l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20"),
    ("sort_text", "index=orders | sort 15 +str(o_orderkey) | fields o_orderkey", "SELECT o_orderkey FROM orders ORDER BY CAST(o_orderkey AS VARCHAR) LIMIT 15"),
    ("sort_address", 'index=events | eval ip="10.0."+user_id+"."+event_id%250 | sort 10 -ip(ip) event_id | fields event_id', "SELECT event_id FROM events ORDER BY user_id DESC, event_id % 250 DESC, event_id LIMIT 10"),
    ("sort_desc", "index=orders | sort 12 o_custkey o_orderkey desc | fields o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey DESC LIMIT 12"),
    # Joins
    ("join_inner", "index=events event_type=click | join max=0 user_id [ search index=events event_type=signup | stats count AS signups BY user_id ] | fields event_id R_signups", "SELECT event_id, signups AS R_signups FROM events JOIN (SELECT user_id, count(*) AS signups FROM events WHERE event_type = 'signup' GROUP BY 1) USING (user_id) WHERE event_type = 'click'"),
    ("join_left", "index=orders | rename o_custkey AS c_custkey | join type=left max=0 c_custkey [ search index=customer c_acctbal>5000 | table c_custkey c_mktsegment ] | fields o_orderkey R_c_mktsegment", "SELECT o_orderkey, c_mktsegment AS R_c_mktsegment FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey"),
    ("join_max", "index=nation | join type=left max=3 n_nationkey [ search index=nation | eval r=n_regionkey*10 | table n_nationkey r offset | sort n_nationkey ] | fields n_nationkey R_r", "SELECT n_nationkey, CASE WHEN n_nationkey < 3 THEN CAST(n_regionkey * 10 AS VARCHAR) END AS R_r FROM nation"),
    ("join_usetime", "index=events event_type=purchase | join max=0 usetime=true earlier=true user_id [ search index=events event_type=click | table _time user_id event_id ] | stats count AS n BY event_id", "SELECT p.event_id, count(*) AS n FROM events p JOIN events c ON p.user_id = c.user_id AND p.ts >= c.ts WHERE p.event_type = 'purchase' AND c.event_type = 'click' GROUP BY 1"),
    # Sources and the platform
    ("makeresults_command", "| makeresults count=5 | eval x=1 | stats count AS n sum(x) AS s", "SELECT CAST(5 AS BIGINT) AS n, '5' AS s"),
    ("archive_summary", "| lang get archive summary index=orders | stats sum(events) AS n dc(sourcetype) AS t", "SELECT CAST(count(*) AS VARCHAR) AS n, CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS t FROM orders"),
    ("system_version", '| lang get system version | rex "^(?<part>[a-z]+): (?<major>[0-9]+)" | fields part major', "SELECT * FROM (VALUES ('sluice', '1'), ('spark', '4'), ('python', '3')) t(part, major)"),
    ("config_commands", "| lang set config post-limit 500 | lang set config recall-size 400 | lang get config | fields _raw", "SELECT * FROM (VALUES ('mail-server = localhost:25'), ('post-limit = 500'), ('query-timeout = 0'), ('recall-size = 400'), ('syslog-port = 1601'), ('trigger = 0 milliseconds')) t(_raw)"),
    ("explain_command", "index=events | explain brief | stats count AS n", "SELECT CAST(1 AS BIGINT) AS n"),
    ("parsetree_command", "index=events | lang debug=parsetree | stats count AS n", "SELECT CAST(1 AS BIGINT) AS n"),
    ("foreachbatch_command", "index=region | lang exec foreachbatch | stats count AS n", "SELECT count(*) AS n FROM region"),
    ("bloom_estimate", "index=events | lang exec tokenizer input event_type | lang exec bloom estimate output n", "SELECT CAST(event_id % 8 AS VARCHAR) AS partition, count(DISTINCT event_type) AS n FROM events GROUP BY 1"),
    ("bloom_create", "index=events | lang exec tokenizer input props | lang exec bloom create", None),
)

FLAGSHIP = "index=events event_type=purchase | stats count AS n avg(value) AS av BY user_id | sort -num(n)"


def engine(spark: SparkSession, folder: str, **options) -> Engine:
    from datetime import UTC, datetime

    return Engine(spark, TableCatalog(spark, folder), recall_size=None, now=datetime(2025, 2, 1, tzinfo=UTC), **options)


def _pipe(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: engine(spark, folder).run(text)


def iplocation(spark: SparkSession, folder: str) -> DataFrame:
    networks = spark.range(32).select((F.col("id") * 256 + 167772160).alias("first"), (F.col("id") * 256 + 167772160 + 255).alias("last"), F.concat(F.lit("C"), F.col("id") % 4).alias("country"), F.concat(F.lit("op"), F.col("id")).alias("operator"))
    return engine(spark, folder, networks=networks).run('index=events | eval ip="10.0."+user_id+".7" | iplocation prefix=g_ ip | fields event_id g_country g_operator')


def _saved(spark: SparkSession, folder: str) -> str:
    return f"{shared_folder(spark)}/saved-{abs(hash(folder))}"


def save_and_load(spark: SparkSession, folder: str) -> DataFrame:
    path = _saved(spark, folder)
    e = engine(spark, folder)
    e.run(f'index=events | stats count AS n sum(event_id) BY user_id event_type | lang exec hdfs save "{path}" overwrite=true')
    return e.run(f'| lang exec hdfs load "{path}"')


def payload_kafka(spark: SparkSession, folder: str) -> DataFrame:
    kept: list[DataFrame] = []
    engine(spark, folder, senders={"kafka": lambda df, options: kept.append(df)}).run("index=events | fields event_id user_id | lang exec kafka save topic")
    return kept[0].select(F.get_json_object("value", "$.event_id").cast("bigint").alias("event_id"), F.get_json_object("value", "$.user_id").cast("bigint").alias("user_id"))


def payload_syslog(spark: SparkSession, folder: str) -> DataFrame:
    kept: list[DataFrame] = []
    engine(spark, folder, senders={"syslog": lambda df, options: kept.append(df)}).run("index=events | fields _raw event_id | lang exec syslog stream host localhost port 1601")
    return kept[0]


def payload_metric(spark: SparkSession, folder: str) -> DataFrame:
    kept: list[DataFrame] = []
    engine(spark, folder, senders={"metric": lambda df, options: kept.append(df)}).run('index=events | stats min(event_id) max(event_id) count(event_id) BY event_type | lang exec dynatrace metric write "events"')
    return kept[0]


EXTRA: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "iplocation_command": (iplocation, "SELECT event_id, CASE WHEN user_id < 32 THEN 'C' || user_id % 4 END AS g_country, CASE WHEN user_id < 32 THEN 'op' || user_id END AS g_operator FROM events"),
    "hdfs_save_load": (save_and_load, "SELECT user_id, event_type, count(*) AS n, CAST(sum(event_id) AS VARCHAR) AS \"sum(event_id)\" FROM events GROUP BY 1, 2"),
    "kafka_payload": (payload_kafka, "SELECT event_id, user_id FROM events"),
    "syslog_payload": (payload_syslog, "SELECT '<14>1 - localhost sluice - - [fields@32473 event_id=\"' || event_id || '\"] ' || props AS line FROM events"),
    "metric_payload": (payload_metric, "SELECT 'events,event_type=\"' || event_type || '\" gauge,min=' || min(event_id) || ',max=' || max(event_id) || ',count=' || count(*) AS line FROM events GROUP BY event_type"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _pipe(text) for name, text, _ in PIPES} | {name: f for name, (f, _) in EXTRA.items()}
SQL: dict[str, str] = {name: sql for name, _, sql in PIPES if sql} | {name: sql for name, (_, sql) in EXTRA.items() if sql}
