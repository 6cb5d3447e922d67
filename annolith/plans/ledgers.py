"""Queries over the events as a ledger, and over text: AGG20-28, WIN09-12, STR, FUN, SRC, SMP."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from annolith.functions import values as V
from annolith.operators import bootstrap as B
from annolith.operators import ledger as L
from annolith.operators import sampling as S
from annolith.operators import streams, tables
from annolith.operators.store import stored
from annolith.session import shared_dir
from annolith.sources import files
from annolith.streaming import ledger as stream

from .registry import query
from .standins import PAGES, pages, read, with_

c = F.col
LEDGER = "led AS (SELECT event_id, ts, user_id AS task, event_type AS stage, event_type <> 'error' AS ok, value AS tokens FROM events)"


def ledger(s, d):
    return read(s, d, "events").select("event_id", "ts", c("user_id").alias("task"), c("event_type").alias("stage"), (c("event_type") != "error").alias("ok"), c("value").alias("tokens"))


@query("agg20_ledger_summary", with_(LEDGER, "SELECT stage, count(*) AS attempts, count(*) FILTER (ok) AS ok, count(DISTINCT task) AS tasks, round(sum(coalesce(tokens, 0)), 4) AS tokens, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS success_rate, round(sum(coalesce(tokens, 0)) / count(DISTINCT task), 4) AS per_task FROM led GROUP BY 1"))
def agg20(s, d):
    r = L.summary(ledger(s, d), ["stage"])
    return r.withColumns({"tokens": F.round("tokens", 4), "success_rate": F.round("success_rate", 6), "per_task": F.round("per_task", 4)})


@query("agg21_stage_tasks", "SELECT event_type, count(DISTINCT coalesce(nullif(user_id % 7, 0), user_id)) AS tasks FROM events GROUP BY 1")
def agg21(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.count_distinct(F.coalesce(F.nullif(c("user_id") % 7, F.lit(0)), "user_id")).alias("tasks"))


@query("agg23_recovery", with_(LEDGER, "SELECT count(*) AS tasks, count(*) FILTER (a AND f) AS recovered, count(*) FILTER (NOT a) AS unrecovered FROM (SELECT task, bool_or(ok) AS a, bool_or(NOT ok) AS f FROM led GROUP BY 1)"))
def agg23(s, d):
    return L.recovery(ledger(s, d), [])


@query("agg24_latency", with_(LEDGER, "SELECT stage, v[CAST(round_even((len(v) - 1) * 0.5::DOUBLE, 0) AS INTEGER) + 1] AS p50, v[CAST(round_even((len(v) - 1) * 0.9::DOUBLE, 0) AS INTEGER) + 1] AS p90, v[CAST(round_even((len(v) - 1) * 0.95::DOUBLE, 0) AS INTEGER) + 1] AS p95, v[len(v)] AS most, len(v) AS n FROM (SELECT stage, list(tokens ORDER BY tokens) AS v FROM led GROUP BY 1)"))
def agg24(s, d):
    return L.latency(ledger(s, d), ["stage"], "tokens")


@query("agg25_cost_scenarios", with_(LEDGER, "SELECT scenario, round(avg(tokens) * factor, 6) AS per_call, round(avg(tokens) * factor * 1000, 4) AS per_1000 FROM led CROSS JOIN (VALUES ('base', 1.0::DOUBLE), ('double', 2.0::DOUBLE)) v(scenario, factor) GROUP BY scenario, factor"))
def agg25(s, d):
    mean = ledger(s, d).agg(F.avg("tokens").alias("m"))
    return mean.select("m", F.inline(F.array(F.struct(F.lit("base").alias("scenario"), F.lit(1.0).alias("factor")), F.struct(F.lit("double").alias("scenario"), F.lit(2.0).alias("factor"))))).select("scenario", F.round(c("m") * c("factor"), 6).alias("per_call"), F.round(c("m") * c("factor") * 1000, 4).alias("per_1000"))


@query("agg26_configuration_costs", "SELECT event_type || '/' || coalesce(CAST(nullif(user_id % 3, 0) AS VARCHAR), '-') AS configuration, round(sum(value), 4) AS cost FROM events GROUP BY 1")
def agg26(s, d):
    key = F.concat_ws("/", "event_type", F.coalesce(F.nullif(c("user_id") % 3, F.lit(0)).cast("string"), F.lit("-")))
    return read(s, d, "events").groupBy(key.alias("configuration")).agg(F.round(F.sum("value"), 4).alias("cost"))


@query("agg27_completeness", "SELECT o_custkey, count(*) AS expected, count(k) AS done, count(*) = count(k) AS complete FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') ON o_orderkey = k GROUP BY 1")
def agg27(s, d):
    done = read(s, d, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("o_orderkey"))
    return L.completeness(read(s, d, "orders").select("o_custkey", "o_orderkey"), done, "o_custkey", "o_orderkey")


@query("agg28_unknown_bucket", "SELECT coalesce(lang, 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def agg28(s, d):
    return read(s, d, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))


@query("agg35_two_denominators", "SELECT count(*) FILTER (quality = 1) AS right_, round_even(100.0 * count(*) FILTER (quality = 1) / count(*), 1)::DOUBLE AS percent_all, round_even(100.0 * count(*) FILTER (quality = 1) / count(*) FILTER (toxic = 0), 1)::DOUBLE AS percent_scorable FROM labels")
def agg35(s, d):
    r, n, k = F.count_if(c("quality") == 1), F.count("*"), F.count_if(c("toxic") == 0)
    return read(s, d, "labels").agg(r.alias("right_"), F.bround(F.lit(100.0) * r / n, 1).alias("percent_all"), F.bround(F.lit(100.0) * r / k, 1).alias("percent_scorable"))


@query("agg40_tolerant_costs", "SELECT event_type, CAST(sum(coalesce(TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT), 0)) AS BIGINT) AS total FROM events GROUP BY 1")
def agg40(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.sum(F.coalesce(F.regexp_extract("props", r"(\d+)", 1).try_cast("bigint"), F.lit(0))).alias("total"))


@query("win09_trailing_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW), 4) AS trailing FROM events")
def win09(s, d):
    return L.trailing(read(s, d, "events"), ["user_id"], "ts", "value", 3600).select("event_id", F.round("trailing", 4).alias("trailing"))


@query("win10_ewma", with_(LEDGER, "SELECT stage, round(list_reduce(list(tokens ORDER BY ts, event_id), lambda a, v: a * 0.95::DOUBLE + v * 0.05::DOUBLE), 6) AS ewma, CAST(count(*) AS INTEGER) AS n FROM led WHERE tokens IS NOT NULL GROUP BY 1"))
def win10(s, d):
    return L.ewma(ledger(s, d), ["stage"], ["ts", "event_id"], "tokens").withColumn("ewma", F.round("ewma", 6))


@query("win11_recovery_flags", with_(LEDGER, "SELECT task, bool_or(ok) AND bool_or(NOT ok) AS recovered FROM led GROUP BY 1"))
def win11(s, d):
    return ledger(s, d).groupBy("task").agg((F.bool_or("ok") & F.bool_or(~c("ok"))).alias("recovered"))


@query("win12_episodes", "SELECT event_id, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS episode FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 2 HOURS THEN 1 ELSE 0 END AS n FROM events)")
def win12(s, d):
    return L.episodes(read(s, d, "events"), ["user_id"], "ts", "event_id", 7200).select("event_id", "episode")


def _stream(s, d):
    return stream.ledger_stream(s, d, read(s, d, "events").schema, pattern="events.parquet")


def _aside(s, name):
    return f"{shared_dir(s).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("str01_done_once", "SELECT event_id, user_id, event_type FROM events")
def str01(s, d):
    out = _aside(s, "str01")
    stream.run_available(stream.done_once(_stream(s, d), "event_id", "ts").select("event_id", "user_id", "event_type"), out, _aside(s, "str01-checkpoint"))
    return s.read.schema("event_id bigint, user_id bigint, event_type string").parquet(out)


@query("str03_window_rates", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def str03(s, d):
    rates = stream.window_rates(_stream(s, d), "ts", "1 day", ["event_type"], "value")
    name = "rates_" + uuid.uuid4().hex
    return stream.collect_available(rates, name, "complete", _aside(s, "str03")).withColumn("total", F.round("total", 4))


@query("str04_latest_status", "SELECT user_id, max_by(event_type, ts) AS event_type, max_by(event_id, ts) AS event_id, max(ts) AS at FROM events GROUP BY 1")
def str04(s, d):
    last = stream.latest_status(_stream(s, d), "user_id", "ts", ["event_type", "event_id"])
    return stream.collect_available(last, "status_" + uuid.uuid4().hex, "complete", _aside(s, "str04"))


@query("src08_struct_flatten", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def src08(s, d):
    return read(s, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p")).select("event_id", "p.*")


@query("src12_xml_counts", "SELECT c_custkey, CAST(c_custkey % 4 AS INTEGER) AS files FROM customer")
def src12(s, d):
    files_of = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < c("c_custkey") % 4), lambda i: F.lit('<file ID="f"/>')), "")
    xml = F.concat(F.lit('<mets><fileGrp USE="DEFAULT">'), files_of, F.lit('</fileGrp><fileGrp USE="THUMBS"><file/></fileGrp></mets>'))
    return read(s, d, "customer").withColumn("xml", xml).select("c_custkey", files.xml_file_count("xml").alias("files"))


@query("src13_links", "SELECT page_id, unnest(list_distinct(list_filter(regexp_extract_all(html, '<a[^>]*\\shref=\"/([a-zA-Z]+)\"', 1), lambda x: x <> ''))) AS target FROM pages")
def src13(s, d):
    return read(s, d, "pages").select("page_id", F.explode(files.links(c("html"), r"^/([a-zA-Z]+)$")).alias("target"))


@query("src16_availability", "SELECT o_custkey, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS human, count(*) FILTER (o_orderstatus = 'O') AS llm, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def src16(s, d):
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",")
    return read(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("total"), F.count_if(c("o_orderstatus") == "F").alias("human"), F.count_if(c("o_orderstatus") == "O").alias("llm"), ids.alias("ids"))


@query("src17_collection_hash", "SELECT lang, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || sha256(text), chr(10) ORDER BY CAST(doc_id AS VARCHAR) || ':' || sha256(text))) AS collection FROM documents GROUP BY 1")
def src17(s, d):
    parts = read(s, d, "documents").select("lang", F.concat_ws(":", c("doc_id").cast("string"), F.sha2("text", 256)).alias("p"))
    return streams.sequence_hash(parts, ["lang"], "p").withColumnRenamed("sha256", "collection")


@query("src18_registry_upsert", "SELECT user_id, max_by(event_id, ts) AS event_id FROM events GROUP BY 1")
def src18(s, d):
    e = read(s, d, "events").select("user_id", "event_id", "ts")
    return files.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "ts").select("user_id", "event_id")


@query("fun01_full_match", "SELECT c_custkey, regexp_full_match(c_name, 'Customer#\\d{9}') AS ok FROM customer")
def fun01(s, d):
    return read(s, d, "customer").select("c_custkey", V.full_match(c("c_name"), r"Customer#\d{9}").alias("ok"))


@query("fun02_replace_pad", "SELECT s_suppkey, replace(s_name, 'Supplier#', '') AS bare, lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS padded FROM supplier")
def fun02(s, d):
    return read(s, d, "supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier#"), F.lit("")).alias("bare"), F.lpad(c("s_suppkey").cast("string"), 4, "0").alias("padded"))


@query("fun03_split_explode", "SELECT p_partkey, unnest(str_split(p_name, ' ')) AS word FROM part")
def fun03(s, d):
    return read(s, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("fun04_slug", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_brand || ' ' || p_name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def fun04(s, d):
    return read(s, d, "part").select("p_partkey", V.slug(F.concat_ws(" ", "p_brand", "p_name")).alias("slug"))


@query("fun06_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m%d') AS issue, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) = CAST(o_orderdate AS DATE) AS same, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders")
def fun06(s, d):
    day = F.to_date(F.date_format("o_orderdate", "yyyyMMdd"), "yyyyMMdd")
    return read(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MMdd").alias("issue"), (day == F.to_date("o_orderdate")).alias("same"), F.unix_seconds(c("o_orderdate").cast("timestamp")).alias("seconds"))


@query("fun08_safe_divide", "SELECT l_suppkey, round(sum(l_tax) / nullif(sum(CASE WHEN l_discount > 0.09 THEN l_quantity ELSE 0 END), 0), 6) AS ratio FROM lineitem GROUP BY 1")
def fun08(s, d):
    return read(s, d, "lineitem").groupBy("l_suppkey").agg(F.round(V.safe_divide(F.sum("l_tax"), F.sum(F.when(c("l_discount") > 0.09, c("l_quantity")).otherwise(0.0))), 6).alias("ratio"))


@query("fun09_power_benchmark", "SELECT l_returnflag, round(avg(1 - pow(1 - 0.3::DOUBLE, l_linenumber)), 6) AS any_, round(avg(pow(0.3::DOUBLE, l_linenumber)), 6) AS all_ FROM lineitem GROUP BY 1")
def fun09(s, d):
    n = c("l_linenumber").cast("double")
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(1 - F.pow(F.lit(0.7), n)), 6).alias("any_"), F.round(F.avg(F.pow(F.lit(0.3), n)), 6).alias("all_"))


@query("fun10_backoff", "SELECT event_id, least(60.0::DOUBLE, 2 * pow(2.0::DOUBLE, event_id % 9 - 1)) AS wait, round(pow(0.5::DOUBLE, value / 60), 9) AS decay FROM events")
def fun10(s, d):
    return read(s, d, "events").select("event_id", V.backoff((c("event_id") % 9).cast("double")).alias("wait"), F.round(V.half_life(c("value")), 9).alias("decay"))


@query("fun11_json_in_noise", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fun11(s, d):
    noisy = F.concat(F.lit("<think>{no}</think> so: "), "props", F.lit(" done"))
    return read(s, d, "events").select("event_id", F.get_json_object(V.json_in(noisy), "$.k").cast("bigint").alias("k"))


@query("fun12_canonical_json", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS j FROM nation")
def fun12(s, d):
    return read(s, d, "nation").select("n_nationkey", F.to_json(F.struct("n_name", "n_regionkey")).alias("j"))


@query("fun14_array_predicates", "SELECT l_orderkey, len(list_filter(list(l_quantity), lambda x: x > 40)) > 0 AS any_, len(list_filter(list(l_quantity), lambda x: x > 5)) = count(*) AS all_ FROM lineitem GROUP BY 1")
def fun14(s, d):
    q = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("q"))
    return q.select("l_orderkey", F.exists("q", lambda x: x > 40).alias("any_"), F.forall("q", lambda x: x > 5).alias("all_"))


@query("fun15_hashes", "SELECT c_custkey, sha256(c_name) AS s256, sha1(c_name) AS s1, md5(c_name) AS m FROM customer")
def fun15(s, d):
    return read(s, d, "customer").select("c_custkey", F.sha2("c_name", 256).alias("s256"), F.sha1("c_name").alias("s1"), F.md5("c_name").alias("m"))


@query("fun16_identity_keys", "SELECT event_id, sha256(CAST(user_id AS VARCHAR) || '|' || format('{:.9f}', value)) AS k FROM events")
def fun16(s, d):
    return read(s, d, "events").select("event_id", V.face_identity(c("user_id").cast("string"), c("value")).alias("k"))


@query("fun17_error_kinds", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN e IS NULL THEN NULL WHEN lower(e) LIKE '%429%' OR lower(e) LIKE '%rate limit%' THEN 'rate_limit' WHEN lower(e) LIKE '%timeout%' OR lower(e) LIKE '%timed out%' THEN 'timeout' WHEN regexp_matches(lower(e), '\\b5\\d\\d\\b') THEN 'server' WHEN lower(e) LIKE '%json%' OR lower(e) LIKE '%schema%' THEN 'format' ELSE 'other' END AS kind FROM (SELECT (['HTTP 429', 'Timed out', 'status 503 now', 'bad JSON', 'what'])[event_id % 6 + 1] AS e FROM events)) GROUP BY 1")
def fun17(s, d):
    e = F.get(F.array(*map(F.lit, ("HTTP 429", "Timed out", "status 503 now", "bad JSON", "what"))), (c("event_id") % 6).cast("int"))
    return L.error_histogram(read(s, d, "events").withColumn("e", e), c("e"))


@query("fun20_id_lists", "SELECT o_custkey, len(list_distinct(list_filter(list(CAST(o_orderkey AS VARCHAR)), lambda x: regexp_full_match(x, '\\d{3,4}')))) AS ids FROM orders GROUP BY 1")
def fun20(s, d):
    text = F.array_join(F.transform(F.collect_list("o_orderkey"), lambda x: x.cast("string")), ";, ")
    return read(s, d, "orders").groupBy("o_custkey").agg(text.alias("t")).select("o_custkey", F.size(V.id_list(c("t"), r"\d{3,4}")).cast("bigint").alias("ids"))


SEED = "sha256('7:' || CAST(image_id AS VARCHAR))"


@query("smp01_stable_sample", with_(PAGES, f"SELECT year, image_id, CAST(row_number() OVER (PARTITION BY year ORDER BY {SEED}, image_id) AS INTEGER) AS place FROM pages_ QUALIFY row_number() OVER (PARTITION BY year ORDER BY {SEED}, image_id) <= 5"))
def smp01(s, d):
    return S.first_by_hash(pages(s, d), ["year"], "image_id", 5, 7).select("year", "image_id", "place")


STRATA = "st AS (SELECT year, count(*) AS n FROM pages_ GROUP BY 1)"


@query("smp03_hamilton", with_(PAGES, STRATA, "q AS (SELECT *, 300 * n / (SELECT sum(n) FROM st)::DOUBLE AS s FROM st)", "SELECT year, n, CAST(floor(s) + CASE WHEN row_number() OVER (ORDER BY s - floor(s) DESC, year) <= 300 - (SELECT sum(floor(s)) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q"))
def smp03(s, d):
    strata = pages(s, d).groupBy("year").agg(F.count("*").alias("n"))
    return S.hamilton(strata, [], "n", F.lit(300), "year").select("year", "n", "quota")


@query("smp04_hamilton_minimum")
def smp04(s, d):
    strata = pages(s, d).groupBy("year", "medium").agg(F.count("*").alias("n"))
    return S.hamilton_with_minimum(strata.withColumn("k", F.concat_ws("|", "year", "medium")), [], "n", 200, 4, "k")


@query("smp05_two_stage_minimum")
def smp05(s, d):
    strata = pages(s, d).groupBy("year", "medium").agg(F.count("*").alias("n"))
    return S.hamilton_with_minimum(strata, ["year"], "n", 30, 4, "medium")


@query("smp07_deficit_schedule")
def smp07(s, d):
    return S.deficit_order(S.first_by_hash(pages(s, d), ["year"], "image_id", 20, 7), "year", "image_id", 7)


@query("smp08_balanced_order", with_(PAGES, f"SELECT image_id, year, row_number() OVER (PARTITION BY year ORDER BY {SEED}, image_id) + (SELECT count(*) FROM pages_ x WHERE x.year = pages_.year AND x.image_id < 100) AS level FROM pages_ WHERE image_id >= 100"))
def smp08(s, d):
    p = pages(s, d).select("image_id", "year")
    return S.balanced_order(p, "year", "image_id", p.where("image_id < 100"), 7).select("image_id", "year", "level")


@query("smp09_promotion", with_(PAGES, "SELECT image_id, CAST(CASE WHEN image_id < 50 THEN 0 WHEN issue % 10 = 0 THEN 1 ELSE 2 END AS INTEGER) AS tier, CASE WHEN image_id >= 50 AND issue % 10 = 0 THEN -image_id ELSE image_id END AS within FROM pages_"))
def smp09(s, d):
    p = pages(s, d)
    return S.promoted(p, "image_id", "image_id", 50, p.where("issue % 10 = 0").select("image_id", (-c("image_id")).alias("rank"))).select("image_id", "tier", "within")


@query("smp10_round_robin", with_(PAGES, "SELECT image_id FROM (SELECT *, row_number() OVER (PARTITION BY year, medium ORDER BY sha256('3:' || CAST(image_id AS VARCHAR)), image_id) AS turn, sha256('3:' || CAST(year AS VARCHAR) || ':' || medium) AS cell FROM pages_) ORDER BY turn, cell LIMIT 60"))
def smp10(s, d):
    return S.round_robin(pages(s, d), ["year", "medium"], "image_id", 3).orderBy("turn", "cell").limit(60).select("image_id")


REPS = 100
DRAWS = f"cl AS (SELECT year, issue, row_number() OVER (PARTITION BY year ORDER BY issue) - 1 AS slot, count(*) OVER (PARTITION BY year) AS n FROM (SELECT DISTINCT year, issue FROM pages_)), dr AS (SELECT b AS replicate, year, ('0x' || substr(md5(b || '|' || year || '|' || slot), 1, 8))::BIGINT % n AS slot FROM cl CROSS JOIN (SELECT unnest(range({REPS})) AS b)), wt AS (SELECT CAST(replicate AS INTEGER) AS replicate, dr.year, issue, count(*) AS weight FROM dr JOIN cl ON cl.year = dr.year AND cl.slot = dr.slot GROUP BY ALL)"
SUMS = "sm AS (SELECT year, issue, CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS num, CAST(count(*) AS DOUBLE) AS den FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_custkey AS issue, o_orderstatus FROM orders) GROUP BY ALL)"


def weights(s, d):
    return S.bootstrap_weights(issues(s, d), "issue", "year", REPS)


def sums(s, d):
    o = read(s, d, "orders").select(F.year("o_orderdate").alias("year"), c("o_custkey").alias("issue"), "o_orderstatus")
    return o.groupBy("year", "issue").agg(F.count_if(c("o_orderstatus") == "F").cast("double").alias("num"), F.count("*").cast("double").alias("den"))


def yearly(s, d, years=None):
    """Each year's share of finished orders in each replicate; a year's draws are its own, so some years need no others."""
    rows = [x if years is None else x.where(c("year").isin(*years)) for x in (issues(s, d), sums(s, d))]
    return B.ratio_series(*rows, "issue", "year", ["year"], REPS)


def two_years(s, d):
    """The series of 1996 and 1999, made once: a row for each year and replicate is stored."""
    series = stored(yearly(s, d, (1996, 1999)), "series")
    return [series.where(c("year") == y).drop("year") for y in (1996, 1999)]


def issues(s, d):
    return pages(s, d).select("year", "issue").distinct()


@query("smp12_bootstrap_weights", with_(PAGES, DRAWS, "SELECT replicate, year, count(*) AS issues, CAST(sum(weight) AS BIGINT) AS draws, max(weight) AS most FROM wt GROUP BY ALL"))
def smp12(s, d):
    return weights(s, d).groupBy("replicate", "year").agg(F.count("*").alias("issues"), F.sum("weight").alias("draws"), F.max("weight").alias("most"))


SERIES = "se AS (SELECT sm.year, replicate, sum(weight * num) / sum(weight * den) AS value FROM sm JOIN wt ON wt.year = sm.year AND wt.issue = sm.issue GROUP BY ALL)"


@query("smp13_cluster_interval", with_(PAGES, DRAWS, SUMS, SERIES, "SELECT year, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.975), 6) AS high, count(value) AS replicates FROM se GROUP BY 1"))
def smp13(s, d):
    series = yearly(s, d)
    return S.interval(series, ["year"]).withColumns({k: F.round(k, 6) for k in ("low", "high")})


@query("smp14_paired_gap", with_(PAGES, DRAWS, SUMS, SERIES, "SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, count(v) AS replicates FROM (SELECT b.value - a.value AS v FROM se a JOIN se b ON a.replicate = b.replicate WHERE a.year = 1996 AND b.year = 1999)"))
def smp14(s, d):
    return S.interval(S.paired_delta(*two_years(s, d), []), []).withColumns({k: F.round(k, 6) for k in ("low", "high")})


@query("smp15_weight_audit", with_(PAGES, DRAWS, "SELECT count(*) FILTER (s <> k) AS wrong_sums FROM (SELECT replicate, wt.year, sum(weight) AS s, any_value(n) AS k FROM wt JOIN (SELECT DISTINCT year, n FROM cl) USING (year) GROUP BY ALL)"))
def smp15(s, d):
    sizes = pages(s, d).groupBy("year").agg(F.count_distinct("issue").alias("k"))
    return weights(s, d).groupBy("replicate", "year").agg(F.sum("weight").alias("s")).join(sizes, "year").agg(F.count_if(c("s") != c("k")).alias("wrong_sums"))


@query("smp24_blind_ids", with_(PAGES, "SELECT image_id, 'B' || lpad(CAST(n AS VARCHAR), CAST(greatest(6, len(CAST(n AS VARCHAR))) AS INTEGER), '0') AS blind_id, CAST(ceil(n / 40.0) AS BIGINT) AS sheet, (n - 1) % 40 + 1 AS line FROM (SELECT image_id, row_number() OVER (ORDER BY sha256('5:' || CAST(image_id AS VARCHAR)), image_id) AS n FROM pages_)"))
def smp24(s, d):
    n = c("position") + 1
    name = F.concat(F.lit("B"), F.lpad(n.cast("string"), F.greatest(F.lit(6), F.length(n.cast("string"))), F.lit("0")))
    placed = tables.numbered(pages(s, d).select("image_id"), [S.hash_key(5, c("image_id")), c("image_id")])
    return placed.select("image_id", name.alias("blind_id"), F.ceil(n / 40).alias("sheet"), ((n - 1) % 40 + 1).alias("line"))


@query("smp22_splits", with_(PAGES, "SELECT CASE WHEN image_id < 140 THEN 'development' WHEN image_id < 280 THEN 'reserve' ELSE 'rest' END AS split, count(*) AS n FROM pages_ GROUP BY 1"))
def smp22(s, d):
    return pages(s, d).groupBy(V.chosen([(c("image_id") < 140, "development"), (c("image_id") < 280, "reserve")], "rest").alias("split")).agg(F.count("*").alias("n"))
