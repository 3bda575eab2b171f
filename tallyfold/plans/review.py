"""Queries of the review operators, registered beside the catalog's, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.operators import records as R
from tallyfold.operators import review as V
from tallyfold.plans import adapters as A
from tallyfold.plans.catalog import _ATT, _BROKEN, _CLEAN, _ESC, _HRIS, _PAIRS, _RECORDS, _attempts, _cleaned, _escalations, _query, _records, scored_pairs

_ALL_PAIRS = _PAIRS.replace(" where id < 600", "")
_CODES_AGAIN = "(429, 500, 502, 503, 504)"


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


_ACTION = "case scope_key when '1-URGENT' then 'approve' when '2-HIGH' then 'edit' when '3-MEDIUM' then 'reject' end"
_SUGGESTED = "case when id % 3 <> 0 then 'v' || cast(id % 5 as string) end"


@_query(f"""with {_ESC}, asked as (select id, {_ACTION} as action, {_SUGGESTED} as suggested from esc where status = 'open')
select id, action, case action when 'approve' then suggested when 'edit' then 'typed' end as value, case when action is null or (action = 'approve' and suggested is null) then 'open' else 'resolved' end as status from asked""")
def resolve_answers(spark, sf_dir):
    found = _escalations(spark, sf_dir).where("status = 'open'")
    answers = found.select("reason_code", "signature", F.expr(_ACTION).alias("action"), F.lit("typed").alias("typed")).distinct().where("action is not null")
    open_ = found.select("id", "reason_code", "signature", F.expr(_SUGGESTED).alias("suggested"))
    return V.resolve(open_, answers).select("id", "action", "value", "status")


_ASKED = "select k, case when k % 3 = 0 then 'R2' else 'R5' end as rule from hris where k % 12 = 0 or k % 200 = 17 and k % 7 <> 0 or k % 100 = 1"


@_query(f"""with {_CLEAN}, failing as (select k, unnest({_BROKEN}) as rule from cleaned), asked as ({_ASKED})
select coalesce(a.k, f.k) as k, coalesce(a.rule, f.rule) as rule, case when f.k is null then 'superseded' when a.k is null then 'new' else 'stays' end as outcome from asked a full join failing f on a.k = f.k and a.rule = f.rule""")
def requestion_survivors(spark, sf_dir):
    failing = _cleaned(spark, sf_dir).select("k", F.explode(R.broken_rules()).alias("rule"))
    return V.requestion(A.view(spark, sf_dir, _ASKED, hris=A.hris_records(spark, sf_dir)), failing, ["k", "rule"])


@_query(f"""with {_CLEAN}, before as (select *, {_BROKEN} as was from cleaned), filled as (select * replace (coalesce(termination_date, case cast((k - 12) / 300 as int) % 3 when 0 then cast(hire_date + interval 30 day as date) when 1 then cast(hire_date - interval 10 day as date) end) as termination_date) from before where list_contains(was, 'R2')),
after as (select *, {_BROKEN} as now from filled)
select k, cast(termination_date as varchar) as filled, array_to_string(list_filter(now, lambda x: not list_contains(was, x)), ',') as newly_broken, list_contains(now, 'R2') as unfixed, not list_contains(now, 'R2') and len(list_filter(now, lambda x: not list_contains(was, x))) = 0 as accepted from after""")
def fill_verdicts(spark, sf_dir):
    turn = F.expr("cast((k - 12) / 300 as int) % 3")
    proposed = F.when(turn == 0, F.date_add("hire_date", 30)).when(turn == 1, F.date_sub("hire_date", 10))
    judged = V.judge_fills(_cleaned(spark, sf_dir), "R2", "termination_date", proposed)
    return judged.select("k", F.col("termination_date").cast("string").alias("filled"), F.array_join("newly_broken", ",").alias("newly_broken"), "unfixed", "accepted")


_PAYLOADS = "select k, 'CC-' || cast(100 * (1 + k % 7) as string) as cost_center, case k % 4 when 0 then 'full_time' when 1 then 'intern' when 2 then '' end as employment_type, case k % 9 when 0 then 'Dircetor' when 1 then '' else 'Director' end as designation, date_of_birth as born from hris"


@_query(f"with {_HRIS}, payloads as ({_PAYLOADS}) select k, case when cost_center not in ('CC-100', 'CC-200', 'CC-300', 'CC-400', 'CC-500') then 'cost_center' when employment_type = 'intern' then 'employment_type' when designation = 'Dircetor' then 'designation' when born = '' then 'date_of_birth' end as refused from payloads")
def target_verdicts(spark, sf_dir):
    payloads = A.view(spark, sf_dir, _PAYLOADS, hris=A.hris_records(spark, sf_dir))
    return payloads.select("k", V.target_verdict(F.col("cost_center"), F.col("employment_type"), F.col("designation"), F.col("born")).alias("refused"))


@_query(f"with {_ATT} select record_id, attempt_number, case when status_code in {_CODES_AGAIN} and attempt_number <= 4 then 'retry' when status_code in {_CODES_AGAIN} then 'PUSH_UNREACHABLE' when status_code in (400, 409, 422) then 'PUSH_REJECTED' else 'done' end as decision from attempts")
def delivery_decisions(spark, sf_dir):
    return _attempts(spark, sf_dir).select("record_id", "attempt_number", V.delivery_decision(F.col("status_code"), F.col("attempt_number")).alias("decision"))


_VERDICT, _SURE = "case a_id % 3 when 0 then 'different' when 1 then 'unsure' end", "cast(b_id % 10 as double) / 10"


@_query(f"with {_ALL_PAIRS} select a_id, b_id, case when score >= 0.9 then 'merge' when score < 0.72 then 'separate' when a_id % 3 = 0 and cast(b_id % 10 as double) / 10 >= 0.75 then 'separate' else 'ask' end as decision from pairs where score > 0")
def pair_decisions(spark, sf_dir):
    return scored_pairs(spark, sf_dir).select("a_id", "b_id", V.pair_decision(F.col("score"), F.expr(_VERDICT), F.expr(_SURE)).alias("decision"))


@_query(f"""with {_ALL_PAIRS}, band as (select * from pairs where score >= 0.72 and score < 0.9),
cells as (select a_id, b_id, unnest(['first_name', 'department']) as field, unnest([a.first_name, a.department]) as a_value, unnest([b.first_name, b.department]) as b_value from band join records a on a.id = a_id join records b on b.id = b_id)
select *, coalesce(a_value, '') <> coalesce(b_value, '') as differs from cells""")
def pair_compare(spark, sf_dir):
    return V.compare_pairs(_records(spark, sf_dir), scored_pairs(spark, sf_dir).where("score >= 0.72 and score < 0.9"), ["first_name", "department"])


_STATE = "select o_custkey as employee_id, max(o_orderkey) as seq, cast(max(o_orderkey) % 97 as string) as digest from orders where o_orderkey % 2 = {half} group by o_custkey"


@_query("select o_custkey as employee_id, max(o_orderkey) as seq, cast(max(o_orderkey) % 97 as varchar) as digest from orders group by o_custkey")
def pushed_state_upsert(spark, sf_dir):
    half = lambda k: A.view(spark, sf_dir, _STATE.format(half=k))
    return V.upsert(half(0), half(1), ["employee_id"], "seq")


@_query("with a as (select distinct p_type as prompt, 'old' as response from part where p_size < 10) select * from a union all select p_type, min(p_brand) from part where p_type not in (select prompt from a) group by p_type")
def cache_insert(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("prompt"), F.col("p_brand").alias("response"), "p_size")
    old = parts.where("p_size < 10").select("prompt", F.lit("old").alias("response")).distinct()
    return V.insert_new(old, parts.select("prompt", "response"), ["prompt"])


@_query("select o_orderkey, 'status' as field, o_orderstatus as before, case when o_orderkey % 5 = 0 then 'X' end as after from orders where o_orderkey % 3 = 0")
def audit_transitions(spark, sf_dir):
    before = _orders(spark, sf_dir).select("o_orderkey", F.col("o_orderstatus").alias("status"))
    after = before.withColumn("status", F.expr("case when o_orderkey % 3 <> 0 then status when o_orderkey % 5 = 0 then 'X' end"))
    return V.transitions(before, after, "o_orderkey", "status")


@_query(f"with {_ESC}, cards as (select reason_code, entity_id, count(*) as similar_count, cast(sum(affected_count) as bigint) as rows_affected from esc where status = 'open' group by 1, 2), nth as (select *, row_number() over (partition by reason_code order by rows_affected desc, entity_id) as place from cards) select reason_code, entity_id, similar_count, rows_affected, place from nth where place <= 25")
def queue_top_cards(spark, sf_dir):
    cards = _escalations(spark, sf_dir).where("status = 'open'").groupBy("reason_code", "entity_id").agg(F.count("*").alias("similar_count"), F.sum("affected_count").alias("rows_affected"))
    return cards.withColumn("place", F.row_number().over(Window.partitionBy("reason_code").orderBy(F.desc("rows_affected"), "entity_id"))).where("place <= 25")


@_query("select r_name as run, (select count(*) from nation where n_regionkey = r_regionkey) as files, (select string_agg(n_name, ', ' order by n_name) from nation where n_regionkey = r_regionkey) as filenames, (select count(*) from customer join nation on n_nationkey = c_nationkey where n_regionkey = r_regionkey) as records from region")
def runs_list(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation")
    files = nation.groupBy("n_regionkey").agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("filenames"))
    rows = read("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n")).join(nation, "n_nationkey").groupBy("n_regionkey").agg(F.sum("n").alias("records"))
    key = F.col("r_regionkey") == F.col("n_regionkey")
    with_files = read("region").join(files, key, "left").drop("n_regionkey").join(rows, key, "left")
    return with_files.select(F.col("r_name").alias("run"), F.coalesce("files", F.lit(0)).alias("files"), "filenames", F.coalesce("records", F.lit(0)).alias("records"))


@_query("select c_custkey, c_name from customer order by c_acctbal desc, c_custkey limit 50 offset 100")
def browse_page(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").orderBy(F.desc("c_acctbal"), "c_custkey").offset(100).limit(50).select("c_custkey", "c_name")


@_query(f"with {_HRIS} select last_name, count(*) as members from hris group by last_name having count(*) >= 2")
def surname_pools(spark, sf_dir):
    return A.hris_records(spark, sf_dir).groupBy("last_name").agg(F.count("*").alias("members")).where("members >= 2")


@_query(f"with {_RECORDS} select id, coalesce(nullif(employee_id, ''), nullif(lower(trim(work_email)), ''), cast(id as varchar)) as identity, coalesce(nullif(trim(concat_ws(' ', nullif(first_name, ''), nullif(last_name, ''))), ''), 'nothing') as shown from records")
def record_identity(spark, sf_dir):
    filled = lambda c: F.nullif(c, F.lit(""))
    identity = F.coalesce(filled(F.col("employee_id")), filled(F.lower(F.trim("work_email"))), F.col("id").cast("string"))
    shown = F.coalesce(filled(F.trim(F.concat_ws(" ", filled(F.col("first_name")), filled(F.col("last_name"))))), F.lit("nothing"))
    return _records(spark, sf_dir).select("id", identity.alias("identity"), shown.alias("shown"))


@_query("select o_orderkey, cast(o_orderkey % 5 as varchar) || 'm' || cast(o_orderkey % 59 as varchar) || '.5s' as raw, (o_orderkey % 5) * 60.0::double + o_orderkey % 59 + 0.5 as seconds from orders")
def duration_parse(spark, sf_dir):
    raw = F.expr("cast(o_orderkey % 5 as string) || 'm' || cast(o_orderkey % 59 as string) || '.5s'")
    return _orders(spark, sf_dir).select("o_orderkey", raw.alias("raw"), V.duration_seconds(raw).alias("seconds"))


@_query(f"with {_ESC} select percentile_cont(0.5) within group (order by affected_count) as median, max(affected_count) as most, round(avg(case when status = 'resolved' then 1.0 else 0.0 end), 6) as accuracy from esc")
def eval_summary(spark, sf_dir):
    return _escalations(spark, sf_dir).agg(F.median("affected_count").alias("median"), F.max("affected_count").alias("most"), F.round(F.avg((F.col("status") == "resolved").cast("double")), 6).alias("accuracy"))
