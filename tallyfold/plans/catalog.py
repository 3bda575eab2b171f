"""Every registered query of the engine with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.config import SCHEMA, STATUSES
from tallyfold.functions import fuzzy, text, values
from tallyfold.operators import pairs as P
from tallyfold.operators import records as R
from tallyfold.plans import adapters as A

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_FIELDS = tuple(f for f in SCHEMA if f.name in ("employee_id", "first_name", "last_name", "work_email", "phone", "date_of_birth", "hire_date", "employment_status", "department", "manager_employee_id", "termination_date"))


def _query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# The oracle's side: the same definitions in the oracle's dialect, written apart from the DataFrame code.
_HRIS = f"hris as ({A.hris("({d} - date '1899-12-30')")})"
_RECORDS = f"{_HRIS}, records as ({A.RECORDS})"
_ESC = f"esc as ({A.ESCALATIONS})"
_ATT = f"attempts as ({A.ATTEMPTS})"


def _slash(c: str) -> str:
    return f"(regexp_full_match({c}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') and try_strptime({c}, '%d/%m/%Y') is not null and try_strptime({c}, '%m/%d/%Y') is not null and try_strptime({c}, '%d/%m/%Y') <> try_strptime({c}, '%m/%d/%Y'))"


def _date(c: str) -> str:
    window = lambda d: f"case when {d} between date '1920-01-01' and date '2100-01-01' then {d} end"
    serial = window(f"(date '1899-12-30' + cast(case when regexp_full_match({c}, '\\d{{4,6}}') then {c} end as int))")
    epoch = window(f"(date '1970-01-01' + cast(cast(case when regexp_full_match({c}, '\\d{{9,10}}') then {c} end as bigint) // 86400 as int))")
    formats = ", ".join(f"cast(try_strptime({c}, '{p}') as date)" for p in ("%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%d-%b-%Y", "%d %b %Y", "%Y/%m/%d"))
    return f"case when {_slash(c)} then null else coalesce({serial}, {epoch}, {formats}) end"


def _enum(c: str) -> str:
    near = [f"{{'d': levenshtein(lower(trim({c})), '{v}'), 'k': {k}, 'v': '{v}'}}" for k, v in enumerate(("active", "on_leave", "terminated"))]
    return f"list_min([{', '.join(near)}])"


_CLEAN = f"""{_HRIS}, cleaned as (select k, employee_id, manager_employee_id, {_date('date_of_birth')} as date_of_birth, {_date('hire_date')} as hire_date, {_date('termination_date')} as termination_date,
  {_slash('date_of_birth')} as amb_birth, {_slash('hire_date')} as amb_hire, {_slash('termination_date')} as amb_end,
  case when {_enum('employment_status')}.d <= 1 then {_enum('employment_status')}.v end as employment_status, {_enum('employment_status')}.d as distance, trim(employment_status) as raw_status from hris)"""
_BROKEN = """list_filter([case when termination_date < hire_date then 'R1' end, case when employment_status = 'terminated' and termination_date is null then 'R2' end,
  case when coalesce(employment_status, '') <> 'terminated' and termination_date is not null then 'R3' end, case when date_of_birth > hire_date - interval 16 year then 'R4' end,
  case when manager_employee_id = employee_id then 'R5' end], lambda x: x is not null)"""
_ISSUES = f"""{_CLEAN}, issues as (
  select 'DATE_FORMAT_AMBIGUOUS' as reason_code, 'legacy_hris_employees.csv:date_of_birth' as scope_key, employee_id as entity_id from cleaned where amb_birth
  union all select 'DATE_FORMAT_AMBIGUOUS', 'legacy_hris_employees.csv:hire_date', employee_id from cleaned where amb_hire
  union all select 'DATE_FORMAT_AMBIGUOUS', 'legacy_hris_employees.csv:termination_date', employee_id from cleaned where amb_end
  union all select 'VALUE_LOW_CONFIDENCE', 'employment_status:' || raw_status, employee_id from cleaned where distance > 1
  union all select 'LOGIC_CONTRADICTION', 'record:' || unnest({_BROKEN}), employee_id from cleaned),
signed as (select *, sha256(reason_code || ':' || scope_key) as signature from issues)"""


def _cleaned(spark, sf_dir):
    return R.clean_records(A.hris_records(spark, sf_dir), _FIELDS)


@_query(f"with {_HRIS} select k, nullif(trim(regexp_replace(first_name, '\\s+', ' ', 'g')), '') as cleaned from hris")
def clean_string(spark, sf_dir):
    return A.hris_records(spark, sf_dir).select("k", text.clean_string(F.col("first_name")).alias("cleaned"))


@_query(f"with {_HRIS} select k, lower(trim(work_email)) as cleaned from hris")
def clean_email(spark, sf_dir):
    return A.hris_records(spark, sf_dir).select("k", text.clean_email(F.col("work_email")).alias("cleaned"))


@_query(f"with {_HRIS} select k, case when regexp_full_match(right(regexp_replace(phone, '[\\s().-]', '', 'g'), 10), '[6-9]\\d{{9}}') then '+91' || right(regexp_replace(phone, '[\\s().-]', '', 'g'), 10) end as cleaned from hris")
def clean_phone(spark, sf_dir):
    return A.hris_records(spark, sf_dir).select("k", text.clean_phone(F.col("phone")).alias("cleaned"))


@_query(f"with {_HRIS} select k, cast({_date('date_of_birth')} as varchar) as born, {_slash('date_of_birth')} as born_ambiguous, cast({_date('hire_date')} as varchar) as hired, {_slash('hire_date')} as hired_ambiguous from hris")
def parse_date_all(spark, sf_dir):
    born, hired = values.parse_date(F.col("date_of_birth")), values.parse_date(F.col("hire_date"))
    return A.hris_records(spark, sf_dir).select("k", born["value"].cast("string").alias("born"), born["ambiguous"].alias("born_ambiguous"), hired["value"].cast("string").alias("hired"), hired["ambiguous"].alias("hired_ambiguous"))


@_query(f"with {_HRIS} select k, cast(try_cast(regexp_replace(annual_ctc, '₹|\\$|,|\\s|INR|USD|EUR', '', 'g') as decimal(38,10)) as double) as amount, case when upper(annual_ctc) like '%USD%' then 'USD' when upper(annual_ctc) like '%EUR%' then 'EUR' else 'INR' end as currency from hris")
def clean_number(spark, sf_dir):
    got = values.clean_number(F.col("annual_ctc"))
    return A.hris_records(spark, sf_dir).select("k", got["amount"].cast("double").alias("amount"), got["currency"].alias("currency"))


@_query(f"with {_HRIS} select k, case when {_enum('employment_status')}.d <= 1 then {_enum('employment_status')}.v end as value, {_enum('employment_status')}.d as distance, {_enum('employment_status')}.v as nearest from hris")
def coerce_enum(spark, sf_dir):
    got = values.coerce_enum(F.col("employment_status"), ("active", "on_leave", "terminated"))
    return A.hris_records(spark, sf_dir).select("k", got["value"].alias("value"), got["distance"].alias("distance"), got["nearest"].alias("nearest"))


@_query(f"with {_HRIS} select distinct 'employment_status' as field, trim(employment_status) as raw from hris where {_enum('employment_status')}.d > 1")
def enum_unresolved_distinct(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(F.explode("doubts").alias("d")).where("d.reason_code = 'VALUE_LOW_CONFIDENCE'").select("d.field", "d.raw").distinct()


@_query(f"with {_CLEAN} select k, array_to_string({_BROKEN}, ',') as broken from cleaned")
def rules_array(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("k", F.array_join(R.broken_rules(), ",").alias("broken"))


@_query(f"with {_HRIS} select k, employee_id, manager_employee_id from hris where manager_employee_id not in (select employee_id from hris)")
def rule_r6(spark, sf_dir):
    return R.dangling_managers(A.hris_records(spark, sf_dir)).select("k", "employee_id", "manager_employee_id")


@_query(f"with {_CLEAN} select k, concat_ws(',', case when hire_date is null then 'hire_date' end, case when employment_status is null then 'employment_status' end) as missing from cleaned")
def strict_gate(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("k", F.array_join(R.field_errors(_FIELDS, strict=True), ",").alias("missing"))


@_query(f"with {_ISSUES} select reason_code, scope_key, entity_id, signature from signed")
def signature_hash(spark, sf_dir):
    return R.issues(_cleaned(spark, sf_dir), "employee_id", "legacy_hris_employees.csv")


@_query(f"with {_ISSUES} select reason_code, signature, min(scope_key) as scope_key, min(entity_id) as first_entity, count(*) as rows_affected from signed group by reason_code, signature")
def issues_grouped(spark, sf_dir):
    return R.grouped(signature_hash(spark, sf_dir))


@_query(f"with {_ISSUES} select reason_code, signature, min(scope_key) as scope_key, min(entity_id) as first_entity, count(*) as rows_affected from signed where scope_key <> 'employment_status:unknown' group by reason_code, signature")
def decisions_antijoin(spark, sf_dir):
    found = signature_hash(spark, sf_dir)
    return R.grouped(found, found.where("scope_key = 'employment_status:unknown'").select("reason_code", "signature"))


@_query(f"with {_ISSUES}, hit as (select distinct entity_id from signed where reason_code = 'LOGIC_CONTRADICTION') select case when entity_id is not null then 'blocked' else 'clean' end as status, count(*) as n from hris left join hit on employee_id = entity_id group by 1")
def records_by_status(spark, sf_dir):
    hit = signature_hash(spark, sf_dir).where("reason_code = 'LOGIC_CONTRADICTION'").select(F.col("entity_id").alias("employee_id")).distinct().withColumn("status", F.lit("blocked"))
    return A.hris_records(spark, sf_dir).join(hit, "employee_id", "left").groupBy(F.coalesce("status", F.lit("clean")).alias("status")).agg(F.count("*").alias("n"))


@_query(f"with {_ISSUES}, tiles(status, ord) as (values {', '.join(f"('{s}', {k})" for k, s in enumerate(STATUSES))}), hit as (select distinct entity_id from signed where reason_code = 'LOGIC_CONTRADICTION'), n as (select case when entity_id is not null then 'blocked' else 'clean' end as status, count(*) as n from hris left join hit on employee_id = entity_id group by 1) select status, ord, coalesce(n, 0) as n from tiles left join n using (status) where status <> 'pending' or n > 0")
def status_tiles(spark, sf_dir):
    tiles = spark.createDataFrame([(s, k) for k, s in enumerate(STATUSES)], "status string, ord int")
    return tiles.join(records_by_status(spark, sf_dir), "status", "left").select("status", "ord", F.coalesce("n", F.lit(0)).alias("n")).where("status <> 'pending' or n > 0")


@_query("select 'o_orderpriority' as name, count(*) as n, 0.0 as null_rate, count(distinct o_orderpriority) as distinct_count, 0.0 as numeric_share, 0.0 as date_share, 'text' as inferred_type from orders union all select 'o_orderkey', count(*), 0.0, least(count(distinct o_orderkey), 10001), 1.0, 0.0, 'numeric' from orders")
def profile_columns(spark, sf_dir):
    return R.profile(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority", "o_orderkey"])


def _map_scores(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_type").alias("header"), F.lit(0.0).alias("null_rate")).distinct()
    fields = spark.createDataFrame([(f.name, k) for k, f in enumerate(SCHEMA)], "field string, field_ord int")
    pairs = parts.join(F.broadcast(fields), F.lit(True)).withColumns({"a": fuzzy.token_sorted(text.header(F.col("header"))), "b": fuzzy.token_sorted(text.header(F.col("field")))})
    return pairs.select("header", "field", "field_ord", "null_rate", fuzzy.ratio("a", "b").alias("score"))


_LCS = """fields(field, field_ord) as (values {fields}),
sorted as (select header, field, field_ord, array_to_string(list_sort(string_split(replace(lower(header), '_', ' '), ' ')), ' ') as a, array_to_string(list_sort(string_split(replace(lower(field), '_', ' '), ' ')), ' ') as b
  from (select distinct p_type as header from part) cross join fields),
dp as (select header, field, field_ord, a, b, 0 as i, list_transform(range(length(b) + 1), lambda x: 0::bigint) as line from sorted
  union all select header, field, field_ord, a, b, i + 1,
    list_reduce(range(1, length(b) + 1), lambda acc, j: list_append(acc, case when substring(a, i + 1, 1) = substring(b, j, 1) then line[j] + 1 else greatest(line[j + 1], acc[j]) end), [0::bigint])
  from dp where i < length(a)),
scores as (select header, field, field_ord, 2.0 * line[length(b) + 1] / (length(a) + length(b)) as score from dp where i = length(a))""".replace("{fields}", ", ".join(f"('{f.name}', {k})" for k, f in enumerate(SCHEMA)))


@_query(f"with recursive {_LCS} select header, field, round(score, 6) as score from scores")
def map_scores(spark, sf_dir):
    return _map_scores(spark, sf_dir).select("header", "field", F.round("score", 6).alias("score"))


@_query(f"with recursive {_LCS}, ranked as (select *, row_number() over (partition by header order by score desc, field_ord) as nth from scores), top as (select header, max(case when nth = 1 then field end) as target, round(max(case when nth = 1 then score end), 4) as confidence, round(max(case when nth = 2 then score end), 4) as runner_up from ranked group by header) select *, case when confidence < 0.5 then 'MAP_UNMAPPED' when confidence < 0.85 or confidence - runner_up < 0.1 then 'MAP_AMBIGUOUS' else 'accept' end as decision from top")
def map_decide(spark, sf_dir):
    return R.decide_mapping(_map_scores(spark, sf_dir))


_BLOCK = "'em:' || substring(split_part(work_email, '@', 1), 1, 5)"
_PAIRS = f"""{_RECORDS}, blocked as (select *, {_BLOCK} as block, split_part(work_email, '@', 1) as lp from records where id < 600),
pairs as (select a.id as a_id, b.id as b_id, a.block as block, case when a.employee_id <> '' and b.employee_id <> '' and a.employee_id <> b.employee_id then 0.0 when a.lp = b.lp then 1.0 when levenshtein(a.lp, b.lp) <= 2 then 0.85 else 0.0 end as score
  from blocked a join blocked b on a.block = b.block and a.id < b.id)"""


def _records(spark, sf_dir):
    return A.source_records(spark, sf_dir)


@_query(f"with {_RECORDS} select id, {_BLOCK} as block from records")
def block_keys(spark, sf_dir):
    return _records(spark, sf_dir).select("id", fuzzy.blocking_key(F.col("work_email"), F.col("first_name"), F.col("last_name"), F.col("phone")).alias("block"))


@_query(_PAIRS.replace(" where id < 600", "").join(("with ", " select a_id, b_id, block, score from pairs where score > 0")))
def scored_pairs(spark, sf_dir):
    return P.candidate_pairs(_records(spark, sf_dir))


@_query(_PAIRS.replace(" where id < 600", "").join(("with ", " select a_id, b_id, score, sha256('DUPE_AMBIGUOUS:' || least(cast(a_id as varchar), cast(b_id as varchar)) || '|' || greatest(cast(a_id as varchar), cast(b_id as varchar))) as signature from pairs where score >= 0.72 and score < 0.9")))
def band_pairs(spark, sf_dir):
    a, b = F.col("a_id").cast("string"), F.col("b_id").cast("string")
    asked = R.signature(F.lit("DUPE_AMBIGUOUS"), F.concat_ws("|", F.least(a, b), F.greatest(a, b)))
    return scored_pairs(spark, sf_dir).where("score >= 0.72 and score < 0.9").select("a_id", "b_id", "score", asked.alias("signature"))


# Records of one key, and e-mails that are equal, lie in one cluster: in this view, those of one local part or key.
_CLUSTERS = f"{_RECORDS}, keyed as (select *, coalesce(nullif(employee_id, ''), 'lp') as _, regexp_extract(work_email, '(\\d+)@', 1) as person, split_part(work_email, '@', 1) as lp from records), clusters as (select id, min(id) over (partition by case when lp like 'x%' and employee_id = '' then lp else person end) as cluster_id, filename, first_name, last_name, department from keyed)"


@_query(f"with {_CLUSTERS} select id, cluster_id from clusters")
def components(spark, sf_dir):
    return R.cluster(_records(spark, sf_dir))


@_query(f"with {_CLUSTERS}, ranked as (select *, case when filename like 'legacy_hris%' then 0 when filename like 'payroll%' then 1 else 2 end as rank from clusters) select id, first_value(id) over (partition by cluster_id order by rank, id) as survivor_id, case when count(*) over (partition by cluster_id) = 1 then 'clean' when id = first_value(id) over (partition by cluster_id order by rank, id) then 'merged_survivor' else 'merged' end as status from ranked")
def survivor_pick(spark, sf_dir):
    rows = _records(spark, sf_dir)
    clustered = rows.join(components(spark, sf_dir), "id")
    size = F.count("*").over(Window.partitionBy("cluster_id"))
    survivor = F.first("id").over(Window.partitionBy("cluster_id").orderBy(R.source_rank(F.col("filename")), "id"))
    return clustered.select("id", survivor.alias("survivor_id"), F.when(size == 1, "clean").when(F.col("id") == survivor, "merged_survivor").otherwise("merged").alias("status"))


_SURVIVE = f"""{_CLUSTERS}, long as (select cluster_id, id, filename, 'first_name' as field, first_name as value from clusters union all select cluster_id, id, filename, 'last_name', last_name from clusters union all select cluster_id, id, filename, 'department', department from clusters),
by_file as (select cluster_id, field, filename, arg_min(value, id) as value, min(id) as id, case when filename like 'legacy_hris%' then 0 when filename like 'payroll%' then 1 else 2 end as rank from long where value <> '' group by cluster_id, field, filename),
merged as (select cluster_id, field, arg_min(value, rank * 1000000000 + id) as value, arg_min(filename, rank * 1000000000 + id) as source, string_agg(filename, '|' order by filename) as sources, count(distinct value) > 1 as conflict from by_file group by cluster_id, field)"""


def _survived(spark, sf_dir):
    rows = _records(spark, sf_dir).join(components(spark, sf_dir), "id")
    return R.survivorship(rows, ["first_name", "last_name", "department"], material=("department",))


@_query(f"with {_SURVIVE} select cluster_id, field, value, source, sources, conflict, conflict and field = 'department' as asks from merged")
def survivorship_merge(spark, sf_dir):
    return _survived(spark, sf_dir)


@_query(f"with {_SURVIVE} select sha256('CONFLICT_ACROSS_SOURCES:' || field || ':' || sources) as signature, count(*) as rows_affected from merged where conflict and field = 'department' group by 1")
def conflicts(spark, sf_dir):
    sig = R.signature(F.lit("CONFLICT_ACROSS_SOURCES"), F.concat_ws(":", "field", "sources"))
    return _survived(spark, sf_dir).where("asks").groupBy(sig.alias("signature")).agg(F.count("*").alias("rows_affected"))


@_query(f"with {_RECORDS}, s as ({ORACLES['survivor_pick'].replace('with ' + _CLUSTERS + ',', 'with c0 as (select 1), ' + _CLUSTERS[len(_RECORDS) + 2:] + ',')}) select r.id, s.status from records r join s using (id) where s.status = 'clean' and trim(r.employee_id) = ''")
def orphans(spark, sf_dir):
    return survivor_pick(spark, sf_dir).join(_records(spark, sf_dir), "id").where("status = 'clean' and trim(employee_id) = ''").select("id", "status")


_PAY = "select cast(o_orderkey as varchar) as employee_id, o_orderstatus, o_orderpriority from orders"


@_query("select cast(o_orderkey as varchar) as employee_id, case when o_orderkey % 4 = 0 then 'created' when o_orderkey % 11 = 5 then 'changed' else 'unchanged' end as outcome from orders")
def delta_classify(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("employee_id"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    digest = R.payload_digest(["employee_id", "o_orderstatus", "o_orderpriority"])
    before = orders.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 11 == 5, "old").otherwise(F.col("o_orderstatus")))
    now = orders.select("employee_id", digest.alias("digest"))
    return R.delta(now, before.select("employee_id", digest.alias("digest")), now.limit(0)).select("employee_id", "outcome")


@_query("select cast(o_orderkey as varchar) as employee_id, sha256('{\"employee_id\":\"' || cast(o_orderkey as varchar) || '\",\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderstatus\":\"' || o_orderstatus || '\"}') as digest from orders")
def payload_digest(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("employee_id"), "o_orderstatus", "o_orderpriority")
    return orders.select("employee_id", R.payload_digest(["employee_id", "o_orderstatus", "o_orderpriority"]).alias("digest"))


def _attempts(spark, sf_dir):
    return A.view(spark, sf_dir, A.ATTEMPTS)


@_query(f"with {_ATT}, last as (select record_id, arg_max(status_code, attempt_number) as code, max(attempt_number) as n from attempts group by record_id), s as (select count(*) filter (code = 200) as pushed, count(*) filter (code not in (200, 429, 500, 502, 503, 504)) as rejected, count(*) filter (code in (429, 500, 502, 503, 504)) as unreachable, cast(sum(n - 1) as bigint) as retries from last) select *, round(coalesce(rejected / nullif(pushed + rejected, 0), 0), 6) as failure_rate, coalesce(rejected / nullif(pushed + rejected, 0), 0) > 0.1 as offer_rollback from s")
def push_summary(spark, sf_dir):
    return R.delivery_summary(_attempts(spark, sf_dir))


@_query(f"with {_ATT} select status_code, count(*) as n, count(distinct record_id) as records from attempts group by status_code")
def attempts_by_code(spark, sf_dir):
    return _attempts(spark, sf_dir).groupBy("status_code").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("records"))


@_query(f"with {_ATT} select distinct record_id from attempts where status_code = 200 and record_id not in (select record_id from attempts where status_code = 422)")
def rollback_antijoin(spark, sf_dir):
    tries = _attempts(spark, sf_dir)
    return tries.where("status_code = 200").select("record_id").distinct().join(tries.where("status_code = 422"), "record_id", "left_anti")


def _escalations(spark, sf_dir):
    return A.view(spark, sf_dir, A.ESCALATIONS).withColumn("signature", R.signature(F.col("reason_code"), F.col("scope_key")))


@_query(f"with {_ESC} select reason_code, sha256(reason_code || ':' || scope_key) as signature, min(id) as first_id, min(entity_id) as entity_id, count(*) as similar_count, cast(sum(affected_count) as bigint) as rows_affected from esc where status = 'open' group by 1, 2")
def queue_cards(spark, sf_dir):
    open_ = _escalations(spark, sf_dir).where("status = 'open'").groupBy("reason_code", "signature")
    return open_.agg(F.min("id").alias("first_id"), F.min("entity_id").alias("entity_id"), F.count("*").alias("similar_count"), F.sum("affected_count").alias("rows_affected"))


@_query(f"with {_ESC}, cards as (select reason_code, scope_key, count(*) as n, sum(affected_count) as rows_affected from esc where status = 'open' group by 1, 2) select reason_code, count(*) as questions, cast(sum(n) as bigint) as similar_count, cast(sum(rows_affected) as bigint) as rows_affected from cards group by 1")
def queue_by_code(spark, sf_dir):
    return queue_cards(spark, sf_dir).groupBy("reason_code").agg(F.count("*").alias("questions"), F.sum("similar_count").alias("similar_count"), F.sum("rows_affected").alias("rows_affected"))


@_query(f"with {_ESC} select count(distinct reason_code || scope_key) as questions from esc where status = 'open'")
def open_question_count(spark, sf_dir):
    return _escalations(spark, sf_dir).where("status = 'open'").agg(F.count_distinct("reason_code", "signature").alias("questions"))


@_query(f"with {_ESC} select reason_code, count(*) as escalations, count(distinct scope_key) as questions, cast(sum(affected_count) as bigint) as rows_affected from esc group by 1")
def compression_table(spark, sf_dir):
    return _escalations(spark, sf_dir).groupBy("reason_code").agg(F.count("*").alias("escalations"), F.count_distinct("signature").alias("questions"), F.sum("affected_count").alias("rows_affected"))


@_query(f"with {_ESC} select reason_code, sha256(reason_code || ':' || scope_key) as signature, max(created_at) as created_at from esc where status = 'resolved' group by 1, 2")
def decisions_latest(spark, sf_dir):
    done = _escalations(spark, sf_dir).where("status = 'resolved'").dropDuplicates(["reason_code", "signature", "created_at"])
    return R.latest_decisions(done).select("reason_code", "signature", "created_at")


@_query(f"with {_ESC} select id, reason_code, status from esc where reason_code = 'LOGIC_CONTRADICTION' and status = 'open' order by created_at, id limit 200")
def audit_filter(spark, sf_dir):
    found = _escalations(spark, sf_dir).where("reason_code = 'LOGIC_CONTRADICTION' and status = 'open'")
    return found.orderBy("created_at", "id").limit(200).select("id", "reason_code", "status")


@_query("select c_custkey, c_name from customer where lower(c_name) like '%0001%' or lower(c_mktsegment) like '%0001%' order by c_name limit 100")
def record_search(spark, sf_dir):
    hit = lambda c: F.lower(c).contains("0001")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").where(hit("c_name") | hit("c_mktsegment")).orderBy(F.asc_nulls_first("c_name")).limit(100).select("c_custkey", "c_name")


@_query(f"with {_ISSUES}, expected as (select 'EMP' || lpad(cast(c_custkey as varchar), 6, '0') as id from customer where c_custkey % 200 = 17), found as (select entity_id as id from issues where scope_key = 'record:R5') select (select count(*) from expected) as injected, (select count(*) from found) as detected, (select count(*) from expected join found using (id)) as hits, round((select count(*) from expected join found using (id)) / nullif((select count(*) from expected), 0), 4) as recall, round((select count(*) from expected join found using (id)) / nullif((select count(*) from found), 0), 4) as precision")
def scoring_recall(spark, sf_dir):
    raw = A.hris_records(spark, sf_dir)
    expected = raw.where("k % 200 = 17").select(F.col("employee_id").alias("id"), F.lit(1).alias("injected"))
    found = signature_hash(spark, sf_dir).where("scope_key = 'record:R5'").select(F.col("entity_id").alias("id"), F.lit(1).alias("detected"))
    both = expected.join(found, "id", "full").agg(F.count("injected").alias("injected"), F.count("detected").alias("detected"), F.count_if(F.col("injected").isNotNull() & F.col("detected").isNotNull()).alias("hits"))
    return both.select("*", F.round(F.try_divide("hits", "injected"), 4).alias("recall"), F.round(F.try_divide("hits", "detected"), 4).alias("precision"))


@_query("select event_type as kind, count(*) as n, max(event_id) as last_seq, cast(sum(cast(json_extract_string(props, '$.k') as bigint)) as bigint) as total from events group by 1")
def event_snapshot(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_seq"), F.sum(k).alias("total"))


@_query("select event_id as seq, event_type as kind from events where event_id > 500 order by event_id limit 500")
def event_tail(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id > 500").orderBy("event_id").limit(500).select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"))
