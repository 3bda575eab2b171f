"""Views of the driver's tables as record exports, with anomalies by key; one SQL text for Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FIRST = "asha,ravi,meera,john,priya,arjun,neha,omar,lena,kiran,sara"
_LAST = "sharma,iyer,patel,smith,reddy,khan,gupta,jones,nair,bose,rao,lopez,mehta"


def _pick(names: str, by: str) -> str:
    return f"split_part('{names}', ',', cast(({by}) % {names.count(',') + 1} as int) + 1)"


def _dmy(d: str, sep: str = "-") -> str:
    return f"lpad(cast(day({d}) as string), 2, '0') || '{sep}' || lpad(cast(month({d}) as string), 2, '0') || '{sep}' || cast(year({d}) as string)"


def hris(serial: str = "datediff({d}, date '1899-12-30')") -> str:
    """The HR export. serial: how the dialect counts days since the spreadsheet's day zero."""
    born = serial.format(d="born")
    return f"""
select k, 'EMP' || lpad(cast(k as string), 6, '0') as employee_id,
  case when k % 20 = 1 then '  ' || first || '  ' else first end as first_name, last as last_name,
  first || '.' || last || cast(k as string) || '@Example.com' as work_email,
  case when k % 4 = 0 then '+91 ' when k % 4 = 1 then '0' when k % 4 = 2 then '' else '+91-' end || cast(6000000000 + k * 7919 as string) as phone,
  case when k % 50 = 9 then '' when k % 67 = 5 then cast({born} as string)
    when k % 101 = 7 then cast(cast({born} - 25569 as bigint) * 86400 as string)
    when k % 50 = 3 then {_dmy('born', '/')} else {_dmy('born')} end as date_of_birth,
  case when k % 40 = 6 then {_dmy('hired', '/')} else {_dmy('hired')} end as hire_date,
  case when k % 97 = 5 then 'unknown' when k % 40 = 7 then 'Activ' when k % 12 = 0 then 'terminated' when k % 12 = 1 then 'On_Leave' else 'active' end as employment_status,
  case when k % 12 = 0 and k % 100 <> 12 then {_dmy('ended')} when k % 200 = 11 then {_dmy('early')} else '' end as termination_date,
  case when k % 200 = 17 then 'EMP' || lpad(cast(k as string), 6, '0') when k % 100 = 19 then 'EMP9' || lpad(cast(k as string), 5, '0')
    else 'EMP' || lpad(cast(k % 50 as string), 6, '0') end as manager_employee_id,
  case when k % 33 = 2 then dept || 'x' else dept end as department,
  case when k % 10 < 3 then 'USD ' else '₹ ' end || cast(1000 + k * 13 as string) as annual_ctc
from (
  select c_custkey as k, {_pick(_FIRST, 'c_custkey')} as first, {_pick(_LAST, 'c_custkey * 5 + 3')} as last, c_mktsegment as dept,
    date '1960-01-01' + cast(c_custkey * 37 % 9000 as int) as born, date '2005-01-01' + cast(c_custkey * 53 % 6000 as int) as hired,
    date '2005-01-01' + cast(c_custkey * 53 % 6000 + c_custkey * 11 % 2000 as int) as ended, date '2005-01-01' + cast(c_custkey * 53 % 6000 as int) + cast(-100 as int) as early
  from customer) t"""


RECORDS = """
select cast(k as bigint) * 3 as id, 'legacy_hris_employees.csv' as filename, employee_id, trim(first_name) as first_name, last_name, lower(work_email) as work_email,
  '' as phone, '' as date_of_birth, department from hris
union all
select cast(k as bigint) * 3 + 1, 'payroll_dump.csv', employee_id, '', '', lower(work_email), '', '', case when k % 20 = 4 then 'OTHER' else department end from hris where k % 25 <> 0
union all
select cast(k as bigint) * 3 + 2, 'crm_contacts_export.xlsx', '', trim(first_name), last_name,
  case when k % 40 = 6 then 'x' || lower(work_email) else lower(work_email) end, '', '', department from hris where k % 10 < 7"""

ATTEMPTS = """
select user_id as record_id, cast(row_number() over (partition by user_id order by event_id) as int) as attempt_number,
  case when event_type = 'error' and event_id % 3 = 0 then 422 when event_type = 'error' then 500 else 200 end as status_code from events"""

ESCALATIONS = """
select o_orderkey as id, case o_orderstatus when 'F' then 'VALUE_LOW_CONFIDENCE' when 'O' then 'DATE_FORMAT_AMBIGUOUS' else 'LOGIC_CONTRADICTION' end as reason_code,
  o_orderpriority as scope_key, o_custkey as entity_id, cast(1 + o_orderkey % 4 as bigint) as affected_count,
  case when o_orderkey % 7 = 0 then 'resolved' else 'open' end as status, o_orderdate as created_at from orders"""


def view(spark: SparkSession, sf_dir: str, sql: str, **views: DataFrame) -> DataFrame:
    """The SQL over the driver's tables and the given frames, by the name that it uses."""
    import re

    frames = dict(views)
    for name in ("customer", "orders", "events", "part", "supplier"):
        if re.search(rf"\bfrom {name}\b", sql):
            frames[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for name in frames:
        sql = re.sub(rf"\bfrom {name}\b", f"from {{{name}}}", sql)
    return spark.sql(sql, **frames)


def hris_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, hris())


def source_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RECORDS, hris=hris_records(spark, sf_dir))
