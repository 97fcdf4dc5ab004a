"""Employee records derived from `customer`: cleaning, validation, filters, checks and changes."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.numbers import half_up
from tessera.functions.records import TYPES, Criteria, cleaned, matching, page, problems
from tessera.sources.tables import table

TODAY = "2025-06-30"
#: The same text for both engines, with planted mistakes by remainder.
_ROWS = """SELECT c_custkey + 1001 AS employee_id, CASE c_custkey % 23 WHEN 0 THEN '  Ann   Mary ' WHEN 1 THEN 'R2D2' WHEN 2 THEN '' ELSE concat('Name', chr(CAST(97 + c_custkey % 26 AS INT))) END AS first_name,
  CASE c_custkey % 29 WHEN 3 THEN NULL ELSE 'O''Neil-Smith' END AS last_name, CASE c_custkey % 31 WHEN 4 THEN 'nobody' WHEN 5 THEN NULL ELSE concat(' C', c_custkey, '@Mail.example.ORG ') END AS email,
  CASE c_custkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN '12-34' WHEN 2 THEN '+91 98765-43210' ELSE '020 555 0199' END AS phone, CASE c_custkey % 37 WHEN 6 THEN NULL ELSE 'F' END AS gender,
  CAST(DATE '1960-01-15' AS DATE) + CAST(c_custkey % 16000 AS INT) AS date_of_birth, c_mktsegment AS department, CASE c_custkey % 41 WHEN 7 THEN ' ' ELSE 'Data  Engineer' END AS job_title,
  CASE c_custkey % 5 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time' WHEN 2 THEN 'Contract' WHEN 3 THEN 'Intern' ELSE 'Temp' END AS employment_type, concat('L', c_nationkey) AS work_location,
  CAST(DATE '1999-05-01' AS DATE) + CAST((c_custkey * 13) % 9700 AS INT) AS hire_date, CAST(c_acctbal * 10 AS DECIMAL(12,2)) AS salary, CAST(c_custkey % 53 AS DECIMAL(4,1)) AS experience_years,
  c_custkey % 3 <> 0 AS is_active, c_custkey % 4 = 0 AS is_remote, CASE WHEN c_custkey % 11 = 0 THEN '  ' END AS notes"""
_SKILLS = "split(concat_ws(',', 'sql', concat('s', c_custkey % 6), concat('s', c_custkey % 4), 'sql'), ',') AS skills"
_DUCK = f"e AS ({_ROWS.replace('chr(CAST(97 + c_custkey % 26 AS INT))', 'chr(CAST(97 + c_custkey % 26 AS INT))')}, string_{_SKILLS} FROM customer)"


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(f"{_ROWS}, {_SKILLS} FROM customer")


def clean_records(spark, sf_dir):
    return cleaned(employees(spark, sf_dir)).select("employee_id", "first_name", "last_name", "email", "phone", "job_title", "notes", F.array_join("skills", "|").alias("skills"))


def record_problems(spark, sf_dir):
    e = cleaned(employees(spark, sf_dir)).withColumn("problems", problems(F.lit(TODAY).cast("date")))
    return e.select("employee_id", F.array_join("problems", "; ").alias("problems"), F.size("problems").cast("long").alias("n_problems"))


WANT = Criteria(search="mail.EXAMPLE", one_of={"employment_type": ["Contract", "Intern", "Full-time"], "department": ["BUILDING", "MACHINERY"]}, skills=["s1", "s2"], active=True, least={"experience_years": 2, "hire_date": datetime.date(2001, 1, 1)}, most={"salary": 80000})


def filtered(spark, sf_dir):
    return matching(employees(spark, sf_dir), WANT).select("employee_id", "department", "salary", "hire_date")


def no_filter(spark, sf_dir):
    return matching(employees(spark, sf_dir), Criteria()).select("employee_id")


def second_page(spark, sf_dir):
    return page(employees(spark, sf_dir).select("employee_id", "salary"), ["salary", "employee_id"], 2, 25)


def overview(spark, sf_dir):
    return employees(spark, sf_dir).agg(F.count("*").alias("employees"), F.count_if("is_active").alias("active"), F.count_if("is_remote").alias("remote"), F.countDistinct("department").alias("departments"), F.countDistinct("work_location").alias("locations"), F.min("salary").alias("min_salary"), F.max("salary").alias("max_salary"), F.min("hire_date").alias("first_hire"), F.max("hire_date").alias("last_hire"))


def checks(spark, sf_dir):
    """All checks in one pass, then turned into rows."""
    e = employees(spark, sf_dir)
    young = F.add_months("date_of_birth", 216) > F.col("hire_date")
    found = {
        "duplicate ids": F.count("*") - F.countDistinct("employee_id"), "duplicate e-mails": F.count("*") - F.countDistinct(F.lower("email")), "younger than 18 at hire": F.count_if(young),
        "salary not above zero": F.count_if(F.col("salary") <= 0), "experience outside 0-50": F.count_if(~F.col("experience_years").between(0, 50)), "unknown type": F.count_if(~F.col("employment_type").isin(*TYPES)), "over 10 skills": F.count_if(F.size("skills") > 10),
    }
    one = e.agg(*[c.alias(n) for n, c in found.items()])
    return one.unpivot([], list(found), "check_name", "issues")


def departments(spark, sf_dir):
    return employees(spark, sf_dir).groupBy("department").agg(F.count("*").alias("employees"), F.count_if("is_active").alias("active"), half_up(F.sum("salary").cast("double") / F.count("salary"), 0).alias("avg_salary"))


def dashboard(spark, sf_dir):
    """Of an empty selection: zeros, no nulls."""
    e = matching(employees(spark, sf_dir), Criteria(one_of={"department": ["NO SUCH"]}))
    return e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("is_active").cast("long")), F.lit(0).cast("long")).alias("active"), F.coalesce(F.avg(F.col("salary").cast("double")), F.lit(0.0)).alias("avg_salary"))


def recent(spark, sf_dir):
    return employees(spark, sf_dir).orderBy(F.desc("hire_date"), F.desc("employee_id")).limit(10).select("employee_id", "department", "hire_date")


def email_taken(spark, sf_dir):
    """Case-insensitive, another employee's own record left out."""
    return employees(spark, sf_dir).filter((F.lower(F.trim("email")) == "c17@mail.example.org") & (F.col("employee_id") != 5)).agg(F.count("*").alias("n"))


def update_row(spark, sf_dir):
    hit = F.col("employee_id") == 1042
    return employees(spark, sf_dir).select("employee_id", F.when(hit, F.lit(1).cast("decimal(12,2)")).otherwise(F.col("salary")).alias("salary"), hit.alias("changed"))


def insert_rows(spark, sf_dir):
    """New rows get the keys after the greatest; numbered per batch, so one task never numbers a whole table of new rows."""
    e = employees(spark, sf_dir).select("employee_id", "department")
    top = e.agg(F.max("employee_id").alias("top"))
    new = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.lit("NEW").alias("department"))
    ranks = new.join(F.broadcast(top)).select((F.col("top") + F.col("k") + 1).alias("employee_id"), "department")
    return e.unionByName(ranks)


def seed_once(spark, sf_dir):
    """Rows are inserted only into an empty table."""
    have = employees(spark, sf_dir).filter("department = 'NEW'").select("department").distinct()
    seed = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.lit("NEW").alias("department"))
    return seed.join(have, "department", "left_anti").select("k", "department")


_CLEAN = """c AS (SELECT * REPLACE (trim(regexp_replace(coalesce(first_name, ''), '\\s+', ' ', 'g')) AS first_name, trim(regexp_replace(coalesce(last_name, ''), '\\s+', ' ', 'g')) AS last_name, trim(regexp_replace(coalesce(job_title, ''), '\\s+', ' ', 'g')) AS job_title,
  lower(trim(coalesce(email, ''))) AS email, nullif(trim(phone), '') AS phone, nullif(trim(notes), '') AS notes) FROM e)"""
_YEARS = "year(hire_date) - year(date_of_birth) - CASE WHEN (month(hire_date), day(hire_date)) < (month(date_of_birth), day(date_of_birth)) THEN 1 ELSE 0 END"
_NAME_SQL = lambda label, c: f"CASE WHEN {c} = '' THEN '{label} is required' WHEN length({c}) > 100 THEN '{label} is too long' WHEN NOT regexp_matches({c}, '^\\p{{L}}+(?:[ .''\\-]\\p{{L}}+)*\\.?$') THEN '{label} has characters that no name has' END"
_PROBLEMS = f"""p AS (SELECT employee_id, list_filter([{_NAME_SQL('first name', 'first_name')}, {_NAME_SQL('last name', 'last_name')}, CASE WHEN job_title = '' THEN 'job title is required' END,
  CASE WHEN email = '' THEN 'email is required' WHEN NOT regexp_matches(email, '^[A-Za-z0-9._%+\\-]+@[A-Za-z0-9\\-]+(?:\\.[A-Za-z0-9\\-]+)+$') THEN 'email is invalid' END,
  CASE WHEN phone IS NOT NULL AND (NOT regexp_matches(phone, '^\\+?[0-9][0-9 \\-]*$') OR len(regexp_extract_all(phone, '[0-9]')) NOT BETWEEN 7 AND 15) THEN 'phone is invalid' END,
  CASE WHEN gender IS NULL THEN 'gender is missing' END, CASE WHEN {_YEARS} < 18 THEN 'too young on the hire date' END, CASE WHEN hire_date > DATE '{TODAY}' + 90 THEN 'hire date is too late' END,
  CASE WHEN salary IS NULL OR salary <= 0 OR salary > 10000000 THEN 'salary is out of range' END, CASE WHEN experience_years NOT BETWEEN 0 AND 50 THEN 'experience is out of range' END], lambda x: x IS NOT NULL) AS problems FROM c)"""
_PROBLEMS = _PROBLEMS.replace(f"CASE WHEN {_YEARS} < 18 THEN 'too young on the hire date' END, CASE WHEN hire_date > DATE '{TODAY}' + 90 THEN 'hire date is too late' END", f"CASE WHEN hire_date > DATE '{TODAY}' + 90 THEN 'hire date is too late' END, CASE WHEN {_YEARS} < 18 THEN 'too young on the hire date' END")

_ALL = (clean_records, record_problems, filtered, no_filter, second_page, overview, checks, departments, dashboard, recent, email_taken, update_row, insert_rows, seed_once)
QUERIES = {f"a8_{f.__name__}": f for f in _ALL}
ORACLE = {f"a8_{k}": f"WITH {_DUCK} {v}" if not v.startswith(",") else f"WITH {_DUCK}{v}" for k, v in {
    "clean_records": f", {_CLEAN} SELECT employee_id, first_name, last_name, email, phone, job_title, notes, array_to_string(list_filter(skills, lambda x, i: list_position(skills, x) = i), '|') AS skills FROM c",
    "record_problems": f", {_CLEAN}, {_PROBLEMS} SELECT employee_id, array_to_string(problems, '; ') AS problems, len(problems) AS n_problems FROM p",
    "filtered": "SELECT employee_id, department, salary, hire_date FROM e WHERE contains(lower(concat(coalesce(first_name, ''), ' ', coalesce(last_name, ''), ' ', coalesce(email, ''), ' ', coalesce(job_title, ''))), 'mail.example') AND employment_type IN ('Contract', 'Intern', 'Full-time') AND department IN ('BUILDING', 'MACHINERY') AND list_has_any(skills, ['s1', 's2']) AND is_active AND experience_years >= 2 AND hire_date >= DATE '2001-01-01' AND salary <= 80000",
    "no_filter": "SELECT employee_id FROM e",
    "second_page": "SELECT employee_id, salary FROM e ORDER BY salary, employee_id LIMIT 25 OFFSET 25",
    "overview": "SELECT count(*) AS employees, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_remote) AS remote, count(DISTINCT department) AS departments, count(DISTINCT work_location) AS locations, min(salary) AS min_salary, max(salary) AS max_salary, min(hire_date) AS first_hire, max(hire_date) AS last_hire FROM e",
    "checks": "SELECT 'duplicate ids' AS check_name, count(*) - count(DISTINCT employee_id) AS issues FROM e UNION ALL SELECT 'duplicate e-mails', count(*) - count(DISTINCT lower(email)) FROM e UNION ALL SELECT 'younger than 18 at hire', count(*) FILTER (WHERE date_of_birth + INTERVAL 18 YEAR > hire_date) FROM e UNION ALL SELECT 'salary not above zero', count(*) FILTER (WHERE salary <= 0) FROM e UNION ALL SELECT 'experience outside 0-50', count(*) FILTER (WHERE experience_years < 0 OR experience_years > 50) FROM e UNION ALL SELECT 'unknown type', count(*) FILTER (WHERE employment_type NOT IN ('Full-time', 'Part-time', 'Contract', 'Intern')) FROM e UNION ALL SELECT 'over 10 skills', count(*) FILTER (WHERE len(skills) > 10) FROM e",
    "departments": "SELECT department, count(*) AS employees, count(*) FILTER (WHERE is_active) AS active, CAST(round(CAST(CAST(sum(salary) AS DOUBLE) / count(salary) AS DECIMAL(38,10)), 0) AS DECIMAL(28,0)) AS avg_salary FROM e GROUP BY department",
    "dashboard": "SELECT count(*) AS n, coalesce(CAST(sum(CAST(is_active AS BIGINT)) AS BIGINT), 0) AS active, coalesce(avg(CAST(salary AS DOUBLE)), 0.0::DOUBLE) AS avg_salary FROM e WHERE department = 'NO SUCH'",
    "recent": "SELECT employee_id, department, hire_date FROM e ORDER BY hire_date DESC, employee_id DESC LIMIT 10",
    "email_taken": "SELECT count(*) AS n FROM e WHERE lower(trim(email)) = 'c17@mail.example.org' AND employee_id <> 5",
    "update_row": "SELECT employee_id, CASE WHEN employee_id = 1042 THEN CAST(1 AS DECIMAL(12,2)) ELSE salary END AS salary, employee_id = 1042 AS changed FROM e",
    "insert_rows": "SELECT employee_id, department FROM e UNION ALL SELECT (SELECT max(employee_id) FROM e) + n_nationkey + 1, 'NEW' FROM nation",
    "seed_once": "SELECT CAST(r_regionkey AS BIGINT) AS k, 'NEW' AS department FROM region WHERE NOT EXISTS (SELECT 1 FROM e WHERE department = 'NEW')",
}.items()}
