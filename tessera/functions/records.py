"""Cleaning, validating and filtering records of people."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits and patterns of the rules.
NAME_LENGTH, JOB_LENGTH, EMAIL_LENGTH, NOTES_LENGTH, MOST_SKILLS = 100, 100, 254, 1000, 10
LEAST_AGE, FUTURE_HIRE_DAYS, MOST_SALARY, MOST_EXPERIENCE = 18, 90, 10_000_000, 50
NAME = r"^\p{L}+(?:[ .'\-]\p{L}+)*\.?$"
EMAIL = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+$"
PHONE = r"^\+?[0-9][0-9 \-]*$"
TYPES = ("Full-time", "Part-time", "Contract", "Intern")


def collapsed(c: str) -> Column:
    """Trimmed, inner white space as single spaces, null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))


def cleaned(df: DataFrame) -> DataFrame:
    empty_to_null = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    return df.withColumns({
        "first_name": collapsed("first_name"), "last_name": collapsed("last_name"), "job_title": collapsed("job_title"),
        "email": F.lower(F.trim(F.coalesce("email", F.lit("")))), "phone": empty_to_null("phone"), "notes": empty_to_null("notes"),
        "skills": F.array_distinct(F.coalesce("skills", F.array().cast("array<string>"))),
    })


def whole_years(start: Column, end: Column) -> Column:
    """Age at `end`: a birthday on 29 February isn't reached on the 28th."""
    early = F.struct(F.month(end), F.dayofmonth(end)) < F.struct(F.month(start), F.dayofmonth(start))
    return F.year(end) - F.year(start) - early.cast("int")


def _name_problem(label: str, c: str) -> Column:
    return (
        F.when(F.col(c) == "", F.lit(f"{label} is required"))
        .when(F.char_length(c) > NAME_LENGTH, F.lit(f"{label} is too long"))
        .when(~F.col(c).rlike(NAME), F.lit(f"{label} has characters that no name has"))
    )


def problems(today: Column) -> Column:
    """array<string> of what is wrong with a cleaned record, in a fixed order."""
    missing = lambda c, text: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(text))
    digits = F.regexp_count("phone", F.lit("[0-9]"))
    return F.array_compact(F.array(
        _name_problem("first name", "first_name"), _name_problem("last name", "last_name"),
        F.when(F.col("job_title") == "", "job title is required").when(F.char_length("job_title") > JOB_LENGTH, "job title is too long"),
        F.when(F.col("email") == "", "email is required").when((F.char_length("email") > EMAIL_LENGTH) | ~F.col("email").rlike(EMAIL), "email is invalid"),
        F.when(F.col("phone").isNotNull() & (~F.col("phone").rlike(PHONE) | ~digits.between(7, 15)), "phone is invalid"),
        missing("gender", "gender is missing"), missing("department", "department is missing"), missing("employment_type", "employment type is missing"), missing("work_location", "work location is missing"),
        F.when(F.col("date_of_birth").isNull(), "date of birth is required"), F.when(F.col("hire_date").isNull(), "hire date is required"),
        F.when(F.col("hire_date") > F.date_add(today, FUTURE_HIRE_DAYS), "hire date is too late"),
        F.when(whole_years(F.col("date_of_birth"), F.col("hire_date")) < LEAST_AGE, "too young on the hire date"),
        F.when(F.col("salary").isNull() | (F.col("salary") <= 0) | (F.col("salary") > MOST_SALARY), "salary is out of range"),
        F.when(F.col("experience_years").isNull() | ~F.col("experience_years").between(0, MOST_EXPERIENCE), "experience is out of range"),
        F.when(F.size("skills") > MOST_SKILLS, "too many skills"), F.when(F.char_length("notes") > NOTES_LENGTH, "notes are too long"),
    ))


@dataclass
class Criteria:
    """What a filter asks for; a value left at its default asks for nothing."""

    search: str = ""
    one_of: dict[str, list[str]] = field(default_factory=dict)
    skills: list[str] = field(default_factory=list)
    active: bool | None = None
    remote_only: bool = False
    least: dict[str, object] = field(default_factory=dict)
    most: dict[str, object] = field(default_factory=dict)


def matching(df: DataFrame, want: Criteria) -> DataFrame:
    """The rows that meet all criteria; plain comparisons are pushed to the scan."""
    if text := want.search.strip().lower():
        # concat_ws skips nulls, so a missing part must still leave its space
        whole = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("first_name", "last_name", "email", "job_title")])
        df = df.filter(F.lower(whole).contains(text))
    for c, values in want.one_of.items():
        if values:
            df = df.filter(F.col(c).isin(values))
    if want.skills:
        df = df.filter(F.arrays_overlap("skills", F.array(*map(F.lit, want.skills))))
    if want.active is not None:
        df = df.filter(F.col("is_active") == F.lit(want.active))
    if want.remote_only:
        df = df.filter("is_remote")
    for c, v in want.least.items():
        df = df.filter(F.col(c) >= F.lit(v))
    for c, v in want.most.items():
        df = df.filter(F.col(c) <= F.lit(v))
    return df


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """Page `number` from 1 on; offset and limit of a top-k, so nothing is sorted as a whole."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
