"""Loading study programs with their entrance subjects, and editing pass marks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.functions import text
from edurank.plans.change import ChangePlan
from edurank.plans.materialize import materialize
from edurank.plans.ordered import forward_fill
from edurank.sources.cells import SHEET, body_rows, level_text
from edurank.sources.seeds import INSTITUTES, institute_seed, seeded, subject_seed
from edurank.sources.store import Tables, assign_ids, conform, insert_absent, upsert, upsert_with_ids

# Headings every program sheet has in its first row.
HEADINGS = {
    "institute": "Институт",
    "code": "Код",
    "name": "Направление подготовки",
    "exam1": "Вступительное испытание 1",
    "exam2": "Вступительное испытание 2 (на выбор)",
    "exam3": "Вступительное испытание 3",
}
REQUIRED, CHOICE = ("required", 1), ("choice", 2)


def program_layout(cells: DataFrame) -> DataFrame:
    """Column of every heading per sheet; null where it is missing."""
    heading = level_text(F.col("value"))
    return (
        cells.where("row_idx = 0")
        .groupBy(*SHEET)
        .agg(
            *(
                F.max(F.when(heading == title.lower(), F.col("col_idx"))).alias(f"{name}_col")
                for name, title in HEADINGS.items()
            ),
            F.lit(1).alias("first_row"),
        )
    )


def missing_columns(cells: DataFrame) -> DataFrame:
    """(file, sheet, heading) of required headings a sheet does not have."""
    names = ", ".join(f"if({name}_col is null, '{title}', null)" for name, title in HEADINGS.items())
    return program_layout(cells).selectExpr(*SHEET, f"explode(array_compact(array({names}))) as heading")


def program_blocks(cells: DataFrame) -> DataFrame:
    """Program rows with the row that starts their block: the last one above that has a code."""
    roles = {name: f"{name}_col" for name in HEADINGS}
    rows = body_rows(cells, program_layout(cells), roles)
    clean = rows.select(
        *SHEET, "row_idx", *(F.nullif(text.squeeze(F.col(name)), F.lit("")).alias(name) for name in HEADINGS)
    ).withColumn("block", F.expr("if(code is not null, row_idx, null)"))
    return forward_fill(clean, SHEET, "row_idx", ["block"]).where("block is not null")


def choice_subjects(blocks: DataFrame) -> DataFrame:
    """Subjects to choose from per block: no "или" rows, each once in the spelling that comes first."""
    rows = blocks.where("exam2 is not null and lower(exam2) <> 'или'")
    return (
        rows.groupBy(*SHEET, "block", text.upper_key(F.col("exam2")).alias("_key"))
        .agg(F.expr("min_by(exam2, row_idx) as subject"))
        .drop("_key")
    )


def merge_requirements(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One role per program and subject: required beats choice, else the larger weight."""
    required = "bool_or(role = 'required')"
    return rows.groupBy(*keys).agg(
        F.expr(f"if({required}, 'required', 'choice') as role"),
        F.expr(f"if({required}, 1, max(weight)) as weight"),
    )


def program_requirement_rows(blocks: DataFrame) -> DataFrame:
    """(code, subject, role, weight) as the sheets say, with canonical subject names."""
    starts = blocks.where("row_idx = block")
    parts = []
    for column, (role, weight) in (("exam1", REQUIRED), ("exam3", REQUIRED)):
        parts.append(
            starts.where(f"{column} is not null").selectExpr(
                "code", f"{column} as subject", f"'{role}' as role", f"{weight} as weight"
            )
        )
    role, weight = CHOICE
    chosen = choice_subjects(blocks).join(starts.select(*SHEET, "block", "code"), [*SHEET, "block"])
    parts.append(chosen.selectExpr("code", "subject", f"'{role}' as role", f"{weight} as weight"))
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.withColumn("subject", text.program_subject(F.col("subject")))


def _stop_if_any(problems: DataFrame, message: str):
    """Raise with a few examples; the check looks at no more than those."""
    found = [", ".join(str(v) for v in row) for row in problems.limit(20).collect()]
    if found:
        raise ValueError(f"{message}: {'; '.join(found)}")


def load_programs(tables: Tables, cells: DataFrame, create_missing: bool = False) -> ChangePlan:
    """Plan that stores programs and requirements; dictionaries are seeded first.

    Stops on missing headings, blocks without institute, unknown institutes and
    (unless ``create_missing``) unknown subjects.
    """
    _stop_if_any(missing_columns(cells), "missing columns")
    blocks = materialize(program_blocks(cells))
    starts = blocks.where("row_idx = block")
    _stop_if_any(starts.where("institute is null").select(*SHEET, "row_idx"), "no institute in row")

    institutes = materialize(seeded(tables, "institute", institute_seed(tables.spark), "institute_id"))
    subjects = seeded(tables, "ege_subject", subject_seed(tables.spark), "subject_id")
    requirements = materialize(program_requirement_rows(blocks))
    missing = requirements.selectExpr("subject as name").distinct().join(subjects, "name", "left_anti")
    if create_missing:
        fresh = insert_absent(subjects, missing, ["name"])
        subjects = subjects.unionByName(conform(assign_ids(fresh, subjects, "subject_id", ["name"]), "ege_subject"))
    else:
        _stop_if_any(missing, "unknown subjects")
    subjects = materialize(subjects)

    named = starts.withColumn(
        "institute", text.canonical_by_key(F.col("institute"), INSTITUTES, text.INSTITUTE_ALIASES)
    ).withColumn("_key", text.upper_key(F.col("institute")))
    by_name = institutes.selectExpr("name as institute", "institute_id as _by_name")
    by_key = (
        institutes.withColumn("_key", text.upper_key(F.col("name")))
        .groupBy("_key")
        .agg(F.expr("min(institute_id) as _by_key"))
    )
    programs = (
        named.join(by_name, "institute", "left")
        .join(by_key, "_key", "left")
        .selectExpr("*", "coalesce(_by_name, _by_key) as institute_id")
    )
    _stop_if_any(programs.where("institute_id is null").select("institute").distinct(), "unknown institutes")
    first = programs.groupBy("code").agg(
        F.expr("min_by(struct(institute_id, coalesce(name, '') as name), struct(file, sheet, row_idx)) as _first")
    )
    rows = first.selectExpr("_first.institute_id", "code", "_first.name", "true as is_active")
    stored = materialize(
        upsert_with_ids("study_program", tables, rows, ["code"], ["institute_id", "name", "is_active"])
    )
    merged = merge_requirements(
        requirements.join(stored.select("code", "program_id"), "code").join(
            subjects.selectExpr("subject_id", "name as subject"), "subject"
        ),
        ["program_id", "subject_id"],
    )
    return ChangePlan(
        {
            "institute": institutes,
            "ege_subject": subjects,
            "study_program": stored,
            "program_ege_requirement": upsert_with_ids(
                "program_ege_requirement", tables, merged, ["program_id", "subject_id"], ["role", "weight"]
            ),
        },
        {"programs": programs.select("institute", "code", "name"), "requirements": merged},
        base=tables.version,
    )


def check_min_scores(scores: DataFrame) -> DataFrame:
    """Errors of pass mark input (subject_id, name, score as text)."""
    return scores.selectExpr(
        "subject_id",
        "name",
        "case when trim(coalesce(score, '')) = '' then 'empty' "
        "when not (trim(score) rlike '^[+-]?[0-9]+$') then 'not a number' "
        "when try_cast(trim(score) as int) between 0 and 100 then null else 'not in 0..100' end as error",
    ).where("error is not null")


def update_min_scores(tables: Tables, scores: DataFrame) -> ChangePlan:
    """Plan that sets pass marks: by id (renaming too), else by name, else as a new subject.

    Nothing changes when any row is invalid.
    """
    errors = check_min_scores(scores)
    current = tables["ege_subject"]
    if not errors.isEmpty():
        return ChangePlan({}, {"errors": errors}, base=tables.version)
    wanted = scores.selectExpr(
        "cast(subject_id as bigint) as subject_id",
        "name",
        "cast(trim(score) as decimal(3,0)) as min_passing_score",
    )
    by_id = wanted.join(current.select("subject_id"), "subject_id", "left_semi")
    others = wanted.join(current.select("subject_id"), "subject_id", "left_anti")
    by_name = others.drop("subject_id").join(current.select("subject_id", "name"), "name")
    new = others.join(current.select("name"), "name", "left_anti")
    changes = by_id.unionByName(by_name).unionByName(new)
    updated = upsert(current, changes, ["subject_id"], ["name", "min_passing_score"])
    counts = by_id.selectExpr("'updated' as action").unionByName(
        by_name.selectExpr("'updated_by_name' as action")
    ).unionByName(new.selectExpr("'inserted' as action"))
    return ChangePlan(
        {"ege_subject": conform(updated, "ege_subject")}, {"errors": errors, "actions": counts.groupBy("action").count()},
        base=tables.version,
    )
