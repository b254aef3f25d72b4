"""Run log: saving searches and ratings, history, reports and run exports.

Every ``save_*`` returns a :class:`~edurank.plans.change.ChangePlan`; nothing is
written before the plan is applied to a store.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edurank.functions.numeric import round_even, to_number_5_2, to_number_10_6
from edurank.operators.schools import with_place
from edurank.plans.change import ChangePlan
from edurank.plans.materialize import materialize
from edurank.plans.params import (
    Page,
    RatingFilters,
    RatingWeights,
    SchoolFilters,
    bounded,
    guess_year_basis,
)
from edurank.plans.texts import REF, ByReference, attach_texts, by_reference
from edurank.sources.schema import FILTER_COLUMNS, PRIMARY_KEYS, struct_type
from edurank.sources.store import CommitConflict, Tables, TableStore, assign_ids, conform, upsert

# Metric catalog (code, name, category, unit, description) and run labels.
METRICS = (
    (
        "avg_graduates",
        "Среднее число выпускников",
        "ege",
        "чел",
        "Среднее число выпускников по доступным периодам ЕГЭ",
    ),
    (
        "avg_score_all",
        "Средний балл ЕГЭ",
        "ege",
        "балл",
        "Средний балл ЕГЭ (по всем или релевантным предметам, в зависимости от фильтров)",
    ),
    (
        "match_share",
        "Потенциальные абитуриенты (норм.)",
        "ege",
        "доля",
        "Нормированное среднее количество потенциальных абитуриентов по выбранным программам",
    ),
    (
        "threshold_share",
        "Прохождение порогов ЕГЭ",
        "ege",
        "доля",
        "Доля предметных порогов, выполняемых школой",
    ),
)
METRIC_CODES = tuple(m[0] for m in METRICS)
SEARCH_REQUEST_NAME = "Поиск школ"
RATING_REQUEST_NAME = "Подбор и рейтинг школ"
RATING_RUN_NAME = "Рейтинг школ"
REPORT_TYPES_ON_REQUEST = ("standard", "detailed")
REPORT_FORMATS_ON_REQUEST = ("json", "pdf", "xlsx")
LAST_RANK = 2147483647


@dataclass(frozen=True)
class SavedRun:
    request_id: int
    run_id: int | None
    plan: ChangePlan
    # The new cards without the names of programs, and these names.
    cards: ByReference | None = None


# --- pieces of a saved request ---------------------------------------------------------------


def metric_weights(weights: RatingWeights) -> dict[str, float]:
    """Normalised weights by metric code (the weights as asked, match part included)."""
    w = weights.normalized()
    return dict(zip(METRIC_CODES, (w.graduates, w.avg_score, w.match_share, w.threshold_share), strict=True))


def run_metric_rows(weights: RatingWeights) -> list[tuple[str, int, bool]]:
    """(metric, weight on the 1..10 scale, is it the heaviest one)."""
    shares = metric_weights(weights)
    heaviest = max(METRIC_CODES, key=shares.__getitem__)
    return [(code, bounded(round(share * 10), 1, 10), code == heaviest) for code, share in shares.items()]


def filter_rows(filters: SchoolFilters) -> list[dict]:
    """One typed row per filter value, without repeats."""
    rows: list[dict] = []

    def add(kind: str, value, **extra):
        row = {"filter_type": kind, FILTER_COLUMNS[kind]: value, **extra}
        if value is not None and row not in rows:
            rows.append(row)

    add("region", filters.region_id)
    add("municipality", filters.municipality_id)
    for value in filters.profile_ids:
        add("school_profile", value)
    min_avg = getattr(filters, "min_avg_score", None)
    min_score = None if min_avg is None else bounded(int(min_avg), 0, 100)
    for value in filters.subject_ids:
        add("subject", value, min_score=min_score)
    for value in getattr(filters, "institute_ids", ()):
        add("institute", value)
    for value in getattr(filters, "program_ids", ()):
        add("program", value)
    return rows


def compact_json(payload: dict) -> str:
    return json.dumps(payload, ensure_ascii=False, separators=(",", ":"))


def _typed(tables: Tables, table: str, rows: list[dict]) -> DataFrame:
    names = struct_type(table).fieldNames()
    return tables.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], struct_type(table))


def _next(tables: Tables, table: str, key: str) -> int:
    return (tables[table].agg(F.max(key)).first()[0] or 0) + 1


def _new_filters(tables: Tables, request_id: int, filters: SchoolFilters) -> DataFrame:
    first = _next(tables, "analytics_request_filter", "filter_id")
    rows = [
        {"filter_id": first + i, "request_id": request_id, **row} for i, row in enumerate(filter_rows(filters))
    ]
    return _typed(tables, "analytics_request_filter", rows)


def _conformed(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {table: conform(df, table) for table, df in rows.items()}


def _author(name: str | None) -> str | None:
    return (name or "").strip() or None


def _numbered(added: dict[str, DataFrame]) -> tuple[str, ...]:
    """Tables among ``added`` whose rows carry a key of their own."""
    return tuple(t for t in added if len(PRIMARY_KEYS[t]) == 1)


def save_on_newest(store: TableStore, make: Callable[[Tables], SavedRun | None], attempts: int = 20) -> SavedRun | None:
    """Save what ``make`` plans on the newest tables; it plans again when others took its keys meanwhile."""
    for left in reversed(range(attempts)):
        saved = make(store.load())
        try:
            if saved is not None:
                saved.plan.apply(store)
            return saved
        except CommitConflict:
            if not left:
                raise
    raise ValueError("at least one attempt is needed")


# --- saving ----------------------------------------------------------------------------------


def save_search(
    tables: Tables,
    filters: SchoolFilters,
    rows: DataFrame,
    total: int,
    page: Page,
    created_by: str | None = None,
    now: datetime | None = None,
) -> SavedRun | None:
    """Log a search with the schools it showed (``rows``: one page of results)."""
    if total <= 0 and rows.isEmpty():
        return None
    now = now or datetime.now(timezone.utc)
    first = rows.where("last_year is not null").orderBy("full_name", "school_id").select("last_year").first()
    request_id = _next(tables, "analytics_request", "request_id")
    request = {
        "request_id": request_id,
        "created_at": now,
        "created_by": _author(created_by),
        "request_name": SEARCH_REQUEST_NAME,
        "scenario": "search",
        "year_basis": guess_year_basis(filters.year, first and first[0]),
        "only_active": False,
        "notes": compact_json(
            {
                "query": filters.q.strip(),
                "kind": filters.kind,
                "year": filters.year,
                "page": page.number,
                "per_page": page.size,
                "total_rows": total,
            }
        ),
    }
    selection = (
        rows.where("school_id is not null")
        .selectExpr("school_id", "cast(avg_score as double) as _score")
        .selectExpr("school_id", f"{to_number_5_2('_score')} as match_score")
        .withColumns({"request_id": F.lit(request_id), "selected_at": F.lit(now)})
    )
    added = {
        "analytics_request": _typed(tables, "analytics_request", [request]),
        "analytics_request_filter": _new_filters(tables, request_id, filters),
        # the request is new, so none of its schools is stored yet
        "analytics_school_selection": selection.dropDuplicates(["school_id"]),
    }
    return SavedRun(request_id, None, ChangePlan({}, appended=_conformed(added), base=tables.version, numbered=_numbered(added)))


def metric_value_rows(ranked: DataFrame, weights: RatingWeights, has_scope: bool) -> DataFrame:
    """Four (raw, norm, weighted) rows per ranked school."""
    shares = metric_weights(weights)
    score = "coalesce(avg_score_for_rating, avg_score_all, 0D)" if has_scope else "coalesce(avg_score_all, 0D)"
    raw_norm = {
        "avg_graduates": ("coalesce(avg_graduates, 0D)", "coalesce(norm_graduates, 0D)"),
        "avg_score_all": (score, "coalesce(norm_avg_score, 0D)"),
        "match_share": ("coalesce(match_share, 0D)", "coalesce(match_share, 0D)"),
        "threshold_share": ("coalesce(threshold_share, 0D)", "coalesce(threshold_share, 0D)"),
    }
    items = ", ".join(
        f"struct('{code}' as metric_code, {raw} as raw, {norm} as norm, {norm} * {shares[code]!r}D as weighted)"
        for code, (raw, norm) in raw_norm.items()
    )
    return (
        ranked.selectExpr("school_id", f"inline(array({items}))")
        .selectExpr(
            "school_id",
            "metric_code",
            f"{to_number_5_2('raw')} as raw_value",
            f"{to_number_10_6('norm')} as norm_value",
            f"{to_number_10_6('weighted')} as weighted_value",
        )
    )


def card_documents(ranked: DataFrame, has_scope: bool, *kept: str) -> DataFrame:
    """The five documents of a saved school card, beside the columns ``kept``."""
    metric = "_for_rating" if has_scope else "_all"
    numbers = ranked.selectExpr(
        "*",
        "coalesce(avg_graduates, 0D) as _graduates",
        "coalesce(avg_score_all, 0D) as _all",
        "coalesce(avg_score_for_rating, avg_score_all, 0D) as _for_rating",
    )
    return numbers.selectExpr(
        "school_id",
        *kept,
        "struct(school_id, full_name, region_name, municipality_name, profile_names) as school_info",
        f"struct({to_number_5_2('_graduates')} as avg_graduates, {to_number_5_2('_all')} as avg_score_all, "
        f"{to_number_5_2('_for_rating')} as avg_score_for_rating, {to_number_5_2(metric)} as avg_score_metric, "
        "cast(ege_years as int) as ege_years, cast(last_year as int) as last_year) as ege_summary",
        "cast(map() as map<string, string>) as admission_summary",
        "cast(map() as map<string, string>) as prof_summary",
        f"struct({to_number_10_6('rating_score')} as rating_score, cast(programs_total as int) as programs_total, "
        f"cast(programs_matched as int) as programs_matched, {to_number_10_6('match_share')} as match_share, "
        f"{to_number_10_6('threshold_share')} as threshold_share, "
        "coalesce(matched_programs, '') as matched_programs) as conclusions",
    )


def save_rating(
    tables: Tables,
    filters: RatingFilters,
    weights: RatingWeights,
    ranked: DataFrame | ByReference,
    created_by: str | None = None,
    now: datetime | None = None,
) -> SavedRun | None:
    """Log a rating (``ranked``: the result of ``rate_schools`` or ``rate_by_reference``) in ten tables.

    All but the metric catalog only grow: request and run are new, so none of
    their rows can be stored yet.  ``clamped`` counts figures beyond the stored width.
    """
    kept = "school_id is not null and rank_pos is not null"
    if not isinstance(ranked, ByReference):
        ranked = by_reference(ranked.where(kept), "matched_programs", ["school_id"])
    names = ranked.texts
    ranked = materialize(ranked.rows.where(kept).drop("matched_programs"))
    if ranked.isEmpty():
        return None
    now = now or datetime.now(timezone.utc)
    first = ranked.where("last_year is not null").orderBy("rank_pos").select("last_year").first()
    year_basis = guess_year_basis(filters.year, first and first[0])
    request_id = _next(tables, "analytics_request", "request_id")
    run_id = _next(tables, "analytics_rating_run", "run_id")
    author, has_scope = _author(created_by), filters.has_scope
    notes = compact_json(
        {
            "query": filters.q.strip(),
            "kind": filters.kind,
            "year": filters.year,
            "enforce_subject_threshold": bool(filters.enforce_subject_threshold),
            "weights": {code: round(share, 6) for code, share in metric_weights(weights).items()},
            "limit": filters.limit,
        }
    )
    request = {
        "request_id": request_id,
        "created_at": now,
        "created_by": author,
        "request_name": RATING_REQUEST_NAME,
        "scenario": "selection",
        "year_basis": year_basis,
        "only_active": False,
        "min_students": bounded(filters.min_graduates, 0),
        "notes": notes,
    }
    run = {
        "run_id": run_id,
        "request_id": request_id,
        "calculated_at": now,
        "calculated_by": author,
        "run_name": RATING_RUN_NAME,
        "stage": "final",
        "algorithm_version": "v1",
        "normalization": "minmax",  # label of the model; the formula is value / max
        "comment": notes,
    }
    metrics = [
        dict(zip(struct_type("analytics_metric").fieldNames(), (*m, True), strict=True)) for m in METRICS
    ]
    run_metrics = [
        {"run_id": run_id, "metric_code": code, "weight": weight, "is_primary": primary}
        for code, weight, primary in run_metric_rows(weights)
    ]
    stamped = {"run_id": F.lit(run_id)}
    score = "coalesce(avg_score_for_rating, avg_score_all, 0D)" if has_scope else "coalesce(avg_score_all, 0D)"
    base = ranked.selectExpr("*", "rating_score * 100D as _percent", f"{score} as _score")
    selection = base.selectExpr("school_id", f"{to_number_5_2('_percent')} as match_score").withColumns(
        {"request_id": F.lit(request_id), "selected_at": F.lit(now)}
    )
    ratings = base.selectExpr(
        "school_id",
        "cast(rank_pos as int) as rank_pos",
        f"cast({round_even('rating_score', 6)} as decimal(12,6)) as total_score",
        f"{year_basis} as year_basis",
        "cast(rint(coalesce(avg_graduates, 0D)) as int) as students_cnt",
        f"{to_number_5_2('_score')} as ege_avg_all",
    ).withColumns(stamped)
    members = ranked.select("school_id").withColumns({**stamped, "selected_at": F.lit(now)})
    values = metric_value_rows(ranked, weights, has_scope).withColumns(stamped)
    numbered = assign_ids(ranked.withColumns(stamped), tables["analytics_school_card"], "card_id", ["run_id", "school_id"])
    named = attach_texts(numbered, names, REF).withColumnRenamed("_text", "matched_programs")
    cards = card_documents(named, has_scope, "run_id", "card_id").withColumn("generated_at", F.lit(now))
    unnamed = ranked.withColumns({**stamped, "matched_programs": F.lit(None).cast("string")})
    short_cards = card_documents(unnamed, has_scope, "run_id", REF)

    # The catalog is written only when it does not hold these metrics yet: two ratings need not conflict over it.
    wanted = conform(_typed(tables, "analytics_metric", metrics), "analytics_metric")
    others = [c for c in wanted.columns if c != "metric_code"]
    changed = {}
    if not wanted.exceptAll(tables["analytics_metric"]).isEmpty():
        changed["analytics_metric"] = upsert(tables["analytics_metric"], wanted, ["metric_code"], others)
    added = {
        "analytics_request": _typed(tables, "analytics_request", [request]),
        "analytics_request_filter": _new_filters(tables, request_id, filters),
        "analytics_rating_run": _typed(tables, "analytics_rating_run", [run]),
        "analytics_run_metric": _typed(tables, "analytics_run_metric", run_metrics),
        "analytics_school_selection": selection,
        "analytics_run_school": members,
        "analytics_school_rating": ratings,
        "analytics_school_metric_value": values,
        "analytics_school_card": cards,
    }
    wide = ranked.selectExpr("count_if(abs(avg_graduates) > 999.99D) as clamped")
    plan = ChangePlan(changed, {"clamped": wide}, _conformed(added), tables.version, numbered=_numbered(added))
    return SavedRun(request_id, run_id, plan, ByReference(short_cards, names))


# --- reading the log -------------------------------------------------------------------------


def _counted(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.groupBy(key).agg(F.expr(f"count(*) as {name}"))


def _filter_summary(tables: Tables) -> DataFrame:
    per_type = tables["analytics_request_filter"].groupBy("request_id", "filter_type").count()
    return (
        per_type.selectExpr("request_id", "concat(filter_type, ':', count) as item")
        .groupBy("request_id")
        .agg(F.expr("listagg(item, ', ') within group (order by item) as filter_summary"))
    )


def calc_history(tables: Tables, limit: int | None = None) -> DataFrame:
    """Requests with their runs, latest first."""
    runs = tables["analytics_rating_run"].select(
        "request_id", "run_id", "calculated_at", "calculated_by", "run_name", "algorithm_version"
    )
    found = (
        tables["analytics_request"]
        .join(runs, "request_id", "left")
        .join(_counted(tables["analytics_school_selection"], "request_id", "selected_cnt"), "request_id", "left")
        .join(_filter_summary(tables), "request_id", "left")
        .join(_counted(tables["analytics_school_rating"], "run_id", "rated_cnt"), "run_id", "left")
        .selectExpr(
            "request_id",
            "created_at",
            "created_by",
            "request_name",
            "scenario",
            "year_basis",
            "notes",
            "coalesce(selected_cnt, 0) as selected_cnt",
            "filter_summary",
            "run_id",
            "calculated_at",
            "calculated_by",
            "run_name",
            "algorithm_version",
            "coalesce(rated_cnt, 0) as rated_cnt",
        )
        .orderBy(F.expr("coalesce(calculated_at, created_at)").desc(), F.desc("request_id"), F.desc("run_id"))
    )
    return found if limit is None else found.limit(max(1, int(limit)))


def rating_runs(tables: Tables, limit: int | None = None) -> DataFrame:
    """Runs with the number of rated schools and of reports, latest first."""
    requests = tables["analytics_request"].selectExpr(
        "request_id", "request_name", "created_by as request_created_by", "year_basis", "notes"
    )
    found = (
        tables["analytics_rating_run"]
        .join(requests, "request_id")
        .join(_counted(tables["analytics_school_rating"], "run_id", "rated_cnt"), "run_id", "left")
        .join(_counted(tables["analytics_school_report"], "run_id", "reports_cnt"), "run_id", "left")
        .selectExpr(
            "run_id",
            "request_id",
            "calculated_at",
            "calculated_by",
            "run_name",
            "algorithm_version",
            "stage",
            "request_name",
            "request_created_by",
            "year_basis",
            "notes",
            "coalesce(rated_cnt, 0) as rated_cnt",
            "coalesce(reports_cnt, 0) as reports_cnt",
        )
        .orderBy(F.desc("calculated_at"), F.desc("run_id"))
    )
    return found if limit is None else found.limit(max(1, int(limit)))


def run_schools(tables: Tables, run_id: int, limit: int | None = None) -> DataFrame:
    """Members of a run by rank; unranked ones last."""
    members = tables["analytics_run_school"].where(F.col("run_id") == run_id).select("run_id", "school_id")
    ranks = tables["analytics_school_rating"].where(F.col("run_id") == run_id)
    schools = tables["school"].join(members.select("school_id"), "school_id", "left_semi")
    found = (
        members.join(with_place(tables, schools), "school_id")
        .join(ranks.select("school_id", "rank_pos", "total_score"), "school_id", "left")
        .select("school_id", "full_name", "municipality_name", "region_name", "rank_pos", "total_score")
        .orderBy(F.asc_nulls_last("rank_pos"), "full_name", "school_id")
    )
    return found if limit is None else found.limit(max(1, int(limit)))


# --- reports ---------------------------------------------------------------------------------


# Names of the matched programs in a card: a text that many cards share.
_CARD_NAMES = "conclusions.matched_programs"


def _cards_by_reference(tables: Tables, scoped: Callable[[DataFrame], DataFrame]) -> ByReference:
    """Cards of a scope with the reference of the names of programs, and these names; digests are made where none are known."""
    known = tables.shared.get("analytics_school_card")
    if known is not None:
        return ByReference(scoped(known.rows), known.texts)
    return by_reference(scoped(tables["analytics_school_card"]).drop("card_id", "generated_at"), _CARD_NAMES, ["run_id", "school_id"])


def _report_parts(
    tables: Tables, run_id: int | None = None, created_by: str | None = None, school_id: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Members of a run with what their documents are made of, without the names of programs, and these names."""

    def of_scope(rows: DataFrame) -> DataFrame:
        if run_id is not None:
            rows = rows.where(F.col("run_id") == run_id)
        if school_id is not None and "school_id" in rows.columns:
            rows = rows.where(F.col("school_id") == school_id)
        return rows

    def scoped(table: str) -> DataFrame:
        return of_scope(tables[table])

    members = scoped("analytics_run_school").select("run_id", "school_id")
    run = (
        scoped("analytics_rating_run")
        .join(tables["analytics_request"].select("request_id", "request_name", "year_basis"), "request_id")
        .selectExpr(
            "run_id",
            "struct(run_id, request_id, calculated_at, algorithm_version, request_name, year_basis) as run",
        )
    )
    values = (
        scoped("analytics_school_metric_value")
        .where("metric_code is not null")
        .groupBy("run_id", "school_id")
        .agg(
            F.expr(
                "map_from_entries(array_sort(collect_list(struct(metric_code, "
                "struct(cast(raw_value as double) as raw_value, cast(norm_value as double) as norm_value, "
                "cast(weighted_value as double) as weighted_value))))) as metrics"
            )
        )
    )
    key = ["run_id", "school_id"]
    ratings = scoped("analytics_school_rating").drop("year_basis")
    cards, names = _cards_by_reference(tables, of_scope)
    cards = cards.withColumn("conclusions", F.col("conclusions").withField("matched_programs", F.lit(None).cast("string")))
    schools = with_place(tables, tables["school"].join(members.select("school_id"), "school_id", "left_semi"))
    parts = (
        members.join(schools, "school_id")
        .join(run, "run_id")
        .join(ratings, key, "left")
        .join(cards, key, "left")
        .join(values, key, "left")
        .withColumn("generated_by", F.lit(_author(created_by)).cast("string"))
    )
    return parts, names


def _documents(parts: DataFrame, names: DataFrame, *kept: str) -> DataFrame:
    """The document of every member, beside the columns ``kept``."""
    named = attach_texts(parts, names, REF)
    return named.withColumn("conclusions", F.col("conclusions").withField("matched_programs", F.col("_text"))).selectExpr(
        "run_id",
        "school_id",
        "rank_pos",
        "full_name",
        *kept,
        "struct(run, struct(school_id, full_name, region_name, municipality_name) as school, "
        "struct(rank_pos, cast(total_score as double) as total_score, students_cnt, "
        "cast(ege_avg_all as double) as ege_avg_all) as rating, "
        "coalesce(metrics, cast(map() as map<string, struct<raw_value: double, norm_value: double, "
        "weighted_value: double>>)) as metrics, "
        "struct(school_info, ege_summary, admission_summary, prof_summary, conclusions) as card, generated_by) "
        "as payload",
    )


def report_payloads(
    tables: Tables, run_id: int | None = None, created_by: str | None = None, school_id: int | None = None
) -> DataFrame:
    """Report document per member of a run as a nested column (all runs without a run id)."""
    return _documents(*_report_parts(tables, run_id, created_by, school_id))


def create_reports(
    tables: Tables,
    run_id: int,
    created_by: str | None = None,
    report_type: str = "standard",
    report_format: str = "json",
    school_id: int | None = None,
    now: datetime | None = None,
) -> tuple[DataFrame, ChangePlan]:
    """New report rows of a run and the plan that stores them.  Unknown types fall back to the default."""
    kind = (report_type or "").strip().lower()
    fmt = (report_format or "").strip().lower()
    parts, names = _report_parts(tables, run_id, created_by, school_id)
    # numbered before the documents are made: only short rows are moved
    numbered = assign_ids(parts, tables["analytics_school_report"], "report_id", ["run_id", "school_id"])
    rows = (
        _documents(numbered, names, "report_id").withColumn("report_payload", F.to_json("payload", {"ignoreNullFields": "false"}))
        .withColumns(
            {
                "report_type": F.lit(kind if kind in REPORT_TYPES_ON_REQUEST else "standard"),
                "report_format": F.lit(fmt if fmt in REPORT_FORMATS_ON_REQUEST else "json"),
                "generated_at": F.lit(now or datetime.now(timezone.utc)),
            }
        )
        .drop("payload", "rank_pos", "full_name")
    )
    fresh = conform(rows, "analytics_school_report")
    return fresh, ChangePlan(
        {}, appended={"analytics_school_report": fresh}, base=tables.version, numbered=("analytics_school_report",)
    )


def report_archive(tables: Tables, limit: int | None = None) -> DataFrame:
    """Reports with school, place and rank, latest first."""
    reports = tables["analytics_school_report"].drop("report_payload")
    schools = with_place(tables, tables["school"].join(reports.select("school_id"), "school_id", "left_semi"))
    ranks = tables["analytics_school_rating"].select("run_id", "school_id", "rank_pos")
    found = (
        reports.join(schools, "school_id")
        .join(ranks, ["run_id", "school_id"], "left")
        .select(
            "report_id",
            "generated_at",
            "report_type",
            "report_format",
            "run_id",
            "school_id",
            "rank_pos",
            "full_name",
            "municipality_name",
            "region_name",
        )
        .orderBy(F.desc("generated_at"), F.desc("report_id"))
    )
    return found if limit is None else found.limit(max(1, int(limit)))


def report_payload(tables: Tables, report_id: int) -> DataFrame:
    """One stored report with the school's name."""
    report = tables["analytics_school_report"].where(F.col("report_id") == report_id)
    return report.join(tables["school"].select("school_id", "full_name"), "school_id")


# --- run export ------------------------------------------------------------------------------

_PIVOT_NAMES = {
    "avg_graduates": "avg_graduates",
    "avg_score_all": "avg_score",
    "match_share": "match_share",
    "threshold_share": "threshold_share",
}


def run_metric_pivot(metric_values: DataFrame) -> DataFrame:
    """Metric rows to one row per run and school with twelve figure columns."""
    figures = [
        F.max(f"{part}_value").alias(part) for part in ("raw", "norm", "weighted")
    ]
    wide = metric_values.groupBy("run_id", "school_id").pivot("metric_code", list(METRIC_CODES)).agg(*figures)
    renamed = {
        f"{code}_{part}": f"{name}_{part}" for code, name in _PIVOT_NAMES.items() for part in ("raw", "norm", "weighted")
    }
    return wide.withColumnsRenamed(renamed)


def run_ranking(tables: Tables, run_id: int) -> DataFrame:
    """Rated schools of a run with their metric figures and matched programs."""
    ratings = tables["analytics_school_rating"].where(F.col("run_id") == run_id)
    values = tables["analytics_school_metric_value"].where(F.col("run_id") == run_id)
    schools = with_place(tables, tables["school"].join(ratings.select("school_id"), "school_id", "left_semi"))
    pivot = run_metric_pivot(values).drop("run_id")
    marked, names = _cards_by_reference(tables, lambda cards: cards.where(F.col("run_id") == run_id))
    found = (
        ratings.join(schools, "school_id")
        .join(pivot, "school_id", "left")
        .join(marked.select("school_id", REF), "school_id", "left")
    )
    return attach_texts(found, names, REF, [F.col("rank_pos"), F.col("full_name")]).selectExpr(
        "rank_pos",
        "school_id",
        "full_name",
        "region_name",
        "municipality_name",
        "total_score",
        "students_cnt",
        "ege_avg_all",
        *(c for c in pivot.columns if c != "school_id"),
        "coalesce(_text, '') as matched_programs",
    )


def run_export(tables: Tables, run_id: int) -> dict[str, DataFrame] | None:
    """Ranking, filters, weights and header of a run; None for an unknown run."""
    requests = tables["analytics_request"].selectExpr(
        "request_id",
        "request_name",
        "created_at as request_created_at",
        "created_by as request_created_by",
        "year_basis",
        "notes",
    )
    meta = (
        tables["analytics_rating_run"]
        .where(F.col("run_id") == run_id)
        .join(requests, "request_id")
        .select(
            "run_id",
            "request_id",
            "calculated_at",
            "calculated_by",
            "run_name",
            "algorithm_version",
            "stage",
            "request_name",
            "request_created_at",
            "request_created_by",
            "year_basis",
            "notes",
        )
    )
    header = meta.first()
    if header is None:
        return None
    columns = list(FILTER_COLUMNS.values())
    order = ["region_id", "municipality_id", "institute_id", "profile_id", "program_id", "subject_id", "school_id"]
    filters = (
        tables["analytics_request_filter"]
        .where(F.col("request_id") == header["request_id"])
        .select("filter_type", *order, "min_score")
        .orderBy("filter_type", *(F.coalesce(c, F.lit(-1)) for c in order))
    )
    assert set(order) == set(columns)
    weights = (
        tables["analytics_run_metric"]
        .where(F.col("run_id") == run_id)
        .select("metric_code", "weight", "is_primary")
        .orderBy("metric_code")
    )
    return {"ranking": run_ranking(tables, run_id), "filters": filters, "weights": weights, "meta": meta}




# --- documents by field ------------------------------------------------------------------------


def document_fields(documents: DataFrame, key: str, column: str = "report_payload") -> DataFrame:
    """(key, path, kind, value): every field of JSON documents, whatever they hold; ``value`` is a VARIANT.

    Objects and arrays are opened level by level, as long as any is left: their
    fields have paths such as ``card.ege_summary.last_year`` and ``items.0``.
    A text that is no JSON gives one field ``$`` without a value; an empty object gives none.
    """
    spark = documents.sparkSession
    kind = "schema_of_variant({0})"
    nested = "(kind like 'OBJECT<%' or kind like 'ARRAY<%')"
    level = documents.selectExpr(key, "'' as path", f"try_parse_json({column}) as value").withColumn("kind", F.expr(kind.format("value")))
    found = level.where(f"not coalesce({nested}, false)").selectExpr(key, "'$' as path", "kind", "value")
    level = level.where(nested)
    while True:
        opened = spark.sql(
            f"select {key}, concat(path, if(path = '', '', '.'), coalesce(e.key, cast(e.pos as string))) as path, e.value as value "
            "from {level}, lateral variant_explode_outer(value) as e where e.pos is not null",
            level=level,
        )
        opened = materialize(opened.withColumn("kind", F.expr(kind.format("value"))))
        found = found.unionByName(opened.where(f"not {nested}"))
        level = opened.where(nested)
        if level.isEmpty():
            return found
