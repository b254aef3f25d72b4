"""A rating is saved without the names of programs beside every school."""

from edurank.operators import rating, runs
from edurank.plans.params import RatingFilters, RatingWeights
from test_operators import small  # noqa: F401

SCOPE = RatingFilters(institute_ids=(1,), enforce_subject_threshold=False)


def test_saved_by_reference(small):  # noqa: F811
    """A rating saved by reference gives the log, reports and ranking of one that is saved with its texts."""
    ranked = rating.rate_schools(small, SCOPE, RatingWeights())
    long = runs.save_rating(small, SCOPE, RatingWeights(), ranked, "me")
    short = runs.save_rating(small, SCOPE, RatingWeights(), rating.rate_by_reference(small, SCOPE, RatingWeights()), "me")
    log, other = long.plan.preview(small), short.plan.preview(small)
    other.shared = {"analytics_school_card": short.cards}
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    for name in ("analytics_school_card", "analytics_school_rating"):
        assert same(log[name].drop("generated_at"), other[name].drop("generated_at"))
    cut = lambda tables: runs.report_payloads(tables, 1, "me").selectExpr("school_id", "payload.card", "payload.rating")
    assert same(cut(log), cut(other)) and same(runs.run_ranking(log, 1), runs.run_ranking(other, 1))
    assert other.with_tables({"school": small["school"]}).shared and not other.with_tables({"analytics_school_card": log["analytics_school_card"]}).shared


def test_counts_do_not_make_documents(small):  # noqa: F811
    """Metric values that come twice make no document; the listing of runs needs none."""
    saved = runs.save_rating(small, SCOPE, RatingWeights(), rating.rate_by_reference(small, SCOPE, RatingWeights()), "me")
    log = saved.plan.preview(small)
    twice = log.with_tables({"analytics_school_metric_value": log["analytics_school_metric_value"].unionAll(log["analytics_school_metric_value"])})
    _, plan = runs.create_reports(twice, 1, "me")
    listed = runs.rating_runs(plan.preview(twice)).collect()
    assert [r.reports_cnt for r in listed] == [log["analytics_run_school"].count()]
