"""Whole documents as bundles of DataFrames; each is computed only when it is read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from agentlog.config import AggConfig, Filters, RoiConfig, UsersConfig
from agentlog.operators import joins, roi, stats, users
from agentlog.session import cut_lineage


def dashboard(
    assignments: DataFrame, clusters: DataFrame, filters: Filters = Filters(), cfg: AggConfig = AggConfig()
) -> dict[str, DataFrame]:
    """Every section of the dashboard over one filtered input.

    Totals, distribution, outliers, top scenarios and the middle of the period come from
    one small stored roll-up; trends, days and failure signals scan their few columns.
    """
    a = joins.apply_filters(assignments, filters)
    roll = cut_lineage(stats.rollup(a))
    trends = stats.scenario_trends(a, cfg, roll)
    failures = stats.failure_summary(a)
    return {
        "totals": stats.totals(roll, clusters),
        "tasks_distribution": stats.with_share(stats.task_distribution(roll, cfg.top_tasks)),
        "top_scenarios": stats.top_scenarios(roll, clusters, trends, cfg.top_scenarios),
        "dynamics": stats.dynamics(a),
        "outliers_summary": stats.outliers(roll),
        "failure_analysis": failures,
        "top_failure_signals": stats.failure_top_signals(a, cfg.top_signals),
        "success_rate": stats.dashboard_success_rate(failures),
    }


def roi_document(
    records: DataFrame, assignments: DataFrame, filters: Filters = Filters(), cfg: RoiConfig = RoiConfig()
) -> dict[str, DataFrame]:
    """Every section of the ROI report.

    The join and the rows are computed once, into a stored roll-up; only the tools, which
    are lists, are counted from the rows.
    """
    rows = roi.roi_rows(joins.joined(joins.apply_filters(records, filters), assignments), cfg)
    roll = cut_lineage(roi.roi_rollup(rows))
    return {
        "verdict": roi.roi_verdict(roll, cfg),
        "summary": roi.roi_summary(roll, cfg),
        "by_category": roi.roi_by_category(roll, cfg),
        "by_scenario": roi.roi_by_scenario(roll, cfg),
        "top_spenders": roi.top_spenders(roi.roi_user_stats(roll, cfg)),
        "department_costs": roi.department_costs(roll, cfg),
        "style_breakdown": roi.style_breakdown(roll),
        "top_tools": roi.tool_frequency(rows),
        "analysis_cost": roi.analysis_cost(roll, cfg),
        "assumptions": roi.roi_assumptions(rows.sparkSession, cfg),
    }


def users_document(
    records: DataFrame, assignments: DataFrame, filters: Filters = Filters(),
    cfg: UsersConfig = UsersConfig(), money: RoiConfig = RoiConfig(),
) -> dict[str, DataFrame]:
    """Every section of the users and models reports."""
    base = joins.joined(joins.apply_filters(records, filters), assignments)
    people = users.users_table(base, cfg, money)
    return {
        "summary": users.users_summary(people, cfg),
        "personas": users.persona_distribution(people),
        "by_department": users.department_users(people),
        "users": people.orderBy(F.desc("total_queries"), "user_id"),
        "model_summary": users.model_summary(base),
        "models": users.model_analytics(base),
    }


def flatten(bundle: dict[str, DataFrame]) -> DataFrame:
    """A bundle as one table of (section, row as JSON)."""
    parts = [
        df.select(F.lit(name).alias("section"), F.to_json(F.struct(*df.columns)).alias("row"))
        for name, df in bundle.items()
    ]
    return reduce(DataFrame.unionByName, parts)
