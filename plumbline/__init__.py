"""Data quality on Spark DataFrames: sources, profiles, rule suites, run history
and a metadata catalog."""

from plumbline.operators.preview import columns, preview, row_count
from plumbline.operators.profile import (
    dataset_summary,
    distinct_counts,
    null_counts,
    numeric_stats,
    profile,
    profile_source,
    with_percentages,
)
from plumbline.operators.profile_states import profile_from_states, profile_state, read_profile_states, write_profile_state
from plumbline.operators.rule_states import merge_rule_states, results_from_states, rule_state, stream_results, stream_validate
from plumbline.operators.rules import RULE_DESCRIPTIONS, RULE_TYPES, Rule
from plumbline.operators.validate import (
    missing_column_warnings,
    report_source,
    run_report,
    run_status,
    run_summary,
    validate,
    validate_isolated,
    validate_many,
    validate_observed,
    validate_source,
)
from plumbline.sources import SourceSpec, read_path, resolve

__all__ = [
    "RULE_DESCRIPTIONS",
    "RULE_TYPES",
    "Rule",
    "SourceSpec",
    "columns",
    "dataset_summary",
    "distinct_counts",
    "merge_rule_states",
    "missing_column_warnings",
    "null_counts",
    "numeric_stats",
    "preview",
    "profile",
    "profile_from_states",
    "profile_source",
    "profile_state",
    "read_path",
    "read_profile_states",
    "report_source",
    "resolve",
    "results_from_states",
    "row_count",
    "rule_state",
    "run_report",
    "run_status",
    "run_summary",
    "stream_results",
    "stream_validate",
    "validate",
    "validate_isolated",
    "validate_many",
    "validate_observed",
    "validate_source",
    "with_percentages",
    "write_profile_state",
]
