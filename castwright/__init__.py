"""castwright: type inference, profiling, safe casting and paging of string tables on Spark."""

from castwright.operators.convert import convert, render_rows, violations
from castwright.operators.dictionary import category_dictionary
from castwright.operators.infer import dataset_warnings, infer, infer_table
from castwright.operators.overrides import apply_overrides, can_convert_matrix, override_errors, schema_diff
from castwright.operators.paging import page_metadata, preview_page, with_ordinals
from castwright.operators.profile import profile, value_counts
from castwright.plans.jobs import preview_run, process, process_csv, process_prefix, process_table
from castwright.sources.csv import read_csv
from castwright.sources.files import list_supported_files

__all__ = [
    "apply_overrides", "can_convert_matrix", "category_dictionary", "convert", "dataset_warnings", "infer",
    "infer_table", "list_supported_files", "override_errors", "page_metadata", "preview_page", "preview_run",
    "process", "process_csv", "process_prefix", "process_table", "profile", "read_csv", "render_rows", "schema_diff",
    "value_counts", "violations", "with_ordinals",
]
