"""Physical shapes the operators share: passes over the data that answer many
questions at once."""

from plumbline.plans.fused import Measures, in_order, literal_rows, struct_sql, unpack
from plumbline.plans.grouped import DEFAULT_COLUMNS_PER_SCAN, value_counts
from plumbline.plans.sums import column_means, column_sums

__all__ = [
    "DEFAULT_COLUMNS_PER_SCAN",
    "Measures",
    "column_means",
    "column_sums",
    "in_order",
    "literal_rows",
    "struct_sql",
    "unpack",
    "value_counts",
]
