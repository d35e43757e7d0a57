"""Compare, join, reconcile and summarize tables with Spark."""

from .functions.cells import cell_type, in_tolerance, is_blank, safe_number
from .functions.names import excel_column
from .operators.aggregate import aggregate, concatenate_parts, de_aggregate, distinct_values
from .operators.columns import extract_column, first_columns, spread_cells, square_rows, strip_cells, union_tables
from .operators.compare import Check, compare_columns, compare_many, parse_constants, specs_from_table, with_constants
from .operators.flatten import FlattenOptions, detect_record_path, expected_rows, flatten, select_records
from .operators.join import join_tables
from .operators.keys import key_analysis, key_set, summarize_keys
from .operators.messages import foreign_texts, parse_envelopes, reassemble, split_messages
from .operators.profile import column_uniqueness, profile, snapshot, snapshot_rows
from .operators.reconcile import ColumnPair, Texts, map_columns, reconcile, reconcile_guided
from .operators.sketches import distinct_sketches, estimated_counts, merge_sketches
from .plans.agg_specs import AGG_TYPES, AggSpec, spec_all
from .plans.session import build_session
from .sources.delimited import convert_types, read_cells, read_csv, read_text, sniff_delimiter, write_csv, write_text
from .sources.dispatch import read_flattened, read_table, read_tables, write_table, write_tables
from .sources.xml import archive_members, parse_documents, read_xml, read_xml_archive, read_xml_tables

__all__ = [name for name in dir() if not name.startswith("_")]
