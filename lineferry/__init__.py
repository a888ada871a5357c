"""Load and produce hand-off files with Spark DataFrames."""

from lineferry.functions.convert import register_conversion
from lineferry.plans.extract import extract_lines, extract_summary, render_rows, run_extract, with_header_footer
from lineferry.plans.load import LoadResult, load, load_summary, loaded, rejects, route, route_with_inserts
from lineferry.spec import ExtractSpec, Field, GlobalFilter, InsertRule, LoadSpec, Lookup

__all__ = [
    "ExtractSpec", "Field", "GlobalFilter", "InsertRule", "LoadResult", "LoadSpec", "Lookup", "extract_lines", "extract_summary",
    "load", "load_summary", "loaded", "register_conversion", "rejects", "render_rows", "route", "run_extract", "route_with_inserts",
    "with_header_footer",
]
