"""Correlation-aware table folding on Spark: functions between columns replace columns, exactly."""

from colfold.api import benchmark, from_format, functions_to_json, generate_schema, get_functions_from_json, get_metadata_from_file, query, to_format, train, where_folded

__all__ = ["benchmark", "from_format", "functions_to_json", "generate_schema", "get_functions_from_json", "get_metadata_from_file", "query", "to_format", "train", "where_folded"]
