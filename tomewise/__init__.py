"""Structural analysis of instruction folders on Spark."""

from .constants import ANALYZER_VERSION, BODY_LINE_LIMIT, BODY_TOKEN_LIMIT, DEFAULT_IGNORE, DEFAULT_TOKENIZER, REGISTRY, SCHEMA_VERSION, SPEC_VERSION
from .plans.analyze import Options, analyze, python_tokenizer
from .plans.render import to_json, to_text
from .plans.schema import json_schema, options_schema
from .sources.trees import from_dir, from_dirs, from_files, from_table

__all__ = ["ANALYZER_VERSION", "BODY_LINE_LIMIT", "BODY_TOKEN_LIMIT", "DEFAULT_IGNORE", "DEFAULT_TOKENIZER", "REGISTRY", "SCHEMA_VERSION", "SPEC_VERSION", "Options", "analyze", "from_dir", "from_dirs", "from_files", "from_table", "json_schema", "options_schema", "python_tokenizer", "to_json", "to_text"]
