from cohortlib.sources.extract import EXTRACT_SCHEMA, guess_types, read_extract, read_stage, write_stage
from cohortlib.sources.tables import CohortInputs, load_inputs

__all__ = ["EXTRACT_SCHEMA", "CohortInputs", "guess_types", "load_inputs", "read_extract", "read_stage", "write_stage"]
