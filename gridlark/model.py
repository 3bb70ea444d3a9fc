"""Names, row types and errors of the engine."""

from __future__ import annotations

from typing import NamedTuple


class Variable(NamedTuple):
    """A header entry, or a request in which None stands for anything."""

    table: str | None
    key: str | None
    type: str | None
    units: str | None


class SimpleVariable(NamedTuple):
    table: str | None
    key: str | None
    units: str | None


FILES = "file_id int, file_path string, file_name string, file_created timestamp, file_type string"
VARIABLES = "file_id int, table string, table_pos int, id int, pos int, is_simple boolean, key string, type string, units string"
STEPS = "file_id int, table string, row_ix long, ts timestamp_ntz, range_ix long, label string, day string, n_days int"
RESULTS = "file_id int, table string, id int, row_ix long, ts timestamp_ntz, value double"
TEXTS = "file_id int, table string, id int, row_ix long, ts timestamp_ntz, value string"
PEAKS = "file_id int, table string, id int, ts timestamp_ntz, min_value double, min_ts timestamp_ntz, max_value double, max_ts timestamp_ntz"

#: Interval tables from the finest to the coarsest.
INTERVALS = ("timestep", "hourly", "daily", "monthly", "annual", "runperiod")
OUTPUT_TYPES = ("standard", "global_max", "global_min", "local_max", "local_min")


class GridlarkError(Exception):
    """Base of the engine's errors."""


class InvalidOutputType(GridlarkError):
    pass


class InvalidUnitsSystem(GridlarkError):
    pass


class PeaksNotIncluded(GridlarkError):
    pass


class IncompleteFile(GridlarkError):
    pass


class InvalidLineSyntax(GridlarkError, AttributeError):
    pass


class BlankLineError(GridlarkError):
    pass


class CannotAggregateVariables(GridlarkError):
    pass


class NoResults(GridlarkError):
    pass


class MultiEnvFileRequired(GridlarkError):
    pass


class InsuficientHeaderInfo(GridlarkError):
    pass


class FormatNotSupported(GridlarkError):
    pass


class LeapYearMismatch(GridlarkError):
    pass


class StartDayMismatch(GridlarkError):
    pass


class CorruptedData(GridlarkError):
    pass


class VariableNotFound(GridlarkError):
    pass


class DuplicateVariable(GridlarkError):
    """Header entries that occur twice; `clean` has the rest, `duplicates` theirs by id."""

    def __init__(self, message: str, clean: dict, duplicates: dict):
        super().__init__(message)
        self.clean, self.duplicates = clean, duplicates
