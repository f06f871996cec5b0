"""Vocabulary, names, texts and thresholds every module shares."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------

NULL_TOKENS = ["", "na", "n/a", "null", "none", "not available", "nan"]
TRUE_TOKENS = ["true", "t", "yes", "y", "1"]
FALSE_TOKENS = ["false", "f", "no", "n", "0"]

LOGICAL_TYPES = ["text", "integer", "float", "boolean", "date", "datetime", "category", "complex"]

DISPLAY_NAMES = {
    "text": "Text",
    "integer": "Integer",
    "float": "Float",
    "boolean": "Boolean",
    "date": "Date",
    "datetime": "DateTime",
    "category": "Category",
    "complex": "Complex",
}
STORAGE_NAMES = {
    "text": "string",
    "integer": "Int64",
    "float": "Float64",
    "boolean": "boolean",
    "date": "datetime64[ns]",
    "datetime": "datetime64[ns]",
    "category": "category",
    "complex": "object",
}

CONFIDENCE_EMPTY = 0.1
CONFIDENCE_BOOLEAN = 0.96
CONFIDENCE_INTEGER = 0.98
CONFIDENCE_FLOAT = 0.97
CONFIDENCE_DATE = 0.92
CONFIDENCE_AMBIGUOUS = 0.3
CONFIDENCE_COMPLEX = 0.8
CONFIDENCE_CATEGORY_LARGE = 0.76
CONFIDENCE_CATEGORY_SMALL = 0.64
CONFIDENCE_TEXT = 0.45

CATEGORY_SMALL = {"min_rows": 5, "max_unique": 5, "max_ratio": 0.4}
CATEGORY_LARGE = {"min_rows": 20, "max_unique": 50, "max_ratio": 0.2}

UNIQUE_CAP = 51
SAMPLE_SIZE = 5

PAGE_SIZE_DEFAULT = 100
PAGE_SIZE_MAX = 500

WARN_EMPTY = "All values were empty or matched recognized null tokens."
WARN_AMBIGUOUS = "Values look date-like but are ambiguous, so the column was kept as text."
WARN_FORCED = "This column was manually forced to a date-like type. Ambiguous values will use pandas defaults."

ERR_UNKNOWN_COLUMN = "Column '%s' does not exist in the dataset."
ERR_UNSUPPORTED_TYPE = "Unsupported override type '%s'."
ERR_UNSAFE = "Column '%s' cannot be safely converted to '%s'."
ERR_NOT_INTEGER = "Column '%s' contains non-integer values."
ERR_NOT_NUMERIC = "Column '%s' contains non-numeric values."
ERR_NOT_BOOLEAN = "Column '%s' contains non-boolean values."
ERR_NOT_DATE = "Column '%s' contains values that are not valid dates."
ERR_NOT_COMPLEX = "Column '%s' contains values that are not complex numbers."
ERR_PAGE_RANGE = "The requested preview page is outside the available row range."
ERR_FILE_TYPE = "Only CSV, XLS, and XLSX files are supported."
ERR_PARSE = "The selected CSV file could not be parsed."
ERR_EMPTY_FILE = "The selected CSV file has no columns to parse."
ERR_RUN_MISSING = "The requested processing run could not be found."
ERR_FILE_MISSING = "Local file '%s' does not exist."

FILE_TYPES = {".csv": "csv", ".xls": "excel", ".xlsx": "excel"}

GROUPED_NUMBER = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?([eE][+-]?\d+)?\z"
TIME_HINT = r"(\d{1,2}:\d{2})|(T\d{1,2}:\d{2})"

# Whitespace removed from both ends of a cell: the Unicode space characters,
# the ASCII controls tab to carriage return and the four separator controls.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)

# First and last instant a nanosecond timestamp can hold, cut to microseconds.
FIRST_INSTANT = "1677-09-21 00:12:43.145225"
LAST_INSTANT = "2262-04-11 23:47:16.854775"
# --- end of fixed values ----------------------------------------------------
