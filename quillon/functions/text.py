"""Text functions of the lenient statement dialect."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that is trimmed around list items.
SPACES = " \t\n\r"


def split_list(text: Column, delimiter: str = ",") -> Column:
    """Items between delimiters, trimmed; blank ones are dropped and quotes mean nothing."""
    return F.filter(F.transform(F.split(text, f"\\Q{delimiter}\\E", -1), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")


def first_word_upper(text: Column) -> Column:
    """The command verb."""
    return F.upper(F.regexp_extract(text, r"^\s*(\S+)", 1))


def words(text: Column) -> Column:
    """The words between ASCII white space."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))


def cell(value: Column) -> Column:
    """The untyped form of a value; null is the text NULL."""
    return F.coalesce(value.cast("string"), F.lit("NULL"))
