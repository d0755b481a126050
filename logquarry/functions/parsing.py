"""Column expressions that turn one raw line into typed fields.

Character classes are ASCII (``\\d``, ``\\w``, ``\\s``), which keeps the meaning equal
across regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logquarry import dims

# Layout of one line. Groups: service, timestamp, process id, level, module,
# request info, message.
LINE_PATTERN = (
    r"^(\S+)\s+(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(\w+)\s+"
    r"([\w.]+)\s+(\[[^\n]*?\])\s+([^\n]*)"
)
LINE_FIELDS = [
    "service", "timestamp_text", "process_id", "level", "module", "request_info", "message",
]
MARK = "\u0001"
# Identifiers inside a message and inside the request part.
INSTANCE_PATTERN = r"\[instance:\s+([a-f0-9-]+)\]"
REQUEST_PATTERN = r"req-([a-f0-9-]+)"


def stripped(line: Column) -> Column:
    """Without leading and trailing blanks and without replacement characters.

    The text source decodes undecodable bytes to U+FFFD; those bytes are to be dropped.
    """
    return F.regexp_replace(F.regexp_replace(line, "�", ""), r"^\s+|\s+$", "")


def line_fields(line: Column) -> list[Column]:
    return [
        F.regexp_extract(line, LINE_PATTERN, i).alias(name)
        for i, name in enumerate(LINE_FIELDS, start=1)
    ]


def line_matches(line: Column) -> Column:
    return line.rlike(LINE_PATTERN)


def line_parts(line: Column) -> Column:
    """All seven fields as an array, null where the line does not match.

    One replacement marks the field borders and one split cuts there, instead of one regex
    pass per field. Lines that already hold the mark are matched field by field.
    """
    marked = F.regexp_replace(line, LINE_PATTERN, MARK.join(f"${i + 1}" for i in range(len(LINE_FIELDS))))
    fields = F.split(marked, MARK, len(LINE_FIELDS))
    one_by_one = F.when(line_matches(line), F.array(*line_fields(line)))
    # bound as a lambda variable, so that the line is cut once
    whole = F.transform(F.array(fields), lambda f: F.when(F.size(f) == len(LINE_FIELDS), f))[0]
    return F.when(F.contains(line, F.lit(MARK)), one_by_one).otherwise(whole)


def line_timestamp(text: Column) -> Column:
    """One to six fraction digits; anything else, or an impossible date, gives null."""
    spaced = F.regexp_replace(text, r"\s+", " ")
    return F.try_to_timestamp(spaced, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")


def flexible_timestamp(text: Column) -> Column:
    """The line layout, then ISO forms with or without zone and fraction, then the date alone."""
    trimmed = F.trim(text)
    layouts = [
        "yyyy-MM-dd HH:mm:ss.SSSSSS",
        "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
        "yyyy/MM/dd HH:mm:ss",
        "dd/MM/yyyy HH:mm:ss",
    ]
    attempts = [F.try_to_timestamp(trimmed, F.lit(layout)) for layout in layouts]
    attempts.append(trimmed.try_cast("timestamp"))
    return F.coalesce(*attempts).cast("timestamp_ntz")


def service_type(service: Column) -> Column:
    expr = F.lit("unknown")
    for name in reversed(dims.SERVICE_TYPES):
        expr = F.when(service.contains(name), F.lit(name)).otherwise(expr)
    return expr


def instance_id(message: Column) -> Column:
    return F.nullif(F.regexp_extract(message, INSTANCE_PATTERN, 1), F.lit(""))


def request_id(request_info: Column) -> Column:
    return F.nullif(F.regexp_extract(request_info, REQUEST_PATTERN, 1), F.lit(""))
