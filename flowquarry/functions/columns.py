"""Column expressions over flow data; all are built-in functions, none is a Python UDF."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowquarry.schema import CLASS_INDEX

NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SPECIAL = r"^[+-]?(nan|inf|infinity)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column | str) -> Column:
    """Trimmed, lower-case, with '_' for slashes and runs of white space."""
    return F.regexp_replace(F.replace(F.lower(strip(c)), F.lit("/"), F.lit("_")), r"(?U)\s+", "_")


def normalize_python(name: str) -> str:
    """normalize_name for a schema's names, known when the plan is made."""
    return re.sub(r"\s+", "_", name.strip().lower().replace("/", "_"))


def map_label(c: Column | str) -> Column:
    """The class of a raw label, null when out of scope; the first rule that holds wins."""
    text = F.lower(F.regexp_replace(strip(c), r"(?U)\s+", " "))
    tight = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(text.isin("benign", "normal"), "Normal").when(tight.contains("ddos"), "DDoS").when(tight.contains("portscan"), "PortScan")


def label_index(c: Column | str) -> Column:
    out = None
    for label, i in CLASS_INDEX.items():
        out = F.when(_col(c) == label, i) if out is None else out.when(_col(c) == label, i)
    return out


def finite(c: Column | str) -> Column:
    """Null for NaN and infinities."""
    c = _col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def is_infinite(c: Column | str) -> Column:
    return F.coalesce(F.abs(_col(c)) == float("inf"), F.lit(False))


def parse_number(c: Column | str) -> Column:
    """A text's number; blank, nan and inf are null, and so is what number_error reports."""
    text = F.trim(_col(c))
    return F.when(text.rlike(NUMBER), finite(text.try_cast("double")))


def number_error(c: Column | str) -> Column:
    """Whether a text is neither blank nor a number."""
    text = F.trim(_col(c))
    return F.coalesce((text != "") & ~text.rlike(NUMBER) & ~F.lower(text).rlike(SPECIAL), F.lit(False))


def parse_timestamp(c: Column | str) -> Column:
    """ISO-8601 with or without Z, null when it can't be read."""
    return F.try_to_timestamp(F.regexp_replace(_col(c), "Z$", "+00:00"))


def minute(c: Column | str) -> Column:
    return F.date_trunc("minute", _col(c))


def severity(label: Column | str) -> Column:
    return F.when(_col(label) == "DDoS", "HIGH").otherwise("MEDIUM")


def alert_title(label: Column | str) -> Column:
    return F.format_string("%s confidence %s detected", severity(label), _col(label))


def alert_description(label: Column | str, confidence: Column | str) -> Column:
    return F.format_string("The model classified this flow as %s with confidence %.4f.", _col(label), _col(confidence))


def identity(*columns: Column | str) -> Column:
    """SHA-256 over the columns' values as one JSON object: no two rows of different values read alike, and nulls differ from every text."""
    fields = [_col(c).cast("string").alias(c if isinstance(c, str) else f"_{i}") for i, c in enumerate(columns)]
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def time_text(c: Column | str) -> Column:
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")


def report_time(c: Column | str) -> Column:
    return F.date_format(_col(c), "dd MMM yyyy · HH:mm:ss")


def session_id_ok(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(r"^\d{8}T\d{6}Z_[0-9a-f]{6}$"), F.lit(False))


def session_id(ts: Column | str, seed: Column | str) -> Column:
    return F.concat(F.date_format(_col(ts), "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), F.substring(F.sha2(_col(seed).cast("string"), 256), 1, 6))


def probability_map(vector: Column | str, classes: tuple[str, ...]) -> Column:
    """Class -> probability from an ML probability vector."""
    from pyspark.ml.functions import vector_to_array

    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), vector_to_array(_col(vector)))
