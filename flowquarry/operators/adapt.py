"""Extractor rows to model rows: renaming, parsing, rejects, metadata, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.columns import identity, normalize_python, number_error, parse_number
from flowquarry.operators.profile import q
from flowquarry.schema import FEATURE_ALIASES, METADATA, METADATA_ALIASES, POLICIES, REPRODUCED, REPRODUCTION


def resolve(columns: list[str], required: list[str], policy: str = REPRODUCTION) -> dict[str, str]:
    """Model feature -> source column; missing or doubly served features are errors, known when the plan is made."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}")
    found: dict[str, str] = {}
    for c in columns:
        name = normalize_python(c)
        target = FEATURE_ALIASES.get(name, name)
        if target in found:
            raise ValueError(f"{target!r} is served by {found[target]!r} and {c!r}")
        found[target] = c
    if policy == REPRODUCTION:
        for target, source in REPRODUCED.items():
            if target in required and target not in found and source in found:
                found[target] = found[source]
    missing = [f for f in required if f not in found]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return {f: found[f] for f in required}


def metadata_columns(columns: list[str]) -> dict[str, list[str]]:
    """Metadata name -> the columns that may hold it, in order of preference."""
    named = {normalize_python(c): c for c in columns}
    out: dict[str, list[str]] = {}
    for alias, target in METADATA_ALIASES.items():
        if alias in named:
            out.setdefault(target, []).append(named[alias])
    return out


def metadata(columns: list[str], given: dict[str, Column] | None = None) -> list[Column]:
    """One string column per metadata name: what is given wins, then the first alias that is not blank."""
    sources = metadata_columns(columns)
    out = []
    for name in METADATA:
        options = [given[name]] if given and name in given else []
        options += [F.nullif(q(c).cast("string"), F.lit("")) for c in sources.get(name, [])]
        out.append((F.coalesce(*options) if options else F.lit(None).cast("string")).alias(name))
    return out


def adapt(df: DataFrame, required: list[str], policy: str = REPRODUCTION, keep: tuple[str, ...] = ()) -> DataFrame:
    """Text columns to model features in order, with reject_reason (null for good rows).

    Blank, nan and inf become null; a value that is no number rejects its row, whose features stay for inspection.
    """
    sources = resolve([c for c in df.columns if c not in keep], required, policy)
    reasons = [F.when(number_error(q(c)), F.lit(f)) for f, c in sources.items()]
    bad = F.array_compact(F.array(*reasons))
    reason = F.when(F.size(bad) > 0, F.concat(F.lit("not numeric: "), F.array_join(bad, ",")))
    return df.select(*[q(c) for c in keep], *[parse_number(q(c)).alias(f) for f, c in sources.items()], reason.alias("reject_reason"))


def split_rejects(adapted: DataFrame) -> tuple[DataFrame, DataFrame]:
    return adapted.where("reject_reason is null").drop("reject_reason"), adapted.where("reject_reason is not null")


def validate_map(df: DataFrame, features: str, required: list[str], extras: str = "reject") -> DataFrame:
    """A map of feature texts to model features, with reject_reason and the extras; policy 'reject' or 'ignore' for these."""
    if extras not in ("reject", "ignore"):
        raise ValueError("extras must be 'reject' or 'ignore'")
    from flowquarry.functions.columns import normalize_name

    need = F.array(*[F.lit(r) for r in required])
    names = F.transform(F.map_keys(features), normalize_name)
    entries = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(features), lambda e: F.struct(normalize_name(e["key"]).alias("key"), e["value"].alias("value")))))
    twice = F.size(F.array_distinct(names)) < F.size(names)
    safe = F.when(~twice, entries)
    missing, more = F.array_except(need, names), F.array_sort(F.array_except(names, need))
    bad = F.filter(need, lambda n: F.coalesce(number_error(F.element_at(F.col("_map"), n)), F.lit(False)))
    out = df.withColumn("_map", safe).withColumns({"_twice": twice, "_missing": missing, "extra_features": more, "_bad": bad})
    reason = F.when(F.col("_twice"), "duplicate features").when(F.size("_missing") > 0, F.concat(F.lit("missing: "), F.array_join("_missing", ",")))
    if extras == "reject":
        reason = reason.when(F.size("extra_features") > 0, F.concat(F.lit("extra: "), F.array_join("extra_features", ",")))
    reason = reason.when(F.size("_bad") > 0, F.concat(F.lit("not numeric: "), F.array_join("_bad", ",")))
    values = [parse_number(F.element_at(F.col("_map"), F.lit(r))).cast("float").alias(r) for r in required]
    return out.select(*[q(c) for c in df.columns if c != features], F.array_join("extra_features", ",").alias("extra_features"), reason.alias("reject_reason"), *values)


def metadata_rejects(df: DataFrame) -> DataFrame:
    """reject_reason for metadata out of bounds: port range, lengths of addresses and protocol."""
    port = lambda c: F.col(c).isNotNull() & ~F.col(c).between(0, 65535)
    reason = (
        F.when(port("source_port"), "source_port").when(port("destination_port"), "destination_port")
        .when(F.length("source_ip") > 45, "source_ip").when(F.length("destination_ip") > 45, "destination_ip").when(F.length("protocol") > 30, "protocol")
    )
    return df.withColumn("reject_reason", reason)


def flow_fingerprint(flow_id: Column | None = None) -> Column:
    """Identity of a flow within a run: its own id if it has one, else metadata, duration and packet counts."""
    own = identity(*sorted(METADATA), "flow_duration", "total_fwd_packets", "total_backward_packets")
    return F.coalesce(flow_id, own) if flow_id is not None else own


def live_fingerprint() -> Column:
    """Identity of a flow within a session: session, 5-tuple, time and duration; never feature values alone."""
    return identity("capture_session_id", "source_ip", "destination_ip", "source_port", "destination_port", "protocol", "capture_time", "flow_duration")
