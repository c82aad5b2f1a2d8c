"""Requests as JSON text against tables of rules: one expression gives all that is wrong with a request, in the rules' order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions import vocab as V

Rule = tuple[str, Callable[[Column], Column]]


def kind_of(v: Column, path: str = "$") -> Column:
    """The JSON type of what is at a path: OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (a null); null where
    there is nothing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)


def text_at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def absent(v: Column, path: str) -> Column:
    return F.coalesce(kind_of(v, path) == "VOID", F.lit(True))


def is_text(v: Column, path: str) -> Column:
    """Text that isn't blank."""
    return F.coalesce((kind_of(v, path) == "STRING") & text_at(v, path).rlike(r"(?U)\S"), F.lit(False))


def is_count(v: Column, path: str, least: int = 0) -> Column:
    """A whole number from ``least`` to the largest of 64 bits: no truth value, no fraction, no text."""
    return F.coalesce((kind_of(v, path) == "BIGINT") & (F.try_variant_get(v, path, "bigint") >= least), F.lit(False))


def iso_time(c: Column) -> Column:
    """A time with its zone, as UTC; null for anything else: no date alone, no time without zone, no day that isn't."""
    zone = F.regexp_extract(c, r"(Z|[+-]\d{2}:\d{2})$", 1)
    local = F.try_to_timestamp(F.concat(F.regexp_extract(c, r"^(.{19}(?:\.\d{1,6})?)", 1), F.lit("Z")))
    minutes = F.when(zone == "Z", F.lit(0).cast("long")).otherwise(F.substring(zone, 2, 2).try_cast("long") * 60 + F.substring(zone, 5, 2).try_cast("long"))
    micros = F.unix_micros(local) - F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * minutes * 60_000_000
    inside = micros.between(-62135596800000000, 253402300799999999)  # the years 1 to 9999
    return F.when(c.rlike(V.ISO_TIME) & (minutes < 1440) & (F.substring(c, 1, 4) != "0000") & inside, F.timestamp_micros(micros))


def epoch(c: Column) -> Column:
    """Seconds since 1970 of a number or a time in lenient form (with or without zone, UTC then, or a date); null otherwise."""
    text = F.trim(c)
    number = text.try_cast("double")
    return F.coalesce(F.when(text.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?$"), number), F.unix_micros(F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text))) / 1e6)


def time_at(path: str) -> Column:
    """The time at a path of a request, from the column that ``judged`` makes of it; null for anything but a text with a time."""
    return F.col(f"`_time {path}`")


def optional_time(v: Column, path: str) -> Column:
    return absent(v, path) | time_at(path).isNotNull()


def optional_text(v: Column, path: str) -> Column:
    return absent(v, path) | is_text(v, path)


def one_of(v: Column, path: str, values: tuple[str, ...], default: bool = True) -> Column:
    own = F.coalesce((kind_of(v, path) == "STRING") & text_at(v, path).isin(*values), F.lit(False))
    return (absent(v, path) | own) if default else own


def items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def bad_item(path: str, test: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda v: F.exists(items(v, path), lambda m: ~test(m))


def time_order(v: Column, first: str, last: str) -> Column:
    """The first time isn't after the last; true where one is absent or no time."""
    return F.coalesce(time_at(first) <= time_at(last), F.lit(True))


def needed(names: list[str], ok: Callable[[Column, str], Column]) -> list[Rule]:
    return [(n, lambda v, n=n: ~ok(v, f"$.{n}")) for n in names]


#: For each kind of request: what may be wrong, and when it is.
RULES: dict[str, list[Rule]] = {
    "add": [
        *needed(["request_id", "user_id", "session_id"], is_text),
        ("messages", lambda v: (kind_of(v, "$.messages") != "ARRAY") | kind_of(v, "$.messages").isNull() | (F.size(items(v, "$.messages")) == 0)),
        ("message", bad_item("$.messages", lambda m: F.coalesce(kind_of(m) == "OBJECT", F.lit(False)))),
        ("role", bad_item("$.messages", lambda m: is_text(m, "$.role"))),
        ("content", bad_item("$.messages", lambda m: is_text(m, "$.content"))),
        ("timestamp", bad_item("$.messages", lambda m: absent(m, "$.timestamp") | is_count(m, "$.timestamp"))),
    ],
    "search": [
        *needed(["query", "user_id"], is_text),
        ("top_k", lambda v: ~is_count(v, "$.top_k", 1)),
        ("options", lambda v: ~absent(v, "$.options") & (F.coalesce(kind_of(v, "$.options") != "ARRAY", F.lit(True)) | F.exists(items(v, "$.options"), lambda o: F.coalesce(kind_of(o) != "STRING", F.lit(True))))),
    ],
    "capture": [
        *needed(["content"], is_text),
        ("tier", lambda v: ~one_of(v, "$.tier", V.TIERS)),
        ("testimony", lambda v: F.coalesce(text_at(v, "$.tier") == "testimony", F.lit(False))),
        ("material_type", lambda v: ~one_of(v, "$.material_type", V.MATERIAL_TYPES)),
        *needed(["origin_id", "session_id"], optional_text),
        ("event_at", lambda v: ~optional_time(v, "$.event_at")),
        ("session_position", lambda v: ~absent(v, "$.session_position") & ~(is_count(v, "$.session_position") & is_text(v, "$.session_id"))),
    ],
    "claim": [
        *needed(["content", "reason"], is_text),
        ("kind", lambda v: ~one_of(v, "$.kind", V.CLAIM_KINDS, False)),
        *needed(["statement_at", "valid_from", "valid_until"], optional_time),
        ("valid_order", lambda v: ~time_order(v, "$.valid_from", "$.valid_until")),
    ],
    "evidence": [
        *needed(["claim_id", "memory_id", "reason"], is_text),
        ("stance", lambda v: ~one_of(v, "$.stance", V.STANCES, False)),
        *needed(["quote", "locator"], optional_text),
    ],
    "range": [
        ("limit", lambda v: ~absent(v, "$.limit") & ~is_count(v, "$.limit")),
        *needed(["since", "until"], optional_time),
        ("time_order", lambda v: ~time_order(v, "$.since", "$.until")),
    ],
}


#: Where times are in requests of each kind.
TIMES = {"capture": ["$.event_at"], "claim": ["$.statement_at", "$.valid_from", "$.valid_until"], "range": ["$.since", "$.until"]}


def reasons(v: Column, kind: str) -> Column:
    """All that is wrong with a request that was parsed; empty if nothing is.  Text that is no JSON object is ``malformed`` alone."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad(v), F.lit(False)), F.lit(name)) for name, bad in RULES[kind])))
    return F.when(F.coalesce(kind_of(v) == "OBJECT", F.lit(False)), found).otherwise(F.array(F.lit("malformed")))


def judged(requests: DataFrame, value: str = "value", kind: str = "kind") -> DataFrame:
    """Requests (kind, value) with ``reasons``; a kind without rules is ``unknown_kind``.

    The text is parsed in a step of its own, once: within the rules, each look at a request would parse it again.  So are its times, taken
    out in one more step: a time's test looks at its text many times."""
    each = F.coalesce(*(F.when(F.col(kind) == k, reasons(F.col("_parsed"), k)) for k in RULES), F.array(F.lit("unknown_kind")))
    parsed = requests.withColumn("_parsed", F.try_parse_json(F.col(value)))
    of = {path: [k for k, paths in TIMES.items() if path in paths] for paths in TIMES.values() for path in paths}
    texts = parsed.withColumns({f"_time {path}": F.when(F.col(kind).isin(*kinds), text_at(F.col("_parsed"), path)) for path, kinds in of.items()})
    times = texts.withColumns({f"_time {path}": iso_time(time_at(path)) for path in of})
    return times.withColumn("reasons", each).drop("_parsed", *(f"_time {path}" for path in of))


def split(requests: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests, written in one pass to two folders of one table."""
    judged(requests).withColumn("accepted", F.size("reasons") == 0).write.mode("append").partitionBy("accepted").parquet(path)
    rows = requests.sparkSession.read.schema(judged(requests).schema.add("accepted", "boolean")).parquet(path)
    return rows.where("accepted").drop("accepted", "reasons"), rows.where("not accepted").drop("accepted")
