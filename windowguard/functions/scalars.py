"""Scalar functions: names, times, paths, log lines and vectors."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from windowguard import constants as K

WHITESPACE = " \t\n\r\f\v"


def bucket(ms: Column, window_ms: int = K.WINDOW_MS) -> Column:
    """Start of the epoch-aligned window of an epoch-ms value."""
    return (F.floor(ms / F.lit(window_ms)) * F.lit(window_ms)).cast("long")


def iso_to_ms(text: Column) -> Column:
    """ISO-8601 UTC text to epoch ms."""
    return F.unix_millis(F.to_timestamp(text))


def ms_to_iso(ms: Column) -> Column:
    """Epoch ms to ``yyyy-MM-ddTHH:mm:ssZ`` (session time zone UTC)."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def local_to_ms(text: Column, timezone: str) -> Column:
    """Local wall-clock text to epoch ms; text that is no time gives NULL."""
    return F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(text), timezone))


def is_normal(anomaly_type: Column) -> Column:
    return anomaly_type.startswith("Normal")


def anomaly_family(case_name: Column) -> Column:
    return (
        F.when(case_name.startswith("Normal"), "Normal")
        .when(case_name.startswith("Lv_P_"), "Performance")
        .when(case_name.startswith("Lv_S_"), "Service")
        .when(case_name.startswith("Lv_D_"), "Database")
        .when(case_name.startswith("Lv_C_"), "Code")
    )


def service_of_pod(pod: Column) -> Column:
    """Pod name without its replica-set and pod suffix; a name that would become empty stays."""
    return F.coalesce(F.nullif(F.regexp_replace(pod, K.POD_SUFFIX, ""), F.lit("")), pod)


#: Put between the parts of a matched log line; no text has it.
CUT = "\x00\x01\x00"


def log_parts(line: Column, timezone: str) -> Column:
    """Struct (ts_ms, level, content) of a log line; ``ts_ms`` is NULL where the line does not parse.

    One match gives all three parts, and the lambda evaluates it once.
    """
    marked = F.split(F.regexp_replace(line, K.LOG_LINE, f"$1{CUT}$2{CUT}"), CUT, 3)

    def named(parts: Column) -> Column:
        stamp = F.when(F.size(parts) == 3, F.get(parts, F.lit(0)))
        return F.struct(
            local_to_ms(stamp, timezone).alias("ts_ms"),
            F.get(parts, F.lit(1)).alias("level"),
            F.btrim(F.get(parts, F.lit(2)), F.lit(WHITESPACE)).alias("content"),
        )

    return F.get(F.transform(F.array(marked), named), F.lit(0))


def normalize_path(url: Column, known: Iterable[str] = ()) -> Column:
    """Path of a URL with variable segments replaced.

    UUIDs become ``{uuid}``, numbers ``{id}``. Segments in ``known`` and lower, snake or camel
    case words stay, anything else becomes ``{param}``. The word patterns are our reading of
    "snake_case or camelCase".
    """
    path = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(path, r"[?#].*$", "")
    names = list(known)

    def segment(part: Column) -> Column:
        keep = part.rlike(r"^$|^[a-z]+(_[a-z0-9]+)*$|^[a-z]+([A-Z][a-z0-9]*)+$")
        if names:
            keep = keep | part.isin(names)
        return (
            F.when(part.rlike(K.UUID_SEGMENT), "{uuid}")
            .when(part.rlike(r"^[0-9]+$"), "{id}")
            .when(keep, part)
            .otherwise("{param}")
        )

    return F.array_join(F.transform(F.split(path, "/"), segment), "/")


def endpoint_key(method: Column, url: Column, known: Iterable[str] = ()) -> Column:
    return F.concat(F.upper(method), F.lit(":"), normalize_path(url, known))


def metric_label_name(labels: Column) -> Column:
    """Metric name followed by ``&key=value`` for every label that tells series apart."""
    told = F.map_filter(labels, lambda k, v: ~k.isin("group", "instance", "job", "__name__"))
    pairs = F.transform(F.map_entries(told), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    name = F.concat(F.element_at(labels, "__name__"), F.lit("&"), F.array_join(pairs, "&"))
    return F.regexp_replace(name, "&$", "")


def line_type(line: Column) -> Column:
    """First matching line type, else OTHER."""
    result = None
    for name, pattern in K.LINE_TYPES:
        hit = line.rlike(pattern)
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result.otherwise("OTHER")


def base_file_name(name: Column) -> Column:
    """File name without its last ``-`` token."""
    parts = F.split(name, "-")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "-")


def normalize_message(message: Column) -> Column:
    """Lower case with every run of digits as one 0 (each digit to 0, then runs of 0 to one)."""
    return F.regexp_replace(F.lower(message), "[0-9]+", "0")


def words(message: Column) -> Column:
    return F.split(message, " ")


def char_trigrams(message: Column) -> Column:
    """All overlapping runs of three characters (a look-ahead at every place); empty below three."""
    return F.regexp_extract_all(message, F.lit("(?s)(?=(.{3}))"), 1)


def word_trigrams(message: Column) -> Column:
    tokens = words(message)
    space = F.lit(" ")
    pairs = F.zip_with(tokens, F.slice(tokens, F.lit(2), F.size(tokens)), lambda a, b: F.concat(a, space, b))
    triples = F.zip_with(pairs, F.slice(tokens, F.lit(3), F.size(tokens)), lambda a, b: F.concat(a, space, b))
    return F.filter(triples, lambda t: t.isNotNull())


def clip(value: Column, low: float, high: float) -> Column:
    """Value limited to [low, high]; NULL stays NULL (plain ``greatest`` would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def early_concat(vectors: dict[str, Column], order: Iterable[str]) -> Column:
    """One vector from one vector per modality, in the given order."""
    order = list(order)
    if set(vectors) != set(order):
        raise ValueError(f"modalities {sorted(vectors)} must be exactly {sorted(order)}")
    return F.concat(*[vectors[name] for name in order])


def squared_distance(vector: Column, center: Column, dim: int) -> Column:
    """Sum of squared differences over ``dim`` components, written out so that it is compiled."""
    total = None
    for i in range(dim):
        gap = F.get(vector, F.lit(i)).cast("double") - F.get(center, F.lit(i))
        total = gap * gap if total is None else total + gap * gap
    return total


def encode(vector: Column, layers: list[list[list[float]]]) -> Column:
    """Bias-free encoder: matrix product per layer, ReLU after every layer but the last."""

    def product(x: Column, matrix: list[list[float]], last: bool) -> Column:
        weights = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in matrix])

        def unit(row: Column) -> Column:
            terms = F.zip_with(row, x, lambda w, v: w * v)
            dot = F.aggregate(terms, F.lit(0.0), lambda acc, term: acc + term)
            return dot if last else F.greatest(dot, F.lit(0.0))

        return F.transform(weights, unit)

    for depth, matrix in enumerate(layers):
        vector = product(vector, matrix, depth == len(layers) - 1)
    return vector
