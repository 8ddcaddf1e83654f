"""Text columns: normalising, cascades, path parts, and what scene-recording manifests hide in file names (STR01-17)."""

from __future__ import annotations

from functools import reduce
from urllib.parse import parse_qsl

from pyspark.sql import Column
from pyspark.sql import functions as F

# The scene classes in label order, and the recording devices by kind.
SCENES = ("airport", "shopping_mall", "metro_station", "street_pedestrian", "public_square", "street_traffic", "tram", "bus", "metro", "park")
REAL_DEVICES = ("A", "B", "C", "D")
SIMULATED_DEVICES = ("S1", "S2", "S3", "S4", "S5", "S6", "S7", "S8", "S9", "S10")
TRAINING_DEVICES = ("A", "B", "C", "S1", "S2", "S3")
MISSING_WORDS = ("", "none", "null", "nan", "n/a", "na")

#: What separates the parts of a file name.
SEPARATOR = r"[._\-/]"


def text(value: Column) -> Column:
    """STR01: trimmed; words that mean "missing" become null."""
    trimmed = F.regexp_replace(value.cast("string"), r"^\s+|\s+$", "")
    return F.when(~F.lower(trimmed).isin(*MISSING_WORDS), trimmed)


def first_present(columns: list[str], *keys: str) -> Column:
    """STR02: the first key that has a value; a key matches its own column, else one that differs in case only."""
    by_lower = {}
    for c in columns:
        by_lower[c.lower()] = c
    found = [k if k in columns else by_lower.get(k.lower()) for k in keys]
    return F.coalesce(*[text(F.col(f"`{c}`")) for c in found if c] or [F.lit(None).cast("string")])


def basename(path: Column) -> Column:
    """STR09: what follows the last slash or backslash."""
    return F.regexp_replace(path, r"^.*[\\/]", "")


def posix_name(path: Column) -> Column:
    """STR03: the last part of a path, trailing slashes left out."""
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def stem_tokens(name: Column) -> Column:
    """STR03: the parts of a file name's stem that are not empty."""
    return F.coalesce(F.filter(F.split(stem(name), f"{SEPARATOR}+"), lambda t: t != ""), F.array().cast("array<string>"))


def device_code(value: Column) -> Column:
    """STR04: a device name in its normal form, or null for what is none."""
    name = F.trim(stem(posix_name(value)))
    upper = F.upper(name)
    return F.when(F.lower(name) == "unknown", F.lit("unknown")).when(upper.isin(*REAL_DEVICES, *SIMULATED_DEVICES), upper)


def device_in_name(name: Column) -> Column:
    """STR04: the last device that stands between separators in a file name."""
    # each separator may end one part and start the next: doubled, so that matches need not share one
    parts = F.regexp_extract_all(F.regexp_replace(name, f"({SEPARATOR})", "$1$1"), F.lit(rf"(?i)(?:^|{SEPARATOR})(unknown|s10|s[1-9]|[abcd])(?:$|{SEPARATOR})"), F.lit(1))
    return device_code(F.when(F.size(parts) > 0, F.element_at(parts, -1)))


def device(given: Column, name: Column, split: Column) -> Column:
    """STR04: device of a record; on the evaluation split an unknown one is allowed, elsewhere it is an error."""
    missing = F.when(split == "eval", F.lit("unknown")).otherwise(F.raise_error(F.lit("no device can be read from the record")).cast("string"))
    return F.coalesce(device_code(given), device_in_name(name), missing)


def scene_of_label(label: Column) -> Column:
    """STR05: a class by name (spaces and dashes as underscores) or by its number."""
    name = F.regexp_replace(F.lower(label), "[- ]", "_")
    number = F.try_element_at(F.array(*map(F.lit, SCENES)), F.when(name.rlike(r"^[0-9]{1,9}$"), name.cast("int") + 1))
    return F.when(name.isin(*SCENES), name).otherwise(number)


def scene_in_name(name: Column) -> Column:
    """STR05: the first class, in class order, that stands between separators in the stem."""
    low = F.lower(stem(name))
    hit = lambda s: low.rlike(f"(?:^|{SEPARATOR}){s.replace('_', SEPARATOR)}(?:$|{SEPARATOR})")
    return reduce(lambda found, s: F.coalesce(found, F.when(hit(s), F.lit(s))), SCENES, F.lit(None).cast("string"))


def scene(label: Column, name: Column) -> Column:
    return F.coalesce(scene_of_label(label), scene_in_name(name))


def _words_of(scene_label: Column) -> Column:
    return F.split(scene_label, "_")


def city_in_name(name: Column, scene_label: Column) -> Column:
    """STR06: the part after the scene's words, unless it is a device or a number."""
    tokens, words = stem_tokens(name), _words_of(scene_label)
    head = F.transform(F.slice(tokens, 1, F.size(words)), F.lower)
    rest = F.when(head == words, F.slice(tokens, F.size(words) + 1, F.greatest(F.size(tokens), F.lit(1)))).otherwise(tokens)
    first = F.get(rest, F.lit(0))
    return F.when(scene_label.isNotNull() & device_code(first).isNull() & ~first.rlike("^[0-9]+$"), first)


def location_in_name(name: Column, scene_label: Column) -> Column:
    """STR06: the part after the city's place, unless it is a device."""
    part = F.get(stem_tokens(name), F.size(_words_of(scene_label)) + 1)
    return F.when(scene_label.isNotNull() & device_code(part).isNull(), part)


def _without_device(name: Column) -> Column:
    tokens = stem_tokens(name)
    ends = (F.size(tokens) > 0) & device_code(F.get(tokens, F.size(tokens) - 1)).isNotNull()
    return F.when(ends, F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def _last(tokens: Column) -> Column:
    return F.get(tokens, F.size(tokens) - 1)


def segment_in_name(name: Column) -> Column:
    """STR06: the number that ends the stem, before any device."""
    last = _last(_without_device(name))
    return F.when(last.rlike("^[0-9]+$"), last)


def recording_in_name(name: Column, segment: Column) -> Column:
    """STR06: what is left of the stem without device and segment, joined by dashes."""
    tokens = _without_device(name)
    ends = _last(tokens).eqNullSafe(segment) & segment.isNotNull() | F.coalesce(_last(tokens).rlike("^[0-9]+$"), F.lit(False))
    left = F.when(ends, F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    return F.when(F.size(left) > 0, F.array_join(left, "-"))


def scene_id(scene_label: Column) -> Column:
    """STR07: place among the classes, -1 where there is none."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SCENES)), scene_label) - 1, F.lit(-1)).cast("long")


def device_type(code: Column) -> Column:
    """STR08"""
    return F.when(code.isin(*REAL_DEVICES), "real").when(code.isin(*SIMULATED_DEVICES), "simulated").otherwise("unknown")


def is_training_device(code: Column) -> Column:
    """STR08"""
    return F.coalesce(code.isin(*TRAINING_DEVICES), F.lit(False))


def source_name(spec: str, prefix: str, known: tuple[str, ...] = ()) -> tuple[str, dict[str, str]]:
    """STR10: ``prefix:name?key=value`` -> name and options; unknown and repeated keys are errors."""
    if not spec.startswith(f"{prefix}:"):
        raise ValueError(f"{spec!r} does not start with {prefix}:")
    name, _, query = spec.removeprefix(f"{prefix}:").partition("?")
    pairs = parse_qsl(query, keep_blank_values=True, strict_parsing=bool(query))
    options = dict(pairs)
    if not name or len(options) != len(pairs) or set(options) - set(known):
        raise ValueError(f"{spec!r}: an empty name, or options that are repeated or none of {known}")
    return name, options


def yes_or_no(word: str) -> bool:
    """STR10: words for true and false; anything else is an error."""
    try:
        return {"1": True, "true": True, "yes": True, "0": False, "false": False, "no": False}[word.lower()]
    except KeyError:
        raise ValueError(f"{word!r} is not a boolean") from None


def query_option(url: Column, key: str) -> Column:
    """STR10 for a column."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def looks_int(value: Column) -> Column:
    """STR11: an optionally signed integer with white space around; digits may be grouped by single underscores."""
    return F.coalesce(value.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), F.lit(False))


def first_filled(*values: Column, default: str = "") -> Column:
    """STR12: the first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(default))


def float_or(value: Column, default: float = 0.0) -> Column:
    """STR13: a 32-bit number; null and empty give the default."""
    return F.coalesce(F.nullif(value, F.lit("")).cast("float"), F.lit(default).cast("float"))


def has_offset_time(value: Column) -> Column:
    """STR14: an ISO-8601 time that states its offset."""
    return F.coalesce(value.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp(value).isNotNull(), F.lit(False))


def parent_name(path: Column) -> Column:
    """STR15: the directory that holds a file, for either kind of slash."""
    return F.element_at(F.split(path, r"[\\/]"), -2)


def archive_stem(name: Column) -> Column:
    """STR16: without a packed-tar suffix, else without the last one."""
    return F.when(F.lower(name).rlike(r"\.tar\.(gz|bz2|xz)$"), F.regexp_replace(name, r"(?i)\.tar\.(gz|bz2|xz)$", "")).otherwise(stem(name))


def is_safe_member(name: Column) -> Column:
    """STR17: neither absolute, nor with a drive, a backslash or a step upwards."""
    bad = name.rlike(r"^/|\\|^[A-Za-z]:|(^|/)\.\.(/|$)") | (name == "")
    return F.coalesce(~bad, F.lit(False))
