"""Column functions: hashing, JSON, paths, text and vectors. Built-ins only."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z alone, as bytes are lowered."""
    return F.translate(text, _UPPER, _LOWER)


def glob_match(text: Column, pattern: str) -> Column:
    """Case-sensitive file-name match in which `*` crosses `/`."""
    return text.rlike(fnmatch.translate(pattern).replace(r"\Z", r"\z"))


def glob_to_regex(pattern: Column) -> Column:
    """The regular expression of a glob that is a column: `*` and `?` only, all else literal."""
    quoted = F.regexp_replace(pattern, r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("(?s)^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(r"\z"))


def full_match(text: Column, pattern: str, cap: int) -> Column:
    """Whole-string match after a length cap (P25)."""
    return F.coalesce((F.char_length(text) <= cap) & text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def content_hash(data: Column) -> Column:
    """SHA-256 stands for the 256-bit content hash (H1, H3)."""
    return F.sha2(data, 256)


def fingerprint(data: Column) -> Column:
    """First eight hex digits of the content hash."""
    return F.left(F.sha2(data, 256), F.lit(8))


def identity_hash(*parts: Column) -> Column:
    """SHA-256 of the number of parts as a byte and the parts with unit separators between."""
    sep = F.lit(chr(31))
    joined: list[Column] = []
    for i, p in enumerate(parts):
        joined += [p] if i == 0 else [sep, p]
    return F.sha2(F.concat(F.unhex(F.lit(f"{len(parts):02x}")), F.encode(F.concat(*joined), "UTF-8")), 256)


def checked_identity_hash(*parts: Column) -> Column:
    """As identity_hash; null if a part holds the separator (H5)."""
    bad = F.lit(False)
    for p in parts:
        bad = bad | F.contains(p, F.lit(chr(31)))
    return F.when(~bad, identity_hash(*parts))


def canonical_json_map(m: Column) -> Column:
    """JSON of a map with sorted keys and no white space."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column, tolerance: float = 1e-6) -> Column:
    """Unit vector; as it is if its norm is within tolerance of 1; null for zero or infinite norms (H8)."""
    n = l2_norm(v)
    doubles = F.transform(v, lambda x: x.cast("double"))
    return F.when(F.abs(n - 1) <= tolerance, doubles).when((n > 0) & (n < float("inf")), F.transform(doubles, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, clamped to -1 to 1 (H9)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))


def band(score: Column, high: float = 0.85, medium: float = 0.65) -> Column:
    """high, medium or low; both floors belong to the upper band."""
    if not 0 <= medium < high <= 1:
        raise ValueError(f"floors {medium} and {high} aren't ascending in 0 to 1")
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def vector_ok(v: Column, dim: int | Column) -> Column:
    """Whether a vector has the dimension and no null or NaN."""
    return (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def aware_timestamp(text: Column) -> Column:
    """Timestamp of ISO text with an offset; null for naive or unparsable text."""
    return F.when(text.rlike(r"(?:Z|[+-]\d{2}:?\d{2})\z"), F.try_to_timestamp(text))


def age_days(now: Column, then: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / 86400


def older_than(now: Column, then: Column, days: int) -> Column:
    """Whether at least `days` days have passed."""
    return age_days(now, then) >= days


def record_id(fields: dict[str, Column]) -> Column:
    """Hash of the canonical JSON of identity fields: keys sorted, nulls written (H6)."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def case_digest(fields: dict[str, Column]) -> Column:
    """Hash of a record's JSON in field order, with its algorithm."""
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"}), 256))


def package_id(text: Column) -> Column:
    """Whether a text is `name@version` of an npm package, ASCII (P25); the last `@` divides it."""
    name, version = F.regexp_extract(text, r"(?s)\A(.+)@([^@]*)\z", 1), F.regexp_extract(text, r"(?s)\A(.+)@([^@]*)\z", 2)
    return full_match(name, r"(?:@[a-z0-9\-_.]+/)?[a-z0-9\-_.]+", 214) & full_match(version, r"[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.+-]+)?", 128)


def registry_url(text: Column) -> Column:
    """Whether a text is an https URL of a registry: a host, perhaps a port and a path, and nothing else (P25)."""
    host = F.regexp_extract(text, r"(?s)\Ahttps://([^/:]*)", 1)
    shape = text.rlike(r"(?s)\Ahttps://[^/:@?#]+(?::[0-9]+)?(?:/[^?#]*)?\z") & text.rlike(r"\A[\x00-\x7F]*\z") & (F.char_length(text) <= 2048)
    return shape & full_match(host, r"[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)*", 253)


def image_ref(text: Column) -> Column:
    """Whether a text can name an image: no white space or controls, at most one colon, nothing empty beside it (P25)."""
    return full_match(text, r"(?U:[^\s\x00-\x1F\x7F:]+(?::[^\s\x00-\x1F\x7F:]+)?)", 256)


def utc_day(ts: Column) -> Column:
    """Directory name of a UTC day (H14); the session's zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd")


def in_unit_range(x: Column) -> Column:
    """Between 0 and 1 and not NaN."""
    return F.coalesce(~F.isnan(x) & x.between(0.0, 1.0), F.lit(False))


def utf8_truncated(text: Column, cap: int) -> Column:
    """The longest prefix of at most `cap` UTF-8 bytes that splits no code point."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.left(raw, F.lit(cap - i)).cast("string")) for i in range(min(4, cap + 1))]
    return F.when(F.octet_length(text) <= cap, text).otherwise(F.coalesce(*cuts))


def utf8_over(text: Column, cap: int) -> Column:
    """Whether the cap took effect: strictly more bytes."""
    return F.octet_length(text) > cap


def soft_truncated(text: Column, budget: int) -> Column:
    """JSON wrapper with a prefix where a payload is over budget, else the payload."""
    wrapped = F.to_json(F.struct(F.lit(True).alias("truncated"), F.octet_length(text).alias("original_bytes"), utf8_truncated(text, budget).alias("prefix")))
    return F.when(F.octet_length(text) > budget, wrapped).otherwise(text)


def path_scrubbed(text: Column, root: str) -> Column:
    """Repository root, user and home prefixes removed; the root's alternative is first."""
    quoted = "".join(c if c.isalnum() or c in "/_-" else "\\" + c for c in root)
    return F.regexp_replace(text, rf"(?:{quoted}/?)|(?:/Users/[^/]+/)|(?:/home/[^/]+/)|(?:/root/)", "")


def safe_relative_path(path: Column) -> Column:
    """Not empty, absolute, or with NUL, backslash or a `..` segment."""
    return (
        (path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\0")) & ~F.contains(path, F.lit("\\"))
        & ~F.array_contains(F.split(path, "/"), "..")
    )


def forbidden_characters(text: Column) -> Column:
    """NUL, C0 controls except tab, line feed and carriage return, or bidirectional controls (F32)."""
    return text.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\u202A-\\u202E\\u2066-\\u2069]")


def diff_issue(diff: Column, files: Column, cap: int = 64 * 1024) -> Column:
    """First failing check of a unified diff, null if none."""
    paths = F.regexp_extract_all(diff, F.lit(r"(?m)^(?:--- a/|\+\+\+ b/)(.+)$"), F.lit(1))
    return (
        F.when(F.trim(diff) == "", "empty").when(F.contains(diff, F.lit("\r")), "crlf").when(F.octet_length(diff) > cap, "too_large")
        .when(diff.rlike(r"(?m)^--- /dev/null"), "creates_file").when(~diff.rlike(r"(?m)^(?:\+(?!\+\+)|-(?!--))"), "no_change")
        .when(F.size(F.array_except(paths, files)) > 0, "undeclared_path")
    )


def lock_line(line: Column) -> Column:
    """(digest, path) of a `hex64  path` line, null if malformed."""
    digest, path = F.regexp_extract(line, r"\A([0-9a-f]{64})  (.+)\z", 1), F.regexp_extract(line, r"\A([0-9a-f]{64})  (.+)\z", 2)
    return F.when(digest != "", F.struct(digest.alias("digest"), path.alias("path")))


def tsc_errors(text: Column) -> Column:
    """Errors of a compiler's summary line, null without one."""
    return F.regexp_extract(text, r"Found (\d+) errors? in", 1).try_cast("int")


def engine_at_least(spec: Column, major: int) -> Column:
    """Whether an engines range starts with >=, ^ or ~ and a major version of at least `major`."""
    return F.coalesce(F.regexp_extract(spec, r"^\s*(?:>=|[\^~])\s*(\d+)", 1).try_cast("int") >= major, F.lit(False))


def bare_version(text: Column) -> Column:
    return F.regexp_replace(text, r"\A[vV]", "")


def values_env(name: Column) -> Column:
    """(env, recognised) of a values file; its stem where the name is another."""
    stem = F.regexp_replace(name, r"\.ya?ml\z", "")
    env = F.regexp_extract(stem, r"(?s)\Avalues-(.+)\z", 1)
    return F.struct(F.when(env != "", env).otherwise(stem).alias("env"), (env != "").alias("recognised"))


def package_of_lock_key(key: Column) -> Column:
    """Package name of an npm v3, pnpm v6/v9 or yarn key (F16)."""
    npm = F.element_at(F.split(key, "node_modules/"), -1)
    rest = F.regexp_replace(key, r"\A/", "")
    named = F.regexp_extract(rest, r"\A(@[^/@]+/[^/@]+|[^/@(]+)", 1)
    return F.when(F.contains(key, F.lit("node_modules/")), npm).otherwise(named)


def kv_pairs(payload: Column) -> Column:
    """Map of NAME=value pairs, quoted or bare; else the legacy single pair `NAME value` (M6)."""
    pair = r'([A-Za-z_][\w.]*)=(?:"((?:[^"\\]|\\.)*)"|(\S+))'
    names = F.regexp_extract_all(payload, F.lit(pair), F.lit(1))
    quoted, bare = F.regexp_extract_all(payload, F.lit(pair), F.lit(2)), F.regexp_extract_all(payload, F.lit(pair), F.lit(3))
    values = F.zip_with(quoted, bare, lambda q, b: F.when(F.coalesce(q, F.lit("")) != "", q).otherwise(F.coalesce(b, F.lit(""))))
    entries = F.zip_with(names, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    last = F.aggregate(
        entries, F.array().cast("array<struct<key:string,value:string>>"),
        lambda acc, e: F.array_append(F.filter(acc, lambda x: x["key"] != e["key"]), e),
    )
    head, tail = F.split(payload, " ", 2)[0], F.trim(F.coalesce(F.get(F.split(payload, " ", 2), 1), F.lit("")))
    legacy = F.when((head != "") & (tail != ""), F.map_from_arrays(F.array(head), F.array(tail))).otherwise(F.create_map().cast("map<string,string>"))
    return F.when(F.size(names) > 0, F.map_from_entries(last)).otherwise(legacy)


def exec_form(payload: Column) -> Column:
    """(form, argv, command): exec for a JSON array of strings, malformed for another array, else shell; null for null (M7)."""
    p = F.trim(payload)
    variant = F.try_parse_json(p)
    argv = F.try_variant_get(variant, "$", "array<string>")
    listed = F.schema_of_variant(variant).isin("ARRAY<STRING>", "ARRAY<VOID>")
    form = F.when(~p.startswith("["), "shell").when(F.coalesce(listed, F.lit(False)), "exec").when(p.isNotNull(), "malformed")
    return F.struct(form.alias("form"), F.when(form == "exec", argv).alias("argv"), F.when(form != "exec", p).alias("command"))


def first_marker(texts: Column, markers: list[str]) -> Column:
    """First marker by marker order that stands in any of the texts (P27, marker first)."""
    def stands(marker: str) -> Column:
        return F.exists(texts, lambda t: F.contains(t, F.lit(marker)))

    return F.coalesce(*[F.when(stands(m), F.lit(m)) for m in markers])


def first_marked_text(texts: Column, markers: list[str]) -> Column:
    """First marker found going through the texts in order (P27, entry first)."""
    found = F.transform(texts, lambda t: F.coalesce(*[F.when(F.contains(t, F.lit(m)), F.lit(m)) for m in markers]))
    return F.get(F.filter(found, lambda m: m.isNotNull()), F.lit(0))
