"""Scalar functions on paths, source text and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of paths whose nodes hold data alone and get no embedding (fixed values).
SKIP_EMBED = ["/dto/", "/entity/", "/constant/", "/constants/", "/proxy/request/", "/proxy/response/", "/proxy/requests/", "/proxy/responses/", "/request/", "/response/"]
#: Files of configuration (fixed values).
CONFIG_EXTENSIONS = [".json", ".yaml", ".yml", ".toml", ".ini", ".properties", ".xml"]
CONFIG_FILENAMES = ["dockerfile", "compose.yml", "compose.yaml", "codeowners"]
SOURCE_LINES = 100
FIRST_LINE = 500
TEXT_CAP = 512


#: What a body's constants, string literals and getters look like (fixed values).
CONSTANT = r"\bAdapterConstants\.\w+|getConfigurationItem\([^)]+\)"
CONSTANT_WRAPPER = r"getConfigurationItem\(|AdapterConstants\.|\)"
LITERAL = r'"([^"\\]{8,100})"'
NOT_READABLE = r"^https?://|^\$\{|^[A-Z_]{6,}$"
GETTER = r"\.get[A-Z][a-zA-Z]{2,}\(\)"
GETTER_WRAPPER = r"^\.|get|\(\)"


def trim_all(x: Column) -> Column:
    """Without any white space at the ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def content_hash(x: Column) -> Column:
    return F.substring(F.sha1(x.cast("binary")), 1, 12)


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the last segment, unless that begins it; '' for none."""
    return F.regexp_extract(base_name(path), r"[^.].*?(\.[^.]*)$", 1)


def is_configuration(path: Column) -> Column:
    return F.lower(extension(path)).isin(CONFIG_EXTENSIONS) | F.lower(base_name(path)).isin(CONFIG_FILENAMES)


def should_embed(kind: Column, path: Column) -> Column:
    return (kind != "FILE") & ~F.lower(path).rlike("|".join(SKIP_EMBED))


def span_source(text: Column, start: Column, end: Column) -> Column:
    """The lines of a node, at most SOURCE_LINES."""
    return F.array_join(F.slice(F.split(text, "\n", -1), start, F.greatest(F.lit(0), F.least(end - start + 1, F.lit(SOURCE_LINES)))), "\n")


def first_line(text: Column, start: Column) -> Column:
    line = F.try_element_at(F.split(text, "\n", -1), start.cast("int"))
    return F.substring(trim_all(F.coalesce(line, F.lit(""))), 1, FIRST_LINE)


def location(path: Column) -> Column:
    """The last two segments of a path, without the last extension."""
    parts = F.split(normal_path(path), "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.\w+$", "")
    above = F.try_element_at(parts, F.lit(-2))
    return F.when(F.coalesce(above, F.lit("")) != "", F.concat(above, F.lit("/"), name)).otherwise(name)


def config_constants(body: Column) -> Column:
    """Up to four names of configuration constants that a body reads."""
    found = F.regexp_extract_all(body, F.lit(CONSTANT), F.lit(0))
    bare = F.transform(found, lambda m: trim_all(F.regexp_replace(m, CONSTANT_WRAPPER, "")))
    return F.slice(F.filter(bare, lambda m: m != ""), 1, 4)


def key_strings(body: Column) -> Column:
    """Up to three readable string literals of 8 to 100 characters: with three letters in a row, no URL, no template, no constant's name."""
    found = F.transform(F.regexp_extract_all(body, F.lit(LITERAL), F.lit(1)), trim_all)
    return F.slice(F.filter(found, lambda s: s.rlike("[A-Za-z]{3}") & ~s.rlike(NOT_READABLE)), 1, 3)


def getter_names(body: Column) -> Column:
    """Up to four names of getters; every 'get' in them goes, not the first alone."""
    found = F.regexp_extract_all(body, F.lit(GETTER), F.lit(0))
    return F.slice(F.transform(found, lambda m: F.regexp_replace(m, GETTER_WRAPPER, "")), 1, 4)


def node_text(kind: Column, name: Column, path: Column, signature: Column, body: Column) -> Column:
    """What is embedded of a node."""
    body = F.coalesce(body, F.lit(""))
    constants = F.array_join(config_constants(body), " ")
    extras = F.array_join(F.filter(F.array(F.when(constants != "", F.concat(F.lit("config:"), constants)).otherwise(""), F.array_join(key_strings(body), " "), F.array_join(getter_names(body), " ")), lambda x: x != ""), " ")
    content = F.substring(F.concat(trim_all(F.coalesce(signature, name)), F.when(extras != "", F.concat(F.lit(" "), extras)).otherwise("")), 1, TEXT_CAP)
    where = F.when(content != "", F.concat(location(path), F.lit(": "), content)).otherwise(path)
    return F.concat(kind, F.lit(" "), name, F.lit(" in "), where)


def extensions_option(value: str) -> list[str]:
    """'ts, .js' as ['.ts', '.js']; case stays as it is."""
    parts = [p.strip() for p in value.split(",")]
    return [p if p.startswith(".") else f".{p}" for p in parts if p]
