"""Text and presentation functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extension to language. Names without one of these have none.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "json": "json", "go": "go", "py": "python",
    "rb": "ruby", "php": "php", "java": "java", "c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "rs": "rust", "kt": "kotlin", "swift": "swift",
    "dart": "dart", "sql": "sql", "sh": "bash", "bash": "bash", "zsh": "bash", "ps1": "powershell", "psm1": "powershell", "less": "less", "lua": "lua", "yml": "yaml", "yaml": "yaml",
    "toml": "toml", "proto": "protobuf", "gradle": "groovy", "mm": "objectivec", "pl": "perl", "h": "cpp", "ini": "ini", "cfg": "ini", "conf": "ini", "md": "markdown",
    "markdown": "markdown", "html": "xml", "htm": "xml", "xml": "xml", "svg": "xml", "css": "css", "scss": "scss", "sass": "scss", "diff": "diff",
}
#: Languages that are shown by another one, and those that cannot be shown.
SHOWN_AS, NOT_SHOWN = {"toml": "ini"}, ("dart", "markdown")


def is_binary(payload: Column) -> Column:
    """A NUL or a control byte other than tab, newline and return among the first 8192 bytes."""
    return F.coalesce(F.decode(F.substring(payload, 1, 8192), "ISO-8859-1").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), F.lit(False))


def to_text(payload: Column) -> Column:
    """Text of a payload by its byte-order mark, else UTF-8; null if it is neither."""
    mark = F.hex(F.substring(payload, 1, 3))
    return (
        F.when(mark == "EFBBBF", F.decode(F.substring(payload, 4, 2147483647), "UTF-8"))
        .when(mark.startswith("FFFE"), F.decode(F.substring(payload, 3, 2147483647), "UTF-16LE"))
        .when(mark.startswith("FEFF"), F.decode(F.substring(payload, 3, 2147483647), "UTF-16BE"))
        .when(F.is_valid_utf8(payload.cast("string")), F.decode(payload, "UTF-8"))
    )


def line_count(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\r?\n", -1))).cast("long")


def first_line(text: Column) -> Column:
    return F.split(text, "\r?\n", 2)[0]


def format_size(n: Column) -> Column:
    kb, mb = 1024, 1024 * 1024
    tenth = lambda unit: F.format_string("%.1f", F.floor(n * 10 / unit + 0.5) / 10)
    return F.when(n < kb, F.concat(n.cast("string"), F.lit(" bytes"))).when(n < mb, F.concat(tenth(kb), F.lit(" KB"))).otherwise(F.concat(tenth(mb), F.lit(" MB")))


def format_when(epoch: Column, zone: Column) -> Column:
    """UTC time, with the original zone in parentheses."""
    return F.concat(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC ("), zone, F.lit(")"))


def ago(seconds: Column) -> Column:
    """The largest whole unit: days, hours, minutes or seconds."""
    part = lambda size, unit: F.concat(F.floor(seconds / size).cast("string"), F.lit(unit))
    return F.when(seconds >= 86400, part(86400, "d")).when(seconds >= 3600, part(3600, "h")).when(seconds >= 60, part(60, "m")).otherwise(part(1, "s"))


def percent(done: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0)).otherwise(F.floor(100 * done / total + 0.5)).cast("long")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def language(name: Column, line: Column) -> Column:
    """By the name or its extension, else by a shebang line."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    low = F.lower(name)
    by_name = F.when(low == "makefile", "makefile").when((low == "dockerfile") | low.endswith("/dockerfile"), "dockerfile").when(low.contains("."), F.try_element_at(table, F.substring_index(low, ".", -1)))
    bang = F.lower(F.when(line.startswith("#!"), line))
    has = lambda *words: F.greatest(*(bang.contains(w) for w in words)) if len(words) > 1 else bang.contains(words[0])
    return F.coalesce(by_name, F.when(has("python"), "python").when(has("node", "deno"), "javascript").when(has("sh"), "bash").when(has("ruby"), "ruby"))


def shown_language(language: Column) -> Column:
    """The language that a page of this one is highlighted with; null for none."""
    for own, other in SHOWN_AS.items():
        language = F.when(language == own, other).otherwise(language)
    return F.when(~language.isin(*NOT_SHOWN), language)


def short_name(name: Column) -> Column:
    return F.when(F.length(name) > 30, F.concat(F.substring(name, 1, 27), F.lit("..."))).otherwise(name)


def path_parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def parent_path(path: Column) -> Column:
    parts = path_parts(path)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def breadcrumbs(path: Column) -> Column:
    """Every prefix of a path."""
    parts = path_parts(path)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
