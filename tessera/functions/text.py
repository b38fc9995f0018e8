"""Text functions of the metadata model as Spark columns: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.inflect import inflect_column

#: Fixed value: the pattern of one word inside an identifier.
WORD = r"[A-Z]+\d*(?![a-z])|[A-Z]?[a-z]+\d*|\d+"


def words(name: Column) -> Column:
    """Words of an identifier: humps, acronyms, numbers."""
    return F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def snake_case(name: Column) -> Column:
    return F.array_join(F.transform(words(name), F.lower), "_")


def pascal_case(name: Column) -> Column:
    return F.array_join(F.transform(words(name), lambda w: capitalize(F.lower(w))), "")


def camel_case(name: Column) -> Column:
    return lcfirst(pascal_case(name))


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def lcfirst(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def loose(text: Column) -> Column:
    """The key under which spellings of one name meet."""
    return F.lower(F.regexp_replace(text, r"[\s_-]", ""))


def short_name(text: Column) -> Column:
    """Last segment of a qualified name, without quotes and type arguments."""
    bare = F.regexp_replace(F.regexp_replace(text, r"<.*$", ""), r"""^["'`\s]+|["'`\s]+$""", "")
    return F.element_at(F.split(bare, r"::|[\\./]"), -1)


def natural_key(text: Column) -> Column:
    """An array that sorts texts as people number them: runs of digits by value, then by length.

    Numbers of up to 999,999 digits are compared exactly.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))

    def key(run: Column) -> Column:
        bare = F.regexp_replace(run, r"^0+(?=.)", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(bare).cast("string"), 6, "0"), bare, F.lpad((999_999 - F.length(run)).cast("string"), 6, "0"))
        return F.when(run.rlike(r"^\d"), number).otherwise(run)

    return F.transform(runs, key)


def clip(text: Column, most: int) -> Column:
    """Control characters as blanks, and at most ``most`` code points with an ellipsis for the rest."""
    clean = F.regexp_replace(text, r"[\x00-\x1f\x7f]", " ")
    return F.when(F.char_length(clean) > most, F.concat(F.substr(clean, F.lit(1), F.lit(most - 1)), F.lit("…"))).otherwise(clean)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_name(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def clean_comment(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def bool_value(text: Column) -> Column:
    low = F.lower(F.trim(text))
    return F.when(low.isin("true", "yes", "on", "1"), True).when(low.isin("false", "no", "off", "0"), False)


def number_value(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "_", "").try_cast("double")


def enum_summary(values: Column, most: int) -> Column:
    """The first values, and how many more there are."""
    shown = F.array_join(F.slice(values, 1, most), ", ")
    more = F.size(values) - most
    return F.when(more > 0, F.concat(shown, F.lit(", … (+"), more.cast("string"), F.lit(")"))).otherwise(shown)


def markdown_cell(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\|])", r"\\$1"), r"\s*\n\s*", " ")


def relative_path(folder: Column, target: Column, ignore_case: bool = False) -> Column:
    """The way from a folder to a file, both absolute; between two drives there is none and the target stays."""
    a, b = path_segments(folder), path_segments(target)
    folded = (lambda s: F.transform(s, F.lower)) if ignore_case else (lambda s: s)
    pairs = F.zip_with(F.slice(folded(a), 1, F.size(a)), F.slice(folded(b), 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(pairs, F.lit(False)).cast("int")
    shared = F.when(first == 0, F.size(pairs)).otherwise(first - 1)
    ups = F.array_repeat(F.lit(".."), F.size(a) - shared)
    rest = F.slice(b, shared + 1, F.greatest(F.size(b) - shared, F.lit(0)))
    way = F.array_join(F.concat(ups, rest), "/")
    drive = lambda s: F.when(F.get(s, F.lit(0)).rlike("^[a-zA-Z]:$"), F.lower(F.get(s, F.lit(0))))
    return F.when(F.coalesce(drive(a) != drive(b), F.lit(False)), target).when(way == "", F.lit(".")).otherwise(way)


def split_qualified(name: Column) -> Column:
    """Parts of a dotted name, dots in quotes kept and quotes taken off."""
    parts = F.regexp_extract_all(name, F.lit(r'("(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^.\s"`\[]+)'), F.lit(1))
    return F.transform(parts, unquoted)


def unquoted(name: Column) -> Column:
    """A name without its quotes; doubled ones inside are one."""
    inside = F.substr(name, F.lit(2), F.char_length(name) - 2)
    return F.when(name.rlike('^".*"$'), F.replace(inside, F.lit('""'), F.lit('"'))).when(name.rlike("^`.*`$"), F.replace(inside, F.lit("``"), F.lit("`"))).when(name.rlike(r"^\[.*\]$"), inside).otherwise(name)


# How technologies name the table of a model that names none.
PLURAL_SNAKE, SNAKE, LOWER = ("rails", "laravel", "gorm", "ent", "bun"), ("typeorm", "mikroorm", "jpa", "doctrine"), ("sqlmodel", "peewee", "tortoise")


def default_table(kind: Column, model: Column, app: Column | None = None) -> Column:
    """The table of a model by the convention of its technology; ``app`` comes before Django's."""
    name = short_name(model)
    django = F.lower(name) if app is None else F.when(F.coalesce(app, F.lit("")) == "", F.lower(name)).otherwise(F.concat(F.lower(app), F.lit("_"), F.lower(name)))
    out = F.when(kind.isin(*PLURAL_SNAKE), inflect_column(snake_case(name), True)).when(kind.isin(*SNAKE), snake_case(name)).when(kind.isin(*LOWER), F.lower(name))
    out = out.when(kind == "mongoose", inflect_column(F.lower(name), True, documents=True)).when(kind == "sequelize", inflect_column(name, True)).when(kind == "django", django)
    return out.otherwise(name)
