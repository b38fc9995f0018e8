"""Names on the driver and inside parsers: the Python side of ``functions.text``."""

from __future__ import annotations

import re

from tessera.functions.inflect import pluralize, singularize
from tessera.functions.text import WORD

_WORD = re.compile(WORD)


def words(name: str) -> list[str]:
    return _WORD.findall(name)


def snake(name: str) -> str:
    return "_".join(w.lower() for w in words(name))


def pascal(name: str) -> str:
    return "".join(w[:1].upper() + w[1:].lower() for w in words(name))


def camel(name: str) -> str:
    out = pascal(name)
    return out[:1].lower() + out[1:]


def lcfirst_plain(name: str) -> str:
    return name[:1].lower() + name[1:]


def loose(name: str) -> str:
    return re.sub(r"[\s_-]", "", name.lower())


def short(name: str) -> str:
    bare = re.sub(r"<.*$", "", name).strip().strip("\"'`")
    return re.split(r"::|[\\./]", bare)[-1].strip("\"'` ")


def natural(text: str) -> tuple:
    """A sort key that orders runs of digits by value; of equal ones the longer first."""
    return tuple(("0", int(t), -len(t)) if t.isdigit() else (t,) for t in re.findall(r"[0-9]+|[^0-9]+", text))


#: How each technology names the table of a model that names none.
_PLURAL_SNAKE = ("rails", "laravel", "gorm", "ent", "bun")
_SNAKE = ("typeorm", "mikroorm", "jpa", "doctrine")
_LOWER = ("sqlmodel", "peewee", "tortoise")


def default_table(kind: str, model: str, app: str | None = None) -> str:
    model = short(model)
    if kind in _PLURAL_SNAKE:
        return pluralize(snake(model))
    if kind in _SNAKE:
        return snake(model)
    if kind in _LOWER:
        return model.lower()
    if kind == "mongoose":
        return pluralize(model.lower(), documents=True)
    if kind == "sequelize":
        return pluralize(model)
    if kind == "django":
        return f"{app.lower()}_{model.lower()}" if app else model.lower()
    return model


__all__ = ["camel", "default_table", "lcfirst_plain", "loose", "natural", "pascal", "pluralize", "short", "singularize", "snake", "words"]
