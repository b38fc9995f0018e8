"""Readers of schema declarations: ``detect(path, text)`` and ``parse(path, text)``, pure and tolerant."""

from __future__ import annotations

from tessera.model import Parsed
from tessera.parsers import dbml, ecto, efcore, engines, go_orms, js_orms, jvm_orms, mappings, php_orms, prisma, python_orms, rails, schema_langs, sql

READERS = {m.KIND: m for m in (sql, dbml, prisma)} | js_orms.READERS | go_orms.READERS | rails.READERS | jvm_orms.READERS | efcore.READERS | ecto.READERS | php_orms.READERS | mappings.READERS | schema_langs.READERS | python_orms.READERS


def parse_file(path: str, text: str, disabled: tuple[str, ...] = ()) -> list[Parsed]:
    """What every reader that claims the file finds in it; an error becomes a warning, never a failure."""
    out = []
    for kind, reader in READERS.items():
        if kind in disabled:
            continue
        try:
            if reader.detect(path, text):
                out.append(reader.parse(path, text))
        except Exception as error:  # noqa: BLE001 - one file must not stop a scan
            out.append(Parsed(path, kind, warnings=[(None, f"{kind} reader failed: {error}")]))
    try:
        if hints := engines.hints(path, text):
            out.append(Parsed(path, "engines", engines=hints))
    except Exception as error:  # noqa: BLE001
        out.append(Parsed(path, "engines", warnings=[(None, f"engine detector failed: {error}")]))
    return [p for p in out if not p.empty()]
