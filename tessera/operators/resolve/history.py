"""Ordered replay: files of definitions and of migrations become two states of tables, enums and relations."""

from __future__ import annotations

import copy
import heapq
import re
from collections import defaultdict
from dataclasses import dataclass, field

from tessera.functions.names import loose, natural, short
from tessera.model import DDL_KINDS, KINDS, Column, Index, Op, Parsed, RawEnum, RawRelation, Ref, Source, entity_id, enum_id, normal_schema
from tessera.operators.resolve.prepare import Prepared, Seen, same

MOST_REFS = 12
#: What one definition may tell another that has no value of its own.
FILLED = ("default", "comment", "generated", "is_array", "enum_ref", "source")


@dataclass(eq=False)
class Table:
    name: str
    kind: str
    schema: str | None = None
    columns: list[Column] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    models: list[tuple[str, str, bool]] = field(default_factory=list)  # name, kind, child
    sources: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)
    refs: list[Source] = field(default_factory=list)
    aliases: list[str] = field(default_factory=list)
    created_in: str | None = None
    certain: bool = False
    full: bool = False
    defined: bool = False
    external: bool = False
    join_table: bool = False
    comment: str | None = None
    engine: str | None = None
    group: str | None = None
    primary: Source | None = None
    score: int = -1

    @property
    def key(self) -> str:
        return entity_id(self.kind, self.schema, self.name)

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if same(c.name, name)), None)

    def column_like(self, name: str) -> Column | None:
        """By name, else the only one of like spelling."""
        if exact := self.column(name):
            return exact
        alike = [c for c in self.columns if loose(c.name) == loose(name)]
        return alike[0] if len(alike) == 1 else None

    def add_model(self, name: str, kind: str, child: bool = False) -> None:
        if not any(k == kind and same(n, name) for n, k, _ in self.models):
            self.models.append((name, kind, child))

    def add_index(self, index: Index) -> None:
        if not index.columns:
            return
        for have in self.indexes:
            if like_index(have, index):
                have.name, have.columns, have.unique = index.name or have.name, list(index.columns), index.unique
                return
        self.indexes.append(Index(list(index.columns), index.unique, index.name))

    def primary_key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    def key_columns(self) -> list[str]:
        fallback = self.column("id") or self.column("_id")
        return self.primary_key() or ([fallback.name] if fallback else [])


@dataclass(eq=False)
class Enum:
    name: str
    values: list[str]
    schema: str | None
    sources: list[str]
    source: Source | None
    created_in: str | None

    @property
    def key(self) -> str:
        return enum_id(self.schema, self.name)


@dataclass(eq=False)
class Stored:
    raw: RawRelation
    kind: str
    file: str
    migrated: bool


def like_index(a: Index, b: Index) -> bool:
    return same(a.name, b.name) or (a.unique == b.unique and [c.lower() for c in a.columns] == [c.lower() for c in b.columns])


def append_new(items: list, value) -> None:
    if value not in items:
        items.append(value)


def add_ref(refs: list[Source], ref: Source | None) -> None:
    if ref and len(refs) < MOST_REFS:
        append_new(refs, Source(ref.file, ref.line))


def fill(target: Column, other: Column) -> None:
    """Gaps of ``target`` from ``other``; nullability and keys are never gaps."""
    target.type = target.type or other.type
    for name in FILLED:
        if getattr(target, name) is None:
            setattr(target, name, getattr(other, name))


def replaced(old: Column, new: Column) -> Column:
    out = copy.deepcopy(new)
    fill(out, old)
    return out


class State:
    """Tables, enums and relations after the steps so far; ``migrated`` says whether the latest or the first statement wins."""

    def __init__(self, migrated: bool):
        self.migrated = migrated
        self.tables: dict[str, Table] = {}
        self.enums: dict[str, Enum] = {}
        self.relations: list[Stored] = []
        self.dropped: set[str] = set()

    def find(self, ref: Ref) -> Table | None:
        if ref.name:
            for kind in ("table", "collection"):
                if hit := self.tables.get(entity_id(kind, ref.schema, ref.name)):
                    return hit
            return None if normal_schema(ref.schema) else next((t for t in self.tables.values() if same(t.name, ref.name)), None)
        if ref.model:
            return next((t for t in self.tables.values() if any(same(n, short(ref.model)) for n, _, _ in t.models)), None)
        return None

    def refers(self, ref: Ref | None, table: Table) -> bool:
        if ref and ref.name:
            schema = normal_schema(ref.schema)
            return same(ref.name, table.name) and (schema is None or same(schema, table.schema))
        return bool(ref and ref.model) and any(same(n, short(ref.model)) for n, _, _ in table.models)

    # Statements

    def table(self, seen: Seen) -> None:
        raw, file = seen.raw, seen.file.file
        key = entity_id(raw.kind, raw.schema, raw.name)
        t = self.tables.setdefault(key, Table(raw.name, raw.kind, normal_schema(raw.schema)))
        self.dropped.discard(key)
        if not raw.partial:
            t.created_in = t.created_in or file
            t.full = t.full or bool(raw.columns)
        t.certain = t.certain or raw.name_certainty >= 2
        for c in raw.columns:
            have = t.column(c.name)
            if have is None:
                t.columns.append(copy.deepcopy(c))
            elif self.migrated:
                t.columns[t.columns.index(have)] = replaced(have, c)
            else:
                fill(have, c)
        for index in raw.indexes:
            t.add_index(index)
        if raw.model_name:
            t.add_model(short(raw.model_name), seen.kind, seen.redirected)
        append_new(t.sources, seen.kind)
        append_new(t.files, file)
        add_ref(t.refs, raw.source)
        if raw.comment is not None and (self.migrated or t.comment is None):
            t.comment = raw.comment
        t.engine, t.group = t.engine or raw.engine, t.group or raw.group
        score = 100 * (not self.migrated) + 20 * (not raw.partial) + 10 * bool(raw.columns) + 3 * (seen.kind not in DDL_KINDS) - 15 * seen.redirected + raw.name_certainty
        if score > t.score and raw.source:
            t.primary, t.score = Source(raw.source.file, raw.source.line), score

    def enum(self, raw: RawEnum, parsed: Parsed) -> None:
        if not raw.name or not raw.name.strip():
            return
        key, made = enum_id(raw.schema, raw.name), None if raw.partial else parsed.file
        have = self.enums.get(key)
        if have is None:
            self.enums[key] = Enum(raw.name, list(dict.fromkeys(raw.values)), normal_schema(raw.schema), [parsed.kind], raw.source, made)
            return
        append_new(have.sources, parsed.kind)
        if self.migrated and not raw.partial:
            have.values, have.source = list(dict.fromkeys(raw.values)), raw.source
        else:
            have.values = list(dict.fromkeys(have.values + raw.values))
        have.created_in = have.created_in or made

    def relation(self, seen: Seen) -> None:
        self.relations.append(Stored(seen.raw, seen.kind, seen.file.file, self.migrated))

    # Changes: each answers "done", "skipped" or "missing".

    def change(self, op: Op, file: str) -> str:
        if op.op in ("dropEnum", "renameEnum"):
            return self._change_enum(op, file)
        table = self.find(op.table)
        if table is None:
            if op.op == "dropTable" and op.table.name and self.migrated:
                self.dropped.add(entity_id("table", op.table.schema, op.table.name))
            return "missing"
        if not self.migrated and op.op not in ("alterColumn", "renameColumn") and table.created_in != file:
            return "skipped"
        return getattr(self, f"_{op.op}")(op, table)

    def _change_enum(self, op: Op, file: str) -> str:
        have = self.enums.get(enum_id(op.schema, op.name))
        if have is None:
            return "missing"
        if not self.migrated and have.created_in != file:
            return "skipped"
        del self.enums[have.key]
        if op.op == "renameEnum":
            have.name = op.to
            self.enums[have.key] = have
        return "done"

    def _dropTable(self, op: Op, table: Table) -> str:
        del self.tables[table.key]
        self.dropped.add(table.key)
        self.relations = [s for s in self.relations if not self.refers(s.raw.from_, table)]
        return "done"

    def _renameTable(self, op: Op, table: Table) -> str:
        name = (op.to or "").strip()
        if not name:
            return "skipped"
        ends = [ref for s in self.relations for ref in (s.raw.from_, s.raw.to, s.raw.through) if self.refers(ref, table)]
        del self.tables[table.key]
        self.dropped.add(table.key)
        table.name = name
        self.tables[table.key] = table
        self.dropped.discard(table.key)
        for ref in ends:
            ref.name = name
        return "done"

    def _dropColumn(self, op: Op, table: Table) -> str:
        column = table.column(op.column)
        if column is None:
            return "skipped"
        table.columns.remove(column)
        uses = lambda names: any(same(n, op.column) for n in names)
        table.indexes = [x for x in table.indexes if not uses(x.columns)]
        self.relations = [s for s in self.relations if s.raw.cardinality == "many-to-many" or not self.refers(s.raw.from_, table) or not uses(s.raw.from_columns)]
        return "done"

    def _renameColumn(self, op: Op, table: Table) -> str:
        column = table.column(op.column)
        if column is None:
            return "missing"
        old, column.name = column.name, op.to
        moved = lambda names: [op.to if same(n, old) else n for n in names]
        for index in table.indexes:
            index.columns = moved(index.columns)
        for s in self.relations:
            if self.refers(s.raw.from_, table):
                s.raw.from_columns = moved(s.raw.from_columns)
            if self.refers(s.raw.to, table):
                s.raw.to_columns = moved(s.raw.to_columns)
        return "done"

    def _alterColumn(self, op: Op, table: Table) -> str:
        column = table.column(op.column)
        if column is None:
            return "missing"
        for name, value in op.set.items():
            if value is not None:
                setattr(column, name, value)
        if op.set.get("primary_key"):
            column.nullable = False
        return "done"

    def _dropForeignKey(self, op: Op, table: Table) -> str:
        wanted = {c.lower() for c in op.columns}

        def goes(s: Stored) -> bool:
            r = s.raw
            if r.cardinality == "many-to-many" or not self.refers(r.from_, table):
                return False
            joined = "_".join([table.name, *r.from_columns])
            names = [r.name] if r.name else [f"{joined}_fkey", f"{joined}_foreign", f"fk_{joined}"]
            if op.name and any(same(n, op.name) for n in names):
                return True
            if wanted:
                return wanted == {c.lower() for c in r.from_columns} and len(op.columns) == len(r.from_columns)
            return bool(not op.name and op.target and op.target.name and same(r.to.name, op.target.name))

        kept = [s for s in self.relations if not goes(s)]
        done = len(kept) < len(self.relations)
        self.relations = kept
        return "done" if done else "skipped"


# Order of files

_FLYWAY = re.compile(r"(?i)^V(\d+(?:[._]\d+)*)__")


def migration_key(path: str) -> tuple:
    """Directory, then Flyway versions by value, other names naturally, repeatable migrations last."""
    folder, _, base = path.rpartition("/")
    found = _FLYWAY.match(base)
    if found:
        version = [int(x) for x in re.split(r"[._]", found[1])]
        while version and version[-1] == 0:
            version.pop()
        return natural(folder), 0, natural("V"), tuple(version), natural(path)
    repeated = bool(re.match(r"(?i)^R__", base))
    return natural(folder), int(repeated), natural(base), (), ()


def migration_order(files: list[Parsed]) -> list[Parsed]:
    """By path; files that name their predecessors are put in order among their own places, the first that is ready first."""
    out = sorted(files, key=lambda f: migration_key(f.file))
    slots = [i for i, f in enumerate(out) if f.revision]
    chain = [out[i] for i in slots]
    number = {f.revision: i for i, f in enumerate(chain)}
    waits = {i: {number[a] for a in f.after if a in number} - {i} for i, f in enumerate(chain)}
    frees: dict[int, list[int]] = defaultdict(list)
    for i, before in waits.items():
        for b in before:
            frees[b].append(i)
    ready = [i for i, before in waits.items() if not before]
    heapq.heapify(ready)
    left, done = set(waits), []
    while left:
        i = heapq.heappop(ready) if ready else min(left)
        if i not in left:
            continue
        left.remove(i)
        done.append(i)
        for j in frees[i]:
            waits[j].discard(i)
            if not waits[j] and j in left:
                heapq.heappush(ready, j)
    for slot, i in zip(slots, done):
        out[slot] = chain[i]
    return out


def definition_order(files: list[Parsed]) -> list[Parsed]:
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(files, key=lambda f: (rank.get(f.kind, len(rank)), natural(f.file)))


def replay(files: list[Parsed], prepared: Prepared, migrated: bool) -> State:
    """Run the steps of all files, line by line; changes that come before their column in another definition run again at the end."""
    state = State(migrated)
    entities, relations = defaultdict(list), defaultdict(list)
    for seen in prepared.entities:
        entities[id(seen.file)].append(seen)
    for seen in prepared.relations:
        relations[id(seen.file)].append(seen)
    late: list[tuple[Op, str]] = []
    for parsed in (migration_order if migrated else definition_order)(files):
        steps = [(s.raw.source, 0, state.table, (s,)) for s in entities[id(parsed)]]
        steps += [(e.source, 1, state.enum, (e, parsed)) for e in parsed.enums]
        steps += [(s.raw.source, 2, state.relation, (s,)) for s in relations[id(parsed)]]
        steps += [(o.source, 3, state.change, (o, parsed.file)) for o in parsed.ops]
        for _, kind, act, args in sorted(steps, key=lambda s: (s[0].line if s[0] else 0, s[1])):
            answer = act(*args)
            if kind == 3 and not migrated and answer == "missing" and args[0].op in ("alterColumn", "renameColumn"):
                late.append(args)
    for args in late:
        state.change(*args)
    return state
