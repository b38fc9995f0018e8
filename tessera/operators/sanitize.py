"""Untrusted settings as clean rows: notes, saved views, layouts, configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_NOTES, NOTE_CHARS, KEY_CHARS = 20_000, 2000, 1000
MOST_VIEWS, VIEW_CHARS, VIEW_ENTITIES = 200, 80, 20_000
MOST_PLACES = 20_000
FILE_CHARS = 8 << 20

NOTES = "tables map<string,string>, columns map<string,map<string,string>>"
VIEWS = "views array<struct<name:string,entities:array<string>>>"
LAYOUT = "map<string,struct<x:double,y:double>>"


def clean_note(text: Column) -> Column:
    """Line ends as line feeds, trimmed and cut; null if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^\s+|\s+$", "")
    return F.when(out != "", F.substr(out, F.lit(1), F.lit(NOTE_CHARS)))


def _valid(key: Column) -> Column:
    return key.isNotNull() & (F.length(key) > 0) & (F.length(key) <= KEY_CHARS) & (key != "__proto__")


def _first(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first rows of each workspace."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("workspace").orderBy(*order))).where(F.col("__n") <= most).drop("__n")


def notes(files: DataFrame) -> DataFrame:
    """Notes of (workspace, text) files as rows (workspace, entity, column or null, note); malformed files have none."""
    read = files.where(F.length("text") <= FILE_CHARS).select("workspace", F.from_json("text", NOTES, {"mode": "PERMISSIVE"}).alias("n"))
    tables = read.select("workspace", F.explode("n.tables").alias("entity", "note")).withColumn("column", F.lit(None).cast("string"))
    columns = read.select("workspace", F.explode("n.columns").alias("entity", "of")).select("workspace", "entity", F.explode("of").alias("column", "note"))
    rows = tables.unionByName(columns).withColumn("note", clean_note(F.col("note")))
    rows = rows.where(F.col("note").isNotNull() & _valid(F.col("entity")) & (F.col("column").isNull() | _valid(F.col("column"))))
    return _first(rows, [F.col("column").isNotNull(), "entity", "column"], MOST_NOTES).select("workspace", "entity", "column", "note")


def update_notes(current: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes with changes (workspace, entity, column, note) on top; an empty note removes one."""
    same = [current[c].eqNullSafe(changes[c]) for c in ("workspace", "entity", "column")]
    kept = current.join(changes, same[0] & same[1] & same[2], "left_anti")
    return kept.unionByName(changes.withColumn("note", clean_note(F.col("note"))).where("note IS NOT NULL").select(*current.columns))


def views(files: DataFrame) -> DataFrame:
    """Saved views as rows (workspace, pos, name, entities): names once beyond case, the first of each."""
    read = files.where(F.length("text") <= FILE_CHARS)
    both = F.coalesce(F.from_json("text", VIEWS)["views"], F.from_json("text", VIEWS.removeprefix("views ")))
    rows = read.select("workspace", F.posexplode(both).alias("pos", "v")).where("v.name IS NOT NULL AND v.entities IS NOT NULL")
    name = F.substr(F.trim(F.regexp_replace("v.name", r"\s+", " ")), F.lit(1), F.lit(VIEW_CHARS))
    members = F.slice(F.array_distinct(F.filter("v.entities", _valid)), 1, VIEW_ENTITIES)
    rows = rows.select("workspace", "pos", name.alias("name"), members.alias("entities")).where("name <> ''")
    once = rows.withColumn("__n", F.row_number().over(Window.partitionBy("workspace", F.lower("name")).orderBy("pos"))).where("__n = 1").drop("__n")
    return _first(once, ["pos"], MOST_VIEWS)


def layout(files: DataFrame) -> DataFrame:
    """Positions as rows (workspace, entity, x, y), rounded half up to a tenth."""
    rows = files.select("workspace", F.explode(F.from_json("text", LAYOUT)).alias("entity", "p")).where((F.length("entity") <= KEY_CHARS) & F.col("p.x").isNotNull() & F.col("p.y").isNotNull())
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    tenth = lambda c: F.floor(c * 10 + 0.5) / 10
    rows = rows.where(finite(F.col("p.x")) & finite(F.col("p.y"))).select("workspace", "entity", tenth(F.col("p.x")).alias("x"), tenth(F.col("p.y")).alias("y"))
    return _first(rows, ["entity"], MOST_PLACES)


UI = (
    "columnMode string, columnModeChosen boolean, direction string, selection string, sidePanelOpen boolean, expanded array<string>, viewport struct<x:double,y:double,scale:double>, "
    "filters struct<disabledSchemas:array<string>,disabledSources:array<string>,disabledEngines:array<string>,hideExternal:boolean,hideInferred:boolean,hideJoinTables:boolean,focusHops:int>"
)
# What a map may show, and which way it may run.
COLUMN_MODES, DIRECTIONS, HOPS = ("all", "keys", "none"), ("LR", "TB"), (1, 2)


def ui_state(files: DataFrame, column_mode: str = "all", direction: str = "LR") -> DataFrame:
    """The state of a map's controls, a row for each (workspace, text); what is missing or wrong has its default."""
    s = F.from_json("text", UI, {"mode": "PERMISSIVE"})
    texts = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    flag = lambda c, default=False: F.coalesce(c, F.lit(default))
    one_of = lambda c, some, default: F.when(c.isin(*some), c).otherwise(F.lit(default))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    v, f = s["viewport"], s["filters"]
    return files.select(
        "workspace",
        one_of(s["columnMode"], COLUMN_MODES, column_mode).alias("column_mode"),
        flag(s["columnModeChosen"]).alias("column_mode_chosen"),
        one_of(s["direction"], DIRECTIONS, direction).alias("direction"),
        s["selection"].alias("selection"),
        flag(s["sidePanelOpen"], True).alias("side_panel_open"),
        texts(s["expanded"]).alias("expanded"),
        F.when(finite(v["x"]) & finite(v["y"]) & finite(v["scale"]) & (v["scale"] > 0), v).alias("viewport"),
        *[texts(f[c]).alias(n) for c, n in (("disabledSchemas", "disabled_schemas"), ("disabledSources", "disabled_sources"), ("disabledEngines", "disabled_engines"))],
        *[flag(f[c]).alias(n) for c, n in (("hideExternal", "hide_external"), ("hideInferred", "hide_inferred"), ("hideJoinTables", "hide_join_tables"))],
        F.when(f["focusHops"].isin(*HOPS), f["focusHops"]).alias("focus_hops"),
    )


@dataclass(frozen=True)
class Config:
    """Settings within their bounds."""

    most_files: int = 5000
    most_kilobytes: int = 2048
    infer_relations: bool = True
    disabled: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    @classmethod
    def of(cls, settings: dict) -> Config:
        def bounded(key: str, low: int, high: int, default: int) -> int:
            value = settings.get(key)
            return min(max(int(value), low), high) if isinstance(value, (int, float)) and not isinstance(value, bool) else default

        def texts(key: str) -> tuple[str, ...]:
            value = settings.get(key)
            return tuple(v for v in value if isinstance(v, str) and v.strip()) if isinstance(value, (list, tuple)) else ()

        return cls(bounded("maxFiles", 100, 200_000, 5000), bounded("maxFileSizeKB", 16, 1_048_576, 2048), settings.get("inferRelations") is not False, texts("disabledParsers"), texts("exclude"))


def export_path(path: str, default: str = "DATABASE.md") -> str:
    """A relative path inside the workspace."""
    parts = [p for p in path.replace("\\", "/").split("/") if p not in ("", ".", "..")]
    out = "/".join(parts)
    return out if out and not out.endswith(":") else default
