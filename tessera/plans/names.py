"""Queries: functions of names, paths and literals, told by hand for every nation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.plans.readers import expected_sql, filled
from tessera.plans.registry import Tables, query

#: Function, its argument, and what it gives.
FORMS: list[tuple[str, str, str]] = [
    ("snake", "HTTPServer@Nmd5Hash", "http_server@N_md5_hash"),
    ("snake", "shipOwner ID", "ship_owner_id"),
    ("camel", "ship_owner-id", "shipOwnerId"),
    ("camel", "SHIP", "ship"),
    ("pascal", "ship_owner@N", "ShipOwner@N"),
    ("capitalize", "ship_Owner", "Ship_Owner"),
    ("lcfirst", "ShipOwner", "shipOwner"),
    ("loose", "Ship_Owner -ID", "shipownerid"),
    ("short", "App\\Models\\Ship@N", "Ship@N"),
    ("short", "fleet::Ship", "Ship"),
    ("short", '"fleet.Ship<Owner>"', "Ship"),
    ("table of rails", "HarbourMaster", "harbour_masters"),
    ("table of typeorm", "HarbourMaster", "harbour_master"),
    ("table of peewee", "HarbourMaster", "harbourmaster"),
    ("table of sequelize", "HarbourMaster", "HarbourMasters"),
    ("table of mongoose", "Status", "status"),
    ("table of django", "Ship", "fleet@N_ship"),
    ("table of prisma", "HarbourMaster", "HarbourMaster"),
    ("clip", "a ship that sails @N", "a ship tha…"),
    ("clip", "short@N", "short@N"),
    ("bool", " Yes ", "true"),
    ("bool", "0", "false"),
    ("bool", "maybe", ""),
    ("number", "1_000.5", "1000.5"),
    ("number", "ten", ""),
    ("unquoted", '"ship ""@N"""', 'ship "@N"'),
    ("unquoted", "[ship]", "ship"),
    ("split", 'fleet."ship.@N".[id]', "fleet|ship.@N|id"),
    ("comment", "  told \n  twice ", "told twice"),
    ("extension", "src/.env", ""),
    ("extension", "src/Ship.TEST.Ts", ".ts"),
    ("base", "src/fleet/ship@N.rb", "ship@N.rb"),
    ("folder", "src/fleet/ship@N.rb", "src/fleet"),
    ("way", "/home/a/docs>/home/a/src/ship@N.ts", "../src/ship@N.ts"),
    ("way", "c:/a>d:/b/x.ts", "d:/b/x.ts"),
    ("cell", "a|b\nc", "a\\|b c"),
    ("some of", "red,green,blue,@N", "red, green, … (+2)"),
]


def _apply(kind: str, text: Column) -> Column:
    if kind.startswith("table of "):
        return tx.default_table(F.lit(kind.removeprefix("table of ")), text, filled("Fleet@N"))
    if kind == "way":
        both = F.split(text, ">")
        return tx.relative_path(both[0], both[1])
    functions = {
        "snake": tx.snake_case, "camel": tx.camel_case, "pascal": tx.pascal_case, "capitalize": tx.capitalize, "lcfirst": tx.lcfirst, "loose": tx.loose, "short": tx.short_name,
        "clip": lambda c: tx.clip(c, 11), "bool": lambda c: tx.bool_value(c).cast("string"), "number": lambda c: tx.number_value(c).cast("string"), "unquoted": tx.unquoted,
        "split": lambda c: F.array_join(tx.split_qualified(c), "|"), "comment": tx.clean_comment, "extension": tx.extension, "base": tx.base_name, "folder": tx.dir_name, "cell": tx.markdown_cell,
        "some of": lambda c: tx.enum_summary(F.split(c, ","), 2),
    }
    return functions[kind](text)


@query(expected_sql([(f"{i} {kind}", text, out) for i, (kind, text, out) in enumerate(FORMS)]))
def name_forms(t: Tables) -> DataFrame:
    nations = t.nation.select(F.concat(F.lit("w"), "n_nationkey").alias("workspace"), "n_nationkey", "n_regionkey")
    rows = None
    for i, (kind, text, _) in enumerate(FORMS):
        one = nations.select("workspace", F.lit(f"{i} {kind}").alias("part"), filled(text).alias("name"), F.coalesce(_apply(kind, filled(text)), F.lit("")).alias("detail"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
