"""One workspace's model for tests: parsed files in, lists of records out."""

import json

from pyspark.sql import SparkSession

from tessera.model import Parsed, as_dict
from tessera.operators import scan


def build(parsed: list[Parsed], infer_relations: bool = True) -> dict[str, list[dict]]:
    """The model of one workspace, whose files are taken in the order of their paths."""
    spark = SparkSession.getActiveSession()
    rows = [("w", f"{p.file}", p.kind, json.dumps(as_dict(p))) for p in parsed]
    # Tables of some rows: compiling code for them would take longer than reading them.
    held = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        return scan.collected(scan.build_models(spark.createDataFrame(rows, scan.PARSED).coalesce(1), infer_relations))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
