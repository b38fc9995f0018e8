"""The command line."""

import json
import subprocess

import pytest

from tessera.__main__ import main


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "shop"
    (root / "db").mkdir(parents=True)
    (root / "db" / "schema.sql").write_text("CREATE TABLE users (id int PRIMARY KEY);\nCREATE TABLE orders (id int PRIMARY KEY, user_id int REFERENCES users(id));\n")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.sql").write_text("CREATE TABLE no (id int);")
    return root


def test_scan(spark, folder, tmp_path, capsys):
    assert main(["scan", str(folder), "--format", "json"]) == 0
    model = json.loads(capsys.readouterr().out)
    assert [e["id"] for e in model["entities"]] == ["orders", "users"] and [r["id"] for r in model["relations"]] == ["orders(user_id)>users"]
    out = tmp_path / "new" / "map.mmd"
    assert main(["scan", str(folder), "-f", "mermaid", "-o", str(out)]) == 0
    assert out.read_text().startswith("erDiagram") and capsys.readouterr().out == ""
    for kind, word in (("md", "users"), ("dbml", "Table"), ("plantuml", "@startuml")):
        assert main(["scan", str(folder), "-f", kind]) == 0 and word in capsys.readouterr().out


def test_an_empty_folder(spark, tmp_path, capsys):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "readme.md").write_text("nothing")
    assert main(["scan", str(tmp_path / "none"), "-f", "mermaid"]) == 0 and capsys.readouterr().out.startswith("erDiagram")


def test_diff(spark, folder, tmp_path, capsys):
    git = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "db")
    git("commit", "-qm", "first")
    (folder / "db" / "schema.sql").write_text("CREATE TABLE users (id int PRIMARY KEY, email text);\n")
    assert main(["diff", str(folder), "--ref", "HEAD"]) == 0
    said = capsys.readouterr().out
    assert "`email`" in said and "#### orders" in said
    assert main(["diff", str(folder), "--base", str(folder)]) == 0 and "####" not in capsys.readouterr().out


def test_wrong_calls(folder, capsys):
    assert main(["scan", str(folder / "absent")]) == 1 and main(["scan", str(folder), "-f", "svg"]) == 1 and main(["what"]) == 1 and main(["diff", str(folder)]) == 1 and main(["--help"]) == 0
    assert "cannot read" in capsys.readouterr().err
