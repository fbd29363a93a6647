"""The command line, over small folders."""

from __future__ import annotations

import os

import pytest

from weir import __main__ as cli

TABLES = "/root/testdata/sf0.001"


def test_list_and_check(spark, capsys):
    assert cli.main(["list"]) == 0 and "exact_duplicates" in capsys.readouterr().out
    assert cli.main(["check", "--rename", "{n} {name}"]) == 0 and cli.main(["check", "--rename", "{x}"]) == 1
    assert cli.main(["check", "--folders", "{year}"]) == 0 and cli.main(["check", "--pages", "1-x"]) == 1


def test_duplicates_convert_tables(spark, tmp_path):
    (tmp_path / "a.md").write_text("# a\n")
    (tmp_path / "b.md").write_text("# a\n")
    (tmp_path / "c.csv").write_text("n;v\nx;1,5\ny;2,5\n")
    cli.main(["duplicates", str(tmp_path), "--out", f"{tmp_path}/o1"])
    assert spark.read.parquet(f"{tmp_path}/o1").where("keep").count() == 1 and spark.read.parquet(f"{tmp_path}/o1").count() == 2
    cli.main(["convert", f"{tmp_path}/*.md", "--to", "txt", "--out", f"{tmp_path}/o2", "--format", "json"])
    assert {r.text for r in spark.read.json(f"{tmp_path}/o2").collect()} == {"A\n"}
    cli.main(["tables", f"{tmp_path}/c.csv", "--out", f"{tmp_path}/o3"])
    assert [c["f"] for c in spark.read.parquet(f"{tmp_path}/o3").where("row_no = 1").first().cells] == [None, 1.5]
    (tmp_path / "r.json").write_text('{"name": "r", "steps": [{"kind": "lower"}]}')
    cli.main(["recipe", f"{tmp_path}/r.json", f"{tmp_path}/a.md", "--out", f"{tmp_path}/o4"])
    assert spark.read.parquet(f"{tmp_path}/o4").first().text == "# a\n"


def test_compare_and_sheets(spark, tmp_path):
    for side, files in {"l": {"same": "x", "sub/Deep": "y", "changed": "aaaa", "only-left": "z"}, "r": {"same": "x", "sub/deep": "y", "changed": "bbbb", "only-right": "z"}}.items():
        for name, text in files.items():
            (tmp_path / side / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / side / name).write_text(text)
            os.utime(tmp_path / side / name, (1, 1))
    want = {"same": "identical", "sub/Deep": "identical", "changed": "different", "only-left": "only-left", "only-right": "only-right"}
    for flags, changed in (([], "different"), (["--quick"], "identical")):
        cli.main(["compare", f"{tmp_path}/l", f"{tmp_path}/r", *flags, "--out", f"{tmp_path}/o{len(flags)}"])
        assert {r.rel: r.status for r in spark.read.parquet(f"{tmp_path}/o{len(flags)}").collect()} == want | {"changed": changed}
    (tmp_path / "January.csv").write_text("Name,Amount\nAnna,12\nLuca,7\n")
    (tmp_path / "February.csv").write_text('amount;NAME;City\n5;Sara;"Ro\nme"\n')
    cli.main(["sheets", f"{tmp_path}/January.csv", f"{tmp_path}/February.csv", "--out", f"{tmp_path}/o5"])
    got = spark.read.parquet(f"{tmp_path}/o5")
    assert got.columns == ["Name", "Amount", "City", "Source file"]
    assert {tuple(r) for r in got.collect()} == {("Anna", "12", None, "January.csv"), ("Luca", "7", None, "January.csv"), ("Sara", "5", "Ro\nme", "February.csv")}


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_run(spark, tmp_path):
    cli.main(["run", "chunks", "--tables", TABLES, "--out", f"{tmp_path}/o"])
    assert spark.read.parquet(f"{tmp_path}/o").count() > 0
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "--tables", TABLES])
