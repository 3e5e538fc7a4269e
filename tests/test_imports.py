import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rules
from ledgerloom.sources import imports

SCHEMA = "root string, path string, content string"


def closure(spark, rows, **kw):
    return {(r.root, r.path): (r.depth, r.by) for r in imports.import_closure(spark, spark.createDataFrame(rows, SCHEMA), **kw).collect()}


@pytest.mark.parametrize("path, want", [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", "../a"), ("../../a/..", "../.."), ("/x/../y", "/y"), ("", ""), ("a/b/../../../c", "../c"), (None, None)])
def test_resolved(spark, path, want):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(imports.resolved(F.col("p"))).first()[0] == want


def test_cycles_missing_files_and_depth_five(spark):
    chain = [("p", "CLAUDE.md", "@c/1.md\n@gone.md")] + [("p", f"c/{i}.md", f"@{i + 1}.md\n@../CLAUDE.md") for i in range(1, 7)]
    want = {("p", "CLAUDE.md"): (0, None), ("p", "c/1.md"): (1, "CLAUDE.md")} | {("p", f"c/{i}.md"): (i, f"c/{i - 1}.md") for i in (2, 3, 4)}
    assert closure(spark, chain) == want
    assert len(closure(spark, chain, depth=5)) == 6 and len(closure(spark, chain, depth=0)) == 1


def test_shortest_chain_smallest_importer_and_projects_apart(spark):
    rows = [
        ("p", "AGENTS.md", "@z.md\n@y.md"), ("p", "z.md", "@x.md"), ("p", "y.md", "@x.md"), ("p", "x.md", "@y.md"),
        ("p", ".claude/rules/r.md", "@../../x.md"), ("p", ".claude/rules/deep/r.md", "@../x.md"), ("p", "alone.md", "@z.md"),
        ("q", "z.md", "no entry here"), ("q", "CLAUDE.md", None), ("q", None, "@z.md"),
    ]
    want = {("p", "AGENTS.md"): (0, None), ("p", ".claude/rules/r.md"): (0, None), ("p", "z.md"): (1, "AGENTS.md"), ("p", "y.md"): (1, "AGENTS.md"), ("p", "x.md"): (1, ".claude/rules/r.md"), ("q", "CLAUDE.md"): (0, None)}
    assert closure(spark, rows + rows) == want
    assert closure(spark, []) == {}


def test_what_is_an_import(spark):
    text = "see @inline.md\n `@ticked.md`\n@/abs.md\n@~/own.md\n@two.md and more\r\n@three.md`x @four.md"
    rows = [("p", "CLAUDE.md", text)] + [("p", x, "") for x in ("inline.md", "ticked.md", "/abs.md", "/home/me/own.md", "two.md", "three.md", "four.md")]
    assert {p for _, p in closure(spark, rows, home="/home/me")} == {"CLAUDE.md", "/abs.md", "/home/me/own.md", "two.md", "three.md"}
    assert ("p", "/home/me/own.md") not in closure(spark, rows)


def test_files_of_a_folder_to_rules(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "CLAUDE.md").write_text("# Git\n@sub%20dir/no.md\n@more+.md\n")
    (tmp_path / "more+.md").write_text("# More\r\n- Never force-push to a shared branch.\r\n")
    (tmp_path / "sub dir" / "no.md").write_text("- Never use `sudo` in scripts.\n")
    (tmp_path / "notes.txt").write_text("- Never read this.\n")
    files = imports.read_files(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"CLAUDE.md", "more+.md", "sub dir/no.md"}
    found = rules.candidates(imports.loaded_lines(spark, files)).collect()
    assert [(r.file, r.line, r.text) for r in found] == [("more+.md", 2, "Never force-push to a shared branch.")]
