from pyspark.sql import functions as F
import pytest

from ledgerloom.operators import rules

TEXT = """# Git
- Never force-push to a shared branch.
- Do not commit directly to main,
  whatever the reason.
* Please read the guide.
```
- never run this
```
| - never | a table |
1. Do not use `sudo` in scripts unless told to.
## Style
- Prefer short names.
- Run the linter before every commit.
Never outside a list.
- No."""


@pytest.fixture(scope="module")
def found(spark):
    lines = spark.createDataFrame([("R.md", i, x) for i, x in enumerate(TEXT.split("\n"), 1)], "file string, line int, value string")
    return rules.compiled(rules.candidates(lines)).cache()


def test_candidates_and_classes(found):
    got = {r.line: (r.text, r["class"], r.pattern, r.strength) for r in found.collect()}
    assert got == {
        2: ("Never force-push to a shared branch.", "enforceable", "git.force_push", "deny"),
        3: ("Do not commit directly to main, whatever the reason.", "enforceable", "git.protected_branch", "deny"),
        10: ("Do not use `sudo` in scripts unless told to.", "enforceable", "shell.sudo", "ask"),
        12: ("Prefer short names.", "interpretive", "none", None),
        13: ("Run the linter before every commit. Never outside a list.", "enforceable", "process.before_commit", "ask"),
    }


def test_coverage_and_permissions(spark, found):
    assert tuple(rules.coverage(found).first()) == (5, 1, 0.2)
    p = rules.permissions(found).first()
    assert p.deny == ["Bash(git.force_push)", "Bash(git.protected_branch)"] and p.ask == ["Bash(process.before_commit)", "Bash(shell.sudo)"]
    assert tuple(rules.coverage(found.limit(0)).first()) == (0, 0, 0.0)


def test_verdicts(spark, found):
    calls = [(1, "Bash", "git push --force origin x", "dev"), (2, "Bash", "git push --force-with-lease", "dev"), (3, "Bash", "git commit -m x", "main"), (4, "Bash", "git commit -m x", None), (5, "Bash", "sudo ls", None), (6, "Edit", "sudo", None), (7, "Bash", None, None)]
    got = {r.call_id: (r.verdict, r.pattern) for r in rules.verdicts(spark.createDataFrame(calls, "call_id int, tool string, input string, branch string"), found).collect()}
    assert got == {1: ("deny", "git.force_push"), 2: ("ask", "process.before_commit"), 3: ("deny", "git.protected_branch"), 4: ("ask", "process.before_commit"), 5: ("ask", "shell.sudo"), 6: ("allow", None), 7: ("allow", None)}


def test_audit(spark):
    s = spark.createDataFrame([("a.json", '{"mcpServers": {"x": {"command": "npx", "args": ["tool"]}, "y": {"command": "npx", "args": ["tool@1.2.0"]}}, "permissions": {"allow": ["Bash(*)", "Bash(sh:*)", "Read"]}}'), ("b.json", "{}"), ("c.json", "not json")], "file string, value string")
    assert {tuple(r) for r in rules.audit(s).collect()} == {("a.json", "unpinned", "x"), ("a.json", "too broad", "Bash(*)"), ("a.json", "shell", "Bash(sh:*)")}


def test_a_negation_reaches_its_own_sentence_only(spark):
    texts = [
        ("Always rebase before you push; never skip the tests.", "interpretive"),
        ("Never mind the style. Rebase when you like.", "interpretive"),
        ("Do not worry but rebase often.", "interpretive"),
        ("Never rebase a branch that others use.", "enforceable"),
        ("Commit often. You must not run git add . in this repository.", "enforceable"),
    ]
    df = spark.createDataFrame(texts, "text string, want string")
    assert df.select(rules.classified(F.col("text"))["class"].alias("got"), "want").where("got <> want").count() == 0
