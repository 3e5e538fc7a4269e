"""Written rules: Markdown to candidate rules, rules to controls, controls against tool calls.

Lines are cut into rules by windows over the lines of a file. Classification is
an ordered cascade: the first family whose trigger fits decides, so it is one CASE
expression that the JVM evaluates. Enforcement joins tool calls to the compiled
rules, a small table written by hand, and takes the first that fits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIST_ITEM = r"^\s*([-*+]|[0-9]+[.)])\s+"
IMPERATIVE = r"(?i)\b(never|always|must|should|do not|don't|avoid|use|run|prefer|only|ask|keep|no)\b"
NEGATED = r"(?i)\b(never|do not|don't|must not|mustn't|should not|shouldn't|avoid|no)\b"
#: Where a sentence, or what a negation reaches within it, ends.
TURN = r"(?<=[\w`)'\"])[.;!?](\s|$)|\b(but|instead|always|then)\b"
WINDOW = 160
SOFT = r"(?i)\b(unless|except|without (asking|approval|permission)|prefer not|if possible|where possible|usually)\b"
PROTECTED = r"(main|master|production|release)"

#: Families in the order they are tried: stage, id, needs a negation, trigger in the rule's text, tool, pattern of what is stopped, condition, strength.
FAMILIES = [
    (1, "git.force_push", True, r"(?i)force[- ]?push|push\s+(--force|-f)\b|push\b.{0,60}--force", "Bash", r"\bgit\s+push\b.*(\s-f\b|--force(?!-with-lease))", None, "deny"),
    (1, "git.no_verify", True, r"(?i)--no-verify|skip\w*\s.{0,40}\bhooks?\b", "Bash", r"\bgit\b.*--no-verify", None, "deny"),
    (1, "git.destructive", True, r"(?i)reset\s+--hard|git\s+(clean|stash|restore)\b|discard\w*\s.{0,40}changes", "Bash", r"\bgit\s+(reset\s+--hard|clean\b|stash\b|checkout\s+--|restore\b)", None, "deny"),
    (1, "git.add_all", True, r"(?i)git\s+add\s+(-A|--all|\.)|stage\s+everything", "Bash", r"\bgit\s+add\s+(-A|--all|\.)(\s|$)", None, "deny"),
    (1, "git.amend", True, r"(?i)\bamend", "Bash", r"\bgit\s+commit\b.*--amend", None, "deny"),
    (1, "git.rebase", True, r"(?i)\brebas", "Bash", r"\bgit\s+(rebase|pull\s+--rebase)\b", None, "deny"),
    (1, "git.protected_branch", True, rf"(?i)\b(commit|push)\w*\b.{{0,60}}\b{PROTECTED}\b", "Bash", r"\bgit\s+(commit|push)\b", PROTECTED, "deny"),
    (1, "git.push", True, r"(?i)\b(git\s+)?push(ing)?\b", "Bash", r"\bgit\s+push\b", None, "ask"),
    (1, "git.config", True, r"(?i)\b(edit|change|modify|update)\w*\s.{0,40}git config", "Bash", r"\bgit\s+config\s+(?!--get|--list|-l)\S+\s+\S+", None, "deny"),
    (2, "git.tags", True, r"(?i)\b(overwrite|delete|move)\w*\s.{0,40}\btags?\b", "Bash", r"\bgit\s+(tag\s+(-d|-f|--delete|--force)|push\b.*:refs/tags)", None, "deny"),
    (3, "shell.rm_rf", True, r"(?i)\brm\s+-(rf|fr|r)\b", "Bash", r"\brm\s+-[a-z]*(r[a-z]*f|f[a-z]*r|r)\b", None, "deny"),
    (3, "shell.sudo", True, r"(?i)\bsudo\b", "Bash", r"\bsudo\b", None, "deny"),
    (3, "shell.kill", True, r"(?i)\b(kill|pkill|killall)\b.{0,40}(process|server|`|$)", "Bash", r"\b(kill|pkill|killall)\b", None, "deny"),
    (5, "git.commit_path", True, r"(?i)\b(commit|stage|add)\w*\s.{0,60}(\.env|secrets?|credentials?|keys?)\b", "Bash", r"\bgit\s+(add|commit)\b.*(\.env|secret|credential)", None, "deny"),
    (5, "file.generated", True, r"(?i)\b(edit|modify|touch|change)\w*\s.{0,70}generated", "Edit", r"generated", None, "deny"),
    (5, "file.secrets_read", True, r"(?i)\bread\w*\s.{0,60}(\.env|secrets?|credentials?)", "Read", r"(\.env|secret|credential)", None, "deny"),
    (5, "file.doc_create", True, r"(?i)\bcreat\w*\s.{0,40}(document|readme|markdown|\.md)", "Write", r"\.md$", None, "ask"),
    (5, "net.no_network", True, r"(?i)\b(network|internet)\b", "Bash", r"\b(curl|wget)\b", None, "deny"),
    (5, "process.dependencies", True, r"(?i)\b(add|install)\w*\s.{0,40}dependenc", "Bash", r"\b(npm|pip|cargo|yarn|pnpm)\s+(install|add|i)\s+\S", None, "ask"),
    (5, "process.full_suite", True, r"(?i)\b(full|whole|entire)\b.{0,30}\b(suite|tests?)\b", "Bash", r"\b(pytest|npm test|cargo test|make test)\s*$", None, "deny"),
    (6, "process.deploy", True, r"(?i)\bdeploy", "Bash", r"\bdeploy\b", None, "ask"),
    (7, "process.before_commit", False, r"(?i)\b(run|check|test)\w*\b.{0,80}\bbefore\b.{0,30}\b(commit|push)", "Bash", r"\bgit\s+(commit|push)\b", None, "ask"),
    (7, "process.ask_before", False, r"(?i)\bask\b.{0,40}\bbefore\b.{0,40}\b(delet|deploy|commit|push)", "Bash", r"\b(rm|deploy|git\s+(commit|push))\b", None, "ask"),
]


def candidates(lines: DataFrame) -> DataFrame:
    """(file, line, heading, text) from (file, line, value): imperative list items with their continuations, outside fences and tables."""
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("value")
    fence = v.rlike(r"^\s*(```|~~~)")
    marked = lines.withColumn("fences", F.sum(fence.cast("int")).over(order)).where(~fence & (F.col("fences") % 2 == 0) & ~v.rlike(r"^\s*\|"))
    is_item, is_heading, is_blank = v.rlike(LIST_ITEM), v.rlike(r"^#+\s"), F.trim(v) == ""
    marked = marked.withColumn("heading", F.last(F.when(is_heading, F.regexp_replace(v, r"^#+\s+", "")), ignorenulls=True).over(order))
    part = F.sum(F.when(is_item | is_heading | is_blank, 1).otherwise(0)).over(order)
    marked = marked.withColumn("part", part).where(~is_heading & ~is_blank)
    rows = marked.groupBy("file", "part").agg(
        F.min("line").alias("line"), F.first("heading", ignorenulls=True).alias("heading"), F.min_by("value", "line").rlike(LIST_ITEM).alias("item"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", F.trim(F.regexp_replace("value", LIST_ITEM, "")).alias("t")))), lambda x: x["t"]), " ").alias("text"),
    )
    return rows.where(F.col("item") & (F.octet_length("text") >= 12) & F.col("text").rlike(IMPERATIVE)).select("file", "line", "heading", "text")


CONTROL = "struct<class:string,pattern:string,tool:string,stops:string,branch:string,strength:string>"


def negated_windows(text: Column) -> Column:
    """What a text's negations reach: from each sentence's negation on, up to WINDOW characters, as far as the sentence's end or a turn to what shall be done."""
    reached = F.transform(F.split(text, TURN), lambda s: F.regexp_extract(s, rf"{NEGATED}.{{0,{WINDOW}}}", 0))
    return F.filter(reached, lambda w: w != "")


def _fits(pattern: str):
    return lambda w: w.rlike(pattern)


def classified(text: Column) -> Column:
    """The control that a rule's text compiles to: the first family that fits; interpretive if none does. A family of what is not to be done must fit what a negation reaches."""
    windows = negated_windows(text)
    out = F.struct(F.lit("interpretive"), F.lit("none"), *(F.lit(None).cast("string"),) * 4).cast(CONTROL)
    for _, name, negated, trigger, tool, stops, branch, strength in reversed(FAMILIES):
        fits = F.exists(windows, _fits(trigger)) if negated else text.rlike(trigger)
        level = F.when(text.rlike(SOFT), "ask").otherwise(strength)
        control = F.struct(F.lit("enforceable"), F.lit(name), F.lit(tool), F.lit(stops), F.lit(branch).cast("string"), level).cast(CONTROL)
        out = F.when(fits, control).otherwise(out)
    return out


def compiled(rules: DataFrame) -> DataFrame:
    return rules.select("*", classified(F.col("text")).alias("c")).select("file", "line", "text", "c.*")


def coverage(rules: DataFrame) -> DataFrame:
    """Counts by class, and the interpretive share (0 without rules)."""
    n, i = F.count("*"), F.sum(F.when(F.col("class") == "interpretive", 1).otherwise(0))
    return rules.agg(n.alias("rules"), F.coalesce(i, F.lit(0)).alias("interpretive"), F.when(n > 0, F.round(i / n, 4)).otherwise(0.0).alias("share"))


def permissions(rules: DataFrame) -> DataFrame:
    """Sorted sets of what is denied and asked; what is denied is not asked as well."""
    entry = F.concat("tool", F.lit("("), "pattern", F.lit(")"))
    sets = rules.where("class = 'enforceable'").agg(F.sort_array(F.collect_set(F.when(F.col("strength") == "deny", entry))).alias("deny"), F.sort_array(F.collect_set(F.when(F.col("strength") == "ask", entry))).alias("ask"))
    return sets.select("deny", F.array_except("ask", "deny").alias("ask"))


def verdicts(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """(call_id, verdict, pattern) of tool calls (call_id, tool, input, branch): the first rule that fits, denials first, else allow.

    Rules are compiled from files written by hand; they are broadcast.
    """
    r = F.broadcast(rules.where("class = 'enforceable'").select(F.col("tool").alias("r_tool"), "stops", F.col("branch").alias("r_branch"), "pattern", "strength", "file", "line"))
    fits = (F.col("tool") == F.col("r_tool")) & F.expr("input rlike stops") & (F.col("r_branch").isNull() | F.expr("coalesce(branch, '') rlike concat('^', r_branch, '$')"))
    first = Window.partitionBy("call_id").orderBy(F.when(F.col("strength") == "deny", 0).otherwise(1), "file", "line")
    met = calls.join(r, fits, "left").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return met.select("call_id", F.coalesce("strength", F.lit("allow")).alias("verdict"), "pattern")


def audit(settings: DataFrame) -> DataFrame:
    """(file, finding, what) over JSON settings (file, value): servers without a pinned version, and shell rules that allow everything."""
    servers = settings.select("file", F.explode(F.from_json(F.get_json_object("value", "$.mcpServers"), "map<string,struct<command:string,args:array<string>>>")).alias("name", "s"))
    floating = servers.where(F.col("s.command").isin("npx", "uvx") & ~F.exists(F.coalesce("s.args", F.array().cast("array<string>")), lambda a: a.rlike(r"@[0-9]+\.")))
    allowed = settings.select("file", F.explode(F.from_json(F.get_json_object("value", "$.permissions.allow"), "array<string>")).alias("rule"))
    broad = allowed.where(F.col("rule").rlike(r"^Bash(\(\*?\)|\(\*:\*\))?$"))
    shells = allowed.where(F.col("rule").rlike(r"^Bash\((ba|z)?sh\b|^Bash\((python|node|perl)\b"))
    return floating.select("file", F.lit("unpinned").alias("finding"), F.col("name").alias("what")).unionByName(broad.select("file", F.lit("too broad").alias("finding"), F.col("rule").alias("what"))).unionByName(shells.select("file", F.lit("shell").alias("finding"), F.col("rule").alias("what")))
