"""Rules over a table of text files (grp, path, text), giving one row per finding.

All expression rules are evaluated in one pass over the text and exploded once; no
rule shuffles. Only Python syntax trees need a Python worker, for ``.py`` rows alone.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward import fixed
from tallyward.functions.pycode import outbound_hosts, unsafe_calls
from tallyward.functions.text import (
    EDGE_SPACE, LINE_BREAK, cut, file_name, has_suffix, literal, match_lines_sql, matches_sql, mentions, nearest_name_sql,
    path_parts, searched, shannon_entropy_sql, strip, strip_quotes,
)
from tallyward.operators.near_names import nearest_names
from tallyward.operators.ordered import numbered_within
from tallyward.session import written
from tallyward.sources.files import visible, within_size

HIT = ("struct<rank:int,pos:int,prefix:string,severity:string,title:string,line:int,"
       "pattern:string,evidence:string>")
HIT_ARRAY = f"array<{HIT}>"
MANIFESTS = ("requirements.txt", "package.json", "pyproject.toml", ".npmrc")

# Own advice per pattern: (risk, remediation).
ADVICE = {
    "OpenAI API key": ("The key can be used by anyone who reads the file.", "Revoke it and load keys at run time."),
    "Anthropic API key": ("The key can be used by anyone who reads the file.", "Revoke it and load keys at run time."),
    "AWS access key": ("Account access for anyone who reads the file.", "Revoke it and use roles or a vault."),
    "GitHub token": ("Repository access for anyone who reads the file.", "Revoke it and load tokens at run time."),
    "Google API key": ("The key can be used by anyone who reads the file.", "Revoke it and load keys at run time."),
    "Slack token": ("Workspace access for anyone who reads the file.", "Revoke it and load tokens at run time."),
    "Private key": ("Allows impersonation and signing.", "Replace the key pair and keep keys out of files."),
    "DB connection string with password": ("Shows credentials and topology.", "Build the string from settings."),
    "Generic high-entropy secret": ("Looks like a token or password.", "Keep secrets in a vault."),
    "Hardcoded password literal": ("A secret may be live in the text.", "Read it from settings or a prompt."),
    "Webhook or telemetry endpoint": ("Data can leave through this address.", "Remove the address."),
    "Instructions to send data externally": ("Tells a reader or tool to send data out.", "Remove the sentence."),
    "Dynamic eval": ("Runs text as code.", "Parse the text instead."),
    "Dynamic exec": ("Runs text as code.", "Parse the text instead."),
    "Shell command injection": ("Input can become a command.", "Pass an argument list without a shell."),
    "Insecure deserialization": ("Loading can run code.", "Use a data-only format."),
    "Disabled TLS verification": ("Traffic can be read and changed.", "Verify certificates."),
    "Shell eval injection": ("A variable can become a command.", "Call the command directly."),
    "Unpinned dependency": ("The installed version can change.", "Pin the exact version."),
    "Typosquat candidate": ("The name is close to a well-known package.", "Check the package name."),
    "Post-install hook": ("Runs code during installation.", "Do the work at run time."),
    "Unknown registry": ("Packages come from an unlisted host.", "Use a known registry or list the host."),
    "Setup command override": ("Runs code during installation.", "Remove the override."),
    "Outbound network call": ("Data can leave to this host.", "Remove the call or list the host."),
}
DEFAULT_ADVICE = ("Needs a review.", "Change or remove it.")


@dataclass(frozen=True)
class TextRule:
    """A pattern searched in every file of a scope.

    ``words``: the pattern cannot match a text without one of them.
    """

    rank: int
    prefix: str
    severity: str
    pattern: str
    regex: str
    title: str
    scope: str = "any"
    evidence: str = "whole"
    words: tuple[str, ...] = ()


def _in_scope(scope: str) -> Column:
    path = F.col("path")
    if scope == "markdown":
        return has_suffix(path, ".md")
    if scope == "python":
        return has_suffix(path, ".py")
    if scope == "shell":
        return has_suffix(path, ".sh") | F.col("text").startswith("#!/bin/")
    if scope == "code":
        return has_suffix(path, ".py") | has_suffix(path, ".sh")
    if scope == "commands":
        return has_suffix(path, ".md") | has_suffix(path, ".sh")
    if scope == "setup":
        return file_name(path) == "setup.py"
    if scope == "manifest":
        return file_name(path).isin(list(MANIFESTS))
    if scope == "requirements":
        return F.lower(file_name(path)) == "requirements.txt"
    if scope == "package":
        return file_name(path) == "package.json"
    if scope == "own text":
        return ~F.arrays_overlap(path_parts(path), F.array(F.lit("references"), F.lit("docs")))
    return F.lit(True)


SECRET_WORDS = (("sk-",), ("sk-ant-",), ("AKIA",), ("ghp_", "gho_", "ghs_"), ("AIza",), ("xox",), ("-----BEGIN ",),
                ("postgres://", "mysql://", "mongodb://", "redis://"))
SECRET_RULES = tuple(
    TextRule(10 + i, "CS", severity, label, regex, label, evidence="marked", words=SECRET_WORDS[i])
    for i, (label, regex, severity) in enumerate(fixed.SECRET_PATTERNS))
ENTROPY_RULE = TextRule(20, "CS", "HIGH", "Generic high-entropy secret", fixed.QUOTED_LITERAL,
                        "High-entropy literal (likely secret)", "own text", "quoted")
PASSWORD_RULE = TextRule(30, "CS", "HIGH", "Hardcoded password literal", fixed.PASSWORD_LITERAL,
                         "Hardcoded {} literal", evidence="cut", words=("passw", "pwd", "secret", "token"))
ENDPOINT_WORDS = ("discord.com/api/webhooks", "hooks.slack.com", "webhook.site", "requestbin.", "pipedream.com",
                  ".ngrok.io", ".serveo.net")
ENDPOINT_RULES = tuple(
    TextRule(40 + i, "DE", "HIGH", "Webhook or telemetry endpoint", regex, f"{label} reference",
             words=(ENDPOINT_WORDS[i],))
    for i, (regex, label) in enumerate(fixed.ENDPOINT_PATTERNS))
PHRASE_WORDS = ("send th", "://", "email th")
PHRASE_RULES = tuple(
    TextRule(50 + i, "DE", "HIGH", "Instructions to send data externally", regex,
             "Instruction to transmit data externally", "markdown", words=(PHRASE_WORDS[i],))
    for i, regex in enumerate(fixed.SEND_PHRASES))
PYTHON_RANK = 60
TLS_RULE = TextRule(70, "UC", "MEDIUM", "Disabled TLS verification", fixed.TLS_VERIFY_OFF,
                    "TLS verification disabled", "python", words=("verify", "_create_unverified_context"))
SHELL_RANKS = (80, 81)
REQUIREMENT_RANK = 90
HOOK_RANKS = (95, 96)
CATALOG_SCOPES = {"PI": "markdown", "EP": "commands", "UC": "code"}
CATALOG_WORDS = (("you are no longer", "ignore ", "disregard ", "forget "), ("bypass ", "regardless of ", "even if "),
                 ("you are ", "pretend ", "act as "), tuple("\u200b\u200c\u200d\u2060\ufeff"),
                 ("rm -rf", "chmod 777"), ("../",), ("/tmp/",))
CATALOG_RULES = tuple(
    TextRule(100 + i, prefix, severity, label, regex, label, CATALOG_SCOPES[prefix], "marked", CATALOG_WORDS[i])
    for i, (prefix, label, regex, severity) in enumerate(fixed.CATALOG_PATTERNS)
) + (TextRule(120, "SC", "HIGH", "Setup command override", r"cmdclass\s*=", "Setup command override", "setup",
              words=("cmdclass",)),)
REGISTRY_RULE = TextRule(
    121, "SC", "MEDIUM", "Unknown registry",
    r"(?:--(?:extra-)?index-url[ =]+|registry\s*=\s*|git\+)https?://(?:[^@/\s]+@)?[^/\s:]+", "Unknown registry",
    "manifest", "host", ("://",))
REGISTRY_HOST = r"https?://(?:[^@/\s]+@)?([^/\s:]+)"
REGISTRY_RANK = REGISTRY_RULE.rank
OUTBOUND_RANK = 130

TEXT_RULES = (*SECRET_RULES, ENTROPY_RULE, PASSWORD_RULE, *ENDPOINT_RULES, *PHRASE_RULES, TLS_RULE)
CORE_RANKS = frozenset(range(10, 97))
CATALOG_RANKS = frozenset(range(100, 131))


def _hit(rank: int, pos: str, prefix: str, severity: str, title: str, line: str, pattern: str, evidence: str) -> str:
    return (f"named_struct('rank', {rank}, 'pos', CAST({pos} AS INT), 'prefix', {literal(prefix)}, "
            f"'severity', {literal(severity)}, 'title', {title}, 'line', CAST({line} AS INT), "
            f"'pattern', {literal(pattern)}, 'evidence', {evidence})")


def _in_file(title: str) -> str:
    return f"concat({title}, ' in ', path)"


def _rule_hits(rule: TextRule, known_registries: Sequence[str], first_per_file: bool = False) -> str:
    """Hits of one text rule out of its matches, the column ``m<rank>``."""
    found = f"m{rule.rank}"
    placed = (f"transform(arrays_zip({found}, {match_lines_sql('text', rule.regex, found)}), "
              "(z, i) -> named_struct('pos', i, 'match', z.`0`, 'line', z.`1`))").replace("z.`0`", f"z.{found}")
    quoted = "substring(m.match, 2, length(m.match) - 2)"
    title, evidence = _in_file(literal(rule.title)), "m.match"
    if rule is ENTROPY_RULE:
        is_secret = (f"{shannon_entropy_sql(quoted)} >= {fixed.MIN_SECRET_ENTROPY}D "
                     f"AND NOT rlike({quoted}, {literal(fixed.HEX_DIGEST)})")
        placed = f"filter({placed}, m -> {is_secret})"
        placed = f"slice({placed}, 1, 1)" if first_per_file else placed
        evidence = f"concat(substring({quoted}, 1, 40), '...')"
    elif rule is PASSWORD_RULE:
        pattern = literal(searched(rule.regex))
        placeholders = ", ".join(literal(p) for p in fixed.PASSWORD_PLACEHOLDERS)
        placed = f"filter({placed}, m -> lower(regexp_extract(m.match, {pattern}, 2)) NOT IN ({placeholders}))"
        title = _in_file(f"concat('Hardcoded ', lower(regexp_extract(m.match, {pattern}, 1)), ' literal')")
        evidence = "substring(m.match, 1, 80)"
    elif rule is REGISTRY_RULE:
        evidence = f"lower(regexp_extract(m.match, {literal(REGISTRY_HOST)}, 1))"
        known = ", ".join(literal(r) for r in known_registries)
        placed = f"filter({placed}, m -> {evidence} NOT IN ({known}))" if known else placed
    elif rule.evidence == "marked":
        evidence = "if(length(m.match) > 80, concat(substring(m.match, 1, 80), '...'), m.match)"
    hit = _hit(rule.rank, "m.pos", rule.prefix, rule.severity, title, "m.line", rule.pattern, evidence)
    return f"CASE WHEN size({found}) > 0 THEN transform({placed}, m -> {hit}) END"


def _shell_hits(first_per_file: bool = False) -> str:
    """Evals on a variable and places that turn certificate checks off, in file order.

    With ``first_per_file`` one finding each: on the first line with an eval, and on line 1 for the certificates.
    """
    def hits(number: int, regex: str, first_line: str, severity: str, title: str, label: str, evidence: str) -> str:
        found = matches_sql("text", regex)
        lines = f"array({first_line})" if first_per_file else (
            f"flatten(transform(array({found}), found -> {match_lines_sql('text', regex, 'found')}))")
        hit = _hit(SHELL_RANKS[number], "i", "UC", severity, _in_file(title), "l", label, evidence)
        return (f"CASE WHEN rlike(text, {literal(searched(regex))}) THEN transform({lines}, (l, i) -> {hit}) "
                f"ELSE CAST(array() AS {HIT_ARRAY}) END")

    eval_lines = f"transform(split(text, {literal(LINE_BREAK)}, -1), l -> rlike(l, {literal(searched(fixed.SHELL_EVAL))}))"
    evals = hits(0, fixed.SHELL_EVAL, f"greatest(array_position({eval_lines}, true), 1)", "CRITICAL", "'shell eval on variable'",
                 "Shell eval injection", "'eval $...'")
    tls = hits(1, fixed.SHELL_TLS_OFF, "1", "MEDIUM", "'TLS verification disabled'", "Disabled TLS verification",
               "'curl -k / wget --no-check-certificate'")
    return f"CASE WHEN in_shell THEN concat({evals}, {tls}) END"


def _requirement_lines() -> str:
    """Requirement lines that are used, trimmed, with their number and the lowered name at their start."""
    numbered = (f"transform(split(text, {literal(LINE_BREAK)}, -1), (l, i) -> named_struct('line', i + 1, "
                f"'text', regexp_replace(l, {literal(EDGE_SPACE)}, '')))")
    used = f"filter({numbered}, u -> u.text != '' AND NOT startswith(u.text, '#'))"
    start = literal(r"(?U)^[^<>=!~\s]*")
    return (f"transform({used}, u -> named_struct('line', u.line, 'text', u.text, "
            f"'name', lower(regexp_extract(u.text, {start}, 0))))")


def _squat_hit(line: str, text: str, name: str, near: str) -> str:
    return _hit(REQUIREMENT_RANK, f"{line} * 2 + 1", "SC", "HIGH",
                f"concat('Possible typosquat: ', {name}, ' (close to ', {near}, ')')", line, "Typosquat candidate",
                f"substring({text}, 1, 80)")


def _requirement_hits() -> str:
    """Unpinned lines and near-miss package names, in line order."""
    near = (f"transform({_requirement_lines()}, u -> named_struct('line', u.line, 'text', u.text, 'name', u.name, "
            f"'near', {nearest_name_sql('u.name', fixed.POPULAR_PACKAGES)}))")
    git_url = literal(searched(r"@\s*git\+"))
    unpinned = _hit(REQUIREMENT_RANK, "u.line * 2", "SC", "MEDIUM", _in_file("'Unpinned dependency'"), "u.line",
                    "Unpinned dependency", "substring(u.text, 1, 80)")
    squat = _squat_hit("u.line", "u.text", "u.name", "u.near")
    return (f"CASE WHEN in_requirements THEN array_compact(flatten(transform({near}, u -> array("
            f"CASE WHEN NOT contains(u.text, '==') AND NOT rlike(u.text, {git_url}) THEN {unpinned} END, "
            f"CASE WHEN u.near IS NOT NULL THEN {squat} END)))) END")


def near_name_findings(files: DataFrame, names: DataFrame) -> DataFrame:
    """Hits of required packages whose name is close to one of ``names``, a list of any length (column ``name``).

    The built-in scan compares each line with its short list; here equal names are looked up once, through an index.
    """
    lines = (
        visible(files).filter(_in_scope("requirements") & F.col("text").isNotNull())
        .select("grp", "path", F.explode(F.expr(_requirement_lines())).alias("u"))
        .select("grp", "path", "u.line", "u.text", "u.name")
    )
    near = nearest_names(lines.select(F.col("name").alias("word")), names)
    found = lines.join(near, F.col("name") == F.col("word"))
    return found.select("grp", "path", F.expr(_squat_hit("line", "text", "name", "near")).alias("hit")).select("grp", "path", "hit.*")


def _hook_hits() -> str:
    def hook(rank: int, name: str) -> str:
        value = f"get_json_object(text, '$.scripts.{name}')"
        hit = _hit(rank, "0", "SC", "HIGH", _in_file(f"'npm {name} hook'"), "1", "Post-install hook",
                   f"""concat('"{name}": "', substring({value}, 1, 60), '"')""")
        return f"CASE WHEN {value} IS NOT NULL THEN {hit} END"

    hooks = ", ".join(hook(rank, name) for rank, name in zip(HOOK_RANKS, ("preinstall", "postinstall")))
    return f"CASE WHEN in_package THEN array_compact(array({hooks})) END"


def _python_hits(files: DataFrame, ranks: Collection[int], allowed_hosts: Sequence[str]) -> DataFrame:
    """Findings of Python syntax trees, made where the files are read; small tables are spread over the cores first."""
    allowed = frozenset(allowed_hosts)
    calls, hosts = PYTHON_RANK in ranks, OUTBOUND_RANK in ranks

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for grp, path, text in zip(batch["grp"], batch["path"], batch["text"]):
                if calls:
                    rows += [(grp, path, PYTHON_RANK, pos, "UC", severity, f"{title} in {path}", line, label, evidence)
                             for pos, (severity, label, title, line, evidence) in enumerate(unsafe_calls(text))]
                if hosts:
                    rows += [(grp, path, OUTBOUND_RANK, pos, "DE", "HIGH", f"Outbound call to {host} in {path}", line,
                              "Outbound network call", host)
                             for pos, (host, line) in enumerate(outbound_hosts(text)) if host not in allowed]
            yield pd.DataFrame(rows, columns=HIT_COLUMNS)

    python = files.filter(_in_scope("python") & F.col("text").isNotNull()).select("grp", "path", "text")
    return _spread(python).mapInPandas(scan, HIT_SCHEMA)


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` in as many tasks as there are cores, if the optimizer takes them for so small that a scan makes fewer splits.

    A larger table is left where it is read: its splits are as many as the cores or more.
    """
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    # the least size of a split while cores are idle
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores, "grp", "path") if size < cores * split else rows


HIT_COLUMNS = ["grp", "path", "rank", "pos", "prefix", "severity", "title", "line", "pattern", "evidence"]
HIT_SCHEMA = ("grp string, path string, rank int, pos int, prefix string, severity string, title string, "
              "line int, pattern string, evidence string")


def scan_files(files: DataFrame, ranks: Collection[int] = CORE_RANKS, extra_rules: Sequence[TextRule] = (),
               known_registries: Sequence[str] = fixed.KNOWN_REGISTRIES,
               allowed_hosts: Sequence[str] = (), max_bytes: int | None = None,
               first_per_file: bool = False) -> DataFrame:
    """Hits of the chosen rules (by rank), unnumbered; ``CATALOG_RANKS`` adds the catalog rules.

    Every text is scanned whole unless ``max_bytes`` is given (``oversized`` lists what that skips).
    ``first_per_file`` reports only the first high-entropy literal, shell eval and shell certificate finding of a file.
    """
    rows = visible(files) if max_bytes is None else within_size(visible(files), max_bytes)
    rules = [r for r in (*TEXT_RULES, *CATALOG_RULES, REGISTRY_RULE) if r.rank in ranks] + list(extra_rules)
    parts = [_rule_hits(r, known_registries, first_per_file) for r in rules]
    scopes = {}
    for scope, scope_ranks, hits in (("shell", SHELL_RANKS, lambda: _shell_hits(first_per_file)), ("package", HOOK_RANKS, _hook_hits),
                                     ("requirements", (REQUIREMENT_RANK,), _requirement_hits)):
        if set(scope_ranks) & set(ranks):
            scopes[f"in_{scope}"] = _in_scope(scope)
            parts.append(hits())
    branches = []
    if parts:
        text, lowered = F.col("text"), F.col("lowered")
        found = {}
        for rule in rules:
            test = _in_scope(rule.scope)
            if rule.words:
                test = test & mentions(text, lowered, rule.words, rule.regex.startswith("(?i)"))
            found[f"m{rule.rank}"] = F.when(test, F.expr(matches_sql("text", rule.regex)))
        arrays = ", ".join(f"coalesce(CAST({p} AS {HIT_ARRAY}), CAST(array() AS {HIT_ARRAY}))" for p in parts)
        branches.append(
            rows.select("grp", "path", "text", F.lower("text").alias("lowered"))
            .select("grp", "path", "text", *[c.alias(n) for n, c in {**found, **scopes}.items()])
            .select("grp", "path", F.explode(F.expr(f"flatten(array({arrays}))")).alias("hit"))
            .select("grp", "path", "hit.*"))
    if {PYTHON_RANK, OUTBOUND_RANK} & set(ranks):
        branches.append(_python_hits(rows, ranks, allowed_hosts))
    table = branches[0]
    for branch in branches[1:]:
        table = table.unionByName(branch)
    return table


def precheck_groups(groups: DataFrame, files: DataFrame, marker: str = fixed.MARKER_FILE) -> DataFrame:
    """Hits of groups whose marker file is missing, nearly empty or has a bad front matter."""
    marked = files.filter(F.col("path") == marker).select("grp", "text")
    gone = _hit(0, "0", "IQ", "CRITICAL", literal(f"Missing {marker}"), "NULL", f"Missing or empty {marker}",
                "'(file not found)'")
    missing = groups.select("grp").join(marked, "grp", "left_anti").select(
        "grp", F.expr(f"CAST(array({gone}) AS {HIT_ARRAY})").alias("hits"))
    text = F.col("text")
    front_pattern = r"(?s)\A---\n(.*?)\n---\n"
    front = F.when(text.rlike(front_pattern), F.regexp_extract(text, front_pattern, 1))
    rows = marked.withColumn("front", front)
    front = F.col("front")
    name_pattern = r"(?mdU)^name:\s*(.+?)\s*$"
    description_pattern = r"(?msdU)^description:\s*(.+?)(?=\n[A-Za-z_]+:|\z)"
    name = F.when(front.rlike(name_pattern), strip_quotes(F.regexp_extract(front, name_pattern, 1)))
    description = F.when(front.rlike(description_pattern),
                         strip_quotes(F.regexp_extract(front, description_pattern, 1)))
    has_name, has_description = front.contains("name:"), front.contains("description:")

    def check(pos: int, condition: Column, prefix: str, severity: str, title: str, line: int | None,
              pattern: str, evidence: Column) -> Column:
        return F.when(condition, F.struct(
            F.lit(0).alias("rank"), F.lit(pos).alias("pos"), F.lit(prefix).alias("prefix"),
            F.lit(severity).alias("severity"), F.lit(title).alias("title"), F.lit(line).cast("int").alias("line"),
            F.lit(pattern).alias("pattern"), evidence.alias("evidence")))

    malformed = "Missing or malformed frontmatter"
    checks = F.array(
        check(1, F.length(strip(text)) < 50, "IQ", "CRITICAL", f"Empty or near-empty {marker}", None,
              f"Missing or empty {marker}", cut(text, 80)),
        check(2, front.isNull(), "SM", "MEDIUM", "Missing YAML frontmatter", 1, malformed, cut(text, 80)),
        check(3, ~has_name, "SM", "MEDIUM", "Frontmatter missing 'name'", 1, malformed, cut(front, 120)),
        check(4, has_name & (F.length(name) > 64), "SM", "HIGH",
              "Frontmatter 'name' exceeds 64-character API limit", 1, "Frontmatter field length",
              F.concat(F.lit("name is "), F.length(name).cast("string"), F.lit(" characters"))),
        check(5, has_name & ~name.rlike(r"^[a-z0-9-]+$"), "SM", "HIGH",
              "Frontmatter 'name' contains invalid characters", 1, "Frontmatter field format",
              F.concat(F.lit("name='"), name, F.lit("'"))),
        check(6, ~has_description, "SM", "MEDIUM", "Frontmatter missing 'description'", 1, malformed, cut(front, 120)),
        check(7, has_description & (F.length(description) > 1024), "SM", "HIGH",
              "Frontmatter 'description' exceeds 1024-character API limit", 1, "Frontmatter field length",
              F.concat(F.lit("description is "), F.length(description).cast("string"), F.lit(" characters"))))
    found = rows.select("grp", F.array_compact(checks).cast(HIT_ARRAY).alias("hits"))
    return (
        missing.unionByName(found).select("grp", F.explode("hits").alias("hit"))
        .select("grp", F.lit(marker).alias("path"), "hit.*")
    )


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key)


def as_findings(hits: DataFrame) -> DataFrame:
    """Findings with ids counted per group and category, in file and rule order.

    The hits are written once first, so the sort samples them and not the texts again.
    """
    order = written(hits, "hits").withColumns({
        "stage": F.when(F.col("rank") == 0, 0).otherwise(1), "parts": path_parts(F.col("path"))})
    numbered = numbered_within(order, ["grp", "prefix"], ["stage", "parts", "rank", "pos", "title"])
    safety = F.col("prefix").isin(list(fixed.SAFETY_PREFIXES))
    advice = F.col("pattern")
    digits = F.greatest(F.lit(3), F.length(F.col("seq").cast("string")))
    risks = {k: v[0] for k, v in ADVICE.items()}
    fixes = {k: v[1] for k, v in ADVICE.items()}
    return numbered.select(
        "grp",
        F.concat(F.lit("SSK-"), F.col("prefix"), F.lit("-"),
                 F.lpad(F.col("seq").cast("string"), digits, F.lit("0"))).alias("finding_id"),
        F.when(safety, "Safety").otherwise("Security").alias("dimension"),
        _lookup(F.col("prefix"), fixed.CATEGORY_NAMES).alias("category"),
        "severity", "title", F.col("path").alias("file"), "line", "pattern", "evidence",
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in risks.items() for v in p]), advice),
                   F.lit(DEFAULT_ADVICE[0])).alias("risk"),
        F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for p in fixes.items() for v in p]), advice),
                   F.lit(DEFAULT_ADVICE[1])).alias("remediation"))


def severity_table(findings: DataFrame, by: Sequence[str] = ("grp", "dimension")) -> DataFrame:
    """Counts per severity, one column each."""
    return findings.groupBy(*by).pivot("severity", list(fixed.SEVERITY_ORDER)).count().fillna(0)


def verdicts(groups: DataFrame, findings: DataFrame) -> DataFrame:
    """FAIL where a critical or high finding exists, per dimension and overall, for every group."""
    bad = F.col("severity").isin(list(fixed.FAIL_SEVERITIES))
    failed = findings.groupBy("grp").agg(
        F.bool_or(bad & (F.col("dimension") == "Safety")).alias("safety"),
        F.bool_or(bad & (F.col("dimension") == "Security")).alias("security"),
        F.count(F.lit(1)).alias("n"))

    def label(flag: Column) -> Column:
        return F.when(F.coalesce(flag, F.lit(False)), "FAIL").otherwise("PASS")

    return groups.select("grp").join(failed, "grp", "left").select(
        "grp", label(F.col("safety") | F.col("security")).alias("verdict"),
        label(F.col("safety")).alias("safety_verdict"), label(F.col("security")).alias("security_verdict"),
        F.coalesce("n", F.lit(0).cast("long")).alias("findings"))


def aggregate_report(verdict_table: DataFrame, findings: DataFrame) -> DataFrame:
    """One row over all groups: groups, findings per dimension, overall verdict."""
    totals = findings.agg(
        F.count_if(F.col("dimension") == "Safety").alias("safety_findings"),
        F.count_if(F.col("dimension") == "Security").alias("security_findings"))
    return verdict_table.agg(
        F.count(F.lit(1)).alias("groups"),
        F.when(F.bool_or(F.col("verdict") == "FAIL"), "FAIL").otherwise("PASS").alias("verdict"),
    ).withColumns({
        "safety_findings": totals.select("safety_findings").scalar(),
        "security_findings": totals.select("security_findings").scalar()})


def ordered_section(findings: DataFrame, dimension: str) -> DataFrame:
    """Findings of one dimension by severity, then id."""
    rank = F.array_position(F.array(*[F.lit(s) for s in fixed.SEVERITY_ORDER]), F.col("severity"))
    return findings.filter(F.col("dimension") == dimension).orderBy("grp", rank, "finding_id")
