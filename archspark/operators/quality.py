"""Textual rules, debt markers, file profiles and the quality aggregates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from archspark.functions import text as tx
from archspark.functions.frames import half_even, let, rank_in, ratio, running, top_k
from archspark.functions.matching import feeds
from archspark.functions.paths import is_test_file
from archspark.schema import KEYS, SEVERITIES

MAX_FINDINGS = 250
MAX_MARKERS = 200


@dataclass(frozen=True)
class Rule:
    """One text rule; ``pattern`` is a Java regular expression over the whole text.

    Every hit holds one of ``literals``, lower-cased, so a text without them needs no search; none means that it is always searched.
    """

    id: str
    category: str
    severity: str
    title: str
    pattern: str
    why: str = ""
    fix: str = ""
    languages: tuple[str, ...] = ()
    ignore: str | None = None
    literals: tuple[str, ...] = ()


# What marks a matched credential as a placeholder.
PLACEHOLDER = (
    r"(?i)(?:os\.environ|getenv|process\.env|System\.getenv|config\[|settings\.|\$\{|\{\{|<[a-z_]+>|"
    r"xxx|placeholder|example|changeme|your[-_]?|dummy|sample|redacted|\*{3,}|null|none|empty)"
)
_JS = ("javascript", "typescript")

# Rule ids, severities, titles, patterns and language scopes.
RULES: tuple[Rule, ...] = (
    Rule("sec.hardcoded_secret", "security", "critical", "Hard-coded credential",
         r"""(?i)\b(?:password|passwd|pwd|secret|secret_key|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|"""
         r"""private[_-]?key|client[_-]?secret|connection[_-]?string)\b\s*[:=]\s*["'][^"'\n]{8,}["']""",
         "Anyone with the repository can read it, now and in its history.",
         "Read the value from a secret store and replace the exposed one.", ignore=PLACEHOLDER,
         literals=("password", "passwd", "pwd", "secret", "key", "token", "connection")),
    Rule("sec.private_key", "security", "critical", "Private key material in the repository",
         r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----",
         "The key lets any reader act as its owner.", "Delete and purge the key, then issue a new pair.",
         literals=("private key-----",)),
    Rule("sec.cloud_key", "security", "critical", "Cloud provider access key",
         r"\b(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|AIza[0-9A-Za-z_\-]{35}|sk-[A-Za-z0-9]{32,}|ghp_[A-Za-z0-9]{36})\b",
         "The key opens paid infrastructure.", "Revoke it and load keys from the provider's vault.",
         literals=("akia", "asia", "aiza", "sk-", "ghp_")),
    Rule("sec.sql_injection", "security", "critical", "SQL built by string concatenation",
         r"""(?is)(?:execute|executemany|query|raw|rawQuery|createQuery|prepareStatement)\s*\(\s*"""
         r"""(?:f?["'][^"']{0,200}\b(?:select|insert|update|delete|drop)\b[^"']{0,200}["']\s*(?:\+|%|\.format\(|,\s*\()|"""
         r"""["'][^"']{0,200}\b(?:select|insert|update|delete)\b[^"']{0,200}\{)""",
         "Text joined into SQL can change the statement.", "Bind parameters.",
         literals=("select", "insert", "update", "delete", "drop")),
    Rule("sec.command_injection", "security", "high", "Shell command execution",
         r"""(?:os\.system\s*\(|subprocess\.[A-Za-z_]+\([^)]*shell\s*=\s*True|child_process\.exec\s*\(|"""
         r"""Runtime\.getRuntime\(\)\.exec\s*\(|Process\.Start\s*\(|exec\.Command\s*\(\s*["'](?:sh|bash|cmd))""",
         "A shell interprets whatever text reaches it.", "Start the program with an argument list.",
         literals=("os.system", "subprocess.", "child_process", "getruntime", "process.start", "exec.command")),
    Rule("sec.dynamic_eval", "security", "high", "Dynamic code evaluation",
         r"""(?<![\w.])(?:eval|exec)\s*\(|new\s+Function\s*\(|setTimeout\s*\(\s*["']|Function\s*\(\s*["']""",
         "Evaluated text is code.", "Use a parser or a lookup table.",
         literals=("eval", "exec", "function", "settimeout")),
    Rule("sec.unsafe_deserialization", "security", "high", "Unsafe deserialization",
         r"(?:pickle\.loads?|cPickle\.loads?|marshal\.loads|yaml\.load\s*\((?![^)]*Safe)|"
         r"ObjectInputStream|BinaryFormatter|JsonConvert\.DeserializeObject<object>|unserialize\s*\()",
         "Loading can create any object and run code.", "Use a safe loader or check a signature first.",
         literals=("pickle.load", "marshal.load", "yaml.load", "objectinputstream", "binaryformatter", "deserializeobject", "unserialize")),
    Rule("sec.weak_crypto", "security", "high", "Weak or broken cryptography",
         r"""(?i)\b(?:md5|sha1)\s*\(|MessageDigest\.getInstance\s*\(\s*["'](?:MD5|SHA-?1)["']|"""
         r"""hashlib\.(?:md5|sha1)\b|new\s+(?:MD5|SHA1)CryptoServiceProvider|\bDES(?:ede)?\b|\bRC4\b|"""
         r"""Cipher\.getInstance\s*\(\s*["'][^"']*ECB""",
         "The algorithm is broken for secrets and integrity.", "Use SHA-256, argon2 or AES-GCM.",
         literals=("md5", "sha1", "sha-1", "des", "rc4", "ecb")),
    Rule("sec.tls_disabled", "security", "critical", "Certificate validation disabled",
         r"""(?:verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|"""
         r"""NODE_TLS_REJECT_UNAUTHORIZED\s*=\s*["']?0|ServerCertificateValidationCallback\s*(?:\+)?=|"""
         r"""TrustAllCerts|CURLOPT_SSL_VERIFYPEER\s*,\s*(?:false|0))""",
         "Nothing proves who answers the connection.", "Trust the right authority or pin the certificate.",
         literals=("verify", "rejectunauthorized", "node_tls_reject", "servercertificate", "trustallcerts")),
    Rule("sec.plaintext_transport", "security", "medium", "Plain-text HTTP endpoint",
         r"""["']http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|\{|\$)[A-Za-z0-9.\-]+""",
         "The traffic can be read and changed on its way.", "Use https.",
         literals=("http://",)),
    Rule("sec.permissive_cors", "security", "high", "Wildcard CORS policy",
         r"""(?:Access-Control-Allow-Origin["']?\s*[:,]\s*["']\*|allow_origins\s*=\s*\[\s*["']\*|"""
         r"""origin\s*:\s*["']\*|AllowAnyOrigin\s*\(\s*\))""",
         "Every site may call with the visitor's credentials.", "List the allowed origins.",
         literals=("origin",)),
    Rule("sec.debug_enabled", "security", "medium", "Debug mode enabled in code",
         r"(?:debug\s*=\s*True|DEBUG\s*=\s*True|app\.run\([^)]*debug\s*=\s*True|UseDeveloperExceptionPage\s*\()",
         "Debug pages show internals.", "Set the flag from configuration.",
         literals=("debug", "usedeveloperexceptionpage")),
    Rule("sec.xss_sink", "security", "high", "Unescaped HTML sink",
         r"(?:innerHTML\s*=|outerHTML\s*=|document\.write\s*\(|dangerouslySetInnerHTML|v-html\s*=|\|\s*safe\b|Html\.Raw\s*\()",
         "Raw text in a page can be script.", "Set text content or sanitise.",
         languages=("javascript", "typescript", "python", "csharp", "java"),
         literals=("innerhtml", "outerhtml", "document.write", "v-html", "safe", "html.raw")),
    Rule("sec.weak_random", "security", "medium", "Predictable randomness for a secret",
         r"(?i)(?:token|secret|password|salt|nonce|session|otp|key)\s*=\s*[^;\n]*"
         r"\b(?:Math\.random|random\.random|random\.randint|rand\.Int|new\s+Random)\s*\(",
         "The generator can be predicted.", "Use a cryptographic generator.",
         literals=("random", "rand.int")),
    Rule("sec.privileged_container", "security", "high", "Over-privileged container",
         r"(?:privileged\s*:\s*true|USER\s+root|runAsUser\s*:\s*0|--cap-add[= ]ALL|allowPrivilegeEscalation\s*:\s*true)",
         "The container can leave its isolation.", "Run as a plain user with single capabilities.",
         languages=("docker", "yaml", "shell"),
         literals=("privileged", "user", "cap-add", "allowprivilege")),
    Rule("perf.select_star", "performance", "medium", "SELECT * query", r"(?i)select\s+\*\s+from\s+\w",
         "All columns travel whether used or not.", "Name the columns.",
         literals=("select",)),
    Rule("perf.await_in_loop", "performance", "medium", "Sequential await inside a loop",
         r"(?m)^\s*(?:for|while)\b[^\n]*\n(?:[^\n]*\n){0,4}?[^\n]*\bawait\b",
         "Each round waits for the one before.", "Gather the tasks and await them together.",
         languages=("javascript", "typescript", "python", "csharp"),
         literals=("await",)),
    Rule("perf.query_in_loop", "performance", "high", "Database query inside a loop (N+1)",
         r"(?mi)^\s*(?:for|foreach|while)\b[^\n]*\n(?:[^\n]*\n){0,4}?[^\n]*"
         r"(?:\.query\(|\.filter\(|\.findOne\(|\.findById\(|\.findMany\(|\.fetchone\(|"
         r"\.execute\(|session\.get\(|repository\.\w+\(|SELECT\s+\w)",
         "The number of statements grows with the rows.", "Fetch all rows with one statement.",
         literals=("for", "while")),
    Rule("perf.blocking_sleep", "performance", "medium", "Blocking sleep on an async path",
         r"(?m)^\s*(?:async\s+def|async\s+function)[^\n]*\n(?:[^\n]*\n){0,20}?[^\n]*"
         r"\b(?:time\.sleep|Thread\.sleep|Thread\.Sleep)\s*\(",
         "The event loop stands still.", "Use the asynchronous sleep.",
         languages=("python", "javascript", "typescript", "csharp", "java"),
         literals=("sleep",)),
    Rule("perf.unbounded_fetch", "performance", "low", "Unbounded result set",
         r"(?i)(?:\.all\(\)|findAll\(\s*\)|\.ToList\(\)|fetchall\(\))(?![^\n]*\b(?:limit|take|top|slice)\b)",
         "A whole table may not fit in memory.", "Page or stream the rows.",
         literals=("all()", "findall(", "tolist()")),
    Rule("perf.sync_io_in_request", "performance", "low", "Synchronous file I/O on a request path",
         r"(?:readFileSync|writeFileSync|existsSync)\s*\(",
         "One call holds up every request.", "Use the asynchronous calls.", languages=_JS,
         literals=("filesync", "existssync")),
    Rule("debt.silent_failure", "debt", "high", "Silently swallowed exception",
         r"(?m)(?:except[^\n:]*:\s*\n\s*(?:pass|\.\.\.)\s*$|catch\s*\([^)]*\)\s*\{\s*\}|"
         r"catch\s*\([^)]*\)\s*\{\s*//[^\n]*\n\s*\}|rescue\s*\n\s*end)",
         "The error leaves no trace.", "Log it or let it rise.",
         literals=("except", "catch", "rescue")),
    Rule("debt.broad_except", "debt", "medium", "Catch-all exception handler",
         r"(?:except\s+(?:BaseException|Exception)?\s*:|catch\s*\(\s*(?:Exception|Throwable|System\.Exception)\s+\w+\s*\)|catch\s*\{)",
         "Programming errors hide behind expected ones.", "Catch the types you can handle.",
         literals=("except", "catch")),
    Rule("debt.magic_number", "debt", "low", "Unexplained magic number",
         r"""(?<![\w."'])(?:if|while|return|=|<|>|\+|\-|\*)\s*(?:\w+\s*[<>=!]=?\s*)?\b\d{4,}\b(?!\s*[)\]]?\s*[;,]?\s*(?://|#))""",
         "A bare number has no meaning to check.", "Name the value."),
    Rule("debt.console_logging", "debt", "low", "Ad-hoc console logging",
         r"(?<![\w.])(?:console\.(?:log|debug)|print\s*\(|System\.out\.println|fmt\.Println)\s*\(",
         "The output has no level and no target.", "Use the project's logger.",
         languages=("javascript", "typescript", "java", "go"),
         literals=("console.", "print")),
    Rule("debt.loose_typing", "debt", "medium", "Type system escape hatch",
         r"(?::\s*any\b|as\s+any\b|@ts-ignore|@ts-nocheck|# type:\s*ignore|dynamic\s+\w+\s*=|Object\s+\w+\s*=\s*\()",
         "The checker no longer sees the value.", "Give the exact type.",
         languages=("typescript", "python", "csharp", "java"),
         literals=("any", "@ts-", "type:", "dynamic", "object")),
)

# Debt marker words.
MARKER_WORDS = ("TODO", "FIXME", "HACK", "XXX", "WORKAROUND", "TEMPORARY", "KLUDGE")
MARKER = r"(?i)(?<![A-Za-z])(" + "|".join(MARKER_WORDS) + r")\b[:\s-]*(.{0,90})"


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rule table, for joining titles and advice onto findings."""
    return spark.createDataFrame(
        [(r.id, r.category, r.severity, r.title, r.why, r.fix) for r in rules],
        "rule string, category string, severity string, title string, why string, fix string",
    )


def snippet(line: Column) -> Column:
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(F.char_length(line) > 140, F.concat(F.substring(line, 1, 140), F.lit("…"))).otherwise(line)


def literal_search(literals: Iterable[str]) -> str:
    """A pattern that finds at every place the longest literal that starts there, in one pass over the text.

    The literals are folded into a tree by common beginnings, so a place is left at the first letter on no branch.
    """
    tree: dict = {}
    for literal in literals:
        node = tree
        for letter in literal:
            node = node.setdefault(letter, {})
        node[""] = {}

    def branch(node: dict) -> str:
        ways = [re.sub(r"([^\w\s])", r"\\\1", letter) + branch(below) for letter, below in sorted(node.items()) if letter]
        if not ways:
            return ""
        joined = ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"
        return f"(?:{joined})?" if "" in node else joined

    return f"(?=({branch(tree)}))"


def matching_rules(
    text: Column, language: Column, is_test: Column, rules: Sequence[Rule] = RULES
) -> Column:
    """Rules that apply to the file and occur in it; security rules skip test files.

    One pass finds the literals of all rules; a rule's own pattern is tried only where one of its literals occurs, or a longer one that
    holds it.
    """
    every = sorted({x for rule in rules for x in rule.literals})

    def tests(found: Column) -> Column:
        rows = []
        for rule in rules:
            scope = text.rlike(rule.pattern)
            if rule.literals:
                holds = [x for x in every if any(y in x for y in rule.literals)]
                scope = F.arrays_overlap(found, F.array(*[F.lit(x) for x in holds])) & scope
            if rule.category == "security":
                scope = ~is_test & scope
            if rule.languages:
                scope = language.isin(*rule.languages) & scope
            row = F.struct(
                F.lit(rule.id).alias("rule"), F.lit(rule.category).alias("category"),
                F.lit(rule.severity).alias("severity"), F.lit(rule.pattern).alias("pattern"),
                F.lit(rule.ignore).cast("string").alias("ignore"),
            )
            rows.append(F.when(scope, row))
        return F.array_compact(F.array(*rows))

    if not every:
        return tests(F.array().cast("array<string>"))
    found = F.regexp_extract_all(F.lower(text), F.lit(literal_search(every)), F.lit(1))
    return let(F.array_distinct(found), tests)


def rule_hits(rule: Column, text: Column, lines: Column, limit: int | None = None) -> Column:
    """Hits of one rule in text order (the first ``limit``, if given), as an array of finding structs.

    A lazy group in front of the rule yields the text before each hit, so the line
    is one plus the line feeds met so far.  ``\\G`` ties each search to the end of
    the one before; without it the text after the last hit costs quadratic time.
    """
    fragments = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    before = F.regexp_extract_all(
        text, F.concat(F.lit(r"\G(?s:(.*?))(?:"), rule["pattern"], F.lit(")")), F.lit(1)
    )

    def placed(held: Column) -> Column:
        upto = running(F.zip_with(held["before"], held["fragments"], lambda b, f: feeds(b) + feeds(f)))
        return F.zip_with(held["fragments"], upto, lambda f, n: F.struct((n - feeds(f) + 1).alias("line"), f.alias("fragment")))

    every = let(F.struct(fragments.alias("fragments"), before.alias("before")), placed)
    hits = F.filter(every, lambda h: ~F.coalesce(F.rlike(h["fragment"], rule["ignore"]), F.lit(False)))
    return F.transform(
        hits if limit is None else F.slice(hits, 1, limit),
        lambda h: F.struct(
            rule["rule"].alias("rule"), rule["category"].alias("category"), rule["severity"].alias("severity"),
            h["line"].alias("line"),
            snippet(F.coalesce(F.try_element_at(lines, h["line"]), h["fragment"])).alias("snippet"),
        ),
    )


def file_findings(matched: Column, text: Column, lines: Column) -> Column:
    """All hits of the matched rules of one file; the text is split into lines once."""
    held = F.struct(matched.alias("matched"), lines.alias("lines"))
    return let(held, lambda h: F.flatten(F.transform(h["matched"], lambda rule: rule_hits(rule, text, h["lines"]))))


def file_markers(lines: Column, limit: int | None = None) -> Column:
    """First marker of each line; with a ``limit``, of the first so many lines that have one."""
    numbered = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("content")))
    hits = F.filter(numbered, lambda x: x["content"].rlike(MARKER))
    hits = hits if limit is None else F.slice(hits, 1, limit)
    return F.transform(
        hits,
        lambda x: F.struct(
            F.upper(F.regexp_extract(x["content"], MARKER, 1)).alias("marker"),
            F.trim(F.regexp_extract(x["content"], MARKER, 2)).alias("note"),
            x["line"].alias("line"),
        ),
    )


def profile_files(files: DataFrame, keys: Sequence[str] = KEYS, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per code file with its counters, findings and markers; the text is read once and dropped.

    Everything is an in-row expression, so the job is a scan without a shuffle.
    Write the result and derive the other quality tables from it.
    """
    language, text = F.col("language"), F.col("text")
    code = files.filter(language.isin(*tx.CODE_LANGUAGES) & (text != ""))
    staged = code.withColumn("lines", tx.text_lines(text)).withColumn("is_test", is_test_file(F.col("path")))
    staged = staged.withColumn("matched", matching_rules(text, language, F.col("is_test"), rules))
    return staged.select(
        *keys, "path", "module", "language", "is_test",
        F.size("lines").alias("loc"),
        tx.line_stats(F.col("lines"), language).alias("stats"),
        tx.long_lines(F.col("lines")).alias("long_lines"),
        tx.deprecated_count(text).alias("deprecated"),
        tx.assertion_count(text, F.col("is_test")).alias("assertions"),
        (~F.col("is_test") & tx.has_module_doc(text, language)).alias("documented"),
        file_findings(F.col("matched"), text, F.col("lines")).alias("findings"),
        file_markers(F.col("lines")).alias("markers"),
    ).select(
        *keys, "path", "module", "language", "is_test", "loc",
        F.col("stats.code").alias("code_lines"), F.col("stats.comment").alias("comment_lines"),
        F.col("stats.blank").alias("blank_lines"), "long_lines", "deprecated", "assertions", "documented",
        "findings", "markers",
    )


def file_profiles(profiled: DataFrame) -> DataFrame:
    """Counters only: the arrays become counts."""
    risky = F.filter("findings", lambda f: f["severity"].isin("critical", "high"))
    return profiled.withColumns({
        "risk_findings": F.size(risky),
        "findings": F.size("findings"),
        "markers": F.size("markers"),
    })


def findings_of(profiled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return profiled.select(*keys, F.col("path").alias("file"), F.explode("findings").alias("f")).select(
        *keys, "file", "f.*"
    )


def markers_of(profiled: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return profiled.select(*keys, F.col("path").alias("file"), F.explode("markers").alias("m")).select(
        *keys, "file", "m.*"
    )


def scan_rules(files: DataFrame, keys: Sequence[str] = KEYS, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Findings of a file table without the other measures."""
    text = F.col("text")
    matched = matching_rules(text, F.col("language"), is_test_file(F.col("path")), rules)
    staged = files.withColumn("matched", matched).filter(F.size("matched") > 0)
    found = file_findings(F.col("matched"), text, tx.text_lines(text))
    return staged.select(*keys, F.col("path").alias("file"), F.explode(found).alias("f")).select(*keys, "file", "f.*")


def scan_markers(files: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    found = file_markers(tx.text_lines(F.col("text")))
    return files.select(*keys, F.col("path").alias("file"), F.explode(found).alias("m")).select(*keys, "file", "m.*")


def top_findings(findings: DataFrame, keys: Sequence[str] = KEYS, limit: int = MAX_FINDINGS) -> DataFrame:
    """Most severe findings first, then by file and line."""
    order = [rank_in(F.col("severity"), SEVERITIES), F.col("file"), F.col("line"), F.col("rule")]
    return top_k(findings, keys, order, limit, rank="seq")


def top_markers(markers: DataFrame, keys: Sequence[str] = KEYS, limit: int = MAX_MARKERS) -> DataFrame:
    return top_k(markers, keys, [F.col("file"), F.col("line")], limit, rank="seq")


def describe_findings(findings: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add title, why and fix; the rule list is a fixed small table."""
    frame = rules_frame(findings.sparkSession, rules).select("rule", "title", "why", "fix")
    return findings.join(F.broadcast(frame), "rule", "left")


def finding_counts(findings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Category by severity over all findings, before any cap."""
    counted = findings.groupBy(*keys, "category").pivot("severity", list(SEVERITIES)).count()
    return counted.fillna(0, subset=list(SEVERITIES))


def marker_counts(markers: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return markers.groupBy(*keys, "marker").agg(F.count("*").alias("n"))


def quality_totals(profiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    test, loc = F.col("is_test"), F.col("loc")
    plain = {c: F.sum(c) for c in ("loc", "code_lines", "comment_lines", "blank_lines", "long_lines", "deprecated")}
    return profiles.groupBy(*keys).agg(
        F.count("*").alias("files"),
        *[c.alias(n) for n, c in plain.items()],
        F.count_if(test).alias("test_files"),
        F.count_if(~test).alias("source_files"),
        F.sum(F.when(test, loc).otherwise(0)).alias("test_loc"),
        F.sum(F.when(test, 0).otherwise(loc)).alias("source_loc"),
        F.sum("assertions").alias("assertions"),
        F.count_if(F.col("documented")).alias("documented_modules"),
        F.count_if(~test & (loc >= tx.HUGE_FILE)).alias("huge_files"),
        F.count_if(~test & (loc >= tx.LARGE_FILE) & (loc < tx.HUGE_FILE)).alias("large_files"),
    )


def doc_totals(files: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Markdown pages and their words."""
    pages = files.filter(F.col("language") == "markdown")
    return pages.groupBy(*keys).agg(
        F.count("*").alias("doc_pages"), F.sum(tx.doc_words(F.col("text"))).alias("doc_words")
    )


def largest_files(profiles: DataFrame, keys: Sequence[str] = KEYS, limit: int = 15, min_loc: int = 0) -> DataFrame:
    rows = profiles.filter(~F.col("is_test") & (F.col("loc") >= min_loc))
    return top_k(rows, keys, [F.desc("loc"), F.col("path")], limit, rank="rank").select(
        *keys, "rank", "path", "module", "language", "loc"
    )


def untested_modules(profiles: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = None) -> DataFrame:
    """Modules with source files and no test files, test folder names removed."""
    modules = profiles.select(*keys, "module", "is_test").distinct()
    source = modules.filter(~F.col("is_test")).select(*keys, "module")
    bare = F.regexp_replace(F.regexp_replace("module", "/tests", ""), "/test", "")
    tested = modules.filter("is_test").select(*keys, bare.alias("module")).distinct()
    left = source.join(tested, [*keys, "module"], "left_anti")
    return left if limit is None else top_k(left, keys, [F.col("module")], limit, rank="seq")


def untested_rollup(profiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    modules = profiles.filter(~F.col("is_test")).groupBy(*keys).agg(F.count_distinct("module").alias("module_count"))
    missing = untested_modules(profiles, keys, None).groupBy(*keys).agg(F.count("*").alias("untested"))
    return modules.join(missing, list(keys), "left").select(
        *keys, "module_count",
        (F.col("module_count") - F.coalesce("untested", F.lit(0))).alias("tested_module_count"),
    )


# --------------------------------------------------------------------------- symbols


def public_symbols(nodes: DataFrame) -> DataFrame:
    """Types and callables that are neither external, private nor in a test file."""
    kinds = ("class", "interface", "abstract_class", "function", "method")
    return nodes.filter(
        F.col("kind").isin(*kinds) & ~F.col("external")
        & (F.coalesce(F.col("attr.visibility"), F.lit("")) != "private")
        & ~F.col("name").startswith("_")
        & ~F.coalesce(F.col("attr.is_test"), F.lit(False))
        & ~is_test_file(F.coalesce(F.col("file"), F.lit("")))
    )


def _shown_name() -> Column:
    return F.when(F.col("qualified_name") != "", F.col("qualified_name")).otherwise(F.col("name"))


def symbol_doc_coverage(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    documented = F.trim(F.coalesce(F.col("attr.docstring"), F.lit(""))) != ""
    return public_symbols(nodes).groupBy(*keys).agg(
        F.count("*").alias("public_symbols"),
        F.count_if(documented).alias("documented_symbols"),
        half_even(F.count_if(documented) / F.count("*"), 4).alias("coverage"),
    )


def undocumented_symbols(nodes: DataFrame, keys: Sequence[str] = KEYS, limit: int = 25) -> DataFrame:
    rows = public_symbols(nodes).filter(F.trim(F.coalesce(F.col("attr.docstring"), F.lit(""))) == "")
    return top_k(rows, keys, [F.col("id")], limit, rank="seq").select(
        *keys, "seq", _shown_name().alias("name"), "kind", "file", "line"
    )


def integer_profile(values: DataFrame, keys: Sequence[str], value: str, over: int = 11) -> DataFrame:
    """Count, mean, upper median, p90, maximum and threshold count of an integer measure, exactly.

    Percentiles are positions in the sorted list.  The list is never built: values
    are counted first, and a running sum over the distinct values finds the position.
    """
    counted = values.groupBy(*keys, F.col(value).cast("bigint").alias("v")).agg(F.count("*").alias("n"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("measured"))
    running = F.sum("n").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumn("upto", running).join(totals, list(keys))
    n, v = F.col("measured"), F.col("v")
    return placed.groupBy(*keys).agg(
        F.first("measured").alias("measured"),
        half_even(F.sum(v * F.col("n")) / F.sum("n"), 2).alias("average"),
        F.min(F.when(F.col("upto") > F.floor(n / 2), v)).alias("median"),
        F.min(F.when(F.col("upto") > F.floor(n * F.lit(0.9)), v)).alias("p90"),
        F.max(v).alias("max"),
        F.sum(F.when(v >= over, F.col("n")).otherwise(0)).alias("over_threshold"),
    )


# Histogram buckets.
BUCKETS = (("1-5", 1, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-50", 21, 50), ("50+", 51, None))


def histogram(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count per bucket; every bucket of every key has a row."""
    v = F.col(value)
    counts = values.groupBy(*keys).agg(
        *[F.count_if((v >= low) if high is None else v.between(low, high)).alias(label) for label, low, high in BUCKETS]
    )
    return counts.unpivot(list(keys), [F.col(f"`{b[0]}`") for b in BUCKETS], "label", "count")


def callables(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isin("function", "method") & ~F.col("external"))


def complexity_profile(nodes: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rows = callables(nodes).filter("attr.complexity is not null")
    return integer_profile(rows.select(*keys, F.col("attr.complexity").alias("c")), keys, "c")


def complex_functions(nodes: DataFrame, keys: Sequence[str] = KEYS, limit: int = 20) -> DataFrame:
    c = F.col("attr.complexity")
    rows = callables(nodes).filter(c >= 11).withColumn("complexity", c)
    return top_k(rows, keys, [F.desc("complexity"), F.col("id")], limit, rank="seq").select(
        *keys, "seq", _shown_name().alias("name"), "file", "line", "complexity",
        F.when(F.col("complexity") >= 21, "high").otherwise("medium").alias("severity"),
    )


def wide_signatures(nodes: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = None) -> DataFrame:
    """Callables with six parameters or more, widest first; all of them unless a ``limit`` is given."""
    rows = callables(nodes).withColumn("params", F.size(F.coalesce("attr.params", F.array()))).filter("params >= 6")
    shown = _shown_name().alias("name")
    if limit is None:
        return rows.select(*keys, shown, "file", "line", "params")
    return top_k(rows, keys, [F.desc("params"), F.col("id")], limit, rank="seq").select(*keys, "seq", shown, "file", "line", "params")


# --------------------------------------------------------------------------- file risk


def file_risk(profiles: DataFrame, churn: DataFrame, keys: Sequence[str] = KEYS, limit: int | None = 300) -> DataFrame:
    """Weighted risk per file: risky and other findings, markers, size and churn.

    ``limit`` is held between 20 and 2000; ``None`` ranks nothing and keeps all rows.
    """
    rows = profiles.join(churn.select(*keys, "path", F.col("changes").alias("churn")), [*keys, "path"], "left")
    churned, risky = F.coalesce("churn", F.lit(0)), F.col("risk_findings")
    risk = (
        risky * 6 + (F.col("findings") - risky) * 2 + F.col("markers")
        + F.least(F.col("loc") / 120, F.lit(8.0)) + F.least(churned / 4, F.lit(10.0))
    )
    scored = rows.withColumns({"churn": churned.cast("bigint"), "risk": half_even(risk, 1)}).select(
        *keys, "path", "module", "language", "is_test", "loc", "findings", "risk_findings", "markers", "churn", "risk"
    )
    if limit is None:
        return scored
    return top_k(scored, keys, [F.desc("risk"), F.col("path")], max(20, min(limit, 2000)), rank="rank")


def risk_band(risk: Column) -> Column:
    return F.when(risk >= 25, "danger").when(risk >= 12, "warning").otherwise("normal")


def filter_hotspots(rows: DataFrame, text: str) -> DataFrame:
    """Rows whose path, module or language contains the text, ignoring case."""
    needle = text.strip().lower()
    tests = [F.lower(c).contains(needle) for c in ("path", "module", "language")]
    return rows.filter(reduce(lambda a, b: a | b, tests)) if needle else rows


def hotspot_kpis(risks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return risks.groupBy(*keys).agg(
        F.count("*").alias("files"),
        F.count_if(F.col("risk_findings") > 0).alias("risky_files"),
        F.count_if(F.col("is_test")).alias("test_files"),
    )


def language_mix(files: DataFrame, keys: Sequence[str] = KEYS, limit: int = 8) -> DataFrame:
    counted = files.groupBy(*keys, "language").agg(F.count("*").alias("files"))
    return top_k(counted, keys, [F.desc("files"), F.col("language")], limit, rank="rank")


def annotate_quality(nodes: DataFrame, profiles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Copy the counters of a file onto its file node."""
    counters = ("loc", "findings", "risk_findings", "is_test")
    side = profiles.select(
        *keys, F.concat(F.lit("file:"), F.col("path")).alias("id"), *[F.col(c).alias(f"_{c}") for c in counters],
        F.col("markers").alias("_debt_markers"),
        *[F.col(c).cast("string").alias(f"_{c}") for c in ("code_lines", "comment_lines", "blank_lines", "long_lines")],
    )
    joined = nodes.join(side, [*keys, "id"], "left")
    attr = F.col("attr")
    for c in (*counters, "debt_markers"):
        attr = attr.withField(c, F.coalesce(F.col(f"_{c}"), F.col(f"attr.{c}")))
    wanted = ("code_lines", "comment_lines", "blank_lines", "long_lines")
    extra = F.coalesce(F.col("attr.extra"), F.create_map().cast("map<string,string>"))
    counts = F.create_map(*[x for c in wanted for x in (F.lit(c), F.col(f"_{c}"))])
    attr = attr.withField(
        "extra",
        F.when(
            F.col("_code_lines").isNotNull(),
            F.map_concat(F.map_filter(extra, lambda k, _: ~k.isin(*wanted)), counts),
        ).otherwise(F.col("attr.extra")),
    )
    return joined.withColumn("attr", attr).select(*nodes.columns)


def file_detail(
    nodes: DataFrame, findings: DataFrame, markers: DataFrame, keys: Sequence[str] = KEYS, max_symbols: int = 200
) -> tuple[DataFrame, DataFrame]:
    """Detail of every file: its shown findings and markers, and its symbols by line.

    ``findings`` is the kept list of :func:`top_findings`; ``findings_truncated``
    tells that the file has more than the list shows.
    """
    per_file = [*keys, "file"]
    shown = findings.groupBy(*per_file).agg(
        F.array_sort(
            F.collect_list(F.struct(rank_in(F.col("severity"), SEVERITIES).alias("severity_rank"), "line", "rule", "severity", "snippet"))
        ).alias("shown")
    )
    marks = markers.groupBy(*per_file).agg(F.array_sort(F.collect_list(F.struct("line", "marker", "note"))).alias("markers"))
    files = nodes.filter(F.col("kind") == "file").select(
        *per_file, "module", "language", F.col("attr.loc").alias("loc"), F.col("attr.is_test").alias("is_test"),
        F.coalesce(F.col("attr.findings"), F.lit(0)).alias("findings_reported"),
        F.col("attr.change_count").alias("changes"), F.col("attr.authors").alias("authors"),
    )
    detail = files.join(shown, per_file, "left").join(marks, per_file, "left").withColumn(
        "findings_truncated", F.col("findings_reported") > F.coalesce(F.size("shown"), F.lit(0))
    )
    kinds = ("class", "interface", "abstract_class", "struct", "function", "method")
    symbols = nodes.filter(F.col("kind").isin(*kinds) & ~F.col("external")).select(
        *per_file, "id", "name", "kind", "line", F.col("attr.complexity").alias("complexity"),
        (F.trim(F.coalesce(F.col("attr.docstring"), F.lit(""))) != "").alias("documented"),
    )
    return detail, top_k(symbols, per_file, [F.col("line"), F.col("id")], max_symbols, rank="seq")
