"""URL filters whose rules are indexed by their rarest literal token.

A rule is a host with a path prefix, or a pattern with wildcards, separators and anchors that becomes a regular expression.
Of the tokens that every URL it fits must contain, the one that is rarest in the URLs at hand is its key. The tokens of a
URL fetch the rules under them, and only these run.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, join_hot, saved

BROADCAST_RULES = 200_000  # rules up to which their index is broadcast
TOKEN = "[a-z0-9]+"


class Rule(NamedTuple):
    """A host rule fits its host and all subdomains where the path starts with its path. A pattern rule fits where its
    regular expression is found in the lower-cased host and path; its tokens are words that any such URL holds whole.
    Of pattern rules an allowing one is an exception: where it fits, no blocking one counts."""

    name: str
    action: str
    host: str | None = None
    path: str | None = None
    pattern: str | None = None
    tokens: tuple[str, ...] = ()


def host_rule(host: str, path: str, action: str) -> Rule:
    """Tokens: those of the host, and those of the path that the path itself ends, as the URL's may go on after it."""
    whole = re.findall(TOKEN, host.lower()) + [m[1] for m in re.finditer(f"({TOKEN})(?=[^A-Za-z0-9])", path.lower())]
    return Rule(host + path, action, host=host, path=path, tokens=tuple(dict.fromkeys(whole)))


def pattern_rule(text: str) -> Rule:
    """The rule that a pattern stands for. The host comes first, from a slash on it is the path.

    `*` is any run of characters (in the host, of other than slashes), `^` a separator (any character but letters, digits,
    underscores, dots, per cent signs and hyphens) or the end, `||` at the start the beginning of the host or of one of its
    labels, `|` at the start that of the host and at the end the end; `@@` before all makes it an exception. All else stands
    for itself. Tokens are the words that no wildcard touches and that the pattern bounds on both sides."""
    action, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    body, start = body.lower(), ""
    if body.startswith("||"):
        body, start = body[2:], "^([^/]*[.])?"
    elif body.startswith("|"):
        body, start = body[1:], "^"
    stop = body.endswith("|")
    body = body.removesuffix("|")
    host, slash, path = body.partition("/")
    if start:
        regex = start + "".join({"*": "[^/]*", "^": "([^a-z0-9_.%-]|$)"}.get(c, _literal(c)) for c in host)
    else:
        regex = "".join({"*": ".*", "^": "([^a-z0-9_.%-]|$)"}.get(c, _literal(c)) for c in host)
    regex += slash + "".join({"*": ".*", "^": "([^a-z0-9_.%-]|$)"}.get(c, _literal(c)) for c in path) + ("$" if stop else "")
    edged = ("^" if start else "*") + body + ("^" if stop else "*")
    whole = [m[1] for m in re.finditer(f"(?<=[^a-z0-9*])({TOKEN})(?=[^a-z0-9*])", edged)]
    return Rule(text, action, pattern=regex, tokens=tuple(dict.fromkeys(whole)))


def _literal(c: str) -> str:
    """A character for itself, as both Java's and RE2's expressions take it."""
    return c if c.isalnum() or c in "/-_%=&,:;~ " or not c.isascii() else f"[{c}]" if c not in "[]\\^" else "\\" + c


# The rules that the contract names.
CONTRACT = [
    host_rule("com", "/en/", "block"), host_rule("example.com", "/en/7", "allow"), host_rule("net", "/de/", "allow"),
    host_rule("example.net", "/de/8", "block"), host_rule("org", "/es/", "block"),
]
# What a corpus does without: subjects, by words of hosts and directories, and parts of sites that hold no text of their own.
SUBJECTS = """casino bets poker slots roulette jackpot lottery porn xxx escort hentai camgirls viagra cialis pills spam warez torrent cracks keygen serials
payday-loans quick-loans forex-signals crypto-giveaway replica-watches essay-writing fake-id hacks cheats""".split()
SERVED = "adserver adservice doubleclick ads banners tracking telemetry analytics pixel popunder affiliates".split()
PARTS = "cgi-bin wp-login wp-admin wp-json xmlrpc cart checkout basket signin signup logout unsubscribe password-reset captcha print share".split()
FILES = "css js json xml rss ico png jpg jpeg gif svg webp woff woff2 mp3 mp4 avi zip gz tar exe dmg apk iso".split()
TEMPLATES = {
    # a subject as a label of the host, at its start, end or inside, with or without a number; as a directory or the name of a file
    "subject": ["||{}.", "||{}-*.", "||*-{}.", "||*-{}-*.", "/{}/", "/{}^", "/{}-*-online^", "/best-{}-", "/{}."],
    "served": ["||{}.", "||*.{}.", "/{}/", "/{}.js^"],
    "part": ["/{}/", "/{}|", "/{}.php^"],
    "file": ["/*.{}|"],
    # pages that speak of a subject and not for it
    "exception": ["@@||{}-help.", "@@/{}-addiction^", "@@/stop-{}-", "@@/news/*/{}^"],
}
PATTERNS = [
    pattern_rule(template.format(word))
    for kind, words in (("subject", SUBJECTS), ("served", SERVED), ("part", PARTS), ("file", FILES), ("exception", SUBJECTS))
    for template in TEMPLATES[kind] for word in words
]


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(i, r.name, r.action, r.host, r.path, r.pattern, list(r.tokens)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "rid int, name string, action string, host string, path string, pattern string, tokens array<string>")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict (allow or block), patterns (names of the pattern rules
    that fit, sorted).

    The longest host rule that fits decides and is named in rule; without one rule is null, and a pattern rule that fits
    blocks unless an exception fits too. A null url or one without :// has an empty host and path, which no rule fits:
    allowed. Host rules of equal length that fit one URL are the same text; the first listed counts. Each distinct URL is
    judged once, however many rows hold it. Other columns are ignored; an empty table gives none. Rules without a token
    that their URLs must hold are refused.
    """
    if lost := [r.name for r in rules if not r.tokens]:
        raise ValueError(f"rules without a literal token: {lost}")
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col), F.col(url_col).alias("_url"))
    rows = rows.withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))}).drop("_url")
    urls = rows.groupBy("host", "path").agg(F.count("*").alias("times"))
    tokens = urls.withColumn("token", F.explode(F.array_distinct(F.regexp_extract_all(F.concat("host", F.lit("/"), ascii_lower(F.col("path"))), F.lit(f"({TOKEN})")))))
    table = _rules(spark, rules)
    near = F.broadcast if len(rules) <= BROADCAST_RULES else (lambda df: df)
    named = table.select(F.explode("tokens").alias("token")).distinct()
    tokens = saved(tokens.join(near(named), "token"))
    counts = tokens.groupBy("token").agg(F.sum("times").alias("times"))
    keyed = table.withColumn("token", F.explode("tokens")).join(counts, "token", "left")
    keyed = keyed.groupBy("rid").agg(F.min(F.struct(F.coalesce("times", F.lit(0)), "token"))["token"].alias("token")).join(table.drop("tokens"), "rid")
    found = tokens.join(near(keyed.withColumnsRenamed({"host": "r_host", "path": "r_path"})), "token")
    of_host = (F.col("host") == F.col("r_host")) | F.endswith("host", F.concat(F.lit("."), "r_host"))
    fits = F.when(F.col("pattern").isNull(), of_host & F.startswith("path", F.col("r_path"))).otherwise(
        F.rlike(F.concat("host", ascii_lower(F.col("path"))), F.col("pattern")))
    pattern = F.when(F.col("pattern").isNotNull(), F.col("name"))
    found = found.where(fits).groupBy("host", "path").agg(
        F.max(F.when(F.col("pattern").isNull(), F.struct(F.length("name"), -F.col("rid"), "name", "action"))).alias("best"),
        F.array_sort(F.collect_set(pattern)).alias("patterns"), F.count_if(F.col("pattern").isNotNull() & (F.col("action") == "allow")).alias("exceptions"), F.first("times").alias("times"),
    )
    out = join_hot(rows, saved(found), ["host", "path"], "times", rows.count(), "left")
    patterns = F.coalesce("patterns", F.array().cast("array<string>"))
    return out.select(
        id_col, "host", "path", F.col("best.name").alias("rule"),
        F.coalesce("best.action", F.when((F.size(patterns) > 0) & (F.col("exceptions") == 0), "block").otherwise("allow")).alias("verdict"), patterns.alias("patterns"),
    )


def oracle(rules: list[Rule]) -> str:
    """The same without an index, as DuckDB SQL over `pages`: every rule on every URL."""
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    listed = ", ".join(f"({i}, {', '.join(map(quote, (r.name, r.action, r.host, r.path)))})" for i, r in enumerate(rules) if r.host)
    patterns = ", ".join(f"({quote(r.name)}, {quote(r.action)}, {quote(r.pattern)})" for r in rules if r.pattern)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH rules(rid, name, action, r_host, r_path) AS (VALUES {listed}), patterns(p_name, p_action, pattern) AS (VALUES {patterns}),
u AS (SELECT page_id, {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
d AS (SELECT DISTINCT host, path FROM u),
r AS (SELECT host, path, max(struct_pack(n := length(name), i := -rid, name := name, action := action)) AS best FROM d, rules
  WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY ALL),
p AS (SELECT host, path, list_sort(list(DISTINCT p_name)) AS patterns, bool_or(p_action = 'allow') AS excepted FROM d, patterns
  WHERE regexp_matches(host || {lower.format("path")}, pattern) GROUP BY ALL)
SELECT page_id, host, path, best.name AS rule,
  coalesce(best.action, CASE WHEN patterns IS NULL OR excepted THEN 'allow' ELSE 'block' END) AS verdict, coalesce(patterns, []) AS patterns
FROM u LEFT JOIN r USING (host, path) LEFT JOIN p USING (host, path)"""
