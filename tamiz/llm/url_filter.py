"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame functions alone.

Each rule is a host and a path prefix, or a bare regular expression, with the literal tokens that any URL it fits
must hold. The index keys a rule by the one of its tokens that fewest URLs hold. A URL's tokens fetch candidate
rules by an equi-join, and only those candidates run their regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm.store import saved, small

#: Tokens of rules that are broadcast at most (rows of a few hundred bytes); a larger index is joined by a shuffle.
INDEX_ROWS = 200_000
#: Runs of these are tokens of a URL or a rule.
TOKEN = r"[^a-z0-9\x{80}-\x{10ffff}]+"
#: A rule with no literal token is fetched by this one, which every URL has.
ANY = "*"


@dataclass(frozen=True)
class Rule:
    """host and path fit the host, its subdomains and paths that start so; pattern fits anywhere in host + path."""

    verdict: str
    host: str = ""
    path: str = ""
    pattern: str = ""
    words: tuple[str, ...] = ()

    def name(self) -> str:
        return self.host + self.path if self.host else self.pattern

    def regex(self) -> str:
        return rf"^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}" if self.host else self.pattern

    def literals(self) -> list[str]:
        """Whole tokens that each fitting URL holds; a path's last one counts only where the path closes it."""
        if not self.host:
            return [w.lower() for w in self.words]
        split = r"[^a-z0-9\u0080-\U0010ffff]+"
        path = re.split(split, self.path.lower())
        return [t for t in re.split(split, self.host.lower()) + path[:-1] if t]


#: The rules asked for, and the method's own for the other URLs; URLs that none of them fits are allowed.
RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))
PATTERNS = (
    Rule("block", pattern=r"(^|[.-])casino[.-]", words=("casino",)),
    Rule("block", pattern=r"(^|[.-])adult[.-]", words=("adult",)),
    Rule("block", pattern=r"(^|[.-])spam[.-]", words=("spam",)),
    Rule("block", pattern=r"(^|[.-])ads[.-]", words=("ads",)),
)


def rule_table(spark: SparkSession, rules: tuple[Rule, ...] = RULES, patterns: tuple[Rule, ...] = PATTERNS) -> DataFrame:
    names = ["rule_id", "rule", "verdict", "regex", "listed", "size", "literals"]
    rows = [(i, r.name(), r.verdict, r.regex(), bool(r.host), len(r.name()), r.literals() or [ANY]) for i, r in enumerate((*rules, *patterns))]
    return spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for n, x in zip(names, row, strict=True))) for row in rows))))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, host, path, rule, verdict), one row for each row of pages.

    The longest rule that fits gives rule and verdict; of equally long ones the first listed. Where none fits, rule
    is null and the verdict is block if a pattern rule fits, else allow. A null url, or one without `://`, has an
    empty host and path, is fitted by no rule, and is allowed. Rows that repeat a url are judged once and joined
    back, but for those without host and path; null and repeated page_ids are kept. Other columns are not read. No pages
    give no rows, no rules allow all. What was judged is written to the shared folder, so that Spark can split the rows of
    a url that many pages have over several tasks.
    """
    rest = "case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end"
    split = pages.select("page_id", "url").withColumn("rest", F.expr(f"coalesce({rest}, '')"))
    split = split.withColumn("host", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).withColumn("path", F.expr(r"regexp_extract(substr(rest, length(host) + 1), r'^[^?#]*', 0)"))
    split = split.select("page_id", "url", "host", "path")
    urls = split.where("host <> '' or path <> ''").select("host", "path").distinct()
    tokens = urls.withColumn("token", F.explode(F.array_union(F.array_distinct(F.filter(F.split(F.lower(F.concat_ws("/", "host", "path")), TOKEN), lambda t: t != "")), F.array(F.lit(ANY)))))
    wanted = rules.select("rule_id", F.explode("literals").alias("token"))
    n_tokens = wanted.count()
    seen = tokens.join(small(wanted.select("token").distinct(), n_tokens, INDEX_ROWS), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    index = wanted.join(seen, "token", "left").groupBy("rule_id").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token")).join(rules, "rule_id")
    found = tokens.join(small(index, n_tokens, INDEX_ROWS), "token").where(F.expr("concat(host, path) rlike regex"))
    order = F.struct("size", -F.col("rule_id"))
    best = found.groupBy("host", "path").agg(
        F.max_by(F.when(F.col("listed"), F.struct("rule", "verdict")), F.when(F.col("listed"), order)).alias("best"),
        F.max(~F.col("listed") & (F.col("verdict") == "block")).alias("blocked"),
    )
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    judged = saved(best.select("host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict")), "judged")
    joined = split.where("host <> '' or path <> ''").join(judged, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    none = split.where("host = '' and path = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    return joined.select("page_id", "url", "host", "path", "rule", "verdict").unionByName(none)
