"""robots.txt: lexer, groups, wildcard rules, verdicts, crawler access. Native expressions, windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, text
from . import nodes as N

READ_BYTES, WARNINGS = 512_000, 100
#: Statuses of a file that is not there.
ABSENT = (404, 410)
RULES = ("allow", "disallow")
CLOSING = (*RULES, "crawl-delay", "host", "clean-param", "noindex")


def lines(robots: DataFrame) -> DataFrame:
    """(origin, line, field, value) of each line with a field, of robots(origin, status, body)."""
    body = F.make_valid_utf8(F.substring(F.coalesce("body", F.lit("")).cast("binary"), 1, READ_BYTES).cast("string"))
    there = robots.where(~F.coalesce(F.col("status").isin(*ABSENT), F.lit(False)))
    each = there.select("origin", F.posexplode(F.split(body, r"\r\n|\r|\n", -1)).alias("line", "raw"))
    bare = each.withColumn("bare", text.trimmed(F.regexp_replace("raw", "#.*$", "")))
    colon = F.instr("bare", ":")
    return bare.where(F.col("bare") != "").select(
        "origin", "line", F.when(colon > 0, F.lower(text.trimmed(F.substring_index("bare", ":", 1)))).alias("field"), F.when(colon > 0, text.trimmed(F.expr("substring(bare, instr(bare, ':') + 1)"))).alias("value")
    )


def rules(robots: DataFrame) -> DataFrame:
    """(origin, group_id, agent, ordinal, type, path, crawl_delay): each agent of a group with each of its rules; a group without rules has one row with null type.

    A user-agent line opens a group unless the line before, of those that count, is one too.
    """
    kept = lines(robots).where(((F.col("field") == "user-agent") & (F.col("value") != "")) | F.col("field").isin(*CLOSING))
    order = Window.partitionBy("origin").orderBy("line")
    is_agent = F.col("field") == "user-agent"
    seen = F.max(is_agent.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumns({"is_agent": is_agent, "seen": seen}).where("seen = 1")
    opens = F.col("is_agent") & ~F.coalesce(F.lag("is_agent").over(order), F.lit(False))
    kept = kept.withColumn("group_id", F.sum(opens.cast("int")).over(order))
    empty = (F.col("field") == "disallow") & (F.col("value") == "")
    delay = F.expr("try_cast(nullif(regexp_extract(value, '^([+-]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+))', 1), '') as double)")
    is_delay = F.col("field") == "crawl-delay"
    groups = kept.groupBy("origin", "group_id").agg(
        F.collect_set(F.when(F.col("is_agent"), F.lower("value"))).alias("agents"),
        F.array_sort(F.collect_list(F.when(F.col("field").isin(*RULES), F.struct(F.col("line").alias("ordinal"), F.when(empty, F.lit("allow")).otherwise(F.col("field")).alias("type"), F.when(empty, F.lit("/")).otherwise(F.col("value")).alias("path"))))).alias("rules"),
        F.min_by(F.when(is_delay, delay), F.when(is_delay & delay.isNotNull(), F.col("line"))).alias("crawl_delay"),
    )
    each = groups.select("origin", "group_id", "crawl_delay", "rules", F.explode("agents").alias("agent"))
    return each.select("origin", "group_id", "agent", "crawl_delay", F.explode_outer("rules").alias("r")).select("origin", "group_id", "agent", "r.ordinal", "r.type", "r.path", "crawl_delay")


def sitemaps(robots: DataFrame) -> DataFrame:
    """(origin, pos, url) of sitemap lines, in groups or not."""
    return lines(robots).where("field = 'sitemap' and value <> ''").select("origin", F.col("line").alias("pos"), F.col("value").alias("url"))


def warnings(robots: DataFrame) -> DataFrame:
    """(origin, line, code) of lines that say nothing: no colon, an empty agent, a rule before any agent, an unknown field."""
    order = Window.partitionBy("origin").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    named = (F.col("field") == "user-agent") & (F.col("value") != "")
    each = lines(robots).withColumn("after_agent", F.coalesce(F.max(named.cast("int")).over(order), F.lit(0)) == 1)
    code = (
        F.when(F.col("field").isNull(), "no_colon").when((F.col("field") == "user-agent") & (F.col("value") == ""), "empty_agent")
        .when(F.col("field").isin(*RULES) & ~F.col("after_agent"), "rule_before_agent").when(~F.col("field").isin("user-agent", "sitemap", *CLOSING), "unknown_field")
    )
    return each.withColumn("code", code).where("code is not null").select("origin", "line", "code")


def _locate(part: Column, path: Column, start: Column) -> Column:
    """1-based place of part in path from start on, 0 if there is none."""
    return F.call_function("locate", part, path, start)


def matches(pattern: Column, path: Column) -> Column:
    """Prefix match with * for any run and a $ at the end for the end of the path. A fold over literals, never a regex."""
    anchored = pattern.endswith("$")
    bare = F.regexp_replace(pattern, r"\$$", "")
    parts = F.split(F.regexp_replace(bare, r"\*+", "*"), r"\*", -1)
    first, n = F.get(parts, F.lit(0)), F.size(parts)
    last = F.element_at(parts, -1)

    def forward(pos: Column, part: Column) -> Column:
        at = _locate(part, path, pos)
        return F.when(pos < 0, pos).when(part == "", pos).when(at == 0, F.lit(-1)).otherwise(at + F.length(part))

    middle = F.aggregate(F.slice(parts, F.lit(2), F.greatest(n - 2, F.lit(0))), F.length(first) + 1, forward)
    ends = F.when(last == "", F.lit(True)).otherwise(F.when(anchored, path.endswith(last) & (F.length(path) - F.length(last) + 1 >= middle)).otherwise(_locate(last, path, middle) > 0))
    fits = F.when(n == 1, F.when(anchored, path == first).otherwise(path.startswith(first))).otherwise(path.startswith(first) & (middle > 0) & ends)
    return F.coalesce(fits & (F.length(pattern) <= fixed.PATTERN_MOST), F.lit(False))


def literal_prefix(pattern: Column) -> Column:
    """What every path that a pattern matches begins with: all before the first * and without a $ at the end."""
    return F.substring_index(F.regexp_replace(pattern, r"\$$", ""), "*", 1)


def _able() -> Column:
    return F.col("type").isNotNull() & (F.col("path") != "") & (F.length("path") <= fixed.PATTERN_MOST)


def rule_index(robots: DataFrame) -> DataFrame:
    """(origin, agent, prefix, type, pattern, ordinal): the rules that can match anything, keyed by the prefix that a path must have."""
    return rules(robots).where(_able()).select("origin", "agent", literal_prefix(F.col("path")).alias("prefix"), "type", F.col("path").alias("pattern"), "ordinal")


def verdicts(asked: DataFrame, robots: DataFrame) -> DataFrame:
    """asked(origin, agent, path, ...) with status, allowed, matched_agent, matched_type, matched_path.

    An agent is judged by the rules of all groups that name it, else by those of ``*``: the
    longest matching pattern wins, on a tie allow, then the first. A server error denies all.
    Repeated and null questions are answered each; an origin without robots.txt allows.

    A question meets only rules whose literal prefix its path has: one probe for each length
    that prefixes of its agent have there, joined on (origin, agent, prefix). Agents that fall
    to the same group ask once. Every join is followed by a shuffle on other keys, so that
    adaptive execution may split what a hot origin brings to it.
    """
    index = rule_index(robots)
    sized = rules(robots).groupBy("origin", "agent").agg(F.collect_set(F.when(_able(), F.length(literal_prefix(F.col("path"))))).alias("lengths"))
    agents = sized.groupBy("origin").agg(F.collect_list(F.struct("agent", "lengths")).alias("agents"))
    sites = robots.groupBy("origin").agg(F.min("status").alias("status")).join(agents, "origin", "left").select(F.col("origin").alias("s_origin"), "status", "agents")
    # only the asked row as a struct enters the joins, so its columns may have any names
    named = lambda name: F.get(F.filter("agents", lambda a: a["agent"] == name), F.lit(0))
    base = asked.select(F.struct("*").alias("_row")).join(sites, F.col("_row.origin") == F.col("s_origin"), "left")
    base = base.withColumn("chosen", F.coalesce(named(F.lower("_row.agent")), named(F.lit("*")))).drop("agents", "s_origin")
    questions = base.groupBy(F.col("_row.origin").alias("q_origin"), F.col("chosen.agent").alias("q_agent"), F.col("_row.path").alias("q_path")).agg(F.any_value("chosen.lengths").alias("lengths"))
    probes = questions.select("q_origin", "q_agent", "q_path", F.explode(F.filter("lengths", lambda n: n <= F.length("q_path"))).alias("n")).withColumn("q_prefix", F.substring(F.col("q_path"), F.lit(1), F.col("n")))
    met = probes.join(index, (F.col("q_origin") == F.col("origin")) & (F.col("q_agent") == F.col("agent")) & (F.col("q_prefix") == F.col("prefix"))).where(matches(F.col("pattern"), F.col("q_path")))
    rank = F.struct(F.length("pattern").alias("length"), (F.col("type") == "allow").alias("allow"), (-F.col("ordinal")).alias("order"), "type", "pattern")
    best = met.groupBy("q_origin", "q_agent", "q_path").agg(F.max(rank).alias("best"))
    out = base.join(best, (F.col("_row.origin") == F.col("q_origin")) & (F.col("chosen.agent") == F.col("q_agent")) & (F.col("_row.path") == F.col("q_path")), "left")
    allowed = F.when(F.col("status") >= 500, False).when(F.col("best").isNull(), True).otherwise(F.col("best.allow"))
    return out.select("_row.*", "status", allowed.alias("allowed"), F.col("chosen.agent").alias("matched_agent"), F.col("best.type").alias("matched_type"), F.col("best.pattern").alias("matched_path"))


def crawler_access(sites: DataFrame, robots: DataFrame, include_deprecated: bool = False) -> DataFrame:
    """(origin, path, token, vendor, purpose, allowed, via_wildcard, ...) of each site(origin, path) and crawler.

    Applebot follows Googlebot's rules where a site names Googlebot but not Applebot.
    """
    names = [c.split()[0] for c in fixed.CRAWLER_SCHEMA.split(", ")]
    crawlers = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in fixed.crawler_rows() if include_deprecated or not row[-1]])
    agents = rules(robots).select("origin", "agent").distinct()
    flags = agents.groupBy("origin").agg(F.bool_or(F.col("agent") == "applebot").alias("names_apple"), F.bool_or(F.col("agent") == "googlebot").alias("names_google"))
    each = sites.join(flags, "origin", "left").withColumn("crawler", F.explode(crawlers))
    borrowed = (F.col("crawler.token") == "Applebot") & ~F.coalesce("names_apple", F.lit(False)) & F.coalesce("names_google", F.lit(False))
    asked = each.select("origin", "path", F.when(borrowed, F.lit("Googlebot")).otherwise(F.col("crawler.token")).alias("agent"), "crawler.*", borrowed.alias("follows_googlebot"))
    judged = verdicts(asked, robots)
    return judged.withColumn("via_wildcard", F.coalesce(F.col("matched_agent") == "*", F.lit(True))).drop("agent")


def access_summary(access: DataFrame) -> DataFrame:
    """One row a site: allowed and blocked counts, blocked search crawlers, blocks that a crawler does not heed, findings."""
    listed = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ordinal", "token")))), lambda x: x["token"])
    out = access.groupBy("origin", "path").agg(
        F.count_if(F.col("allowed")).alias("allowed_count"), F.count_if(~F.col("allowed")).alias("blocked_count"),
        listed(~F.col("allowed") & (F.col("purpose") == "search")).alias("blocked_citation_critical"),
        listed(~F.col("allowed") & (F.col("respects_robots_txt") != "yes")).alias("unenforceable_blocks"),
        F.count_if(F.col("allowed") & (F.col("purpose") == "training")).alias("training_allowed"),
    )
    found = N.findings(
        N.finding("all_crawlers_allowed", "info", F.col("blocked_count") == 0), N.finding("crawlers_blocked", "info", F.col("blocked_count") > 0),
        N.finding("search_crawlers_blocked", "warn", F.size("blocked_citation_critical") > 0), N.finding("blocks_unenforceable", "warn", F.size("unenforceable_blocks") > 0),
        N.finding("training_crawlers_allowed", "info", F.col("training_allowed") > 0),
    )
    return out.withColumn("crawler_findings", found)


def by_vendor(access: DataFrame) -> DataFrame:
    """(origin, path, vendor, crawlers array<struct<token,allowed>>): a site's crawlers by vendor, in registry order."""
    each = F.array_sort(F.collect_list(F.struct("ordinal", "token", "allowed")))
    return access.groupBy("origin", "path", "vendor").agg(F.transform(each, lambda x: F.struct(x["token"].alias("token"), x["allowed"].alias("allowed"))).alias("crawlers"))


def site_report(robots: DataFrame) -> DataFrame:
    """(origin, found, status, group_count, sitemap_count, blocks_everything, warning_count, delay_count, robots_score, robots_findings) of each robots.txt."""
    of_group = rules(robots).groupBy("origin", "group_id").agg(F.max("crawl_delay").alias("delay"))
    groups = of_group.groupBy("origin").agg(F.count("*").alias("group_count"), F.count("delay").alias("delay_count"))
    maps = sitemaps(robots).groupBy("origin").agg(F.count("*").alias("sitemap_count"))
    warned = warnings(robots).groupBy("origin").agg(F.count("*").alias("warning_count"), F.array_sort(F.collect_list(F.struct("line", "code"))).alias("warned"))
    root = verdicts(robots.select("origin", F.lit("*").alias("agent"), F.lit("/").alias("path")), robots).select("origin", "allowed")
    found = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    out = robots.select("origin", "status").join(groups, "origin", "left").join(maps, "origin", "left").join(warned, "origin", "left").join(root, "origin", "left")
    out = out.fillna(0, ["group_count", "sitemap_count", "warning_count", "delay_count"]).withColumns({"found": found, "blocks_everything": found & ~F.col("allowed")}).drop("allowed")
    score = F.when(F.col("blocks_everything"), 0).when(~F.col("found"), 40).when(F.col("sitemap_count") > 0, 100).otherwise(70)
    told = N.findings(
        N.finding("robots_found", "pass", F.col("found")), N.finding("robots_absent", "warn", F.col("status").isin(*ABSENT)), N.finding("robots_failed", "fail", ~F.col("found") & ~F.coalesce(F.col("status").isin(*ABSENT), F.lit(False))),
        N.finding("blocks_everything", "fail", F.col("blocks_everything")), N.finding("sitemap_undeclared", "warn", F.col("sitemap_count") == 0), N.finding("sitemap_declared", "pass", F.col("sitemap_count") > 0),
    )
    warned = F.transform(F.slice(F.coalesce("warned", F.array().cast("array<struct<line:int,code:string>>")), 1, WARNINGS), lambda w: F.struct(w["code"].alias("code"), F.lit("warn").alias("severity")))
    last = N.findings(N.finding("more_warnings", "warn", F.col("warning_count") > WARNINGS), N.finding("crawl_delay", "info", F.col("delay_count") > 0))
    return out.withColumns({"robots_score": score, "robots_findings": F.concat(told, warned, last)}).drop("warned")
