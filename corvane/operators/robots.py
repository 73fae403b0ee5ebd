"""robots.txt: groups by running sums over significant lines, group selection, rule strength and crawler policy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: (token, provider, purpose, whether robots.txt applies: None where unknown)
CRAWLERS: tuple[tuple[str, str, str, bool | None], ...] = (
    ("OAI-SearchBot", "OpenAI", "search", True), ("ChatGPT-User", "OpenAI", "user", False), ("GPTBot", "OpenAI", "training", True), ("Claude-SearchBot", "Anthropic", "search", True), ("Claude-User", "Anthropic", "user", True),
    ("ClaudeBot", "Anthropic", "training", True), ("PerplexityBot", "Perplexity", "search", True), ("Perplexity-User", "Perplexity", "user", False), ("Google-Extended", "Google", "control", True), ("Applebot-Extended", "Apple", "control", True),
    ("meta-externalagent", "Meta", "training", True), ("CCBot", "Common Crawl", "training", True), ("Amazonbot", "Amazon", "training", True), ("Bytespider", "ByteDance", "legacy", None), ("anthropic-ai", "Anthropic", "legacy", None),
)
CRAWLERS_SQL = "(VALUES " + ", ".join(f"('{t}', '{p}', '{u}', {'NULL' if a is None else str(a).lower()})" for t, p, u, a in CRAWLERS) + ") AS crawlers(token, provider, purpose, robots_applicable)"


def crawlers(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {CRAWLERS_SQL}")


def rules(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, line, grp, kind, value) of agent and rule lines in groups. A blank line ends a group, a comment line does not;
    an agent line after a rule or a blank begins one; rules outside of a group are dropped."""
    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("line", "raw"))
    said = lines.select(key, "line", F.expr(r"regexp_replace(regexp_replace(raw, r'#.*', ''), r'^\s+|\s+$', '')").alias("s"), F.expr(r"regexp_replace(raw, r'^\s+|\s+$', '') = ''").alias("blank"))
    kinds = said.select(
        key, "line",
        F.expr(r"""CASE WHEN blank THEN 'blank' WHEN s RLIKE r'(?i)^user-agent:\s*.+$' AND size(filter(split(regexp_extract(s, r'(?i)^user-agent:\s*(.+)$', 1), ','), t -> trim(t) <> '')) > 0 THEN 'agent'
               WHEN s RLIKE r'(?i)^(?:allow|disallow):' THEN lower(regexp_extract(s, r'(?i)^(allow|disallow):', 1)) END""").alias("kind"),
        F.expr(r"regexp_extract(s, r'^[^:]*:\s*(.*)$', 1)").alias("value"),
    ).where("kind IS NOT NULL")
    w = Window.partitionBy(key).orderBy("line")
    begins = (F.col("kind") == "agent") & F.coalesce(F.lag("kind").over(w) != "agent", F.lit(True))
    last = lambda k: F.max(F.when(k, F.col("line"))).over(w)
    grouped = kinds.withColumn("grp", F.sum(begins.cast("bigint")).over(w)).withColumn("open", F.coalesce(last(F.col("kind") == "agent"), F.lit(-1)) > F.coalesce(last(F.col("kind") == "blank"), F.lit(-1)))
    return grouped.where("kind <> 'blank' AND open").drop("open")


def agents(parsed: DataFrame, key: str) -> DataFrame:
    """(key, grp, agent) of every product token."""
    tokens = F.explode(F.split("value", ",")).alias("agent")
    return parsed.where("kind = 'agent'").select(key, "grp", tokens).select(key, "grp", F.expr(r"regexp_replace(agent, r'^\s+|\s+$', '')").alias("agent")).where("agent <> ''")


def selected(parsed: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """(key, token, grp): for each target agent, all groups whose longest matching product token is longest of all.

    targets is the registry of crawlers, of a fixed small size, or the agents of a URL check: it is broadcast by size only.
    """
    match = F.expr("agent = '*' OR contains(lower(token), lower(agent))")
    best = agents(parsed, key).join(targets.select("token"), match).groupBy(key, "token", "grp").agg(F.max(F.length("agent")).alias("n"))
    w = Window.partitionBy(key, "token").orderBy(F.desc("n"))
    return best.withColumn("r", F.rank().over(w)).where("r = 1").select(key, "token", "grp")


def matched_agents(parsed: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(key, token, agents): the product tokens of the chosen groups, each once whatever its case, as first written, in the file's order."""
    ord_ = agents_in_order(parsed, key).join(chosen, [key, "grp"])
    first = ord_.groupBy(key, "token", F.lower("agent").alias("low")).agg(F.min(F.struct("line", "pos", "agent")).alias("f"))
    return first.groupBy(key, "token").agg(F.sort_array(F.collect_list("f")).alias("l")).select(key, "token", F.expr("array_join(transform(l, x -> x.agent), ',')").alias("agents"))


def agents_in_order(parsed: DataFrame, key: str) -> DataFrame:
    """(key, grp, line, pos, agent) of every product token."""
    tokens = parsed.where("kind = 'agent'").select(key, "grp", "line", F.posexplode(F.split("value", ",")).alias("pos", "raw"))
    return tokens.select(key, "grp", "line", "pos", F.expr(r"regexp_replace(raw, r'^\s+|\s+$', '')").alias("agent")).where("agent <> ''")


def registry_audit(files: DataFrame, key: str, path: str = "/") -> DataFrame:
    """(key, token, allowed, rule, warnings): the wildcard and every crawler of the registry for each file, with or without a group that names it. The registry is a fixed list."""
    spark = files.sparkSession
    parsed = rules(files, key)
    targets = crawlers(spark).unionByName(spark.sql("SELECT '*' AS token, '' AS provider, '' AS purpose, true AS robots_applicable"))
    asked = files.select(key, F.lit(path).alias("path"))
    judged = verdicts(parsed, selected(parsed, targets, key), asked, key)
    notes = F.expr("""array_join(array_compact(array(CASE WHEN NOT robots_applicable THEN 'may ignore robots.txt' END, CASE WHEN robots_applicable IS NULL OR purpose = 'legacy' THEN 'to be verified' END, CASE WHEN purpose = 'control' THEN 'control token' END)), '; ')""")
    every = files.select(key).crossJoin(F.broadcast(targets))
    return every.join(judged, [key, "token"], "left").select(key, "token", F.coalesce("allowed", F.lit(True)).alias("allowed"), F.coalesce("rule", F.lit("")).alias("rule"), notes.alias("warnings"))


def url_policy(urls: DataFrame, files: DataFrame, agent: str, key: str, url: str = "url") -> DataFrame:
    """(url, allowed) of each address for one agent, by its path and query; an address that isn't one, and a host without groups, allow. files has a row for each host (key)."""
    spark = files.sparkSession
    parsed = rules(files, key)
    target = spark.createDataFrame([(agent,)], "token string")
    parts = urls.withColumn(key, F.expr(rf"lower(regexp_extract({url}, r'(?i)^https?://([^/?#]+)', 1))")).withColumn("path", F.expr(rf"regexp_extract({url}, r'(?i)^https?://[^/?#]+([^#]*)', 1)")).withColumn("path", F.expr("CASE WHEN path = '' THEN '/' WHEN path LIKE '?%' THEN '/' || path ELSE path END"))
    judged = verdicts(parsed, selected(parsed, target, key), parts.where(f"{key} <> ''").select(key, "path").distinct(), key).select(key, "path", "allowed")
    return parts.join(judged, [key, "path"], "left").select(url, F.coalesce("allowed", F.lit(True)).alias("allowed"))


_PATTERN = r"concat('^', regexp_replace(regexp_replace(regexp_replace(path, r'([.+?^${}()|\[\]\\])', r'\\$1'), r'\*', '.*'), r'\\\$$', r'\$'))"


def verdicts(parsed: DataFrame, chosen: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """(key, token, path, allowed, rule): the longest matching rule of the chosen groups decides, allow on a tie; none allows."""
    lines = parsed.where("kind <> 'agent'").select(key, "grp", "line", "kind", F.col("value").alias("path")).where("path <> ''").withColumn("pattern", F.expr(_PATTERN)).withColumnRenamed("path", "rule")
    asked = chosen.select(key, "token").distinct().join(paths, key)
    hits = chosen.join(lines, [key, "grp"]).join(paths, key).where("path RLIKE pattern")
    allow = F.col("kind") == "allow"
    # Among equally long rules an allow wins, the last of them; without one the first disallow stays.
    w = Window.partitionBy(key, "token", "path").orderBy(F.desc(F.length("rule")), F.desc(allow), F.when(allow, -F.col("line")).otherwise(F.col("line")))
    best = hits.withColumn("r", F.row_number().over(w)).where("r = 1").select(key, "token", "path", allow.alias("ok"), "rule")
    return asked.join(best, [key, "token", "path"], "left").select(key, "token", "path", F.coalesce("ok", F.lit(True)).alias("allowed"), F.coalesce("rule", F.lit("")).alias("rule"))


def generated(preset: str = "search-visible", disallow: tuple[str, ...] = ("/admin", "/api", "/private"), sitemap: str | None = None) -> str:
    """A robots.txt that lets search and user agents in; training agents only under the preset 'open'."""
    out = []
    for purpose in ("search", "user", "training", "control", "legacy"):
        open_ = purpose in ("search", "user") or preset == "open"
        out.append(f"# {purpose} agents")
        for token, _, use, _ in CRAWLERS:
            if use == purpose:
                out += [f"User-agent: {token}", "Allow: /" if open_ else "Disallow: /", *([f"Disallow: {p}" for p in disallow] if open_ else []), ""]
    out += ["# everyone else", "User-agent: *", *[f"Disallow: {p}" for p in disallow], "Allow: /"]
    return "\n".join(out + (["", f"Sitemap: {sitemap}"] if sitemap else [])) + "\n"
