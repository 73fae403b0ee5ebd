"""Roll-ups over many documents: site statistics, rankings, findings facts, profile cubes and before/after diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scalar

_STATS, _QUOTES = scalar.applicable("statistics", "profile"), scalar.applicable("quotations", "profile")
#: Findings of both models: (model, rule, severity expression over the figures of audit.audited(); NULL is no finding).
FINDINGS: tuple[tuple[str, str, str], ...] = (
    ("v1", "content.intro_definition", "CASE WHEN intro = '' THEN 'fail' WHEN v1_answer = 10 THEN 'pass' ELSE 'warn' END"),
    ("v1", "content.tables", "CASE WHEN v1_tables > 0 THEN 'pass' ELSE 'warn' END"),
    ("v1", "content.lists", "CASE WHEN v1_lists > 0 THEN 'pass' ELSE 'warn' END"),
    ("v1", "content.headings", "CASE WHEN v1_headers > 0 THEN 'pass' ELSE 'warn' END"),
    ("v1", "content.semantic_html", "CASE WHEN NOT is_html THEN NULL WHEN v1_unsemantic THEN 'warn' ELSE 'pass' END"),
    ("v1", "content.dynamic_rendering", "CASE WHEN v1_dynamic THEN 'warn' END"),
    ("v1", "content.statistics_density", "CASE WHEN v1_statistics = 20 THEN 'pass' ELSE 'warn' END"),
    ("v1", "content.quotation_density", "CASE WHEN v1_quotations = 20 THEN 'pass' ELSE 'warn' END"),
    ("v1", "content.citation_links", "CASE WHEN link_count >= 3 THEN 'pass' ELSE 'warn' END"),
    ("v1", "content.references_section", "CASE WHEN has_sources THEN 'pass' ELSE 'warn' END"),
    ("v1", "content.pronoun_density", "CASE WHEN pronoun_points > 0 THEN 'warn' ELSE 'pass' END"),
    ("v1", "content.acronym_clarity", "CASE WHEN acr_unexplained > 0 THEN 'warn' ELSE 'pass' END"),
    ("v2", "v2.structure.headings", "CASE WHEN heading_status <> 'pass' THEN 'warn' END"),
    ("v2", "v2.structure.empty_sections", "CASE WHEN section_status <> 'pass' THEN 'warn' END"),
    ("v2", "v2.structure.answer_first", "CASE WHEN answer_status = 'fail' THEN 'warn' END"),
    ("v2", "v2.statistics.attribution", f"CASE WHEN {_STATS} AND stat_total >= 3 AND stat_sourced < 0.5e0 * stat_total THEN 'warn' END"),
    ("v2", "v2.statistics.implausible", f"CASE WHEN {_STATS} AND stat_total - stat_sourced >= 5 AND stat_sourced < 0.3e0 * stat_total THEN 'warn' END"),
    ("v2", "v2.quotations.attribution", f"CASE WHEN {_QUOTES} AND quote_found > 0 AND quote_attributed < 0.7e0 * quote_found THEN 'warn' END"),
    ("v2", "v2.quotations.unattributed", f"CASE WHEN {_QUOTES} AND quote_found - quote_attributed >= 3 AND quote_attributed < 0.3e0 * quote_found THEN 'warn' END"),
    ("v2", "v2.citations.link_farm", "CASE WHEN link_farm THEN 'fail' END"),
    ("v2", "v2.citations.no_links", "CASE WHEN external = 0 AND NOT link_farm THEN 'warn' END"),
    ("v2", "v2.clarity.pronouns", "CASE WHEN v2_pronoun_points > 0 THEN 'warn' END"),
    ("v2", "v2.observations.heading_hierarchy", "CASE WHEN heading_status <> 'pass' THEN 'warn' END"),
    ("v2", "v2.observations.section_containment", "CASE WHEN section_status <> 'pass' THEN 'warn' END"),
    ("v2", "v2.observations.answer_first", "CASE WHEN answer_status <> 'pass' THEN 'warn' END"),
    ("v2", "v2.observations.attribution", "CASE WHEN attribution_status <> 'pass' THEN 'warn' END"),
    ("v2", "v2.observations.freshness", "CASE WHEN fresh_status <> 'pass' THEN 'warn' END"),
    ("v2", "v2.observations.link_quality", "CASE WHEN link_status <> 'pass' THEN 'warn' END"),
)
#: Recommendations of the second model: (condition, text).
_ON = {k: scalar.applicable(k, "profile") for k in scalar.DIMENSIONS}
RECOMMENDATIONS: tuple[tuple[str, str], ...] = (
    (f"{_ON['structure']} AND v2_structure < 12", "Put headings in order, fill thin sections and open with a definition"),
    (f"{_ON['statistics']} AND v2_statistics < 12 AND stat_total > stat_sourced", "Name a source next to each figure"),
    (f"{_ON['statistics']} AND v2_statistics < 12 AND stat_total = 0", "Bring figures from sources with authority"),
    (f"{_ON['quotations']} AND v2_quotations < 12 AND quote_found > quote_attributed", "Attribute each quotation to a named person"),
    (f"{_ON['quotations']} AND v2_quotations < 12 AND quote_found = 0", "Quote known experts or customers by name"),
    (f"{_ON['citations']} AND v2_citations < 12 AND external = 0", "Link to outside sources with authority and list them"),
    (f"{_ON['citations']} AND v2_citations < 12 AND external > 0 AND NOT sources_section", "Add a section of sources"),
    (f"{_ON['clarity']} AND v2_clarity < 16", "Use fewer pronouns, spell acronyms out, balance paragraphs"),
)
#: Recommendations of the first model, in order.
RECOMMENDATIONS_V1: tuple[tuple[str, str], ...] = (
    ("v1_structure < 15", "Open with a summary of 40 to 90 words that stands alone"),
    ("v1_structure < 15 AND is_html", "Break text up with tables, headings and lists in markup"),
    ("v1_structure < 15 AND NOT is_html", "Break text up with Markdown tables, headings and lists"),
    ("v1_statistics < 20", "Give figures, shares, amounts or dates from studies"),
    ("v1_quotations < 20", "Quote experts directly"),
    ("v1_citations < 20", "Link to reputable sources and list them"),
    ("v1_clarity < 18", "Put nouns in place of vague pronouns"),
    ("v1_clarity < 18", "Spell acronyms out where they first occur"),
)
#: Observations as rows: (kind, status, figures as JSON).
OBSERVATIONS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("heading_hierarchy", "heading_status", ("heading_count", "heading_skips", "heading_repeats")), ("section_self_containment", "section_status", ("section_count", "section_thin")),
    ("paragraph_distribution", "paragraph_status", ("paragraph_count", "paragraph_min", "paragraph_max", "paragraph_median", "paragraph_long")), ("answer_first", "answer_status", ("intro_words",)),
    ("attribution_proximity", "attribution_status", ("stat_total", "stat_sourced", "quote_found", "quote_attributed")), ("content_freshness", "fresh_status", ()), ("semantic_html", "semantic_status", ("semantic_count",)),
    ("link_quality", "link_status", ("external", "internal", "word_count")),
)


def observations(scored: DataFrame) -> DataFrame:
    """(doc_id, kind, status, facts): a row for each observation of a document; facts are its figures by name."""
    fact = lambda names: "map_from_arrays(" + f"array({', '.join(map(repr, names))}), array({', '.join(names)}))" if names else "CAST(map() AS MAP<STRING, BIGINT>)"
    rows = ", ".join(f"struct('{k}' AS kind, {s} AS status, {fact(names)} AS facts)" for k, s, names in OBSERVATIONS)
    return scored.selectExpr("doc_id", f"inline(filter(array({rows}), o -> o.status IS NOT NULL))")


def view(scored: DataFrame) -> DataFrame:
    """The per-file view of a site report: no text, only what is shown of a file."""
    return scored.select("doc_id", "path", "status", "v2_score", "band", "profile", F.expr("CASE WHEN status = 'error' THEN 'Read failed: ' || coalesce(path, '') END").alias("error"))


def message(scores: DataFrame, score: str = "v2_score", among: Sequence[str] = ("true",)) -> DataFrame:
    """One row for each condition in among, all from one pass, with the report's message where its rows have no statistics to show: no documents, or none that could be scored; else null."""
    counts = [F.count(F.expr(f"CASE WHEN {c} THEN {x} END")).alias(f"{k}{i}") for i, c in enumerate(among) for k, x in (("n", "1"), ("k", score))]
    said = ", ".join(f"struct(CASE WHEN n{i} = 0 THEN 'No documents found' WHEN k{i} = 0 THEN 'No document could be scored' END AS message)" for i in range(len(among)))
    return scores.agg(*counts).selectExpr(f"inline(array({said}))")


#: What deltas() compares.
COMPARED = tuple(f"{m}_{k}" for m in ("v1", "v2") for k in scalar.DIMENSIONS) + ("v1_total", "v2_score")


def deltas(scored: DataFrame) -> DataFrame:
    """(doc_id, dimension, before, after, delta) of both models' dimensions and totals, for documents on both sides: scored has a column side, 'before' or 'after'.
    Rows meet by doc_id, each of one side with each of the other; those without one meet none."""
    figures = F.struct(*COMPARED)
    both = scored.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.collect_list(F.when(F.col("side") == x, figures)).alias(x) for x in ("before", "after")])
    pairs = both.select("doc_id", F.explode("before").alias("b"), "after").select("doc_id", "b", F.explode("after").alias("a"))
    rows = ", ".join(f"struct('{n}' AS dimension, b.{n} AS before, a.{n} AS after, a.{n} - b.{n} AS delta)" for n in COMPARED)
    return pairs.selectExpr("doc_id", f"inline(array({rows}))")


def tally(results: DataFrame, status: str = "status") -> DataFrame:
    """One row of a batch's outcome: (total, succeeded, failed)."""
    return results.agg(F.count("*").alias("total"), F.count_if(F.col(status) == "success").alias("succeeded"), F.count_if(~F.col(status).eqNullSafe(F.lit("success"))).alias("failed"))


def findings(scored: DataFrame, *keys: str) -> DataFrame:
    """(doc_id, other keys, model, rule_id, severity, ord): a row for each finding of the documents that could be scored; one scan, no join."""
    rows = ", ".join(f"struct({i} AS ord, '{m}' AS model, '{r}' AS rule_id, {s} AS severity)" for i, (m, r, s) in enumerate(FINDINGS))
    return scored.where("status = 'success'").selectExpr("doc_id", *keys, f"inline(filter(array({rows}), f -> f.severity IS NOT NULL))").select("doc_id", *keys, "model", "rule_id", "severity", F.col("ord").cast("bigint").alias("ord"))


def findings_sql(scored: str) -> str:
    parts = " UNION ALL ".join(f"SELECT doc_id, '{m}' AS model, '{r}' AS rule_id, {s} AS severity, CAST({i} AS BIGINT) AS ord FROM s" for i, (m, r, s) in enumerate(FINDINGS))
    return f"WITH s AS MATERIALIZED ({scored}), f AS (SELECT * FROM ({parts}) t WHERE severity IS NOT NULL)"


def recommendations(scored: DataFrame, rules: tuple[tuple[str, str], ...] = RECOMMENDATIONS) -> DataFrame:
    """(doc_id, ord, recommendation) of each document, in the rules' order."""
    rows = ", ".join(f"CASE WHEN {c} THEN struct({i} AS ord, '{t}' AS recommendation) END" for i, (c, t) in enumerate(rules))
    return scored.selectExpr("doc_id", f"inline(array_compact(array({rows})))")


def top_recommendations(recs: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent; ties go to the one seen first."""
    return recs.groupBy("recommendation").agg(F.count("*").alias("documents"), F.min(F.struct("doc_id", "ord")).alias("first")).orderBy(F.desc("documents"), "first").limit(k).select("recommendation", "documents")


def top_findings(found: DataFrame, k: int = 10) -> DataFrame:
    """The k rules with most findings but passes; ties go to the one seen first."""
    bad = found.where("severity <> 'pass'")
    return bad.groupBy("rule_id").agg(F.count("*").alias("occurrences"), F.min(F.struct("doc_id", "ord")).alias("first"), F.min_by("severity", F.struct("doc_id", "ord")).alias("severity")).orderBy(F.desc("occurrences"), "first").limit(k).select("rule_id", "occurrences", "severity")


def summary(scores: DataFrame, score: str = "v2_score") -> DataFrame:
    """One row of site statistics over finite scores; errors are rows whose score is null."""
    two = lambda c: F.floor(c * 100 + 0.5) / 100
    s = F.col(score)
    return scores.agg(
        F.count("*").alias("total"), F.count(s).alias("succeeded"), (F.count("*") - F.count(s)).alias("failed"), two(F.avg(s)).alias("average"), two(F.median(s)).alias("median"), F.min(s).alias("lowest"), F.max(s).alias("highest"),
        two(F.stddev_pop(s)).alias("deviation"), F.count_if(s >= 80).alias("excellent"), F.count_if((s >= 50) & (s < 80)).alias("good"), F.count_if(s < 50).alias("needs_work"),
    )


def worst(scores: DataFrame, k: int = 5, score: str = "v2_score") -> DataFrame:
    """The k lowest scores. Nulls sort last and go after the limit: a filter before it would be pushed into the projections below
    and repeat the whole score's expression there."""
    return scores.orderBy(F.asc_nulls_last(score), "doc_id").limit(k).where(F.col(score).isNotNull())


def deduplicated(found: DataFrame, facts: str) -> DataFrame:
    """The first finding of each document, rule and facts."""
    w = Window.partitionBy("doc_id", "rule_id", facts).orderBy("ord")
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def changes(found: DataFrame) -> DataFrame:
    """(doc_id, rule_id, change) of rules that warn or fail: improved, regressed or unchanged; found has a column side, 'before' or 'after'. Findings without a doc_id are never of the same document."""
    sides = found.where("severity IN ('warn', 'fail')").groupBy("doc_id", "rule_id").agg(*[F.max(F.col("side") == x).alias(x) for x in ("before", "after")])
    return sides.selectExpr("doc_id", "rule_id", "explode(CASE WHEN NOT after THEN array('improved') WHEN NOT before THEN array('regressed') WHEN doc_id IS NULL THEN array('improved', 'regressed') ELSE array('unchanged') END) AS change")


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """changes() from the findings of one side and those of the other."""
    return changes(before.withColumn("side", F.lit("before")).unionByName(after.withColumn("side", F.lit("after"))))
