"""llms.txt: title, summary, sections, links. Reported, never scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import nodes as N


def llms_txt(files: DataFrame) -> DataFrame:
    """files(origin, status, body, full_status) with title, summary, sections, link_count, has_optional."""
    found = F.col("status").between(200, 299) & (text.trimmed(F.coalesce("body", F.lit(""))) != "")
    body = F.when(found, F.col("body"))
    part = lambda pattern: F.nullif(text.trimmed(F.regexp_extract(body, pattern, 1)), F.lit(""))
    sections = F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^##[ \t]+(.+)$"), F.lit(1)), lambda s: text.trimmed(s))
    out = files.withColumns({
        "found": found, "title": part(r"(?m)^#[ \t]+(.+)$"), "summary": part(r"(?m)^>[ \t]*(.+)$"), "sections": F.coalesce(sections, F.array().cast("array<string>")),
        "link_count": F.coalesce(F.regexp_count(body, F.lit(r"(?m)^[ \t]*[-*][ \t]*\[[^\]]*\]\([^)]*\)")), F.lit(0)), "full_variant_found": F.coalesce(F.col("full_status").between(200, 299), F.lit(False)),
    })
    out = out.withColumn("has_optional", F.exists("sections", lambda s: F.lower(s) == "optional"))
    f = F.col("found")
    codes = N.findings(
        N.finding("llms_absent", "info", ~f), N.finding("llms_present", "pass", f), N.finding("title_missing", "warn", f & F.col("title").isNull()), N.finding("summary_missing", "info", f & F.col("summary").isNull()),
        N.finding("links_missing", "warn", f & (F.col("link_count") == 0)), N.finding("adoption", "info", f), N.finding("full_variant", "info", F.col("full_variant_found")),
    )
    return out.withColumn("llms_findings", codes)
