"""On-page analyses: columns over a parsed page, each with a score and coded findings.

Every function adds columns to parsed pages (see sources.pages.parse) and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text, urls
from . import nodes as N
from . import probes

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def meta_tags(pages: DataFrame) -> DataFrame:
    """Title, description, canonical, robots directives, language, charset, viewport, favicon; meta_score."""
    titles = N.tag("title")
    canonicals = N.where(lambda n: (n["tag"] == "link") & (N.lower_attr(n, "rel") == "canonical"))
    header = F.element_at("headers", F.lit("x-robots-tag"))
    canonical = N.first(canonicals)
    html = N.first(N.tag("html"))
    declared = N.attr(N.first(N.where(lambda n: (n["tag"] == "meta") & n["attrs"].isNotNull() & F.map_contains_key(n["attrs"], "charset"))), "charset")
    out = pages.withColumns({
        "title": F.nullif(text.trimmed(N.first(titles)["text"]), F.lit("")),
        "title_count": F.size(titles),
        "description": N.meta("description"),
        "canonical_count": F.size(canonicals),
        "canonical": F.when(text.trimmed(N.attr(canonical, "href")) != "", canonical["url"]),
        "meta_robots": N.meta("robots"),
        "x_robots_tag": header,
        "lang": F.nullif(text.trimmed(N.attr(html, "lang")), F.lit("")),
        "charset": F.coalesce(F.nullif(text.trimmed(declared), F.lit("")), F.nullif(F.regexp_extract(F.coalesce("content_type", F.lit("")), r"(?i)charset=([^;\s]+)", 1), F.lit(""))),
        "viewport": N.meta("viewport"),
        "favicon": N.attr(N.first(N.where(lambda n: (n["tag"] == "link") & N.has_token(n, "rel", "icon"))), "href"),
    })
    directives = F.filter(F.transform(F.split(F.lower(F.concat_ws(",", "meta_robots", "x_robots_tag")), ","), lambda d: text.trimmed(d)), lambda d: d != "")
    out = out.withColumns({
        "title_length": F.coalesce(text.utf16_length(F.col("title")), F.lit(0)),
        "description_length": F.coalesce(text.utf16_length(F.col("description")), F.lit(0)),
        "robots_directives": directives,
        "canonical_is_self": F.coalesce(urls.normalised(F.col("canonical")) == urls.normalised(F.col("final_url")), F.lit(False)),
    })
    out = out.withColumns({
        "indexable": ~F.arrays_overlap("robots_directives", F.array(F.lit("noindex"), F.lit("none"))),
        "followable": ~F.arrays_overlap("robots_directives", F.array(F.lit("nofollow"), F.lit("none"))),
    })
    t, d = F.col("title_length"), F.col("description_length")
    no_title, no_description, no_canonical = F.col("title").isNull(), F.col("description").isNull(), F.col("canonical").isNull()
    score = (
        F.when(no_title, 0).when((F.col("title_count") > 1) | (t < fixed.TITLE_MIN), 15).when(t > fixed.TITLE_MAX, 18).otherwise(25)
        + F.when(no_description, 0).when(d < fixed.DESCRIPTION_MIN, 10).when(d > fixed.DESCRIPTION_MAX, 13).otherwise(20)
        + F.when(no_canonical, 0).when(F.col("canonical_count") > 1, 8).when(F.col("canonical_is_self"), 15).otherwise(12)
        + F.when(F.col("indexable"), 15).otherwise(0)
        + F.when(F.col("lang").isNotNull(), 8).otherwise(0)
        + F.when(F.col("charset").isNotNull(), 7).otherwise(0)
        + F.when(F.col("viewport").isNotNull(), 10).otherwise(0)
    )
    lang, viewport = F.col("lang").isNotNull(), F.col("viewport").isNotNull()
    found = N.findings(
        N.finding("title_missing", "fail", no_title),
        N.finding("title_several", "warn", ~no_title & (F.col("title_count") > 1)),
        N.finding("title_short", "warn", ~no_title & (F.col("title_count") == 1) & (t < fixed.TITLE_MIN)),
        N.finding("title_long", "warn", ~no_title & (F.col("title_count") == 1) & (t > fixed.TITLE_MAX)),
        N.finding("title_ok", "pass", ~no_title & (F.col("title_count") == 1) & t.between(fixed.TITLE_MIN, fixed.TITLE_MAX)),
        N.finding("description_missing", "fail", no_description),
        N.finding("description_short", "warn", ~no_description & (d < fixed.DESCRIPTION_MIN)),
        N.finding("description_long", "warn", ~no_description & (d > fixed.DESCRIPTION_MAX)),
        N.finding("description_ok", "pass", ~no_description & d.between(fixed.DESCRIPTION_MIN, fixed.DESCRIPTION_MAX)),
        N.finding("canonical_missing", "warn", no_canonical),
        N.finding("canonical_several", "fail", ~no_canonical & (F.col("canonical_count") > 1)),
        N.finding("canonical_self", "pass", ~no_canonical & (F.col("canonical_count") == 1) & F.col("canonical_is_self")),
        N.finding("canonical_elsewhere", "info", ~no_canonical & (F.col("canonical_count") == 1) & ~F.col("canonical_is_self")),
        N.finding("noindex", "fail", ~F.col("indexable")),
        N.finding("indexable", "pass", F.col("indexable")),
        N.finding("nofollow", "warn", ~F.col("followable")),
        N.finding("lang_declared", "pass", lang),
        N.finding("lang_missing", "warn", ~lang),
        N.finding("charset_missing", "warn", F.col("charset").isNull()),
        N.finding("viewport_present", "pass", viewport),
        N.finding("viewport_missing", "fail", ~viewport),
    )
    return out.withColumns({"meta_score": text.clamp(score), "meta_grade": text.grade(score), "meta_findings": found})


def _first_wins(selected: Column, key: str) -> Column:
    """map of lower-cased key to content; the first of repeated keys stays."""
    pairs = F.transform(selected, lambda n: F.struct(N.lower_attr(n, key).alias("k"), text.trimmed(F.coalesce(N.attr(n, "content"), F.lit(""))).alias("v")))
    pairs = F.filter(pairs, lambda p: p["v"] != "")
    kept = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda e: e["k"] == p["k"]))
    return F.map_from_entries(kept)


def social(pages: DataFrame, fetches: DataFrame | None = None) -> DataFrame:
    """Open Graph and Twitter cards. fetches(url, status): probed images; None leaves reachability null."""
    og = N.where(lambda n: (n["tag"] == "meta") & N.lower_attr(n, "property").rlike("^(og:|article:)"))
    twitter = N.where(lambda n: (n["tag"] == "meta") & N.lower_attr(n, "name").startswith("twitter:"))
    out = pages.withColumns({"open_graph": _first_wins(og, "property"), "twitter": _first_wins(twitter, "name")})
    has_image = lambda m, k: F.map_contains_key(m, k)
    image = F.coalesce(F.element_at("open_graph", F.lit("og:image")), F.element_at("twitter", F.lit("twitter:image")))
    named = lambda key, name: N.first(N.where(lambda n: (n["tag"] == "meta") & (N.lower_attr(n, key) == name) & (text.trimmed(N.attr(n, "content")) != "")))
    url = F.when(has_image("open_graph", "og:image"), named("property", "og:image")["url"]).otherwise(named("name", "twitter:image")["url"])
    out = out.withColumn("raw_image", image).withColumn("og_image_url", url)
    if fetches is None:
        out = out.withColumn("og_image_status", F.lit(None).cast("int"))
    else:
        probed = probes.outcomes(fetches).select(F.col("key").alias("image_key"), F.col("status").alias("og_image_status"), F.lit(True).alias("image_probed"))
        out = out.join(probed, urls.visit_key(F.col("og_image_url")) == F.col("image_key"), "left").drop("image_key")
    # a probe that got no answer found nothing
    probed = F.col("image_probed") if fetches is not None else F.lit(None).cast("boolean")
    reachable = F.when(probed, F.coalesce(F.col("og_image_status").between(200, 299), F.lit(False)))
    has = has_image
    score = sum(F.when(has("open_graph", k), points).otherwise(0) for k, points in fixed.OG_POINTS.items())
    score = score + F.when(has("twitter", "twitter:card"), 10).otherwise(0) + F.when(has("open_graph", "og:site_name"), 5).otherwise(0) + F.when(reachable, 5).otherwise(0)
    relative = has("open_graph", "og:image") & ~F.element_at("open_graph", F.lit("og:image")).rlike("(?i)^https?://")
    each = []
    for k in fixed.OG_POINTS:
        code = k.replace(":", "_")
        each += [N.finding(f"{code}_present", "pass", has("open_graph", k)), N.finding(f"{code}_missing", "fail" if k == "og:image" else "warn", ~has("open_graph", k))]
    found = N.findings(
        *each,
        N.finding("twitter_card_present", "pass", has("twitter", "twitter:card")),
        N.finding("twitter_card_missing", "warn", ~has("twitter", "twitter:card")),
        N.finding("image_invalid", "fail", F.col("raw_image").isNotNull() & F.col("og_image_url").isNull()),
        N.finding("image_reachable", "pass", reachable),
        N.finding("image_unreachable", "fail", ~reachable),
        N.finding("image_relative", "fail", relative),
    )
    return out.withColumns({"og_image_reachable": reachable, "social_score": text.clamp(score), "social_grade": text.grade(score), "social_findings": found}).drop("raw_image", "image_probed")


def headings(pages: DataFrame) -> DataFrame:
    """headings array<struct<level,text,skips_level>>, outline, counts, question_headings; heading_score."""
    all_ = F.transform(N.tag(*HEADINGS), lambda n: F.struct(F.substring(n["tag"], 2, 1).cast("int").alias("level"), text.collapse(n["text"]).alias("text")))
    full = F.filter("all_headings", lambda h: h["text"] != "")
    with_skips = F.transform("full", lambda h, i: F.struct(h["level"].alias("level"), h["text"].alias("text"), ((i > 0) & (h["level"] > F.get("full", i - 1)["level"] + 1)).alias("skips_level")))
    out = pages.withColumn("all_headings", all_).withColumn("full", full).withColumn("headings", with_skips)
    out = out.withColumns({
        "empty_headings": F.size("all_headings") - F.size("full"),
        "h1_count": F.size(F.filter("headings", lambda h: h["level"] == 1)),
        "h1_text": F.transform(F.filter("headings", lambda h: h["level"] == 1), lambda h: h["text"]),
        "level_skips": F.size(F.filter("headings", lambda h: h["skips_level"])),
        "question_headings": F.transform(F.filter("headings", lambda h: text.is_question(h["text"])), lambda h: h["text"]),
        "outline": F.array_join(F.transform("headings", lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("H"), h["level"].cast("string"), F.lit(" "), h["text"])), "\n"),
    }).drop("all_headings", "full")
    h1, n, skips, empty, asked = F.col("h1_count"), F.size("headings"), F.col("level_skips"), F.col("empty_headings"), F.size("question_headings")
    score = (
        F.when(h1 == 1, 40).when(h1 > 1, 20).otherwise(0) + F.when(n >= 2, 25).otherwise(0) + F.when(skips == 0, 20).otherwise(8)
        + F.when(empty == 0, 5).otherwise(0) + F.when(asked > 0, 10).otherwise(0)
    )
    found = N.findings(
        N.finding("h1_missing", "fail", h1 == 0), N.finding("h1_single", "pass", h1 == 1), N.finding("h1_several", "warn", h1 > 1),
        N.finding("headings_few", "warn", n < 2), N.finding("headings_enough", "pass", n >= 2),
        N.finding("levels_in_order", "pass", skips == 0), N.finding("levels_skipped", "warn", skips > 0),
        N.finding("headings_empty", "warn", empty > 0),
        N.finding("questions_present", "pass", asked > 0), N.finding("questions_absent", "info", asked == 0),
    )
    return out.withColumns({"heading_score": text.clamp(score), "heading_grade": text.grade(score), "heading_findings": found})


def content(pages: DataFrame) -> DataFrame:
    """Word, sentence and syllable counts, reading ease, ratios of the main text; content_score."""
    out = pages.withColumn("body_text", text.collapse(F.col("main_text"))).withColumn("word_list", text.words(F.col("body_text")))
    out = out.withColumns({
        "word_count": F.size("word_list"),
        "sentence_count": text.sentence_count(F.col("body_text")),
        "syllable_count": text.syllables(F.col("word_list")),
        "paragraph_count": F.size(N.tag("p")),
    })
    w = F.col("word_count")
    out = out.withColumns({
        "avg_words_per_sentence": text.to_tenth(w / F.col("sentence_count")),
        "reading_ease": text.reading_ease(w, F.col("sentence_count"), F.col("syllable_count")),
        "reading_time_minutes": F.greatest(F.lit(1), text.round_half_up(w / 220)).cast("int"),
        "thin_content": w < fixed.THIN_WORDS,
        "text_to_html_ratio": F.when(F.col("bytes") > 0, text.to_tenth(F.octet_length("body_text") / F.col("bytes") * 100)).otherwise(F.lit(0.0)),
    })
    ease, avg, p, ratio, size = F.col("reading_ease"), F.col("avg_words_per_sentence"), F.col("paragraph_count"), F.col("text_to_html_ratio"), F.col("bytes")
    few, low = (p < 3) & (w > 200), (ratio < 5) & (size > 50_000)
    score = (
        F.when(F.col("thin_content"), 10).otherwise(35) + F.when(F.col("landmark"), 15).otherwise(0) + F.when(ease >= 50, 20).otherwise(8)
        + F.when(avg <= 25, 15).otherwise(0) + F.when(~few, 10).otherwise(0) + F.when(~low, 5).otherwise(0)
    )
    found = N.findings(
        N.finding("content_thin", "warn", F.col("thin_content")), N.finding("content_deep", "pass", ~F.col("thin_content")),
        N.finding("landmark_missing", "warn", ~F.col("landmark")), N.finding("landmark_present", "pass", F.col("landmark")),
        N.finding("easy_to_read", "pass", ease >= 50), N.finding("hard_to_read", "warn", ease < 50),
        N.finding("sentences_long", "warn", avg > 25), N.finding("paragraphs_few", "warn", few),
        N.finding("text_ratio_low", "warn", low), N.finding("html_heavy", "warn", size > fixed.HEAVY_HTML),
    )
    return out.withColumns({"reading_level": text.reading_level(ease), "content_score": text.clamp(score), "content_grade": text.grade(score), "content_findings": found})


def top_terms(pages: DataFrame, most: int = 15) -> DataFrame:
    """(page_id, term, count, density, rank): a page's most frequent terms, ties by first appearance. pages: with content()."""
    from pyspark.sql import Window

    each = pages.select("page_id", "word_count", F.posexplode("word_list").alias("pos", "word")).withColumn("term", text.term(F.col("word")))
    each = each.where((F.length("term") >= 4) & ~F.col("term").isin(fixed.STOP_WORDS))
    counted = each.groupBy("page_id", "word_count", "term").agg(F.count("*").alias("count"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("count"), "pos"))
    density = text.round_half_up(F.col("count") / F.col("word_count") * 10000) / 100
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select("page_id", "term", "count", density.alias("density"), "rank")


def images(pages: DataFrame) -> DataFrame:
    """images array, counts; image_score."""
    src = lambda n: F.coalesce(N.attr(n, "src"), N.attr(n, "data-src"))
    imgs = F.filter(N.tag("img"), lambda n: text.trimmed(F.coalesce(src(n), F.lit(""))) != "")
    out = pages.withColumn("img_nodes", imgs)

    def one(n: Column) -> Column:
        url = F.coalesce(n["url"], src(n))
        kind = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9_]{2,5})(?:[?#]|$)", 1))
        alt = N.attr(n, "alt")
        size_missing = N.attr(n, "width").isNull() | N.attr(n, "height").isNull()
        return F.struct(
            url.alias("src"), alt.isNull().alias("missing_alt"), F.coalesce(text.trimmed(alt) == "", F.lit(False)).alias("empty_alt"),
            size_missing.alias("missing_dimensions"), (N.lower_attr(n, "loading") == "lazy").alias("lazy_loaded"), kind.isin("webp", "avif").alias("modern_format"),
        )

    pictures = N.tag("picture")
    modern_sources = F.exists(N.where(lambda n: (n["tag"] == "source") & N.lower_attr(n, "type").isin("image/webp", "image/avif")), lambda n: F.exists(pictures, lambda p: N.inside(n, p)))
    out = out.withColumn("images", F.transform("img_nodes", one)).withColumn("picture_sources", modern_sources)
    count = lambda c: F.size(F.filter("images", lambda i: i[c]))
    out = out.withColumns({"total_images": F.size("images"), "missing_alt": count("missing_alt"), "decorative_alt": count("empty_alt"), "missing_dimensions": count("missing_dimensions"), "lazy_loaded": count("lazy_loaded"), "modern_format": count("modern_format")})
    n, alt, dims, lazy = F.col("total_images"), F.col("missing_alt"), F.col("missing_dimensions"), F.col("lazy_loaded")
    modern = (F.col("modern_format") > 0) | F.col("picture_sources")
    score = F.when(n == 0, 100).otherwise(
        text.round_half_up(45 * (1 - alt / n)) + text.round_half_up(25 * (1 - dims / n)) + F.when(modern, 20).otherwise(0) + F.when(lazy > 0, 10).otherwise(0)
    )
    found = N.findings(
        N.finding("images_none", "info", n == 0), N.finding("alt_complete", "pass", (n > 0) & (alt == 0)), N.finding("alt_missing", "fail", alt > 0),
        N.finding("dimensions_complete", "pass", (n > 0) & (dims == 0)), N.finding("dimensions_missing", "warn", dims > 0),
        N.finding("modern_formats", "pass", (n > 0) & modern), N.finding("legacy_formats", "warn", (n > 0) & ~modern),
        N.finding("lazy_loading", "pass", lazy > 0), N.finding("lazy_loading_absent", "warn", (lazy == 0) & (n > 5)),
    )
    out = out.withColumns({"legacy_format": n - F.col("modern_format"), "image_score": text.clamp(score), "image_grade": text.grade(score), "image_findings": found})
    return out.drop("img_nodes", "picture_sources")


def links(pages: DataFrame, checked: DataFrame | None = None) -> DataFrame:
    """links array<struct<href,text,internal,rel,nofollow,...>>, counts; links_score.

    checked(page_id, checked_count, broken_count): the outcome of link_status(); None: links were not probed.
    """
    href = lambda n: text.trimmed(F.coalesce(N.attr(n, "href"), F.lit("")))
    anchors = F.filter(N.tag("a"), lambda n: (href(n) != "") & ~href(n).rlike("(?i)^(#|mailto:|tel:|javascript:|data:)"))
    out = pages.withColumn("anchors", anchors)
    imgs = N.tag("img")

    def one(n: Column) -> Column:
        label = text.collapse(F.coalesce(n["text"], F.lit("")))
        image = N.first(F.filter(imgs, lambda m: N.inside(m, n) & F.map_contains_key(m["attrs"], "alt")))
        named = (text.trimmed(F.coalesce(N.attr(image, "alt"), F.lit(""))) != "") | (text.trimmed(F.coalesce(N.attr(n, "aria-label"), F.lit(""))) != "")
        rel = N.attr(n, "rel")
        url = n["url"]
        return F.struct(
            url.alias("href"), label.alias("text"), (urls.host(url) == urls.host(F.col("final_url"))).alias("internal"), rel.alias("rel"),
            F.coalesce(F.lower(rel).rlike(r"\bnofollow\b"), F.lit(False)).alias("nofollow"),
            F.coalesce(F.lower(rel).rlike(r"\bsponsored\b"), F.lit(False)).alias("sponsored"), F.coalesce(F.lower(rel).rlike(r"\bugc\b"), F.lit(False)).alias("ugc"),
            ((label == "") & ~named).alias("empty_anchor"), F.lower(label).isin(fixed.GENERIC_ANCHORS).alias("generic"),
        )

    out = out.withColumn("links", F.filter(F.transform("anchors", one), lambda x: x["href"].isNotNull())).drop("anchors")
    count = lambda test: F.size(F.filter("links", test))
    out = out.withColumns({
        "total_links": F.size("links"), "internal_links": count(lambda x: x["internal"]), "external_links": count(lambda x: ~x["internal"]),
        "nofollow_links": count(lambda x: x["nofollow"]), "sponsored_links": count(lambda x: x["sponsored"]), "ugc_links": count(lambda x: x["ugc"]),
        "empty_anchor_text": count(lambda x: x["empty_anchor"]), "generic_count": count(lambda x: x["generic"]),
        "generic_anchor_text": F.array_distinct(F.transform(F.filter("links", lambda x: x["generic"]), lambda x: x["text"])),
    })
    if checked is None:
        out = out.withColumns({"checked_count": F.lit(None).cast("long"), "broken_count": F.lit(None).cast("long")})
    else:
        out = out.join(checked, "page_id", "left").fillna({"checked_count": 0, "broken_count": 0})
    inside, outside, empty, generic = F.col("internal_links"), F.col("external_links"), F.col("empty_anchor_text"), F.col("generic_count")
    probed, broken = F.col("checked_count"), F.col("broken_count")
    score = (
        F.when(inside == 0, 0).when(inside < 3, 15).otherwise(35) + F.when(outside == 0, 10).otherwise(20) + F.when(empty == 0, 15).otherwise(0)
        + F.greatest(F.lit(0), 20 - 2 * generic) + F.when(probed.isNull() | ((probed > 0) & (broken == 0)), 10).otherwise(0)
    )
    found = N.findings(
        N.finding("internal_none", "fail", inside == 0), N.finding("internal_few", "warn", inside.between(1, 2)), N.finding("internal_enough", "pass", inside >= 3),
        N.finding("external_none", "info", outside == 0), N.finding("external_some", "pass", outside > 0), N.finding("anchors_empty", "warn", empty > 0),
        N.finding("generic_none", "pass", generic == 0), N.finding("generic_some", "warn", generic > 0),
        N.finding("broken_unchecked", "info", probed.isNull()), N.finding("broken_none", "pass", (probed > 0) & (broken == 0)), N.finding("broken_some", "fail", broken > 0),
    )
    return out.withColumns({"links_score": text.clamp(score), "links_grade": text.grade(score), "link_findings": found})


def link_sample(pages: DataFrame, most: int = fixed.LINK_SAMPLE) -> DataFrame:
    """(page_id, href, pos, internal): a page's distinct links to probe, internal ones first; a repeated href keeps its first place and last value."""
    from pyspark.sql import Window

    each = pages.select("page_id", F.posexplode("links").alias("pos", "link"))
    one = each.groupBy("page_id", F.col("link.href").alias("href")).agg(F.min("pos").alias("pos"), F.max_by("link", "pos").alias("link"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(~F.col("link.internal"), "pos"))
    return one.withColumn("n", rank).where(F.col("n") <= most).select("page_id", "href", "pos", F.col("link.internal").alias("internal"))


def link_status(sample: DataFrame, fetches: DataFrame) -> DataFrame:
    """(page_id, checked_count, broken_count) of sampled links joined with fetches(url, status, ...), see probes.outcomes. A probe without an answer is broken."""
    joined = sample.join(probes.outcomes(fetches), urls.visit_key(F.col("href")) == F.col("key"), "left")
    return joined.groupBy("page_id").agg(F.count("key").alias("checked_count"), F.count_if(F.col("key").isNotNull() & F.coalesce(urls.broken(F.col("status")), F.lit(True))).alias("broken_count"))


def external_domains(pages: DataFrame, most: int = 20) -> DataFrame:
    """(page_id, domain, count, rank) of external links, ties by first appearance."""
    from pyspark.sql import Window

    each = pages.select("page_id", F.posexplode("links").alias("pos", "link")).where("not link.internal")
    counted = each.groupBy("page_id", urls.host(F.col("link.href")).alias("domain")).agg(F.count("*").alias("count"), F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("count"), "pos"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).drop("pos")


def _is_root(name: str):
    if name == "data-reactroot":
        return lambda n: F.map_contains_key(n["attrs"], name)
    return lambda n: N.attr(n, "id") == name


def rendering(pages: DataFrame) -> DataFrame:
    """Whether the text is there without scripts. pages: with content()."""
    out = pages
    found = F.lit(None).cast("struct<name:string,words:int>")
    for name in reversed(fixed.SPA_ROOTS):
        node = N.first(N.where(_is_root(name)))
        label = f"[{name}]" if name == "data-reactroot" else f"#{name}"
        words = F.size(F.filter(F.split(text.collapse(F.coalesce(node["text"], F.lit(""))), " "), lambda w: w != ""))
        found = F.when(node.isNotNull(), F.struct(F.lit(label).alias("name"), words.alias("words"))).otherwise(found)
    out = out.withColumn("spa_root", found).withColumn("spa_shell_detected", F.coalesce(F.col("spa_root.words") < 50, F.lit(False)))
    next_ = F.exists(F.col("nodes"), lambda n: (n["tag"] == "script") & (N.attr(n, "id") == "__NEXT_DATA__"))
    react = F.exists(F.col("nodes"), lambda n: F.map_contains_key(n["attrs"], "data-reactroot"))
    vue = F.exists(F.col("nodes"), lambda n: F.map_contains_key(n["attrs"], "data-v-app"))
    hint = F.coalesce(F.when(F.col("spa_shell_detected"), F.col("spa_root.name")), F.when(next_, F.lit("Next.js")), F.when(react, F.lit("React")), F.when(vue, F.lit("Vue")))
    script_bytes = F.aggregate(N.tag("script"), F.lit(0), lambda s, n: s + F.coalesce(F.octet_length(n["text"]), F.lit(0)))
    out = out.withColumns({"framework_hint": hint, "inline_script_bytes": script_bytes, "renders_without_js": (F.col("word_count") >= 100) & ~F.col("spa_shell_detected")}).drop("spa_root")
    found = N.findings(
        N.finding("renders", "pass", F.col("renders_without_js")), N.finding("spa_shell", "fail", F.col("spa_shell_detected")),
        N.finding("words_few", "warn", ~F.col("renders_without_js") & ~F.col("spa_shell_detected")),
        N.finding("script_heavy", "warn", (F.col("inline_script_bytes") > 0.5 * F.col("bytes")) & (F.col("bytes") > 50_000)),
    )
    return out.withColumn("render_findings", found)
