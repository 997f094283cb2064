"""Operators over tables of fetched pages.

Links, headings and prose come from regular expressions over the page text,
JVM-side; a page is one row and no step gathers pages together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postmill.functions import fixed, gates, titles, urls
from postmill.functions.dates import bind, deadline, is_rolling
from postmill.functions.fixed import rule
from postmill.operators.cards import linked_cards
from postmill.operators.links import Wanted, links_of

ANCHOR = r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"'#]+)[\"'][^>]*>(.*?)</a\s*>"


def plain(html: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def links_by_expressions(html: Column, url: Column) -> Column:
    """pos, href, text, url of each link of a page, not tested yet."""
    def link(a: Column, i: Column) -> Column:
        text = plain(F.regexp_extract(a, ANCHOR, 2))
        return bind(F.regexp_extract(a, ANCHOR, 1), lambda href: F.struct(i.cast("int").alias("pos"), href.alias("href"), text.alias("text"), urls.normalise(href, url).alias("url"), F.lit(False).alias("tested")))

    return F.transform(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0)), link)


def anchors(pages: DataFrame, wanted: Wanted | None = None) -> DataFrame:
    """page_id, page_url, pos, href, text, url of every link, or of those
    ``wanted``.  ASCII pages are read in Arrow batches, others by expressions."""
    html, url = F.col("html"), F.col("url")
    ascii_only = F.coalesce((F.octet_length(html) == F.length(html)) & (F.octet_length(url) == F.length(url)), F.lit(False))
    by_batch = links_of(F.when(ascii_only, html), F.when(ascii_only, url), ANCHOR, wanted)
    # inside the generator, where a filter on an address does not compute it again
    found = pages.select("page_id", url.alias("page_url"), F.explode(F.when(ascii_only, by_batch).otherwise(links_by_expressions(html, url))).alias("a"))
    kept = found.select("page_id", "page_url", "a.*")
    return (kept if wanted is None else kept.where(F.col("tested") | wanted.condition())).drop("tested")


def first_links(links: DataFrame) -> DataFrame:
    """The first link to each URL of a page."""
    return links.withColumn("rn", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("pos"))).where("rn = 1").drop("rn")


def board_links(pages: DataFrame, limit: int = 120) -> DataFrame:
    """Internal links that look like a vacancy board, ranked: specific words
    first, then generic ones, then the rest, shallow paths first."""
    links = anchors(pages).where("url <> ''")
    same = urls.registrable(urls.host(F.col("url"))) == urls.registrable(urls.host(F.col("page_url")))
    boards = first_links(links.where(same & gates.looks_like_board(F.col("url"), F.col("text"))))
    return rank_links(boards).where(F.col("rank") <= limit)


def rank_links(links: DataFrame) -> DataFrame:
    low = F.lower(F.concat_ws(" ", "url", "text"))
    kind = F.when(gates.any_of(low, fixed.SPECIFIC_BOARD_WORDS), 0).when(gates.any_of(low, fixed.GENERIC_BOARD_WORDS), 1).otherwise(3)
    depth = F.least(F.size(urls.segments(F.col("url"))), F.lit(3))
    home = urls.path(F.col("url")).rlike(r"(?i)^/?$|^/[a-z]{2}(-[a-z]{2})?$")
    scored = links.where(~home).withColumn("score", kind * 10 + depth)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("page_id").orderBy("score", "pos")))


def vacancy_links(pages: DataFrame) -> DataFrame:
    """Links whose address and text read like a vacancy, the first of each;
    ``is_phd`` tells doctoral roles."""
    good = Wanted(15, 240, text=(fixed.ROLE_TITLE,), no_text=(fixed.BROWSE_TEXT, fixed.STUDENT_SUPPORT), url=(fixed.DETAIL_LINK,))
    kept = anchors(pages, good).withColumn("key", urls.vacancy_key(F.col("url")))
    first = kept.groupBy("page_id", "key").agg(F.min(F.struct("pos", "url", "text")).alias("f")).select("page_id", "f.*")
    return first.withColumn("is_phd", F.col("text").rlike(rule(fixed.DOCTORAL_ROLE)))


def recovered_links(pages: DataFrame, most: int = 200) -> DataFrame:
    """Links with a job-like title of 20 characters or more and no noise, the
    first of each address, at most ``most`` a page."""
    first = first_links(anchors(pages, Wanted(20, text=(f"(?:{fixed.DOCTORAL_TEXT}|{fixed.JOB_TEXT})",), no_text=(fixed.NOISE_TEXT,))))
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("n") <= most)
    return ranked.select("page_id", "n", "url", F.left("text", F.lit(200)).alias("title"))


def result_links(pages: DataFrame, base_host: Column) -> DataFrame:
    """Hits of a search-result page: redirects unwrapped, on the wanted host
    only, the first of each; ``base_host`` may use the page's columns."""
    hosted = anchors(pages.select("page_id", "url", "html")).withColumn("url", urls.unwrap_redirect(F.col("url")))
    wanted = pages.select("page_id", base_host.alias("wanted"))
    kept = hosted.where(F.col("url").startswith("http")).join(wanted, "page_id").where(urls.in_scope(F.col("url"), F.col("wanted")))
    return first_links(kept).select("page_id", "pos", "url", F.left("text", F.lit(200)).alias("title"))


def careers_links(pages: DataFrame, most: int = 5) -> DataFrame:
    """The first links of a homepage whose text names careers."""
    first = first_links(anchors(pages, Wanted(text=(fixed.CAREERS_TEXT,), no_text=(fixed.NOT_CAREERS_TEXT,))))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("n") <= most).select("page_id", "n", "url", "text")


def harvest(pages: DataFrame, as_of: Column, limit: int = 80) -> DataFrame:
    """Postings of listing pages, the first of each address, in page order, at
    most ``limit`` a page.

    A link's title is the heading of its card where that is 13 to 199 characters
    long, else its own text; where that is no longer than 12, the first words of
    the row around it.  It must look like a posting, its card must be relevant and
    its title be no banner; a title of up to three words gives way to the address
    where that spells one.  The deadline comes from title and card.
    """
    links = linked_cards(pages)
    href, text, head, row = F.col("href"), F.col("text"), F.col("heading"), F.col("row_text")
    address = F.when(href.rlike("^(https?:)?//"), href).otherwise(urls.resolved(href, F.col("page_url")))
    link = links.withColumn("url", F.explode(F.array(address)))  # computed once, whatever filters ask for it
    own = F.when((F.length(head) > 12) & (F.length(head) < 200), head).otherwise(text)
    short = (F.length(own) <= 12) & F.col("card").isNotNull() & (F.length(row) > 12)
    title = F.when(short, F.coalesce("row_first", F.lit(""))).otherwise(own)
    named = link.where(F.col("url").startswith("http") & ~F.col("url").rlike("(?i)#(main|content|accept|refuse|cookie)")).withColumn("title", title)
    context = F.left(F.when((F.length("title") <= 12) & row.isNotNull(), row).otherwise(F.coalesce("card", "text")), F.lit(700))
    shown = F.when(F.length("title") > 12, F.col("title")).otherwise(text)
    rows = named.where(gates.is_posting_link(F.col("url"), shown)).withColumn("context", context).where(gates.relevance(F.col("context"))).withColumn("key", F.rtrim(F.substring_index("url", "?", 1), F.lit("/")))
    told = F.coalesce(F.nullif("title", F.lit("")), "text")
    kept = rows.withColumn("title", told).where(~gates.is_banner(F.trim("title")))
    first = kept.groupBy("page_id", "key").agg(F.min(F.struct("pos", "url", "title", "context")).alias("f")).select("page_id", "f.*")
    ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("n") <= limit)
    final = ranked.withColumn("title", titles.title_from_address(F.col("url"), F.col("title")))
    whole = F.concat_ws(" ", "title", "context")
    dated = final.withColumn("d", F.explode(F.array(deadline(whole, as_of)))).withColumn("rolling", is_rolling(whole))
    return dated.select(
        "page_id", "n", "url", F.left(F.coalesce(F.nullif("title", F.lit("")), F.lit("(untitled)")), F.lit(180)).alias("title"), "context", F.col("d.raw").alias("deadline"), F.col("d.value").alias("deadline_date"),
        F.when(F.col("rolling"), "rolling").otherwise(F.col("d.status")).alias("deadline_status"),
    )


def verified_boards(pages: DataFrame, as_of: Column) -> DataFrame:
    """page_id, postings, verified of fetched board pages: a board yields
    postings or lists vacancies."""
    counts = harvest(pages, as_of).groupBy("page_id").agg(F.count(F.lit(1)).alias("postings"))
    n = F.coalesce("postings", F.lit(0).cast("long"))
    return pages.join(counts, "page_id", "left").select("page_id", n.alias("postings"), ((n > 0) | gates.lists_positions(F.col("html"))).alias("verified"))


def enrich(postings: DataFrame, pages: DataFrame, as_of: Column) -> DataFrame:
    """Postings with what their detail page adds: description, deadline (the
    page's where it states one), funding flag, country, organisation and
    heading.  ``postings``: url, title, context, country and any others;
    ``pages``: url, html, one row for each url."""
    site = F.left(F.regexp_extract("html", r"(?is)<meta\b[^>]*(?:og:site_name|application-name)[^>]*content\s*=\s*[\"']([^\"']*)", 1), F.lit(90))
    # a page is read once, before it meets its postings, however many they are; exploded arrays stay below the join
    read = F.explode(F.array(F.struct(description(F.coalesce("html", F.lit(""))).alias("description_full"), site.alias("org_hint"), heading(F.col("html")).alias("page_heading"))))
    detail = pages.select(F.col("url").alias("page_url"), read.alias("page")).select("page_url", "page.*")
    rows = postings.join(detail, postings["url"] == detail["page_url"], "left").withColumn("enriched", F.col("page_url").isNotNull())
    blob = rows.withColumn("description_full", F.coalesce("description_full", F.lit(""))).withColumn("blob", F.concat_ws(" ", "title", "context", "description_full"))
    found = F.when(F.col("enriched"), deadline(F.when(F.col("enriched"), F.col("blob")), as_of))
    dated = blob.withColumn("page_deadline", F.explode(F.array(found)))
    status = F.when(is_rolling(F.col("blob")), F.lit("rolling")).otherwise(F.col("page_deadline.status"))
    return dated.select(
        *postings.drop("country").columns, "enriched", "description_full", F.col("page_deadline.raw").alias("page_deadline_raw"), F.col("page_deadline.value").alias("page_deadline_date"),
        F.when(F.col("page_deadline.raw") != "", status).otherwise("unknown").alias("page_deadline_status"), F.when(F.col("enriched"), titles.has_funding(F.col("blob"))).otherwise(False).alias("has_funding_evidence"),
        F.coalesce(F.nullif(F.when(F.col("enriched"), titles.infer_country(F.col("url"), F.col("blob"))), F.lit("")), "country").alias("country"),
        "org_hint", "page_heading",
    )


def enrichment_counts(enriched: DataFrame) -> DataFrame:
    """How many rows were enriched, have a country, a deadline, funding."""
    return enriched.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("enriched").alias("enriched"), F.count_if(F.coalesce("country", F.lit("")) != "").alias("with_country"),
        F.count_if(F.coalesce("page_deadline_raw", F.lit("")) != "").alias("with_deadline"), F.count_if("has_funding_evidence").alias("with_funding"),
    )


def description(html: Column, least: int = 200, most: int = 4000, keep: int = 2500) -> Column:
    """The longest prose block (a p, div or section without another inside)
    that is no boilerplate; the first among equals."""
    body = F.regexp_replace(html, r"(?is)<(script|style|nav|header|footer|noscript)\b.*?</\1\s*>", " ")
    blocks = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<(?:p|div|section)\b[^>]*>((?:(?!<(?:p|div|section)\b|</(?:p|div|section)).)*)"), F.lit(1)), plain)
    good = F.filter(blocks, lambda b: (F.length(b) > least) & (F.length(b) < most) & ~b.rlike(rule(fixed.BOILERPLATE)))
    best = F.aggregate(good, F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    return F.left(best, F.lit(keep))


def heading(html: Column) -> Column:
    return F.left(plain(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1", 1)), F.lit(140))


def next_page(links: DataFrame) -> DataFrame:
    """Per page the first link to a following page: a pager word or a page
    number in the address; never a template, the page itself, a page before it
    or, from a numbered page, another listing."""
    own, href, u = F.col("page_url"), F.col("href"), F.col("next")
    pager = F.trim("text").rlike(rule(fixed.PAGER_WORDS)) | href.rlike(r"[?&](page|p|offset|start)=\d+") | href.rlike(r"/page/\d+")
    template = href.rlike(r"[?&](page|p|offset|start)=\s*(#|$)") | href.rlike(r"/page/\s*(#|$)")
    here, there = urls.page_number(own), urls.page_number(u)
    backward = F.coalesce(there <= here, F.lit(False))
    elsewhere = here.isNotNull() & (F.rtrim(urls.unpaged(u), F.lit("/")) != F.rtrim(urls.unpaged(own), F.lit("/")))
    # addresses of what may be a pager only, exploded so that the filter does not compute them again
    named = links.where(pager & ~template).withColumn("next", F.explode(F.array(urls.absolute(href, own))))
    good = named.where(u.startswith("http") & (u != own) & ~backward & ~elsewhere)
    return good.groupBy("page_id").agg(F.min_by("next", "pos").alias("next_url"))


def by_rules(pages: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of pages by per-host extraction rules, a column for each of
    ``fields``; ``rules`` has host, field and pattern (the first group is the
    value)."""
    hosted = pages.withColumn("host", urls.host(F.col("url")))
    found = hosted.join(rules, "host").select("page_id", "field", F.nullif(plain(F.expr("regexp_extract(html, pattern, 1)")), F.lit("")).alias("value"))
    return found.groupBy("page_id").pivot("field", fields).agg(F.first("value"))


def line_record(text: Column) -> Column:
    """Fields of a card given as lines, around the line that says when it was
    posted: org, posted, title, department, field, country, city, description;
    null without such a line."""
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    at = F.array_position(F.transform(lines, lambda x: x.contains("Posted on:")), True).cast("int")
    line = F.get(lines, at - 1)
    after = lambda label: F.coalesce(F.trim(F.replace(F.try_element_at(F.filter(lines, lambda x: x.startswith(label)), F.lit(-1)), F.lit(label), F.lit(""))), F.lit(""))
    place = r"Number of offers:\s*\d+,\s*([^,]+),\s*([^,\n]+)"
    record = F.struct(
        F.trim(F.regexp_replace(line, "Posted on:.*$", "")).alias("org"), F.trim(F.regexp_extract(line, r"Posted on:\s*(.+)", 1)).alias("posted"),
        F.coalesce(F.get(lines, at), F.lit("")).alias("title"), after("Department:").alias("department"), after("Research Field:").alias("field"),
        F.trim(F.regexp_extract(text, place, 1)).alias("country"), F.trim(F.regexp_extract(text, place, 2)).alias("city"),
        F.left(F.array_join(F.slice(lines, at + 2, 3), " "), F.lit(400)).alias("description"),
    )
    return F.when(at > 0, record)


def requirements(html: Column, most: int = 20) -> Column:
    items = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<(?:li|p)\b[^>]*>(.*?)</(?:li|p)"), F.lit(1)), plain)
    return F.slice(F.filter(items, lambda x: F.length(x) > 20), 1, most)
