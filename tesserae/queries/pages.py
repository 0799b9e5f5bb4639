"""Queries from pages to chunks. The tables hold no HTML, so each chunk is first put into a page of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import catalog as C
from tesserae.operators import chunking, crawl, pages
from tesserae.plans.stage import shared_dir
from tesserae.registry import query
from tesserae.sources.tables import read

# White space at the ends of lines, as Unicode has it.
_WS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = rf"^{_WS}+|{_WS}+$"


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, html: a page for each chunk, with its title, headers and content, a menu, a comment and links."""
    rows = C.once(spark, sf_dir, "source", "content_type", "title", "headers_context", "content").where("source is not null and content is not null")
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.filter(F.transform(F.split("content", "\n"), lambda x: F.regexp_replace(x, _TRIM, "")), lambda x: x != "")
    put = lambda xs, a, b: F.array_join(F.transform(xs, lambda x: F.concat(F.lit(a), safe(x), F.lit(b))), "\n")
    heads = F.filter(F.coalesce("headers_context", F.lit([]).cast("array<string>")), lambda x: x != "")
    headings = F.array_join(F.transform(heads, lambda x, i: F.concat(F.lit("<h"), (i + 2).cast("string"), F.lit(">"), safe(x), F.lit("</h"), (i + 2).cast("string"), F.lit(">"))), "")
    image = F.concat(F.lit('<img src="/img/'), F.col("chunk_id"), F.lit('.png" alt="">'), put(lines, "<p>", "</p>"))
    body = (
        F.when(F.col("content_type") == "list", F.concat(F.lit("<ul>"), put(lines, "<li>", "</li>"), F.lit("</ul>")))
        .when(F.col("content_type") == "table", F.concat(F.lit('<table class="wikitable">'), put(lines, "<tr><td>", "</td></tr>"), F.lit("</table>")))
        .when(F.col("content_type") == "image_ocr", image)
        .otherwise(put(lines, "<p>", "</p>"))
    )
    html = F.concat(
        F.lit('<html><head><style>p {}</style></head><body><div class="menu"><p>menu</p></div><h1 id="firstHeading">'), safe(F.coalesce("title", F.lit(""))), F.lit('</h1><div id="mw-content-text">'),
        headings, F.lit("<!-- end -->"), body, F.lit('<div class="footer">footer</div></div><a href="../../x?y#z">x</a></body></html>'),
    )
    return rows.select(F.concat("source", F.lit("/"), "chunk_id").alias("url"), html.alias("html"))


_ITEMS = rf"""{C._CHUNKS}, pg as (select source || '/' || chunk_id as url, chunk_id, source, content_type, coalesce(nullif(trim(title, ' '), ''), 'No Title') as title, list_filter(coalesce(headers_context, []), lambda x: x <> '') as h,
    list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '{_TRIM}', '', 'g')), lambda x: x <> '') as l from ch where source is not null and content is not null),
it as (select url, chunk_id, source, title, h,
  flatten(list_transform(range(1, len(h) + 1), lambda i: [{{'type': 'header', 'level': cast(i + 1 as int), 'content': h[i], 'context': h[:i]}}, {{'type': 'text', 'level': null, 'content': h[i], 'context': h[:i]}}])) ||
  case when content_type = 'list' then case when len(l) = 0 then [] else [{{'type': 'list', 'level': null, 'content': array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)), 'context': h}}] end
    when content_type = 'table' then case when len(l) = 0 then [] else [{{'type': 'table', 'level': null, 'content': array_to_string(list_transform(l, lambda x: '| ' || array_to_string(list_filter(string_split_regex(x, '{_WS}+'), lambda y: y <> ''), ' ') || ' |')[:1] || ['|---|'] ||
      list_transform(l, lambda x: '| ' || array_to_string(list_filter(string_split_regex(x, '{_WS}+'), lambda y: y <> ''), ' ') || ' |')[2:], chr(10)), 'context': h}}] end
    else case when content_type = 'image_ocr' then [{{'type': 'image', 'level': null, 'content': '', 'context': h}}] else [] end ||
      flatten(list_transform(l, lambda x: [{{'type': 'paragraph', 'level': null, 'content': x, 'context': h}}, {{'type': 'text', 'level': null, 'content': x, 'context': h}}])) end as items from pg)"""


@query(f"""with {_ITEMS}, e as (select url, chunk_id, source, unnest(items) as i, unnest(range(0, len(items))) as pos from it)
  select url, cast(pos as int) as pos, i.type as type, coalesce(i.level, 0) as level, md5(i.content) as content, array_to_string(i.context, ' | ') as context,
    case when i.type = 'image' then regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0) || '/img/' || chunk_id || '.png' end as image_url from e""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pages.structured_items(wiki_pages(spark, sf_dir))
    return rows.select("url", "pos", "type", F.coalesce("level", F.lit(0)).alias("level"), F.md5("content").alias("content"), F.array_join("context", " | ").alias("context"), "image_url")


_PIECES = r"flatten(list_transform(list_filter(string_split(regexp_replace({}, '([.!?])\s+', '\1␞', 'g'), '␞'), lambda s: trim(s, ' ') <> ''), lambda s: list_transform(range(0, length(s), 512), lambda i: substring(s, cast(i as bigint) + 1, 512))))"
_FOLD = """
fold as (
  select key, parts, 1 as i, [parts[1]] as buf, length(parts[1]) as n, cast(null as varchar) as flushed from src
  union all
  select key, parts, i + 1, case when fits then buf || [p] else rest || [p] end, case when fits then n + length(p) else coalesce(list_sum(list_transform(rest, lambda s: length(s))), 0) + length(p) end, case when fits then null else array_to_string(buf, ' ') end
  from (select *, n + length(p) <= 512 as fits, buf[len(buf) - greatest(1, cast(floor(len(buf) * 0.25) as int)) + 1:] as rest from (select *, parts[i + 1] as p from fold where i < len(parts)))),
outs as (select key, i, flushed as content from fold where flushed is not null union all select key, i + 1, array_to_string(buf, ' ') from fold where i = len(parts))"""
C.SQL["chunk_sentences"] = f"""with recursive src as (select doc_id as key, {_PIECES.format('text')} as parts from documents where text is not null and len({_PIECES.format('text')}) > 0), {_FOLD}
  select key as doc_id, cast(row_number() over (partition by key order by i) - 1 as int) as chunk_no, content from outs"""


_UNITS = f"""un as (select url, title, chunk_id, source, flatten(list_transform(items, lambda t: case when t.type in ('paragraph', 'text') then list_transform({_PIECES.format('t.content')}, lambda p: {{'kind': 'text', 'content': p, 'context': t.context}})
  else [{{'kind': t.type, 'content': t.content, 'context': t.context}}] end)) as units from it)"""
_CHUNK_FOLD = """
pf as (
  select url, units, 0 as i, cast([] as varchar[]) as buf, 0 as n, cast([] as varchar[]) as ctx, cast(null as varchar) as head, 0 as no, cast([] as struct(content varchar, context varchar[], kind varchar, no int)[]) as em from un
  union all
  select url, units, i + 1,
    case when u.kind = 'header' then buf when u.kind <> 'text' then [] when fits then buf || [u.content] else rest || [u.content] end,
    case when u.kind = 'header' then n when u.kind <> 'text' then 0 when fits then n + length(u.content) else coalesce(list_sum(list_transform(rest, lambda s: length(s))), 0) + length(u.content) end,
    case when u.kind = 'header' and u.content is distinct from head then u.context else ctx end,
    case when u.kind = 'header' then u.content else head end,
    case when u.kind = 'header' then no when u.kind = 'image' then no + has when u.kind <> 'text' then no + has + 1 when fits then no else no + 1 end,
    case when u.kind = 'header' then [] when u.kind <> 'text' then closed || [{'content': case when u.kind <> 'image' then u.content end, 'context': u.context, 'kind': case when u.kind = 'image' then 'image_ocr' else u.kind end, 'no': case when u.kind <> 'image' then no + has end}]
      when fits then [] else closed end
  from (select *, len(buf) = 0 or n + length(u.content) <= 512 as fits, buf[len(buf) - greatest(1, cast(floor(len(buf) * 0.25) as int)) + 1:] as rest, case when len(buf) > 0 then 1 else 0 end as has,
      case when len(buf) > 0 then [{'content': array_to_string(buf, ' '), 'context': ctx, 'kind': 'text', 'no': no}] else [] end as closed
    from (select *, units[i + 1] as u from pf where i < len(units)))),
pe as (select url, i, unnest(em) as c, generate_subscripts(em, 1) as j from pf union all
  select url, i + 1, {'content': array_to_string(buf, ' '), 'context': ctx, 'kind': 'text', 'no': no}, 1 from pf where i = len(units) and len(buf) > 0),
po as (select url, c, cast(row_number() over (partition by url order by i, j) - 1 as int) as pos from pe)"""


@query(f"""with recursive {_ITEMS}, {_UNITS}, {_CHUNK_FOLD}
  select sha256(case when c.kind = 'image_ocr' then regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', 0) || '/img/' || chunk_id || '.png-0' else url || '-' || c.no end) as chunk_id, url as source, c.kind as content_type, title,
    array_to_string(list_filter(c.context, lambda x, k: list_position(c.context, x) = k), ' | ') as headers, md5(case when c.kind = 'image_ocr' then 'ALT_TEXT: ' else c.content end) as content, coalesce(c.no, -1) as chunk_index, pos
  from po join (select url, title, chunk_id from it) using (url)
  where c.kind = 'image_ocr' or length(trim(case when len(c.context) > 0 then '[' || array_to_string(c.context, ' | ') || '] ' else '' end || c.content, ' ')) >= 64""")
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.page_chunks(pages.page_items(wiki_pages(spark, sf_dir)))
    return rows.select("chunk_id", "source", "content_type", "title", F.array_join("headers_context", " | ").alias("headers"), F.md5("content").alias("content"), F.coalesce("chunk_index", F.lit(-1)).alias("chunk_index"), "pos")


# ---- links, crawl and sitemap

_DOMAIN = "https://"
_NOT = " and ".join(f"not contains(loc, '{n}')" for n in pages.NAMESPACES)


@query(f"select distinct loc, coalesce(starts_with(loc, '{_DOMAIN}') and contains(loc, '/wiki/index.php/') and {_NOT} and not regexp_matches(regexp_replace(regexp_replace(loc, '^.*/wiki/index\\.php/', ''), '#.*$', ''), '[:?]'), false) as is_page from sitemap where loc is not null")
def wiki_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "sitemap").where("loc is not null").select("loc").distinct()
    return rows.select("loc", pages.is_wiki_page(F.col("loc"), _DOMAIN).alias("is_page"))


# A site made of the sources: page n of all links to pages 2 n + 1 and 2 n + 2, every fifth page can't be fetched.
_NODES = "nd as (select source, row_number() over (order by source) - 1 as n from (select distinct source from chunks_memory where source is not null))"


def _site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """url, html of the pages; a page that can't be fetched has no html."""
    rows = read(spark, sf_dir, "chunks_memory").where("source is not null").select("source").distinct()
    rows = C.numbered(rows, ["source"], "n")
    children = rows.where("n > 0").select(F.floor((F.col("n") - 1) / 2).alias("n"), F.col("source").alias("to")).groupBy("n").agg(F.sort_array(F.collect_list("to")).alias("to"))  # two at most
    both = rows.join(children, "n", "left")
    anchors = F.array_join(F.transform(F.coalesce("to", F.lit([]).cast("array<string>")), lambda t: F.concat(F.lit('<a href="'), t, F.lit('?a=1#b">x</a>'))), " ")
    html = F.when(F.col("n") % 5 != 4, F.concat(F.lit('<div id="mw-content-text"><p>'), anchors, F.lit("</p></div><a href='/out'>out</a>")))
    return both.select(F.col("source").alias("url"), html.alias("html"), "n")


_CRAWL = f"""{_NODES}, bfs as (select source, n, 0 as depth from nd where n = 0 and n % 5 <> 4 union all
  select nd.source, nd.n, depth + 1 from bfs join nd on nd.n in (2 * bfs.n + 1, 2 * bfs.n + 2) where depth < 10 and nd.n % 5 <> 4),
found as (select source as url, depth from bfs qualify row_number() over (order by depth, source) <= 200)"""


@query(f"with {_NODES} select a.source as src, regexp_replace(b.source, '[?#].*$', '') as dst from nd a join nd b on b.n in (2 * a.n + 1, 2 * a.n + 2) where a.n % 5 <> 4")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.links(_site(spark, sf_dir).where("html is not null"))


@query(f"with recursive {_CRAWL} select url, cast(depth as int) as depth from found")
def crawl_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _site(spark, sf_dir)
    start = site.where("n = 0").first()["url"]
    return crawl.crawl(pages.links(site.where("html is not null")), site.select("url", F.col("html").isNotNull().alias("fetched")), start)


@query(f"with recursive {_CRAWL} select count(*) as total, count(*) filter (n % 5 <> 4) as fetched, count(*) filter (n % 5 = 4) as failed, (select count(*) from found) as crawled from nd")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = _site(spark, sf_dir)
    found = crawl_site(spark, sf_dir).agg(F.count("*").alias("crawled"))
    return site.agg(F.count("*").alias("total"), F.count_if(F.col("html").isNotNull()).alias("fetched"), F.count_if(F.col("html").isNull()).alias("failed")).join(F.broadcast(found), how="cross")


@query(f"with recursive {_CRAWL} select url as loc, '2025-01-02' as lastmod, 'weekly' as changefreq, case when depth = 0 then 1.0 else 0.8 end::double as priority from found")
def sitemap_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawled pages as a sitemap: written as XML and read again."""
    import datetime
    import uuid

    found = crawl_site(spark, sf_dir)
    path = f"{shared_dir(spark)}/sitemap-{uuid.uuid4().hex}"
    start = found.where("depth = 0").first()["url"]
    crawl.write_sitemap(crawl.sitemap(found, start, datetime.date(2025, 1, 2)), path)
    return crawl.read_sitemap(spark, path).withColumn("lastmod", F.col("lastmod").cast("string"))
