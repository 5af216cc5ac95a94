"""Long guidance per check name.  The texts are this package's own wording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteprism.common import literal_rows

# (check name, what is wrong, why it matters, how to fix it, short example)
GUIDES = [
    ("Robots.txt Presence", "No robots.txt was found at the site root.", "Crawlers then guess which areas matter and where the sitemap is.", "Publish a robots.txt that names the sitemap.", "User-agent: *\nAllow: /\nSitemap: https://example.com/sitemap.xml"),
    ("Robots.txt Blocking Critical Resources", "robots.txt keeps crawlers from styles, scripts or images.", "A page that cannot be rendered fully may be judged wrongly.", "Drop the rules that cover static files.", "Allow: /css/\nAllow: /js/"),
    ("Noindex Tags on Important Pages", "Pages that look important carry a noindex directive.", "They will leave the search results.", "Take the directive off every page that should be found.", "<meta name=\"robots\" content=\"index, follow\">"),
    ("Canonical Tag Presence", "Pages do not declare a canonical address.", "Variants of one page can compete with each other.", "Declare one canonical address per page.", "<link rel=\"canonical\" href=\"https://example.com/page\">"),
    ("Canonical Self-Referencing", "The canonical address is not the page's own.", "The page asks to be replaced by another one in the index.", "Point the canonical at the page unless it is a true copy.", "<link rel=\"canonical\" href=\"(this page)\">"),
    ("Orphan Pages", "No page links to these pages.", "Crawlers and visitors cannot reach them by following links.", "Link to them from related pages or remove them.", "<a href=\"/orphan\">Descriptive text</a>"),
    ("Missing Title Tag", "Pages have no title.", "The title is the headline of the search result.", "Write one title per page.", "<title>Topic - Brand</title>"),
    ("Title Too Short (<30 chars)", "Titles use little of the room they have.", "Short titles say too little about the page.", "Extend them to 50-60 characters.", "<title>Hand-made oak tables for small kitchens</title>"),
    ("Title Too Long (>60 chars)", "Titles are longer than a result shows.", "The end is cut off.", "Put the important words first and stay under 60 characters.", "<title>Oak tables for small kitchens</title>"),
    ("Duplicate Title Tags", "Several pages share a title.", "It is unclear which page answers a search.", "Give each page its own title.", "<title>Oak tables, size 120 cm</title>"),
    ("Missing Meta Description", "Pages have no description.", "The result text is then picked from the page.", "Summarise each page in 150-160 characters.", "<meta name=\"description\" content=\"...\">"),
    ("Missing H1", "Pages have no main heading.", "The topic of the page is not stated.", "Add one h1.", "<h1>Oak tables</h1>"),
    ("Multiple H1s", "Pages have more than one main heading.", "The main topic becomes unclear.", "Keep one h1 and turn the others into h2.", "<h1>Main</h1><h2>Part</h2>"),
    ("Missing Image Alt Text", "Images have no text alternative.", "Screen readers and image search cannot use them.", "Describe what the image shows.", "<img src=\"t.jpg\" alt=\"Oak table with two chairs\">"),
    ("TTFB > 800ms", "The first byte arrives after more than 800ms (average now: {average_ttfb_ms}ms).", "Everything else on the page waits for it.", "Cache pages and speed up the server's slow requests.", "Cache-Control: public, max-age=600"),
    ("Missing Image Dimensions", "Images state no width and height.", "The layout moves while they load.", "State both dimensions.", "<img src=\"t.jpg\" width=\"640\" height=\"480\" alt=\"...\">"),
    ("Duplicate Content URLs", "One text is served under several addresses.", "Links and ranking are split between them.", "Redirect the copies or give them a shared canonical.", "<link rel=\"canonical\" href=\"https://example.com/original\">"),
    ("Broken Internal Links (404)", "Links point to pages that were not found in the crawl.", "Visitors and crawlers meet a dead end.", "Correct the address or remove the link.", "<a href=\"/existing\">...</a>"),
    ("Nofollow on Internal Links", "Links within the site are marked nofollow.", "They pass no weight to your own pages.", "Remove the mark from internal links.", "<a href=\"/page\">...</a>"),
    ("Generic Anchor Text", "Link texts such as 'click here' say nothing about the target.", "The text is a hint about the linked page.", "Name the target in the link text.", "<a href=\"/sizes\">Table sizes</a>"),
    ("Missing Breadcrumbs", "Inner pages show no breadcrumb trail.", "The place of the page in the site is not visible.", "Add a trail with BreadcrumbList markup.", "{\"@type\": \"BreadcrumbList\"}"),
    ("Missing OpenGraph Tags", "Sharing tags are missing.", "Shared links appear without headline or picture.", "Add og:title and og:image.", "<meta property=\"og:title\" content=\"...\">"),
    ("Missing FAQ Schema", "Question pages carry no FAQPage markup.", "Rich question results stay out of reach.", "Mark questions and answers up.", "{\"@type\": \"FAQPage\"}"),
    ("Missing Breadcrumb Schema", "Inner pages carry no BreadcrumbList markup.", "The result shows a bare address instead of a trail.", "Mark the trail up.", "{\"@type\": \"BreadcrumbList\"}"),
    ("Missing/Invalid Hreflang", "Language links do not include the page itself.", "Language versions may be ignored.", "List every version, this page included.", "<link rel=\"alternate\" hreflang=\"en\" href=\"(this page)\">"),
    ("Missing Language Declaration", "The html element names no language.", "Screen readers and search engines have to guess it.", "Set the lang attribute.", "<html lang=\"en\">"),
    ("Missing Viewport Meta", "The viewport is not declared.", "Phones show the desktop layout.", "Declare the viewport.", "<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">"),
    ("Viewport Not Responsive", "The viewport has a fixed width.", "The page does not fit small screens.", "Use the width of the device.", "<meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">"),
    ("4xx Errors", "Pages answer with a client error.", "Visitors and crawlers reach a page that isn't there.", "Restore the page, redirect its address or drop the links to it.", "Redirect 301 /old /new"),
    ("Slow Server Response", "The server needs more than 600ms.", "Slow pages are crawled less and left sooner.", "Profile slow requests, cache, and move closer to visitors.", "Cache-Control: public, max-age=600"),
]


def guide_table(spark: SparkSession) -> DataFrame:
    return literal_rows(
        spark, GUIDES, "guide_title string, description string, why_it_matters string, how_to_fix string, code_example string"
    )
