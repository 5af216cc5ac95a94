"""The 100 audit rules: id, name, severity, unit, recommendation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siteprism.common import literal_rows

# Category of each run of ten check ids, in order.
CATEGORIES = [
    "Crawlability & Indexability", "On-Page SEO", "Technical Performance", "URL Structure",
    "Internal Linking", "Content Quality", "Structured Data", "Security & Accessibility",
    "Mobile Optimization", "Server & Infrastructure",
]

# Check names, severities and recommendations as users see them.
# Unit: P page predicate, E elements counted per page, G duplicate group,
# J link join, H headers, S site, C constant pass.
RULES = [
    (1, "Robots.txt Presence", "high", "S", "Create a robots.txt file to control crawler access."),
    (2, "Robots.txt Blocking Critical Resources", "critical", "S", "Remove disallow rules for CSS, JS, and image files."),
    (3, "Sitemap.xml Presence", "high", "S", "Create an XML sitemap and submit to search engines."),
    (4, "Sitemap Validity", "medium", "S", "Fix sitemap XML errors for proper indexing."),
    (5, "Noindex Tags on Important Pages", "critical", "P", "Remove noindex from pages you want indexed."),
    (6, "Canonical Tag Presence", "medium", "P", "Add canonical tags to all indexable pages."),
    (7, "Canonical Self-Referencing", "medium", "P", "Ensure canonical tags point to the page itself."),
    (8, "X-Robots-Tag in Headers", "high", "H", "Remove X-Robots-Tag: noindex from important pages."),
    (9, "Orphan Pages", "high", "J", "Add internal links to orphan pages or remove them."),
    (10, "Crawl Depth > 4", "medium", "P", "Flatten site structure to max 4 clicks from homepage."),
    (11, "Missing Title Tag", "high", "P", "Add unique title tags to all pages (50-60 characters)."),
    (12, "Title Too Short (<30 chars)", "medium", "P", "Expand titles to 50-60 characters for better SEO."),
    (13, "Title Too Long (>60 chars)", "low", "P", "Shorten titles to under 60 characters to avoid truncation."),
    (14, "Duplicate Title Tags", "high", "G", "Make each page title unique."),
    (15, "Missing Meta Description", "high", "P", "Add unique meta descriptions (150-160 characters)."),
    (16, "Meta Description Length", "low", "P", "Optimize meta descriptions to 150-160 characters."),
    (17, "Missing H1", "high", "P", "Add a single H1 tag to each page."),
    (18, "Multiple H1s", "medium", "P", "Use only one H1 tag per page."),
    (19, "Heading Hierarchy Broken", "low", "P", "Follow proper heading hierarchy: H1 -> H2 -> H3."),
    (20, "Missing Image Alt Text", "medium", "P", "Add descriptive alt text to all images."),
    (21, "LCP > 2.5s", "high", "P", "Optimize Largest Contentful Paint to under 2.5s."),
    (22, "INP > 200ms", "medium", "P", "Optimize Interaction to Next Paint to under 200ms."),
    (23, "CLS > 0.1", "high", "P", "Reduce Cumulative Layout Shift to under 0.1."),
    (24, "TTFB > 800ms", "medium", "P", "Improve server response time to under 800ms."),
    (25, "Render-Blocking Resources", "high", "P", "Defer non-critical CSS/JS or inline critical styles."),
    (26, "Uncompressed Images", "medium", "E", "Compress images to under 200KB."),
    (27, "Missing Image Dimensions", "medium", "P", "Add width and height attributes to images."),
    (28, "No Text Compression", "medium", "H", "Enable gzip or Brotli compression on the server."),
    (29, "Unminified CSS/JS", "low", "P", "Minify CSS and JavaScript files."),
    (30, "Third-Party Script Impact", "medium", "P", "Reduce third-party scripts or load them asynchronously."),
    (31, "URL Length > 100 chars", "low", "P", "Keep URLs under 100 characters."),
    (32, "Non-ASCII Characters", "medium", "P", "Use only ASCII characters in URLs."),
    (33, "Underscores in URLs", "low", "P", "Use hyphens instead of underscores in URLs."),
    (34, "Uppercase in URLs", "low", "P", "Use lowercase URLs for consistency."),
    (35, "Trailing Slash Inconsistency", "medium", "P", "Be consistent with trailing slashes."),
    (36, "URL Depth > 4 levels", "medium", "P", "Flatten URL structure to max 4 levels."),
    (37, "Dynamic Parameters", "medium", "P", "Use clean, static URLs without query parameters."),
    (38, "Session IDs in URLs", "high", "P", "Remove session IDs from URLs; use cookies instead."),
    (39, "Duplicate Content URLs", "high", "G", "Consolidate duplicate content or use canonical tags."),
    (40, "Missing Keywords in URL", "low", "P", "Include target keywords in URL slugs."),
    (41, "Poorly Linked Pages", "medium", "J", "Increase internal links to important pages. These pages have only 1-2 incoming links."),
    (42, "Broken Internal Links (404)", "high", "J", "Fix or remove broken internal links."),
    (43, "Redirect Chains (Internal)", "medium", "P", "Update links to point directly to final URLs."),
    (44, "Nofollow on Internal Links", "medium", "E", "Remove nofollow from internal links."),
    (45, "Generic Anchor Text", "medium", "P", "Use descriptive anchor text for internal links."),
    (46, "Low Internal Link Count", "medium", "P", "Add more internal links to pages (at least 3)."),
    (47, "High Internal Link Count", "low", "P", "Reduce excessive internal links (max 100 per page)."),
    (48, "Missing Breadcrumbs", "low", "P", "Add breadcrumb navigation with Schema markup."),
    (49, "Deep Pages (> 4 clicks)", "medium", "P", "Ensure important pages are within 4 clicks of homepage."),
    (50, "Pagination Issues", "medium", "P", "Add rel='next' and rel='prev' for pagination."),
    (51, "Thin Content (< 300 words)", "high", "P", "Add more valuable content (aim for 500+ words)."),
    (52, "Duplicate Content (Internal)", "high", "G", "Remove or consolidate duplicate content."),
    (53, "Near-Duplicate Content", "medium", "P", "Differentiate or merge near-duplicate pages."),
    (54, "Missing Content", "high", "P", "Add meaningful content to empty pages."),
    (55, "Keyword Stuffing", "medium", "P", "Reduce keyword density to natural levels (<3%)."),
    (56, "Outdated Content", "low", "C", "Update content with old dates regularly."),
    (57, "Broken Images", "medium", "E", "Fix or remove broken image links."),
    (58, "Missing OpenGraph Tags", "low", "P", "Add og:title and og:image for social sharing."),
    (59, "Missing Twitter Cards", "low", "P", "Add Twitter Card meta tags for better sharing."),
    (60, "Low Readability Score", "low", "P", "Simplify content for better readability."),
    (61, "No Structured Data", "medium", "P", "Add JSON-LD structured data to pages."),
    (62, "Schema Syntax Errors", "high", "P", "Fix structured data syntax errors."),
    (63, "Missing Organization Schema", "medium", "S", "Add Organization schema to homepage."),
    (64, "Missing Breadcrumb Schema", "low", "P", "Add BreadcrumbList schema to inner pages."),
    (65, "Missing Article Schema", "medium", "P", "Add Article schema to blog/news pages."),
    (66, "Missing Product Schema", "high", "P", "Add Product schema to product pages."),
    (67, "Missing LocalBusiness Schema", "high", "S", "Add LocalBusiness schema if you have a physical location."),
    (68, "Missing FAQ Schema", "low", "P", "Add FAQPage schema to FAQ sections."),
    (69, "Missing Review Schema", "medium", "P", "Add Review schema to pages with reviews."),
    (70, "Incomplete Schema Fields", "medium", "E", "Add all required fields to schema markup."),
    (71, "Not HTTPS", "critical", "P", "Migrate all pages to HTTPS."),
    (72, "Mixed Content", "high", "P", "Load all resources over HTTPS."),
    (73, "Missing SSL Certificate", "critical", "S", "Install an SSL certificate."),
    (74, "Expired SSL Certificate", "critical", "C", "Renew SSL certificate before expiry."),
    (75, "Missing HSTS Header", "medium", "H", "Enable HSTS (Strict-Transport-Security header)."),
    (76, "Missing Language Declaration", "medium", "P", "Add lang attribute to HTML tag."),
    (77, "Missing/Invalid Hreflang", "high", "P", "Ensure hreflang tags include self-referencing."),
    (78, "Low Color Contrast", "low", "P", "Improve color contrast for accessibility."),
    (79, "Missing Form Labels", "medium", "P", "Add labels to all form inputs."),
    (80, "Missing Skip Links", "low", "P", "Add skip-to-content links for accessibility."),
    (81, "Missing Viewport Meta", "high", "P", "Add viewport meta tag for mobile responsiveness."),
    (82, "Viewport Not Responsive", "high", "P", "Set viewport to width=device-width, initial-scale=1."),
    (83, "Tap Targets Too Small", "medium", "P", "Make tap targets at least 48x48px."),
    (84, "Font Size Too Small", "medium", "P", "Use at least 16px base font size."),
    (85, "Content Wider Than Screen", "high", "P", "Ensure content fits within viewport width."),
    (86, "Intrusive Interstitials", "medium", "P", "Remove intrusive popups on mobile."),
    (87, "Mobile-Only 404s", "high", "C", "Ensure mobile and desktop return same content."),
    (88, "Flash Content", "high", "P", "Replace Flash with HTML5."),
    (89, "Plugins Required", "high", "P", "Remove plugin dependencies."),
    (90, "Touch Elements Too Close", "medium", "P", "Add spacing between touch targets."),
    (91, "4xx Errors", "high", "P", "Fix or redirect 4xx error pages."),
    (92, "5xx Errors", "critical", "P", "Fix server errors immediately."),
    (93, "Redirect Chains", "medium", "P", "Reduce redirect chains to single hops."),
    (94, "Redirect Loops", "high", "P", "Fix redirect loops immediately."),
    (95, "302 Instead of 301", "medium", "P", "Use 301 for permanent redirects."),
    (96, "Missing Custom 404 Page", "low", "S", "Create a helpful custom 404 page."),
    (97, "No Browser Caching", "low", "H", "Enable browser caching with Cache-Control headers."),
    (98, "No CDN Detected", "low", "S", "Consider using a CDN for static assets."),
    (99, "Slow Server Response", "medium", "P", "Optimize server to respond in under 600ms."),
    (100, "IP Canonicalization", "medium", "C", "Ensure IP address redirects to domain."),
]

UNIT = {r[0]: r[3] for r in RULES}
SEVERITY = {r[0]: r[2] for r in RULES}


def category(check_id: int) -> str:
    return CATEGORIES[(check_id - 1) // 10]


def rule_table(spark: SparkSession, only: list[int] | None = None) -> DataFrame:
    """The rules as a (broadcast, at most 100-row) dimension."""
    rows = [
        (i, category(i), name, severity, rec)
        for i, name, severity, _, rec in RULES
        if only is None or i in only
    ]
    return literal_rows(
        spark, rows, "check_id int, category string, check_name string, severity string, recommendation string"
    )
