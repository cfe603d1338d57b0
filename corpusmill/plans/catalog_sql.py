"""The registered core queries in DuckDB SQL. Queries that need an HTML parser, YAML or the whole cleaner have none."""

from __future__ import annotations

W = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NW = "[^" + W[1:]
E = r"[^\n\r\x{2028}\x{2029}]"
URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{W}+', ' ', 'g'))"


def n_words(x: str) -> str:
    """Words of a text: runs of non-blanks."""
    return f"len(regexp_extract_all({x}, '{NW}+'))"


def n_tokens(x: str) -> str:
    return f"ceil(length({trim(x)}) / 4.0)::BIGINT"


def plain(x: str) -> str:
    x = f"regexp_replace({x}, '(?ms)^---.*?---', '')"
    x = f"regexp_replace({x}, '(?m)^#+ {E}+', '', 'g')"
    x = rf"regexp_replace({x}, '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
    x = rf"regexp_replace({x}, '\*\*([^*]+)\*\*', '\1', 'g')"
    return flat(f"translate({x}, '*_`>#-', '      ')")


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, '{URL}', {group})"


def is_absolute(url: str) -> str:
    return f"regexp_matches({url}, '^(?i:https?)://[^/?#]+')"


def canonical(url: str) -> str:
    """Without its fragment."""
    u = trim(url)
    return f"CASE WHEN {is_absolute(u)} THEN lower({part(u, 1)}) || '://' || lower({part(u, 2)}) || CASE WHEN {part(u, 3)} = '' THEN '/' ELSE {part(u, 3)} END || {part(u, 4)} END"


def discovered(url: str) -> str:
    return f"regexp_replace({canonical(url)}, '/$', '')"


def persisted(url: str) -> str:
    c = canonical(url)
    return f"coalesce(CASE WHEN {part(f'({c})', 3)} = '/' THEN {c} ELSE regexp_replace({c}, '/$', '') END, {url})"


def host(url: str) -> str:
    u = trim(url)
    return rf"CASE WHEN {is_absolute(u)} THEN regexp_replace(lower({part(u, 2)}), ':\d*$', '') END"


def domain(url: str) -> str:
    return f"replace({host(url)}, '.', '-')"


def pathname(url: str) -> str:
    u = trim(url)
    return f"CASE WHEN {is_absolute(u)} THEN CASE WHEN {part(u, 3)} = '' THEN '/' ELSE {part(u, 3)} END END"


def slug(url: str) -> str:
    inner = f"regexp_replace({pathname(url)}, '^/|/$', '', 'g')"
    return f"coalesce(nullif(CASE WHEN {inner} = '' THEN 'index' ELSE substr(regexp_replace(replace({inner}, '/', '-'), '[^a-zA-Z0-9_-]', '', 'g'), 1, 120) END, ''), 'page')"


def tags(url: str) -> str:
    stop = "'en','www','index','html','php','cfm','asp','aspx','page','home'"
    return f"""list_filter(list_transform(string_split({pathname(url)}, '/'), lambda s: lower({trim("regexp_replace(s, '\\.[A-Za-z0-9]+$', '')")})), lambda s: length(s) > 1 AND s NOT IN ({stop}))"""


PAGES = "pages AS (SELECT page_id, url, coalesce(title, '') AS title, markdown, coalesce(completeness_report.fetch_method, 'static') AS fetch_method FROM discovered_pages WHERE markdown IS NOT NULL)"
LINES = f"""{PAGES}, lines AS (SELECT page_id, i, line, {trim('line')} AS t FROM (SELECT page_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM pages))"""

_QUALITY = rf"""{LINES},
 shorts AS (SELECT page_id, count(*) AS n, count(*) FILTER ({n_words('t')} < 5) AS k FROM lines WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, '```') AND NOT starts_with(t, '|') GROUP BY page_id),
 doubles AS (SELECT page_id, count(*) AS n, count(DISTINCT t) AS k FROM lines WHERE length(t) > 10 GROUP BY page_id),
 links AS (SELECT page_id, sum({n_words('label')}) AS n FROM (SELECT page_id, unnest(regexp_extract_all(markdown, '\[([^\]]+)\]\([^)]*\)', 1)) AS label FROM pages) GROUP BY page_id),
 base AS (SELECT p.*, {n_words('markdown')} AS words, len(regexp_extract_all(markdown, '(?m)^#{{1,6}}{W}+')) AS headings,
   CASE WHEN {n_words('markdown')} = 0 THEN 0.0 ELSE coalesce(l.n, 0)::DOUBLE / {n_words('markdown')} END AS density,
   CASE WHEN coalesce(s.n, 0) < 5 THEN 0.0 ELSE s.k::DOUBLE / s.n END AS short_ratio, CASE WHEN coalesce(d.n, 0) < 5 THEN 0.0 ELSE 1 - d.k::DOUBLE / d.n END AS duplicate_ratio,
   (regexp_matches(markdown, '(?m)^[-*+]{W}+') OR regexp_matches(markdown, '(?m)^\d+\.{W}+'))::BIGINT AS listed, regexp_matches(markdown, '\|{E}+\|')::BIGINT AS rowed, contains(lower(title), '[error') AS bad
   FROM pages p LEFT JOIN shorts s USING (page_id) LEFT JOIN doubles d USING (page_id) LEFT JOIN links l USING (page_id)),
 rich AS (SELECT *, (headings > 0)::BIGINT + (headings >= 3)::BIGINT + listed + rowed AS richness,
   list_filter([CASE WHEN fetch_method = 'static' THEN 'Static HTTP fetch — JavaScript-rendered content may be missing.' END,
     CASE WHEN words = 0 THEN 'No content extracted — page may have failed to render.' WHEN words < 50 THEN 'Very short content (' || words || ' words) — page may be incomplete or blocked.' WHEN words < 200 THEN 'Short content (' || words || ' words) — verify against the live page.' END,
     CASE WHEN bad THEN 'Page title suggests a rendering error — content may be incomplete.' END,
     CASE WHEN density > 0.6 THEN 'Very high link density (' || floor(density * 100 + 0.5)::BIGINT || '% link text) — page is likely a navigation index, not content.' WHEN density > 0.4 THEN 'High link density (' || floor(density * 100 + 0.5)::BIGINT || '% link text) — page may be navigation-heavy.' END,
     CASE WHEN short_ratio > 0.7 THEN 'Very high short-line ratio (' || floor(short_ratio * 100 + 0.5)::BIGINT || '%) — content may be a link dump or menu rather than prose.' WHEN short_ratio > 0.5 THEN 'High short-line ratio (' || floor(short_ratio * 100 + 0.5)::BIGINT || '%) — content may be list-heavy with little prose.' END,
     CASE WHEN duplicate_ratio > 0.3 THEN 'Duplicate line ratio ' || floor(duplicate_ratio * 100 + 0.5)::BIGINT || '% — repeated boilerplate blocks detected.' END], lambda x: x IS NOT NULL) AS warnings FROM base),
 scored AS (SELECT *, greatest(0, least(100, 100 - CASE WHEN words = 0 THEN 60 WHEN words >= 500 THEN 0 ELSE floor(40 * (1 - sqrt(words / 500.0)) + 0.5) END
   - CASE WHEN density > 0.6 THEN 30 WHEN density > 0.4 THEN 15 ELSE 0 END - CASE WHEN short_ratio > 0.7 THEN 15 WHEN short_ratio > 0.5 THEN 8 ELSE 0 END - CASE WHEN duplicate_ratio > 0.3 THEN 10 ELSE 0 END
   + CASE WHEN words <= 200 THEN 0 WHEN richness = 0 THEN -15 WHEN richness = 1 THEN -5 WHEN richness >= 3 THEN 5 ELSE 0 END - CASE WHEN bad THEN 20 ELSE 0 END - 5 * greatest(len(warnings) - 1, 0)))::BIGINT AS score FROM rich),
 q AS (SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM scored)"""


def hashed(x: str, ctes: str = PAGES) -> str:
    return f"WITH {ctes} SELECT page_id, length(x)::BIGINT AS chars, sha256(x) AS hash FROM (SELECT page_id, {x} AS x FROM pages)"


UI = r"open chat|resources|filters?|naming conventions|panel[\s]+\d+|grp-type-\d+|slick-slide\d+"
NOISE = (
    r"previous|next|resources|video|×clear all|clear all|clear filters?|reset filters?|show models?|show model|shop models?|watch the video|watch now|100%|finalizing…|finalizing\.\.\.|compare\s+\d+\s*/\s*\d+"
    r"|open chat|learn more|get pricing|contact us|apply|cancel|close|you can[''’]?t perform that action at this time|card view|list view|card view\s*list view|cancel\s*apply|loading products(?:…|\.\.\.)?|filters?"
    r"|filter by|view as|keyword|showing \d+(?:\s*-\s*\d+)?\s+results|sort by|panel\s+\d+|grp-type-\d+|slick-slide\d+|starting at\s*\$\s*[\d,.]+"
    r"|white paper|success story|product brief|solution brief|datasheet|brochure|product review"
)
BURSTS = r"card view\s*list view|cancel\s*apply|loading products(?:…|\.\.\.)?|panel\s+\d+|grp-type-\d+|slick-slide\d+|starting at\s*\$\s*[\d,.]+|filters?|filter by|sort by|view as"
TAGS = "div|span|p|br|a|strong|em|ul|ol|li|table|tr|td|th|section|article|header|footer|nav"
CTA = "Show Models?|Show Model|Shop Models?|Watch the|Learn more|Get pricing|Contact us|Apply|Cancel|Close"


def artifacts(x: str) -> str:
    x = rf"regexp_replace({x}, '(?m)^\\?\]\([^)\n]+\){W}*$', '', 'g')"
    x = rf"regexp_replace({x}, '(?im)!\[[^\]]*\]\([^)]*\)|\\?\*\[Image:[^\]]*\]\*|^\*\[Image:[^\]]*\]\*{W}*$', '', 'g')"
    x = rf"regexp_replace({x}, '(?m)^\*\\?\[Image:[^\]]*\]\*{W}*$', '', 'g')"
    x = rf"regexp_replace({x}, '(?i)\[([^\]]+)\]\(javascript:[^)]+\)', '\1', 'g')"
    x = rf"regexp_replace({x}, '(?i)\[([^\]]+)\]\(#(?:models|[\w-]+)?\)', '\1', 'g')"
    x = rf"regexp_replace({x}, '(?im)^\[(?:{CTA})[^\]]*\]\([^)]+\){W}*$', '', 'g')"
    return rf"regexp_replace(replace({x}, '\_', '_'), '\\([\[\]()])', '\1', 'g')"


def encoding(x: str) -> str:
    return rf"replace(regexp_replace(translate({x}, chr(160) || '‘’“”–—', ' ' || chr(39) || chr(39) || chr(34) || chr(34) || '--'), '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g'), chr(13) || chr(10), chr(10))"


def whitespace(x: str) -> str:
    return trim(rf"regexp_replace(replace({x}, chr(13) || chr(10), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g')")


def title_of(x: str) -> str:
    cut = rf"regexp_replace({flat(x)}, '{W}*\|{W}*{E}+$', '')"
    cut = f"regexp_replace({cut}, '{W}+[–—]{W}*{E}+$', '')"
    cut = f"regexp_replace({cut}, '{W}+-{W}+{E}+$', '')"
    return f"coalesce(nullif({trim(cut)}, ''), {flat(x)})"


_UI_LINE = rf"regexp_matches({trim('regexp_extract(line, ' + chr(39) + '^#{1,6}' + W + '+(' + E + '+)$' + chr(39) + ', 1)')}, '^(?i:{UI})$')"
_TITLE_LINE = trim(f"regexp_extract(markdown, '(?m)^# ({E}+)', 1)")
_NOISE = rf"""(t <> '' AND (length(t) <= 2 OR regexp_matches(t, '(?i)^\*\\?\[image:|javascript:|^\\?\]\(') OR regexp_matches(t, '^(?i:{NOISE})$')
   OR (len(regexp_extract_all(t, '[^(\n]+\(\d+\)')) >= 2 AND {trim("regexp_replace(t, '[^(\\n]+\\(\\d+\\)', '', 'g')")} = '') OR regexp_matches(t, '^\*{W}+\d+$')
   OR regexp_matches(t, '^\\?(?:\[|\]|\)|\({W}*$|[\\*]{{1,3}}{W}*$)') OR (head <> '' AND lower(t) = lower(head))))"""

_DESCRIPTION = f"""firsts AS (SELECT page_id, arg_min(t, i) AS first FROM lines WHERE length(t) > 40 AND NOT starts_with(t, '#') AND NOT starts_with(t, '*') GROUP BY page_id),
 described AS (SELECT p.page_id, {title_of('p.title')} AS title, p.markdown,
   coalesce(substr(regexp_replace(f.first, '{W}+', ' ', 'g'), 1, 320), nullif({trim(f"regexp_extract(p.markdown, '(?m)^#{{1,3}}{W}+({E}+)', 1)")}, ''), 'Scraped page content.') AS description FROM pages p LEFT JOIN firsts f USING (page_id)),
 heads AS (SELECT page_id, i, {trim(f"regexp_replace(line, '^#+{W}+', '')")} AS h FROM lines WHERE regexp_matches(line, '^#{{1,3}}{W}+')),
 good AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM heads WHERE NOT regexp_matches({trim('h')}, '^(?i:{UI})$')),
 joined AS (SELECT page_id, string_agg(h, ' | ' ORDER BY i) FILTER (h <> '') AS hs FROM good WHERE k <= 12 GROUP BY page_id)"""

_SECTIONS = rf"""{LINES},
 kinds AS (SELECT page_id, i, line, regexp_matches(line, '^#{{1,3}}{W}+{E}+$') AS head, {trim(f"regexp_extract(line, '^#{{1,3}}{W}+({E}+)$', 1)")} AS h, length(regexp_extract(line, '^(#{{1,3}}){W}+{E}+$', 1)) AS level FROM lines),
 marked AS (SELECT *, CASE WHEN head THEN CASE WHEN regexp_matches(h, '^(?i:{UI})$') THEN 'ui' ELSE 'h' END ELSE 'c' END AS kind FROM kinds),
 placed AS (SELECT *, last_value(CASE WHEN kind <> 'c' THEN i END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS cur, last_value(CASE WHEN kind <> 'c' THEN kind END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS curk,
   first_value(CASE WHEN kind = 'h' THEN i END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt FROM marked),
 texts AS (SELECT page_id, CASE WHEN curk = 'h' THEN cur ELSE nxt END AS sec, {plain("string_agg(line, chr(10) ORDER BY i)")} AS x FROM placed WHERE kind = 'c' GROUP BY page_id, sec),
 sections AS (SELECT t.page_id, m.i, m.h AS heading, m.level::BIGINT AS level, {n_words('t.x')}::BIGINT AS word_count, {n_tokens('t.x')} AS token_estimate FROM texts t JOIN marked m ON m.page_id = t.page_id AND m.i = t.sec WHERE {n_words('t.x')} >= 5)"""

_MANIFEST = f"""manifest AS (SELECT * EXCLUDE (ms, mu, norm) FROM (SELECT *, max(seq) OVER (PARTITION BY domain, slug) AS ms, max(seq) OVER (PARTITION BY domain, norm) AS mu FROM (SELECT *, {persisted('url')} AS norm FROM manifest_entries)) WHERE seq = ms AND seq = mu)"""
_SAVED = f"""{_MANIFEST}, saved AS (SELECT seq, domain, {persisted('url')} AS norm, slug, title FROM manifest)"""
_GRAPH = rf"""e AS (SELECT domain, src, trim(href) AS h FROM link_edges WHERE src IS NOT NULL AND href IS NOT NULL AND NOT regexp_matches(trim(href), '^(#|(?i:mailto:|javascript:|tel:))') AND trim(href) <> ''),
 o AS (SELECT domain, h, {canonical('src')} AS c, {discovered('src')} AS source FROM e),
 a AS (SELECT domain, source, regexp_extract(c, '^([a-z][a-z0-9+.\-]*://[^/?#]*)', 1) AS origin, h FROM o),
 t AS (SELECT domain, source, origin, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN h WHEN starts_with(h, '//') THEN regexp_extract(origin, '^[a-z]+:') || h WHEN starts_with(h, '/') THEN origin || h ELSE origin || '/' || regexp_replace(h, '^(\./)+', '') END AS abs FROM a),
 graph AS (SELECT DISTINCT domain, source, target FROM (SELECT domain, source, origin, {discovered('abs')} AS target FROM t) WHERE target IS NOT NULL AND starts_with(target, origin))"""
_EXCLUDES = ("/tag/", "/author/", "/wp-json/", "/feed/", "?replytocom=", "/login", "/cart", "/mysupermicro", "/search?")


def kept(x: str) -> str:
    return "NOT (" + " OR ".join(f"contains({x}, '{p}')" for p in _EXCLUDES) + ")"


_TAGS = "(SELECT coalesce(string_agg(s, ',' ORDER BY i), '') FROM (SELECT s, min(i) AS i FROM (SELECT unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT {tags} AS l)) GROUP BY s ORDER BY i LIMIT 8))"


def decoded(x: str) -> str:
    """Text of HTML with its named and numbered characters."""
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&#x27;", "chr(39)"), ("&nbsp;", "chr(160)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    return x


def tag_text(tag: str) -> str:
    """Text of the first element of a kind; null where it says nothing."""
    inner = rf"regexp_extract(html, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1)"
    return f"nullif({trim(decoded(f"regexp_replace({inner}, '<[^>]*>', '', 'g')"))}, '')"


def meta(name: str) -> str:
    """Content of a meta element; null where it says nothing."""
    content = f"""regexp_extract(html, '(?i)<meta[^>]* (?:name|property)="{name}"[^>]* content="([^"]*)"', 1)"""
    return f"nullif({trim(decoded(content))}, '')"


_CHOSEN = f"""newest AS (SELECT arg_max(struct_pack(page_id := page_id, fetch_id := fetch_id, fetched_at := fetched_at, url := coalesce(nullif(final_url, ''), url)), struct_pack(a := fetched_at, b := fetch_id)) AS x FROM fetched_pages WHERE html <> '' OR markdown <> '' GROUP BY page_id),
 keyed AS (SELECT x.page_id, x.fetch_id, x.fetched_at, x.url, {domain('x.url')} AS domain, {slug('x.url')} AS slug, {persisted('x.url')} AS norm FROM newest),
 chosen AS (SELECT * FROM (SELECT *, max(fetch_id) OVER (PARTITION BY domain, slug) AS ms, max(fetch_id) OVER (PARTITION BY domain, norm) AS mu FROM keyed) WHERE fetch_id = ms AND fetch_id = mu)"""

ORACLE = {
    "corpus_documents": f"WITH {_CHOSEN} SELECT page_id, fetch_id, domain, slug, url, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS crawled_at, {_TAGS.format(tags=tags('url'))} AS tags FROM chosen",
    "corpus_manifest": f"WITH {_CHOSEN} SELECT fetch_id AS seq, domain, slug, url, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS scraped_at, {_TAGS.format(tags=tags('url'))} AS tags, 'active' AS status, 'web-page' AS document_type, true AS hashed, true AS estimated FROM chosen",
    "save_counts": f"""SELECT {host('url')} AS host, count(*) FILTER (status = 'done' AND markdown <> '' AND slug <> '') AS n_saved, count(*) FILTER (status = 'error') AS n_failed, count(*) FILTER (status = 'done' AND markdown <> '' AND slug <> '') > 0 AS any_saved,
 count(*) FILTER (selected AND status IS DISTINCT FROM 'done') = 0 AS all_done FROM discovered_pages GROUP BY 1""",
    "stored_session": "SELECT page_id, id, url, title, selected, status, error, slug FROM discovered_pages",
    "persisted_reports": f"""SELECT page_id, CASE WHEN completeness_report.fetch_method = 'firecrawl' THEN 'firecrawl' ELSE 'static' END AS fetch_method, length(markdown)::BIGINT AS chars, {n_words('markdown')}::BIGINT AS words, len(regexp_extract_all(markdown, '(?m)^#{{1,6}}{W}+'))::BIGINT AS headings,
 completeness_report.completeness_score::BIGINT AS score, coalesce(completeness_report.grade, 'fair') AS grade FROM discovered_pages WHERE markdown IS NOT NULL AND completeness_report.completeness_score IS NOT NULL""",
    "page_titles": f"SELECT fetch_id, coalesce(nullif(extracted_title, ''), {tag_text('title')}, {meta('og:title')}, {tag_text('h1')}, final_url) AS title FROM fetched_pages",
    "page_heads": f"""SELECT fetch_id, CASE WHEN length(d) > 20 THEN substr(regexp_replace(d, '{W}+', ' ', 'g'), 1, 320) END AS description, NULL::VARCHAR AS last_updated
 FROM (SELECT fetch_id, coalesce({meta('description')}, {meta('og:description')}, {meta('twitter:description')}) AS d FROM fetched_pages)""",
    "page_links": rf"""SELECT fetch_id, (generate_subscripts(l, 1) - 1)::BIGINT AS ord, unnest(l) AS href FROM (SELECT fetch_id,
  list_filter(list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1), lambda x: {decoded('x')}), lambda x: NOT regexp_matches(x, '^(#|(?i:mailto:))')) AS l FROM fetched_pages)""",
    "page_documents": f"""WITH {PAGES}, made AS (SELECT p.page_id, p.url, {title_of('p.title')} AS title, d.discovered_at AS seen, {plain('p.markdown')} AS x FROM pages p JOIN discovered_pages d USING (page_id) WHERE p.url IS NOT NULL)
 SELECT page_id, url, title, strftime(seen, '%Y-%m-%dT%H:%M:%SZ') AS scraped_at, {n_words('x')}::BIGINT AS content_words, sha256(x) AS content_hash, {n_tokens('x')} AS token_estimate, 'active' AS status, 'web-page' AS document_type FROM made""",
    "quality_report": f"WITH {_QUALITY} SELECT page_id, length(markdown)::BIGINT AS chars, words::BIGINT AS words, headings::BIGINT AS headings, floor(density * 1000000 + 0.5)::BIGINT AS density, floor(short_ratio * 1000000 + 0.5)::BIGINT AS short_ratio, floor(duplicate_ratio * 1000000 + 0.5)::BIGINT AS duplicate_ratio, richness::BIGINT AS richness, array_to_string(warnings, ' | ') AS warnings, score, grade FROM q",
    "quality_by_grade": f"WITH {_QUALITY} SELECT grade, CASE grade WHEN 'excellent' THEN 'default' WHEN 'good' THEN 'secondary' WHEN 'fair' THEN 'outline' ELSE 'destructive' END AS badge, count(*) AS n_pages, floor(avg(score) + 0.5)::BIGINT AS avg_score FROM q GROUP BY grade",
    "warning_counts": f"WITH {_QUALITY} SELECT regexp_replace(w, '[0-9]+', 'N', 'g') AS warning, count(*) AS n_pages FROM (SELECT unnest(warnings) AS w FROM q) GROUP BY 1",
    "quality_gate": f"WITH {_QUALITY} SELECT {host('url')} AS host, count(*) FILTER (score >= 50) AS n_kept, count(*) FILTER (score < 50) AS n_left_out FROM q GROUP BY 1",
    "stale_reports": f"""SELECT * FROM (SELECT page_id, completeness_report.content_word_count::BIGINT AS stored_words, {n_words('markdown')}::BIGINT AS words, completeness_report.heading_count::BIGINT AS stored_headings, len(regexp_extract_all(markdown, '(?m)^#{{1,6}}{W}+'))::BIGINT AS headings
 FROM discovered_pages WHERE markdown IS NOT NULL AND completeness_report IS NOT NULL) WHERE stored_words IS DISTINCT FROM words OR stored_headings IS DISTINCT FROM headings""",
    "plain_text_stats": f"WITH {PAGES} SELECT page_id, length(x)::BIGINT AS chars, {n_words('x')}::BIGINT AS word_count, {n_tokens('x')} AS token_estimate, sha256(x) AS content_hash FROM (SELECT page_id, {plain('markdown')} AS x FROM pages)",
    "content_hash_dedupe": f"WITH {PAGES} SELECT sha256(x) AS content_hash, min(page_id) AS page_id, count(*) AS n_pages FROM (SELECT page_id, {plain('markdown')} AS x FROM pages) GROUP BY 1",
    "clean_titles": f"SELECT page_id, {title_of('title')} AS title FROM discovered_pages WHERE title IS NOT NULL",
    "normalized_text": hashed(whitespace(encoding("markdown"))),
    "residual_html": hashed(f"regexp_replace(regexp_replace(markdown, '(?i)</?(?:{TAGS})[^>]*>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"),
    "markdown_artifacts": hashed(artifacts("markdown")),
    "noise_lines": f"WITH {LINES}, titled AS (SELECT page_id, {_TITLE_LINE} AS head FROM pages) SELECT page_id, length(x)::BIGINT AS chars, sha256(x) AS hash FROM (SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT {_NOISE}), '') AS x FROM lines JOIN titled USING (page_id) GROUP BY page_id)",
    "ui_headings": rf"""WITH {LINES}, one AS (SELECT page_id, i, line FROM lines WHERE NOT {_UI_LINE} AND NOT regexp_matches(t, '^(?i:{BURSTS})$')),
 two AS (SELECT page_id, string_agg(line, chr(10) ORDER BY i) AS x FROM one GROUP BY page_id),
 three AS (SELECT p.page_id, regexp_replace(regexp_replace(regexp_replace(coalesce(t.x, ''), '(?i)\n## Open chat\b[^\n]*', '', 'g'), '(?i)\n## Filters?\b[^\n]*', '', 'g'), '(?i)\n## Naming Conventions\b[^\n]*', '', 'g') AS x FROM pages p LEFT JOIN two t USING (page_id)),
 four AS (SELECT page_id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1) AS i FROM three),
 five AS (SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT regexp_matches(line, '(?i)^#{{1,3}}{W}+(?:open chat|filters?|naming conventions)\b')), '') AS x FROM four GROUP BY page_id)
 SELECT page_id, length(x)::BIGINT AS chars, sha256(x) AS hash FROM five""",
    "flat_subheadings": hashed(rf"regexp_replace(markdown, '(?m)^#{{4,6}}{W}+({E}+)', '\1', 'g')"),
    "section_dedupe": f"""WITH {PAGES}, marked AS (SELECT page_id, string_split(regexp_replace(markdown, '(?m)^## ', chr(1) || '## ', 'g'), chr(1)) AS parts FROM pages),
 cut AS (SELECT page_id, {trim('unnest(parts)')} AS p, generate_subscripts(parts, 1) AS i FROM marked), keyed AS (SELECT *, nullif(lower({trim(f"regexp_extract(p, '^## ({E}+)', 1)")}), '') AS k FROM cut WHERE p <> ''),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY i) AS n FROM keyed),
 kept AS (SELECT page_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS x FROM ranked WHERE k IS NULL OR n = 1 GROUP BY page_id)
 SELECT p.page_id, length(coalesce(x, ''))::BIGINT AS chars, sha256(coalesce(x, '')) AS hash FROM pages p LEFT JOIN kept USING (page_id)""",
    "paragraph_dedupe": rf"""WITH {PAGES}, cut AS (SELECT page_id, unnest(regexp_split_to_array(markdown, '\n{{2,}}')) AS p, generate_subscripts(regexp_split_to_array(markdown, '\n{{2,}}'), 1) AS i FROM pages),
 keyed AS (SELECT *, lower({flat('p')}) AS k FROM cut), ranked AS (SELECT *, row_number() OVER (PARTITION BY page_id, k ORDER BY i) AS n FROM keyed),
 kept AS (SELECT page_id, string_agg(p, chr(10) || chr(10) ORDER BY i) AS x FROM ranked WHERE length(k) < 40 OR n = 1 GROUP BY page_id)
 SELECT page_id, length(x)::BIGINT AS chars, sha256(x) AS hash FROM kept""",
    "chunk_sections": f"WITH {_SECTIONS} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS section_no, heading, level, word_count, token_estimate FROM sections",
    "stale_sections": f"""WITH {_SECTIONS}, now AS (SELECT p.page_id, count(s.i) AS n_sections FROM pages p LEFT JOIN sections s USING (page_id) GROUP BY p.page_id),
 stored AS (SELECT page_id, max(coalesce(len(chunk_sections), -1)) AS n_stored FROM page_metadata GROUP BY page_id) SELECT page_id, n_sections, n_stored FROM now JOIN stored USING (page_id) WHERE n_sections <> n_stored""",
    "embed_texts": f"""WITH {LINES}, {_DESCRIPTION} SELECT d.page_id, d.description, substr(concat_ws(' | ', nullif(d.title, ''), nullif(d.description, ''), j.hs), 1, 1500) AS embed_text FROM described d LEFT JOIN joined j USING (page_id)""",
    "url_forms": f"SELECT page_id, {discovered('url')} AS discovered, {persisted('url')} AS persisted, {host('url')} AS host, {domain('url')} AS domain, replace(regexp_replace({domain('url')}, '^www-', ''), '-', '.') AS index_domain, {slug('url')} AS slug, (SELECT coalesce(string_agg(s, ',' ORDER BY i), '') FROM (SELECT s, min(i) AS i FROM (SELECT unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT {tags('url')} AS l)) GROUP BY s ORDER BY i LIMIT 8)) AS tags FROM discovered_pages",
    "url_filter": f"SELECT domain, count(*) FILTER ({kept('href')}) AS n_kept, count(*) FILTER (NOT {kept('href')}) AS n_left_out FROM link_edges WHERE href IS NOT NULL GROUP BY domain",
    "discovered_once": f"SELECT {host('url')} AS host, {discovered('url')} AS url, min(page_id) AS first_seen FROM discovered_pages WHERE {discovered('url')} IS NOT NULL GROUP BY 1, 2",
    "slug_collisions": f"SELECT domain, slug, count(*) AS n_urls FROM (SELECT DISTINCT {domain('url')} AS domain, {slug('url')} AS slug, {persisted('url')} AS norm FROM discovered_pages) GROUP BY domain, slug HAVING count(*) > 1",
    "manifest_upsert": f"WITH {_MANIFEST} SELECT seq, domain, slug, url, title, coalesce(word_count::BIGINT, -1) AS word_count, coalesce(token_estimate::BIGINT, -1) AS token_estimate FROM manifest",
    "corpus_totals": f"WITH {_MANIFEST} SELECT domain, count(*) AS page_count, coalesce(sum(word_count), 0)::BIGINT AS total_word_count, coalesce(sum(token_estimate), 0)::BIGINT AS total_token_estimate FROM manifest GROUP BY domain",
    "index_lines": f"""WITH {_MANIFEST}, numbered AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seq) AS k FROM manifest)
 SELECT domain, k AS line_no, k || '. ' || coalesce(nullif(title, ''), slug, '') || ' — ' || coalesce(url, '') || CASE WHEN token_estimate IS NULL THEN '' ELSE ' (~' || format('{{:,}}', token_estimate) || ' tokens)' END AS line FROM numbered""",
    "manifest_fresh": f"""WITH {_MANIFEST}, newest AS (SELECT strftime(CAST(substr(max(scraped_at), 1, 10) AS DATE) - INTERVAL 12 MONTH, '%Y-%m-%d') AS day FROM manifest)
 SELECT tag, count(*) AS n_entries, count(DISTINCT domain) AS n_domains FROM (SELECT unnest(tags) AS tag, domain FROM manifest WHERE substr(scraped_at, 1, 10) > (SELECT day FROM newest)) GROUP BY tag""",
    "unchanged_entries": "SELECT domain, sum(n - 1)::BIGINT AS n_unchanged FROM (SELECT domain, slug, content_hash, count(*) AS n FROM manifest_entries WHERE content_hash IS NOT NULL GROUP BY ALL) GROUP BY domain",
    "resume_join": f"""WITH {_SAVED}, by_url AS (SELECT domain, norm, max(seq) AS seq FROM saved WHERE norm IS NOT NULL GROUP BY ALL), by_slug AS (SELECT domain, slug, max(seq) AS seq FROM saved WHERE slug IS NOT NULL GROUP BY ALL),
 keyed AS (SELECT page_id, url, CASE WHEN status = 'scraping' THEN 'pending' ELSE status END AS status, selected, {domain('url')} AS d, {persisted('url')} AS k, {slug('url')} AS ks FROM discovered_pages)
 SELECT d.page_id, d.url, CASE WHEN u.seq IS NOT NULL THEN 'url' WHEN s.seq IS NOT NULL THEN 'slug' END AS matched_by, CASE WHEN coalesce(u.seq, s.seq) IS NOT NULL THEN 'done' ELSE d.status END AS status,
  CASE WHEN coalesce(u.seq, s.seq) IS NOT NULL THEN false ELSE d.selected END AS selected, m.slug AS saved_slug, m.title AS saved_title
 FROM keyed d LEFT JOIN by_url u ON d.d = u.domain AND d.k = u.norm LEFT JOIN by_slug s ON d.d = s.domain AND d.ks = s.slug LEFT JOIN saved m ON m.seq = coalesce(u.seq, s.seq)""",
    "preview_lookup": f"""WITH {_SAVED}, by_url AS (SELECT domain, norm, min(seq) AS seq FROM saved WHERE norm IS NOT NULL GROUP BY ALL), by_slug AS (SELECT domain, slug, min(seq) AS seq FROM saved WHERE slug IS NOT NULL GROUP BY ALL),
 keyed AS (SELECT page_id, {domain('url')} AS d, {persisted('url')} AS k, slug FROM discovered_pages)
 SELECT d.page_id, m.slug AS saved_slug, m.title AS saved_title FROM keyed d LEFT JOIN by_url u ON d.d = u.domain AND d.k = u.norm LEFT JOIN by_slug s ON d.d = s.domain AND d.slug = s.slug LEFT JOIN saved m ON m.seq = coalesce(u.seq, s.seq)""",
    "patched_session": "WITH p AS (SELECT page_id, arg_max({'u': final_url, 't': extracted_title}, fetch_id) AS x FROM fetched_pages WHERE page_id IS NOT NULL GROUP BY page_id) SELECT d.page_id, coalesce(p.x.u, d.url) AS url, coalesce(p.x.t, d.title) AS title, d.status FROM discovered_pages d LEFT JOIN p USING (page_id)",
    "session_progress": f"""WITH c AS (SELECT {host('url')} AS host, count(*) AS n_pages, count(*) FILTER (selected) AS n_selected, count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'error') AS n_error, count(*) FILTER (status IS DISTINCT FROM 'done') AS n_remaining FROM discovered_pages GROUP BY 1)
 SELECT *, floor((n_done + n_error)::DOUBLE / CASE WHEN n_selected > 0 THEN n_selected ELSE n_pages END * 100 + 0.5)::BIGINT AS progress FROM c""",
    "scrape_summary": f"""SELECT {host('url')} AS host, floor(avg(completeness_report.completeness_score) + 0.5)::BIGINT AS avg_score, count(*) FILTER (completeness_report.completeness_score < 50) AS n_low, count(*) FILTER (completeness_report.fetch_method = 'firecrawl') AS n_rendered, count(*) AS n_scored
 FROM discovered_pages WHERE status = 'done' AND completeness_report.completeness_score IS NOT NULL GROUP BY 1""",
    "completed_pages": f"SELECT {host('url')} AS host, count(*) FILTER (status = 'done' AND markdown <> '' AND slug <> '') AS n_complete, count(*) FILTER (selected AND status IS DISTINCT FROM 'done') AS n_waiting FROM discovered_pages GROUP BY 1",
    "scrape_history": "SELECT domain, strftime(written_at, '%Y-%m-%d') AS day, count(*) AS n_pages, max(seq) AS last_seq FROM manifest_entries WHERE written_at IS NOT NULL GROUP BY 1, 2 ORDER BY day DESC, last_seq DESC LIMIT 50",
    "session_rows": f"""SELECT replace(to_base64(encode(replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*'))), '=', '') AS id, url, coalesce({pathname('url')}, url) AS title, true AS selected, 'pending' AS status FROM (SELECT DISTINCT {discovered('url')} AS url FROM discovered_pages WHERE {discovered('url')} IS NOT NULL)""",
    "page_keys": "SELECT page_id, replace(to_base64(encode(replace(replace(replace(replace(replace(url_encode(url), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*'))), '=', '') AS id FROM discovered_pages",
    "link_graph": f"WITH {_GRAPH} SELECT domain, source, target FROM graph",
    "crawl_bfs": f"""WITH RECURSIVE {_GRAPH}, seeds AS (SELECT domain, min(source) AS url FROM graph GROUP BY domain), edges AS (SELECT * FROM graph WHERE source <> target AND {kept('target')}),
 walk AS (SELECT domain, url, 0 AS depth FROM seeds UNION SELECT w.domain, e.target, w.depth + 1 FROM walk w JOIN edges e ON e.domain = w.domain AND e.source = w.url WHERE w.depth < 3) SELECT domain, url, min(depth)::BIGINT AS depth FROM walk GROUP BY domain, url""",
}
