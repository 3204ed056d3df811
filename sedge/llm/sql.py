"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from .mixing import DOCUMENTS_WEIGHTS

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.vec AS DOUBLE[]), CAST(c.vec AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def _level(name: str) -> str:
    cases = " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in DOCUMENTS_WEIGHTS.get(name, {}).items())
    return f"CASE {cases} ELSE 1 END" if cases else "1"


def _fill(name: str, parent: str, above: str) -> str:
    """CTEs that split the budgets of table `above` over the children `name`."""
    part = f"PARTITION BY {parent}" if parent else ""
    keys = f"{parent}, {name}" if parent else name
    budget = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
    order = f"{part} ORDER BY cap::DOUBLE / w::DOUBLE, {name}"
    return f"""
{name}_n AS (SELECT {keys}, sum(cap)::HUGEINT AS cap, ({_level(name)})::HUGEINT AS w FROM leaf GROUP BY {keys}),
{name}_o AS (
  SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
         sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ahead
  FROM {name}_n {budget}),
{name}_f AS (SELECT *, cap * ahead <= w * (budget - taken) AS filled FROM {name}_o),
{name}_r AS (
  SELECT *, budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER ({part}) AS rest,
         sum(CASE WHEN filled THEN 0 ELSE w END) OVER ({part}) AS open FROM {name}_f),
{name}_b AS (
  SELECT {keys}, (CASE WHEN filled THEN cap ELSE (w::HUGEINT * rest::HUGEINT) // open::HUGEINT END)::HUGEINT AS budget FROM {name}_r)"""


OP6 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS n_tokens,
         regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS number FROM documents),
t AS (SELECT doc_id, CASE WHEN number = '' THEN 'domain-' ELSE 'domain' || (number::INT % 4) END AS domain, lang, source, n_tokens FROM d),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * 4 AS cap FROM t GROUP BY ALL),
root AS (SELECT least(sum(tokens) * 4, sum(tokens) * 8 // 10) AS budget FROM leaf),
{_fill("domain", "", "root")},
{_fill("lang", "domain", "domain_b")},
{_fill("source", "domain, lang", "lang_b")},
share AS (
  SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS epochs,
         CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS remainder FROM leaf JOIN source_b USING (domain, lang, source)),
p AS (SELECT *, md5('17:' || epochs || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM t JOIN share USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p)
SELECT doc_id, domain, lang, source, n_tokens,
       (epochs + CASE WHEN remainder > 0 AND upto <= remainder THEN 1 ELSE 0 END)::BIGINT AS copies FROM c
"""


# verdict, host, path
_PAGE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _rules(host: str, path: str, value) -> str:
    ordered = sorted(_PAGE_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"({host} = '{r[1]}' OR {host} LIKE '%.{r[1]}') AND {path} LIKE '{r[2]}%'"
    return "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered) + " END"


def _after(url: str) -> str:
    """What follows the first ://."""
    return f"CASE WHEN contains({url}, '://') THEN substr({url}, strpos({url}, '://') + 3) ELSE '' END"


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({_after(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({_after(url)}, '^[^/?#]*([^?#]*)', 1), '')"


def _query(url: str) -> str:
    return f"regexp_extract({_after(url)}, '^[^?#]*([?][^#]*)', 1)"


def _key(url: str) -> str:
    return f"CASE WHEN contains({url}, '://') THEN {_host(url)} || CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END || {_query(url)} END"


def _root(url: str) -> str:
    return f"regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1)"


def _dotless(path: str) -> str:
    """`..` takes the segment before it away, `.` nothing; either at the end leaves a slash."""
    parts = f"string_split(substr({path}, 2), '/')"
    step = "CASE WHEN x[1] = '.' THEN k WHEN x[1] = '..' THEN list_slice(k, 1, greatest(len(k) - 1, 0)) ELSE list_concat(k, x) END"
    folded = f"list_reduce(list_prepend([]::VARCHAR[], list_transform({parts}, lambda y: [y])), lambda k, x: {step})"
    return f"'/' || array_to_string(list_concat({folded}, CASE WHEN {parts}[-1] IN ('.', '..') THEN [''] ELSE [] END), '/')"


def _resolve(target: str, base: str) -> str:
    path, rest = f"regexp_extract({target}, '^[^?#]*')", f"regexp_extract({target}, '(?s)^[^?#]*(.*)$', 1)"
    folder = f"CASE WHEN {_path(base)} = '' THEN '/' ELSE regexp_replace({_path(base)}, '[^/]*$', '') END"
    return f"""CASE
    WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {target}
    WHEN {target} LIKE '//%' THEN regexp_extract({base}, '(?s)^(.*?:)//', 1) || {target}
    WHEN {target} LIKE '/%' THEN {_root(base)} || {_dotless(path)} || {rest}
    WHEN {target} LIKE '#%' THEN {_root(base)} || {_path(base)} || {_query(base)}
    WHEN {target} LIKE '?%' THEN {_root(base)} || {_path(base)} || {target}
    ELSE {_root(base)} || {_dotless(f"({folder} || {path})")} || {rest} END"""


def _href(tag: str) -> str:
    value = r"""(?is)\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)"""
    return f"""trim(replace(regexp_replace(regexp_extract({tag}, '{value}', 1), '^["''](.*)["'']$', '\\1', 's'), '&amp;', '&'))"""


OP7 = f"""
WITH RECURSIVE heads AS (
  SELECT url, regexp_replace(regexp_split_to_array(html, '(?i)<body\\b')[1], '(?s)<!--.*?(?:-->|$)', '', 'g') AS head
  FROM pages WHERE contains(url, '://')),
tags AS (
  SELECT url, head, unnest(list_concat(
    list_transform(regexp_extract_all(head, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>'), lambda t: {_href("t")}),
    list_transform(regexp_extract_all(head, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>'),
                   lambda t: trim(replace(regexp_extract(t, '(?is)\\burl\\s*=\\s*["'']?([^"''>\\s]+)', 1), '&amp;', '&'))))) AS target
  FROM heads),
based AS (SELECT url, target, {_href("regexp_extract(head, '(?is)<base" + chr(92) + "b[^>]*>')")} AS given FROM tags WHERE target <> ''),
whole AS (SELECT url, target, CASE WHEN given = '' THEN url ELSE {_resolve("given", "url")} END AS base FROM based),
found AS (SELECT url, {_resolve("target", "base")} AS target FROM whole),
edge AS (SELECT {_key("url")} AS u, {_key("target")} AS v FROM found),
both_ AS (SELECT u, v FROM edge WHERE u <> v UNION SELECT v, u FROM edge WHERE u <> v),
reach AS (SELECT u AS node, u AS seen FROM both_ UNION SELECT r.node, b.v FROM reach r JOIN both_ b ON r.seen = b.u),
judged AS (
  SELECT node, {_rules("regexp_extract(seen, '^([^/]*)', 1)", "regexp_extract(seen, '^[^/]*([^?]*)', 1)", lambda r: r[0])} AS said FROM reach),
class AS (SELECT node, CASE WHEN bool_or(said = 'allow') THEN 'allow' WHEN bool_or(said = 'block') THEN 'block' ELSE 'allow' END AS verdict FROM judged GROUP BY node),
page AS (SELECT page_id, {_host("url")} AS host, {_path("url")} AS path, {_key("url")} AS node FROM pages)
SELECT page_id, host, path, {_rules("host", "path", lambda r: r[1] + r[2])} AS rule,
       coalesce({_rules("host", "path", lambda r: r[0])}, class.verdict, 'allow') AS verdict
FROM page LEFT JOIN class USING (node)
"""

OP8 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT doc_id, text, host, regexp_extract_all(text, '{_WORD}') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS g FROM w, unnest(range(1, len(words) - 6)) AS x(i)),
many AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, p FROM win JOIN many USING (doc_id, g), unnest(range(i, i + 8)) AS x(p)),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
line AS (
  SELECT doc_id, host, trim(regexp_replace(lower(x.l), '[\x20\x09-\x0D]+', ' ', 'g')) AS l, len(regexp_extract_all(x.l, '{_WORD}')) AS n
  FROM w, unnest(lines) AS x(l)),
often AS (SELECT host, l, count(DISTINCT doc_id) AS docs FROM line GROUP BY host, l HAVING count(DISTINCT doc_id) > 20),
hosts AS (SELECT host, count(DISTINCT doc_id) AS all_docs FROM d GROUP BY host),
lost AS (
  SELECT doc_id, sum(n) AS n FROM line JOIN often USING (host, l) JOIN hosts USING (host) WHERE docs * 100 > all_docs * 5 GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS n_frequent_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_frequent_words AS remaining FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words, base_failed,
       NOT base_failed AND (n_frequent_words = 0 OR (remaining >= 20 AND remaining * 100 >= n_words * 30)) AS kept FROM b
"""

SQL = {
    "op1_branch_and_bound_top_k": OP1,
    "op6_hierarchical_mix": OP6,
    "op7_redirect_url_filter": OP7,
    "op8_line_frequency_rules": OP8,
}
