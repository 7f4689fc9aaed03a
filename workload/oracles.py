"""The same queries as plain SQL over the given tables, for checking.

Written apart from the engine: the number rules are one CASE of structs, the
duplicate fold uses ordered aggregates, families are numbered by row_number().
"""

from __future__ import annotations

from masterloom.functions import fixed_values as fv

from masterloom.operators.similar_titles import PERCENT
from masterloom.sources.schemas import BULK_HEADERS

from .frames import BULK_SQL, CURATED_SQL
from .queries import AS_OF, DEEP_PAGE, FRESH_AS_OF, LONG_QUERY, LOOKUP_NUMBER, OVERRIDE_STEP, SEARCH_QUERY


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _sql(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _clean(column: str) -> str:
    return f"CASE WHEN lower(trim({column})) IN ({_quoted(fv.MISSING_WORDS)}) THEN NULL ELSE trim({column}) END"


def _date(column: str) -> str:
    return f"CAST(try_strptime({_clean(column)}, ['%m/%d/%Y', '%Y-%m-%d']) AS DATE)"


def _numbered(name: str, source: str, hint: str) -> str:
    """CTEs that add ``p``, the parsed number, to a source with ``number``."""
    def result(number: str, country: str, kind: str, placeholder: bool = False) -> str:
        return (f"{{'num': {number}, 'country': {country}, 'kind': {kind}, 'ph': {str(placeholder).lower()}}}")

    codes = " ".join(
        f"WHEN upper(number) = '{code}' THEN " + result("NULL::VARCHAR", "'US'", f"'{kind}'", True)
        for code, kind in fv.PLACEHOLDER_TYPES.items())
    digits = "regexp_replace(c, '[^0-9]', '', 'g')"
    home = f"regexp_replace(regexp_replace(substr(c, 3), '{fv.HOME_KIND_CODE}', ''), '[^0-9]', '', 'g')"
    rest = "regexp_replace(substr(c, 3), '([A-Z][0-9]?)$', '')"
    known = f"length(c) > 2 AND substr(c, 1, 2) IN ({_quoted(fv.COUNTRY_PREFIXES)})"
    return f"""
{name}_0 AS (SELECT *, {hint} AS h, upper(regexp_replace(number, '[\\s\\-,/]+', '', 'g')) AS c0 FROM {source}),
{name}_1 AS (SELECT *, CASE WHEN h <> 'US' AND starts_with(c0, 'US') AND c0 <> 'US' THEN substr(c0, 3) ELSE c0 END AS c FROM {name}_0),
{name} AS MATERIALIZED (SELECT *, CASE
  WHEN number IS NULL THEN {result("NULL::VARCHAR", "NULL::VARCHAR", "'unknown'", True)}
  {codes}
  WHEN c = '' THEN {result("NULL::VARCHAR", "NULL::VARCHAR", "'unknown'", True)}
  WHEN (starts_with(c, 'USRE') OR starts_with(c, 'RE')) AND {digits} <> '' THEN {result(f"'USRE' || {digits}", "'US'", "'reissue'")}
  WHEN regexp_matches(c, '^(US)?D[0-9]+') THEN {result("'USD' || regexp_extract(c, '^(?:US)?D([0-9]+)', 1)", "'US'", "'design'")}
  WHEN regexp_matches(c, '^US[0-9]{{11}}([A-Z][0-9]?)?$') THEN {result("CASE WHEN length(c) = 13 THEN c || 'A1' ELSE c END", "'US'", "'publication'")}
  WHEN {known} AND starts_with(c, 'US') AND {home} <> '' THEN {result(f"'US' || {home}", "'US'", "'utility'")}
  WHEN {known} AND {rest} <> '' THEN {result(f"substr(c, 1, 2) || {rest}", "substr(c, 1, 2)", "'foreign'")}
  WHEN regexp_matches(c, '^[0-9][0-9A-Z.\\-]*$') THEN {result("coalesce(h, 'US') || c", "coalesce(h, 'US')", "CASE WHEN coalesce(h, 'US') = 'US' THEN 'utility' ELSE 'foreign' END")}
  WHEN h IS NOT NULL THEN {result("h || c", "h", "'foreign'")}
  ELSE {result("c", "NULL::VARCHAR", "'unknown'")} END AS p FROM {name}_1)"""


_STATUS = " UNION ALL ".join(
    f"SELECT {_sql(key)} AS s_key, {_sql(value)} AS s_value, {_sql(tag)}::VARCHAR AS s_tag"
    for key, (value, tag) in fv.STATUS_RULES.items())


def _owner(column: str, field: int) -> str:
    whens = " ".join(
        f"WHEN regexp_matches({column}, '{pattern}', 'i') THEN {(_sql(name), str(ok).lower())[field]}"
        for pattern, name, ok in fv.OWNER_RULES)
    return f"CASE {whens} ELSE {(column, 'false')[field]} END"


def _flags(*tests: tuple[str, str]) -> str:
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


_NON_OWNER = " OR ".join(f"contains(lower(owner_raw), {_sql(n)})" for n in fv.KNOWN_NON_OWNERS)

_BULK = f"""
status_rules AS ({_STATUS}),
bulk_raw AS MATERIALIZED ({BULK_SQL}),
bulk_c AS (SELECT row_index, {_clean('number')} AS number, {_clean('title')} AS title, {_clean('abstract')} AS abstract,
  {_clean('main_text')} AS main_text, {_clean('claims')} AS claims_text, {_date('filing_date')} AS filing_date,
  {_date('granted_date')} AS grant_date, {_clean('status')} AS status_raw, {_clean('current_assignee')} AS owner_raw,
  {_clean('inventors')} AS inventors_raw, {_clean('figure_urls')} AS figure_urls
  FROM bulk_raw WHERE {_clean('number')} IS NOT NULL),
{_numbered('bulk_n', 'bulk_c', 'NULL::VARCHAR')},
bulk_s AS (SELECT b.*, CASE WHEN p.ph THEN 'pending' ELSE coalesce(s_value, 'unknown') END AS status,
  CASE WHEN p.ph THEN 'pre_publication' ELSE s_tag END AS sub_tag,
  {_owner('owner_raw', 0)} AS owner, coalesce({_owner('owner_raw', 1)}, false) AS confirmed
  FROM bulk_n AS b LEFT JOIN status_rules ON s_key = lower(status_raw)),
bulk AS MATERIALIZED (SELECT *, p.num AS normalized_number, p.country AS country, p.kind AS patent_type, p.ph AS is_placeholder,
  NOT confirmed AS review,
  coalesce(list_filter(list_transform(string_split(inventors_raw, ','), lambda x: trim(x)), lambda x: x <> ''), []) AS inventors,
  {_flags(('unparseable_number', 'p.num IS NULL'), ('assignee_needs_review', 'NOT confirmed'), ('unknown_status', "status = 'unknown'"))} AS flags
  FROM bulk_s)"""

_CURATED = f"""
status_rules AS ({_STATUS}),
curated_raw AS MATERIALIZED ({CURATED_SQL}),
curated_c AS (SELECT row_index, {_clean('ip_status')} AS status_raw, {_clean('country')} AS country_raw, {_clean('title')} AS title,
  {_date('filing_date')} AS filing_date, {_clean('number')} AS number, {_date('issue_date')} AS grant_date,
  {_date('expiration_date')} AS expiration_date, {_clean('model')} AS model, {_clean('product_line')} AS product_line,
  {_clean('link')} AS link FROM curated_raw),
{_numbered('curated_n', 'curated_c', 'country_raw')},
curated_s AS (SELECT c.* EXCLUDE (c0, c, h), coalesce(country_raw, p.country) AS country,
  CASE WHEN p.ph THEN 'pending' ELSE coalesce(s_value, 'unknown') END AS status,
  CASE WHEN p.ph THEN 'pre_publication' ELSE s_tag END AS sub_tag
  FROM curated_n AS c LEFT JOIN status_rules ON s_key = lower(status_raw)
  WHERE country_raw IS NOT NULL OR status_raw IS NOT NULL OR title IS NOT NULL OR number IS NOT NULL),
curated_k AS (SELECT *, country <> 'US' AND number IS NOT NULL AND p.num IS NULL AS made FROM curated_s),
curated AS MATERIALIZED (SELECT *, CASE WHEN country = 'US' THEN 'us' ELSE 'foreign' END AS section,
  CASE WHEN made THEN country || regexp_replace(upper(number), '[^A-Z0-9]', '', 'g') ELSE p.num END AS normalized_number,
  CASE WHEN made THEN 'foreign' ELSE p.kind END AS patent_type, p.ph AS is_placeholder,
  {_flags(('placeholder_number', 'p.ph'), ('unknown_status', "status = 'unknown'"), ('missing_filing_date', 'filing_date IS NULL'),
          ('missing_expiration_date', "expiration_date IS NULL AND status IN ('active', 'pending')"))} AS flags
  FROM curated_k)"""

_FOLDED = """
bulk_k AS (SELECT *, coalesce(normalized_number, ' b' || row_index) AS k FROM bulk),
bulk_g AS (SELECT k, min(row_index) AS row_index,
  arg_min({'raw': number, 'num': normalized_number, 'country': country, 'kind': patent_type, 'ph': is_placeholder, 'flags': flags, 'inv': inventors,
           'st': status, 'tag': sub_tag, 'sraw': status_raw, 'oraw': owner_raw, 'own': owner, 'conf': confirmed}, row_index) AS f,
  arg_min({'st': status, 'tag': sub_tag, 'sraw': status_raw}, row_index) FILTER (status <> 'unknown') AS s,
  arg_min({'oraw': owner_raw, 'own': owner, 'conf': confirmed}, row_index) FILTER (confirmed) AS o,
  arg_min(title, row_index) FILTER (title IS NOT NULL) AS title,
  arg_min(abstract, row_index) FILTER (abstract IS NOT NULL) AS abstract,
  arg_min(claims_text, row_index) FILTER (claims_text IS NOT NULL) AS claims_text,
  arg_min(filing_date, row_index) FILTER (filing_date IS NOT NULL) AS filing_date,
  arg_min(grant_date, row_index) FILTER (grant_date IS NOT NULL) AS grant_date,
  flatten(list(inventors ORDER BY row_index)) AS names FROM bulk_k GROUP BY k),
folded AS MATERIALIZED (SELECT k, row_index, f.raw AS raw_number, f.num AS normalized_number, f.country AS country, f.kind AS patent_type,
  f.ph AS is_placeholder, CASE WHEN s IS NULL THEN f.st ELSE s.st END AS status, CASE WHEN s IS NULL THEN f.tag ELSE s.tag END AS sub_tag,
  CASE WHEN s IS NULL THEN f.sraw ELSE s.sraw END AS status_raw, CASE WHEN o IS NULL THEN f.oraw ELSE o.oraw END AS owner_raw,
  CASE WHEN o IS NULL THEN f.own ELSE o.own END AS owner, CASE WHEN o IS NULL THEN f.conf ELSE o.conf END AS confirmed,
  title, abstract, claims_text, filing_date, grant_date,
  list_concat(f.inv, list_filter(names, lambda x, i: list_position(names, x) = i AND NOT list_contains(f.inv, x))) AS inventors,
  f.flags AS flags FROM bulk_g)"""

_FIRST = """
curated_d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, coalesce(normalized_number, ' c' || row_index) AS k,
  row_number() OVER (PARTITION BY coalesce(normalized_number, ' c' || row_index) ORDER BY row_index) AS rn FROM curated) WHERE rn = 1)"""

_UUID = """substr(hx, 1, 8) || '-' || substr(hx, 9, 4) || '-5' || substr(hx, 14, 3) || '-' ||
  translate(substr(hx, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(hx, 18, 3) || '-' || substr(hx, 21, 12)"""

_MERGED = f"""
both_sides AS (SELECT c.row_index AS ci, b.row_index AS bi, c.row_index IS NOT NULL AS hc, b.row_index IS NOT NULL AS hb,
  coalesce(c.normalized_number, b.normalized_number) AS normalized_number, coalesce(c.number, b.raw_number) AS raw_number,
  coalesce(c.country, b.country) AS country, coalesce(c.patent_type, b.patent_type, 'unknown') AS patent_type,
  coalesce(c.is_placeholder, false) OR coalesce(b.is_placeholder, false) AS is_placeholder,
  c.title AS ct, b.title AS bt, b.abstract, b.claims_text, c.filing_date AS cf, b.filing_date AS bf, c.grant_date AS cg, b.grant_date AS bg,
  c.expiration_date, c.product_line, c.model, c.link, c.status AS cs, c.sub_tag AS ctag, c.status_raw AS craw,
  b.status AS bs, b.sub_tag AS btag, b.status_raw AS braw, b.owner_raw, b.owner AS bowner, b.confirmed AS bconf,
  coalesce(b.inventors, []) AS inventors, coalesce(c.flags, []) AS cfl, coalesce(b.flags, []) AS bfl
  FROM curated_d AS c FULL JOIN folded AS b ON c.k = b.k),
hashed AS (SELECT *, coalesce(ci, bi) AS ri,
  sha1(unhex('{fv.ID_NAMESPACE.replace("-", "")}') || encode('{fv.ID_SEED_PREFIX}' || coalesce(normalized_number,
    coalesce(country, 'NA') || '-' || coalesce(raw_number, 'NO_NUMBER') || '-' || coalesce(ci, bi)))) AS hx FROM both_sides),
merged AS MATERIALIZED (SELECT *, {_UUID} AS id,
  CAST(CASE WHEN hc AND normalized_number IS NOT NULL THEN 0 WHEN hc THEN 1 WHEN normalized_number IS NOT NULL THEN 2 ELSE 3 END AS BIGINT)
    * 1152921504606846976 + ri AS seq,
  coalesce(ct, bt) AS title, CASE WHEN ct IS NULL THEN 'csv' ELSE 'xlsx' END AS title_source,
  coalesce(cf, bf) AS filing_date, CASE WHEN cf IS NULL THEN 'csv' ELSE 'xlsx' END AS filing_date_source,
  coalesce(cg, bg) AS grant_date, CASE WHEN cg IS NULL THEN 'csv' ELSE 'xlsx' END AS grant_date_source,
  CASE WHEN hc AND cs <> 'unknown' THEN cs WHEN hb THEN bs ELSE 'unknown' END AS status,
  CASE WHEN hc AND cs <> 'unknown' THEN ctag WHEN hb THEN btag END AS sub_tag,
  CASE WHEN hc AND cs <> 'unknown' THEN 'xlsx' WHEN hb THEN 'csv' ELSE 'xlsx' END AS status_source,
  CASE WHEN hc THEN coalesce(bowner, '{fv.HOUSE_OWNER}') ELSE bowner END AS owner,
  hc OR coalesce(bconf, false) AS confirmed, NOT hc AND NOT coalesce(bconf, true) AS review,
  CASE WHEN hb THEN 'csv' ELSE 'xlsx' END AS owner_source,
  list_concat(cfl, list_filter(bfl, lambda x: NOT list_contains(cfl, x))) AS mflags FROM hashed),
titled AS MATERIALIZED (SELECT *, nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), '') AS tkey,
  country IS NULL OR country = 'US' AS home FROM merged),
founders AS (SELECT seq, tkey, row_number() OVER (ORDER BY seq) AS fno FROM titled WHERE home),
claims AS (SELECT tkey AS claim, min(fno) AS fno FROM founders WHERE tkey IS NOT NULL GROUP BY tkey),
linked AS (SELECT t.seq, c.fno FROM titled AS t LEFT JOIN claims AS c ON t.hc AND t.tkey = c.claim WHERE NOT home),
placed AS (
  SELECT seq, fno, true AS is_parent, false AS is_orphan FROM founders
  UNION ALL SELECT seq, fno, false, false FROM linked WHERE fno IS NOT NULL
  UNION ALL SELECT seq, (SELECT count(*) FROM founders) + row_number() OVER (ORDER BY seq), true, true FROM linked WHERE fno IS NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY fno) AS family_size FROM placed),
master AS MATERIALIZED (SELECT t.*, p.fno, p.is_parent, p.is_orphan, p.family_size, 'FAM-' || CASE WHEN p.fno < 100000 THEN lpad(p.fno::VARCHAR, 5, '0') ELSE p.fno::VARCHAR END AS family_id,
  CASE WHEN p.is_orphan THEN list_append(mflags, 'missing_us_parent') ELSE mflags END AS flags FROM titled AS t JOIN sized AS p USING (seq)),
fam AS (SELECT fno, max(family_id) AS family_id, max(id) FILTER (is_parent) AS parent_id, max(normalized_number) FILTER (is_parent) AS parent_number,
  max(title) FILTER (is_parent) AS parent_title, count(*) AS member_count,
  list(country ORDER BY NOT is_parent, seq) FILTER (country IS NOT NULL) AS cs, bool_or(is_orphan) AS orphan FROM master GROUP BY fno),
families AS (SELECT * EXCLUDE (cs), coalesce(list_filter(cs, lambda x, i: list_position(cs, x) = i), []) AS countries, member_count > {fv.OVERSIZED_ABOVE} AS oversized FROM fam),
members AS (SELECT fno, family_id, CASE WHEN is_parent THEN -1 ELSE seq END AS place, id, normalized_number, country, status,
  CAST(filing_date AS VARCHAR) AS filing_date, CAST(grant_date AS VARCHAR) AS grant_date, family_size, seq FROM master)"""

_TESTS = {
    "assignee_review": "review",
    "missing_expiration": "expiration_date IS NULL AND status IN ('active', 'pending')",
    "missing_filing": "filing_date IS NULL",
    "unknown_status": "status = 'unknown'",
    "placeholder_number": "is_placeholder",
    "foreign_orphans": "is_orphan",
    "bulk_only_non_owner": "hb AND NOT hc AND NOT confirmed",
    "bulk_only_historical": "hb AND NOT hc AND confirmed",
    "curated_only": "hc AND NOT hb AND NOT is_placeholder",
    "missing_product_line": "coalesce(product_line, '') = ''",
    "missing_tech_cluster": "true",
}
_EXCEPTIONS = "exc AS (" + " UNION ALL ".join(
    f"SELECT '{name}' AS category, * FROM master WHERE {test}" for name, test in _TESTS.items()) + ")"
_SUMMARY = "summary AS (" + " UNION ALL ".join(
    [f"SELECT '{name}' AS category, count(*) AS n FROM master WHERE {test}" for name, test in _TESTS.items()]
    + ["SELECT 'oversized_families', count(*) FROM families WHERE oversized"]) + ")"

_ROWS = """trows AS (SELECT seq, id, normalized_number, raw_number, title, status, sub_tag AS status_sub_tag, country, patent_type, product_line, model,
  filing_date, grant_date, expiration_date, inventors, owner AS assignee, confirmed AS is_confirmed_owner, is_placeholder, family_id, flags FROM master)"""


def bulk(select: str) -> str:
    return f"WITH {_BULK} {select}"


def curated(select: str) -> str:
    return f"WITH {_CURATED} {select}"


def folded(select: str) -> str:
    return f"WITH {_BULK}, {_FOLDED} {select}"


def master(select: str, *more: str) -> str:
    curated_ctes = _CURATED.split("),\n", 1)[1]  # the status rules are there already
    return f"WITH {','.join([_BULK, curated_ctes, _FOLDED, _FIRST, _MERGED, *more])} {select}"


def _text(column: str) -> str:
    return f"array_to_string({column}, '|')"


def _day(column: str) -> str:
    return f"CAST({column} AS VARCHAR)"


_BULK_COLUMNS = f"""row_index, {{number}} AS raw_number, normalized_number, country, patent_type, is_placeholder, status, sub_tag, status_raw,
  owner_raw, owner, confirmed, NOT confirmed AS review, title, abstract, claims_text, {_day('filing_date')} AS filing_date,
  {_day('grant_date')} AS grant_date, {_text('inventors')} AS inventors, {_text('flags')} AS flags"""

_MEMBER = "family_id, place, id, normalized_number, country, status, filing_date, grant_date"


def _shown(column: str) -> str:
    return (f"array_to_string({column}[1:3], ', ') || CASE WHEN len({column}) > 3 THEN ' +' || (len({column}) - 3) ELSE '' END")


def _errors(field: str, query: str) -> str:
    """Fewest edits between the query and any substring near its length."""
    n = len(query)
    k = int(n * fv.SEARCH_THRESHOLD)
    # A field shorter than n - k is further away than k whatever it holds.
    return (f"CASE WHEN length({field}) >= {n - k} THEN list_min(flatten(list_transform(range({max(n - k, 1)}, {n + k + 1}), lambda w: list_transform("
            f"range(1, greatest(length({field}), 1) + 1), lambda i: levenshtein(substr(lower({field}), i, w), '{query}'))))) END")


def _search(query: str) -> tuple[str, str]:
    """CTE ``scored`` with the errors per field, and the match test on it."""
    k = int(len(query) * fv.SEARCH_THRESHOLD)
    costs, tests, total, weight = [], [], [], []
    for name, share in fv.SEARCH_WEIGHTS.items():
        cost = (f"list_min(list_transform(inventors, lambda v: {_errors('v', query)}))" if name == "inventors"
                else _errors(name, query))
        costs.append(f"{cost} AS e_{name}")
        tests.append(f"e_{name} <= {k}")
        total.append(f"CASE WHEN e_{name} <= {k} THEN e_{name} / {len(query)}.0::DOUBLE * {share} ELSE 0 END")
        weight.append(f"CASE WHEN e_{name} <= {k} THEN {share} ELSE 0 END")
    cte = f"scored AS (SELECT *, {', '.join(costs)} FROM trows)"
    ranked = f"hits AS (SELECT *, ({' + '.join(total)}) / ({' + '.join(weight)}) AS rank FROM scored WHERE {' OR '.join(tests)})"
    return f"{cte}, {ranked}", ranked


_HITS = _search(SEARCH_QUERY)[0]
_LONG_HITS = _search(LONG_QUERY)[0]

_EXPORT = ", ".join(
    f"coalesce({value}, '') AS {column}" for value, column in zip(
        ("id", "normalized_number", "title", "status", "status_sub_tag", "country", "patent_type", "product_line", "model",
         _day("filing_date"), _day("grant_date"), _day("expiration_date"), "array_to_string(inventors, '; ')", "assignee",
         "CAST(is_confirmed_owner AS VARCHAR)", "family_id", "array_to_string(flags, '; ')"), fv.EXPORT_COLUMNS))

_COUNTS = """
SELECT 'by_status' AS metric, status AS name, count(*) AS n, min(seq) AS first FROM master GROUP BY status
UNION ALL SELECT 'by_product_line', coalesce(product_line, '(unmapped)'), count(*), min(seq) FROM master GROUP BY 2
UNION ALL SELECT 'by_decade', CAST(year(filing_date) // 10 * 10 AS VARCHAR) || 's', count(*), min(seq) FROM master WHERE filing_date IS NOT NULL GROUP BY 2
UNION ALL SELECT 'by_country', coalesce(country, '(unknown)'), count(*), min(seq) FROM master GROUP BY 2
UNION ALL SELECT 'jurisdiction_count', '', count(DISTINCT nullif(country, '')), 0 FROM master
UNION ALL SELECT 'total', '', count(*), 0 FROM master
UNION ALL SELECT 'confirmed_owner', '', count(*) FILTER (confirmed), 0 FROM master
UNION ALL SELECT 'family_count', '', count(DISTINCT fno), 0 FROM master
UNION ALL SELECT 'matched', '', count(*) FILTER (hc AND hb), 0 FROM master
UNION ALL SELECT 'curated_only', '', count(*) FILTER (hc AND NOT hb), 0 FROM master
UNION ALL SELECT 'bulk_only', '', count(*) FILTER (hb AND NOT hc), 0 FROM master
"""

_ALERTS = ("SELECT CAST(sum(n) AS BIGINT) AS alerts FROM summary WHERE category IN ('assignee_review', 'missing_expiration', "
           "'unknown_status', 'foreign_orphans', 'bulk_only_non_owner', 'oversized_families')")

_LOG = f"""numbered AS (SELECT id, row_number() OVER (ORDER BY seq) AS no FROM master),
ov AS (SELECT m.id, e.event_id, e.ts,
    ['status', 'product_line', 'technology_cluster', 'assignee_confirmed', 'exclude', 'notes'][event_id % 6 + 1] AS field,
    CASE WHEN event_id % 6 IN (3, 4) THEN CASE WHEN event_id % 4 < 2 THEN 'true' ELSE 'false' END ELSE event_type || ' ' || user_id END AS value
  FROM events AS e JOIN numbered AS m ON (e.event_id * {OVERRIDE_STEP}) % (SELECT count(*) FROM master) + 1 = m.no),
latest AS (SELECT id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY id, field ORDER BY ts DESC, event_id DESC) AS rn FROM ov) WHERE rn = 1),
wide AS (SELECT id, max(value) FILTER (field = 'status') AS o_status, max(value) FILTER (field = 'product_line') AS o_line,
  max(value) FILTER (field = 'technology_cluster') AS o_cluster, max(value) FILTER (field = 'assignee_confirmed') AS o_conf,
  max(value) FILTER (field = 'exclude') AS o_exclude, max(value) FILTER (field = 'notes') AS o_notes FROM latest GROUP BY id)"""


_SNAPSHOTS = """corrected AS (SELECT m.seq, coalesce(o_status, status) AS status, coalesce(o_line, product_line) AS product_line,
    coalesce(o_notes, '') AS notes FROM master AS m LEFT JOIN wide AS w ON w.id = m.id WHERE coalesce(o_exclude, 'false') <> 'true'),
j AS (SELECT m.seq, c.seq AS nk, m.status AS os, c.status AS ns, m.product_line AS ol, c.product_line AS nl, '' AS oo, c.notes AS no
  FROM master AS m LEFT JOIN corrected AS c ON c.seq = m.seq)"""


def _changes(direction: str, gone: str, before: str, after: str) -> str:
    parts = [f"SELECT seq, '{gone}' AS change, NULL::VARCHAR AS field, NULL::VARCHAR AS before, NULL::VARCHAR AS after FROM j WHERE nk IS NULL"]
    for field, letter in (("status", "s"), ("product_line", "l"), ("notes", "o")):
        b, a = before + letter, after + letter
        parts.append(f"SELECT seq, 'changed', '{field}', {b}, {a} FROM j WHERE nk IS NOT NULL AND {b} IS DISTINCT FROM {a}")
    return f"SELECT *, '{direction}' AS direction FROM ({' UNION ALL '.join(parts)})"


_KEPT = ", ".join(f"CASE WHEN nk IS NULL OR starts_with(ns, 'error') THEN o{x} ELSE n{x} END AS {name}"
                  for x, name in (("s", "status"), ("l", "product_line"), ("o", "notes")))

# Cells that the landing takes for missing are null.
_LANDED = ", ".join(
    f"CASE WHEN {cell} IN ({_quoted(fv.MISSING_TOKENS)}) THEN NULL ELSE {cell} END AS {name}"
    for name, cell in ((n, "main_text || chr(10) || 'says \"so\", twice' || chr(10)" if n == "main_text" else n) for n in BULK_HEADERS.values()))

# Every open title against every claimed one, by whole edit distances.
_SIMILAR = f"""alone AS (SELECT seq, tkey FROM master WHERE is_orphan AND hc),
near AS (SELECT o.tkey, c.claim, c.fno, levenshtein(o.tkey, c.claim) AS d, greatest(length(o.tkey), length(c.claim)) AS longer
  FROM (SELECT DISTINCT tkey FROM alone WHERE tkey IS NOT NULL) AS o JOIN claims AS c ON o.tkey <> c.claim
  AND levenshtein(o.tkey, c.claim) <= greatest(length(o.tkey), length(c.claim)) * {100 - PERCENT} // 100),
similar_to AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tkey ORDER BY d::DOUBLE / longer, fno) AS rn FROM near) WHERE rn = 1)"""
_RELINKED = f"""{_SIMILAR},
linked_too AS (SELECT l.seq, coalesce(l.fno, s.fno) AS fno FROM linked AS l JOIN titled AS t USING (seq)
  LEFT JOIN similar_to AS s ON t.hc AND l.fno IS NULL AND s.tkey = t.tkey),
placed_too AS (SELECT seq, fno, true AS is_parent, false AS orphan FROM founders
  UNION ALL SELECT seq, fno, false, false FROM linked_too WHERE fno IS NOT NULL
  UNION ALL SELECT seq, (SELECT count(*) FROM founders) + row_number() OVER (ORDER BY seq), true, true FROM linked_too WHERE fno IS NULL),
grouped AS (SELECT p.fno, max(id) FILTER (is_parent) AS parent_id, count(*) AS member_count, bool_or(orphan) AS orphan,
  list(country ORDER BY NOT is_parent, p.seq) FILTER (country IS NOT NULL) AS cs FROM placed_too AS p JOIN titled USING (seq) GROUP BY p.fno)"""

ORACLES: dict[str, str] = {
    "similar_title_links": master("""SELECT a.seq, a.tkey AS title, s.fno AS family_no, s.claim AS parent_title, s.d AS distance
      FROM alone AS a LEFT JOIN similar_to AS s USING (tkey)""", _SIMILAR),
    "families_by_similarity": master(f"""SELECT 'FAM-' || CASE WHEN fno < 100000 THEN lpad(fno::VARCHAR, 5, '0') ELSE fno::VARCHAR END AS family_id,
      parent_id, member_count, coalesce(array_to_string(list_filter(cs, lambda x, i: list_position(cs, x) = i), '|'), '') AS countries, orphan,
      member_count > {fv.OVERSIZED_ABOVE} AS oversized FROM grouped""", _RELINKED),
    "entity_overlap": master("SELECT hc AS in_curated, hb AS in_bulk, count(*) AS n FROM master GROUP BY ALL"),
    "curated_records": curated(f"""SELECT row_index, section, number AS raw_number, normalized_number, country, patent_type, is_placeholder,
      status, sub_tag, status_raw, title, {_day('filing_date')} AS filing_date, {_day('grant_date')} AS grant_date,
      {_day('expiration_date')} AS expiration_date, model, product_line, link AS google_patents_link, {_text('flags')} AS flags FROM curated"""),
    "bulk_records": bulk(f"SELECT {_BULK_COLUMNS.format(number='number')} FROM bulk"),
    "normalize_number": bulk("SELECT row_index, number AS raw_number, normalized_number, country, patent_type, is_placeholder FROM bulk"),
    "normalize_status": bulk("SELECT status_raw AS raw, status, sub_tag, is_placeholder, count(*) AS n FROM bulk GROUP BY ALL"),
    "normalize_owner": bulk(f"""SELECT owner_raw AS raw, owner, confirmed, review, coalesce(({_NON_OWNER}) AND NOT
      ({' OR '.join(f"regexp_matches(owner_raw, '{p}', 'i')" for p, _, _ in fv.OWNER_RULES)}), false) AS known_non_owner,
      count(*) AS n FROM bulk GROUP BY ALL"""),
    "raw_payload": bulk(f"""SELECT row_index, number, title, abstract, main_text, {_day('filing_date')} AS filing_date,
      {_day('grant_date')} AS granted_date, status_raw AS status, owner_raw AS current_assignee, inventors_raw AS inventors,
      claims_text AS claims, figure_urls FROM bulk"""),
    "dedupe_absorb": folded(f"SELECT {_BULK_COLUMNS.format(number='raw_number')} FROM folded"),
    "dedupe_first": f"WITH {_CURATED}, {_FIRST} SELECT row_index, normalized_number, number AS raw_number, country, title FROM curated_d",
    "bulk_only": master("SELECT row_index, normalized_number, country, title FROM folded WHERE k NOT IN (SELECT k FROM curated_d)"),
    "merge_master": master(f"""SELECT seq, id, raw_number, normalized_number, patent_type, country, is_placeholder, title, abstract, claims_text,
      {_day('filing_date')} AS filing_date, {_day('grant_date')} AS grant_date, NULL::VARCHAR AS publication_date,
      {_day('expiration_date')} AS expiration_date, product_line, model, link AS google_patents_url, '' AS notes,
      title_source, 'csv' AS abstract_source, 'csv' AS claims_text_source, filing_date_source, grant_date_source,
      'csv' AS publication_date_source, 'xlsx' AS expiration_date_source, 'xlsx' AS product_line_source, 'xlsx' AS model_source,
      'xlsx' AS google_patents_url_source, 'manual' AS notes_source, false AS title_overridden, status, sub_tag, status_source,
      craw AS raw_curated, braw AS raw_bulk, owner_raw, owner, confirmed, review, owner_source, {_text('inventors')} AS inventors,
      family_id, {_text('flags')} AS flags, CASE WHEN hc AND hb THEN 'xlsx|csv' WHEN hc THEN 'xlsx' ELSE 'csv' END AS sources,
      ci AS _curated_row_index, bi AS _bulk_row_index FROM master"""),
    "merge_stats": master("""SELECT count(*) AS total_records, count(*) FILTER (hc AND hb) AS matched, count(*) FILTER (hc AND NOT hb) AS curated_only,
      count(*) FILTER (hb AND NOT hc) AS bulk_only, count(DISTINCT fno) AS families, count(*) FILTER (country = 'US') AS home_records,
      count(*) FILTER (country <> 'US') AS foreign_records, count(*) FILTER (confirmed) AS confirmed_owner FROM master"""),
    "families": master(f"SELECT family_id, parent_id, parent_number, parent_title, member_count, {_text('countries')} AS countries, orphan, oversized FROM families"),
    "family_members": master(f"SELECT {_MEMBER} FROM members"),
    "family_member_lists": master("""SELECT family_id, CASE WHEN place < 0 THEN -1 ELSE place // 256 END AS chunk, count(*) AS n,
      string_agg(id || '/' || coalesce(normalized_number, '-') || '/' || coalesce(country, '-') || '/' || status || '/' ||
        coalesce(filing_date, '-') || '/' || coalesce(grant_date, '-'), '|' ORDER BY place) AS members
      FROM members GROUP BY ALL"""),
    "member_chunks": master("""SELECT family_id, CASE WHEN place < 0 THEN -1 ELSE place // 256 END AS chunk, string_agg(id, '|' ORDER BY place) AS member_ids
      FROM members GROUP BY ALL"""),
    "oversized_families": master(f"SELECT family_id, parent_title, member_count, {_text('countries')} AS countries FROM families WHERE oversized"),
    "siblings_of_parents": master(f"""SELECT a.id AS of_id, {', '.join('o.' + c for c in _MEMBER.split(', '))}
      FROM master AS a JOIN members AS o ON o.fno = a.fno AND o.seq <> a.seq WHERE a.is_parent"""),
    "record_families": master("""SELECT m.id, m.seq, m.family_id, f.parent_id, f.member_count, f.orphan, f.oversized
      FROM master AS m JOIN families AS f USING (fno)"""),
    "record_lookup": master(f"SELECT id, normalized_number, country, title, family_id FROM master WHERE normalized_number = '{LOOKUP_NUMBER}'"),
    "merge_shape": master("""SELECT count(*) FILTER (hc AND hb) AS matched, count(*) FILTER (hc AND NOT hb) AS curated_only,
      count(*) FILTER (hb AND NOT hc) AS bulk_only FROM master"""),
    "family_coverage": master("SELECT family_id, country, count(*) AS members FROM master GROUP BY ALL"),
    "exceptions_long": master(f"""SELECT category, seq, id, normalized_number, raw_number, title, country, status, sub_tag AS status_sub_tag,
      owner AS assignee, product_line, family_id, {_text('flags')} AS flags FROM exc""", _EXCEPTIONS),
    "exception_summary": master("SELECT category, n FROM summary", _SUMMARY),
    "exception_preview": master(f"""SELECT category, place, total, total > {fv.PREVIEW_SIZE} AS truncated, seq, id,
      coalesce(normalized_number, raw_number, '—') AS number, {_shown('flags')} AS flags FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY seq) AS place,
      count(*) OVER (PARTITION BY category) AS total FROM exc) WHERE place <= {fv.PREVIEW_SIZE}""", _EXCEPTIONS),
    "alert_records": master("SELECT count(DISTINCT seq) AS records FROM exc WHERE category IN ('assignee_review', 'missing_expiration', "
                            "'unknown_status', 'foreign_orphans', 'bulk_only_non_owner')", _EXCEPTIONS),
    "alert_count": master(_ALERTS, _SUMMARY),
    "format_duplicates": bulk("""SELECT normalized_number, count(DISTINCT number) AS spellings, count(*) AS rows FROM bulk
      WHERE normalized_number IS NOT NULL GROUP BY 1 HAVING count(DISTINCT number) > 1"""),
    "curated_summary": curated("""SELECT count(*) AS total_rows, count(*) FILTER (section = 'us') AS us_rows, count(*) FILTER (section = 'foreign') AS foreign_rows,
      count(*) FILTER (is_placeholder) AS placeholder_rows, count(*) FILTER (status = 'unknown') AS unknown_status,
      count(*) FILTER (normalized_number IS NULL) AS missing_numbers, string_agg(DISTINCT country, '|' ORDER BY country) AS countries FROM curated"""),
    "bulk_summary": bulk("""SELECT count(*) AS total_rows, count(DISTINCT normalized_number) AS unique_normalized,
      count(*) FILTER (normalized_number IS NULL) AS unparseable_numbers, count(*) FILTER (confirmed) AS confirmed_owner,
      count(*) FILTER (review) AS needs_assignee_review, count(*) FILTER (status = 'unknown') AS unknown_status FROM bulk"""),
    "top_countries": bulk("""SELECT coalesce(country, 'UNKNOWN') AS country, count(*) AS count, min(row_index) AS first FROM bulk GROUP BY 1
      ORDER BY count DESC, first LIMIT 10"""),
    "taxonomy_lines": master("SELECT product_line AS name, count(*) AS count, min(seq) AS first FROM master WHERE product_line <> '' GROUP BY 1"),
    "taxonomy_models": master("SELECT model AS name, count(*) AS count, min(seq) AS first FROM master WHERE model <> '' GROUP BY 1"),
    "overview_all": master(f"SELECT metric, name, n FROM ({_COUNTS}) UNION ALL SELECT 'exception_count', '', alerts FROM ({_ALERTS})", _SUMMARY),
    "overview_top_lines": master(f"SELECT name, n, first FROM ({_COUNTS}) WHERE metric = 'by_product_line' ORDER BY n DESC, first LIMIT 10"),
    "table_rows": master(f"""SELECT * REPLACE ({_day('filing_date')} AS filing_date, {_day('grant_date')} AS grant_date,
      {_day('expiration_date')} AS expiration_date, {_text('inventors')} AS inventors, {_text('flags')} AS flags) FROM trows""", _ROWS),
    "facets": master("""SELECT DISTINCT 'product_line' AS facet, product_line AS value FROM trows WHERE product_line <> ''
      UNION ALL SELECT DISTINCT 'country', country FROM trows WHERE country <> ''""", _ROWS),
    "view_page": master(f"""SELECT seq, id, title, status, country, {_day('filing_date')} AS filing_date FROM (SELECT * FROM trows
      WHERE status IN ('active', 'pending') AND country IN ('US', 'EP') ORDER BY coalesce({_day('filing_date')}, '') DESC, seq LIMIT 50 OFFSET 50)""", _ROWS),
    "view_page_deep": master(f"""SELECT seq, id, title, country FROM trows ORDER BY coalesce(title, ''), seq
      LIMIT {fv.PAGE_SIZE} OFFSET {DEEP_PAGE * fv.PAGE_SIZE}""", _ROWS),
    "filtered_by_date_and_type": master(f"""SELECT id, patent_type, {_day('filing_date')} AS filing_date FROM trows
      WHERE patent_type IN ('utility', 'design') AND filing_date BETWEEN '1995-01-01' AND '2005-12-31'""", _ROWS),
    "page_count": master("SELECT count(*) AS rows, greatest(1, CAST(ceil(count(*) / 50) AS BIGINT)) AS pages FROM trows", _ROWS),
    "export_rows": master(f"SELECT {_EXPORT} FROM trows", _ROWS),
    "search_matches": master("SELECT id, title FROM hits", _ROWS, _HITS),
    "search_long": master("SELECT id, title FROM hits", _ROWS, _LONG_HITS),
    "search_view": master("""SELECT seq, id, country, round(rank, 6) AS rank FROM (SELECT * FROM hits
      ORDER BY coalesce(country, ''), rank, seq LIMIT 50)""", _ROWS, _HITS),
    "display_fields": master(f"""SELECT id, coalesce(normalized_number, raw_number, '—') AS number,
      coalesce(link, '{fv.LINK_BASE}' || url_encode(normalized_number)) AS link,
      coalesce(strftime(filing_date, '%b %-d, %Y'), '—') AS filed, CAST(year(filing_date) AS INTEGER) AS year,
      CAST(year(filing_date) // 10 * 10 AS VARCHAR) || 's' AS decade,
      CASE status WHEN 'active' THEN 'Active' WHEN 'pending' THEN 'Pending' WHEN 'expired' THEN 'Expired' WHEN 'dead' THEN 'Dead' ELSE 'Unknown' END AS status,
      {_shown('inventors')} AS inventors FROM master"""),
    "override_apply": master("""SELECT m.id, coalesce(o_status, status) AS status, CASE WHEN o_status IS NULL THEN status_source ELSE 'manual' END AS status_source,
      coalesce(o_line, product_line) AS product_line, o_line IS NOT NULL AS line_overridden, coalesce(o_notes, '') AS notes,
      coalesce(o_cluster, '') AS clusters, CASE WHEN o_conf IS NULL THEN confirmed ELSE o_conf = 'true' END AS confirmed,
      CASE WHEN o_conf IS NULL THEN review ELSE false END AS review
      FROM master AS m LEFT JOIN wide AS w ON w.id = m.id WHERE coalesce(o_exclude, 'false') <> 'true'""", _LOG),
    "snapshot_diff": master(
        f"{_changes('to corrected', 'removed', 'o', 'n')} UNION ALL {_changes('from corrected', 'added', 'n', 'o')}", _LOG, _SNAPSHOTS),
    "keep_good": master(f"SELECT seq, {_KEPT}, nk IS NULL OR starts_with(ns, 'error') AS stale FROM j", _LOG, _SNAPSHOTS),
    "landed_bulk": f"""SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, {_LANDED} FROM ({BULK_SQL})""",
    "published_master": master(f"SELECT seq, id, normalized_number, country, title, status, family_id, {_text('flags')} AS flags FROM master"),
    "published_view": master("""SELECT m.seq, m.id, title, coalesce(o_status, status) AS status, coalesce(o_line, product_line) AS product_line,
      CASE WHEN o_conf IS NULL THEN confirmed ELSE o_conf = 'true' END AS is_confirmed_owner, family_id
      FROM master AS m LEFT JOIN wide AS w ON w.id = m.id WHERE coalesce(o_exclude, 'false') <> 'true'""", _LOG),
    "kept_source": master("SELECT seq, id, normalized_number, title, abstract, claims_text, family_id, hb AS stale FROM master"),
    "published_taxonomy": master("""SELECT 'product_line' AS field, product_line AS name, count(*) AS count FROM master
      WHERE product_line <> '' GROUP BY 2 UNION ALL SELECT 'model', model, count(*) FROM master WHERE model <> '' GROUP BY 2"""),
    "published_members": master("SELECT family_id, member_count, member_count AS members FROM families"),
    "refresh_log": master("""SELECT count(*) AS total_records, count(*) FILTER (hc AND hb) AS matched, count(DISTINCT fno) AS families,
      (SELECT count(*) FROM curated) AS curated_rows, (SELECT count(*) FROM bulk) AS bulk_rows,
      (SELECT count(DISTINCT normalized_number) FROM bulk) AS unique_normalized, count(*) FILTER (status = 'unknown') AS unknown_status,
      (SELECT count(*) FROM families WHERE oversized) AS oversized, 0 AS errors FROM master"""),
    "csv_round_trip": f"SELECT {', '.join(f"nullif({c}, '') AS {c}" for c in fv.EXPORT_COLUMNS)} FROM ({master(f'SELECT {_EXPORT} FROM trows', _ROWS)})",
    "json_round_trip": master(f"""SELECT * REPLACE ({_day('filing_date')} AS filing_date, {_day('grant_date')} AS grant_date,
      {_day('expiration_date')} AS expiration_date, {_text('inventors')} AS inventors, {_text('flags')} AS flags) FROM trows""", _ROWS),
    "freshness": f"""SELECT 'source ' || user_id AS source, strftime(max(ts), '%Y-%m-%d') AS last_refresh,
      date_diff('day', CAST(max(ts) AS DATE), DATE '{FRESH_AS_OF}') > 30 AS stale FROM events GROUP BY 1""",
    "expiry_bands": master(f"""SELECT id, CASE WHEN expiration_date < DATE '{AS_OF}' THEN 'expired'
      WHEN expiration_date <= DATE '{AS_OF}' + INTERVAL 12 MONTH THEN '12_months'
      WHEN expiration_date <= DATE '{AS_OF}' + INTERVAL 24 MONTH THEN '24_months' WHEN expiration_date IS NOT NULL THEN 'later' END AS band,
      CASE WHEN expiration_date IS NOT NULL THEN greatest(date_diff('day', DATE '{AS_OF}', expiration_date), 0) END AS days FROM master"""),
    "split_product_lines": master("""SELECT parts[1] AS primary_line, array_to_string(parts[2:], '|') AS secondary_lines, count(*) AS n FROM (
      SELECT list_filter(list_transform(string_split(product_line, '/'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM master
      WHERE product_line IS NOT NULL) GROUP BY ALL"""),
}

# The same figures by other ways.
for _name, _same in (("owner_by_table", "normalize_owner"), ("status_by_table", "normalize_status"),
                     ("overview_kept", "overview_all"), ("facets_kept", "facets")):
    ORACLES[_name] = ORACLES[_same]
