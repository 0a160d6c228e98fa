"""The same results in SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations

from checks.data import SCHEMAS, TABLES, view_sql

NUMERIC = ("int", "bigint", "double")
WIDTHS = {"int": 4, "bigint": 8, "double": 8, "timestamp_ntz": 8}
YEAR = r"(19\d{2}|20\d{2})"
NAME_PARTS = ("year", "date", "datum", "start", "end", "from", "to", "published", "created", "updated")
KEY_PARTS = (" id", "id ", "_id", "id_", "doi", "orcid", "uuid", "guid", "issn", "isbn")


def r(expr: str, digits: int = 6) -> str:
    """Rounded, without a negative zero."""
    x = f"round(cast({expr} as double), {digits})"
    return f"case when {x} = 0 then 0e0 else {x} end"


def pct(part: str, whole: str) -> str:
    return f"coalesce(cast({part} as double) / nullif({whole}, 0) * 100e0, 0e0)"


def columns_of(name: str, *kinds: str) -> list[str]:
    return [c for c, t in SCHEMAS[name].items() if not kinds or t in kinds]


def big(expr: str) -> str:
    return f"cast({expr} as bigint)"


def union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


# --- per table ------------------------------------------------------------------------------

def schema_rows(name: str, source: str | None = None) -> str:
    source = source or view_sql(name)
    return union([
        f"""select '{c}' as "column", '{t}' as dtype, count({c}) as non_null,
  count(*) - count({c}) as "null", {r(pct(f'count(*) - count({c})', 'count(*)'))} as null_pct,
  count(distinct {c}) + {big(f'count(*) > count({c})')} as "unique" from {source}"""
        for c, t in SCHEMAS[name].items()])


def missing_rows(name: str) -> str:
    return union([f"""select '{c}' as "column", count(*) - count({c}) as missing,
  {r(pct(f'count(*) - count({c})', 'count(*)'))} as missing_pct from {view_sql(name)}"""
                  for c in SCHEMAS[name]])


def rank_value(c: str, q: float, source: str, index: str | None = None) -> str:
    """The nearest-rank quantile of a column as a scalar subquery."""
    index = index or f"cast(floor((n - 1) * {q} + 0.5) as bigint)"
    return (f"(select max(v) from (select cast({c} as double) as v, row_number() over (order by {c}) - 1 as i, "
            f"count(*) over () as n from {source} where {c} is not null) where i = {index})")


def median(c: str, source: str) -> str:
    low = rank_value(c, 0, source, "(n - 1) // 2")
    high = rank_value(c, 0, source, "n // 2")
    return f"(({low} + {high}) / 2e0)"


def numeric_rows(name: str) -> str:
    s = view_sql(name)
    return union([f"""select '{c}' as "column", count({c}) as "count", {r(f'avg({c})')} as mean,
  {r(f'stddev_samp({c})')} as std, {r(f'min({c})')} as "min", {r(rank_value(c, .25, s))} as "25%",
  {r(rank_value(c, .5, s))} as "50%", {r(rank_value(c, .75, s))} as "75%", {r(f'max({c})')} as "max"
from {s}""" for c in columns_of(name, *NUMERIC)])


def quantile_rows(name: str) -> str:
    s = view_sql(name)
    return union([f"""select '{c}' as "column", {r(rank_value(c, .25, s))} as "25%",
  {r(rank_value(c, .5, s))} as "50%", {r(rank_value(c, .75, s))} as "75%", {r(median(c, s))} as median"""
                  for c in columns_of(name, *NUMERIC)])


def wide_quantiles() -> str:
    source = "(select " + ", ".join(f"l_extendedprice + l_partkey * {i} as c{i}" for i in range(64)) + " from lineitem)"
    return union([f"""select 'c{i}' as "column", {r(rank_value(f'c{i}', .25, source))} as "25%",
  {r(rank_value(f'c{i}', .5, source))} as "50%", {r(rank_value(f'c{i}', .75, source))} as "75%",
  {r(median(f'c{i}', source))} as median""" for i in range(64)])


def wide_correlations() -> str:
    """One row of a corr for each pair, unpivoted."""
    source = ", ".join(f"case when (o_orderkey + {i}) % {i + 2} <> 0 then o_totalprice + o_custkey * {i * i}e0 end as c{i}" for i in range(72))
    pairs = [(i, j) for i in range(72) for j in range(i, 72)]
    one = ", ".join(f"corr(c{i}, c{j})" for i, j in pairs)
    both = ", ".join(f"('c{a}', 'c{b}')" for i, j in pairs for a, b in dict.fromkeys([(i, j), (j, i)]))
    places = ", ".join(str(k) for k, (i, j) in enumerate(pairs, 1) for _ in dict.fromkeys([(i, j), (j, i)]))
    return f"""with one as (select [{one}] as held from (select {source} from orders)),
names as (select unnest([{both}]) as pair, unnest([{places}]) as place)
select pair[1] as column_a, pair[2] as column_b, {r('held[place]')} as corr from names, one""".replace("pair[1]", "struct_extract(pair, 1)").replace("pair[2]", "struct_extract(pair, 2)")


def shape_rows(name: str) -> str:
    s = view_sql(name)
    parts = []
    for c in columns_of(name, *NUMERIC):
        unique = f"(count(distinct {c}) + {big(f'count(*) > count({c})')})"
        skew = (f"case when stddev_samp({c}) > 0 then (avg({c}) - {median(c, s)}) / stddev_samp({c}) "
                "else 0e0 end")
        parts.append(f"""select '{c}' as "column", count({c}) as non_null, {unique} as "unique",
  {r(f'case when count({c}) > 0 then {unique} / cast(count({c}) as double) else 0e0 end')} as unique_ratio,
  {r(f'case when count({c}) > 0 then sum(case when {c} = 0 then 1 else 0 end) * 100e0 / count({c}) end')} as zero_pct,
  {r(f'case when count({c}) > 0 then {skew} end')} as approx_skew,
  (count({c}) = 0 or {unique} <= 1) as is_constant from {s}""")
    return union(parts)


def duplicates(name: str) -> str:
    cols = ", ".join(SCHEMAS[name])
    return f"""select {big('sum(n)')} as "rows",
  {big('coalesce(sum(case when n > 1 then n end), 0)')} as duplicate_rows,
  {r(pct('coalesce(sum(case when n > 1 then n end), 0)', 'sum(n)'))} as duplicate_row_pct
from (select count(*) as n from {view_sql(name)} group by {cols})"""


def bytes_of(c: str, kind: str) -> str:
    if kind in WIDTHS:
        return f"count({c}) * {WIDTHS[kind]}"
    if kind == "array<float>":
        return f"coalesce(sum(len({c}) * 4), 0)"
    return f"coalesce(sum(strlen({c})), 0)"


def size_rows(name: str) -> str:
    return union([f"""select '{c}' as "column", {big(bytes_of(c, t))} as bytes from {view_sql(name)}"""
                  for c, t in SCHEMAS[name].items()])


def overview_row(name: str, source: str | None = None, total: str | None = None) -> str:
    source = source or view_sql(name)
    cols = SCHEMAS[name]
    missing = " + ".join(f"count(*) - count({c})" for c in cols)
    size = " + ".join(bytes_of(c, t) for c, t in cols.items())
    total = total or "count(*)"
    dup = (f"(select coalesce(sum(case when n > 1 then n end), 0) from (select count(*) as n from {source} "
           f"group by {', '.join(cols)}))")
    return f"""select {total} as "rows", {total} as rows_total, count(*) as rows_sample,
  {total} > count(*) as sampled, {big(len(cols))} as "columns", {big(missing)} as missing_cells,
  {r(pct(f'({missing})', f'(count(*) * {len(cols)})'))} as missing_cell_pct, {big(dup)} as duplicate_rows,
  {r(pct(dup, 'count(*)'))} as duplicate_row_pct, {big(size)} as memory_bytes_estimate from {source}"""


def row_nulls(name: str) -> str:
    cols = list(SCHEMAS[name])
    count = " + ".join(f"case when {c} is null then 1 else 0 end" for c in cols)
    return f"select ({count}) as nulls, ({count}) / {len(cols)}e0 * 100e0 as p from {view_sql(name)}"


def row_missing(name: str) -> str:
    q = {}
    for label, share in (("p50", .5), ("p90", .9), ("p99", .99)):
        q[label] = (f"(select p from (select p, row_number() over (order by p) - 1 as i, count(*) over () as n "
                    f"from per_row) where i = cast(floor((n - 1) * {share} + 0.5) as bigint))")
    return f"""with per_row as ({row_nulls(name)}),
one as (select {r('min(p)')} as min_null_pct, {r('max(p)')} as max_null_pct, {r('avg(p)')} as mean_null_pct,
  {r(q['p50'])} as p50_null_pct, {r(q['p90'])} as p90_null_pct, {r(q['p99'])} as p99_null_pct from per_row)
"""


def row_missingness(name: str) -> str:
    levels = ", ".join(f"({t})" for t in (0, 10, 25, 50, 75, 90, 100))
    return row_missing(name) + f"""select {big('t.level')} as threshold_null_pct_ge,
  (select count(*) from per_row where p >= t.level) as "rows", one.*
from (values {levels}) as t(level), one"""


def correlation_rows(name: str) -> str:
    cols = columns_of(name, *NUMERIC)
    parts = []
    for a in cols:
        for b in cols:
            value = f"case when isnan(corr({a}, {b})) then null else corr({a}, {b}) end"
            if a == b:
                value = f"case when stddev_samp({a}) > 0 then 1e0 end"
            parts.append(f"select '{a}' as column_a, '{b}' as column_b, {r(value)} as corr "
                         f"from {view_sql(name)}")
    return union(parts)


def correlation_matrix(name: str) -> str:
    cols = columns_of(name, *NUMERIC)
    picks = ", ".join(f"max(case when column_b = '{c}' then corr end) as {c}" for c in cols)
    return f"select column_a as \"column\", {picks} from ({correlation_rows(name)}) group by column_a"


def uniqueness_rows(name: str, source: str | None = None) -> str:
    return union([f"""select '{c}' as "column", count(distinct {c}) as unique_non_null,
  count(distinct {c}) + {big(f'count(*) > count({c})')} as unique_including_null_as_value
from {source or view_sql(name)}""" for c in SCHEMAS[name]])


def key_candidates(name: str) -> str:
    named = " or ".join(f"contains(lower(\"column\"), '{p}')" for p in KEY_PARTS)
    place = " ".join(f"when '{c}' then {i}" for i, c in enumerate(SCHEMAS[name]))
    return f"""with s as (select *, cast("unique" as double) / nullif(non_null, 0) as ratio,
    case "column" {place} end as pos from ({schema_rows(name)})),
c as (select *, case when non_null >= 50 and null_pct <= 30 and ratio >= 0.98 then 'unique_ratio'
    when {named} then 'name' end as source from s),
o as (select *, row_number() over (order by case when source = 'name' then 1 else 0 end,
    case when source = 'name' then 0 else -ratio end, case when source = 'name' then pos else 0 end,
    "column") as priority from c where source is not null)
select priority, "column", source, {r('ratio')} as unique_ratio from o"""


def key_rows(name: str, keys: list[str]) -> str:
    return union([f"""select '{k}' as key_column, count(*) as unique_keys,
  {r(f'(select count(*) from {view_sql(name)}) / cast(count(*) as double)')} as avg_rows_per_key,
  max(n) as max_rows_per_key, {big('sum(case when n > 1 then 1 else 0 end)')} as repeated_keys,
  {big('sum(case when n > 1 then n else 0 end)')} as rows_in_repeated_keys,
  {r('sum(case when n > 1 then 1 else 0 end) * 100e0 / count(*)')} as repeated_keys_pct
from (select {k}, count(*) as n from {view_sql(name)} where {k} is not null group by {k})"""
                  for k in keys])


def key_top(name: str, keys: list[str], k: int = 10) -> str:
    return union([f"""(select '{c}' as key_column, cast({c} as varchar) as "key", count(*) as rows_per_key
from {view_sql(name)} where {c} is not null group by {c} order by count(*) desc, cast({c} as varchar) limit {k})"""
                  for c in keys])


def topk(name: str, cols: list[str], k: int = 20) -> str:
    return union([f"""(select '{c}' as "column", v as "value", count(*) as "count",
  {r(f'count(*) * 100e0 / (select count(*) from {view_sql(name)})')} as pct_of_rows
from (select coalesce(regexp_replace({c}, '^\\s+$', ''), '<NULL>') as v from {view_sql(name)})
group by v order by count(*) desc, v limit {k})""" for c in cols])


def text_rows(name: str) -> str:
    parts = []
    for c in columns_of(name, "string"):
        lengths = f"(select length({c}) as len from {view_sql(name)}) as lengths"
        parts.append(f"""select '{c}' as "column", count({c}) as non_null, count(*) - count({c}) as "null",
  {big(f"coalesce(sum(case when {c} = '' then 1 else 0 end), 0)")} as empty_string,
  {big(f"coalesce(sum(case when regexp_full_match({c}, '\\s*') then 1 else 0 end), 0)")} as whitespace_only,
  {r(f'avg(length({c}))')} as avg_len, {big(f'min(length({c}))')} as min_len,
  {r(rank_value('len', .5, lengths))} as p50_len, {r(rank_value('len', .9, lengths))} as p90_len,
  {big(f'max(length({c}))')} as max_len from {view_sql(name)}""")
    return union(parts)


def list_shares(name: str) -> str:
    """(column, separator, rows_with_separator_pct) of the list-like columns."""
    parts = [f"""select '{c}' as "column", count(case when length({c}) > 500 then 1 end) * 100e0 / greatest(count({c}), 1) as long_share,
  avg(case when contains({c}, ';') then 1e0 when {c} is not null then 0e0 end) * 100e0 as semicolons,
  avg(case when contains({c}, '|') then 1e0 when {c} is not null then 0e0 end) * 100e0 as pipe,
  avg(case when contains({c}, ',') then 1e0 when {c} is not null then 0e0 end) * 100e0 as comma
from {view_sql(name)}""" for c in columns_of(name, "string")]
    return f"""select "column", case when semicolons >= pipe and semicolons >= comma then ';'
  when pipe >= comma then '|' else ',' end as "separator",
  greatest(semicolons, pipe, comma) as share from ({union(parts)})
where greatest(semicolons, pipe, comma) >= 20 and long_share <= 10"""


def list_detect(name: str) -> str:
    return f"""select "column", "separator", {r('share')} as rows_with_separator_pct from ({list_shares(name)})"""


def list_items(name: str, column: str, sep: str) -> str:
    items = f"(select len(string_split({column}, '{sep}')) as items from {view_sql(name)}) as per_cell"
    return f"""select l."column", l."separator", {r('l.share')} as rows_with_separator_pct,
  {r(f'(select avg(items) from {items})')} as avg_items,
  {big(rank_value('items', .5, items))} as p50_items, {big(rank_value('items', .9, items))} as p90_items,
  {big(f'(select max(items) from {items})')} as max_items from ({list_shares(name)}) l"""


def list_tokens(name: str, column: str, sep: str) -> str:
    return f"""select '{column}' as "column", token, count(*) as "count" from (
  select t as token from (
    select regexp_replace(unnest(string_split({column}, '{sep}')), '^\\s+|\\s+$', '', 'g') as t
    from {view_sql(name)}) where t <> '')
group by token order by count(*) desc, token limit 30"""


def categorical_decisions(name: str) -> str:
    cols = columns_of(name, "string")
    longest = union([f"select '{c}' as \"column\", count(case when length({c}) > 500 then 1 end) * 100e0 / greatest(count({c}), 1) as long_share from {view_sql(name)}"
                     for c in cols])
    return f"""with reasons as (select s."column", s.dtype,
  case when l."column" is not null then 'skipped_listlike' when m.long_share > 10 then 'skipped_long_text'
    when s.non_null >= 50 and s.null_pct <= 50 and s."unique" / cast(s.non_null as double) >= 0.98
    then 'skipped_high_uniqueness' else '' end as reason
  from ({schema_rows(name)}) s join ({longest}) m on s."column" = m."column"
  left join ({list_shares(name)}) l on s."column" = l."column")
select "column", dtype, case when reason = '' then 'profiled' else 'skipped' end as decision, reason
from reasons"""


def year_rows(name: str, rename: dict[str, str] | None = None) -> str:
    rename = rename or {}
    cols = [c for c in SCHEMAS[name] if any(p in rename.get(c, c) for p in NAME_PARTS)]
    if rename:
        cols = list(rename)
    return union([f"""select '{rename.get(c, c)}' as "column", {big('min(y)')} as min_year,
  {big('max(y)')} as max_year, count(y) as year_hits
from (select cast(nullif(regexp_extract(cast({c} as varchar), '{YEAR}', 1), '') as int) as y
  from {view_sql(name)})""" for c in cols])


def warnings(name: str) -> str:
    return f"""with o as ({overview_row(name)}), m as ({missing_rows(name)}), s as ({shape_rows(name)})
select 'empty_dataset' as rule, cast(null as varchar) as "column",
  'Dataset is empty (0 rows or 0 columns).' as warning from o where "rows" = 0 or "columns" = 0
union all select 'missing_cells', null, 'High overall missingness (>= 50% missing cells).'
from o where missing_cell_pct >= 50
union all select 'duplicate_rows', null, 'High duplicate row rate (>= 10%).' from o where duplicate_row_pct >= 10
union all select 'column_missing', "column",
  printf('Column ''%s'' has >= 80%% missing (%.2f%%).', "column", missing_pct)
from (select * from m where missing_pct >= 80)
union all select 'column_constant', "column", printf('Column ''%s'' is constant (unique<=1).', "column")
from (select * from s where is_constant)"""


def cards(name: str, profiled: list[str]) -> str:
    top = (f"""(select "column", "value" as top_value, "count" as top_count from (select *, row_number() over
      (partition by "column" order by "count" desc, "value") as place from ({topk(name, profiled)})) where place = 1)"""
           if profiled else "(select '' as \"column\", '' as top_value, cast(0 as bigint) as top_count where false)")
    return f"""select s.*, n.mean, n.std, n."min", n."25%" as p25, n."50%" as p50, n."75%" as p75, n."max",
  t.empty_string, t.whitespace_only, t.avg_len, t.min_len, t.p50_len, t.p90_len, t.max_len,
  u.unique_non_null, u.unique_including_null_as_value, c.top_value, c.top_count
from ({schema_rows(name)}) s left join ({numeric_rows(name)}) n on s."column" = n."column"
left join ({text_rows(name)}) t on s."column" = t."column"
left join ({uniqueness_rows(name)}) u on s."column" = u."column" left join {top} c on s."column" = c."column\""""


def histogram(name: str, bins: int = 12) -> str:
    parts = []
    for c in columns_of(name, *NUMERIC):
        parts.append(f"""select '{c}' as "column", g.bin, {r('e.lo + g.bin * e.w')} as low,
  {r('e.lo + (g.bin + 1) * e.w')} as high, count(v.x) as "count"
from (select cast(range as bigint) as bin from range({bins})) g
cross join (select lo, case when hi = lo then 1e0 else (hi - lo) / {bins} end as w from
  (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from {view_sql(name)})) e
left join (select x, least({bins - 1}, cast(floor((x - lo) / case when hi = lo then 1e0 else (hi - lo) / {bins} end)
    as bigint)) as bin from (select cast({c} as double) as x from {view_sql(name)} where {c} is not null),
    (select cast(min({c}) as double) as lo, cast(max({c}) as double) as hi from {view_sql(name)})) v
  on v.bin = g.bin group by all""")
    return union(parts)


# --- samples and names ------------------------------------------------------------------------

def drawn(source: str, key: str, n: int) -> str:
    return f"select * from {source} order by md5(concat('42:', cast({key} as varchar))), {key} limit {n}"


def drawn_by_json(source: str, n: int) -> str:
    fields = ", ".join(f"'{c}', {c}" for c in SCHEMAS[source])
    return f"(select * from {view_sql(source)} order by md5(concat('42:', cast(json_object({fields}) as varchar))) limit {n})"


SLUG = (r"regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s', '_', 'g'), "
        r"'[^\p{{L}}\p{{N}}_-]', '', 'g')")


def slug(expr: str) -> str:
    return f"coalesce(nullif(substring({SLUG.format(expr)}, 1, 60), ''), 'dataset')"


# --- sources ----------------------------------------------------------------------------------

HEADER = ("okey", "col_2", "status", "status__1", "col_5", "status__1__1")
SHEET_ROWS = """select cast(o_orderkey as varchar) as okey, cast(o_custkey as varchar) as col_2,
  o_orderstatus as status,
  case when o_orderpriority <> '1-URGENT' then cast(o_totalprice as varchar) end as status__1,
  case when o_orderpriority <> '1-URGENT' then cast(o_orderdate as varchar) end as col_5,
  case when o_orderpriority <> '1-URGENT' then o_orderpriority end as status__1__1 from orders"""


# --- catalog ----------------------------------------------------------------------------------

def sid(name: str) -> str:
    return f"substring(sha1('lake/{name}::sheet=None'), 1, 8)"


def ids(name: str) -> str:
    return f"{sid(name)} as dataset_id, '{name}' as dataset_name, '' as sheet_name"


def catalog_facts() -> str:
    """One row per column of the catalog."""
    parts = []
    for name, cols in SCHEMAS.items():
        for pos, (c, t) in enumerate(cols.items()):
            kind = "numeric" if t in NUMERIC else "text" if t == "string" else "other"
            year = "cast(null as integer)"
            if any(p in c for p in NAME_PARTS):
                year = f"cast(nullif(regexp_extract(cast({c} as varchar), '{YEAR}', 1), '') as int)"
            parts.append(f"""select {ids(name)}, {pos} as pos, '{c}' as "column", '{t}' as dtype, '{kind}' as kind,
  count(*) as "rows", count({c}) as non_null, count(distinct {c}) + {big(f'count(*) > count({c})')} as "unique",
  min({year}) as min_year, max({year}) as max_year, count({year}) as year_hits, {big(bytes_of(c, t))} as bytes
from {view_sql(name)}""")
    return f"select *, {pct('\"rows\" - non_null', '\"rows\"')} as null_pct, cast(\"unique\" as double) / nullif(non_null, 0) as ratio from ({union(parts)})"


def catalog_index() -> str:
    dups = union([f"""select '{name}' as dataset_name, count(*) as "rows",
  (select coalesce(sum(n), 0) from (select count(*) as n from {view_sql(name)} group by {', '.join(cols)}
   having count(*) > 1)) as dup from {view_sql(name)}""" for name, cols in SCHEMAS.items()])
    return f"""select f.dataset_id, concat(f.dataset_id, '__', f.dataset_name, '__sheet-None') as dataset_dir,
  concat('lake/', f.dataset_name) as source_path, f.dataset_name, f.sheet_name, d."rows",
  d."rows" as rows_sample, false as sampled, count(*) as "columns",
  {pct('sum(f."rows" - f.non_null)', 'sum(f."rows")')} as missing_cell_pct,
  {pct('d.dup', 'd."rows"')} as duplicate_row_pct, {big('sum(f.bytes)')} as memory_bytes_estimate
from facts f join ({dups}) d on f.dataset_name = d.dataset_name
group by f.dataset_id, f.dataset_name, f.sheet_name, d."rows", d.dup"""


def with_facts(sql: str, index: bool = False) -> str:
    ctes = f"facts as ({catalog_facts()})"
    if index:
        ctes += f", idx as ({catalog_index()})"
    return f"with {ctes}\n{sql}"


IDS = "dataset_id, dataset_name, sheet_name"
HOTSPOTS = f"""select {IDS}, "column", null_pct as missing_pct from (select *, row_number() over
  (partition by dataset_id order by null_pct desc, "column") as place from facts)"""
CONSTANT = "kind = 'numeric' and (non_null = 0 or \"unique\" <= 1)"
RICH = "kind = 'text' and non_null >= 200 and null_pct <= 50 and ratio >= 0.5"
BUCKETS = ", ".join(f"count(case when kind = '{k}' then 1 end) as {k}_cols_est"
                    for k in ("numeric", "text", "bool", "other"))
TEMPORAL = f"""select {IDS}, count(case when year_hits > 0 then 1 end) as datetime_cols_detected,
  {big('min(min_year)')} as min_year, {big('max(max_year)')} as max_year from facts group by {IDS}"""
KEYLIKE = f"""select {IDS}, string_agg("column", ', ' order by "column") as high_uniqueness_cols from
  (select *, row_number() over (partition by dataset_id order by "column") as place from facts
   where non_null >= 50 and null_pct <= 30 and ratio >= 0.98) group by {IDS}"""
CATALOG_WARNINGS = f"""select {IDS}, 'empty_dataset' as rule, cast(null as varchar) as "column",
  'Dataset is empty (0 rows or 0 columns).' as warning from idx where "rows" = 0 or "columns" = 0
union all select {IDS}, 'missing_cells', null, 'High overall missingness (>= 50% missing cells).'
from idx where missing_cell_pct >= 50
union all select {IDS}, 'duplicate_rows', null, 'High duplicate row rate (>= 10%).'
from idx where duplicate_row_pct >= 10
union all select {IDS}, 'column_missing', "column",
  printf('Column ''%s'' has >= 80%% missing (%.2f%%).', "column", null_pct)
from (select *, row_number() over (partition by dataset_id order by "rows" - non_null desc, "column") as place
  from facts where null_pct >= 80)
union all select {IDS}, 'column_constant', "column", printf('Column ''%s'' is constant (unique<=1).', "column")
from (select *, row_number() over (partition by dataset_id order by "column") as place
  from facts where {CONSTANT})"""


def row_quantiles() -> str:
    parts = []
    for name in SCHEMAS:
        at = {q: (f"(select p from (select p, row_number() over (order by p) - 1 as i, count(*) over () as n from "
                  f"({row_nulls(name)})) where i = cast(floor((n - 1) * {q} + 0.5) as bigint))")
              for q in (.5, .9, .99)}
        parts.append(f"""select '{name}' as dataset_name, {r('min(p)')} as row_min_null_pct,
  {r(at[.5])} as row_p50_null_pct, {r(at[.9])} as row_p90_null_pct, {r(at[.99])} as row_p99_null_pct,
  {r('max(p)')} as row_max_null_pct from ({row_nulls(name)})""")
    return union(parts)


def sources(columns: str) -> str:
    return with_facts(f"""select {columns} from idx
join (select dataset_id, {BUCKETS} from facts group by dataset_id) b on idx.dataset_id = b.dataset_id
join ({TEMPORAL}) t on idx.dataset_id = t.dataset_id
left join ({KEYLIKE}) k on idx.dataset_id = k.dataset_id
join ({row_quantiles()}) rm on idx.dataset_name = rm.dataset_name""", True)


def rounded_index(alias: str = "idx") -> str:
    return f"""{alias}.dataset_id, {alias}.source_path, {alias}.dataset_name, {alias}.sheet_name,
  {alias}."rows", {alias}.rows_sample, {alias}.sampled, {alias}."columns", 'ok' as status,
  {r(f'{alias}.missing_cell_pct')} as missing_cell_pct, {r(f'{alias}.duplicate_row_pct')} as duplicate_row_pct"""


def nearest_of(column: str, q: float) -> str:
    return (f"(select v from (select {column} as v, row_number() over (order by {column}) - 1 as i, "
            f"count(*) over () as n from idx) where i = cast(floor((n - 1) * {q} + 0.5) as bigint))")


def oracle_sql() -> dict[str, str]:
    header_values = ", ".join(f"({i}, '{n}')" for i, n in enumerate(HEADER))
    types = {"okey": "bigint", "col_2": "bigint", "status": "string", "status__1": "double",
             "col_5": "timestamp_ntz", "status__1__1": "string"}
    sample = f"({drawn(view_sql('dirty_orders'), 'o_orderkey', 2000)}) as dirty_orders"
    orders_sample = f"({drawn('orders', 'o_orderkey', 3000)}) as orders"
    sql = {
        "header_promotion": f"""select 'orders.xlsx' as path, o_orderstatus as sheet, cast(2 as bigint) as header_row,
  cast(h.pos as integer) as pos, h.name from (select distinct o_orderstatus from orders)
  cross join (values {header_values}) as h(pos, name)""",
        "header_repair": r"""with words as (select item_id, w.pos - 1 as pos,
    regexp_replace(w.cell, '^\s+|\s+$', '', 'g') as cell
  from (select item_id, unnest(string_split(text, ' ')) as cell,
      generate_subscripts(string_split(text, ' '), 1) as pos from benchmark) w),
named as (select item_id, pos, case when cell = '' then concat('col_', cast(pos + 1 as varchar)) else cell end as name
  from words),
counted as (select *, row_number() over (partition by item_id, lower(name) order by pos) - 1 as seen from named)
select item_id, cast(pos as integer) as pos,
  case when seen > 0 then concat(name, '__', cast(seen as varchar)) else name end as name from counted""",
        "ragged_rows": SHEET_ROWS,
        "infer_column_types": union([f"""select '{c}' as "column", case when count({c}) = 0 then 'string'
  when count({c}) = count(case when regexp_full_match({c}, '[+-]?\\d{{1,18}}') then 1 end) then 'bigint'
  when count({c}) = count(case when regexp_full_match({c}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') then 1 end)
    then 'double'
  when count({c}) = count(case when lower({c}) in ('true', 'false') then 1 end) then 'boolean'
  when count({c}) = count(try_cast({c} as timestamp)) then 'timestamp_ntz' else 'string' end as "type"
from ({SHEET_ROWS})""" for c in types]),
        "typed_rows": f"""select cast(okey as bigint) as okey, cast(col_2 as bigint) as col_2, status,
  {r('status__1')} as status__1, cast(col_5 as timestamp) as col_5, status__1__1 from ({SHEET_ROWS})""",
        "sheet_datasets": f"""select 'orders' as name, status as sheet, count(*) as "rows",
  count(status__1) as status__1, cast(6 as bigint) as "columns" from ({SHEET_ROWS}) group by status""",
        "container_columns": f"""with s as ({SHEET_ROWS}), c as (unpivot (select status as sheet, {', '.join(f'case when {c} is null then 0 else 1 end as {c}' for c in types)} from s)
  on {', '.join(types)} into name "column" value held),
t as (values {', '.join(f"('{c}', {i}, '{t}')" for i, (c, t) in enumerate(types.items()))})
select 'orders.xlsx' as path, sheet, cast(t.col1 as bigint) as pos, c."column", case when sum(held) = 0 then 'string' else t.col2 end as "type", {big('sum(held)')} as non_null
from c join t on t.col0 = c."column" group by sheet, t.col1, c."column", t.col2
union all select 'orders.xlsx', 'head', pos, name, 'string', 0 from (values (0, 'only'), (1, 'a header')) as h(pos, name)""",
        "container_tables": """select 'orders.xlsx' as path, o_orderstatus as sheet, cast(6 as bigint) as "columns",
  count(*) filter (o_orderkey + 3 <= 1002) as "rows", bool_or(o_orderkey + 3 > 1002) as truncated from orders group by o_orderstatus
union all select 'orders.xlsx', 'blank', 0, 0, false""",
        "report_families": union([f"""select '{n}' as dataset_name, {sid(n)} as dataset_id, * from ({missing_rows(n)})""" for n in ("dirty_orders", "judged_documents", "customer", "labels")]),
        "folder_tables": """select 'orders' as name, 'parquet' as format, true as in_parts, 'o_orderstatus' as partitions, count(*) as "rows", cast(6 as bigint) as "columns" from orders
union all select 'customer', 'csv', true, '', count(*), 5 from customer union all select 'part', 'json', true, '', count(*), 6 from part""",
        "written_reports": f"""select format, concat(substring(sha1('lake/orders::sheet=None'), 1, 8), '__orders__sheet-None') as folder,
  u.*, cast(1 as bigint) as files_found, (select count(*) from orders) as total_rows
from (values ('csv'), ('json'), ('parquet')) as f(format), ({uniqueness_rows('orders')}) as u""",
        "file_inventory": union([f"""select '{t}.parquet' as file, true as has_bytes, count(*) as "rows",
  cast({len(TABLES[t])} as bigint) as "columns" from {t}""" for t in TABLES]),
        "json_key_inventory": """select event_type, count(*) as documents,
  cast(sum(len(json_keys(props))) as bigint) as json_keys, cast(0 as bigint) as json_items
from events group by event_type""",
        "sample_exact_n": drawn("orders", "o_orderkey", 1000),
        "head_sample": """select * from lineitem
order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice limit 500""",
        "preview": f"select * from {view_sql('dirty_orders')} order by o_orderkey limit 20",
        "sampled_overview": overview_row("dirty_orders", sample, "(select count(*) from orders)"),
        "dataset_names": f"""select page_id, substring(sha1(concat(url, '::sheet=None')), 1, 8) as id,
  substring(sha1(concat(url, '::sheet=Sheet 1')), 1, 8) as sheet_id,
  {slug("concat('  ', url, ' x ')")} as slug from pages""",
        "overview": overview_row("dirty_orders"),
        "overview_dup_customers": overview_row("dup_customers"),
        "duplicate_rows": duplicates("narrow_lineitem"),
        "duplicate_rows_wide": duplicates("dup_customers"),
        "duplicate_rows_lineitem": duplicates("lineitem"),
        "duplicate_rows_embeddings": duplicates("embeddings"),
        "schema_profile": schema_rows("dirty_orders"),
        "schema_profile_lineitem": schema_rows("lineitem"),
        "schema_profile_documents": schema_rows("documents"),
        "unique_exact": union([f"""select '{c}' as "column", count(distinct {c}) as unique_non_null from lineitem"""
                               for c in TABLES["lineitem"]]),
        "unique_approx": union([f"""select '{c}' as "column", count(distinct {c}) as unique_non_null,
  true as within_3pct from lineitem""" for c in TABLES["lineitem"]]),
        "unique_sample": schema_rows("orders", orders_sample),
        "max_unique_sample": uniqueness_rows("judged_documents", drawn_by_json("judged_documents", 150)),
        "missingness": missing_rows("dirty_orders"),
        "missingness_judged_documents": missing_rows("judged_documents"),
        "row_missingness": row_missingness("dirty_orders"),
        "row_missingness_quantiles": row_missing("judged_documents") + "select * from one",
        "row_null_counts": f"""select o_orderkey, {big('nulls')} as null_count, {r('p')} as null_pct from (
  select o_orderkey, n as nulls, n / 8e0 * 100e0 as p from (select o_orderkey, {' + '.join(
      f'case when {c} is null then 1 else 0 end' for c in SCHEMAS['dirty_orders'])} as n
  from {view_sql('dirty_orders')}))""",
        "dtype_counts": union([f"select '{t}' as dtype, cast({n} as bigint) as \"count\" from lineitem having count(*) > 0"
                               for t, n in (("bigint", 3), ("int", 1), ("double", 4), ("string", 2),
                                            ("timestamp_ntz", 1))]),
        "numeric_summary": numeric_rows("dirty_orders"),
        "numeric_summary_lineitem": numeric_rows("lineitem"),
        "numeric_quantiles": quantile_rows("lineitem"),
        "numeric_quantiles_narrowed": quantile_rows("lineitem"),
        "distribution_shape": shape_rows("dirty_orders"),
        "distribution_shape_lineitem": shape_rows("lineitem"),
        "numeric_histogram": histogram("lineitem"),
        "numeric_histogram_dirty": histogram("dirty_orders"),
        "correlations": correlation_rows("dirty_orders"),
        "correlations_lineitem": correlation_rows("lineitem"),
        "correlations_wide": wide_correlations(),
        "correlation_matrix": correlation_matrix("judged_documents"),
        "uniqueness": uniqueness_rows("dirty_orders"),
        "uniqueness_orders": uniqueness_rows("orders"),
        "key_candidates": key_candidates("dirty_orders"),
        "key_candidates_customer": key_candidates("customer"),
        "key_duplicates": key_rows("dirty_orders", ["o_orderkey", "cust_id"]),
        "key_duplicates_lineitem": key_rows("lineitem", ["l_orderkey", "l_partkey", "l_suppkey"]),
        "key_top_repeated": key_top("dirty_orders", ["o_orderkey", "cust_id"]),
        "key_document": f"""with k as ({key_rows('dirty_orders', ['o_orderkey', 'cust_id'])})
select case key_column when 'o_orderkey' then cast(0 as bigint) else 1 end as place, key_column as candidate, key_column, unique_keys, avg_rows_per_key, max_rows_per_key from k""",
        "key_summary": f"""select '["o_orderkey","cust_id"]' as candidates, cast(2 as bigint) as entries,
  max(n) as second_max from (select cust_id, count(*) as n from {view_sql('dirty_orders')}
  where cust_id is not null group by cust_id)""",
        "categorical_columns": categorical_decisions("dirty_orders"),
        "categorical_columns_documents": categorical_decisions("documents"),
        "categorical_topk": topk("dirty_orders", ["sparse_status", "priority"]),
        "frequent_values": union([f"""(select '{c}' as "column", cast({c} as varchar) as "value", count(*) as "count",
  row_number() over (order by count(*) desc, cast({c} as varchar)) as place from {view_sql('dirty_orders')}
  where {c} is not null group by {c} order by place limit 5)""" for c in ("sparse_status", "tags", "cust_id", "o_orderkey")]),
        "key_top_repeated_many": key_top("orders", ["o_orderkey", "o_custkey"], 5000),
        "quality_warnings_empty": union([f"""select {rule} as rule, {name} as "column", {said} as warning
where not exists (select 1 from orders where o_orderkey < 0)""" for rule, name, said in [
            ("'empty_dataset'", "cast(null as varchar)", "'Dataset is empty (0 rows or 0 columns).'"),
            *[("'column_constant'", f"'{c}'", f"'Column ''{c}'' is constant (unique<=1).'") for c in columns_of("orders", *NUMERIC)]]]),
        "categorical_topk_part": topk("part", ["p_name", "p_brand", "p_type"]),
        "text_profile": text_rows("dirty_orders"),
        "text_profile_documents": text_rows("documents"),
        "text_profile_pages": text_rows("pages"),
        "listlike_detect": list_detect("dirty_orders"),
        "listlike_detect_benchmark": list_detect("benchmark"),
        "listlike_items": list_items("dirty_orders", "tags", ";"),
        "listlike_tokens": list_tokens("dirty_orders", "tags", ";"),
        "listlike_tokens_benchmark": list_tokens("benchmark", "text", ","),
        "temporal_coverage": year_rows("orders"),
        "temporal_coverage_dirty": year_rows("dirty_orders"),
        "temporal_coverage_token": year_rows("orders", {"o_orderdate": "order_date"}),
        "quality_warnings": warnings("dirty_orders"),
        "numeric_quantiles_wide": wide_quantiles(),
        "csv_round_trip": "select * from documents",
        "catalog_with_failures": """select 'good' as dataset_name, count(*) as "rows", cast(6 as bigint) as "columns", true as ok
from orders union all select 'broken', null, null, false""",
        "quality_warnings_sparse": warnings("sparse_orders"),
        "quality_warnings_dup_customers": warnings("dup_customers"),
        "column_profile": cards("dirty_orders", ["sparse_status", "priority"]),
        "column_profile_lineitem": cards("lineitem", ["l_returnflag", "l_linestatus"]),
        "datasets_index": with_facts(f"""select {rounded_index()}, idx.dataset_dir, memory_bytes_estimate from idx""", True),
        "catalog_totals": with_facts(f"""select count(distinct dataset_id) as files_found,
  count(distinct dataset_id) as datasets_processed, {big('sum("rows")')} as total_rows,
  {big('sum("columns")')} as total_columns, cast(0 as bigint) as datasets_failed from idx""", True),
        "dtype_composition": with_facts(f"""select dtype, count(*) as "count",
  {r('count(*) * 100e0 / (select count(*) from facts)')} as pct from facts group by dtype"""),
        "type_buckets": with_facts(f"select {IDS}, {BUCKETS} from facts group by {IDS}"),
        "high_uniqueness": with_facts(KEYLIKE),
        "high_cardinality": with_facts(f"""select {IDS}, "column", dtype, non_null, "unique", {r('ratio')} as unique_ratio,
  {r('null_pct')} as null_pct from (select *, row_number() over (partition by dataset_id order by ratio desc,
  "column") as place from facts where {RICH})"""),
        "missing_hotspots": with_facts(f"""select {IDS}, "column", {r('missing_pct')} as missing_pct from ({HOTSPOTS})
order by missing_pct desc, dataset_name, "column\""""),
        "high_missing_columns": with_facts(f"""select {IDS}, "column", {r('missing_pct')} as missing_pct from ({HOTSPOTS})
where missing_pct >= 80 order by missing_pct desc, dataset_name, "column\""""),
        "constant_columns": with_facts(f"""select {IDS}, "column" from (select *, row_number() over
  (partition by dataset_id order by "column") as place from facts where {CONSTANT})"""),
        "catalog_temporal": with_facts(f"select * from ({TEMPORAL}) where datetime_cols_detected > 0"),
        "catalog_warnings": with_facts(CATALOG_WARNINGS, True),
        "sources_table": sources(f"""{rounded_index()}, memory_bytes_estimate, numeric_cols_est, text_cols_est,
  bool_cols_est, other_cols_est, datetime_cols_detected, min_year, max_year,
  coalesce(high_uniqueness_cols, '') as high_uniqueness_cols, row_min_null_pct, row_p50_null_pct,
  row_p90_null_pct, row_p99_null_pct, row_max_null_pct"""),
        "top_datasets": sources("""idx.dataset_id, idx.dataset_name, idx.sheet_name, idx."rows", idx.rows_sample,
  idx.sampled, idx."columns", """ + f"""{r('idx.missing_cell_pct')} as missing_cell_pct,
  {r('idx.duplicate_row_pct')} as duplicate_row_pct, numeric_cols_est, text_cols_est,
  datetime_cols_detected, min_year, max_year""") + ' order by idx."rows" desc, idx.dataset_name limit 20',
        "catalog_missing_stats": with_facts("select " + ", ".join(
            f"{r(f'avg({c})')} as avg_{c}, {r(f'median({c})')} as p50_{c}, {r(nearest_of(c, .9))} as p90_{c}"
            for c in ("missing_cell_pct", "duplicate_row_pct")) + " from idx", True),
        "catalog_search": with_facts(f"""select {rounded_index()}, idx.dataset_dir, memory_bytes_estimate from idx
where (contains(lower(dataset_name), 'orders') or contains(lower(source_path), 'orders')) and "rows" >= 100""", True),
        "missing_pct_buckets": with_facts("""select cast(g.range as bigint) as bucket, g.range * 10e0 as low,
  (g.range + 1) * 10e0 as high, count(idx.dataset_id) as "count" from range(10) g
left join idx on least(9, cast(floor(missing_cell_pct / 10) as bigint)) = g.range group by g.range""", True),
        "hotspot_matrix": f"""select {IDS}, "column", {r('missing_pct / 100e0')} as share
from ({with_facts(HOTSPOTS)}) where missing_pct > 0""",
        "master_summary": with_facts(f""", w as ({CATALOG_WARNINGS}), n as (
  select 'datasets' as part, (select count(*) from idx) as entries
  union all select 'global_dtype_counts', (select count(distinct dtype) from facts)
  union all select 'top_missing_hotspots', (select count(*) from ({HOTSPOTS}))
  union all select 'high_missing_columns', (select count(*) from ({HOTSPOTS}) where missing_pct >= 80)
  union all select 'high_cardinality_columns', (select count(*) from facts where {RICH})
  union all select 'constant_columns', (select count(*) from facts where {CONSTANT})
  union all select 'temporal_coverage', (select count(*) from ({TEMPORAL}) where datetime_cols_detected > 0)
  union all select 'quality_warnings', (select count(*) from w))
select {big('(select sum("rows") from idx)')} as total_rows, n.* from n""", True).replace(")\n, w", "), w"),
        "run_notes": """select 'orders' as dataset, concat('Profiled on a sample of 100 rows (of ',
  cast(count(*) as varchar), ' total) using strategy=random.') as note from orders
union all select 'pages', concat('Profiled on a sample of 100 rows (of ', cast(count(*) as varchar),
  ' total) using strategy=random.') from pages having count(*) > 100
union all select 'benchmark', concat('Profiled on a sample of 100 rows (of ', cast(count(*) as varchar),
  ' total) using strategy=random.') from benchmark having count(*) > 100
union all select 'region', 'Not enough numeric columns for correlation.' from region having count(*) > 0
union all select 'pages', 'Not enough numeric columns for correlation.' from pages having count(*) > 0
union all select 'benchmark', 'Not enough numeric columns for correlation.' from benchmark having count(*) > 0""",
    }
    for name in ("lineitem", "documents", "embeddings", "events"):
        sql[f"logical_size_bytes_{name}"] = size_rows(name)
    sql["master_document"] = sql["sources_table"]
    return sql
