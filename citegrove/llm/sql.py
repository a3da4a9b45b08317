"""SQL twins of the queries, for an independent engine."""

_FOLD = r"regexp_replace(lower(nfc_normalize(regexp_replace(coalesce({0}, ''), '\\[nrt]', ' ', 'g'))), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"


def _label(label: str) -> str:
    plain = rf"regexp_extract(record, '(?is)(?:^|[|;\n])\s*{label}\s*[:=](.*?)(?:\s*[|;\n]\s*[a-z][a-z _-]*[:=]|$)', 1)"
    quoted = rf"regexp_extract(record, '(?is)\"{label}\"\s*:\s*\"((?:[^\"\\]|\\.)*)\"', 1)"
    return f"case when record like '{{%' then {quoted} else {plain} end"


P3_FOUND = f"""
with f as (
  select hit_id, {_FOLD.format('title')} t, {_FOLD.format(_label('first[ _-]?author'))} a,
         {_FOLD.format(_label('year'))} y, {_FOLD.format(_label('venue'))} v
  from paper_hit
)
select min(hit_id) as hit_id, count(*) as n_copies from f where t <> '' group by t, a, y, v having count(*) >= 2
"""

_VALUE = r"trim(lower(regexp_replace({0}, '[\s\p{{Z}}\x1c-\x1f\x85]+', ' ', 'g')))"

P5_FOUND = f"""
with v as (
  select i.item_id, {_VALUE.format('u.value')} as value from menu_item i, unnest(i.evidence) as u(value) where u.value is not null
), w as (select * from v where value <> ''),
n as (select count(distinct item_id) as n from w),
c as (select value, count(*) as n_occ, count(distinct item_id) as n_rec from w group by value)
select value, n_occ, n_rec, case when n_rec < 3 then 'rare' else 'common' end as mark
from c, n where n_rec < 3 or n_rec * 100 > n * 2
"""

P4_FOUND = f"""
with v as (
  select distinct i.item_id, {_VALUE.format('u.value')} as value from menu_item i, unnest(i.evidence) as u(value) where u.value is not null
), e as (select item_id, value, count(*) over (partition by item_id) as n from v where value <> ''),
es as (select * from e where n >= 3),
d as (
  select distinct item_id, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) as value from menu_item
  where key in ('threats', 'evidence_standards', 'protocols', 'validity_checks')
), ds as (select item_id, value, count(*) over (partition by item_id) as n from d)
select 'evidence' as field, a.item_id as item_a, b.item_id as item_b
from es a join es b on a.value = b.value and a.item_id < b.item_id group by a.item_id, b.item_id, a.n, b.n
having count(*) * 5 >= (a.n + b.n - count(*)) * 3
union all
select 'name', a.item_id, b.item_id
from ds a join ds b on a.value = b.value and a.item_id < b.item_id group by a.item_id, b.item_id, a.n, b.n
having count(*) * 4 >= (a.n + b.n - count(*)) * 3
"""
