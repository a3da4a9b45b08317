"""SQL fragments of the text functions, for the independent engine."""

from __future__ import annotations

from citegrove.functions.rules import FAMILIES, GENERIC_CLASSES
from citegrove.functions.text import SUFFIXES, TAXONOMY_STOPS


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def NORM_TITLE(x: str) -> str:  # noqa: N802
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\[nrt]', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def SQUASH(x: str) -> str:  # noqa: N802
    return f"regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"


def tokens_sql(x: str) -> str:
    stops = ", ".join(f"'{s}'" for s in TAXONOMY_STOPS)
    return f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), lambda t: length(t) > 1 and t not in ({stops})))"


def BM25_TOKENS(x: str) -> str:  # noqa: N802
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9][a-z0-9\-]{{2,}}')"


def STEM(w: str) -> str:  # noqa: N802
    cases = " ".join(f"when length({w}) > {len(s) + 2} and suffix({w}, '{s}') then left({w}, length({w}) - {len(s)})" for s in SUFFIXES)
    cut = f"(case {cases} else {w} end)"
    return f"(case when length({cut}) > 3 and suffix({cut}, 'e') then left({cut}, length({cut}) - 1) else {cut} end)"


def CANON_GENERIC(x: str) -> str:  # noqa: N802
    raw = strip_sql(f"coalesce({x}, '')")
    base = strip_sql(rf"regexp_replace({raw}, '\s*[\(\[][^\)\]]*[\)\]]\s*$', '')")
    cut = f"(case when contains({base}, ':') then {strip_sql(rf'''regexp_split_to_array({base}, '\s*:\s+')[1]''')} else {base} end)"
    return rf"regexp_replace(case when {cut} <> '' then {cut} else {raw} end, '^[ .,;\-]+|[ .,;\-]+$', '', 'g')"


def CANON_MODEL(x: str) -> str:  # noqa: N802
    raw = strip_sql(f"coalesce({x}, '')")
    bare = rf"regexp_replace(regexp_replace({raw}, '\s*[\(\[].*?[\)\]]\s*', ' ', 'g'), '^[ .,;:\-]+|[ .,;:\-]+$', '', 'g')"
    scale = rf"regexp_replace(regexp_replace({bare}, '(?i)\d+\s*x\s*\d+\s*[bm]\b', ' ', 'g'), '(?i)\d+\s*[bm]\b', ' ', 'g')"
    major = rf"regexp_extract({scale}, '(?:^|[^\d.])(\d{{1,2}})(?:\.(\d))?(?:[^\d]|$)', 1)"
    minor = rf"regexp_extract({scale}, '(?:^|[^\d.])(\d{{1,2}})(?:\.(\d))?(?:[^\d]|$)', 2)"
    tier = f"(case when {major} in ('', '0') or try_cast({major} as int) > 20 then '' when {minor} = '5' then {major} || '.5' else {major} end)"
    classes = ", ".join(f"'{c}'" for c in GENERIC_CLASSES)
    rules = " ".join(f"when regexp_matches({raw}, '(?i){p}') then case when {tier} <> '' then '{n}-' || {tier} else '{n}' end" for p, n in FAMILIES)
    return f"case when {raw} = '' or lower({bare}) in ({classes}) or lower({raw}) in ({classes}) then '' {rules} else {CANON_GENERIC(x)} end"


def ALIASES(x: str) -> str:  # noqa: N802
    raw = strip_sql(f"coalesce({x}, '')")
    inner = rf"list_filter(list_transform(regexp_extract_all({raw}, '[\(\[]([^\)\]]{{1,60}})[\)\]]', 1), lambda b: regexp_replace(b, '^\s+|\s+$', '', 'g')), lambda b: b <> '' and not regexp_full_match(b, '[\d.,\s]*[bmkBMK]?') and not contains(b, '/'))"
    rest = SQUASH(rf"regexp_replace({raw}, '\s*[\(\[][^\)\]]*[\)\]]\s*', ' ', 'g')")
    return f"list_sort(list_distinct(list_filter(list_concat(list_concat([{SQUASH(raw)}], list_transform({inner}, lambda b: {SQUASH('b')})), [{rest}]), lambda a: length(a) >= 2)))"
