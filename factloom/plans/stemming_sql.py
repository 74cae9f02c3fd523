"""The English stemmer as a chain of DuckDB selects, for the oracle: written from the algorithm's steps apart from the Python version."""

from ..functions import stemming as tables

_LIST = lambda words: ", ".join(f"'{w}'" for w in words)
_CASES = lambda of, pairs: f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"
_ENDS = lambda of, words: f"regexp_extract({of}, '({'|'.join(words)})$', 1)"  # noqa: E731  the leftmost match is the longest suffix
_CUT = lambda of, n: f"left({of}, length({of})::int - {n})"
_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "regexp_matches({}, '^[aeiouy][^aeiouy]$|[^aeiouy][aeiouy][^aeiouywxY]$')"


def stems_sql(terms: str) -> str:
    """CTEs, the last one ``stems`` (t, stem), for a table (t) of different terms."""
    start = " ".join(f"WHEN starts_with(y, '{w}') THEN {len(w)}" for w in tables.LONG_STARTS)
    return f"""z0 AS (SELECT t, regexp_replace(regexp_replace(t, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS y FROM {terms}),
z1 AS (SELECT *, CASE {start} WHEN regexp_matches(y, '{_REGION}') THEN length(regexp_extract(y, '{_REGION}')) ELSE length(y) END AS p1 FROM z0),
z2 AS (SELECT *, CASE WHEN regexp_matches(substr(y, p1 + 1), '{_REGION}') THEN p1 + length(regexp_extract(substr(y, p1 + 1), '{_REGION}')) ELSE length(y) END AS p2,
 CASE WHEN y LIKE '%sses' THEN {_CUT("y", 2)} WHEN regexp_matches(y, 'ie[ds]$') THEN CASE WHEN length(y) > 4 THEN {_CUT("y", 2)} ELSE {_CUT("y", 1)} END
  WHEN y LIKE '%us' OR y LIKE '%ss' THEN y WHEN y LIKE '%s' AND regexp_matches({_CUT("y", 2)}, '[aeiouy]') THEN {_CUT("y", 1)} ELSE y END AS a FROM z1),
z3 AS (SELECT *, {_ENDS("a", tables.VERBAL)} AS e FROM z2),
z4 AS (SELECT *, {_CUT("a", "length(e)::int")} AS b FROM z3),
z5 AS (SELECT *, CASE WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(b) >= p1 THEN b || 'ee' ELSE a END WHEN e = '' OR NOT regexp_matches(b, '[aeiouy]') THEN a
  WHEN regexp_matches(b, '(at|bl|iz)$') THEN b || 'e' WHEN right(b, 2) IN ({_LIST(tables.DOUBLES)}) THEN {_CUT("b", 1)}
  WHEN length(b) <= p1 AND {_SHORT.format("b")} THEN b || 'e' ELSE b END AS c FROM z4),
z6 AS (SELECT *, CASE WHEN length(c) > 2 AND regexp_matches(c, '[^aeiouy][yY]$') THEN {_CUT("c", 1)} || 'i' ELSE c END AS d FROM z5),
z7 AS (SELECT *, {_ENDS("d", tables.STEP_2)} AS e2 FROM z6),
z8 AS (SELECT *, CASE WHEN e2 <> '' AND length(d) - length(e2) >= p1 AND (e2 <> 'ogi' OR d LIKE '%logi') AND (e2 <> 'li' OR regexp_matches(d, '[{tables.BEFORE_LI}]li$'))
  THEN {_CUT("d", "length(e2)::int")} || {_CASES("e2", tables.STEP_2)} ELSE d END AS f FROM z7),
z9 AS (SELECT *, {_ENDS("f", tables.STEP_3)} AS e3 FROM z8),
z10 AS (SELECT *, CASE WHEN e3 <> '' AND length(f) - length(e3) >= CASE WHEN e3 = 'ative' THEN p2 ELSE p1 END THEN {_CUT("f", "length(e3)::int")} || {_CASES("e3", tables.STEP_3)} ELSE f END AS g FROM z9),
z11 AS (SELECT *, {_ENDS("g", tables.STEP_4)} AS e4 FROM z10),
z12 AS (SELECT *, CASE WHEN e4 <> '' AND length(g) - length(e4) >= p2 AND (e4 <> 'ion' OR regexp_matches(g, '[st]ion$')) THEN {_CUT("g", "length(e4)::int")} ELSE g END AS h FROM z11),
z13 AS (SELECT *, CASE WHEN h LIKE '%e' AND (length(h) - 1 >= p2 OR length(h) - 1 >= p1 AND NOT {_SHORT.format(_CUT("h", 1))}) OR h LIKE '%ll' AND length(h) - 1 >= p2 THEN {_CUT("h", 1)} ELSE h END AS i FROM z12),
stems AS (SELECT t, CASE WHEN length(t) <= 2 THEN t WHEN t IN ({_LIST(tables.SPECIAL)}) THEN {_CASES("t", tables.SPECIAL)} WHEN a IN ({_LIST(tables.KEPT_AFTER_PLURAL)}) THEN a ELSE replace(i, 'Y', 'y') END AS stem FROM z13)"""
