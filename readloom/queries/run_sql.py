"""Adapter detection, over-represented sequences and whole runs in SQL: the steps as common table expressions, in order."""

from __future__ import annotations

from readloom.operators import detect, orp
from readloom.queries.sql import _HOT, _OVERLAP, _TOTALS, PE, SE, _code, _gc, _mended, _sum4

_SIMPLE = " AND ".join(f"length(replace(seed, '{b}', '')) > 4" for b in "ACGT")
_CHANGES = "(SELECT count(*) FROM (SELECT unnest(range(1, 10)) AS i) WHERE substr(seed, CAST(i AS BIGINT), 1) <> substr(seed, CAST(i + 1 AS BIGINT), 1))"

#: The head, its seeds with their rank, the texts around them, and the dominant path on either side. Result: table adapter.
DETECT = f"""numbered AS (SELECT upper(seq) AS seq, count(*) OVER w AS n0, coalesce(sum(length(seq)) OVER w, 0) AS b0 FROM se WINDOW w AS (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 head AS MATERIALIZED (SELECT seq FROM numbered WHERE n0 < {detect.HEAD_READS} AND b0 < {detect.HEAD_BASES}),
 seed_places AS (SELECT substr(seq, CAST(i + 1 AS BIGINT), 10) AS seed FROM (SELECT seq, unnest(range(20, greatest(20, length(seq) - 10))) AS i FROM head)),
 seeds AS MATERIALIZED (SELECT seed, count(*) AS n FROM seed_places WHERE NOT regexp_matches(seed, '[^ACGT]') AND NOT starts_with(seed, 'GGGG') AND {_gc('seed', 'GC')} < 8 AND {_SIMPLE} GROUP BY seed),
 ranked AS (SELECT seed, n, row_number() OVER (ORDER BY n DESC, translate(seed, 'ATCG', '0123') DESC) AS rank, n >= 10 AND n * 1048576 >= 20 * (SELECT sum(n) FROM seeds) AS frequent FROM seeds QUALIFY rank <= 10),
 tried AS MATERIALIZED (SELECT seed, rank FROM ranked WHERE rank < (SELECT coalesce(min(rank), 11) FROM ranked WHERE NOT frequent) AND {_CHANGES} >= 3 AND (SELECT count(*) FROM head) >= {detect.LEAST_READS}),
 around AS (SELECT rank, seq, p FROM (SELECT rank, seed, seq, unnest(range(20, greatest(20, length(seq) - 10))) AS p FROM head JOIN tried ON contains(seq, seed)) WHERE substr(seq, CAST(p + 1 AS BIGINT), 10) = seed),
 texts_of AS (SELECT rank, 'after' AS side, substr(seq, CAST(p + 11 AS BIGINT), CAST(least({detect.LONGEST}, length(seq) - 1 - p - 10) AS BIGINT)) AS t FROM around
   UNION ALL SELECT rank, 'before', reverse(substr(seq, CAST(greatest(0, p - {detect.LONGEST_BEFORE}) + 1 AS BIGINT), CAST(least(p, {detect.LONGEST_BEFORE}) AS BIGINT))) FROM around),
 prefixes AS (SELECT rank, side, substr(t, 1, CAST(i AS BIGINT)) AS prefix, count(*) AS n FROM (SELECT rank, side, t, unnest(range(1, length(t) + 1)) AS i FROM texts_of) GROUP BY ALL),
 kids AS MATERIALIZED (SELECT rank, side, left(prefix, -1) AS parent, sum(n) AS total, max(n) AS most, arg_max(right(prefix, 1), n) AS letter FROM prefixes GROUP BY ALL),
 walk AS (SELECT rank, side, '' AS path FROM tried, (SELECT unnest(['after', 'before']) AS side)
   UNION ALL SELECT w.rank, w.side, path || letter FROM walk AS w JOIN kids AS k ON k.rank = w.rank AND k.side = w.side AND k.parent = w.path WHERE total >= {detect.OBSERVED} AND most / total >= CAST({detect.DOMINANT} AS DOUBLE)),
 longest_walk AS (SELECT rank, side, arg_max(path, length(path)) AS path FROM walk GROUP BY rank, side),
 ended AS (SELECT l.*, coalesce(k.total, 0) < {detect.OBSERVED} AS leaf FROM longest_walk AS l LEFT JOIN kids AS k ON k.rank = l.rank AND k.side = l.side AND k.parent = l.path),
 candidates AS (SELECT t.rank, left(reverse(b.path) || t.seed || a.path, {detect.LONGEST}) AS text, a.leaf AND b.leaf AS leaf FROM tried AS t JOIN ended AS a ON a.rank = t.rank AND a.side = 'after' JOIN ended AS b ON b.rank = t.rank AND b.side = 'before'),
 decided AS (SELECT rank, leaf, text, {"coalesce(" + ", ".join(f"CASE WHEN starts_with(text, '{k}') THEN '{k}' END" for k in detect.KNOWN) + ")"} AS known FROM candidates),
 adapter AS MATERIALIZED (SELECT coalesce((SELECT coalesce(known, text) FROM decided WHERE known IS NOT NULL OR leaf ORDER BY rank LIMIT 1), '') AS a)"""

#: Hits of hot words in every 20th read: the first window, then each that the one before doesn't hide.
_SCAN = f"""WITH RECURSIVE hot AS ({_HOT}), lengths AS (SELECT DISTINCT length(word) AS k FROM hot), {SE},
 every AS (SELECT row_number() OVER () AS r, seq FROM se WHERE read_id % 20 = 0),
 windows AS (SELECT r, k, i, substr(seq, CAST(i + 1 AS BIGINT), CAST(k AS BIGINT)) AS word FROM (SELECT r, seq, k, unnest(range(0, greatest(1, length(seq) - k))) AS i FROM every, lengths WHERE length(seq) >= k)),
 met AS (SELECT w.r, w.k, list(w.i ORDER BY w.i) AS places FROM windows AS w JOIN hot USING (word) GROUP BY w.r, w.k),
 taken AS (SELECT r, k, places, places[1] AS i FROM met UNION ALL SELECT r, k, places, list_filter(places, lambda x: x > i + k)[1] FROM taken WHERE list_filter(places, lambda x: x > i + k)[1] IS NOT NULL),
 starts AS (SELECT word, i, count(*) AS n FROM taken JOIN windows USING (r, k, i) GROUP BY word, i),
 found AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, string_agg(i || ':' || n, ',' ORDER BY i) AS starts FROM starts GROUP BY word)
SELECT word, n, starts FROM found WHERE n * 20 > CASE length(word) {' '.join(f'WHEN {k} THEN {n}' for k, n in orp.REPORTED)} ELSE {orp.REPORTED_OTHER} END"""


def _ends_cut(source: str) -> str:
    """Both ends cut by quality; only reads of which something is left. Result: cut (all columns, seq and qual cut)."""
    return f"""c1 AS (SELECT *, length(seq) AS n, coalesce(list_filter(range(0, greatest(0, length(seq) - 4)), lambda s: {_sum4('s')} >= 212)[1], length(seq) - 4) AS s0 FROM {source}),
 c2 AS (SELECT *, CASE WHEN s0 > 0 THEN s0 + 3 ELSE s0 END AS s1 FROM c1 WHERE n > 4),
 c3 AS (SELECT *, s1 + length(regexp_extract(substr(seq, CAST(s1 + 1 AS BIGINT)), '^N*')) AS s2 FROM c2),
 c4 AS (SELECT *, coalesce(list_max(list_filter(range(s2 + 4, greatest(s2 + 4, n)), lambda t: {_sum4('t - 3')} >= 212)), s2 + 3) AS t0 FROM c3 WHERE n - s2 - 4 > 0),
 c5 AS (SELECT *, length(rtrim(substr(seq, 1, CAST(CASE WHEN t0 < n - 1 THEN t0 - 2 ELSE t0 + 1 END AS BIGINT)), 'N')) - s2 AS kept FROM c4),
 cut AS (SELECT * REPLACE (substr(seq, CAST(s2 + 1 AS BIGINT), kept) AS seq, substr(qual, CAST(s2 + 1 AS BIGINT), kept) AS qual) FROM c5 WHERE kept > 0 AND s2 < n - 1)"""


def _poly_g(source: str, out: str, seq: str = "seq", qual: str = "qual") -> str:
    others = f"length(replace(right({seq}, CAST(i + 1 AS BIGINT)), 'G', ''))"
    return f"""{out}1 AS (SELECT *, coalesce(list_filter(range(0, length({seq})), lambda i: {others} > 5 OR ({others} > (i + 1) // 8 AND i >= 9))[1], length({seq})) AS ge FROM {source}),
 {out}2 AS (SELECT *, CAST(CASE WHEN ge < 10 THEN length({seq}) WHEN strpos(right({seq}, CAST(least(ge + 1, length({seq})) AS BIGINT)), 'G') = 0 THEN length({seq}) - 1
   ELSE length({seq}) - least(ge + 1, length({seq})) + strpos(right({seq}, CAST(least(ge + 1, length({seq})) AS BIGINT)), 'G') - 1 END AS BIGINT) AS gl FROM {out}1),
 {out} AS (SELECT * EXCLUDE (ge, gl) REPLACE (left({seq}, gl) AS {seq}, left({qual}, gl) AS {qual}) FROM {out}2)"""


def _poly_x(source: str, out: str) -> str:
    def wrong(b: str) -> str:
        others = "".join(x for x in "ACGT" if x != b) + "acgtn"
        return f"(i + 1 - length(translate(right(seq, CAST(i + 1 AS BIGINT)), '{others}', '')))"

    counts = ", ".join(f"length(translate(xt, '{''.join(x for x in 'ACGT' if x != b)}acgtn', ''))" for b in "ATCG")
    return f"""{out}1 AS (SELECT *, list_filter(range(0, length(seq)), lambda i: {' AND '.join(f"{wrong(b)} > least(5, (i + 1) // 8)" for b in 'ATCG')} AND i >= 8)[1] AS xp FROM {source}),
 {out}2 AS (SELECT *, right(seq, CAST(xp + 1 AS BIGINT)) AS xt FROM {out}1),
 {out}3 AS (SELECT *, [{counts}] AS xc FROM {out}2),
 {out}4 AS (SELECT *, strpos(xt, substr('ATCG', list_position(xc, list_max(xc)), 1)) AS xa FROM {out}3),
 {out}5 AS (SELECT *, CAST(CASE WHEN xp IS NULL OR xp < 9 OR xa = 0 THEN length(seq) ELSE length(seq) - xp - 2 + xa END AS BIGINT) AS xl FROM {out}4),
 {out} AS (SELECT * EXCLUDE (xp, xt, xc, xa, xl) REPLACE (left(seq, xl) AS seq, left(qual, xl) AS qual) FROM {out}5)"""


_SPAN = "CAST(least(length(x) - p, length(y)) - greatest(0, -p) AS BIGINT)"


def _adapters(source: str, out: str, listed: str, match: str) -> str:
    """Each adapter of a list (an expression over one row of `ad`) in turn; empty ones do nothing."""
    begin = "CASE WHEN length(y) >= 16 THEN -4 WHEN length(y) >= 12 THEN -3 WHEN length(y) >= 8 THEN -2 ELSE 0 END"
    hit = f"{_SPAN} > 0 AND hamming(substr(x, CAST(greatest(p, 0) + 1 AS BIGINT), {_SPAN}), substr(y, CAST(greatest(0, -p) + 1 AS BIGINT), {_SPAN})) <= least(length(x) - p, length(y)) // 8"
    return f"""{out}1 AS (SELECT s.*, list_reduce(list_concat([seq], {listed}), lambda x, y: CASE WHEN length(y) < {match} THEN x ELSE substr(x, 1, CAST(greatest(0, coalesce(list_filter(range({begin}, length(x) - {match}), lambda p: {hit})[1], length(x))) AS BIGINT)) END) AS kept_seq FROM {source} AS s, ad),
 {out} AS (SELECT * EXCLUDE (kept_seq) REPLACE (kept_seq AS seq, left(qual, length(kept_seq)) AS qual) FROM {out}1)"""


def _single(listed: bool) -> str:
    """The chain of a single run. Result: passed."""
    lists = "SELECT [a] AS one, (SELECT list_sort(list(DISTINCT upper(trim(seq)))) FROM adapters) AS l FROM adapter"
    steps = [_ends_cut("se"), _poly_g("cut", "pg"), _poly_x("pg", "px"), f"ad AS ({lists})", _adapters("px", "sa", "one", "4")]
    if listed:
        steps.append(_adapters("sa", "la", "l", "(CASE WHEN len(l) > 256 THEN 6 WHEN len(l) > 16 THEN 5 ELSE 4 END)"))
    return f"{SE}, {DETECT}, " + ",\n ".join(steps) + f",\n passed AS (SELECT * FROM {'la' if listed else 'sa'} WHERE {_code('seq', 'qual')} = 0)"


def _paired() -> str:
    """Tails of G, overlap, correction, cut by overlap, filter. Result: passed."""
    pe = f"{PE.replace('pe AS (', 'whole AS (', 1)}, {_poly_g('whole', 'ga', 's1', 'q1')}, {_poly_g('ga', 'pe', 's2', 'q2')}"
    overlap = _OVERLAP.replace(PE, pe, 1)
    return f"""{overlap},
 mended AS (SELECT read_id, name, overlapped AND o < 0 AS short, size, {_mended(1)}, {_mended(2)} FROM ov),
 both_cut AS (SELECT read_id, name, {', '.join(f"CASE WHEN short THEN left({c}, CAST(size AS BIGINT)) ELSE {c} END AS {t}" for c, t in (('m1', 's1'), ('w1', 'q1'), ('m2', 's2'), ('w2', 'q2')))} FROM mended),
 passed AS (SELECT * FROM both_cut WHERE greatest({_code('s1', 'q1')}, {_code('s2', 'q2')}) = 0)"""


def oracle_sql() -> dict[str, str]:
    return {
        "adapter_detect": f"WITH RECURSIVE {SE}, {DETECT} SELECT a AS adapter FROM adapter",
        "overrepresented": _SCAN,
        "pipeline_se": f"WITH RECURSIVE {_single(True)} SELECT read_id, name, seq, strand, qual FROM passed",
        "pipeline_se_report": f"WITH RECURSIVE {_single(False)} SELECT {_TOTALS}, 'before' AS \"when\" FROM se UNION ALL SELECT {_TOTALS}, 'after' FROM passed",
        "pipeline_pe": f"WITH {_paired()} SELECT read_id, name, s1, q1, s2, q2 FROM passed",
    }
