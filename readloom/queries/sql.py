"""The same results in SQL, for an independent engine over the same tables."""

from __future__ import annotations

_ENDS = "chr(13) || chr(10)"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _line(c: str) -> str:
    return f"rtrim(coalesce({c}, ''), {_ENDS})"


def _qual(q: str, s: str) -> str:
    return f"CASE WHEN {q} IS NULL THEN repeat('K', length({_line(s)})) ELSE {_line(q)} END"


SE = f"se AS (SELECT DISTINCT read_id, {_line('name')} AS name, {_line('seq')} AS seq, coalesce(rtrim(strand, {_ENDS}), '+') AS strand, {_qual('qual', 'seq')} AS qual FROM reads_se)"
PE = f"pe AS (SELECT DISTINCT read_id, {_line('name')} AS name, {_line('s1')} AS s1, {_qual('q1', 's1')} AS q1, {_line('s2')} AS s2, {_qual('q2', 's2')} AS q2 FROM reads_pe)"
LR = f"lr AS (SELECT DISTINCT read_id, {_line('name')} AS name, {_line('seq')} AS seq, {_qual('qual', 'seq')} AS qual FROM long_reads)"
ONCE = f"once AS (SELECT DISTINCT read_id, upper(trim(seq, {_WHITE})) AS seq FROM reads_se)"


def _below(q: int) -> str:
    return "'" + "".join(map(chr, range(33, 33 + q))).replace("'", "''") + "'"


def _q(n: int, col: str = "qual") -> str:
    return f"length(translate({col}, {_below(n)}, ''))"


def _gc(c: str = "seq", letters: str = "GCgc") -> str:
    return f"(length({c}) - length(translate({c}, '{letters}', '')))"


def _code(s: str, q: str) -> str:
    return f"CASE WHEN length({s}) >= 500 THEN 3 WHEN length({s}) < 15 THEN 2 WHEN (length({s}) - {_q(15, q)}) * 100 > 40 * length({s}) THEN 4 WHEN length({s}) - length(translate({s}, 'N', '')) > 5 THEN 1 ELSE 0 END"


_TOTALS = f"""count(*) AS reads, CAST(coalesce(sum(length(seq)), 0) AS BIGINT) AS bases, CAST(coalesce(sum({_q(20)}), 0) AS BIGINT) AS q20_bases, CAST(coalesce(sum({_q(30)}), 0) AS BIGINT) AS q30_bases,
 CAST(coalesce(sum({_gc()}), 0) AS BIGINT) AS gc_bases, round(avg(length(seq)), 6) AS mean_length, CAST(max(length(seq)) AS INTEGER) AS max_length"""

_BASES = "b AS (SELECT pos, upper(substr(seq, CAST(pos + 1 AS BIGINT), 1)) AS base, greatest(0, ascii(substr(qual, CAST(pos + 1 AS BIGINT), 1)) - 33) AS q FROM (SELECT seq, qual, unnest(range(0, length(seq))) AS pos FROM se))"

_KMER = "k AS (SELECT upper(substr(seq, CAST(i AS BIGINT), 5)) AS kmer FROM (SELECT seq, unnest(range(1, length(seq) - 3)) AS i FROM se))"


def _at(c: str, i: str) -> str:
    return f"ascii(substr({c}, CAST({i} AS BIGINT), 1))"


def _sum4(i: str) -> str:
    return " + ".join(_at("qual", f"{i} + {j}") for j in range(1, 5))


_INT = "CAST({} AS INTEGER)"

_CUT5 = f"""WITH {SE}, a AS (SELECT *, length(seq) AS n, coalesce(list_filter(range(0, greatest(0, length(seq) - 4)), lambda s: {_sum4('s')} >= 212)[1], length(seq) - 4) AS s0 FROM se),
 b AS (SELECT *, CASE WHEN s0 > 0 THEN s0 + 3 ELSE s0 END AS s1 FROM a),
 c AS (SELECT *, s1 + length(regexp_extract(substr(seq, CAST(greatest(s1, 0) + 1 AS BIGINT)), '^N*')) AS s2 FROM b),
 d AS (SELECT *, n - 4 > 0 AND n - s2 > 0 AND s2 < n - 1 AS ok FROM c)
SELECT read_id, CASE WHEN ok THEN substr(seq, CAST(s2 + 1 AS BIGINT)) ELSE seq END AS seq, CASE WHEN ok THEN substr(qual, CAST(s2 + 1 AS BIGINT)) ELSE qual END AS qual, ok AS trimmed_ok FROM d"""

_CUT3 = f"""WITH {SE}, a AS (SELECT *, length(seq) AS n, coalesce(list_max(list_filter(range(4, greatest(4, length(seq))), lambda t: {_sum4('t - 3')} >= 212)), 3) AS t0 FROM se),
 b AS (SELECT *, CASE WHEN t0 < n - 1 THEN t0 - 3 ELSE t0 END AS t1 FROM a),
 c AS (SELECT *, length(rtrim(substr(seq, 1, CAST(greatest(t1, -1) + 1 AS BIGINT)), 'N')) AS kept FROM b),
 d AS (SELECT *, n - 4 > 0 AND kept > 0 AND n > 1 AS ok FROM c)
SELECT read_id, CASE WHEN ok THEN substr(seq, 1, kept) ELSE seq END AS seq, CASE WHEN ok THEN substr(qual, 1, kept) ELSE qual END AS qual, ok AS trimmed_ok FROM d"""

_POLYG = f"""WITH {SE}, a AS (SELECT read_id, seq, length(seq) AS n, coalesce(list_filter(range(0, length(seq)), lambda i: length(replace(right(seq, CAST(i + 1 AS BIGINT)), 'G', '')) > 5
   OR (length(replace(right(seq, CAST(i + 1 AS BIGINT)), 'G', '')) > (i + 1) // 8 AND i >= 9))[1], length(seq)) AS e FROM se),
 b AS (SELECT *, right(seq, CAST(least(e + 1, n) AS BIGINT)) AS tail FROM a)
SELECT read_id, CASE WHEN e < 10 THEN seq WHEN strpos(tail, 'G') = 0 THEN substr(seq, 1, n - 1) ELSE substr(seq, 1, n - length(tail) + strpos(tail, 'G') - 1) END AS seq FROM b"""


def _wrong(b: str) -> str:
    others = "".join(x for x in "ACGT" if x != b) + "acgtn"
    return f"(i + 1 - length(translate(right(seq, CAST(i + 1 AS BIGINT)), '{others}', '')))"


_POLYX = f"""WITH {SE}, a AS (SELECT read_id, seq, length(seq) AS n, list_filter(range(0, length(seq)), lambda i: {' AND '.join(f"{_wrong(b)} > least(5, (i + 1) // 8)" for b in 'ATCG')} AND (i >= 8 OR i + 1 >= 9))[1] AS p FROM se),
 b AS (SELECT *, right(seq, CAST(p + 1 AS BIGINT)) AS tail FROM a),
 c AS (SELECT *, [{', '.join(f"length(translate(tail, '{''.join(x for x in 'ACGT' if x != b)}acgtn', ''))" for b in 'ATCG')}] AS counts FROM b),
 d AS (SELECT *, substr('ATCG', list_position(counts, list_max(counts)), 1) AS best FROM c)
SELECT read_id, CASE WHEN p IS NULL OR p + 1 < 10 THEN seq WHEN strpos(tail, best) = 0 THEN seq ELSE substr(seq, 1, CAST(n - p - 1 + strpos(tail, best) - 1 AS BIGINT)) END AS seq FROM d"""

_ADAPTER = f"""WITH {SE}, ad AS (SELECT DISTINCT upper(seq) AS a FROM adapters WHERE ord = 0),
 p AS (SELECT read_id, seq, a, length(seq) AS n, length(a) AS m,
   list_filter(range(CASE WHEN length(a) >= 16 THEN -4 WHEN length(a) >= 12 THEN -3 WHEN length(a) >= 8 THEN -2 ELSE 0 END, length(seq) - 4), lambda x:
     least(length(seq) - x, length(a)) - greatest(0, -x) > 0 AND
     hamming(substr(seq, CAST(greatest(x, 0) + 1 AS BIGINT), CAST(least(length(seq) - x, length(a)) - greatest(0, -x) AS BIGINT)), substr(a, CAST(greatest(0, -x) + 1 AS BIGINT), CAST(least(length(seq) - x, length(a)) - greatest(0, -x) AS BIGINT)))
       <= least(length(seq) - x, length(a)) // 8)[1] AS pos FROM se, ad),
 cut AS (SELECT read_id, CASE WHEN pos IS NULL THEN seq ELSE substr(seq, 1, CAST(greatest(pos, 0) AS BIGINT)) END AS kept, CAST(CASE WHEN pos IS NULL THEN 0 WHEN pos < 0 THEN m + pos ELSE n - pos END AS BIGINT) AS removed, seq FROM p)"""

_RC = "translate(reverse({}), 'ACGTacgt', 'TGCATGCA')"

_OVERLAP = f"""{PE}, r AS (SELECT *, {_RC.format('s2')} AS rc, length(s1) AS n1, length(s2) AS n2 FROM pe),
 f AS (SELECT *, list_filter(range(0, n1 - 30), lambda o: hamming(substr(s1, CAST(o + 1 AS BIGINT), CAST(least(50, n1 - o, n2) AS BIGINT)), substr(rc, 1, CAST(least(50, n1 - o, n2) AS BIGINT))) <= 5)[1] AS ahead FROM r WHERE n1 > 0 AND n2 > 0),
 g AS (SELECT *, CASE WHEN ahead IS NULL THEN list_filter(range(0, n2 - 30), lambda k: hamming(substr(s1, 1, CAST(least(50, n1, n2 - k) AS BIGINT)), substr(rc, CAST(k + 1 AS BIGINT), CAST(least(50, n1, n2 - k) AS BIGINT))) <= 5)[1] END AS behind FROM f),
 ov AS (SELECT *, ahead IS NOT NULL OR behind IS NOT NULL AS overlapped, CASE WHEN ahead IS NOT NULL THEN ahead WHEN behind IS NOT NULL THEN -behind ELSE 0 END AS o,
   CASE WHEN ahead IS NOT NULL THEN least(n1 - ahead, n2) WHEN behind IS NOT NULL THEN least(n1, n2 - behind) ELSE 0 END AS size FROM g
   UNION ALL SELECT *, NULL, NULL, false, 0, 0 FROM r WHERE n1 = 0 OR n2 = 0),
 sized AS (SELECT *, CASE WHEN NOT overlapped THEN 512 ELSE least(512, CASE WHEN o > 0 THEN n1 + n2 - size ELSE size END) END AS ins FROM ov)"""

_REST = "regexp_extract(name, '^.*:(..+)$', 1)"
_FIRST = f"CASE WHEN length(name) < 5 THEN '' WHEN regexp_matches({_REST}, '^[^+]*\\+..') THEN regexp_extract({_REST}, '^([^+]*)\\+..', 1) ELSE {_REST} END"
_LAST = "CASE WHEN length(name) < 5 THEN '' ELSE regexp_extract(name, '^.*[:+](..+)$', 1) END"


def _tag(umi: str, prefix: str = "", always: bool = False) -> str:
    tag = f"':' || {repr(prefix + '_') + ' || ' if prefix else ''}{umi}"
    tagged = f"CASE WHEN strpos(name, ' ') > 0 THEN substr(name, 1, strpos(name, ' ') - 1) || {tag} || substr(name, strpos(name, ' ')) ELSE name || {tag} END"
    return tagged if always else f"CASE WHEN {umi} <> '' THEN {tagged} ELSE name END"


def _cut(c: str, n: str) -> str:
    return f"substr({c}, CAST({n} + 1 AS BIGINT)) AS {c}"


def _n(s: str, k: int, skip: int, less: int = 1) -> str:
    return f"greatest(0, least(length({s}) - {less}, least(length({s}), {k}) + {skip}))"


def _followed(source: str, rows: str) -> str:
    return f"""WITH {source}, w AS ({rows}), v AS (SELECT * FROM w WHERE NOT regexp_matches(key12, '[^ATCG]') AND NOT regexp_matches(word32, '[^ATCG]') AND length(key12) = 12 AND length(word32) = 32),
 c AS (SELECT key12, translate(word32, 'ATCG', '0123') AS t, word32, count(*) AS n, min(gc) AS gc FROM v GROUP BY key12, word32),
 m AS (SELECT key12, word32, n, gc FROM c QUALIFY row_number() OVER (PARTITION BY key12 ORDER BY t) = 1)"""


_DUP_SE = _followed(SE, f"SELECT substr(seq, 1, 12) AS key12, substr(seq, greatest(0, length(seq) - 37) + 1, 32) AS word32, CAST(floor(255.0 * {_gc('seq', 'GC')} / length(seq) + 0.5) AS INTEGER) AS gc FROM se WHERE length(seq) >= 32")
_DUP_PE = _followed(PE, f"SELECT substr(s1, 1, 12) AS key12, substr(s2, 1, 32) AS word32, CAST(floor(255.0 * ({_gc('s1', 'GC')} + {_gc('s2', 'GC')}) / (length(s1) + length(s2)) + 0.5) AS INTEGER) AS gc FROM pe WHERE length(s1) >= 32 AND length(s2) >= 32")

_HOT = f"""WITH {SE}, o AS (SELECT seq, coalesce(sum(length(seq)) OVER (ORDER BY read_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM se), h AS (SELECT seq FROM o WHERE before < 1510000),
 l AS (SELECT max(length(seq)) AS longest FROM h), k AS (SELECT unnest([10, 20, 40, 100, least(150, longest - 2)]) AS k, longest FROM l),
 w AS (SELECT substr(seq, CAST(i AS BIGINT), CAST(k AS BIGINT)) AS word, k, longest FROM (SELECT seq, k, longest, unnest(range(1, greatest(1, length(seq) - k + 1))) AS i FROM h, k)),
 c AS (SELECT word, count(*) AS n FROM w GROUP BY word, k, longest HAVING count(*) >= CASE WHEN k >= longest - 1 THEN 3 WHEN k >= 100 THEN 5 WHEN k >= 40 THEN 20 WHEN k >= 20 THEN 100 ELSE 500 END)
SELECT word, n FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS x WHERE x.word <> c.word AND length(x.word) > length(c.word) AND contains(x.word, c.word) AND c.n // x.n < 10)"""

_SEEDS = f"""WITH {SE}, w AS (SELECT upper(substr(seq, CAST(i + 1 AS BIGINT), 10)) AS seed FROM (SELECT seq, unnest(range(20, greatest(20, length(seq) - 10))) AS i FROM se))
SELECT seed, count(*) AS n FROM w WHERE NOT regexp_matches(seed, '[^ACGT]') AND NOT starts_with(seed, 'GGGG') AND {_gc('seed', 'GC')} < 8 AND {' AND '.join(f"length(replace(seed, '{b}', '')) > 4" for b in 'ACGT')}
GROUP BY seed ORDER BY n DESC, translate(seed, 'ATCG', '0123') DESC LIMIT 10"""

_ENDS_SQL = f"""WITH {LR}, e AS (SELECT 'head' AS part, substr(seq, 1, 100) AS s, substr(qual, 1, 100) AS q FROM lr UNION ALL SELECT 'tail', right(seq, 100), right(qual, 100) FROM lr),
 b AS (SELECT part, pos, substr(s, CAST(pos + 1 AS BIGINT), 1) AS base, ascii(substr(q, CAST(pos + 1 AS BIGINT), 1)) - 33 AS v FROM (SELECT part, s, q, unnest(range(0, length(s))) AS pos FROM e))
SELECT part, CAST(pos AS INTEGER) AS pos, {', '.join(f"CAST(count(*) FILTER (base = '{b}') AS BIGINT) AS {b.lower()}" for b in 'ATCG')}, CAST(sum(v) AS BIGINT) AS quality_sum, count(*) AS bases FROM b GROUP BY part, pos"""

_TOP5 = f"""WITH {LR}, q AS (SELECT read_id, length(seq) AS length, list_sum(list_transform(range(1, length(qual) + 1), lambda i: {_at('qual', 'i')} - 33)) / length(seq) AS m FROM lr WHERE length(seq) > 0)
SELECT 'quality' AS list, CAST(row_number() OVER (ORDER BY m DESC, read_id) AS INTEGER) AS place, read_id, CAST(length AS INTEGER) AS length, round(m, 6) AS mean_quality FROM q QUALIFY place <= 5
UNION ALL SELECT 'length', CAST(row_number() OVER (ORDER BY length DESC, read_id) AS INTEGER) AS place, read_id, CAST(length AS INTEGER), round(m, 6) FROM q QUALIFY place <= 5"""

_FIELD = '("([^"]|"")*"|[^",\\r\\n]*)'
_PARSE = f"""WITH raw AS (SELECT DISTINCT raw_id, fmt, regexp_replace(coalesce(payload, ''), '\\r?\\n$', '') AS p FROM raw_reads),
 f AS (SELECT raw_id, fmt, p, fmt = 'csv' AND NOT regexp_full_match(p, '{_FIELD}(,{_FIELD})*') AS broken,
   CASE fmt WHEN 'tsv' THEN string_split(p, chr(9)) WHEN 'fastq' THEN regexp_split_to_array(p, '\\r?\\n')
     ELSE list_transform(regexp_extract_all(',' || p, ',{_FIELD}', 1), lambda x: CASE WHEN starts_with(x, '"') THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS l FROM raw),
 g AS (SELECT *, len(l) <> CASE WHEN fmt = 'fastq' THEN 4 ELSE 3 END AS wrong, l[1] AS name, l[2] AS seq, CASE WHEN fmt = 'fastq' THEN l[4] ELSE l[3] END AS qual FROM f),
 h AS (SELECT raw_id, name, seq, qual, CASE WHEN broken THEN 'quoting' WHEN wrong THEN 'columns' WHEN fmt = 'fastq' AND NOT starts_with(l[3], '+') THEN 'separator' WHEN NOT regexp_matches(name, '^@[^\\s]') THEN 'header'
   WHEN NOT regexp_full_match(seq, '[ACGTNacgtn]+') THEN 'seq' WHEN NOT regexp_full_match(qual, '[!-~]*') THEN 'qual' WHEN length(seq) <> length(qual) THEN 'length' END AS reason FROM g)"""

_BIN2 = "translate(qual, {}, {})"


def _bins(edges: tuple[int, ...]) -> str:
    source, target, low = "", "", 33
    for e in [*edges, 93]:
        for c in range(low, min(33 + e, 126) + 1):
            source, target = source + chr(c), target + chr(low)
        low = 34 + e
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"translate(qual, {quote(source)}, {quote(target)})"


#: Both ends with 2 bases off the front and 1 off the tail.
_CUT_BOTH = f"""WITH {SE}, a AS (SELECT *, length(seq) AS n, coalesce(list_filter(range(2, greatest(2, length(seq) - 5)), lambda s: {_sum4('s')} >= 212)[1], length(seq) - 5) AS s0 FROM se),
 b AS (SELECT *, CASE WHEN s0 > 0 THEN s0 + 3 ELSE s0 END AS s1 FROM a),
 c AS (SELECT *, s1 + length(regexp_extract(substr(seq, CAST(greatest(s1, 0) + 1 AS BIGINT)), '^N*')) AS s2, n - 7 > 0 AS ok1 FROM b),
 d AS (SELECT *, ok1 AND n - s2 - 5 > 0 AS ok2, coalesce(list_max(list_filter(range(s2 + 4, greatest(s2 + 4, n - 1)), lambda t: {_sum4('t - 3')} >= 212)), s2 + 3) - 3 AS t1 FROM c),
 e AS (SELECT *, length(rtrim(substr(seq, 1, CAST(greatest(t1, -1) + 1 AS BIGINT)), 'N')) - s2 AS kept FROM d),
 f AS (SELECT *, ok2 AND kept > 0 AND s2 < n - 1 AS ok FROM e)
SELECT read_id, CASE WHEN ok THEN substr(seq, CAST(s2 + 1 AS BIGINT), CAST(greatest(kept, 0) AS BIGINT)) ELSE seq END AS seq, CASE WHEN ok THEN substr(qual, CAST(s2 + 1 AS BIGINT), CAST(greatest(kept, 0) AS BIGINT)) ELSE qual END AS qual, ok AS trimmed_ok FROM f"""

_SPAN = "CAST(least(length(x) - p, length(y)) - greatest(0, -p) AS BIGINT)"
#: Each adapter of the sorted list in turn; with 17 to 256 of them five bases must match.
_ADAPTERS = f"""WITH {SE}, ad AS (SELECT list_sort(list(DISTINCT upper(trim(seq)))) AS l FROM adapters),
 cut AS (SELECT read_id, seq, list_reduce(list_concat([seq], l), lambda x, y: substr(x, 1, CAST(greatest(0, coalesce(list_filter(
   range(CASE WHEN length(y) >= 16 THEN -4 WHEN length(y) >= 12 THEN -3 WHEN length(y) >= 8 THEN -2 ELSE 0 END, length(x) - 5), lambda p:
   {_SPAN} > 0 AND hamming(substr(x, CAST(greatest(p, 0) + 1 AS BIGINT), {_SPAN}), substr(y, CAST(greatest(0, -p) + 1 AS BIGINT), {_SPAN})) <= least(length(x) - p, length(y)) // 8)[1], length(x))) AS BIGINT))) AS kept FROM se, ad)
SELECT read_id, kept AS seq, CAST(length(seq) - length(kept) AS BIGINT) AS removed FROM cut"""

_PLAIN = f"""WITH {SE}, u AS (SELECT read_id, upper(seq) AS u FROM se)
SELECT read_id, regexp_matches(u, '[^ACGT]') AS ambiguous, array_to_string(list_transform(range(1, length(u) + 1), lambda i: CASE WHEN substr(u, CAST(i AS BIGINT), 1) IN ('A', 'C', 'G', 'T') THEN substr(u, CAST(i AS BIGINT), 1)
  ELSE substr('ACGT', CAST(1 + (length(regexp_replace(substr(u, 1, CAST(i AS BIGINT)), '[ACGT]', '', 'g')) - 1) % 4 AS BIGINT), 1) END), '') AS seq FROM u"""


def _mended(own: int) -> str:
    """Bases, qualities and number of corrections of one mate by the other; j is its place from 1, i the place in the overlap."""
    other = 3 - own
    i = "(j - 1 - greatest(o, 0))" if own == 1 else "(n2 - greatest(-o, 0) - j)"
    there = f"(n2 - greatest(-o, 0) - {i})" if own == 1 else f"(greatest(o, 0) + {i} + 1)"
    pair = "translate({}, 'ACGTacgt', 'TGCATGCA')"
    mine, its = f"substr(s{own}, CAST(j AS BIGINT), 1)", f"substr(s{other}, CAST({there} AS BIGINT), 1)"
    differ = f"{mine} <> {pair.format(its)}" if own == 1 else f"{its} <> {pair.format(mine)}"
    when = f"overlapped AND {i} >= 0 AND {i} < size AND {differ} AND {_at(f'q{other}', there)} >= 63 AND {_at(f'q{own}', 'j')} <= 47"
    places = f"range(1, n{own} + 1)"
    text = lambda new, old: f"array_to_string(list_transform({places}, lambda j: CASE WHEN {when} THEN {new} ELSE {old} END), '')"
    return f"{text(pair.format(its), mine)} AS m{own}, {text(f'substr(q{other}, CAST({there} AS BIGINT), 1)', f'substr(q{own}, CAST(j AS BIGINT), 1)')} AS w{own}, len(list_filter({places}, lambda j: {when})) AS c{own}"


def oracle_sql() -> dict[str, str]:
    dup = "SELECT {} FROM m"
    return {
        "p3_found": f"{_PARSE} SELECT raw_id, reason FROM h WHERE reason IS NOT NULL",
        "p3_loaded": f"{_PARSE} SELECT raw_id, name, seq, qual FROM h WHERE reason IS NULL",
        "p4_found": f"WITH {ONCE} SELECT key12 FROM (SELECT substr(seq, 1, 12) AS key12, count(*) AS n FROM once WHERE length(seq) >= 12 GROUP BY 1) WHERE n * 100 > 3 * (SELECT count(DISTINCT read_id) FROM once)",
        "p4_groups": f"WITH {ONCE} SELECT substr(seq, 1, 12) AS key12, count(*) AS n_reads, CAST(sum(length(seq)) AS BIGINT) AS bases, CAST(min(length(seq)) AS INTEGER) AS min_len, CAST(max(length(seq)) AS INTEGER) AS max_len, CAST(sum({_gc('seq', 'GC')}) AS BIGINT) AS gc_bases FROM once WHERE length(seq) >= 12 GROUP BY 1",
        "totals": f"WITH {SE} SELECT {_TOTALS} FROM se",
        "q20_q30": f"WITH {SE}, t AS (SELECT {_TOTALS} FROM se) SELECT q20_bases, q30_bases, round(q20_bases / bases, 9) AS q20_share, round(q30_bases / bases, 9) AS q30_share FROM t",
        "gc_content": f"WITH {SE} SELECT CAST(sum({_gc()}) AS BIGINT) AS gc_bases, round(sum({_gc()}) / sum(length(seq)), 9) AS gc_share FROM se",
        "length_hist": f"WITH {SE} SELECT CAST(length(seq) AS INTEGER) AS length, count(*) AS reads FROM se GROUP BY 1",
        "gc_hist": f"WITH {SE} SELECT CAST({_gc()} * 100 // length(seq) AS INTEGER) AS gc_percent, count(*) AS reads FROM se WHERE length(seq) > 0 GROUP BY 1",
        "mean_quality_hist": f"WITH {SE} SELECT CAST(floor(list_sum(list_transform(range(1, length(qual) + 1), lambda i: greatest(0, {_at('qual', 'i')} - 33))) / length(seq)) AS INTEGER) AS mean_quality, count(*) AS reads FROM se WHERE length(seq) > 0 GROUP BY 1",
        "position_bases": f"WITH {SE}, {_BASES} SELECT CAST(pos AS INTEGER) AS pos, base, count(*) AS n FROM b GROUP BY ALL",
        "position_quality": f"WITH {SE}, {_BASES} SELECT CAST(pos AS INTEGER) AS pos, base, CAST(sum(q) AS BIGINT) AS quality_sum FROM b GROUP BY pos, base",
        "kmer5": f"WITH {SE}, {_KMER} SELECT kmer, count(*) AS n FROM k WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY kmer",
        "kmer5_minmax": f"WITH {SE}, {_KMER}, c AS (SELECT kmer, count(*) AS n FROM k WHERE NOT regexp_matches(kmer, '[^ACGT]') GROUP BY kmer) SELECT min(n) AS least, max(n) AS most FROM c",
        "max_length": f"WITH {SE} SELECT CAST(max(length(seq)) AS INTEGER) AS max_length FROM se WHERE read_id < 262144",
        "every_20th": f"WITH {SE} SELECT read_id, seq FROM se WHERE read_id % 20 = 0",
        "filter_codes": f"WITH {SE} SELECT read_id, {_code('seq', 'qual')} AS code FROM se",
        "filter_summary": f"WITH {SE} SELECT {_code('seq', 'qual')} AS code, count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases FROM se GROUP BY 1",
        "pair_filter": f"WITH {PE} SELECT greatest({_code('s1', 'q1')}, {_code('s2', 'q2')}) AS code, count(*) * 2 AS reads FROM pe GROUP BY 1",
        "trim_fixed": f"WITH {SE}, t AS (SELECT *, length(seq) > 8 AND 5 < length(seq) - 1 AS ok FROM se) SELECT read_id, CASE WHEN ok THEN substr(seq, 6, length(seq) - 8) ELSE seq END AS seq, CASE WHEN ok THEN substr(qual, 6, length(seq) - 8) ELSE qual END AS qual, ok AS trimmed_ok FROM t",
        "cut_5": _CUT5,
        "cut_3": _CUT3,
        "cut_both": _CUT_BOTH,
        "adapter_list_trim": _ADAPTERS,
        "plain_bases": _PLAIN,
        "overlap_correct": f"WITH {_OVERLAP}, mended AS (SELECT read_id, {_mended(1)}, {_mended(2)} FROM ov) SELECT read_id, m1 AS s1, w1 AS q1, m2 AS s2, w2 AS q2, CAST(c1 + c2 AS INTEGER) AS corrected FROM mended",
        "polyg": _POLYG,
        "polyx": _POLYX,
        "adapter_seq_trim": f"{_ADAPTER} SELECT read_id, kept AS seq, removed FROM cut",
        "adapter_counts": f"{_ADAPTER}, c AS (SELECT substr(seq, length(kept) + 1) AS adapter, count(*) AS n FROM cut WHERE removed > 0 GROUP BY 1) SELECT adapter, n FROM c WHERE n > 0.01 * (SELECT sum(n) FROM c)",
        "adapter_list": "SELECT DISTINCT upper(trim(seq)) AS seq FROM adapters",
        "mate_join": f"WITH {PE} SELECT read_id, name, s1, q1, s2, q2 FROM pe",
        "interleave": f"WITH {PE} SELECT read_id, 1 AS mate, name, s1 AS seq, q1 AS qual FROM pe UNION ALL SELECT read_id, 2, name, s2, q2 FROM pe",
        "deinterleave": f"WITH {SE} SELECT a.read_id // 2 AS read_id, a.name, a.seq AS s1, a.qual AS q1, b.seq AS s2, b.qual AS q2 FROM se a JOIN se b ON b.read_id = a.read_id + 1 WHERE a.read_id % 2 = 0",
        "fastq_lines": f"WITH {SE} SELECT read_id, name || chr(10) || seq || chr(10) || strand || chr(10) || qual AS record FROM se",
        "missing_quality": f"SELECT DISTINCT read_id, repeat('K', length({_line('seq')})) AS qual FROM reads_se WHERE qual IS NULL",
        "revcomp": f"WITH {PE} SELECT read_id, {_RC.format('s2')} AS rc2 FROM pe",
        "overlap_full": f"WITH {_OVERLAP} SELECT read_id, overlapped, CAST(o AS INTEGER) AS \"offset\", CAST(size AS INTEGER) AS overlap, CAST(CASE WHEN ahead IS NOT NULL THEN hamming(substr(s1, CAST(o + 1 AS BIGINT), CAST(least(50, size) AS BIGINT)), substr(rc, 1, CAST(least(50, size) AS BIGINT))) WHEN behind IS NOT NULL THEN hamming(substr(s1, 1, CAST(least(50, size) AS BIGINT)), substr(rc, CAST(behind + 1 AS BIGINT), CAST(least(50, size) AS BIGINT))) ELSE 0 END AS INTEGER) AS differences FROM ov",
        "insert_size_hist": f"WITH {_OVERLAP} SELECT CAST(ins AS INTEGER) AS insert_size, count(*) AS pairs FROM sized GROUP BY 1",
        "insert_peak": f"WITH {_OVERLAP} SELECT CAST(ins AS INTEGER) AS peak, count(*) AS pairs FROM sized WHERE ins < 512 GROUP BY 1 ORDER BY pairs DESC, peak LIMIT 1",
        "adapter_overlap_trim": f"WITH {_OVERLAP} SELECT read_id, CASE WHEN o < 0 THEN substr(s1, 1, CAST(size AS BIGINT)) ELSE s1 END AS s1, CASE WHEN o < 0 THEN substr(s2, 1, CAST(size AS BIGINT)) ELSE s2 END AS s2, CAST(CASE WHEN o < 0 THEN n1 - size + n2 - size ELSE 0 END AS INTEGER) AS removed FROM ov",
        "umi_index1": f"WITH {SE} SELECT read_id, seq, {_tag('(' + _FIRST + ')')} AS name, qual FROM se",
        "umi_read1": f"WITH {SE} SELECT read_id, {_tag('substr(seq, 1, 8)', 'UMI')} AS name, {_cut('seq', _n('seq', 8, 2))}, substr(qual, CAST({_n('seq', 8, 2)} + 1 AS BIGINT)) AS qual FROM se",
        "umi_per_index": f"WITH {SE} SELECT read_id, seq, {_tag('(' + _FIRST + ')', always=True)} AS name, qual FROM se",
        "umi_per_read": f"WITH {SE} SELECT read_id, {_tag('substr(seq, 1, 8)', always=True)} AS name, {_cut('seq', _n('seq', 8, 0, 0))}, substr(qual, CAST({_n('seq', 8, 0, 0)} + 1 AS BIGINT)) AS qual FROM se",
        "umi_pair_index1": f"WITH {PE} SELECT read_id, s1, s2, {_tag('(' + _FIRST + ')', 'X')} AS name, q1, q2 FROM pe",
        "umi_pair_index2": f"WITH {PE} SELECT read_id, s1, s2, {_tag('(' + _LAST + ')')} AS name, q1, q2 FROM pe",
        "umi_pair_read2": f"WITH {PE} SELECT read_id, s1, {_cut('s2', _n('s2', 6, 1))}, {_tag('substr(s2, 1, 6)')} AS name, q1, substr(q2, CAST({_n('s2', 6, 1)} + 1 AS BIGINT)) AS q2 FROM pe",
        "umi_pair_per_index": f"WITH {PE} SELECT read_id, s1, s2, {_tag('((' + _FIRST + chr(41) + " || '_' || (" + _LAST + '))', always=True)} AS name, q1, q2 FROM pe",
        "umi_pair_per_read": f"WITH {PE} SELECT read_id, {_cut('s1', _n('s1', 6, 0))}, {_cut('s2', _n('s2', 6, 0))}, {_tag(chr(40) + 'substr(s1, 1, 6)' + " || '_' || substr(s2, 1, 6))", always=True)} AS name, substr(q1, CAST({_n('s1', 6, 0)} + 1 AS BIGINT)) AS q1, substr(q2, CAST({_n('s2', 6, 0)} + 1 AS BIGINT)) AS q2 FROM pe",
        "dup_se": f"{_DUP_SE} {dup.format('key12, word32, n, gc')}",
        "dup_pe": f"{_DUP_PE} {dup.format('key12, word32, n, gc')}",
        "dup_rate": f"{_DUP_SE} SELECT count(*) AS keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS reads, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates, round(coalesce(sum(n - 1) / sum(n), 0.0), 9) AS rate FROM m",
        "dup_hist": f"{_DUP_SE} SELECT least(n, 31) AS copies, count(*) AS keys, round(avg(gc / 255.0), 9) AS mean_gc FROM m GROUP BY 1",
        "hot_sequences": _HOT,
        "adapter_seeds": _SEEDS,
        "tgs_totals": f"WITH {LR} SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, {', '.join(f'CAST(sum({_q(n)}) AS BIGINT) AS q{n}_bases' for n in (5, 10, 15))}, round(avg(length(seq)), 6) AS mean_length, CAST(max(length(seq)) AS INTEGER) AS max_length FROM lr",
        "tgs_head_tail": _ENDS_SQL,
        "tgs_length_hist": f"WITH {LR} SELECT CAST(ceil(length(seq) / 10) AS INTEGER) AS bucket, count(*) AS reads FROM lr GROUP BY 1",
        "tgs_top5": _TOP5,
        "fasta_min_length": "SELECT DISTINCT gid, CAST(length(regexp_replace(coalesce(seq, ''), '\\s', '', 'g')) AS INTEGER) AS length FROM fasta_records WHERE length(regexp_replace(coalesce(seq, ''), '\\s', '', 'g')) >= 200",
        "quality_bins": f"WITH {SE} SELECT read_id, {_bins((4, 13, 20))} AS two_bits, {_bins((13,))} AS one_bit FROM se",
        "pipeline_tgs": f"WITH {LR} SELECT count(*) AS reads, CAST(sum(length(seq)) AS BIGINT) AS bases, {', '.join(f'CAST(sum({_q(n)}) AS BIGINT) AS q{n}_bases' for n in (5, 10, 15))}, round(avg(length(seq)), 6) AS mean_length, CAST(max(length(seq)) AS INTEGER) AS max_length FROM lr",
    }
