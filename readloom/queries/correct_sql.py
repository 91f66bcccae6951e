"""The error correction in SQL: every stage as common table expressions over the reads, written from the definitions."""

from __future__ import annotations

from readloom.operators.correct import LABEL, bucket_limit
from readloom.queries.sql import SE

#: Constants of the mixing function, modulo 2^64, and how far it shifts.
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))
_STEP = 0x9E3779B97F4A7C15
_LOW64 = "CAST(18446744073709551615 AS UHUGEINT)"
_RC = "translate(reverse({}), 'ACGT', 'TGCA')"
NEAR = 1e-6


def _times(x: str, factor: str) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {factor}) & {_LOW64} AS UBIGINT)"


#: Upper case, every other letter in turn A, C, G, T.
READY = f"""{SE},
 upper_case AS (SELECT read_id, name, qual, upper(seq) AS u FROM se),
 ready AS MATERIALIZED (SELECT read_id, name, qual, CASE WHEN regexp_matches(u, '[^ACGT]') THEN array_to_string(list_transform(range(1, length(u) + 1), lambda i: CASE WHEN substr(u, CAST(i AS BIGINT), 1) IN ('A', 'C', 'G', 'T') THEN substr(u, CAST(i AS BIGINT), 1)
   ELSE substr('ACGT', CAST(1 + (length(regexp_replace(substr(u, 1, CAST(i AS BIGINT)), '[ACGT]', '', 'g')) - 1) % 4 AS BIGINT), 1) END), '') ELSE u END AS seq FROM upper_case)"""


def _bits(word: str) -> str:
    text = word
    for letter, pair in (("A", "00"), ("C", "01"), ("G", "10"), ("T", "11")):
        text = f"replace({text}, '{letter}', '{pair}')"
    return f"CAST(CAST(lpad({text}, 64, '0') AS BIT) AS UBIGINT)"


def _mixed() -> str:
    """Columns x0 (word + map * step) to the hash, one step a table."""
    out = "m0 AS (SELECT sid, map, mask, CAST((CAST(word AS UHUGEINT) + CAST(map AS UHUGEINT) * " + f"CAST({_STEP} AS UHUGEINT)) & {_LOW64} AS UBIGINT) AS x FROM words, (SELECT unnest(range(0, 48)) AS map))"
    for i, (shift, factor) in enumerate(_MIX):
        mixed = _times(f"xor(x, x >> {shift})", f"CAST({factor} AS UHUGEINT)")
        out += f",\n m{i + 1} AS (SELECT sid, map, mask, {mixed} AS x FROM m{i})"
    return out + ",\n least AS (SELECT sid, map, min(xor(x, x >> 31) & mask) AS hash FROM m2 GROUP BY sid, map)"


#: Signatures of different sequences, then of reads.
SIGNATURES = f"""{READY},
 k AS (SELECT CASE WHEN max(length(seq)) < 160 THEN 20 ELSE 32 END AS k FROM ready),
 texts AS MATERIALIZED (SELECT seq, row_number() OVER () AS sid FROM (SELECT DISTINCT seq FROM ready)),
 places AS (SELECT sid, k, substr(seq, CAST(i AS BIGINT), CAST(k AS BIGINT)) AS w FROM (SELECT sid, seq, k, unnest(range(1, length(seq) - k + 2)) AS i FROM texts, k)),
 words AS MATERIALIZED (SELECT DISTINCT sid, least({_bits('w')}, {_bits(_RC.format('w'))}) AS word, CASE WHEN k = 32 THEN CAST(18446744073709551615 AS UBIGINT) ELSE CAST(1099511627775 AS UBIGINT) END AS mask FROM places),
 {_mixed()},
 sigs AS MATERIALIZED (SELECT read_id, map, hash FROM ready JOIN texts USING (seq) JOIN least USING (sid)),
 buckets AS MATERIALIZED (SELECT map, hash, count(*) AS n FROM sigs GROUP BY map, hash)"""


def links(coverage: int) -> str:
    return f"""{SIGNATURES},
 kept_sigs AS MATERIALIZED (SELECT s.* FROM sigs AS s JOIN buckets AS b USING (map, hash) WHERE n BETWEEN 2 AND {bucket_limit(coverage)}),
 links AS MATERIALIZED (SELECT DISTINCT a.read_id AS read_id, b.read_id AS candidate FROM kept_sigs AS a JOIN kept_sigs AS b USING (map, hash) WHERE a.read_id <> b.read_id)"""


PAIRED = "paired AS (SELECT l.read_id, l.candidate FROM links AS l JOIN links AS m ON m.read_id = xor(l.read_id, 1) AND m.candidate = xor(l.candidate, 1))"


def aligned(coverage: int = 30, pairs: bool = False) -> str:
    """All shifts of both directions, the best of each, the better direction, and the limit on mismatches."""
    need = "greatest(30, CAST(floor(length(a) * CAST(0.3 AS DOUBLE)) AS BIGINT))"
    over = "CASE WHEN s >= 0 THEN least(la - s, lc) ELSE least(la, lc + s) END"
    kept = f"""limits AS (SELECT read_id, CASE {' '.join(f"WHEN count(*) FILTER (mismatches / overlap < CAST({t * 0.06!r} AS DOUBLE)) >= {coverage * 0.6!r} THEN CAST({t * 0.06!r} AS DOUBLE)" for t in (2, 3, 4))} END AS most FROM usable GROUP BY read_id),
 aligned AS MATERIALIZED (SELECT u.*, coalesce(mismatches / overlap < most, false) AS kept FROM usable AS u JOIN limits USING (read_id))"""
    if pairs:
        kept = f"{PAIRED},\n aligned AS MATERIALIZED (SELECT u.*, p.read_id IS NOT NULL OR mismatches / overlap < CAST(0.06 AS DOUBLE) AS kept FROM usable AS u LEFT JOIN paired AS p USING (read_id, candidate))"
    return f"""{links(coverage)},
 sides AS (SELECT l.read_id, l.candidate, x.seq AS a, y.seq AS c0 FROM links AS l JOIN ready AS x USING (read_id) JOIN ready AS y ON y.read_id = l.candidate),
 ways AS (SELECT read_id, candidate, a, c0 AS c, false AS reverse FROM sides UNION ALL SELECT read_id, candidate, a, {_RC.format('c0')}, true FROM sides),
 shifts AS (SELECT *, length(a) AS la, length(c) AS lc, {need} AS need, unnest(list_concat(range(0, greatest(1, length(a) - {need} + 1)), range(-1, least(-1, {need} - length(c) - 1), -1))) AS s FROM ways),
 laid AS (SELECT *, CAST({over} AS BIGINT) AS o FROM shifts),
 missed AS (SELECT *, hamming(substr(a, CAST(greatest(s, 0) + 1 AS BIGINT), o), substr(c, CAST(greatest(-s, 0) + 1 AS BIGINT), o)) AS m FROM laid WHERE o >= 5),
 best AS (SELECT read_id, candidate, reverse, min(need) AS need, arg_min({{'s': s, 'o': o, 'm': m}}, (la + lc - 2 * o + m) * 4096 + CASE WHEN s >= 0 THEN s ELSE 2048 - s END) AS b FROM missed WHERE m < o // 5 GROUP BY read_id, candidate, reverse),
 enough AS (SELECT read_id, candidate, reverse, b.s AS s, b.o AS o, b.m AS m FROM best WHERE b.o >= need),
 chosen AS (SELECT read_id, candidate, arg_min({{'r': reverse, 's': s, 'o': o, 'm': m}}, struct_pack(ratio := m / o, longer := -o, forward := NOT reverse)) AS b FROM enough GROUP BY read_id, candidate),
 usable AS MATERIALIZED (SELECT read_id, candidate, b.r AS reverse, CAST(b.s AS INTEGER) AS shift, CAST(b.o AS INTEGER) AS overlap, CAST(b.m AS INTEGER) AS mismatches FROM chosen WHERE b.m / b.o < CAST({4 * 0.06!r} AS DOUBLE)),
 {kept}"""


def _columns(i: int) -> str:
    """Counts, rounded weights, consensus and support of every column of the piles of round i; column 0 is the anchor's first."""
    return f"""rows{i} AS (SELECT read_id, 0 AS shift, text, CAST(1 AS DOUBLE) AS f FROM anchors UNION ALL SELECT read_id, shift, text, f FROM pile{i}),
 bases{i} AS (SELECT read_id, shift + p AS col, substr(text, CAST(p + 1 AS BIGINT), 1) AS base, f FROM (SELECT *, unnest(range(0, length(text))) AS p FROM rows{i})),
 cells{i} AS MATERIALIZED (SELECT read_id, col, base, count(*) AS n, round(sum(f), 9) AS w FROM bases{i} GROUP BY read_id, col, base),
 cols{i} AS MATERIALIZED (SELECT read_id, col, CAST(sum(n) AS BIGINT) AS cover, sum(w) AS total, max(w) / sum(w) AS support, arg_max(base, struct_pack(w := w, first := -ascii(base))) AS top FROM cells{i} GROUP BY read_id, col)"""


def _round(i: int, coverage: int) -> str:
    """Candidates of another region: they disagree with the anchor in its first column where another base is frequent."""
    return f"""{_columns(i)},
 own{i} AS (SELECT a.read_id, c.col, substr(a.text, CAST(c.col + 1 AS BIGINT), 1) AS own, c.top FROM anchors AS a JOIN cols{i} AS c ON c.read_id = a.read_id AND c.col >= 0 AND c.col < length(a.text)),
 frequent{i} AS (SELECT o.read_id, o.col, o.own, max(base) AS found FROM own{i} AS o JOIN cells{i} AS x ON x.read_id = o.read_id AND x.col = o.col AND x.base <> o.top AND x.n >= {int(coverage * 0.3)}
   WHERE o.read_id IN (SELECT read_id FROM own{i} WHERE own <> top) GROUP BY o.read_id, o.col, o.own),
 hit{i} AS (SELECT * FROM frequent{i} QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY col) = 1),
 gone{i} AS (SELECT p.read_id, p.candidate, p.f FROM pile{i} AS p JOIN hit{i} AS h USING (read_id) WHERE h.col >= p.shift AND h.col < p.shift + length(p.text) AND (substr(p.text, CAST(h.col - p.shift + 1 AS BIGINT), 1) = h.found) <> (h.own = h.found)),
 out{i} AS (SELECT read_id, candidate FROM gone{i} WHERE read_id NOT IN (SELECT read_id FROM gone{i} WHERE f >= 0.9)),
 pile{i + 1} AS MATERIALIZED (SELECT p.* FROM pile{i} AS p LEFT JOIN out{i} AS g USING (read_id, candidate) WHERE g.read_id IS NULL)"""


def piled(coverage: int = 30) -> str:
    """The piles after up to five rounds and what their columns say of the anchor."""
    return f"""{aligned(coverage)},
 pile0 AS MATERIALIZED (SELECT l.read_id, l.candidate, l.reverse, l.shift, CASE WHEN l.reverse THEN {_RC.format('r.seq')} ELSE r.seq END AS text, 1 - sqrt(mismatches / greatest(1, overlap * CAST(0.2 AS DOUBLE))) AS f FROM aligned AS l JOIN ready AS r ON r.read_id = l.candidate WHERE kept),
 anchors AS MATERIALIZED (SELECT read_id, seq AS text FROM ready WHERE read_id IN (SELECT read_id FROM pile0)),
 {', '.join(_round(i, coverage) for i in range(5))},
 {_columns(5)},
 inside AS (SELECT c.*, substr(a.text, CAST(c.col + 1 AS BIGINT), 1) AS own FROM cols5 AS c JOIN anchors AS a ON a.read_id = c.read_id AND c.col >= 0 AND c.col < length(a.text)),
 quality AS (SELECT read_id, avg(support) AS mean, min(support) AS least, min(cover) AS low, max(cover) AS high FROM inside GROUP BY read_id),
 judged AS MATERIALIZED (SELECT *, mean >= {1 - 0.06 - NEAR!r} AND least >= {1 - 3 * 0.06 - NEAR!r} AND low >= {0.6 / 6 * coverage - NEAR!r} AS trusted, mean >= {1 - 0.06 - NEAR!r} AND least >= {1 - 3 * 0.06 - NEAR!r} AND low >= {0.6 / 6 * coverage - NEAR!r}
   AND ceil(100 * (greatest(1 - mean, (1 - least) / 3, 0) - {NEAR!r})) <= {3 + NEAR!r} AS hq FROM quality)"""


def corrected(coverage: int = 30) -> str:
    """Corrections of anchors and, where an anchor is of high quality, of candidates near it."""
    return f"""{piled(coverage)},
 numbers AS (SELECT read_id, count(*) AS kept FROM pile5 GROUP BY read_id),
 anchor_text AS (SELECT i.read_id, string_agg(CASE WHEN n.kept IS NULL THEN i.own WHEN j.trusted THEN i.top WHEN i.support > 0.9 AND x.n <= 2 THEN i.top ELSE i.own END, '' ORDER BY i.col) AS seq, bool_and(j.hq AND n.kept IS NOT NULL) AS hq
   FROM inside AS i JOIN judged AS j USING (read_id) JOIN cells5 AS x ON x.read_id = i.read_id AND x.col = i.col AND x.base = i.own LEFT JOIN numbers AS n ON n.read_id = i.read_id GROUP BY i.read_id),
 near AS (SELECT p.* FROM pile5 AS p JOIN judged AS j USING (read_id) JOIN anchors AS a USING (read_id) WHERE j.hq AND abs(p.shift) <= 15 AND p.shift + length(p.text) <= length(a.text) + 15),
 near_text AS (SELECT n.read_id, n.candidate, n.shift, n.reverse, string_agg(c.top, '' ORDER BY c.col) AS seq FROM near AS n JOIN cols5 AS c ON c.read_id = n.read_id AND c.col >= n.shift AND c.col < n.shift + length(n.text) GROUP BY ALL),
 corrections AS MATERIALIZED (SELECT read_id, 'anchor' AS kind, hq, CAST(0 AS INTEGER) AS shift, seq FROM anchor_text UNION ALL SELECT candidate, 'candidate', false, shift, CASE WHEN reverse THEN {_RC.format('seq')} ELSE seq END FROM near_text)"""


def _micro(x: str) -> str:
    return f"CAST(round({x} * 1000000) AS BIGINT)"


def _features(coverage: int) -> str:
    """Features of every position that differs from the consensus, in millionths."""
    one = [
        "own_n / cover", "own_w / total", "own_w / greatest(1, own_n)", "top_n / cover", "support", "top_w / greatest(1, top_n)", "total / cover", f"cover / {coverage}", f"total / {coverage}", "mean", "least", f"high / {coverage}", f"low / {coverage}",
    ]
    joined = " || ',' || ".join(f"CAST({_micro(x)} AS VARCHAR)" for x in one)
    both = _micro("(least(la, stop) - greatest(0, shift)) / (greatest(la, stop) - least(0, shift))")
    return f"""{piled(coverage)},
 shown AS (SELECT a.read_id, a.read_id AS owner, 'anchor' AS kind, 0 AS shift, a.text, false AS reverse, length(a.text) AS la FROM anchors AS a JOIN judged AS j USING (read_id) WHERE NOT j.hq
   UNION ALL SELECT p.candidate, p.read_id, 'candidate', p.shift, p.text, p.reverse, length(a.text) FROM pile5 AS p JOIN anchors AS a USING (read_id) WHERE p.shift >= -15 AND p.shift + length(p.text) <= length(a.text) + 15),
 placed AS (SELECT s.*, s.shift + length(text) AS stop, c.col - s.shift AS p, c.col, c.cover, c.total, c.support, c.top, substr(text, CAST(c.col - s.shift + 1 AS BIGINT), 1) AS own FROM shown AS s JOIN cols5 AS c ON c.read_id = s.owner AND c.col >= s.shift AND c.col < s.shift + length(text)),
 whole AS (SELECT *, avg(support) OVER w AS mean, min(support) OVER w AS least, max(cover) OVER w AS high, min(cover) OVER w AS low FROM placed WINDOW w AS (PARTITION BY read_id, owner, kind)),
 differ AS (SELECT d.*, x.n AS own_n, x.w AS own_w, t.n AS top_n, t.w AS top_w FROM whole AS d JOIN cells5 AS x ON x.read_id = d.owner AND x.col = d.col AND x.base = d.own JOIN cells5 AS t ON t.read_id = d.owner AND t.col = d.col AND t.base = d.top WHERE d.own <> d.top)
SELECT read_id, kind, CAST(CASE WHEN reverse THEN -p - 1 ELSE p END AS INTEGER) AS pos, top AS consensus, {joined} || CASE WHEN kind = 'candidate' THEN ',' || CAST({both} AS VARCHAR) ELSE '' END AS features FROM differ"""


def _splits(coverage: int) -> str:
    """Groups of candidates by which of two bases they have in columns that these halve."""
    return f"""{piled(coverage)},
 halves AS (SELECT x.read_id, x.col, list(x.base ORDER BY x.base) AS two FROM cells0 AS x JOIN cols0 AS c USING (read_id, col) WHERE x.n >= 2 AND x.n / c.cover BETWEEN {0.4 - NEAR!r} AND {0.6 + NEAR!r} GROUP BY x.read_id, x.col HAVING count(*) = 2),
 few AS (SELECT read_id FROM halves GROUP BY read_id HAVING count(*) <= 16),
 shown_at AS (SELECT p.read_id, p.candidate, h.col, CASE WHEN h.col >= p.shift AND h.col < p.shift + length(p.text) THEN coalesce(list_position(two, substr(p.text, CAST(h.col - p.shift + 1 AS BIGINT), 1)), 0) ELSE 0 END AS x, two FROM pile0 AS p JOIN few USING (read_id) JOIN halves AS h USING (read_id)),
 patterns AS MATERIALIZED (SELECT read_id, candidate, list(x ORDER BY col) AS p, list(CASE WHEN x > 0 THEN col || two[x] END ORDER BY col) AS shown FROM shown_at GROUP BY read_id, candidate),
 kinds AS (SELECT DISTINCT read_id, p, shown FROM patterns),
 final AS (SELECT q.* FROM kinds AS q WHERE NOT EXISTS (SELECT 1 FROM kinds AS r WHERE r.read_id = q.read_id AND r.p <> q.p AND len(list_filter(list_zip(q.p, r.p), lambda z: z[1] > 0 AND z[1] <> z[2])) = 0))
SELECT f.read_id, coalesce(array_to_string(list_filter(f.shown, lambda s: s IS NOT NULL), ','), '') AS pattern, string_agg(CAST(m.candidate AS VARCHAR), ',' ORDER BY m.candidate) AS candidates
 FROM final AS f JOIN patterns AS m ON m.read_id = f.read_id AND len(list_filter(list_zip(m.p, f.p), lambda z: z[1] > 0 AND z[1] <> z[2])) = 0 GROUP BY f.read_id, f.p, f.shown"""


def oracle_sql() -> dict[str, str]:
    shown = "read_id, candidate, reverse, shift, overlap, mismatches, kept"
    found = "SELECT read_id, kind, hq, shift, seq FROM corrections"
    return {
        "cand_bucket_sizes": f"WITH {SIGNATURES} SELECT n, count(*) AS buckets FROM buckets GROUP BY n",
        "cand_pairs": f"WITH {links(30)} SELECT read_id, candidate FROM links",
        "cand_paired": f"WITH {links(30)}, {PAIRED} SELECT read_id, candidate, true AS paired FROM paired",
        "align": f"WITH {aligned()} SELECT {shown} FROM aligned",
        "align_mates": f"WITH {aligned(pairs=True)} SELECT {shown} FROM aligned",
        "consensus": f"""WITH {piled()}, line AS (SELECT read_id, CAST(min(col) AS INTEGER) AS begin, string_agg(top, '' ORDER BY col) AS consensus, string_agg(CAST({_micro('support')} AS VARCHAR), ',' ORDER BY col) AS support, string_agg(CAST(cover AS VARCHAR), ',' ORDER BY col) AS coverage FROM cols5 GROUP BY read_id)
SELECT l.*, CAST((SELECT count(*) FROM pile5 AS p WHERE p.read_id = l.read_id) AS INTEGER) AS reads, trusted, hq FROM line AS l JOIN judged USING (read_id)""",
        "correction_features": f"WITH {_features(10)}",
        "region_splits": f"WITH {_splits(10)}",
        "corrections": f"WITH {corrected()} {found}",
        "corrections_sparse": f"WITH {corrected(10)} {found}",
        "corrected_reads": f"""WITH {corrected()},
 by_read AS (SELECT read_id, max(struct_pack(hq := hq, seq := seq)) FILTER (kind = 'anchor') AS a, count(*) AS n, min(seq) AS lo, max(seq) AS hi FROM corrections GROUP BY read_id),
 labelled AS (SELECT read_id, a.seq AS seq, CASE WHEN a IS NULL THEN 0 WHEN a.hq THEN 3 WHEN n >= 3 THEN CASE WHEN lo = hi THEN 2 ELSE 0 END ELSE 1 END AS label FROM by_read)
SELECT s.read_id, coalesce(CASE WHEN label > 0 THEN l.seq END, s.seq) AS seq, s.name || '{LABEL}' || CAST(coalesce(label, 0) AS VARCHAR) AS name, s.qual FROM se AS s LEFT JOIN labelled AS l USING (read_id)""",
    }
