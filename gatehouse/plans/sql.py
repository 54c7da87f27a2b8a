"""DuckDB SQL of the catalogue's queries, written from the operators' definitions."""

from __future__ import annotations

import math

from gatehouse.functions import sequences as S
from gatehouse.operators import gates

_AS_DNA = f"translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{S.LETTERS}', '{S.BASES}')"
_AS_AA = f"regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^{S.RESIDUES}]', '', 'g')"


def _runs(column: str, pattern: str) -> str:
    return f"coalesce(list_max(list_transform(regexp_extract_all({column}, '{pattern}'), lambda x: length(x))), 0)"


def _gc(column: str) -> str:
    return f"CASE WHEN length({column}) > 0 THEN (length({column}) - length(replace(replace({column}, 'G', ''), 'C', '')))::DOUBLE / length({column}) ELSE 0::DOUBLE END"


_FEATURES = f"""
d AS (SELECT doc_id, lang, source, {_AS_DNA} AS dna FROM documents),
f AS (SELECT *, length(dna) AS n, {_gc("dna")} AS gc, {_runs("dna", "A+|C+|G+|T+")} AS max_run, {_runs("dna", "G+")} AS max_g FROM d),
v AS (SELECT *, NOT (gc BETWEEN 0.25 AND 0.65) AS r1, max_run > 8 AS r2, NOT (n BETWEEN 18 AND 3000) AS r3, max_g > 3 AS r4 FROM f),
e AS (SELECT *, (1.5 * r1::INT + 1.5 * r2::INT + 1.0 * r3::INT)::DOUBLE AS score,
             list_filter([CASE WHEN r1 THEN 'GC_OUT_OF_BAND' END, CASE WHEN r2 THEN 'HOMOPOLYMER_RUN' END,
                          CASE WHEN r3 THEN 'LENGTH_OUT_OF_RANGE' END, CASE WHEN r4 THEN 'POLY_G_RUN' END], lambda x: x IS NOT NULL) AS fired FROM v)
"""


def _unit(expression: str) -> str:
    return f"(('0x' || substr(md5({expression}), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE)"


# hairpins: complementary pairs of one sum form islands; a stem runs outwards from an innermost pair whose loop is allowed
_STEMS = f"""
d AS (SELECT item_id, {_AS_DNA} AS dna FROM benchmark),
c AS (SELECT item_id, i, substr(dna, i + 1, 1) AS ch FROM (SELECT item_id, dna, unnest(range(0, length(dna))) AS i FROM d)),
pairs AS (SELECT a.item_id, a.i AS l, b.i AS r FROM c a JOIN c b ON a.item_id = b.item_id AND b.i - a.i > 3 AND b.ch = translate(a.ch, 'ACGT', 'TGCA')),
island AS (SELECT *, l - row_number() OVER (PARTITION BY item_id, l + r ORDER BY l) AS island FROM pairs),
runs AS (SELECT item_id, l, r, row_number() OVER (PARTITION BY item_id, l + r, island ORDER BY l) AS stem FROM island),
stems AS (SELECT item_id, stem, r - l - 1 AS loop, l - stem + 1 AS "start", r + stem AS "end" FROM runs WHERE r - l - 1 <= 30
          QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY stem DESC, l, r - l) = 1)
"""

_COUNTS = """
l AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || floor(l_extendedprice * 100)::BIGINT AS guide, l_partkey AS gene, floor(l_quantity * 10)::BIGINT AS q,
             floor(l_extendedprice / 150)::BIGINT AS p FROM lineitem),
h AS (SELECT guide, gene, q + ('0x' || substr(md5(guide || 'a'), 1, 6))::BIGINT % 40 AS i1, q + ('0x' || substr(md5(guide || 'b'), 1, 6))::BIGINT % 40 AS i2,
             p + ('0x' || substr(md5(guide || 'c'), 1, 6))::BIGINT % 40 AS f1, p + ('0x' || substr(md5(guide || 'd'), 1, 6))::BIGINT % 40 AS f2 FROM l),
logs AS (SELECT *, (ln(i1) + ln(i2) + ln(f1) + ln(f2)) / 4 AS m FROM h WHERE i1 > 0 AND i2 > 0 AND f1 > 0 AND f2 > 0),
s AS (SELECT exp(median(ln(i1) - m)) AS s1, exp(median(ln(i2) - m)) AS s2, exp(median(ln(f1) - m)) AS s3, exp(median(ln(f2) - m)) AS s4 FROM logs),
g AS (SELECT guide, gene, (i1 / s1 + i2 / s2) / 2 AS init, (f1 / s3 + f2 / s4) / 2 AS fin FROM h, s),
x AS (SELECT *, round(log2((fin + 0.5) / (init + 0.5)), 5) AS lfc, log2((fin + 0.5) / (init + 0.5)) AS raw, log10(init + 1) AS level FROM g)
"""

_AVG_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE)"

_MW = """
r AS (SELECT *, rank() OVER (ORDER BY {s}) + (count(*) OVER (PARTITION BY {s}) - 1) / 2.0::DOUBLE AS rk FROM {t}),
ties AS (SELECT sum(c::DOUBLE * c * c - c) AS tie FROM (SELECT count(*) AS c FROM r GROUP BY {s}))
"""

# the upper tail of the normal distribution by the Fourier series of the error function
_UPPER_TAIL = "(1 - 2 / pi() * (least(greatest({{z}} / sqrt(2.0::DOUBLE), -7.5), 7.5) / 5 + {terms})) / 2".format(
    terms=" + ".join(f"{math.exp(-n * n / 25) / n!r}::DOUBLE * sin({2 * n} * least(greatest({{z}} / sqrt(2.0::DOUBLE), -7.5), 7.5) / 5)" for n in range(1, 33))
)
_POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12)]

_VEC = """
train AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0), test AS (SELECT * FROM embeddings WHERE vec_id % 5 = 0),
sims AS (SELECT t.vec_id AS query, t.label AS q_label, b.vec_id AS neighbour, b.label AS n_label,
                round(list_cosine_similarity(t.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS similarity FROM test t, train b),
knn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM sims QUALIFY rank <= 5)
"""

_PAIRS = f"""
e AS (SELECT 'c' || o_custkey AS a, 'p' || l_partkey AS b, (max(l_quantity) > 25)::INT AS label
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
u AS (SELECT *, {_unit("'e|' || a || '|' || b")} AS u FROM e)
"""

_POINTS = """
p AS (SELECT coalesce(label, -1) AS g, vec_id AS atom, (['C', 'N', 'O', 'S'])[(vec_id % 4 + 1)::INT] AS element, embedding[1]::DOUBLE * 20 AS x,
             embedding[2]::DOUBLE * 20 AS y, embedding[3]::DOUBLE * 20 AS z FROM embeddings)
"""

_SITES_PAIRS = """
e AS (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b, (max(l_quantity) > 25)::INT AS label FROM lineitem GROUP BY l_partkey, l_suppkey),
nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e)
"""

_CELLS = f"""
c AS (SELECT user_id AS target, count(*) AS k, avg(value) AS m, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id),
t AS (SELECT target, CASE WHEN errors = 0 THEN round(m / 100, 6) END AS knockdown_resid, {_unit("'p|' || target")} / 2 AS p, k * 3 AS n_cells FROM c),
v AS (SELECT *, p < 0.05 AS hit, coalesce(knockdown_resid > 0.5, false) AS weak, knockdown_resid IS NULL AS unmeasured, n_cells < 25 AS low FROM t)
"""

_SITES = ", ".join(f"('{e}', '{p}')" for e, p in S.site_patterns())
_KMERS = "SELECT {key} AS key, unnest(list_distinct(list_transform(range(1, length(text) - 10), lambda i: substr(text, i, 12)))) AS kmer FROM {table}"
_FORBIDDEN = ", ".join(f"('{m}')" for m in gates.FORBIDDEN)

SQL = {
    "rule_eval_dna": f"""WITH {_FEATURES}
        SELECT lang, count(*) AS n, count(*) FILTER (score = 0) AS passed, round(sum(score), 6) AS score, count(*) FILTER (r1) AS gc_out_of_band,
               count(*) FILTER (r2) AS homopolymer_run, count(*) FILTER (r3) AS length_out_of_range, count(*) FILTER (r4) AS poly_g_run FROM e GROUP BY lang""",
    "rule_verdicts_dna": f"WITH {_FEATURES} SELECT doc_id, array_to_string(fired, ',') AS fired, score, score = 0 AS ok, len(fired) = 0 AS clean FROM e",
    "rule_verdicts_hard_only": f"WITH {_FEATURES} SELECT score = 0 AS ok, count(*) AS n FROM e GROUP BY 1",
    "rule_fire_rates": f"""WITH {_FEATURES}, w AS (
        SELECT lang, avg(r1::INT) AS a, avg(r2::INT) AS b, avg(r3::INT) AS c, avg(r4::INT) AS g, avg((len(fired) > 0)::INT) AS x FROM e GROUP BY lang)
        SELECT lang, unnest(['GC_OUT_OF_BAND', 'HOMOPOLYMER_RUN', 'LENGTH_OUT_OF_RANGE', 'POLY_G_RUN', 'ANY']) AS contract,
               round(unnest([a, b, c, g, x]), 6) AS rate FROM w""",
    "rule_tally_first_reason": f"WITH {_FEATURES} SELECT lang, fired[1] AS reason, count(*) AS n FROM e WHERE len(fired) > 0 GROUP BY 1, 2",
    "rule_set_verdict": f"WITH {_FEATURES} SELECT count(*) AS items, count(*) FILTER (score = 0) AS passed, bool_and(score = 0) AS ok FROM e",
    "severity_dna": f"""WITH {_FEATURES} SELECT doc_id, round(greatest(gc / 0.65 - 1, 0) + greatest(0.25 / greatest(gc, 1e-6) - 1, 0)
        + greatest(max_run / 8.0::DOUBLE - 1, 0) + greatest(n / 3000.0::DOUBLE - 1, 0) + greatest(18.0::DOUBLE / greatest(n, 1) - 1, 0), 6)::DOUBLE AS severity FROM e""",
    "calibrated_rules": f"""WITH {_FEATURES}, motifs(m) AS (VALUES {_FORBIDDEN}), pool AS (SELECT * FROM e WHERE source = 'src0'),
        top AS (SELECT coalesce(max(max_run), 8) AS ref FROM pool),
        rare AS (SELECT m FROM motifs WHERE coalesce((SELECT avg(contains(dna, m)::INT) FROM pool), 0) < 0.02),
        hit AS (SELECT DISTINCT doc_id FROM e, rare WHERE contains(dna, m))
        SELECT lang, count(*) AS n, count(*) FILTER (max_run > ref) AS c5, count(hit.doc_id) AS c6
        FROM e CROSS JOIN top LEFT JOIN hit ON e.doc_id = hit.doc_id WHERE source <> 'src0' GROUP BY lang""",
    "restriction_sites": f"""WITH {_FEATURES}, sites(enzyme, site) AS (VALUES {_SITES}),
        spots AS (SELECT doc_id, enzyme, site, dna, unnest(range(0, length(dna) - length(site) + 1)) AS position FROM d, sites WHERE contains(dna, site))
        SELECT doc_id, enzyme, site, position::INT AS position FROM spots WHERE substr(dna, position + 1, length(site)) = site""",
    "lcs_crosshyb": f"""WITH d AS (SELECT item_id, {_AS_DNA} AS dna FROM benchmark), t AS (SELECT item_id, dna, reverse(translate(dna, 'ACGT', 'TGCA')) AS rc FROM d),
        a AS (SELECT item_id AS a, i, substr(dna, i, 12) AS k FROM (SELECT item_id, dna, unnest(range(1, length(dna) - 10)) AS i FROM t)),
        b AS (SELECT item_id AS b, j, substr(rc, j, 12) AS k FROM (SELECT item_id, rc, unnest(range(1, length(rc) - 10)) AS j FROM t)),
        m AS (SELECT a, b, i, i - j AS diagonal FROM a JOIN b USING (k) WHERE a < b),
        g AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, diagonal ORDER BY i) AS island FROM m)
        SELECT a, b, max(c) + 11 AS stretch FROM (SELECT a, b, count(*) AS c FROM g GROUP BY a, b, diagonal, island) GROUP BY a, b""",
    "promoter_boxes": f"""WITH d AS (SELECT item_id, {_AS_DNA} AS dna FROM benchmark),
        i AS (SELECT item_id, dna, unnest(range(0, length(dna) - 23)) AS i FROM d), s AS (SELECT *, unnest(range(12, 23)) AS spacer FROM i),
        h AS (SELECT item_id, i, spacer, i + 6 + spacer AS j, hamming(substr(dna, i + 1, 6), 'TTGACA') AS h35, hamming(substr(dna, i + 7 + spacer, 6), 'TATAAT') AS h10
              FROM s WHERE i + 12 + spacer <= length(dna)),
        best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h35 + h10, i, spacer) AS nth FROM h QUALIFY nth = 1)
        SELECT d.item_id, h35::INT AS h35, i::INT AS i35, h10::INT AS h10, j::INT AS i10, spacer::INT AS spacer FROM d LEFT JOIN best ON d.item_id = best.item_id""",
    "hairpin_flag": f"""WITH {_STEMS} SELECT d.item_id, coalesce(stem, 0)::INT AS stem, coalesce(loop, 0)::INT AS loop, coalesce("start", 0)::INT AS "start", coalesce("end", 0)::INT AS "end"
        FROM d LEFT JOIN stems ON d.item_id = stems.item_id""",
    "dna_full_gate": f"""WITH {_STEMS}, f AS (SELECT d.item_id, dna, length(dna) AS n, {_gc("dna")} AS gc, {_runs("dna", "A+|C+|G+|T+")} AS max_run, {_runs("dna", "G+")} AS max_g, coalesce(stem, 0) AS stem
            FROM d LEFT JOIN stems ON d.item_id = stems.item_id),
        v AS (SELECT *, NOT (gc BETWEEN 0.25 AND 0.65) AS r1, max_run > 8 AS r2, NOT (n BETWEEN 18 AND 3000) AS r3, stem >= 12 AS r4, max_g > 3 AS r5,
                     regexp_matches(dna, '{"|".join(p for _, p in S.site_patterns())}') AS r6 FROM f)
        SELECT item_id, array_to_string(list_filter([CASE WHEN r1 THEN 'GC_OUT_OF_BAND' END, CASE WHEN r2 THEN 'HOMOPOLYMER_RUN' END, CASE WHEN r3 THEN 'LENGTH_OUT_OF_RANGE' END,
               CASE WHEN r4 THEN 'STRONG_HAIRPIN' END, CASE WHEN r5 THEN 'POLY_G_RUN' END, CASE WHEN r6 THEN 'RESTRICTION_SITE' END], lambda x: x IS NOT NULL), ',') AS fired,
               (1.5 * r1::INT + 1.5 * r2::INT + r3::INT + r4::INT)::DOUBLE AS score, NOT (r1 OR r2 OR r3 OR r4) AS ok,
               round(greatest(gc / 0.65 - 1, 0) + greatest(0.25 / greatest(gc, 1e-6) - 1, 0) + greatest(max_run / 8.0::DOUBLE - 1, 0) + greatest(n / 3000.0::DOUBLE - 1, 0)
                     + greatest(18.0::DOUBLE / greatest(n, 1) - 1, 0) + greatest(stem / 12.0::DOUBLE - 1, 0), 6)::DOUBLE AS severity FROM v""",
    "promoter_gate": f"""WITH {_FEATURES}, motifs(m) AS (VALUES {_FORBIDDEN}), pool AS (SELECT * FROM e WHERE source = 'src0'),
        top AS (SELECT coalesce(max(max_run), 8) AS ref FROM pool), rare AS (SELECT m FROM motifs WHERE coalesce((SELECT avg(contains(dna, m)::INT) FROM pool), 0) < 0.02),
        hit AS (SELECT DISTINCT doc_id FROM e, rare WHERE contains(dna, m)),
        i AS (SELECT doc_id, dna, unnest(range(0, length(dna) - 23)) AS i FROM d), s AS (SELECT *, unnest(range(12, 23)) AS spacer FROM i),
        h AS (SELECT doc_id, i, spacer, hamming(substr(dna, i + 1, 6), 'TTGACA') AS h35, hamming(substr(dna, i + 7 + spacer, 6), 'TATAAT') AS h10 FROM s WHERE i + 12 + spacer <= length(dna)),
        best AS (SELECT doc_id, min(struct_pack(total := h35 + h10, i := i, spacer := spacer, h35 := h35, h10 := h10)) AS b FROM h GROUP BY doc_id),
        told AS (SELECT e.doc_id, lang, (b IS NULL OR b.h35 > 2)::INT AS c1, (b IS NULL OR b.h10 > 2)::INT AS c2, coalesce(b.h35 <= 2 AND b.h10 <= 2 AND NOT (b.spacer BETWEEN 15 AND 19), false)::INT AS c3,
                     (NOT (gc BETWEEN 0.30 AND 0.70))::INT AS c4, (max_run > ref)::INT AS c5, (hit.doc_id IS NOT NULL)::INT AS c6
              FROM e CROSS JOIN top LEFT JOIN best ON best.doc_id = e.doc_id LEFT JOIN hit ON hit.doc_id = e.doc_id)
        SELECT lang, count(*) AS n, count(*) FILTER (c1 + c2 + c3 + c4 + c5 + c6 = 0) AS passed, sum(c1 + c2 + c3 + c4 + c5 + c6)::DOUBLE AS score FROM told GROUP BY lang""",
    "kmer_freqs": f"""WITH {_FEATURES}, w AS (
        SELECT doc_id, 1 AS k, unnest(list_transform(range(1, n + 1), lambda i: substr(dna, i, 1))) AS kmer FROM f WHERE n >= 2
        UNION ALL SELECT doc_id, 2, unnest(list_transform(range(1, n), lambda i: substr(dna, i, 2))) FROM f WHERE n >= 2),
        c AS (SELECT doc_id, k, kmer, count(*) AS n FROM w GROUP BY ALL)
        SELECT doc_id, kmer, round(n / (sum(n) OVER (PARTITION BY doc_id, k))::DOUBLE, 6) AS freq FROM c""",
    "guide_hard_rules": f"""WITH {_FEATURES}, w AS (SELECT doc_id, substr(dna, (i * 20 + 1)::BIGINT, 20) AS guide FROM (SELECT doc_id, dna, unnest(range(0, n // 20)) AS i FROM f WHERE n >= 20)),
        x AS (SELECT doc_id, contains(guide, 'TTTT') AS t, {_gc("guide")} AS gc, {_runs("guide", "A+|C+|G+|T+")} >= 5 AS r FROM w)
        SELECT doc_id, count(*) AS guides, count(*) FILTER (t OR gc < 0.2 OR gc > 0.8 OR r) AS flagged, count(*) FILTER (t) AS tttt,
               count(*) FILTER (gc < 0.2) AS gc_low, count(*) FILTER (gc > 0.8) AS gc_high, count(*) FILTER (r) AS run FROM x GROUP BY doc_id""",
    "antibody_charge": f"""WITH d AS (SELECT doc_id, {_AS_AA} AS aa FROM documents), c AS (SELECT doc_id, length(aa) AS n, {", ".join(f"length(aa) - length(replace(aa, '{r}', '')) AS n{r}" for r in S.RESIDUES)} FROM d)
        SELECT doc_id, CASE WHEN n = 0 THEN 0::DOUBLE ELSE round(1 / (1 + pow(10, 7.4 - {S.PKA_START})) {" ".join(f"+ n{r} / (1 + pow(10, 7.4 - {p}))" for r, p in S.PKA_POSITIVE.items())}
               - 1 / (1 + pow(10, {S.PKA_END} - 7.4)) {" ".join(f"- n{r} / (1 + pow(10, {p} - 7.4))" for r, p in S.PKA_NEGATIVE.items())}, 6) END AS charge,
               CASE WHEN n = 0 THEN 0::DOUBLE ELSE round(({" + ".join(f"n{r} * ({v}::DOUBLE)" for r, v in S.HYDROPATHY.items())}) / n, 6) END AS gravy FROM c""",
    "liability_motifs": f"""WITH d AS (SELECT doc_id, {_AS_AA} AS aa FROM documents)
        SELECT doc_id, len(regexp_extract_all(aa, 'N[^P][ST]')) AS sequons, len(regexp_extract_all(aa, 'N[GS]')) AS deamidation,
               len(regexp_extract_all(aa, 'D[GS]')) AS isomerization, len(regexp_extract_all(aa, 'DP')) AS fragmentation FROM d""",
    "rank_avg_price": f"""WITH o AS (SELECT o_orderkey, round(o_totalprice / 1000) AS price FROM orders)
        SELECT o_orderkey, price, {_AVG_RANK.format("price")} AS rank FROM o""",
    "spearman_qty_price": """WITH r AS (SELECT l_returnflag,
            rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS a,
            rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS b FROM lineitem)
        SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rho, NULL::VARCHAR AS degenerate FROM r GROUP BY 1""",
    "pearson_degenerate": """WITH l AS (SELECT *, CASE WHEN l_linenumber = 4 THEN 1.0::DOUBLE ELSE l_quantity END AS qty FROM lineitem),
        g AS (SELECT l_partkey, l_linenumber, count(*) AS n, min(qty) = max(qty) OR min(l_discount) = max(l_discount) AS flat, corr(qty, l_discount) AS r FROM l GROUP BY 1, 2)
        SELECT l_linenumber, CASE WHEN n < 3 THEN 'n<3' WHEN flat THEN 'zero variance' END AS degenerate, count(*) AS groups,
               round(avg(CASE WHEN n >= 3 AND NOT flat THEN r END), 6) AS mean_r FROM g GROUP BY 1, 2""",
    "auroc_nchars_quality": f"""WITH t AS (SELECT n_chars, quality FROM documents JOIN labels USING (doc_id)), {_MW.format(s="n_chars", t="t")},
        a AS (SELECT count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg, sum(rk) FILTER (quality = 1) AS rs FROM r),
        b AS (SELECT *, rs - n_pos * (n_pos + 1) / 2.0::DOUBLE AS u, (n_pos + n_neg)::DOUBLE AS n FROM a, ties)
        SELECT n_pos, n_neg, u, round(u / (n_pos * n_neg), 6) AS auroc,
               round((u - n_pos * n_neg / 2.0::DOUBLE) / sqrt(n_pos * n_neg / 12.0::DOUBLE * (n + 1 - tie / (n * (n - 1)))), 6) AS z FROM b""",
    "average_precision_quality": """WITH t AS (SELECT doc_id, n_chars, quality FROM documents JOIN labels USING (doc_id)),
        r AS (SELECT *, row_number() OVER o AS seen, sum(quality) OVER o AS tp FROM t WINDOW o AS (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))
        SELECT count(*) AS n, sum(quality)::BIGINT AS positives, round(coalesce(avg(tp / seen::DOUBLE) FILTER (quality = 1), 0), 6) AS ap FROM r""",
    "bh_fdr": f"""WITH t AS (SELECT p_partkey, pow({_unit("'p|' || p_partkey")}, 2) AS p FROM part), r AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, p_partkey) AS raw FROM t)
        SELECT p_partkey, round(least(1, min(raw) OVER (ORDER BY p, p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6)::DOUBLE AS q FROM r""",
    "equal_count_bins": """WITH r AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
        SELECT ((i * 30 - 1) // n)::BIGINT AS bin, count(*) AS n, round(avg(o_totalprice), 6) AS centre FROM r GROUP BY 1""",
    "median_mad_by_flag": "SELECT l_returnflag, round(median(l_extendedprice), 6) AS med, round(mad(l_extendedprice), 6) AS mad FROM lineitem GROUP BY 1",
    "zscore_by_group": """WITH s AS (SELECT o_orderpriority, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders GROUP BY 1)
        SELECT o_orderkey, round((o_totalprice - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS z FROM orders JOIN s USING (o_orderpriority)""",
    "gap_slope": """WITH m AS (SELECT year(l_shipdate) * 12 + month(l_shipdate) AS month, avg(l_extendedprice) FILTER (l_returnflag = 'R') AS a,
            avg(l_extendedprice) FILTER (l_returnflag = 'N') AS b FROM lineitem GROUP BY 1)
        SELECT round(coalesce(regr_slope(a - b, month), 0), 4) AS slope FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
    "size_factors": f"WITH {_COUNTS} SELECT unnest(['i1', 'i2', 'f1', 'f2']) AS sample, round(unnest([s1, s2, s3, s4]), 6) AS factor FROM s",
    "guide_stats": f"""WITH {_COUNTS}, r AS (SELECT *, row_number() OVER (ORDER BY level, raw, guide) AS i, count(*) OVER () AS n FROM x),
        b AS (SELECT *, (i * 30 - 1) // n AS bin FROM r), t AS (SELECT bin, avg(level) AS centre, CASE WHEN mad(raw) = 0 THEN 1e-9 ELSE 1.4826 * mad(raw) END AS spread FROM b GROUP BY bin),
        nxt AS (SELECT *, lead(centre) OVER (ORDER BY centre) AS c2, lead(spread) OVER (ORDER BY centre) AS s2 FROM t),
        edge AS (SELECT min(centre) AS lo, arg_min(spread, centre) AS s_lo FROM t), mid AS (SELECT median(raw) AS mid FROM x)
        SELECT guide, gene, round(raw, 5) AS lfc, round(-(raw - mid) / CASE WHEN level < lo THEN s_lo WHEN c2 IS NULL THEN spread
               ELSE spread + (s2 - spread) * (level - centre) / (c2 - centre) END, 4) AS depletion
        FROM x CROSS JOIN edge CROSS JOIN mid ASOF LEFT JOIN nxt ON x.level >= nxt.centre""",
    "spread_trend": """WITH r AS (SELECT o_custkey::DOUBLE AS level, o_totalprice, row_number() OVER (ORDER BY o_custkey, o_totalprice, o_orderkey) AS i, count(*) OVER () AS n FROM orders)
        SELECT ((i * 20 - 1) // n)::BIGINT AS bin, round(avg(level), 6) AS centre, round(CASE WHEN mad(o_totalprice) = 0 THEN 1e-9 ELSE 1.4826::DOUBLE * mad(o_totalprice) END, 6) AS spread FROM r GROUP BY 1""",
    "gene_calls": f"""WITH {_COUNTS}, q AS (SELECT gene, -lfc AS v FROM x), {_MW.format(s="v", t="q")},
        a AS (SELECT gene, count(*) AS n, sum(rk) AS rs FROM r GROUP BY gene), w AS (SELECT count(*)::DOUBLE AS total FROM q),
        b AS (SELECT *, rs - n * (n + 1) / 2.0::DOUBLE AS u, total - n AS o FROM a, w, ties)
        SELECT gene, n, u, round(CASE WHEN o > 0 THEN u / (n * o) ELSE 0.5 END, 6)::DOUBLE AS auroc,
               round((u - n * o / 2) / sqrt(n * o / 12 * (total + 1 - tie / (total * (total - 1)))), 6) AS z FROM b""",
    "gene_calls_significant": f"""WITH {_COUNTS}, q AS (SELECT gene, -lfc AS v FROM x), {_MW.format(s="v", t="q")},
        a AS (SELECT gene, count(*) AS n, sum(rk) AS rs FROM r GROUP BY gene), w AS (SELECT count(*)::DOUBLE AS total FROM q),
        b AS (SELECT *, rs - n * (n + 1) / 2.0::DOUBLE AS u, total - n AS o FROM a, w, ties),
        zs AS (SELECT gene, (u - n * o / 2) / sqrt(n * o / 12 * (total + 1 - tie / (total * (total - 1)))) AS z FROM b),
        ps AS (SELECT gene, z, greatest(0, {_UPPER_TAIL.format(z="z")}) AS p FROM zs),
        qs AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, gene) AS raw FROM ps),
        f AS (SELECT *, least(1, min(raw) OVER (ORDER BY p, gene ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS fdr FROM qs)
        SELECT gene, round(z, 6) AS z, round(p, 6)::DOUBLE AS p, round(fdr, 6)::DOUBLE AS q, fdr < 0.05 AS significant FROM f""",
    "size_greedy_split": """WITH RECURSIVE sizes AS (
            SELECT c_mktsegment AS g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS i FROM customer GROUP BY 1),
        lim AS (SELECT floor(sum(n) * 0.8::DOUBLE) AS room FROM sizes),
        walk AS (SELECT 0::BIGINT AS i, NULL::VARCHAR AS g, 0::BIGINT AS n, 0::BIGINT AS used, false AS fits
            UNION ALL SELECT s.i, s.g, s.n, CASE WHEN w.used + s.n <= room THEN w.used + s.n ELSE w.used END, w.used + s.n <= room
            FROM walk w JOIN sizes s ON s.i = w.i + 1, lim)
        SELECT g AS c_mktsegment, CASE WHEN fits THEN 'train' ELSE 'test' END AS split, n FROM walk WHERE i > 0""",
    "bootstrap_ci": f"""WITH u AS (SELECT b, s_acctbal::DOUBLE AS v, {_unit("'boot|' || s_suppkey || '|' || b")} AS u FROM supplier, range(500) t(b)),
        k AS (SELECT b, v, {" + ".join(f"(u >= {e!r}::DOUBLE)::INT" for e in _POISSON)} AS k FROM u),
        m AS (SELECT b, sum(k * v) / sum(k) AS m FROM k GROUP BY b HAVING sum(k) > 0), o AS (SELECT list_sort(list(m)) AS o FROM m)
        SELECT round(o[13], 6) AS lo, round(o[488], 6) AS hi FROM o""",
    "antibody_pi": f"""WITH RECURSIVE d AS (SELECT doc_id, {_AS_AA} AS aa FROM documents),
        c AS (SELECT doc_id, length(aa) AS n, {", ".join(f"length(aa) - length(replace(aa, '{r}', '')) AS n{r}" for r in (*S.PKA_POSITIVE, *S.PKA_NEGATIVE))} FROM d),
        w AS (SELECT *, 7::DOUBLE AS x, 3.5::DOUBLE AS step, 0 AS i FROM c
            UNION ALL SELECT doc_id, n, {", ".join(f"n{r}" for r in (*S.PKA_POSITIVE, *S.PKA_NEGATIVE))}, x + CASE WHEN
                1 / (1 + pow(10, x - {S.PKA_START})) {" ".join(f"+ n{r} / (1 + pow(10, x - {p}))" for r, p in S.PKA_POSITIVE.items())}
                - 1 / (1 + pow(10, {S.PKA_END} - x)) {" ".join(f"- n{r} / (1 + pow(10, {p} - x))" for r, p in S.PKA_NEGATIVE.items())} > 0 THEN step ELSE -step END, step / 2, i + 1
            FROM w WHERE i < 60)
        SELECT doc_id, CASE WHEN n = 0 THEN 7::DOUBLE ELSE round(x, 6) END AS pi FROM w WHERE i = 60""",
    "null_band": f"WITH {_COUNTS} SELECT round(avg(lfc) - 3 * stddev_pop(lfc), 5) AS lo, round(avg(lfc) + 3 * stddev_pop(lfc), 5) AS hi FROM x WHERE gene <= 50",
    "screen_reliability": f"""WITH {_COUNTS}, y AS (SELECT gene, round(init, 4) >= 30 AS usable, lfc FROM x),
        band AS (SELECT avg(lfc) - 3 * stddev_pop(lfc) AS lo FROM y WHERE gene <= 50),
        sds AS (SELECT gene, stddev_pop(lfc) AS sd FROM y WHERE usable GROUP BY gene HAVING count(*) >= 2),
        lim AS (SELECT median(sd) + 3 * 1.4826 * CASE WHEN mad(sd) = 0 THEN 1e-9 ELSE mad(sd) END AS lim FROM sds),
        w AS (SELECT gene, count(*) AS guides, count(*) FILTER (usable) AS usable, stddev_pop(lfc) FILTER (usable) AS sd, count(*) FILTER (usable AND lfc < lo) AS cleared, any_value(lim) AS lim FROM y, band, lim GROUP BY gene),
        z AS (SELECT gene, guides, usable, (guides - usable) / guides::DOUBLE >= 0.5 AS floor, usable < 3 AS few, coalesce(sd > lim, false) AND cleared >= 1 AS discordant FROM w)
        SELECT *, floor OR few OR discordant AS under_powered FROM z""",
    "subsample_guides": "SELECT l_partkey AS gene, least(count(DISTINCT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || floor(l_extendedprice * 100)::BIGINT), 3) AS guides FROM lineitem GROUP BY 1",
    "single_cell_audit": f"""WITH {_CELLS} SELECT count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit AND NOT (weak OR unmeasured OR low)) AS confident_negatives,
        count(*) FILTER (NOT hit AND (weak OR unmeasured OR low)) AS unsupported, round(coalesce(avg((weak OR unmeasured OR low)::INT) FILTER (NOT hit), 0), 6)::DOUBLE AS q1,
        round(coalesce(avg(weak::INT) FILTER (NOT hit), 0), 6)::DOUBLE AS weak_no_hit, round(coalesce(avg(weak::INT) FILTER (hit), 0), 6)::DOUBLE AS weak_hit FROM v""",
    "single_cell_flagged": f"""WITH {_CELLS} SELECT target, round_even(knockdown_resid, 4) AS knockdown_resid, n_cells, array_to_string(list_filter([CASE WHEN weak THEN 'WEAK_KNOCKDOWN' END,
        CASE WHEN unmeasured THEN 'KNOCKDOWN_UNMEASURED' END, CASE WHEN low THEN 'LOW_CELL_COUNT' END], lambda x: x IS NOT NULL), ',') AS fired
        FROM v WHERE NOT hit AND (weak OR unmeasured OR low) ORDER BY v.knockdown_resid DESC NULLS LAST, target LIMIT 50""",
    "leak_membership": f"""WITH d AS (SELECT *, {_unit("'half|' || doc_id")} < 0.5 AS train FROM documents),
        x AS (SELECT doc_id, trim(text) <> '' AND text IN (SELECT text FROM d WHERE train) AS a, source IN (SELECT source FROM d WHERE train) AS b,
                     trim(text) <> '' AND (text, lang) IN (SELECT (text, lang) FROM d WHERE train) AS c, trim(text) <> '' AND text IN (SELECT text FROM benchmark) AS g FROM d WHERE NOT train)
        SELECT doc_id, array_to_string(list_filter([CASE WHEN a THEN 'EXACT_PRODUCT_IN_TRAIN' END, CASE WHEN b THEN 'SAME_PATENT_IN_TRAIN' END, CASE WHEN c THEN 'REACTION_DUP' END,
               CASE WHEN g THEN 'TEMPLATE_SEEN_IN_TRAIN' END], lambda x: x IS NOT NULL), ',') AS fired, (a::INT + b::INT + c::INT + g::INT)::DOUBLE AS score FROM x""",
    "kmer_knn": f"""WITH q AS ({_KMERS.format(key="item_id", table="benchmark")}), t AS ({_KMERS.format(key="doc_id", table="documents")}),
        sh AS (SELECT q.key AS query, t.key AS neighbour, count(*) AS shared FROM q JOIN t USING (kmer) GROUP BY 1, 2),
        nq AS (SELECT key, count(*) AS n FROM q GROUP BY key), nt AS (SELECT key, count(*) AS n FROM t GROUP BY key),
        j AS (SELECT sh.*, shared / (nq.n + nt.n - shared)::DOUBLE AS s FROM sh JOIN nq ON nq.key = query JOIN nt ON nt.key = neighbour)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank, neighbour, shared, round(s, 6) AS similarity FROM j QUALIFY rank <= 5""",
    "random_split": """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('s1|' || doc_id), doc_id) AS i, count(*) OVER () AS n FROM documents)
        SELECT doc_id, CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM r""",
    "group_disjoint_split": """WITH g AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
        r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('s1|=' || source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM g)
        SELECT source, CASE WHEN before < total * 0.2 THEN 'test' ELSE 'train' END AS split, n FROM r""",
    "holdout_strata": f"""WITH {_PAIRS}, s AS (SELECT *, {_unit("'novel|' || a")} < 0.3 OR {_unit("'novel|' || b")} < 0.3 AS fresh FROM u),
        tr AS (SELECT * FROM s WHERE NOT fresh AND u < 0.8), te AS (SELECT * FROM s WHERE fresh OR u >= 0.8),
        ends AS (SELECT a AS node, label FROM tr UNION ALL SELECT b, label FROM tr), deg AS (SELECT node, sum(label) AS d FROM ends GROUP BY node),
        x AS (SELECT te.label, CASE (x.node IS NOT NULL)::INT + (y.node IS NOT NULL)::INT WHEN 2 THEN 'C1' WHEN 1 THEN 'C2' ELSE 'C3' END AS stratum, coalesce(x.d, 0) + coalesce(y.d, 0) AS score
              FROM te LEFT JOIN deg x ON te.a = x.node LEFT JOIN deg y ON te.b = y.node),
        r AS (SELECT *, rank() OVER (PARTITION BY stratum ORDER BY score) + (count(*) OVER (PARTITION BY stratum, score) - 1) / 2.0::DOUBLE AS rk FROM x),
        g AS (SELECT stratum, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label <> 1) AS n_neg, sum(rk) FILTER (label = 1) AS rs FROM r GROUP BY 1)
        SELECT stratum, n_pos, n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2.0::DOUBLE) / (n_pos * n_neg) END, 6) AS auroc FROM g""",
    "pair_leakage_rates": f"""WITH {_PAIRS}, tr AS (SELECT * FROM u WHERE u < 0.8), nodes AS (SELECT a AS node FROM tr UNION SELECT b FROM tr),
        x AS (SELECT a IN (SELECT node FROM nodes) AS s, b IN (SELECT node FROM nodes) AS t FROM u WHERE u >= 0.8)
        SELECT unnest(['BOTH_PARTNERS_SEEN', 'PARTNER_SEEN_IN_TRAIN', 'NEAR_DUP_PROTEIN', 'ANY']) AS contract,
               round(unnest([avg((s AND t)::INT), avg((s OR t)::INT), 0::DOUBLE, avg((s OR t)::INT)]), 6) AS rate FROM x""",
    "vec_knn": f"WITH {_VEC} SELECT query, rank, neighbour, round(similarity, 6) AS similarity FROM knn",
    "vec_knn_vote": f"""WITH {_VEC}, w AS (SELECT query, q_label, n_label, round(sum(similarity), 9) AS w FROM knn GROUP BY 1, 2, 3)
        SELECT query, n_label AS predicted, n_label = q_label AS correct FROM w QUALIFY row_number() OVER (PARTITION BY query ORDER BY w DESC, n_label) = 1""",
    "knn_regression": f"""WITH {_VEC} SELECT query, round(CASE WHEN sum(similarity) > 0 THEN sum(n_label::DOUBLE * similarity) / sum(similarity) ELSE avg(n_label) END, 6) AS predicted FROM knn GROUP BY query""",
    "sim_deciles": f"""WITH {_VEC}, r AS (SELECT *, row_number() OVER (ORDER BY similarity, query) AS i, count(*) OVER () AS n FROM knn WHERE rank = 1)
        SELECT ((i * 10 - 1) // n)::BIGINT AS bin, count(*) AS n, round(avg(similarity), 6) AS mean_similarity, round(avg((n_label = q_label)::INT), 6) AS accuracy FROM r GROUP BY 1""",
    "topk_accuracy": f"""WITH {_VEC}, f AS (SELECT query, min(rank) FILTER (n_label = q_label) AS first FROM knn GROUP BY query)
        SELECT count(*) AS queries, round(avg(coalesce(first <= 1, false)::INT), 6) AS top1, round(avg(coalesce(first <= 3, false)::INT), 6) AS top3, round(avg(coalesce(first <= 5, false)::INT), 6) AS top5 FROM f""",
    "majority_floor": "SELECT round(max(n) / sum(n)::DOUBLE, 6) AS floor FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)",
    "ridge_gram": """WITH f AS (SELECT [1.0::DOUBLE, l_quantity / 50, l_discount, l_tax] AS x, l_extendedprice / 1e5 AS y FROM lineitem),
        i AS (SELECT unnest(range(4)) AS i), p AS (SELECT a.i AS i, b.i AS j FROM i a, i b)
        SELECT i::INT AS i, j::INT AS j, round(sum(x[i + 1] * x[j + 1]), 4) AS v FROM f, p GROUP BY 1, 2
        UNION ALL SELECT i::INT, -1, round(sum(x[i + 1] * y), 4) FROM f, i GROUP BY 1""",
    "greedy_top_k": """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) / l_quantity, 6) AS score FROM lineitem
        ORDER BY score DESC, l_orderkey, l_linenumber LIMIT 100""",
    "readout_qualify": """WITH r AS (SELECT event_id, event_type <> 'error' AS built, value, abs(value - 50) / 100 AS cv, value / 10 AS signal, user_id % 17 <> 0 AS ok FROM events),
        x AS (SELECT event_id, list_filter([CASE WHEN NOT built OR value IS NULL THEN 'QA' END, CASE WHEN built AND cv > 0.3 THEN 'QB' END,
            CASE WHEN (built AND signal < 0.05) OR signal > 10 THEN 'QC' END, CASE WHEN NOT ok THEN 'QD' END], lambda v: v IS NOT NULL) AS fired FROM r)
        SELECT event_id, array_to_string(fired, ',') AS fired, len(fired)::DOUBLE AS score FROM x""",
    "stress_hash_draw": """WITH u AS (SELECT event_id, value, ('0x' || substr(sha256('sat|0|' || event_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS s,
            ('0x' || substr(sha256('det|0|' || event_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS d, ('0x' || substr(sha256('ff|0|' || event_id), 1, 13))::BIGINT / 4503599627370496::DOUBLE AS f FROM events)
        SELECT event_id AS design, round(CASE WHEN value >= 80 AND s < 0.3 THEN 100 - value ELSE value END, 6) AS value, CASE WHEN value < 80 AND f < 0.05 THEN 0.40 ELSE 0.05 END::DOUBLE AS replicate_cv,
               CASE WHEN value >= 80 AND s < 0.3 AND d < 0.75 THEN 15.0 ELSE 1.0 END::DOUBLE AS signal FROM u""",
    "cell_hash_distance": f"""WITH {_POINTS} SELECT a.g, a.atom AS a, b.atom AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) AS dist
        FROM p a JOIN p b ON a.g = b.g AND a.atom < b.atom WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 1.0""",
    "interface_gate": f"""WITH {_POINTS}, rad(e, r) AS (VALUES ('C', 1.75::DOUBLE), ('N', 1.55::DOUBLE), ('O', 1.40::DOUBLE), ('S', 1.80::DOUBLE)), q AS (SELECT p.*, r FROM p JOIN rad ON e = element),
        d AS (SELECT a.g, a.atom AS a, b.atom AS b, a.r AS ra, b.r AS rb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist, a.element = 'S' AND b.element = 'S' AS ss
              FROM q a JOIN q b ON a.g = b.g AND a.atom % 2 = 1 AND b.atom % 2 = 0),
        m AS (SELECT g, min(dist) AS min_dist, count(*) FILTER (ra + rb - dist > 0.4 AND NOT (ss AND dist < 2.5)) AS n_clash,
                     greatest(coalesce(max(ra + rb - dist) FILTER (NOT (ss AND dist < 2.5) AND dist < 5), 0), 0)::DOUBLE AS max_overlap,
                     count(DISTINCT a) FILTER (dist < rb) AS in_a, count(DISTINCT b) FILTER (dist < ra) AS in_b, count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM d GROUP BY g),
        v AS (SELECT *, CASE WHEN na <= nb THEN in_a / na::DOUBLE ELSE in_b / nb::DOUBLE END AS buried FROM m)
        SELECT g, round(min_dist, 6) AS min_dist, n_clash, round(max_overlap, 6) AS max_overlap, round(buried, 6) AS buried_frac,
               array_to_string(list_filter([CASE WHEN n_clash > 0 THEN 'INTERFACE_CLASH' END, CASE WHEN max_overlap > 0.9 THEN 'SEVERE_INTERFACE_CLASH' END,
               CASE WHEN buried > 0.1 THEN 'INTERFACE_VOLUME_OVERLAP' END, CASE WHEN min_dist > 5 THEN 'CHAINS_NOT_IN_CONTACT' END], lambda x: x IS NOT NULL), ',') AS fired FROM v""",
    "ligand_gate": f"""WITH {_POINTS}, rad(e, r) AS (VALUES ('C', 1.70::DOUBLE), ('N', 1.55::DOUBLE), ('O', 1.52::DOUBLE), ('S', 1.80::DOUBLE)), q AS (SELECT p.*, r FROM p JOIN rad ON e = element),
        lig AS (SELECT * FROM q WHERE atom % 10 = 0), pro AS (SELECT * FROM q WHERE atom % 10 <> 0),
        d AS (SELECT a.g, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist, a.r + b.r AS rr FROM lig a JOIN pro b USING (g)),
        m AS (SELECT g, min(dist) AS min_dist, min(dist / rr) FILTER (dist < 5) AS min_rel, count(*) FILTER (dist < 5 AND dist / rr < 0.75) AS n_clash FROM d GROUP BY g),
        low AS (SELECT g, min(x - r) AS lx, min(y - r) AS ly, min(z - r) AS lz FROM lig GROUP BY g),
        steps AS (SELECT unnest(range(0, 9)) AS s),
        own AS (SELECT DISTINCT g, lx + ix * 0.5 AS px, ly + iy * 0.5 AS py, lz + iz * 0.5 AS pz FROM (
            SELECT g, x, y, z, r, lx, ly, lz, (floor((x - r - lx) / 0.5) + a.s)::BIGINT AS ix, (floor((y - r - ly) / 0.5) + b.s)::BIGINT AS iy, (floor((z - r - lz) / 0.5) + c.s)::BIGINT AS iz
            FROM lig JOIN low USING (g), steps a, steps b, steps c)
            WHERE pow(lx + ix * 0.5 - x, 2) + pow(ly + iy * 0.5 - y, 2) + pow(lz + iz * 0.5 - z, 2) <= r * r AND ix >= 0 AND iy >= 0 AND iz >= 0),
        hit AS (SELECT DISTINCT o.* FROM own o JOIN pro b ON o.g = b.g AND pow(px - b.x, 2) + pow(py - b.y, 2) + pow(pz - b.z, 2) <= b.r * b.r),
        v AS (SELECT g, (SELECT count(*) FROM hit h WHERE h.g = low.g)::DOUBLE / (SELECT count(*) FROM own o WHERE o.g = low.g) AS overlap_frac FROM low),
        f AS (SELECT p.g, v.overlap_frac, m.min_dist, m.min_rel, coalesce(m.n_clash, 0) AS n_clash FROM (SELECT DISTINCT g FROM p) p LEFT JOIN v ON v.g = p.g LEFT JOIN m ON m.g = p.g)
        SELECT g, round(overlap_frac, 6) AS overlap_frac, round(min_dist, 6) AS min_dist, round(min_rel, 6) AS min_rel, n_clash,
               array_to_string(list_filter([CASE WHEN min_dist IS NOT NULL AND min_rel < 0.75 THEN 'LIGAND_PROTEIN_CLASH' END, CASE WHEN min_dist IS NOT NULL AND overlap_frac > 0.075 THEN 'LIGAND_PROTEIN_VOLUME_OVERLAP' END,
               CASE WHEN min_dist > 5 THEN 'LIGAND_OUT_OF_POCKET' END, CASE WHEN min_dist IS NULL THEN 'NOT_FRAMED' END], lambda x: x IS NOT NULL), ',') AS fired FROM f""",
    "chain_pairs": f"""WITH {_POINTS}, rad(e, r) AS (VALUES ('C', 1.75::DOUBLE), ('N', 1.55::DOUBLE), ('O', 1.40::DOUBLE), ('S', 1.80::DOUBLE)), q AS (SELECT p.*, r FROM p JOIN rad ON e = element),
        d AS (SELECT a.g, a.element AS ca, b.element AS cb, a.r + b.r AS rr, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM q a JOIN q b ON a.g = b.g AND a.element < b.element)
        SELECT g, count(DISTINCT ca || cb) AS pairs, count(*) FILTER (rr - dist > 0.4) AS n_clash, round(greatest(max(rr - dist), 0), 6)::DOUBLE AS max_overlap, round(min(dist), 6) AS min_dist
        FROM d WHERE dist < 5 GROUP BY g""",
    "primary_pair": f"""WITH {_POINTS}, n AS (SELECT g, element AS chain, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, element) AS place FROM p GROUP BY g, element),
        q AS (SELECT p.*, place FROM p JOIN n ON p.g = n.g AND p.element = n.chain WHERE place <= 4),
        c AS (SELECT a.g, a.element AS chain_a, b.element AS chain_b, a.place AS pa, b.place AS pb, count(DISTINCT a.atom) AS contacts FROM q a JOIN q b ON a.g = b.g AND a.place < b.place
              WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) < 6 GROUP BY ALL)
        SELECT g, chain_a, chain_b, contacts FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY contacts DESC, pa, pb) = 1""",
    "interface_severity": f"""WITH {_POINTS}, rad(e, r) AS (VALUES ('C', 1.75::DOUBLE), ('N', 1.55::DOUBLE), ('O', 1.40::DOUBLE), ('S', 1.80::DOUBLE)), q AS (SELECT p.*, r FROM p JOIN rad ON e = element),
        d AS (SELECT a.g, a.atom AS a, b.atom AS b, a.r AS ra, b.r AS rb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS dist, a.element = 'S' AND b.element = 'S' AS ss
              FROM q a JOIN q b ON a.g = b.g AND a.atom % 2 = 1 AND b.atom % 2 = 0),
        m AS (SELECT g, min(dist) AS min_dist, greatest(coalesce(max(ra + rb - dist) FILTER (NOT (ss AND dist < 2.5) AND dist < 5), 0), 0)::DOUBLE AS depth,
                     count(DISTINCT a) FILTER (dist < rb) AS in_a, count(DISTINCT b) FILTER (dist < ra) AS in_b, count(DISTINCT a) AS na, count(DISTINCT b) AS nb FROM d GROUP BY g),
        v AS (SELECT *, CASE WHEN na <= nb THEN in_a / na::DOUBLE ELSE in_b / nb::DOUBLE END AS buried FROM m)
        SELECT g, round(greatest(depth / 0.9::DOUBLE - 1, 0) + greatest(buried / 0.1::DOUBLE - 1, 0) + greatest(min_dist / 5.0::DOUBLE - 1, 0), 6)::DOUBLE AS severity FROM v""",
    "molecule_severity": """WITH m AS (SELECT p_partkey, p_partkey % 50 <> 0 AS valid, p_size / 6.0::DOUBLE AS sa, p_retailprice AS mw, (p_partkey % 100) / 10.0::DOUBLE AS logp, p_partkey % 8 AS hbd,
            p_partkey % 13 AS hba, p_partkey % 12 AS rotb, p_partkey % 160 AS tpsa, p_partkey % 3 AS alerts FROM part),
        f AS (SELECT *, sa > 6 AS r2, mw > 900 OR logp > 7 AS r3, alerts > 0 AS r4, (mw > 500)::INT + (logp > 5)::INT + (hbd > 5)::INT + (hba > 10)::INT >= 2 AS r5, rotb > 10 OR tpsa > 140 AS r6 FROM m)
        SELECT p_partkey, CASE WHEN NOT valid THEN 10::DOUBLE ELSE round(greatest(sa / 6 - 1, 0) + greatest(mw / 900 - 1, 0) + greatest(logp / 7 - 1, 0), 6)::DOUBLE END AS severity,
               CASE WHEN NOT valid THEN 'INVALID_MOLECULE' ELSE array_to_string(list_filter([CASE WHEN r2 THEN 'UNSYNTHESIZABLE' END, CASE WHEN r3 THEN 'EXTREME_PROPERTY' END, CASE WHEN r4 THEN 'STRUCTURAL_ALERT' END,
               CASE WHEN r5 THEN 'LIPINSKI_RO5' END, CASE WHEN r6 THEN 'VEBER' END], lambda x: x IS NOT NULL), ',') END AS fired,
               CASE WHEN NOT valid THEN 2::DOUBLE ELSE (1.5 * r2::INT + 1.5 * r3::INT)::DOUBLE END AS score FROM f""",
    "node_disjoint_split": f"""WITH {_SITES_PAIRS}, h AS (SELECT node, row_number() OVER (ORDER BY md5('s1|' || node), node) AS i, count(*) OVER () AS n FROM nodes),
        t AS (SELECT node FROM h WHERE i <= greatest(1, floor(n * sqrt(0.2::DOUBLE)))), m AS (SELECT e.*, a IN (SELECT node FROM t) AS fa, b IN (SELECT node FROM t) AS fb FROM e)
        SELECT CASE WHEN fa THEN 'test' ELSE 'train' END AS split, count(*) AS pairs, sum(label)::BIGINT AS positive FROM m WHERE fa = fb GROUP BY 1""",
    "holdout_split": f"""WITH {_SITES_PAIRS}, h AS (SELECT node, row_number() OVER (ORDER BY md5('s1-nodes|' || node), node) AS i, count(*) OVER () AS n FROM nodes),
        t AS (SELECT node FROM h WHERE i <= greatest(1, floor(n * 0.3::DOUBLE))), m AS (SELECT e.*, a IN (SELECT node FROM t) OR b IN (SELECT node FROM t) AS novel FROM e),
        s AS (SELECT a, b, row_number() OVER (ORDER BY md5('s1-pairs|' || a || '|' || b), a || '|' || b) AS i, count(*) OVER () AS n FROM m WHERE NOT novel),
        f AS (SELECT a, b FROM s WHERE i <= floor(n * 0.8::DOUBLE))
        SELECT CASE WHEN f.a IS NULL THEN 'test' ELSE 'train' END AS split, count(*) AS pairs, sum(label)::BIGINT AS positive FROM m LEFT JOIN f ON m.a = f.a AND m.b = f.b GROUP BY 1""",
    "class_audit": f"""WITH {_VEC}, w AS (SELECT query, any_value(q_label) AS label, n_label, sum(similarity) AS w FROM knn GROUP BY query, n_label),
        v AS (SELECT query, label, n_label AS predicted FROM w QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(w, 9) DESC, n_label NULLS FIRST) = 1),
        x AS (SELECT v.query, label, coalesce(predicted = label, false) AS hit, top.s AS s FROM v JOIN (SELECT query, max(similarity) AS s FROM knn GROUP BY query) top USING (query)),
        r AS (SELECT *, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS rk FROM x),
        a AS (SELECT count(*) AS n, avg((s >= 0.35)::INT) AS prevalence, avg(hit::INT) AS full_, coalesce(avg(hit::INT) FILTER (s < 0.35), 0) AS clean,
                     count(*) FILTER (hit)::DOUBLE AS np, count(*) FILTER (NOT hit)::DOUBLE AS nn, sum(rk) FILTER (hit) AS rs FROM r),
        f AS (SELECT max(c) / sum(c)::DOUBLE AS floor FROM (SELECT count(*) AS c FROM x GROUP BY label))
        SELECT n, round(prevalence, 6) AS prevalence, round(full_, 6) AS "full", round(clean, 6) AS clean, round(floor, 6) AS floor,
               CASE WHEN np > 0 AND nn > 0 THEN round((rs - np * (np + 1) / 2) / (np * nn), 6) END AS explained, round(full_ - clean, 6) AS inflation FROM a, f""",
    "others_mean": """WITH s AS (SELECT o_orderpriority, count(*) AS n_test, sum(o_totalprice) AS t, avg(o_totalprice) AS m FROM orders GROUP BY 1), w AS (SELECT sum(n_test) AS n, sum(t) AS t FROM s)
        SELECT o_orderpriority, n_test, (w.n - n_test)::BIGINT AS n_train, round((w.t - s.t) / (w.n - n_test), 4) AS train_mean, round(abs(m - (w.t - s.t) / (w.n - n_test)), 4) AS error FROM s, w""",
    "shuffle_control": """WITH c AS (SELECT p_partkey, p_size::DOUBLE AS x, (p_size * 10 + p_partkey % 7)::DOUBLE AS y FROM part),
        f AS (SELECT x, row_number() OVER (ORDER BY md5('s1-from|' || p_partkey), p_partkey) AS i FROM c), t AS (SELECT y, row_number() OVER (ORDER BY md5('s1-to|' || p_partkey), p_partkey) AS i FROM c)
        SELECT (SELECT round(corr(x, y), 6) FROM c) AS real, (SELECT round(corr(x, y), 6) FROM f JOIN t USING (i)) AS control""",
    "bit_knn": """WITH b AS (SELECT vec_id, list_filter(range(1, len(embedding) + 1), lambda i: embedding[i] > 0) AS bits FROM embeddings),
        s AS (SELECT q.vec_id AS query, t.vec_id AS neighbour, len(list_intersect(q.bits, t.bits)) AS common, len(q.bits) AS nq, len(t.bits) AS nt FROM b q, b t WHERE q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
        v AS (SELECT query, neighbour, round(common / greatest(nq + nt - common, 1)::DOUBLE, 9) AS s FROM s)
        SELECT query, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank, neighbour, round(s, 6) AS similarity FROM v QUALIFY rank <= 5""",
    "screen_baseline_gate": f"""WITH {_COUNTS}, m AS (SELECT gene, avg(lfc) AS lfc, avg(-lfc) AS score, gene % 7 = 0 AS truth FROM x WHERE gene % 7 IN (0, 1) GROUP BY gene),
        r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk, row_number() OVER (ORDER BY score DESC, gene) AS i,
                     sum(truth::INT) OVER (ORDER BY score DESC, gene ROWS UNBOUNDED PRECEDING) AS hits FROM m),
        a AS (SELECT count(*) FILTER (truth)::DOUBLE AS np, count(*) FILTER (NOT truth)::DOUBLE AS nn, sum(rk) FILTER (truth) AS rs, avg(hits / i::DOUBLE) FILTER (truth) AS ap,
                     median(lfc) FILTER (truth) AS me, median(lfc) FILTER (NOT truth) AS mn FROM r)
        SELECT round((rs - np * (np + 1) / 2) / (np * nn), 6) AS auroc, round(ap, 6) AS ap, round(me, 6) AS median_essential, round(mn, 6) AS median_nonessential FROM a""",
    "streaming_flags": """WITH r AS (SELECT date_trunc('day', ts) AS w, event_type <> 'error' AS built, value, user_id % 17 <> 0 AS ok FROM events)
        SELECT w::TIMESTAMP AS window_start, count(*) AS n, count(*) FILTER (NOT built OR abs(value - 50) / 100 > 0.3 OR value / 10 < 0.05 OR value / 10 > 10 OR NOT ok) AS flagged FROM r GROUP BY 1""",
    "orders_of_segment_semi": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "customers_without_orders_anti": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "batch_jaccard": """WITH a AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 2 = 0), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey % 2 = 1),
        i AS (SELECT count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b)), u AS (SELECT count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b))
        SELECT i.n AS both, u.n AS any, round(i.n / u.n::DOUBLE, 6) AS jaccard FROM i, u""",
    "revenue_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "top_groups_per_nation": "SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank, c_custkey, c_acctbal FROM customer QUALIFY rank <= 3",
}
