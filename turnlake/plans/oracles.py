"""DuckDB SQL of the registered queries, written apart from the DataFrame plans."""

from __future__ import annotations

SEG = """seg AS (SELECT event_id, user_id % 50 AS file_id, event_type AS speaker, CASE WHEN event_id % 2 = 0 THEN 'ref' ELSE 'hyp' END AS side,
  (epoch_us(ts) // 1000) % 3600000 AS s_ms, (epoch_us(ts) // 1000) % 3600000 + CAST(floor(value * 100) AS BIGINT) + 1 AS e_ms FROM events)"""
# each speaker's own intervals merged, boundaries, who is active, pairs of speakers
CELLS = (
    SEG
    + """, marked AS (SELECT *, max(e_ms) OVER (PARTITION BY file_id, side, speaker ORDER BY s_ms, e_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
islands AS (SELECT *, sum(CASE WHEN s_ms <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, side, speaker ORDER BY s_ms, e_ms ROWS UNBOUNDED PRECEDING) AS island FROM marked),
own AS (SELECT file_id, side, speaker, min(s_ms) AS s_ms, max(e_ms) AS e_ms FROM islands GROUP BY file_id, side, speaker, island),
points AS (SELECT file_id, s_ms AS lo FROM own UNION SELECT file_id, e_ms FROM own),
cells AS (SELECT * FROM (SELECT file_id, lo, lead(lo) OVER (PARTITION BY file_id ORDER BY lo) AS hi FROM points) WHERE hi IS NOT NULL),
act AS (SELECT c.file_id, c.lo, c.hi, o.side, o.speaker FROM cells c JOIN own o ON o.file_id = c.file_id AND o.s_ms <= c.lo AND c.lo < o.e_ms),
pairs AS (SELECT r.file_id, r.speaker AS ref_speaker, h.speaker AS hyp_speaker, CAST(sum(r.hi - r.lo) AS BIGINT) AS overlap
  FROM act r JOIN act h ON r.file_id = h.file_id AND r.lo = h.lo WHERE r.side = 'ref' AND h.side = 'hyp' GROUP BY ALL)"""
)
# the best mapping by trying all orders of the five speakers
BEST = (
    CELLS
    + """, names AS (SELECT DISTINCT speaker FROM seg), ranked AS (SELECT speaker, row_number() OVER (ORDER BY speaker) AS i FROM names),
orders AS (SELECT row_number() OVER () AS o, [a.speaker, b.speaker, c.speaker, d.speaker, e.speaker] AS hyps FROM names a, names b, names c, names d, names e
  WHERE a.speaker NOT IN (b.speaker, c.speaker, d.speaker, e.speaker) AND b.speaker NOT IN (c.speaker, d.speaker, e.speaker) AND c.speaker NOT IN (d.speaker, e.speaker) AND d.speaker <> e.speaker),
tried AS (SELECT p.file_id, o.o, sum(p.overlap) AS matched FROM orders o, ranked r, pairs p WHERE p.ref_speaker = r.speaker AND p.hyp_speaker = o.hyps[r.i] GROUP BY p.file_id, o.o),
best AS (SELECT file_id, CAST(max(matched) AS BIGINT) AS matched FROM tried GROUP BY file_id),
counted AS (SELECT c.file_id, c.lo, c.hi, count(a.speaker) FILTER (a.side = 'ref') AS r, count(a.speaker) FILTER (a.side = 'hyp') AS h
  FROM cells c LEFT JOIN act a ON a.file_id = c.file_id AND a.lo = c.lo GROUP BY c.file_id, c.lo, c.hi),
sums AS (SELECT file_id, CAST(sum(r * (hi - lo)) AS BIGINT) AS total, CAST(sum(greatest(0, r - h) * (hi - lo)) AS BIGINT) AS missed,
  CAST(sum(greatest(0, h - r) * (hi - lo)) AS BIGINT) AS fa, CAST(sum(least(r, h) * (hi - lo)) AS BIGINT) AS both FROM counted GROUP BY file_id),
raw AS (SELECT file_id, count(*) FILTER (side = 'ref') AS refs, count(*) FILTER (side = 'hyp') AS hyps, coalesce(CAST(sum(e_ms - s_ms) FILTER (side = 'hyp') AS BIGINT), 0) AS raw_hyp,
  coalesce(CAST(sum(e_ms - s_ms) FILTER (side = 'ref') AS BIGINT), 0) AS raw_ref FROM seg GROUP BY file_id),
parts AS (SELECT raw.file_id, raw.hyps, raw.raw_ref, s.missed, CASE WHEN raw.refs = 0 THEN raw.raw_hyp ELSE s.fa END AS false_alarm, s.both - coalesce(b.matched, 0) AS confusion, s.total
  FROM raw JOIN sums s USING (file_id) LEFT JOIN best b USING (file_id))"""
)
DER = "CASE WHEN total > 0 THEN CAST(missed + false_alarm + confusion AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0 END"
FRAMES = "fr AS (SELECT user_id % 20 AS file_id, event_type AS speaker, CAST(row_number() OVER (PARTITION BY user_id % 20, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, value / 500e0 AS score FROM events)"
W1 = (
    FRAMES
    + """, h AS (SELECT file_id, speaker, frame, coalesce(last_value(CASE WHEN score >= 2e-1 THEN 1 WHEN score < 1e-1 THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY file_id, speaker ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS "on" FROM fr)"""
)


def _runs(source: str, name: str) -> str:
    return f"""{name} AS (SELECT *, sum(change) OVER (PARTITION BY file_id, speaker ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN "on" <> lag("on") OVER (PARTITION BY file_id, speaker ORDER BY frame) THEN 1 ELSE 0 END AS change FROM {source}))"""


LONG_ON = 'SELECT file_id, speaker, frame, CASE WHEN "on" = 1 AND count(*) OVER (PARTITION BY file_id, speaker, run) >= 3 THEN 1 ELSE 0 END AS "on" FROM {0}'
SHORT_OFF = """SELECT file_id, speaker, frame, CASE WHEN "on" = 0 AND run > 0 AND run < max(run) OVER (PARTITION BY file_id, speaker)
  AND count(*) OVER (PARTITION BY file_id, speaker, run) < 3 THEN 1 ELSE "on" END AS "on" FROM {0}"""
TURNS = (
    FRAMES
    + """, st AS (SELECT file_id, speaker, frame, coalesce(last_value(CASE WHEN score * 4 > 5e-1 THEN 1 WHEN score * 4 < 5e-1 THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY file_id, speaker ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS a FROM fr),
edge AS (SELECT * FROM (SELECT *, max(frame) OVER (PARTITION BY file_id, speaker) AS last_frame, coalesce(lag(a) OVER (PARTITION BY file_id, speaker ORDER BY frame), 0) AS b FROM st) WHERE a <> b),
closed AS (SELECT *, coalesce(lead(frame) OVER (PARTITION BY file_id, speaker ORDER BY frame), last_frame) AS stop FROM edge),
turns AS (SELECT file_id, speaker, frame * 1.6875e-2 + 5e-1 * 6.19375e-2 AS "start", stop * 1.6875e-2 + 5e-1 * 6.19375e-2 AS "end" FROM closed WHERE a = 1)"""
)
SG = """sg AS (SELECT (l_orderkey // 5000) * 4 + l_suppkey % 4 AS file_id, CAST(l_orderkey % 50 AS INTEGER) AS chunk_idx, CAST(l_partkey % 60 AS INTEGER) AS frame_idx, CAST(l_linenumber % 3 AS INTEGER) AS speaker_idx,
  max(CASE WHEN l_quantity > 25 THEN 1e0 ELSE 0e0 END) AS active FROM lineitem GROUP BY 1, 2, 3, 4),
ext AS (SELECT file_id, max(chunk_idx) + 1 AS chunks, CAST(round((1e1 + max(chunk_idx) * 1e0 + 5e-1 * 6.19375e-2 - 5e-1 * 6.19375e-2) / 1.6875e-2) AS INTEGER) + 1 AS extent FROM sg GROUP BY file_id),
outf AS (SELECT sg.*, CAST(round(chunk_idx * 1e0 / 1.6875e-2) AS INTEGER) + frame_idx AS out_frame, extent FROM sg JOIN ext USING (file_id)),
placed AS (SELECT * FROM outf WHERE out_frame < extent),
grid AS (SELECT file_id, CAST(unnest(range(0, extent)) AS INTEGER) AS out_frame FROM ext)"""
COUNT = (
    SG
    + """, sums AS (SELECT file_id, out_frame, chunk_idx, sum(active) AS n FROM placed GROUP BY ALL), means AS (SELECT file_id, out_frame, avg(n) AS m FROM sums GROUP BY ALL),
cnt AS (SELECT g.file_id, g.out_frame, CAST(greatest(0, CASE WHEN coalesce(m, 0e0) - floor(coalesce(m, 0e0)) < 5e-1 - 1e-6 THEN floor(coalesce(m, 0e0)) WHEN coalesce(m, 0e0) - floor(coalesce(m, 0e0)) > 5e-1 + 1e-6
  THEN ceil(m) WHEN CAST(floor(m) AS BIGINT) % 2 = 0 THEN floor(m) ELSE floor(m) + 1 END) AS INTEGER) AS n_speakers FROM grid g LEFT JOIN means USING (file_id, out_frame))"""
)
EMB = "emb AS (SELECT vec_id // 150 AS file_id, CAST((vec_id % 150) // 3 AS INTEGER) AS chunk_idx, CAST(vec_id % 150 % 3 AS INTEGER) AS speaker_idx, embedding, label, vec_id FROM embeddings)"
ACT = (
    COUNT
    + ", "
    + EMB
    + """, lab AS (SELECT file_id, chunk_idx, speaker_idx, label % 3 AS cluster FROM emb),
mx AS (SELECT p.file_id, p.out_frame, p.chunk_idx, l.cluster, max(p.active) AS a FROM placed p JOIN lab l USING (file_id, chunk_idx, speaker_idx) GROUP BY ALL),
sc AS (SELECT file_id, out_frame, cluster, sum(a) AS score FROM mx GROUP BY ALL), wide AS (SELECT file_id, max(cluster) + 1 AS w FROM lab GROUP BY file_id),
dense AS (SELECT g.file_id, g.out_frame, CAST(unnest(range(0, w)) AS INTEGER) AS cluster FROM grid g JOIN wide USING (file_id)),
ac AS (SELECT d.*, coalesce(score, 0e0) AS score FROM dense d LEFT JOIN sc USING (file_id, out_frame, cluster))"""
)
POWER = "map(c, a) AS (VALUES (0, [0, 0, 0]), (1, [1, 0, 0]), (2, [0, 1, 0]), (3, [0, 0, 1]), (4, [1, 1, 0]), (5, [1, 0, 1]), (6, [0, 1, 1]))"
LOGITS = "lg AS (SELECT vec_id, embedding[1:7]::DOUBLE[] AS l FROM embeddings), am AS (SELECT vec_id, CAST(8 - list_position(list_reverse(l), list_max(l)) - 1 AS INTEGER) AS class_idx FROM lg)"
TRANSCRIPT = """tr AS (SELECT conv_id % 50 AS file_id, conv_id * 10000 + turn AS row_idx, CAST(sum(length(text) * 100) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) - length(text) * 100 AS s_ms,
  CAST(sum(length(text) * 100) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e_ms FROM conversations)"""
UNION = """uni AS (SELECT file_id, side, min(s_ms) AS s_ms, max(e_ms) AS e_ms FROM (SELECT *, sum(CASE WHEN s_ms <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY file_id, side ORDER BY s_ms, e_ms ROWS UNBOUNDED PRECEDING) AS isl
  FROM (SELECT *, max(e_ms) OVER (PARTITION BY file_id, side ORDER BY s_ms, e_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {0})) GROUP BY file_id, side, isl)"""
FIRST = "fs AS (SELECT file_id, speaker, CAST(row_number() OVER (PARTITION BY file_id ORDER BY min(event_id), speaker) - 1 AS INTEGER) AS idx FROM seg GROUP BY file_id, speaker)"

# merges of the nearest centroids in one row of lists; the clusters of a recording as lists of rows
AHC = """unit AS (
      SELECT file_id, vec_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY vec_id) - 1 AS BIGINT) AS slot,
        list_transform(embedding, lambda e: e::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM emb),
    state(file_id, step, n, cl) AS (
      SELECT file_id, CAST(0 AS BIGINT), count(*), list({'id': slot, 'size': 1e0, 'c': v, 'g': [[slot]]} ORDER BY slot) FROM unit GROUP BY file_id
      UNION ALL
      SELECT file_id, step + 1, n, list_concat(list_concat(list_concat(cl[1:i - 1], [{'id': n + step, 'size': cl[i].size + cl[j].size,
        'c': list_transform(range(1, len(cl[i].c) + 1), lambda k: (cl[i].size * cl[i].c[k] + cl[j].size * cl[j].c[k]) / (cl[i].size + cl[j].size)),
        'g': CASE WHEN d <= 1 THEN [list_concat(flatten(cl[p].g), flatten(cl[q].g))] ELSE list_concat(cl[p].g, cl[q].g) END}]), cl[i + 1:j - 1]), cl[j + 1:len(cl)])
      FROM (SELECT *, best.d AS d, best.i AS i, best.j AS j, CASE WHEN cl[best.i].id < cl[best.j].id THEN best.i ELSE best.j END AS p, CASE WHEN cl[best.i].id < cl[best.j].id THEN best.j ELSE best.i END AS q
        FROM (SELECT *, list_min(list_transform(range(1, len(cl)), lambda i: list_min(list_transform(range(i + 1, len(cl) + 1), lambda j: {'d': list_distance(cl[i].c, cl[j].c), 'i': i, 'j': j})))) AS best
          FROM state WHERE len(cl) > 1))),
    groups AS (SELECT file_id, unnest(range(1, len(cl[1].g) + 1)) AS k, cl[1].g AS g FROM state WHERE len(cl) = 1),
    leaves AS (SELECT file_id, CAST(k - 1 AS INTEGER) AS cluster, unnest(g[k]) AS slot FROM groups)"""
# means, directions of labels, spread within and between labels, features by falling ratio of the two
PLDA = (
    EMB
    + """, m1 AS (SELECT list(m ORDER BY i) AS mean FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM emb, range(1, 65) r(i) GROUP BY i)),
    u AS (SELECT vec_id, label, list_transform(v, lambda x: x * sqrt(len(v)) / sqrt(list_dot_product(v, v))) AS u FROM (SELECT emb.*, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE - mean[i]) AS v FROM emb, m1)),
    dirs AS (SELECT nth, list(m ORDER BY i) AS d FROM (SELECT label, i, avg(u[i]) AS m FROM u, range(1, 65) r(i) GROUP BY label, i)
      JOIN (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS nth FROM u GROUP BY label) USING (label) WHERE nth <= 16 GROUP BY nth),
    p AS (SELECT vec_id, label, list(list_dot_product(u, d) ORDER BY nth) AS p FROM u, dirs GROUP BY vec_id, label),
    m2 AS (SELECT list(m ORDER BY j) AS mean FROM (SELECT j, avg(p[j]) AS m FROM p, (SELECT unnest(range(1, count(*) + 1)) AS j FROM dirs) GROUP BY j)),
    y AS (SELECT vec_id, label, list_transform(v, lambda x: x * sqrt(len(v)) / sqrt(list_dot_product(v, v))) AS y FROM (SELECT p.*, list_transform(range(1, len(p) + 1), lambda i: p[i] - mean[i]) AS v FROM p, m2)),
    e AS (SELECT vec_id, label, unnest(range(1, len(y) + 1)) AS j, unnest(y) AS y FROM y),
    by_label AS (SELECT j, label, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM e GROUP BY j, label),
    spread AS (SELECT j, sum(s) / sum(n) AS mu, (sum(q) - sum(s * s / n)) / sum(n) AS w, sum(s * s / n) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)) AS b FROM by_label GROUP BY j),
    dims AS (SELECT *, CAST(row_number() OVER (ORDER BY b / w DESC) - 1 AS INTEGER) AS dim, b / w AS phi FROM spread),
    f AS (SELECT vec_id, dim, CAST((y - mu) / sqrt(w) AS FLOAT) AS x FROM e JOIN dims USING (j))"""
)
# mixture inference of a recording in one row of lists, from first(file_id, vec_id, cluster)
def _em(fa: str = "0.07e0", turns: int = 20) -> str:
    return f"""xs AS (SELECT vec_id, list(x::DOUBLE ORDER BY dim) AS x FROM f GROUP BY vec_id),
    ph AS (SELECT list(phi::FLOAT::DOUBLE ORDER BY dim) AS phi FROM dims),
    scaled AS (SELECT file_id, vec_id, cluster, list_transform(range(1, len(x) + 1), lambda d: x[d] * sqrt(phi[d])) AS rho, -0.5 * (list_dot_product(x, x) + len(x) * ln(2 * pi())) AS g FROM first JOIN xs USING (vec_id), ph),
    input AS (SELECT *, list_transform(range(1, len(phi) + 1), lambda d: list_transform(rho, lambda r: r[d])) AS by_dim
      FROM (SELECT file_id, list(vec_id ORDER BY vec_id) AS ids, list(rho ORDER BY vec_id) AS rho, list(g ORDER BY vec_id) AS g, list(cluster ORDER BY vec_id) AS cl, max(cluster) + 1 AS k FROM scaled GROUP BY file_id), ph),
    em(file_id, turn, gamma, prior, before, done) AS (
      SELECT file_id, 0, list_transform(cl, lambda c: list_transform(range(0, k), lambda j: (CASE WHEN j = c THEN 1e0 ELSE exp(-7e0) END / (1 + (k - 1) * exp(-7e0)))::FLOAT::DOUBLE)), list_transform(range(0, k), lambda j: 1e0 / k), '-infinity'::DOUBLE, FALSE FROM input
      UNION ALL
      SELECT file_id, turn + 1, gamma2, list_transform(w2, lambda v: v / list_sum(w2)), bound, (turn > 0 AND bound - before < 1e-4) OR turn = {turns - 1}
      FROM (SELECT *, list_transform(range(1, len(prior) + 1), lambda j: list_sum(list_transform(gamma2, lambda r: r[j]))) AS w2,
          list_sum(evidence) + 0.8e0 * 0.5e0 * list_sum(list_transform(range(1, len(prior) + 1), lambda j: list_sum(list_transform(range(1, len(phi) + 1), lambda d: ln(inv[j][d]) - inv[j][d] - alpha[j][d] * alpha[j][d] + 1)))) AS bound
        FROM (SELECT *, list_transform(range(1, len(g) + 1), lambda t: list_transform(jt[t], lambda v: exp(v - evidence[t]))) AS gamma2
          FROM (SELECT *, list_transform(jt, lambda r: list_max(r) + ln(list_sum(list_transform(r, lambda v: exp(v - list_max(r)))))) AS evidence
            FROM (SELECT *, list_transform(range(1, len(g) + 1), lambda t: list_transform(range(1, len(prior) + 1), lambda j: {fa} * (list_dot_product(rho[t], alpha[j]) - 0.5e0 * penalty[j] + g[t]) + ln(prior[j] + 1e-8))) AS jt
              FROM (SELECT *, list_transform(range(1, len(prior) + 1), lambda j: list_sum(list_transform(range(1, len(phi) + 1), lambda d: (inv[j][d] + alpha[j][d] * alpha[j][d]) * phi[d]))) AS penalty
                FROM (SELECT *, list_transform(range(1, len(prior) + 1), lambda j: list_transform(range(1, len(phi) + 1), lambda d: {fa} / 0.8e0 * inv[j][d] * list_dot_product(cols[j], by_dim[d]))) AS alpha
                  FROM (SELECT *, list_transform(cols, lambda c: list_transform(phi, lambda v: 1 / (1 + {fa} / 0.8e0 * list_sum(c) * v))) AS inv
                    FROM (SELECT em.*, rho, g, by_dim, phi, list_transform(range(1, len(prior) + 1), lambda j: list_transform(gamma, lambda r: r[j])) AS cols FROM em JOIN input USING (file_id) WHERE NOT done))))))))),
    ended AS (SELECT * FROM em WHERE done)"""


LIKELIEST = """SELECT file_id, vec_id, CAST(list_position(r, list_max(r)) - 1 AS INTEGER) AS speaker, round(list_max(r)::DOUBLE, 4) AS responsibility
    FROM (SELECT file_id, unnest(ids) AS vec_id, list_transform(unnest(gamma), lambda v: v::FLOAT) AS r FROM ended JOIN input USING (file_id))"""
SQL = {
    "der_per_file": f"WITH {BEST} SELECT file_id, missed, false_alarm, confusion, total, {DER} AS der FROM parts",
    "der_corpus": f"""WITH {BEST}, pooled AS (SELECT file_id % 5 AS dataset, CAST(sum(CASE WHEN hyps = 0 THEN raw_ref ELSE missed END) AS BIGINT) AS missed, CAST(sum(false_alarm) AS BIGINT) AS false_alarm,
      CAST(sum(confusion) AS BIGINT) AS confusion, CAST(sum(CASE WHEN hyps = 0 THEN raw_ref ELSE total END) AS BIGINT) AS total FROM parts GROUP BY 1) SELECT *, {DER} AS der FROM pooled""",
    "der_mean": f"WITH {BEST} SELECT round(avg({DER}), 9) AS mean_der, count(*) AS files FROM parts",
    "elementary_intervals": f"WITH {SEG}, p AS (SELECT file_id, s_ms AS lo FROM seg UNION SELECT file_id, e_ms FROM seg) SELECT * FROM (SELECT file_id, lo, lead(lo) OVER (PARTITION BY file_id ORDER BY lo) AS hi FROM p) WHERE hi IS NOT NULL",
    "active_speakers": f"WITH {CELLS} SELECT file_id, lo, hi, side, count(*) AS speakers FROM act GROUP BY ALL",
    "cooccurrence": f"WITH {CELLS} SELECT * FROM pairs",
    "speaker_pairs": f"""WITH {BEST}, top AS (SELECT file_id, arg_max(o, matched) AS o FROM tried GROUP BY file_id)
      SELECT p.* FROM top t JOIN orders USING (o) JOIN ranked r ON TRUE JOIN pairs p ON p.file_id = t.file_id AND p.ref_speaker = r.speaker AND p.hyp_speaker = hyps[r.i] WHERE p.overlap > 0""",
    "rttm_durations": f"""WITH {SEG} SELECT CAST(file_id AS VARCHAR) AS file_id, speaker, count(*) AS lines, CAST(sum(e_ms - s_ms) AS BIGINT) AS speech, max(e_ms - s_ms) AS longest FROM seg GROUP BY ALL""",
    "speaker_mapping": f"WITH {BEST} SELECT * FROM best",
    "timeline_union": f"WITH {SEG}, one AS (SELECT file_id, 'x' AS side, s_ms, e_ms FROM seg), {UNION.format('one')} SELECT file_id, s_ms, e_ms FROM uni",
    "timeline_coverage": f"""WITH {SEG}, {UNION.format('seg')}, tot AS (SELECT file_id, CAST(sum(e_ms - s_ms) AS BIGINT) AS total FROM uni WHERE side = 'ref' GROUP BY 1),
      cov AS (SELECT a.file_id, CAST(sum(least(a.e_ms, b.e_ms) - greatest(a.s_ms, b.s_ms)) AS BIGINT) AS c FROM uni a JOIN uni b ON a.file_id = b.file_id AND a.side = 'ref' AND b.side = 'hyp' AND a.s_ms < b.e_ms AND b.s_ms < a.e_ms GROUP BY 1)
      SELECT t.file_id, t.total, coalesce(c, 0) AS covered, CASE WHEN t.file_id IN (SELECT file_id FROM uni WHERE side = 'hyp') AND total > 0 THEN CAST(100 * coalesce(c, 0) AS DOUBLE) / CAST(total AS DOUBLE) END AS percent FROM tot t LEFT JOIN cov USING (file_id)""",
    "speaker_airtime": f"WITH {SEG} SELECT file_id, speaker, CAST(sum(e_ms - s_ms) AS BIGINT) AS airtime FROM seg GROUP BY ALL",
    "segment_stats": f"WITH {SEG} SELECT file_id, side, count(*) AS segments, count(DISTINCT speaker) AS speakers, CAST(sum(e_ms - s_ms) AS BIGINT) AS speech, max(e_ms) AS span FROM seg GROUP BY ALL",
    "speakers_first_seen": f"WITH {SEG}, {FIRST} SELECT * FROM fs",
    "speaker_labels": f"WITH {SEG}, {FIRST} SELECT file_id, speaker, printf('SPEAKER_%02d', idx) AS label FROM fs",
    "transcript_speakers": f"""WITH {SEG}, {TRANSCRIPT}, ov AS (SELECT t.file_id, t.row_idx, s.speaker, row_number() OVER (PARTITION BY t.file_id, t.row_idx ORDER BY least(t.e_ms, s.e_ms) - greatest(t.s_ms, s.s_ms) DESC, s.event_id) AS r
      FROM tr t JOIN seg s ON s.file_id = t.file_id AND s.s_ms < t.e_ms AND t.s_ms < s.e_ms) SELECT tr.*, coalesce(ov.speaker, 'UNKNOWN') AS speaker FROM tr LEFT JOIN ov ON ov.file_id = tr.file_id AND ov.row_idx = tr.row_idx AND r = 1""",
    # the state machine itself, frame by frame
    "hysteresis_switching": f"""WITH RECURSIVE {FRAMES}, m(file_id, speaker, frame, a) AS (
      SELECT DISTINCT file_id, speaker, -1, 0 FROM fr UNION ALL
      SELECT fr.file_id, fr.speaker, fr.frame, CASE WHEN m.a = 1 THEN CASE WHEN fr.score < 2e-1 THEN 0 ELSE 1 END ELSE CASE WHEN fr.score >= 1e-1 THEN 1 ELSE 0 END END
      FROM m JOIN fr ON fr.file_id = m.file_id AND fr.speaker = m.speaker AND fr.frame = m.frame + 1)
      SELECT file_id, speaker, frame, a AS "on" FROM m WHERE frame >= 0""",
    "hysteresis": f"WITH {W1} SELECT * FROM h",
    "frame_runs": f'WITH {W1}, {_runs("h", "r")} SELECT file_id, speaker, "on", min(frame) AS "start", max(frame) + 1 AS "end" FROM r GROUP BY file_id, speaker, run, "on"',
    "min_on": f"WITH {W1}, {_runs('h', 'r')} " + LONG_ON.format("r"),
    "min_off": f"WITH {W1}, {_runs('h', 'r')} " + SHORT_OFF.format("r"),
    "pad_regions": f'WITH {W1} SELECT file_id, speaker, frame, max("on") OVER (PARTITION BY file_id, speaker ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS "on" FROM h',
    "binarized": f"""WITH {W1}, {_runs('h', 'r')}, b AS ({LONG_ON.format('r')}), {_runs('b', 'q')}, c AS ({SHORT_OFF.format('q')})
      SELECT file_id, speaker, frame, max("on") OVER (PARTITION BY file_id, speaker ORDER BY frame ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS "on" FROM c""",
    "segments_from_frames": f"WITH {TURNS} SELECT * FROM turns",
    "segment_durations": f'WITH {TURNS} SELECT file_id, count(*) AS turns, round(sum("end" - "start"), 6) AS speech FROM turns GROUP BY file_id',
    "merged_segments": f"""WITH {SEG}, l AS (SELECT *, lag(speaker) OVER w AS ps, lag(e_ms) OVER w AS pe FROM seg WINDOW w AS (PARTITION BY file_id ORDER BY s_ms, speaker, e_ms)),
      i AS (SELECT *, sum(CASE WHEN ps = speaker AND s_ms - pe < 30000 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY s_ms, speaker, e_ms ROWS UNBOUNDED PRECEDING) AS t FROM l)
      SELECT file_id, speaker, min(s_ms) AS "start", last(e_ms ORDER BY s_ms, e_ms) AS "end" FROM i GROUP BY file_id, speaker, t""",
    "make_exclusive": f"""WITH {FRAMES} SELECT file_id, speaker, frame, CASE WHEN row_number() OVER (PARTITION BY file_id, frame ORDER BY score DESC, speaker DESC) = 1 THEN score ELSE 0e0 END AS score FROM fr""",
    "rttm_roundtrip": f"WITH {SEG} SELECT CAST(file_id AS VARCHAR) AS file_id, speaker, s_ms, e_ms FROM seg",
    "rttm_lines": f"WITH {SEG} SELECT event_id, printf('SPEAKER %d 1 %d.%03d000 %d.%03d000 <NA> <NA> %s <NA> <NA>', file_id, s_ms // 1000, s_ms % 1000, (e_ms - s_ms) // 1000, (e_ms - s_ms) % 1000, speaker) AS value FROM seg",
    "rttm_intervals": f"WITH {SEG} SELECT CAST(file_id AS VARCHAR) AS file_id, count(*) AS lines, CAST(sum(e_ms - s_ms) AS BIGINT) AS speech FROM seg GROUP BY file_id",
    "rttm_split": f"WITH {SEG} SELECT CAST(file_id AS VARCHAR) AS file_id, count(*) AS lines, min(event_id) AS first_line FROM seg GROUP BY file_id",
    "json_segments": f"WITH {SEG} SELECT file_id, speaker, s_ms, e_ms FROM seg",
    "parallel_array_segments": f"WITH {SEG} SELECT file_id, speaker, s_ms, e_ms FROM seg WHERE e_ms > s_ms",
    "textgrid_intervals": f"WITH {SEG} SELECT file_id, speaker, s_ms, e_ms FROM seg WHERE event_id % 7 <> 0",
    "speech_labels": f"WITH {SEG} SELECT file_id, speaker AS label, count(*) AS n FROM seg WHERE event_id % 3 <> 0 GROUP BY ALL",
    "transcript_rows": f"WITH {TRANSCRIPT} SELECT s_ms, e_ms, concat('a', chr(9), row_idx) AS text FROM tr",
    "powerset_map": f"WITH {POWER}, {LOGITS}, n AS (SELECT class_idx, count(*) AS frames FROM am GROUP BY class_idx) SELECT c AS class_idx, CAST(i AS INTEGER) AS speaker_idx, a[i + 1] AS active, coalesce(frames, 0) AS frames FROM map LEFT JOIN n ON n.class_idx = c, range(3) r(i)",
    "powerset_decode": f"WITH {POWER}, {LOGITS} SELECT vec_id, class_idx, CAST(i AS INTEGER) AS speaker_idx, a[i + 1] AS active FROM am JOIN map ON c = class_idx, range(3) r(i)",
    "powerset_encode": f"WITH {LOGITS} SELECT * FROM am",
    "window_enumeration": """WITH f AS (SELECT o_orderkey AS idx, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders), k AS (SELECT idx, n, CASE WHEN n < 10000 THEN 0 ELSE (n - 10000) // 4000 + 1 + CASE WHEN n > 10000 AND ((n - 10000) // 4000 + 1) * 4000 < n THEN 1 ELSE 0 END END AS c FROM f),
      w AS (SELECT idx, n, unnest(range(0, c)) AS i FROM k) SELECT idx, CAST(i AS INTEGER) AS chunk_idx, i * 4000 AS start_sample, i * 4000 + 10000 > n AS is_padded FROM w""",
    "chunk_slices": """WITH w AS (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(0, (len(embedding) - 24) // 7 + 1 + CASE WHEN ((len(embedding) - 24) // 7 + 1) * 7 < len(embedding) THEN 1 ELSE 0 END)) AS i FROM embeddings)
      SELECT vec_id, CAST(i AS INTEGER) AS chunk_idx, CAST(len(embedding[i * 7 + 1 : least(i * 7 + 24, n)]) AS INTEGER) AS samples, 24 AS padded, round(list_sum(embedding[i * 7 + 1 : least(i * 7 + 24, n)]::DOUBLE[]), 6) AS sum FROM w""",
    "start_frames": f"WITH {SG} SELECT DISTINCT chunk_idx, CAST(round(chunk_idx * 1e0 / 1.6875e-2) AS INTEGER) AS start_frame FROM sg",
    "output_extent": f"WITH {SG} SELECT file_id, chunks, extent FROM ext",
    "frame_times": f"WITH {FRAMES} SELECT DISTINCT frame, frame * 1.6875e-2 + 5e-1 * 6.19375e-2 AS seconds FROM fr",
    "clean_masks": f"WITH {SG} SELECT *, CASE WHEN sum(active) OVER (PARTITION BY file_id, chunk_idx, frame_idx) < 2 THEN active ELSE 0e0 END AS clean FROM sg",
    "speaker_weights": f"""WITH {SG}, c AS (SELECT *, CASE WHEN sum(active) OVER (PARTITION BY file_id, chunk_idx, frame_idx) < 2 THEN active ELSE 0e0 END AS clean FROM sg),
      s AS (SELECT file_id, chunk_idx, speaker_idx, sum(active) AS a, sum(clean) AS k, count(*) AS n FROM c GROUP BY ALL) SELECT file_id, chunk_idx, speaker_idx, k > ceil(n * 6000 / 16000) AS use_clean, CASE WHEN k > ceil(n * 6000 / 16000) THEN k ELSE a END AS weight FROM s WHERE a >= 5""",
    "training_set": f"""WITH {SG}, {EMB}, c AS (SELECT *, CASE WHEN abs(sum(active) OVER (PARTITION BY file_id, chunk_idx, frame_idx) - 1) < 1e-6 THEN active ELSE 0e0 END AS alone FROM sg),
      f AS (SELECT file_id, chunk_idx, count(DISTINCT frame_idx) AS n FROM sg GROUP BY ALL), s AS (SELECT file_id, chunk_idx, speaker_idx, sum(alone) AS single_activity FROM c GROUP BY ALL)
      SELECT vec_id, s.* FROM s JOIN f USING (file_id, chunk_idx) JOIN emb USING (file_id, chunk_idx, speaker_idx) WHERE single_activity >= 1e-1 * n""",
    "mark_inactive": f"""WITH {SG}, {EMB}, s AS (SELECT file_id, chunk_idx, speaker_idx, sum(CASE WHEN speaker_idx = chunk_idx % 3 THEN 0 ELSE active END) AS a FROM sg GROUP BY ALL)
      SELECT e.file_id, e.chunk_idx, e.speaker_idx, CASE WHEN coalesce(a, 0) <= 0 THEN -2 ELSE label % 3 END AS cluster FROM emb e LEFT JOIN s USING (file_id, chunk_idx, speaker_idx)""",
    "speaker_count": f"WITH {COUNT} SELECT * FROM cnt",
    "silent_files": f"WITH {COUNT} SELECT file_id, max(n_speakers) = 0 AS silent, max(n_speakers) AS most FROM cnt GROUP BY file_id",
    "cluster_activations": f"WITH {ACT} SELECT * FROM ac",
    # insertion sort of a frame's clusters, frame by frame
    "smoothed_topk": f"""WITH RECURSIVE {ACT}, most AS (SELECT file_id, max(n_speakers) AS m FROM cnt GROUP BY file_id), all_of AS (
      SELECT g.file_id, g.out_frame, CAST(unnest(range(0, greatest(w, m))) AS INTEGER) AS cluster FROM grid g JOIN wide USING (file_id) JOIN most USING (file_id)),
    full_ac AS (SELECT d.*, coalesce(score, 0e0) AS score FROM all_of d LEFT JOIN sc USING (file_id, out_frame, cluster)),
    fs AS (SELECT file_id, out_frame, list(score ORDER BY cluster) AS s, any_value(n_speakers) AS k FROM full_ac JOIN cnt USING (file_id, out_frame) GROUP BY file_id, out_frame),
    scan(file_id, out_frame, kept) AS (SELECT DISTINCT file_id, -1, CAST([] AS BIGINT[]) FROM fs UNION ALL
      SELECT fs.file_id, fs.out_frame, CASE WHEN k >= len(s) THEN range(len(s)) ELSE list_reduce(list_transform(range(len(s)), lambda i: [i]), lambda o, x:
        list_concat(list_concat(o[1:coalesce(list_max(list_filter(range(1, len(o) + 1), lambda j: NOT CASE WHEN abs(s[x[1] + 1] - s[o[j] + 1]) < 1e-1
          THEN list_contains(kept, x[1]) AND NOT list_contains(kept, o[j]) ELSE s[x[1] + 1] > s[o[j] + 1] END)), 0)], x),
          o[coalesce(list_max(list_filter(range(1, len(o) + 1), lambda j: NOT CASE WHEN abs(s[x[1] + 1] - s[o[j] + 1]) < 1e-1
          THEN list_contains(kept, x[1]) AND NOT list_contains(kept, o[j]) ELSE s[x[1] + 1] > s[o[j] + 1] END)), 0) + 1:len(o)]))[1:k] END
      FROM scan JOIN fs ON fs.file_id = scan.file_id AND fs.out_frame = scan.out_frame + 1)
    SELECT a.file_id, a.out_frame, a.cluster, a.score, CASE WHEN list_contains(kept, a.cluster) THEN 1 ELSE 0 END AS active FROM full_ac a JOIN scan USING (file_id, out_frame)""",
    "frame_topk": f"WITH {ACT} SELECT ac.*, CASE WHEN row_number() OVER (PARTITION BY file_id, out_frame ORDER BY score DESC, cluster) <= n_speakers THEN 1 ELSE 0 END AS active FROM ac JOIN cnt USING (file_id, out_frame)",
    "l2_normalize": "WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings), x AS (SELECT vec_id, n, e, unnest(range(0, len(e))) AS i FROM u) SELECT vec_id, CAST(i AS INTEGER) AS dim, round(e[i + 1] / n, 6) AS x FROM x",
    "cosine_matrix": f"WITH {EMB} SELECT a.vec_id AS i, b.vec_id AS j, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM emb a JOIN emb b ON a.file_id = b.file_id AND a.vec_id < b.vec_id",
    "pairwise_distance": f"WITH {EMB} SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM emb a JOIN emb b ON a.file_id = b.file_id AND a.vec_id < b.vec_id",
    "finite_filter": f"WITH {EMB} SELECT file_id, count(*) AS n FROM emb WHERE vec_id % 5 <> 0 GROUP BY file_id",
    "logsumexp": f"WITH {LOGITS} SELECT vec_id, round(5 * list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(5 * x - 5 * list_max(l))))), 6) AS value FROM lg",
    "rounded_ties": "SELECT DISTINCT l_quantity / 2 AS half, CAST(round_even(l_quantity / 2, 0) AS INTEGER) AS rounded FROM lineitem",
    "weighted_centroids": f"WITH {EMB}, x AS (SELECT file_id, label, (vec_id % 7) / 7e0 AS w, embedding, unnest(range(0, len(embedding))) AS i FROM emb) SELECT file_id, label, CAST(i AS INTEGER) AS dim, round(CAST(CAST(sum(w * embedding[i + 1]::DOUBLE) / greatest(sum(w), 1e-8) AS FLOAT) AS DOUBLE), 6) AS x FROM x GROUP BY file_id, label, i",
    "chunk_assignment": f"""WITH {EMB}, d AS (SELECT file_id, label % 3 AS c, embedding, unnest(range(0, len(embedding))) AS i FROM emb), m AS (SELECT file_id, c, i, avg(embedding[i + 1]::DOUBLE) AS x FROM d GROUP BY file_id, c, i), ce AS (SELECT file_id, c, list(x ORDER BY i) AS v FROM m GROUP BY file_id, c),
      s AS (SELECT file_id, chunk_idx, speaker_idx, c, CAST(1 + list_cosine_similarity(embedding::DOUBLE[], v) AS FLOAT) AS score FROM emb JOIN ce USING (file_id)), n AS (SELECT file_id, chunk_idx, count(DISTINCT speaker_idx) AS k FROM emb GROUP BY ALL),
      p(a, b, c) AS (SELECT x.i, y.i, z.i FROM range(3) x(i), range(3) y(i), range(3) z(i) WHERE x.i <> y.i AND y.i <> z.i AND x.i <> z.i),
      t AS (SELECT n.file_id, n.chunk_idx, p.a, p.b, p.c, sum(s.score) AS total FROM n, p, s WHERE s.file_id = n.file_id AND s.chunk_idx = n.chunk_idx AND s.c = CASE s.speaker_idx WHEN 0 THEN p.a WHEN 1 THEN p.b ELSE p.c END GROUP BY ALL),
      b AS (SELECT *, row_number() OVER (PARTITION BY file_id, chunk_idx ORDER BY total DESC, a, b, c) AS r FROM t)
      SELECT e.file_id, e.chunk_idx, e.speaker_idx, CAST(CASE e.speaker_idx WHEN 0 THEN a WHEN 1 THEN b ELSE c END AS INTEGER) AS cluster FROM emb e JOIN b ON b.file_id = e.file_id AND b.chunk_idx = e.chunk_idx AND r = 1""",
    "budgeted_selection": """WITH f AS (SELECT o_orderkey AS idx, o_totalprice AS duration, row_number() OVER w AS n, sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM orders WINDOW w AS (ORDER BY o_totalprice, o_orderkey))
      SELECT idx, duration FROM f WHERE n <= 500 AND (n = 1 OR s <= 1000000)""",
    "paired_files": "SELECT printf('rec%d', o_orderkey) AS stem, printf('/data/wav/rec%d.wav', c_custkey) AS audio, printf('/data/rttm/rec%d.rttm', o_orderkey) AS annotation FROM customer JOIN orders ON c_custkey = o_orderkey",
    "missing_files": "SELECT printf('rec%d', o_orderkey) AS stem FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)",
    "wav_scan": """WITH x AS (SELECT vec_id, len(embedding) AS n, list_transform(embedding, lambda v: greatest(-32768, least(32767, CAST(round_even(v::DOUBLE * 32768, 0) AS BIGINT)))) AS s FROM embeddings)
      SELECT vec_id AS file_id, CAST(16 * n AS INTEGER) AS samples, 16000 AS sample_rate, CAST(16 * n AS DOUBLE) / 16000 AS duration, CAST(16 * list_sum(s) AS BIGINT) AS total, CAST(list_max(list_transform(s, lambda v: abs(v))) AS BIGINT) AS peak FROM x""",
    "wav_windows": """WITH x AS (SELECT vec_id, 16 * len(embedding) AS n, list_transform(embedding, lambda v: greatest(-32768, least(32767, CAST(round_even(v::DOUBLE * 32768, 0) AS BIGINT)))) AS s FROM embeddings),
      w AS (SELECT *, unnest(range(0, (n - 300) // 70 + 1 + CASE WHEN n > 300 AND ((n - 300) // 70 + 1) * 70 < n THEN 1 ELSE 0 END)) AS c FROM x WHERE n >= 300)
      SELECT vec_id AS file_id, CAST(c AS INTEGER) AS chunk_idx, CAST(c * 70 AS BIGINT) AS start_sample, CAST(least(300, n - c * 70) AS INTEGER) AS samples, c * 70 + 300 > n AS is_padded,
        CAST(list_sum(list_transform(range(c * 70, least(n, c * 70 + 300)), lambda i: s[i % len(s) + 1])) AS BIGINT) AS total FROM w""",
    # each step merges the two nearest centroids of a recording; groups of leaves are kept in the order of the tree
    "ahc_labels": f"WITH RECURSIVE {EMB}, {AHC} SELECT file_id, vec_id, cluster FROM leaves JOIN unit USING (file_id, slot)",
    "plda_features": f"WITH {PLDA} SELECT file_id, vec_id, dim, round(abs(x::DOUBLE), 5) AS feature FROM f JOIN emb USING (vec_id)",
    "plda_eigenvalues": f"WITH {PLDA} SELECT dim, round(phi, 6) AS value FROM dims",
    "vbx_posteriors": f"WITH RECURSIVE {PLDA}, {AHC}, first AS (SELECT file_id, vec_id, cluster FROM leaves JOIN unit USING (file_id, slot)), {_em()} {LIKELIEST}",
    "mixture_posteriors": f"WITH RECURSIVE {PLDA}, first AS (SELECT file_id, vec_id, label AS cluster FROM emb), {_em('1e0', 6)} {LIKELIEST}",
    "mixture_speakers": f"WITH RECURSIVE {PLDA}, first AS (SELECT file_id, vec_id, label AS cluster FROM emb), {_em()} SELECT file_id, CAST(unnest(range(0, len(prior))) AS INTEGER) AS speaker, round(unnest(prior)::FLOAT::DOUBLE, 5) AS prior, turn AS turns FROM ended",
    # the discrete Fourier transform as inner products with 257 cosines and sines
    "filter_banks": """WITH x AS (SELECT vec_id, 16 * len(embedding) AS n, list_transform(embedding, lambda v: greatest(-32768, least(32767, CAST(round_even(v::DOUBLE * 32768, 0) AS BIGINT)))::DOUBLE) AS s FROM embeddings),
      fr AS (SELECT vec_id, s, unnest(range(0, (n - 400) // 160 + 1)) AS f FROM x),
      cut AS (SELECT vec_id, f, list_transform(range(f * 160, f * 160 + 400), lambda i: s[i % len(s) + 1]) AS v FROM fr),
      centred AS (SELECT vec_id, f, list_transform(v, lambda e: e - list_sum(v) / 400) AS v FROM cut),
      wave AS (SELECT vec_id, f, list_transform(range(400), lambda i: (v[i + 1] - 97e-2 * v[greatest(i, 1)]) * (54e-2 - 46e-2 * cos(2 * pi() * i / 399))) AS y FROM centred),
      basis AS (SELECT k, list_transform(range(400), lambda i: cos(2 * pi() * k * i / 512)) AS c, list_transform(range(400), lambda i: sin(2 * pi() * k * i / 512)) AS d FROM range(257) r(k)),
      power AS (SELECT vec_id, f, k, list_inner_product(y, c) ** 2 + list_inner_product(y, d) ** 2 AS p FROM wave, basis),
      ends AS (SELECT 1127 * ln(1 + 20e0 / 700) AS lo, 1127 * ln(1 + 8000e0 / 700) AS hi),
      bank AS (SELECT b, k, greatest(0, least((m - e1) / w, (e1 + 2 * w - m) / w)) AS t FROM (
        SELECT b, k, 1127 * ln(1 + k * 16000e0 / 512 / 700) AS m, lo + b * (hi - lo) / 81 AS e1, (hi - lo) / 81 AS w FROM ends, range(80) q(b), range(257) r(k))),
      mel AS (SELECT vec_id, f, b, sum(p * t) AS e FROM power JOIN bank USING (k) WHERE t > 0 GROUP BY ALL)
      SELECT vec_id AS file_id, CAST(count(DISTINCT f) AS INTEGER) AS frames, CAST(count(DISTINCT b) AS INTEGER) AS bins, round(sum(ln(greatest(e, 1.1920928955078125e-07))), 3) AS energy FROM mel GROUP BY vec_id""",
    "annotation_files": f"""WITH {SEG} SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY s_ms, e_ms, speaker) - 1 AS INTEGER) AS line_idx, s_ms, e_ms - s_ms AS length_ms, speaker FROM seg""",
    "statistics_pooling": f"""WITH {EMB}, x AS (SELECT file_id, CASE WHEN vec_id % 3 > 0 THEN 1e0 ELSE 0e0 END AS w, embedding, unnest(range(0, len(embedding))) AS i FROM emb),
      y AS (SELECT file_id, i, w, embedding[i + 1]::DOUBLE AS v FROM x), m AS (SELECT file_id, i, sum(w) AS n, sum(w * w) AS q, sum(w * v) / sum(w) AS mean FROM y GROUP BY ALL)
      SELECT y.file_id, CAST(y.i AS INTEGER) AS dim, round(any_value(mean), 6) AS mean, round(sqrt(greatest(sum(w * (v - mean) * (v - mean)) / (any_value(n) - any_value(q) / any_value(n) + 1e-8), 1e-10)), 5) AS std FROM y JOIN m ON m.file_id = y.file_id AND m.i = y.i GROUP BY y.file_id, y.i""",
    "bench_summary": "SELECT event_type, round(avg(value), 6) AS mean_s, min(value) AS min_s, count(*) AS runs, round(count(*) * 600e0 / sum(value), 6) AS rtfx FROM events GROUP BY event_type",
    "queue_jobs": """WITH e AS (SELECT user_id % 50 AS file_id, least(user_id % 50 % 3, event_id % 3) AS run FROM events),
      f AS (SELECT file_id, count(*) AS n, max(run) AS last FROM e GROUP BY file_id)
      SELECT file_id, CAST(n AS INTEGER) AS parts, 'complete' AS state, CAST(last AS INTEGER) AS batch, CAST(row_number() OVER (ORDER BY last, file_id) AS INTEGER) AS nth FROM f""",
    "queue_microbatch": f"WITH {SEG} SELECT file_id, speaker, count(*) AS jobs, CAST(sum(e_ms - s_ms) AS BIGINT) AS speech FROM seg GROUP BY ALL",
    "queue_fallback": f"WITH {SEG} SELECT file_id, CASE WHEN file_id % 7 = 3 THEN NULL ELSE CAST(sum(e_ms - s_ms) AS BIGINT) END AS speech, CASE WHEN file_id % 7 = 3 THEN 'ValueError: bad recording' END AS error FROM seg GROUP BY file_id",
    "window_steps": """WITH m(mode, step, hop) AS (VALUES ('cpu', 1e0, 16000), ('coreml', 0.96e0, 15360), ('coreml-fast', 2e0, 32000), ('cuda', 1e0, 16000), ('cuda-fast', 2e0, 32000)),
      f AS (SELECT CAST(floor(o_totalprice * 16000) AS BIGINT) AS n FROM orders), w AS (SELECT mode, step, hop, n, (n - 160000) // hop + 1 AS whole FROM f, m WHERE n >= 160000)
      SELECT mode, step, CAST(sum(whole + CASE WHEN n > 160000 AND whole * hop < n THEN 1 ELSE 0 END) AS BIGINT) AS windows FROM w GROUP BY mode, step""",
}
