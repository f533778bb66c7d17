"""DuckDB SQL for the queries of queries.py, written from the definitions rather than from the plans."""

from __future__ import annotations

from spanloom.tables import sql

SAMPLES = "(VALUES (0), (1), (2)) AS n(sample_idx)"


def common() -> str:
    return f"""
sig AS ({sql("signal", "duckdb")}),
reg AS ({sql("regions", "duckdb")}),
chr AS (SELECT sample_idx, chrom, CAST(max(e) AS BIGINT) AS length FROM sig GROUP BY sample_idx, chrom),
base AS (SELECT sample_idx, chrom, value, unnest(range(s, e)) AS pos FROM sig)"""


def reference_bins(anchor: str, up: int, down: int, size: int) -> str:
    ref = {"TSS": "CASE WHEN strand = '-' THEN e ELSE s END", "TES": "CASE WHEN strand = '-' THEN s ELSE e END", "center": "(s + e) // 2"}[anchor]
    n = (up + down) // size
    u, d = up // size, down // size
    left = {"TSS": f"{u}", "TES": f"least((e - s) // {size}, {u})", "center": f"least((CASE WHEN strand = '-' THEN (e - s) - (e - s) // 2 ELSE (e - s) // 2 END) // {size}, {u})"}[anchor]
    right = {"TSS": f"least((e - s) // {size}, {d})", "TES": f"{d}", "center": f"least((CASE WHEN strand = '-' THEN (e - s) // 2 ELSE (e - s) - (e - s) // 2 END) // {size}, {d})"}[anchor]
    return f"""
bins AS (
  SELECT region_id, chrom, i AS bin,
         CASE WHEN strand = '-' THEN ref - (i - {u}) * {size} - {size} ELSE ref + (i - {u}) * {size} END AS bs,
         CASE WHEN strand = '-' THEN ref - (i - {u}) * {size} ELSE ref + (i - {u}) * {size} + {size} END AS be,
         CASE WHEN i < {u} THEN i < {u} - ({left}) ELSE i - {u} >= ({right}) END AS beyond, false AS short
  FROM (SELECT *, {ref} AS ref, unnest(range({n})) AS i FROM reg) r
)"""


def scale_bins(body: int, up: int, down: int, u5: int, u3: int, size: int) -> str:
    """Zones by name, each with its start, length and bins; a zone's bins run along the chromosome."""
    n = [up // size, u5 // size, body // size, u3 // size, down // size]
    total = sum(n)
    return f"""
cut AS (SELECT *, least({u5}, e - s) AS c5, least({u3}, (e - s) - least({u5}, e - s)) AS c3 FROM reg),
zones AS (
  SELECT region_id, chrom, strand, 0 AS z, s - {up} AS zs, {up} AS len, {n[0]} AS n, 0 AS first FROM cut WHERE strand <> '-'
  UNION ALL SELECT region_id, chrom, strand, 1, s, c5, {n[1]}, {n[0]} FROM cut WHERE strand <> '-'
  UNION ALL SELECT region_id, chrom, strand, 2, s + c5, (e - s) - c5 - c3, {n[2]}, {n[0] + n[1]} FROM cut WHERE strand <> '-'
  UNION ALL SELECT region_id, chrom, strand, 3, e - c3, c3, {n[3]}, {n[0] + n[1] + n[2]} FROM cut WHERE strand <> '-'
  UNION ALL SELECT region_id, chrom, strand, 4, e, {down}, {n[4]}, {total - n[4]} FROM cut WHERE strand <> '-'
  UNION ALL SELECT region_id, chrom, strand, 0, s - {down}, {down}, {n[4]}, 0 FROM cut WHERE strand = '-'
  UNION ALL SELECT region_id, chrom, strand, 1, s, c3, {n[3]}, {n[4]} FROM cut WHERE strand = '-'
  UNION ALL SELECT region_id, chrom, strand, 2, s + c3, (e - s) - c5 - c3, {n[2]}, {n[4] + n[3]} FROM cut WHERE strand = '-'
  UNION ALL SELECT region_id, chrom, strand, 3, e - c5, c5, {n[1]}, {n[4] + n[3] + n[2]} FROM cut WHERE strand = '-'
  UNION ALL SELECT region_id, chrom, strand, 4, e, {up}, {n[0]}, {total - n[0]} FROM cut WHERE strand = '-'
),
laid AS (SELECT *, unnest(range(n)) AS i FROM zones),
bins AS (
  SELECT l.region_id, l.chrom, CASE WHEN l.strand = '-' THEN {total - 1} - (first + i) ELSE first + i END AS bin,
         CASE WHEN len <= 0 THEN zs ELSE zs + len * i // n END AS bs,
         CASE WHEN len <= 0 THEN zs ELSE zs + greatest(len * (i + 1) // n, len * i // n + 1) END AS be,
         false AS beyond, {body} > 0 AND (c.e - c.s) - c5 - c3 < {size} AS short
  FROM laid l JOIN cut c ON c.region_id = l.region_id
)"""


def runs(statistic: str, zero: bool, nan_after_end: bool = False) -> str:
    """cells from bins by overlapping intervals."""
    w = "CASE WHEN g.s IS NOT NULL THEN least(be, g.e) - greatest(bs, g.s) END"
    gap = "coalesce(c, 0) < width"
    value = {
        "mean": f"CASE WHEN {'width' if zero else 'c'} > 0 THEN wx / {'width' if zero else 'c'} END",
        "sum": "wx",
        "min": f"CASE WHEN low IS NOT NULL AND {gap} THEN least(low, 0.0) ELSE low END" if zero else "low",
        "max": f"CASE WHEN high IS NOT NULL AND {gap} THEN greatest(high, 0.0) ELSE high END" if zero else "high",
        "std": "CASE WHEN {n} > 0 THEN sqrt(greatest({n} * wxx - wx * wx, 0.0)) / {n} END".replace("{n}", "CAST(width AS DOUBLE)" if zero else "CAST(c AS DOUBLE)"),
    }[statistic]
    value = f"coalesce({value}, 0.0)" if zero else value
    value = f"CASE WHEN NOT beyond THEN {value} END" if nan_after_end else value
    return f"""
joined AS (
  SELECT b.region_id, n.sample_idx, b.bin, b.be - b.bs AS width, beyond, {w} AS w, g.value AS x
  FROM bins b CROSS JOIN {SAMPLES}
  LEFT JOIN sig g ON NOT b.short AND g.sample_idx = n.sample_idx AND g.chrom = b.chrom AND g.s < b.be AND b.bs < g.e AND b.bs < b.be
),
folded AS (
  SELECT region_id, sample_idx, bin, max(width) AS width, bool_or(beyond) AS beyond, sum(w) AS c, sum(w * x) AS wx, sum(w * x * x) AS wxx, min(x) AS low, max(x) AS high
  FROM joined GROUP BY region_id, sample_idx, bin
),
cells AS (SELECT region_id, CAST(sample_idx AS INTEGER) AS sample_idx, CAST(bin AS INTEGER) AS bin, CAST({value} AS DOUBLE) AS value FROM folded)"""


def median_of_runs(zero: bool) -> str:
    """cells from bins: the median of all bases of the overlapping intervals, each with its width, and of zeros for the gaps."""
    gap = """
  UNION ALL SELECT region_id, sample_idx, bin, 0.0, width - c FROM wide WHERE width > c""" if zero else ""
    fill = "coalesce(x, 0.0)" if zero else "x"
    return f"""
met AS (
  SELECT b.region_id, g.sample_idx, b.bin, g.value AS x, least(be, g.e) - greatest(bs, g.s) AS w
  FROM bins b JOIN sig g ON g.chrom = b.chrom AND g.s < b.be AND b.bs < g.e WHERE NOT b.short AND b.bs < b.be
),
wide AS (
  SELECT b.region_id, n.sample_idx, b.bin, be - bs AS width, coalesce(c, 0) AS c
  FROM bins b CROSS JOIN {SAMPLES}
  LEFT JOIN (SELECT region_id, sample_idx, bin, sum(w) AS c FROM met GROUP BY ALL) m ON m.region_id = b.region_id AND m.sample_idx = n.sample_idx AND m.bin = b.bin
),
parts AS (
  SELECT region_id, sample_idx, bin, x, w FROM met{gap}
),
upto AS (
  SELECT *, sum(w) OVER (PARTITION BY region_id, sample_idx, bin ORDER BY x ROWS UNBOUNDED PRECEDING) AS hi,
         sum(w) OVER (PARTITION BY region_id, sample_idx, bin) AS total
  FROM parts
),
seen AS (
  SELECT region_id, sample_idx, bin, (min(x) FILTER (hi > (total - 1) // 2) + min(x) FILTER (hi > total // 2)) / 2 AS x
  FROM upto GROUP BY region_id, sample_idx, bin
),
cells AS (
  SELECT b.region_id, CAST(n.sample_idx AS INTEGER) AS sample_idx, CAST(b.bin AS INTEGER) AS bin, CAST({fill} AS DOUBLE) AS value
  FROM bins b CROSS JOIN {SAMPLES} LEFT JOIN seen s ON s.region_id = b.region_id AND s.sample_idx = n.sample_idx AND s.bin = b.bin
)"""


def spliced() -> str:
    """Regions' blocks base by base, with offsets; a region without blocks is one block."""
    return f"""
ex AS ({sql("exons", "duckdb")}),
blocks AS (
  SELECT r.region_id, r.chrom, r.strand, coalesce(ex.s, r.s) AS s, coalesce(ex.e, r.e) AS e, ex.s IS NOT NULL AS real
  FROM reg r LEFT JOIN ex ON ex.region_id = r.region_id
),
feature AS (SELECT region_id, any_value(chrom) AS chrom, any_value(strand) AS strand, min(s) AS s, max(e) AS e, CAST(sum(e - s) AS BIGINT) AS total, bool_or(real) AS real FROM blocks GROUP BY region_id),
walk AS (SELECT region_id, pos, row_number() OVER (PARTITION BY region_id ORDER BY pos) - 1 AS off FROM (SELECT region_id, unnest(range(s, e)) AS pos FROM blocks) q)"""


def spliced_cells(spots: str, n_bins: int, zero: bool = False, short: str = "false") -> str:
    """spots: (region_id, zone offset o, zone length t, bins of the zone n, first bin, pos), by genomic order of zones."""
    return f"""
spots AS ({spots}),
placed AS (
  SELECT p.region_id, f.chrom, CASE WHEN f.strand = '-' THEN {n_bins - 1} - (first + i) ELSE first + i END AS bin, pos
  FROM (SELECT *, ((o + 1) * n - 1) // t AS i FROM spots WHERE n > 0) p JOIN feature f ON f.region_id = p.region_id
  WHERE NOT ({short})
),
seen AS (
  SELECT p.region_id, v.sample_idx, p.bin, CAST(sum(v.value) AS DOUBLE) / count(*) AS x, count(*) AS c, CAST(sum(v.value) AS DOUBLE) AS total
  FROM placed p JOIN base v ON v.chrom = p.chrom AND v.pos = p.pos GROUP BY p.region_id, v.sample_idx, p.bin
),
wide AS (SELECT region_id, bin, count(*) AS width FROM placed GROUP BY region_id, bin),
cells AS (
  SELECT f.region_id, CAST(n.sample_idx AS INTEGER) AS sample_idx, CAST(k.bin AS INTEGER) AS bin,
         {"CASE WHEN w.width > 0 THEN coalesce(s.total, 0.0) / w.width ELSE 0.0 END" if zero else "s.x"} AS value
  FROM feature f CROSS JOIN {SAMPLES} CROSS JOIN (SELECT unnest(range({n_bins})) AS bin) k
  LEFT JOIN wide w ON w.region_id = f.region_id AND w.bin = k.bin
  LEFT JOIN seen s ON s.region_id = f.region_id AND s.sample_idx = n.sample_idx AND s.bin = k.bin
)"""


def spliced_reference(anchor: str, up: int, down: int, size: int) -> str:
    """Zones of `up` and `down` bases; where blocks run out, the chromosome goes on beside them."""
    u, d = up // size, down // size
    # Left and right of the anchor along the chromosome.
    left, right = f"(CASE WHEN f.strand = '-' THEN {down} ELSE {up} END)", f"(CASE WHEN f.strand = '-' THEN {up} ELSE {down} END)"
    n_left = f"(CASE WHEN f.strand = '-' THEN {d} ELSE {u} END)"
    n_right = f"(CASE WHEN f.strand = '-' THEN {u} ELSE {d} END)"
    point = {"TSS": "CASE WHEN f.strand = '-' THEN f.total ELSE 0 END", "TES": "CASE WHEN f.strand = '-' THEN 0 ELSE f.total END", "center": "f.total // 2"}[anchor]
    line = f"""
    SELECT f.region_id, k.d, {left} AS l, {right} AS r, {n_left} AS nl, {n_right} AS nr,
           CASE WHEN {point} + k.d < 0 THEN f.s + ({point} + k.d) WHEN {point} + k.d >= f.total THEN f.e + ({point} + k.d - f.total) ELSE a.pos END AS pos
    FROM feature f CROSS JOIN (SELECT unnest(range(-{max(up, down)}, {max(up, down)})) AS d) k
    LEFT JOIN walk a ON a.region_id = f.region_id AND a.off = {point} + k.d"""
    return f"""
    SELECT region_id, d + l AS o, l AS t, nl AS n, 0 AS first, pos FROM ({line}) x WHERE d < 0 AND d >= -l
    UNION ALL SELECT region_id, d, r, nr, nl, pos FROM ({line}) x WHERE d >= 0 AND d < r"""


def spliced_scale(body: int, up: int, down: int, u5: int, u3: int, size: int) -> str:
    n = [up // size, u5 // size, body // size, u3 // size, down // size]
    pick = lambda a, b: f"(CASE WHEN f.strand = '-' THEN {b} ELSE {a} END)"
    near, far = f"least({pick(u5, u3)}, f.total)", f"greatest(f.total - {pick(u3, u5)}, least({pick(u5, u3)}, f.total))"
    first = [pick(0, 0), pick(n[0], n[4]), pick(n[0] + n[1], n[4] + n[3]), pick(n[0] + n[1] + n[2], n[4] + n[3] + n[2]), pick(sum(n) - n[4], sum(n) - n[0])]
    return f"""
    SELECT f.region_id, k.d AS o, {pick(up, down)} AS t, {pick(n[0], n[4])} AS n, 0 AS first, f.s - {pick(up, down)} + k.d AS pos
      FROM feature f CROSS JOIN (SELECT unnest(range({max(up, down)})) AS d) k WHERE k.d < {pick(up, down)}
    UNION ALL SELECT f.region_id, a.off, {near}, {pick(n[1], n[3])}, {first[1]}, a.pos FROM feature f JOIN walk a ON a.region_id = f.region_id WHERE a.off < {near}
    UNION ALL SELECT f.region_id, a.off - {near}, {far} - {near}, {n[2]}, {first[2]}, a.pos FROM feature f JOIN walk a ON a.region_id = f.region_id WHERE a.off >= {near} AND a.off < {far}
    UNION ALL SELECT f.region_id, a.off - {far}, f.total - {far}, {pick(n[3], n[1])}, {first[3]}, a.pos FROM feature f JOIN walk a ON a.region_id = f.region_id WHERE a.off >= {far}
    UNION ALL SELECT f.region_id, k.d, {pick(down, up)}, {pick(n[4], n[0])}, {first[4]}, f.e + k.d
      FROM feature f CROSS JOIN (SELECT unnest(range({max(up, down)})) AS d) k WHERE k.d < {pick(down, up)}"""


def query(*parts: str, select: str = "SELECT region_id, sample_idx, bin, value FROM cells") -> str:
    return f"WITH {','.join(p.strip() for p in (common(), *parts))}\n{select}"
