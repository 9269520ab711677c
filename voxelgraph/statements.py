"""One statement for each operator, over the relations of catalog.RELATIONS and the given tables, in SQL that Spark and
DuckDB share; idiv(a,b) is a whole division."""

from __future__ import annotations

#: Runs: one row for each order line, as experiment results (case, method, metrics).
RUNS = "SELECT l_orderkey AS run_id, l_linenumber AS line, l_returnflag AS case_name, l_linestatus AS method, l_quantity AS e_k, l_discount AS e_phi, l_tax AS e_u, l_extendedprice AS t_total FROM {lineitem}"

#: Components of labels, their sizes against a threshold, and the part that holds the label's seed: relation and least size.
#: For each edge the owner's wall segment in the plane of its site, at least 1.8 from the site along its normal, with the best score:
#: margin to the domain's edge, distances to site and face, and how many voxels of either cell stand in a window of 19 x 15.
WALL_SEGMENTS = "WITH seg AS (SELECT v.cell, v.vid, v.z, c.dy, c.dx, v.x + 0.5 + 0.5 * c.dx AS cx, v.y + 0.5 + 0.5 * c.dy AS cy, s.x + 0.5 AS sx, s.y + 0.5 AS sy FROM {contact} c JOIN {cellvox} v ON v.vid = c.vid JOIN {site} s ON s.site_id = v.cell AND s.z = v.z WHERE c.dz = 0), far AS (SELECT *, (cx - sx) * dx + (cy - sy) * dy AS delta FROM seg WHERE (cx - sx) * dx + (cy - sy) * dy >= 1.8), near AS (SELECT f.vid, f.dy, f.dx, n.cell, count(*) AS n FROM far f JOIN {cellvox} n ON n.z = f.z AND n.y >= floor(f.cy - 7) AND n.y < ceil(f.cy + 8) AND n.x >= floor(f.cx - 8) AND n.x < ceil(f.cx + 11) GROUP BY f.vid, f.dy, f.dx, n.cell), told AS (SELECT g.owner, g.neighbor, f.vid, f.dy, f.dx, 0.65 * least(f.cx, f.cy, 50 - f.cx, 30 - f.cy) - 0.1 * sqrt((f.cx - f.sx) * (f.cx - f.sx) + (f.cy - f.sy) * (f.cy - f.sy)) + 0.05 * least(sqrt((f.cx - g.fx) * (f.cx - g.fx) + (f.cy - g.fy) * (f.cy - g.fy)), 24.0) - 0.03 * coalesce(j.n, 0) + 0.01 * coalesce(i.n, 0) - 0.45 * abs(f.cy - f.sy) - 0.12 * abs(f.delta - 3.8) AS score FROM {facegeo} g JOIN far f ON f.cell = g.owner LEFT JOIN near i ON i.vid = f.vid AND i.dy = f.dy AND i.dx = f.dx AND i.cell = g.owner LEFT JOIN near j ON j.vid = f.vid AND j.dy = f.dy AND j.dx = f.dx AND j.cell = g.neighbor) SELECT owner, neighbor, vid, dy, dx, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY owner, neighbor ORDER BY round(score, 9) DESC, vid, dy, dx) AS r FROM told) AS q WHERE r = 1"
CUT = "SELECT label, parts, kept, seed_size, kept_sum, lost, CASE WHEN kept >= 2 OR lost THEN 1 ELSE 0 END AS cut, CASE WHEN lost THEN CAST('Infinity' AS DOUBLE) ELSE (CASE WHEN seed_size >= thr THEN kept_sum - seed_size ELSE kept_sum END) / CAST(greatest(seed_size, 1) AS DOUBLE) END AS islands FROM (SELECT c.label, count(seed_root) = 0 AS lost, count(*) AS parts, sum(CASE WHEN n >= thr THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN n >= thr THEN n ELSE 0 END) AS kept_sum, max(CASE WHEN root = seed_root THEN n ELSE 0 END) AS seed_size, max(thr) AS thr FROM (SELECT label, root, count(*) AS n FROM {{{0}}} GROUP BY label, root) c JOIN (SELECT label, greatest({1}, ceil(0.01 * count(*))) AS thr FROM {{{0}}} GROUP BY label) t ON t.label = c.label LEFT JOIN (SELECT label, root AS seed_root FROM {{{0}}} WHERE seed) z ON z.label = c.label GROUP BY c.label) AS q"

#: Porosity and wall contact of blocks of five voxels.
METRICS = "SELECT t.tz, t.ty, t.tx, t.porosity, coalesce(n.near_wall, 0) AS near_wall, coalesce(n.mean_solid, 0) AS mean_solid FROM (SELECT idiv(z,5) AS tz, idiv(y,5) AS ty, idiv(x,5) AS tx, avg(CASE WHEN pore THEN 1.0 ELSE 0.0 END) AS porosity FROM {vox} GROUP BY idiv(z,5), idiv(y,5), idiv(x,5)) t LEFT JOIN (SELECT idiv(p.z,5) AS tz, idiv(p.y,5) AS ty, idiv(p.x,5) AS tx, avg(CASE WHEN c.n > 0 THEN 1.0 ELSE 0.0 END) AS near_wall, avg(coalesce(c.n, 0) * 1.0) AS mean_solid FROM {pore} p LEFT JOIN (SELECT vid, count(*) AS n FROM {contact} GROUP BY vid) c ON c.vid = p.vid GROUP BY idiv(p.z,5), idiv(p.y,5), idiv(p.x,5)) n ON n.tz = t.tz AND n.ty = t.ty AND n.tx = t.tx"

STATEMENTS: dict[str, str] = {
    # scans, sources, sinks
    # grids and masks
    "gn1_index_grid": "SELECT vid, z, y, x FROM {vox}",
    "gn5_disk_stamp": "SELECT DISTINCT v.vid FROM {site} s CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) AS a(oy) CROSS JOIN (VALUES (-2), (-1), (0), (1), (2)) AS b(ox) JOIN {vox} v ON v.vid = s.vid + a.oy * 50 + b.ox WHERE a.oy * a.oy + b.ox * b.ox <= 4 AND v.x = s.x + b.ox AND v.y = s.y + a.oy",
    "gn8_binary_closing": "SELECT vid FROM {closed}",
    "gn15_minmax_scaled": "SELECT vid, round((val - lo) / (hi - lo), 6) AS scaled, CAST(vid % 5 AS INT) AS palette FROM {vox}, (SELECT min(val) AS lo, max(val) AS hi FROM {vox}) AS m",
    # projections, filters, validation
    "f1_pore_filter": "SELECT vid, z, y, x FROM {vox} WHERE pore",
    "f2_flat_id": "SELECT vid, (CAST(z AS BIGINT) * 30 + y) * 50 + x AS again, z, y, x FROM {vox}",
    "f4_inlet_outlet": "SELECT vid, CASE WHEN x = lo THEN 'inlet' ELSE 'outlet' END AS kind FROM {pore}, (SELECT min(x) AS lo, max(x) AS hi FROM {pore}) AS m WHERE x = lo OR x = hi",
    "f5_seed_validation": "SELECT kind, count(*) AS n, min(site) AS first_offender FROM (SELECT c.site, CASE WHEN c.z < 0 OR c.z >= m.depth OR c.y < 0 OR c.y >= 30 OR c.x < 0 OR c.x >= 50 THEN 'outside' WHEN p.vid IS NULL THEN 'solid' ELSE 'pore' END AS kind FROM (SELECT c_custkey AS site, c_custkey % 12 - 1 AS z, c_custkey % 32 - 1 AS y, c_custkey * 7 % 53 - 1 AS x FROM {customer}) c CROSS JOIN (SELECT max(z) + 1 AS depth FROM {vox}) m LEFT JOIN {pore} p ON p.z = c.z AND p.y = c.y AND p.x = c.x) AS q GROUP BY kind",
    "f7_bounding_box": "SELECT p.vid, p.z - b.z0 AS z, p.y - b.y0 AS y, p.x - b.x0 AS x FROM {pore} p, (SELECT min(z) AS z0, greatest(min(y) - 2, 0) AS y0, least(max(y) + 3, 30) AS y1, greatest(min(x) - 2, 0) AS x0, least(max(x) + 3, 50) AS x1, max(z) + 1 AS z1 FROM {site} WHERE site_id < 9) AS b WHERE p.z >= b.z0 AND p.z < b.z1 AND p.y >= b.y0 AND p.y < b.y1 AND p.x >= b.x0 AND p.x < b.x1",
    "f9_point_probe": "SELECT v.vid, v.pore, o.site_id, o.d FROM {vox} v LEFT JOIN {owner} o ON o.vid = v.vid WHERE v.z = 0 AND v.y BETWEEN 3 AND 6 AND v.x BETWEEN 10 AND 14",
    "f10_two_sided_obstacle": "SELECT a.vid, a.other, a.gap FROM (SELECT vid, lead(vid) OVER (PARTITION BY z, y ORDER BY x) AS other, lead(x) OVER (PARTITION BY z, y ORDER BY x) - x - 1 AS gap FROM {pore}) a JOIN {owner} oa ON oa.vid = a.vid JOIN {owner} ob ON ob.vid = a.other AND ob.site_id = oa.site_id WHERE a.gap > 0",
    "f11_label_boundary": "SELECT DISTINCT s.kind, e.src AS vid FROM {side26} e LEFT JOIN {owner} a ON a.vid = e.src LEFT JOIN {owner} b ON b.vid = e.dst CROSS JOIN (VALUES ('four', 1, 0), ('eight', 2, 0), ('four_solid', 1, 1), ('eight_solid', 2, 1)) AS s(kind, most, solid) WHERE e.dz = 0 AND e.w2 <= s.most AND coalesce(a.site_id, -1) <> coalesce(b.site_id, -1) AND (s.solid = 1 OR e.pore AND a.site_id IS NOT NULL AND b.site_id IS NOT NULL)",
    "f12_adjacent_to_solid": "SELECT DISTINCT vid FROM {contact}",
    "f13_first_valid_projection": "SELECT y, x, min_by(site_id, r) AS label FROM (SELECT y, x, o.site_id, CASE WHEN z >= m.mid THEN z - m.mid ELSE 1000000 - z END AS r FROM {pore} p JOIN {owner} o ON o.vid = p.vid CROSS JOIN (SELECT CAST(floor((max(z) + 1) / 2) AS INT) AS mid FROM {vox}) AS m) AS q GROUP BY y, x",
    "f14_facelet_validity": "SELECT count(*) AS n, sum(CASE WHEN a.vid IS NULL OR b.vid IS NULL THEN 1 ELSE 0 END) AS off_pore, sum(CASE WHEN least(a.cell, b.cell) = f.owner AND greatest(a.cell, b.cell) = f.neighbor AND f.owner < f.neighbor THEN 0 ELSE 1 END) AS wrong_labels, sum(CASE WHEN abs(a.z - b.z) + abs(a.y - b.y) + abs(a.x - b.x) = 1 THEN 0 ELSE 1 END) AS apart, sum(CASE WHEN abs(a.z - b.z) * 0 + abs(a.y - b.y) * 1 + abs(a.x - b.x) * 2 = f.axis THEN 0 ELSE 1 END) AS wrong_axis FROM {face} f LEFT JOIN {cellvox} a ON a.vid = f.vid LEFT JOIN {cellvox} b ON b.vid = f.nb",
    "f19_tolerant_cast": "SELECT p_partkey, coalesce(try_cast(substring(p_brand, 7, 2) AS DOUBLE), 1e9) AS v FROM {part}",
    "f20_boolean_text": "SELECT o_orderkey, lower(trim(o_orderstatus)) IN ('f', 'true', '1', 'yes') AS flag FROM {orders}",
    "f21_row_lookup": "SELECT c_custkey, least(greatest(coalesce(c_acctbal, 0), 0), 5000) AS clipped FROM {customer} WHERE c_mktsegment LIKE '%O%'",
    "f22_exposed_faces": "SELECT vid, dz, dy, dx FROM {exposed}",
    "f23_pair_faces": "SELECT f.owner, f.neighbor, f.vid, f.nb, f.axis, f.sign, CAST(NULL AS BIGINT) AS solid FROM {face} f UNION ALL SELECT v.cell, -1, c.vid, c.nb, 2 - abs(c.dx) * 0 - abs(c.dy) * 1, c.dx + c.dy, c.nb FROM {contact} c JOIN {cellvox} v ON v.vid = c.vid WHERE c.dz = 0",
    "f24_best_wall_segment": WALL_SEGMENTS,
    "f27_affine_projection": "SELECT vid, round(x / 49.0 * 1000, 3) AS px, round(y / 29.0 * 600, 3) AS py FROM {vox}",
    # joins
    "j1_adjacency6": "SELECT src, dst FROM {edge}",
    "j2_adjacency26": "SELECT src, dst, round(sqrt(w2), 6) AS w FROM {edge26}",
    "j3_forward_pairs": "SELECT src, dst, dz, dy, dx FROM {forward}",
    "j4_periodic_pairs": "SELECT src, dst, dz, dy, dx FROM {wrapped}",
    "j5_attribute_lookup": "SELECT p.vid, coalesce(c.c_acctbal, -1) AS c FROM {pore} p LEFT JOIN {owner} o ON o.vid = p.vid LEFT JOIN {customer} c ON c.c_custkey = o.site_id",
    "j6_cell_broadcast": "SELECT v.vid, c.top FROM {cellvox} v JOIN (SELECT cell, max(val) AS top FROM {cellvox} GROUP BY cell) c ON c.cell = v.cell",
    "j8_pair_flux_lookup": "SELECT f.vid, f.nb, round(x.q, 6) AS q FROM {face} f LEFT JOIN {flux} x ON x.owner = f.owner AND x.neighbor = f.neighbor WHERE x.q IS NOT NULL",
    "j14_lattice_candidates": "SELECT c.vid, count(*) AS n, min(c.site_id) AS first_site FROM {latcand} c GROUP BY c.vid",
    "j17_run_ratio": "SELECT a.case_name, round(a.t / nullif(b.t, 0), 6) AS ratio FROM (SELECT l_returnflag AS case_name, sum(l_quantity) AS t FROM {lineitem} WHERE l_linestatus = 'O' GROUP BY l_returnflag) a JOIN (SELECT l_returnflag AS case_name, sum(l_quantity) AS t FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY l_returnflag) b ON a.case_name = b.case_name",
    "j18_spec_join": "SELECT c.c_custkey, coalesce(nullif(n.n_name, ''), 'unknown') AS label FROM {customer} c LEFT JOIN {nation} n ON n.n_nationkey = c.c_nationkey",
    "j19_resume_anti_join": "SELECT c.case_name, s.scale FROM (SELECT DISTINCT l_returnflag AS case_name FROM {lineitem}) c, (VALUES (1), (2), (4)) AS s(scale) WHERE NOT EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_returnflag = c.case_name AND l.l_linenumber = s.scale AND l.l_quantity = 50 AND l.l_tax = 0)",
    "j20_run_grid": "SELECT stride, face_mode, dt, n_steps FROM (VALUES (2), (3), (4)) AS a(stride), (VALUES ('center'), ('geodesic')) AS b(face_mode), (VALUES (0.1), (0.2)) AS c(dt), (VALUES (900), (1800)) AS d(n_steps)",
    "j21_reference_change": "SELECT o.o_orderkey, round(abs(o.o_totalprice - m.mean) / nullif(abs(m.mean), 0), 6) AS change FROM {orders} o LEFT JOIN (SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean FROM {orders} GROUP BY o_orderpriority) m ON m.o_orderpriority = o.o_orderpriority",
    "j22_case_policy": "SELECT n.n_name AS case_name, p.policy, n.n_nationkey + p.k AS metric, coalesce(s.best, 0) AS evidence FROM {nation} n CROSS JOIN (VALUES ('default', 100), ('accurate', 200)) AS p(policy, k) LEFT JOIN (SELECT s_nationkey, max(s_acctbal) AS best FROM {supplier} GROUP BY s_nationkey) s ON s.s_nationkey = n.n_nationkey WHERE p.policy = 'default' OR n.n_nationkey = 3",
    # iterative graph operators
    "i1_geodesic_ownership": "SELECT vid, site_id, d FROM {owner}",
    "i2_weighted_distances": "SELECT vid, round(d, 5) AS d FROM {owner26}",
    "i3_coordinate_key_ownership": "SELECT vid, site_id, d FROM {bykey}",
    "i4_first_arrival": "SELECT d, count(*) AS n FROM {owner} GROUP BY d",
    "i5_single_source": "SELECT vid, d FROM {single}",
    "i6_shortest_path_parents": "SELECT e.dst AS vid, min(e.src) AS parent, min(a.d) + 1 AS d FROM {single} a JOIN {edge} e ON e.src = a.vid JOIN {single} b ON b.vid = e.dst AND b.d = a.d + 1 GROUP BY e.dst",
    "i7_lattice_l1": "SELECT vid, l1, site_id FROM (SELECT vid, site_id, l1, row_number() OVER (PARTITION BY vid ORDER BY l1, site_id) AS r FROM {latcand}) AS q WHERE r = 1",
    "i14_stamped_core": "SELECT vid, site_id, round(d, 5) AS d FROM {stampcore}",
    "i15_stamping_radius": "SELECT site_id, round(radius, 6) AS radius FROM {stampradius}",
    "i22_components": "SELECT vid, root FROM {comp}",
    "i23_split_cells": "SELECT vid, label, cell_id, cell_by_site FROM {block}",
    "i24_component_of_seed": "SELECT c.vid FROM {comp} c JOIN (SELECT k.root FROM {comp} k JOIN {site} s ON s.vid = k.vid AND s.site_id = 0) r ON r.root = c.root",
    "i25_reachable": "SELECT c.vid FROM {comp} c JOIN (SELECT DISTINCT k.root FROM {comp} k JOIN {site} s ON s.vid = k.vid) r ON r.root = c.root",
    # aggregations
    "a1_bellman_certificate": "SELECT count(*) AS directed, max(CASE WHEN a.vid IS NOT NULL AND b.vid IS NOT NULL THEN greatest(b.d - a.d - 1, 0) END) AS residual, sum(CASE WHEN b.d = a.d + 1 AND a.site_id < b.site_id THEN 1 ELSE 0 END) AS tie_violations, sum(CASE WHEN b.vid IS NULL THEN 1 ELSE 0 END) + max(m.unassigned) AS unassigned FROM {edge} e LEFT JOIN {owner} a ON a.vid = e.src LEFT JOIN {owner} b ON b.vid = e.dst CROSS JOIN (SELECT sum(CASE WHEN o.vid IS NULL THEN 1 ELSE 0 END) AS unassigned FROM {pore} p LEFT JOIN {owner} o ON o.vid = p.vid) AS m",
    "a2_rho_d": "SELECT max(abs(a.d - b.d)) - 1 AS rho, count(*) AS directed FROM {edge} e JOIN {owner} a ON a.vid = e.src JOIN {owner} b ON b.vid = e.dst",
    "a3_directed_audit": "SELECT sum(CASE WHEN b.d > a.d + 1 OR (b.d = a.d + 1 AND b.site_id > a.site_id) THEN 1 ELSE 0 END) AS n_lex FROM {edge} e JOIN {owner} a ON a.vid = e.src JOIN {owner} b ON b.vid = e.dst",
    "a4_coverage": "SELECT count(o.vid) AS assigned, count(*) - count(o.vid) AS unassigned, max(o.d) AS max_d FROM {pore} p LEFT JOIN {owner} o ON o.vid = p.vid",
    "a5_unlabelled_fraction": "SELECT round(avg(CASE WHEN o.vid IS NULL THEN 1.0 ELSE 0.0 END), 8) AS r_unf FROM {pore} p LEFT JOIN {owner} o ON o.vid = p.vid",
    "a6_label_mismatch": "SELECT count(*) AS n, sum(CASE WHEN coalesce(o.site_id, -1) <> coalesce(CAST(b.label AS INT), -1) THEN 1 ELSE 0 END) AS mismatches FROM {owner} o FULL OUTER JOIN {block} b ON b.vid = o.vid",
    "a7_roi_fraction": "SELECT round(avg(CASE WHEN d > 2 THEN 1.0 ELSE 0.0 END), 8) AS eta_roi, round(1 - avg(CASE WHEN d > 2 THEN 1.0 ELSE 0.0 END), 8) AS eta_stamp FROM {owner}",
    "a8_accuracy": "SELECT round(avg(abs(o.d - w.d)), 5) AS mae, round(sqrt(avg((o.d - w.d) * (o.d - w.d))), 5) AS rmse, round(max(abs(o.d - w.d)), 5) AS max_err, round(coalesce(avg(CASE WHEN w.d > 1e-9 THEN abs(o.d - w.d) / w.d END), 0), 5) AS mre, round(avg(CASE WHEN o.site_id = w.site_id THEN 1.0 ELSE 0.0 END), 8) AS acc_rate, round(1 - avg(CASE WHEN o.site_id = w.site_id THEN 1.0 ELSE 0.0 END), 8) AS mismatch_rate FROM {owner} o JOIN {labels26} w ON w.vid = o.vid",
    "a9_cut_rate": "SELECT 'strict' AS mode, round(avg(cut), 8) AS r_cut, round(avg(islands), 8) AS rho_isl, round(avg(CASE WHEN NOT lost THEN islands END), 8) AS rho_seeded, sum(CASE WHEN lost THEN 1 ELSE 0 END) AS unseeded FROM (" + CUT.format("fieldpart", 16) + ") AS a UNION ALL SELECT 'through_unlabelled', round(avg(cut), 8), round(avg(islands), 8), round(avg(CASE WHEN NOT lost THEN islands END), 8), sum(CASE WHEN lost THEN 1 ELSE 0 END) FROM (" + CUT.format("freepart", 16) + ") AS b",
    "a10_cut_by_label": "SELECT label, max(total) AS total, count(*) AS parts, max(CASE WHEN r = 1 THEN n END) AS largest, max(CASE WHEN r = 2 THEN n END) AS second, sum(CASE WHEN n >= thr THEN 1 ELSE 0 END) AS kept, sum(CASE WHEN n >= thr THEN n ELSE 0 END) AS kept_voxels, round(max(CASE WHEN r = 1 THEN n END) / CAST(max(total) AS DOUBLE), 8) AS largest_fraction FROM (SELECT c.label, c.n, t.total, t.thr, row_number() OVER (PARTITION BY c.label ORDER BY c.n DESC, c.root) AS r FROM (SELECT label, root, count(*) AS n FROM {fieldpart} GROUP BY label, root) c JOIN (SELECT label, count(*) AS total, greatest(16, ceil(0.01 * count(*))) AS thr FROM {fieldpart} GROUP BY label) t ON t.label = c.label) AS q GROUP BY label ORDER BY largest_fraction, label LIMIT 40",
    "a11_cut_breakdown": "SELECT kind, count(*) AS cells FROM (SELECT CASE WHEN r.cut = 0 THEN 'whole' WHEN s.cut = 0 THEN 'threshold' WHEN f.cut = 0 THEN 'crack' ELSE 'true' END AS kind FROM (" + CUT.format("fieldpart", 1) + ") AS r JOIN (" + CUT.format("fieldpart", 16) + ") AS s ON s.label = r.label JOIN (" + CUT.format("freepart", 16) + ") AS f ON f.label = r.label) AS k GROUP BY kind",
    "a12_cell_moments": "SELECT cell, count(*) AS volume, round(avg(x + 0.5), 6) AS cx, round(avg(y + 0.5), 6) AS cy, round(avg(z + 0.5), 6) AS cz FROM {cellvox} GROUP BY cell",
    "a14_cell_graph": "SELECT owner, neighbor, area, round(conductance, 6) AS conductance, round(mean_geodesic_length, 6) AS mean_geodesic_length FROM {graph}",
    "a15_face_vectors": "SELECT owner, neighbor, area, ax, ay, az, round(fx, 6) AS fx, round(fy, 6) AS fy, round(fz, 6) AS fz FROM {facegeo}",
    "a16_geodesic_metric": "SELECT owner, neighbor, round(r_owner, 6) AS r_owner, round(r_neigh, 6) AS r_neigh, round(ell, 6) AS ell, round(w_owner, 6) AS w_owner, round(w_neigh, 6) AS w_neigh, round(t, 6) AS t, round(dx, 5) AS dx, round(dy, 5) AS dy, round(dz, 5) AS dz FROM {metric}",
    "a17_wall_facelets": "SELECT cell, wall_area FROM {wall}",
    "a18_wall_transmissibility": "SELECT cell, round(twall, 5) AS twall FROM {twall}",
    "a19_boundary_area": "SELECT cell, sum(CASE WHEN x = lo THEN 1 ELSE 0 END) AS inlet_area, sum(CASE WHEN x = hi THEN 1 ELSE 0 END) AS outlet_area FROM {cellvox}, (SELECT min(x) AS lo, max(x) AS hi FROM {pore}) AS m GROUP BY cell",
    "a21_component_summary": "SELECT count(*) AS parts, max(n) AS largest, round(max(n) / CAST(sum(n) AS DOUBLE), 8) AS largest_fraction, sum(CASE WHEN x0 = 0 AND x1 = 49 THEN 1 ELSE 0 END) AS spans_x, sum(CASE WHEN y0 = 0 AND y1 = 29 THEN 1 ELSE 0 END) AS spans_y, sum(CASE WHEN z0 = 0 AND z1 = top THEN 1 ELSE 0 END) AS spans_z FROM (SELECT c.root, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM {comp} c JOIN {pore} p ON p.vid = c.vid GROUP BY c.root) AS q CROSS JOIN (SELECT max(z) AS top FROM {vox}) AS m",
    "a22_block_labels": "SELECT vid, label FROM {block}",
    "a24_case_preflight": "SELECT concat('layer_', CAST(idiv(v.z,4) AS STRING)) AS case_name, count(*) AS n_total, sum(CASE WHEN v.pore THEN 1 ELSE 0 END) AS n_fl, round(avg(CASE WHEN v.pore THEN 1.0 ELSE 0.0 END), 8) AS porosity, '(4, 4, 4);(2, 4, 4);(2, 2, 2)' AS strides, concat(CAST(sum(CASE WHEN v.pore AND v.z % 4 = 2 AND v.y % 4 = 2 AND v.x % 4 = 2 THEN 1 ELSE 0 END) AS STRING), ';', CAST(sum(CASE WHEN v.pore AND v.z % 2 = 1 AND v.y % 4 = 2 AND v.x % 4 = 2 THEN 1 ELSE 0 END) AS STRING), ';', CAST(sum(CASE WHEN v.pore AND v.z % 2 = 1 AND v.y % 2 = 1 AND v.x % 2 = 1 THEN 1 ELSE 0 END) AS STRING)) AS seed_counts FROM {vox} v GROUP BY idiv(v.z,4)",
    "a25_reference_groups": "SELECT l_returnflag AS case_name, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi, round((max(l_quantity) - min(l_quantity)) / greatest(abs(avg(l_quantity)), 1e-300), 8) AS rel_span, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n_true, sum(CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END) AS n_false, concat_ws(';', max(CASE WHEN l_linestatus = 'F' THEN 'F' END), max(CASE WHEN l_linestatus = 'O' THEN 'O' END)) AS sources FROM {lineitem} GROUP BY l_returnflag",
    "a26_runtime_profile": "SELECT l_linestatus AS stage, count(*) AS calls, round(sum(l_quantity), 2) AS seconds, round(avg(l_quantity), 6) AS mean FROM {lineitem} GROUP BY l_linestatus",
    "a28_case_series": "SELECT l_returnflag AS case_name, l_linenumber AS step, round(avg(l_discount), 6) AS v FROM {lineitem} GROUP BY l_returnflag, l_linenumber",
    "a29_projection_audit": "SELECT kind, edges, max_abs_before, l2_before, small_after FROM (SELECT kind, count(*) AS edges FROM {fluxes} GROUP BY kind) k CROSS JOIN (SELECT round(max(abs(div)), 5) AS max_abs_before, round(sqrt(sum(div * div)), 5) AS l2_before, max(abs(after)) < 1e-6 AS small_after FROM {balance}) b",
    "a30_stage_audit": "SELECT sites > 20 AND assigned = 1.0 AND cells >= owned AND facelets > 0 AND edges > 0 AND projected >= edges AND worst < 0.0001 AS passed, sites, assigned, cells, facelets, edges, projected, missing FROM (SELECT (SELECT count(*) FROM {site}) AS sites, (SELECT round(avg(CASE WHEN o.vid IS NULL THEN 0.0 ELSE 1.0 END), 8) FROM {pore} p JOIN (SELECT DISTINCT k.root FROM {comp} k JOIN {site} s ON s.vid = k.vid) r ON TRUE JOIN {comp} c ON c.vid = p.vid AND c.root = r.root LEFT JOIN {owner} o ON o.vid = p.vid) AS assigned, (SELECT count(DISTINCT cell) FROM {cellvox}) AS cells, (SELECT count(DISTINCT site_id) FROM {owner}) AS owned, (SELECT count(*) FROM {face}) AS facelets, (SELECT count(*) FROM {graph}) AS edges, (SELECT count(*) FROM {fluxes}) AS projected, (SELECT max(abs(after)) FROM {balance}) AS worst, (SELECT count(*) FROM (VALUES ('sites'), ('ownership'), ('cells'), ('facelets'), ('edges'), ('projection'), ('walls')) AS w(name) LEFT JOIN (SELECT 'sites' AS found, count(*) AS n FROM {site} UNION ALL SELECT 'ownership', count(*) FROM {owner} UNION ALL SELECT 'cells', count(*) FROM {cellvox} UNION ALL SELECT 'facelets', count(*) FROM {face} UNION ALL SELECT 'edges', count(*) FROM {graph} UNION ALL SELECT 'projection', count(*) FROM {balance} UNION ALL SELECT 'walls', count(*) FROM {wall}) AS p ON p.found = w.name AND p.n > 0 WHERE p.found IS NULL) AS missing) AS q",
    "a31_timing_reconciliation": "SELECT run_id, line, round(seed_ms + label_ms + split_ms + geometry_ms - build_ms, 4) AS gap, abs(seed_ms + label_ms + split_ms + geometry_ms - build_ms) > 5e-4 AS breach FROM (SELECT l_orderkey AS run_id, l_linenumber AS line, l_discount * 10 AS seed_ms, l_tax * 10 AS label_ms, l_quantity / 10 AS split_ms, l_extendedprice / 1000 AS geometry_ms, l_discount * 10 + l_tax * 10 + l_quantity / 10 + l_extendedprice / 1000 + CASE WHEN l_linenumber = 7 THEN 0.002 WHEN l_linenumber = 6 THEN 0.0001 ELSE 0.0 END AS build_ms FROM {lineitem}) AS t",
    "a32_tile_fractions": "SELECT count(*) AS tiles, round(avg(CASE WHEN n_pore = n THEN 1.0 ELSE 0.0 END), 8) AS dense, round(avg(CASE WHEN n_pore = 0 THEN 1.0 ELSE 0.0 END), 8) AS empty, round(avg(CASE WHEN n_pore > 0 AND n_pore < n THEN 1.0 ELSE 0.0 END), 8) AS mixed, round(sum(n_pore) / CAST(sum(n) AS DOUBLE), 8) AS porosity, round(sum(CASE WHEN n_pore > 0 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 8) AS active_voxels FROM (SELECT idiv(z,4) AS tz, idiv(y,4) AS ty, idiv(x,4) AS tx, count(*) AS n, sum(CASE WHEN pore THEN 1 ELSE 0 END) AS n_pore FROM {vox} GROUP BY idiv(z,4), idiv(y,4), idiv(x,4)) AS q",
    # windows, sort, limit
    "w1_first_occurrence": "SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS r FROM {lineitem}) AS q WHERE r = 1",
    "w3_stratified_sample": "SELECT vid, bin FROM (SELECT vid, bin, row_number() OVER (ORDER BY h, vid) AS overall FROM (SELECT vid, bin, h, row_number() OVER (PARTITION BY bin ORDER BY h, vid) AS r FROM (SELECT p.vid, CAST(floor((p.x - m.lo) * 42 / CAST(m.hi + 1 - m.lo AS DOUBLE)) AS INT) AS bin, (p.vid * 7919 + 13) % 10007 AS h FROM {pore} p CROSS JOIN (SELECT min(x) AS lo, max(x) AS hi FROM {pore} WHERE x > 1 AND x < 48) AS m WHERE p.x > 1 AND p.x < 48) AS b) AS s WHERE r <= greatest(2, ceil(360 / 42.0))) AS t WHERE overall <= 360",
    "w4_hash_sample": "SELECT vid FROM {pore} ORDER BY (vid * 7919 + 13) % 10007, vid LIMIT 200",
    "w5_random_ids": "SELECT vid FROM {pore} WHERE (vid * 7919) % 31 = 3 ORDER BY vid LIMIT 100",
    "w7_top_labels": "SELECT cell, n FROM (SELECT cell, count(*) AS n FROM {cellvox} GROUP BY cell) AS q ORDER BY n DESC, cell LIMIT 55",
    "w9_best_eight": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice, l_orderkey, l_linenumber LIMIT 8",
    "w10_case_order": "SELECT n.n_name, coalesce(r.rank, 999) AS rank FROM {nation} n LEFT JOIN (VALUES (0, 2), (1, 0), (2, 1), (3, 4)) AS r(k, rank) ON r.k = n.n_regionkey ORDER BY rank, n.n_name",
    "w11_log_spaced": "SELECT DISTINCT CAST(floor(power(2.0, k / 2.0) + 0.5) AS INT) AS n FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) AS s(k)",
    "w12_unique_candidates": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber) AS r FROM {lineitem} WHERE l_partkey <= 2600) AS q WHERE r = 1",
    # sets and scalars
    "u1_concat_parts": "SELECT vid, nb, axis FROM {face} WHERE axis = 0 UNION ALL SELECT vid, nb, axis FROM {face} WHERE axis = 1 UNION ALL SELECT vid, nb, axis FROM {face} WHERE axis = 2",
    "u2_edge_union": "SELECT g.owner, g.neighbor, 'internal' AS kind, g.area FROM {graph} g UNION ALL SELECT owner, neighbor, kind, CAST(conductance AS BIGINT) FROM {fluxes} WHERE kind <> 'internal'",
    "u3_upsert": "SELECT k, v FROM (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY p) AS r FROM (SELECT c_nationkey AS k, max(c_acctbal) AS v, 0 AS p FROM {customer} WHERE c_nationkey < 12 GROUP BY c_nationkey UNION ALL SELECT n_nationkey, 0.0, 1 FROM {nation}) AS u) AS q WHERE r = 1",
    "u4_set_difference": "SELECT vid FROM {pore} EXCEPT SELECT vid FROM {owner}",
    "u5_overlay_panels": "SELECT 'a' AS panel, l_returnflag AS case_name, CAST(count(*) AS DOUBLE) AS v FROM {lineitem} GROUP BY l_returnflag UNION ALL SELECT 'b', l_linestatus, round(avg(l_tax), 6) FROM {lineitem} GROUP BY l_linestatus",
    "x1_selector": "SELECT m.tz, m.ty, m.tx, a.mode, CASE WHEN m.near_wall >= 0.35 AND m.porosity >= 0.45 THEN 'fibrous_high_wall_contact' WHEN m.porosity < 0.45 AND m.mean_solid >= 0.25 THEN 'granular_low_porosity' ELSE 'structured_or_open_channel' END AS selector_class, CASE WHEN m.near_wall >= 0.35 AND m.porosity >= 0.45 THEN CASE WHEN a.mode = 'accuracy' THEN 'gfps_admissible' ELSE 'wall_biased' END WHEN m.porosity < 0.45 AND m.mean_solid >= 0.25 THEN 'stride_offset' ELSE 'stride_half_admissible' END AS seed_family FROM (" + METRICS + ") AS m CROSS JOIN (VALUES ('default'), ('accuracy')) AS a(mode)",
    "x2_closure_status": "SELECT c.case_name, k.closure, CASE WHEN k.closure = 'patch_throat_size_factor' AND c.case_name IN ('bentheimer_sandstone_crop', 'fibrous_filter_proxy') THEN 'reference_only_not_current_method' WHEN k.closure = 'patch_throat_size_factor' THEN 'not_for_main' ELSE 'rejected' END AS status, CASE WHEN k.closure = 'patch_throat_size_factor' THEN 'network' WHEN k.closure LIKE '%component_merged%' AND k.closure NOT LIKE '%periodic_lift%' THEN 'overpredicts' ELSE 'periodic_lift' END AS reason FROM (VALUES ('orthogonal_duct'), ('skewed_duct'), ('bentheimer_sandstone_crop'), ('fibrous_filter_proxy')) AS c(case_name) CROSS JOIN (VALUES ('patch_throat_size_factor'), ('component_merged_factor'), ('component_merged_periodic_lift'), ('periodic_lift_only')) AS k(closure)",
    "x3_evidence_routing": "SELECT s.case_name, s.family, CASE WHEN s.label IS NULL THEN 'main' ELSE 'protocol' END AS source, coalesce(CASE WHEN s.label IS NULL THEN m.e_k_percent ELSE p.e_k_percent END, 100 * CASE WHEN s.label IS NULL THEN m.e_k ELSE p.e_k END) AS e_k_percent, coalesce(CASE WHEN s.label IS NULL THEN m.speedup END, CASE WHEN s.label IS NULL THEN NULL ELSE p.speedup_est END) AS speedup FROM (SELECT c.case_name, f.family, r.label FROM (VALUES ('fibrous_filter_proxy'), ('bentheimer_sandstone_crop'), ('orthogonal_duct')) AS c(case_name) CROSS JOIN (VALUES ('wall_biased'), ('gfps_admissible'), ('stride_offset'), ('stride_half_admissible')) AS f(family) LEFT JOIN (VALUES ('fibrous_filter_proxy', 'wall_biased', 'fibrous_fast_fixed_beta'), ('fibrous_filter_proxy', 'gfps_admissible', 'fibrous_accurate_fixed_beta'), ('bentheimer_sandstone_crop', 'stride_offset', 'bentheimer_default_offset')) AS r(case_name, family, label) ON r.case_name = c.case_name AND r.family = f.family) AS s LEFT JOIN (SELECT 'orthogonal_duct' AS case_name, 2.5 AS e_k_percent, 0.5 AS e_k, 7.0 AS speedup UNION ALL SELECT 'fibrous_filter_proxy', NULL, 0.125, 3.0 UNION ALL SELECT 'bentheimer_sandstone_crop', 4.0, 0.75, NULL) m ON m.case_name = s.case_name LEFT JOIN (SELECT 'fibrous_fast_fixed_beta' AS label, NULL AS e_k_percent, 0.25 AS e_k, 5.0 AS speedup_est UNION ALL SELECT 'fibrous_accurate_fixed_beta', 1.5, 0.5, NULL) p ON p.label = s.label",
    "x4_table_projection": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS n, round(100 * l_discount, 4) AS percent, round(1000 * l_tax, 4) AS ms FROM {lineitem}",
    "x5_alias_coalesce": "SELECT c_custkey, coalesce(nullif(beta, ''), nullif(wall_beta, ''), nullif(beta_old, '')) AS beta FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING) ELSE '' END AS beta, CASE WHEN c_custkey % 3 = 1 THEN CAST(2 * c_custkey AS STRING) END AS wall_beta, CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END AS beta_old FROM {customer}) AS t",
    "x6_metric26": "SELECT vid, round((g - m) + sqrt(2) * (m - l) + sqrt(3) * l, 6) AS d26 FROM (SELECT vid, greatest(z, y, x) AS g, least(z, y, x) AS l, z + y + x - greatest(z, y, x) - least(z, y, x) AS m FROM {vox}) AS q",
    "x7_relative_error": "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_tax = 0 THEN CASE WHEN l_discount = 0 THEN 0.0 ELSE -1.0 END ELSE abs(l_discount - l_tax) / greatest(abs(l_tax), 1e-300) END, 5) AS rel, round(100 * abs(l_discount - l_tax) / greatest(abs(l_quantity), 1e-300), 8) AS percent, round(l_extendedprice / greatest(abs(l_quantity), 1e-300), 8) AS speed_up FROM {lineitem}",
    "x8_wall_scale": "SELECT c.cell, round(least(greatest(power(m.ccomp / 64.0, 0.25), 0.05), 20.0), 6) AS global_scale, round(least(greatest(power(greatest(c.volume / 64.0, 1e-300), 0.25), 0.05), 20.0), 6) AS scale, round(coalesce(t.twall, 0) * 1.5 * least(greatest(power(greatest(c.volume / 64.0, 1e-300), 0.25), 0.05), 20.0), 4) AS twall FROM {cellgeo} c LEFT JOIN {twall} t ON t.cell = c.cell CROSS JOIN (SELECT sum(volume) / count(*) AS ccomp FROM {cellgeo}) AS m",
    "x9_vector_norm": "SELECT vid, round(sqrt(z * z + y * y + x * x), 6) AS norm, round(x / greatest(sqrt(z * z + y * y + x * x), 1e-12), 6) AS ux FROM {vox}",
    # finite-volume algebra
    "l1_laplacian": "SELECT row, col, round(val, 6) AS val FROM {matrix}",
    "l2_resistor_matrix": "SELECT row, col, val FROM {resistor}",
    "l2_resistor_rhs": "SELECT row, rhs FROM {resistorrhs}",
    "l3_pressure_solution": "SELECT p.vid, p.pressure BETWEEN -1e-6 AND 1.000001 AS bounded, abs(r.rest) < 1e-5 AS solved FROM {pressure} p JOIN {residual} r ON r.vid = p.vid",
    "l3_direct_fallback": "SELECT vid, pressure BETWEEN -1e-9 AND 1.000000001 AS bounded, abs(rest) < 1e-8 AS solved FROM {directrest}",
    "l4_voxel_velocity": "SELECT e.src AS vid, round(sum(greatest(a.val - b.val, 0) * e.dx), 3) AS vx, round(sum(greatest(a.val - b.val, 0) * e.dy), 3) AS vy, round(sum(greatest(a.val - b.val, 0) * e.dz), 3) AS vz FROM {edge} e JOIN {pore} a ON a.vid = e.src JOIN {pore} b ON b.vid = e.dst GROUP BY e.src",
    "l5_incidence": "SELECT owner AS cell, owner, neighbor, 1 AS b FROM {fluxes} UNION ALL SELECT neighbor, owner, neighbor, -1 FROM {fluxes} WHERE neighbor >= 0",
    "l6_target_flux": "SELECT owner, neighbor, kind, round(q, 6) AS q FROM {fluxes}",
    "l7_divergence": "SELECT cell, round(div, 5) AS div FROM {balance}",
    "l8_conservative_projection": "SELECT cell, round(div, 5) AS target, abs(after) < 1e-6 AS conservative FROM {balance}",
    "l9_normal_signs": "SELECT vid, nb, axis, sign FROM {face}",
    "l10_cell_velocity": "SELECT cell, round(sum(v * nx) / sum(a), 6) AS vx, round(sum(v * ny) / sum(a), 6) AS vy, round(sum(v * nz) / sum(a), 6) AS vz, sum(a) AS area FROM (SELECT c.cell, x.q / g.area AS v, CASE WHEN f.axis = 2 THEN f.sign ELSE 0 END AS nx, CASE WHEN f.axis = 1 THEN f.sign ELSE 0 END AS ny, CASE WHEN f.axis = 0 THEN f.sign ELSE 0 END AS nz, 1 AS a FROM {face} f JOIN {fluxes} x ON x.owner = f.owner AND x.neighbor = f.neighbor JOIN {graph} g ON g.owner = f.owner AND g.neighbor = f.neighbor JOIN (SELECT owner AS o, neighbor AS n, owner AS cell FROM {graph} UNION ALL SELECT owner, neighbor, neighbor FROM {graph}) c ON c.o = f.owner AND c.n = f.neighbor UNION ALL SELECT owner, CASE WHEN kind = 'inlet' THEN -q ELSE q END, 1, 0, 0, CAST(conductance AS BIGINT) FROM {fluxes} WHERE kind <> 'internal') AS u GROUP BY cell",
    "l11_darcy_readout": "SELECT round(sum(x.q * m.dx) / max(v.total), 7) AS ux, round(sum(x.q * m.dy) / max(v.total), 7) AS uy, round(sum(x.q * m.dz) / max(v.total), 7) AS uz, round(0.5 * sum(x.q * m.dx) / max(v.total) / 2.0, 8) AS k_x, round(abs(0.5 * sum(x.q * m.dx) / max(v.total) / 2.0 - 0.01) / greatest(abs(0.01), 1e-300), 5) AS e_k FROM {flux} x JOIN {metric} m ON m.owner = x.owner AND m.neighbor = x.neighbor CROSS JOIN (SELECT sum(volume) AS total FROM {cellgeo}) AS v",
    "l12_lsq_gradient": "SELECT cell, round(mxx, 4) AS mxx, round(mxy, 4) AS mxy, round(mxz, 4) AS mxz, round(myy, 4) AS myy, round(myz, 4) AS myz, round(mzz, 4) AS mzz, round(gx, 4) AS gx, round(gy, 4) AS gy, round(gz, 4) AS gz FROM {gradient}",
    "l19_time_loop": "SELECT cell, step, CASE WHEN step IN (3, 6) THEN abs(div) < 1e-6 END AS projected, rel_change >= 0 AS finite FROM {timeloop}",
    "l18_block_cg": "SELECT cell, same FROM {blockcg}",
    "l17_momentum_predictor": "SELECT cell, solved FROM {predictor}",
    "l16_pressure_modes": "SELECT cell, agree FROM {pressuremodes}",
    "l15_monolithic_stokes": "SELECT cell, abs(div) < 1e-7 AS divergence_free, momentum < 1e-6 AS balanced FROM {stokes}",
    "l14_projected_scalar": "SELECT cell, abs(div) < 1e-6 AS divergence_free, step FROM {projectedflow}",
    "l13_scalar_stokes": "SELECT cell, solved, ux >= 0 AS forward FROM {scalarflow}",
    "l20_reductions": "SELECT round(max(abs(b.div / c.volume)), 6) AS mass_inf, round(sqrt(avg((b.div / c.volume) * (b.div / c.volume))), 6) AS mass_l2, round(sum(p.p * c.volume) / sum(c.volume), 6) AS mean_u, round(0.5 * sum(p.p * c.volume) / sum(c.volume) / 2.0, 6) AS k_eff, sum(CASE WHEN isnan(b.div) THEN 1 ELSE 0 END) > 0 AS has_nan FROM {balance} b JOIN {cellgeo} c ON c.cell = b.cell JOIN {press} p ON p.cell = b.cell",
    "l21_flux_error": "SELECT count(*) AS faces, count(r.owner) AS matched, round(sqrt(sum((x.q - r.q) * (x.q - r.q))) / greatest(sqrt(sum(r.q * r.q)), 1e-300), 6) AS e_phi FROM {flux} x LEFT JOIN {metricflux} r ON r.owner = x.owner AND r.neighbor = x.neighbor",
}
