"""The registered queries in DuckDB SQL: the pixel work on exploded pixels, an implementation of its own."""

from __future__ import annotations

# File name extensions of decodable and of raw photos.
_STANDARD = "('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp', 'webp')"
_RAW = "('cr2', 'cr3', 'crw', 'nef', 'nrw', 'arw', 'srf', 'sr2', 'orf', 'rw2', 'raf', 'dng', 'pef', 'ptx', 'srw', 'x3f', '3fr', 'erf', 'kdc', 'mrw', 'raw', 'mos', 'iiq', 'rwl', 'dcr')"

_PHOTOS = f"""
frames AS (SELECT vec_id, embedding, unnest(range(0, vec_id % 3 + 1))::BIGINT AS k FROM embeddings),
all_photos AS (SELECT *, vec_id * 4 + k AS photo_id,
  '/roll' || (vec_id // 10) || CASE WHEN vec_id % 29 = 0 THEN '/disqualified' ELSE '' END || '/' || CASE WHEN vec_id % 5 = 0 THEN '_' ELSE '' END
  || 'IMG' || ((vec_id * 4 + k) % 400) || '.' || (['jpg', 'JPG', 'png', 'tiff', 'nef', 'webp', 'txt', 'jpeg'])[vec_id % 8 + 1] AS path FROM frames),
classed AS (SELECT *, CASE WHEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN {_STANDARD} THEN 'standard' WHEN lower(regexp_extract(path, '\\.([^./]*)$', 1)) IN {_RAW} THEN 'raw' ELSE 'unsupported' END AS format_class FROM all_photos),
photos AS (SELECT * FROM classed WHERE format_class <> 'unsupported' AND NOT contains(path, '/disqualified/'))"""

_PIXELS = f"""{_PHOTOS},
bytes AS (SELECT photo_id, p, greatest(0, least(255, floor(embedding[p + 1]::DOUBLE * pow(2, 2 + vec_id % 7) + 128) + 6 * k + CASE WHEN k > 0 AND p = (vec_id * 7 + k * 13) % 64 THEN 40 ELSE 0 END))::BIGINT AS v
  FROM photos, range(0, 64) AS t(p)),
px AS (SELECT a.photo_id, a.p, a.p % 8 AS x, a.p // 8 AS y, a.v AS r, b.v AS g, c.v AS b FROM bytes a JOIN bytes b ON a.photo_id = b.photo_id AND b.p = (a.p + 21) % 64 JOIN bytes c ON a.photo_id = c.photo_id AND c.p = (a.p + 42) % 64),
gray AS (SELECT *, round_even(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b, 0)::BIGINT AS l FROM px)"""


def _laplacian(name: str, x0: int, y0: int, w: int, h: int) -> str:
    """Laplacian of each photo's part (x0, y0, w, h) with repeated edges, one row per pixel."""
    lines = " ".join(f"JOIN gray {t} ON {t}.photo_id = c.photo_id AND {t}.x = {x} AND {t}.y = {y}" for t, x, y in (("n", "c.x", f"greatest(c.y - 1, {y0})"), ("s", "c.x", f"least(c.y + 1, {y0 + h - 1})"), ("w", f"greatest(c.x - 1, {x0})", "c.y"), ("e", f"least(c.x + 1, {x0 + w - 1})", "c.y")))
    return f"{name} AS (SELECT c.photo_id, c.x, c.y, n.l + s.l + w.l + e.l - 4 * c.l AS v FROM gray c {lines} WHERE c.x >= {x0} AND c.x < {x0 + w} AND c.y >= {y0} AND c.y < {y0 + h})"


# the parts of an 8 x 8 image: all of it, 0.6, 0.5 and 0.45 of either edge
_PARTS = {"var_full": (0, 0, 8, 8), "var_object": (1, 1, 5, 5), "var_half": (2, 2, 4, 4), "var_portrait": (2, 2, 4, 4)}
_VARIANCES = ", ".join(_laplacian(f"lap_{n}", *part) for n, part in _PARTS.items()) + ", " + ", ".join(f"{n}_t AS (SELECT photo_id, (count(*) * sum(v * v) - sum(v) * sum(v))::DOUBLE / (count(*) * count(*))::DOUBLE AS {n} FROM lap_{n} GROUP BY photo_id)" for n in _PARTS)

_FEATURES = f"""{_PIXELS}, {_VARIANCES},
sums AS (SELECT photo_id, count(*) AS n_px, sum(l) AS sum_l, sum(l * l) AS sum_l2, count(*) FILTER (WHERE l <= 3 OR l >= 252) AS n_clipped, sum(r - g) AS sum_rg, sum((r - g) * (r - g)) AS sum_rg2,
  sum(r + g - 2 * b) AS sum_yb2x, sum((r + g - 2 * b) * (r + g - 2 * b)) AS sum_yb2x2 FROM gray GROUP BY photo_id),
energies AS (SELECT photo_id, sum(abs(v)) AS energy, coalesce(sum(abs(v)) FILTER (WHERE abs(x - 8 / 3e0) <= 1 OR abs(x - 16 / 3e0) <= 1 OR abs(y - 8 / 3e0) <= 1 OR abs(y - 16 / 3e0) <= 1), 0) AS energy_thirds FROM lap_var_full GROUP BY photo_id),
features AS (SELECT p.photo_id, p.path, s.* EXCLUDE (photo_id), e.energy, e.energy_thirds, var_full, var_object, var_half, var_portrait,
  CASE WHEN var_full <= 1 THEN 'landscape' WHEN var_half / var_full > 1.6e0 THEN 'object' ELSE 'landscape' END AS mode
  FROM photos p JOIN sums s USING (photo_id) JOIN energies e USING (photo_id) JOIN var_full_t USING (photo_id) JOIN var_object_t USING (photo_id) JOIN var_half_t USING (photo_id) JOIN var_portrait_t USING (photo_id))"""

_SCORED = f"""{_FEATURES},
raw_scores AS (SELECT *, CASE WHEN mode = 'object' THEN var_object ELSE var_full END AS score FROM features),
scored AS (SELECT photo_id AS seq, path, mode, score, var_full, var_object, var_portrait,
  CASE WHEN score <= 0 THEN 0 ELSE 100 * score / (score + 100) END AS sharpness,
  greatest(0, least(100, 100 * (1 - abs(sum_l / n_px::DOUBLE - 128) / 128) - 100 * (n_clipped / n_px::DOUBLE))) AS exposure,
  greatest(0, least(100, 100 * sqrt((n_px * sum_l2 - sum_l * sum_l) / (n_px * n_px)::DOUBLE) / 64)) AS contrast,
  greatest(0, least(100, 100 * (sqrt(greatest(sum_rg2 / n_px::DOUBLE - pow(sum_rg / n_px::DOUBLE, 2), 0) + greatest(sum_yb2x2 / n_px::DOUBLE / 4 - pow(sum_yb2x / n_px::DOUBLE / 2, 2), 0))
    + 0.3e0 * sqrt(pow(sum_rg / n_px::DOUBLE, 2) + pow(sum_yb2x / n_px::DOUBLE / 2, 2))) / 110)) AS color,
  CASE WHEN energy <= 0 THEN 50 ELSE greatest(0, least(100, 50 + 50 * ((energy_thirds / energy::DOUBLE - (1 - 0.75e0 * 0.75e0)) / (0.75e0 * 0.75e0)))) END AS composition
  FROM raw_scores),
weighed AS (SELECT *, (sharpness * 0.25::FLOAT::DOUBLE + exposure * 0.15::FLOAT::DOUBLE + contrast * 0.1::FLOAT::DOUBLE + color * 0.1::FLOAT::DOUBLE + composition * 0.25::FLOAT::DOUBLE)
  / (0.25::FLOAT::DOUBLE + 0.15::FLOAT::DOUBLE + 0.1::FLOAT::DOUBLE + 0.1::FLOAT::DOUBLE + 0.25::FLOAT::DOUBLE) AS overall FROM scored)"""

_HASHED = """
taps AS (SELECT i, j, greatest(0, 1 - abs(j + 0.5e0 - (i + 0.5e0) * (8e0 / 9e0))) AS w FROM range(0, 9) AS a(i), range(0, 8) AS b(j)
  WHERE j >= greatest(floor((i + 0.5e0) * (8e0 / 9e0) - 1), 0) AND j <= least(ceil((i + 0.5e0) * (8e0 / 9e0) + 1), 7)),
tap_sums AS (SELECT i, 1e0 / sum(w) AS f FROM taps GROUP BY i),
small AS (SELECT photo_id, y, i, round_even(sum(r * w) * any_value(f), 0) AS r, round_even(sum(g * w) * any_value(f), 0) AS g, round_even(sum(b * w) * any_value(f), 0) AS b FROM px JOIN taps ON px.x = taps.j JOIN tap_sums USING (i) GROUP BY photo_id, y, i),
small_gray AS (SELECT photo_id, y, i, round_even(0.2126e0 * r + 0.7152e0 * g + 0.0722e0 * b, 0) AS l FROM small),
bits AS (SELECT a.photo_id, sum(CASE WHEN a.l > b.l THEN pow(2::HUGEINT, a.y * 8 + a.i)::HUGEINT ELSE 0::HUGEINT END)::HUGEINT AS u FROM small_gray a JOIN small_gray b ON a.photo_id = b.photo_id AND a.y = b.y AND b.i = a.i + 1 GROUP BY a.photo_id),
hashes AS (SELECT photo_id, (CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::BIGINT AS phash FROM bits)"""

_PAIRS = "distinct_hashes AS (SELECT DISTINCT phash FROM hashed), pairs AS (SELECT a.phash AS hash_a, b.phash AS hash_b, bit_count(xor(a.phash, b.phash))::INT AS distance FROM distinct_hashes a JOIN distinct_hashes b ON a.phash < b.phash AND bit_count(xor(a.phash, b.phash)) <= 6)"

_GROUPS = f"""{_PAIRS},
edges AS (SELECT hash_a AS x, hash_b AS y FROM pairs UNION ALL SELECT hash_b, hash_a FROM pairs),
closure AS (SELECT phash AS x, phash AS y FROM distinct_hashes UNION SELECT c.x, e.y FROM closure c JOIN edges e ON c.y = e.x),
components AS (SELECT x AS phash, min(y) AS component FROM closure GROUP BY x),
members AS (SELECT path, seq, component FROM hashed JOIN components USING (phash)),
groups AS (SELECT component, count(*) AS group_size, min(seq) AS first_seq FROM members GROUP BY component HAVING count(*) > 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY group_size DESC, first_seq) AS group_rank FROM groups),
grouped AS (SELECT group_rank, group_size, row_number() OVER (PARTITION BY component ORDER BY seq) AS member_rank, path, seq FROM members JOIN ranked USING (component)),
winners AS (SELECT group_rank, path, seq, overall FROM (SELECT group_rank, path, seq, overall, row_number() OVER (PARTITION BY group_rank ORDER BY overall DESC, seq) AS nth FROM grouped JOIN weighed USING (path, seq)) WHERE nth = 1),
alone AS (SELECT NULL::BIGINT AS group_rank, path, seq, overall FROM weighed JOIN hashed USING (path, seq) WHERE NOT EXISTS (SELECT 1 FROM grouped g WHERE g.path = weighed.path AND g.seq = weighed.seq)),
found AS (SELECT * FROM winners UNION ALL SELECT * FROM alone)"""


def _with(ctes: str, query: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{query}"


def _grouped(query: str, survivors: bool) -> str:
    hashed = f"hashed AS (SELECT path, seq, phash FROM weighed JOIN hashes ON seq = photo_id{' WHERE score > 32' if survivors else ''})"
    return _with(f"{_SCORED}, {_HASHED}, {hashed}, {_GROUPS}", query, recursive=True)


#: The same without an input order, as a scan's results come: paths decide ties.
_GROUPS_BY_PATH = _GROUPS.replace("min(seq) AS first_seq", "min(path) AS first_seq").replace("ORDER BY seq)", "ORDER BY path)").replace("ORDER BY overall DESC, seq)", "ORDER BY overall DESC, path)")


def _scanned(query: str) -> str:
    return _grouped(query, True).replace(_GROUPS, _GROUPS_BY_PATH)


_FLAGGED = """
out_names AS (SELECT DISTINCT regexp_extract(path, '[^/]*$') AS file_name FROM all_photos WHERE photo_id % 11 = 0),
low AS (SELECT path, seq, regexp_extract(path, '[^/]*$') AS file_name FROM scored WHERE score <= 32),
plan AS (SELECT path, '/photos/disqualified/' || file_name AS target,
  CASE WHEN row_number() OVER (PARTITION BY file_name ORDER BY seq, path) = 1 AND file_name NOT IN (SELECT file_name FROM out_names) THEN 'moved' ELSE 'failed' END AS status FROM low)"""

_PRIORS = """
cells AS (
  SELECT 0 AS start, (j * 40 + i) * 3 + b AS nth, i, j, 40 AS cols, 30 AS rws, ([10, 16, 24])[b + 1] AS edge FROM range(0, 40) x(i), range(0, 30) y(j), range(0, 3) z(b)
  UNION ALL SELECT 3600, (j * 20 + i) * 2 + b, i, j, 20, 15, ([32, 48])[b + 1] FROM range(0, 20) x(i), range(0, 15) y(j), range(0, 2) z(b)
  UNION ALL SELECT 4200, (j * 10 + i) * 2 + b, i, j, 10, 8, ([64, 96])[b + 1] FROM range(0, 10) x(i), range(0, 8) y(j), range(0, 2) z(b)
  UNION ALL SELECT 4360, (j * 5 + i) * 3 + b, i, j, 5, 4, ([128, 192, 256])[b + 1] FROM range(0, 5) x(i), range(0, 4) y(j), range(0, 3) z(b)),
priors AS (SELECT (start + nth)::INT AS prior_idx, ((i + 0.5)::FLOAT / cols::FLOAT)::FLOAT AS pcx, ((j + 0.5)::FLOAT / rws::FLOAT)::FLOAT AS pcy, least(edge::FLOAT / 320::FLOAT, 1)::FLOAT AS pw, least(edge::FLOAT / 240::FLOAT, 1)::FLOAT AS ph FROM cells),
detections AS (SELECT vec_id * 4 AS photo_id, (CASE WHEN weaker THEN (vec_id * 37 + i * 61 + 1) % 4421 ELSE (vec_id * 37 + i * 61) % 4420 END)::INT AS prior_idx,
  (0.5::FLOAT + (embedding[i + 1]::FLOAT * CASE WHEN weaker THEN 0.96875::FLOAT ELSE 1::FLOAT END)::FLOAT)::FLOAT AS face_score, embedding[i + 17]::FLOAT AS lx, embedding[i + 33]::FLOAT AS ly, embedding[i + 49]::FLOAT AS lw, embedding[64 - i]::FLOAT AS lh FROM embeddings, range(0, 16) t(i), (VALUES (false), (true)) u(weaker)),
sized AS (SELECT photo_id, prior_idx, face_score, (lx * 0.1::FLOAT * pw + pcx)::FLOAT AS cx, (ly * 0.1::FLOAT * ph + pcy)::FLOAT AS cy, (exp((lw * 0.2::FLOAT)::DOUBLE)::FLOAT * pw)::FLOAT AS w, (exp((lh * 0.2::FLOAT)::DOUBLE)::FLOAT * ph)::FLOAT AS h
  FROM detections JOIN priors USING (prior_idx) WHERE face_score > 0.7::FLOAT),
boxes AS (SELECT photo_id, prior_idx, face_score, (cx - w / 2::FLOAT)::FLOAT AS x1, (cy - h / 2::FLOAT)::FLOAT AS y1, (cx + w / 2::FLOAT)::FLOAT AS x2, (cy + h / 2::FLOAT)::FLOAT AS y2 FROM sized)"""

_AREA = "(greatest(({0}.x2 - {0}.x1)::FLOAT, 0::FLOAT) * greatest(({0}.y2 - {0}.y1)::FLOAT, 0::FLOAT))::FLOAT"
_BOTH = "(greatest((least(k.x2, o.x2) - greatest(k.x1, o.x1))::FLOAT, 0::FLOAT) * greatest((least(k.y2, o.y2) - greatest(k.y1, o.y1))::FLOAT, 0::FLOAT))::FLOAT"
_BOX = "struct_pack(prior_idx := o.prior_idx, face_score := o.face_score, x1 := o.x1, y1 := o.y1, x2 := o.x2, y2 := o.y2)"
_NMS = f"""{_PRIORS.strip()},
ordered AS (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY face_score DESC, prior_idx) AS place FROM boxes),
steps AS (SELECT photo_id, place, [{_BOX}] AS kept FROM ordered o WHERE place = 1
  UNION ALL SELECT s.photo_id, o.place, CASE WHEN len(list_filter(s.kept, lambda k: ({_BOTH} / ({_AREA.format("k")} + {_AREA.format("o")} - {_BOTH} + 0.00001::FLOAT))::FLOAT > 0.3::FLOAT)) = 0 THEN list_append(s.kept, {_BOX}) ELSE s.kept END
  FROM steps s JOIN ordered o ON o.photo_id = s.photo_id AND o.place = s.place + 1),
kept_boxes AS (SELECT photo_id, unnest(kept, recursive := true) FROM (SELECT photo_id, arg_max(kept, place) AS kept FROM steps GROUP BY photo_id))"""
_PIXEL_EDGE = "(greatest(least({0}, 1::FLOAT), 0::FLOAT) * 8::FLOAT)::FLOAT AS {0}"
_MAIN = f"""{_NMS},
pixel_faces AS (SELECT photo_id, prior_idx, face_score, {", ".join(_PIXEL_EDGE.format(c) for c in ("x1", "y1", "x2", "y2"))} FROM kept_boxes),
large_faces AS (SELECT *, {_AREA.format("p")} AS area FROM pixel_faces p WHERE ({_AREA.format("p")} / 64::FLOAT)::FLOAT >= 0.001::FLOAT),
main_faces AS (SELECT * FROM (SELECT l.*, path, row_number() OVER (PARTITION BY photo_id ORDER BY area DESC, face_score DESC, prior_idx) AS nth FROM large_faces l JOIN photos USING (photo_id)) WHERE nth = 1),
subjects AS (SELECT photo_id, 0.6e0 * greatest(0, least(100, 100 * (area::DOUBLE / 64e0) / 0.15e0))
  + 0.4e0 * greatest(0, least(100, 100 * (1 - sqrt(pow((x1 + x2)::FLOAT::DOUBLE / 2 - 4, 2) + pow((y1 + y2)::FLOAT::DOUBLE / 2 - 4, 2)) / (sqrt(128e0) / 2)))) AS subject FROM main_faces)"""


def _face_side(low: str, high: str) -> str:
    """Begin and length of the face's part along one edge of 8 pixels, as struct(at, n)."""
    span = f"greatest((({high} - {low})::FLOAT * 1.7::FLOAT)::FLOAT, 1::FLOAT)"
    begin = f"least(greatest(((({low} + {high})::FLOAT / 2::FLOAT)::FLOAT - ({span} / 2::FLOAT)::FLOAT)::FLOAT, 0::FLOAT), 7::FLOAT)"
    return f"struct_pack(at := trunc({begin})::INT, n := greatest(1, least(trunc(least({span}, (8::FLOAT - {begin})::FLOAT))::INT, 8 - trunc({begin})::INT)))"


_FACE_LINES = " ".join(f"JOIN gray {t} ON {t}.photo_id = c.photo_id AND {t}.x = {x} AND {t}.y = {y}" for t, x, y in (("n", "c.x", "greatest(c.y - 1, py.at)"), ("s", "c.x", "least(c.y + 1, py.at + py.n - 1)"), ("w", "greatest(c.x - 1, px.at)", "c.y"), ("e", "least(c.x + 1, px.at + px.n - 1)", "c.y")))
_FACE_VARIANCE = f"""face_parts AS (SELECT photo_id, {_face_side("x1", "x2")} AS px, {_face_side("y1", "y2")} AS py FROM main_faces),
lap_face AS (SELECT c.photo_id, n.l + s.l + w.l + e.l - 4 * c.l AS v FROM face_parts f JOIN gray c ON c.photo_id = f.photo_id AND c.x >= px.at AND c.x < px.at + px.n AND c.y >= py.at AND c.y < py.at + py.n {_FACE_LINES}),
face_variances AS (SELECT photo_id, (count(*) * sum(v * v) - sum(v) * sum(v))::DOUBLE / (count(*) * count(*))::DOUBLE AS var_face FROM lap_face GROUP BY photo_id)"""


def _resized(source: str, name: str, edge: int, axis: str) -> str:
    """source (photo_id, x, y, r, g, b) with 8 places along an axis brought to `edge` by a tent, widened when it shrinks."""
    scale, wide, other = f"(8e0 / {edge}e0)", f"{max(8 / edge, 1.0)!r}e0", "y" if axis == "x" else "x"
    centre = f"((i + 0.5e0) * {scale})"
    taps = f"(SELECT i, j, greatest(0, 1 - abs((j + 0.5e0 - {centre}) / {wide})) AS w FROM range(0, {edge}) a(i), range(0, 8) b(j) WHERE j >= greatest(floor({centre} - {wide}), 0) AND j <= least(ceil({centre} + {wide}), 7))"
    colours = ", ".join(f"greatest(0, least(255, round_even(sum({c} * w) * (1e0 / sum(w)), 0)))::BIGINT AS {c}" for c in "rgb")
    return f"{name} AS (SELECT photo_id, i AS {axis}, {other}, {colours} FROM {source} JOIN {taps} ON {axis} = j GROUP BY photo_id, i, {other})"


_THUMBS = _resized("px", "narrow", 5, "x") + ", " + _resized("narrow", "thumb", 5, "y")
_WANTED = "wanted AS (SELECT CASE WHEN photo_id % 7 = 0 THEN path || '.gone' ELSE path END AS path, max((['landscape', 'object', 'portrait'])[photo_id % 3 + 1]) AS new_mode FROM all_photos WHERE photo_id % 5 = 0 GROUP BY 1)"
_TENSOR = _resized("px", "wide", 20, "x") + ", " + _resized("wide", "tensor", 15, "y")
_EVENTS = "scan_events AS (SELECT event_id AS seq, user_id::VARCHAR AS path, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'scored' END AS status, CASE WHEN event_type <> 'error' THEN value END AS score FROM events)"
_LATEST = _with(_EVENTS, "SELECT path, max(seq) AS seq, arg_max(status, seq) AS status, max_by(struct_pack(s := score), seq).s AS score FROM scan_events GROUP BY path")
_SIX = "round(sharpness, 6) AS sharpness, round(exposure, 6) AS exposure, round(contrast, 6) AS contrast, round(color, 6) AS color, round(composition, 6) AS composition"


def _fit(most: int) -> str:
    fits = f"w <= {most} AND h <= {most}"
    return ", ".join(f"(CASE WHEN {fits} THEN {c} ELSE greatest(1, round_even({c} * least({most}e0 / w, {most}e0 / h), 0)) END)::INT AS {name}_{most}" for c, name in (("w", "width"), ("h", "height")))


ORACLE_SQL = {
    "format_class": _with(_PHOTOS, "SELECT photo_id, format_class, regexp_extract(path, '[^/]*$') AS file_name FROM classed"),
    "supported_photos": _with(_PHOTOS, "SELECT photo_id, path FROM photos"),
    "fit_dimensions": f"SELECT vec_id, {_fit(1600)}, {_fit(220)} FROM (SELECT vec_id, vec_id * 37 % 6000 + 1 AS w, vec_id * 53 % 4000 + 1 AS h FROM embeddings)",
    "photo_moments": _with(_FEATURES, "SELECT photo_id, n_px, sum_l::BIGINT AS sum_l, sum_l2::BIGINT AS sum_l2, n_clipped, sum_rg::BIGINT AS sum_rg, sum_rg2::BIGINT AS sum_rg2, sum_yb2x::BIGINT AS sum_yb2x, sum_yb2x2::BIGINT AS sum_yb2x2, energy::BIGINT AS energy, energy_thirds::BIGINT AS energy_thirds FROM features"),
    "center_crop_sharpness": _with(_FEATURES, "SELECT photo_id, round(var_full, 6) AS var_full, round(var_object, 6) AS var_object, round(var_half, 6) AS var_half, round(var_portrait, 6) AS var_portrait FROM features"),
    "guess_mode": _with(_FEATURES, "SELECT photo_id, mode FROM features"),
    "photo_metrics": _with(_SCORED, f"SELECT path, seq, mode, round(score, 6) AS score, {_SIX} FROM scored"),
    "dhash": _with(f"{_PIXELS}, {_HASHED}", "SELECT photo_id, phash FROM hashes"),
    "overall_scores": _with(_SCORED, "SELECT path, seq, round(overall, 6) AS overall FROM weighed"),
    "reweighted": _with(_SCORED, "SELECT path, seq, round((sharpness * 0.5::FLOAT::DOUBLE + exposure * 0.05::FLOAT::DOUBLE + contrast * 0.3::FLOAT::DOUBLE + composition * 0.1::FLOAT::DOUBLE) / (0.5::FLOAT::DOUBLE + 0.05::FLOAT::DOUBLE + 0.3::FLOAT::DOUBLE + 0.1::FLOAT::DOUBLE), 6) AS overall FROM scored"),
    "sharpness_bands": _with(_SCORED, "SELECT CASE WHEN score <= 40 THEN 'blurry' WHEN score <= 100 THEN 'soft' ELSE 'sharp' END AS band, count(*) AS photos FROM scored GROUP BY 1"),
    "labels": _with(_SCORED, "SELECT path, seq, regexp_extract(path, '[^/]*$') AS file_name, CASE WHEN score <= 40 THEN 'blurry' WHEN score <= 100 THEN 'soft' ELSE 'sharp' END AS band, round(score::DECIMAL(38, 10), 1)::DECIMAL(38, 1)::VARCHAR AS score_text FROM scored"),
    "decoded_faces": _with(_PRIORS, "SELECT photo_id, prior_idx, round(face_score::DOUBLE, 4) + 0e0 AS face_score, round(x1::DOUBLE, 4) + 0e0 AS x1, round(y1::DOUBLE, 4) + 0e0 AS y1, round(x2::DOUBLE, 4) + 0e0 AS x2, round(y2::DOUBLE, 4) + 0e0 AS y2 FROM boxes"),
    "similar_pairs": _with(f"{_PIXELS}, {_HASHED}, hashed AS (SELECT phash FROM hashes), {_PAIRS}", "SELECT hash_a, hash_b, distance FROM pairs"),
    "duplicate_groups": _grouped("SELECT group_rank, group_size, member_rank, path, seq FROM grouped", False),
    "duplicate_groups_survivors": _grouped("SELECT group_rank, group_size, member_rank, path, seq FROM grouped", True),
    "group_sections": _grouped("SELECT group_rank, member_rank, 'Group (' || group_size || ')' AS title, path FROM grouped", False),
    "group_sizes": _grouped("SELECT group_size, count(*) AS groups FROM groups GROUP BY group_size", False),
    "best_of_group": _grouped("SELECT group_rank, path, round(overall, 6) AS overall FROM winners", True),
    "ungrouped": _grouped("SELECT path, round(overall, 6) AS overall FROM alone", True),
    "cull_shortlist": _grouped("SELECT path, seq, coalesce(found.group_rank, 0) AS group_rank, round(overall, 6) AS overall FROM found ORDER BY found.overall DESC, found.group_rank IS NULL, found.group_rank, seq LIMIT 150", True),
    "cull_funnel": _grouped("SELECT (SELECT count(*) FROM scored) AS total, (SELECT count(*) FROM scored WHERE score > 32) AS after_technical, (SELECT count(*) FROM found) AS after_dedupe, least((SELECT count(*) FROM found), 150) AS shown", True),
    "cull_scanned_shortlist": _scanned("SELECT path, coalesce(found.group_rank, 0) AS group_rank, round(overall, 6) AS overall FROM found ORDER BY found.overall DESC, found.group_rank IS NULL, found.group_rank, path LIMIT 150"),
    "cull_scanned_funnel": _scanned("SELECT (SELECT count(*) FROM scored) AS total, (SELECT count(*) FROM scored WHERE score > 32) AS after_technical, (SELECT count(*) FROM found) AS after_dedupe, least((SELECT count(*) FROM found), 150) AS shown"),
    "scan_counts": _with(_EVENTS, "SELECT count(*) AS found, count(*) FILTER (WHERE seq % 4 < 3) AS processed, count(*) FILTER (WHERE seq % 4 < 3 AND status = 'scored') AS scored, count(*) FILTER (WHERE seq % 4 < 3 AND status = 'failed') AS failed, count(*) FILTER (WHERE seq % 4 = 3) AS waiting FROM scan_events"),
    "flat_by_sharpness": _with(_SCORED, "SELECT row_number() OVER (ORDER BY score DESC, seq, path) AS place, path, round(score, 6) AS score FROM scored"),
    "flat_by_overall": _with(_SCORED, "SELECT row_number() OVER (ORDER BY weighed.overall DESC, seq, path) AS place, path, round(overall, 6) AS overall FROM weighed"),
    "apply_overrides": _with(
        f"""{_SCORED}, {_WANTED},
changed AS (SELECT s.path, coalesce(new_mode, mode) AS mode, CASE WHEN coalesce(new_mode, mode) = mode THEN score WHEN new_mode = 'portrait' THEN var_portrait WHEN new_mode = 'object' THEN var_object ELSE var_full END AS score FROM scored s LEFT JOIN wanted w ON s.path = w.path)""",
        "SELECT path, mode, round(score, 6) AS score, round(CASE WHEN score <= 0 THEN 0 ELSE 100 * score / (score + 100) END, 6) AS sharpness FROM changed",
    ),
    "resolve_mode": _with(f"{_FEATURES}, {_MAIN}", "SELECT f.photo_id, CASE f.photo_id % 4 WHEN 1 THEN 'landscape' WHEN 2 THEN 'object' WHEN 3 THEN 'portrait' ELSE CASE WHEN m.photo_id IS NOT NULL THEN 'portrait' ELSE mode END END AS mode FROM features f LEFT JOIN main_faces m ON f.photo_id = m.photo_id", recursive=True),
    "subject_scores": _with(f"{_PHOTOS}, {_MAIN}", "SELECT photo_id, round(subject, 3) AS subject FROM subjects", recursive=True),
    "nms_faces": _with(_NMS, "SELECT photo_id, prior_idx FROM kept_boxes", recursive=True),
    "main_faces": _with(f"{_PHOTOS}, {_MAIN}", "SELECT photo_id, path, round(x1::DOUBLE, 3) AS x1, round(y1::DOUBLE, 3) AS y1, round(x2::DOUBLE, 3) AS x2, round(y2::DOUBLE, 3) AS y2, round(face_score::DOUBLE, 3) AS score FROM main_faces", recursive=True),
    "face_crop_sharpness": _with(f"{_PIXELS}, {_MAIN}, {_FACE_VARIANCE}", "SELECT photo_id, 'portrait' AS mode, round(var_face, 6) AS var_face, round(var_face, 6) AS score FROM face_variances", recursive=True),
    "thumbs": _with(f"{_PIXELS}, {_THUMBS}", "SELECT photo_id, 5::INT AS width, 5::INT AS height, sha256(unhex(string_agg(printf('%02x%02x%02x', r, g, b), '' ORDER BY y, x))) AS rgb_sha256 FROM thumb GROUP BY photo_id"),
    "detector_input": _with(f"{_PIXELS}, {_TENSOR}", "SELECT photo_id, (3 * count(*))::INT AS n, round(sum((r - 127) / 128e0), 3) AS sum_0, round(sum((g - 127) / 128e0), 3) AS sum_1, round(sum((b - 127) / 128e0), 3) AS sum_2 FROM tensor GROUP BY photo_id"),
    "apply_overrides_faces": _with(
        f"""{_FEATURES}, {_MAIN}, {_FACE_VARIANCE}, {_WANTED},
with_faces AS (SELECT f.*, var_face, subject, CASE WHEN var_face IS NOT NULL THEN 'portrait' ELSE mode END AS own_mode FROM features f LEFT JOIN face_variances USING (photo_id) LEFT JOIN subjects USING (photo_id)),
moded AS (SELECT w.*, coalesce(new_mode, own_mode) AS final_mode FROM with_faces w LEFT JOIN wanted USING (path)),
changed AS (SELECT path, final_mode AS mode, CASE final_mode WHEN 'portrait' THEN coalesce(var_face, var_portrait) WHEN 'object' THEN var_object ELSE var_full END AS score, CASE WHEN final_mode = 'portrait' THEN subject END AS subject FROM moded)""",
        "SELECT path, mode, round(score, 6) AS score, round(CASE WHEN score <= 0 THEN 0 ELSE 100 * score / (score + 100) END, 6) AS sharpness, round(subject, 3) AS subject FROM changed", recursive=True,
    ),
    "latest_results": _LATEST,
    "stream_latest": _LATEST,
    "known_updates": _with(_EVENTS, "SELECT path, seq, status FROM scan_events WHERE seq % 3 = 0 AND path IN (SELECT path FROM scan_events WHERE seq % 3 > 0 AND status = 'failed')"),
    "written_results": _with(_SCORED, "SELECT path, seq, mode, round(score, 6) AS score FROM scored"),
    "grouped_paths": _grouped("SELECT DISTINCT path FROM grouped", False),
    "disqualify_plan": _with(f"{_SCORED}, {_FLAGGED}", "SELECT path, target, status, CASE WHEN status = 'failed' THEN 'target exists' END AS error FROM plan"),
    "disqualify_summary": _with(f"{_SCORED}, {_FLAGGED}", "SELECT status, count(*) AS photos FROM plan GROUP BY status"),
    "remaining_photos": _with(f"{_SCORED}, {_FLAGGED}", "SELECT path FROM scored WHERE path NOT IN (SELECT path FROM plan WHERE status = 'moved')"),
    "flagged": _with(_SCORED, "SELECT count(*) FILTER (WHERE score <= 32) AS flagged FROM scored"),
    "scan_status": _with(_EVENTS, "SELECT count(*) FILTER (WHERE status = 'scored') AS scored, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) AS processed FROM scan_events"),
    "scan_progress": _with(_EVENTS, "SELECT status, count(*) AS photos FROM scan_events GROUP BY status"),
}
