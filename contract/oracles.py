"""DuckDB SQL for the same results as ``queries``, written on its own terms.

Groups are found by going through the detections of a frame and scanning the groups founded so far, pixels are summed in closed
form. DuckDB rounds where Spark truncates a cast, hence ``trunc``.
"""

from __future__ import annotations

from contract import toys

# Ids of the 91-entry COCO list that no category uses.
COCO_GAPS = (12, 26, 29, 30, 45, 66, 68, 69, 71, 83)

# The 80 COCO category names by contiguous id.
COCO_NAMES = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat",
    "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat",
    "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack",
    "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball",
    "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket",
    "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair",
    "couch", "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse", "remote",
    "keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book",
    "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)

FRAME = "video_id, frame_no, frame_key, width, height"

MANIFEST = """manifest AS (
  SELECT 'in/clip_' || CAST(c_custkey % 100 AS STRING) ||
    CASE c_custkey % 7 WHEN 0 THEN '.mp4' WHEN 1 THEN '.AVI' WHEN 2 THEN '.mov' WHEN 3 THEN '.txt'
                       WHEN 4 THEN '.webm' WHEN 5 THEN '.jpg' ELSE '.m4v' END AS path
  FROM customer),
paths AS (
  SELECT DISTINCT path FROM manifest
  WHERE regexp_matches(lower(path), '\\.(mp4|avi|mov|mkv|flv|wmv|webm|m4v)$'))"""

FRAMES = """frames AS (
  SELECT video_id, frame_no, frame_key,
    CASE video_id % 4 WHEN 0 THEN 1920 WHEN 1 THEN 1280 WHEN 2 THEN 3840 ELSE 1080 END AS width,
    CASE video_id % 4 WHEN 0 THEN 1080 WHEN 1 THEN 720 WHEN 2 THEN 2160 ELSE 1920 END AS height
  FROM (SELECT o_orderkey AS frame_key, CAST(o_custkey % 40 AS INT) AS video_id,
          CAST(row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS INT) AS frame_no
        FROM orders) t),
videos AS (
  SELECT video_id, 'in/clip_' || CAST(video_id AS STRING) || '.mp4' AS path,
    min(width) AS width, min(height) AS height,
    min(CASE video_id % 5 WHEN 0 THEN 0e0 WHEN 1 THEN 24e0 WHEN 2 THEN 25e0 WHEN 3 THEN 29.97e0 ELSE 30e0 END) AS fps,
    CAST(count(*) AS INT) AS total_frames
  FROM frames GROUP BY video_id)"""

RAW = """raw AS (
  SELECT video_id, frame_no, frame_key, width, height, model_source, det_seq, score,
    CAST(CASE (frame_key + subj) % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 16 WHEN 3 THEN 15 ELSE 2 END
      + CASE WHEN model_source = 'fasterrcnn' THEN 1 ELSE 0 END AS INT) AS label,
    ox + jx + 0.25e0 AS x1, oy + jy + 0.75e0 AS y1, ox + jx + bw + 0.5e0 AS x2, oy + jy + bh + 0.5e0 AS y2
  FROM (
    SELECT f.*, l_partkey % 2 AS subj, l_suppkey % 40 AS jx, l_partkey % 30 AS jy,
      CASE l_linenumber % 3 WHEN 0 THEN 'yolo' WHEN 1 THEN 'detr' ELSE 'fasterrcnn' END AS model_source,
      0.4e0 + l_quantity / 100 AS score,
      CASE WHEN frame_key % 7 = 0 THEN 0 ELSE (frame_key * 37 + (l_partkey % 2) * 400) % CAST(width / 2 AS INT) END AS ox,
      CASE WHEN frame_key % 3 = 0 THEN (frame_key * 53) % 20 ELSE (frame_key * 53 + (l_partkey % 2) * 200) % CAST(height / 2 AS INT) END AS oy,
      CASE WHEN frame_key % 7 = 0 THEN width - 60 ELSE 120 + (frame_key * 7) % CAST(width / 4 AS INT) END AS bw,
      150 + (frame_key * 11) % CAST(height / 4 AS INT) AS bh,
      CAST(row_number() OVER (PARTITION BY frame_key ORDER BY l_linenumber % 3, l_linenumber, l_partkey, l_suppkey,
        l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS INT) AS det_seq
    FROM lineitem JOIN frames f ON l_orderkey = f.frame_key) t)"""


def _names(model: str, ident: str) -> str:
    listed = ", ".join(f"'{n}'" for n in COCO_NAMES)
    return (
        f"CASE WHEN {model} = 'yolo' AND {ident} BETWEEN 0 AND 79 THEN ([{listed}])[{ident} + 1] "
        f"ELSE 'class_' || CAST({ident} AS STRING) END"
    )


def _category(ident: str) -> str:
    return f"CASE WHEN {ident} = 0 THEN 'person' WHEN {ident} BETWEEN 14 AND 23 THEN 'animal' ELSE 'object' END"


def _normalised(name: str, label: str, class_id: str) -> str:
    return f"""{name} AS (
  SELECT {FRAME}, model_source, det_seq, x1, y1, x2, y2, confidence, class_id,
    {_category("class_id")} AS category, {_names("model_source", "class_id")} AS class_name
  FROM (
    SELECT {FRAME}, model_source, det_seq, CAST(trunc(x1) AS INT) AS x1, CAST(trunc(y1) AS INT) AS y1,
      CAST(trunc(x2) AS INT) AS x2, CAST(trunc(y2) AS INT) AS y2, score AS confidence,
      CAST({class_id} AS INT) AS class_id
    FROM (SELECT * REPLACE ({label} AS label) FROM raw) WHERE score >= 0.5e0))"""


DET = _normalised("det", "label", "CASE WHEN model_source = 'fasterrcnn' THEN label - 1 ELSE label END")

_gaps = ", ".join(str(g) for g in COCO_GAPS)
CANONICAL = _normalised(
    "canon",
    "CAST((frame_key + label) % 93 AS INT)",
    f"""CASE WHEN model_source = 'yolo' THEN label
        WHEN label NOT BETWEEN 1 AND 90 OR label IN ({_gaps}) THEN -1
        ELSE label - 1 - len(list_filter([{_gaps}], lambda g: g < label)) END""",
)

REG = """reg AS (
  SELECT f.video_id, f.frame_no, f.frame_key, f.width, f.height,
    CAST(l_linenumber AS INT) AS line_no, CAST(l_partkey % 200 AS INT) AS rx, CAST(l_suppkey % 90 * 5 AS INT) AS ry,
    CAST(10 + l_partkey % 400 AS INT) AS rw, CAST(4 + l_suppkey % 60 AS INT) AS rh
  FROM lineitem JOIN frames f ON l_orderkey = f.frame_key),
texty AS (
  SELECT * FROM reg
  WHERE CASE WHEN rh > 0 THEN rw / rh ELSE 0 END > 2.5e0 AND rw > width * 0.08e0 AND rw * rh > 100
    AND ry > (height - trunc(height * 0.75e0)) * 0.3e0),
textframes AS (SELECT frame_key FROM texty GROUP BY frame_key HAVING count(*) >= 2)"""


def _iou(a: str, b: str) -> str:
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    union = (
        f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {w} * {h})"
    )
    return f"CASE WHEN {w} < 0 OR {h} < 0 THEN 0e0 WHEN {union} > 0 THEN {w} * {h} / {union} ELSE 0e0 END"


def _votes(source: str) -> str:
    """Visit the detections of ``source`` one by one, look through the groups founded so far for the first
    with a member that matches, and join it or found another; then keep groups with two models."""
    box = "struct_pack(x1 := s.x1, y1 := s.y1, x2 := s.x2, y2 := s.y2)"
    founded = f"struct_pack(gid := s.det_seq, c := s.class_id, m := [{box}])"
    return f"""s AS (SELECT *, row_number() OVER (PARTITION BY frame_key ORDER BY det_seq) AS k FROM {source}),
g AS (
  SELECT frame_key, k, det_seq AS gid, [{founded}] AS st FROM s WHERE k = 1
  UNION ALL
  SELECT s.frame_key, s.k, coalesce(h.hit, s.det_seq),
    CASE WHEN h.hit IS NULL THEN list_append(h.st, {founded})
      ELSE list_transform(h.st, lambda q: CASE WHEN q.gid = h.hit
        THEN struct_pack(gid := q.gid, c := q.c, m := list_append(q.m, {box})) ELSE q END) END
  FROM (
    SELECT g.frame_key, s.k, g.st, list_filter(g.st, lambda q: q.c = s.class_id
        AND len(list_filter(q.m, lambda e: {_iou("e", "s")} >= 0.5e0)) > 0)[1].gid AS hit
    FROM g JOIN s ON s.frame_key = g.frame_key AND s.k = g.k + 1) h
  JOIN s ON s.frame_key = h.frame_key AND s.k = h.k),
grp AS (SELECT s.*, CAST(g.gid AS INT) AS gid FROM g JOIN s USING (frame_key, k)),
cons AS (
  SELECT {FRAME}, gid, CAST(trunc(avg(x1)) AS INT) AS x1, CAST(trunc(avg(y1)) AS INT) AS y1,
    CAST(trunc(avg(x2)) AS INT) AS x2, CAST(trunc(avg(y2)) AS INT) AS y2, max(confidence) AS confidence,
    any_value(class_id) AS class_id, any_value(category) AS category,
    max(CASE WHEN det_seq = gid THEN class_name END) AS class_name,
    'ensemble(' || string_agg(DISTINCT model_source, ',' ORDER BY model_source) || ')' AS model_source,
    CAST(count(DISTINCT model_source) AS INT) AS votes, count(*) AS members
  FROM grp GROUP BY {FRAME}, gid HAVING count(DISTINCT model_source) >= 2)"""


VOTES = _votes("det")
CONS = f"{FRAME}, gid, x1, y1, x2, y2, confidence, class_id, class_name, model_source, votes, members"


def _top(name: str, source: str, position: str) -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY frame_key ORDER BY score DESC,
        CASE category WHEN 'person' THEN 0 WHEN 'animal' THEN 1 ELSE 2 END, {position}) AS INT) AS rn
    FROM (SELECT *, CAST((x2 - x1) AS BIGINT) * (y2 - y1) AS area,
            CAST((x2 - x1) AS BIGINT) * (y2 - y1) * confidence AS score FROM {source}))
  WHERE rn = 1)"""


ONE_SUBJECT = _top("subj", "(SELECT * FROM det WHERE model_source = 'yolo')", "det_seq")
ALL_SUBJECT = _top("subj", "cons", "gid")
ANY_SUBJECT = _top("subj", "det", "det_seq")

FORMATS = """formats AS (
  SELECT unnest(['9:16', '3:4', '1:1', '4:5', '16:9', '4:3']) AS format,
    unnest([9e0 / 16, 3e0 / 4, 1e0, 4e0 / 5, 9e0 / 16, 9e0 / 16]) AS ratio,
    unnest([9e0 / 16, 3e0 / 4, 1e0, 4e0 / 5, 16e0 / 9, 4e0 / 3]) AS strict_ratio)"""
BY_FORMAT = "byformat AS (SELECT s.*, format, ratio FROM subj s CROSS JOIN formats)"


def _crop(source: str, ratio: str = "9e0 / 16", padding: int = 500) -> str:
    edge = "(CASE WHEN {} THEN 0.1e0 ELSE 0e0 END)"
    near = edge.format("crop_x <= 10 OR crop_y <= 10")
    far = edge.format("crop_x + crop_w >= width - 10 OR crop_y + crop_h >= height - 10")
    return f"""k1 AS (
  SELECT *, x2 - x1 + {2 * padding} AS pw, y2 - y1 + {2 * padding} AS ph, {ratio} AS r,
    CASE WHEN category = 'person' THEN y1 / height ELSE 0e0 END AS head_space FROM {source}),
k2 AS (
  SELECT *, CAST(CASE WHEN pw / ph > r THEN pw ELSE trunc(ph * r) END AS INT) AS cw,
    CAST(CASE WHEN pw / ph > r THEN trunc(pw / r) ELSE ph END AS INT) AS ch FROM k1),
k3 AS (SELECT *, CASE WHEN cw > width OR ch > height THEN least(width / cw, height / ch) ELSE 1e0 END AS sc FROM k2),
k4 AS (SELECT *, CAST(trunc(cw * sc) AS INT) AS crop_w, CAST(trunc(ch * sc) AS INT) AS crop_h FROM k3),
k5 AS (
  SELECT *, CAST(floor((x1 + x2) / 2e0) - floor(crop_w / 2e0) AS INT) AS px,
    CAST(floor((y1 + y2) / 2e0) - floor(crop_h / 2e0)
      + CASE WHEN head_space > 0 AND head_space < 0.05e0 THEN -trunc(crop_h * 0.1e0)
             WHEN head_space > 0.25e0 THEN trunc(crop_h * 0.1e0) ELSE 0 END AS INT) AS py FROM k4),
k6 AS (
  SELECT *, greatest(0, least(px, width - crop_w)) AS crop_x, greatest(0, least(py, height - crop_h)) AS crop_y FROM k5),
crop AS (
  SELECT *, greatest(0e0, 1e0 - abs(0.45e0 - CASE WHEN crop_w > 0 AND crop_h > 0 THEN
      ((x2 - x1) * (y2 - y1)) / (CAST(crop_w AS BIGINT) * crop_h) ELSE 0e0 END)
    - ({near} + {far})) AS quality
  FROM k6)"""


OUTCOME = """outc AS (
  SELECT f.video_id, f.frame_no, f.frame_key, c.category, c.class_id, c.confidence, c.crop_x, c.crop_y, c.crop_w,
    c.crop_h, c.quality,
    CASE WHEN t.frame_key IS NOT NULL THEN 'skipped_text' WHEN c.frame_key IS NULL THEN 'skipped_no_detection'
         WHEN c.crop_x IS NULL THEN 'no_crop' WHEN c.quality > 0.3e0 THEN 'saved' ELSE 'rejected_quality' END AS outcome
  FROM frames f LEFT JOIN textframes t USING (frame_key) LEFT JOIN crop c USING (frame_key)),
saved AS (SELECT * FROM outc WHERE outcome = 'saved')"""


def _counts(processed: str) -> str:
    one = "CAST(count(*) FILTER (WHERE {}) AS BIGINT) AS {}"
    outcomes = ("skipped_text", "skipped_no_detection", "rejected_quality", "no_crop")
    kinds = ("person", "animal", "object")
    columns = [one.format(processed, "processed_frames"), one.format("outcome = 'saved'", "saved_frames")]
    columns += [one.format(f"outcome = '{o}'", o) for o in outcomes]
    columns += [one.format(f"outcome = 'saved' AND category = '{c}'", f"{c}_frames") for c in kinds]
    return f"stats AS (SELECT video_id, {', '.join(columns)} FROM outc GROUP BY video_id)"


TURBO_COUNTS = _counts("outcome <> 'skipped_text'")
PLAIN_COUNTS = _counts("true")
COUNTERS = (
    "processed_frames, saved_frames, skipped_text, skipped_no_detection, rejected_quality, no_crop, "
    "person_frames, animal_frames, object_frames"
)
CROPS = "video_id, frame_no, frame_key, category, crop_x, crop_y, crop_w, crop_h, quality"

ONE_RUN = (FRAMES, RAW, DET, REG, ONE_SUBJECT, _crop("subj"), OUTCOME)
ALL_RUN = (FRAMES, RAW, DET, REG, VOTES, ALL_SUBJECT, _crop("subj"), OUTCOME)

_stem = "regexp_replace(regexp_replace(path, '^.*/', ''), '^(.+)\\.[^.]+$', '\\1')"
_file = "printf('frame_%06d_q%d.jpg', frame_no, CAST(trunc(quality * 100e0) AS INT))"


def _pixel_sum(x0: str, x1: str, y0: str, y1: str) -> str:
    """Sum of x + y + c + key % 50 over a box and three channels, 0 for an empty box."""
    w, h = f"({x1} - {x0})", f"({y1} - {y0})"
    xs = f"(({x0} + {x1} - 1) * {w} / 2)"
    ys = f"(({y0} + {y1} - 1) * {h} / 2)"
    return (
        f"CASE WHEN {w} > 0 AND {h} > 0 THEN 3 * ({h} * {xs} + {w} * {ys}) + 3 * {w} * {h} "
        f"+ 3 * {w} * {h} * (frame_key % 50) ELSE 0 END"
    )


PICTURES = f"""pics AS (
  SELECT video_id, frame_no, frame_key, {toys.WIDTH} AS width, {toys.HEIGHT} AS height,
    CAST(frame_key % 16 AS INT) AS bx, CAST(frame_key * 7 % 12 AS INT) AS bt,
    CAST(4 + frame_key % 13 AS INT) AS bw, CAST(3 + frame_key % 10 AS INT) AS bh,
    CAST(frame_key % 5 AS INT) AS label, {toys.HEIGHT} - CAST(trunc({toys.HEIGHT} * 0.75e0) AS INT) AS strip
  FROM frames)"""
BRIGHT_SUBJECT = f"""bright AS (
  SELECT video_id, frame_no, frame_key, width, height, bx AS x1, bt AS y1, bx + bw AS x2, bt + bh AS y2,
    {_category("label")} AS category, label FROM pics)"""

_o = "greatest(bx, crop_x), least(bx + bw, crop_x + crop_w), greatest(bt, crop_y), least(bt + bh, crop_y + crop_h)"


def _with(body: str, *parts: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)}\n{body}"


def oracle_sql() -> dict[str, str]:
    det = (FRAMES, RAW, DET)
    reg = (FRAMES, REG)
    single = (*det, ONE_SUBJECT, _crop("subj"))
    formats = (*det, ANY_SUBJECT, FORMATS, BY_FORMAT)
    stats_of = f"SELECT video_id, {COUNTERS} FROM stats"
    totals = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in COUNTERS.split(", "))
    subject = f"{FRAME}, det_seq, x1, y1, x2, y2, confidence, class_id, category, area, score"
    ox0, ox1, oy0, oy1 = (part.strip() + ")" for part in _o[:-1].split("),"))
    bright = f"greatest(0, {ox1} - {ox0}) * greatest(0, {oy1} - {oy0}) * 3 * (200 + frame_key % 5)"
    crop_xyxy = ("crop_x", "crop_x + crop_w", "crop_y", "crop_y + crop_h")
    run = f"{_stem} || '_9x16_yolo_turbo'"
    found = {
        "video_manifest": _with("SELECT path FROM paths", MANIFEST),
        "video_info": _with(
            "SELECT *, CASE WHEN fps > 0 THEN total_frames / fps ELSE 0e0 END AS duration FROM videos", FRAMES
        ),
        "frame_scan": _with("SELECT * FROM frames", FRAMES),
        "frame_sample": _with("SELECT * FROM frames WHERE frame_no % 30 = 0", FRAMES),
        "frame_lookup": _with(
            """SELECT r.video_id, CAST(frame_index AS INT) AS frame_index,
                 CAST(frame_index + 1 AS INT) AS frame_no, f.frame_key
               FROM (SELECT video_id, unnest([29, total_frames - 1, total_frames]) AS frame_index FROM videos) r
               LEFT JOIN frames f ON f.video_id = r.video_id AND f.frame_no = frame_index + 1""",
            FRAMES,
        ),
        "output_run_name": _with(
            f"""SELECT path, {run} AS run_name FROM paths
                UNION ALL SELECT path, {_stem} || '_1x1_ensemble' FROM paths""",
            MANIFEST,
        ),
        "crop_filename": _with(f"SELECT frame_key, {_file} AS file_name FROM crop", *single),
        "crop_manifest": _with(
            f"""SELECT {run} AS run_name, CASE category WHEN 'person' THEN 'persons' WHEN 'animal' THEN 'animals'
                  ELSE 'objects' END AS category_dir, {_file} AS file_name, video_id, frame_no,
                  crop_x, crop_y, crop_w, crop_h, quality
                FROM saved JOIN (SELECT video_id, path FROM videos) USING (video_id)""",
            *ONE_RUN,
        ),
        "class_map": _with(
            """SELECT frame_key, det_seq, class_id, CASE WHEN class_id = 2 THEN 'object'
                 WHEN class_id < 10 THEN 'person' ELSE 'animal' END AS category FROM det""",
            *det,
        ),
        "det_normalise": _with("SELECT * EXCLUDE (category) FROM det", *det),
        "det_normalise_canonical": _with("SELECT * EXCLUDE (category) FROM canon", FRAMES, RAW, CANONICAL),
        "det_categorise": _with("SELECT frame_key, det_seq, class_id, category FROM det", *det),
        "det_categorise_nested": _with(
            """SELECT f.frame_key, count(*) FILTER (WHERE category = 'person') AS persons,
                 count(*) FILTER (WHERE category = 'animal') AS animals,
                 count(*) FILTER (WHERE category = 'object') AS objects
               FROM frames f LEFT JOIN det d ON d.frame_key = f.frame_key GROUP BY f.frame_key""",
            *det,
        ),
        "model_subset": _with("SELECT * EXCLUDE (category) FROM det WHERE model_source <> 'detr'", *det),
        "all_detections": _with(
            """SELECT frame_key, CAST(row_number() OVER (PARTITION BY frame_key ORDER BY
                   CASE model_source WHEN 'yolo' THEN 0 WHEN 'detr' THEN 1 ELSE 2 END, det_seq) AS INT) AS det_seq,
                 model_source, x1, y1, confidence FROM det""",
            *det,
        ),
        "detection_stats": _with(
            """SELECT count(DISTINCT model_source) AS total_models,
                 string_agg(DISTINCT model_source, ',' ORDER BY model_source) AS loaded_models, '' AS silent_models,
                 2 AS voting_threshold FROM det""",
            *det,
        ),
        "region_predicate": _with("SELECT * FROM texty", *reg),
        "text_quick": _with(
            f"""SELECT {FRAME}, coalesce(n, 0) AS text_regions, coalesce(n, 0) >= 2 AS is_text
                FROM frames LEFT JOIN (SELECT frame_key, count(*) AS n FROM texty GROUP BY 1) USING (frame_key)""",
            *reg,
        ),
        "text_ocr_fallback": _with(
            f"""SELECT {FRAME}, 0e0 AS text_ratio, coalesce(n, 0) >= 2 AS has_text
                FROM frames LEFT JOIN (SELECT frame_key, count(*) AS n FROM texty GROUP BY 1) USING (frame_key)""",
            *reg,
        ),
        "text_ocr": _with(
            _ocr("(height - CAST(trunc(height * 0.75e0) AS INT))"), *reg
        ),
        "text_ocr_frame": _with(_ocr("height"), *reg),
        "text_gate": _with(
            "SELECT * FROM frames WHERE frame_key NOT IN (SELECT frame_key FROM textframes)", *reg
        ),
        "iou": _with(
            f"""SELECT a.frame_key, a.det_seq, {_iou("a", "b")} AS iou
                FROM det a JOIN det b ON a.frame_key = b.frame_key AND b.det_seq = a.det_seq + 1""",
            *det,
        ),
        "iou_pairs": _with(
            f"""SELECT a.frame_key, a.class_id, a.det_seq AS det_seq_a, b.det_seq AS det_seq_b, {_iou("a", "b")} AS iou
                FROM det a JOIN det b ON a.frame_key = b.frame_key AND a.class_id = b.class_id
                  AND a.det_seq < b.det_seq WHERE {_iou("a", "b")} >= 0.5e0""",
            *det,
        ),
        "vote_groups": _with("SELECT frame_key, det_seq, class_id, model_source, gid FROM grp", *det, VOTES),
        "vote_groups_crowded": _with(
            "SELECT frame_key, det_seq, class_id, gid FROM grp",
            *det,
            """crowd AS (SELECT * REPLACE (frame_key % 40 AS frame_key, CAST(row_number() OVER (
                 PARTITION BY frame_key % 40 ORDER BY frame_key, det_seq) AS INT) AS det_seq) FROM det)""",
            _votes("crowd"),
        ),
        "consensus": _with(f"SELECT {CONS} FROM cons", *det, VOTES),
        "effective_threshold": _with(
            f"SELECT {CONS} FROM cons",
            *det,
            "two AS (SELECT * FROM det WHERE model_source IN ('yolo', 'detr'))",
            _votes("two"),
        ),
        "bbox_area_score": _with(
            """SELECT frame_key, det_seq, CAST((x2 - x1) * (y2 - y1) AS BIGINT) AS area,
                 (x2 - x1) * (y2 - y1) * confidence AS score FROM det""",
            *det,
        ),
        "primary_subject": _with(f"SELECT {subject} FROM subj", *det, ANY_SUBJECT),
        "primary_subject_ensemble": _with(
            "SELECT * EXCLUDE (class_name) FROM subj", *det, VOTES, ALL_SUBJECT
        ),
        "subject_rank": _with(
            """SELECT frame_key, det_seq, category, score, CAST(row_number() OVER (PARTITION BY frame_key
                 ORDER BY score DESC, CASE category WHEN 'person' THEN 0 WHEN 'animal' THEN 1 ELSE 2 END, det_seq) AS INT)
                 AS subject_rank
               FROM (SELECT *, CAST((x2 - x1) AS BIGINT) * (y2 - y1) * confidence AS score FROM det)""",
            *det,
        ),
        "union_bbox": _with(
            f"""SELECT {FRAME}, x1, y1, x2, y2 FROM frames LEFT JOIN (
                  SELECT frame_key, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM det GROUP BY 1)
                USING (frame_key)""",
            *det,
        ),
        "best_crops": _with(
            """SELECT video_id, category, CAST(place AS INT) AS place, frame_no, quality FROM (
                 SELECT *, row_number() OVER (PARTITION BY video_id, category ORDER BY quality DESC, frame_no) AS place
                 FROM saved) WHERE place <= 5""",
            *ONE_RUN,
        ),
        "head_space": _with(
            """SELECT frame_key, category, CASE WHEN category = 'person' THEN y1 / height ELSE 0e0 END AS head_space
               FROM subj""",
            *det, ANY_SUBJECT,
        ),
        "aspect_ratio": _with(
            """SELECT frame_key, format, ratio, strict_ratio FROM (
                 SELECT frame_key, ['9:16', '3:4', '1:1', '4:5', '16:9', '4:3'][frame_key % 6 + 1] AS format FROM frames)
               JOIN formats USING (format)""",
            FRAMES, FORMATS,
        ),
        "crop_box": _with(
            "SELECT frame_key, format, crop_x, crop_y, crop_w, crop_h FROM crop", *formats, _crop("byformat", "ratio")
        ),
        "crop_box_strict": _with(
            "SELECT frame_key, crop_x, crop_y, crop_w, crop_h FROM crop",
            *det, ANY_SUBJECT, _crop("subj", "16e0 / 9", 20),
        ),
        "crop_quality": _with(
            "SELECT frame_key, format, quality FROM crop", *formats, _crop("byformat", "ratio", 100)
        ),
        "quality_gate": _with(f"SELECT {CROPS} FROM crop WHERE quality > 0.3e0", *single),
        "zoom_box": _with(
            """SELECT frame_key, zoom_w, zoom_h,
                 greatest(0, least(CAST(crop_x + floor(crop_w / 2e0) - floor(zoom_w / 2e0) AS INT), width - zoom_w)) AS zoom_x,
                 greatest(0, least(CAST(crop_y + floor(crop_h / 2e0) - floor(zoom_h / 2e0) AS INT), height - zoom_h)) AS zoom_y
               FROM (SELECT *, CAST(trunc(crop_w / 1.2e0) AS INT) AS zoom_w, CAST(trunc(crop_h / 1.2e0) AS INT) AS zoom_h
                     FROM crop)""",
            *single,
        ),
        "curate_single": _with(f"SELECT {CROPS} FROM saved", *ONE_RUN),
        "curate_ensemble": _with(f"SELECT {CROPS} FROM saved", *ALL_RUN),
        "frame_outcomes": _with(
            "SELECT video_id, frame_no, outcome FROM outc",
            FRAMES, RAW, DET, REG, VOTES, ALL_SUBJECT, _crop("subj", "4e0 / 5", 100), OUTCOME,
        ),
        "two_pass": _with(
            f"SELECT {CONS} FROM cons",
            *ONE_RUN,
            "again AS (SELECT * FROM det WHERE frame_key IN (SELECT frame_key FROM saved))",
            _votes("again"),
        ),
        "video_stats": _with(stats_of, *ONE_RUN, TURBO_COUNTS),
        "video_stats_standard": _with(stats_of, *ALL_RUN, PLAIN_COUNTS),
        "overall_stats": _with(
            f"""SELECT video_id, 'clip_' || CAST(video_id AS STRING) || '.mp4' AS video_name,
                  CAST(1 AS BIGINT) AS total_videos, CAST(1 AS BIGINT) AS processed_videos, {COUNTERS}, round(d, 6) AS total_time
                FROM timed
                UNION ALL SELECT NULL, NULL, (SELECT count(*) FROM videos), count(*), {totals}, round(sum(d), 6) FROM timed""",
            *ONE_RUN, TURBO_COUNTS,
            """timed AS (SELECT s.*, CASE WHEN fps > 0 THEN total_frames / fps ELSE 0e0 END AS d
                 FROM stats s JOIN videos v ON s.video_id = v.video_id)""",
        ),
        "processing_fps": _with(
            """SELECT video_id, processed_frames, d AS processing_time,
                 CASE WHEN d > 0 THEN processed_frames / d ELSE 0e0 END AS processing_fps
               FROM stats JOIN (SELECT video_id, CASE WHEN fps > 0 THEN total_frames / fps ELSE 0e0 END AS d FROM videos)
               USING (video_id)""",
            *ONE_RUN, TURBO_COUNTS,
        ),
        "progress_pct": _with(
            """SELECT f.video_id, frame_no, total_frames, frame_no / total_frames * 100e0 AS progress
               FROM frames f JOIN videos v ON f.video_id = v.video_id WHERE frame_no % 30 = 0""",
            FRAMES,
        ),
        "infer_detections": _with(
            f"""SELECT {FRAME}, 'yolo' AS model_source, 1 AS det_seq, 0.5e0 + label * 0.05e0 AS score, label,
                  bx + 0.25e0 AS x1, bt + 0.25e0 AS y1, bx + bw + 0.5e0 AS x2, bt + bh + 0.5e0 AS y2 FROM pics""",
            FRAMES, PICTURES,
        ),
        "extract_regions": _with(
            f"""SELECT {FRAME}, 1 AS line_no, bx AS rx, CAST(greatest(bt - (height - strip), 0) AS INT) AS ry, bw AS rw,
                  CAST(bt + bh - greatest(bt, height - strip) AS INT) AS rh
                FROM pics WHERE bt + bh > height - strip""",
            FRAMES, PICTURES,
        ),
        "crop_pixels": _with(
            f"""SELECT frame_key, crop_w AS width, crop_h AS height, crop_w * crop_h * 3 AS bytes,
                  CAST({_pixel_sum(*crop_xyxy)} - {_pixel_sum(ox0, ox1, oy0, oy1)} + {bright} AS BIGINT) AS total
                FROM crop JOIN (SELECT frame_key, bx, bt, bw, bh FROM pics) USING (frame_key)""",
            FRAMES, PICTURES, BRIGHT_SUBJECT, _crop("bright", "1e0", 4),
        ),
        "stream_harvest": _with(f"SELECT {CROPS} FROM saved", *ALL_RUN),
        "stream_stats": _with(stats_of, *ONE_RUN, TURBO_COUNTS),
        "stream_long_rows": _with(f"SELECT {CROPS} FROM saved", *ALL_RUN),
        "stream_resume": _with(f"SELECT {CROPS} FROM saved", *ALL_RUN),
        "stream_progress": _with(
            """SELECT f.video_id, max(frame_no) AS frame_no, any_value(total_frames) AS total_frames,
                 max(frame_no) / any_value(total_frames) * 100e0 AS progress
               FROM frames f JOIN videos v ON f.video_id = v.video_id GROUP BY 1""",
            FRAMES,
        ),
        "stream_rates": _with("SELECT count(*) AS processed_frames, true AS measured FROM frames", FRAMES),
        "stream_late_rows": _with(
            """SELECT CASE WHEN frame_key % 5 = 0 AND fast > 0 THEN 'expired' ELSE 'complete' END AS status,
                 count(*) AS frames, CAST(sum(CASE WHEN frame_key % 5 = 0 THEN n - fast ELSE n END) AS BIGINT) AS detections,
                 CAST(sum(regs) AS BIGINT) AS regions FROM sized GROUP BY 1
               UNION ALL SELECT 'late', count(*), CAST(sum(yolos) AS BIGINT), CAST(0 AS BIGINT) FROM sized WHERE frame_key % 5 = 1 AND yolos > 0
               UNION ALL SELECT 'dropped', CAST(0 AS BIGINT), CAST(sum(fast) AS BIGINT), CAST(0 AS BIGINT) FROM sized WHERE frame_key % 5 = 0""",
            FRAMES, RAW, DET, REG,
            """sized AS (SELECT f.frame_key, coalesce(n, 0) AS n, coalesce(fast, 0) AS fast, coalesce(yolos, 0) AS yolos, coalesce(regs, 0) AS regs
               FROM frames f LEFT JOIN (SELECT frame_key, count(*) AS n, count(*) FILTER (WHERE model_source = 'fasterrcnn') AS fast,
                 count(*) FILTER (WHERE model_source = 'yolo') AS yolos FROM det GROUP BY 1) d ON f.frame_key = d.frame_key
               LEFT JOIN (SELECT frame_key, count(*) AS regs FROM reg GROUP BY 1) r ON f.frame_key = r.frame_key)""",
        ),
    }
    as_batch = ("two_pass", "text_gate", "best_crops", "frame_scan")
    return found | {f"stream_{name}": found[name] for name in as_batch} | {"stream_manifest": found["crop_manifest"]}


def _ocr(rows: str) -> str:
    return f"""SELECT {FRAME}, coalesce(a, 0) / (CAST({rows} AS BIGINT) * width) AS text_ratio,
        coalesce(a, 0) / (CAST({rows} AS BIGINT) * width) > 0.015e0 AS has_text
      FROM frames LEFT JOIN (SELECT frame_key, CAST(sum((rw + 2) * (rh + 3)) AS DOUBLE) AS a FROM reg GROUP BY 1)
      USING (frame_key)"""
