"""Small hand-made and seeded tables, and the plain meaning of voting to hold results against."""

import random

from reelsift import schemas

FRAME = (1, 1, 1, 1920, 1080)


def det_rows(boxes, frame=FRAME):
    """``boxes``: (class_id, x1, y1, x2, y2[, model[, confidence]]) in visiting order."""
    rows = []
    for seq, (cls, x1, y1, x2, y2, *more) in enumerate(boxes, 1):
        model = more[0] if more else "yolo"
        confidence = more[1] if len(more) > 1 else 0.9
        rows.append((*frame, model, seq, x1, y1, x2, y2, confidence, cls))
    return rows


def det(spark, *frames):
    rows = []
    for i, boxes in enumerate(frames, 1):
        rows += det_rows(boxes, (1, i, i, 1920, 1080))
    return spark.createDataFrame(rows, schemas.DETECTIONS)


def overlap(a, b):
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w < 0 or h < 0:
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


def grouped(boxes, threshold=0.5):
    """{det_seq: gid} by visiting the boxes one after the other."""
    groups = []
    for seq, (cls, *box) in enumerate(boxes, 1):
        box = box[:4]
        for founder, members in groups:
            if any(c == cls and overlap(b, box) >= threshold for c, b, _ in members):
                members.append((cls, box, seq))
                break
        else:
            groups.append((seq, [(cls, box, seq)]))
    return {seq: founder for founder, members in groups for _, _, seq in members}


def crowd(seed, count, spread=60, size=(20, 40), copies=0.0, classes=2):
    """Random boxes of like size that overlap a lot; a share of them copies of earlier ones."""
    rng = random.Random(seed)
    boxes = []
    for _ in range(count):
        if boxes and rng.random() < copies:
            boxes.append(rng.choice(boxes))
            continue
        x, y = rng.randrange(spread), rng.randrange(spread)
        w, h = rng.randint(*size), rng.randint(*size)
        boxes.append((rng.randrange(classes), x, y, x + w, y + h))
    return boxes
