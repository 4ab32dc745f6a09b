"""Pictures whose content follows from the frame key, and models simple enough to be checked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

WIDTH, HEIGHT, CHANNELS = 32, 24, 3
BRIGHT = 150
DRAWN = "video_id INT, frame_no INT, frame_key BIGINT, width INT, height INT, data BINARY"


def rectangle(key: int) -> tuple[int, int, int, int]:
    """Left, top, width and height of the bright rectangle."""
    return key % 16, key * 7 % 12, 4 + key % 13, 3 + key % 10


def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    y, x, c = np.indices((HEIGHT, WIDTH, CHANNELS))
    gradient = (x + y + c).astype(np.uint8)
    for batch in batches:
        pictures = []
        for key in batch["frame_key"]:
            picture = gradient + np.uint8(key % 50)
            left, top, wide, high = rectangle(int(key))
            picture[top : top + high, left : left + wide] = 200 + key % 5
            pictures.append(picture.tobytes())
        yield batch.assign(data=pictures)


def _bounds(picture: np.ndarray) -> tuple[int, int, int, int] | None:
    ys, xs = np.nonzero(picture[:, :, 0] > BRIGHT)
    if not len(xs):
        return None
    return int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1


def make_detector():
    """Finds the bright rectangle; its shade is the label."""

    def detect(pictures):
        for picture in pictures:
            x1, y1, x2, y2 = _bounds(picture)
            label = int(picture[y1, x1, 0]) - 200
            yield [(label, 0.5 + label * 0.05, x1 + 0.25, y1 + 0.25, x2 + 0.5, y2 + 0.5)]

    return detect


def make_region_finder():
    """Finds the part of the rectangle inside the strip, if any."""

    def find(strips):
        for strip in strips:
            box = _bounds(strip)
            yield [] if box is None else [(box[0], box[1], box[2] - box[0], box[3] - box[1])]

    return find


def byte_sums(data: pd.Series) -> pd.Series:
    return pd.Series([int(np.frombuffer(d, np.uint8).sum(dtype=np.int64)) for d in data], dtype="int64")
