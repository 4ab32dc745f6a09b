"""Class ids, names and categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Contiguous COCO ids that count as person and as animal.
PERSON_IDS = (0,)
ANIMAL_IDS = (14, 15, 16, 17, 18, 19, 20, 21, 22, 23)
CATEGORIES = ("person", "animal", "object")  # also the order in which score ties are broken

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


def category(class_id: Column) -> Column:
    return (
        F.when(class_id.isin(*PERSON_IDS), "person")
        .when(class_id.isin(*ANIMAL_IDS), "animal")
        .otherwise("object")
    )


def category_rank(name: Column) -> Column:
    return F.when(name == "person", 0).when(name == "animal", 1).otherwise(2)


def class_id(model: Column, label: Column, label_map: str = "reference") -> Column:
    """Model label to class id.

    ``reference`` shifts only the one-based Faster R-CNN labels. ``canonical`` brings both models
    that speak the 91-entry list onto the contiguous ids; labels outside that list become -1.
    """
    if label_map == "reference":
        return F.when(model == "fasterrcnn", label - 1).otherwise(label).cast("int")
    gaps_below = F.lit(0)
    for gap in COCO_GAPS:
        gaps_below = gaps_below + F.when(label > gap, 1).otherwise(0)
    listed = label.between(1, 90) & ~label.isin(*COCO_GAPS)
    contiguous = F.when(listed, label - 1 - gaps_below).otherwise(-1)
    return F.when(model == "yolo", label).otherwise(contiguous).cast("int")


def class_name(model: Column, ident: Column) -> Column:
    """YOLO names its classes; the other two models yield ``class_<id>``."""
    names = F.split(F.lit(",".join(COCO_NAMES)), ",")  # folded to a constant array
    generic = F.concat(F.lit("class_"), ident.cast("string"))
    known = (model == "yolo") & ident.between(0, len(COCO_NAMES) - 1)
    return F.when(known, F.get(names, ident)).otherwise(generic)
