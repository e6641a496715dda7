"""Names that answers and annotations use. Pass other tables of the same shape where a function takes a vocabulary."""

from __future__ import annotations

# The 80 object names of the COCO benchmark, in its order.
COCO_CATEGORIES = [
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light",
    "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat", "dog", "horse", "sheep", "cow",
    "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee",
    "skis", "snowboard", "sports ball", "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle",
    "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple", "sandwich", "orange",
    "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed",
    "dining table", "toilet", "tv", "laptop", "mouse", "remote", "keyboard", "cell phone", "microwave", "oven",
    "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
]

# Other names of some of them.
CATEGORY_ALIASES = {
    "person": ["person", "people", "man", "woman"],
    "bicycle": ["bicycle", "bike"],
    "motorcycle": ["motorcycle", "motorbike"],
    "airplane": ["airplane", "aeroplane", "plane", "aircraft"],
    "couch": ["couch", "sofa"],
    "potted plant": ["potted plant", "houseplant", "plant"],
    "dining table": ["dining table", "dinner table", "table"],
    "tv": ["tv", "television"],
    "cell phone": ["cell phone", "mobile phone", "smartphone", "phone"],
    "hair drier": ["hair drier", "hair dryer"],
    "refrigerator": ["refrigerator", "fridge"],
    "handbag": ["handbag", "purse"],
    "suitcase": ["suitcase", "luggage"],
    "tennis racket": ["tennis racket", "tennis racquet"],
    "sports ball": ["sports ball", "ball"],
    "orange": ["orange fruit", "oranges", "orange"],
}

# Phrases for the four spatial relations.
RELATION_PHRASES = {
    "to the left of": ["to the left of", "left of", "on the left of"],
    "to the right of": ["to the right of", "right of", "on the right of"],
    "above": ["above", "over", "on top of"],
    "below": ["below", "under", "beneath"],
}

# Predicates of scene graphs that name one of these relations.
PREDICATES = {
    "above": "above",
    "below": "below",
    "left": "to the left of",
    "left of": "to the left of",
    "on left of": "to the left of",
    "right": "to the right of",
    "right of": "to the right of",
    "on right of": "to the right of",
    "to the left of": "to the left of",
    "to the right of": "to the right of",
}

# Weights of the difficulty tags.
DIFFICULTY_WEIGHTS = {
    "tiny_object": 2.0, "small_object": 1.0, "occluded": 1.5, "truncated": 1.0, "group_of": 1.0, "dense_instances": 1.5,
    "repeated_category": 1.0, "category_diversity": 1.0, "long_tail_category": 2.0, "spatial_relation": 1.5, "dense_relations": 1.0,
}

# The ways of choosing absent objects, in the order of reports.
STRATEGIES = ["random", "popular", "adversarial"]
