"""Scores and tags from columns of measures: image quality, structure tags."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.columns import codes

#: What each part of an image's quality weighs.
QUALITY_WEIGHTS = {"size": 0.26, "contrast": 0.22, "blur": 0.22, "ink": 0.20, "crop": 0.10}
#: From where to where a measure rises from worst to best (for ink and border also from best to worst).
QUALITY_RANGES = {"side": (64, 180), "area": (6400, 90000), "contrast": (18, 120), "blur": (20, 900), "thin": (0.001, 0.006), "dense": (0.32, 0.65), "border": (0.05, 0.30)}
#: Fixed values: (code, measure, whether it must not be below or above, limit).
QUALITY_CODES = (
    ("low_resolution", "side", "below", 96), ("low_contrast", "contrast", "below", 25), ("blurred", "blur", "below", 35),
    ("too_little_foreground", "ink", "below", 0.006), ("too_dense_foreground", "ink", "above", 0.45), ("possibly_cropped", "border", "above", 0.18),
)
#: Codes that fail an image whatever its score.
QUALITY_BLOCKING = ("image_unreadable", "too_little_foreground")
#: The halogens, and the elements that have a tag of their own.
HALOGENS, TAGGED = ("F", "Cl", "Br", "I"), ("N", "O", "S", "P")


def image_quality(c: Callable[[str], Column] = F.col, least: float = 0.55) -> Column:
    """struct(quality_score, reason_codes, passed) of an image from width, height, contrast, blur, ink and border.

    ``ink`` is the share of dark pixels, ``border`` that of the margin. The score is a weighted mean of five parts between 0 and 1.
    """
    at = {"side": F.least(c("width"), c("height")), "area": c("width") * c("height"), **{k: c(k) for k in ("contrast", "blur", "ink", "border")}}

    def risen(name: str, value: Column) -> Column:
        low, high = QUALITY_RANGES[name]
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.lit(float(high - low))))

    parts = {
        "size": F.least(risen("side", at["side"]), risen("area", at["area"])), "contrast": risen("contrast", at["contrast"]), "blur": risen("blur", at["blur"]),
        # Ink is best between its two ranges.
        "ink": F.least(risen("thin", at["ink"]), 1 - risen("dense", at["ink"])), "crop": 1 - risen("border", at["border"]),
    }
    score = F.bround(reduce(lambda a, b: a + b, [F.lit(w) * parts[k] for k, w in QUALITY_WEIGHTS.items()]), 4)
    found = codes(*[(code, at[m] < limit if side == "below" else at[m] > limit) for code, m, side, limit in QUALITY_CODES])
    blocked = F.arrays_overlap(found, F.array(*map(F.lit, QUALITY_BLOCKING)))
    return F.struct(score.alias("quality_score"), found.alias("reason_codes"), ((score >= least) & ~blocked).alias("passed"))


def structure_tags(c: Callable[[str], Column] = F.col) -> Column:
    """Tags of a structure in order of name, ``other`` if there are none.

    Columns: heavy_atoms, weight, rings, aromatic_rings, fragments, chiral_centers, formal_charge, plain_carbons (not aromatic), and
    elements, an array of symbols.
    """
    has = lambda *names: F.arrays_overlap(c("elements"), F.array(*map(F.lit, names)))
    tags = {
        "small_molecule": (c("heavy_atoms") <= 12) & (c("weight") < 200), "large_molecular_weight": c("weight") >= 500,
        "simple_organic": (c("rings") <= 1) & (c("weight") < 350) & (c("fragments") == 1), "high_ring_count": c("rings") >= 3,
        "polycyclic_or_fused": c("aromatic_rings") >= 2, "stereochemical": c("chiral_centers") > 0, "formal_charge": c("formal_charge") != 0,
        "salt_or_multifragment": c("fragments") > 1, "halogen": has(*HALOGENS), "long_chain": (c("plain_carbons") >= 10) & (c("rings") <= 1),
        **{f"contains_{e}": has(e) for e in TAGGED},
    }
    found = F.array_sort(codes(*tags.items()))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))
