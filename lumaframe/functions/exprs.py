"""Pure column expressions: exposure arithmetic, scores, distances, guarded reads.

Every function maps columns to a column; all stay inside whole-stage code
generation or Spark's own array functions.  Nulls propagate unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Admissible camera settings and the thresholds of a good frame.
ISO_RANGE = (50, 12_800)
SHUTTER_RANGE = (1 / 8000, 30.0)
LIMITS = {"shadow": 0.30, "highlight": 0.03, "midtone": 0.55, "range": 0.20, "noise": 0.45, "blur": 0.55, "overall": 0.65}


def lit(value: float) -> Column:
    return F.lit(float(value))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(lit(low), F.least(x, lit(high)))


def clip01(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)


def plain_zero(x: Column) -> Column:
    """The same number without a negative zero."""
    return x + lit(0)


def stops(ratio: Column) -> Column:
    """log2 of a positive ratio; null for zero and below."""
    return F.when(ratio > 0, F.log2(ratio))


def relative_ev(iso: Column, shutter: Column) -> Column:
    return stops(lit(1) / F.nullif(shutter, lit(0))) - stops(iso / lit(100))


def exposure_scale(iso: Column, shutter: Column, ref_iso: Column, ref_shutter: Column) -> Column:
    return F.try_divide(iso, ref_iso) * F.try_divide(shutter, ref_shutter)


def exposure_change(iso: Column, shutter: Column, ref_iso: Column, ref_shutter: Column) -> Column:
    return stops(F.try_divide(iso, ref_iso)) + stops(F.try_divide(shutter, ref_shutter))


def proposal_distance(iso: Column, shutter: Column, to_iso: Column, to_shutter: Column) -> Column:
    return F.abs(stops(F.try_divide(iso, to_iso))) + F.abs(stops(F.try_divide(shutter, to_shutter)))


def apply_action(iso: Column, shutter: Column) -> tuple[Column, Column]:
    """The settings a camera can take: ISO rounded half-even and clamped, shutter clamped."""
    return clamp(F.bround(iso.cast("double"), 0), *ISO_RANGE), clamp(shutter, *SHUTTER_RANGE)


def is_unchanged(iso: Column, shutter: Column, to_iso: Column, to_shutter: Column) -> Column:
    near = F.abs(shutter - to_shutter) <= F.greatest(lit(1e-9) * F.greatest(F.abs(shutter), F.abs(to_shutter)), lit(1e-12))
    return (iso == to_iso) & near


def is_small(iso: Column, shutter: Column, to_iso: Column, to_shutter: Column) -> Column:
    return (F.abs(iso - to_iso) < 1) & (F.abs(stops(F.try_divide(to_shutter, shutter))) < lit(0.02))


def linear_blend(a: Column, b: Column, weight: float) -> Column:
    return F.bround(lit(1 - weight) * a + lit(weight) * b, 0)


def geometric_blend(a: Column, b: Column, weight: Column) -> Column:
    """exp((1 - w) ln a + w ln b); null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.exp((lit(1) - weight) * F.ln(a) + weight * F.ln(b)))


def blend_weight(distance: Column, gain: Column) -> Column:
    """Falls with the distance and grows with the gain, between .20 and .75."""
    return clamp(lit(0.20) + lit(0.55) * F.exp(lit(-3) * F.greatest(distance, lit(0))) * F.least(F.greatest(gain, lit(0)) / lit(0.10), lit(1)), 0.20, 0.75)


def unmet_criteria(shadow: Column, highlight: Column, midtone: Column, span: Column, noise: Column, blur: Column, confidence: Column, overall: Column) -> Column:
    """Names of the limits a frame misses, in a fixed order."""
    rules = [
        ("shadow", shadow > LIMITS["shadow"]), ("highlight", highlight > LIMITS["highlight"]), ("midtone", midtone < LIMITS["midtone"]),
        ("dynamic_range", span < LIMITS["range"]), ("noise", noise > LIMITS["noise"]), ("blur", (blur > LIMITS["blur"]) & (confidence > 0.5)), ("overall", overall < LIMITS["overall"]),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))


def heuristic_action(shadow: Column, highlight: Column, midtone: Column, noise: Column, blur: Column, confidence: Column, iso: Column, shutter: Column) -> tuple[Column, Column]:
    """(iso, shutter) of the rule of thumb: the first fault that holds decides; nulls are no fault."""
    bright = F.coalesce(highlight > LIMITS["highlight"], F.lit(False))
    dark = F.coalesce(shadow > LIMITS["shadow"], F.lit(False)) | F.coalesce(midtone < LIMITS["midtone"], F.lit(False))
    noisy, shaken = F.coalesce(noise > LIMITS["noise"], F.lit(False)), F.coalesce(blur > LIMITS["noise"], F.lit(False))
    smeared = F.coalesce((blur > LIMITS["blur"]) & (confidence > 0.5), F.lit(False))
    iso_factor = F.when(bright, 1.0).when(dark & shaken, 2.0).when(dark, 1.0).when(noisy, 0.5).when(smeared, 2.0).otherwise(1.0)
    shutter_factor = F.when(bright, 0.6).when(dark & shaken, 1.0).when(dark, 1.5).when(noisy, 2.0).when(smeared, 0.5).otherwise(1.0)
    return F.greatest(F.bround(iso.cast("double") * iso_factor, 0), lit(1)), shutter * shutter_factor


def exposure_score(shadow: Column, highlight: Column, midtone: Column) -> Column:
    s, h = clip01(lit(1) - shadow / lit(0.60)), clip01(lit(1) - highlight / lit(0.06))
    return clip01(lit(0.30) * s + lit(0.30) * h + lit(0.40) * clip01(midtone / lit(0.55)))


def overall_score(exposure: Column, contrast: Column, noise: Column, sharpness: Column) -> Column:
    return clip01(lit(0.40) * exposure + lit(0.20) * contrast + lit(0.20) * noise + lit(0.20) * sharpness)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), lit(0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in 0..2; 1 for empty, unequal lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0)
    return F.when(fits, clamp(lit(1) - F.try_divide(dot(a, b), norm), 0.0, 2.0)).otherwise(lit(1))


def jensen_shannon(p: Column, q: Column, floor: float = 1e-12) -> Column:
    """Jensen-Shannon distance (natural log, square root) of two histograms; 1 if lengths differ."""
    def shares(x: Column) -> Column:
        total = F.aggregate(x, lit(0), lambda s, v: s + F.greatest(v, lit(floor)))
        return F.transform(x, lambda v: F.greatest(v, lit(floor)) / total)

    a, b = shares(p), shares(q)
    part = F.zip_with(a, b, lambda x, y: lit(0.5) * (x * F.ln(lit(2) * x / (x + y)) + y * F.ln(lit(2) * y / (x + y))))
    total = F.aggregate(part, lit(0), lambda s, v: s + v)
    return F.when((F.size(p) == F.size(q)) & (F.size(p) > 0), F.sqrt(F.greatest(total, lit(0)))).otherwise(lit(1))


def euclidean(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite if the lengths differ."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), lit(0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.sqrt(gap)).otherwise(lit(float("inf")))


def exposure_vector(iso: Column, shutter: Column) -> Column:
    return F.array(F.log2(F.greatest(iso.cast("double"), lit(1)) / lit(100)) / lit(8), F.log2(F.greatest(shutter, lit(1e-9)) * lit(60)) / lit(16))


def action_vector(iso: Column, shutter: Column, ref_iso: Column, ref_shutter: Column) -> Column:
    return F.array(stops(F.try_divide(iso, ref_iso)) / lit(8), stops(F.try_divide(shutter, ref_shutter)) / lit(8))


def histogram_bin(value: Column, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """0-based bin of ``value``; the last bin holds its upper edge, values outside are null."""
    at = F.floor((value - lit(low)) / lit(high - low) * lit(bins)).cast("int")
    return F.when((value >= low) & (value <= high), F.least(at, F.lit(bins - 1)))


def shutter_token(token: Column) -> Column:
    """Seconds of a shutter number: 10 and more is a denominator; zero and below null."""
    v = token.try_cast("double")
    return F.when(v >= 10, lit(1) / v).when(v > 0, v)


def normalized_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")


def strip_fence(text: Column) -> Column:
    """The inside of a Markdown code fence, or the trimmed text itself."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z0-9_-]*\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.trim(F.when(F.length(inner) > 0, inner).otherwise(text))


def stable_id(*fields: Column) -> Column:
    """First 20 hex digits of SHA-256 over the fields' texts; nulls keep their place."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(f.cast("string"), F.lit("\u2400")) for f in fields]), 256), 1, 20)


def resolve_path(path: Column, base: str) -> Column:
    """Absolute paths as they are, others below ``base``."""
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def scene_name_parts(name: Column) -> Column:
    """The seven parts of a scene folder's name as a struct; null with fewer tokens."""
    t = F.split(name, "_")
    part = lambda i: F.get(t, F.lit(i))
    return F.when(
        F.size(t) >= 7,
        F.struct(
            F.concat_ws("_", part(0), part(1)).alias("scene_id"), part(1).alias("physical_scene_id"), part(2).alias("camera"), part(3).try_cast("int").alias("iso"),
            shutter_token(part(4)).alias("shutter"), part(5).try_cast("int").alias("color_temperature"), part(6).alias("brightness_level"),
        ),
    )


def is_effective(iso: Column, shutter: Column, to_iso: Column, to_shutter: Column, least: float = 0.05) -> Column:
    """Whether an action changes the exposure by at least ``least`` stops."""
    return F.abs(exposure_change(to_iso, to_shutter, iso, shutter)) >= lit(least)


def ev_or_derived(ev: Column, iso: Column, shutter: Column) -> Column:
    """The stated EV, else the one that ISO and shutter give."""
    return F.coalesce(ev, relative_ev(iso, shutter))


def folder_scene(path: Column) -> Column:
    """``'a_b'`` of the first two tokens of the name of a file's folder; null with fewer than two."""
    tokens = F.split(F.element_at(F.split(path, "/"), -2), "_")
    return F.when(F.size(F.split(path, "/")) >= 2, F.when(F.size(tokens) >= 2, F.concat_ws("_", F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1)))))


def variant_name(scene: Column, offset: Column) -> Column:
    """The name of a scene's exposure variant: ``<scene>-`` and the offset with its sign and two decimals."""
    return F.concat(scene, F.lit("-"), F.when(offset < 0, "-").otherwise("+"), F.format_string("%.2f", F.abs(offset)))
