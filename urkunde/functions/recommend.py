"""Which preprocessing approaches to try, and in which order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Approaches by document type, those that always follow, and the lists of the modes.
BY_TYPE = {
    "fraktur": ("fraktur_traditional", "fraktur_enhanced"),
    "official_document": ("official_document", "german_italic"),
    "mixed_period": ("mixed_period", "standard"),
}
OTHERWISE = ("modern_german", "standard")
FALLBACKS = ("light", "standard", "direct")
QUICK = ("standard", "light", "direct")
MOST = 6
REASONS = {
    "fraktur": "Detected Fraktur script - using specialized preprocessing",
    "official_document": "Official document detected - using government document optimization",
    "mixed_period": "Mixed text styles detected - using balanced approach",
    "modern": "Modern German text - using standard preprocessing",
    "poor": "Poor image quality - prioritizing noise reduction",
    "excellent": "Excellent image quality - trying direct OCR first",
    "inverted": "Inverted image detected - using inversion preprocessing",
    "contrast": "Low contrast - using contrast enhancement",
    "noise": "High noise level - using noise reduction",
}


def names(items: tuple[str, ...] | list[str]) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def recommended(kind: Column, quality: Column, inverted: Column, contrast: Column, noise: Column) -> Column:
    """The list for an image; an approach may stand in it twice."""
    out = names(OTHERWISE)
    for t, own in BY_TYPE.items():
        out = F.when(kind == t, names(own)).otherwise(out)

    def ahead(name: str, when: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: F.when(when(x), F.concat(names([name]), x)).otherwise(x)

    def behind(name: str) -> Callable[[Column], Column]:
        return lambda x: F.when(F.array_contains(x, name), x).otherwise(F.array_append(x, F.lit(name)))

    edits = [
        ahead("enhanced", lambda _: quality == "poor"),
        ahead("direct", lambda _: quality == "excellent"),
        lambda x: F.when(inverted & ~F.array_contains(x, "minimal"), F.array_insert(x, 2, F.lit("minimal"))).otherwise(x),
        ahead("enhanced", lambda _: contrast < 30),
        ahead("enhanced", lambda x: (noise > 0.6) & ~F.array_contains(x, "enhanced")),
        *map(behind, FALLBACKS),
    ]
    for edit in edits:
        out = let(out, edit)
    return F.slice(out, 1, MOST)


def reasons(kind: Column, quality: Column, inverted: Column, contrast: Column, noise: Column) -> Column:
    """Why, in the order of the rules."""
    base = F.lit(REASONS["modern"])
    for t in BY_TYPE:
        base = F.when(kind == t, REASONS[t]).otherwise(base)
    given = [
        base,
        F.when(quality == "poor", REASONS["poor"]).when(quality == "excellent", REASONS["excellent"]),
        F.when(inverted, REASONS["inverted"]),
        F.when(contrast < 30, REASONS["contrast"]),
        F.when(noise > 0.6, REASONS["noise"]),
    ]
    return F.array_compact(F.array(*given))


def selected(choice: Column, advised: Column, known: list[str], preferred: list[str], most: int) -> Column:
    """The approaches to try: a mode's list, the chosen one, the preferred ones, or the first of those advised."""
    return (
        F.when(choice == "skip_analysis", names(QUICK))
        .when(choice == "all_recommended", advised)
        .when(choice.isin(known), F.array(choice))
        .otherwise(names(preferred) if preferred else F.slice(advised, 1, most))
    )


def parsed_choice(typed: Column, shown: Column) -> Column:
    """struct(choice, valid): 0 or nothing for automatic, a for all, s for the quick list, a number for one that is shown."""
    low = F.lower(F.trim(F.coalesce(typed, F.lit(""))))
    at = low.try_cast("int")
    named = F.get(shown, at - 1)
    automatic = low.isin("", "0")
    choice = F.when(low == "a", "all_recommended").when(low == "s", "skip_analysis").when(at >= 1, named)
    return F.struct(choice.alias("choice"), (automatic | choice.isNotNull()).alias("valid"))
