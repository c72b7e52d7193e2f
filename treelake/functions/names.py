"""Names, slugs and noise patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of names that mark a noisy leaf, with their categories.
NOISE = (
    ("sp.", r"\bsp\."),
    ("nr./cf./aff.", r"\b(?:nr|cf|aff)\.\s"),
    ("environmental", r"\benvironmental\b"),
    ("unidentified", r"\bunidentified\b"),
    ("uncultured", r"\buncultured\b"),
    ("hybrid", r"\bhybrid\b"),
)
#: Patterns of names of nodes that only group others.
CONTAINERS = (
    ("unclassified", r"^unclassified\s"),
    ("incertae sedis", r"\bincertae\s+sedis\b"),
    ("environmental samples", r"^environmental\s+samples$"),
)


def matches(name: Column, pattern: str) -> Column:
    """Case-insensitive search; false for null."""
    return F.coalesce(F.regexp_like(name, F.lit(f"(?i){pattern}")), F.lit(False))


def noise_categories(name: Column, patterns=NOISE) -> Column:
    """All categories whose pattern a name matches, in the order of the patterns."""
    return F.filter(F.array(*[F.when(matches(name, p), F.lit(c)) for c, p in patterns]), lambda x: x.isNotNull())


def container_category(name: Column, patterns=CONTAINERS) -> Column:
    """The first category that matches, else null."""
    return F.coalesce(*[F.when(matches(name, p), F.lit(c)) for c, p in patterns], F.lit(None).cast("string"))


def slugify(text: Column, default: str = "clade", keep: str = "") -> Column:
    """Lower case with `_` for every run of other characters; `keep` names further characters that stay."""
    s = F.regexp_replace(F.lower(text), f"[^a-z0-9{keep}]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(s, "^_+|_+$", ""), F.lit("")), F.lit(default))


def dataset_name(name: Column, taxid: Column, max_depth: Column, clean: Column) -> Column:
    return F.concat(
        slugify(name), F.lit("_"), taxid.cast("string"),
        F.coalesce(F.concat(F.lit("_d"), max_depth.cast("string")), F.lit("")), F.when(clean, "_clean").otherwise(""),
    )


def is_numeric(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit("^[0-9]+$")), F.lit(False))


def curriculum_phases(spec: str) -> list[tuple[int, int | None]]:
    """"1:1,20:3,50:None" as (first epoch, deepest difference) pairs by epoch; the later of two for an epoch counts."""
    if not re.fullmatch(r"(\s*\d+\s*:\s*(\d+|None)\s*(,(?!$)|$))+", spec):
        raise ValueError(f"no list of epoch:difference: {spec!r}")
    found = dict(re.findall(r"(\d+)\s*:\s*(\d+|None)", spec))
    return sorted((int(e), None if d == "None" else int(d)) for e, d in found.items())


def automatic_phases(max_depth: int, epochs: int) -> list[tuple[int, int | None]]:
    """Four phases at 0, 20, 40 and 60 % of the epochs: parents only, a quarter, half, all of the depth."""
    starts = [1]
    for share in (0.2, 0.4, 0.6):
        starts.append(max(starts[-1] + 1, int(epochs * share)))
    return list(zip(starts, (1, max(1, max_depth // 4), max(2, max_depth // 2), None)))
