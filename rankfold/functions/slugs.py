"""Board identifier variants as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankfold import fixed_values as fv


def slug_variants(slug: Column, ats: str, shorthand: dict[str, str] | None = None) -> Column:
    """Other spellings to try for a slug, in order, without repeats and without the slug."""
    known = fv.SLUG_SHORTHAND[ats] if shorthand is None else shorthand
    tries: list[Column] = []
    if ats == fv.BOARD_A:
        tries.append(F.regexp_replace(slug, "[^a-z0-9]", ""))
    elif ats == fv.BOARD_B:
        tries.append(F.replace(slug, F.lit("-"), F.lit("")))
    tries += [F.concat(slug, F.lit(s)) for s in fv.SLUG_SUFFIXES[ats]]
    tries += [
        F.when(
            slug.endswith(s) & (F.char_length(slug) > len(s)),
            F.substring(slug, F.lit(1), F.char_length(slug) - len(s)),
        )
        for s in fv.SLUG_STRIPPED_SUFFIXES[ats]
    ]
    tries += [F.concat(slug, F.lit(s)) for s in fv.SLUG_LATE_SUFFIXES[ats]]
    if known:
        pairs = [F.lit(part) for item in known.items() for part in item]
        tries.append(F.try_element_at(F.create_map(*pairs), slug))
    return F.array_except(F.array_distinct(F.array_compact(F.array(*tries))), F.array(slug))


def slugs_to_try(slug: Column, ats: Column) -> Column:
    """The slug itself, then its variants for the row's board kind."""
    variants = F.when(ats == fv.BOARD_A, slug_variants(slug, fv.BOARD_A))
    variants = variants.when(ats == fv.BOARD_B, slug_variants(slug, fv.BOARD_B))
    variants = variants.otherwise(slug_variants(slug, fv.BOARD_C))
    return F.concat(F.array(slug), variants)
