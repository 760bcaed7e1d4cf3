"""Mapping of free terms to stored values without a join.

A vocabulary has a few dozen entries, so it travels as a constant inside the expression
and matching is a map-side projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from cohortlake.functions import clinical, vocabulary as V


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(values: Sequence[str]) -> str:
    return f"array({', '.join(_text(v) for v in values)})"


def _strings(values: Sequence[str]) -> Column:
    return F.expr(_list(values))


def _lookup(pairs: Mapping[str, Sequence[str]]) -> Column:
    """A constant map from text to stored values."""
    return F.expr(f"map({', '.join(f'{_text(k)}, {_list(v)}' for k, v in pairs.items())})")


def _entries(pairs: Mapping[str, Sequence[str]]) -> Column:
    """A constant array of (term, values), in match order."""
    return F.expr(
        "array(" + ", ".join(
            f"named_struct('term', {_text(k)}, 'values', {_list(v)})" for k, v in pairs.items()
        ) + ")"
    )


@dataclass(frozen=True)
class Vocabulary:
    """How free text becomes stored values (J14): exact value, term, substring, default.

    ``exact_case``        stored values are compared as they are, untrimmed
    ``valid_substrings``  substrings of stored values are tried before those of terms
    ``drop_period``       terms are also tried without a trailing period

    Exact values and terms are found in a constant map; only a miss walks the terms for
    substrings, first match first.
    """

    terms: Mapping[str, Sequence[str]]
    valid: Sequence[str]
    default: Sequence[str]
    when_empty: Sequence[str]
    exact_case: bool = False
    valid_substrings: bool = False
    drop_period: bool = False

    def _found(self, text: Column) -> list[Column]:
        norm = F.lower(F.trim(text))

        def substring(pairs: Mapping[str, Sequence[str]]) -> Column:
            near = F.filter(
                _entries(pairs), lambda e: F.contains(norm, e["term"]) | F.contains(e["term"], norm)
            )
            return F.get(near, F.lit(0))["values"]

        steps = []
        if self.exact_case:
            steps.append(F.try_element_at(_lookup({v: [v] for v in self.valid}), text))
            steps.append(F.try_element_at(_lookup(self.terms), norm))
        else:
            exact = {v.lower(): [v] for v in self.valid}
            steps.append(F.try_element_at(_lookup({**self.terms, **exact}), norm))
        if self.drop_period:
            bare = F.regexp_replace(norm, r"\.+$", "")
            steps.append(F.try_element_at(_lookup(self.terms), bare))
        if self.valid_substrings:
            steps.append(substring({v.lower(): [v] for v in self.valid}))
        steps.append(substring(self.terms))
        return steps

    def values(self, text: Column) -> Column:
        """Stored values meant by the text."""
        empty = text.isNull() | (text == "")
        return F.when(empty, _strings(self.when_empty)).otherwise(
            F.coalesce(*self._found(text), _strings(self.default))
        )

    def recognised(self, text: Column) -> Column:
        """Whether the text leads to stored values without the default."""
        return F.coalesce(text != "", F.lit(False)) & F.coalesce(*self._found(text)).isNotNull()


ADMISSION_TYPE = Vocabulary(
    V.ADMISSION_TYPE_TERMS, V.ADMISSION_TYPES,
    default=V.EMERGENCY_ADMISSION_TYPES, when_empty=["EW EMER."],
)
ICU_TYPE = Vocabulary(V.ICU_TYPE_TERMS, V.ICU_TYPES, default=V.ICU_TYPES, when_empty=V.ICU_TYPES)
ADMISSION_LOCATION = Vocabulary(
    V.ADMISSION_LOCATION_TERMS, V.ADMISSION_LOCATIONS,
    default=V.ADMISSION_LOCATIONS, when_empty=V.ADMISSION_LOCATIONS,
)
NETWORK_ADMISSION_TYPE = Vocabulary(
    V.NETWORK_ADMISSION_TYPE_TERMS, V.ADMISSION_TYPES,
    default=V.EMERGENCY_ADMISSION_TYPES, when_empty=V.EMERGENCY_ADMISSION_TYPES,
    exact_case=True, valid_substrings=True, drop_period=True,
)
NETWORK_ICU_TYPE = Vocabulary(
    V.NETWORK_ICU_TYPE_TERMS, V.ICU_TYPES, default=V.ICU_TYPES, when_empty=V.ICU_TYPES, exact_case=True,
)


def validate_parameters(admission: Column, icu: Column, score: Column, gender: Column) -> Column:
    """Struct of mapped request parameters with warnings."""
    def warning(label: str, raw: Column, vocabulary: Vocabulary) -> Column:
        return F.when(
            raw.isNotNull() & (raw != "") & ~vocabulary.recognised(raw),
            F.concat(F.lit(f"{label} '"), raw, F.lit("' not recognized")),
        )

    warnings = F.array_compact(
        F.array(warning("Admission type", admission, ADMISSION_TYPE), warning("ICU type", icu, ICU_TYPE))
    )
    mapped = F.struct(
        ADMISSION_TYPE.values(admission).alias("admission_types"), ICU_TYPE.values(icu).alias("icu_types")
    )
    # the lambda binds the mapped values once for all the columns made from them
    return F.transform(
        F.array(mapped),
        lambda m: F.struct(
            m["admission_types"].alias("admission_types"),
            m["admission_types"][0].alias("admission_type_primary"),
            clinical.admission_category(m["admission_types"][0]).alias("admission_type_category"),
            m["icu_types"].alias("icu_types"),
            m["icu_types"][0].alias("icu_type_primary"),
            clinical.icu_category(m["icu_types"][0]).alias("icu_type_category"),
            clinical.valid_early_score(score).alias("early_icu_score"),
            clinical.gender_code(gender).alias("gender"),
            warnings.alias("warnings"),
        ),
    )[0]


def tier_priority(tier: Column) -> Column:
    """Transfer priority of a hospital tier, lower first."""
    lookup = F.create_map(*[F.lit(x) for pair in V.TIER_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(lookup, tier), F.lit(V.UNKNOWN_TIER_PRIORITY))


def transport_minutes(source: Column, target: Column) -> Column:
    """Transport time between two sites with a default."""
    pairs = [
        x
        for (a, b), minutes in V.TRANSPORT_MINUTES.items()
        for x in (F.lit(f"{a}|{b}"), F.lit(minutes))
    ]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), F.concat(source, F.lit("|"), target)),
        F.lit(V.DEFAULT_TRANSPORT_MINUTES),
    )
