"""Hospital resource expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: status texts, and the capabilities assumed when none are stored
NO_BEDS = "AT CAPACITY - No beds available"
NEAR = "NEAR CAPACITY - Very limited availability"
MODERATE = "MODERATE CAPACITY"
GOOD = "GOOD CAPACITY"
DEFAULT_CAPABILITIES = {
    "ecmo": False,
    "cardiac_surgery": True,
    "mechanical_ventilation": True,
    "dialysis": True,
    "advanced_cardiac_care": False,
    "infectious_disease": True,
}
EQUIPMENT_COLUMNS = {
    "ecmo": "ecmo_available",
    "cardiac_surgery": "cardiac_surgery_available",
    "advanced_cardiac_care": "advanced_cardiac_care_available",
}
GENERAL_EQUIPMENT = ["mechanical_ventilation", "dialysis"]
SPECIALISTS = ["cardiac_surgeon", "interventional_cardiologist", "infectious_disease"]
# end of fixed values


def default_capabilities() -> Column:
    return F.create_map(*[F.lit(x) for pair in DEFAULT_CAPABILITIES.items() for x in pair])


def capacity_status(rate: Column, beds: Column) -> Column:
    """Capacity text."""
    return (
        F.when(beds == 0, NO_BEDS).when(rate >= 0.90, NEAR).when(rate >= 0.70, MODERATE).otherwise(GOOD)
    )


def capability(flags: Column, name: Column | str) -> Column:
    """One capability flag, false when absent (F16)."""
    name = name if isinstance(name, Column) else F.lit(name)
    return F.coalesce(F.try_element_at(flags, name), F.lit(False))


def overall_status(rate: Column, beds: Column, flags: Column) -> Column:
    """Capacity text followed by missing capabilities."""
    missing = F.array_compact(
        F.array(
            F.when(~capability(flags, "advanced_cardiac_care"), "No advanced cardiac care"),
            F.when(~capability(flags, "ecmo"), "No ECMO"),
        )
    )
    status = capacity_status(rate, beds)
    return F.when(
        F.size(missing) > 0,
        F.concat(status, F.lit(" | Limitations: "), F.array_join(missing, ", ")),
    ).otherwise(status)


def capability_status(name: Column, flags: Column, specialists: Column) -> Column:
    """Struct(available, status): equipment first, then staff, else not found."""
    owned = F.lit(None).cast("boolean")
    for equipment, column in EQUIPMENT_COLUMNS.items():
        owned = F.when(name == equipment, F.coalesce(F.col(column), F.lit(False))).otherwise(owned)
    for equipment in GENERAL_EQUIPMENT:
        owned = F.when(
            name == equipment,
            F.coalesce(F.try_element_at(flags, F.lit(equipment)), F.lit(True)),
        ).otherwise(owned)
    on_staff = F.when(name.isin(SPECIALISTS), F.array_contains(specialists, name))
    status = (
        F.when(owned, "AVAILABLE")
        .when(owned.isNotNull(), "NOT AVAILABLE")
        .when(on_staff, "ON STAFF")
        .when(on_staff.isNotNull(), "NOT ON STAFF")
        .otherwise("CAPABILITY NOT FOUND")
    )
    return F.struct(
        F.coalesce(owned, on_staff, F.lit(False)).alias("available"), status.alias("status")
    )
