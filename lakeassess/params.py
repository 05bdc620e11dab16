"""Coefficients of the standards. Every default can be replaced by the caller."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class HardnessCurve:
    """``exp(a + b ln H) * (cf_base - cf_slope ln H)``."""

    a: float
    b: float
    cf_base: float = 1.0
    cf_slope: float = 0.0


@dataclass(frozen=True)
class HardnessStandard:
    """Acute and chronic curves of one analyte in one sample fraction.

    ``divisor`` scales both results; ``chronic_cap`` limits the chronic one.
    """

    analyte: str
    fraction: str
    acute: HardnessCurve
    chronic: HardnessCurve
    divisor: float = 1.0
    chronic_cap: float | None = None


# Regulatory hardness coefficients.
HARDNESS_STANDARDS: tuple[HardnessStandard, ...] = (
    HardnessStandard(
        "CADMIUM",
        "Dissolved",
        acute=HardnessCurve(-2.918, 1.128, cf_base=1.138672, cf_slope=0.041838),
        chronic=HardnessCurve(-3.490, 0.7852, cf_base=1.101672, cf_slope=0.041838),
    ),
    HardnessStandard(
        "CHROMIUM",
        "Dissolved",
        acute=HardnessCurve(3.688, 0.8190, cf_base=0.316),
        chronic=HardnessCurve(1.561, 0.8190, cf_base=8.60),
    ),
    # The chronic factor equals fluoride's intercept, which looks like a slip
    # in the published defaults. It is kept so that results agree.
    HardnessStandard(
        "COPPER",
        "Dissolved",
        acute=HardnessCurve(-1.464, 0.9422, cf_base=0.960),
        chronic=HardnessCurve(-1.465, 0.8545, cf_base=6.7319),
    ),
    HardnessStandard(
        "FLUORIDE",
        "Total",
        acute=HardnessCurve(6.7319, 0.5394),
        chronic=HardnessCurve(6.0445, 0.5394),
        divisor=1000.0,
        chronic_cap=4.0,
    ),
    HardnessStandard(
        "LEAD",
        "Dissolved",
        acute=HardnessCurve(-1.301, 1.273, cf_base=1.46203, cf_slope=0.145712),
        chronic=HardnessCurve(-2.863, 1.273, cf_base=1.46203, cf_slope=0.145712),
    ),
    HardnessStandard(
        "MANGANESE",
        "Dissolved",
        acute=HardnessCurve(4.9187, 0.7467, cf_base=0.9812),
        chronic=HardnessCurve(4.0635, 0.7467, cf_base=0.9812),
    ),
    HardnessStandard(
        "NICKEL",
        "Dissolved",
        acute=HardnessCurve(0.5173, 0.8460, cf_base=0.998),
        chronic=HardnessCurve(-2.286, 0.8460, cf_base=0.997),
    ),
    HardnessStandard(
        "ZINC",
        "Dissolved",
        acute=HardnessCurve(0.9035, 0.8473, cf_base=0.978),
        chronic=HardnessCurve(-0.4456, 0.8473, cf_base=0.986),
    ),
)


@dataclass(frozen=True)
class AmmoniaStage:
    """Chronic ammonia standard of one life stage and temperature band."""

    low: float = 0.0577
    high: float = 2.487
    multiplier: float = 1.45


# Ammonia coefficients.
@dataclass(frozen=True)
class AmmoniaParams:
    acute_low: float = 0.411
    acute_transition_ph: float = 7.204
    acute_high: float = 58.4
    acute_limit: float = 15.0
    transition_ph: float = 7.688
    present_temperature: float = 14.51
    absent_temperature: float = 7.0
    present_cold: AmmoniaStage = AmmoniaStage(multiplier=2.85)
    present_warm: AmmoniaStage = AmmoniaStage()
    absent_cold: AmmoniaStage = AmmoniaStage()
    absent_warm: AmmoniaStage = AmmoniaStage()
    cold_exponent: float = 0.504
    temperature_slope: float = 0.028
    reference_temperature: float = 25.0
    early_life_months: tuple[int, ...] = (3, 4, 5, 6, 7, 8, 9, 10)
    subchronic_factor: float = 2.5
    chronic_days: float = 30.0
    subchronic_days: float = 4.0


@dataclass(frozen=True)
class SulfateBand:
    """Linear standard inside a closed hardness and chloride range.

    ``(intercept + hardness_slope * H + chloride_slope * Cl) * factor``
    """

    hardness_from: float
    hardness_to: float
    chloride_from: float
    chloride_to: float
    intercept: float
    hardness_slope: float
    chloride_slope: float
    factor: float = 0.65


# Sulfate coefficients.
@dataclass(frozen=True)
class SulfateParams:
    """Bands are tried in order, then the two constants.

    In the second band the labelled chloride slope is 54.163, but the standard
    in use multiplies chloride by the sulfate factor 0.65. The value in use is
    the default; pass ``chloride_slope=54.163`` for the labelled one.
    """

    high_chloride: SulfateBand = SulfateBand(100, 500, 25, 500, 1276.7, 5.508, -1.457)
    low_chloride: SulfateBand = SulfateBand(100, 500, 5, 25, -57.478, 5.79, 0.65)
    soft_hardness: float = 100.0
    soft_chloride: float = 5.0
    soft_standard: float = 500.0
    hard_hardness: float = 500.0
    hard_chloride: float = 5.0
    hard_standard: float = 2000.0


@dataclass(frozen=True)
class AssessmentParams:
    hardness: tuple[HardnessStandard, ...] = HARDNESS_STANDARDS
    ammonia: AmmoniaParams = field(default_factory=AmmoniaParams)
    sulfate: SulfateParams = field(default_factory=SulfateParams)
    chronic_days: float = 4.0
    trophic_state: bool = True
