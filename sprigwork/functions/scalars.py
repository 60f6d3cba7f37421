"""Scalar functions of the domain as Column expressions; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: code lists, short code -> long name
DIRECTIONS = {"up": "increased", "dn": "decreased", "nc": "unchanged"}
NODE_TYPES = {"G": "GENE", "H": "HORMONE", "M": "METABOLITE", "E": "ENVIRONMENT", "PC": "PROTEIN_COMPLEX", "R": "REGULATORY_RNA", "P": "PHENOTYPE", "PR": "PROCESS"}
RECONCILIATIONS = {"em": "exact_match", "ci": "case_insensitive", "fm": "family_member", "cc": "composite_collapse", "cm": "composite_member", "ta": "treatment_analog", "mm": "mechanism_mapping", "nin": "not_in_network", "ctl": "control"}
PERTURBATIONS = {"ko": "knockout", "kd": "knockdown", "oe": "overexpression", "dko": "double_knockout", "tko": "triple_knockout", "gof": "gain_of_function", "lof": "loss_of_function", "rsc": "rescue", "trt": "treatment", "dm": "double_mutant", "cmb": "combined", "ep": "epistasis"}
MODES = {"KO": 0.0, "KD": 0.5, "OE": 2.0}
KNOCK_OUT = ("ko", "knockout", "loss_of_function", "lof", "null")
KNOCK_DOWN = ("kd", "knockdown", "rnai", "heterozygous", "hypomorph")
OVER_EXPRESSED = ("oe", "overexpression", "gain_of_function", "gof")
FRS_BANDS = ((3.0, "weak"), (6.0, "small-scale solid"), (9.0, "medium-scale solid"), (12.0, "large-scale strong"))
KAPPA_BANDS = ((0.0, "poor"), (0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial"))

INF = float("inf")


def expand(col: Column, codes: dict[str, str]) -> Column:
    """Long name of a code given short or long in any letter case; other values stay as they are."""
    low = F.lower(F.trim(col))
    out = None
    for short, long in codes.items():
        hit = low.isin(short.lower(), long.lower())
        out = F.when(hit, long) if out is None else out.when(hit, long)
    return out.otherwise(col)


def direction(col: Column) -> Column:
    return expand(col, DIRECTIONS)


def safe_ratio(perturbed: Column, baseline: Column) -> Column:
    """perturbed / baseline; over a baseline of 0: infinite if something is left, else 1."""
    return F.when(baseline == 0, F.when(perturbed > 0, F.lit(INF)).otherwise(1.0)).otherwise(F.try_divide(perturbed, baseline))


def safe_log2(x: Column) -> Column:
    """log2, minus infinity at and below 0."""
    return F.when(x <= 0, F.lit(-INF)).otherwise(F.log2(x))


def classify_ratio(ratio: Column, threshold: float = 0.05) -> Column:
    """Direction of a ratio; both limits are exclusive."""
    return F.when(ratio > 1 + threshold, "increased").when(ratio < 1 - threshold, "decreased").otherwise("unchanged")


def classify_signal(signal: Column, threshold: float = 1e-5) -> Column:
    """Direction of a signal, or of the difference of two."""
    return F.when(signal > threshold, "increased").when(signal < -threshold, "decreased").otherwise("unchanged")


def modifier_signal(modifier: Column) -> Column:
    """Start signal of a perturbed node."""
    return F.when(modifier == 0, -1.0).when(modifier == 0.5, -0.5).when(modifier >= 2, 1.0).otherwise(modifier - 1.0)


def hill_activation(x: Column, k: Column, n: Column) -> Column:
    """Hill activation scaled to 1 at 1; 0 at and below 0."""
    kn, xn = F.pow(k, n), F.pow(x, n)
    return F.when(x <= 0, 0.0).otherwise(F.try_divide(xn * (kn + 1), kn + xn))


def hill_inhibition(x: Column, k: Column, n: Column) -> Column:
    """Hill inhibition scaled to 1 at 1."""
    kn = F.pow(k, n)
    return F.try_divide(kn + 1, kn + F.when(x <= 0, 0.0).otherwise(F.pow(x, n)))


def finite(*cols: Column) -> Column:
    """All are numbers, neither null nor NaN nor infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & F.coalesce((F.abs(c) < INF) & ~F.isnan(c), F.lit(False))
    return out


def interaction(a: Column, b: Column, ab: Column) -> Column:
    """Departure of a double perturbation from the sum of its singles, null unless all are finite."""
    return F.when(finite(a, b, ab), ab - a - b)


def masking_distance(a: Column, b: Column, ab: Column) -> Column:
    return F.when(finite(a, b, ab), F.least(F.abs(ab - a), F.abs(ab - b)))


def interaction_class(a: Column, b: Column, ab: Column, tau: float = 0.1, tau_mask: float = 0.1) -> Column:
    """additive, masking, buffering, synergy or reshaping, in this order of test; undefined if not all finite."""
    return (
        F.when(~finite(a, b, ab), "undefined")
        .when(F.abs(interaction(a, b, ab)) <= tau, "additive")
        .when(masking_distance(a, b, ab) <= tau_mask, "masking")
        .when(F.abs(ab) < F.least(F.abs(a), F.abs(b)) - tau_mask, "buffering")
        .when(F.abs(ab) > F.greatest(F.abs(a), F.abs(b)) + tau_mask, "synergy")
        .otherwise("reshaping")
    )


def finite_difference(x: Column, y: Column) -> Column:
    """x - y, null unless both are finite."""
    return F.when(finite(x, y), x - y)


def complexity_score(modifiers: Column, supply: Column) -> Column:
    """Modifiers other than 1 plus supplies, at least 1."""
    changed = F.coalesce(F.size(F.map_filter(modifiers, lambda _, v: v != 1.0)), F.lit(0))
    return F.greatest(F.lit(1), F.when(modifiers.isNull(), 0).otherwise(changed) + F.when(supply.isNull(), 0).otherwise(F.size(supply)))


def complexity_label(score: Column) -> Column:
    return F.when(score <= 1, "easy").when(score == 2, "medium").otherwise("hard")


def modelled_as(n_mods: Column, n_supply: Column) -> Column:
    """What kind of experiment a scenario models, by its numbers of modifiers and supplies."""
    plus = F.when(n_supply > 0, F.lit("_plus_treatment")).otherwise("")
    return (
        F.when(n_mods == 0, F.when(n_supply == 0, "control").otherwise("treatment_only"))
        .when(n_mods == 1, F.when(n_supply == 0, "single_mutation").otherwise("mutation_plus_treatment"))
        .when(n_mods == 2, F.concat(F.lit("double_mutation"), plus))
        .otherwise(F.concat(F.lit("multi_mutation_"), n_mods.cast("string"), plus))
    )


def infer_modifier(kind: Column) -> Column:
    """Modifier that a perturbation type implies, 1 where it implies none."""
    k = F.lower(F.trim(kind))
    return (
        F.when(k.isin(*KNOCK_OUT), 0.0).when(k.isin(*KNOCK_DOWN), 0.5).when(k.isin(*OVER_EXPRESSED), 2.0)
        .when(k.contains("double") & k.contains("ko"), 0.0).otherwise(1.0)
    )


def infer_baseline(baseline: Column, kind: Column, modifiers: Column, supply: Column) -> Column:
    """Baseline of comparison: a rescue is held against the mutant, epistasis stays, the default is WT."""
    given = F.coalesce(baseline, F.lit("WT"))
    k = F.lower(F.coalesce(kind, F.lit("")))
    changed = F.coalesce(F.exists(F.map_values(modifiers), lambda v: v != 1.0), F.lit(False))
    supplied = F.coalesce(F.size(supply) > 0, F.lit(False))
    return F.when(given == "epistasis", given).when((supplied & changed) | k.contains("ko+exogenous") | k.contains("rescue"), "mutant").otherwise(given)


def infer_type(kind: Column, modifier: Column, supplied: Column) -> Column:
    """Perturbation type, inferred from the first modifier where none is given."""
    by_modifier = (
        F.when(modifier == 0, "knockout").when(modifier >= 2, "overexpression").when((modifier > 0) & (modifier < 1), "knockdown")
        .when((modifier == 1) & supplied, "treatment").otherwise("other")
    )
    none = F.when(supplied, "treatment").otherwise("knockout")
    return F.when(F.length(F.coalesce(kind, F.lit(""))) > 0, kind).when(modifier.isNotNull(), by_modifier).otherwise(none)


def sign_strict(col: Column) -> Column:
    """Sign of an edge given as text or number: the positive spellings are +1, all else -1."""
    return F.when(F.lower(F.trim(col.cast("string"))).isin("+", "activation", "activates", "positive", "1", "1.0"), 1).otherwise(-1)


def effect_verb(sign: Column) -> Column:
    return F.when(sign > 0, "activates").when(sign < 0, "inhibits").otherwise("regulates")


def signed_magnitude(value: Column, baseline: Column, floor: float = 1e-6, limit: float = 3.0) -> Column:
    """log2 ratio with a floor under both, held to [-limit, limit] and scaled to [-1, 1]."""
    ratio = F.log2(F.greatest(value, F.lit(floor)) / F.greatest(baseline, F.lit(floor)))
    return F.least(F.greatest(ratio, F.lit(-limit)), F.lit(limit)) / limit


def as_percent(accuracy: Column) -> Column:
    """Accuracy in percent, whether it was given as a share (up to 1.5) or in percent."""
    return F.when(accuracy <= 1.5, accuracy * 100).otherwise(accuracy)


def band(score: Column) -> Column:
    """Band of a rigor score."""
    out = F.when(score < 0, "below-random")
    for limit, label in FRS_BANDS:
        out = out.when(score < limit, label)
    return out.otherwise("exceptional")


def kappa_band(kappa: Column) -> Column:
    out = F.when(kappa < 0, "below-chance")
    for limit, label in KAPPA_BANDS:
        out = out.when(kappa < limit, label)
    return out.otherwise("almost perfect")


def type_colour(kind: Column) -> Column:
    """Colour of a node by its type (fixed values)."""
    colours = {"GENE": "#4C78A8", "HORMONE": "#F58518", "METABOLITE": "#54A24B", "ENVIRONMENT": "#EECA3B", "PROTEIN_COMPLEX": "#B279A2", "REGULATORY_RNA": "#9D755D", "PHENOTYPE": "#E45756", "PROCESS": "#72B7B2"}
    out = None
    for name, colour in colours.items():
        out = F.when(kind == name, colour) if out is None else out.when(kind == name, colour)
    return out.otherwise("#BAB0AC")


def series_bucket(name: Column, buckets: int = 10) -> Column:
    """A stable number in [0, buckets) for a name: 31-fold over its characters in 32 bits."""
    codes = F.transform(F.split(name, ""), lambda c: F.ascii(c))
    return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c) % F.lit(2**32), lambda h: (h % buckets).cast("int"))


def ambiguous_axis(name: Column) -> Column:
    """True for an environment axis that can go both ways and says neither (temperature, but not high temperature)."""
    n = F.lower(name)
    axis = n.rlike(r"(?:^|[^a-z])(?:temperature|temp|light|water|nitrogen|nitrate|phosphate|humidity|ph|photoperiod|day_?length|salinity|density|co2)(?:$|[^a-z])")
    said = n.rlike(r"(?:^|[^a-z])(?:high|low|long|short|cold|warm|hot|heat|dark|red|blue|far|deficit|excess|increased?|decreased?|elevated|reduced|limited|stress|shade|drought)(?:$|[^a-z])")
    return axis & ~said


def map_text(col: Column) -> Column:
    """'k=v; k=v' of a map, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(col)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")


def path_text(col: Column) -> Column:
    return F.array_join(col, " > ")


def formula_text(node: Column, activators: Column, inhibitors: Column) -> Column:
    """Formula of a node: geometric mean of activators times bounded inverse of inhibitors."""
    act = F.when(F.size(activators) > 0, F.concat(F.lit("geomean("), F.array_join(activators, ", "), F.lit(")"))).otherwise("1")
    inh = F.when(F.size(inhibitors) > 0, F.concat(F.lit(" * inverse("), F.array_join(inhibitors, ", "), F.lit(")"))).otherwise("")
    return F.concat(node, F.lit(" = "), act, inh)


# ---- menus of node functions, by name; arrays in, number out
def _floored(values: Column, floor: float) -> Column:
    return F.transform(values, lambda v: F.greatest(v, F.lit(floor)))


def _product(values: Column) -> Column:
    return F.aggregate(values, F.lit(1.0), lambda p, v: p * v)


def _or_one(values: Column, result: Column) -> Column:
    return F.when(F.size(values) == 0, 1.0).otherwise(result)


def weighted_geomean(values: Column, weights: Column, floor: float = 0.01) -> Column:
    return _or_one(values, F.aggregate(F.zip_with(_floored(values, floor), weights, lambda v, w: F.pow(v, w)), F.lit(1.0), lambda p, v: p * v))


ACTIVATIONS = {
    "geomean": lambda v, floor=0.01: _or_one(v, F.pow(_product(_floored(v, floor)), F.try_divide(F.lit(1.0), F.size(v)))),
    "arithmean": lambda v, floor=0.01: _or_one(v, F.try_divide(F.aggregate(_floored(v, floor), F.lit(0.0), lambda s, x: s + x), F.size(v))),
    "max_pool": lambda v, floor=0.01: _or_one(v, F.array_max(_floored(v, floor))),
    "min_pool": lambda v, floor=0.01: _or_one(v, F.array_min(_floored(v, floor))),
}
INHIBITIONS = {
    "bounded_inverse": lambda v, eps=0.1, k=10.0: _or_one(v, F.least(1.0 / F.greatest(_product(v), F.lit(eps)), F.lit(k))),
    "independent_inverse": lambda v, eps=0.1, k=10.0: _or_one(v, _product(F.transform(v, lambda x: F.least(1.0 / F.greatest(x, F.lit(eps)), F.lit(k))))),
    "linear_clamp": lambda v, eps=0.1, k=10.0: _or_one(v, _product(F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(2.0 - x, F.lit(1.0)))))),
}
