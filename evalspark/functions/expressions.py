"""Scalar expressions: parsers, bands, splits, calibration maps and decisions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TWO_64 = 18446744073709551616.0


def parse_code_map(c: Column) -> Column:
    """A literal like ``{'C1': 100.0}`` as a map sorted by code; null if malformed."""
    parsed = F.from_json(F.regexp_replace(c, "'", '"'), "map<string,double>")
    return F.map_from_entries(F.array_sort(F.map_entries(parsed)))


def parse_composite_codes(c: Column) -> Column:
    """Statements of ``a+b;c`` as structs of the one primary code (below 200 or from 500 on) and its modifiers.

    Null if a statement lacks exactly one primary or statements repeat.
    """
    codes = F.transform(F.split(c, ";"), lambda s: F.transform(F.split(s, r"\+"), lambda x: x.cast("int")))
    primary = lambda x: (x < 200) | (x >= 500)
    parts = F.transform(codes, lambda s: F.struct(F.filter(s, primary)[0].alias("primary_code"), F.array_sort(F.filter(s, lambda x: ~primary(x))).alias("modifiers")))
    good = F.forall(codes, lambda s: F.size(F.filter(s, primary)) == 1) & (F.size(F.array_distinct(codes)) == F.size(codes))
    return F.when(good, parts)


def composite_code_problems(c: Column, known: list[int]) -> Column:
    """What is wrong with statements of ``a+b;c``, in this order; an empty array for a good value.

    ``no_number``: a part that isn't a whole number (or a null value), which hides all else; ``primary``: a statement without exactly one
    primary code (below 200 or from 500 on); ``repeated_modifier``; ``repeated_statement``; ``unknown_code``: not in ``known``.
    """
    parts = F.transform(F.split(c, ";"), lambda s: F.split(s, r"\+"))
    number = F.forall(F.flatten(parts), lambda x: x.rlike(r"^\d{1,9}$"))
    codes = F.transform(parts, lambda s: F.transform(s, lambda x: x.try_cast("int")))
    primary = lambda x: (x < 200) | (x >= 500)
    once = lambda a: F.size(F.array_distinct(a)) == F.size(a)
    ordered = F.transform(codes, lambda s: F.array_sort(s))
    found = {
        "primary": F.exists(codes, lambda s: F.size(F.filter(s, primary)) != 1), "repeated_modifier": F.exists(codes, lambda s: ~once(F.filter(s, lambda x: ~primary(x)))),
        "repeated_statement": ~once(ordered), "unknown_code": F.size(F.array_except(F.flatten(codes), F.array(*[F.lit(k) for k in known]))) > 0,
    }
    told = F.array_compact(F.array(*[F.when(t, F.lit(name)) for name, t in found.items()]))
    return F.when(F.coalesce(number, F.lit(False)), told).otherwise(F.array(F.lit("no_number")))


def age_band(age: Column) -> Column:
    """Bands of twenty years; 300 stands for an age above 89, which is in the last band."""
    return F.when(age.isNull(), "unknown").when(age == 300, "80+").when((age < 0) | (age > 130), "invalid").when(age < 40, "<40").when(age < 60, "40-59").when(age < 80, "60-79").otherwise("80+")


def sex_group(sex: Column) -> Column:
    return F.when(sex.isNull(), "unknown").when(sex == 0, "male").when(sex == 1, "female").otherwise("invalid")


def split_for_fold(fold: Column) -> Column:
    """Folds 1 to 7 train, 8 selects, 9 calibrates, 10 tests."""
    return F.when(fold <= 7, "train").when(fold == 8, "select").when(fold == 9, "calibrate").when(fold == 10, "test")


def hash_unit(c: Column, salt: str) -> Column:
    """The first eight bytes of SHA-256 of ``salt|value`` as a share of 2 ** 64."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), c.cast("string")), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / TWO_64


def hash_split(c: Column, salt: str, cuts: tuple[float, float] = (0.4, 0.8)) -> Column:
    """Role A, B or C by a salted hash."""
    u = hash_unit(c, salt)
    return F.when(u < cuts[0], "A").when(u < cuts[1], "B").otherwise("C")


def stateless_seed(base: int, c: Column, purpose: str) -> Column:
    """A seed of 63 bits fixed by base, record and purpose: the first 16 hexadecimal digits without the highest bit."""
    text = F.concat(F.lit(f"{base}|"), c.cast("string"), F.lit(f"|{purpose}"))
    return (F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(str(2**63)).cast("decimal(20,0)")).cast("long")


def sigmoid(z: Column) -> Column:
    """Stable for either sign."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.log(q) - F.log(1 - q)


def symmetric_energy(z: Column, temperature: float) -> Column:
    """C14: one label's energy, -T log(e^(z / 2T) + e^(-z / 2T))."""
    return -(F.abs(z) / 2 + temperature * F.log1p(F.exp(-F.abs(z) / temperature)))


def adjust_to_prior(p: Column, source: Column, target: Column) -> Column:
    """The probability under another prevalence."""
    return sigmoid(logit(p) + logit(target) - logit(source))


#: Fixed: labels that can't hold together.
INCOMPATIBLE = (("NORM", "MI"), ("NORM", "STTC"), ("NORM", "HYP"))


def incoherent_labels(supported: Column, pairs: tuple[tuple[str, str], ...] = INCOMPATIBLE) -> Column:
    """Of an array of supported labels those in a pair that can't hold together, in their order."""

    def clashes(label: Column) -> Column:
        out = F.lit(False)
        for a, b in pairs:
            both = F.array_contains(supported, a) & F.array_contains(supported, b)
            out = out | (both & label.isin(a, b))
        return out

    return F.filter(supported, clashes)


def trust_decision(
    integrity: Column, contract: Column, quality: Column, distribution: Column, gate: Column | None, decisions: Column,
    pairs: tuple[tuple[str, str], ...] | None = INCOMPATIBLE,
) -> Column:
    """A struct of decision, reason, uncertain_labels and incoherent_labels; the first check that fails decides.

    ``quality`` is a status (PASS, LIMITED, REACQUIRE, INVALID), ``decisions`` an array of structs of label and decision
    (SUPPORTED, NOT_SUPPORTED, UNCERTAIN); ``gate`` None leaves the gate out, ``pairs`` None the coherence check.
    Missing evidence has states of its own: an input without quality evidence is invalid, one without distribution
    evidence unsupported, and without gate or label decisions there is no prediction. A null flag of integrity or
    contract counts as false.
    """
    no = lambda c: ~F.coalesce(c, F.lit(False))
    none = F.array().cast("array<string>")
    labels = lambda what: F.transform(F.filter(decisions, lambda d: d["decision"] == what), lambda d: d["label"])
    uncertain = F.coalesce(labels("UNCERTAIN"), none)
    incoherent = incoherent_labels(labels("SUPPORTED"), pairs) if pairs else none
    checks = [
        (no(integrity), "INVALID_INPUT", "RELEASE_INTEGRITY_UNVERIFIED"),
        (no(contract), "INVALID_INPUT", "INPUT_CONTRACT_INVALID"),
        (quality.isNull(), "INVALID_INPUT", "QUALITY_COMPONENT_UNAVAILABLE"),
        (quality == "INVALID", "INVALID_INPUT", "SIGNAL_QUALITY_INVALID"),
        (quality.isin("LIMITED", "REACQUIRE"), "REACQUIRE", "SIGNAL_REACQUISITION_REQUIRED"),
        (distribution.isNull(), "UNSUPPORTED_INPUT", "DISTRIBUTION_COMPONENT_UNAVAILABLE"),
        (~distribution, "UNSUPPORTED_INPUT", "OUTSIDE_VALIDATED_DISTRIBUTION"),
    ]
    if gate is not None:
        checks.append((gate.isNull(), "ABSTAIN", "UNCERTAINTY_COMPONENT_UNAVAILABLE"))
        checks.append((~gate, "ABSTAIN", "LEGACY_ENTROPY_GATE_REJECTED"))
    checks += [
        (decisions.isNull(), "ABSTAIN", "UNCERTAINTY_COMPONENT_UNAVAILABLE"),
        (F.size(uncertain) > 0, "ABSTAIN", "CONFORMAL_SET_UNCERTAIN"),
        (F.size(incoherent) > 0, "ABSTAIN", "LABEL_SET_INCOHERENT"),
    ]
    number = F.coalesce(*[F.when(failed, F.lit(i)) for i, (failed, _, _) in enumerate(checks)], F.lit(len(checks)))
    states = F.array(*[F.lit(x) for _, x, _ in checks], F.lit("PREDICTION_ALLOWED"))
    reasons = F.array(*[F.lit(x) for _, _, x in checks], F.lit("ALL_TRUST_GATES_PASSED"))
    return F.struct(
        states[number].alias("decision"), reasons[number].alias("reason"),
        F.when(number == len(checks) - 2, uncertain).otherwise(none).alias("uncertain_labels"),
        F.when(number == len(checks) - 1, incoherent).otherwise(none).alias("incoherent_labels"),
    )


def round_scaled(c: Column, digits: int) -> Column:
    """A double scaled, rounded half away from zero and scaled back, as SQL engines on doubles do; -0.0 keeps its sign.

    F.round goes by the shortest decimal, where some halves fall elsewhere, and makes 0.0 of small negative numbers.
    """
    scale = 10.0**digits
    return F.signum(c) * F.round(F.abs(c) * scale) / scale


def aliased_frequency(f: Column, fs: Column) -> Column:
    """Where a frequency appears after sampling at fs."""
    r = f % fs
    return F.when(r > fs / 2, fs - r).otherwise(r)


def register_sql_functions(spark: SparkSession) -> None:
    """Sigmoid, binary_entropy and energy as SQL functions that Catalyst inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ev_sigmoid(z DOUBLE) RETURNS DOUBLE RETURN CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ev_binary_entropy(p DOUBLE) RETURNS DOUBLE RETURN -(p * ln(p) + (1 - p) * ln(1 - p)) / ln(2.0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION ev_energy(z DOUBLE) RETURNS DOUBLE RETURN -(abs(z) / 2 + log1p(exp(-abs(z))))")
