"""Row-level feature expressions.

Every function returns Columns built from built-in expressions; fitted numbers
(bin edges, quantiles, means) are passed in, so scoring never refits them.
A flag on a missing value is 0, never NULL; a zero denominator gives NULL, which the
final fill treats like any other gap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    return F.coalesce(condition.cast("int"), F.lit(0))


def clean_number(x: str | Column) -> Column:
    """NaN becomes NULL, so comparisons behave like missing values."""
    v = _c(x).cast("double")
    return F.when(~F.isnan(v), v)


def to_number(x: str | Column, default: float | None = 0.0) -> Column:
    """Text to double; what does not parse becomes the default."""
    parsed = _c(x).try_cast("double")
    parsed = F.when(~F.isnan(parsed), parsed)
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def finite(x: str | Column, default: float | None = None) -> Column:
    """NaN and both infinities become NULL (or the default)."""
    v = _c(x).cast("double")
    ok = F.when(F.abs(v) < F.lit(float("inf")), v)  # NaN sorts above infinity
    return ok if default is None else F.coalesce(ok, F.lit(float(default)))


def non_negative(x) -> Column:
    return F.greatest(_c(x).cast("double"), F.lit(0.0))


def amount_transforms(x: str) -> dict[str, Column]:
    return {f"{x}_log": F.log1p(non_negative(x)), f"{x}_sqrt": F.sqrt(non_negative(x)),
            f"{x}_squared": _c(x) * _c(x)}


def powers(x: str) -> dict[str, Column]:
    v = _c(x).cast("double")
    return {f"{x}_squared": v * v, f"{x}_cubed": v * v * v}


def equal_width_bin(x: str | Column, lo: float, hi: float, bins: int = 10) -> Column:
    """Right-closed equal-width bins 0..bins-1; a constant column falls in the middle bin."""
    v = _c(x).cast("double")
    if hi == lo:
        return F.when(v.isNotNull(), F.lit((bins - 1) // 2))
    step = (hi - lo) / bins
    cell = F.ceil((v - F.lit(lo)) / F.lit(step)).cast("int") - 1
    return F.when(v.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), cell)))


def quantile_bin(x: str | Column, edges: list[float]) -> Column:
    """Right-closed bins between distinct quantile edges; the lowest edge belongs to bin 0.

    Values outside the fitted edges take the nearest bin.
    """
    v = _c(x).cast("double")
    edges = sorted(set(edges))
    inner = edges[1:-1]
    code = sum((flag(v > F.lit(e)) for e in inner), F.lit(0))
    return F.when(v.isNotNull(), code.cast("int"))


def above(x, cut: float) -> Column:
    return flag(_c(x) > F.lit(cut))


def below(x, cut: float) -> Column:
    return flag(_c(x) < F.lit(cut))


def round_amount(x, modulus: float = 1000) -> Column:
    return flag((_c(x) % F.lit(modulus)) == 0)


def joined_timestamp(date: str, time: str) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", _c(date), _c(time)))


# fixed values: hour windows used by the different presets (first hour, last hour, wraps midnight)
NIGHT = {"engineer": (22, 6, True), "automl": (22, 6, True), "transaction": (0, 5, False),
         "early_morning": (0, 6, False)}
BUSINESS = {"engineer": (8, 18), "automl": (9, 17)}


def is_night(hour: Column, preset: str = "engineer") -> Column:
    first, last, wraps = NIGHT[preset]
    inside = (hour >= first) | (hour <= last) if wraps else (hour >= first) & (hour <= last)
    return flag(inside)


def is_business_hours(hour: Column, preset: str = "engineer") -> Column:
    first, last = BUSINESS[preset]
    return flag(hour.between(first, last))


def is_weekend(weekday: Column) -> Column:
    return flag(weekday >= 5)


def time_parts(ts: str | Column, prefix: str = "transaction") -> dict[str, Column]:
    """Hour, day, month, weekday (Monday 0) and the flags derived from them."""
    t = _c(ts)
    hour, weekday = F.hour(t), F.weekday(t)
    return {f"{prefix}_hour": hour, f"{prefix}_day": F.dayofmonth(t), f"{prefix}_month": F.month(t),
            f"{prefix}_weekday": weekday, f"{prefix}_is_weekend": is_weekend(weekday),
            "is_business_hours": is_business_hours(hour), "is_night": is_night(hour)}


def cyclic(x: str | Column, period: int, name: str) -> dict[str, Column]:
    angle = F.lit(2.0) * F.pi() * _c(x) / F.lit(float(period))
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def ratio(a, b, eps: float = 1e-6) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double") + F.lit(eps))


def product(a, b, scale: float = 1.0) -> Column:
    p = _c(a).cast("double") * _c(b)
    return p if scale == 1.0 else p / F.lit(scale)


def same(a, b) -> Column:
    """1 when both are present and equal; a missing side never equals anything."""
    return flag(_c(a) == _c(b))


def different(a, b) -> Column:
    return F.lit(1) - same(a, b)


def differs_from(x, home: str) -> Column:
    return different(x, F.lit(home))


def name_length(x) -> Column:
    return F.length(_c(x))


def word_count(x) -> Column:
    t = F.trim(F.regexp_replace(_c(x), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def balance_use(amount, balance) -> dict[str, Column]:
    r = ratio(amount, balance, 1.0)
    return {"amount_to_balance_ratio": r, "depletes_balance": flag(r > 0.8)}


def balance_change(before, after, claim=None) -> dict[str, Column]:
    b, a = _c(before).cast("double"), _c(after).cast("double")
    out = {"balance_change": a - b, "balance_change_pct": F.try_divide(a - b, b + 1) * 100}
    if claim is not None:
        out["balance_after_claim_ratio"] = F.try_divide(a, _c(claim) + 1)
        out["claim_to_balance_ratio"] = F.try_divide(_c(claim), b + 1)
    return out


def credit_risk(debt_ratio, delinquencies, income_k, loan, debt_q25: float, debt_q75: float,
                income_q25: float) -> dict[str, Column]:
    return {"debt_income_log": F.log1p(_c(debt_ratio)), "is_high_debt": above(debt_ratio, debt_q75),
            "is_low_debt": below(debt_ratio, debt_q25), "has_delinquency": above(delinquencies, 0),
            "delinquency_log": F.log1p(_c(delinquencies)), "income_log": F.log1p(_c(income_k)),
            "is_low_income": below(income_k, income_q25),
            "loan_to_income_ratio": F.try_divide(_c(loan), _c(income_k) * 1000 + 1)}


def customer_profile(age, tenure_days, velocity, distance, velocity_q90: float, distance_q90: float,
                     distance_q95: float) -> dict[str, Column]:
    return {"age_log": F.log1p(_c(age)), "is_young_customer": below(age, 25),
            "is_senior_customer": above(age, 60), "tenure_log": F.log1p(_c(tenure_days)),
            "is_new_account": below(tenure_days, 30), "is_old_account": above(tenure_days, 365),
            "velocity_log": F.log1p(_c(velocity)), "is_high_velocity": above(velocity, velocity_q90),
            "distance_log": F.log1p(_c(distance)), "is_far_from_home": above(distance, distance_q90),
            "is_very_far": above(distance, distance_q95)}


def policy_profile(policy_months, claims, processing_ms, processing_q90: float) -> dict[str, Column]:
    return {"policy_age_log": F.log1p(_c(policy_months)), "is_new_policy": below(policy_months, 12),
            "is_old_policy": above(policy_months, 60), "has_previous_claims": above(claims, 0),
            "is_frequent_claimant": flag(_c(claims) >= 3),
            "processing_time_log": F.log1p(_c(processing_ms)),
            "is_slow_processing": above(processing_ms, processing_q90)}


def merchant_profile(risk, cashback, amount, risk_q25: float, risk_q75: float) -> dict[str, Column]:
    return {"merchant_risk_log": F.log1p(_c(risk)), "is_high_risk_merchant": above(risk, risk_q75),
            "is_low_risk_merchant": below(risk, risk_q25), "cashback_log": F.log1p(_c(cashback)),
            "has_cashback": above(cashback, 0),
            "cashback_to_amount_ratio": F.try_divide(_c(cashback), _c(amount) + 1)}


def noisy(x, std: float, key: str | Column, seed: int = 42) -> Column:
    """Gaussian noise of 1 % of the deviation.  Drawn from a hash of the row key
    (Box-Muller), so a recomputed partition draws the same noise again."""
    scale = float(2 ** 53)
    u = (F.pmod(F.xxhash64(_c(key), F.lit(seed)), F.lit(2 ** 53)) + 1) / F.lit(scale)
    v = F.pmod(F.xxhash64(_c(key), F.lit(seed + 1)), F.lit(2 ** 53)) / F.lit(scale)
    normal = F.sqrt(F.lit(-2.0) * F.log(u)) * F.cos(F.lit(2.0) * F.pi() * v)
    return _c(x) + normal * F.lit(0.01 * std)


def zscore(x, mean: float, std: float) -> Column:
    return (_c(x) - F.lit(mean)) / F.lit(std)


def min_max(x, lo: float, hi: float) -> Column:
    return (_c(x) - F.lit(lo)) / F.lit(hi - lo) if hi > lo else F.lit(0.5)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def to_unit(x, lo: float, hi: float) -> Column:
    """Fixed-range scaling into [0, 1] with clamping."""
    return clamp((_c(x).cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)), 0, 1)


def from_unit(u, lo: float, hi: float) -> Column:
    return F.lit(float(lo)) + clamp(_c(u), 0, 1) * F.lit(float(hi - lo))


# ---- scoring expressions -------------------------------------------------------------------

def risk_level(p, include_zero: bool = False) -> Column:
    """LOW up to 0.3, MEDIUM up to 0.7, HIGH up to 1; p = 0 has no level unless asked for."""
    p = _c(p)
    inside = ((p >= 0) if include_zero else (p > 0)) & (p <= 1)
    return F.when(inside, F.when(p <= 0.3, "LOW").when(p <= 0.7, "MEDIUM").otherwise("HIGH"))


def tier(score, high: float, medium: float) -> Column:
    return F.when(_c(score) >= high, "HIGH").when(_c(score) >= medium, "MEDIUM").otherwise("LOW")


def alert_action(p, block: float = 0.25, review: float = 0.15) -> Column:
    return F.when(_c(p) >= block, "BLOCK").when(_c(p) >= review, "REVIEW").otherwise("PASS")


def calibrated(p) -> Column:
    return 1 / (1 + F.exp(F.lit(-10.0) * (_c(p) - 0.5)))


def predicted(p, threshold: float = 0.5) -> Column:
    return flag(_c(p) >= threshold)


def blended(p, anomaly, weight_model: float = 0.7, weight_anomaly: float = 0.3) -> Column:
    return _c(p) * weight_model + _c(anomaly) * weight_anomaly


def ensemble(ps: list[str], weights: list[float]) -> dict[str, Column]:
    """Weighted mean, population variance over models, and stability."""
    total = float(sum(weights))
    cols = [_c(p) for p in ps]
    mean = sum((c * float(w) for c, w in zip(cols, weights)), F.lit(0.0)) / total
    plain = sum(cols, F.lit(0.0)) / len(cols)
    var = sum(((c - plain) * (c - plain) for c in cols), F.lit(0.0)) / len(cols)
    return {"fraud_probability": mean, "prediction_variance": var,
            "prediction_stability": 1 - clamp(var, 0, 1)}
