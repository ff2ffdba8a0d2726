"""Fitted feature engineering: rules are chosen and numbers fitted once on a table,
then applied unchanged to any other table, batch or stream."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.functions import features as ft
from ledgerwatch.functions import names as nm
from ledgerwatch.operators import encode
from ledgerwatch.operators.ordering import exact_quantiles
from ledgerwatch.operators.profile import is_numeric, kind, unique_shares, without_nan
from ledgerwatch.session import cut_lineage

# A technique is applied when its score exceeds the threshold.
THRESHOLDS = {"polynomial": 0.70, "interaction": 0.60, "binning": 0.40, "log_transform": 0.50, "aggregation": 0.60}



# step kind -> expression of its arguments; a step is plain data, so fitted rules save as JSON
STEPS = {
    "log": lambda s: F.log1p(ft.non_negative(s["a"])),
    "log_raw": lambda s: F.log1p(F.col(s["a"])),
    "sqrt": lambda s: F.sqrt(ft.non_negative(s["a"])),
    "square": lambda s: F.col(s["a"]) * F.col(s["a"]),
    "cube": lambda s: F.col(s["a"]) * F.col(s["a"]) * F.col(s["a"]),
    "width_bin": lambda s: ft.equal_width_bin(s["a"], s["lo"], s["hi"]),
    "quantile_bin": lambda s: ft.quantile_bin(s["a"], s["edges"]),
    "above": lambda s: ft.above(s["a"], s["cut"]),
    "below": lambda s: ft.below(s["a"], s["cut"]),
    "round": lambda s: ft.round_amount(s["a"], s["m"]),
    "ratio": lambda s: ft.ratio(s["a"], s["b"], s["eps"]),
    "product": lambda s: ft.product(s["a"], s["b"]),
    "sin": lambda s: ft.cyclic(s["a"], s["period"], "x")["x_sin"],
    "cos": lambda s: ft.cyclic(s["a"], s["period"], "x")["x_cos"],
    "hour": lambda s: F.hour(s["a"]), "day": lambda s: F.dayofmonth(s["a"]), "month": lambda s: F.month(s["a"]),
    "weekday": lambda s: F.weekday(s["a"]),
    "weekend": lambda s: ft.is_weekend(F.col(s["a"])),
    "weekend_of": lambda s: ft.is_weekend(F.weekday(s["a"])),
    "business_of": lambda s: ft.is_business_hours(F.hour(s["a"])),
    "night_of": lambda s: ft.is_night(F.hour(s["a"])),
    "night": lambda s: ft.is_night(F.col(s["a"]), "automl"),
    "business": lambda s: ft.is_business_hours(F.col(s["a"]), "automl"),
    "hour_log": lambda s: F.hour(s["t"]) * F.log1p(ft.non_negative(s["a"])),
    "same": lambda s: ft.same(s["a"], s["b"]), "different": lambda s: ft.different(s["a"], s["b"]),
    "length": lambda s: ft.name_length(s["a"]), "words": lambda s: ft.word_count(s["a"]),
}


def fit_codes(df: DataFrame, cats: list[str]) -> dict:
    """Codes as literals when there are few, otherwise as a table written once."""
    if not cats:
        return {}
    codes = encode.fit_label_codes(df, cats)
    maps = encode.small_code_maps(codes)
    return {"code_maps": maps} if maps is not None else {"codes": cut_lineage(codes)}


@dataclass
class FittedFeatures:
    """Steps, category codes, customer statistics, fill values and the output order."""

    steps: list[dict]
    inputs: list[str]
    categorical: list[str] = field(default_factory=list)
    fill: dict[str, float] = field(default_factory=dict)
    customer: str | None = None
    amount: str | None = None
    code_maps: dict[str, dict[str, int]] | None = None
    codes: DataFrame | None = None
    stats: DataFrame | None = None

    @property
    def outputs(self) -> list[str]:
        extra = [f"{self.customer}_tx_count", f"{self.customer}_avg_amount"] if self.customer else []
        return self.inputs + [s["name"] for s in self.steps] + extra

    @property
    def by_row(self) -> bool:
        """No table is joined: every row is transformed where it is."""
        return not self.customer and (not self.categorical or self.code_maps is not None)

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """``keep`` columns (ids, label) followed by the features as doubles without gaps."""
        kept = {f"_keep_{c}": F.col(c) for c in (keep or [])}
        out = df.withColumns({**kept, **{s["name"]: STEPS[s["kind"]](s) for s in self.steps}})
        if self.customer:
            out = out.join(self.stats, self.customer, "left")
        if self.categorical and self.code_maps is not None:
            out = out.withColumns({c: encode.code_from_map(c, self.code_maps.get(c, {"": 0})) for c in self.categorical})
        elif self.categorical:
            out = encode.apply_label_codes(out, self.codes, self.categorical)
        value = lambda c: F.coalesce(ft.finite(c), F.lit(float(self.fill.get(c, 0.0)))).alias(c)
        return out.select(*[F.col(k).alias(k[len("_keep_"):]) for k in kept], *[value(c) for c in self.outputs])

    def save(self, spark: SparkSession, path: str) -> None:
        state = {k: getattr(self, k) for k in ("steps", "inputs", "categorical", "fill", "customer", "amount", "code_maps")}
        spark.createDataFrame([(json.dumps(state),)], "value string").write.mode("overwrite").text(f"{path}/state")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        if self.stats is not None:
            self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedFeatures":
        out = FittedFeatures(**json.loads(spark.read.text(f"{path}/state").first()["value"]))
        if out.categorical and out.code_maps is None:
            out.codes = spark.read.parquet(f"{path}/codes")
        if out.customer:
            out.stats = spark.read.parquet(f"{path}/stats")
        return out


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """role -> columns, in schema order; distinct values are counted only where the role depends on them."""
    names = (df.sparkSession.createDataFrame([(i, f.name, kind(f.dataType)) for i, f in enumerate(df.schema)], "position int, name string, dtype string")
             .withColumn("grp", nm.semantic_group(nm.normalized(F.col("name")))))

    def role(share: Column) -> Column:
        return nm.column_role(F.col("name"), F.col("grp"), share, F.col("dtype") == "string", F.col("dtype").isin("integer", "float"))

    # the rules ask whether the share is above 0.95 or below 0.1
    trial = names.select("name", *[role(F.lit(s)).alias(k) for k, s in (("all", 1.0), ("some", 0.5), ("few", 0.0))]).collect()
    asked = [x["name"] for x in trial if not x["all"] == x["some"] == x["few"]]
    shares = unique_shares(without_nan(df), asked) if asked else {}
    share = F.lit(None).cast("double")
    for c, s in shares.items():
        share = F.when(F.col("name") == c, s).otherwise(share)
    out: dict[str, list[str]] = {}
    for x in names.select("name", "position", role(share).alias("role")).orderBy("position").collect():
        out.setdefault(x["role"] or "other", []).append(x["name"])
    return out


def _is_time(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, (T.TimestampType, T.TimestampNTZType))


def fit_rules(df: DataFrame, target: str | None = None, roles: dict[str, list[str]] | None = None) -> FittedFeatures:
    """Rule-based engineering by column role: amount, time, pair, name and interaction
    features, label codes, median filling; ids, dates and names are dropped."""
    x = df.drop(target) if target else df
    roles = column_roles(x) if roles is None else roles
    get = lambda k: [c for c in roles.get(k, []) if c != target]
    numeric = {f.name for f in x.schema if is_numeric(f.dataType)}
    amounts = [c for c in get("amount") if c in numeric]
    steps: list[dict] = []
    add = lambda name, kind, **kw: steps.append({"name": name, "kind": kind, **kw})
    plain = [c for c in amounts if "zscore" not in c.lower() and "z_score" not in c.lower()]
    dropped = set(get("id") + get("date") + get("name"))
    medians = [c for c in x.columns if c in numeric and c not in dropped]
    q = exact_quantiles(x, {c: [0.0, 0.05, 0.95, 1.0, 0.5] for c in dict.fromkeys(plain + medians)}) if plain or medians else {}
    for c in amounts:
        if c not in plain:
            add(f"{c}_squared", "square", a=c)
            continue
        if (c.lower().startswith("is_") or "flag" in c.lower()) and q[c][0] in (0.0, 1.0) and q[c][3] in (0.0, 1.0):
            continue
        for kind in ("log", "sqrt"):
            add(f"{c}_{kind}", kind, a=c)
        add(f"{c}_squared", "square", a=c)
        add(f"{c}_bin", "width_bin", a=c, lo=q[c][0], hi=q[c][3])
        add(f"{c}_is_high", "above", a=c, cut=q[c][2])
        add(f"{c}_is_low", "below", a=c, cut=q[c][1])
        add(f"{c}_is_round", "round", a=c, m=1000)
    times = [c for c in get("time") + get("date") if _is_time(x, c)]
    if times:
        t = times[0]
        for name, kind in (("transaction_hour", "hour"), ("transaction_day", "day"), ("transaction_month", "month"),
                           ("transaction_weekday", "weekday"), ("transaction_is_weekend", "weekend_of"),
                           ("is_business_hours", "business_of"), ("is_night", "night_of")):
            add(name, kind, a=t)
        if plain:
            add("hour_amount_interaction", "hour_log", t=t, a=plain[0])
    for role, out in (("country", ["is_same_country", "is_international"]), ("bank", ["is_same_bank"])):
        send = [c for c in get(role) if "sender" in c.lower() or "from" in c.lower()]
        recv = [c for c in get(role) if "receiver" in c.lower() or "to" in c.lower()]
        if send and recv:
            for name, kind in zip(out, ("same", "different")):
                add(name, kind, a=send[0], b=recv[0])
    for c in get("name"):
        add(f"{c}_length", "length", a=c)
        add(f"{c}_words", "words", a=c)
    cats = [c for c in get("categorical") + get("country") + get("bank") if c not in numeric and c not in dropped]
    inputs = [c for c in x.columns if c not in dropped and (c in numeric or c in cats)]
    return FittedFeatures(steps, inputs, cats, {c: q[c][4] or 0.0 for c in inputs if c in numeric},
                          **fit_codes(x, cats))


def fit_flags(df: DataFrame, flags: dict[str, float], amounts: list[str], times: list[str] | None = None,
              customer: str | None = None, cats: list[str] | None = None, binned: int | None = None) -> FittedFeatures:
    """Flag-driven engineering: five techniques by score, plus ratio, cyclic and calendar
    features that are always made.  Without amounts the first three numbers take part.
    `binned` limits the amounts that are binned to the first so many."""
    cats = cats or []
    numeric = [f.name for f in df.schema if is_numeric(f.dataType)]
    amounts = amounts or numeric[:3]
    on = {k for k, t in THRESHOLDS.items() if flags.get(k, 0.0) > t}
    steps: list[dict] = []
    add = lambda name, kind, **kw: steps.append({"name": name, "kind": kind, **kw})
    hours = [c for c in (times or []) if c in numeric]
    if "polynomial" in on:
        for c in amounts:
            add(f"{c}_squared", "square", a=c)
            add(f"{c}_cubed", "cube", a=c)
    if "interaction" in on:
        if len(amounts) >= 2:
            add(f"{amounts[0]}_x_{amounts[1]}", "product", a=amounts[0], b=amounts[1])
        if hours:
            add(f"{amounts[0]}_x_{hours[0]}", "product", a=amounts[0], b=hours[0])
    need: dict[str, list[float]] = {}
    if "log_transform" in on or "binning" in on:
        need = {c: [0.0, 0.2, 0.4, 0.6, 0.8, 1.0] for c in amounts}
    q = exact_quantiles(df, need) if need else {}
    if "log_transform" in on:
        for c in amounts:
            if q[c][0] is not None and q[c][0] > 0:
                add(f"{c}_log", "log_raw", a=c)
    if "binning" in on:
        for c in amounts[:binned]:
            add(f"{c}_bin", "quantile_bin", a=c, edges=q[c])
    if len(amounts) >= 2:
        add(f"{amounts[0]}_div_{amounts[1]}", "ratio", a=amounts[0], b=amounts[1], eps=1e-6)
    for c in hours:
        period = 7 if "weekday" in c.lower() or "day_of_week" in c.lower() else 24
        add(f"{c}_sin", "sin", a=c, period=period)
        add(f"{c}_cos", "cos", a=c, period=period)
    if "weekday" in numeric:
        add("is_weekend", "weekend", a="weekday")
    if "hour" in numeric:
        add("is_night", "night", a="hour")
        add("is_business_hours", "business", a="hour")
    stats = None
    if "aggregation" in on and customer:
        stats = df.groupBy(customer).agg(F.count("*").alias(f"{customer}_tx_count"), F.avg(amounts[0]).alias(f"{customer}_avg_amount"))
    inputs = [c for c in df.columns if (c in numeric or c in cats) and c != customer]
    return FittedFeatures(steps, inputs, cats, {}, customer if stats is not None else None, amounts[0],
                          stats=stats, **fit_codes(df, cats))


