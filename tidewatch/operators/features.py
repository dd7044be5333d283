"""Feature executor: many declarative features in one aggregation.

A feature contributes ``measures`` (decomposable aggregates over transactions),
``finish`` (columns computed from the aggregated row) and ``post`` (windows over
the entity's aggregated periods). Measures of all features run in one pass. When
distinct counts are asked for, the pass has two levels, (keys, counterparty) and
then (keys): a hot key is spread over its counterparties before it is brought
together, and no row is expanded per distinct count.

Features that cannot be a single aggregation give a ``frame``: a DataFrame with
one row per key, joined to the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.session import bucketed

Params = Mapping[str, object]
Columns = dict[str, Column]


@dataclass(frozen=True)
class Measure:
    """An aggregate that can be computed in two steps."""

    kind: str  # count | sum | max | min | distinct | carried
    value: Column | None = None
    where: Column | None = None
    key: str | None = None  # the counted column of a distinct measure

    def _filtered(self, value: Column) -> Column:
        return value if self.where is None else F.when(self.where, value)

    def whole(self) -> Column:
        """The aggregate in one step."""
        if self.kind == "distinct":
            return F.count_distinct(self._filtered(F.col(self.key)))
        return self.partial()

    def partial(self) -> Column:
        """First level, per (keys, counted column)."""
        if self.kind == "distinct":
            return F.max(self._filtered(F.lit(1)))
        if self.kind == "count":
            return F.count(self._filtered(F.lit(1) if self.value is None else self.value))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](self._filtered(self.value))

    def combine(self, name: str) -> Column:
        """Partial results of the same counted column, put together."""
        return {"count": F.sum, "sum": F.sum, "min": F.min}.get(self.kind, F.max)(name)

    def merge(self, name: str) -> Column:
        """Second level, per keys."""
        if self.kind == "distinct":
            return F.count(F.when(F.col(self.key).isNotNull(), F.col(name)))
        if self.kind == "count":
            return F.sum(name)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](name)


def count(where: Column | None = None) -> Measure:
    return Measure("count", None, where)


def total(value: Column, where: Column | None = None) -> Measure:
    """Sum over the matching rows; NULL when there is none."""
    return Measure("sum", value, where)


def largest(value: Column, where: Column | None = None) -> Measure:
    return Measure("max", value, where)


def smallest(value: Column, where: Column | None = None) -> Measure:
    return Measure("min", value, where)


def distinct(key: str, where: Column | None = None) -> Measure:
    return Measure("distinct", None, where, key)


def carried(text: Column) -> Measure:
    """Largest text of the rows.

    Texts cannot be kept in a hash aggregate's buffers, so they would turn the
    whole aggregation into a sort. They are reduced to distinct values first, on
    their own, and joined.
    """
    return Measure("carried", text)


def _nothing(params: Params) -> dict:
    return {}


@dataclass(frozen=True)
class Feature:
    """What to compute for one behavioural feature, and what it needs."""

    id: str
    outputs: tuple[str, ...]
    requires: frozenset[str]
    keys: tuple[str, ...] = ("customer_id", "month_offset")
    version: str = "v1"
    layer: str = "core"
    params: frozenset[str] = frozenset()
    defaults: Mapping[str, object] = field(default_factory=dict)
    measures: Callable[[Params], dict[str, Measure]] = _nothing
    finish: Callable[[Params], Columns] = _nothing
    post: Callable[[Params], Columns] = _nothing
    frame: Callable[[DataFrame | RollUp, Params], DataFrame] | None = None
    daily: bool = False  # the frame needs no more than daily totals
    trace: Callable[[Params], Column] | None = None


class FeatureError(ValueError):
    """A feature set that cannot be run together."""


# --- selection and parameters (driver side) ---------------------------------


def select_features(
    available: Iterable[Feature],
    spec: Mapping[str, Mapping[str, Mapping[str, object]]],
    active: bool = True,
    train: bool | None = None,
) -> list[Feature]:
    """Pick features by a ``{id: {version: {active, train, params}}}`` spec.

    A feature of layer ``ext`` takes the place of the ``core`` one with the same
    id and version. One version per id may be active, and no output column may
    come from two features.
    """
    by_key: dict[tuple[str, str], Feature] = {}
    for f in available:
        held = by_key.get((f.id, f.version))
        if held is None or f.layer == "ext":
            by_key[(f.id, f.version)] = f
    chosen: list[Feature] = []
    for fid, versions in spec.items():
        if not versions:
            raise FeatureError(f"{fid}: no version given")
        bad = [v for v in versions if not re.fullmatch(r"v\d+", v)]
        if bad:
            raise FeatureError(f"{fid}: versions must look like v1, got {bad}")
        missing = [v for v, c in versions.items() if "active" not in c or "train" not in c]
        if missing:
            raise FeatureError(f"{fid}: active and train must be set for {missing}")
        live = [v for v, c in versions.items() if c["active"]]
        if len(live) > 1:
            raise FeatureError(f"{fid}: more than one active version: {live}")
        for v, conf in versions.items():
            if (active and not conf["active"]) or (train is not None and conf["train"] != train):
                continue
            if (fid, v) not in by_key:
                raise FeatureError(f"{fid} {v} is not available")
            f = by_key[(fid, v)]
            chosen.append(replace(f, defaults={**f.defaults, **conf.get("params", {})}))
    _no_shared_outputs(chosen)
    return chosen


def _no_shared_outputs(features: Sequence[Feature]) -> None:
    owner: dict[str, str] = {}
    for f in features:
        for name in f.outputs:
            if owner.setdefault(name, f.id) != f.id:
                raise FeatureError(f"column {name} comes from both {owner[name]} and {f.id}")


def merged_params(feature: Feature, common: Params) -> dict:
    """Common parameters overridden by the feature's own."""
    return {**common, **feature.defaults}


def max_look_back(features: Iterable[Feature], common: Params, name: str, horizon: int | None = None) -> int:
    """Longest look-back any feature needs; an error when the data is shorter."""
    values = [int(common.get(name, 0)), 0]
    values += [int(merged_params(f, common).get(name, 0)) for f in features]
    longest = max(values)
    if horizon is not None and longest > horizon:
        raise FeatureError(f"look-back {longest} is longer than the data horizon {horizon}")
    return longest


# --- checks ------------------------------------------------------------------


def _describe(x: Column | Measure) -> str:
    if isinstance(x, Measure):
        return f"{x.kind}|{x.value}|{x.where}|{x.key}"
    return str(x)


def _gather(features: Sequence[Feature], common: Params, stage: str) -> dict:
    """One dict per stage; equal names must mean equal expressions and back."""
    out: dict = {}
    text_of: dict[str, str] = {}
    name_of: dict[str, str] = {}
    for f in features:
        for name, expr in getattr(f, stage)(merged_params(f, common)).items():
            text = _describe(expr)
            if text_of.setdefault(name, text) != text:
                raise FeatureError(f"{stage}: {name} is defined in two ways ({f.id})")
            if name_of.setdefault(text, name) != name:
                raise FeatureError(f"{stage}: {name} repeats {name_of[text]} ({f.id})")
            out[name] = expr
    return out


def check_features(df: DataFrame, features: Sequence[Feature], common: Params) -> None:
    keys = {f.keys for f in features}
    if len(keys) != 1:
        raise FeatureError(f"features are grouped by different keys: {sorted(keys)}")
    have = set(df.columns)
    for f in features:
        lost = sorted((f.requires | set(f.keys)) - have)
        if lost:
            raise FeatureError(f"{f.id}: missing columns {lost}")
        unset = sorted(f.params - set(merged_params(f, common)))
        if unset:
            raise FeatureError(f"{f.id}: missing parameters {unset}")
    _no_shared_outputs(features)


# --- execution ---------------------------------------------------------------


def aggregate_measures(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Measure], heavy: DataFrame | None = None) -> DataFrame:
    """All measures in one pass over the transactions.

    Distinct counts shuffle the rows by keys and counted column, and what is left of them by keys. Where that
    reduces little, ``heavy`` (see ``heavy_entities``; it is broadcast) saves the second: rows are
    dealt by keys, those of heavy entities by slices of the counted column, too.
    """
    texts = {n: m.value for n, m in measures.items() if m.kind == "carried"}
    if texts:
        few = df.select(*keys, *[v.alias(n) for n, v in texts.items()]).distinct()
        held = few.groupBy(*keys).agg(*[F.max(n).alias(n) for n in texts])
        others = {n: m for n, m in measures.items() if n not in texts}
        return held if not others else aggregate_measures(df, keys, others, heavy).join(held, list(keys))
    counted = {m.key for m in measures.values() if m.kind == "distinct"}
    if len(counted) == 1:
        (key,) = counted
        if key not in keys and heavy is not None:
            columns, over = _narrow(measures)
            dealt = df.join(F.broadcast(heavy), keys[0], "left").select(*keys, key, _slice_of(key).alias(SLICE), *[c.alias(n) for n, c in columns.items()])
            first = dealt.repartition(*keys, SLICE).groupBy(*keys, SLICE, key).agg(*[m.partial().alias(n) for n, m in over.items()])
            slices = first.groupBy(*keys, SLICE).agg(*[m.merge(n).alias(n) for n, m in measures.items()])
            return slices.groupBy(*keys).agg(*[(F.sum(n) if m.kind == "distinct" else m.combine(n)).alias(n) for n, m in measures.items()])
        if key not in keys:
            first = df.groupBy(*keys, key).agg(*[m.partial().alias(n) for n, m in measures.items()])
            return first.groupBy(*keys).agg(*[m.merge(n).alias(n) for n, m in measures.items()])
    return df.groupBy(*keys).agg(*[m.whole().alias(n) for n, m in measures.items()])


#: The part of its keys' rows that a row lies in; 0 but for keys with very many rows.
SLICE = "_slice"
#: Rows of an entity that one slice should hold.
SLICE_ROWS = 1 << 20


def heavy_entities(df: DataFrame, entity: str, most: int = SLICE_ROWS) -> DataFrame:
    """(entity, slices) of the entities with more than ``most`` rows: at most one for every ``most`` rows of ``df``."""
    sizes = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    return sizes.select(entity, F.ceil(F.col("_n") / most).cast("int").alias("_slices"))


def _slice_of(category: str) -> Column:
    """The slice of a row joined with the heavy entities."""
    return F.coalesce(F.pmod(F.xxhash64(category), F.col("_slices")).cast("int"), F.lit(0))


@dataclass(frozen=True)
class RollUp:
    """Transactions reduced once to (keys, day, counterparty).

    All measures are kept as partial results, which are put together upwards: by counterparty
    for explanations, by day for trailing totals, by keys for features. The rows are stored by keys and slice, so
    that none of these shuffles what it has not reduced.
    """

    rows: DataFrame
    keys: tuple[str, ...]
    day: str
    category: str
    measures: Mapping[str, Measure]
    daily: Mapping[str, Measure]
    held: Mapping[str, str]  # name of a measure -> column of the rows, which equal measures share

    def by_keys(self) -> DataFrame:
        """The measures per keys, over counterparties first, as a hot key is spread over them."""
        first = self.rows.groupBy(*self.keys, SLICE, self.category).agg(*[m.combine(self.held[n]).alias(n) for n, m in self.measures.items()])
        return first.groupBy(*self.keys).agg(*[m.merge(n).alias(n) for n, m in self.measures.items()])

    def by_day(self) -> DataFrame:
        """The daily measures per keys and day, in partitions by the first key, in which trailing windows run."""
        days = self.rows.groupBy(*self.keys, SLICE, self.day).agg(*[m.combine(self.held[f"_day_{n}"]).alias(n) for n, m in self.daily.items()])
        return days.repartition(self.keys[0]).groupBy(*self.keys, self.day).agg(*[m.combine(n).alias(n) for n, m in self.daily.items()])

    def explain(self, view: str) -> DataFrame:
        """Count ``c`` and rounded sum ``s`` per keys and counterparty of a view; rows without counterparty are left out."""
        c, s = self.held[f"_c_{view}"], self.held[f"_s_{view}"]
        rows = self.rows.filter((F.col(c) > 0) & F.col(self.category).isNotNull())
        return rows.groupBy(*self.keys, SLICE, self.category).agg(F.sum(c).alias("c"), F.round(F.sum(s), 2).alias("s")).drop(SLICE)


def _narrow(measures: Mapping[str, Measure]) -> tuple[Columns, dict[str, Measure]]:
    """Columns that hold all that the measures need, one for each value and one bit for each condition, and
    the measures over these columns: less to shuffle than the texts they come from or the measures themselves."""
    values: dict[str, tuple[str, Column]] = {}
    bits: dict[str, tuple[int, Column]] = {}
    over = {}
    for name, m in measures.items():
        value = where = None
        if m.value is not None:
            value = F.col(values.setdefault(str(m.value), (f"_v{len(values)}", m.value))[0])
        if m.where is not None:
            bit = bits.setdefault(str(m.where), (1 << len(bits), m.where))[0]
            where = F.col("_flags").bitwiseAND(F.lit(bit).cast("long")) != 0
        over[name] = replace(m, value=value, where=where)
    flags = sum((F.when(w, F.lit(bit)).otherwise(F.lit(0)).cast("long") for bit, w in bits.values()), F.lit(0).cast("long"))
    return {**dict(values.values()), "_flags": flags}, over


def roll_up(
    df: DataFrame, features: Sequence[Feature], params: Params | None, day: str, category: str, amount: str,
    daily: Mapping[str, Measure], views: Mapping[str, Column], heavy: DataFrame | None = None,
) -> RollUp:
    """One pass over the transactions, written once; ``views`` are predicates whose counts and sums are explained.

    Rows are dealt by their keys. The ``heavy`` entities (see ``heavy_entities``; they are broadcast) are
    dealt by slices of their counterparties, too.
    """
    common = dict(params or {})
    check_features(df, features, common)
    keys = features[0].keys
    measures = {n: m for n, m in _gather(features, common, "measures").items() if m.kind != "carried"}
    other = sorted({m.key for m in measures.values() if m.kind == "distinct"} - {category})
    if other:
        raise FeatureError(f"a roll-up by {category} cannot count distinct {other}")
    wanted = {**measures, **{f"_day_{n}": m for n, m in daily.items()}}
    for name, where in views.items():
        wanted |= {f"_c_{name}": count(where), f"_s_{name}": total(F.col(amount), where)}
    first: dict[str, str] = {}
    held = {n: first.setdefault(_describe(m), n) for n, m in wanted.items()}
    columns, over = _narrow({n: wanted[n] for n in first.values()})
    part = F.lit(0)
    if heavy is not None:
        df = df.join(F.broadcast(heavy), keys[0], "left")
        part = _slice_of(category)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = df.select(*keys, day, category, part.alias(SLICE), *[c.alias(name) for name, c in columns.items()]).repartition(n, *keys, SLICE)
    rows = narrow.groupBy(*keys, SLICE, day, category).agg(*[m.partial().alias(name) for name, m in over.items()])
    return RollUp(bucketed(rows, n, *keys, SLICE), tuple(keys), day, category, measures, daily, held)


def run_features(
    df: DataFrame,
    features: Sequence[Feature],
    params: Params | None = None,
    keep_inner: bool = False,
    roll: RollUp | None = None,
    texts_from: DataFrame | None = None,
    heavy: DataFrame | None = None,
) -> DataFrame:
    """One row per entity and period with the output columns of every feature.

    With a roll-up of the same features, ``df`` is read only for carried texts and for frames
    that need single transactions. ``texts_from``: the same transactions with fewer columns, to read the texts
    the joins that other columns need. ``heavy``: see ``aggregate_measures``.
    """
    common = dict(params or {})
    check_features(df, features, common)
    keys = list(features[0].keys)

    measures = _gather(features, common, "measures")
    finish = _gather(features, common, "finish")
    post = _gather(features, common, "post")

    out = None
    if measures:
        if roll is None:
            out = aggregate_measures(df, keys, measures, heavy)
        else:
            texts = {n: m for n, m in measures.items() if m.kind == "carried"}
            out = roll.by_keys()
            out = out.join(aggregate_measures(df if texts_from is None else texts_from, keys, texts), keys) if texts else out
        out = out.withColumns(finish)
    for f in features:
        if f.frame is not None:
            part = f.frame(roll if roll is not None and f.daily else df, merged_params(f, common))
            out = part if out is None else out.join(part, keys, "left")
    if post:
        out = out.withColumns(post)
    if keep_inner:
        return out
    return out.select(*keys, *[o for f in features for o in f.outputs])


def run_feature(df: DataFrame, feature: Feature, params: Params | None = None) -> DataFrame:
    """A single feature, ordered by its keys."""
    return run_features(df, [feature], params).orderBy(*feature.keys)
