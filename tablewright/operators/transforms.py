"""Column transforms: fit once on a table, then apply as a plain projection.

Every fit is one aggregate over all its columns (plus one value count where
values matter); only its small result reaches the driver. Every ``transform`` of
a fitted model is a single ``select``, so it also runs on a streaming frame.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import dates, parts
from tablewright.functions.cells import (
    clean,
    embedded_number,
    is_number,
    is_numeric_field,
    to_number,
)
from tablewright.operators.profile import FIRST_ROWS, LONG_TEXT, is_long, top_values, value_counts
from tablewright.operators.ranking import ordered_prefix, top_per_group
from tablewright.session import durable, fresh_path

MAX_ELEMENTS = 500
MAX_TERMS = 100
INLINE_CATEGORIES = 256


def q(name: str) -> Column:
    return F.col(f"`{name}`")


class _Columns(Params):
    """Parameter ``columns``: the input columns."""

    columns = Param(Params._dummy(), "columns", "input columns", TypeConverters.toListString)
    options = Param(Params._dummy(), "options", "further settings as JSON", TypeConverters.toString)

    def getColumns(self) -> list[str]:
        return self.getOrDefault(self.columns)

    def option(self, name, default=None):
        return json.loads(self.getOrDefault(self.options)).get(name, default)

    def _setup(self, columns, **options):
        self._set(columns=list(columns or []), options=json.dumps(options))


class _Fitted(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted transform: ``state`` holds what the fit found for each column."""

    state = Param(Params._dummy(), "state", "fit result as JSON", TypeConverters.toString)
    in_place = False

    def __init__(self, columns: Sequence[str] = (), state: dict | None = None, **options):
        super().__init__()
        self._setup(columns, **options)
        self._set(state=json.dumps(state or {}))

    def getState(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    def outputs(self, field: T.StructField, state) -> list[Column]:
        """Replacement columns of one input column."""
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.getState()
        replaced = {c: self.outputs(df.schema[c], state.get(c)) for c in self.getColumns()}
        kept, added = [], []
        for name in df.columns:
            if name not in replaced:
                kept.append(q(name))
            elif self.in_place:
                kept += replaced[name]
            else:
                added += replaced[name]
        return df.select(*kept, *added)


class _Fit(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator over ``columns``; subclasses give the fit state per column."""

    model: type[_Fitted]

    def __init__(self, columns: Sequence[str] = (), **options):
        super().__init__()
        self._setup(columns, **options)

    def fit_state(self, df: DataFrame, columns: list[str]) -> dict:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> _Fitted:
        columns = self.getColumns()
        state = self.fit_state(df, columns) if columns else {}
        options = json.loads(self.getOrDefault(self.options))
        return self.model(columns=columns, state=state, **options)


def one_row(df: DataFrame, aggs: list[Column]):
    """The single row of a global aggregate."""
    return df.agg(*aggs).first()


# --- numbers and categories -------------------------------------------------


class StandardizeModel(_Fitted):
    in_place = True

    def outputs(self, field, state):
        scale = state["std"] if state["std"] else 1.0
        value = clean(field).cast("double")
        return [((value - F.lit(state["mean"])) / F.lit(scale)).alias(field.name)]


class Standardize(_Fit):
    """(x - mean) / population standard deviation; a zero deviation divides by 1."""

    model = StandardizeModel

    def fit_state(self, df, columns):
        aggs = []
        for i, c in enumerate(columns):
            value = clean(df.schema[c]).cast("double")
            aggs += [F.avg(value).alias(f"m{i}"), F.stddev_pop(value).alias(f"s{i}")]
        row = one_row(df, aggs)
        return {
            c: {"mean": row[f"m{i}"] or 0.0, "std": row[f"s{i}"] or 0.0}
            for i, c in enumerate(columns)
        }


class _LookupWriter(DefaultParamsWriter):
    """Saves the written lookups of a model with it."""

    def saveImpl(self, path):
        model = self.instance
        state, spark = model.getState(), self.sparkSession
        for i, c in enumerate(model.getColumns()):
            if state[c].get("path"):
                spark.read.parquet(state[c]["path"]).write.parquet(f"{path}/lookups/{i}")
                state[c] = {"saved": f"lookups/{i}"}
        kept = model.getOrDefault(model.state)
        model._set(state=json.dumps(state))
        super().saveImpl(path)
        model._set(state=kept)


class _LookupReader(DefaultParamsReader):
    def load(self, path):
        model = super().load(path)
        state = {c: {"path": f"{path}/{s['saved']}"} if s.get("saved") else s for c, s in model.getState().items()}
        return model._set(state=json.dumps(state))


class OrdinalEncodeModel(_Fitted):
    in_place = True

    def write(self):
        return _LookupWriter(self)

    @classmethod
    def read(cls):
        return _LookupReader(cls)

    def _transform(self, df):
        state = self.getState()
        out = df
        for c in self.getColumns():
            path = state[c].get("path")
            if path:  # too many categories for a literal: a written lookup table
                lookup = df.sparkSession.read.parquet(path).withColumnsRenamed(
                    {"value": f"_v_{c}", "code": f"_code_{c}"}
                )
                # missing cells get a key of their own each, so they meet in no task and match nothing
                text = clean(df.schema[c]).cast("string")
                spread = F.concat(F.lit("\u0001"), F.monotonically_increasing_id().cast("string"))
                out = out.withColumn(f"_k_{c}", F.coalesce(text, spread))
                out = out.join(lookup, q(f"_k_{c}") == q(f"_v_{c}"), "left").drop(f"_v_{c}", f"_k_{c}")
        selected = []
        for f in df.schema.fields:
            if f.name not in state:
                selected.append(q(f.name))
            elif state[f.name].get("path"):
                selected.append(F.coalesce(q(f"_code_{f.name}"), F.lit(-1)).alias(f.name))
            else:
                selected += self.outputs(f, state[f.name])
        return out.select(*selected)

    def outputs(self, field, state):
        values = state["values"]
        if not values:
            return [F.lit(-1).cast("bigint").alias(field.name)]
        codes = F.map_from_arrays(
            F.lit(values), F.lit(list(range(len(values)))).cast("array<bigint>")
        )
        code = F.try_element_at(codes, clean(field).cast("string"))
        return [F.coalesce(code, F.lit(-1)).alias(field.name)]


class OrdinalEncode(_Fit):
    """Sorted categories to 0..k-1; unseen and missing values, NaN and infinities too, to -1.

    Categories are ordered in the column's own type. Few are kept in the model; many
    are ranked by range partitions and written as a lookup table next to the
    checkpoints, which ``save`` copies to the model's folder.
    """

    model = OrdinalEncodeModel

    def fit_state(self, df, columns):
        limit = self.option("inline", INLINE_CATEGORIES)
        state = {}
        for i, c in enumerate(columns):
            value = clean(df.schema[c])
            values = durable(df.select(value.alias("sorted")).filter(F.col("sorted").isNotNull()).distinct())
            few = [r[0] for r in values.orderBy("sorted").limit(limit + 1).select(F.col("sorted").cast("string")).collect()]
            if len(few) <= limit:
                state[c] = {"values": few}
                continue
            path = fresh_path(df.sparkSession, "categories")
            ordered_prefix(values, ["sorted"], out="upto").select(
                F.col("sorted").cast("string").alias("value"), (F.col("upto") - 1).alias("code")
            ).write.parquet(path)
            state[c] = {"path": path}
        return state


class ModeImputeModel(_Fitted):
    in_place = True

    def outputs(self, field, state):
        value = clean(field)
        fill = (state or {}).get("fill")
        if fill is None:
            fill = "nothing" if isinstance(field.dataType, T.StringType) else None
        if fill is None:
            return [value.alias(field.name)]
        return [F.coalesce(value, F.lit(fill).cast(field.dataType)).alias(field.name)]


class ModeImpute(_Fit):
    """Fill missing cells with the smallest most frequent value of the column."""

    model = ModeImputeModel

    def fit_state(self, df, columns):
        counts = value_counts(df, None, columns)
        numeric = [i for i, c in enumerate(columns) if is_numeric_field(df.schema[c])]
        as_number = F.when(F.col("pos").isin(numeric), F.col("token").try_cast("double"))
        ranked = top_values(df, counts.withColumn("_num", as_number), [F.col("n").desc(), F.col("_num")], 1, columns)
        rows = ranked.select("pos", "value").collect()
        return {columns[r["pos"]]: {"fill": r["value"]} for r in rows}


class CastIfNumericModel(_Fitted):
    in_place = True

    def outputs(self, field, state):
        if state and state["numeric"]:
            return [to_number(q(field.name)).alias(field.name)]
        return [q(field.name)]


class CastIfNumeric(_Fit):
    """Text columns become numbers when every filled cell parses as one."""

    model = CastIfNumericModel

    def fit_state(self, df, columns):
        row = one_row(df, [
            F.bool_and(is_number(q(c))).alias(f"b{i}") for i, c in enumerate(columns)
        ])
        return {c: {"numeric": bool(row[f"b{i}"])} for i, c in enumerate(columns)}


class DropColumns(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Drop the columns."""

    def __init__(self, columns: Sequence[str] = ()):
        super().__init__()
        self._setup(columns)

    def _transform(self, df):
        return df.drop(*self.getColumns())


class DropConstantModel(_Fitted):
    in_place = True

    def outputs(self, field, state):
        return [] if state and state["constant"] else [q(field.name)]


class DropConstant(_Fit):
    """Drop columns with at most one distinct value; the choice is kept for new data."""

    model = DropConstantModel

    def fit_state(self, df, columns):
        aggs = []
        for i, c in enumerate(columns):
            aggs += [F.min(q(c)).alias(f"a{i}"), F.max(q(c)).alias(f"z{i}")]
        row = one_row(df, aggs)
        return {c: {"constant": row[f"a{i}"] == row[f"z{i}"]} for i, c in enumerate(columns)}


# --- dates and URLs ---------------------------------------------------------


class DatePartsModel(_Fitted):
    def _transform(self, df):
        state = self.getState()
        columns = self.getColumns()
        texts = {c: f"_stamp_{c}" for c in columns if isinstance(df.schema[c].dataType, T.StringType)}
        japanese = [c for c in texts if state[c]["dialect"] == "japanese"]
        parsed = dates.with_stamps(df, texts, japanese) if texts else df
        parsed = parsed.withColumns({f"_stamp_{c}": q(c).cast("timestamp") for c in columns if c not in texts})
        added = []
        for c in self.getColumns():
            japanese = state[c]["dialect"] == "japanese"
            names = dates.JAPANESE_PARTS if japanese else dates.WESTERN_PARTS
            values = dates.date_parts(q(f"_stamp_{c}"))
            added += [v.alias(f"{c}_{n}") for v, n in zip(values, names)]
        return parsed.select(*[q(c) for c in df.columns if c not in self.getColumns()], *added)


class DateParts(_Fit):
    """Year to second and weekday of date columns.

    ``dialect`` is western, japanese or auto; auto names the parts in Japanese if
    any cell of the column has a character outside ASCII. Each cell of such a
    column is read as an era date, and as a western one where that fails.
    """

    model = DatePartsModel

    def fit_state(self, df, columns):
        dialect = self.option("dialect", "auto")
        if dialect != "auto":
            return {c: {"dialect": dialect} for c in columns}
        texts = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]
        wide = {}
        if texts:
            row = one_row(df, [F.bool_or(dates.has_wide_text(q(c))).alias(c) for c in texts])
            wide = row.asDict()
        return {c: {"dialect": "japanese" if wide.get(c) else "western"} for c in columns}


class UrlParts(_Fitted):
    """Domain, path, last path piece and depth of URL columns."""

    def outputs(self, field, state):
        names = ("Domain", "Path", "LastPath", "Depth")
        return [
            p.alias(f"{field.name}_{n}") for p, n in zip(parts.url_parts(q(field.name)), names)
        ]


# --- numbers inside text ----------------------------------------------------


class EmbeddedNumber(_Fitted):
    """The number inside each text."""

    in_place = True

    def outputs(self, field, state):
        return [embedded_number(q(field.name)).alias(field.name)]


def _one_residue(df: DataFrame, columns: list[str]) -> dict:
    """Whether each column has one unit: its smallest and largest residue agree."""
    aggs = []
    for i, c in enumerate(columns):
        residue = parts.unit_residue(q(c))
        aggs += [F.min(residue).alias(f"a{i}"), F.max(residue).alias(f"z{i}")]
    row = one_row(df, aggs)
    return {
        c: {"single": row[f"a{i}"] is not None and row[f"a{i}"] == row[f"z{i}"]}
        for i, c in enumerate(columns)
    }


class UnitNumberModel(_Fitted):
    in_place = True

    def outputs(self, field, state):
        cell = q(field.name)
        amount = parts.plain_amount(cell) if state["single"] else parts.unit_amount(
            cell, self.option("factors")
        )
        return [amount.alias(field.name)]


class UnitNumber(_Fit):
    """Number with unit to a number; scaled when the column mixes units."""

    model = UnitNumberModel

    def fit_state(self, df, columns):
        return _one_residue(df, columns)


class SignNumberModel(_Fitted):
    in_place = True

    def outputs(self, field, state):
        cell = q(field.name)
        amount = parts.plain_amount(cell) if state["single"] else parts.sign_amount(cell)
        return [amount.alias(field.name)]


class SignNumber(_Fit):
    """Number with a less-than or greater-than word to a number."""

    model = SignNumberModel

    def fit_state(self, df, columns):
        return _one_residue(df, columns)


class RangeNumberModel(_Fitted):
    def outputs(self, field, state):
        start, end = parts.range_ends(q(field.name))
        if state["ranges"]:
            return [start.alias(f"{field.name}_start"), end.alias(f"{field.name}_end")]
        return [start.alias(f"{field.name}_no_change")]


class RangeNumber(_Fit):
    """Range text to start and end, or to one number when no cell is a range."""

    model = RangeNumberModel

    def fit_state(self, df, columns):
        row = one_row(df, [
            F.bool_or(parts.has_range(q(c))).alias(f"b{i}") for i, c in enumerate(columns)
        ])
        return {c: {"ranges": bool(row[f"b{i}"])} for i, c in enumerate(columns)}


# --- lists ------------------------------------------------------------------


class ListColumnsModel(_Fitted):
    def _transform(self, df):
        state = self.getState()
        columns = self.getColumns()
        # A projection of its own: each list is split once for all its columns.
        split = df.withColumns({
            f"_list_{c}": parts.list_elements(q(c)) for c in columns if state[c]["kind"] != "text"
        })
        added = []
        for c in columns:
            elements, kind = q(f"_list_{c}"), state[c]["kind"]
            if kind == "categories":
                added += [
                    F.array_contains(elements, v).cast("int").alias(f"{c}_{v}") for v in state[c]["values"]
                ]
            elif kind == "fixed":
                added += [F.get(elements, F.lit(i)).alias(f"{c}_{i}") for i in range(state[c]["length"])]
            else:
                added.append(F.coalesce(q(c), F.lit("0")).alias(f"{c}_as_sentence"))
        return split.select(*[q(c) for c in df.columns if c not in columns], *added)


class ListColumns(_Fit):
    """List text to 0/1 columns, to fixed positions, or to plain text."""

    model = ListColumnsModel

    def fit_state(self, df, columns):
        most = self.option("max_elements", MAX_ELEMENTS)
        lists = {c: parts.list_elements(q(c)) for c in columns}
        # what the first rows show already, all rows need not be asked
        head = durable(df.select(*[q(c) for c in columns]).limit(FIRST_ROWS))
        many, uneven = self._many(head, columns, lists, most), self._uneven(head, columns, lists)
        open_ = [c for c in columns if c not in many]
        found: dict[str, list[str]] = {}
        if open_:
            counts = self._elements(df, open_, lists).groupBy("pos", "e").agg(F.count(F.lit(1)).alias("n"))
            # One more than allowed is enough to know a column has too many.
            for r in top_per_group(counts, ["pos"], [F.col("e")], most).select("pos", "e").collect():
                found.setdefault(open_[r["pos"]], []).append(r["e"])
        full = [c for c in columns if c in many or len(found.get(c, [])) >= most]
        asked = [c for c in full if c not in uneven]
        aggs = []
        for i, c in enumerate(asked):
            aggs += [F.min(F.size(lists[c])).alias(f"a{i}"), F.max(F.size(lists[c])).alias(f"z{i}")]
        row = one_row(df, aggs) if asked else {}
        length = {c: row[f"a{i}"] for i, c in enumerate(asked) if row[f"a{i}"] == row[f"z{i}"]}
        state = {}
        for c in columns:
            if c not in full:
                state[c] = {"kind": "categories", "values": sorted(found.get(c, []))}
            elif c in length:
                state[c] = {"kind": "fixed", "length": length[c]}
            else:
                state[c] = {"kind": "text"}
        return state

    @staticmethod
    def _elements(df, columns, lists):
        """(pos, e): the distinct elements of each cell."""
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("pos"), F.array_distinct(lists[c]).alias("es"))
            for i, c in enumerate(columns)
        ]))).select("pos", F.explode("es").alias("e"))

    def _many(self, head, columns, lists, most) -> set[str]:
        """Columns with at least ``most`` elements in some rows."""
        counts = self._elements(head, columns, lists).groupBy("pos").agg(F.count_distinct("e").alias("n"))
        return {columns[r["pos"]] for r in counts.where(F.col("n") >= most).collect()}

    @staticmethod
    def _uneven(head, columns, lists) -> set[str]:
        """Columns whose lists differ in length in some rows."""
        row = head.agg(*[(F.min(F.size(lists[c])) < F.max(F.size(lists[c]))).alias(f"u{i}") for i, c in enumerate(columns)]).first()
        return {c for i, c in enumerate(columns) if row[f"u{i}"]}


# --- formatted IDs ----------------------------------------------------------


def _split_values(df: DataFrame, columns: Sequence[str], counts: DataFrame | None) -> DataFrame:
    """(pos, value, n): the filled cells of the columns, distinct where already counted."""
    cells = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), q(c).cast("string").alias("value"))
        for i, c in enumerate(columns)
    ]))).filter(F.col("value").isNotNull())
    each = cells.select("pos", "value", F.lit(1).cast("bigint").alias("n"))
    if counts is None:
        return each
    # Counted values stand for all their cells; only long texts are read again.
    short = counts.filter(~is_long(F.col("token")))
    return short.select("pos", F.col("token").alias("value"), "n").unionByName(
        each.filter(F.length("value") > LONG_TEXT)
    )


def detect_splits(
    df: DataFrame, columns: Sequence[str], counts: DataFrame | None = None
) -> DataFrame:
    """(pos, column, separator, parts): parts is above 1 where all cells agree.

    ``counts`` may give the value counts of the columns, numbered in their order.
    """
    found = (
        _split_values(df, columns, counts)
        .select("pos", "n", parts.cell_separator(F.col("value")).alias("sep"), "value")
        .withColumn(
            "count",
            F.coalesce(
                (F.length("value") - F.length(F.replace("value", "sep", F.lit("")))) / F.length("sep") + 1,
                F.lit(1),
            ).cast("int"),
        )
    )
    by_sep = found.groupBy("pos", "sep").agg(
        F.sum("n").alias("n"), F.min("count").alias("least"), F.max("count").alias("most")
    )
    # Few separators per column are left; the most frequent wins, ties by value.
    best = by_sep.groupBy("pos").agg(
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.min(F.when(F.col("sep").isNotNull(), F.struct((-F.col("n")).alias("n"), "sep"))).alias("top"),
    )
    agreed = (F.col("least") == F.col("most")) & (F.col("most") > 1)
    return best.select(
        "pos",
        F.element_at(F.lit(list(columns)), F.col("pos") + 1).alias("column"),
        F.when(agreed, F.col("top.sep")).alias("separator"),
        F.when(agreed, F.col("most")).otherwise(F.lit(1)).alias("parts"),
    )


def maybe_split(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns whose cells may all have one number of parts above 1, as far as some first rows tell.

    Cells that differ in parts, or have one part each, rule a column out for good.
    """
    if not columns:
        return []
    head = durable(df.select(*[q(c) for c in columns]).limit(FIRST_ROWS))
    out = {r["column"] for r in detect_splits(head, columns).collect() if r["parts"] == 1}
    return [c for c in columns if c not in out]


def detect_split(df: DataFrame, column: str) -> tuple[str | None, int]:
    row = detect_splits(df, [column]).first()
    return (row["separator"], row["parts"]) if row else (None, 1)


def split_by_text(df: DataFrame, column: str, separator: str, n: int) -> DataFrame:
    """``{column}_0`` to ``{column}_{n-1}``; missing parts are empty."""
    names = [parts.text_part(q(column), separator, i).alias(f"{column}_{i}") for i in range(n)]
    return df.select(*[q(c) for c in df.columns if c != column], *names)


def split_by_offsets(df: DataFrame, column: str, offsets: Sequence[int]) -> DataFrame:
    """Pieces between character offsets."""
    names = [p.alias(f"{column}_{i}") for i, p in enumerate(parts.offset_parts(q(column), list(offsets)))]
    return df.select(*[q(c) for c in df.columns if c != column], *names)


def split_number_text(df: DataFrame, column: str) -> DataFrame:
    """``{column}_num`` and ``{column}_str``."""
    number, text = parts.number_text_parts(q(column))
    return df.select(
        *[q(c) for c in df.columns if c != column],
        number.alias(f"{column}_num"),
        text.alias(f"{column}_str"),
    )


class FormattedIdModel(_Fitted):
    def outputs(self, field, state):
        name, column = field.name, q(field.name)
        option = state["option"]
        if option == 3:
            return [column.alias(f"{name}_unchanged")]
        if option == 1:
            pieces = parts.offset_parts(column, state["offsets"])
            made = {f"{name}_{i}": p for i, p in enumerate(pieces)}
        elif option == 2:
            made = {f"{name}_{i}": parts.text_part(column, state["separator"], i) for i in range(state["parts"])}
        else:
            number, text = parts.number_text_parts(column)
            made = {f"{name}_num": number, f"{name}_str": text}
        numeric, dropped = state.get("numeric", []), state.get("dropped", [])
        return [
            (to_number(v) if n in numeric else v).alias(n) for n, v in made.items() if n not in dropped
        ]


class FormattedId(_Fit):
    """Split ID columns into parts, make numeric parts numbers, drop constant parts.

    ``specs`` may give a column's split: ``{"option": 1, "offsets": [..]}``,
    ``{"option": 2, "separator": ..}``, ``{"option": 3}`` (leave as is) or
    ``{"option": 4}`` (number and text). Other columns are split on the separator
    all their cells agree on, else into number and text.
    """

    model = FormattedIdModel

    def fit_state(self, df, columns):
        specs = dict(self.option("specs") or {})
        state = {}
        open_columns = maybe_split(df, [c for c in columns if c not in specs])
        found = {r["column"]: r for r in detect_splits(df, open_columns).collect()} if open_columns else {}
        sized = [c for c, s in specs.items() if s["option"] == 2]
        sizes = one_row(df, [
            F.max(F.size(F.split(q(c).cast("string"), parts.re.escape(specs[c]["separator"])))).alias(c)
            for c in sized
        ]) if sized else {}
        for c in columns:
            if c in specs:
                state[c] = dict(specs[c])
                if specs[c]["option"] == 2:
                    state[c]["parts"] = int(sizes[c] or 1)
            elif c in found and found[c]["parts"] > 1:
                state[c] = {"option": 2, "separator": found[c]["separator"], "parts": found[c]["parts"]}
            else:
                state[c] = {"option": 4}
        pieces = FormattedIdModel(columns=columns, state=state).transform(df.select(*map(q, columns)))
        made = {
            c: [n for n in pieces.columns if n.startswith(f"{c}_")]
            for c in columns if state[c]["option"] != 3
        }
        aggs = []
        for c, names in made.items():
            for n in names:
                aggs += [
                    F.bool_and(is_number(q(n))).alias(f"num_{n}"),
                    F.min(q(n)).alias(f"a_{n}"),
                    F.max(q(n)).alias(f"z_{n}"),
                ]
        row = one_row(pieces, aggs) if aggs else {}
        for c, names in made.items():
            state[c]["numeric"] = [n for n in names if row[f"num_{n}"]]
            state[c]["dropped"] = [n for n in names if row[f"a_{n}"] == row[f"z_{n}"]]
        return state


def interleaved_samples(df: DataFrame, column: str, key: str) -> DataFrame:
    """Five samples of a column, text and whole-number cells taking turns."""
    text = q(column).cast("string")
    cells = df.select(F.col(key).alias("ord"), text.alias("value")).filter(text.isNotNull())
    number = to_number(F.col("value"))
    sides = cells.select(
        "ord",
        F.inline(F.array(
            F.struct(F.lit("num").alias("side"), F.when(number.isNotNull(), F.format_string("%d", number.cast("bigint"))).alias("v")),
            F.struct(F.lit("str").alias("side"), F.when(~F.col("value").rlike(r"^\d+$"), F.col("value")).alias("v")),
        )),
    ).filter(F.col("v").isNotNull())
    totals = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"))
    firsts = top_per_group(sides, ["side"], [F.col("ord"), F.col("v")], 5, spread=["ord"])
    joined = firsts.groupBy("side").agg(
        F.sort_array(F.collect_list(F.struct("rank", "v"))).alias("_p")
    ).join(F.broadcast(totals), "side")
    empty = F.array().cast("array<string>")
    both = joined.agg(
        F.coalesce(F.max(F.when(F.col("side") == "num", F.col("_p.v"))), empty).alias("nums"),
        F.coalesce(F.max(F.when(F.col("side") == "str", F.col("_p.v"))), empty).alias("strs"),
        F.coalesce(F.max(F.when(F.col("side") == "num", F.col("n"))), F.lit(0)).alias("nn"),
        F.coalesce(F.max(F.when(F.col("side") == "str", F.col("n"))), F.lit(0)).alias("ns"),
    )
    longer_num = F.col("nn") > F.col("ns")
    turns = F.least(F.lit(3), F.when(longer_num, F.col("nn")).otherwise(F.col("ns"))).cast("int")
    pairs = F.flatten(F.transform(
        F.sequence(F.lit(0), turns - 1),
        lambda i: F.array(
            F.get(F.col("strs"), F.when(longer_num, (i % F.col("ns")).cast("int")).otherwise(i)),
            F.get(F.col("nums"), F.when(longer_num, i).otherwise((i % F.col("nn")).cast("int"))),
        ),
    ))
    picked = (
        F.when((F.col("nn") > 0) & (F.col("ns") > 0), pairs)
        .when(F.col("nn") > 0, F.col("nums"))
        .otherwise(F.col("strs"))
    )
    five = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.get(F.col("_s"), i % F.size("_s")))
    return both.select(picked.alias("_s")).select(F.when(F.size("_s") > 0, five).alias("samples"))


# --- text -------------------------------------------------------------------


def text_terms(col: Column) -> Column:
    """Lower-case terms of two or more word characters, digit runs as one term."""
    lowered = F.lower(F.coalesce(col.cast("string"), F.lit("NA")))
    bare = F.regexp_replace(lowered, r"[!-/:-@\[-`{-~]", "")
    masked = F.regexp_replace(bare, r"\p{Nd}+", "num")
    return F.regexp_extract_all(masked, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def text_vocabulary(df: DataFrame, column: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, uses, docs, total): the most used terms, ties by term.

    Each text is split once; its terms count as uses, its different terms as docs.
    """
    def counted(terms: Column, use: int, doc: int) -> Column:
        return F.transform(
            terms, lambda t: F.struct(t.alias("term"), F.lit(use).alias("use"), F.lit(doc).alias("doc"))
        )

    terms = df.select(text_terms(q(column)).alias("terms"))
    both = F.concat(counted(F.col("terms"), 1, 0), counted(F.array_distinct("terms"), 0, 1))
    uses = terms.select(F.inline(both)).groupBy("term").agg(
        F.sum("use").alias("uses"), F.sum("doc").alias("docs")
    )
    top = uses.orderBy(F.col("uses").desc(), F.col("term")).limit(max_terms)
    return top.withColumn("total", df.agg(F.count(F.lit(1))).scalar())


class TextTfIdfModel(_Fitted):
    """Adds ``{column}_tfidf``, an L2-normalised sparse vector over the vocabulary."""

    def _transform(self, df):
        out = df
        for c in self.getColumns():
            state = self.getState()[c]
            terms, counts, weighted = f"_{c}_terms", f"_{c}_counts", f"_{c}_weighted"
            out = out.withColumn(terms, text_terms(q(c)))
            if not state["terms"]:
                out = out.withColumn(f"{c}_tfidf", F.lit(None)).drop(terms, c)
                continue
            vectors = CountVectorizerModel.from_vocabulary(state["terms"], terms, counts)
            scale = ElementwiseProduct(scalingVec=Vectors.dense(state["idf"]), inputCol=counts, outputCol=weighted)
            unit = Normalizer(p=2.0, inputCol=weighted, outputCol=f"{c}_tfidf")
            out = unit.transform(scale.transform(vectors.transform(out))).drop(terms, counts, weighted, c)
        return out


class TextTfIdf(_Fit):
    """TF-IDF over the most used terms of each text column."""

    model = TextTfIdfModel

    def fit_state(self, df, columns):
        state = {}
        for c in columns:
            rows = text_vocabulary(df, c, self.option("max_terms", MAX_TERMS)).collect()
            rows.sort(key=lambda r: (-r["uses"], r["term"]))
            state[c] = {
                "terms": [r["term"] for r in rows],
                "idf": [math.log((1 + r["total"]) / (1 + r["docs"])) + 1 for r in rows],
            }
        return state


def tfidf_rows(df: DataFrame, column: str, key: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """Long form of the TF-IDF weights: (key, term, weight); no shuffle after the fit."""
    model = TextTfIdf([column], max_terms=max_terms).fit(df.select(key, column))
    terms = model.getState()[column]["terms"]
    weights = model.transform(df.select(key, column)).select(
        key, F.posexplode(vector_to_array(F.col(f"{column}_tfidf"))).alias("_i", "weight")
    )
    return weights.filter(F.col("weight") > 0).select(
        key, F.element_at(F.lit(terms), F.col("_i") + 1).alias("term"), "weight"
    )
