"""Column profiles: counts, distinct values, extremes, top values, hidden types, personal data.

Most tables: one value-frequency table carries everything but the typed extremes. Every column is
read and its distinct values are shuffled once, and a value that fills a third of a column is already
one row after the map-side sums. Files over COLUMNWISE_BYTES are read a column at a time, so a task
holds the values of one column of its split, and numbers and dates are counted as they are and only
then written as text.

Very large tables: no facts need a shuffle of values but the distinct counts of what is no whole number.
Counts and shapes are sums of rows as they come, whole numbers are counted by bitmaps (see `distinct`),
and top values come from candidates that are counted again (see `heavy`). Both ways give the same
rows; SMALL_BYTES, by the size of the tables as the optimizer knows it, decides between them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F, types as T

from tallyglass.functions import fixed, kinds
from tallyglass.functions.text import quoted, rlike_sql, stripped, stripped_sql
from tallyglass.operators import distinct, heavy
from tallyglass.sources.catalog import union_all

LONG_TEXT = 256
TOP_VALUES = 10
SMALL_BYTES = 64 << 30
COLUMNWISE_BYTES = 4 << 20
COLUMNWISE_PARTS = 32  # of one table at most; a wider one is read some columns at a time
SAMPLE_VALUES = 5
NAME = ["table_name", "column_name"]
NOT_SORTABLE = (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def _name(field: T.StructField) -> str:
    return "`" + field.name.replace("`", "``") + "`"


def text_sql(field: T.StructField) -> str:
    """SQL for the value of any column as text."""
    name = _name(field)
    if isinstance(field.dataType, T.BinaryType):
        return f"hex({name})"
    if isinstance(field.dataType, T.ArrayType):
        return f"if({name} is null, null, to_json(struct({name})))"
    if isinstance(field.dataType, (T.MapType, T.StructType)):
        return f"to_json({name})"
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        zero = f"cast(0 as {field.dataType.simpleString()})"
        return f"cast({name} + {zero} as string)"  # zero and minus zero are one value
    return f"cast({name} as string)"


# --- per-value facts -------------------------------------------------------------------------
# Long expressions are written as SQL text: one parse instead of hundreds of calls to the JVM.

BITS = ["blank", "dated", "ipv4", "dialled", "boolean", *fixed.FORMATS]
PII_BITS = {"email": "email", "iban": "iban", "siret": "siret", "ipv4": "ipv4",
            "phone": "dialled"}


def _shape_sql(text: str) -> str:
    """What one value looks like, as the bits of one number, so that it travels as one column.

    Patterns that serve both personal data and formats are tested once; combinations are read
    from the bits later. `text` has no blanks at its ends. A pattern is only tried on values that pass
    a cheap test which it implies: most texts begin with a letter, are long and hold no `@`.
    """
    low, high = fixed.PHONE_DIGITS
    digits = f"length(regexp_replace({text}, '[^0-9]', ''))"
    booleans = ", ".join(quoted(b) for b in fixed.TEXT_BOOLEANS)
    tests = {
        "blank": f"length({text}) = 0",
        "dated": rlike_sql(text, fixed.DATE_LIKE),
        "ipv4": rlike_sql(text, fixed.PII_PATTERNS["ipv4"]),
        "dialled": f"{rlike_sql(text, fixed.PII_PATTERNS['phone'])} "
                   f"and {digits} between {low} and {high}",
        "boolean": f"lower({text}) in ({booleans})",
    } | {name: rlike_sql(text, pattern) for name, pattern in fixed.FORMATS.items()}
    shortest, longest = min(map(len, fixed.TEXT_BOOLEANS)), max(map(len, fixed.TEXT_BOOLEANS))
    first = f"left({text}, 1)"
    implied = {
        "blank": "true",
        "boolean": f"length({text}) between {shortest} and {longest}",
        "email": f"contains({text}, '@')",
        "iban": f"{first} between 'A' and 'Z'",
    }
    like_number = f"({first} between '0' and '9' or {first} in ('+', '-', '(', ')', '.'))"
    grouped: dict[str, list[str]] = {}
    for i, name in enumerate(BITS):
        grouped.setdefault(implied.get(name, like_number), []).append(
            f"if({tests[name]}, {1 << i}, 0)")
    return " + ".join(f"if({test}, {' + '.join(bits)}, 0)" for test, bits in grouped.items())


def _bit_sql(name: str) -> str:
    return f"(shape & {1 << BITS.index(name)} <> 0)"


Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Cells:
    """The tables turned on their side: (c, cell), where `c` numbers `names` from 1.

    A number instead of two names keeps the rows that are shuffled small.
    """

    names: list[tuple[str, str, str]]  # table, column, kind
    tables: Tables
    columns: list[str] | None
    df: DataFrame
    texts: DataFrame | None  # the cells to be counted as text
    typed: list[DataFrame]  # (c, v): the cells to be counted as what they are, by type

    def named(self, df: DataFrame) -> DataFrame:
        tables = ", ".join(quoted(t) for t, _, _ in self.names)
        columns = ", ".join(quoted(c) for _, c, _ in self.names)
        others = [c for c in df.columns if c != "c"]
        return df.selectExpr(f"element_at(array({tables}), c) as table_name",
                             f"element_at(array({columns}), c) as column_name", *others)

    def kind_sql(self, *wanted: str) -> str:
        """SQL test: the column is of one of these kinds."""
        ids = [str(i) for i, (_, _, kind) in enumerate(self.names, 1) if kind in wanted]
        return f"c in ({', '.join(ids)})" if ids else "false"

    def only(self, *wanted: str) -> DataFrame | None:
        if not any(kind in wanted for _, _, kind in self.names):
            return None
        return cells(self.tables, self.columns, wanted).df


def _typed(data_type: T.DataType) -> str | None:
    """The type in which equal values have equal text and the reverse, where it is cheaper than text."""
    if isinstance(data_type, T.IntegralType):
        return "bigint"
    if isinstance(data_type, (T.FloatType, T.DoubleType, T.DateType, T.TimestampNTZType)):
        return data_type.simpleString()
    return None


def columnwise(df: DataFrame) -> bool:
    """Whether the table is a large columnar file whose columns are best read one after the other."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(str(plan.stats().sizeInBytes())) <= COLUMNWISE_BYTES:
        return False
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and str(
        plan.relation().toString()) in ("parquet", "orc")


def _sideways(df: DataFrame, columns: list[tuple[int, str]], name: str) -> DataFrame:
    """(c, `name`) of the columns, given by number and SQL."""
    if len(columns) == 1:
        return df.selectExpr(f"{columns[0][0]} as c", f"{columns[0][1]} as {name}")
    structs = ", ".join(f"named_struct('c', {c}, '{name}', {value})" for c, value in columns)
    return df.selectExpr(f"inline(array({structs}))")


def cells(tables: Tables, columns: list[str] | None = None, wanted: tuple[str, ...] = ()
          ) -> Cells:
    """All columns are named; where kinds are wanted, only values of those are read."""
    names, parts, texts = [], [], []
    typed: dict[str, list[DataFrame]] = {}
    for name, df in tables.items():
        read = []
        for f in df.schema.fields:
            if columns is None or f.name in columns:
                kind = kinds.kind_of(f.dataType)
                names.append((name, f.name, kind))
                if not wanted or kind in wanted:
                    read.append((len(names), f))
        if not read:
            continue
        parts.append(_sideways(df, [(c, text_sql(f)) for c, f in read], "cell"))
        if not columnwise(df):
            texts.append(parts[-1])
            continue
        of_type: dict[str | None, list] = {}
        for c, f in read:
            of_type.setdefault(_typed(f.dataType), []).append((c, f))
        together = -(-len(read) // COLUMNWISE_PARTS)
        for type_name, some in of_type.items():
            for at in range(0, len(some), together):
                few = some[at:at + together]
                if type_name is None:
                    texts.append(_sideways(df, [(c, text_sql(f)) for c, f in few], "cell"))
                else:
                    typed.setdefault(type_name, []).append(_sideways(
                        df, [(c, f"cast({_name(f)} as {type_name})") for c, f in few], "v"))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        parts.append(spark.createDataFrame([], "c int, cell string"))
        texts = parts
    return Cells(names, tables, columns, union_all(parts), union_all(texts) if texts else None,
                 [union_all(some) for some in typed.values()])


def _value_facts(source: Cells) -> DataFrame:
    """Shape totals per column, for every column named, in one pass without a shuffle of values.

    Every row counts as it comes: nothing here depends on which values are equal.
    """
    tested = _tested_sql(source, "cell")
    each = source.df.selectExpr(
        "c", "length(cell) as length",
        f"if({tested} and cell is not null, {_shape_sql(stripped_sql('cell'))}, 0) as shape",
        "1 as n")
    spark = source.df.sparkSession
    every = spark.range(1, len(source.names) + 1).select(F.col("id").cast("int").alias("c"))
    facts = every.join(_column_facts(each), "c", "left")
    return facts.withColumn("filled", F.coalesce("filled", F.lit(0)))


def _tested_sql(source: Cells, cell: str) -> str:
    """Whose shape is looked at: texts, and whole numbers long enough to be a telephone number."""
    return (f"({source.kind_sql('text')} or ({source.kind_sql('integer')} "
            f"and length({cell}) >= {fixed.PHONE_DIGITS[0]}))")


def counted(source: Cells, about: dict[str, str]) -> DataFrame:
    """(c, value, about, n): every distinct value of every column, counted.

    Values longer than 256 characters are grouped by a SHA-256 digest, so documents do not travel;
    `about` has it, and the given SQL of the whole text. NULL is a value of its own without either.
    """
    parts = []
    if source.texts is not None:
        long = f"length(cell) > {LONG_TEXT}"
        told = ", ".join(f"'{name}', {sql}" for name, sql in about.items())
        parts.append(source.texts.selectExpr(
            "c", f"if({long}, null, cell) as value",
            f"if({long}, named_struct('digest', sha2(cell, 256), {told}), null) as about",
        ).groupBy("c", "value", "about").agg(F.count("*").alias("n")))
    if source.typed:
        kind = parts[0].schema["about"].dataType.simpleString() if parts else "struct<" + ",".join(
            f"{name}:{type_name}" for name, type_name in source.df.selectExpr(
                "sha2(cell, 256) as digest", *[f"{sql} as {name}" for name, sql in about.items()]
            ).dtypes) + ">"
        parts += [df.groupBy("c", "v").agg(F.count("*").alias("n")).selectExpr(
            "c", "cast(v as string) as value", f"cast(null as {kind}) as about", "n")
            for df in source.typed]
    return union_all(parts)


def frequencies(source: Cells) -> DataFrame:
    """(c, value, digest, length, shape, n): every distinct value of every column, counted.

    Of long values the length and shape are read from the whole text. NULL has a `length` of NULL.
    """
    tested = _tested_sql(source, "cell")
    whole_shape = _shape_sql(stripped_sql("cell"))
    grouped = counted(source, {
        "length": "length(cell)", "shape": f"if({tested}, {whole_shape}, 0)"})
    return grouped.selectExpr("*", f"{stripped_sql('value')} as text").selectExpr(
        "c", "value", "about.digest", "coalesce(about.length, length(value)) as length",
        f"coalesce(about.shape, if({_tested_sql(source, 'value')} and text is not null, "
        f"{_shape_sql('text')}, 0)) "
        "as shape", "n",
    )


def _column_facts(freq: DataFrame) -> DataFrame:
    """Counts and shape totals per column; every buffer is a number, so this stays hashed."""
    known, filled = "length is not null", f"length is not null and not {_bit_sql('blank')}"

    def rows(test, name):
        return f"coalesce(sum(if({test}, n, 0)), 0) as {name}"

    facts = [
        "sum(n) as sample_size", rows(known, "non_null_count"),
        "count(length) as distinct_count",
        "sum(n * length) / sum(if(length is null, null, n)) as avg_length",
        rows(filled, "filled"),
    ]
    facts += [
        rows(f"{filled} and {_bit_sql(bit)} and not {_bit_sql('dated')}", f"pii_{p}")
        for p, bit in PII_BITS.items()
    ]
    facts += [
        f"coalesce(bool_and(if({filled}, {_bit_sql(bit)}, null)), true) as {name}"
        for name, bit in (("is_date", "date"), ("is_integer", "integer"),
                          ("is_number", "numeric"), ("is_boolean", "boolean"))
    ]
    facts += [rows(f"{known} and not {_bit_sql(f)}", f"bad_{f}") for f in fixed.FORMATS]
    return freq.groupBy("c").agg(*[F.expr(f) for f in facts])


def _extremes(df: DataFrame, name: str) -> DataFrame:
    """Typed minimum, maximum and mean of every column, in aggregates without a shuffle.

    One text among them makes an aggregate of numbers some times slower, so those of a large file
    have one of their own.
    """
    fields = list(enumerate(df.schema.fields))
    if not columnwise(df):
        return _extremes_of(df, name, fields)
    numbers = [(i, f) for i, f in fields if _typed(f.dataType) is not None]
    others = [x for x in fields if x not in numbers]
    return union_all([_extremes_of(df, name, some) for some in (numbers, others) if some])


def _extremes_of(df: DataFrame, name: str, fields: list[tuple[int, T.StructField]]) -> DataFrame:
    aggregates, rows = ["count(*) as n"], []
    for i, f in fields:
        column, kind = _name(f), kinds.kind_of(f.dataType)
        low = high = mean = "null"
        if not isinstance(f.dataType, NOT_SORTABLE):
            low, high = f"low_{i}", f"high_{i}"
            aggregates += [f"min({column}) as {low}", f"max({column}) as {high}"]
        if kind in ("integer", "number"):
            mean = f"mean_{i}"
            aggregates.append(f"avg({column}) as {mean}")
        rows.append(
            f"named_struct('table_name', {quoted(name)}, 'column_name', {quoted(f.name)}, "
            f"'ordinal', {i + 1}, 'declared_type', {quoted(f.dataType.simpleString())}, "
            f"'kind', '{kind}', 'min_value', cast({low} as string), "
            f"'max_value', cast({high} as string), 'mean_value', cast({mean} as double))"
        )
    return df.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(rows)}))")


# --- what the facts mean ---------------------------------------------------------------------

# Type a column really holds: its own, or one that all its text values agree on.
HIDDEN_TYPE = """
case when kind = 'integer' then 'integer' when kind = 'number' then 'numeric'
  when kind = 'boolean' then 'boolean' when kind = 'temporal' then 'datetime'
  when kind <> 'text' or filled = 0 then 'text' when is_date then 'datetime (text)'
  when is_integer then 'integer (text)' when is_number then 'numeric (text)'
  when is_boolean then 'boolean (text)' else 'text' end"""

# First kind of personal data that enough of the filled values match, and by name.
PII_BY_VALUES = "case " + " ".join(
    f"when filled > 0 and pii_{p} / filled >= {fixed.PII_SHARE} then '{p}'"
    for p in fixed.PII_PATTERNS
) + " end"
PII_BY_NAME = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(column_name), '{h}')" for h in hints) + f" then '{p}'"
    for p, hints in fixed.PII_NAME_HINTS.items()
) + " end"

EXPECTED_FORMAT = """
case when kind <> 'text' or non_null_count = 0 then null
  when pii_type in ('email', 'phone', 'iban', 'siret') then pii_type
  when detected_type = 'datetime (text)' then 'date'
  when detected_type = 'integer (text)' then 'integer'
  when detected_type = 'numeric (text)' then 'numeric' end"""

INVALID = "case format_checked " + " ".join(
    f"when '{f}' then bad_{f}" for f in fixed.FORMATS) + " end"


def _meaning(facts: DataFrame, extremes: DataFrame) -> DataFrame:
    return extremes.join(facts, NAME).selectExpr(
        "*", f"{HIDDEN_TYPE} as detected_type", f"coalesce({PII_BY_VALUES}, {PII_BY_NAME}) "
        "as pii_type",
    ).selectExpr("*", f"{EXPECTED_FORMAT} as format_checked").selectExpr(
        "*", f"{INVALID} as invalid_count")


# --- public operators ------------------------------------------------------------------------

def _whole_values(source: Cells, best: DataFrame, name: str) -> DataFrame:
    """Long values by their digest, in column `name`: at most k digests per column are broadcast."""
    texts = source.only("text", "other")
    if texts is None:
        return best.withColumn("whole", F.lit(None).cast("string"))
    wanted = best.where(F.col(name).isNotNull()).select("c", name)
    found = texts.where(F.length("cell") > LONG_TEXT).withColumn(
        name, F.sha2("cell", 256)
    ).join(F.broadcast(wanted), ["c", name], "left_semi").groupBy("c", name).agg(
        F.first("cell").alias("whole")
    )
    return best.join(found, ["c", name], "left")


def _ranked(source: Cells, freq: DataFrame, k: int) -> DataFrame:
    # NULL sorts last and is dropped after ranking: a filter before it would give this branch a
    # shuffle of its own instead of the one that the column facts already use.
    order = Window.partitionBy("c").orderBy(
        F.col("length").isNull(), F.desc("n"), F.coalesce("value", "digest")
    )
    best = freq.withColumn("rank", F.row_number().over(order)).where(
        (F.col("rank") <= k) & F.col("length").isNotNull()
    )
    return _whole_values(source, best, "digest").select(
        "c", "rank", F.coalesce("value", "whole").alias("value"), "n"
    )


def _items(source: Cells) -> DataFrame:
    """(c, item): values with a mark, digests of long ones with another."""
    return source.df.where("cell is not null").selectExpr(
        "c", f"if(length(cell) > {LONG_TEXT}, concat('#', sha2(cell, 256)), concat('=', cell)) "
        "as item")


def _counted_numbers(source: Cells, tables: Tables) -> dict[int, tuple[int, bool]]:
    """For columns of `source` that bitmaps suit: the distinct count, and whether no value repeats."""
    names, values = distinct.whole_numbers(tables)
    place = {name: i for i, name in enumerate(((t, c) for t, c, _ in source.names), 1)}
    fits = [] if values is None else [
        i for i, yes in distinct.dense(values).items() if yes and names[i - 1] in place]
    if not fits:
        return {}
    values = values.where(F.col("c").isin(*fits))
    known = values.groupBy("c").agg(F.count("v").alias("known"))
    return {place[names[r.c - 1]]: (r.distinct_count, r.distinct_count == r.known)
            for r in distinct.by_bitmaps(values).join(known, "c").collect()}


def _heavy(source: Cells, k: int, numbers: dict[int, tuple[int, bool]]) -> DataFrame:
    """(c, rank, value, n) from candidates; see `heavy`."""
    items = _items(source)
    unique = [c for c, (_, once) in numbers.items() if once]
    others = [c for c in range(1, len(source.names) + 1) if c not in unique]
    best = heavy.top_items(items, others, k)
    if unique:
        best = best.unionByName(heavy.smallest(items, unique, k))
    best = best.selectExpr(
        "c", "rank", "n", "if(item like '=%', substring(item, 2), null) as value",
        "if(item like '#%', substring(item, 2), null) as digest")
    return _whole_values(source, best, "digest").select(
        "c", "rank", F.coalesce("value", "whole").alias("value"), "n")


def _bytes(tables: Tables) -> int:
    """The size of the tables as the optimizer knows it, or zero."""
    return sum(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
               for df in tables.values())


def top_values(df: DataFrame, k: int = TOP_VALUES, columns: list[str] | None = None
               ) -> DataFrame:
    """(column_name, rank, value, n): the `k` most frequent values per column, ties by value.

    Candidates are found by sketches and counted again, so values are shuffled only where many
    of them might be as frequent as the last one wanted.
    """
    source = cells({"": df}, columns)
    return source.named(_heavy(source, k, _counted_numbers(source, {"": df}))).drop("table_name")


def profile(df: DataFrame, name: str, sampled: bool = False, n_rows: int | None = None,
            small_bytes: int = SMALL_BYTES) -> DataFrame:
    """One row per column of the table: the twenty facts a data analyst looks up first.

    Tables of more than `small_bytes` are profiled without a shuffle of all their values.
    """
    return _profiles({name: df}, sampled, n_rows, small_bytes)


def _by_frequencies(source: Cells) -> tuple[DataFrame, DataFrame]:
    freq = frequencies(source)
    return _column_facts(freq), _ranked(source, freq, TOP_VALUES)


def _by_summaries(source: Cells, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """The same facts and top values; only values of columns without a bitmap are shuffled, once each."""
    numbers = _counted_numbers(source, tables)
    others = _items(source)
    if numbers:
        others = others.where(~F.col("c").isin(*numbers))
    counts = distinct.by_values(others.withColumnRenamed("item", "v")).unionByName(
        others.sparkSession.createDataFrame(
            [(c, n) for c, (n, _) in numbers.items()], "c int, distinct_count bigint"))
    facts = _value_facts(source).where("sample_size is not null").drop("distinct_count").join(
        counts, "c", "left")
    return facts.withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0).cast("long"))), \
        _heavy(source, TOP_VALUES, numbers)


def _profiles(tables: Tables, sampled: bool = False, n_rows: int | None = None,
              small_bytes: int = SMALL_BYTES) -> DataFrame:
    source = cells(tables)
    small = _bytes(tables) <= small_bytes
    column_facts, ranked = _by_frequencies(source) if small else _by_summaries(source, tables)
    best = ranked.groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("best")
    ).select(
        "c",
        F.transform("best", lambda b: F.struct(b.value.alias("value"), b.n.alias("count")))
        .alias("top_values"),
        F.slice(F.transform("best", lambda b: b.value), 1, SAMPLE_VALUES).alias("sample_values"),
    )
    extremes = union_all([_extremes(df, name) for name, df in tables.items()])
    facts = source.named(column_facts.join(best, "c", "left"))
    rows = "sample_size" if n_rows is None else f"cast({n_rows} as bigint)"
    return _meaning(facts, extremes).selectExpr(
        *NAME, "ordinal", "declared_type", f"{str(sampled).lower()} as sampled", "sample_size",
        f"{rows} as row_count", "sample_size - non_null_count as null_count", "non_null_count",
        "1 - non_null_count / sample_size as null_rate", "distinct_count",
        "distinct_count / nullif(non_null_count, 0) as distinct_ratio",
        "min_value", "max_value", "mean_value", "avg_length", "detected_type", "pii_type",
        "format_checked", "invalid_count",
        "coalesce(top_values, cast(array() as array<struct<value:string,count:bigint>>)) "
        "as top_values",
        "coalesce(sample_values, cast(array() as array<string>)) as sample_values",
    )


def quick_counts(df: DataFrame, name: str, lg_k: int = 12) -> DataFrame:
    """Counts with sketched distinct values: one pass, no shuffle of values, for wide tables."""
    fields = df.schema.fields
    aggregates = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        aggregates += [
            F.count(f"`{f.name}`").alias(f"known_{i}"),
            F.hll_sketch_estimate(F.hll_sketch_agg(F.expr(text_sql(f)), lg_k))
            .alias(f"distinct_{i}"),
        ]
    rows = [
        F.struct(
            F.lit(name).alias("table_name"), F.lit(f.name).alias("column_name"),
            F.col("rows").alias("row_count"), F.col(f"known_{i}").alias("non_null_count"),
            (F.col("rows") - F.col(f"known_{i}")).alias("null_count"),
            F.col(f"distinct_{i}").alias("distinct_count"),
        )
        for i, f in enumerate(fields)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def detect_types(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, detected_type): the schema decides, or all values of a text column."""
    source = cells({"": df}, columns, ("text",))
    by_kind = ", ".join(quoted(kind) for _, _, kind in source.names)
    facts = _value_facts(source).selectExpr(
        "*", f"element_at(array({by_kind}), c) as kind")
    return source.named(facts).selectExpr("column_name", f"{HIDDEN_TYPE} as detected_type")


def validity(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """(column_name, format_checked, checked, invalid_count) over every row, in one pass."""
    for fmt in formats.values():
        if fmt not in fixed.FORMATS:
            raise ValueError(f"unknown format {fmt!r}")
    counts = []
    for i, (column, fmt) in enumerate(formats.items()):
        value = stripped(F.col(column).cast("string"))
        counts += [
            F.count(column).alias(f"n_{i}"),
            F.count_if(~value.rlike(fixed.FORMATS[fmt])).alias(f"bad_{i}"),
        ]
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.lit(f).alias("format_checked"),
                 F.col(f"n_{i}").alias("checked"), F.col(f"bad_{i}").alias("invalid_count"))
        for i, (c, f) in enumerate(formats.items())
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))


def detect_pii(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column_name, pii_type, found_by): content first, then the column name."""
    source = cells({"": df}, columns, ("text", "integer"))
    return source.named(_value_facts(source)).selectExpr(
        "column_name", f"coalesce({PII_BY_VALUES}, {PII_BY_NAME}) as pii_type",
        f"case when {PII_BY_VALUES} is not null then 'values' "
        f"when {PII_BY_NAME} is not null then 'name' end as found_by",
    )


def key_candidates(profile_df: DataFrame) -> DataFrame:
    """Columns without NULL whose every value is different."""
    return profile_df.where(
        "null_count = 0 and distinct_count = sample_size and sample_size > 0 and not sampled"
    ).select("table_name", "column_name", "ordinal", "distinct_count")


def primary_keys(profile_df: DataFrame) -> DataFrame:
    """The key-named integer candidate of each table, where there is exactly one."""
    named = key_candidates(profile_df.where(
        "declared_type in ('tinyint', 'smallint', 'int', 'bigint') "
        "and lower(column_name) rlike '(^id|_id|key)$'"
    ))
    return named.groupBy("table_name").agg(
        F.count("*").alias("_n"), F.first("column_name").alias("column_name")
    ).where("_n = 1").select("table_name", "column_name")


def profile_all(
    tables: dict[str, DataFrame], only: str | None = None, existing_df: DataFrame | None = None,
    failed: dict[str, str] | None = None, small_bytes: int = SMALL_BYTES,
) -> DataFrame:
    """Profiles of all tables, or of one; its rows replace the older ones of the same table.

    A table that cannot be analysed is left out and named in `failed`.
    """
    usable = {}
    for name in [only] if only else sorted(tables):
        try:
            tables[name].schema  # analysis happens here, so a broken table shows now
            usable[name] = tables[name]
        except Exception as error:  # noqa: BLE001 - reported to the caller, others go on
            if failed is None:
                raise
            failed[name] = str(error)
    fresh = _profiles(usable, small_bytes=small_bytes)
    if existing_df is None:
        return fresh
    return fresh.unionByName(existing_df.where(~F.col("table_name").isin(*usable)))
