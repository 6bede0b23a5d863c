"""Records from lines, NDJSON, CSV and TSV: ``text``, ``id`` and, where it is kept, the reason a line was skipped."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import JS_SPACE

#: Column names that are taken for the text, the first that is there.
TEXT_NAMES = tuple("text message comment body content msg review nachricht kommentar inhalt".split())
REASONS = ("json", "not-object", "no-text")


def lines(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """``text``: lines end at ``\\n``, a ``\\r`` before it is dropped, blank ones stay."""
    reader = spark.readStream if streaming else spark.read
    return reader.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r\z", "").alias("text"))


def ndjson(spark: SparkSession, path: str, text_field: str = "text", id_field: str = "id", on_bad_line: str = "skip") -> DataFrame:
    """``text, id`` of each object; see :func:`ndjson_lines` for what is skipped."""
    rows = ndjson_lines(spark, path, text_field, id_field)
    if on_bad_line == "throw":
        bad = F.concat(F.lit(f"{path}: a line is unusable ("), F.col("skipped"), F.lit("): "), F.substring("line", 1, 200))
        return rows.select(F.when(F.col("skipped").isNotNull(), F.raise_error(bad)).otherwise(F.col("text")).alias("text"), "id")
    if on_bad_line != "skip":
        raise ValueError("on_bad_line must be 'skip' or 'throw'")
    return rows.where("skipped is null").select("text", "id")


def ndjson_lines(spark: SparkSession, path: str, text_field: str = "text", id_field: str = "id") -> DataFrame:
    """``line, text, id, skipped``; ``skipped`` is one of :data:`REASONS` or null.  Blank lines are left out.

    Parsed as VARIANT; of a repeated key the last counts."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    rows = lines(spark, path).where(~F.col("text").rlike(rf"\A[{JS_SPACE}]*\z")).select(F.col("text").alias("line"), F.try_parse_json("text").alias("v"))
    kind = F.schema_of_variant("v")
    child = lambda name: F.try_variant_get("v", "$['" + name.replace("'", "\\'") + "']", "variant")
    is_object, is_array = kind.startswith("OBJECT"), kind.startswith("ARRAY")
    text, own = child(text_field), child(id_field)
    # A JSON array is an object too, one without a text.
    skipped = F.when(F.col("v").isNull(), "json").when(~(is_object | is_array), "not-object").when(~F.coalesce(F.schema_of_variant(text) == "STRING", F.lit(False)), "no-text")
    id_kind = F.schema_of_variant(own)
    usable = id_kind.isin("STRING", "BIGINT", "DOUBLE") | id_kind.startswith("DECIMAL")
    return rows.select("line", F.when(skipped.isNull(), F.try_variant_get("v", "$['" + text_field + "']", "string")).alias("text"), F.when(skipped.isNull() & usable, own.cast("string")).alias("id"), skipped.alias("skipped"))


def skip_counts(rows: DataFrame) -> DataFrame:
    return rows.where("skipped is not null").groupBy(F.col("skipped").alias("reason")).agg(F.count(F.lit(1)).alias("lines"))


def csv_rows(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, strict: bool = True) -> DataFrame:
    """All columns as strings.  ``strict`` tokenizes as the state machine that takes text behind a
    closing quote for part of the field, over splits of any file; Spark's own reader keeps the quotes then, and can't split a file."""
    if strict:
        return _strict_csv(spark, path, delimiter, header)
    reader = spark.read.option("header", header).option("sep", delimiter).option("multiLine", True).option("quote", '"').option("escape", '"').option("inferSchema", False).option("nullValue", "\0").option("emptyValue", "")
    return reader.csv(path)


def split_csv(text: str, delimiter: str = ",") -> Iterator[list[str]]:
    """Rows of fields: a quote opens only an empty field, ``""`` within quotes is one, an
    unquoted ``\\r`` is dropped."""
    row: list[str] = []
    field: list[str] = []
    quoted = False
    i = 0
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                field.append(c)
        elif c == '"' and not field:
            quoted = True
        elif c == delimiter:
            row.append("".join(field))
            field = []
        elif c == "\n":
            yield [*row, "".join(field)]
            row, field = [], []
        elif c != "\r":
            field.append(c)
        i += 1
    if row or field:
        yield [*row, "".join(field)]


def quoted_after(line: str, quoted: bool, delimiter: str = ",") -> bool:
    """Whether the end of a line lies within quotes, if its beginning does or doesn't."""
    if '"' not in line:
        return quoted
    empty, i = not quoted, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c != '"':
                empty = False
            elif line[i + 1 : i + 2] == '"':
                empty = False
                i += 1
            else:
                quoted = False
        elif c == '"' and empty:
            quoted = True
        elif c == delimiter:
            empty = True
        elif c != "\r":
            empty = False
        i += 1
    return quoted


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of lines of one split of a file, in order; a split may come in several runs."""
    for batch in batches:
        lines, files, starts = (c.to_pylist() for c in batch.columns)
        lo = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or (files[i], starts[i]) != (files[lo], starts[lo]):
                yield (files[lo], starts[lo]), lines[lo:i]
                lo = i


def _strict_csv(spark: SparkSession, path: str, delimiter: str, header: bool) -> DataFrame:
    """Each split is first walked for both cases, that it begins within quotes or not; which of them holds follows from the
    splits before it, one short row each on the driver.  Then rows are made split by split, and
    those that go over an end of a split from their pieces."""
    source = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for split, some in _by_split(batches):
            own = state.setdefault(split, [False, True, False])  # the end's state for both beginnings, and whether a row that came from before ends here
            for line in some:
                own[0], own[1] = quoted_after(line, own[0], delimiter), quoted_after(line, own[1], delimiter)
                own[2] |= not own[1]
        rows = [(*split, *own) for split, own in state.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()))], names=["f", "b", "plain", "quoted", "closed"])

    begins: dict[tuple[str, int], tuple[bool, int]] = {}  # within quotes, and in which split the row began that is open
    file, within, origin, ragged = None, False, 0, False
    for row in sorted(source.mapInArrow(walk, "f string, b long, plain boolean, quoted boolean, closed boolean").collect()):
        if row["f"] != file:
            file, within, origin = row["f"], False, row["b"]
        begins[row["f"], row["b"]] = within, origin
        if not within or row["closed"]:
            origin = row["b"]
        within = row["quoted"] if within else row["plain"]
        ragged |= within
    held = spark.sparkContext.broadcast(begins)
    most = 1 << 16  # lines that are cut into rows at once

    def fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of fields; pieces of rows that go over an end have ``f, origin, b`` and the text instead."""
        state: dict = {}

        def piece(split, lines, at, first):
            return pa.RecordBatch.from_arrays([pa.array([None], pa.list_(pa.string())), pa.array([split[0]]), pa.array([at], pa.int64()), pa.array([split[1]], pa.int64()), pa.array([0 if first else 1], pa.int32()), pa.array(["\n".join(lines)])], names=_PIECE)

        def whole(lines):
            found = list(split_csv("\n".join(lines) + "\n", delimiter))
            none = [None] * len(found)
            return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *(pa.array(none, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=_PIECE)

        for split, some in _by_split(batches):
            within, origin = held.value[split]
            own = state.setdefault(split, {"quoted": within, "head": [] if within else None, "rows": [], "open": [], "header": header and split[1] == 0})
            for line in some:
                own["quoted"] = quoted_after(line, own["quoted"], delimiter)
                if own["head"] is not None:
                    own["head"].append(line)
                    if not own["quoted"]:
                        yield piece(split, own["head"], origin, True)
                        own["head"] = None
                    continue
                own["open"].append(line)
                if not own["quoted"]:
                    own["rows"] += [] if own["header"] else own["open"]  # each file begins with its header
                    own["open"], own["header"] = [], False
                    if len(own["rows"]) >= most:
                        yield whole(own["rows"])
                        own["rows"] = []
        for split, own in state.items():
            if own["rows"]:
                yield whole(own["rows"])
            if own["head"]:
                yield piece(split, own["head"], held.value[split][1], True)
            if own["open"]:
                yield piece(split, own["open"], split[1], False)

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        parts = sorted(zip(*(table.column(c).to_pylist() for c in ("b", "place", "t")), strict=True))
        return pa.table({"f": pa.array(list(split_csv("\n".join(t for *_, t in parts), delimiter)), pa.list_(pa.string()))})

    rows = source.mapInArrow(fields, "fields array<string>, f string, origin long, b long, place int, t string")
    over = rows.where("fields is null").select("f", "origin", "b", "place", "t").groupBy("f", "origin").applyInArrow(joined, "f array<string>")
    body = rows.where("fields is not null").select(F.col("fields").alias("f"))
    body = body.unionByName(over) if ragged else body
    top = source.where("b = 0").limit(4096).mapInArrow(lambda batches: _first_row(batches, delimiter), "f array<string>").first()
    if top is None:
        return spark.createDataFrame([], "`_c0` string")
    names = list(top["f"]) if header else [f"_c{i}" for i in range(len(top["f"]))]
    return body.select(*(F.coalesce(F.get("f", F.lit(i)), F.lit("")).alias(name) for i, name in enumerate(names)))


_PIECE = ["fields", "f", "origin", "b", "place", "t"]


def _first_row(batches: Iterator[pa.RecordBatch], delimiter: str) -> Iterator[pa.RecordBatch]:
    text = "\n".join(line for batch in batches for line in batch.column(0).to_pylist())
    found = next(split_csv(text + "\n", delimiter), None) if text else None
    yield pa.RecordBatch.from_arrays([pa.array([found] if found else [], pa.list_(pa.string()))], names=["f"])


def column_of(names: list[str], wanted: str | int | None, what: str = "text") -> str:
    """The column named or numbered; failing that the only one, or the first of :data:`TEXT_NAMES`."""
    if isinstance(wanted, int):
        if not 0 <= wanted < len(names):
            raise ValueError(f"there is no column {wanted}; columns: {', '.join(names)}")
        return names[wanted]
    if wanted is not None:
        if wanted not in names:
            raise ValueError(f"there is no column {wanted!r}; columns: {', '.join(names)}")
        return wanted
    if len(names) == 1:
        return names[0]
    plain = {}
    for name in names:
        plain.setdefault(name.strip().lower(), name)
    for name in TEXT_NAMES:
        if name in plain:
            return plain[name]
    raise ValueError(f"which column holds the {what}? columns: {', '.join(names)}")


def csv(spark: SparkSession, path: str, column: str | int | None = None, id_column: str | int | None = None, delimiter: str = ",", header: bool = True, strict: bool = True) -> DataFrame:
    """``text, id``; rows with an empty text go, an empty id is null."""
    rows = csv_rows(spark, path, delimiter, header, strict)
    names = rows.columns
    text = F.col(f"`{column_of(names, column if column is not None or header or len(names) == 1 else 0)}`")
    own: Column = F.lit(None).cast("string") if id_column is None else F.nullif(F.col(f"`{column_of(names, id_column, 'id')}`"), F.lit(""))
    return rows.select(text.alias("text"), own.alias("id")).where("text is not null and text <> ''")


def records(spark: SparkSession, path: str, **options) -> DataFrame:
    """``text, id`` by the file's extension."""
    low = path.lower()
    if low.endswith((".ndjson", ".jsonl")):
        return ndjson(spark, path, **options)
    if low.endswith(".tsv"):
        return csv(spark, path, **{"delimiter": "\t"} | options)
    if low.endswith(".csv"):
        return csv(spark, path, **options)
    if low.endswith(".parquet"):
        rows = spark.read.parquet(path)
        text = F.col(f"`{column_of([f.name for f in rows.schema if isinstance(f.dataType, T.StringType)], options.get('column'))}`")
        own = options.get("id_column")
        return rows.select(text.alias("text"), (F.col(f"`{own}`").cast("string") if own else F.lit(None).cast("string")).alias("id"))
    return lines(spark, path).withColumn("id", F.lit(None).cast("string"))
