"""JSON documents {"matrix": ...}, {"vector": ...}, {"edges": ...}, {"labelled_edges": ...}, in any number of part files.

The parts of a document, one after the other in the order of their names, are the
document: an element of the outer array is a line, the first one opens the document,
the last one closes it. So a large document is written and read by many tasks, and
``cat part-*`` gives the file that other programs read. Real numbers have six decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.stage import running_sum, staged

POINTS = "array<array<bigint>>"


def number_text(v: Column, real: bool = False) -> Column:
    return F.format_string("%.6f", v.cast("double")) if real else v.cast("string")


def point_text(x: Column, y: Column, real: bool = True) -> Column:
    """[x, y]"""
    return F.concat(F.lit("["), number_text(x, real), F.lit(", "), number_text(y, real), F.lit("]"))


def segment_text(x1: Column, y1: Column, x2: Column, y2: Column, real: bool = True) -> Column:
    """[[x1, y1], [x2, y2]]"""
    return F.concat(F.lit("["), point_text(x1, y1, real), F.lit(", "), point_text(x2, y2, real), F.lit("]"))


def list_text(items: Column) -> Column:
    """[a, b, ...] of an array of texts."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def region_text(cx: Column, cy: Column, ring: Column) -> Column:
    """{"centroid": [x, y], "vertices": [[x, y], ...]} of a ring of structs (x, y)."""
    return F.concat(F.lit('{"centroid": '), point_text(cx, cy), F.lit(', "vertices": '), list_text(F.transform(ring, lambda p: point_text(p["x"], p["y"]))), F.lit("}"))


def edge_text() -> Column:
    return segment_text(*map(F.col, ("x1", "y1", "x2", "y2")), real=False)


def labelled_text() -> Column:
    return F.concat(F.lit('{"label": '), number_text(F.col("label")), F.lit(' , "vertices": '), edge_text(), F.lit("}"))


def document(elements: DataFrame, name: str, order: list[str]) -> DataFrame:
    """elements (order columns, json) -> (order columns, value): the lines of a document, in the order of columns that tell elements apart."""
    rows = running_sum(elements.withColumn("_one", F.lit(1).cast("long")), order, "_one", "_at")
    total = rows.agg(F.count("*").alias("_n"))
    head, tail = F.when(F.col("_at") == 0, F.lit(f'{{"{name}": [')).otherwise(""), F.when(F.col("_at") == F.col("_n") - 1, "]}").otherwise(", ")
    return rows.crossJoin(F.broadcast(total)).select(*order, F.concat(head, "json", tail).alias("value"))


def write(elements: DataFrame, path: str, name: str, order: list[str]) -> None:
    """Writes elements (order columns, json) as a document; none of them gives an empty one."""
    lines = staged(document(elements, name, order))
    if not lines.head(1):
        spark = elements.sparkSession
        spark.createDataFrame([(f'{{"{name}": []}}',)], "value string").write.mode("overwrite").text(path)
        return
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str, name: str, element: str) -> DataFrame:
    """(at, element) of a document, in one file of any layout or in the parts that write() makes; element is its type in DDL.

    The text is cut at commas, so that Spark splits one file among as many tasks as it
    does any other; an element begins where as many brackets have been closed as opened,
    which running sums over ranges tell. Documents hold numbers: strings, but for names,
    may not have commas or brackets. Only an element is ever in memory as a whole.
    """
    place = ["file", "block", "row"]
    cut = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    cut = staged(cut.where(~F.col("value").rlike(r"^\s*$")), "fragments")
    first = cut.agg(F.min(F.struct(*place))).first()[0]
    if first is None:
        return spark.createDataFrame([], f"at long, element {element}")
    is_first = (F.col("file") == first.file) & (F.col("block") == first.block) & (F.col("row") == first.row)
    head = F.regexp_replace("value", rf'^\s*\{{\s*"{name}"\s*:\s*\[', "")
    text = cut.withColumn("value", F.when(is_first, head).otherwise(F.col("value")))
    deep = running_sum(text.withColumn("step", (F.regexp_count("value", F.lit(r"[\[{]")) - F.regexp_count("value", F.lit(r"[\]}]"))).cast("long")), place, "step", "depth")
    begun = running_sum(deep.withColumn("one", (F.col("depth") == 0).cast("long")), place, "one", "before")
    whole = begun.groupBy((F.col("before") + F.col("one") - 1).alias("at")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*place, "value"))), lambda v: v["value"]), ",").alias("text"))
    whole = staged(whole, "elements")
    last = whole.agg(F.max("at")).first()[0]
    closed = F.when(F.col("at") == last, F.regexp_replace("text", r"\]\s*\}\s*$", "")).otherwise(F.col("text"))
    parsed = F.from_json(F.concat(F.lit('{"e": '), closed, F.lit("}")), f"e {element}")["e"]
    return whole.where(~closed.rlike(r"^\s*$")).select("at", parsed.alias("element"))


def write_matrix(grid: DataFrame, path: str, label: str = "label", real: bool = False) -> None:
    """{"matrix": [[...], ...]} of cells (x, y, label): a line for each x."""
    row = F.transform(F.array_sort(F.collect_list(F.struct("y", F.col(label).alias("v")))), lambda c: number_text(c["v"], real))
    write(grid.groupBy("x").agg(list_text(row).alias("json")), path, "matrix", ["x"])


def read_matrix(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Cells (x, y, label)."""
    rows = read(spark, path, "matrix", f"array<{kind}>")
    return rows.select(F.col("at").alias("x"), F.posexplode("element").alias("y", "label")).withColumn("y", F.col("y").cast("long"))


def write_vector(items: DataFrame, path: str, order: list[str], item: Column) -> None:
    """{"vector": [...]} of item, a text such as number_text() or point_text(), in the order of columns that tell rows apart."""
    write(items.select(*order, item.alias("json")), path, "vector", order)


def read_vector(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(at, element)"""
    return read(spark, path, "vector", kind)


def loader(spark: SparkSession, folder: str, kind: str = "double"):
    """A function of a name that reads the vector of that name in folder."""
    return lambda name: read_vector(spark, f"{folder.rstrip('/')}/{name}.json", kind)


def write_edges(edges: DataFrame, path: str) -> None:
    """{"edges": [[[x1, y1], [x2, y2]], ...]}"""
    write(edges.select("x1", "y1", "x2", "y2", edge_text().alias("json")), path, "edges", ["x1", "y1", "x2", "y2"])


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(x1, y1, x2, y2)"""
    return read(spark, path, "edges", POINTS).select(*_ends("element"))


def write_labelled_edges(edges: DataFrame, path: str) -> None:
    """{"labelled_edges": [{"label": n, "vertices": [[x1, y1], [x2, y2]]}, ...]}"""
    order = ["label", "x1", "y1", "x2", "y2"]
    write(edges.select(*order, labelled_text().alias("json")), path, "labelled_edges", order)


def read_labelled_edges(spark: SparkSession, path: str) -> DataFrame:
    """(label, x1, y1, x2, y2)"""
    rows = read(spark, path, "labelled_edges", f"struct<label:bigint,vertices:{POINTS}>")
    return rows.select("element.label", *_ends("element.vertices"))


def _ends(points: str) -> list[Column]:
    return [F.get(F.get(points, F.lit(i)), F.lit(j)).alias(f"{c}{i + 1}") for i in (0, 1) for j, c in enumerate("xy")]
